"""A corpus pipeline in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
defined cases of a stage are those of its operator. In all of them a null text counts as empty, a null id stands for
itself, repeated rows are decided on one by one unless a stage says otherwise, an empty table stays empty, and further
columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe.llm.bpe import bpe_encode
from doclathe.llm.common import dropped, stored, unused
from doclathe.llm.decontaminate import without_leaks
from doclathe.llm.line_dedup import line_dedup
from doclathe.llm.simhash import one_of_each
from doclathe.llm.toxicity import fitted, scorer

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half go. A text without terms has the score of the labels' share, and stays
    unless most labels are toxic; without labels all stay."""
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return docs.withColumn(score, scorer(docs, model)).where(F.col(score) < 0.5).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in the largest document that holds them only; n_chars follows the text. Every document stays; a
    null text comes back as the empty one, and rows with the largest id keep the line together."""
    also = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = line_dedup(docs, also=also)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return out.select(*[new[c] if c in new else F.col(f"`in_{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row with the smallest id stays; texts without words are copies of each other."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go; texts without words stay, and all if there are no items."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of each document; a text without tokens has an empty list."""
    return bpe_encode(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Models, covering hashes and BPE have no SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
