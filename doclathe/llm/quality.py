"""Quality selection by importance resampling.

Two bag-of-n-gram models over hashed words and word pairs: one of target text (rows labelled as good), one of all rows,
both counted over the whole tables. A text's log importance weight is the sum over its n-grams of the log ratio of the
two models; Gumbel noise is added and the k largest are the sample, drawn without replacement in proportion to the
weights. ``k`` defaults to the labels' share of good rows, of all rows. Words are cut into runs of letters or digits
and runs of other signs.

Defined cases: null and empty texts have weight zero; without good labels every weight is zero and nothing is drawn
unless ``k`` is given; ids with several labels count as good if one says so; of rows with equal keys those with smaller
ids are drawn first, null ids before them, and rows with equal ids and keys are interchangeable; other columns, of both
tables, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, mixed, stored, tuned

BUCKETS = 1 << 14
CUT = re.compile(r"\w+|[^\w\s]+")
#: Up to so many good ids travel with the tasks; beyond, they meet the rows in a shuffle.
BROADCAST_IDS = 2_000_000


def _hashes(token: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in CUT.findall(token.lower()))


_memo = Memo(_hashes)


def ngrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words and word pairs, with repeats."""
    one = np.fromiter(chain.from_iterable(map(_memo.__getitem__, text.split())), np.uint64)
    with np.errstate(over="ignore"):
        two = mixed(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
    return (np.concatenate((one, two)) % np.uint64(buckets)).astype(np.int64)


def _good(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") > 0).cast("long")), F.lit(0))).first()
    ids = known.where("quality > 0").select("doc_id", F.lit(True).alias("target"))
    if good <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id", "left"), good / n if n else 0.0


def log_ratios(marked: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log of target over raw probability of every bucket, smoothed by one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b.column("text").to_pylist(), b.column("target").to_pylist()):
                n = np.bincount(ngrams(text, buckets), minlength=buckets)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    got = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(buckets), np.ones(buckets)
    for b, r, t in got:
        raw[b] += r
        target[b] += t
    if target.sum() == buckets:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def top_k(df: DataFrame, k: int, key: str = "gumbel_key", tie: str = "doc_id") -> DataFrame:
    """The rows with the k largest keys. The k-th key, to 2^-20, is found digit by digit from counts of at most 2^16
    buckets, so no task sorts or holds the whole table; rows within 2^-20 of it are taken by key and then by ``tie``."""
    if k <= 0:
        return df.limit(0)
    df = df.withColumn("_o", _ordered(F.col(key)))
    low, fixed, need = -(1 << 63), 64, k
    while fixed:
        fixed -= 16
        step = 1 << fixed
        inside = df.where((F.col("_o") >= low) & (F.col("_o") <= low + step * 65535 + (step - 1)))
        digit = F.shiftrightunsigned(F.col("_o") - F.lit(low), fixed) if low != -(1 << 63) else F.shiftright(F.col("_o"), fixed) + F.lit(32768)
        counts = {r["d"]: r["n"] for r in inside.groupBy(digit.cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if need <= counts[d]:
                low += d * step
                break
            need -= counts[d]
        else:
            return df.drop("_o")
    above, equal = df.where(F.col("_o") > low), df.where(F.col("_o") == low)
    return above.unionByName(equal.orderBy(F.col(key).desc(), tie).limit(need)).drop("_o")


def _ordered(x):
    """Longs in the order of doubles, to 2^-20; the range of the keys is far inside."""
    return F.round(F.greatest(F.least(x, F.lit(4e12)), F.lit(-4e12)) * F.lit(float(1 << 20))).cast("long")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """The sample: doc_id, log_weight, gumbel_key, n_rows (of the table) of each row drawn."""
    spark = docs.sparkSession
    tuned(spark)
    marked, share = _good(docs, labels)
    held = spark.sparkContext.broadcast(log_ratios(marked, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            w = [float(table[ngrams(t, buckets)].sum()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = plain.mapInArrow(weigh, "doc_id long, log_weight double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = stored(scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    n = scored.count()
    return top_k(scored, round(share * n) if k is None else k).withColumn("n_rows", F.lit(n).cast("long"))
