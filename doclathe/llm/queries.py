"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_dedup

    return simhash_dedup(table(spark, sf_dir, "documents")).drop("copies")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept", "firsts", "lasts")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontamination

    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False).drop("ids")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_dedup import phrase_dedup

    return phrase_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


OP10_SQL = """
with lines as (
  select doc_id, i, line, regexp_replace(line, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') as s
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls, unnest(range(1, len(ls) + 1)) as i, ls[i] as line from documents)
), keyed as (
  select doc_id, i, line, translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), freq as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), marked as (
  select keyed.doc_id, i, line, freq.k is not null and keyed.doc_id <> keeper as gone from keyed left join freq using (k)
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


OP1_SQL = """
with recursive v as (
  select vec_id, label, [x::double for x in embedding] as e from embeddings
), pairs as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) as (
  select vec_id, vec_id from v union select r.x, p.y from reach r join pairs p on r.y = p.x
), n as (select x, count(*) as n from pairs group by x), c as (select x, min(y) as component_id from reach group by x)
select v.vec_id, coalesce(n.n, 0) as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join c on c.x = v.vec_id left join n on n.x = v.vec_id
"""


OP9_SQL = """
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), win as (
  select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w)
), rep as (
  select doc_id, i from win where h in (select h from win group by h having count(*) > 1)
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as j from rep
), words as (
  select doc_id, unnest(range(1, len(ws) + 1)) as j, unnest(ws) as word from w
), kept as (
  select words.doc_id, count(*) as n, string_agg(word, ' ' order by j) as s from words anti join gone using (doc_id, j) group by words.doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from w left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_phrase_dedup": OP9_SQL, "op1_embedding_dedup": OP1_SQL, "op10_line_dedup": OP10_SQL}
