"""Repeated byte strings by a logarithmic family of suffix arrays.

Every batch of texts gets a suffix array: its suffixes, sampled at anchors (see ``repeats``), in byte order of their first
HEAD bytes, with one row for each interval of suffixes that begin alike. The array is sharded by a hash of these bytes, so
that two arrays meet shard by shard, in order and without a shuffle. A new array is merge-scanned against all levels for
heads that recur, in it or in a level; then, as long as the last level stands for as many batches as the new array, the
two are merged to a level of twice the size. Heads that recur are extended to full length: the texts around them are
compared byte string by byte string, by a fingerprint of LENGTH bytes.

``SuffixIndex`` keeps texts, suffixes, levels and recurring heads as tables and can be opened again, so that later batches
meet all earlier ones.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; rows with equal ids or texts
are separate documents, each a place where a string starts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import dropped, mixed, parts, reopened, rolling, sharded, signed, stored, tuned
from .links import grouped_runs
from .repeats import anchors, by_content, contexts_in, counted_spans, covered, distinct_texts, in_texts, keyed, lists, merged, one_span, repeated_in_group, spans_batch

LENGTH, HEAD, BATCHES = 400, 32, 4
with np.errstate(over="ignore"):
    BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_tokens(text: bytes) -> np.ndarray:
    return BYTE[np.frombuffer(text, np.uint8)]


SUFFIX = "prefix binary, h long, k1 long, k2 long, size int, firsts array<long>, n long"


def suffixes(texts: DataFrame, length: int, head: int) -> DataFrame:
    """The sampled suffixes of each text: prefix (their first ``head`` bytes) with its hash h, where the strings of
    ``length`` bytes start that they stand for (``size`` of them from each of ``firsts``), and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix, h, row, size, firsts, n = [], [], [], [], [], []
            for i, (text, copies) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist())):
                x, place, first, last = anchors(byte_tokens(text), length, head)
                if not len(x):
                    continue
                own = contexts_in(x, place, first, last, lambda f, z: text[f : z + length])  # noqa: B023
                at = [j for j, _ in own]
                prefix += [text[p : p + head] for p in place[at].tolist()]
                h.append(x[at])
                row.append(np.full(len(own), i))
                size.append((last - first + 1)[at])
                firsts += [f for _, f in own]
                n += [len(f) * copies for _, f in own]
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(signed(np.concatenate(h))), b.column("k1").take(at), b.column("k2").take(at), pa.array(np.concatenate(size).astype(np.int32)), lists(firsts), pa.array(n, pa.int64())], ["prefix", "h", "k1", "k2", "size", "firsts", "n"])

    return texts.select("k1", "k2", "text", "copies").mapInArrow(run, SUFFIX)


class SuffixFamily:
    """Levels of suffix arrays (prefix, h, n), each with the number of batches it stands for, and the heads that recur."""

    ARRAY = "prefix binary, h long, n long"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []
        self.recurring: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """``batch``: prefix, h, n of the suffixes of a batch."""
        new = self._array(batch)
        # Merge scan: heads of the batch that occur twice in it, or in a level.
        found = new.where("n > 1").select("h")
        for _, level in self.levels:
            found = found.union(new.join(level.select("prefix").hint("merge"), "prefix", "left_semi").select("h"))
        self.recurring.append(stored(found.distinct(), "recurring"))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            both = self._merged(old, new)
            dropped(old, new)
            new, size = both, size * 2
        self.levels.append((size, new))

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two arrays as one, read side by side in their order."""
        b = b.select("prefix", F.col("h").alias("_h"), F.col("n").alias("_n")).hint("merge")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
        return sharded(a.join(b, "prefix", "full_outer").select("prefix", F.coalesce("h", "_h").alias("h"), n.alias("n")), "suffixes", "prefix", order=True)

    def _array(self, rows: DataFrame) -> DataFrame:
        return sharded(rows.groupBy("prefix").agg(F.min("h").alias("h"), F.sum("n").alias("n")), "suffixes", "prefix", order=True)

    def heads(self) -> DataFrame:
        """h of every head that recurs."""
        out = self.recurring[0]
        for r in self.recurring[1:]:
            out = out.unionByName(r)
        return out.distinct()


class SuffixIndex:
    """Texts, suffixes and the family over them, in tables. ``save`` and ``open`` carry it from session to session."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, head: int = HEAD):
        tuned(spark)
        self.spark, self.length, self.head = spark, length, head
        self.texts: list[DataFrame] = []
        self.rows: list[DataFrame] = []
        self.family = SuffixFamily(spark)

    def add(self, docs: DataFrame) -> None:
        """One batch more, as one array."""
        texts = distinct_texts(docs)
        rows = stored(suffixes(texts, self.length, self.head), "suffix-rows")
        self.texts.append(texts)
        self.rows.append(rows)
        self.family.add(rows)

    def add_all(self, docs: DataFrame, batches: int = BATCHES) -> None:
        """``docs`` in so many batches by a hash of their texts, one after the other."""
        texts = distinct_texts(docs)
        rows = suffixes(texts, self.length, self.head).withColumn("batch", F.pmod("k1", F.lit(batches)).cast("int"))
        rows = stored(rows, "suffix-rows", partition_by="batch")
        self.texts.append(texts)
        self.rows.append(rows)
        for i in range(batches):
            self.family.add(rows.where(F.col("batch") == i))

    def all_texts(self) -> DataFrame:
        """Each distinct text with its copies in all batches."""
        if len(self.texts) == 1:
            return self.texts[0]
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed, and leaves equal keys apart.
        out = self.spark.read.parquet(*[t.doclathe_path for t in self.texts])
        return out.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))

    def matches(self, hot: int | None = None) -> DataFrame:
        """k1, k2, spans: bytes in strings of ``length`` bytes that also start elsewhere, in any batch."""
        rows = self.rows[0].select("h", "k1", "k2", "size", "firsts")
        for r in self.rows[1:]:
            rows = rows.unionByName(r.select("h", "k1", "k2", "size", "firsts"))
        if len(self.rows) > 1:
            rows = rows.distinct()  # a text of two batches
        rows = stored(rows.join(self.family.heads(), "h"), "suspects")
        return long_matches(self.all_texts(), rows, self.length, hot or repeats.HOT)

    def result(self, docs: DataFrame, with_text: bool = True, hot: int | None = None) -> DataFrame:
        """What is left of ``docs``, rows that have been added; see ``suffix_dedup``."""
        out = cut_bytes(self.all_texts(), self.matches(hot), self.length, with_text)
        return keyed(docs).select("doc_id", "k1", "k2").join(out, ["k1", "k2"]).drop("k1", "k2")

    def save(self, path: str) -> None:
        state = {"length": self.length, "head": self.head, "buckets": parts(self.spark), "texts": [t.doclathe_path for t in self.texts], "rows": [r.doclathe_path for r in self.rows], "recurring": [r.doclathe_path for r in self.family.recurring], "levels": [[n, t.doclathe_path] for n, t in self.family.levels]}
        self.spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        state = json.loads(spark.read.text(path).first()[0])
        out, read = cls(spark, state["length"], state["head"]), spark.read.parquet
        out.texts = [reopened(spark, p, "k1 long, k2 long, text string, copies long", state["buckets"], ["k1", "k2"]) for p in state["texts"]]
        out.family.levels = [(n, reopened(spark, p, SuffixFamily.ARRAY, state["buckets"], ["prefix"])) for n, p in state["levels"]]
        for into, paths in ((out.rows, state["rows"]), (out.family.recurring, state["recurring"])):
            for p in paths:
                into.append(read(p))
                into[-1].doclathe_path = p
        return out

    def dropped(self) -> None:
        """Deletes all tables."""
        dropped(*self.texts, *self.rows, *self.family.recurring, *[t for _, t in self.family.levels])


def long_matches(texts: DataFrame, suspects: DataFrame, length: int, hot: int) -> DataFrame:
    """k1, k2, spans of bytes in strings of ``length`` bytes that also start elsewhere; ``suspects``: h, k1, k2, size,
    firsts of the suffixes whose head recurs. See ``by_content`` for heads with more than ``hot`` rows."""
    large = stored(suspects.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > hot).select("h"), "large")
    s = F.substring("b", (F.element_at("firsts", 1) + 1).cast("int"), F.col("size") - 1 + length).alias("s")

    def windows(s: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all strings of ``length`` bytes, and how many each row has."""
        s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
        offsets = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1].astype(np.int64)
        data = np.frombuffer(s.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sizes = offsets[1:] - offsets[:-1] - length + 1
        at = np.repeat(offsets[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return rolling(BYTE[data], length)[at], sizes

    def kernel(c: dict, starts: np.ndarray) -> pa.RecordBatch | None:
        w, sizes = windows(c["s"])
        flag = repeated_in_group(w, starts, sizes) | np.repeat(np.asarray(c["many"]), sizes)
        return spans_batch(c, flag, sizes, length)

    def compared(rows: DataFrame) -> DataFrame:
        rows = in_texts(texts, rows, s).select("h", "k1", "k2", "firsts", "many", "s")
        return grouped_runs(rows, ["h"], kernel, "k1 long, k2 long, first long, last long", at_most=4000).select("k1", "k2", one_span())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                w, sizes = windows(part.column("s"))
                at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h", "k1", "k2", "firsts", "many")), pa.ListArray.from_arrays(pa.array(at), pa.array(signed(w)))], ["h", "k1", "k2", "firsts", "many", "w"])

    if large.isEmpty():
        return compared(suspects)
    out = compared(suspects.join(large, "h", "left_anti"))
    contexts = in_texts(texts, suspects.join(large, "h"), F.xxhash64(s).alias("c1"), F.xxhash64(F.lit(1), s).alias("c2")).drop("many")
    left, known = by_content(stored(contexts, "contexts"), length, hot)
    out = out.unionByName(known).unionByName(compared(left.where(F.col("rows") <= hot)))
    if (more := left.where(F.col("rows") > hot)).isEmpty():
        return out
    rows = in_texts(texts, more, s).mapInArrow(listed, "h long, k1 long, k2 long, firsts array<long>, many boolean, w array<long>")
    return out.unionByName(counted_spans(rows, length))


def cut_bytes(texts: DataFrame, spans: DataFrame, length: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = (b.column("text").cast(pa.binary()), b.column("copies"), b.column("firsts"), b.column("lasts"))
            for text, copies, firsts, lasts in zip(*(c.to_pylist() for c in cols)):
                if copies > 1 and len(text) >= length:
                    firsts, lasts = [0], [len(text)]
                a, z = merged(np.array(firsts or [], np.int64), np.array(lasts or [], np.int64))
                kept = b"".join(text[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(text)])) if len(a) else text
                out.append((len(text), len(text) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None, a.tolist() if with_text else None, z.tolist() if with_text else None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array([r[j] for r in out], k) for j, k in enumerate(kinds))], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "firsts", "lasts"])

    return covered(texts, spans).mapInArrow(run, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, firsts array<long>, lasts array<long>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, with_text: bool = True, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), firsts, lasts (removed spans) of each row; the
    last three are null without ``with_text``. ``hot`` (default: ``repeats.HOT``) is the number of suffixes with one head
    that are compared side by side in a task at most. The result is a table; all others are deleted."""
    index = SuffixIndex(docs.sparkSession, length, head)
    index.add_all(docs, batches)
    out = stored(index.result(docs, with_text, hot), "suffix-dedup")
    index.dropped()
    return out
