"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line with ASCII white space stripped and A-Z lower-cased. ``LineIndex`` is state in tables: postings
(key, document), exact counts (documents that hold a key, the largest of them) and one row for each shard of the key space
with a cuckoo filter of the shard's frequent keys. Inserting documents counts their keys and adds those that become
frequent to their shards' filters; deleting documents counts again what they held and removes from the filters the keys
that are frequent no more. Documents are streamed against the filters, only lines that pass are looked up in the exact
counts, and what has to go comes back by document.

Defined cases: a null or empty text is one empty line; rows with equal ids are separate documents that are the "largest"
together, and are deleted together; a null id is smaller than any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BROADCAST_ROWS, Held, dropped, fresh, small, stored, texts_of, tuned

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard's filter, about.
SHARD_KEYS = 50_000
#: Filters of up to so many bytes travel with the tasks (some 27 million keys); beyond, every line is looked up.
SIEVE_BYTES = 64 << 20


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(BLANK) for x in text.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def hashed(key: bytes) -> tuple[int, int]:
    """128 bits of a key, as two signed longs."""
    d = xxhash.xxh3_128_digest(key)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class CuckooFilter:
    """Two candidate buckets of four 16-bit fingerprints for each key; supports insertion and deletion.

    A filter that is full is followed by one of twice its size, so it grows without its keys."""

    SLOTS, KICKS, LOAD = 4, 200, 0.85
    TURN, M64 = 0x5BD1E9955BD1E995, (1 << 64) - 1

    def __init__(self, capacity: int):
        n = 1
        while n * self.SLOTS * self.LOAD < max(capacity, 1):
            n *= 2
        self.parts: list[tuple[int, array]] = []  # (mask of bucket numbers, cells)
        self.n = 0
        self._grow(n)

    def _grow(self, buckets: int) -> None:
        self.parts.append((buckets - 1, array("H", bytes(2 * self.SLOTS * buckets))))
        self.used = 0

    def _places(self, h: int, mask: int) -> tuple[int, int, int]:
        fp = (h & self.M64) >> 48 or 1
        return fp, h & mask, (h & mask) ^ self._jump(fp, mask)

    def _jump(self, fp: int, mask: int) -> int:
        return ((fp * self.TURN & self.M64) >> 20) & mask

    def add(self, h: int) -> None:
        self.n += 1
        mask, cells = self.parts[-1]
        if self.used >= self.LOAD * len(cells) or not self._put(h, mask, cells):
            self._grow(2 * (mask + 1))
            self._put(h, *self.parts[-1])
        self.used += 1

    def _put(self, h: int, mask: int, cells: array) -> bool:
        fp, a, b = self._places(h, mask)
        for bucket in (a, b):
            for i in range(4 * bucket, 4 * bucket + 4):
                if not cells[i]:
                    cells[i] = fp
                    return True
        moved, bucket = [], a
        for k in range(self.KICKS):
            i = 4 * bucket + k % 4
            moved.append((i, cells[i]))
            fp, cells[i] = cells[i], fp
            bucket ^= self._jump(fp, mask)
            for j in range(4 * bucket, 4 * bucket + 4):
                if not cells[j]:
                    cells[j] = fp
                    return True
        for i, old in reversed(moved):  # no place was found: as before
            cells[i] = old
        return False

    def remove(self, h: int) -> bool:
        """Takes a key out that has been added; whether its fingerprint was there."""
        for at in range(len(self.parts) - 1, -1, -1):
            mask, cells = self.parts[at]
            fp, a, b = self._places(h, mask)
            for bucket in (a, b):
                for i in range(4 * bucket, 4 * bucket + 4):
                    if cells[i] == fp:
                        cells[i] = 0
                        self.n -= 1
                        self.used -= at == len(self.parts) - 1
                        return True
        return False

    def contains(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h).astype(np.int64).view(np.uint64)
        fp = h >> np.uint64(48)
        fp = np.where(fp == 0, np.uint64(1), fp)
        out = np.zeros(len(h), bool)
        for mask, cells in self.parts:
            table = np.frombuffer(cells, np.uint16).reshape(-1, 4)
            first = h & np.uint64(mask)
            with np.errstate(over="ignore"):
                second = first ^ ((fp * np.uint64(self.TURN) >> np.uint64(20)) & np.uint64(mask))
            own = fp.astype(np.uint16)[:, None]
            out |= (table[first] == own).any(1) | (table[second] == own).any(1)
        return out

    def dump(self) -> bytes:
        head = json.dumps([self.n, self.used, [m for m, _ in self.parts]]).encode()
        return head + b"\n" + b"".join(c.tobytes() for _, c in self.parts)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        head, _, rest = bytes(data).partition(b"\n")
        out = cls.__new__(cls)
        out.n, out.used, masks = json.loads(head)
        out.parts, at = [], 0
        for m in masks:
            cells = array("H")
            cells.frombytes(rest[at : (at := at + 2 * cls.SLOTS * (m + 1))])
            out.parts.append((m, cells))
        return out


class Sieve:
    """The filters of all shards."""

    def __init__(self, rows: list[tuple[int, bytes]], shards: int):
        self.shards, self.filters = shards, {s: CuckooFilter.load(d) for s, d in rows}

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        shard, out = np.asarray(h2) % self.shards, np.zeros(len(h1), bool)
        for s in np.unique(shard):
            if int(s) in self.filters:
                at = np.flatnonzero(shard == s)
                out[at] = self.filters[int(s)].contains(h1[at])
        return out


def postings_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id: the distinct long lines of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, ids = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b)):
                for key in {k for k in line_keys(text) if long_enough(k, min_chars)}:
                    x, y = hashed(key)
                    h1.append(x)
                    h2.append(y)
                    ids.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return fresh(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "h1 long, h2 long, doc_id long")


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("refs"), F.max("doc_id").alias("keeper"))


class LineIndex:
    """postings (h1, h2, doc_id), counts (h1, h2, refs, keeper) and filters (shard, data), each a table. ``insert`` and
    ``delete`` return the index after the change; tables that it no longer needs are deleted by ``dropped``."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.postings, self.counts, self.filters, self.shards, self.min_docs, self.min_chars = postings, counts, filters, shards, min_docs, min_chars

    @classmethod
    def over(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        tuned(docs.sparkSession)
        postings = stored(postings_of(docs, min_chars), "line-postings")
        counts = stored(_counted(postings), "line-counts")
        n = counts.where(F.col("refs") >= min_docs).count()
        out = cls(postings, counts, None, max(1, -(-n // shard_keys)), min_docs, min_chars)
        out.filters = stored(out._changed(None, out.frequent().select("h1", "h2", F.lit(True).alias("add"))), "line-filters")
        return out

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("refs") >= self.min_docs).select("h1", "h2", "keeper")

    def _changed(self, filters: DataFrame | None, changes: DataFrame) -> DataFrame:
        """The shards' filters after keys have come (add) or gone."""
        filters = changes.sparkSession.createDataFrame([], "shard long, data binary") if filters is None else filters
        changes = changes.select(F.pmod("h2", F.lit(self.shards)).alias("shard"), "h1", "add")

        def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.load(old["data"].iloc[0]) if len(old) else CuckooFilter(len(new))
            for h, add in sorted(zip(new["h1"].tolist(), new["add"].tolist())):
                f.add(h) if add else f.remove(h)
            return pd.DataFrame({"shard": [(old if len(old) else new)["shard"].iloc[0]], "data": [f.dump()]})

        return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, "shard long, data binary")

    def _after(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        """The index with new postings and counts; filters follow the keys that have become frequent, or no longer are."""
        counts = stored(counts, "line-counts")
        was = self.counts.select("h1", "h2", (F.col("refs") >= self.min_docs).alias("was"))
        now = counts.select("h1", "h2", (F.col("refs") >= self.min_docs).alias("now"))
        both = was.join(now, ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
        changes = both.where("was <> now").select("h1", "h2", F.col("now").alias("add"))
        out = LineIndex(stored(postings, "line-postings"), counts, None, self.shards, self.min_docs, self.min_chars)
        out.filters = stored(self._changed(self.filters, changes), "line-filters")
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        new = postings_of(docs, self.min_chars)
        more = _counted(new).select("h1", "h2", F.col("refs").alias("_r"), F.col("keeper").alias("_k"))
        refs = F.coalesce("refs", F.lit(0)) + F.coalesce("_r", F.lit(0))
        counts = self.counts.join(more, ["h1", "h2"], "full_outer").select("h1", "h2", refs.alias("refs"), F.greatest("keeper", "_k").alias("keeper"))
        return self._after(self.postings.unionByName(new), counts)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        ids = fresh(doc_ids, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        left = self.postings.join(ids, "doc_id", "left_anti").select("h1", "h2", "doc_id")
        touched = self.postings.join(ids, "doc_id", "left_semi").select("h1", "h2").distinct()
        again = _counted(left.join(touched, ["h1", "h2"], "left_semi"))
        return self._after(left, self.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(again))

    def sieve(self, most: int = SIEVE_BYTES) -> Sieve | None:
        """The filters, if they have at most so many bytes."""
        if (self.filters.agg(F.sum(F.length("data"))).first()[0] or 0) > most:
            return None
        return Sieve([(r["shard"], bytes(r["data"])) for r in self.filters.collect()], self.shards)

    def dropped(self) -> None:
        dropped(self.postings, self.counts, self.filters)


OUT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def line_dedup(docs: DataFrame, index: LineIndex | None = None, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, with_text: bool = True, also: tuple[str, ...] = (), sieve_bytes: int = SIEVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256, kept_text (null without ``with_text``), and the
    columns in ``also`` as in_<name>. ``index`` is one that holds the documents; without, one is built over ``docs``."""
    tuned(docs.sparkSession)
    own = index or LineIndex.over(docs, min_docs, min_chars)
    min_chars = own.min_chars
    sieve = own.sieve(sieve_bytes)
    held = Held(docs.sparkSession, sieve)
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    # What becomes of a line depends on its document's id and on the line: equal rows have one key.
    src = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("_x"), F.xxhash64(F.lit(1), doc_id, text).alias("_y"), *[F.col(f"`{c}`").alias(f"_also_{c}") for c in also])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = held.value
        for b in batches:
            row, line, a, c = [], [], [], []
            for r, text in enumerate(texts_of(b)):
                for i, key in enumerate(line_keys(text)):
                    if long_enough(key, min_chars):
                        x, y = hashed(key)
                        row.append(r)
                        line.append(i)
                        a.append(x)
                        c.append(y)
            a, c = np.array(a, np.int64), np.array(c, np.int64)
            keep = np.flatnonzero(sieve.contains(a, c)) if sieve else np.arange(len(a))
            at = pa.array(np.array(row, np.int64)[keep])
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in ("_x", "_y", "doc_id")), pa.array(np.array(line, np.int32)[keep]), pa.array(a[keep]), pa.array(c[keep])], ["_x", "_y", "doc_id", "line", "h1", "h2"])

    lines = src.select("_x", "_y", "doc_id", "text").mapInArrow(passing, "_x long, _y long, doc_id long, line int, h1 long, h2 long")
    hits = lines.join(small(own.frequent(), broadcast_rows), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    hits = stored(hits.groupBy("_x", "_y").agg(F.collect_set("line").alias("_drop")), "line-hits")
    if index is None:
        own.dropped()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"]
        for b in batches:
            out = []
            for doc_id, text, gone in zip(b.column("doc_id").to_pylist(), texts_of(b), b.column("_drop").to_pylist()):
                lines, gone = text.split(b"\n"), set(gone or ())
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
                out.append((doc_id, len(lines), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)] + [b.column(f"_also_{c}") for c in also], names + [f"_also_{c}" for c in also])

    schema = OUT + "".join(f", `_also_{f.name}` {f.dataType.simpleString()}" for c in also for f in [docs.schema[c]])
    out = src.join(small(hits, broadcast_rows), ["_x", "_y"], "left").drop("_x", "_y").mapInArrow(apply, schema)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text", *[F.col(f"`_also_{c}`").alias(f"in_{c}") for c in also])
