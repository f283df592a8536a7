"""Byte-level BPE over long texts by overlapping chunks.

A text of more than CHUNK characters is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from
its own start, which may lie inside a pre-token. A scan for pre-tokens looks only ahead, so two scans that share one
boundary agree from there on: at the first boundary that both chunks have in their overlap the text is cut. The pieces
between cuts are encoded in parallel, and only their ids come together, by order, for the text's digests; decoding
concatenates the tokens' bytes. Where an overlap holds no common boundary (a run of more than OVERLAP characters without
any), what follows isn't known to be in step: the text from the last cut on is then one piece.

Defined cases: null counts as the empty text (no tokens); a repeated row or id is a row of its own; an empty table gives
an empty result; strings that look like special tokens are ordinary text; other columns pass only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, tuned

CHUNK, OVERLAP = 1 << 15, 1 << 10


class ByteBpe:
    """A rank file with a pre-token pattern; ``encode`` and ``decode`` as the tiktoken library has them."""

    _loaded: dict[tuple[str, str], ByteBpe] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}

    @classmethod
    def of(cls, data: bytes, pattern: str) -> ByteBpe:
        key = (hashlib.sha256(data).hexdigest(), pattern)
        if key not in cls._loaded:
            cls._loaded[key] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)
        return cls._loaded[key]

    def encode(self, text: str) -> list[int]:
        return self.own.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def boundaries(self, text: str, start: int, stop: int, whole: bool) -> Iterator[int]:
        """Starts of pre-tokens of text[start:] up to ``stop``. Unless ``whole``, the text goes on after its end, and
        what the scan finds at the very end isn't trusted."""
        for m in self.pattern.finditer(text, start):
            if m.start() >= stop or not whole and m.end() >= len(text) - 1:
                return
            yield m.start()


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(offset, text) of overlapping chunks; each has ``overlap`` characters of its successor."""
    for at in range(0, max(len(text), 1), chunk):
        yield at, text[at : at + chunk + overlap]


def scan(bpe: ByteBpe, at: int, piece: str, total: int, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Absolute boundaries in a chunk's first ``overlap`` characters and in those it shares with its successor."""
    head = [at] if at == 0 else []
    tail: list[int] = []
    for b in bpe.boundaries(piece, 0, chunk + overlap, at + len(piece) >= total):
        if at and b < overlap:
            head.append(at + b)
        if b >= chunk:
            tail.append(at + b)
    return head, tail


def stitch(scans: list[tuple[int, list[int], list[int]]]) -> list[int]:
    """Where the pieces of one text start; (offset, head, tail) of each chunk, in order. ``piece_starts`` in plain Python."""
    cuts = [0]
    for (_, _, tail), (_, head, _) in zip(scans, scans[1:]):
        held = set(head)
        if (found := next((b for b in tail if b in held), None)) is None:
            break
        cuts.append(found)
    return cuts


def pieces(text: str, cuts: list[int]) -> Iterator[str]:
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        yield text[a:b]


def piece_starts(scans: DataFrame) -> DataFrame:
    """_row, at, no (of the piece a chunk's text belongs to), begin, end (of that piece's part; end null: the text's end).

    ``scans``: _row, at, head, tail of each chunk. Only boundaries in overlaps are moved."""
    order = Window.partitionBy("_row").orderBy("at")
    rows = scans.withColumn("end", F.get(F.array_intersect("tail", F.coalesce(F.lead("head").over(order), F.array().cast("array<long>"))), F.lit(0)))
    # A cut counts as long as none is missing before it.
    sofar = F.max(F.col("end").isNull()).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", F.when(~sofar, F.col("end")))
    rows = rows.withColumn("begin", F.coalesce(F.lag("end").over(order), F.lit(0)).cast("long"))
    return rows.withColumn("no", F.sum(F.when(F.lag("end").over(order).isNull(), 0).otherwise(1)).over(order)).select("_row", "at", "no", "begin", "end")


def digest(bpe: ByteBpe, parts_of: Iterator[list[int]], with_ids: bool) -> tuple:
    """n_tokens, sha256 of the ids, sha256 of the decoded bytes, and the ids where asked for."""
    n, of_ids, of_bytes, ids = 0, hashlib.sha256(), hashlib.sha256(), [np.empty(0, np.int32)]
    for got in parts_of:
        if got:
            of_ids.update(("," * (n > 0) + ",".join(map(str, got))).encode())
            of_bytes.update(bpe.decode(got))
            n += len(got)
            if with_ids:
                ids.append(np.array(got, np.int32))
    return n, of_ids.hexdigest(), of_bytes.hexdigest(), np.concatenate(ids) if with_ids else None


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (null without ``with_ids``) of each row.

    ``vocabulary`` is a rank file on the driver; its bytes travel with the tasks (its size doesn't grow with the data)."""
    spark = docs.sparkSession
    tuned(spark)
    with open(vocabulary, "rb") as f:
        held = spark.sparkContext.broadcast((f.read(), pattern))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(*held.value)
        for b in batches:
            rows = [(d, *digest(bpe, iter([bpe.encode(t)]), with_ids)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    short = base.where(F.length("text") <= chunk).mapInArrow(whole, OUT)
    long = base.where(F.length("text") > chunk)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, d, t in zip(b.column("_row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for at, piece in chunks(t, chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([d], pa.int64()), pa.array([at], pa.int64()), pa.array([len(t)], pa.int64()), pa.array([piece])], ["_row", "doc_id", "at", "total", "piece"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(*held.value)
        for b in batches:
            found = [scan(bpe, at, p, n, chunk, overlap) for at, p, n in zip(b.column("at").to_pylist(), b.column("piece").to_pylist(), b.column("total").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("at"), *(pa.array([x[j] for x in found], pa.list_(pa.int64())) for j in (0, 1))], ["_row", "at", "head", "tail"])

    def encoded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One piece, from one chunk or from several that are not in step."""
        rows = rows.sort_values("at")
        at, begin, end = rows["at"].iloc[0], rows["begin"].iloc[0], rows["end"].iloc[-1]
        text = "".join([*(p[:chunk] for p in rows["piece"].iloc[:-1]), rows["piece"].iloc[-1]])
        stop = len(text) if pd.isna(end) else int(end) - at
        return pd.DataFrame({"_row": [key[0]], "doc_id": _id(rows), "no": [key[1]], "ids": [ByteBpe.of(*held.value).encode(text[int(begin) - at : stop])]})

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        n, a, b, ids = digest(ByteBpe.of(*held.value), (x.tolist() for x in rows["ids"]), with_ids)
        return pd.DataFrame({"doc_id": _id(rows), "n_tokens": [n], "ids_sha256": [a], "decoded_sha256": [b], "ids": [ids]})

    shape = "_row long, doc_id long, at long, total long, piece string"
    # Written, so that a row's number is the same for all its chunks even if an executor is lost.
    cuts = stored(long.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, shape).repartition(parts(spark), "_row", "at"), "chunks")
    scans = cuts.mapInArrow(pretokenise, "_row long, at long, head array<long>, tail array<long>")
    of = cuts.join(piece_starts(scans), ["_row", "at"])
    ids = of.groupBy("_row", "no").applyInPandas(encoded, "_row long, doc_id long, no long, ids array<int>")
    return short.unionByName(ids.groupBy("_row").applyInPandas(joined, OUT))


def _id(rows: pd.DataFrame) -> pd.array:
    x = rows["doc_id"].iloc[0]
    return pd.array([None if pd.isna(x) else int(x)], "Int64")
