"""Repeated passages of words by Aho-Corasick automata.

Recurring passages are confirmed first: runs of PHRASE words that are anchors (see ``repeats``) of windows of WINDOW
words and occur at least twice form the dictionary of phrases. It is cut into shards of a bounded number of phrases, each
compiled to one automaton; every document is streamed, piece by piece, through the automata of the shards that its
anchors name, and every occurrence of a phrase is located there. The windows around the occurrences of a phrase then
stand side by side in the shard's task, are compared in full, and every window that also starts elsewhere is cut. A
phrase in very many texts has shards of its own, each with a share of the documents, and ``by_content`` and
``counted_spans`` do the rest.

Defined cases: null and empty texts have no words; texts of fewer than WINDOW words lose nothing; rows with equal ids or
texts are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import Memo, dropped, parts, rolling, signed, stored, tuned
from .repeats import anchors, by_content, contexts_in, counted_spans, covered, distinct_texts, in_texts, keyed, lists, merged, one_span, repeated_in_group, spans_batch

WINDOW, PHRASE = 35, 8
#: Phrases of one automaton, at most about so many.
SHARD = 20_000
#: Pieces whose windows are compared at a time, in whole groups.
AT_ONCE = 20_000
_memo = Memo(xxhash.xxh64_intdigest)
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends."""
    blank = np.concatenate(([True], _blank[np.frombuffer(text, np.uint8)], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


ROW = "h long, k1 long, k2 long, before int, size int, firsts array<long>, start int, stop int, n long"


def phrase_rows(texts: DataFrame, window: int, phrase: int) -> DataFrame:
    """The anchors of each text: h (hash of the phrase), the windows that it stands for (``size`` of them from each of
    ``firsts``), the bytes of the first such passage (start, stop), the words before the phrase in it, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[list[np.ndarray]] = [[], [], [], [], [], []]
            firsts, n = [], []
            for i, (text, copies) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist())):
                words = text.split()
                if len(words) < window:
                    continue
                tokens = hashed_words(words)
                h, place, first, last = anchors(tokens, window, phrase)
                own = contexts_in(h, place, first, last, lambda f, z: tokens[f : z + window].tobytes())  # noqa: B023
                at = [j for j, _ in own]
                starts, ends = word_places(text)
                first, last = first[at], last[at]
                for x, y in zip(found, (h[at], np.full(len(at), i), place[at] - first, last - first + 1, starts[first], ends[last + window - 1])):
                    x.append(y)
                firsts += [f for _, f in own]
                n += [len(f) * copies for _, f in own]
            if firsts:
                h, row, before, size, start, stop = (np.concatenate(x) for x in found)
                at = pa.array(row)
                ints = [pa.array(x.astype(np.int32)) for x in (before, size, start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), b.column("k1").take(at), b.column("k2").take(at), ints[0], ints[1], lists(firsts), ints[2], ints[3], pa.array(n, pa.int64())], [x.split()[0] for x in ROW.split(", ")])

    return texts.select("k1", "k2", "text", "copies").mapInArrow(run, ROW)


def automaton(phrases: dict[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, h in phrases.items():
        a.add_word(f" {p} ", h)
    a.make_automaton()
    return a


def dealt(texts: DataFrame, rows: DataFrame, shards: int, hot: int) -> DataFrame:
    """Dictionary (kind 0: s is a phrase's passage) and pieces of documents (kind 1: s is a passage with a phrase), dealt
    out by shard, the dictionary first. ``rows`` also have: rows (of the phrase), named (whether its words are taken here)."""
    salts = F.ceil(F.col("rows") / hot).cast("int")
    shard = F.when(F.col("rows") > hot, F.col("h")).otherwise(F.pmod("h", F.lit(shards)))
    own = F.pmod(F.xxhash64("k1", "k2"), salts).cast("int")
    entry = lambda kind, salt: F.struct(F.lit(kind).alias("kind"), salt.alias("salt"))
    kinds = F.when(F.col("named"), F.concat(F.array(entry(1, own)), F.transform(F.sequence(F.lit(0), salts - 1), lambda x: entry(0, x)))).otherwise(F.array(entry(1, own)))
    s = F.substring("b", F.col("start") + 1, F.col("stop") - F.col("start")).alias("s")
    both = in_texts(texts, rows.select("h", "k1", "k2", "before", "size", "firsts", "start", "stop", "rows", "named", "again"), s)
    both = both.select("h", "k1", "k2", "before", "size", "firsts", "start", "stop", "many", "s", shard.alias("shard"), F.explode(kinds).alias("_e"))
    both = both.select("shard", "_e.salt", "_e.kind", "h", "k1", "k2", "before", "size", "firsts", "start", "stop", "many", "s")
    n = parts(texts.sparkSession)
    return both.repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "kind", "h")


def located(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[list[tuple]]:
    """Pieces in which the automaton of their shard finds their phrase: h, k1, k2, firsts, many, w (hashes of the windows),
    before, size, start, stop."""
    phrases: dict[str, int] = {}
    a = at = None
    for b in batches:
        out = []
        cols = (b.column(c).to_pylist() for c in ("shard", "salt", "kind", "h", "k1", "k2", "before", "size", "firsts", "start", "stop", "many", "s"))
        for shard, salt, kind, h, k1, k2, before, size, firsts, start, stop, many, s in zip(*cols):
            if (shard, salt) != at:
                phrases, a, at = {}, None, (shard, salt)
            words = s.split()
            if kind == 0:
                phrases[b" ".join(words[before : before + phrase]).decode()] = h
                continue
            if a is None:
                a = automaton(phrases)
            end = len(b" ".join(words[: before + phrase]).decode()) + 1
            if any(e == end and x == h for e, x in a.iter(f" {b' '.join(words).decode()} ")):
                out.append((h, k1, k2, firsts, many, rolling(hashed_words(words), window), before, size, start, stop))
        yield out


def repeated_windows(texts: DataFrame, rows: DataFrame, window: int, phrase: int, hot: int, shard: int) -> DataFrame:
    """k1, k2, spans of words in windows that also start elsewhere."""
    heads = rows.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("k1", "k2")).alias("k")).where("n > 1")
    heads = stored(heads.select("h", "rows", F.col("k.k1").alias("n1"), F.col("k.k2").alias("n2")), "phrases")
    known = heads.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
    suspects = stored(rows.join(heads, "h").withColumn("named", (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2"))).withColumn("again", F.lit(False)).drop("n1", "n2", "n"), "suspects")
    # Many more than tasks, so that tasks get about as many pieces each.
    shards = max(16 * parts(texts.sparkSession), -(-known["n"] // shard))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = np.fromiter((len(r[5]) for r in rows), np.int64, len(rows))
            h = np.fromiter((r[0] for r in rows), np.int64, len(rows))
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            flag = repeated_in_group(np.concatenate([r[5] for r in rows]), starts, sizes) | np.repeat(np.fromiter((r[4] for r in rows), bool, len(rows)), sizes)
            c = {"k1": pa.array([r[1] for r in rows], pa.int64()), "k2": pa.array([r[2] for r in rows], pa.int64()), "firsts": lists([r[3] for r in rows])}
            if (out := spans_batch(c, flag, sizes, window)) is not None:
                yield out

        for found in located(batches, window, phrase):
            held += found
            if len(held) >= AT_ONCE:
                cut = next(i for i in range(len(held) - 1, -1, -1) if i == 0 or held[i][0] != held[i - 1][0])
                if cut:
                    yield from flush(held[:cut])
                    held = held[cut:]
        if held:
            yield from flush(held)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in located(batches, window, phrase):
            c = [np.frombuffer(xxhash.xxh3_128_digest(r[5].tobytes()), np.int64) for r in rows]
            whole = [(r[0], r[1], r[2], r[6], r[7], r[8], r[9], int(x), int(y)) for r, (x, y) in zip(rows, c)]
            cols = [pa.array([r[j] for r in whole], k) for j, k in enumerate([pa.int64()] * 3 + [pa.int32()] * 4 + [pa.int64()] * 2)]
            yield pa.RecordBatch.from_arrays([*cols, lists([r[3] for r in rows])], ["h", "k1", "k2", "before", "size", "start", "stop", "c1", "c2", "firsts"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in located(batches, window, phrase):
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)), lists([signed(r[5]).tolist() for r in rows])], ["h", "k1", "k2", "firsts", "many", "w"])

    spans = "k1 long, k2 long, first long, last long"
    out = dealt(texts, suspects.where(F.col("rows") <= hot), shards, hot).mapInArrow(compared, spans).select("k1", "k2", one_span())
    if (known["most"] or 0) <= hot:
        return out
    many = dealt(texts, suspects.where(F.col("rows") > hot), shards, hot).mapInArrow(contents, "h long, k1 long, k2 long, before int, size int, start int, stop int, c1 long, c2 long, firsts array<long>")
    left, whole = by_content(stored(many, "contexts"), window, hot)
    left = left.withColumn("named", F.lit(True))
    out = out.unionByName(whole).unionByName(dealt(texts, left.where(F.col("rows") <= hot), shards, hot).mapInArrow(compared, spans).select("k1", "k2", one_span()))
    if (more := left.where(F.col("rows") > hot)).isEmpty():
        return out
    more = dealt(texts, more, shards, hot).mapInArrow(listed, "h long, k1 long, k2 long, firsts array<long>, many boolean, w array<long>")
    return out.unionByName(counted_spans(more, window))


def cut_words(texts: DataFrame, spans: DataFrame, window: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            cols = (b.column("text").cast(pa.binary()), b.column("copies"), b.column("firsts"), b.column("lasts"))
            for text, copies, firsts, lasts in zip(*(c.to_pylist() for c in cols)):
                words = text.split()
                if copies > 1 and len(words) >= window:
                    firsts, lasts = [0], [len(words)]
                a, z = merged(np.array(firsts or [], np.int64), np.array(lasts or [], np.int64))
                kept = [w for x, y in zip([0, *z.tolist()], [*a.tolist(), len(words)]) for w in words[x:y]] if len(a) else words
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if with_text else None))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *(pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))], ["k1", "k2", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return covered(texts, spans).mapInArrow(run, "k1 long, k2 long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def phrase_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, with_text: bool = True, hot: int | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null without ``with_text``) of each row.

    A phrase with more than ``hot`` passages (default: ``repeats.HOT``) is dealt out to several tasks; an automaton holds about ``shard`` phrases at most. The result is a table; all others are deleted."""
    tuned(docs.sparkSession, size="2m")
    texts = distinct_texts(docs)
    rows = stored(phrase_rows(texts, window, phrase), "anchors")
    spans = repeated_windows(texts, rows, window, phrase, hot or repeats.HOT, shard)
    out = cut_words(texts, spans, window, with_text)
    out = stored(keyed(docs).select("doc_id", "k1", "k2").join(out, ["k1", "k2"]).drop("k1", "k2"), "phrase-dedup")
    dropped(texts, rows)
    return out
