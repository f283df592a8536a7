"""Exact repeats of fixed length: which windows of L tokens also start elsewhere.

Every window of L tokens has an anchor: the least hash of its runs of K tokens, the first of equals. The anchor depends
on the window's tokens alone, so equal windows have equal anchors at equal offsets, and an anchor that occurs once in
all texts rules out every window it stands for. What is left is compared window by window, grouped by anchor. Of an
anchor in very many texts, one context of each content is left first; if these are still too many for a task, their
windows are counted one by one, so that no work grows with the square of a group.

Texts are worked on once for each distinct text: a table bucketed by the text's 128-bit key is joined without another
shuffle of texts. A text with several copies repeats from end to end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, parts, rolling, sharded, sliding_min, stored

POSITION = 20
LOW = np.uint64((1 << POSITION) - 1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of an anchor that are compared side by side in one task, at most.
HOT = 2048


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the key (k1, k2) of each row's text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """k1, k2, text, copies: a table in the shared folder, bucketed by its key."""
    rows = keyed(docs).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return sharded(rows, "texts", "k1", "k2")


def least(keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): the least key of each window, for runs of windows that share one."""
    m = sliding_min(keys, window)
    if not len(m):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    last = np.append(first[1:], len(m)) - 1
    known = m[first] != NONE
    first, last = first[known], last[known]
    # The key's low bits are the place, modulo 2^POSITION; the place is in [first, first + window).
    place = (m[first] & LOW).astype(np.int64)
    return first + ((place - first) & ((1 << POSITION) - 1)), first, last


def with_places(h: np.ndarray) -> np.ndarray:
    """Keys in the order of hashes, earlier places first among equals; NONE stays."""
    return np.where(h == NONE, NONE, (h & ~LOW) | (np.arange(len(h), dtype=np.uint64) & LOW))


def least_runs(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, first, last): the least hash of each window of ``window`` entries, for runs of windows that share one."""
    found: list[tuple] = []
    size = 1 << POSITION
    step = size - window + 1
    for at in range(0, max(len(h) - window + 1, 0), step):
        part = h[at : at + size]
        place, first, last = least(with_places(part), window)
        found.append((part[place], place + at, first + at, last + at))
    if not found:
        return np.empty(0, np.uint64), *((np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in zip(*found))


def anchors(tokens: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, first, last): anchors, and the windows from ``first`` to ``last`` that each stands for."""
    return least_runs(rolling(tokens, k), length - k + 1)


def contexts_in(h: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, content: Callable[[int, int], bytes]) -> list[tuple[int, list[int]]]:
    """(i, firsts): one of the runs with equal anchor and equal windows, and where each of them starts.

    ``content`` gives what tells one run's windows from another's. A text that repeats itself has few contexts."""
    if len(np.unique(h)) == len(h):
        return [(i, [f]) for i, f in enumerate(first.tolist())]
    found: dict[tuple, tuple[int, list[int]]] = {}
    for i, (x, p, f, z) in enumerate(zip(h.tolist(), place.tolist(), first.tolist(), last.tolist())):
        found.setdefault((x, p - f, content(f, z)), (i, []))[1].append(f)
    return list(found.values())


def lists(rows: list[list[int]]) -> pa.Array:
    """Lists of longs as one Arrow array."""
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array([x for r in rows for x in r], pa.int64()))


def in_texts(texts: DataFrame, rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` (with k1, k2) beside their texts: ``rows``' columns, many (whether such a context starts at two places, as
    known from here or from again) and ``columns``, which may use b, the text's bytes. Texts aren't shuffled."""
    names = [c for c in rows.columns if c not in ("k1", "k2")]
    own = rows.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("_own"))
    both = texts.join(own, ["k1", "k2"]).select("k1", "k2", "copies", F.col("text").cast("binary").alias("b"), F.explode("_own").alias("_x"))
    both = both.select("k1", "k2", "copies", "b", *[F.col(f"_x.{n}").alias(n) for n in names])
    many = (F.col("copies") > 1) | (F.size("firsts") > 1)
    return both.select("k1", "k2", *names, (many | F.col("again") if "again" in names else many).alias("many"), *columns)


def spans_from(shift: Column, size: Column) -> Column:
    """spans: a span (first, last) of ``size`` tokens, ``shift`` after each of a context's firsts."""
    span = lambda f: F.struct((f + shift).cast("long").alias("first"), (f + shift + size).cast("long").alias("last"))
    return F.transform("firsts", span).alias("spans")


def one_span() -> Column:
    """spans, of the one span that a row has."""
    return F.array(F.struct("first", "last")).alias("spans")


def counted_spans(windows: DataFrame, length: int) -> DataFrame:
    """k1, k2, spans of repeated windows, by counting windows one by one.

    ``windows``: h, k1, k2, firsts, many, w (hashes of a context's windows). Counts are partial before the shuffle, and the
    work grows with the rows, not with the square of an anchor's."""
    one = windows.select("h", "k1", "k2", "firsts", "many", F.posexplode("w").alias("j", "w"))
    again = one.groupBy("h", "w").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("h", "w")
    hit = one.join(stored(again, "repeated"), ["h", "w"])
    return hit.select("k1", "k2", spans_from(F.col("j"), F.lit(length)))


def by_content(contexts: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """What is left to compare of anchors in very many texts, and the spans that are known.

    ``contexts`` (a table): h, k1, k2, size, firsts, c1, c2 (hash of the content) and more. Contexts of equal content repeat
    from end to end. One of each content is left, with again (whether there are others) and rows (of its anchor)."""
    classes = stored(contexts.groupBy("h", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("one")), "contents")
    both = contexts.join(classes, ["h", "c1", "c2"])
    known = both.where("n > 1").select("k1", "k2", spans_from(F.lit(0), F.col("size") - 1 + length))
    left = both.where((F.col("k1") == F.col("one.k1")) & (F.col("k2") == F.col("one.k2")))
    rows = classes.groupBy("h").agg(F.count(F.lit(1)).alias("rows"))
    return stored(left.withColumn("again", F.col("n") > 1).drop("n", "one", "c1", "c2").join(rows, "h"), "left"), known


def repeated(h: np.ndarray) -> np.ndarray:
    """Which entries have an equal."""
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def repeated_in_group(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which entries have an equal in their own group. ``starts``: each group's first row; ``sizes``: entries of each row."""
    group = np.zeros(len(sizes), np.uint64)
    group[starts] = 1
    return repeated(h ^ np.repeat(mixed(np.cumsum(group, dtype=np.uint64)), sizes))


def runs(flag: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of set flags, within rows of the given sizes."""
    if not flag.any():
        return (np.empty(0, np.int64),) * 3
    row = np.repeat(np.arange(len(sizes)), sizes)
    base = np.cumsum(sizes) - sizes
    edge = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    begins = flag.copy()
    begins[1:] &= ~flag[:-1]
    begins[edge] = flag[edge]
    ends = flag.copy()
    ends[:-1] &= ~flag[1:]
    ends[edge[1:] - 1] = flag[edge[1:] - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends)
    return row[a], a - base[row[a]], b - base[row[a]]


def spans_batch(c: dict, flag: np.ndarray, sizes: np.ndarray, length: int) -> pa.RecordBatch | None:
    """Rows k1, k2, first, last (exclusive) of covered tokens; c has k1, k2 and firsts (where each row's windows start)."""
    row, a, b = runs(flag, sizes)
    if not len(row):
        return None
    starts = c["firsts"].combine_chunks() if isinstance(c["firsts"], pa.ChunkedArray) else c["firsts"]
    offsets = starts.offsets.to_numpy().astype(np.int64)
    flat = starts.values.to_numpy()
    n = (offsets[1:] - offsets[:-1])[row]
    which = np.repeat(np.arange(len(row)), n)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    first = flat[offsets[:-1][row[which]] + nth] + a[which]
    last = first + (b - a)[which] + length
    at = pa.array(row[which])
    return pa.RecordBatch.from_arrays([_take(c["k1"], at), _take(c["k2"], at), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))], ["k1", "k2", "first", "last"])


def _take(x, at: pa.Array) -> pa.Array:
    out = x.take(at)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal spans (spans that touch are one)."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate(([True], first[1:] > reach[:-1]))
    return first[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(first) - 1)]


def covered(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts with the list of their spans (null: none); ``spans``: k1, k2, spans."""
    own = spans.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return texts.join(own, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", F.col("spans.first").alias("firsts"), F.col("spans.last").alias("lasts"))
