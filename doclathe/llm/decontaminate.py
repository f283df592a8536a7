"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units and names turn into typed placeholders, other words into lower case
without outer punctuation. The hashed windows of WINDOW template tokens of all benchmark items form a table, and the windows
of all texts are joined with it by hash. An item leaks into a text if at least COVERAGE of its windows are found and its
slots agree along the alignment that most windows share: each value in a slot of the item stands for one value there, for
CONSISTENT of all slots. So a question whose numbers or names were exchanged throughout is found, and a text that only
shares its wording isn't.

Nothing of the benchmark comes to the driver but counts. Its window table is broadcast up to BROADCAST_WINDOWS windows and
joined in a shuffle beyond.

Defined cases: null and empty texts and items match nothing; an item shorter than a window is one window of its own
length, and is ignored below LEAST words; items with equal ids are separate items, and a window of several items counts
for each; rows with equal ids are separate rows, and equal rows have equal leaks; an empty benchmark leaks nowhere; a token
is a name if it starts in upper case within a sentence; other columns, of both tables, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, dropped, mixed, rolling, signed, small, stored, tuned, unused
from .toxicity import EDGES

WINDOW, COVERAGE, CONSISTENT, LEAST = 8, 0.5, 0.8, 5
#: So many distinct windows of the benchmark may be sent to all tasks (8 bytes each).
BROADCAST_WINDOWS = 2_000_000
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%|k|m)?")
#: Unit words.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb oz ml cl l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v a c f k j kj cal kcal pa kpa bar mph kmh meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace"))


SLOT = {k: _h(f"\0{k}") for k in ("number", "unit", "name")}


def token(raw: str) -> tuple[int, int]:
    """(hash, flags): flags hold 1 for upper case at the start, 2 for the end of a sentence, 4 for a slot."""
    core = raw.strip(EDGES)
    ends = 2 if raw.rstrip("\"'»”’)]")[-1:] in (".", "!", "?", ":", ";") or not core else 0
    if NUMBER.fullmatch(core):
        return SLOT["number"], ends | 4
    if core in UNITS or core.lower() in UNITS and len(core) > 2:
        return SLOT["unit"], ends | 4
    return _h(core.lower()), ends | (core[:1].isupper() and core[1:2].islower())


_memo = Memo(token)


def template(words: list[str]) -> np.ndarray:
    """The hashes of a text's template tokens; a slot has the hash of its kind."""
    both = list(map(_memo.__getitem__, words))
    h = np.array([x for x, _ in both], np.uint64)
    flags = np.array([y for _, y in both], np.int8)
    if len(h):
        named = (flags & 1 == 1) & (flags & 4 == 0)
        named[0] = False
        named[1:] &= flags[:-1] & 2 == 0
        h[named] = np.uint64(SLOT["name"])
    return h


def window_hashes(words: list[str], n: int) -> np.ndarray:
    """Hash of each run of n template tokens; runs of different length have different hashes."""
    with np.errstate(over="ignore"):
        return mixed(rolling(template(words), n) + np.uint64(n))


SLOT_HASHES = frozenset(SLOT.values())


def slots(item: list[str], words: list[str], n: int, shift: int, places: list[int]) -> tuple[int, int]:
    """Slots of the item in its windows of n tokens at ``places``, found ``shift`` words later, and those that agree on one
    substitution."""
    kinds = template(item)
    values: dict[tuple[int, str], dict[str, int]] = defaultdict(lambda: defaultdict(int))
    found = 0
    for q in sorted({q + k for q in places for k in range(n)}):
        if int(kinds[q]) in SLOT_HASHES:
            found += 1
            values[int(kinds[q]), item[q].strip(EDGES)][words[q + shift].strip(EDGES)] += 1
    return found, sum(max(v.values()) for v in values.values())


def benchmark_windows(items: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """item, n (tokens of a window), total (distinct windows of the item), q (place), h of all windows of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(np.empty(0, np.int64),) * 5]
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                words = (text or "").split()
                if len(words) >= least:
                    n = min(window, len(words))
                    h = window_hashes(words, n)
                    out.append((np.full(len(h), item), np.full(len(h), n), np.full(len(h), len(np.unique(h))), np.arange(len(h)), signed(h)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["item", "n", "total", "q", "h"])

    return items.mapInArrow(run, "item long, n long, total long, q long, h long")


def text_windows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """_x, _y, p (place), h of all windows of texts (_x, _y, text), for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [t.split() for t in b.column("text").to_pylist()]
            for n in lengths:
                h = [window_hashes(w, n) if len(w) >= n else np.empty(0, np.uint64) for w in words]
                at = np.concatenate(([0], np.cumsum([len(x) for x in h]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("_x"), b.column("_y"), pa.ListArray.from_arrays(pa.array(at), pa.array(signed(np.concatenate(h))))], ["_x", "_y", "h"])

    return texts.mapInArrow(run, "_x long, _y long, h array<long>").select("_x", "_y", F.posexplode("h").alias("p", "h"))


def row_key() -> tuple[Column, Column]:
    """128 bits of a row's id and text; a row's leaks depend on no more."""
    row = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(*row), F.xxhash64(F.lit(1), *row)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """_x, _y (a row's key), item_id, coverage, n_slots, consistency of each item that leaks into a row; a table."""
    spark = docs.sparkSession
    tuned(spark)
    x, y = row_key()
    texts = docs.select(x.alias("_x"), y.alias("_y"), F.coalesce("text", F.lit("")).alias("text"))
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    windows = stored(benchmark_windows(items.select("item", "text")), "item-windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW - LEAST + 1
    known = stored(windows.select("h").distinct(), "window-hashes")
    found = stored(text_windows(texts, lengths).join(small(known, broadcast_windows), "h"), "window-hits")
    pairs = stored(found.join(windows, "h").select("_x", "_y", "item", "n", "total", "q", (F.col("p") - F.col("q")).alias("shift"), "h"), "window-pairs")
    enough = pairs.groupBy("_x", "_y", "item", "n", "total").agg(F.size(F.collect_set("h")).alias("k")).where(F.col("k") / F.col("total") >= coverage)
    lines = pairs.groupBy("_x", "_y", "item", "shift").agg(F.collect_set("q").alias("qs"))
    best = F.max(F.struct(F.size("qs").alias("size"), (-F.col("shift")).alias("back"), "qs")).alias("best")
    best = lines.groupBy("_x", "_y", "item").agg(best)
    chosen = enough.join(best, ["_x", "_y", "item"]).select("_x", "_y", "item", "n", (F.col("k") / F.col("total")).alias("coverage"), (-F.col("best.back")).alias("shift"), F.col("best.qs").alias("qs"))
    chosen = stored(chosen.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item"), "candidates")
    dropped(found, pairs, known, windows, items)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("item_text", "text", "n", "shift", "qs")))
            got = [slots(i.split(), t.split(), n, shift, qs) for i, t, n, shift, qs in rows]
            n, ok = (pa.array([g[j] for g in got], pa.int64()) for j in (0, 1))
            share = pa.array([a / k if k else 1.0 for k, a in got], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_x", "_y", "item_id", "coverage")), n, share], ["_x", "_y", "item_id", "coverage", "n_slots", "consistency"])

    texts = texts.join(small(chosen), ["_x", "_y"]).dropDuplicates(["_x", "_y", "item"])
    out = texts.mapInArrow(checked, "_x long, _y long, item_id long, coverage double, n_slots long, consistency double")
    out = stored(out.where(F.col("consistency") >= consistent), "leaks")
    dropped(chosen)
    return out


def decontamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The leaks: doc_id, item_id, coverage, n_slots, consistency for each text and each item that leaks into it."""
    x, y = row_key()
    found = small(leaks(docs, benchmark, coverage, consistent, broadcast_windows))
    return docs.select(F.col("doc_id"), x.alias("_x"), y.alias("_y")).join(found, ["_x", "_y"]).drop("_x", "_y")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows into which an item leaks."""
    x, y = row_key()
    a, b = unused(docs, "x"), unused(docs, "y")
    found = leaks(docs, benchmark).select(F.col("_x").alias(a), F.col("_y").alias(b)).distinct()
    return docs.withColumn(a, x).withColumn(b, y).join(small(stored(found, "leaking")), [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
