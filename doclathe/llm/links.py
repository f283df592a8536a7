"""Links inside buckets, block by block, and connected components of the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, parts, stored

#: A bucket with more rows is cut into blocks, and its pairs of blocks are dealt out as tasks of their own.
BLOCK = 2048
#: So many rows that name oversized buckets may be sent to all tasks; beyond, they are joined by key.
BROADCAST_ROWS = 50_000


def block_pairs(rows: DataFrame, keys: list[str], spread: str, block: int = BLOCK) -> DataFrame:
    """Adds _lo, _hi, _side; a bucket's rows meet in groups (keys, _lo, _hi) of at most about two blocks.

    Buckets of up to ``block`` rows are one group (0, 0). In larger ones each row joins one group for each block of its
    bucket, and every two rows of a bucket meet exactly once: within (i, i), or from different sides of (i, j)."""
    large = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "large")
    n = large.count()
    if n == 0:
        dropped(large)
        zero = F.lit(0)
        return rows.select("*", zero.alias("_lo"), zero.alias("_hi"), zero.alias("_side"))
    counts = F.broadcast(large) if n <= BROADCAST_ROWS else large
    blocks = F.coalesce(F.ceil(F.col("_n") / block).cast("int"), F.lit(1))
    out = rows.join(counts, keys, "left").withColumn("_b", blocks).withColumn("_side", F.pmod(F.xxhash64(F.col(spread)), F.col("_b")).cast("int"))
    out = out.withColumn("_other", F.explode(F.expr("sequence(0, _b - 1)")))
    return out.withColumn("_lo", F.least("_side", "_other")).withColumn("_hi", F.greatest("_side", "_other")).drop("_n", "_b", "_other")


def grouped_runs(rows: DataFrame, keys: list[str], kernel: Callable[[dict[str, np.ndarray | pa.Array], np.ndarray], pa.RecordBatch | None], schema: str, at_most: int = 200_000) -> DataFrame:
    """Deals rows out by ``keys``, sorts them and hands whole groups to ``kernel(columns, starts)``, many groups at a time."""
    names = rows.columns
    dealt = rows.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            ks = [table.column(k).to_numpy() for k in keys]
            change = np.zeros(len(table), bool)
            change[0] = True
            for k in ks:
                change[1:] |= k[1:] != k[:-1]
            starts = np.flatnonzero(change)
            cut = len(table) if last else int(starts[-1])
            held, n = ([], 0) if last else (table.slice(cut).to_batches(), len(table) - cut)
            if cut and (out := kernel({c: table.column(c).slice(0, cut) for c in names}, starts[starts < cut])) is not None:
                yield out

        wait = at_most
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= wait:
                    yield from done(False)
                    wait = max(at_most, 2 * n)
        if n:
            yield from done(True)

    return dealt.mapInArrow(run, schema)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links a-b: the smallest node that each one reaches."""
    root = np.arange(n)
    while True:
        before = root.copy()
        m = np.minimum(root[a], root[b])
        np.minimum.at(root, a, m)
        np.minimum.at(root, b, m)
        np.minimum.at(root, before[a], m)
        np.minimum.at(root, before[b], m)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def _stars(e: DataFrame) -> bool:
    """Whether every node of the links (u, v) is either a centre or linked to one centre only."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of ``edges`` (a, b), both long and not null; component is the smallest id reached.

    Alternating large and small stars: every round keeps a spanning set of links no larger than the last, and the
    number of rounds grows with the logarithm of the longest chain. Minima are aggregated before the shuffle, so a node
    with very many links makes no large task; each round is a table in the shared folder."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "links")
        dropped(e, large)
        e = new
    pairs = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = e.select(F.col("v").alias("id")).distinct().join(pairs.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    return pairs.unionByName(roots)
