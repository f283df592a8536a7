"""Near-dedup of embeddings by iterative quantisation.

Equal vectors of one label are one class first. A bounded sample (SAMPLE vectors of each length by a hash of their id)
gives a centre and principal axes; iterative quantisation alternates signs and an orthogonal rotation (Procrustes) until
codes are balanced. Several rotations, from different starts, give as many codes of up to 64 bits for every vector. A
multi-index over the codes has one table for each part of ``width`` bits of each rotation's code. The width grows with the
logarithm of the number of vectors, so that buckets stay small, and the number of tables follows from the width and from
the share of bits in which two vectors at the threshold differ, so that a pair is missed with a chance of MISS at most.

Retrieval moves codes only: rows of a bucket are compared by the Hamming distance of their whole codes, and only those
with a candidate within RADIUS fetch their vectors. They meet again in the same bucket, and pairs are reranked by the
cosine of the original vectors in double precision. A pair counts in the first table that retrieves it, so no list of
pairs is made.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label
link with nothing; vectors of different length don't link; rows with equal ids are separate vectors; null ids take part
and are a component's smallest id only where it has no other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, dropped, stored, tuned
from .links import block_pairs, components, grouped_runs, local_roots

THRESHOLD, SAMPLE, BITS, MISS = 0.98, 4096, 64, 1e-4
#: Candidates differ in at most this share of a code's bits.
RADIUS = 0.25
BLOCK = 1024


class Quantiser:
    """Codes of at most 64 bits: signs of rotated principal components."""

    def __init__(self, sample: np.ndarray, rotations: int = 4, steps: int = 40, seed: int = 0):
        self.centre = sample.mean(0)
        x = sample - self.centre
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, :BITS]
        v, self.turns = x @ axes, []
        rng = np.random.default_rng(seed)
        for _ in range(rotations):
            r, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
            for _ in range(steps):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            self.turns.append(axes @ r)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One column of 64-bit codes for each rotation."""
        out = np.zeros((len(x), len(self.turns)), np.uint64)
        for j, t in enumerate(self.turns):
            bits = (x - self.centre) @ t > 0
            out[:, j] = (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """_row, vec_id, label, v (array of double, of norm over zero, all finite; else null)."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(e, lambda x: x != 0)
    v = F.when(e.isNull() | F.coalesce(bad, F.lit(False)) | F.coalesce(zero, F.lit(True)) | F.col("label").isNull(), F.lit(None)).otherwise(e)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v")).withColumn("_row", F.monotonically_increasing_id())


@dataclass
class Plan:
    """Tables of a multi-index: ``tables`` parts of ``width`` bits, ``each`` of them from one rotation's code of ``bits``."""

    width: int
    tables: int
    each: int
    bits: int

    @classmethod
    def of(cls, n: int, size: int, threshold: float, miss: float = MISS) -> Plan:
        """For n vectors of one label and ``size`` components."""
        bits = min(BITS, size)
        width = min(bits, max(8, min(24, math.ceil(math.log2(max(n, 1) / 4)))))
        same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** width
        return cls(width, math.ceil(math.log(miss) / math.log(1 - same)) if same < 1 else 1, bits // width, bits)

    @property
    def rotations(self) -> int:
        return -(-self.tables // self.each)

    @property
    def radius(self) -> int:
        return math.ceil(RADIUS * self.bits)

    def part(self, codes: np.ndarray, t: int) -> np.ndarray:
        """What table t is keyed by; ``codes``: one column for each rotation."""
        return (codes[:, t // self.each] >> np.uint64(t % self.each * self.width)) & np.uint64((1 << self.width) - 1)

    def before(self, differ: np.ndarray, t: int) -> np.ndarray:
        """Which pairs an earlier table than t retrieves; ``differ``: the bits in which their codes differ."""
        out = np.zeros(len(differ), bool)
        near = np.bitwise_count(differ) <= self.radius
        for u in range(t):
            out |= (self.part(differ, u) == 0) & near[:, u // self.each]
        return out


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    tuned(spark)
    base = stored(usable(vectors).withColumn("_k", F.xxhash64("label", "v")).withColumn("_l", F.xxhash64(F.lit(1), "label", "v")), "vectors", "snappy")
    good = base.where("v is not null")
    classes = good.groupBy("_k", "_l").agg(F.min("_row").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("size", F.size("v")), "classes", "snappy")
    most = {r["size"]: r["n"] for r in classes.groupBy("size", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("size").agg(F.max("n").alias("n")).collect()}
    plans, quantisers = {}, {}
    for size in sorted(most):
        plans[size] = Plan.of(most[size], size, threshold, miss)
        picked = classes.where(F.col("size") == size).orderBy(F.xxhash64("id"), "id").select("v").limit(sample).toPandas()
        quantisers[size] = Quantiser(_units(picked["v"].tolist()), plans[size].rotations)
    if not most:
        ids = base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return ids.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    coded = stored(_coded(classes, Held(spark, quantisers)), "codes", "snappy")
    stars = stored(_links(coded, _retrieved(coded, plans), plans, threshold), "stars")
    counts = stars.groupBy("_row").agg(F.sum("n").alias("n"))
    member = components(stars.select(F.col("_row").alias("a"), F.col("root").alias("b")))
    of = coded.select("id", "copies").join(member, "id", "left").join(counts.withColumnRenamed("_row", "id"), "id", "left")
    of = of.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    rows = base.select("_row", "vec_id", "_k", "_l").join(classes.select("_k", "_l", "id"), ["_k", "_l"], "left").join(of, "id", "left")
    rows = stored(rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", -1 - F.col("_row")).alias("component")), "rows")
    dropped(stars, coded, classes, base)
    smallest = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(smallest, "component").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _coded(classes: DataFrame, held: Held) -> DataFrame:
    """id, label (hash), size, copies, v and codes (one long for each rotation)."""

    @F.pandas_udf("array<long>")
    def codes(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), object)
        size = v.map(len).to_numpy()
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            c = held.value[int(s)].codes(_units(v.iloc[at].tolist()))
            for i, row in zip(at, c.view(np.int64)):
                out[i] = row
        return pd.Series(out)

    return classes.select("id", F.xxhash64("label").alias("label"), "size", "copies", "v", codes("v").alias("codes"))


BUCKET = ["label", "size", "table", "part", "_lo", "_hi"]


def _retrieved(coded: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """The rows of each bucket that have a candidate in it, by their codes alone."""

    @F.pandas_udf("struct<part:array<long>,code:array<long>>")
    def entries(size: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = np.empty((len(size), 2), object)
        sizes = size.to_numpy()
        for s in np.unique(sizes):
            plan, at = plans[int(s)], np.flatnonzero(sizes == s)
            c = np.stack(codes.iloc[at].to_list()).astype(np.int64).view(np.uint64)
            keys = np.stack([plan.part(c, t) for t in range(plan.tables)], 1).view(np.int64)
            own = c[:, np.arange(plan.tables) // plan.each].view(np.int64)
            for i, k, o in zip(at, keys, own):
                out[i] = k, o
        return pd.DataFrame({"part": out[:, 0], "code": out[:, 1]})

    rows = coded.select("id", "label", "size", entries("size", "codes").alias("e"))
    rows = rows.select("id", "label", "size", F.posexplode(F.arrays_zip("e.part", "e.code")).alias("table", "x")).select("id", "label", "size", "table", "x.part", "x.code")
    rows = block_pairs(rows, ["label", "size", "table", "part"], "id", BLOCK)

    def kernel(c: dict, starts: np.ndarray) -> pa.RecordBatch | None:
        code = c["code"].to_numpy().view(np.uint64)
        lo, hi, side = (c[k].to_numpy() for k in ("_lo", "_hi", "_side"))
        radius = np.array([plans[s].radius for s in np.unique(c["size"].to_numpy()).tolist()])[np.unique(c["size"].to_numpy(), return_inverse=True)[1]]
        ends = np.append(starts[1:], len(code))
        end, one, found = np.repeat(ends, ends - starts), lo == hi, np.zeros(len(code), bool)
        at, d = np.arange(len(code)), 1
        while len(at := at[at + d < end[at]]):
            near = (np.bitwise_count(code[at] ^ code[at + d]) <= radius[at]) & (one[at] | (side[at] != side[at + d]))
            found[at[near]] = True
            found[at[near] + d] = True
            d += 1
        at = pa.array(np.flatnonzero(found))
        return pa.RecordBatch.from_arrays([c[k].take(at).combine_chunks() for k in ["id", *BUCKET, "_side"]], ["id", *BUCKET, "_side"]) if len(at) else None

    return grouped_runs(rows, BUCKET, kernel, "id long, label long, size int, table int, part long, _lo int, _hi int, _side int", at_most=100_000)


def _links(coded: DataFrame, found: DataFrame, plans: dict[int, Plan], threshold: float) -> DataFrame:
    """For each row and each group it has links in: n, links first met there, and a root that spans them."""
    rows = found.join(coded.select("id", "copies", "v", "codes"), "id")

    def kernel(c: dict, starts: np.ndarray) -> pa.RecordBatch | None:
        ids, sizes, table, side, copies = (c[k].to_numpy() for k in ("id", "size", "table", "_side", "copies"))
        one = c["_lo"].to_numpy() == c["_hi"].to_numpy()
        arrays = {k: c[k].combine_chunks() if isinstance(c[k], pa.ChunkedArray) else c[k] for k in ("v", "codes")}
        flat = {k: (a.offsets.to_numpy(), a.values.to_numpy()) for k, a in arrays.items()}
        out_id, out_n, out_root = [], [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            if e - s < 2:
                continue
            (vo, vs), (co, cs) = flat["v"], flat["codes"]
            x = vs[vo[s] : vo[e]].reshape(e - s, -1)
            code = cs[co[s] : co[e]].reshape(e - s, -1).view(np.uint64)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            plan, t = plans[int(sizes[s])], int(table[s])
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            differ = code[a] ^ code[b]
            ok = np.bitwise_count(differ[:, t // plan.each]) <= plan.radius
            if not one[s]:
                ok &= side[s + a] != side[s + b]
            a, b, differ = a[ok], b[ok], differ[ok]
            if not len(a):
                continue
            new = ~plan.before(differ, t)
            n = np.bincount(a[new], copies[s + b[new]], e - s) + np.bincount(b[new], copies[s + a[new]], e - s)
            root = local_roots(a, b, e - s)
            at = np.flatnonzero((n > 0) | (root != np.arange(e - s)))
            out_id.append(ids[s + at])
            out_n.append(n[at])
            out_root.append(ids[s + root[at]])
        if not out_id:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(y).astype(np.int64)) for y in (out_id, out_n, out_root)], ["_row", "n", "root"])

    return grouped_runs(rows, BUCKET, kernel, "_row long, n long, root long", at_most=20_000)
