"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints are 64-bit majority votes of shingle hashes. For radius r, every bit position gets a vector of r + 1 bits
(not zero); table v, for each of the 2^(r+1) - 1 vectors v that are not zero, keeps the bits whose vector has odd inner
product with v. Any r positions leave some v orthogonal to all of them, so two fingerprints that differ in at most r
bits agree on all bits of at least one table: no pair within the radius is missed.

Defined cases: null and empty texts have fingerprint zero and link like any other; null ids take part and are not the
smallest unless alone; rows with equal ids are separate documents; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, per_batch, stored, texts_of, tuned, unused
from .links import block_pairs, components, grouped_runs, local_roots

SHINGLE, RADIUS, SEED = 4, 4, 42
STEP = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    votes = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for i in range(0, len(starts), STEP):
        a, b = starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist()
        bits = np.array([h(joined[x:y], SEED) for x, y in zip(a, b)], np.uint64)
        votes += np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    out = 0
    for i in np.flatnonzero(votes * 2 > len(starts)):
        out |= 1 << int(i)
    return out


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash and fingerprint (signed long) of each row."""
    tuned(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in texts_of(b)]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return per_batch(rows, run, "doc_id long, text_hash long, fp long")


def masks(radius: int) -> list[int]:
    """The covering family's masks, as signed longs: bit i gets the vector i mod (2^(r+1) - 1) + 1."""
    n = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of distinct ``fp`` within the radius."""
    family = masks(radius)
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in family])
    rows = fps.select("fp", F.posexplode(tables).alias("table", "bucket"))
    rows = block_pairs(rows, ["table", "bucket"], "fp")

    def kernel(c: dict, starts: np.ndarray) -> pa.RecordBatch | None:
        x = c["fp"].to_numpy().view(np.uint64)
        lo, hi, side = (c[k].to_numpy() for k in ("_lo", "_hi", "_side"))
        ends = np.append(starts[1:], len(x))
        size = ends - starts
        end = np.repeat(ends, size)
        one = lo == hi
        at, a, b, d = np.flatnonzero(np.repeat(size > 1, size)), [], [], 1
        while len(at := at[at + d < end[at]]):
            ok = np.bitwise_count(x[at] ^ x[at + d]) <= radius
            ok &= one[at] | (side[at] != side[at + d])
            a.append(at[ok])
            b.append(at[ok] + d)
            d += 1
        if not a:
            return None
        root = local_roots(np.concatenate(a), np.concatenate(b), len(x))
        at = np.flatnonzero(root != np.arange(len(x)))
        s = x.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(s[root[at]])], ["a", "b"])

    return grouped_runs(rows, ["table", "bucket", "_lo", "_hi"], kernel, "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, copies (rows with this fingerprint) of each row."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    found = components(fingerprint_links(classes.select("fp"), radius))
    member = classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    member = stored(member, "members")
    dropped(classes)
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = member.join(smallest, "component").select("fp", "copies", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs``, all columns, with one row of each group: one that has the group's smallest id."""
    tuned(docs.sparkSession)
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    # A row is picked by its id and a hash of its text, which costs no second look at the shingles. Null ids come last.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = stored(fps.groupBy("fp").agg(F.min(row).alias("first")), "classes")
    found = components(fingerprint_links(classes.select("fp"), radius))
    member = classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    own, kept_id, kept_text = (unused(docs, n) for n in ("own_text", "kept_id", "kept_text"))
    pick = stored(member.groupBy("component").agg(F.min("first").alias("x")).select(F.col("x.doc_id").alias(kept_id), F.col("x.text_hash").alias(kept_text)), "picked")
    dropped(fps, classes)
    rows = docs.withColumn(own, text_hash())
    same = (F.col(own) == F.col(kept_text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id))
    return rows.join(pick, same).dropDuplicates([kept_text, kept_id]).select(*[F.col(f"`{c}`") for c in docs.columns])
