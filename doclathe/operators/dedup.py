"""Exact duplicates by content fingerprint. The first row by ``order`` is the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fingerprint, record_fingerprint

#: Fingerprints of a store up to this size may be broadcast to filter rows.
BROADCAST_FINGERPRINTS = 500_000


def content_key(df: DataFrame, column: str | None = None, order: str = "doc_id", missing_unique: bool = False) -> Column:
    """The fingerprint of a column, or of all columns but ``order``. Null counts as empty; with ``missing_unique`` every
    row without the column's value is a key of its own."""
    if column is None:
        return record_fingerprint(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != order])
    c = F.col(f"`{column}`").cast("string")
    return fingerprint(F.coalesce(c, F.concat(F.lit("__empty__"), F.col(order).cast("string"))) if missing_unique else F.coalesce(c, F.lit("")))


def firsts(df: DataFrame, order: str = "doc_id") -> DataFrame:
    """fingerprint, first (smallest ``order``), copies: aggregated before the shuffle, so that a very frequent
    fingerprint is no large group."""
    return df.groupBy("fingerprint").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def mark_duplicates(df: DataFrame, column: str | None = "text", order: str = "doc_id", missing_unique: bool = False) -> DataFrame:
    """Adds fingerprint, is_duplicate, existing_id (of the original, for duplicates). ``order`` must be unique.

    Fingerprints and order keys alone are aggregated to find those that occur again. Up to BROADCAST_FINGERPRINTS of them
    are sent to all tasks, and no row is shuffled; beyond, AQE splits the join at frequent fingerprints. Columns of the
    names that are added are replaced."""
    key = content_key(df, column, order, missing_unique)
    kept = [c for c in df.columns if c.lower() not in ("fingerprint", "is_duplicate", "existing_id")]
    first = firsts(df.select(key.alias("fingerprint"), F.col(order)), order).where("copies > 1").select("fingerprint", F.col("first").alias("_first")).persist()
    if first.count() <= BROADCAST_FINGERPRINTS:
        first = F.broadcast(first)
    keyed = df.select(*[F.col(f"`{c}`") for c in kept], key.alias("fingerprint"))
    dup = F.coalesce(F.col(order) != F.col("_first"), F.lit(False))
    return keyed.join(first, "fingerprint", "left").select(*[F.col(f"`{c}`") for c in kept], "fingerprint", dup.alias("is_duplicate"), F.when(dup, F.col("_first")).alias("existing_id"))


def unique_rows(df: DataFrame, column: str | None = "text", order: str = "doc_id", missing_unique: bool = True) -> DataFrame:
    return mark_duplicates(df, column, order, missing_unique).where(~F.col("is_duplicate")).drop("is_duplicate", "existing_id")


def duplicate_rows(df: DataFrame, column: str | None = "text", order: str = "doc_id", missing_unique: bool = True) -> DataFrame:
    return mark_duplicates(df, column, order, missing_unique).where("is_duplicate").drop("is_duplicate").withColumnRenamed("existing_id", "duplicate_of")


def fingerprint_count(df: DataFrame, column: str = "text", approximate: bool = False) -> DataFrame:
    key = fingerprint(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("n"))


class FingerprintStore:
    """A table (fingerprint, doc_id), one row for each fingerprint; changes return a new store."""

    SCHEMA = "fingerprint string, doc_id string"

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("fingerprint", F.col("doc_id").cast("string").alias("doc_id"))

    @classmethod
    def empty(cls, spark) -> FingerprintStore:
        return cls(spark.createDataFrame([], cls.SCHEMA))

    @classmethod
    def load(cls, spark, items: list) -> FingerprintStore:
        """From fingerprints, or pairs of fingerprint and doc_id."""
        pairs = {(x if isinstance(x, str) else x[0]): (None if isinstance(x, str) else x[1]) for x in items}
        return cls(spark.createDataFrame(list(pairs.items()), cls.SCHEMA))

    def register(self, rows: DataFrame, order: str = "doc_id") -> FingerprintStore:
        """Rows overwrite the store's doc_id; of several rows the last by ``order`` does, compared in its own type."""
        new = rows.groupBy("fingerprint").agg(F.max_by(F.col("doc_id").cast("string"), order).alias("doc_id"))
        return FingerprintStore(self.rows.join(new.select("fingerprint"), "fingerprint", "left_anti").unionByName(new))

    def remove(self, fingerprints: DataFrame) -> FingerprintStore:
        return FingerprintStore(self.rows.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti"))

    def count(self) -> int:
        return self.rows.select("fingerprint").distinct().count()

    def _side(self) -> DataFrame:
        small = self.rows.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS
        return F.broadcast(self.rows) if small else self.rows

    def known(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` (with a fingerprint) that the store has."""
        return df.join(self._side().select("fingerprint"), "fingerprint", "left_semi")

    def unknown(self, df: DataFrame) -> DataFrame:
        return df.join(self._side().select("fingerprint"), "fingerprint", "left_anti")

    def doc_ids(self, df: DataFrame) -> DataFrame:
        """Adds existing_doc_id: empty if the store has none for it, null if it doesn't have the fingerprint."""
        own = self._side().select("fingerprint", F.coalesce("doc_id", F.lit("")).alias("existing_doc_id"))
        return df.join(own, "fingerprint", "left")
