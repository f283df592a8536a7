"""Shared plumbing: tables in the shared folder, Arrow batches, hashing, fixed rules."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Used where a local session, as in tests, names no shared folder.
OWN_SHARED = "/tmp/checkpoints"
#: Words are what stands between ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: bytes.split() without an argument cuts at exactly these six bytes.
BLANK = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or OWN_SHARED).rstrip('/')}/doclathe"


def stored(df: DataFrame, tag: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors recompute nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.doclathe_path = path
    return out


def sharded(df: DataFrame, tag: str, *keys: str, order: bool = False, path: str | None = None) -> DataFrame:
    """As ``stored``, in as many buckets by ``keys`` as there are shuffle partitions, each in order of ``keys`` if asked
    for: two such tables meet by these keys without a shuffle. The catalogue keeps no entry of it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    name = f"{tag}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(parts(spark), *keys)
    if order:
        writer = writer.sortBy(*keys)
    writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return _unlisted(spark, name, path)


def _unlisted(spark: SparkSession, name: str, path: str) -> DataFrame:
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the entry goes; the table is external, so its files stay
    spark.sql(f"drop table {name}")
    out.doclathe_path = path
    return out


def reopened(spark: SparkSession, path: str, schema: str, buckets: int, keys: list[str]) -> DataFrame:
    """A table that ``sharded`` has written, in another session."""
    name, by = f"t_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"create table {name} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {buckets} buckets location '{path}'")
    return _unlisted(spark, name, path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "doclathe_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: So many rows of a table may be sent to all tasks; beyond, it is joined by key.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, have = f"_{name}", {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def tuned(spark: SparkSession, records: int = 10_000, size: str = "4m") -> None:
    """Arrow batches are bounded by bytes, so that very long texts travel in batches of a few rows."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns named, whatever else ``df`` has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def per_batch(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Map Arrow batches one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def held_out(col: Column | str, remainder: int) -> Column:
    """crc32 of the id as text, modulo five, equals ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % 5 == remainder, F.lit(False))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(tokens: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` tokens (uint64), by doubling: log k passes over the array."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, block, width, done, out = np.uint64(base), tokens, 1, 0, None
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                piece = block[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += width
            if width * 2 > k:
                return mixed(out)
            block = block[:-width] * power + block[width:] if len(block) > width else block[:0]
            power, width = power * power, width * 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` entries."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    width, block = 1, x
    while width * 2 <= w:
        block = np.minimum(block[:-width], block[width:])
        width *= 2
    return np.minimum(block[:n], block[w - width : w - width + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Memo(dict):
    """What a function gives for a key, kept for up to ``room`` keys."""

    def __init__(self, f: Callable, room: int = 120_000):
        super().__init__()
        self.f, self.room = f, room

    def __missing__(self, key):
        if len(self) >= self.room:
            self.clear()
        self[key] = out = self.f(key)
        return out


class Held:
    """A broadcast value with a key by which a worker can keep what it derives from it."""

    def __init__(self, spark: SparkSession, value):
        self.id, self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._sent.value
