"""Resumable batches: items in shards, a ledger of what is done, retries for what failed.

The ledger is four kinds of JSON lines in one folder (batch, shard, item and attempt events). State is the latest event of
each shard or item, found by aggregation. An attempt writes its rows to a folder of its own and is named in the ledger
together with what became of its shards and items, in one write; only named attempts have results. So a batch can be
killed at any time: what an unnamed attempt has written doesn't count, and an item that went well is never run again."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "completed", "failed", "paused", "cancelled")
EVENT = "batch_id string, kind string, shard_id string, idx long, status string, n_ok long, n_failed long, error string, retry int, at string"


#: So many shards may be sent to all tasks to pick their items; beyond, items are joined by shard.
BROADCAST_SHARDS = 200_000


def new_batch_id(now: datetime | None = None) -> str:
    return f"batch_{(now or datetime.now()):%Y%m%d_%H%M%S}_{secrets.token_hex(3)}"


def shard_plan(spark: SparkSession, total: int, shard_size: int = 10) -> DataFrame:
    """shard_id, start_index, end_index (inclusive), status: contiguous ranges of ``total`` items."""
    n = -(-total // shard_size)
    i = F.col("id")
    return spark.range(n).select(F.format_string("shard_%04d", i).alias("shard_id"), (i * shard_size).alias("start_index"), F.least((i + 1) * shard_size - 1, F.lit(total - 1)).alias("end_index"), F.lit("pending").alias("status"))


def shard_of(idx: Column, shard_size: int) -> Column:
    return F.format_string("shard_%04d", F.floor(idx / shard_size))


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key, by (at, retry)."""
    return events.groupBy(*keys).agg(F.max_by(F.struct("status", "n_ok", "n_failed", "error", "retry", "at"), F.struct("at", "retry")).alias("x")).select(*keys, "x.*")


def progress(shards: DataFrame) -> DataFrame:
    """total_shards, completed, failed, running, pending, processed, failed_items, percent, done."""
    n = F.count(F.lit(1))
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    done = F.count_if(F.col("status") == "completed")
    return shards.agg(
        n.alias("total_shards"), is_("completed"), is_("failed"), is_("running"), is_("pending"),
        F.coalesce(F.sum(F.when(F.col("status").isin("completed", "failed"), F.col("n_ok"))), F.lit(0)).alias("processed"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed_items"),
        F.when(n > 0, F.round(100.0 * done / F.greatest(n, F.lit(1)), 2)).otherwise(F.lit(0.0)).alias("percent"),
        F.coalesce(F.bool_and(F.col("status").isin("completed", "failed")), F.lit(True)).alias("done"),
    )


def retriable(items: DataFrame, max_retry: int = 3) -> DataFrame:
    return items.where((F.col("status") == "failed") & (F.col("retry") < max_retry))


@dataclass
class Batch:
    """A batch over rows with a dense index ``idx``. ``work`` maps rows (idx, ...) to rows with idx, ok and error."""

    spark: SparkSession
    root: str
    batch_id: str
    shard_size: int = 10
    #: Called after each run: with the progress, and with the rows (idx, error) that failed.
    on_progress: Callable[[dict], None] | None = None
    on_failed: Callable[[DataFrame], None] | None = None
    #: Called after each run for each shard that was run, and for each item that failed, one after the other.
    on_shard: Callable[[dict], None] | None = None
    on_item_failed: Callable[[dict], None] | None = None

    @property
    def path(self) -> str:
        return f"{self.root}/{self.batch_id}"

    def _now(self) -> str:
        return datetime.now().isoformat()

    def _write(self, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, EVENT)
        df.write.mode("append").json(f"{self.path}/ledger")

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(EVENT).json(f"{self.path}/ledger")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], EVENT)
            raise

    def create(self, total: int) -> Batch:
        at = self._now()
        plan = shard_plan(self.spark, total, self.shard_size)
        none = F.lit(None)
        self._write(plan.select(F.lit(self.batch_id).alias("batch_id"), F.lit("shard").alias("kind"), "shard_id", none.cast("long").alias("idx"), "status", F.lit(0).cast("long").alias("n_ok"), F.lit(0).cast("long").alias("n_failed"), none.cast("string").alias("error"), F.lit(0).alias("retry"), F.lit(at).alias("at")))
        return self

    def shards(self) -> DataFrame:
        return latest(self.events().where("kind = 'shard'"), "shard_id")

    def items(self) -> DataFrame:
        return latest(self.events().where("kind = 'item'"), "idx")

    def pending(self) -> DataFrame:
        """Shards that aren't done: a running one was interrupted and counts as pending."""
        return self.shards().where("status in ('pending', 'running', 'failed')").withColumn("status", F.lit("pending"))

    def status(self) -> str:
        last = latest(self.events().where("kind = 'batch'"), "batch_id").first()
        if last is not None and last["status"] == "cancelled":
            return "cancelled"
        p = progress(self.shards()).first()
        if not p["total_shards"] or not p["done"]:
            return "running" if p["completed"] else "pending"
        return "failed" if p["failed"] else "completed"

    def is_resume(self) -> bool:
        return self.shards().where("status = 'completed'").limit(1).count() > 0 and self.status() != "completed"

    def cancel(self) -> None:
        self._write([(self.batch_id, "batch", None, None, "cancelled", None, None, None, 0, self._now())])

    def results(self) -> DataFrame | None:
        """Rows of the items that went well, one for each; None before the first attempt has ended."""
        named = [r["error"] for r in self.events().where("kind = 'attempt'").select("error").collect()]
        return self.spark.read.parquet(*[f"{self.path}/attempts/{n}" for n in named]).where("ok").drop("ok", "error") if named else None

    def run(self, items: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Runs all pending shards at once: Spark deals their rows out, the ledger keeps the bounds. Of a shard that has
        failed before, items that went well aren't run again. Returns the progress."""
        if self.status() == "cancelled":
            return progress(self.shards())
        todo = self.pending().select("shard_id")
        if todo.count() <= BROADCAST_SHARDS:
            todo = F.broadcast(todo)
        own = items.withColumn("shard_id", shard_of(F.col("idx"), self.shard_size)).join(todo, "shard_id")
        if (done := self.results()) is not None:
            own = own.join(done.select("idx"), "idx", "left_anti")
        none = F.lit(None)
        self._write(self.shards().join(todo, "shard_id").select(*self._event("shard"), "shard_id", none.cast("long").alias("idx"), F.lit("running").alias("status"), "n_ok", "n_failed", none.cast("string").alias("error"), "retry"))
        return self._finish(own, work, False)

    def retry(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], max_retry: int = 3) -> DataFrame:
        """Runs failed items again, each up to ``max_retry`` times."""
        todo = retriable(self.items(), max_retry).select("idx")
        return self._finish(items.join(todo, "idx").withColumn("shard_id", shard_of(F.col("idx"), self.shard_size)), work, True)

    def _event(self, kind: str) -> list[Column]:
        return [F.lit(self.batch_id).alias("batch_id"), F.lit(kind).alias("kind"), F.lit(self._now()).alias("at")]

    def _finish(self, own: DataFrame, work: Callable[[DataFrame], DataFrame], again: bool) -> DataFrame:
        attempt = secrets.token_hex(8)
        where = f"{self.path}/attempts/{attempt}"
        work(own.drop("shard_id")).write.parquet(where)
        done, none = self.spark.read.parquet(where), F.lit(None)
        at = self._event("shard")[2]  # one time for all events of an attempt
        about = lambda kind: [*self._event(kind)[:2], at]
        before = self.items().select("idx", F.col("retry").alias("_retry"))
        tried = done.select("idx", "ok", "error").join(before, "idx", "left")
        tried = tried.where(~F.col("ok") | F.col("_retry").isNotNull())
        retry = F.coalesce(F.col("_retry") + F.lit(int(again)), F.lit(0))
        items = tried.select(*about("item"), none.cast("string").alias("shard_id"), "idx", F.when(F.col("ok"), "completed").otherwise("failed").alias("status"), F.col("ok").cast("long").alias("n_ok"), (~F.col("ok")).cast("long").alias("n_failed"), "error", retry.alias("retry"))
        counts = done.select(shard_of(F.col("idx"), self.shard_size).alias("shard_id"), "ok").groupBy("shard_id").agg(F.count_if("ok").alias("g"), F.count_if(~F.col("ok")).alias("b"))
        # A retry leaves failed items that have had their retries; a run takes up all of its shards' items.
        failed = F.col("n_failed") - F.col("g") if again else F.col("b")
        touched = F.col("status").isin("running") if not again else F.col("g").isNotNull()
        counts = self.shards().join(counts, "shard_id", "left").where(touched).select("shard_id", (F.col("n_ok") + F.coalesce("g", F.lit(0))).alias("g"), F.coalesce(failed, F.lit(0)).alias("b"), "retry")
        state = F.when(F.col("b") > 0, "failed").when(F.col("g") > 0, "completed").otherwise("pending")
        shards = counts.select(*about("shard"), "shard_id", none.cast("long").alias("idx"), state.alias("status"), F.col("g").alias("n_ok"), F.col("b").alias("n_failed"), none.cast("string").alias("error"), (F.col("retry") + 1).alias("retry"))
        named = self.spark.range(1).select(*about("attempt"), none.cast("string").alias("shard_id"), none.cast("long").alias("idx"), F.lit("completed").alias("status"), none.cast("long").alias("n_ok"), none.cast("long").alias("n_failed"), F.lit(attempt).alias("error"), F.lit(0).alias("retry"))
        self._write(items.unionByName(shards).unionByName(named))
        now = progress(self.shards())
        if self.on_failed:
            self.on_failed(done.where(~F.col("ok")).select("idx", "error"))
        if self.on_item_failed:
            for r in done.where(~F.col("ok")).select("idx", "error").toLocalIterator():
                self.on_item_failed(r.asDict())
        if self.on_shard:
            ran = done.select(shard_of(F.col("idx"), self.shard_size).alias("shard_id")).distinct()
            for r in self.shards().join(ran, "shard_id").toLocalIterator():
                self.on_shard(r.asDict())
        if self.on_progress:
            self.on_progress(now.first().asDict())
        return now

    def summary(self) -> dict:
        return {"batch_id": self.batch_id, "status": self.status(), **progress(self.shards()).first().asDict()}


class Scheduler:
    """Batches under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def create_and_run(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], shard_size: int = 10, batch_id: str | None = None) -> Batch:
        batch = Batch(self.spark, self.root, batch_id or new_batch_id(), shard_size).create(items.count())
        batch.run(items, work)
        return batch

    def resume(self, batch_id: str, items: DataFrame, work: Callable[[DataFrame], DataFrame], shard_size: int = 10) -> Batch:
        batch = Batch(self.spark, self.root, batch_id, shard_size)
        batch.run(items, work)
        return batch

    def status(self, batch_id: str) -> dict:
        return Batch(self.spark, self.root, batch_id).summary()


def stream_files(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], schema: str = "path string, content binary"):
    """The streaming form of a batch: files that haven't been seen are read once, transformed and appended; Spark's
    checkpoint is the ledger, so that a restart goes on where the last run ended."""
    rows = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(source)
    return transform(rows).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def stream_deduplicated(rows: DataFrame, key: str = "fingerprint", time_column: str | None = None, within: str = "1 day") -> DataFrame:
    """First rows by key; with a time column, state is kept for ``within`` only."""
    if time_column:
        return rows.withWatermark(time_column, within).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])
