"""Command line: python -m doclathe.cli VERB ... (or through spark-submit)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import extraction, mapping, triage
from .operators.rules import RuleValidator
from .registry import PluginManager
from .sources import files, sinks
from .streaming.batch import Batch, Scheduler

SHOWN = 10_000


def session() -> SparkSession:
    return SparkSession.builder.appName("doclathe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parsed(spark: SparkSession, path: str) -> DataFrame:
    out = files.parse_files(files.read_files(spark, path))
    return out.withColumn("doc_id", F.md5("file_path"))


def extracted(spark: SparkSession, path: str, provider: str | None, prompt: str = "default") -> DataFrame:
    """doc_id, source_file and the reply as JSON; without a provider, from the offline extractor."""
    docs = parsed(spark, path).withColumn("text", files.full_text())
    if provider:
        replies = extraction.extract_with_model(docs, extraction.client_factory(provider), prompt).withColumn("data", F.to_json("data"))
        return docs.select("doc_id", F.col("file_path").alias("source_file")).join(replies, "doc_id")
    own = docs.select("doc_id", F.col("file_path").alias("source_file"), "success", "error", F.to_json(F.struct(*extraction.OfflineExtractor().columns(F.col("text")))).alias("data"))
    return own


def pipeline(spark: SparkSession, path: str, provider: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quality report) of a file or folder."""
    records = mapping.Converter().convert_response(extracted(spark, path, provider), now=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    report = triage.QualityValidator(RuleValidator().required("doc_id").required("title"), Config.load().recheck_threshold).report(records.drop("_extraction_error"), dedup_field="summary")
    return records, report


def emit(df: DataFrame, out: str | None) -> None:
    if out:
        sinks.save_jsonl(df, out)
        return
    shown = 0
    for r in df.select(sinks.jsonl_line(df).alias("x")).toLocalIterator():
        shown += len(r["x"])
        print(r["x"][:SHOWN])
        if shown > SHOWN:
            print("... (give --output for the rest)")
            return


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="doclathe")
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb in ("pipeline", "parse", "extract", "validate", "batch"):
        v = verbs.add_parser(verb)
        v.add_argument("path")
        v.add_argument("-o", "--output")
        if verb in ("pipeline", "extract", "batch"):
            v.add_argument("--provider")
        if verb == "extract":
            v.add_argument("--prompt", default="default")
        if verb == "validate":
            v.add_argument("--required", nargs="*", default=[])
            v.add_argument("--threshold", type=float, default=Config.load().recheck_threshold)
            v.add_argument("--dedup-field")
        if verb == "batch":
            v.add_argument("--state", required=True)
            v.add_argument("--shard-size", type=int, default=10)
            v.add_argument("--resume")
            v.add_argument("--retry", action="store_true")
    v = verbs.add_parser("status")
    v.add_argument("state")
    v.add_argument("batch_id")
    verbs.add_parser("plugins")
    a = top.parse_args(argv)
    spark = session()
    if a.verb == "pipeline":
        records, report = pipeline(spark, a.path, a.provider)
        emit(records, a.output)
        print(json.dumps(triage.QualityValidator.summary(report).first().asDict()))
    elif a.verb == "parse":
        emit(files.preview(parsed(spark, a.path)) if not a.output else parsed(spark, a.path), a.output)
    elif a.verb == "extract":
        emit(extracted(spark, a.path, a.provider, a.prompt), a.output)
    elif a.verb == "validate":
        rules = RuleValidator()
        for f in a.required:
            rules.required(f)
        rows = files.read_json_records(spark, a.path).withColumn("_ord", F.monotonically_increasing_id())
        report = triage.QualityValidator(rules, a.threshold).report(rows, dedup_field=a.dedup_field, order="_ord")
        emit(report, a.output)
        print(json.dumps(triage.QualityValidator.summary(report).first().asDict()))
    elif a.verb == "batch":
        # Items are a folder's files by path; the index is dense, and no task holds them all.
        indexed = files.read_files(spark, a.path).select("path").orderBy("path").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
        listed = spark.createDataFrame(indexed, "path string, idx long")

        def work(items: DataFrame) -> DataFrame:
            whole = items.join(files.read_files(spark, a.path), "path")
            out = files.parse_files(whole, keep=("idx",))
            return out.select("idx", F.col("success").alias("ok"), "error", "file_path", "text", "paragraphs")

        s = Scheduler(spark, a.state)
        if a.resume:
            b = Batch(spark, a.state, a.resume, a.shard_size)
            b.retry(listed, work) if a.retry else b.run(listed, work)
        else:
            b = s.create_and_run(listed, work, a.shard_size)
        if a.output:
            sinks.save_jsonl(b.results(), a.output)
        print(json.dumps(b.summary()))
    elif a.verb == "status":
        print(json.dumps(Scheduler(spark, a.state).status(a.batch_id)))
    else:
        emit(PluginManager().list_all(spark), None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
