"""JSON sinks. Nulls are written, as a record's keys are part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = {"ignoreNullFields": "false"}


def json_text(*columns: Column | str, pretty: bool = True) -> Column:
    return F.to_json(F.struct(*columns), KEEP | ({"pretty": "true"} if pretty else {}))


def jsonl_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), KEEP)


def save_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, in as many files as the data has partitions."""
    df.write.options(**KEEP).mode(mode).json(path)


def save_json(df: DataFrame, path: str) -> None:
    """A small result as one file with a list of objects; its rows come to one task."""
    one = df.agg(F.to_json(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])), KEEP | {"pretty": "true"}).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)
