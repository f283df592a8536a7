"""Content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(c: Column, kind: str = "string") -> Column:
    """MD5 in hexadecimal digits: of bytes as they are, of anything else as text."""
    return F.md5(c if kind == "binary" else c.cast("string"))


def fingerprints(c: Column) -> Column:
    """Of each item of a list, in order."""
    return F.transform(c, lambda x: F.md5(x.cast("string")))


def record_fingerprint(*columns: Column | str) -> Column:
    """Of the canonical JSON of some columns, nulls included."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
