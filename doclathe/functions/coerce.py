"""Numbers, dates and declared types, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, trim

NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def parsed_float(c: Column) -> Column:
    """A number as Python's float() reads it, or null."""
    s = strip(c.cast("string"))
    low = F.lower(F.regexp_replace(s, r"^\+", ""))
    special = F.when(low.endswith("nan"), F.lit(float("nan"))).when(F.startswith(low, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.regexp_like(s, F.lit(NUMBER)), F.translate(s, "_", "").try_cast("double")).when(F.regexp_like(s, F.lit(SPECIAL)), special)


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(parsed_float(c), F.lit(float(default)))


def to_int(c: Column, default: int = 0) -> Column:
    """Towards zero; what is no number, or no 64-bit one, is the default."""
    x = parsed_float(c)
    return F.coalesce(F.when(F.abs(x) < 9.2233720368547e18, x).cast("bigint"), F.lit(default).cast("bigint"))


def extract_number(c: Column) -> Column:
    """The first number within a text, or null."""
    found = F.regexp_extract(c.cast("string"), r"([-+]?\d+\.?\d*)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def to_bool(c: Column, kind: str) -> Column:
    """Truth of a value of the given Spark type: not empty, not zero."""
    if kind == "string":
        return c != ""
    if kind.startswith(("array", "map")):
        return F.size(c) > 0
    return c if kind == "boolean" else c != 0


def to_dict(c: Column) -> Column:
    """A JSON object as a map; anything else is an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(F.when(F.startswith(strip(c), F.lit("{")), c), "map<string,string>"), empty)


#: What the date formats of the compatible mode are, with the length of their format strings.
DATES = (
    (17, r"^(\d{4})-(\d{1,2})-(\d{1,2})T(\d{1,2}):(\d{1,2}):(\d{1,2})$"),
    (17, r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})$"),
    (8, r"^(\d{4})-(\d{1,2})-(\d{1,2})$"),
    (8, r"^(\d{4})/(\d{1,2})/(\d{1,2})$"),
    (11, r"^(\d{4})年(\d{1,2})月(\d{1,2})日$"),
)
ISO = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def to_iso_datetime(c: Column, compat: bool = False) -> Column:
    """ISO 8601 without zone, for five formats; otherwise an ISO time within the text, or else the stripped text.

    ``compat`` reads of a text only as many characters as its format string has, which leaves most full dates as they are."""
    s = trim(c)
    found = []
    for width, pattern in DATES:
        t = F.substring(s, 1, width) if compat else s
        part = [F.regexp_extract(t, pattern, i + 1) for i in range(pattern.count("("))] + [F.lit("0")] * (6 - pattern.count("("))
        two = lambda x: F.lpad(x, 2, "0")
        iso = F.concat(part[0], F.lit("-"), two(part[1]), F.lit("-"), two(part[2]), F.lit("T"), two(part[3]), F.lit(":"), two(part[4]), F.lit(":"), two(part[5]))
        real = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
        found.append(F.when(F.regexp_like(t, F.lit(pattern)) & real, iso))
    within = F.nullif(F.regexp_extract(s, ISO, 0), F.lit(""))
    return F.coalesce(*found, within, s)


def round2(c: Column) -> Column:
    return F.round(c, 2)
