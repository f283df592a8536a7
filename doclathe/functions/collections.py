"""Lists, tags and matches, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Separators in the order in which they are tried, and what an address and a phone number look like.
SEPARATORS = (";", "\n", "|", "、", "，", "；")
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"1[3-9]\d{9}"


def to_list(c: Column, separator: str = ",") -> Column:
    """Splits at the first of the known separators that occurs; without any, a list of one. Empty items go."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    out = F.array(strip(s))
    for x in reversed((separator, *(y for y in SEPARATORS if y != separator))):
        out = F.when(F.contains(s, F.lit(x)), F.transform(F.split(s, "\\Q" + x + "\\E", -1), strip)).otherwise(out)
    return F.filter(out, lambda x: x != "")


def distinct_list(c: Column) -> Column:
    """Keeps the first of equal items, in order."""
    return F.array_distinct(c)


def head(c: Column, k: int) -> Column:
    return F.slice(c, 1, k)


def tags(text: Column, words: list[str], ignore_case: bool = False) -> Column:
    """The words that occur in the text, in the order of the list."""
    if ignore_case:
        low = F.lower(text)
        return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, F.lower(w)))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def messages(system: Column | None, user: Column, history: Column | None = None) -> Column:
    """array<struct<role, content>>: system unless blank, history, user."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    none = F.array().cast("array<struct<role:string,content:string>>")
    first = none if system is None else F.when(F.coalesce(system, F.lit("")) == "", none).otherwise(one("system", system))
    return F.concat(first, none if history is None else F.coalesce(history, none), one("user", user))
