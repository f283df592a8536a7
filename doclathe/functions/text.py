"""String functions, as Catalyst expressions. A null text gives an empty one unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's str.strip() also takes the four separators that Java's class leaves out.
BLANKS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Strips Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, rf"(?U)^{BLANKS}+|{BLANKS}+\z", "")


def trim(c: Column) -> Column:
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """One blank for runs of blanks and tabs, one empty line at most, stripped."""
    return trim(F.regexp_replace(F.regexp_replace(c.cast("string"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def collapse_blank_runs(c: Column) -> Column:
    """Runs of three or more line ends, with blanks between, become two; runs of two or more blanks one."""
    return F.regexp_replace(F.regexp_replace(c, r"\n\s*\n\s*\n", "\n\n"), r"[ \t]{2,}", " ")


def remove_html_tags(c: Column) -> Column:
    return trim(F.regexp_replace(c.cast("string"), r"<[^>]+>", ""))


def truncate(c: Column, max_length: int = 1000) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.length(s) > max_length, F.concat(F.substring(s, 1, max_length), F.lit("..."))).otherwise(s)


def to_lower(c: Column) -> Column:
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def regex_extract(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    s = c.cast("string")
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def regex_replace(c: Column, pattern: str, replacement: str = "") -> Column:
    """``replacement`` may hold \\1 to \\9."""
    import re

    java = re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))
    return F.coalesce(F.regexp_replace(c.cast("string"), pattern, java), F.lit(""))


def clean_json(c: Column) -> Column:
    """Drops comments and trailing commas, straightens quotes; single quotes only where a text starts with {' or [{."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.regexp_replace(s, r"//[^\n]*\n", "\n")
    s = F.regexp_replace(s, r"(?s)/\*.*?\*/", "")
    s = F.translate(s, "“”‘’", "\"\"''")
    s = F.regexp_replace(s, r"(?U),\s*([}\]])", "$1")
    return trim(F.when(F.startswith(s, F.lit("{'")) | F.startswith(s, F.lit("[{")), F.translate(s, "'", '"')).otherwise(s))


def render_prompt(template: str, text: Column) -> Column:
    """Every {text} of the template becomes the text."""
    return F.replace(F.lit(template), F.lit("{text}"), F.coalesce(text, F.lit("")))


def line_stats(c: Column) -> Column:
    """struct(total_lines, non_empty_lines, char_count)"""
    s = F.coalesce(c, F.lit(""))
    lines = F.split(s, "\n", -1)
    filled = F.filter(lines, lambda x: strip(x) != "")
    return F.struct(F.size(lines).cast("long").alias("total_lines"), F.size(filled).cast("long").alias("non_empty_lines"), F.length(s).cast("long").alias("char_count"))


def paragraphs(c: Column, separator: str = "\n\n", keep_empty: bool = False) -> Column:
    """Stripped pieces between literal separators."""
    cut = F.transform(F.split(F.coalesce(c, F.lit("")), "\\Q" + separator + "\\E", -1), strip)
    return cut if keep_empty else F.filter(cut, lambda x: x != "")


def file_extension(path: Column) -> Column:
    """What follows the last point, in lower case; http(s) addresses are html."""
    address = F.startswith(path, F.lit("http://")) | F.startswith(path, F.lit("https://"))
    return F.when(address, F.lit("html")).otherwise(F.lower(F.substring_index(path, ".", -1)))
