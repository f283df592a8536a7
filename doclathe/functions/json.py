"""JSON in model replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
RELAXED = {"mode": "PERMISSIVE", "allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}


def balanced(text: str) -> str | None:
    """From the first { or [ to its partner, counting that kind of bracket only; null if there is none."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    left = text[at]
    right, depth, i = {"{": "}", "[": "]"}[left], 0, at
    while True:
        a, b = text.find(left, i), text.find(right, i)
        if b < 0:
            return None
        if 0 <= a < b:
            depth, i = depth + 1, a + 1
        else:
            depth, i = depth - 1, b + 1
            if not depth:
                return text[at:i]


def _balanced(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else balanced(t))

    return f(c)


def extract_json(reply: Column) -> Column:
    """The first fenced block; else the first balanced object or list; else the whole text. Stripped."""
    fenced = F.regexp_like(reply, F.lit(FENCE))
    # Only replies without a fence and with a bracket reach Python.
    bare = F.when(~fenced & F.regexp_like(reply, F.lit(r"[{\[]")), reply)
    return strip(F.when(fenced, F.regexp_extract(reply, FENCE, 1)).otherwise(F.coalesce(_balanced(bare), reply)))


def parse_object(text: Column) -> Column:
    """map<string,string>; what is no object, even by relaxed rules, becomes {raw_text: text}."""
    looks = F.startswith(strip(text), F.lit("{"))
    found = F.from_json(F.when(looks, text), "map<string,string>", RELAXED)
    return F.coalesce(found, F.create_map(F.lit("raw_text"), text))
