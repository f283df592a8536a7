"""Cleaning rules over every string column, and the pipeline that folds them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as S

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "_ga", "_gl", "_branch_match_id")


def over_strings(df: DataFrame, f: Callable[[Column], Column], columns: Iterable[str] | None = None) -> DataFrame:
    """Applies ``f`` to all string columns (or those named); null stays null."""
    own = set(columns) if columns is not None else {x.name for x in df.schema if isinstance(x.dataType, T.StringType)}
    return df.select(*[F.when(F.col(f"`{c}`").isNotNull(), f(F.col(f"`{c}`"))).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns])


#: Phones, then identity numbers, then mail addresses, and what is left of them; the order matters.
MASKS = (
    (r"(1[3-9]\d)\d{4}(\d{4})", "$1****$2"),
    (r"(\d{6})\d{8,11}(\d{4})", "$1********$2"),
    (r"(?U)(\w)[\w.]*(@\w+\.\w+)", "$1***$2"),
)


def mask_sensitive(c: Column) -> Column:
    return reduce(lambda x, m: F.regexp_replace(x, *m), MASKS, c)


def without_tracking(c: Column) -> Column:
    """Drops tracking parameters from http addresses and leaves all else of the address as it is."""
    names = "|".join(TRACKING)
    s = F.regexp_replace(c, rf"([?&])(?:(?:{names})=[^&#]*(?:&|(?=#)|$))+", "$1")
    s = F.regexp_replace(s, r"[?&](#|$)", "$1")
    return F.when(F.startswith(c, F.lit("http")), s).otherwise(c)


def rebuilt_url(url: str) -> str:
    """Drops tracking parameters and encodes the query anew, equal names together, empty values kept."""
    if not url.startswith("http"):
        return url
    try:
        parts = urlparse(url)
    except ValueError:
        return url
    kept = {k: v for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k not in TRACKING}
    return urlunparse(parts._replace(query=urlencode(kept, doseq=True)))


def _rebuilt(c: Column) -> Column:
    @F.pandas_udf("string")
    def f(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: None if u is None else rebuilt_url(u))

    return f(c)


def normalize_url(c: Column) -> Column:
    """The exact form of ``without_tracking``; only addresses with a query or fragment mark go through Python."""
    return F.when(F.startswith(c, F.lit("http")) & F.regexp_like(c, F.lit(r"[?;#]")), _rebuilt(c)).otherwise(c)


@dataclass
class CleanRule:
    """A named transform of a DataFrame; rows for which ``needed`` is false stay as they are."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    needed: Callable[[DataFrame], Column] | None = None
    version: str = "1.0"
    description: str = ""
    author: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.needed is None:
            return self.apply(df)
        want = F.coalesce(self.needed(df), F.lit(False))
        new = self.apply(df.withColumn("_want", want).withColumn("_old", F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        return new.select(*[F.when(F.col("_want"), F.col(f"`{c}`")).otherwise(F.col(f"_old.`{c}`")).alias(c) for c in df.columns])


whitespace = CleanRule("whitespace_normalizer", lambda d: over_strings(d, S.normalize_whitespace), description="blanks and empty lines")
urls = CleanRule("url_normalizer", lambda d: over_strings(d, normalize_url), description="tracking parameters")
html_tags = CleanRule("html_tag_stripper", lambda d: over_strings(d, S.remove_html_tags), description="HTML tags")
sensitive = CleanRule("sensitive_data_masker", lambda d: over_strings(d, mask_sensitive), description="phones, identity numbers, mail")
BUILT_IN = (whitespace, urls, html_tags, sensitive)


def clean(df: DataFrame, rules: Iterable[CleanRule]) -> DataFrame:
    """Applies rules in order."""
    return reduce(lambda d, rule: rule(d), rules, df)
