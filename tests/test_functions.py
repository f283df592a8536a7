from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from doclathe.functions import coerce as N
from doclathe.functions import collections as A
from doclathe.functions import hashing as H
from doclathe.functions import json as J
from doclathe.functions import text as S
from doclathe.shipping import ship


@pytest.fixture(scope="module")
def of(spark):
    """The value of a function of one text."""
    ship(spark)

    def run(f, value):
        return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]

    return run


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (S.trim, "  a b　\n", "a b"),
        (S.trim, None, ""),
        (S.normalize_whitespace, "a   b\t c", "a b c"),
        (S.normalize_whitespace, "a\n\n\nb", "a\n\nb"),
        (S.remove_html_tags, "<div>a<span>b</span></div> ", "ab"),
        (lambda c: S.truncate(c, 5), "0123456789", "01234..."),
        (lambda c: S.truncate(c, 5), "0123", "0123"),
        (S.to_lower, None, ""),
        (lambda c: S.regex_extract(c, r"(\d+)-(\d+)", 2), "a 12-34", "34"),
        (lambda c: S.regex_extract(c, r"\d+"), "abc", None),
        (lambda c: S.regex_replace(c, r"(\w)\d", r"<\1>"), "a1b2", "<a><b>"),
        (S.clean_json, "{'a': 1, 'b': [1, 2,],}", '{"a": 1, "b": [1, 2]}'),
        (S.clean_json, '{"a": 1, // note\n "b": /* x */ 2}', '{"a": 1, \n "b":  2}'),
        (S.clean_json, "{“a”: ‘b’}", "{\"a\": 'b'}"),
        (lambda c: S.render_prompt("{text} and {text} {{}}", c), "x", "x and x {{}}"),
        (S.paragraphs, "a\n\n b \n\n\n\nc", ["a", "b", "c"]),
        (lambda c: S.paragraphs(c, "---"), "A---B---C", ["A", "B", "C"]),
        (S.paragraphs, "", []),
        (S.file_extension, "https://x.y/z.txt", "html"),
        (S.file_extension, "/a/b.TXT", "txt"),
        (N.to_int, "42", 42),
        (N.to_int, " 3.7 ", 3),
        (N.to_int, "-3.7", -3),
        (N.to_int, "abc", 0),
        (lambda c: N.to_int(c, -1), "abc", -1),
        (N.to_int, "inf", 0),
        (N.to_int, "1_000", 1000),
        (N.to_int, "3.7d", 0),
        (N.to_float, "3.14", 3.14),
        (N.to_float, "1e3", 1000.0),
        (N.to_float, "-Infinity", -math.inf),
        (N.to_float, "abc", 0.0),
        (N.to_float, None, 0.0),
        (N.extract_number, "costs 100 coins", 100.0),
        (N.extract_number, "none", None),
        (N.to_iso_datetime, "2024-06-04", "2024-06-04T00:00:00"),
        (N.to_iso_datetime, "2024-1-15", "2024-01-15T00:00:00"),
        (N.to_iso_datetime, "2024/06/04", "2024-06-04T00:00:00"),
        (N.to_iso_datetime, "2024年6月4日", "2024-06-04T00:00:00"),
        (N.to_iso_datetime, "2024-06-04 15:30:00", "2024-06-04T15:30:00"),
        (N.to_iso_datetime, "at 2024-06-04T15:30:00Z", "2024-06-04T15:30:00"),
        (N.to_iso_datetime, "2024-13-45", "2024-13-45"),
        (N.to_iso_datetime, "soon", "soon"),
        (lambda c: N.to_iso_datetime(c, True), "2024-06-04", "2024-06-04"),
        (lambda c: N.to_iso_datetime(c, True), "2024-6-4", "2024-06-04T00:00:00"),
        (lambda c: N.to_iso_datetime(c, True), "2024-1-15", "2024-01-01T00:00:00"),
        (lambda c: N.to_iso_datetime(c, True), "2024-6-14 15:30:45", "2024-06-14T15:30:04"),
        (A.to_list, "a, b,,c", ["a", "b", "c"]),
        (A.to_list, "a;b;c", ["a", "b", "c"]),
        (A.to_list, "a、b", ["a", "b"]),
        (A.to_list, "word", ["word"]),
        (A.to_list, None, []),
        (lambda c: A.distinct_list(A.to_list(c)), "a,b,a,c", ["a", "b", "c"]),
        (lambda c: A.tags(c, ["AI", "SQL"]), "sql and AI", ["AI"]),
        (lambda c: A.tags(c, ["AI", "SQL"], True), "sql and AI", ["AI", "SQL"]),
        (A.emails, "a.b+c@x-y.org, no@", ["a.b+c@x-y.org"]),
        (A.phones, "call 13812345678 or 12812345678", ["13812345678"]),
        (H.fingerprint, "hello world", "5eb63bbbe01eeed093cb22bb8f5acdc3"),
        (J.extract_json, 'Sure:\n```json\n{"a": 1}\n```\nbye', '{"a": 1}'),
        (J.extract_json, 'x {"a": {"b": 1}} y', '{"a": {"b": 1}}'),
        (J.extract_json, "list [1, [2]] end", "[1, [2]]"),
        (J.extract_json, " plain ", "plain"),
        (J.extract_json, "open { only", "open { only"),
        (J.parse_object, "{'a': 1}", {"a": "1"}),
        (J.parse_object, "no json", {"raw_text": "no json"}),
    ],
)
def test_function(of, f, x, y):
    assert of(f, x) == y


def test_nan(of):
    assert math.isnan(of(N.to_float, "NaN"))


def test_messages(spark):
    df = spark.createDataFrame([("hi", [("user", "a"), ("assistant", "b")])], "u string, h array<struct<role:string,content:string>>")
    two, four, one = df.select(A.messages(F.lit("s"), F.col("u")).alias("a"), A.messages(F.lit("s"), F.col("u"), F.col("h")).alias("b"), A.messages(F.lit(""), F.col("u")).alias("c")).first()
    assert [len(two), len(four), len(one)] == [2, 4, 1]
    assert [m["role"] for m in four] == ["system", "user", "assistant", "user"]


def test_line_stats(of):
    assert tuple(of(S.line_stats, "a\n\nb\nc")) == (4, 3, 6)
