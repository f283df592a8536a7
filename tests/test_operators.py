from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from doclathe.operators import cleaning, dedup, extraction, mapping, triage
from doclathe.operators.rules import RuleValidator, all_valid


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_clean_rules(spark):
    df = spark.createDataFrame([(1, "13812345678 at john.doe@mail.com", "<b>x</b>  y", "http://a.b/?utm_source=x&q=1")], "n int, a string, b string, u string")
    out = cleaning.clean(df, cleaning.BUILT_IN).first()
    assert out["a"] == "138****5678 at j***@mail.com"
    assert out["b"] == "x y"
    assert out["u"] == "http://a.b/?q=1"
    assert out["n"] == 1


def test_phone_rule_comes_before_identity_numbers(spark):
    df = spark.createDataFrame([("110101199003071234",), (None,)], "a string")
    assert [r["a"] for r in cleaning.clean(df, [cleaning.sensitive]).collect()] == ["110101199****71234", None]


@pytest.mark.parametrize(("url", "out"), [("http://a/?utm_source=1", "http://a/"), ("http://a/?b=&gclid=2&b=3#f", "http://a/?b=&b=3#f"), ("ftp://a/?gclid=1", "ftp://a/?gclid=1"), ("http://a/?q=a b", "http://a/?q=a+b")])
def test_urls(spark, url, out):
    assert cleaning.rebuilt_url(url) == out
    if " " not in url:
        assert spark.createDataFrame([(url,)], "u string").select(cleaning.without_tracking(F.col("u"))).first()[0] == out


def test_rule_only_where_needed(spark):
    rule = cleaning.CleanRule("up", lambda d: cleaning.over_strings(d, F.upper), lambda d: F.col("a").startswith("x"))
    assert [r[0] for r in rule(spark.createDataFrame([("xa",), ("ya",), (None,)], "a string")).collect()] == ["XA", "ya", None]


def mapped(spark, record, **kw):
    return mapping.Converter(**kw).convert(spark.createDataFrame([(record,)], "record string")).first()


def test_mapping(spark):
    out = mapped(spark, '{"name": "second", "title": "first", "tags": "a,b", "score": "0.5", "unused": 1}')
    assert (out["title"], out["keywords"], out["confidence"], out["content_type"]) == ("first", ["a", "b"], 0.5, "document")
    assert mapped(spark, '{"name": "second"}')["title"] == "second"
    assert mapped(spark, '{"Title": "any case"}')["title"] == "any case"
    blocked = mapped(spark, '{"title": null, "name": "second"}')
    assert blocked["title"] == ""
    empty = mapped(spark, "{}")
    assert (empty["doc_id"], empty["entities"], empty["confidence"]) == ("", [], None)
    assert mapped(spark, "nonsense")["_conversion_error"] == "not a record"
    assert mapped(spark, '{"confidence": "high"}')["confidence"] == 0.0


def test_strict_mapping(spark):
    df = spark.createDataFrame([("{}",)], "record string")
    with pytest.raises(Exception, match="required field doc_id"):
        mapping.Converter().convert(df, strict=True).collect()


def test_schema_round_trip_and_warnings(spark):
    s = mapping.OutputSchema("t").add_fields([mapping.FieldRule("n", ["n"], True, 0, int, validators=[lambda c: c > 3], normalizers=[lambda c: c + 1])])
    assert mapping.OutputSchema.from_dict(s.to_dict()).to_dict() == s.to_dict()
    assert s.required_fields() == ["n"] == s.field_names()
    assert mapped(spark, '{"n": "2.9"}', schema=s)["n"] == 3
    m = F.from_json("record", "map<string,string>")
    assert spark.createDataFrame([('{"n": 2}',)], "record string").select(mapping.Converter(s).warnings(m)).first()[0] == ["n"]


def test_response_mapping(spark):
    df = spark.createDataFrame([(True, '{"title": "t"}', "7"), (True, "just text", "8"), (False, None, "9")], "success boolean, data string, doc_id string")
    out = mapping.Converter().convert_response(df).orderBy("doc_id").collect()
    assert [(r["title"], r["raw_text"], r["_extraction_error"]) for r in out] == [("t", "", None), ("", "just text", None), ("", "", "extraction failed")]


def test_rules(spark):
    r = RuleValidator().required("title").type("n", int).regex("title", "[a-z]+").length("title", 2, 4).range("score", 0, 1).custom("title", "no_x", lambda c: ~c.contains("x"))
    df = spark.createDataFrame([(1, "abc", 1, "0.5"), (2, "", 1, "2"), (3, None, 1, "bad"), (4, "axbcd", None, "nan"), (5, "ABC", 2, None)], "id int, title string, n int, score string")
    found = {x["id"]: [e["rule"] for e in x["rule_results"]] for x in r.validate(df).collect()}
    assert found == {1: ["all_pass"], 2: ["required", "regex", "length", "range"], 3: ["required", "no_x", "range"], 4: ["length", "no_x"], 5: ["regex"]}
    good, bad = r.split(df)
    assert rows(good.select("id"), "id") == [(1,)]
    assert rows(bad.select("id"), "id") == [(2,), (3,), (4,), (5,)]
    assert r.validate(df, strict=True).where(F.size("rule_results") > 1).count() == 0
    assert r.summary() == {"title": ["required", "regex", "length", "no_x"], "n": ["type_check"], "score": ["range"]}


def test_warnings_pass_and_missing_fields_are_null(spark):
    df = spark.createDataFrame([(1,)], "id int")
    r = RuleValidator().custom("id", "odd", lambda c: c > 5, level="warning").regex("absent", "a")
    out = r.validate(df).select(all_valid(F.col("rule_results")).alias("ok"), "rule_results").first()
    assert out["ok"] and [x["rule"] for x in out["rule_results"]] == ["odd"]
    assert RuleValidator().required("absent").split(df)[1].count() == 1


def test_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "doc_id int, text string")
    assert rows(dedup.mark_duplicates(df).select("doc_id", "is_duplicate", "existing_id"), "doc_id") == [(1, False, None), (2, False, None), (3, True, 1), (4, False, None), (5, True, 4)]
    assert rows(dedup.unique_rows(df).select("doc_id"), "doc_id") == [(1,), (2,), (4,), (5,)]
    assert rows(dedup.duplicate_rows(df).select("doc_id", "duplicate_of"), "doc_id") == [(3, 1)]
    assert dedup.mark_duplicates(df, None).where("is_duplicate").count() == 2
    assert dedup.mark_duplicates(df.limit(0)).count() == 0


def test_store(spark):
    s = dedup.FingerprintStore.load(spark, ["f1", ("f2", "d2")])
    df = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "fingerprint string")
    assert rows(s.doc_ids(df), "fingerprint") == [("f1", ""), ("f2", "d2"), ("f3", None)]
    assert rows(s.known(df), "fingerprint") == [("f1",), ("f2",)]
    s = s.register(spark.createDataFrame([("f2", "new"), ("f4", "d4")], "fingerprint string, doc_id string")).remove(spark.createDataFrame([("f1",)], "fingerprint string"))
    assert rows(s.rows, "fingerprint") == [("f2", "new"), ("f4", "d4")]
    assert s.count() == 2


def test_triage(spark):
    df = spark.createDataFrame([(1, "a", "0.3"), (2, "a", "0.9"), (3, "", "0.9"), (4, "b", "high"), (5, "c", None)], "doc_id int, text string, confidence string")
    q = triage.QualityValidator(RuleValidator().required("text"), 0.7)
    report = q.report(df, dedup_field="text")
    out = {r["doc_id"]: (r["pass"], r["needs_recheck"], r["recheck_reason"].split(" ")[0]) for r in report.collect()}
    assert out == {1: (True, True, "low"), 2: (False, False, "duplicate"), 3: (False, False, "rules"), 4: (True, False, ""), 5: (True, False, "")}
    assert tuple(q.summary(report).first()) == (5, 3, 2, 1, 60.0)
    assert q.recheck_queue(report).count() == 1
    assert q.error_archive(report).count() == 3
    assert tuple(q.summary(q.report(df.limit(0), dedup_field="text")).first()) == (0, 0, 0, 0, 0.0)


def test_offline_extractor(spark):
    text = "A title\nwrites to a@b.org and 13812345678 about Python"
    out = extraction.OfflineExtractor().extract(spark.createDataFrame([(1, text), (2, None), (3, "x" * 300)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert (out[0]["title"], out[0]["keywords"], [tuple(e) for e in out[0]["entities"]]) == ("A title", ["Python"], [("a@b.org", "email"), ("13812345678", "phone")])
    assert out[0]["word_count"] == len(text)
    assert out[1]["word_count"] == 0 and out[1]["keywords"] == ["文档"]
    assert out[2]["summary"] == "x" * 200 + "..." and out[2]["title"] == "文档标题（Mock）"


class Flaky:
    def __init__(self, *errors):
        self.errors = list(errors)

    def chat(self, messages):
        if self.errors:
            raise self.errors.pop(0)
        return "ok"


def test_retries():
    waits = []
    assert extraction.chat_with_retry(Flaky(ValueError(), extraction.RateLimitError()), [], 3, 5, waits.append) == "ok"
    assert waits == [5, 10]
    with pytest.raises(extraction.AuthError):
        extraction.chat_with_retry(Flaky(extraction.AuthError()), [], 3, 5, waits.append)
    assert [extraction.classify(s) for s in (401, 429, 503, None)] == ["auth", "rate_limit", "server", "other"]
    with pytest.raises(ValueError, match="unknown provider"):
        extraction.client_factory("none")
    assert extraction.client_factory("ECHO") is extraction.EchoClient


def test_model_extraction_skips_copies_and_keeps_errors(spark):
    class Broken:
        def chat(self, messages):
            if "bad" in messages[-1]["content"]:
                raise ValueError("no")
            return '{"n": 1}'

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "x")], "doc_id int, text string")
    out = extraction.extract_with_model(df, Broken, retries=0, interval=0).orderBy("doc_id").collect()
    assert [(r["success"], r["skipped"], r["error"]) for r in out] == [(True, False, None), (False, False, "ValueError: no"), (True, True, None)]
    assert out[0]["data"] == {"n": "1"}
