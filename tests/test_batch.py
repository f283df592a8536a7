from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from doclathe.config import Config
from doclathe.registry import Plugin, PluginManager
from doclathe.resilience import CircuitBreaker, CircuitOpen, HttpClient, RetriesExhausted, StatusError, waits
from doclathe.streaming import batch


def test_shard_plan(spark):
    out = batch.shard_plan(spark, 25, 10).orderBy("shard_id").collect()
    assert [(r["shard_id"], r["start_index"], r["end_index"]) for r in out] == [("shard_0000", 0, 9), ("shard_0001", 10, 19), ("shard_0002", 20, 24)]
    assert batch.shard_plan(spark, 0, 10).count() == 0


def work(bad):
    return lambda df: df.select("idx", (F.col("idx") != bad).alias("ok"), F.when(F.col("idx") == bad, "broken").alias("error"), (F.col("idx") * 2).alias("y"))


def test_batch_fails_retries_and_resumes(spark, tmp_path):
    items = spark.range(12).withColumnRenamed("id", "idx")
    s = batch.Scheduler(spark, str(tmp_path))
    b = s.create_and_run(items, work(7), 5)
    p = b.summary()
    assert (p["total_shards"], p["completed"], p["failed"], p["processed"], p["failed_items"], p["status"]) == (3, 2, 1, 11, 1, "failed")
    assert b.is_resume() and [r["shard_id"] for r in b.pending().collect()] == ["shard_0001"]
    assert [(r["idx"], r["error"], r["retry"]) for r in batch.retriable(b.items()).collect()] == [(7, "broken", 0)]
    b.retry(items, work(7))
    assert [(r["idx"], r["retry"]) for r in batch.retriable(b.items()).collect()] == [(7, 1)]
    b.retry(items, work(-1))
    assert b.status() == "completed" and b.items().where("status = 'failed'").count() == 0
    assert sorted(r["y"] for r in b.results().collect()) == [2 * i for i in range(12)]


def test_items_that_went_well_are_never_run_again(spark, tmp_path):
    items = spark.range(20).withColumnRenamed("id", "idx")
    told = []
    b = batch.Batch(spark, str(tmp_path), "b", 10, on_shard=lambda r: told.append((r["shard_id"], r["status"])), on_item_failed=lambda r: told.append(r["idx"])).create(20)
    assert b.results() is None
    b.run(items, work(13))
    assert b.results().count() == 19 and sorted(told, key=str) == [("shard_0000", "completed"), ("shard_0001", "failed"), 13]
    for _ in range(2):  # a second run takes up the failed item only
        b.run(items, work(13))
        assert b.results().count() == 19 and b.summary()["processed"] == 19 and b.summary()["failed_items"] == 1

    def killed(df):
        work(-1)(df).write.parquet(f"{b.path}/attempts/torn")  # written, but not named
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        b.run(items, killed)
    assert b.shards().where("status = 'running'").count() == 1 and b.results().count() == 19
    b.run(items, work(-1))
    assert sorted(r["y"] for r in b.results().collect()) == [2 * i for i in range(20)] and b.status() == "completed"


def test_resume_runs_only_what_is_left(spark, tmp_path):
    items = spark.range(20).withColumnRenamed("id", "idx")
    b = batch.Batch(spark, str(tmp_path), "b", 5).create(20)
    b.run(items.where("idx < 10"), work(-1))
    assert [r["shard_id"] for r in b.pending().orderBy("shard_id").collect()] == ["shard_0002", "shard_0003"]
    seen = []

    def counted(df):
        seen.append(sorted(r["idx"] for r in df.collect()))
        return work(-1)(df)

    told = []
    b.on_progress, b.on_failed = told.append, lambda d: told.append(d.count())
    b.run(items, counted)
    assert told[0] == 0 and told[1]["percent"] == 100.0
    assert seen == [list(range(10, 20))] and b.status() == "completed"
    b.cancel()
    assert b.status() == "cancelled"


def test_streaming_form(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    go = lambda: batch.stream_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d.select("path", F.col("content").cast("string").alias("text"))).awaitTermination()
    go()
    (tmp_path / "in/b.txt").write_text("y")
    go()
    assert sorted(r["text"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_breaker():
    now = [0.0]
    b = CircuitBreaker(3, 60, clock=lambda: now[0])

    def fail():
        raise OSError

    for _ in range(3):
        with pytest.raises(OSError):
            b.call(fail)
    with pytest.raises(CircuitOpen):
        b.call(lambda: 1)
    now[0] = 61
    assert b.state == "half_open" and b.call(lambda: 1) == 1 and b.state == "closed"


def test_http():
    assert waits(7) == [1, 3, 5, 10, 30, 60, 120]
    slept = []
    replies = iter([(503, b""), (200, b"body")])
    assert HttpClient(opener=lambda m, u, h, b: next(replies), sleep=slept.append).get("u") == b"body" and slept == [1]
    with pytest.raises(StatusError):
        HttpClient(opener=lambda m, u, h, b: (404, b""), sleep=slept.append).get("u")
    with pytest.raises(RetriesExhausted):
        HttpClient(retries=1, opener=lambda m, u, h, b: (500, b""), sleep=slept.append).get("u")


def test_pages_are_fetched(spark):
    from doclathe.sources.files import parse_files

    def client():
        return HttpClient(0, opener=lambda m, u, h, b: (200, f"<p>{m} {u}</p>".encode()) if "good" in u else (404, b""), sleep=lambda s: None)

    rows = spark.createDataFrame([("https://a/good", None), ("https://a/bad", None), ("b.txt", None), ("https://a/held", bytearray(b"<p>own</p>"))], "path string, content binary")
    got = {r["file_path"]: (r["success"], r["text"], r["error"]) for r in parse_files(rows, http=client).collect()}
    assert got["https://a/good"] == (True, "GET https://a/good", None) and got["https://a/held"][1] == "own"
    assert got["https://a/bad"] == (False, "", "StatusError: HTTP 404") and got["b.txt"][2] == "FileNotFoundError: no such file"


def test_provider_clients():
    from doclathe.operators.extraction import AuthError, HttpChatClient, RateLimitError, chat_with_retry

    sent = []

    def opener(method, url, headers, body):
        sent.append((method, url, headers["Authorization"], json.loads(body)))
        return 200, json.dumps({"choices": [{"message": {"content": "hello"}}]}).encode()

    for provider, model in (("openai", "gpt-4o"), ("qwen", "qwen-plus"), ("zhipu", "glm-4-flash")):
        client = HttpChatClient(provider, "k", http=HttpClient(0, opener=opener), max_tokens=5)
        assert client.chat([{"role": "user", "content": "x"}]) == "hello"
        method, url, key, body = sent[-1]
        assert method == "POST" and url.endswith("/chat/completions") and key == "Bearer k"
        assert body == {"model": model, "messages": [{"role": "user", "content": "x"}], "temperature": 0.1, "top_p": 0.9, "max_tokens": 5}
    with pytest.raises(AuthError):
        HttpChatClient("openai", "")
    for status, error in ((401, AuthError), (429, RateLimitError), (500, RuntimeError)):
        with pytest.raises(error):
            HttpChatClient("qwen", "k", http=HttpClient(0, opener=lambda m, u, h, b: (status, b""))).chat([])  # noqa: B023
    replies, slept = iter([(429, b""), (200, json.dumps({"choices": [{"message": {"content": "late"}}]}).encode())]), []
    client = HttpChatClient("zhipu", "k", "http://own/", http=HttpClient(0, opener=lambda *a: next(replies)))
    assert chat_with_retry(client, [], sleep=slept.append) == "late" and slept == [5.0]


def test_plugins(spark, tmp_path):
    m = PluginManager()
    assert {p.name for p in m.of_kind("prompt")} == {"resume", "contract", "news"}
    m.enable_all(False)
    assert m.of_kind("clean_rule") == [] and m.parser_for_file("a.tsv") is None
    m.enable_all()
    assert m.parser_for_file("a.TSV").name == "csv_table" and m.parser_for_file("a.xyz") is None
    m.enable("html_tag_stripper", False)
    m.save(str(tmp_path / "p.json"))
    n = PluginManager()
    n.restore(str(tmp_path / "p.json"))
    assert not n.get("html_tag_stripper").enabled
    df = spark.createDataFrame([("<b> x  y</b>",)], "a string")
    assert n.clean(df).first()[0] == "<b> x y</b>"
    n.register(Plugin("broken", "clean_rule", lambda d: d.select("absent")))
    assert n.clean(df).count() == 1 and n.get("broken").info()["status"] == "error"
    assert n.load("doclathe.operators.cleaning:whitespace").name == "whitespace_normalizer"
    assert n.list_all(spark).where("status = 'error'").count() == 1
    assert json.loads((tmp_path / "p.json").read_text())["version"] == "1.0"


def test_config():
    c = Config.load({"MAX_RETRIES": "7", "RECHECK_THRESHOLD": "0.5"})
    assert (c.max_retries, c.recheck_threshold, c.max_batch_size) == (7, 0.5, 100)


def test_logs(tmp_path):
    from doclathe.logs import logger

    log = logger("own", str(tmp_path / "logs"))
    log.info("said")
    assert logger("own") is log and len(log.handlers) == 2
    assert "said" in (tmp_path / "logs/own.log").read_text()
