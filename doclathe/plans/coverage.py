"""More queries of the catalogue: parsers, plugins, clients, stores and batches, on inputs made from the tables."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..config import Config
from ..functions import coerce as N
from ..functions import collections as A
from ..functions import hashing as H
from ..functions import text as S
from ..operators import cleaning, dedup, extraction, mapping
from ..operators.rules import RuleValidator
from ..registry import Plugin, PluginManager
from ..resilience import CircuitBreaker, HttpClient, waits
from ..shipping import ship
from ..sources import files, sinks
from ..streaming import batch
from .catalogue import query, sql_strip, table


def values(rows: list[tuple], *names: str) -> str:
    """SQL of literal rows."""
    show = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({', '.join(names)})"


def text(c) -> F.Column:
    return F.col(c).cast("string")


@query("select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey, '1' as data_rows, 'key,name,region' as headers from nation")
def csv_columns(spark, sf_dir):
    """CSV files through the parser plugin."""
    reg = files.ParserRegistry()
    reg.register(files.CSV_PLUGIN)
    content = F.concat(F.lit("key,name,region\n"), text("n_nationkey"), F.lit(',"'), "n_name", F.lit('",'), text("n_regionkey"), F.lit("\n"))
    own = table(spark, sf_dir, "nation").select(F.concat(text("n_nationkey"), F.lit(".csv")).alias("path"), F.encode(content, "utf-8").alias("content"))
    row = F.col("tables")[0][1]
    return files.parse_files(own, reg).select(row[0].alias("n_nationkey"), row[1].alias("n_name"), row[2].alias("n_regionkey"), F.col("metadata")["data_rows"].alias("data_rows"), F.col("metadata")["headers"].alias("headers"))


@query("""select doc_id, 'T' || doc_id as title, source as author, 'Hello ' || doc_id || chr(10) || 'k' || chr(10) || doc_id as text, doc_id::varchar as cell,
  'https://x.org/i/' || doc_id || '.png' as src, lang as alt from documents where source is not null and lang is not null""")
def html_meta_tables_images(spark, sf_dir):
    i = text("doc_id")
    page = F.concat(F.lit("<html><head><title>T"), i, F.lit('</title><meta name="author" content="'), "source", F.lit('"></head><body><nav>menu</nav><script>x</script><p>Hello '), i, F.lit("</p><table><tr><th>k</th><td>"), i, F.lit('</td></tr></table><img src="/i/'), i, F.lit('.png" alt="'), "lang", F.lit('"></body></html>'))
    own = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", F.concat(F.lit("https://x.org/p"), i).alias("path"), F.encode(page, "utf-8").alias("content"))
    out = files.parse_files(own, options={"html": {"with_images": True}}, keep=("doc_id",))
    return out.select("doc_id", F.col("metadata")["title"].alias("title"), F.col("metadata")["author"].alias("author"), "text", F.col("tables")[0][0][1].alias("cell"), F.col("images")[0]["src"].alias("src"), F.col("images")[0]["alt"].alias("alt"))


def _docx(rows: list[str], cell: str, title: str) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, rows))}<w:tbl><w:tr><w:tc>{p(cell)}</w:tc></w:tr></w:tbl></w:body></w:document>")
        z.writestr("docProps/core.xml", f'<c:coreProperties xmlns:c="urn:c" xmlns:dc="urn:dc"><dc:title>{title}</dc:title></c:coreProperties>')
    return out.getvalue()


@query("select doc_id, 'a' || doc_id || chr(10) || 'b' as text, doc_id::varchar as cell, 'title ' || doc_id as title from documents")
def docx_parse(spark, sf_dir):
    """Word files made from ids, through the parser."""
    ship(spark)

    @F.pandas_udf("binary")
    def made(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: _docx([f"a{i}", "", "b"], str(i), f"title {i}"))

    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(text("doc_id"), F.lit(".docx")).alias("path"), made("doc_id").alias("content"))
    return files.parse_files(own, keep=("doc_id",)).select("doc_id", "text", F.col("tables")[0][0][0].alias("cell"), F.col("metadata")["title"].alias("title"))


@query("select doc_id, ['é中', '中文', 'é'][1 + doc_id % 3] as text, ['utf-8', 'gbk', 'latin-1'][1 + doc_id % 3] as encoding from documents")
def text_encodings(spark, sf_dir):
    data = F.element_at(F.array(F.unhex(F.lit("C3A9E4B8AD")), F.unhex(F.lit("D6D0CEC4")), F.unhex(F.lit("E9"))), (F.col("doc_id") % 3 + 1).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(text("doc_id"), F.lit(".md")).alias("path"), data.alias("content"))
    return files.parse_files(own, keep=("doc_id",)).select("doc_id", "text", F.col("metadata")["encoding"].alias("encoding"))


PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@query(f"select doc_id || '.txt' as file_path, len({PARAGRAPHS}) as paragraphs_count, 0::bigint as tables_count, length(text)::bigint as text_length, md5(text) as whole, text[1:2000] as start from documents")
def result_summary(spark, sf_dir):
    """Summary, preview and full text of parsed files."""
    own = table(spark, sf_dir, "documents").select(F.concat(text("doc_id"), F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    out = files.parse_files(own)
    a = files.summary(out).select("file_path", "paragraphs_count", "tables_count", F.md5("text").alias("whole"))
    b = files.preview(out).select("file_path", F.col("text_length").cast("long").alias("text_length"), F.col("text").alias("start"))
    full = out.select("file_path", F.md5(files.full_text()).alias("whole"))
    return a.join(b, "file_path").join(full, ["file_path", "whole"])


@query("select doc_id, lang, source from documents")
def json_text_round_trip(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return own.select(F.from_json(sinks.json_text(*own.columns), own.schema).alias("r")).select("r.*")


FIELDS = [("doc_id", True, "str", 3), ("source_file", False, "str", 3), ("title", False, "str", 3), ("content_type", False, "str", 3), ("entities", False, "list", 3), ("summary", False, "str", 3), ("keywords", False, "list", 3), ("extraction_time", False, "str", 3), ("confidence", False, "float", 3), ("raw_text", False, "str", 4)]


@query(values(FIELDS, "field", "required", "kind", "sources"))
def schema_fields(spark, sf_dir):
    """The generic schema as a dict and back."""
    s = mapping.OutputSchema.from_dict(mapping.generic_schema().to_dict())
    rows = [(k, k in s.required_fields(), s.fields[k].type_name, len(s.fields[k].source_keys)) for k in s.field_names()]
    return spark.createDataFrame(rows, "field string, required boolean, kind string, sources int")


@query("select doc_id, upper(lang) as lang, case when length(source) <> 4 then 'source' else '' end as warnings from documents")
def custom_fields(spark, sf_dir):
    """Normalisers and validators of a schema's own fields."""
    s = mapping.OutputSchema("own").add_fields([mapping.FieldRule("doc_id", field_type=int), mapping.FieldRule("lang", ["LANG"], normalizers=[F.upper]), mapping.FieldRule("source", validators=[lambda c: F.length(c) == 4])])
    own = table(spark, sf_dir, "documents").select(F.to_json(F.struct("doc_id", "lang", "source")).alias("record"))
    c = mapping.Converter(s)
    m = F.from_json("record", "map<string,string>")
    return own.select(*c.columns(m)[:2], F.array_join(c.warnings(m), ",").alias("warnings"))


@query("""select p_partkey, p_size::bigint as as_int, p_retailprice as as_float, p_name as as_str, true as as_bool, array_to_string([p_brand, 'x'], '|') as as_list, p_brand as as_dict, false as none, round(p_retailprice / 7, 2) as rounded from part""")
def declared_types(spark, sf_dir):
    by = lambda c, t: mapping.normalize_by_type(c, t)
    own = table(spark, sf_dir, "part")
    return own.select("p_partkey", by(text("p_size"), int).alias("as_int"), by(text("p_retailprice"), "float").alias("as_float"), by(F.concat(F.lit(" "), "p_name", F.lit("\t")), str).alias("as_str"), by(F.col("p_name"), "bool").alias("as_bool"), F.array_join(by(F.to_json(F.array("p_brand", F.lit("x"))), list), "|").alias("as_list"), by(F.to_json(F.struct(F.col("p_brand").alias("b"))), dict)["b"].alias("as_dict"), N.to_bool(F.col("p_size") * 0, "int").alias("none"), N.round2(F.col("p_retailprice") / 7).alias("rounded"))


@query("select doc_id, trim(source) as trimmed, 'a' || chr(10) || chr(10) || 'b c' as collapsed, md5(text) as of_bytes, md5('x') || '|' || md5(lang) as of_list, 'b|' || lang || '|c' as distinct_items from documents where lang not in ('b', 'c')")
def small_functions(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("lang not in ('b', 'c')")
    blank = F.concat(F.lit("a\n \n\n"), F.lit("b   c"))
    return own.select("doc_id", S.trim(F.concat(F.lit(" \t"), "source", F.lit("\n"))).alias("trimmed"), S.collapse_blank_runs(blank).alias("collapsed"), H.fingerprint(F.encode("text", "utf-8"), "binary").alias("of_bytes"), F.array_join(H.fingerprints(F.array(F.lit("x"), "lang")), "|").alias("of_list"), F.array_join(A.distinct_list(F.array(F.lit("b"), "lang", F.lit("b"), F.lit("c"), "lang")), "|").alias("distinct_items"))


@query("select page_id, url || '?b=2&b=3&a=1+x' as url from pages where not contains(url, '?') and not contains(url, '#') and not contains(url, ';')")
def normalize_urls(spark, sf_dir):
    ship(spark)
    plain = table(spark, sf_dir, "pages").where("not contains(url, '?') and not contains(url, '#') and not contains(url, ';')")
    return cleaning.clean(plain.select("page_id", F.concat("url", F.lit("?b=2&utm_source=a&a=1%20x&b=3")).alias("url")), [cleaning.urls])


@query(values([("title", "required,length"), ("n", "range"), ("lang", "regex,known")], "field", "rules"))
def rules_summary(spark, sf_dir):
    r = RuleValidator().required("title").range("n", 1).regex("lang", "en").length("title", 3).custom("lang", "known", lambda c: c.isNotNull())
    return spark.createDataFrame([(k, ",".join(v)) for k, v in r.summary().items()], "field string, rules string")


@query("select count(distinct text) as before, count(distinct text) filter (where lang <> 'en') as after, count(*) filter (where lang <> 'en') as known from documents")
def store_load_remove(spark, sf_dir):
    """A store of pairs of language and text, with the text's fingerprint as doc_id: a text may occur in several languages."""
    own = table(spark, sf_dir, "documents").select("lang", H.fingerprint(F.col("text")).alias("plain"))
    own = own.withColumn("fingerprint", H.record_fingerprint("lang", "plain"))
    store = dedup.FingerprintStore(own.select("fingerprint", F.col("plain").alias("doc_id")).distinct())
    store = store.register(dedup.FingerprintStore.load(spark, ["seed", ("named", "7")]).rows)
    less = store.remove(own.where("lang is null or lang = 'en'").select("fingerprint").union(spark.createDataFrame([("seed",), ("named",)], "fingerprint string")))
    texts = lambda s: dedup.FingerprintStore(s.rows.where("doc_id is not null").select(F.col("doc_id").alias("fingerprint"), "doc_id").distinct())
    return spark.createDataFrame([(texts(store).count() - 1, texts(less).count(), less.known(own).count())], "before long, after long, known long")


@query("select true as success, n > 1 as skipped, count(*) as n from (select row_number() over (partition by text order by doc_id) as n from documents) group by 2")
def extraction_accounting(spark, sf_dir):
    extraction.register_prompt("plain", "", "{text}")
    return extraction.accounting(extraction.extract_with_model(table(spark, sf_dir, "documents"), extraction.client_factory("Echo"), "plain"))


class Flaky:
    """Fails before every reply."""

    def __init__(self):
        self.calls = 0

    def chat(self, messages):
        self.calls += 1
        if self.calls % 2:
            raise extraction.RateLimitError("busy")
        return json.dumps({"n": len(messages[-1]["content"])})


@query("select doc_id, true as success, (length(text) + 6)::varchar as n, null::varchar as error from documents")
def retried_calls(spark, sf_dir):
    extraction.register_prompt("short", "s", "Read: {text}")
    out = extraction.extract_with_model(table(spark, sf_dir, "documents"), Flaky, "short", dedup=False, interval=0.0)
    return out.select("doc_id", "success", F.col("data")["n"].alias("n"), "error")


def _replies(method: str, url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
    """A provider's answer: the model's name and what it was asked."""
    asked = json.loads(body)
    if headers["Authorization"] != "Bearer k":
        return 401, b""
    return 200, json.dumps({"choices": [{"message": {"content": f"{asked['model']} {asked['max_tokens']} {len(asked['messages'][-1]['content'])}"}}]}).encode()


@query("""select n_nationkey, ['gpt-4o', 'qwen-plus', 'glm-4-flash'][1 + n_nationkey % 3] || ' 4096 ' || length(n_name) as reply, case when n_nationkey = 24 then 'AuthError: HTTP 401' end as error from nation where n_nationkey < 24
union all select n_nationkey, null, 'AuthError: HTTP 401' from nation where n_nationkey = 24""")
def provider_replies(spark, sf_dir):
    """The three providers' clients, over an opener that needs no network."""
    extraction.register_prompt("plain", "", "{text}")
    own, out = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text")), None
    for i, p in enumerate(("openai", "qwen", "zhipu", "openai")):
        make = lambda p=p, i=i: extraction.HttpChatClient(p, "k" if i < 3 else "wrong", http=HttpClient(0, opener=_replies))
        part = own.where(f"n_nationkey < 24 and n_nationkey % 3 = {i}" if i < 3 else "n_nationkey = 24")
        got = extraction.extract_with_model(part, make, "plain", order="n_nationkey", dedup=False, retries=0).select("n_nationkey", F.col("raw_response").alias("reply"), "error")
        out = got if out is None else out.unionByName(got)
    return out


@query(values([(s, k) for s, k in ((401, "auth"), (403, "auth"), (404, "other"), (429, "rate_limit"), (500, "server"), (503, "server"))], "status", "kind"))
def error_classes(spark, sf_dir):
    return spark.createDataFrame([(s, extraction.classify(s)) for s in (401, 403, 404, 429, 500, 503)], "status int, kind string")


@query("select doc_id, upper(lang) as lang, 'You read news.' as system, true as asked from documents")
def plugin_rules_and_prompts(spark, sf_dir):
    """A rule of one's own, one that is disabled, one that is broken; a prompt plugin."""
    m = PluginManager(built_in=False)
    m.register(Plugin("upper", "clean_rule", lambda d: cleaning.over_strings(d, F.upper, ["lang"])))
    m.register(Plugin("hidden", "clean_rule", lambda d: cleaning.over_strings(d, F.lower)))
    m.register(Plugin("broken", "clean_rule", lambda d: d.select("absent")))
    m.enable("hidden", False)
    system, template, _ = PluginManager().get("news").body
    out = m.clean(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return out.select("doc_id", "lang", F.lit(system).alias("system"), F.endswith(S.render_prompt(template, F.col("text")), F.col("text")).alias("asked"))


@query(values([("whitespace_normalizer", "clean_rule", "enabled"), ("url_normalizer", "clean_rule", "enabled"), ("html_tag_stripper", "clean_rule", "disabled"), ("sensitive_data_masker", "clean_rule", "enabled"), ("resume", "prompt", "enabled"), ("contract", "prompt", "enabled"), ("csv_table", "doc_parser", "enabled")], "name", "type", "status"))
def plugin_list(spark, sf_dir):
    m = PluginManager()
    m.enable("html_tag_stripper", False)
    m.unregister("news")
    return m.list_all(spark).select("name", "type", "status")


@query("select page_id, url || ' read' as text, 'html' as file_type from pages where starts_with(url, 'http') and not contains(url, '<') and not contains(url, '&')")
def fetched_pages(spark, sf_dir):
    """Pages by their addresses, over an opener that needs no network."""
    ship(spark)

    def client():
        return HttpClient(0, opener=lambda m, u, h, b: (200, f"<html><body><p>{u} read</p></body></html>".encode()))

    own = table(spark, sf_dir, "pages").where("startswith(url, 'http') and not contains(url, '<') and not contains(url, '&')").select("page_id", F.col("url").alias("path"), F.lit(None).cast("binary").alias("content"))
    return files.parse_files(own, keep=("page_id",), http=client).select("page_id", "text", "file_type")


@query("select doc_id, lang || '!' as text, 'shout' as file_type from documents where lang is not null")
def registered_parser(spark, sf_dir):
    reg = files.ParserRegistry()
    reg.register(files.Parser("shout", ("log",), lambda data, path="", **o: {"text": data.decode() + "!", "paragraphs": [], "tables": [], "images": [], "metadata": {}}))
    own = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.concat(text("doc_id"), F.lit(".LOG")).alias("path"), F.encode("lang", "utf-8").alias("content"))
    return files.parse_files(own, reg, keep=("doc_id",)).select("doc_id", "text", "file_type")


@query(values([("csv", "txt"), ("docx", "docx"), ("htm", "html"), ("html", "html"), ("json", "txt"), ("jsonl", "txt"), ("log", "txt"), ("markdown", "txt"), ("md", "txt"), ("pdf", "pdf"), ("txt", "txt")], "extension", "parser"))
def parser_extensions(spark, sf_dir):
    reg = files.ParserRegistry()
    reg.unregister("xhtml")
    own = {e: p["name"] for p in reg.parsers() for e in p["extensions"]}
    return spark.createDataFrame([(e, own[e]) for e in reg.extensions()], "extension string, parser string")


@query(values([(x,) for x in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()], "name"))
def folder_files(spark, sf_dir):
    """A folder as a source, in which a table is a file or a folder of files; names only, so no file is read."""
    own = files.read_files(spark, f"{sf_dir}/*.parquet", recursive=True)
    return own.select(F.regexp_extract("path", r"([^/]+)\.parquet(/|$)", 1).alias("name")).distinct()


@query(values([(i, s) for i, s in enumerate(("closed", "closed", "open", "half_open", "closed"))], "step", "state"))
def breaker_states(spark, sf_dir):
    now, out = [0.0], []
    b = CircuitBreaker(2, 60, clock=lambda: now[0])

    def call(f) -> None:
        try:
            b.call(f)
        except ZeroDivisionError:
            pass
        out.append(b.state)

    out.append(b.state)
    call(lambda: 1 / 0)
    call(lambda: 1 / 0)
    now[0] = 61
    out.append(b.state)
    call(lambda: 1)
    return spark.createDataFrame(list(enumerate(out)), "step int, state string")


@query(values([(0, 1.0), (1, 3.0), (2, 5.0), (3, 10.0), (4, 30.0), (5, 60.0)], "n", "wait").replace("* from", "n, wait::double as wait from"))
def retry_waits(spark, sf_dir):
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(waits(6))], "n int, wait double")


@query(values([("llm_provider", "openai"), ("max_batch_size", "100"), ("max_retries", "7"), ("recheck_threshold", "0.6"), ("retry_interval", "5")], "name", "value"))
def settings(spark, sf_dir):
    c = Config.load({"MAX_RETRIES": "7"})
    return spark.createDataFrame([(k, str(getattr(c, k))) for k in ("llm_provider", "max_batch_size", "max_retries", "recheck_threshold", "retry_interval")], "name string, value string")


@query("""with s as (select 'shard_' || lpad((doc_id // 64)::varchar, 4, '0') as shard_id, count(*) as n, count(*) filter (where n_chars >= 10000 and doc_id % 2 = 0) as bad from documents group by 1)
select shard_id, case when bad > 0 then 'failed' else 'completed' end as status, n - bad as n_ok, bad as n_failed, n - bad as results from s""")
def batch_resume(spark, sf_dir):
    """A batch in which long documents fail; a second run takes up these only, and half of them go well."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/batches"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "n_chars")
    fails = lambda bad: lambda d: d.select("idx", (~bad).alias("ok"), F.when(bad, "too long").alias("error"))
    long = F.col("n_chars") >= 10000
    b = batch.Scheduler(spark, root).create_and_run(docs, fails(long), 64)
    b.run(docs, fails(long & (F.col("idx") % 2 == 0)))
    own = b.results().groupBy(batch.shard_of(F.col("idx"), 64).alias("shard_id")).agg(F.count(F.lit(1)).alias("results"))
    return b.shards().join(own, "shard_id", "left").select("shard_id", "status", "n_ok", "n_failed", F.coalesce("results", F.lit(0)).alias("results"))
