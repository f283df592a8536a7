"""Queries over the driver's tables, and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce as N
from ..functions import collections as A
from ..functions import hashing as H
from ..functions import json as J
from ..functions import text as S
from ..operators import cleaning, dedup, extraction, mapping, triage
from ..operators.rules import RuleValidator
from ..shipping import ship
from ..sources import files, sinks
from ..streaming import batch

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query, with the SQL it must equal."""

    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import coverage  # noqa: F401  registers more

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from . import coverage  # noqa: F401

    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments. Spaces and line ends are the only white space at the ends of these texts.
BLANK = r"[ \t\n\x0B\f\r]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in extraction.TERMS) + "]"
MORE_SQL = "[" + ", ".join(f"'{t}'" for t in extraction.MORE_TERMS) + "]"
EMAIL_SQL = r"'[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_-]+\.[\p{L}\p{M}\p{N}_.-]+'"
PHONE_SQL = r"'1[3-9]\d{9}'"
OFFLINE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, string_split({sql_strip("coalesce(text, '')")}, chr(10)) as ls from documents),
e as (select *, case when length(ls[1]) < 100 then {sql_strip("ls[1]")} else '' end as ti, array_to_string(ls[1:10], ' ') as su, list_filter({TERMS_SQL}, lambda x: contains(t, x))[1:10] as kw,
  regexp_extract_all(t, {EMAIL_SQL})[1:3] as em, regexp_extract_all(t, {PHONE_SQL})[1:3] as ph from d)
select doc_id, case when ti <> '' then ti else '文档标题（Mock）' end as title, su[1:200] || case when length(t) > 200 then '...' else '' end as summary,
  array_to_string(case when len(kw) > 0 then kw else ['文档'] end, '|') as keywords,
  array_to_string(list_concat(list_transform(em, lambda x: 'email:' || x), list_transform(ph, lambda x: 'phone:' || x)), '|') as entities,
  length(t) as word_count, md5(t) as content_md5 from e
"""


def original():
    """The id of the original, -1 for originals themselves."""
    return F.coalesce("existing_id", F.lit(-1)).cast("long").alias("existing_id")


def flat(df: DataFrame) -> DataFrame:
    named = F.array_join(F.transform("entities", lambda e: F.concat(e["type"], F.lit(":"), e["name"])), "|")
    return df.withColumn("keywords", F.array_join("keywords", "|")).withColumn("entities", named)


@query(f"""with x as ({OFFLINE_SQL}), r as (select x.*, d.source, l.quality, row_number() over (partition by content_md5 order by x.doc_id) as n,
  min(x.doc_id) over (partition by content_md5) as f from x join documents d using (doc_id) left join labels l using (doc_id))
select doc_id, source as source_file, title, 'document' as content_type, summary, keywords, entities, word_count, content_md5, coalesce(quality, 1.0)::double as confidence, n > 1 as is_duplicate,
  case when n > 1 then f else -1 end as existing_id, word_count >= 20 and n = 1 as pass, coalesce(quality, 1.0) < 0.6 as needs_recheck from r""")
def pipeline_offline(spark, sf_dir):
    """Extraction, mapping, rules, duplicates and triage of documents in one plan."""
    docs = table(spark, sf_dir, "documents")
    own = flat(extraction.OfflineExtractor().extract(docs, keep=("doc_id", "source")))
    own = own.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id", "left")
    q = triage.QualityValidator(RuleValidator().required("title").range("word_count", 20))
    report = q.report(own, dedup_field="content_md5")
    return report.select("doc_id", F.col("source").alias("source_file"), "title", F.lit("document").alias("content_type"), "summary", "keywords", "entities", "word_count", "content_md5", "confidence", "is_duplicate", original(), "pass", "needs_recheck")


@query(OFFLINE_SQL)
def extract_offline(spark, sf_dir):
    return flat(extraction.OfflineExtractor().extract(table(spark, sf_dir, "documents")))


@query(f"""with d as (select doc_id, coalesce(text, '') as t from documents), e as (select *, list_filter({MORE_SQL}, lambda x: contains(lower(t), lower(x)))[1:15] as kw from d)
select doc_id, t[1:300] || case when length(t) > 300 then '...' else '' end as summary, array_to_string(case when len(kw) > 0 then kw else ['文档'] end, '|') as keywords,
  len(regexp_extract_all(t, {EMAIL_SQL})[1:5]) + len(regexp_extract_all(t, {PHONE_SQL})[1:5]) as n_entities from e""")
def extract_wide(spark, sf_dir):
    own = extraction.OfflineExtractor.wide().extract(table(spark, sf_dir, "documents"))
    return own.select("doc_id", "summary", F.array_join("keywords", "|").alias("keywords"), F.size("entities").cast("long").alias("n_entities"))


@query(f"select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), {EMAIL_SQL}), '|') as emails, array_to_string(regexp_extract_all(coalesce(text, ''), {PHONE_SQL}), '|') as phones from documents")
def extract_contacts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.emails(t), "|").alias("emails"), F.array_join(A.phones(t), "|").alias("phones"))


@query("select doc_id, array_to_string(list_filter(['the', 'la', 'der', 'idiot', 'license', 'de'], lambda x: contains(text, x))[1:4], '|') as tags from documents")
def keyword_tags(spark, sf_dir):
    words = ["the", "la", "der", "idiot", "license", "de"]
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(A.head(A.tags(F.col("text"), words), 4), "|").alias("tags"))


@query(f"select doc_id, len(string_split(text, chr(10))) as total_lines, len(list_filter(string_split(text, chr(10)), lambda x: {sql_strip('x')} <> '')) as non_empty_lines, length(text) as char_count from documents")
def text_line_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.line_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(f"""with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') as ps from documents)
select doc_id, unnest(range(len(ps))) as pos, unnest(ps) as paragraph from p""")
def paragraph_split(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.paragraphs(F.col("text"), "\n")).alias("pos", "paragraph"))
    return own.withColumn("pos", F.col("pos").cast("long"))


@query(f"select doc_id, {sql_strip('''regexp_replace(regexp_replace(replace(replace(text, ' ', ' ' || chr(9) || ' '), chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')} as text from documents")
def whitespace_normalize(spark, sf_dir):
    wide = F.replace(F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\n"), F.lit("\n\n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", S.normalize_whitespace(wide).alias("text"))


@query("select doc_id, case when length(text) > 100 then text[1:100] || '...' else text end as short, lower(text) as low from documents")
def truncate_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text"), 100).alias("short"), S.to_lower(F.col("text")).alias("low"))


@query("select doc_id, nullif(regexp_extract(text, '[A-Z][a-z]+\\.'), '') as first_end, regexp_replace(text, '([a-z]+)ing', '\\1ed', 'g') as past from documents")
def regex_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.regex_extract(F.col("text"), r"[A-Z][a-z]+\.").alias("first_end"), S.regex_replace(F.col("text"), "([a-z]+)ing", r"\1ed").alias("past"))


@query(f"select page_id, {sql_strip('''regexp_replace(html, '<[^>]+>', '', 'g')''')} as text from pages")
def html_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.remove_html_tags(F.col("html")).alias("text"))


@query("select page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') as title from pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.regex_extract(F.col("html"), "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query()
def html_parse(spark, sf_dir):
    """Text, counts and title of whole pages, through the HTML parser."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), F.lit("#.html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    own = files.parse_files(pages, keep=("page_id",))
    return own.select("page_id", "success", "text", F.size("paragraphs").cast("long").alias("paragraphs_count"), F.size("tables").cast("long").alias("tables_count"), F.col("metadata")["title"].alias("title"))


@query("""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(1[3-9]\\d)\\d{4}(\\d{4})', '\\1****\\2', 'g'), '(\\d{6})\\d{8,11}(\\d{4})', '\\1********\\2', 'g'),
  '([\\p{L}\\p{M}\\p{N}_])[\\p{L}\\p{M}\\p{N}_.]*(@[\\p{L}\\p{M}\\p{N}_]+\\.[\\p{L}\\p{M}\\p{N}_]+)', '\\1***\\2', 'g') as text from documents""")
def mask_sensitive(spark, sf_dir):
    return cleaning.clean(table(spark, sf_dir, "documents").select("doc_id", "text"), [cleaning.sensitive])


NAMES = "|".join(cleaning.TRACKING)


@query(f"""with u as (select page_id, url || case when page_id % 3 = 0 then '?utm_source=a&id=' || page_id || '&gclid=x' when page_id % 3 = 1 then '?utm_source=a&utm_term=b' else '?q=1&fbclid=2&r=3' end as url from pages)
select page_id, regexp_replace(regexp_replace(url, '([?&])(?:(?:{NAMES})=[^&#]*(?:&|$))+', '\\1', 'g'), '[?&]$', '') as url from u""")
def strip_tracking_params(spark, sf_dir):
    n = F.col("page_id") % 3
    tail = F.when(n == 0, F.concat(F.lit("?utm_source=a&id="), "page_id", F.lit("&gclid=x"))).when(n == 1, F.lit("?utm_source=a&utm_term=b")).otherwise(F.lit("?q=1&fbclid=2&r=3"))
    return table(spark, sf_dir, "pages").select("page_id", cleaning.without_tracking(F.concat("url", tail)).alias("url"))


@query(f"select page_id, {sql_strip('''regexp_replace(regexp_replace(regexp_replace(html, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g')''')} as html from pages")
def clean_pipeline(spark, sf_dir):
    return cleaning.clean(table(spark, sf_dir, "pages").select("page_id", "html"), [cleaning.whitespace, cleaning.html_tags])


@query("select doc_id, md5(text) as fingerprint from documents")
def content_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))


@query("""select doc_id, md5(text) as fingerprint, row_number() over (partition by md5(text) order by doc_id) > 1 as is_duplicate,
  case when row_number() over (partition by md5(text) order by doc_id) > 1 then first_value(doc_id) over (partition by md5(text) order by doc_id) else -1 end as existing_id from documents""")
def dup_first_wins(spark, sf_dir):
    return dedup.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "is_duplicate", original())


@query("select min(doc_id) as doc_id, md5(text) as fingerprint from documents group by text")
def dedup_unique(spark, sf_dir):
    return dedup.unique_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("select md5(text) as fingerprint, min(doc_id) as \"first\", count(*) as copies from documents group by text having count(*) > 1")
def dup_groups(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))
    return dedup.firsts(own).where("copies > 1")


@query("select count(distinct text) as n from documents")
def fingerprint_count(spark, sf_dir):
    return dedup.fingerprint_count(table(spark, sf_dir, "documents"))


def _store(spark, sf_dir) -> dedup.FingerprintStore:
    seen = table(spark, sf_dir, "documents").where("source in ('src0', 'src1', 'src2')")
    return dedup.FingerprintStore.empty(spark).register(seen.select(H.fingerprint(F.col("text")).alias("fingerprint"), "doc_id"))


SEEN = "select md5(text) as fingerprint, max(doc_id)::varchar as d from documents where source in ('src0', 'src1', 'src2') group by 1"


@query(f"select doc_id, md5(text) as fingerprint from documents where md5(text) not in (select fingerprint from ({SEEN}))")
def seeded_anti_dedup(spark, sf_dir):
    return _store(spark, sf_dir).unknown(table(spark, sf_dir, "documents").select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))).select("doc_id", "fingerprint")


@query(f"select doc_id, md5(text) as fingerprint from documents where md5(text) in (select fingerprint from ({SEEN}))")
def seeded_semi(spark, sf_dir):
    return _store(spark, sf_dir).known(table(spark, sf_dir, "documents").select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))).select("doc_id", "fingerprint")


@query(f"select doc_id, s.d as existing_doc_id from documents left join ({SEEN}) s on s.fingerprint = md5(text)")
def seeded_lookup(spark, sf_dir):
    return _store(spark, sf_dir).doc_ids(table(spark, sf_dir, "documents").select("doc_id", H.fingerprint(F.col("text")).alias("fingerprint"))).select("doc_id", "existing_doc_id")


@query("""with k as (select doc_id, coalesce(quality::varchar, '__empty__' || doc_id) as k from documents left join labels using (doc_id))
select doc_id, doc_id <> min(doc_id) over (partition by k) as is_duplicate, case when doc_id <> min(doc_id) over (partition by k) then min(doc_id) over (partition by k) else -1 end as existing_id from k""")
def dedup_missing_key(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return dedup.mark_duplicates(own, "quality", missing_unique=True).select("doc_id", "is_duplicate", original())


def _rules() -> RuleValidator:
    r = RuleValidator().required("text").type("text", str).regex("lang", "en|fr|de").length("text", 50, 20000).range("n_chars", 100, 10000)
    return r.custom("source", "known_source", lambda c: c.isin("src0", "src1", "src2", "src3"), "source is not known")


@query("""select doc_id, field, rule from (
  select doc_id, 'text' as field, 'required' as rule, text is not null and text <> '' as ok from documents union all
  select doc_id, 'lang', 'regex', lang is null or regexp_matches(lang, '^(en|fr|de)') from documents union all
  select doc_id, 'text', 'length', text is null or length(text) between 50 and 20000 from documents union all
  select doc_id, 'n_chars', 'range', n_chars is null or n_chars between 100 and 10000 from documents union all
  select doc_id, 'source', 'known_source', coalesce(source in ('src0', 'src1', 'src2', 'src3'), false) from documents) where not ok""")
def rule_errors(spark, sf_dir):
    own = _rules().validate(table(spark, sf_dir, "documents")).select("doc_id", F.explode("rule_results").alias("r"))
    return own.where("r.level = 'error'").select("doc_id", "r.field", "r.rule")


VALID = "text is not null and text <> '' and regexp_matches(lang, '^(en|fr|de)') and length(text) between 50 and 20000 and n_chars between 100 and 10000 and source in ('src0', 'src1', 'src2', 'src3')"


@query(f"select doc_id from documents where {VALID}")
def filter_valid(spark, sf_dir):
    return _rules().split(table(spark, sf_dir, "documents"))[0].select("doc_id")


@query(f"select doc_id from documents where not ({VALID})")
def filter_invalid(spark, sf_dir):
    return _rules().split(table(spark, sf_dir, "documents"))[1].select("doc_id")


@query("""select doc_id, case when text is null or text = '' then 'required' when not regexp_matches(lang, '^(en|fr)') then 'regex' else 'all_pass' end as rule from documents""")
def rule_strict(spark, sf_dir):
    r = RuleValidator().required("text").regex("lang", "en|fr")
    return r.validate(table(spark, sf_dir, "documents"), strict=True).select("doc_id", F.col("rule_results")[0]["rule"].alias("rule"))


@query("select o_orderkey, 'range' as rule from orders where not (o_totalprice between 1000 and 400000)")
def rule_range_orders(spark, sf_dir):
    own = RuleValidator().required("o_orderstatus").range("o_totalprice", 1000, 400000).validate(table(spark, sf_dir, "orders"))
    return own.select("o_orderkey", F.explode("rule_results").alias("r")).where("r.level = 'error'").select("o_orderkey", "r.rule")


def _report(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")), "doc_id", "left")
    return triage.QualityValidator(_rules(), 0.6).report(own, dedup_field="text")


REPORT = f"""with j as (select d.*, l.quality as score, row_number() over (partition by text order by doc_id) > 1 as dup from documents d left join labels l using (doc_id)),
r as (select doc_id, coalesce(({VALID}), false) and not dup as pass, dup as is_duplicate, coalesce(score, 1)::double as confidence, coalesce(score, 1) < 0.6 as needs_recheck, ({VALID}) as ok, md5(text) as f from j)"""


@query(f"""{REPORT} select doc_id, pass, is_duplicate, confidence, needs_recheck,
  case when is_duplicate then 'duplicate' when not ok then 'rules' when needs_recheck then 'low' else '' end as reason from r""")
def quality_report(spark, sf_dir):
    kind = F.regexp_extract("recheck_reason", "^(duplicate|rules|low)", 1).alias("reason")
    return _report(spark, sf_dir).select("doc_id", "pass", "is_duplicate", "confidence", "needs_recheck", kind)


@query(f"""{REPORT} select count(*) as total, count(*) filter (where pass) as passed, count(*) filter (where not pass) as failed, count(*) filter (where needs_recheck) as needs_recheck,
  round(100.0::double * count(*) filter (where pass) / count(*), 2) as pass_rate from r""")
def quality_summary(spark, sf_dir):
    return triage.QualityValidator.summary(_report(spark, sf_dir))


@query(f"{REPORT} select doc_id, confidence from r where needs_recheck")
def recheck_queue(spark, sf_dir):
    return triage.QualityValidator.recheck_queue(_report(spark, sf_dir)).select("doc_id", "confidence")


@query(f"{REPORT} select doc_id, pass from r where not pass or needs_recheck")
def error_archive(spark, sf_dir):
    return triage.QualityValidator.error_archive(_report(spark, sf_dir)).select("doc_id", "pass")


def _records(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id") % 4
    title = F.when(n == 0, F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("name")))).when(n == 1, F.to_json(F.struct(F.col("lang").alias("Name"), F.col("n_chars").cast("string").alias("SCORE")))).when(n == 2, F.lit('{"title": null, "name": "unused", "tags": "a, b,,c"}')).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("record"))


@query("""select doc_id, case doc_id % 4 when 0 then source when 1 then lang else '' end as title, 'document' as content_type,
  case when doc_id % 4 = 1 then n_chars::double end as confidence, case when doc_id % 4 = 2 then 'a|b|c' else '' end as keywords from documents""")
def schema_map(spark, sf_dir):
    """Source keys by priority and whatever case; a null under the first key blocks the second."""
    own = mapping.Converter().convert(_records(spark, sf_dir).withColumnRenamed("doc_id", "n"), keep=("n",))
    return own.select(F.col("n").alias("doc_id"), "title", "content_type", "confidence", F.array_join("keywords", "|").alias("keywords"))


@query("""select doc_id, case when doc_id % 5 = 0 then '' else 't' || doc_id end as title, case when doc_id % 5 = 0 then 'model failed' end as error, doc_id::varchar as filled from documents""")
def convert_responses(spark, sf_dir):
    ok = F.col("doc_id") % 5 != 0
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), ok.alias("success"), F.when(ok, F.to_json(F.struct(F.concat(F.lit("t"), "doc_id").alias("title")))).alias("data"), F.when(~ok, F.lit("model failed")).alias("error"), F.col("source").alias("source_file"))
    out = mapping.Converter().convert_response(own)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "title", F.col("_extraction_error").alias("error"), F.col("doc_id").alias("filled"))


@query("""select p_partkey, trunc(p_retailprice)::bigint as as_int, p_retailprice as as_float, 0::bigint as bad_int, -1.0::double as bad_float, p_size::double as number from part""")
def normalize_types(spark, sf_dir):
    price = F.concat(F.lit("  "), F.col("p_retailprice").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", N.to_int(price).alias("as_int"), N.to_float(price).alias("as_float"), N.to_int(F.col("p_name")).alias("bad_int"), N.to_float(F.col("p_brand"), -1.0).alias("bad_float"), N.extract_number(F.concat(F.lit("size "), "p_size", F.lit(" cm"))).alias("number"))


@query("select doc_id, try_cast(nullif(regexp_extract(text, '([-+]?\\d+\\.?\\d*)', 1), '') as double) as number from documents")
def extract_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.extract_number(F.col("text")).alias("number"))


@query("""select p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') as parts, 3::bigint as n from part""")
def to_list_split(spark, sf_dir):
    own = A.to_list(F.replace("p_type", F.lit(" "), F.lit(" ; ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(own, "|").alias("parts"), F.size(A.distinct_list(A.to_list(F.lit("a, b,a ,, c")))).cast("long").alias("n"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') as iso, strftime(o_orderdate, '%Y-%m-%dT00:00:00') as slashed, strftime(o_orderdate, '%Y-%m-%d') as compat from orders""")
def iso_dates(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cn = F.date_format("o_orderdate", "yyyy年M月d日")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.to_iso_datetime(cn).alias("iso"), N.to_iso_datetime(F.replace(day, F.lit("-"), F.lit("/"))).alias("slashed"), N.to_iso_datetime(day, compat=True).alias("compat"))


@query("select event_id, props as recovered, json_extract_string(props, '$.k') as k, md5(props) as whole from events")
def json_recover(spark, sf_dir):
    ship(spark)
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" as asked")))
    own = table(spark, sf_dir, "events").select("event_id", "props", J.extract_json(fenced).alias("recovered"))
    return own.select("event_id", "recovered", J.parse_object(F.col("recovered"))["k"].alias("k"), F.md5("props").alias("whole"))


@query("""select event_id, props as cleaned from events""")
def clean_json(spark, sf_dir):
    messy = F.concat(F.lit("/* note */ "), F.regexp_replace("props", r"\}$", ", }"), F.lit(" // end\n"))
    return table(spark, sf_dir, "events").select("event_id", S.clean_json(messy).alias("cleaned"))


@query("""select conv_id, len(ms) as n, array_to_string(ms, '|') as messages from (select conv_id, list_concat(['system:S'], list(role || ':' || coalesce(text, '') order by turn, role, text), ['user:next']) as ms from conversations group by conv_id)""")
def build_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    history = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.coalesce(x["text"], F.lit("")).alias("content")))
    own = turns.select("conv_id", A.messages(F.lit("S"), F.lit("next"), history).alias("m"))
    return own.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|").alias("messages"))


@query("""select 'shard_' || lpad(i::varchar, 4, '0') as shard_id, i * 64 as start_index, least((i + 1) * 64, n) - 1 as end_index, 'pending' as status
  from (select count(*) as n from documents), lateral (select unnest(range(cast(ceil(n / 64.0) as bigint))) as i)""")
def shard_plan(spark, sf_dir):
    return batch.shard_plan(spark, table(spark, sf_dir, "documents").count(), 64)


@query("""with s as (select doc_id // 64 as s, count(*) filter (where n_chars < 10000) as g, count(*) filter (where n_chars >= 10000) as b from documents group by 1)
select count(*) as total_shards, count(*) filter (where b = 0) as completed, count(*) filter (where b > 0) as failed, 0::bigint as running, 0::bigint as pending, sum(g)::bigint as processed, sum(b)::bigint as failed_items,
  round(100.0::double * count(*) filter (where b = 0) / count(*), 2) as percent, true as done from s""")
def shard_progress(spark, sf_dir):
    """The roll-up of a batch in which long documents fail."""
    ok = F.col("n_chars") < 10000
    own = table(spark, sf_dir, "documents").groupBy(batch.shard_of(F.col("doc_id"), 64).alias("shard_id")).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))
    return batch.progress(own.withColumn("status", F.when(F.col("n_failed") > 0, "failed").otherwise("completed")))


@query("select doc_id as idx, doc_id % 5 as retry from documents where n_chars >= 5000 and doc_id % 5 < 3")
def retry_filter(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 5).alias("retry"), F.when(F.col("n_chars") >= 5000, "failed").otherwise("completed").alias("status"))
    return batch.retriable(own).drop("status")


@query("""with r as (select doc_id, text, row_number() over (partition by text order by doc_id) as n from documents)
select doc_id, true as success, n > 1 as skipped, case when n > 1 then 'duplicate_content' end as skip_reason, case when n = 1 then md5(text) end as model_md5, md5(text) as content_md5 from r""")
def batch_extract_skip(spark, sf_dir):
    """Of equal texts one goes to the (stand-in) model, the others are skipped."""
    extraction.register_prompt("plain", "", "{text}")
    out = extraction.extract_with_model(table(spark, sf_dir, "documents"), extraction.client_factory("echo"), "plain")
    return out.select("doc_id", "success", "skipped", "skip_reason", F.col("data")["md5"].alias("model_md5"), "content_md5")


@query("select doc_id, lang, source from documents")
def jsonl_columns(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return own.select(F.from_json(sinks.jsonl_line(own), own.schema).alias("r")).select("r.*")


@query("select doc_id, regexp_extract(p, '\\.([^.]*)$', 1) as extension, regexp_extract(p, '\\.([^.]*)$', 1) in ('txt', 'html', 'docx', 'pdf') as known from (select doc_id, 'a.b/f' || doc_id || ['.txt', '.html', '.docx', '.xyz'][1 + doc_id % 4] as p from documents)")
def format_dispatch(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".TXT", ".html", ".Docx", ".xyz"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("a.b/f"), "doc_id", ends)
    return table(spark, sf_dir, "documents").select("doc_id", S.file_extension(path).alias("extension"), files.ParserRegistry().can_parse(path).alias("known"))


@query("select doc_id, true as success, length(text) as chars, len(string_split(text, chr(10))) as lines from documents")
def parse_text(spark, sf_dir):
    """Documents as text files through the parser."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
    out = files.parse_files(own, keep=("doc_id",))
    return out.select("doc_id", "success", F.length("text").cast("long").alias("chars"), F.col("metadata")["total_lines"].cast("long").alias("lines"))


@query("select doc_id, 'Read: ' || text || ' / ' || text as prompt from documents")
def render_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.render_prompt("Read: {text} / {text}", F.col("text")).alias("prompt"))
