"""Extraction: a deterministic offline extractor, and a model-client path that only distinct texts take."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import collections as A
from ..functions import json as J
from ..functions import text as S
from ..resilience import HttpClient, RetriesExhausted, StatusError
from ..shipping import ship
from .dedup import mark_duplicates

#: Terms that the offline extractor looks for.
TERMS = ["Python", "Java", "AI", "机器学习", "深度学习", "NLP", "前端", "后端", "本科", "硕士", "博士", "工程师", "经理", "总监", "项目", "产品", "设计", "开发", "测试", "运维", "React", "Vue", "Django", "Spring", "TensorFlow"]
#: Further terms of the wider, case-insensitive variant.
MORE_TERMS = [*TERMS, "PyTorch", "SQL", "MySQL", "MongoDB", "Redis", "Docker", "Kubernetes", "AWS", "Azure", "Linux", "Git", "CI/CD", "Agile"]


@dataclass
class OfflineExtractor:
    """Title, summary, keywords and entities of a text, without a model."""

    terms: list[str] = field(default_factory=lambda: list(TERMS))
    ignore_case: bool = False
    summary_lines: int | None = 10
    summary_chars: int = 200
    keywords: int = 10
    entities: int = 3
    default_title: str = "文档标题（Mock）"
    default_keywords: tuple[str, ...] = ("文档",)

    @classmethod
    def wide(cls) -> OfflineExtractor:
        return cls(list(MORE_TERMS), True, None, 300, 15, 5, "文档标题")

    def columns(self, text: Column) -> list[Column]:
        t = F.coalesce(text, F.lit(""))
        lines = F.split(S.strip(t), "\n", -1)
        first = F.element_at(lines, 1)
        title = F.when(F.length(first) < 100, S.strip(first)).otherwise(F.lit(""))
        base = t if self.summary_lines is None else F.array_join(F.slice(lines, 1, self.summary_lines), " ")
        found = A.head(A.tags(t, self.terms, self.ignore_case), self.keywords)
        named = lambda xs, kind: F.transform(A.head(xs, self.entities), lambda x: F.struct(x.alias("name"), F.lit(kind).alias("type")))
        return [
            F.when(title != "", title).otherwise(F.lit(self.default_title)).alias("title"),
            F.concat(F.substring(base, 1, self.summary_chars), F.when(F.length(t) > self.summary_chars, F.lit("...")).otherwise(F.lit(""))).alias("summary"),
            F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, self.default_keywords))).alias("keywords"),
            F.concat(named(A.emails(t), "email"), named(A.phones(t), "phone")).alias("entities"),
            F.length(t).cast("long").alias("word_count"),
            F.md5(t).alias("content_md5"),
        ]

    def extract(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        return df.select(*keep, *self.columns(F.col(text)))


class ChatClient(Protocol):
    """What a provider's client must have. Clients are made on executors, one for each task."""

    def chat(self, messages: list[dict[str, str]]) -> str: ...


class AuthError(Exception):
    """Not retried."""


class RateLimitError(Exception):
    """Retried after a wait that doubles."""


def classify(status: int | None) -> str:
    """The class of an error by its status code."""
    return {401: "auth", 403: "auth", 429: "rate_limit"}.get(status or 0, "server" if status and status >= 500 else "other")


def chat_with_retry(client: ChatClient, messages: list[dict[str, str]], retries: int = 3, interval: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """``retries`` + 1 attempts; fixed waits, doubling ones under rate limits, none after an authentication error."""
    for attempt in range(retries + 1):
        try:
            return client.chat(messages)
        except AuthError:
            raise
        except Exception as e:
            if attempt == retries:
                raise
            sleep(interval * 2**attempt if isinstance(e, RateLimitError) else interval)
    raise AssertionError


class EchoClient:
    """A deterministic stand-in: replies with a fenced JSON object about the last message."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        import hashlib
        import json

        text = messages[-1]["content"]
        return "```json\n" + json.dumps({"summary": text[:40], "length": len(text), "md5": hashlib.md5(text.encode()).hexdigest()}, ensure_ascii=False) + "\n```"


#: Providers with their default models, the roots of their addresses, and sampling parameters.
PROVIDERS: dict[str, dict] = {
    "openai": {"model": "gpt-4o", "base": "https://api.openai.com/v1"},
    "qwen": {"model": "qwen-plus", "base": "https://dashscope.aliyuncs.com/compatible-mode/v1"},
    "zhipu": {"model": "glm-4-flash", "base": "https://open.bigmodel.cn/api/paas/v4"},
}
SAMPLING = {"temperature": 0.1, "top_p": 0.9, "max_tokens": 4096}


class HttpChatClient:
    """A provider's chat completions over HTTP. ``chat_with_retry`` does the retries, so ``http`` makes one attempt only."""

    def __init__(self, provider: str, key: str, base: str = "", model: str = "", http: HttpClient | None = None, **sampling):
        if not key:
            raise AuthError(f"{provider}: no key")
        known = PROVIDERS[provider]
        self.key, self.base, self.model = key, (base or known["base"]).rstrip("/"), model or known["model"]
        self.http, self.sampling = http or HttpClient(retries=0), SAMPLING | sampling

    def chat(self, messages: list[dict[str, str]]) -> str:
        try:
            got = self.http.post_json(f"{self.base}/chat/completions", {"model": self.model, "messages": messages, **self.sampling}, {"Authorization": f"Bearer {self.key}"})
        except (StatusError, RetriesExhausted) as e:
            status = getattr(e if isinstance(e, StatusError) else e.__cause__, "status", None)
            raise {"auth": AuthError, "rate_limit": RateLimitError}.get(classify(status), RuntimeError)(str(e)) from e
        return got["choices"][0]["message"]["content"] or ""


def _configured(provider: str) -> Callable[[], ChatClient]:
    """Makes a client from the settings of the environment it is made in."""

    def make() -> ChatClient:
        c = Config.load()
        return HttpChatClient(provider, c.llm_api_key, c.llm_api_base, c.llm_model)

    return make


_factories: dict[str, Callable[[], ChatClient]] = {"echo": EchoClient} | {p: _configured(p) for p in PROVIDERS}


def register_client(name: str, make: Callable[[], ChatClient]) -> None:
    _factories[name.lower()] = make


def client_factory(name: str) -> Callable[[], ChatClient]:
    """Of a registered provider, whatever its case."""
    if name.lower() not in _factories:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(_factories)}")
    return _factories[name.lower()]


PROMPTS = {
    "default": ("You extract facts from documents and answer in JSON.", "List the entities (name, type, attributes) and a short summary of the text below as one JSON object. Use null where the text says nothing.\n\n{text}"),
    "key_value": ("You extract facts from documents and answer in JSON.", "Return every field and value that the text below states, as one flat JSON object.\n\n{text}"),
}


def register_prompt(name: str, system: str, template: str) -> None:
    PROMPTS[name] = (system, template)


def prompt(name: str | None) -> tuple[str, str]:
    """(system, template); unknown names give the default."""
    return PROMPTS.get(name or "default", PROMPTS["default"])


REPLY = "reply string, error string"


def extract_with_model(df: DataFrame, make: Callable[[], ChatClient], prompt_name: str = "default", text: str = "text", order: str = "doc_id", dedup: bool = True, retries: int = 3, interval: float = 5.0) -> DataFrame:
    """order, success, data (map), raw_response, error, content_md5, skipped, skip_reason.

    Of equal texts only the first (by ``order``) is sent to the model. An error is a row, not a failed task."""
    ship(df.sparkSession)
    system, template = prompt(prompt_name)
    own = df.select(order, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = mark_duplicates(own, "_text", order) if dedup else own.select("*", F.md5("_text").alias("fingerprint"), F.lit(False).alias("is_duplicate"))

    @F.pandas_udf(REPLY)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for texts in batches:
            out = []
            for t in texts:
                try:
                    out.append((chat_with_retry(client, ([{"role": "system", "content": system}] if system.strip() else []) + [{"role": "user", "content": t}], retries, interval), None))
                except Exception as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["reply", "error"])

    sent = own.where(~F.col("is_duplicate")).withColumn("_r", ask.asNondeterministic()(S.render_prompt(template, F.col("_text"))))
    parsed = J.parse_object(J.extract_json(F.col("_r.reply")))
    none = F.lit(None)
    done = sent.select(order, F.col("_r.error").isNull().alias("success"), F.when(F.col("_r.error").isNull(), parsed).alias("data"), F.col("_r.reply").alias("raw_response"), F.col("_r.error").alias("error"), F.col("fingerprint").alias("content_md5"), F.lit(False).alias("skipped"), none.cast("string").alias("skip_reason"))
    if not dedup:
        return done
    skipped = own.where("is_duplicate").select(order, F.lit(True).alias("success"), none.cast("map<string,string>").alias("data"), none.cast("string").alias("raw_response"), none.cast("string").alias("error"), F.col("fingerprint").alias("content_md5"), F.lit(True).alias("skipped"), F.lit("duplicate_content").alias("skip_reason"))
    return done.unionByName(skipped)


def accounting(results: DataFrame) -> DataFrame:
    return results.groupBy("success", "skipped").agg(F.count(F.lit(1)).alias("n"))
