"""Schema mapping: records with arbitrary keys onto declared output fields."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as N
from ..functions import collections as A
from ..functions import text as S

Transform = Callable[[Column], Column]
SPARK = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "list": "array<string>", "dict": "map<string,string>"}


def normalize_by_type(c: Column, kind: str | type | None) -> Column:
    """A text as a declared type; null stays null, unknown types change nothing."""
    name = kind.__name__ if isinstance(kind, type) else kind
    f: dict[str, Transform] = {"str": S.trim, "int": N.to_int, "float": N.to_float, "bool": lambda x: x != "", "list": listed, "dict": N.to_dict}
    return F.when(c.isNotNull(), f[name](c)) if name in f else c


def listed(c: Column) -> Column:
    """A JSON list as it is, other texts by their separators."""
    asis = F.from_json(F.when(F.startswith(S.strip(c), F.lit("[")), c), "array<string>")
    return F.coalesce(asis, A.to_list(c))


@dataclass
class FieldRule:
    target_key: str
    source_keys: list[str] = field(default_factory=list)
    required: bool = False
    default: object = None
    field_type: str | type = "str"
    validators: list[Transform] = field(default_factory=list)
    normalizers: list[Transform] = field(default_factory=list)
    description: str = ""

    @property
    def type_name(self) -> str:
        return self.field_type.__name__ if isinstance(self.field_type, type) else str(self.field_type)

    @property
    def spark_type(self) -> str:
        return SPARK.get(self.type_name, "string")

    def default_column(self) -> Column:
        if isinstance(self.default, (list, tuple)):
            return F.array(*map(F.lit, self.default)).cast(self.spark_type)
        if isinstance(self.default, dict):
            return F.from_json(F.lit(json.dumps(self.default)), "map<string,string>")
        return F.lit(self.default).cast(self.spark_type)


@dataclass
class OutputSchema:
    name: str
    version: str = "1.0"
    fields: dict[str, FieldRule] = field(default_factory=dict)
    description: str = ""

    def add_field(self, rule: FieldRule) -> OutputSchema:
        self.fields[rule.target_key] = rule
        return self

    def add_fields(self, rules: list[FieldRule]) -> OutputSchema:
        for r in rules:
            self.add_field(r)
        return self

    def field_names(self) -> list[str]:
        return list(self.fields)

    def required_fields(self) -> list[str]:
        return [k for k, r in self.fields.items() if r.required]

    def template(self) -> list[Column]:
        """A row of defaults."""
        return [r.default_column().alias(k) for k, r in self.fields.items()]

    def to_dict(self) -> dict:
        """Without callables."""
        own = [{"target_key": r.target_key, "source_keys": list(r.source_keys), "required": r.required, "default": r.default, "field_type": r.type_name, "description": r.description} for r in self.fields.values()]
        return {"name": self.name, "version": self.version, "description": self.description, "fields": own}

    @classmethod
    def from_dict(cls, d: dict) -> OutputSchema:
        out = cls(d["name"], d.get("version", "1.0"), description=d.get("description", ""))
        return out.add_fields([FieldRule(**f) for f in d.get("fields", [])])


def generic_schema() -> OutputSchema:
    """The ten-field target, source keys by priority."""
    rows = (
        ("doc_id", "doc_id document_id id", True, "", "str"),
        ("source_file", "source_file file_path source", False, "", "str"),
        ("title", "title name 标题", False, "", "str"),
        ("content_type", "content_type type category", False, "document", "str"),
        ("entities", "entities items data", False, [], "list"),
        ("summary", "summary abstract description", False, "", "str"),
        ("keywords", "keywords tags key_words", False, [], "list"),
        ("extraction_time", "extraction_time timestamp created_at", False, "", "str"),
        ("confidence", "confidence score 置信度", False, None, "float"),
        ("raw_text", "raw_text text content 原文", False, "", "str"),
    )
    return OutputSchema("generic").add_fields([FieldRule(t, s.split(), r, d, k) for t, s, r, d, k in rows])


def matched(record: Column, keys: list[str]) -> Column:
    """The value of the first source key that is present, exactly or but for case. A key that is present with null
    blocks the keys after it."""
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        low = F.lit(k.lower())
        alike = F.filter(F.map_keys(record), lambda x: F.lower(x) == low)  # noqa: B023
        out = F.when(F.map_contains_key(record, k), F.try_element_at(record, F.lit(k))).when(F.size(alike) > 0, F.try_element_at(record, F.try_element_at(alike, F.lit(1)))).otherwise(out)
    return out


def empty(c: Column, kind: str) -> Column:
    """Null, the empty text and the empty list; zero and false are values."""
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


class Converter:
    """Compiles a schema to columns over a map of strings (or a JSON text) with arbitrary keys."""

    def __init__(self, schema: OutputSchema | None = None, time_field: str = "extraction_time"):
        self.schema, self.time_field = schema or generic_schema(), time_field

    def columns(self, record: Column, strict: bool = False, now: Column | None = None) -> list[Column]:
        out = []
        for k, r in self.schema.fields.items():
            c = normalize_by_type(matched(record, r.source_keys or [k]), r.field_type)
            for f in r.normalizers:
                c = f(c)
            missing = empty(c, r.spark_type) if r.required else c.isNull()
            default = r.default_column()
            if strict and r.required:
                default = F.raise_error(F.lit(f"required field {k} is missing")).cast(r.spark_type)
            c = F.when(missing, default).otherwise(c)
            if k == self.time_field and now is not None:
                c = F.when(empty(c, "string"), now).otherwise(c)
            out.append(c.alias(k))
        return out

    def warnings(self, record: Column) -> Column:
        """Fields whose values fail one of their own validators; they are kept all the same."""
        found = []
        for k, r in self.schema.fields.items():
            c = normalize_by_type(matched(record, r.source_keys or [k]), r.field_type)
            for v in r.validators:
                found.append(F.when(c.isNotNull() & ~F.coalesce(v(c), F.lit(False)), F.lit(k)))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def convert(self, df: DataFrame, record: str = "record", keep: tuple[str, ...] = (), strict: bool = False, now: Column | None = None) -> DataFrame:
        """One output row for each input row; a JSON text that is no object gives the template and _conversion_error."""
        kind = df.schema[record].dataType.simpleString()
        m = F.col(record) if kind.startswith("map") else F.from_json(F.col(record), "map<string,string>")
        df = df.withColumn("_m", F.coalesce(m, F.create_map().cast("map<string,string>")))
        error = F.when(m.isNull(), F.lit("not a record")).cast("string").alias("_conversion_error")
        extra = [F.col(f"`{c}`") for c in keep if c not in self.schema.fields]
        return df.select(*extra, *self.columns(F.col("_m"), strict, now), error)

    def convert_response(self, df: DataFrame, success: str = "success", data: str = "data", doc_id: str = "doc_id", source_file: str = "source_file", now: Column | None = None) -> DataFrame:
        """Model replies: failures give the template and _extraction_error; data that is no object becomes raw text;
        an empty doc_id or source_file is filled in."""
        ok = F.coalesce(F.col(success), F.lit(False))
        obj = F.when(F.startswith(S.strip(F.col(data)), F.lit("{")), F.from_json(F.col(data), "map<string,string>"))
        m = F.when(ok, F.coalesce(obj, F.create_map(F.lit("raw_text"), F.col(data)))).otherwise(F.create_map().cast("map<string,string>"))
        df = df.withColumn("_m", m)
        cols = []
        for c, k in zip(self.columns(F.col("_m"), now=now), self.schema.fields):
            fill = {"doc_id": doc_id, "source_file": source_file}.get(k)
            cols.append(F.when(empty(c, "string"), F.col(fill).cast("string")).otherwise(c).alias(k) if fill and fill in df.columns else c)
        why = F.coalesce(F.col("error"), F.lit("extraction failed")) if "error" in df.columns else F.lit("extraction failed")
        return df.select(*cols, F.when(~ok, why).alias("_extraction_error"))

    def stats(self, df: DataFrame) -> dict:
        s = self.schema
        return {"schema_name": s.name, "schema_version": s.version, "field_count": len(s.fields), "required_fields": s.required_fields(), "conversion_count": df.count()}
