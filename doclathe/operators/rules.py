"""Declarative quality rules: each row gets a list of results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import parsed_float

RESULT = "struct<field:string,level:string,pass:boolean,message:string,rule:string>"
#: Spark types that count as a declared Python type; a boolean is an int, too.
KINDS = {"str": ("string",), "int": ("tinyint", "smallint", "int", "bigint", "boolean"), "float": ("float", "double"), "bool": ("boolean",), "list": ("array",), "dict": ("map", "struct")}


def result(field: Column | str | None, level: str, message: str, rule: str, passed: bool = False) -> Column:
    of = F.lit(field) if field is None or isinstance(field, str) else field
    return F.struct(of.cast("string").alias("field"), F.lit(level).alias("level"), F.lit(passed).alias("pass"), F.lit(message).alias("message"), F.lit(rule).alias("rule"))


@dataclass
class Rule:
    field: str
    name: str
    holds: Callable[[Column, T.DataType], Column]
    message: str
    level: str = "error"


class RuleValidator:
    """Rules by field; fields in the order of their first rule."""

    def __init__(self):
        self.rules: dict[str, list[Rule]] = {}

    def _add(self, rule: Rule) -> RuleValidator:
        self.rules.setdefault(rule.field, []).append(rule)
        return self

    def required(self, field: str) -> RuleValidator:
        """Not null, not the empty text, not the empty list."""

        def holds(c: Column, t: T.DataType) -> Column:
            if isinstance(t, T.StringType):
                return c.isNotNull() & (c != "")
            return c.isNotNull() & (F.size(c) > 0) if isinstance(t, T.ArrayType) else c.isNotNull()

        return self._add(Rule(field, "required", holds, f"field '{field}' must not be empty"))

    def type(self, field: str, expected: type | str) -> RuleValidator:
        """By the column's type; for VARIANT columns by each value's."""
        name = expected.__name__ if isinstance(expected, type) else expected

        def holds(c: Column, t: T.DataType) -> Column:
            if isinstance(t, T.NullType):
                return F.lit(True)
            if isinstance(t, T.VariantType):
                own = F.lower(F.schema_of_variant(c))
                kinds = [*KINDS[name], *(["decimal"] if name == "float" else []), *(["object"] if name == "dict" else [])]
                fits = F.lit(False)
                for k in kinds:
                    fits = fits | F.startswith(own, F.lit(k))
                return c.isNull() | (own == "void") | fits
            return c.isNull() | F.lit(t.simpleString().split("<")[0] in KINDS[name])

        return self._add(Rule(field, "type_check", holds, f"field '{field}' must be of type {name}"))

    def regex(self, field: str, pattern: str, message: str = "") -> RuleValidator:
        """Anchored at the start only."""
        return self._add(Rule(field, "regex", lambda c, t: c.isNull() | F.regexp_like(c.cast("string"), F.lit(f"^(?:{pattern})")), message or f"field '{field}' does not match {pattern}"))

    def length(self, field: str, least: int = 0, most: int | None = None) -> RuleValidator:
        def holds(c: Column, t: T.DataType) -> Column:
            n = F.length(c.cast("string"))
            return c.isNull() | ((n >= least) & (F.lit(True) if most is None else n <= most))

        return self._add(Rule(field, "length", holds, f"field '{field}' must have {least}{'' if most is None else f' to {most}'} characters{' at least' if most is None else ''}"))

    def range(self, field: str, least: float | None = None, most: float | None = None) -> RuleValidator:
        """What is no number fails; NaN passes."""

        def holds(c: Column, t: T.DataType) -> Column:
            x = c.cast("double") if isinstance(t, T.NumericType) else parsed_float(c)
            fits = F.lit(True)
            if least is not None:
                fits = fits & (x >= least)
            if most is not None:
                fits = fits & (x <= most)
            return c.isNull() | F.coalesce(F.isnan(x) & x.isNotNull() | fits & x.isNotNull(), F.lit(False))

        bounds = ", ".join(f"{s} {v}" for s, v in ((">=", least), ("<=", most)) if v is not None)
        return self._add(Rule(field, "range", holds, f"field '{field}' must be {bounds}"))

    def custom(self, field: str, name: str, check: Callable[[Column], Column], message: str = "", level: str = "error") -> RuleValidator:
        """``check`` maps the column to a boolean one (a UDF will do); null is a failure."""
        return self._add(Rule(field, name, lambda c, t: F.coalesce(check(c), F.lit(False)), message or f"rule '{name}' failed", level))

    def failures(self, df: DataFrame, strict: bool = False) -> Column:
        """array<struct>: the failures in order (the first one only if ``strict``); without any, one note of level info."""
        found = []
        for field, rules in self.rules.items():
            there = field in df.columns
            t = df.schema[field].dataType if there else T.NullType()
            c = F.col(f"`{field}`") if there else F.lit(None)
            if isinstance(t, T.NullType):
                c, t = c.cast("string"), T.StringType() if not there else t
            for r in rules:
                ok = F.lit(True) if not there and r.name == "type_check" else r.holds(c, t)
                found.append(F.when(~F.coalesce(ok, F.lit(False)), result(field, r.level, r.message, r.name)))
        bad = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{RESULT}>")
        if strict:
            bad = F.slice(bad, 1, 1)
        return F.when(F.size(bad) > 0, bad).otherwise(F.array(result(None, "info", "all fields passed", "all_pass", True)))

    def validate(self, df: DataFrame, strict: bool = False, name: str = "rule_results") -> DataFrame:
        return df.withColumn(name, self.failures(df, strict))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid rows, invalid rows with their errors)"""
        marked = self.validate(df, name="errors")
        return marked.where(all_valid(F.col("errors"))).drop("errors"), marked.where(~all_valid(F.col("errors")))

    def summary(self) -> dict[str, list[str]]:
        return {k: [r.name for r in rs] for k, rs in self.rules.items()}


def all_valid(results: Column) -> Column:
    """No result of level error; warnings and notes pass."""
    return F.forall(results, lambda r: r["level"] != "error")
