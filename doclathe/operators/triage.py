"""Quality reports: rules, duplicates and confidence; what to archive and what to check again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import parsed_float
from .dedup import mark_duplicates
from .rules import RuleValidator, all_valid

THRESHOLD = 0.6


def confidence(df: DataFrame) -> Column:
    """The column confidence if there is one, else score, else 1; what is no number is 1, too."""
    name = next((c for c in ("confidence", "score") if c in df.columns), None)
    if name is None:
        return F.lit(1.0)
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return F.coalesce(F.col(name).cast("double") if numeric else parsed_float(F.col(name)), F.lit(1.0))


class QualityValidator:
    def __init__(self, rules: RuleValidator | None = None, threshold: float = THRESHOLD):
        self.rules, self.threshold = rules or RuleValidator(), threshold

    def report(self, df: DataFrame, dedup: bool = True, dedup_field: str | None = None, order: str = "doc_id") -> DataFrame:
        """Adds pass, rule_results, is_duplicate, fingerprint, existing_id, confidence, needs_recheck, recheck_reason.

        A duplicate's reason replaces that of the rules; low confidence is a reason only if there is no other, and
        doesn't fail the row."""
        if dedup:
            own = self.rules.validate(mark_duplicates(df, dedup_field, order).withColumn("_conf", confidence(df)))
        else:
            own = self.rules.validate(df.withColumn("_conf", confidence(df))).select("*", F.lit(None).cast("string").alias("fingerprint"), F.lit(False).alias("is_duplicate"), F.lit(None).cast(df.schema[order].dataType).alias("existing_id"))
        ok = all_valid(F.col("rule_results"))
        errors = F.array_join(F.transform(F.filter("rule_results", lambda r: r["level"] == "error"), lambda r: r["message"]), "; ")
        low = F.col("_conf") < self.threshold
        reason = (
            F.when(F.col("is_duplicate"), F.concat(F.lit("duplicate content ("), F.substring("fingerprint", 1, 12), F.lit("...)")))
            .when(~ok, F.concat(F.lit("rules failed: "), errors))
            .when(low, F.concat(F.lit("low confidence ("), F.format_string("%.2f", F.col("_conf")), F.lit(f" < {self.threshold})")))
            .otherwise(F.lit(""))
        )
        return own.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("confidence",)], (ok & ~F.col("is_duplicate")).alias("pass"), "rule_results", "fingerprint", "is_duplicate", "existing_id", F.col("_conf").alias("confidence"), low.alias("needs_recheck"), reason.alias("recheck_reason"))

    @staticmethod
    def summary(report: DataFrame) -> DataFrame:
        """total, passed, failed, needs_recheck, pass_rate (percent, two digits; 0 without rows)."""
        n, ok = F.count(F.lit(1)), F.count_if("pass")
        return report.agg(n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"), F.count_if("needs_recheck").alias("needs_recheck"), F.when(n > 0, F.round(100.0 * ok / F.greatest(n, F.lit(1)), 2)).otherwise(F.lit(0.0)).alias("pass_rate"))

    @staticmethod
    def error_archive(report: DataFrame) -> DataFrame:
        return report.where(~F.col("pass") | F.col("needs_recheck"))

    @staticmethod
    def recheck_queue(report: DataFrame) -> DataFrame:
        return report.where("needs_recheck")


def export_archive(archive: DataFrame, path: str, exported_at: str) -> None:
    """Rows as JSON lines under path/records, and one line {exported_at, count} under path/header."""
    archive.write.option("ignoreNullFields", "false").mode("overwrite").json(f"{path}/records")
    archive.agg(F.count(F.lit(1)).alias("count")).select(F.lit(exported_at).alias("exported_at"), "count").coalesce(1).write.mode("overwrite").json(f"{path}/header")
