"""What leaves the engine: import rows, sanitized findings, written runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.coerce import lenient_date, stable_hash
from findloom.functions.text import redact

SEVERITY_TITLES = {"critical": "Critical", "high": "High", "medium": "Medium", "low": "Low", "info": "Info"}
#: Fields of the metadata that may be exported.
PUBLIC_META = ("scanner", "host", "port", "scheme", "path", "query_keys", "parameter", "method", "protocol", "raw_id", "plugin_id", "template_id", "category", "service", "technology", "cve_id", "cve_ids", "cwe", "references", "confidence")


def tags(scanners: Column, priority: Column, status: Column) -> Column:
    label = lambda k, v: F.concat(F.lit(f"{k}:"), F.nullif(v, F.lit("")))
    each = F.transform(F.coalesce(scanners, F.array().cast("array<string>")), lambda s: F.concat(F.lit("scanner:"), F.lower(s)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(each, F.array(label("priority", priority), label("status", status))))))


def import_rows(findings: DataFrame, date: Column) -> DataFrame:
    """One row per finding for a generic importer; absent fields are null and left out of JSON."""
    m = F.col("meta")
    cwe = F.regexp_extract(F.coalesce(m["cwe"], F.lit("")), r"([0-9]+)", 1).try_cast("int")
    title = F.coalesce(F.nullif(F.trim("vulnerability_name"), F.lit("")), F.lit("Unnamed vulnerability"))
    level = F.initcap("severity")
    cve = F.coalesce(m["cve_id"], F.get(m["cve_ids"], F.lit(0)))
    where = F.when(F.contains("asset_id", F.lit("://")), F.col("asset_id")).otherwise(F.concat_ws(":", m["host"], m["port"].cast("string")))
    return findings.select(title.alias("title"), level.alias("severity"), "description", F.col("remediation").alias("mitigation"), lenient_date(date).cast("string").alias("date"), cwe.alias("cwe"), cve.alias("cve"), tags(F.col("scanners"), F.col("priority"), F.lit(None).cast("string")).alias("tags"), F.concat(F.lit("fl-"), stable_hash(title, F.col("asset_id"), m["parameter"], m["method"], cve)).alias("unique_id_from_tool"), F.array_join(m["references"], "\n").alias("references"), where.alias("endpoint"))


def sanitize(findings: DataFrame) -> DataFrame:
    """Allowed metadata only, secrets in texts redacted, run-internal columns dropped."""
    keep = F.struct(*[F.col(f"meta.{f}").alias(f) for f in PUBLIC_META])
    return findings.withColumns({"meta": keep, "description": redact(F.col("description")), "remediation": redact(F.col("remediation")), "asset_id": redact(F.col("asset_id"))}).drop("ord", "repeatable")


def write_run(findings: DataFrame, base: str, slug: str, run_ts: str) -> None:
    """Append a run; partitions are the slug and the time, so one target's history is pruned to."""
    findings.withColumns({"target_slug": F.lit(slug), "run_ts": F.lit(run_ts)}).write.mode("append").partitionBy("target_slug", "run_ts").parquet(base)


def write_json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)
