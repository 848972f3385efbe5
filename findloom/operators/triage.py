"""Human decisions on findings: stable keys, revisions, and what is stamped on a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import redact
from findloom.schema import TRIAGE_STATUSES

SCOPES = ("finding", "site_vuln")
COMMENT_LENGTH, REVIEWER_LENGTH = 2000, 64


def reattachable(host_only: Column) -> Column:
    """Whether a key names a host: without one it would meet unrelated findings."""
    return F.contains(F.coalesce(host_only, F.lit("")), F.lit("::"))


def annotation_key(strict: Column, general: Column, host_only: Column, scope: str = "finding") -> Column:
    """Key that a decision is kept by; empty where the scope can't be told."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    at_host = reattachable(host_only)
    key = F.when(at_host, host_only) if scope == "site_vuln" else F.when(at_host, general).otherwise(strict)
    return F.coalesce(key, F.lit(""))


def clean(entries: DataFrame) -> DataFrame:
    """Entries with secrets hidden, one-line comments of bounded length and plain reviewer names; unknown states and empty keys go."""
    comment = F.substring(F.trim(F.regexp_replace(redact(F.coalesce("comment", F.lit(""))), r"\s+", " ")), 1, COMMENT_LENGTH)
    name = F.regexp_replace(F.regexp_replace(F.coalesce("reviewer", F.lit("local-user")), r"[^a-zA-Z0-9_.-]+", "-"), r"^-+|-+$", "")
    reviewer = F.substring(F.when(name == "", "local-user").otherwise(name), 1, REVIEWER_LENGTH)
    return entries.filter(F.col("status").isin(*TRIAGE_STATUSES) & F.col("scope").isin(*SCOPES) & (F.coalesce("key", F.lit("")) != "")).withColumns({"comment": comment, "reviewer": reviewer})


def record(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log with new entries, each with the next revision of its key; entries of one key follow in ``ord``."""
    from pyspark.sql import Window

    keys = ["scope", "key"]
    last = log.groupBy(*keys).agg(F.max("revision").alias("_last"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    fresh = clean(entries).join(last, keys, "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + nth)
    return log.unionByName(fresh.select(*log.columns))


def stamp(findings: DataFrame, log: DataFrame) -> DataFrame:
    """``findings`` (with fingerprints) and ``human_triage``: the latest decision on the finding's key, else on its site's."""
    keys = [F.col(f"fp_{k}") for k in ("strict", "general", "host_only")]
    newest = log.groupBy("scope", "key").agg(F.max_by(F.struct("status", "comment", "reviewer", "decided_at", "revision"), "revision").alias("e"))
    side = lambda scope: newest.filter(F.col("scope") == scope).select(F.col("key").alias(f"_{scope}"), F.struct(F.lit(scope).alias("scope"), "e.*").alias(f"_e_{scope}"))
    rows = findings.withColumns({f"_{s}": annotation_key(*keys, s) for s in SCOPES})
    for scope in SCOPES:
        rows = rows.join(side(scope), f"_{scope}", "left")
    return rows.withColumn("human_triage", F.coalesce("_e_finding", "_e_site_vuln")).drop(*[f"_{s}" for s in SCOPES], *[f"_e_{s}" for s in SCOPES])
