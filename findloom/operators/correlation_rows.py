"""Rows of a report on what a decider said of findings: each relationship once, the first few in order.

A review names a finding and its candidates, and comes from either side. The set of their labels is its
signature: of equal ones the first finding's stays, by a minimum that combines on the map side. The first
rows are a top-k, which combines there too, so a finding that a third of all reviews name costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.url import none_if_empty

#: Rows that a report shows.
LIMIT = 10


def label(title: Column, scanners: Column) -> Column:
    """What tells a finding in a relationship: its title and scanners, in lower case."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(none_if_empty(title), F.lit("Unknown"))), r"(?U)\s+", " "))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(scanners, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s))), lambda s: s != "")))
    return F.concat(words, F.lit("|"), F.array_join(names, ","))


def entries(findings: DataFrame, order: str = "ord") -> DataFrame:
    """``findings`` with a decision that is to be shown: merged ones all, reviews of one relationship once.

    ``findings`` has vulnerability_name, asset_id, found_by and correlation, as the export contract leaves
    it; ``order`` is a number that tells which comes first.
    """
    c = F.col("correlation")
    shown = findings.filter((c["source"] == "llm") & c["status"].isin("merged", "needs_review"))
    candidates = F.coalesce(F.transform(c["review_candidates"], lambda x: label(x["vulnerability_name"], x["scanners"])), F.array().cast("array<string>"))
    own = label(F.col("vulnerability_name"), F.col("found_by"))
    signature = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(own), candidates))), "\u001f")
    reviews = shown.filter(c["status"] == "needs_review").groupBy(signature.alias("signature")).agg(F.min_by(F.struct(*findings.columns), order).alias("f")).select("f.*")
    return shown.filter(c["status"] == "merged").unionByName(reviews)


def report_rows(findings: DataFrame, limit: int = LIMIT, order: str = "ord") -> DataFrame:
    """The first ``limit`` entries: merged before reviews, then by name, asset and scanners; ``total`` counts all."""
    c = F.col("correlation")
    all_ = entries(findings, order)
    asset = F.coalesce(none_if_empty(F.trim("asset_id")), F.lit("Unknown asset"))
    names = F.array_join(F.coalesce("found_by", F.array().cast("array<string>")), ",")
    rows = all_.select(
        F.when(c["status"] == "merged", 0).otherwise(1).alias("_rank"), F.lower(F.coalesce("vulnerability_name", F.lit(""))).alias("_name"), F.lower(asset).alias("_asset"), order, F.coalesce("vulnerability_name", F.lit("")).alias("title"), asset.alias("asset"), names.alias("scanners"),
        c["status"].alias("status"), F.bround(c["confidence"] * 100).cast("int").alias("percent"), F.size(F.coalesce(c["review_candidates"], F.array().cast(findings.schema["correlation"].dataType["review_candidates"].dataType))).alias("candidates"),
    )
    first = rows.orderBy("_rank", "_name", "_asset", "scanners", order).limit(max(1, limit))
    return first.withColumn("total", all_.agg(F.count("*")).scalar()).drop("_rank", "_name", "_asset")
