"""Queries on merging by keys of falling strictness: the supplied orders as findings with internal server errors among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from findloom import schema
from findloom.operators import tiers
from findloom.operators.context import with_context
from findloom.plans.pipeline import with_fingerprints
from findloom.plans.tables import spread, table
from findloom.shared import cut

TIER_ORDERS = """
SELECT o_orderkey AS k, o_orderkey % 4 AS kind, CAST(floor(o_orderkey / 4) AS BIGINT) % 2 AS p, CAST(floor(o_orderkey / 8) AS BIGINT) % 3 AS q, concat('h', o_custkey % 500, '.example.com') AS host,
  CASE o_orderkey % 3 WHEN 0 THEN 'zap' WHEN 1 THEN 'nuclei' ELSE 'wapiti' END AS scanner,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity
FROM orders
"""


def tier_findings(spark, d):
    """Kinds 1 and 3 are internal server errors of two methods, 0 and 2 injections and listings."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    kind = F.col("kind")
    name = F.when(kind == 0, "SQL Injection in login").when(kind == 2, "Directory listing enabled").otherwise("Internal Server Error")
    meta = F.struct("scanner", F.when(kind == 3, "POST").otherwise("GET").alias("method"), F.concat(F.lit("q"), F.col("q").cast("string")).alias("parameter"))
    asset = F.concat(F.lit("https://"), "host", F.lit("/app/"), F.col("p").cast("string"))
    rows = spread(spark.sql(TIER_ORDERS), "k").select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("finding_id"), F.col("k").alias("ord"), name.alias("vulnerability_name"), "severity", asset.alias("asset_id"), F.lit("seen").alias("description"), F.lit("fix").alias("remediation"), meta.alias("meta"))
    return schema.conform(rows)


def finding_tiers(spark, d):
    # keys of names and targets are the same in both ways of merging
    rows = cut(tiers.server_error_key(with_context(with_fingerprints(tier_findings(spark, d)))).drop("ctx"))
    merged = [tiers.merge_tiers(rows, wide).withColumn("wide", F.lit(wide)) for wide in (False, True)]
    return merged[0].unionByName(merged[1]).select("wide", "ord", "match_level", "merge_confidence", "duplicate_count", "severity", F.array_join(F.array_sort("found_by"), ",").alias("found_by"))


_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"
FINDING_TIERS = f"""
WITH o AS (SELECT * FROM ({TIER_ORDERS})), modes AS (SELECT unnest([false, true]) AS wide),
firsts AS (SELECT host, p, arg_min(kind, k) AS first_kind FROM o WHERE kind IN (1, 3) GROUP BY 1, 2),
g AS (SELECT o.*, wide, CASE
    WHEN kind IN (0, 2) THEN kind || host || CASE WHEN wide THEN '' ELSE '/' || p END
    WHEN kind = first_kind THEN 'first' || host || p ELSE 'other' || host || p || kind || q END AS grp
  FROM o LEFT JOIN firsts USING (host, p), modes),
s AS (SELECT wide, grp, min(k) AS ord, count(*) AS n, count(DISTINCT p) AS ps, count(DISTINCT (p, q)) AS qs, arg_max(severity, {_RANK} * 1000000000000 - k) AS severity, string_agg(DISTINCT scanner, ',' ORDER BY scanner) AS found_by FROM g GROUP BY 1, 2)
SELECT wide, ord, CASE WHEN n = 1 THEN 'single' WHEN ps > 1 THEN 'host_only' WHEN qs > 1 THEN 'general' ELSE 'strict' END AS match_level,
  CASE WHEN n = 1 THEN 1.0 WHEN ps > 1 THEN 0.6 WHEN qs > 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS merge_confidence, n AS duplicate_count, severity, found_by FROM s
"""

QUERIES = {"finding_tiers": (finding_tiers, FINDING_TIERS)}
