"""Queries on sites: the supplied events look up the profile of their user's site, and the supplied pages link within theirs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from findloom.functions.site import link_priority, site_link, with_site
from findloom.operators import site_profiles
from findloom.operators.close_names import close_matches
from findloom.plans.tables import table
from findloom.shared import cut

#: Links of a site that are opened first.
QUEUED = 20

# Customers as revisions of the profiles of 100 sites; what is wrong with one follows from its key.
_REVISIONS = """
SELECT c_custkey AS k, concat('https://s', c_custkey % 100, '.example.com/') AS target, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'site' END AS type, CASE WHEN c_custkey % 13 = 0 THEN 'other.org' END AS subject_host, concat('about ', c_custkey) AS description,
  CASE WHEN c_custkey % 7 = 0 THEN 'llm:x' ELSE 'human:me' END AS verified_by, CAST(floor(c_custkey / 100) AS BIGINT) AS nth, c_custkey % 3 AS mode
FROM customer
"""
_DAY = "2024-01-01"


def site_profile_lookup(spark, d):
    """Orders stand for runs against 100 sites on the days of a year; each gets the profile that held then."""
    table(spark, d, "customer").createOrReplaceTempView("customer")
    risk = F.struct(F.lit("high").alias("asset_criticality"), F.when(F.col("mode") == 0, "test").otherwise("production").alias("environment"), F.lit(True).alias("sensitive_data"), F.lit(None).cast("boolean").alias("requires_auth"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason"), F.array(F.lit("e")).alias("evidence_ids"))
    at = F.lit(_DAY).cast("timestamp") + F.make_dt_interval(days=(F.col("nth") * 37 % 360).cast("int"), hours=(F.col("k") % 20).cast("int"))
    made = spark.sql(_REVISIONS).select(
        "target", "type", "subject_host", "description", F.array(F.lit("sells")).alias("business_processes"), F.lit("llm").alias("analysis_source"), F.array(F.lit("s")).alias("sources"), risk.cast(site_profiles.RISK).alias("risk_context"), "verified_by", at.alias("verified_at"),
        F.date_add(F.to_date(at), F.when(F.col("mode") == 1, 10).otherwise(90)).alias("stale_after"), F.when(F.col("k") % 17 == 0, F.repeat(F.lit("0"), F.lit(64))).alias("profile_revision"),
    )
    profiles = cut(made.withColumn("profile_revision", F.coalesce("profile_revision", site_profiles.revision_digest())))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("S"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".EXAMPLE.com:443/x?y")).alias("t"), (F.lit(_DAY).cast("timestamp") + F.make_dt_interval(days=(F.col("o_custkey") % 360).cast("int"), hours=F.lit(12))).alias("at"))
    found = site_profiles.as_of(cut(with_site(runs, F.col("t"), "url")), profiles)
    return found.groupBy("url", F.col("profile.description").alias("description"), F.col("profile.risk_context.environment").alias("environment")).agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


_RISK_SAID = """'{"asset_criticality":"high","environment":"' || CASE WHEN mode = 0 THEN 'test' ELSE 'production' END || '","sensitive_data":true,"confidence":0.5,"reason":"r","evidence_ids":["e"]}'"""
_DIGEST = f"""sha256('{{"analysis_source":"llm","business_processes":["sells"],"description":"' || description || '","risk_context":' || {_RISK_SAID} || ',"sources":["s"],"target":"' || target || '"}}')"""
SITE_PROFILE_LOOKUP = f"""
WITH v AS (SELECT *, k % 100 AS site, TIMESTAMP '{_DAY}' + INTERVAL 1 DAY * (nth * 37 % 360) + INTERVAL 1 HOUR * (k % 20) AS since FROM ({_REVISIONS}) WHERE k % 11 <> 0 AND k % 13 <> 0 AND k % 7 <> 0 AND k % 17 <> 0
  -- of two confirmed at one time the greater revision, the hash of what they say, counts
  QUALIFY row_number() OVER (PARTITION BY site, since ORDER BY {_DIGEST} DESC) = 1),
r AS (SELECT o_orderkey AS k, o_orderkey % 100 AS site, TIMESTAMP '{_DAY}' + INTERVAL 1 DAY * (o_custkey % 360) + INTERVAL 12 HOUR AS at_time FROM orders),
held AS (SELECT r.k, r.site, r.at_time, (SELECT arg_max((v.description, v.mode, v.since), v.since) FROM v WHERE v.site = r.site AND v.since <= r.at_time) AS p FROM r),
fresh AS (SELECT k, site, CASE WHEN CAST(at_time AS DATE) <= CAST(p[3] AS DATE) + CASE WHEN p[2] = 1 THEN 10 ELSE 90 END THEN p END AS p FROM held)
SELECT 'https://s' || site || '.example.com/x' AS url, p[1] AS description, CASE WHEN p IS NULL THEN NULL WHEN p[2] = 0 THEN 'test' ELSE 'production' END AS environment, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM fresh GROUP BY 1, 2, 3
"""


def site_links(spark, d):
    """Of each site of the supplied pages the links to open first."""
    pages = table(spark, d, "pages").select("url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    # a site's menus repeat on its pages: each reference of a page's address is resolved once
    links = with_site(pages.distinct(), F.col("url"), "page").withColumn("link", site_link(F.col("page"), F.col("page"), F.col("href")))
    each = links.filter("link IS NOT NULL").select("site", "link").distinct().withColumn("p", link_priority(F.col("link")))
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy("p"))).filter(F.col("place") <= QUEUED)
    return ranked.select("site", "link", "place", F.col("p.rank").alias("rank"), F.col("p.depth").alias("depth"))


SITE_LINKS = rf"""
WITH p AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
l AS (SELECT DISTINCT host, scheme || '://' || host || regexp_extract(href, '^[^?#]*') AS link, regexp_extract(href, '^[^?#]*') AS path FROM p WHERE href LIKE '/%'),
r AS (SELECT host, link, CASE WHEN regexp_matches(lower(path), 'about|service|product|solution|platform|company|what-we-do|mission') THEN 0 ELSE 1 END AS rank, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS depth FROM l),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY rank, depth, link) AS INTEGER) AS place FROM r)
SELECT trim(regexp_replace(host, '[^a-z0-9]+', '-', 'g'), '-') || '--' || substr(sha256(host), 1, 12) AS site, link, place, rank, depth FROM n WHERE place <= {QUEUED}
"""

def close_part_types(spark, d):
    """Types of parts, each written without one vowel, and what may be meant. SQL has no such share of matching characters."""
    types = table(spark, d, "part").select(F.col("p_type").alias("name"))
    return close_matches(types.select(F.regexp_replace(F.lower("name"), "^([^aeiou]*)[aeiou]", "$1").alias("name")), types)


QUERIES = {"close_part_types": (close_part_types, None), "site_profile_lookup": (site_profile_lookup, SITE_PROFILE_LOOKUP), "site_links": (site_links, SITE_LINKS)}
