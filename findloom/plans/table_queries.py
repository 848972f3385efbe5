"""Queries on the star-schema, event and document tables; each applies one operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from findloom import schema
from findloom.functions import coerce, text
from findloom.operators import compare, enrich, resolve, score, summary
from findloom.plans.tables import table

_HALF = "2024-01-16"


def severity_alias(spark, d):
    level = schema.severity(F.regexp_replace(F.lower("o_orderpriority"), r"^[0-9]-(not specified)?", ""))
    return summary.zero_filled(table(spark, d, "orders"), level, list(schema.SEVERITIES))


_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (schema.SEVERITY_ALIASES | {s: s for s in schema.SEVERITIES}).items()) + "}"
SEVERITY_ALIAS = rf"""
WITH l AS (SELECT coalesce(map_extract_value({_ALIAS}, trim(regexp_replace(lower(o_orderpriority), '^[0-9]-(not specified)?', ''))), 'info') AS level FROM orders)
SELECT s.level, count(l.level) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(level) LEFT JOIN l USING (level) GROUP BY 1
"""


def source_counts(spark, d):
    events = table(spark, d, "events")
    per_user = events.groupBy("user_id").agg(F.collect_set("event_type").alias("labels"))
    known = spark.createDataFrame([("never",)], "label string")
    return summary.count_by_label(per_user, "labels", known)


SOURCE_COUNTS = """
SELECT label, count(user_id) AS n FROM (SELECT DISTINCT event_type AS label, user_id FROM events UNION ALL SELECT 'never', NULL) GROUP BY label
"""


def topk_flag(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return summary.flag_top(rows, [F.col("o_orderpriority"), -F.col("o_totalprice"), F.col("o_orderkey")], 25).select("o_orderkey", "selected")


TOPK_FLAG = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) <= 25 AS selected FROM orders"


def exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("duplicate_count"))


EXACT_DEDUP = "SELECT sha256(coalesce(text, '')) AS key, min(doc_id) AS first_id, count(*) AS duplicate_count FROM documents GROUP BY 1"


def merge_unions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), "source", "lang")
    return docs.groupBy("key").agg(F.min("ord").alias("base"), F.array_join(resolve.ordered_union("ord", "source", "lang"), ",").alias("labels"))


MERGE_UNIONS = """
WITH v AS (SELECT sha256(coalesce(text, '')) AS key, doc_id, unnest([struct_pack(i := 0, v := source), struct_pack(i := 1, v := lang)]) AS x FROM documents),
f AS (SELECT key, x.v AS v, min(doc_id * 2 + x.i) AS o FROM v GROUP BY 1, 2)
SELECT f.key, b.base, string_agg(f.v, ',' ORDER BY f.o) AS labels FROM f JOIN (SELECT key, min(doc_id) AS base FROM v GROUP BY 1) b USING (key) GROUP BY 1, 2
"""


def run_diff(spark, d):
    e = table(spark, d, "events")
    side = lambda c: e.filter(c).groupBy("user_id", "event_type").agg(F.bround(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))
    before, after = side(F.col("ts") < _HALF), side(F.col("ts") >= _HALF)
    return compare.diff(after, before, ["user_id", "event_type"], ["n"]).groupBy("status").agg(F.count("*").alias("n"))


RUN_DIFF = f"""
WITH g AS (SELECT user_id, event_type, count(*) FILTER (ts < '{_HALF}') AS p, count(*) FILTER (ts >= '{_HALF}') AS c FROM events GROUP BY 1, 2)
SELECT CASE WHEN p = 0 THEN 'new' WHEN c = 0 THEN 'fixed' WHEN p <> c THEN 'changed' ELSE 'persistent' END AS status, count(*) AS n FROM g GROUP BY 1
"""


def coverage_delta(spark, d):
    e = table(spark, d, "events")
    seen = lambda c: F.coalesce(F.collect_set(F.when(c, F.col("event_type"))), F.array().cast("array<string>"))
    users = e.groupBy("user_id").agg(seen(F.col("ts") >= _HALF).alias("cur"), seen(F.col("ts") < _HALF).alias("prev"))
    c = compare.coverage(F.col("cur"), F.col("prev"))
    return users.select("user_id", *[F.array_join(c[k], ",").alias(k) for k in ("shared", "added", "dropped")], c["mode"].alias("mode"))


COVERAGE_DELTA = f"""
WITH g AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (ts >= '{_HALF}'), []) AS c, coalesce(list(DISTINCT event_type) FILTER (ts < '{_HALF}'), []) AS p FROM events GROUP BY 1),
s AS (SELECT user_id, list_sort(list_intersect(c, p)) AS i, list_sort(list_filter(c, lambda x: NOT list_contains(p, x))) AS a, list_sort(list_filter(p, lambda x: NOT list_contains(c, x))) AS d FROM g)
SELECT user_id, array_to_string(i, ',') AS shared, array_to_string(a, ',') AS added, array_to_string(d, ',') AS dropped,
  CASE WHEN len(a) = 0 AND len(d) = 0 THEN 'full' WHEN len(i) > 0 THEN 'partial' ELSE 'skipped' END AS mode FROM s
"""


def baseline_pick(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    last = enrich.latest_by(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("current"), F.col("o_orderpriority").alias("p"))
    earlier = o.join(last, "o_custkey").filter("o_orderkey <> current").withColumn("mode", F.when(F.col("o_orderpriority") == F.col("p"), "full").otherwise("partial")).withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return compare.pick_baseline(earlier, "o_custkey", "mode", "at").select("o_custkey", "current", F.col("o_orderkey").alias("baseline"), "mode")


BASELINE_PICK = """
WITH l AS (SELECT o_custkey, o_orderkey AS current, o_orderpriority AS p FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, current, o_orderkey AS baseline, CASE WHEN o_orderpriority = p THEN 'full' ELSE 'partial' END AS mode FROM orders JOIN l USING (o_custkey) WHERE o_orderkey <> current
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority = p THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) = 1
"""


def dim_enrich(spark, d):
    li, part, supp = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    out = li.join(part.select("p_partkey", "p_brand"), li.l_partkey == F.col("p_partkey"), "left").join(supp.select("s_suppkey", "s_nationkey"), li.l_suppkey == F.col("s_suppkey"), "left")
    return out.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


DIM_ENRICH = "SELECT p_brand, s_nationkey, count(*) AS n, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS quantity FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"

_RULES = [(100, 0, 5, None, None, "production"), (60, 1, None, "BUILDING", "high", None), (60, 2, None, "MACHINERY", "low", "test"), (10, 3, None, None, "medium", "staging")]


def rule_fill(spark, d):
    rules = spark.createDataFrame(_RULES, "specificity int, ord int, nation int, segment string, asset_criticality string, environment string")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    hit = (F.col("nation").isNull() | (F.col("nation") == F.col("c_nationkey"))) & (F.col("segment").isNull() | (F.col("segment") == F.col("c_mktsegment")))
    return enrich.fill_from_rules(c, rules, "c_custkey", hit, ("asset_criticality", "environment"))


_RULE_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _RULES)
RULE_FILL = f"""
WITH r(specificity, ord, nation, segment, ac, env) AS (VALUES {_RULE_VALUES}),
m AS (SELECT c_custkey, r.* FROM customer JOIN r ON (nation IS NULL OR nation = c_nationkey) AND (segment IS NULL OR segment = c_mktsegment))
SELECT c_custkey, arg_min(ac, -specificity * 100 + ord) FILTER (ac IS NOT NULL) AS asset_criticality, arg_min(env, -specificity * 100 + ord) FILTER (env IS NOT NULL) AS environment FROM m GROUP BY 1
"""

_DECISIONS = [("finding", "1:click", "confirmed", 1), ("finding", "1:click", "false_positive", 2), ("finding", "2:view", "needs_review", 1), ("site_vuln", "1", "not_applicable", 1), ("site_vuln", "3", "confirmed", 4)]


def two_level_lookup(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("exact"), F.col("user_id").cast("string").alias("site"))
    decisions = spark.createDataFrame(_DECISIONS, "scope string, key string, status string, revision int")
    return enrich.two_level_lookup(rows, decisions, "exact", "site").select("event_id", "status")


TWO_LEVEL_LOOKUP = f"""
WITH a(scope, key, status, revision) AS (VALUES {", ".join(map(str, _DECISIONS))}), l AS (SELECT scope, key, arg_max(status, revision) AS status FROM a GROUP BY 1, 2)
SELECT event_id, coalesce(x.status, y.status) AS status FROM events LEFT JOIN l x ON x.scope = 'finding' AND x.key = user_id || ':' || event_type LEFT JOIN l y ON y.scope = 'site_vuln' AND y.key = cast(user_id AS varchar)
"""


def semi_repeat(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    before = e.filter(F.col("ts") < _HALF).select("user_id", "event_type").distinct()
    return e.filter(F.col("ts") >= _HALF).join(before, ["user_id", "event_type"], "left_semi").select("event_id")


SEMI_REPEAT = f"SELECT event_id FROM events e WHERE ts >= '{_HALF}' AND EXISTS (SELECT 1 FROM events p WHERE p.ts < '{_HALF}' AND p.user_id = e.user_id AND p.event_type = e.event_type)"


def score_bands(spark, d):
    li = table(spark, d, "lineitem")
    cvss, epss = F.col("l_quantity") / 5, F.col("l_discount") * 10
    pct = F.col("l_tax") * 12
    points = score.cvss_points(cvss) + score.exploit_points(epss, F.least(pct, F.lit(1.0)), F.col("l_returnflag") == "R")
    total = score.clamp(points + F.when(F.col("l_linestatus") == "O", 16).otherwise(-6), 0, 100)
    return li.select(total.alias("risk_score"), score.priority(total).alias("priority")).groupBy("risk_score", "priority").agg(F.count("*").alias("n"))


_BANDS = "CASE WHEN e >= 0.85 THEN 10 WHEN e >= 0.60 THEN 7 WHEN e >= 0.30 THEN 4 WHEN e >= 0.10 THEN 2 WHEN e >= 0.01 THEN 1 ELSE 0 END"
SCORE_BANDS = f"""
WITH b AS (SELECT cast(round_even(l_quantity / 5 * 6.5, 0) AS integer) AS c, l_discount * 10 AS e, least(l_tax * 12, 1.0) AS q, l_returnflag = 'R' AS k, CASE WHEN l_linestatus = 'O' THEN 16 ELSE -6 END AS x FROM lineitem),
p AS (SELECT c + x + CASE WHEN k THEN greatest(8, least(12, {_BANDS} + y)) ELSE least(12, {_BANDS} + y) END AS s FROM (SELECT *, CASE WHEN q >= 0.98 THEN 2 WHEN q >= 0.90 THEN 1 ELSE 0 END AS y FROM b)),
r AS (SELECT cast(greatest(0, least(100, s)) AS integer) AS risk_score FROM p)
SELECT risk_score, CASE WHEN risk_score >= 85 THEN 'P0' WHEN risk_score >= 65 THEN 'P1' WHEN risk_score >= 45 THEN 'P2' WHEN risk_score >= 25 THEN 'P3' ELSE 'P4' END AS priority, count(*) AS n FROM r GROUP BY 1, 2
"""


def floor_and_cap(spark, d):
    o = table(spark, d, "orders")
    points = (F.floor(F.col("o_totalprice") / 5000)).cast("int")
    signal = F.when(F.col("o_orderstatus") == "F", "weak")
    kev = F.col("o_orderpriority") == "1-URGENT"
    known = F.col("o_orderstatus") == "P"
    floor = F.when(F.col("o_custkey") % 2 == 0, 85).otherwise(70)
    return o.select(score.final_score(points, signal, known, kev, floor).alias("s")).groupBy("s").agg(F.count("*").alias("n"))


FLOOR_AND_CAP = """
WITH p AS (SELECT cast(floor(o_totalprice / 5000) AS integer) AS x, o_orderstatus AS t, o_orderpriority = '1-URGENT' AS kev, CASE WHEN o_custkey % 2 = 0 THEN 85 ELSE 70 END AS f FROM orders),
c AS (SELECT kev, f, CASE WHEN t = 'F' AND NOT kev THEN least(x, 35) ELSE x END AS x FROM p)
SELECT cast(greatest(0, least(100, CASE WHEN kev THEN greatest(x, f) ELSE x END)) AS integer) AS s, count(*) AS n FROM c GROUP BY 1
"""


def upsert_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "n_chars")
    store = docs.filter(F.col("doc_id") % 3 != 0).select("doc_id", "content_hash", F.lit("old").alias("created_at"))
    fresh = docs.filter((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0)).select("doc_id", F.when(F.col("n_chars") % 5 == 0, F.lit("x")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("new").alias("created_at"))
    return summary.upsert(store, fresh, ["doc_id"]).groupBy("action", "created_at").agg(F.count("*").alias("n"))


UPSERT_COUNTS = """
WITH s AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 3 <> 0), i AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)
SELECT CASE WHEN i.doc_id IS NULL THEN 'kept' WHEN s.doc_id IS NULL THEN 'inserted' WHEN s.h = i.h THEN 'skipped' ELSE 'updated' END AS action, CASE WHEN s.doc_id IS NULL THEN 'new' ELSE 'old' END AS created_at, count(*) AS n
FROM s FULL JOIN i ON s.doc_id = i.doc_id GROUP BY 1, 2
"""


def _partitions(spark, d):
    docs = table(spark, d, "documents")
    whole = docs.select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("grp"))
    letters = docs.select(F.col("doc_id").alias("id"), F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]+", ""), 256).alias("grp"))
    return whole, letters


def pair_metrics(spark, d):
    return summary.pair_metrics(*_partitions(spark, d))


def cluster_metrics(spark, d):
    return summary.cluster_metrics(*_partitions(spark, d))


_BOTH = "g AS (SELECT sha256(coalesce(text, '')) AS e, sha256(regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', '', 'g')) AS a FROM documents)"
PAIR_METRICS = f"""
WITH {_BOTH}, t AS (SELECT cast(sum(n * (n - 1) // 2) AS bigint) AS tp FROM (SELECT count(*) AS n FROM g GROUP BY e, a)),
x AS (SELECT cast(sum(n * (n - 1) // 2) AS bigint) AS pe FROM (SELECT count(*) AS n FROM g GROUP BY e)), y AS (SELECT cast(sum(n * (n - 1) // 2) AS bigint) AS pa FROM (SELECT count(*) AS n FROM g GROUP BY a))
SELECT tp, pa - tp AS fp, pe - tp AS fn, CASE WHEN pa > 0 THEN round(tp / pa, 6) ELSE 1.0 END AS precision, CASE WHEN pe > 0 THEN round(tp / pe, 6) ELSE 1.0 END AS recall FROM t, x, y
"""
CLUSTER_METRICS = f"""
WITH {_BOTH}, x AS (SELECT count(*) AS expected_groups, count(*) FILTER (k > 1) AS split_groups FROM (SELECT count(DISTINCT a) AS k FROM g GROUP BY e)),
y AS (SELECT count(*) AS actual_groups, count(*) FILTER (k > 1) AS merged_groups FROM (SELECT count(DISTINCT e) AS k FROM g GROUP BY a))
SELECT *, split_groups = 0 AND merged_groups = 0 AS exact_partition FROM x, y
"""


def confusion(spark, d):
    return summary.confusion(table(spark, d, "labels"), "quality", "toxic")


CONFUSION = "SELECT quality AS expected, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2"


def redact_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("text_sha256"))


def _sql_redaction() -> str:
    out = "text"
    for pattern, into in text.REDACTIONS:
        plain = pattern.replace("'", "''")
        out = f"regexp_replace({out}, '{plain}', '{into.replace('$', chr(92))}', 'g')"
    return out


REDACT_TOKENS = f"SELECT doc_id, sha256({_sql_redaction()}) AS text_sha256 FROM documents"


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k string, v string, page string, ref string").alias("p"), F.json_object_keys("props").alias("keys"))
    return e.select("event_id", F.array_join(F.array_sort("keys"), ",").alias("keys"))


JSON_PROPS = "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events"


def status_histogram(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


STATUS_HISTOGRAM = "SELECT event_type AS status, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1"


def union_all_schema(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return c.unionByName(s, allowMissingColumns=True)


UNION_ALL_SCHEMA = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::varchar AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier"


def cross_plan(spark, d):
    types = table(spark, d, "events").select("event_type").distinct()
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(types))


CROSS_PLAN = "SELECT r_name, event_type FROM region, (SELECT DISTINCT event_type FROM events)"


def validate_rows(spark, d):
    c = table(spark, d, "customer")
    errors = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, F.lit("negative balance")), F.when(~F.col("c_name").rlike("^Customer"), F.lit("odd name")), F.when(F.col("c_nationkey") > 20, F.lit("nation out of range"))))
    return c.select("c_custkey", F.array_join(errors, "; ").alias("errors"), F.size(errors).alias("n"))


VALIDATE_ROWS = """
SELECT c_custkey, array_to_string(e, '; ') AS errors, cast(len(e) AS integer) AS n FROM (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN NOT starts_with(c_name, 'Customer') THEN 'odd name' END, CASE WHEN c_nationkey > 20 THEN 'nation out of range' END], lambda x: x IS NOT NULL) AS e FROM customer)
"""


def coerce_numbers(spark, d):
    raw = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("%")).otherwise(F.lit(" ")))
    return table(spark, d, "lineitem").select(coerce.to_fraction(raw).alias("fraction"), coerce.cvss_severity(coerce.to_float(raw)).alias("level")).groupBy("fraction", "level").agg(F.count("*").alias("n"))


COERCE_NUMBERS = """
WITH v AS (SELECT cast(round(l_discount * 100) AS integer)::double AS x FROM lineitem)
SELECT CASE WHEN x > 1 AND x <= 100 THEN x / 100 ELSE greatest(0.0, least(1.0, x)) END AS fraction, CASE WHEN x >= 9 THEN 'critical' WHEN x >= 7 THEN 'high' WHEN x >= 4 THEN 'medium' WHEN x >= 0.1 THEN 'low' ELSE 'info' END AS level, count(*) AS n FROM v GROUP BY 1, 2
"""


def stable_hashes(spark, d):
    return table(spark, d, "customer").select("c_custkey", coerce.stable_hash(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("key"), coerce.pair_key(F.col("c_name"), F.col("c_mktsegment")).alias("pair"))


STABLE_HASHES = "SELECT c_custkey, substr(sha256(concat_ws('::', c_name, cast(c_nationkey AS varchar), c_mktsegment)), 1, 16) AS key, concat_ws('::', least(c_name, c_mktsegment), greatest(c_name, c_mktsegment)) AS pair FROM customer"


def _cve(key: str):
    """A part's CVE: its number has six digits or more."""
    number = (F.col(key) + 1000).cast("string")
    return F.concat(F.lit("CVE-2024-"), F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0")))


def primary_candidate(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(_cve("l_partkey")).alias("cves"))
    ident = _cve("p_partkey").alias("cve_id")
    part = table(spark, d, "part")
    cvss = part.filter("p_size % 3 <> 0").select(ident, (F.col("p_size") / 5).alias("score"))
    epss = part.filter("p_size % 2 = 0").select(ident, (F.col("p_size") / 50).alias("score"), (F.col("p_size") / 60).alias("percentile"))
    kev = part.filter("p_size = 7").select(ident)
    return enrich.primary_candidate(o, "l_orderkey", "cves", cvss, epss, kev).select("l_orderkey", "cve_id", "kev")


# Of equals the greatest id counts, by its text.
PRIMARY_CANDIDATE = """
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, 'CVE-2024-' || lpad(cast(l_partkey + 1000 AS varchar), greatest(6, length(cast(l_partkey + 1000 AS varchar)))::INTEGER, '0') AS cve_id FROM lineitem)
SELECT l_orderkey, cve_id, coalesce(p_size = 7, false) AS kev FROM l LEFT JOIN part ON l_partkey = p_partkey
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(p_size = 7, false) DESC, CASE WHEN p_size % 3 <> 0 THEN p_size / 5 ELSE -1 END DESC, CASE WHEN p_size % 2 = 0 THEN p_size / 50 ELSE -1 END DESC, CASE WHEN p_size % 2 = 0 THEN p_size / 60 ELSE -1 END DESC, cve_id DESC) = 1
"""

QUERIES = {
    k: (globals()[k], globals()[k.upper()])
    for k in (
        "severity_alias", "source_counts", "topk_flag", "exact_dedup", "merge_unions", "run_diff", "coverage_delta", "baseline_pick", "dim_enrich", "rule_fill", "two_level_lookup", "semi_repeat",
        "score_bands", "floor_and_cap", "upsert_counts", "pair_metrics", "cluster_metrics", "confusion", "redact_tokens", "json_props", "status_histogram", "union_all_schema", "cross_plan", "validate_rows",
        "coerce_numbers", "stable_hashes", "primary_candidate",
    )
}
