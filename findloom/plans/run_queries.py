"""Queries on whole results: what may leave, and runs in the versioned store.

Results are made of the supplied orders, one a customer, as JSON texts that both engines put together
from ``PAYLOADS``; what each query makes of them is written out apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from findloom.operators import contract, correlation_rows
from findloom.plans.finding_queries import ORDERS
from findloom.plans.finding_queries import findings as order_findings
from findloom.plans.tables import spread, table
from findloom.shared import cut, shared_dir
from findloom.sources.store import RunStore, read_results

# A finding as JSON: which forbidden or malformed parts it holds follows from its order's number.
PAYLOADS = """
SELECT o_custkey AS run, o_orderkey AS k, concat('{"vulnerability_name":"v', CAST(o_orderkey AS STRING), '","description":"d"', CASE WHEN o_orderkey % 4 = 0 THEN ',"finding_id":"f","environment":null' ELSE '' END,
  ',"meta":{"scanner":"zap"', CASE WHEN o_orderkey % 3 = 0 THEN ',"kev":true' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN ',"deep":[{"scanners":[]}]' ELSE '' END, '}',
  CASE WHEN o_orderkey % 7 = 0 THEN ',"source_findings":[{"scanner":"z"},{"fp_strict":"x","meta":{"merged":true}},3]' ELSE '' END,
  CASE o_orderkey % 6 WHEN 0 THEN ',"human_triage":{"status":"confirmed","scope":"finding","key":"k","reviewer":" me ","decided_at":"2026-01-01T00:00:00Z","secret":1}' WHEN 1 THEN ',"human_triage":{"status":"nope","scope":"finding","key":"k","reviewer":"me","decided_at":"2026-01-01T00:00:00Z"}' ELSE '' END,
  CASE o_orderkey % 9 WHEN 0 THEN ',"correlation":{"status":"merged","source":"llm","confidence":0.5,"review_candidates":[{"finding_id":"b","confidence":1},{"finding_id":"a","confidence":2}]}' WHEN 1 THEN ',"correlation":{"status":"merged","source":"llm","confidence":true}' ELSE '' END,
  CASE o_orderkey % 8 WHEN 0 THEN ',"ai_analysis_status":"unavailable","ai_summary":{}' WHEN 1 THEN ',"ai_analysis_status":"completed","applicability":{}' ELSE '' END, '}') AS j
FROM orders
"""


def _payloads(spark, d):
    # dealt by run while rows are narrow: texts are made and gathered where they are, in as many tasks as there are parts
    spread(table(spark, d, "orders"), "o_custkey").createOrReplaceTempView("orders")
    # a result's findings are one document, as they are in its file
    found = spark.sql(PAYLOADS).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]), ",").alias("all"))
    text = F.concat(F.lit('{"schema_version":"2.0"'), F.when(F.col("run") % 2 == 0, ',"scan_plan":{"duplicate_analysis":1}').otherwise(""), F.lit(',"all_findings":['), "all", F.lit("]}"))
    return found.select("run", F.parse_json(text).alias("payload"))


def export_violations(spark, d):
    return contract.forbidden_paths(cut(_payloads(spark, d)), "run", deep=True)


_PLACES = "p AS (SELECT run, k, 'all_findings[' || (row_number() OVER (PARTITION BY run ORDER BY k) - 1) || ']' AS spot FROM (SELECT o_custkey AS run, o_orderkey AS k FROM orders))"
EXPORT_VIOLATIONS = f"""
WITH {_PLACES}
SELECT DISTINCT run, 'scan_plan' AS path FROM p WHERE run % 2 = 0
UNION ALL SELECT run, spot || '.' || unnest(['finding_id', 'environment']) FROM p WHERE k % 4 = 0
UNION ALL SELECT run, spot || '.meta.kev' FROM p WHERE k % 3 = 0 UNION ALL SELECT run, spot || '.meta.deep[0].scanners' FROM p WHERE k % 5 = 0
UNION ALL SELECT run, spot || '.source_findings[1].' || unnest(['fp_strict', 'meta.merged']) FROM p WHERE k % 7 = 0
"""


def export_contract(spark, d):
    clean = _payloads(spark, d).select("run", contract.sanitize_result(F.col("payload")).alias("v"))
    # what is said of a whole result is made before its findings are rows, which then don't carry it
    named = clean.select("run", F.array_join(F.array_sort(F.map_keys(F.variant_get("v", "$", "map<string,variant>"))), ",").alias("result_keys"), F.variant_get("v", "$.all_findings", "variant").alias("all"))
    each = named.lateralJoin(spark.tvf.variant_explode(F.col("all").outer()).alias("e"))
    get = lambda path, kind="string": F.try_variant_get("e.value", path, kind)
    keys = lambda path: F.array_join(F.array_sort(F.map_keys(F.try_variant_get("e.value", path, "map<string,variant>"))), ",")
    return each.select(
        "run", F.col("e.pos").alias("pos"), "result_keys", keys("$").alias("keys"), keys("$.meta").alias("meta_keys"), get("$.human_triage.reviewer").alias("reviewer"),
        F.size(F.coalesce(get("$.source_findings", "array<variant>"), F.array().cast("array<variant>"))).alias("sources"), get("$.correlation.review_candidates[0].finding_id").alias("candidate"), get("$.ai_analysis_status").alias("ai"),
    )


EXPORT_CONTRACT = """
SELECT o_custkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, 'all_findings,schema_version' AS result_keys,
  concat_ws(',', CASE WHEN o_orderkey % 8 = 0 THEN 'ai_analysis_status' END, CASE WHEN o_orderkey % 9 = 0 THEN 'correlation' END, 'description', CASE WHEN o_orderkey % 6 = 0 THEN 'human_triage' END, 'meta', CASE WHEN o_orderkey % 7 = 0 THEN 'source_findings' END, 'vulnerability_name') AS keys,
  CASE WHEN o_orderkey % 5 = 0 THEN 'deep,scanner' ELSE 'scanner' END AS meta_keys, CASE WHEN o_orderkey % 6 = 0 THEN 'me' END AS reviewer, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS sources, CASE WHEN o_orderkey % 9 = 0 THEN 'b' END AS candidate,
  CASE WHEN o_orderkey % 8 = 0 THEN 'unavailable' END AS ai
FROM orders
"""

_TIMES = {0: "20260101_000000", 1: "20260201_000000", 2: "20260301_000000"}


def run_store(spark, d):
    """Three runs of one target are published; the current one's baseline is the newest before it, of two versions the later."""
    rows = cut(order_findings(spark, d))
    store = RunStore(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")
    for k, ts in _TIMES.items():
        store.save_run(rows.filter(F.col("ord") % 3 == k), "shop", ts)
    store.save_run(rows.filter("ord % 3 = 1 AND ord % 2 = 0"), "shop", _TIMES[1])
    baseline = store.runs("shop", exclude=store.latest("shop")).first()
    previous = store.read_run("shop", baseline["run_ts"])
    return previous.groupBy("severity", F.col("meta.scanner").alias("scanner")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).withColumns({"run_ts": F.lit(baseline["run_ts"]), "version": F.lit(baseline["version"])})


RUN_STORE = f"SELECT severity, scanner, count(*) AS n, min(k) AS first, '{_TIMES[1]}' AS run_ts, CAST(2 AS BIGINT) AS version FROM ({ORDERS}) WHERE k % 3 = 1 AND k % 2 = 0 GROUP BY 1, 2"


def schema_upgrade(spark, d):
    """Result files of two versions, read in one scan; the older ones say nothing but an address."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    finding = """concat('{"vulnerability_name":"n","asset_id":"https://H', o_custkey % 300, '.example.com/a/', o_orderkey % 3, '?q=1&p=2","mark":', o_orderkey, ',"meta":{"scanner":"zap"', CASE WHEN o_orderkey % 2 = 0 THEN ',"host":"own","parameter":"z"' ELSE '' END, ',"odd":[1]}}')"""
    found = spark.sql(f"SELECT o_custkey % 40 AS part, o_orderkey AS k, {finding} AS j FROM orders").groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: x["j"]), ",").alias("all"))
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    found.select("part", F.concat(F.lit("{"), F.when(F.col("part") % 2 == 0, '"schema_version":"2.0",').otherwise(""), F.lit('"all_findings":['), "all", F.lit("]}")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    rows = read_results(spark, [f"{path}/part=*"])
    m = F.col("meta")
    return rows.groupBy("schema_version", m["host"].alias("host"), m["path"].alias("path"), F.array_join(m["query_keys"], ",").alias("keys"), m["parameter"].alias("parameter")).agg(F.count("*").alias("n"), F.sum(F.variant_get("extra", "$.finding.mark", "long")).alias("marks"), F.count_if(F.variant_get("extra", "$.meta.odd[0]", "long") == 1).alias("odd"))


SCHEMA_UPGRADE = """
WITH o AS (SELECT *, (o_custkey % 40) % 2 = 0 AS fresh FROM orders)
SELECT CASE WHEN fresh THEN '2.0' END AS schema_version, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN NOT fresh THEN 'h' || (o_custkey % 300) || '.example.com' END AS host, CASE WHEN NOT fresh THEN '/a/' || (o_orderkey % 3) END AS path,
  CASE WHEN NOT fresh THEN 'p,q' END AS keys, CASE WHEN o_orderkey % 2 = 0 THEN 'z' END AS parameter, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS marks, count(*) AS odd
FROM o GROUP BY 1, 2, 3, 4, 5
"""

def correlation_report(spark, d):
    """What a decider said of the orders as findings: each relationship once, the first rows of all."""
    table(spark, d, "orders").createOrReplaceTempView("orders")
    name = lambda n: F.concat(F.lit("N"), n.cast("string"))
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    candidate = F.struct(name(cust % 11).alias("vulnerability_name"), F.array(F.lit("ZAP")).alias("scanners"))
    said = F.struct(F.when(k % 3 == 0, "merged").otherwise("needs_review").alias("status"), F.lit("llm").alias("source"), ((k % 9).cast("double") / 8).alias("confidence"), F.array(candidate).alias("review_candidates"))
    rows = table(spark, d, "orders").select(k.alias("ord"), name(cust % 50).alias("vulnerability_name"), F.concat(F.lit("h"), (cust % 20).cast("string")).alias("asset_id"), F.array(F.when(k % 2 == 0, "zap").otherwise("nikto")).alias("found_by"), F.when(k % 3 != 2, said).alias("correlation"))
    return correlation_rows.report_rows(rows)


CORRELATION_REPORT = """
WITH f AS (SELECT o_orderkey AS ord, 'N' || (o_custkey % 50) AS title, 'h' || (o_custkey % 20) AS asset, CASE WHEN o_orderkey % 2 = 0 THEN 'zap' ELSE 'nikto' END AS scanners, CASE WHEN o_orderkey % 3 = 0 THEN 'merged' ELSE 'needs_review' END AS status, o_orderkey % 9 AS conf, 'n' || (o_custkey % 11) || '|zap' AS other
  FROM orders WHERE o_orderkey % 3 <> 2),
g AS (SELECT *, lower(title) || '|' || scanners AS own FROM f),
e AS (SELECT * FROM g WHERE status = 'merged' UNION ALL SELECT * FROM g WHERE status = 'needs_review' QUALIFY row_number() OVER (PARTITION BY least(own, other), greatest(own, other) ORDER BY ord) = 1)
SELECT ord, title, asset, scanners, status, CAST(round_even(conf / 8 * 100, 0) AS INTEGER) AS percent, 1 AS candidates, (SELECT count(*) FROM e) AS total FROM e ORDER BY CASE WHEN status = 'merged' THEN 0 ELSE 1 END, lower(title), lower(asset), scanners, ord LIMIT 10
"""

QUERIES = {"correlation_report": (correlation_report, CORRELATION_REPORT), "export_violations": (export_violations, EXPORT_VIOLATIONS), "export_contract": (export_contract, EXPORT_CONTRACT), "run_store": (run_store, RUN_STORE), "schema_upgrade": (schema_upgrade, SCHEMA_UPGRADE)}
