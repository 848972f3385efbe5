import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from findloom.operators import compare, enrich, export, normalize, predicates, resolve, score, summary
from findloom.plans import pipeline
from findloom.sources import reports


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body if isinstance(body, str) else json.dumps(body))
    return str(p)


NMAP_XML = """<nmaprun><host><address addr="10.1.2.3" addrtype="ipv4"/><ports>
<port protocol="tcp" portid="443"><state state="open"/><service name="http" tunnel="ssl" product="nginx"/>
<script id="vulners" output="CVE-2024-1111 9.8 u&#10;CVE-2023-2222 4.3&#10;other"/><script id="title" output="Home"/></port>
<port protocol="tcp" portid="22"><state state="closed"/><service name="ssh"/></port></ports></host></nmaprun>"""


def test_nmap(spark, tmp_path):
    files = reports.whole_files(spark, write(tmp_path, "n.xml", NMAP_XML))
    services = reports.nmap_services(files, F.lit("t")).collect()
    assert [(s.host, s.port, s.web_scheme) for s in services] == [("10.1.2.3", 443, "https")]
    rows = normalize.nmap(reports.nmap_findings(files, F.lit("t"))).collect()
    assert {(r.vulnerability_name, r.severity, r.asset_id) for r in rows} == {("CVE-2024-1111", "critical", "10.1.2.3:443"), ("CVE-2023-2222", "medium", "10.1.2.3:443"), ("title finding on http", "info", "10.1.2.3:443")}


def test_nuclei(spark, tmp_path):
    good = {"template-id": "t1", "matched-at": "http://127.0.0.1:81/a?z=1&b=2", "info": {"name": "Open redirect", "severity": "hi", "reference": ["https://x/CVE-2024-7777"]}}
    path = write(tmp_path, "n.jsonl", json.dumps(good) + "\n\nnot json\n")
    row = normalize.nuclei(reports.json_lines(spark, path, reports.NUCLEI), F.lit("http://127.0.0.1:81"), F.lit("https://o.org")).collect()
    assert len(row) == 1
    assert (row[0].severity, row[0].asset_id, row[0].meta.query_keys, row[0].meta.cve_ids) == ("high", "https://o.org/a?z=1&b=2", ["b", "z"], ["CVE-2024-7777"])


def test_nikto_shapes(spark, tmp_path):
    item = {"msg": "Cookie without httponly flag", "uri": "/x"}
    for body, n in (({"vulnerabilities": [item], "items": [item]}, 2), ({"scans": [{"items": [item]}]}, 1), ([{"vulnerabilities": [item]}, {"items": [item]}], 2)):
        rows = normalize.nikto(reports.nikto_items(reports.whole_files(spark, write(tmp_path, "k.json", body))), F.lit("https://o.org"), F.lit("https://o.org/")).collect()
        assert [(r.asset_id, r.severity) for r in rows] == [("https://o.org/x", "low")] * n


def test_wapiti(spark, tmp_path):
    body = {"vulnerabilities": {"SQL Injection": [{"path": "/q", "level": 4, "parameter": "id", "method": "GET"}]}, "anomalies": {"Internal Server Error": [{"info": "noise"}, {"path": "/e", "info": "http error 500", "method": "GET", "level": 3}]}, "classifications": {"SQL Injection": {"desc": "d", "ref": {"b": "u2", "a": "u1"}}}}
    rows = normalize.wapiti(reports.wapiti_items(reports.whole_files(spark, write(tmp_path, "w.json", body))), F.lit("https://o.org"), F.lit("https://o.org")).collect()
    assert sorted((r.vulnerability_name, r.severity) for r in rows) == [("Internal Server Error", "low"), ("SQL Injection", "critical")]
    assert next(r for r in rows if r.severity == "critical").meta.references == ["u1", "u2"]


def test_zap(spark, tmp_path):
    alert = {"alert": "X", "riskdesc": "Medium (High)", "desc": "<p>d</p>", "cweid": "79", "instances": [{"uri": "https://o.org/a", "method": "POST", "param": "p"}, {"uri": "https://o.org/b"}]}
    for site in ({"@name": "https://o.org", "alerts": [alert]}, [{"@name": "https://o.org", "alerts": [alert]}]):
        row = normalize.zap(reports.zap_alerts(reports.whole_files(spark, write(tmp_path, "z.json", {"site": site}))), F.lit("https://o.org"), F.lit("https://o.org")).first()
        assert (row.severity, row.asset_id, row.meta.cwe, row.meta.parameter, row.description) == ("medium", "https://o.org/a", "CWE-79", "p", "d")


def test_records(spark, tmp_path):
    for body, n in (([{"id": "1"}, {"id": "2"}], 2), ({"records": [{"id": "1"}]}, 1), ({"id": "9"}, 1)):
        assert reports.json_records(reports.whole_files(spark, write(tmp_path, "r.json", body)), "id string").count() == n
    for body, n in (({"CVE-2024-0001": {"score": "9.1"}, "note": {"score": "1"}}, 1), ({"vulnerabilities": [{"cveID": "CVE-2024-0002"}]}, 1), ([{"cve": "CVE-2024-0003"}, {"cve": "x"}], 2), ({"cve": "CVE-2024-0004"}, 1)):
        assert reports.cve_records(reports.whole_files(spark, write(tmp_path, "c.json", body))).count() == n


def test_pipeline_merges_scores_and_sanitizes(spark, tmp_path):
    alert = {"alert": "SQL injection", "riskdesc": "High", "desc": 'leak password = "hunter2hunter2"', "pluginid": "40018", "instances": [{"uri": "https://o.org/a?id=1", "param": "id", "method": "GET"}]}
    files = reports.whole_files(spark, write(tmp_path, "z.json", {"site": {"alerts": [alert, alert]}}))
    out = pipeline.run([normalize.zap(reports.zap_alerts(files), F.lit("https://o.org"), F.lit("https://o.org"))]).collect()
    assert len(out) == 1
    row = out[0]
    assert row.duplicate_count == 2 and row.scanners == ["zap"] and "hunter2" not in row.description
    assert (row.risk_score, row.priority) == (49 + 14 + 6, "P1")
    assert "adapter_mode" not in row.meta


@pytest.mark.parametrize(("cvss", "points"), [(8.8, 57), (10.0, 65), (1.0, 6), (3.0, 20)])
def test_cvss_half_even(spark, cvss, points):
    assert spark.range(1).select(score.cvss_points(F.lit(cvss)).alias("p")).first().p == points


def test_exposure(spark):
    hosts = {"https://a.org/x": True, "10.0.0.1:80": False, "http://172.20.1.1/": False, "172.40.1.1": True, "db.internal": False, "[::1]:80": False, "": False}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", score.internet_exposed(F.col("h")).alias("x"))
    assert {r.h: r.x for r in got.collect()} == hosts


def test_floor_cap_and_evidence(spark):
    f = lambda *a: spark.range(1).select(score.final_score(*[F.lit(x) for x in a]).alias("s")).first().s
    assert f(60, "weak", False, False, 85) == 35 and f(60, "weak", True, False, 85) == 60 and f(40, "weak", False, True, 85) == 85 and f(140, None, False, False, 70) == 100
    e = lambda *a: spark.range(1).select(score.evidence_points(*[F.lit(x) for x in a]).alias("s")).first().s
    assert e(None, True, False, False) == 4 and e("high", True, True, False) == 1 and e("high", True, True, True) == -9


def test_greedy_matching_equals_sequential(spark):
    rng = random.Random(5)
    rows = [(a, b, rng.randint(0, 5)) for a, b in itertools.product(range(8), range(8)) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "a int, b int, s int")
    got = {(r.a, r.b) for r in resolve.match_greedy(df, lambda d: d.cache(), [F.desc("s"), F.asc("a"), F.asc("b")]).collect()}
    used_a, used_b, expected = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            expected.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert got == expected


def test_cluster_needs_every_member(spark):
    rows = spark.createDataFrame([("k", i, s, 4) for i, s in (("a", "x"), ("b", "y"), ("c", "z"))], "bucket string, finding_id string, scanner string, rank int")
    ok = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c")], "bucket string, a string, b string")
    got = {r.finding_id: r.cluster_id for r in resolve.cluster(rows, ok).collect()}
    assert got["c"] == got["b"] and got["a"] != got["b"]


def test_order_does_not_matter(spark):
    rows = [(i, f"s{i % 3}", "k" if i % 2 else None) for i in range(20)]
    outs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "ord int, v string, key string").repartition(5)
        outs.append(df.groupBy("key").agg(resolve.ordered_union("ord", "v").alias("u")).orderBy("key").collect())
    assert outs[0] == outs[1]


def test_diff_modes(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b"), (4, "x")], "k int, s string")
    prev = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, s string")
    full = {r.k: r.status for r in compare.diff(cur, prev, ["k"], ["s"]).collect()}
    assert full == {1: "persistent", 2: "changed", 3: "fixed", 4: "new"}
    part = {r.k: r.status for r in compare.diff(cur, prev, ["k"], ["s"], partial=True).collect()}
    assert part == {1: "persistent", 2: "changed", 3: None, 4: None}


def test_rules_validation_and_artifacts(spark):
    rules = spark.createDataFrame([(100, 0, "a.org", None, "high"), (30, 1, None, "org", "low")], "specificity int, ord int, host string, host_suffix string, asset_criticality string")
    hosts = spark.createDataFrame([("a.org",), ("b.org",), ("borg",)], "h string")
    none = F.lit(None).cast("string")
    hit = predicates.rule_matches({"asset_id": none, "host": F.col("host"), "host_suffix": F.col("host_suffix"), "path_prefix": none}, none, F.col("h"), none)
    assert {r.h: r.asset_criticality for r in enrich.fill_from_rules(hosts, rules, "h", hit, ("asset_criticality",)).collect()} == {"a.org": "high", "b.org": "low"}
    empty = spark.createDataFrame([], "finding_id string, vulnerability_name string, severity string, asset_id string, description string, remediation string, meta struct<scanner:string,port:int,cvss_score:double,epss_score:double,epss_percentile:double>")
    predicates.assert_valid(empty)
    bad = spark.createDataFrame([("f1", " ", "odd", "a", "d", "r", ("", 70000, 11.0, None, None))], empty.schema)
    with pytest.raises(ValueError, match="vulnerability_name is missing"):
        predicates.assert_valid(bad)


def test_summary_edges(spark):
    none = spark.createDataFrame([], "level string")
    assert {r.level: r.n for r in summary.zero_filled(none, F.col("level"), ["a", "b"]).collect()} == {"a": 0, "b": 0}
    same = spark.createDataFrame([], "id int, grp string")
    assert summary.pair_metrics(same, same).first().precision == 1.0


def test_export_rows(spark):
    got = spark.range(1).select(export.tags(F.array(F.lit("Zap"), F.lit("zap")), F.lit("P1"), F.lit(None).cast("string")).alias("t")).first().t
    assert got == ["priority:P1", "scanner:zap"]


def test_streaming_ingest(spark, tmp_path):
    from findloom.streaming import ingest

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.jsonl", json.dumps({"template-id": "t", "matched-at": "https://o.org/a", "info": {"severity": "low"}}) + "\nbad\n")
    q = ingest.ingest_json_lines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "https://o.org")
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
