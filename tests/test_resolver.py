"""The resolver, run comparison, enrichment, knowledge store, triage and evaluation on own small cases."""

import itertools

import pytest
from pyspark.sql import functions as F

from findloom import schema
from findloom.operators import context, enrich, evaluate, knowledge, merge, profile, resolve, score, triage
from findloom.plans import pipeline


def findings(spark, *rows):
    """Rows of name, severity, asset and metadata as findings in order."""
    data = []
    for i, (name, severity, asset, meta) in enumerate(rows):
        meta = dict(meta)
        fid, description = meta.pop("finding_id", None), meta.pop("description", f"text {i}")
        data.append((fid, i, name, severity, asset, description, meta.pop("remediation", "fix"), meta, []))
    return spark.createDataFrame(data, schema.FINDING)


def test_context(spark):
    rows = findings(
        spark,
        ("a", "low", "https://Shop.org/A/123/?z=1&y=2", {"scanner": "zap", "method": "get"}), ("b", "low", "h.org:22", {"scanner": "nmap", "service": "ssh", "protocol": "tcp"}), ("c", "low", "h.org", {"scanner": "nmap", "protocol": "udp", "port": 53}),
        ("d", "low", "http://shop.org:8080", {"scanner": "zap"}), ("e", "low", "h.org:21", {"scanner": "nmap", "service": "FTP Server", "protocol": "tcp"}),
    )
    got = [r.ctx for r in context.with_context(rows).orderBy("ord").collect()]
    assert (got[0].host, got[0].port, got[0].path, got[0].query_keys, got[0].endpoint_family, got[0].target_family) == ("shop.org", 443, "/a/123", "y&z", "/a/{id}", "web")
    buckets = [r.b for r in context.with_context(rows).orderBy("ord").select(context.coarse_bucket(F.col("ctx")).alias("b")).collect()]
    assert buckets == ["shop.org|web-default|web", "h.org|22|ssh", "h.org|53|generic", "shop.org|web:8080|web", "h.org|21|ftp_server"]


def test_exact_merge_keeps_sources_and_order(spark):
    m = {"scanner": "zap", "plugin_id": "10", "parameter": "q"}
    rows = findings(
        spark,
        ("SQL Injection", "medium", "https://a.org/x", m | {"references": ["r2", "r1"], "degraded_execution": True}), ("Other", "low", "https://a.org/y", {"scanner": "zap"}), ("SQL Injection", "low", "https://a.org/x", m | {"references": ["r1", "r3"], "cve_ids": ["CVE-2024-0001"]}),
        ("SQL Injection", "high", "https://a.org/x", m | {"description": "text 2"}), ("SQL Injection", "high", "https://a.org/x", m | {"scanner": "wapiti"}),
    )
    keyed = pipeline.with_fingerprints(pipeline.union_findings([rows]))
    got = pipeline.resolve_exact(keyed).orderBy("ord").collect()
    assert [(r.vulnerability_name, r.ord, r.duplicate_count) for r in got] == [("SQL Injection", 0, 3), ("Other", 1, 1), ("SQL Injection", 4, 1)]
    top = got[0]
    assert (top.severity, top.meta.references, top.meta.cve_ids, top.found_by) == ("high", ["r2", "r1", "r3"], ["CVE-2024-0001"], ["zap"])
    assert top.finding_id.startswith("cluster-") and len({s.finding_id for s in top.source_findings}) == 2 and top.meta.merged and top.meta.original_findings_count == 2
    assert top.meta.confirmation_scanners == ["zap"] and not top.meta.has_multi_scanner_confirmation and got[1].meta.merged is None


URL = "https://a.org/login"


def test_rules_join_scanners(spark):
    rows = findings(
        spark,
        ("Missing Content-Security-Policy header", "low", URL, {"scanner": "zap"}), ("CSP header not set", "info", URL, {"scanner": "nikto"}), ("CSP header not set", "info", "https://a.org/other", {"scanner": "nuclei"}),
        ("CVE-2024-1 in product", "high", "a.org:22", {"scanner": "nmap", "service": "ssh", "cve_id": "CVE-2024-1234"}), ("Weak ssh", "low", "a.org:22", {"scanner": "nuclei", "service": "ssh", "cve_ids": ["cve-2024-1234"]}),
        ("SQL Injection", "high", URL, {"scanner": "zap", "parameter": "id", "method": "POST"}), ("Blind SQL injection", "high", URL, {"scanner": "wapiti", "parameter": "ID", "method": "post"}), ("SQL injection", "high", URL, {"scanner": "nuclei", "parameter": "id"}),
        ("SQL injection", "high", URL, {"scanner": "nikto", "parameter": "id", "method": "POST", "degraded_execution": True}),
    )
    hinted = context.with_hints(context.with_context(rows.withColumn("finding_id", F.concat(F.lit("f"), "ord")))).cache()
    got = sorted((r.finding_id_a, r.finding_id_b, r.rule) for r in resolve.candidate_pairs(hinted).withColumn("rule", resolve.deterministic_rule()).filter("rule IS NOT NULL").collect())
    assert got == [("f0", "f1", "same_header_family_same_endpoint"), ("f3", "f4", "same_cve_same_effective_target"), ("f5", "f6", "same_strong_family_same_endpoint_context")]


def test_decisions_and_reviews(spark):
    rows = findings(
        spark,
        ("Open redirect on login", "medium", "https://b.org/login", {"scanner": "zap", "finding_id": "f1"}), ("Login open redirect", "low", "https://b.org/login?next=x", {"scanner": "nuclei", "finding_id": "f2"}), ("Open redirect login page", "low", "https://b.org/", {"scanner": "nikto", "finding_id": "f3"}),
        ("Unrelated cookie thing", "low", "https://b.org/", {"scanner": "wapiti", "finding_id": "f4"}),
    )
    answers = spark.createDataFrame([("f1::f2", True, 0.97, "same", "Open redirect"), ("f1::f3", True, 0.5, "maybe", "Open redirect"), ("f2::f3", False, 0.9, "no", "")], "pair_key string, same boolean, confidence double, reason string, canonical_title string")
    records = resolve.comparisons(context.with_hints(context.with_context(rows)).cache(), answers).cache()
    merged = spark.createDataFrame([("c", ["f1", "f2"]), ("f3", []), ("f4", [])], "finding_id string, ids array<string>").select("finding_id", F.transform("ids", lambda i: F.struct(i.alias("finding_id"))).alias("source_findings"))
    results = resolve.final_results(records, merged).cache()
    got = {(r.a, r.b): r for r in results.collect()}
    assert set(got) == {("f1", "f2"), ("f1", "f3"), ("f2", "f3")} and got["f1", "f2"].approved and got["f1", "f2"].final_merge_result == "merged" and got["f1", "f3"].needs_review and got["f1", "f2"].gate == "passed_similar_normalized_title"
    pairs = resolve.correlations(results, merged).collect()
    assert {(p.finding_id, p.candidate_id, p.confidence) for p in pairs} == {("c", "f3", 0.5), ("f3", "c", 0.5)}
    assert resolve.analysis(records).first().approved == 1


def test_matching_of_many_rounds(spark, tmp_path):
    """A chain on which greedy matching needs more than fifty rounds."""
    n, made = 52, []

    def written(df):
        made.append(str(tmp_path / str(len(made))))
        df.coalesce(1).write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    rows = [(i, j, 2 * n - i - j) for i in range(n) for j in (i, i + 1)]
    got = resolve.match_greedy(spark.createDataFrame(rows, "a int, b int, s int"), written, [F.desc("s"), F.asc("a"), F.asc("b")])
    used_a, used_b, expected = set(), set(), 0
    for a, b, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b)
            expected += 1
    assert got.count() == expected and len(made) > 100


def test_compare_runs(spark):
    m = {"scanner": "zap"}
    now = findings(spark, ("SQL injection", "high", "https://a.org/x?id=1", m | {"finding_id": "n1"}), ("Directory listing enabled", "low", "https://a.org/files", m | {"finding_id": "n2"}), ("Weak cipher suite", "low", "a.org:8443", {"scanner": "nmap", "service": "tls", "finding_id": "n3"}))
    old = findings(spark, ("SQL injection", "medium", "https://a.org/x?id=1", m | {"finding_id": "p1"}), ("Directory listing enabled", "low", "https://a.org/files", m | {"finding_id": "p2"}), ("Weak cipher suite", "low", "a.org:9443", {"scanner": "nmap", "service": "tls", "finding_id": "p3"}))
    got = {(r.current_id, r.previous_id): (r.status, r.changed_fields) for r in profile.compare_runs(now, old, lambda d: d.cache()).collect()}
    assert got == {("n1", "p1"): ("CHANGED", ["severity"]), ("n2", "p2"): ("PERSISTENT", []), ("n3", None): ("NEW", []), (None, "p3"): ("FIXED", [])}
    part = profile.compare_runs(now, old, lambda d: d.cache(), partial=True)
    assert profile.counts(part).first().asDict() == {"new": 0, "fixed": 0, "persistent": 1, "changed": 1, "unmatched_current": 1, "unmatched_previous": 1, "matched": 2}


def test_repeats(spark):
    now = spark.createDataFrame([(1, "s1", "g1"), (2, "s2", "g2"), (3, None, "g3"), (4, "s4", "g4"), (5, None, None)], "k int, fp_strict string, fp_general string")
    old = spark.createDataFrame([("s1", "x"), ("other", "g2"), ("s3", "g3"), (None, "g4"), (None, None)], "fp_strict string, fp_general string")
    assert {r.k: r.repeatable for r in score.with_repeatable(now, old).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_intelligence(spark):
    feed = [(0, '{"cve": "CVE-2024-1111", "cvss_v4": {"score": 9.9, "vector": "v"}}'), (1, '{"cve": "CVE-2024-1111", "cvss_v3_score": "8.1"}'), (2, '{"cveID": "x cve-2024-2222", "cvss_score": 7.5, "cvss_version": "4.0"}'), (3, '{"id": "n", "note": "CVE-2024-3333", "value": 12}')]
    kinds = "cve string, cvss_v4 string, cvss_v3_score string, cveID string, cvss_score double, cvss_version string, id string, note string, value double"
    cvss = enrich.cvss_feed(spark.createDataFrame(feed, "ord int, j string").select("ord", F.from_json("j", kinds).alias("r")).select("ord", "r.*"), "feed")
    got = {r.cve_id: (r.cvss_score, r.cvss_version) for r in cvss.collect()}
    assert got == {"CVE-2024-1111": (8.1, "3.1"), "CVE-2024-2222": (7.5, "4.0"), "CVE-2024-3333": (10.0, "3.1")}
    epss = enrich.epss_feed(spark.createDataFrame([(0, "CVE-2024-1111", "45%", None), (1, "CVE-2024-2222", None, "0.9")], "ord int, cve string, epss string, percentile string"), "e")
    kev = enrich.kev_feed(spark.createDataFrame([(0, "CVE-2024-2222", None, "2026-01-01"), (1, "CVE-2024-1111", "false", None)], "ord int, cveID string, listed string, dueDate string"), "k")
    rows = findings(
        spark,
        ("a", "low", "a", {"finding_id": "1", "scanner": "x", "cve_ids": ["CVE-2024-1111", "CVE-2024-2222"]}), ("b", "low", "a", {"finding_id": "2", "scanner": "x", "cve_ids": ["nonsense"], "cvss_score": 5.0, "kev_listed": True}), ("c", "low", "a", {"finding_id": "3", "scanner": "x", "cve_id": "CVE-2020-9999", "cvss_score": 4.0, "epss_score": 0.5}),
        ("d", "low", "a", {"finding_id": "4", "scanner": "x", "cvss_score": 3.0}),
    )
    out = {r.finding_id: r.meta for r in enrich.with_intelligence(rows, cvss, epss, kev).collect()}
    assert (out["1"].cve_id, out["1"].cvss_score, out["1"].kev_listed, out["1"].kev_due_date, out["1"].epss_percentile) == ("CVE-2024-2222", 7.5, True, "2026-01-01", 0.9)
    assert (out["2"].cve_ids, out["2"].cvss_score, out["2"].kev_listed) == ([], None, None) and out["4"].cvss_score == 3.0
    assert (out["3"].cve_id, out["3"].cvss_score, out["3"].cvss_source, out["3"].epss_score, out["3"].kev_listed) == ("CVE-2020-9999", 4.0, "scanner", None, False)


def test_asset_rules(spark):
    rules = spark.createDataFrame([(0, None, "a.org", None, None, "high", None), (1, None, None, "*.org", None, "low", "production"), (2, None, None, None, "/x", None, "test"), (3, None, None, None, None, "high", None)], "ord int, asset_id string, host string, host_suffix string, path_prefix string, asset_criticality string, environment string")
    rules = rules.withColumns({"internet_exposed": F.lit(None).cast("boolean"), "requires_auth": F.lit(None).cast("boolean"), "sensitive_data": F.lit(None).cast("boolean")})
    rows = context.with_context(findings(spark, ("a", "low", "https://a.org/x", {"finding_id": "1"}), ("a", "low", "https://b.com/x", {"finding_id": "2", "business_context": {"environment": "staging"}}), ("a", "low", "https://c.net/", {"finding_id": "3"})))
    got = {r.finding_id: (r.meta.business_context.asset_criticality, r.meta.business_context.environment) for r in enrich.asset_context(rows, rules).collect()}
    assert got == {"1": ("high", "production"), "2": (None, "staging"), "3": (None, None)}


def test_knowledge_sync(spark):
    rows = findings(spark, ("A", "low", "x", {"scanner": "ZAP", "plugin_id": "1", "path": "/p"}), ("B", "low", "x", {"scanner": "nmap", "service": "ssh"}), ("A2", "low", "x", {"scanner": "zap", "plugin_id": "1"}))
    records = knowledge.records(knowledge.original_findings(rows))
    empty = records.select(*knowledge.FIELDS, "content_hash", F.lit("").alias("created_at"), F.lit("").alias("updated_at")).limit(0)
    store, log = knowledge.sync(empty, records, "t1")
    assert {r.scanner_name: (r.total_imported, r.total_updated, r.total_skipped) for r in log.collect()} == {"zap": (1, 1, 0), "nmap": (1, 0, 0)}
    again, log = knowledge.sync(store.cache(), records.filter("ord > 0"), "t2")
    assert {r.scanner_name: (r.total_imported, r.total_updated, r.total_skipped) for r in log.collect()} == {"zap": (0, 0, 1), "nmap": (0, 0, 1)}
    assert {(r.scanner_name, r.created_at, r.updated_at, r.affected_target_type) for r in knowledge.listed(again).collect()} == {("zap", "t1", "t2", "host"), ("nmap", "t1", "t2", "network_service")}
    answers = spark.createDataFrame([("k", "v1", 1, "old"), ("k", "v1", 2, "new")], "cache_key string, version string, saved_at int, answer string")
    asked = spark.createDataFrame([("k", "v1"), ("k", "v2"), ("z", "v1")], "cache_key string, version string")
    assert sorted((r.cache_key, r.version, r.answer) for r in knowledge.cached(asked, answers, ("version",)).collect() if r.hit) == [("k", "v1", "new")]


def test_triage(spark):
    log = spark.createDataFrame([("finding", "n::h", "confirmed", "c", "me", "d1", 1)], "scope string, key string, status string, comment string, reviewer string, decided_at string, revision int")
    new = spark.createDataFrame([(1, "finding", "n::h", "false_positive", "password = hunter22x\n ok", "a b!", "d2"), (2, "site_vuln", "m::h", "needs_review", None, None, "d2"), (3, "finding", "q", "odd", "", "", "")], "ord int, scope string, key string, status string, comment string, reviewer string, decided_at string")
    both = triage.record(log, new)
    assert {(r.key, r.revision, r.reviewer) for r in both.collect()} == {("n::h", 1, "me"), ("n::h", 2, "a-b"), ("m::h", 1, "local-user")} and not both.filter("comment LIKE '%hunter22x%'").count()
    rows = spark.createDataFrame([(1, "n::h::x", "n::h", "n::h"), (2, "m::h::x", "m::h::x", "m::h"), (3, "n", "n", "n")], "k int, fp_strict string, fp_general string, fp_host_only string")
    got = {r.k: r.human_triage and (r.human_triage.scope, r.human_triage.status) for r in triage.stamp(rows, both).collect()}
    assert got == {1: ("finding", "false_positive"), 2: ("site_vuln", "needs_review"), 3: None}
    with pytest.raises(ValueError, match="unknown scope"):
        triage.annotation_key(F.lit(""), F.lit(""), F.lit(""), "host")


def test_case_metrics_equal_brute_force(spark):
    expected = {"a": [["1", "2", "3"], ["4"]], "b": [["1"], ["2"]], "c": [["1", "2"]]}
    actual = {"a": [["1", "2"], ["3", "4"]], "b": [["1"], ["2"]], "c": [["1", "2"]]}
    rows = lambda x: spark.createDataFrame([(c, i, str(g)) for c, gs in x.items() for g, ids in enumerate(gs) for i in ids], "case_id string, id string, grp string")
    pairs = lambda gs: {p for g in gs for p in itertools.combinations(sorted(g), 2)}
    m = evaluate.case_metrics(rows(expected), rows(actual))
    for r in m.collect():
        e, a = pairs(expected[r.case_id]), pairs(actual[r.case_id])
        assert (r.true_positives, r.false_positives, r.false_negatives) == (len(e & a), len(a - e), len(e - a)) and r.exact_partition == (sorted(expected[r.case_id]) == sorted(actual[r.case_id]))
    t = evaluate.totals(m).first()
    assert (t.cases, t.exact, t.precision, t.recall) == (3, 2, round(2 / 3, 6), 0.5)


def test_labels(spark):
    rows = findings(spark, ("A", "low", "x", {"scanner": "zap", "path": "/1"}), ("A", "low", "x", {"scanner": "zap", "path": "/2"}))
    assert evaluate.label_template(rows).count() == 2
    with pytest.raises(ValueError, match="told apart"):
        evaluate.label_template(rows.unionByName(rows))
    labels = spark.createDataFrame([("a", "applicable"), ("b", "likely_false_positive"), ("c", "applicable"), ("d", "applicable")], "finding_key string, expected string")
    made = spark.createDataFrame([("a", "completed", "applicable"), ("b", "cached", "applicable"), ("c", "unavailable", None)], "finding_key string, status string, predicted string")
    r = evaluate.advice_metrics(labels, made).first()
    assert (r.matched_cases, r.analyzed_cases, r.unavailable_count, r.match_rate, r.applicability_agreement) == (3, 2, 1, 0.75, 0.5)


def test_scorer_phrases(spark):
    f = lambda text: spark.createDataFrame([(text,)], "t string").select(score.low_signal(F.col("t")).alias("l"), score.vulnerability_class(F.col("t"), F.array().cast("array<int>"))["id"].alias("c"), score.requires_auth(F.lit(None).cast("boolean"), F.col("t")).alias("a"), score.known_exploit(F.lit(None).cast("boolean"), F.array("t")).alias("e")).first()
    assert f("missing the x-frame-options header").l == "missing_hardening_header" and f("samesite attribute missing").l == "cookie_hardening_flag" and f("force of nature").c == "generic_issue"
    assert f("a serverside template injection").c == "server_side_template_injection" and f("xrce").c == "generic_issue" and f("pre-auth rce").a is False and f("post auth only").a is True
    assert f("https://github.com/x/poc-exploit-1").e and not f("https://github.com/x/poc").e and f("see exploit-db.com").e and merge is not None


def test_rule_classes_equal_the_pairs(spark):
    """Links of a finding are the pairs that the rules make of it, protocols and degraded findings included."""
    import random

    from findloom import schema
    from findloom.operators import context, resolve

    rng = random.Random(11)
    names = ["SQL Injection", "Missing Content-Security-Policy header", "OpenSSH outdated", "XML External Entity found"]
    rows = []
    for i in range(70):
        meta = {"scanner": rng.choice(["zap", "Nikto", "nmap"]), "cve_ids": rng.choice([None, ["CVE-2024-1000"], ["CVE-2024-1000", "CVE-2024-2000"]]), "parameter": rng.choice([None, "q"]), "method": rng.choice(["get", None]), "protocol": rng.choice([None, "tcp", "udp"]), "service": rng.choice([None, "ssh"]), "degraded_execution": rng.random() < 0.1}
        rows.append({"finding_id": f"f{i:02d}", "ord": i, "vulnerability_name": rng.choice(names), "severity": "low", "asset_id": rng.choice(["https://h/a", "https://h/b", "h:22", ""]), "description": "d", "remediation": "r", "meta": meta})
    df = context.with_hints(context.with_context(spark.createDataFrame(rows, schema.FINDING)))
    pairs = {}
    side = lambda s: df.selectExpr(f"finding_id id_{s}", f"lower(coalesce(meta.scanner, '')) scanner_{s}", f"coalesce(meta.degraded_execution, false) degraded_{s}", f"cves cves_{s}", f"families families_{s}", f"ctx ctx_{s}")
    both = side("a").crossJoin(side("b")).filter("id_a <> id_b AND scanner_a <> scanner_b AND NOT degraded_a AND NOT degraded_b AND ctx_a.host <> '' AND ctx_a.host = ctx_b.host AND ctx_a.target_family = ctx_b.target_family AND ctx_a.port <=> ctx_b.port")
    both = both.filter("ctx_a.target_family = 'web' OR ctx_a.protocol = '' OR ctx_b.protocol = '' OR ctx_a.protocol = ctx_b.protocol")
    for r in both.collect():
        keys = [("same_cve_same_effective_target", c) for c in set(r["cves_a"]) & set(r["cves_b"])]
        shared = set(r["families_a"]) & set(r["families_b"])
        if r["ctx_a"]["path"] == r["ctx_b"]["path"]:
            keys += [("same_header_family_same_endpoint", f) for f in shared if f in context.HEADER_FAMILIES]
            if r["ctx_a"]["parameter"] == r["ctx_b"]["parameter"] != "" and r["ctx_a"]["method"] == r["ctx_b"]["method"] != "":
                keys += [("same_strong_family_same_endpoint_context", f) for f in shared if f in context.PARAMETER_FAMILIES]
        for rule, _ in keys:
            pairs[r["id_a"], rule] = pairs.get((r["id_a"], rule), 0) + 1
    got = {}
    for r in resolve.rule_classes(df).collect():
        got[r["finding_id"], r["rule"]] = got.get((r["finding_id"], r["rule"]), 0) + r["links"]
    assert got == pairs and len(pairs) > 20


def test_intelligence_of_repeated_ids(spark):
    from findloom import schema
    from findloom.operators import enrich

    rows = [{"finding_id": "same", "ord": i, "vulnerability_name": "n", "severity": "low", "asset_id": "a", "description": "d", "remediation": "r", "meta": {"scanner": "zap", "cve_ids": c, "cvss_score": s}} for i, (c, s) in enumerate([(["CVE-2024-1000"], 5.0), (["CVE-2024-1000"], 5.0), (["CVE-2024-2000", "CVE-2024-1000"], None), (None, 1.0)])]
    feed = enrich.cvss_feed(spark.createDataFrame([(0, "CVE-2024-1000", None, "9.8")], "ord int, cve string, cvss_v4_score string, cvss_v3_score string"), "own")
    got = enrich.with_intelligence(spark.createDataFrame(rows, schema.FINDING), feed).orderBy("ord").collect()
    assert [len(r["meta"]["cve_intelligence_candidates"] or []) for r in got] == [1, 1, 2, 0] and [r["meta"]["cvss_score"] for r in got] == [9.8, 9.8, 9.8, 1.0]


def test_degraded_sources_count_wherever_they_say_so(spark):
    from findloom import schema
    from findloom.operators import merge, score
    from findloom.plans.pipeline import with_fingerprints

    source = lambda own, meta: {"finding_id": "s", "scanner": "zap", "degraded": own, "meta": {"degraded_execution": meta}}
    cases = [[source(False, True)], [source(True, None)], [source(None, None)], [source(False, True), source(None, False)], None]
    rows = [{"finding_id": f"f{i}", "ord": i, "vulnerability_name": "n", "severity": "high", "asset_id": "https://h/a", "description": "d", "remediation": "r", "meta": {"scanner": "zap"}, "source_findings": s} for i, s in enumerate(cases)]
    df = with_fingerprints(spark.createDataFrame(rows, schema.FINDING))
    assert [r["d"] for r in df.orderBy("ord").select(merge.degraded(df["meta"], df["source_findings"]).alias("d")).collect()] == [True, True, False, True, False]
    evidence = [r["risk_factors"]["evidence"] for r in score.score(df).orderBy("ord").collect()]
    assert evidence[0] == evidence[1] < evidence[2] == evidence[4] and evidence[0] <= evidence[3] < evidence[2]
