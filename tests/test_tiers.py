from __future__ import annotations

import random

from pyspark.sql import functions as F

from findloom import schema
from findloom.operators import tiers
from findloom.operators.context import with_context
from findloom.plans.pipeline import with_fingerprints


def in_sequence(rows, n_tiers):
    """(order, first row of the group, tier) by the plain sequence; rows are (order, keys, veto)."""
    groups, out = [], {}
    for i, keys, veto in sorted(rows):
        to = None
        for t in range(n_tiers):
            near = next((g for g in groups if keys[t] and any(k[t] == keys[t] for _, k, _ in g)), None)
            if near is not None and not (veto and any(v and v != veto for _, _, v in near)):
                to = (near, t)
                break
        if to is None:
            groups.append([(i, keys, veto)])
            out[i] = (i, -1)
        else:
            to[0].append((i, keys, veto))
            out[i] = (to[0][0][0], to[1])
    return out


def grouped(spark, rows, n_tiers):
    df = spark.createDataFrame([(i, *keys, veto) for i, keys, veto in rows], "ord long, fp_strict string, fp_general string, fp_host_only string, veto string")
    got = tiers.tiered_groups(df.withColumn("x", F.lit(1)), tiers.KEYS[:n_tiers], "veto")
    return {r["ord"]: (r["root"], r["tier"]) for r in got.collect()}


def test_groups_equal_the_sequence_on_random_keys(spark):
    rng = random.Random(5)
    for n_tiers, kinds in ((2, 6), (3, 4), (3, 12)):
        pick = lambda: rng.choice([None, ""] + [str(k) for k in range(kinds)])  # noqa: B023, E731
        rows = [(3 * i, (pick(), pick(), pick()), rng.choice([None, None, "a", "b", "c"])) for i in range(60)]
        assert grouped(spark, rows, n_tiers) == in_sequence(rows, n_tiers)


def test_groups_equal_the_sequence_where_keys_refine_each_other(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        h, g, s, e = rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.choice("xy")
        rows.append((i, (f"{h}/{g}/{s}/{e}", f"{h}/{g}", str(h)), e if h == 0 else None))
    assert grouped(spark, rows, 3) == in_sequence(rows, 3)


def test_a_chain_of_keys_ends_right(spark):
    # each row shares its strict key with the one before by turns, so groups hang on one another
    rows = [(i, (f"s{i // 2}", f"g{(i + 1) // 2}", None), None) for i in range(12)]
    assert grouped(spark, rows, 2) == in_sequence(rows, 2)


def test_a_hot_key_and_no_rows(spark):
    rows = [(i, ("hot", "hot", "hot"), None) for i in range(300)]
    got = grouped(spark, rows, 3)
    assert {r for r, _ in got.values()} == {0} and got[0] == (0, -1) and got[299] == (0, 0)
    assert grouped(spark, [], 2) == {}


def finding(i, name, asset, method=None, scanner="zap", severity="low"):
    return {"finding_id": f"f{i}", "ord": i, "vulnerability_name": name, "severity": severity, "asset_id": asset, "description": "d", "remediation": "r", "meta": {"scanner": scanner, "method": method}}


def test_merge_by_tiers(spark):
    error = "Internal Server Error"
    rows = [
        finding(0, "SQL Injection", "https://h/a?x=1", scanner="zap"), finding(1, "SQL Injection", "https://h/a?x=2", scanner="nuclei", severity="high"), finding(2, "SQL Injection", "https://h/a?y=2"),
        finding(3, error, "https://h/a", "GET"), finding(4, error, "https://h/a", "POST"), finding(5, error, "https://h/a", "POST"), finding(6, error, "https://h/a", "GET"), finding(7, "SQL Injection", "https://h/b"),
    ]
    df = with_fingerprints(schema.conform(spark.createDataFrame(rows, "finding_id string, ord long, vulnerability_name string, severity string, asset_id string, description string, remediation string, meta struct<scanner:string,method:string>")))
    got = {r["ord"]: r for r in tiers.merge_tiers(df).collect()}
    assert {k: (r["match_level"], r["duplicate_count"], r["merge_confidence"]) for k, r in got.items()} == {0: ("general", 3, 0.85), 3: ("strict", 2, 1.0), 4: ("strict", 2, 1.0), 7: ("single", 1, 1.0)}
    assert got[0]["severity"] == "high" and got[0]["found_by"] == ["zap", "nuclei"]
    merged, counts = tiers.deduplicate(df, use_host_only=True)
    one = counts.first()
    assert (one["original_findings_count"], one["deduplicated_findings_count"], one["duplicates_merged"], one["suppressed_adapter_findings_count"]) == (8, 3, 5, 0)
    assert {r["match_level"] for r in merged.collect()} == {"host_only", "strict"}


def test_server_key_needs_a_host_and_the_name(spark):
    rows = [finding(0, "Internal server error", "https://h/a", "get"), finding(1, "Other", "https://h/a"), finding(2, "Internal server error", "")]
    df = schema.conform(spark.createDataFrame(rows, "finding_id string, ord long, vulnerability_name string, severity string, asset_id string, description string, remediation string, meta struct<scanner:string,method:string>"))
    assert [r["server_key"] for r in tiers.server_error_key(with_context(df)).orderBy("ord").collect()] == ["h|https||/a|GET", None, None]
