from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from findloom.operators import contract

ANSWERS = {
    "ai_analysis_status": "cached", "applicability": {"status": "likely_valid", "confidence": 0.5, "reason": " r ", "evidence_ids": ["e1"]}, "ai_remediation": {"steps": ["s"], "verification": ["v"]},
    "ai_priority": {"recommended_priority": "P1", "confidence": 1, "reason": "r", "evidence_ids": ["e"], "context_revision": "c"}, "ai_summary": {"description": "d", "business_impact": "b", "evidence_ids": ["e"]},
}
TRIAGE = {"status": "confirmed", "scope": "finding", "key": "k", "reviewer": "me", "decided_at": "2026-01-01T00:00:00Z"}


def payloads(spark, *values):
    rows = [(i, v if isinstance(v, str) or v is None else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run long, j string").select("run", F.parse_json("j").alias("payload"))


def paths(spark, value, deep=False):
    return sorted(r["path"] for r in contract.forbidden_paths(payloads(spark, value), "run", deep=deep).collect())


def clean(spark, f, value):
    got = payloads(spark, value).select(F.to_json(f(F.col("payload"))).alias("x")).first()["x"]
    return None if got is None else json.loads(got)


def visited(result):
    """The contract's paths by plain recursion."""
    out = []

    def keys(prefix, place, value):
        out.extend(f"{prefix}{k}" for k in value if k in contract.FORBIDDEN[place])

    def finding(prefix, f):
        if isinstance(f, dict):
            keys(f"{prefix}.", "finding", f)
            if isinstance(f.get("meta"), dict):
                keys(f"{prefix}.meta.", "meta", f["meta"])
            if isinstance(f.get("source_findings"), list):
                for i, s in enumerate(f["source_findings"]):
                    if isinstance(s, dict):
                        keys(f"{prefix}.source_findings[{i}].", "source", s)
                        if isinstance(s.get("meta"), dict):
                            keys(f"{prefix}.source_findings[{i}].meta.", "meta", s["meta"])

    if not isinstance(result, dict):
        return []
    keys("", "result", result)
    for name in contract.FINDING_LISTS:
        for i, f in enumerate(result.get(name) if isinstance(result.get(name), list) else []):
            finding(f"{name}[{i}]", f)
    by = result.get("findings_by_scanner")
    for scanner, fs in (by if isinstance(by, dict) else {}).items():
        for i, f in enumerate(fs if isinstance(fs, list) else []):
            finding(f"findings_by_scanner.{scanner}[{i}]", f)
    return sorted(out)


def test_forbidden_paths_are_named(spark):
    finding = {"finding_id": "f", "meta": {"kev": None, "host": "h", "deep": {"scanners": []}}, "source_findings": [1, {"fp_strict": "x", "meta": {"merged": True}}], "environment": {"finding_id": 1}}
    result = {"scan_plan": {}, "all_findings": [{}, finding, 3], "fixed_findings": {"finding_id": 1}, "findings_by_scanner": {"zap": [finding], "odd": 1}, "changed_findings": [[finding]], "notes": {"scan_plan": 1}}
    assert paths(spark, result) == visited(result)
    deep = paths(spark, result, deep=True)
    assert set(deep) - set(paths(spark, result)) == {"all_findings[1].meta.deep.scanners", "findings_by_scanner.zap[0].meta.deep.scanners"}


@pytest.mark.parametrize("value", ["[1]", "null", '"x"', None, {}, {"all_findings": None}])
def test_no_paths(spark, value):
    assert paths(spark, value) == []


def test_depth_is_not_bounded(spark):
    value = {"kev": 1}
    for _ in range(12):
        value = {"x": [value]}
    assert paths(spark, {"all_findings": [{"meta": value}]}, deep=True) == ["all_findings[0].meta" + ".x[0]" * 12 + ".kev"]


def test_a_finding_is_rebuilt(spark):
    finding = {
        "finding_id": "f", "vulnerability_name": "n", "description": "token = abcdefghijklmnop1234", "asset_id": 5, "own": [1, {"kev": 1}], "meta": {"kev": 1, "host": "h"}, "source_findings": [{"finding_id": 1, "scanner": "zap", "meta": None}, 7],
        "human_triage": TRIAGE | {"extra": 1, "comment": "  c ", "revision": 0}, "correlation": {"status": "merged", "source": "llm", "confidence": True}, **ANSWERS,
    }
    got = clean(spark, contract.sanitize_finding, finding)
    assert "finding_id" not in got and "correlation" not in got and got["meta"] == {"host": "h"} and got["asset_id"] == 5 and got["own"] == [1, {"kev": 1}]
    assert got["source_findings"] == [{"scanner": "zap", "meta": {}}] and got["human_triage"] == TRIAGE | {"comment": "c"}
    assert got["applicability"] == ANSWERS["applicability"] | {"reason": "r"} and got["ai_priority"]["confidence"] == 1.0 and "abcdefghijklmnop1234" not in got["description"]
    assert contract and paths(spark, {"all_findings": [got]}) == []
    assert clean(spark, contract.sanitize_finding, [1, 2]) == [1, 2]


@pytest.mark.parametrize(
    "field, wrong",
    [("applicability", {"status": "likely_valid", "confidence": True, "reason": "r", "evidence_ids": ["e"]}), ("applicability", ANSWERS["applicability"] | {"more": 1}), ("ai_remediation", {"steps": [], "verification": ["v"]}),
     ("ai_priority", ANSWERS["ai_priority"] | {"recommended_priority": "P9"}), ("ai_summary", None), ("ai_analysis_status", "other"), ("ai_summary", ANSWERS["ai_summary"] | {"evidence_ids": ["e"] * 21}), ("ai_remediation", {"steps": ["a", " "], "verification": ["v"]})],
)
def test_a_malformed_answer_takes_the_others_with_it(spark, field, wrong):
    got = clean(spark, contract.sanitize_finding, ANSWERS | {field: wrong})
    assert not set(got) & set(contract.ADVISORY)
    assert set(clean(spark, contract.sanitize_finding, ANSWERS | {"ai_analysis_status": "unavailable"})) == {"meta", "ai_analysis_status"}


def test_triage_and_correlation(spark):
    for wrong in ({"status": "x"}, {"scope": None}, {"key": " "}, {"reviewer": 1}, {"decided_at": "2026-01-01"}):
        assert clean(spark, contract.human_triage, TRIAGE | wrong) is None
    assert clean(spark, contract.human_triage, [TRIAGE]) is None
    candidates = [{"finding_id": "b", "confidence": 0.5, "scanners": ["zap", "nmap", 1, "zap"]}, {"finding_id": "a", "confidence": 1}, {"finding_id": "c", "confidence": True}, 4]
    got = clean(spark, contract.correlation, {"status": "needs_review", "source": "llm", "confidence": 0.25, "needs_review": 1, "secret": 1, "review_candidates": candidates})
    assert [c["finding_id"] for c in got["review_candidates"]] == ["a", "b"] and got["review_candidates"][1]["scanners"] == ["nmap", "zap"] and got["needs_review"] is True and "secret" not in got
    assert clean(spark, contract.correlation, {"status": "needs_review", "source": "me", "confidence": 0.25}) is None


def test_results_and_their_parts(spark):
    risk = {"asset_criticality": "high", "environment": "test", "sensitive_data": None, "requires_auth": True, "confidence": 0.5, "reason": "r", "evidence_ids": []}
    knowledge = {"description": "d", "reviewer": "me", "profile_revision": "r1", "business_processes": ["p"], "risk_context": risk, "hidden": 1}
    result = {"scan_plan": 1, "target": "t", "all_findings": [{"finding_id": 1}], "fixed_findings": 3, "findings_by_scanner": {"zap": [{"finding_id": 2, "meta": {"kev": 1}}]}, "asset_knowledge": knowledge, "ai_analysis_summary": {"status": "partial", "limit": -1, "cached_count": 2, "latency_ms": 1.23456, "estimated_cost_usd": None, "x": 1}}
    got = clean(spark, contract.sanitize_result, result)
    assert got["all_findings"] == [{"meta": {}}] and got["fixed_findings"] == [] and got["findings_by_scanner"] == {"zap": [{"meta": {}}]} and got["target"] == "t" and "scan_plan" not in got
    assert got["ai_analysis_summary"] == {"status": "partial", "cached_count": 2, "latency_ms": 1.235} and "hidden" not in got["asset_knowledge"] and got["asset_knowledge"]["risk_context"]["requires_auth"] is True
    assert clean(spark, contract.risk_context, risk | {"sensitive_data": "no"}) is None and clean(spark, contract.risk_context, {k: v for k, v in risk.items() if k != "sensitive_data"}) is None
    assert clean(spark, contract.sanitize_result, {"all_findings": []}) == {"all_findings": []}
    assert clean(spark, contract.sanitize_result, [1]) is None
