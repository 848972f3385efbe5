"""What may leave the engine, on open payloads: a variant column per result, walked and rebuilt in the engine.

``forbidden_paths`` walks the places of a payload that hold findings, metadata and sources, level by level,
and names every field that must not be exported. ``sanitize_result`` rebuilds a payload without them, and
with the advisory parts only in the shape that their readers are promised: each is rebuilt from allowed
fields or dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import redact
from findloom.shared import cut

# Fields that are not exported, by where they stand.
FORBIDDEN = {
    "result": (
        "asset_criticality", "business_context", "discovery", "duplicate_analysis", "llm_duplicate_comparisons", "previous_findings", "scan_plan", "scanner_execution", "scanner_instances", "scoring_context",
        "target_probe", "target_probes", "transport_detected",
    ),
    "finding": (
        "asset_criticality", "business_context", "change_details", "comparison_match_reasons", "comparison_match_score", "comparison_mode", "comparison_uncertainty", "confidence_boost", "degraded_execution",
        "duplicate_count", "environment", "evidence_quality", "finding_id", "fp_general", "fp_host_only", "fp_strict", "impact_for_developers", "importance", "internet_exposed", "match_level", "merge_confidence",
        "normalized_name", "previous_match_id", "previous_values", "requires_auth", "sensitive_data", "status_info",
    ),
    "meta": (
        "business_context", "confirmation_scanners", "cve_intelligence_candidates", "cvss_score", "cvss_source", "cvss_vector", "cvss_version", "degraded_execution", "degraded_scanners", "duplicate_resolution_mode",
        "epss_percentile", "epss_score", "epss_source", "evidence_quality", "has_multi_scanner_confirmation", "kev", "kev_due_date", "kev_listed", "kev_source", "merged", "original_findings_count", "scanner_instance", "scanners",
    ),
    "source": ("comparison_mode", "degraded_execution", "finding_id", "fp_general", "fp_host_only", "fp_strict"),
}
# Where findings stand in a result, and the values of enumerated fields.
FINDING_LISTS = ("all_findings", "fixed_findings", "changed_findings", "partial_unmatched_current_findings", "partial_unmatched_previous_findings")
BY_SCANNER = "findings_by_scanner"
ANSWERED, UNANSWERED = ("completed", "cached"), ("unavailable", "skipped_limit")
APPLICABILITY = ("likely_false_positive", "valid_but_not_applicable", "likely_valid", "needs_review")
SUMMARY_STATUSES = ("completed", "partial", "disabled_not_configured", "disabled_by_user", "unavailable")
TRIAGE_STATUSES, TRIAGE_SCOPES = ("confirmed", "false_positive", "not_applicable", "needs_review"), ("finding", "site_vuln")
CRITICALITIES, ENVIRONMENTS = ("high", "medium", "low", "unknown"), ("production", "staging", "development", "test", "unknown")
PRIORITIES = ("P0", "P1", "P2", "P3", "P4")
COUNTS = (
    "limit", "selected_count", "analyzed_count", "cached_count", "unavailable_count", "skipped_limit_count", "needs_review_count", "priority_disagreement_count", "redaction_count", "prompt_tokens", "completion_tokens", "total_tokens",
)
ADVISORY = ("ai_analysis_status", "applicability", "ai_remediation", "ai_priority", "ai_summary")

#: Which place a field, or an element of a list, leads to.
_INTO = {("result", k): "findings" for k in FINDING_LISTS} | {("result", BY_SCANNER): "scanners", ("finding", "meta"): "meta", ("finding", "source_findings"): "sources", ("source", "meta"): "meta"}
_ELEMENT = {"findings": "finding", "sources": "source"}


def forbidden_paths(payloads: DataFrame, key: str, payload: str = "payload", deep: bool = False, keep=cut) -> DataFrame:
    """(key, path) of every field of ``payload`` (a variant) that must not be exported, such as ``all_findings[3].meta.kev``.

    One level a round: a field or element is followed only into a place that may hold forbidden fields,
    so texts are never opened. ``deep`` goes on through everything below metadata, to any depth, where
    its forbidden fields are named too. Payloads that are no objects, and null ones, have no paths.
    """
    level = payloads.select(key, F.lit("result").alias("place"), F.lit("").alias("path"), F.col(payload).alias("v"))
    found = []
    while True:
        names = F.col("e.key")
        step = level.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e")).filter("e.pos IS NOT NULL")
        into = reduce(lambda c, kv: c.when((F.col("place") == kv[0][0]) & (names == kv[0][1]), kv[1]), _INTO.items(), F.when(F.lit(False), ""))
        for a, b in _ELEMENT.items():
            into = into.when((F.col("place") == a) & names.isNull(), b)
        into = into.when((F.col("place") == "scanners") & names.isNotNull(), "findings")
        if deep:
            into = into.when(F.col("place") == "meta", "meta")
        path = F.when(names.isNull(), F.concat("path", F.lit("["), F.col("e.pos").cast("string"), F.lit("]"))).when(F.col("path") == "", names).otherwise(F.concat("path", F.lit("."), names))
        bad = reduce(lambda c, kv: c | ((F.col("place") == kv[0]) & names.isin(*kv[1])), FORBIDDEN.items(), F.lit(False))
        step = keep(step.select(key, into.alias("place"), path.alias("path"), F.coalesce(bad, F.lit(False)).alias("bad"), F.when(into.isNotNull(), F.col("e.value")).alias("v")).filter("bad OR place IS NOT NULL"))
        found.append(step.filter("bad").select(key, "path"))
        level = step.filter("place IS NOT NULL").select(key, "place", "path", "v")
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, found)


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _get(v: Column, field: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{field}", kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _map(v: Column) -> Column:
    """The fields of an object, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column, limit: int = 1000) -> Column:
    """A string without white space around it and of bounded length; empty for anything else."""
    return F.when(_kind(v) == "STRING", F.substring(F.regexp_replace(v.cast("string"), r"(?U)^\s+|\s+$", ""), 1, limit)).otherwise("")


def _number(v: Column) -> Column:
    return F.when(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), v.cast("double"))


def _whole(v: Column) -> Column:
    return F.when(_kind(v) == "BIGINT", v.cast("long"))


def _share(v: Column) -> Column:
    """A number from 0 to 1, else null."""
    return _once(_number(v), lambda n: F.when((n >= 0) & (n <= 1), n))


def _one_of(v: Column, values: tuple[str, ...]) -> Column:
    own = F.when(_kind(v) == "STRING", v.cast("string"))
    return F.when(own.isin(*values), own)


def _texts(v: Column, most: int = 5, limit: int = 500, least: int = 1) -> Column:
    """A list of ``least`` to ``most`` texts, none of them empty; else null."""
    def sound(items: Column) -> Column:
        fits = (F.size(items) >= least) & (F.size(items) <= most) & ~F.exists(items, lambda x: x == "")
        return F.when(F.coalesce(fits, F.lit(False)), items)

    return _once(F.transform(_list(v), lambda x: _text(x, limit)), sound)


def _exactly(v: Column, fields: tuple[str, ...]) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(_map(v))) == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))


def _whole_struct(v: Column, parts: dict[str, Column], optional: tuple[str, ...] = (), strict: bool = True) -> Column:
    """A struct of the parts if each is there (a text, or a value), and the object has just these fields; else null."""
    shaped = _exactly(v, tuple(parts)) if strict else _map(v).isNotNull()

    def sound(built: Column) -> Column:
        # a text is empty, anything else null, where it isn't as promised
        whole = [built[f].isNotNull() & (built[f].cast("string") != "") for f in parts if f not in optional]
        return F.when(F.coalesce(reduce(lambda a, b: a & b, whole), F.lit(False)), built)

    return F.when(shaped, _once(F.struct(*[p.alias(k) for k, p in parts.items()]), sound))


def applicability(v: Column) -> Column:
    return _whole_struct(v, {"status": _one_of(_get(v, "status"), APPLICABILITY), "confidence": _share(_get(v, "confidence")), "reason": _text(_get(v, "reason")), "evidence_ids": _texts(_get(v, "evidence_ids"), 20, 200)})


def remediation(v: Column) -> Column:
    return _whole_struct(v, {"steps": _texts(_get(v, "steps")), "verification": _texts(_get(v, "verification"))})


def priority(v: Column) -> Column:
    return _whole_struct(v, {
        "recommended_priority": _one_of(_get(v, "recommended_priority"), PRIORITIES), "confidence": _share(_get(v, "confidence")), "reason": _text(_get(v, "reason")), "evidence_ids": _texts(_get(v, "evidence_ids"), 20, 200),
        "context_revision": _text(_get(v, "context_revision"), 200),
    })


def summary(v: Column) -> Column:
    return _whole_struct(v, {"description": _text(_get(v, "description"), 1500), "business_impact": _text(_get(v, "business_impact")), "evidence_ids": _texts(_get(v, "evidence_ids"), 20, 200)})


def human_triage(v: Column) -> Column:
    """Status, scope, key, reviewer and time of a decision, or null; a comment and a revision where they are sound."""
    date = lambda f: F.when(_text(_get(v, f), 40).endswith("Z"), _text(_get(v, f), 40))
    revision = _whole(_get(v, "revision"))
    parts = {"status": _one_of(_get(v, "status"), TRIAGE_STATUSES), "scope": _one_of(_get(v, "scope"), TRIAGE_SCOPES), "key": _text(_get(v, "key"), 512), "reviewer": _text(_get(v, "reviewer"), 100), "decided_at": date("decided_at")}
    parts |= {"comment": F.nullif(_text(_get(v, "comment"), 2000), F.lit("")), "updated_at": date("updated_at"), "revision": F.when(revision >= 1, revision)}
    return _whole_struct(v, parts, ("comment", "updated_at", "revision"), strict=False)


def correlation(v: Column) -> Column:
    """What a decider said of a finding and its candidates, candidates in order of id, confidence and title; or null."""
    def candidate(c: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.filter(F.transform(_list(_get(c, "scanners")), lambda s: _text(s, 100)), lambda s: s != "")))
        return F.struct(_text(_get(c, "finding_id"), 200).alias("finding_id"), _share(_get(c, "confidence")).alias("confidence"), _text(_get(c, "canonical_title"), 500).alias("canonical_title"), _text(_get(c, "vulnerability_name"), 500).alias("vulnerability_name"), F.coalesce(names, F.array().cast("array<string>")).alias("scanners"), _text(_get(c, "reason")).alias("reason"))

    given = F.coalesce(_list(_get(v, "review_candidates")), F.array().cast("array<variant>"))
    sound = F.array_sort(F.filter(F.transform(F.filter(given, lambda c: _map(c).isNotNull()), candidate), lambda c: c["confidence"].isNotNull()))
    review = _get(v, "needs_review")
    truth = F.when(_kind(review) == "BOOLEAN", review.cast("boolean")).when(_kind(review) == "STRING", review.cast("string") != "").when(_number(review).isNotNull(), _number(review) != 0).otherwise(False)
    # a list or an object is true unless it is empty
    truth = F.when(F.size(F.coalesce(_list(review), F.map_values(_map(review)))) > 0, True).otherwise(truth)
    parts = {"status": _one_of(_get(v, "status"), ("merged", "needs_review")), "source": _one_of(_get(v, "source"), ("llm",)), "confidence": _share(_get(v, "confidence")), "reason": _text(_get(v, "reason")), "canonical_title": _text(_get(v, "canonical_title"), 500), "needs_review": truth, "review_candidates": sound}
    return _whole_struct(v, parts, ("reason", "canonical_title", "review_candidates"), strict=False)


def analysis_summary(v: Column) -> Column:
    """Counts and costs of an advisory run that are sound, of a known status; or null."""
    count = lambda f: F.when(_whole(_get(v, f)) >= 0, _whole(_get(v, f)))
    amount = lambda f, digits: F.when(_number(_get(v, f)) >= 0, F.round(_number(_get(v, f)), digits))
    some = lambda f, n: F.nullif(_text(_get(v, f), n), F.lit(""))
    parts = {"status": _one_of(_get(v, "status"), SUMMARY_STATUSES), "model": some("model", 200), "prompt_version": some("prompt_version", 100)} | {f: count(f) for f in COUNTS} | {"latency_ms": amount("latency_ms", 3), "estimated_cost_usd": amount("estimated_cost_usd", 8)}
    return _whole_struct(v, parts, tuple(f for f in parts if f != "status"), strict=False)


def risk_context(v: Column) -> Column:
    """The risk proposal of a site profile, with just its fields; or null."""
    flag = lambda f: F.when(_kind(_get(v, f)) == "BOOLEAN", _get(v, f).cast("boolean"))
    sound = lambda f: F.coalesce(_kind(_get(v, f)).isin("BOOLEAN", "VOID"), F.lit(False))
    parts = {"asset_criticality": _one_of(_get(v, "asset_criticality"), CRITICALITIES), "environment": _one_of(_get(v, "environment"), ENVIRONMENTS), "sensitive_data": flag("sensitive_data"), "requires_auth": flag("requires_auth"), "confidence": _share(_get(v, "confidence")), "reason": _text(_get(v, "reason"), 500)}
    parts["evidence_ids"] = _texts(_get(v, "evidence_ids"), 20, 200, least=0)
    built = _whole_struct(v, parts, ("sensitive_data", "requires_auth", "evidence_ids"))
    return F.when(sound("sensitive_data") & sound("requires_auth") & parts["evidence_ids"].isNotNull(), built)


def asset_knowledge(v: Column) -> Column:
    """What is shown of a site profile: description, reviewer and revision, and the optional parts that are sound; or null."""
    parts = {"description": _text(_get(v, "description")), "reviewer": _text(_get(v, "reviewer"), 100), "profile_revision": _text(_get(v, "profile_revision"), 128)}
    more = {"analysis_source": F.nullif(_text(_get(v, "analysis_source"), 50), F.lit("")), "business_processes": _texts(_get(v, "business_processes"), 5, 300), "risk_context": risk_context(_get(v, "risk_context"))}
    return _whole_struct(v, parts | more, tuple(more), strict=False)


def _object(fields: Column) -> Column:
    return F.to_variant_object(fields)


def _without(fields: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


_EMPTY = "cast(map() AS map<string,variant>)"


def sanitize_meta(v: Column) -> Column:
    return _object(F.coalesce(_without(_map(v), FORBIDDEN["meta"]), F.expr(_EMPTY)))


def _entry(name: str, value: Column, there: Column) -> Column:
    """A map of one field, or of none where it is not there."""
    return F.when(F.coalesce(there, F.lit(False)), F.create_map(F.lit(name), value)).otherwise(F.expr(_EMPTY))


def _found(v: Column, field: str, use) -> Column:
    """``use(field's value)``, a map, with the field looked up once; an empty map where it is not there."""
    return _once(_get(v, field), lambda own: F.when(own.isNotNull(), use(own)).otherwise(F.expr(_EMPTY)))


def _cleaned(v: Column, field: str, clean) -> Column:
    """A map of the field as ``clean`` leaves it, or of none."""
    return _found(v, field, lambda own: _once(clean(own), lambda c: _entry(field, _bare(c), c.isNotNull())))


def _bare(struct: Column) -> Column:
    """A struct as an object without its null fields."""
    return F.parse_json(F.to_json(struct))


def sanitize_source(v: Column) -> Column:
    fields = _without(_map(v), (*FORBIDDEN["source"], "meta"))
    return F.when(_map(v).isNotNull(), _object(F.map_concat(fields, F.create_map(F.lit("meta"), sanitize_meta(_get(v, "meta"))))))


def sanitize_finding(v: Column) -> Column:
    """One finding (a variant) as it may be exported; what is no object stays as it is.

    Secrets in its texts are redacted.
    """
    rebuilt = ("meta", "source_findings", "human_triage", "correlation", "description", "remediation", "asset_id", *ADVISORY)
    parts = [_without(_map(v), (*FORBIDDEN["finding"], *rebuilt)), F.create_map(F.lit("meta"), sanitize_meta(_get(v, "meta")))]
    for f in ("description", "remediation", "asset_id"):
        text = lambda own: F.when(_kind(own) == "STRING", F.parse_json(F.to_json(F.struct(redact(own.cast("string")).alias("x")))))
        parts.append(_found(v, f, lambda own, f=f, text=text: F.create_map(F.lit(f), F.coalesce(_get(text(own), "x"), own))))
    # sources that are no list stay as they are
    sources = lambda own: _object(F.filter(F.transform(_list(own), sanitize_source), lambda s: s.isNotNull()))
    parts.append(_found(v, "source_findings", lambda own: F.create_map(F.lit("source_findings"), F.coalesce(sources(own), own))))
    parts += [_cleaned(v, f, clean) for f, clean in (("human_triage", human_triage), ("correlation", correlation))]
    status = _get(v, "ai_analysis_status")
    answers = {"applicability": applicability, "ai_remediation": remediation, "ai_priority": priority, "ai_summary": summary}

    def answered(built: Column) -> Column:
        whole = reduce(lambda a, b: a & b, [built[f].isNotNull() for f in answers])
        return F.when(whole, F.map_concat(F.create_map(F.lit("ai_analysis_status"), status), *[F.create_map(F.lit(f), _bare(built[f])) for f in answers])).otherwise(F.expr(_EMPTY))

    said = F.struct(*[clean(_get(v, f)).alias(f) for f, clean in answers.items()])
    parts.append(F.when(_one_of(status, ANSWERED).isNotNull(), _once(said, answered)).otherwise(_entry("ai_analysis_status", status, _one_of(status, UNANSWERED).isNotNull())))
    return F.when(_map(v).isNotNull(), _object(F.map_concat(*parts))).otherwise(v)


def _sanitized_list(v: Column) -> Column:
    return _object(F.transform(F.coalesce(_list(v), F.array().cast("array<variant>")), sanitize_finding))


def sanitize_result(v: Column) -> Column:
    """A whole result (a variant) as it may be exported."""
    lists = [_entry(f, _sanitized_list(_get(v, f)), _get(v, f).isNotNull()) for f in FINDING_LISTS]
    by_scanner = _map(_get(v, BY_SCANNER))
    cleaned = _object(F.transform_values(by_scanner, lambda _, x: _sanitized_list(x)))
    special = (*FINDING_LISTS, BY_SCANNER, "ai_analysis_summary", "asset_knowledge")
    parts = [_without(_map(v), (*FORBIDDEN["result"], *special)), *lists, _entry(BY_SCANNER, F.coalesce(cleaned, _get(v, BY_SCANNER)), _get(v, BY_SCANNER).isNotNull())]
    parts += [_cleaned(v, f, clean) for f, clean in (("ai_analysis_summary", analysis_summary), ("asset_knowledge", asset_knowledge))]
    return F.when(_map(v).isNotNull(), _object(F.map_concat(*parts)))
