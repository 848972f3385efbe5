"""The finding schema: one explicit struct, rank tables and enumerations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Levels and their aliases.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_ALIASES = {
    "crit": "critical", "severe": "critical", "hi": "high", "important": "high", "med": "medium", "moderate": "medium", "warning": "medium",
    "lo": "low", "minor": "low", "informational": "info", "information": "info", "note": "info", "unknown": "info",
}
PRIORITIES = ("P0", "P1", "P2", "P3", "P4")
SCHEMA_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
MERGE_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SELECTION_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
TRIAGE_STATUSES = ("confirmed", "false_positive", "not_applicable", "needs_review")

_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BUSINESS = _struct(asset_criticality=_S, environment=_S, internet_exposed=T.BooleanType(), requires_auth=T.BooleanType(), sensitive_data=T.BooleanType())
_I, _D, _B = T.IntegerType(), T.DoubleType(), T.BooleanType()
CANDIDATE = _struct(cve_id=_S, cvss_score=_D, cvss_version=_S, cvss_vector=_S, cvss_source=_S, epss_score=_D, epss_percentile=_D, epss_source=_S, kev_listed=_B, kev_source=_S, kev_due_date=_S)
META = _struct(
    scanner=_S, host=_S, port=_I, scheme=_S, path=_S, query_keys=_L, parameter=_S, method=_S, protocol=_S, raw_id=_S, plugin_id=_S, template_id=_S,
    category=_S, service=_S, technology=_S, cve_id=_S, cve_ids=_L, cwe=_S, cwe_ids=_L, references=_L, tags=_L, confidence=_S,
    cvss_score=_D, cvss_v4_score=_D, epss_score=_D, epss_percentile=_D, kev_listed=_B, known_exploit=_B,
    degraded_execution=_B, adapter_mode=_S, effective_target=_S, original_target=_S, business_context=BUSINESS,
    risk=_S, module=_S, service_version=_S, matcher_name=_S, evidence=_S, http_request=_S, curl_command=_S,
    raw_ids=_L, paths=_L, parameters=_L, ports=T.ArrayType(_I), methods=_L, matcher_names=_L, evidence_examples=_L, http_request_examples=_L, curl_command_examples=_L,
    cvss_version=_S, cvss_vector=_S, cvss_source=_S, epss_source=_S, kev_source=_S, kev_due_date=_S, cve_intelligence_candidates=T.ArrayType(CANDIDATE),
    merged=_B, original_findings_count=_I, scanners=_L, has_multi_scanner_confirmation=_B, confirmation_scanners=_L, degraded_scanners=_L, match_level=_S, merged_lineage_ids=_L, duplicate_resolution_mode=_S,
)
SOURCE = _struct(finding_id=_S, scanner=_S, vulnerability_name=_S, severity=_S, asset_id=_S, description=_S, remediation=_S, degraded=_B, meta=META, fp_strict=_S, fp_general=_S, fp_host_only=_S)
FINDING = _struct(finding_id=_S, ord=T.LongType(), vulnerability_name=_S, severity=_S, asset_id=_S, description=_S, remediation=_S, meta=META, source_findings=T.ArrayType(SOURCE))


def conform(rows, kind: T.StructType = FINDING):
    """``rows`` with exactly the fields of ``kind``, those of structs too; what is missing is null."""
    return rows.select(*[_conformed(rows.schema, F.col, f).alias(f.name) for f in kind.fields], *[c for c in rows.columns if c not in kind.names])


def _conformed(have: T.StructType, get, field: T.StructField) -> Column:
    own = next((f for f in have.fields if f.name == field.name), None)
    if own is None or isinstance(own.dataType, T.NullType):
        return F.lit(None).cast(field.dataType)
    value, kind = get(field.name), field.dataType
    if isinstance(kind, T.StructType) and isinstance(own.dataType, T.StructType):
        if own.dataType == kind:
            return value
        inner = F.struct(*[_conformed(own.dataType, value.__getitem__, f).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and isinstance(own.dataType, T.ArrayType) and isinstance(own.dataType.elementType, T.StructType):
        inner = own.dataType.elementType
        return F.transform(value, lambda x: F.struct(*[_conformed(inner, x.__getitem__, f).alias(f.name) for f in kind.elementType.fields])).cast(kind)
    return value.cast(kind)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def severity(value: Column) -> Column:
    """Level of a severity label: trimmed, lower case, aliases resolved; empty or unknown is info."""
    low = F.lower(F.trim(value))
    known = SEVERITY_ALIASES | {s: s for s in SEVERITIES}
    return F.coalesce(F.try_element_at(literal_map(known), low), F.lit("info"))


def severity_rank(value: Column, ranks: dict[str, int] = SCHEMA_RANK) -> Column:
    """Rank of a level after alias mapping."""
    return F.element_at(literal_map(ranks), severity(value))
