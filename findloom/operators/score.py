"""Risk score and priority as one column expression; no shuffle.

Layers: technical severity, exploit likelihood, business context, evidence quality; then a cap for
low-signal findings, a floor for known exploitation, and a clamp to 0..100.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.coerce import criticality, environment, to_ints
from findloom.functions.text import bound, says
from findloom.operators.merge import source_degraded
from findloom.schema import literal_map

# Points, bounds, classes and patterns.
SEVERITY_POINTS = {"critical": 62, "high": 49, "medium": 30, "low": 12, "info": 2}
CRITICALITY_POINTS = {"high": 4, "medium": 2, "low": 0, "unknown": 0}
ENVIRONMENT_POINTS = {"production": 3, "staging": 0, "development": -3, "test": -2, "unknown": 0}
CONFIDENCE_POINTS = {"high": 0, "medium": -1, "low": -5, "unknown": -3}
EPSS_POINTS = ((0.85, 10), (0.60, 7), (0.30, 4), (0.10, 2), (0.01, 1))
PERCENTILE_POINTS = ((0.98, 2), (0.90, 1))
PRIORITY_FROM = (("P0", 85), ("P1", 65), ("P2", 45), ("P3", 25))
EXPLOIT_MOST, EXPLOIT_KNOWN, CVSS_FACTOR, LOW_SIGNAL_MOST, LOW_SIGNAL_CONTEXT = 12, 8, 6.5, 35, 12
#: Classes with boost, floor, CWE numbers and the phrases that name them.
CLASSES = (
    ("remote_code_execution", 18, 78, (77, 78, 88, 94), (
        "remote code execution",
        "rce",
        "command injection",
        "os command injection",
        "code injection",
        "shell injection",
    )),
    ("insecure_deserialization", 16, 74, (502,), (
        "insecure deserialization",
        "unsafe deserialization",
        "deserialization",
    )),
    ("server_side_template_injection", 16, 72, (1336,), (
        "server-side template injection",
        "server side template injection",
        "serverside template injection",
        "ssti",
    )),
    ("sql_injection", 14, 60, (89, 564), (
        "sql injection",
        "sqli",
    )),
    ("authentication_bypass", 14, 60, (287, 306, 862, 863), (
        "authentication bypass",
        "authorization bypass",
        "auth bypass",
        "auth-bypass",
        "authbypass",
        "login bypass",
        "access control bypass",
    )),
    ("server_side_request_forgery", 12, 56, (918,), (
        "server-side request forgery",
        "server side request forgery",
        "serverside request forgery",
        "ssrf",
    )),
    ("xml_external_entity", 12, 56, (611,), (
        "xml external entity",
        "xxe",
    )),
    ("path_traversal", 12, 54, (22, 23, 35, 36, 73), (
        "path traversal",
        "directory traversal",
        "local file inclusion",
        "lfi",
        "arbitrary file read",
        "file disclosure",
    )),
    ("credential_exposure", 12, 54, (259, 312, 522, 798), (
        "credential exposure",
        "exposed credential",
        "exposed credentials",
        "hardcoded credential",
        "hardcoded credentials",
        "secret exposure",
        "api key exposure",
        "password disclosure",
        "token disclosure",
    )),
)
#: Response headers that harden a site.
HARDENING_HEADERS = (
    "strict-transport-security",
    "content-security-policy",
    "x-frame-options",
    "x-content-type-options",
    "referrer-policy",
    "permissions-policy",
)
#: Findings that say little; a header's own name is put in place of {header}.
LOW_SIGNAL = (
    ("missing_hardening_header", (
        "missing security header",
        "header missing",
        "missing {header}",
        "missing the {header}",
        "{header} header missing",
    )),
    ("header_or_banner_disclosure", (
        "server header",
        "x-powered-by",
        "server version",
        "version disclosure",
        "banner disclosure",
        "technology stack disclosure",
    )),
    ("cookie_hardening_flag", (
        "cookie without httponly",
        "cookie without secure",
        "missing httponly",
        "missing secure flag",
        "samesite missing",
        "samesite is missing",
        "samesite attribute missing",
        "samesite attribute is missing",
    )),
)
#: Hosts that are internal.
INTERNAL_NAMES = ("localhost",)
INTERNAL_SUFFIXES = (".local", ".internal", ".lan")
INTERNAL_PREFIXES = ("127.", "10.", "192.168.", *(f"172.{i}." for i in range(16, 32)), "fe80:")
#: Phrases on whether a login is needed.
OPEN_TEXT = (
    "unauthenticated",
    "without authentication",
    "no authentication required",
    "authentication not required",
    "pre-auth",
    "pre auth",
    "anonymous",
)
LOGIN_TEXT = (
    "authenticated",
    "after login",
    "requires login",
    "requires authentication",
    "post-auth",
    "post auth",
    "authenticated user",
)
#: What references to public exploits hold, anywhere or as whole words, and the last part of a repository's address.
EXPLOIT_SITES = ("exploit-db", "exploitdb", "metasploit", "packetstorm")
EXPLOIT_PHRASES = ("public exploit", "proof-of-concept exploit", "proof of concept exploit", "poc exploit")
EXPLOIT_REPOSITORY = ("exploit", "proof-of-concept", "proof_of_concept", "poc-exploit", "poc_exploit")


def _steps(value: Column, steps: tuple) -> Column:
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def cvss_points(score: Column) -> Column:
    """Half-even rounding."""
    return F.bround(score * F.lit(CVSS_FACTOR), 0).cast("int")


def exploit_points(score: Column, percentile: Column, known: Column) -> Column:
    base = F.when(score.isNotNull(), _steps(score, EPSS_POINTS)).when(percentile >= 0.75, 1).otherwise(0)
    points = F.least(F.lit(EXPLOIT_MOST), base + _steps(percentile, PERCENTILE_POINTS))
    return F.when(F.coalesce(known, F.lit(False)), F.greatest(points, F.lit(EXPLOIT_KNOWN))).otherwise(points)


def priority(score: Column) -> Column:
    out = F.lit("P4")
    for name, least in reversed(PRIORITY_FROM):
        out = F.when(score >= least, name).otherwise(out)
    return out


def internet_exposed(asset: Column) -> Column:
    """False for hosts that look internal. IPv6 loopback and link-local addresses count as internal."""
    low = F.lower(F.trim(F.coalesce(asset, F.lit(""))))
    host = lambda rest: F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).when(rest.rlike(r"^[^/]*:[^/]*:"), F.regexp_extract(rest, r"^([^/]*)", 1)).otherwise(F.regexp_extract(rest, r"^([^/:]*)", 1))
    # the host is compared with some thirty values, so it is worked out before
    internal = bound(bound(F.regexp_replace(low, r"^[a-z][a-z0-9+.-]*://", ""), host), _internal)
    return F.when(low == "", False).otherwise(~internal)


def _internal(host: Column) -> Column:
    tests = [F.contains(host, F.lit(n)) for n in INTERNAL_NAMES] + [host.endswith(x) for x in INTERNAL_SUFFIXES] + [host.startswith(x) for x in INTERNAL_PREFIXES]
    return reduce(lambda a, b: a | b, tests, host == "::1")


def text_blob(name: Column, description: Column, *more: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (name, description, *more)]))


def vulnerability_class(text: Column, cwes: Column) -> Column:
    """Struct id, boost, floor of the first rule that the CWE numbers or the text meet."""
    make = lambda i, b, f: F.struct(F.lit(i).alias("id"), F.lit(b).alias("boost"), F.lit(f).alias("floor"))
    out = make("generic_issue", 0, 0)
    for ident, boost, floor, numbers, phrases in reversed(CLASSES):
        out = F.when(F.arrays_overlap(cwes, F.array(*map(F.lit, numbers))) | says(text, phrases), make(ident, boost, floor)).otherwise(out)
    return out


def low_signal(text: Column) -> Column:
    """The low-signal rule that the text meets, or null."""
    out = F.lit(None).cast("string")
    for ident, phrases in reversed(LOW_SIGNAL):
        spelled = tuple(p.format(header=h) for p in phrases for h in (HARDENING_HEADERS if "{header}" in p else ("",)))
        out = F.when(says(text, spelled), ident).otherwise(out)
    return out


def requires_auth(flag: Column, description: Column) -> Column:
    low = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(flag, F.when(says(low, OPEN_TEXT), False).otherwise(says(low, LOGIN_TEXT)))


def known_exploit(flag: Column, references: Column) -> Column:
    every = F.lower(F.array_join(F.coalesce(references, F.array().cast("array<string>")), " "))
    repository = F.exists(F.split(every, r"\s+"), lambda r: F.contains(r, F.lit("github.com/")) & says(F.substring_index(r, "github.com/", -1), EXPLOIT_REPOSITORY, whole=False))
    return F.coalesce(flag, F.lit(False)) | says(every, EXPLOIT_SITES, whole=False) | says(every, EXPLOIT_PHRASES) | repository


def technical_points(cvss: Column, level: Column, cls: Column) -> Column:
    base = F.coalesce(F.try_element_at(literal_map(SEVERITY_POINTS), level), F.lit(2)) + cls["boost"]
    return F.when(cvss.isNotNull(), cvss_points(cvss) + cls["boost"]).otherwise(F.greatest(base, cls["floor"]))


def business_points(exposed: Column, auth: Column, level: Column, env: Column, sensitive: Column) -> Column:
    reach = clamp(F.when(exposed, 6).otherwise(0) + F.when(auth, -6).otherwise(0), -6, 6)
    impact = F.element_at(literal_map(CRITICALITY_POINTS), criticality(level)) + F.element_at(literal_map(ENVIRONMENT_POINTS), environment(env)) + F.when(sensitive, 4).otherwise(0)
    return clamp(reach + clamp(impact, -3, 10), -6, 16)


def evidence_points(confidence: Column, repeatable: Column, any_degraded: Column, all_degraded: Column) -> Column:
    """An unstated confidence counts nothing; degraded evidence lowers it and withholds the bonus."""
    stated = F.lower(F.trim(confidence))
    label = F.when(all_degraded, "low").when(any_degraded & (stated == "high"), "medium").otherwise(stated)
    points = F.when(label.isNull(), 0).otherwise(F.coalesce(F.try_element_at(literal_map(CONFIDENCE_POINTS), label), F.lit(-3)))
    return clamp(points + F.when(repeatable & ~all_degraded, 4).otherwise(0) + F.when(all_degraded, -4).when(any_degraded, -2).otherwise(0), -10, 4)


def final_score(points: Column, signal: Column, known: Column, kev: Column, floor: Column) -> Column:
    capped = F.when(signal.isNotNull() & ~kev & ~known, F.least(points, F.lit(LOW_SIGNAL_MOST))).otherwise(points)
    return clamp(F.when(kev, F.greatest(capped, floor)).otherwise(capped), 0, 100)


def with_repeatable(findings: DataFrame, previous: DataFrame | None, keys: tuple[str, str] = ("fp_strict", "fp_general")) -> DataFrame:
    """``findings`` with ``repeatable``: the earlier run has the same strict key, or, where either side has none, the same general key."""
    if previous is None:
        return findings.withColumn("repeatable", F.lit(False))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    strict, general = keys
    one = previous.filter(~blank(strict)).select(F.col(strict).alias("_s")).distinct()
    earlier = previous.filter(~blank(general)).groupBy(F.col(general).alias("_g")).agg(F.max(blank(strict)).alias("_open"))
    out = findings.join(one, F.col(strict) == F.col("_s"), "left").join(earlier, F.col(general) == F.col("_g"), "left")
    again = F.when(blank(strict), F.col("_g").isNotNull()).otherwise(F.col("_s").isNotNull() | F.coalesce("_open", F.lit(False)))
    return out.withColumn("repeatable", again).drop("_s", "_g", "_open")


def cvss_info(meta: Column) -> Column:
    """Struct score and version: version 4 before 3.1; a plain score is 4.0 if its version or vector says so."""
    hint = F.trim(F.coalesce(meta["cvss_version"], F.lit("")))
    four = hint.isin("4", "4.0") | F.coalesce(meta["cvss_vector"].startswith("CVSS:4.0"), F.lit(False))
    fit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))
    make = lambda x, v: F.struct(fit(x).alias("score"), v.alias("version"))
    return F.when(meta["cvss_v4_score"].isNotNull(), make(meta["cvss_v4_score"], F.lit("4.0"))).when(meta["cvss_score"].isNotNull(), make(meta["cvss_score"], F.when(four, "4.0").otherwise("3.1")))


def confidence_label(value: Column) -> Column:
    """high, medium or low, from a label or a number from 0 to 3; null if unstated, unknown otherwise."""
    low = F.lower(F.trim(value))
    number = low.try_cast("double")
    by_number = F.when(number >= 3, "high").when(number >= 2, "medium").when(number >= 0, "low")
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(None)).when(low.isin("high", "confirmed", "certain", "firm"), "high").when(low == "medium", "medium").when(low.isin("low", "tentative"), "low").otherwise(F.coalesce(by_number, F.lit("unknown")))


def rationale(factors: Column) -> Column:
    """One line of text on how a score came about."""
    part = lambda k: F.concat(F.lit(f"{k} "), factors[k].cast("string"))
    return F.concat_ws("; ", *[part(k) for k in ("technical", "exploit", "business", "evidence")], F.when(factors["vulnerability_class"] != "generic_issue", F.concat(F.lit("class "), factors["vulnerability_class"])), F.when(factors["signal"].isNotNull(), F.concat(F.lit("low signal: "), factors["signal"])), F.when(factors["kev"], F.lit("known to be exploited")))


def score(findings: DataFrame, previous: DataFrame | None = None, keys: tuple[str, str] = ("fp_strict", "fp_general")) -> DataFrame:
    """``findings`` with risk_score, priority and risk_factors.

    ``previous`` holds the keys of an earlier run: a finding found again is repeatable.
    """
    m, b = F.col("meta"), F.col("meta.business_context")
    out = with_repeatable(findings, previous, keys)
    sources = F.coalesce(F.col("source_findings"), F.array().cast(findings.schema["source_findings"].dataType))
    own = F.coalesce(m["degraded_execution"], F.lit(False))
    any_degraded = own | F.exists(sources, source_degraded)
    all_degraded = F.when(F.size(sources) > 0, F.forall(sources, source_degraded)).otherwise(own)
    text = text_blob(F.col("vulnerability_name"), F.col("description"), m["raw_id"], m["cwe"], F.array_join(F.coalesce(m["references"], F.array().cast("array<string>")), " "))
    cwes = to_ints(F.concat_ws(" ", m["cwe"], m["cwe_ids"]))
    out = out.withColumns({"_text": text, "_cwes": cwes})
    out = out.withColumns({"_class": vulnerability_class(F.col("_text"), F.col("_cwes")), "_cvss": cvss_info(m)["score"], "_known": known_exploit(m["known_exploit"], m["references"]), "_any": any_degraded, "_all": all_degraded})
    out = out.withColumn("_exposed", F.coalesce(b["internet_exposed"], internet_exposed(F.coalesce(F.nullif(F.col("asset_id"), F.lit("")), m["host"])))).withColumn("_signal", F.when(F.col("_cvss").isNull() & (F.col("_class.id") == "generic_issue"), low_signal(F.col("_text"))))
    kev = F.coalesce(m["kev_listed"], F.lit(False))
    sensitive = F.coalesce(b["sensitive_data"], F.lit(False))
    business = business_points(F.col("_exposed"), requires_auth(b["requires_auth"], F.col("description")), b["asset_criticality"], b["environment"], sensitive)
    weak = F.col("_cvss").isNull() & (F.col("_class.id") == "generic_issue") & F.col("severity").isin("low", "info")
    out = out.withColumns(
        {
            "_technical": technical_points(F.col("_cvss"), F.col("severity"), F.col("_class")),
            "_exploit": exploit_points(m["epss_score"], m["epss_percentile"], F.col("_known")),
            "_business": F.when(weak, F.least(business, F.lit(LOW_SIGNAL_CONTEXT))).otherwise(business),
            "_evidence": evidence_points(m["confidence"], F.col("repeatable"), F.col("_any"), F.col("_all")),
            "_floor": F.when(F.col("_exposed") | ((criticality(b["asset_criticality"]) == "high") & (environment(b["environment"]) == "production")), 85).otherwise(70),
        }
    )
    total = F.col("_technical") + F.col("_exploit") + F.col("_business") + F.col("_evidence")
    out = out.withColumn("risk_score", final_score(total, F.col("_signal"), F.col("_known"), kev, F.col("_floor")))
    factors = F.struct(*[F.col(f"_{k}").alias(k) for k in ("technical", "exploit", "business", "evidence")], F.col("_class.id").alias("vulnerability_class"), F.col("_signal").alias("signal"), kev.alias("kev"))
    return out.withColumns({"priority": priority(F.col("risk_score")), "risk_factors": factors}).drop(*[c for c in out.columns if c.startswith("_")])
