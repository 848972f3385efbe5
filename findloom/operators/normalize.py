"""From raw report rows to findings, one projection per scanner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.coerce import cve_ids, cvss_severity, first_value
from findloom.functions.text import says, strip_html
from findloom.functions.url import query_keys, remap_origin, web_target, with_target

# Words that tell a severity, in order.
NIKTO_WORDS = (
    ("critical", (
        "remote code execution",
        "code execution",
        "rce",
        "sql injection",
        "command injection",
        "authentication bypass",
        "auth bypass",
    )),
    ("high", (
        "xss",
        "cross-site scripting",
        "directory traversal",
        "path traversal",
        "file inclusion",
        "arbitrary file upload",
        "source disclosure",
    )),
    ("medium", (
        "default credentials",
        "default password",
        "outdated",
        "end of life",
        "unpatched",
        "misconfiguration",
        "information disclosure",
        "directory indexing",
        "admin interface",
        "backup",
        "debug",
    )),
    ("low", (
        "information",
        "header",
        "banner",
        "cookie",
        "version disclosure",
        "server leaks",
    )),
)
PAYLOAD_WORDS = (
    "payload",
    "inject",
    "exec",
    "command",
    "sql",
    "template",
    "traversal",
    "xss",
    "parameter ",
)
WAPITI_LEVELS = {"1": "low", "2": "medium", "3": "high", "4": "critical"}


def project(rows: DataFrame, name: Column, level: Column, asset: Column, description: Column, remediation: Column, **meta: Column) -> DataFrame:
    """Rows as findings; location fields of the metadata come from the asset unless given.

    The asset and its parts are columns of their own first: inlined, their expressions would repeat
    in every field.
    """
    staged, t = with_target(rows.withColumn("_asset", asset), F.col("_asset"))
    place = {"host": t["host"], "scheme": t["scheme"], "path": t["path"], "port": t["port"], "query_keys": query_keys(t["query"])}
    given = place | meta
    fields = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.META.fields]
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return staged.select(name.alias("vulnerability_name"), level.alias("severity"), F.col("_asset").alias("asset_id"), text(description).alias("description"), text(remediation).alias("remediation"), F.struct(*fields).alias("meta"))


def keyword_severity(text: Column, rules: tuple = NIKTO_WORDS) -> Column:
    out = F.lit("info")
    for level, words in reversed(rules):
        out = F.when(says(F.lower(text), words, whole=False), level).otherwise(out)
    return out


def nmap(rows: DataFrame) -> DataFrame:
    asset = F.concat_ws(":", "host", "port")
    title = F.coalesce(F.col("cve_id"), F.concat(F.col("script"), F.lit(" finding on "), F.col("service")))
    return project(
            rows, title, cvss_severity(F.col("cvss")), asset, F.col("output"), F.lit(""), scanner=F.lit("nmap"), host=F.col("host"), port=F.col("port").try_cast("int"), protocol=F.col("protocol"), service=F.col("service"),
            raw_id=F.coalesce("cve_id", "script"), cve_id=F.col("cve_id"), cve_ids=F.when(F.col("cve_id").isNotNull(), F.array("cve_id")), cvss_score=F.col("cvss"),
    )


def nuclei(rows: DataFrame, scanned: Column, origin: Column) -> DataFrame:
    at = remap_origin(first_value(F.col("`matched-at`"), F.col("matched")), scanned, origin)
    asset = F.coalesce(at, remap_origin(F.coalesce(F.col("host"), scanned), scanned, origin))
    ident = F.coalesce(F.col("`template-id`"), F.col("templateID"), F.lit("unknown"))
    info = F.col("info")
    refs = F.from_json(F.when(info["reference"].startswith("["), info["reference"]).otherwise(F.to_json(F.array(info["reference"]))), "array<string>")
    cves = cve_ids(info["classification"]["cve-id"], F.array_join(F.coalesce(refs, F.array().cast("array<string>")), " "))
    tags = F.split(F.regexp_replace(F.coalesce(info["tags"], F.lit("")), r'[\[\]"\s]', ""), ",")
    return project(rows, F.coalesce(info["name"], ident), schema.severity(info["severity"]), asset, info["description"], info["remediation"], scanner=F.lit("nuclei"), raw_id=ident, template_id=ident, cve_id=F.get(cves, F.lit(0)), cve_ids=cves, references=refs, tags=F.filter(tags, lambda t: t != ""))


def _joined(base: Column, path: Column) -> Column:
    return F.when(path.startswith("http"), path).when(F.coalesce(path, F.lit("")) == "", base).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def nikto(rows: DataFrame, scanned: Column, origin: Column) -> DataFrame:
    title = F.coalesce(first_value(F.col("msg"), F.col("description"), F.col("message")), F.lit("Nikto finding"))
    uri = remap_origin(F.coalesce(first_value(F.col("uri"), F.col("url")), F.lit("")), scanned, origin)
    words = F.concat_ws(" ", "msg", "description", "message")
    return project(rows, title, keyword_severity(words), _joined(web_target(origin), uri), first_value(F.col("description"), F.col("message"), F.col("msg")), first_value(F.col("remediation"), F.col("solution"), F.col("fix")), scanner=F.lit("nikto"), raw_id=first_value(F.col("OSVDB"), F.col("id")), method=F.col("method"), effective_target=scanned, original_target=origin)


def server_error(rows: DataFrame) -> Column:
    """null for other categories; else skip, low or strong for reported internal server errors."""
    text = F.lower(F.concat_ws(" ", "name", "description", "info", "category"))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    context = (has("path") | has("url")) & text.rlike("500|internal server error|http error")
    replay = has("http_request") | has("curl_command")
    strong = has("parameter") & replay & says(text, PAYLOAD_WORDS, whole=False)
    kind = F.when(~context, "skip").when(strong, "strong").when(has("parameter") | replay | has("method") | has("module"), "low").otherwise("skip")
    return F.when(F.lower(F.trim("category")) == "internal server error", kind)


def wapiti(rows: DataFrame, scanned: Column, origin: Column, levels: list[str] | None = None) -> DataFrame:
    kept = rows.withColumn("_error", server_error(rows)).filter("_error IS NULL OR _error <> 'skip'")
    raw = first_value(F.col("severity"), F.col("level"))
    level = F.when(F.col("_error") == "low", "low").otherwise(schema.severity(F.coalesce(F.try_element_at(schema.literal_map(WAPITI_LEVELS), raw), raw)))
    path = remap_origin(F.coalesce(first_value(F.col("path"), F.col("url")), F.lit("")), scanned, origin)
    refs = F.array_sort(F.array_distinct(F.map_values(F.col("classification.ref"))))
    confidence = F.when(F.col("_error") == "strong", "high").when(F.col("_error") == "low", "low")
    out = project(kept, F.coalesce("name", "category"), level, _joined(web_target(origin), path), first_value(F.col("description"), F.col("info")), first_value(F.col("remediation"), F.col("solution"), F.col("fix")), scanner=F.lit("wapiti"), category=F.col("category"), method=F.col("method"), parameter=F.col("parameter"), references=refs, confidence=confidence, effective_target=scanned, original_target=origin)
    return out.filter(F.col("severity").isin([s.lower() for s in levels])) if levels else out


def zap(rows: DataFrame, scanned: Column, origin: Column) -> DataFrame:
    """Only the first instance of an alert gives place, method and parameter."""
    first = F.get("instances", F.lit(0))
    asset = remap_origin(F.coalesce(first_value(first["uri"], first["url"], F.col("site_url")), scanned), scanned, origin)
    level = schema.severity(F.regexp_extract(F.coalesce(first_value(F.col("riskdesc"), F.col("risk")), F.lit("")), r"^\s*(\w+)", 1))
    cwe = F.when(F.col("cweid").rlike("^[0-9]+$"), F.concat(F.lit("CWE-"), F.col("cweid"))).otherwise(F.nullif(F.col("cweid"), F.lit("")))
    title = F.coalesce(first_value(F.col("name"), F.col("alert")), F.lit("ZAP finding"))
    return project(rows, title, level, asset, strip_html(F.coalesce("desc", title)), strip_html(F.coalesce(first_value(F.col("solution"), F.col("otherinfo")), F.lit(""))), scanner=F.lit("zap"), plugin_id=F.col("pluginid"), cwe=cwe, method=first["method"], parameter=first["param"], confidence=F.col("confidence"), references=F.array_compact(F.array("reference")), effective_target=scanned, original_target=origin)


NORMALIZERS = {"nmap": nmap, "nuclei": nuclei, "nikto": nikto, "wapiti": wapiti, "zap": zap}


def register(name: str, normalizer) -> None:
    """Add or replace a normalizer: raw rows to the columns of ``finding``."""
    NORMALIZERS[name] = normalizer
