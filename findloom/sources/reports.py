"""Scanner reports as DataFrames, one raw row per reported item; offline, from files.

Every reader gives an explicit schema, so no pass over the data infers one. Documents of one JSON or
XML value per file are read whole, one row per file, and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEXT = "string"
NUCLEI = (
    "`template-id` string, templateID string, host string, `matched-at` string, matched string, "
    "info struct<name:string, severity:string, description:string, remediation:string, reference:string, tags:string, classification:struct<`cve-id`:string, `cwe-id`:string, `cvss-score`:double>>"
)
NIKTO_ITEM = "struct<msg:string, description:string, message:string, uri:string, url:string, method:string, OSVDB:string, remediation:string, solution:string, fix:string, id:string, references:string>"
NIKTO = f"vulnerabilities array<{NIKTO_ITEM}>, items array<{NIKTO_ITEM}>, scans array<struct<vulnerabilities:array<{NIKTO_ITEM}>, items:array<{NIKTO_ITEM}>>>, target string"
WAPITI_ITEM = "struct<name:string, severity:string, level:string, path:string, url:string, description:string, info:string, remediation:string, solution:string, fix:string, module:string, method:string, parameter:string, http_request:string, curl_command:string, wstg:string, _category:string>"
WAPITI_PARTS = ("vulnerabilities", "anomalies", "additionals", "infos")
ZAP_ALERT = "struct<name:string, alert:string, risk:string, riskdesc:string, desc:string, solution:string, otherinfo:string, confidence:string, pluginid:string, cweid:string, wascid:string, reference:string, instances:array<struct<uri:string, url:string, method:string, param:string, evidence:string>>>"
NMAP = (
    "struct<host:array<struct<address:array<struct<_addr:string,_addrtype:string>>, ports:struct<port:array<struct<_portid:string,_protocol:string,state:struct<_state:string>,"
    "service:struct<_name:string,_version:string,_product:string,_extrainfo:string,_tunnel:string>,script:array<struct<_id:string,_output:string>>>>>>>>"
)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; bad lines are left out, or raise when ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row per element of the tag."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def json_records(files: DataFrame, schema: str, key: str = "records") -> DataFrame:
    """Records of a list, of an object's ``records``, or one single object."""
    many = F.from_json("text", f"array<struct<{schema}>>")
    held = F.from_json("text", f"struct<`{key}`:array<struct<{schema}>>>")[key]
    one = F.array(F.from_json("text", f"struct<{schema}>"))
    start = F.substring(F.ltrim("text"), 1, 1)
    return files.select("file", F.explode(F.when(start == "[", many).otherwise(F.coalesce(held, one))).alias("r")).select("file", "r.*")


def cve_records(files: DataFrame, fields: str = "struct<cve:string, cve_id:string, cveID:string, id:string, score:string, epss:string, percentile:string, cvss_score:string, baseScore:string, source:string, dueDate:string>") -> DataFrame:
    """Feed entries of a list, of vulnerabilities, items or records, of a map keyed by CVE, or one object."""
    start = F.substring(F.ltrim("text"), 1, 1)
    named = [F.get_json_object("text", f"$.{k}") for k in ("vulnerabilities", "items", "records")]
    listed = F.from_json(F.when(start == "[", F.col("text")).otherwise(F.coalesce(*named)), f"array<{fields}>")
    by_key = F.map_filter(F.from_json("text", f"map<string,{fields}>"), lambda k, v: k.rlike(r"(?i)^CVE-[0-9]{4}-[0-9]{4,7}$"))
    keyed = F.transform(F.map_entries(by_key), lambda e: e["value"].withField("cve_id", F.coalesce(e["value"]["cve_id"], e["key"])))
    single = F.array(F.from_json("text", fields))
    every = F.when(listed.isNotNull(), listed).when(F.size(keyed) > 0, keyed).otherwise(single)
    return files.select("file", F.posexplode(every).alias("ord", "r")).select("file", "ord", "r.*")


def nmap_services(files: DataFrame, target: Column) -> DataFrame:
    """One row per open port, with its scripts; the address falls back to the target."""
    ports = _nmap_ports(files, target).filter("p.state._state = 'open'")
    s = F.col("p.service")
    name, text = F.coalesce(s["_name"], F.lit("unknown")), lambda f: F.coalesce(s[f], F.lit(""))
    return ports.select(
        "file", "host", F.col("p._portid").try_cast("int").alias("port"), F.coalesce("p._protocol", F.lit("tcp")).alias("protocol"), name.alias("service"),
        text("_product").alias("product"), text("_version").alias("version"), text("_extrainfo").alias("extrainfo"), text("_tunnel").alias("tunnel"), web_scheme(name, text("_tunnel"), text("_product"), text("_extrainfo")).alias("web_scheme"),
    )


def _nmap_ports(files: DataFrame, target: Column) -> DataFrame:
    hosts = files.select("file", F.explode(F.from_xml("text", NMAP)["host"]).alias("h"))
    return hosts.select("file", F.coalesce(F.get("h.address", F.lit(0))["_addr"], target).alias("host"), F.explode("h.ports.port").alias("p"))


def nmap_findings(files: DataFrame, target: Column) -> DataFrame:
    """One row per script result; the vulners script gives one per CVE line."""
    rows = _nmap_ports(files, target).select("file", "host", F.coalesce("p._portid", F.lit("unknown")).alias("port"), F.coalesce("p._protocol", F.lit("tcp")).alias("protocol"), F.coalesce("p.service._name", F.lit("unknown")).alias("service"), F.coalesce("p.service._version", F.lit("")).alias("service_version"), F.explode("p.script").alias("s"))
    rows = rows.select("*", F.col("s._id").alias("script"), F.coalesce("s._output", F.lit("")).alias("output")).drop("s")
    cves = vulners_lines(rows.filter("script = 'vulners'"))
    plain = rows.filter("script <> 'vulners' AND trim(output) <> ''").withColumns({"cve_id": F.lit(None).cast("string"), "cvss": F.lit(None).cast("double")})
    return cves.unionByName(plain)


def vulners_lines(rows: DataFrame) -> DataFrame:
    """Lines that start with a CVE id; the second word is the score."""
    line = rows.withColumn("w", F.explode(F.transform(F.split("output", "\n"), lambda x: F.split(F.trim(x), r"\s+")))).filter(F.get("w", F.lit(0)).startswith("CVE-"))
    return line.withColumns({"cve_id": F.get("w", F.lit(0)), "cvss": F.get("w", F.lit(1)).try_cast("double")}).drop("w")


def web_scheme(service: Column, tunnel: Column, product: Column, extra: Column) -> Column:
    """http, https or empty, from what the service calls itself."""
    name, words = F.lower(F.trim(service)), F.lower(F.concat_ws(" ", service, product, extra))
    ssl = F.lower(F.trim(tunnel)) == "ssl"
    tokens = F.split(words, r"[^a-z0-9]+")
    return (
        F.when(ssl & (F.contains(words, F.lit("http")) | (F.trim(words) == "")), "https").when(F.contains(name, F.lit("https")) | F.contains(name, F.lit("ssl/http")), "https").when(F.contains(name, F.lit("http")), "http")
        .when(F.array_contains(tokens, "https"), "https").when(F.array_contains(tokens, "http"), "http").otherwise("")
    )


def nikto_items(files: DataFrame) -> DataFrame:
    """Items of an object, of its scans, or of a list of such."""
    none = F.array().cast(f"array<{NIKTO_ITEM}>")
    one = F.from_json("text", f"struct<{NIKTO}>")
    many = F.when(F.ltrim("text").startswith("["), F.from_json("text", f"array<struct<{NIKTO}>>")).otherwise(F.array(one))
    own = lambda x: F.concat(F.coalesce(x["vulnerabilities"], none), F.coalesce(x["items"], none))
    scans = lambda x: F.flatten(F.transform(F.coalesce(x["scans"], F.array().cast(f"array<struct<vulnerabilities:array<{NIKTO_ITEM}>, items:array<{NIKTO_ITEM}>>>")), own))
    return files.select("file", F.explode(F.flatten(F.transform(many, lambda x: F.concat(own(x), scans(x))))).alias("r")).select("file", "r.*")


def _tagged(entry: Column) -> Column:
    return F.transform(entry["value"], lambda v: F.struct(entry["key"].alias("category"), v.alias("v")))


def wapiti_items(files: DataFrame) -> DataFrame:
    """Items of four containers, each a map of lists or a list, tagged with category and type."""
    parts = []
    for part in WAPITI_PARTS:
        body = F.get_json_object("text", f"$.{part}")
        by_key = F.flatten(F.transform(F.map_entries(F.from_json(body, f"map<string,array<{WAPITI_ITEM}>>")), _tagged))
        listed = F.transform(F.from_json(body, f"array<{WAPITI_ITEM}>"), lambda v: F.struct(F.coalesce(v["_category"], F.lit("Generic")).alias("category"), v.alias("v")))
        every = F.when(F.ltrim(body).startswith("["), listed).otherwise(by_key)
        parts.append(files.select("file", F.lit(part).alias("kind"), F.explode(every).alias("e")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    classes = files.select(F.col("file").alias("f"), F.from_json(F.get_json_object("text", "$.classifications"), "map<string,struct<desc:string,sol:string,ref:map<string,string>>>").alias("classes"))
    out = out.join(classes, F.col("file") == F.col("f"), "left")
    return out.select("file", "kind", "e.category", "e.v.*", F.try_element_at("classes", F.col("e.category")).alias("classification")).drop("_category")


def zap_alerts(files: DataFrame) -> DataFrame:
    """Alerts of each site, or of one site given as an object, tagged with its address."""
    body = F.get_json_object("text", "$.site")
    site = f"struct<`@name`:string, name:string, alerts:array<{ZAP_ALERT}>>"
    sites = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{site}>")).otherwise(F.array(F.from_json(body, site)))
    return files.select("file", F.explode(sites).alias("s")).select("file", F.coalesce("s.@name", "s.name").alias("site_url"), F.explode("s.alerts").alias("a")).select("file", "site_url", "a.*")


def target_runs(runs: DataFrame, slug: str) -> DataFrame:
    """Run partitions of a slug whose name is a time, newest first. ``runs(target_slug, run_ts)``."""
    valid = F.col("run_ts").rlike(r"^[0-9]{8}_[0-9]{6}$") & F.try_to_timestamp("run_ts", F.lit("yyyyMMdd_HHmmss")).isNotNull()
    return runs.filter((F.col("target_slug") == slug) & valid).orderBy(F.desc("run_ts"))


def preferred_artifacts(files: DataFrame, order: list[str]) -> DataFrame:
    """Per run the artifact that comes first in the order. ``files(run_ts, name, path)``."""
    from findloom.operators.enrich import latest_by

    place = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    return latest_by(files.filter(F.col("name").isin(order)), ["run_ts"], [place])
