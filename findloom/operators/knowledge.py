"""The knowledge store: original findings as records by scanner and source id, kept up to date by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.coerce import first_value, stable_hash
from findloom.operators.context import none, one, texts

#: The content of a record; times of the sync are no part of it.
FIELDS = ("scanner_name", "source_vulnerability_id", "title", "description", "severity", "cvss", "cve_list", "cwe_list", "category", "remediation", "references", "technology", "affected_target_type")


def original_findings(findings: DataFrame) -> DataFrame:
    """Merged findings taken apart into their sources; others as they are."""
    own = F.struct(*[F.col(f) for f in ("finding_id", "vulnerability_name", "severity", "asset_id", "description", "remediation", "meta")])
    each = F.when(F.size(F.coalesce("source_findings", F.array().cast(f"array<{schema.SOURCE.simpleString()}>"))) > 0, F.transform("source_findings", lambda s: F.struct(*[s[f].alias(f) for f in ("finding_id", "vulnerability_name", "severity", "asset_id", "description", "remediation", "meta")]))).otherwise(F.array(own))
    return findings.select(F.col("ord"), F.posexplode(each).alias("nth", "f")).select("ord", "nth", "f.*")


def target_type(meta: Column) -> Column:
    """web_endpoint, network_service or host, by what the metadata says of the place."""
    some = lambda *names: F.coalesce(*[F.nullif(meta[n].cast("string"), F.lit("")) for n in names]).isNotNull()
    return F.when(some("path", "parameter", "scheme"), "web_endpoint").when(some("service", "port", "protocol"), "network_service").otherwise("host")


#: Adapters by scanner: the fields of which the first given is the source id, those that joined stand in
#: for it, and those of category and technology. Others use "".
ADAPTERS: dict[str, dict[str, tuple[str, ...]]] = {
    "": {"id": ("plugin_id", "template_id", "raw_id", "cve_id"), "joined": (), "category": ("category",), "technology": ("service", "technology")},
}


def register_adapter(scanner: str, **fields: tuple[str, ...]) -> None:
    """Use own fields for a scanner; those left out are the general ones."""
    ADAPTERS[scanner.lower()] = ADAPTERS[""] | fields


register_adapter("nuclei", category=("tags", "category"))
register_adapter("zap", id=("plugin_id", "raw_id"), category=("cwe", "risk"))
register_adapter("wapiti", id=("raw_id",), joined=("category", "module"), category=("category", "module"))
register_adapter("nikto", category=())
register_adapter("nmap", id=("cve_id", "raw_id"), category=("service", "protocol"), technology=("service", "service_version"))


def _adapted(what: str, scanner: Column, meta: Column) -> Column:
    field = lambda n: F.get(meta[n], F.lit(0)) if n == "tags" else meta[n]

    def pick(names: tuple[str, ...]) -> Column:
        if what == "joined":
            return F.nullif(F.concat_ws("::", *[F.nullif(F.trim(field(n)), F.lit("")) for n in names]), F.lit(""))
        return first_value(*[field(n) for n in names], F.lit(None).cast("string"))

    out = pick(ADAPTERS[""][what])
    for name, fields in ADAPTERS.items():
        if name:
            out = F.when(scanner == name, pick(fields[what])).otherwise(out)
    return out


def records(originals: DataFrame) -> DataFrame:
    """One knowledge record per original finding, with its content hash."""
    m = F.col("meta")
    scanner = F.lower(F.trim(F.coalesce(m["scanner"], F.lit("generic"))))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    lists = lambda first, rest: F.array_distinct(texts(one(m[first]), m[rest]))
    rows = originals.withColumn("scanner_name", scanner)
    source = F.coalesce(*[_adapted(what, F.col("scanner_name"), m) for what in ("id", "joined")])
    derived = F.concat(F.lit("derived-"), stable_hash(F.col("scanner_name"), F.col("vulnerability_name"), m["category"], m["module"], m["service"], m["path"]))
    rows = rows.select(
        "ord", "nth", "scanner_name", F.coalesce(F.trim(source), derived).alias("source_vulnerability_id"), text("vulnerability_name").alias("title"), text("description").alias("description"), F.lower(F.coalesce(F.nullif(text("severity"), F.lit("")), F.lit("info"))).alias("severity"),
        m["cvss_score"].alias("cvss"), lists("cve_id", "cve_ids").alias("cve_list"), lists("cwe", "cwe_ids").alias("cwe_list"), F.trim(_adapted("category", F.col("scanner_name"), m)).alias("category"), text("remediation").alias("remediation"),
        F.array_distinct(texts(F.coalesce(m["references"], none()))).alias("references"), F.trim(_adapted("technology", F.col("scanner_name"), m)).alias("technology"), target_type(m).alias("affected_target_type"),
    )
    return rows.withColumn("content_hash", content_hash())


def content_hash() -> Column:
    """Hash of a record's content."""
    return F.sha2(F.to_json(F.struct(*FIELDS)), 256)


def sync(store: DataFrame, incoming: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The store after the sync and one line per scanner of the run log.

    ``incoming`` is of ``records``. Of several records of one key the last counts; the earlier ones are
    counted as updates, or as skipped if their content is that of the one before. created_at stays.
    """
    from pyspark.sql import Window

    keys = ["scanner_name", "source_vulnerability_id"]
    old = store.select(*keys, F.col("content_hash").alias("_old"), "created_at")
    w = Window.partitionBy(*keys).orderBy("ord", "nth")
    seen = incoming.join(old, keys, "left").withColumn("_before", F.coalesce(F.lag("content_hash").over(w), F.col("_old")))
    action = F.when(F.col("_before").isNull(), "imported").when(F.col("_before") == F.col("content_hash"), "skipped").otherwise("updated")
    marked = seen.withColumns({"action": action, "_n": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ord"), F.desc("nth")))})
    n = lambda a: F.count_if(F.col("action") == a).alias(f"total_{a}")
    log = marked.groupBy("scanner_name").agg(n("imported"), n("updated"), n("skipped")).withColumn("sync_timestamp", F.lit(at))
    fresh = marked.filter("_n = 1").select(*FIELDS, "content_hash", F.coalesce("created_at", F.lit(at)).alias("created_at"), F.lit(at).alias("updated_at"))
    kept = store.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns)
    return kept.unionByName(fresh), log


def listed(store: DataFrame, scanner: str | None = None) -> DataFrame:
    rows = store if scanner is None else store.filter(F.col("scanner_name") == scanner.strip().lower())
    return rows.orderBy("scanner_name", "source_vulnerability_id")


def latest_answers(log: DataFrame, key: str = "cache_key", at: str = "saved_at") -> DataFrame:
    """The newest answer of each cache key: saving appends, reading takes the last."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), at).alias("l")).select(key, "l.*")


def cached(requests: DataFrame, log: DataFrame, same: tuple[str, ...], key: str = "cache_key") -> DataFrame:
    """``requests`` with the stored answer, if key and all of ``same`` (versions and hashes) agree."""
    answers = latest_answers(log, key)
    on = [key, *same]
    return requests.join(answers.select(*on, *[c for c in answers.columns if c not in on], F.lit(True).alias("hit")), on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
