"""Joins that add what is known elsewhere: CVE feeds, asset rules, human decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.coerce import cve_id, cve_ids, first_value, to_bool, to_float, to_fraction

#: Specificity of an asset rule by the fields that it matches on (fixed values).
SPECIFICITY = {"asset_id": 100, "host": 60, "host_suffix": 30, "path_prefix": 10}
RULE_FIELDS = ("asset_criticality", "environment", "internet_exposed", "requires_auth", "sensitive_data")


def feed_entries(records: DataFrame, cve: str, score: str, percentile: str | None = None, order: str = "ord") -> DataFrame:
    """One row per CVE: the last of repeated records wins."""
    cols = [cve_id(F.col(cve)).alias("cve_id"), to_float(F.col(score)).alias("score"), F.col(order).alias("_o")]
    if percentile:
        cols.append(to_fraction(F.col(percentile)).alias("percentile"))
    got = records.select(*cols).filter("cve_id IS NOT NULL")
    last = F.max(F.struct("_o", *[c for c in got.columns if c not in ("cve_id", "_o")])).alias("l")
    return got.groupBy("cve_id").agg(last).select("cve_id", "l.*").drop("_o")


def primary_candidate(findings: DataFrame, key: str, cves: str, cvss: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """For each finding its CVE that matters most: listed first, then CVSS, EPSS, percentile, id.

    ``cvss(cve_id, score)``, ``epss(cve_id, score, percentile)``, ``kev(cve_id)``; unknown counts -1.
    """
    each = findings.select(key, F.explode(cves).alias("cve_id"))
    each = each.join(cvss.select("cve_id", F.col("score").alias("cvss")), "cve_id", "left").join(epss.select("cve_id", F.col("score").alias("epss"), "percentile"), "cve_id", "left").join(kev.select("cve_id", F.lit(True).alias("kev")).distinct(), "cve_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    order = F.struct(F.coalesce("kev", F.lit(False)).alias("kev"), known("cvss").alias("cvss"), known("epss").alias("epss"), known("percentile").alias("percentile"), F.col("cve_id"))
    return each.groupBy(key).agg(F.max(order).alias("best")).select(key, "best.*")


#: Names of the fields that feeds use, the first that is given counts.
RECORD_CVE = ("cve", "cve_id", "cveID", "id")
CVSS_FIELDS = (
    ("4.0", ("cvss_v4", "cvss_v4_score", "cvss_v4_base_score", "cvss_v4Score"), ("cvss_v4_vector", "cvss_v4Vector")),
    ("3.1", ("cvss_v3_1", "cvss_v31", "cvss_v3", "cvss_v3_1_score", "cvss_v31_score", "cvss_v3_score"), ("cvss_v3_1_vector", "cvss_v31_vector", "cvss_v3_vector")),
)
CVSS_GENERIC = ("cvss_score", "cvss", "value")
EPSS_FIELDS = (("epss", "epss_score", "score", "value"), ("epss_percentile", "percentile"))
KEV_LISTED, KEV_DUE, KEV_SOURCE = ("listed", "value"), ("dueDate", "due_date", "date_due"), ("kev_source", "source", "catalog")


def _text(records: DataFrame, name: str) -> Column:
    """A field as text: scalars as they are, structs and maps as JSON; null where the feed lacks it."""
    kind = next((f.dataType for f in records.schema.fields if f.name == name), None)
    if kind is None:
        return F.lit(None).cast("string")
    return F.col(name).cast("string") if kind.typeName() not in ("struct", "map", "array", "variant") else F.to_json(name)


def _given(records: DataFrame, *names: str) -> Column:
    return first_value(*[_text(records, n) for n in names])


def record_cve(records: DataFrame) -> Column:
    """A record's CVE: of the usual fields in turn, else the first anywhere in it."""
    return F.coalesce(*[cve_id(_text(records, n)) for n in RECORD_CVE], cve_id(F.to_json(F.struct(*records.columns))))


def _on_scale(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def nested_cvss(value: Column) -> tuple[Column, Column]:
    """Score within 0 to 10, and vector, of an object or a plain number."""
    part = lambda *names: first_value(*[F.get_json_object(value, f"$.{n}") for n in names])
    own = value.startswith("{")
    score = to_float(F.when(own, part("score", "baseScore", "cvss_score")).otherwise(value))
    return _on_scale(score), F.when(own, part("vector", "vectorString", "cvss_vector"))


def _last(rows: DataFrame, order: str) -> DataFrame:
    """The last record of each CVE."""
    fields = [c for c in rows.columns if c not in ("cve_id", order)]
    return rows.filter("cve_id IS NOT NULL").groupBy("cve_id").agg(F.max_by(F.struct(*fields), order).alias("l")).select("cve_id", "l.*")


def cvss_feed(records: DataFrame, source: str, order: str = "ord") -> DataFrame:
    """(cve_id, cvss_score, cvss_version, cvss_vector, cvss_source): version 4 before 3.1 before plain scores; the last record of a CVE counts."""
    entry = F.lit(None).cast("struct<score:double,version:string,vector:string>")
    for version, scores, vectors in CVSS_FIELDS:
        for name in scores:
            score, vector = nested_cvss(_text(records, name))
            entry = F.coalesce(entry, F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(version).alias("version"), F.coalesce(vector, _given(records, *vectors)).alias("vector"))))
    plain, _ = nested_cvss(_given(records, *CVSS_GENERIC))
    hint = F.when(F.trim(_given(records, "cvss_version")) == "4.0", "4.0").otherwise("3.1")
    entry = F.coalesce(entry, F.when(plain.isNotNull(), F.struct(plain.alias("score"), hint.alias("version"), _text(records, "cvss_vector").alias("vector"))))
    rows = records.select(record_cve(records).alias("cve_id"), entry.alias("e"), F.coalesce(_given(records, "cvss_source", "source"), F.lit(source)).alias("cvss_source"), order).filter("e IS NOT NULL")
    return _last(rows.select("cve_id", F.col("e.score").alias("cvss_score"), F.col("e.version").alias("cvss_version"), F.col("e.vector").alias("cvss_vector"), "cvss_source", order), order)


def epss_feed(records: DataFrame, source: str, order: str = "ord") -> DataFrame:
    """(cve_id, epss_score, epss_percentile, epss_source), both within 0 and 1."""
    score, percentile = (to_fraction(_given(records, *names)) for names in EPSS_FIELDS)
    rows = records.select(record_cve(records).alias("cve_id"), score.alias("epss_score"), percentile.alias("epss_percentile"), F.coalesce(_given(records, "epss_source", "source"), F.lit(source)).alias("epss_source"), order)
    return _last(rows.filter("epss_score IS NOT NULL OR epss_percentile IS NOT NULL"), order)


def kev_feed(records: DataFrame, source: str, order: str = "ord") -> DataFrame:
    """(cve_id, kev_source, kev_due_date) of the records that aren't said to be unlisted."""
    off = F.coalesce(F.lower(F.trim(_given(records, *KEV_LISTED))) == "false", F.lit(False))
    rows = records.select(record_cve(records).alias("cve_id"), F.coalesce(_given(records, *KEV_SOURCE), F.lit(source)).alias("kev_source"), _given(records, *KEV_DUE).alias("kev_due_date"), off.alias("off"), order)
    return _last(rows.filter("NOT off").drop("off"), order)


def _order(c: Column) -> Column:
    known = lambda f: F.coalesce(c[f], F.lit(-1.0)).alias(f)
    return F.struct(F.coalesce(c["kev_listed"], F.lit(False)).alias("kev"), known("cvss_score"), known("epss_score"), known("epss_percentile"), c["external"].alias("external"), c["cve_id"].alias("cve_id"))


def choose(candidates: Column) -> Column:
    """The candidate that scoring goes by, folded over the candidates in order.

    Of two whose CVSS scores are within one point the listed one stays; else the greater in listing,
    CVSS, EPSS, percentile, own feed and id.
    """

    def better(best: Column, c: Column) -> Column:
        near = F.coalesce(F.abs(best["cvss_score"] - c["cvss_score"]) <= 1.0, F.lit(False))
        by_listing = near & (best["kev_listed"] != c["kev_listed"])
        return F.when(F.when(by_listing, c["kev_listed"]).otherwise(_order(c) > _order(best)), c).otherwise(best)

    return F.aggregate(F.slice(candidates, 2, F.greatest(F.size(candidates), F.lit(1))), candidates[0], better)


def with_intelligence(findings: DataFrame, cvss: DataFrame | None = None, epss: DataFrame | None = None, kev: DataFrame | None = None) -> DataFrame:
    """``findings`` with canonical CVE fields from the feeds that are given.

    Each CVE of a finding is a candidate; the finding's own CVSS stands in for its primary CVE. Fields of
    a feed that says nothing on the chosen CVE are cleared; without a feed they stay. A finding whose CVE
    fields hold no CVE loses them. Feeds are one row a CVE and are joined by it, so a common CVE is
    looked up once for all findings: only distinct CVEs meet the feeds, and findings that say the same of
    the same CVEs share their candidates, so rows may repeat an id.
    """
    m = F.col("meta")
    spark = findings.sparkSession
    none = {"cvss": "cve_id string, cvss_score double, cvss_version string, cvss_vector string, cvss_source string", "epss": "cve_id string, epss_score double, epss_percentile double, epss_source string", "kev": "cve_id string, kev_source string, kev_due_date string"}
    feeds = {k: spark.createDataFrame([], none[k]) if df is None else df for k, df in (("cvss", cvss), ("epss", epss), ("kev", kev))}
    ids = cve_ids(m["cve_id"], F.array_join(F.coalesce(m["cve_ids"], F.array().cast("array<string>")), " "))
    rows = findings.withColumn("_cves", ids)
    known = rows.select(F.explode("_cves").alias("cve_id")).distinct().join(feeds["cvss"], "cve_id", "left").join(feeds["epss"], "cve_id", "left").join(feeds["kev"].withColumn("kev_listed", F.lit(True)), "cve_id", "left")
    own = _on_scale(m["cvss_score"])
    said = {"own": own, "first": F.coalesce(cve_id(m["cve_id"]), F.get("_cves", F.lit(0))), "own_version": m["cvss_version"], "own_vector": m["cvss_vector"], "own_source": F.coalesce(m["cvss_source"], F.lit("scanner"))}
    rows = rows.withColumn("_case", F.sha2(F.to_json(F.struct("_cves", *[v.alias(k) for k, v in said.items()])), 256))
    with_cves = rows.filter(F.size("_cves") > 0)
    each = with_cves.select("_case", "_cves", *[v.alias(k) for k, v in said.items()]).distinct().select("_case", F.posexplode("_cves").alias("pos", "cve_id"), *said).join(known, "cve_id")
    stands = F.col("cvss_score").isNull() & F.col("own").isNotNull() & (F.col("cve_id") == F.col("first"))
    pick = lambda feed, mine: F.when(stands, mine).otherwise(F.col(feed))
    version = F.when(F.trim("own_version") == "4.0", "4.0").otherwise("3.1")
    fields = {
        "cve_id": F.col("cve_id"), "cvss_score": pick("cvss_score", F.col("own")), "cvss_version": pick("cvss_version", version), "cvss_vector": pick("cvss_vector", F.col("own_vector")), "cvss_source": pick("cvss_source", F.col("own_source")),
        "epss_score": F.col("epss_score"), "epss_percentile": F.col("epss_percentile"), "epss_source": F.col("epss_source"), "kev_listed": F.coalesce("kev_listed", F.lit(False)), "kev_source": F.col("kev_source"), "kev_due_date": F.col("kev_due_date"), "external": F.col("cvss_score").isNotNull(),
    }
    candidates = each.groupBy("_case").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("c")))), lambda x: x["c"]).alias("_all"))
    found = with_cves.join(candidates.withColumn("_best", choose(F.col("_all"))), "_case")
    joined = found.unionByName(rows.filter(F.size("_cves") == 0), allowMissingColumns=True)
    b, some = F.col("_best"), F.size("_cves") > 0
    scored, rated, listed = b["cvss_score"].isNotNull(), b["epss_score"].isNotNull() | b["epss_percentile"].isNotNull(), F.coalesce(b["kev_listed"], F.lit(False))
    had = m["cve_id"].isNotNull() | m["cve_ids"].isNotNull() | m["cve_intelligence_candidates"].isNotNull()
    new = {"cve_id": b["cve_id"], "cve_ids": F.col("_cves"), "cve_intelligence_candidates": F.transform("_all", lambda c: F.struct(*[c[f].alias(f) for f in schema.CANDIDATE.names]))}
    new |= {f: F.when(scored, b[f]).otherwise(m[f]) for f in ("cvss_score", "cvss_version", "cvss_vector", "cvss_source")}
    new |= {f: F.when(rated, b[f]) if epss is not None else F.when(rated, b[f]).otherwise(m[f]) for f in ("epss_score", "epss_percentile", "epss_source")}
    new |= {"kev_listed": listed if kev is not None else F.when(listed, True).otherwise(m["kev_listed"])}
    new |= {f: F.when(listed, b[f]) if kev is not None else F.when(listed, b[f]).otherwise(m[f]) for f in ("kev_source", "kev_due_date")}
    gone = {f: F.lit(None) for f in new} | {"cve_ids": F.array()}
    meta = F.struct(*[(F.when(some, new[f.name]).when(had, gone[f.name].cast(f.dataType)).otherwise(m[f.name]) if f.name in new else m[f.name]).cast(f.dataType).alias(f.name) for f in schema.META.fields])
    return joined.withColumn("meta", meta).drop("_cves", "_case", "_all", "_best").select(*findings.columns)


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Asset rules with their specificity and place; a rule needs a field to match on, and one to set."""
    given = lambda f: F.trim(F.coalesce(F.col(f), F.lit(""))) != ""
    points = sum((F.when(given(f), p).otherwise(0) for f, p in SPECIFICITY.items()), F.lit(0))
    low = {f: F.when(given(f), F.lower(F.trim(f)) if f in ("host", "host_suffix") else F.trim(f)) for f in SPECIFICITY}
    low["host_suffix"] = F.regexp_replace(low["host_suffix"], r"^[*.]+", "")
    sets = F.coalesce(*[F.col(f).cast("string") for f in RULE_FIELDS]).isNotNull()
    return rules.withColumns(low | {"specificity": points}).filter((F.col("specificity") > 0) & sets)


def asset_context(findings: DataFrame, rules: DataFrame, key: str = "finding_id") -> DataFrame:
    """``findings`` (with ctx) whose business context is filled from the matching rules; explicit values win."""
    from findloom.operators.predicates import rule_matches

    c, m = F.col("ctx"), F.col("meta")
    hit = rule_matches({f: F.col(f"r.{f}") for f in SPECIFICITY}, F.col("f.asset_id"), c["host"], F.coalesce(F.nullif(c["path"], F.lit("")), F.lit("/")))
    got = findings.select(key, "asset_id", "ctx").alias("f").join(F.broadcast(compiled_rules(rules).alias("r")), hit)
    first = lambda f: F.min_by(f"r.{f}", F.when(F.col(f"r.{f}").isNotNull(), F.struct(-F.col("r.specificity"), F.col("r.ord")))).alias(f"_{f}")
    filled = got.groupBy(key).agg(*[first(f) for f in RULE_FIELDS])
    b = F.struct(*[F.coalesce(m["business_context"][f], F.col(f"_{f}").cast(schema.BUSINESS[f].dataType)).alias(f) for f in RULE_FIELDS])
    meta = F.struct(*[(b if f == "business_context" else m[f]).alias(f) for f in schema.META.names])
    return findings.join(filled, key, "left").withColumn("meta", meta).drop(*[f"_{f}" for f in RULE_FIELDS])


def fill_from_rules(targets: DataFrame, rules: DataFrame, key: str, matches: Column, fields: tuple[str, ...] = RULE_FIELDS) -> DataFrame:
    """Per target each field from the most specific matching rule that has it; ties by rule order.

    ``rules`` is a short list of settings with ``specificity`` and ``ord`` and is broadcast.
    """
    first = lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(-F.col("specificity"), F.col("ord")))).alias(f)
    return targets.join(F.broadcast(rules), matches).groupBy(key).agg(*[first(f) for f in fields])


def two_level_lookup(rows: DataFrame, decisions: DataFrame, exact: str, site: str, value: str = "status") -> DataFrame:
    """``rows`` with the decision for the exact key, else for the site key; the latest revision counts."""
    latest = decisions.groupBy("scope", "key").agg(F.max_by(value, "revision").alias(value))
    one = latest.filter("scope = 'finding'").select(F.col("key").alias(exact), F.col(value).alias("_exact"))
    two = latest.filter("scope = 'site_vuln'").select(F.col("key").alias(site), F.col(value).alias("_site"))
    return rows.join(one, exact, "left").join(two, site, "left").withColumn(value, F.coalesce("_exact", "_site")).drop("_exact", "_site")


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
