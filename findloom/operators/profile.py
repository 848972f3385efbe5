"""Two runs of one target, finding by finding: logical identity, matches, what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.coerce import exact_cve_ids
from findloom.functions.text import jaccard, normalize_name
from findloom.operators import context
from findloom.operators.context import names_of, one, texts
from findloom.operators.compare import accept_match, match_score
from findloom.operators.resolve import match_greedy
from findloom.schema import SCHEMA_RANK, SOURCE, conform

#: The sets of a profile.
SETS = ("anchors", "families", "protocols", "ports", "paths", "endpoints", "query_keys", "parameters", "methods", "names", "title", "cves", "cwes", "idents", "categories", "technologies", "scanners", "severities", "confidences")
#: The set that each of the points of a match is for.
DIMENSIONS = {
    "anchor": "anchors", "family": "families", "port": "ports", "cve": "cves", "ident": "idents", "name": "names", "cwe": "cwes", "title": "title", "path": "paths", "endpoint": "endpoints", "technology": "technologies", "category": "categories",
    "parameter": "parameters", "query_key": "query_keys", "method": "methods", "scanner": "scanners",
}


def _records(findings: DataFrame, key: str) -> DataFrame:
    """The finding itself and each of its sources as rows of their own."""
    own = findings.select(F.col(key).alias("_of"), "vulnerability_name", "severity", "asset_id", "remediation", "meta", F.coalesce("meta.scanners", context.none()).alias("listed"))
    source = findings.select(F.col(key).alias("_of"), F.explode("source_findings").alias("s")).select("_of", "s.vulnerability_name", "s.severity", "s.asset_id", "s.remediation", "s.meta", F.array_compact(F.array("s.scanner")).alias("listed"))
    return own.unionByName(source)


def profiles(findings: DataFrame, key: str = "finding_id") -> DataFrame:
    """One row per finding: ``id``, a sorted set of each of ``SETS``, and ``remediation_available``.

    A merged finding's sets are of its own values and of all its sources. Values become distinct before
    they meet, so one finding with many equal sources is no large group.
    """
    rows = context.with_context(_records(findings, key))
    m, c = F.col("meta"), F.col("ctx")
    lower = lambda v: F.transform(v, F.lower)
    upper = lambda v: F.transform(v, F.upper)
    norm = normalize_name(F.col("vulnerability_name"))
    level = F.lower(F.trim("severity"))
    values = {
        "anchors": F.when(c["host"] != "", F.array(c["host"])).otherwise(lower(texts(one(F.col("asset_id"))))), "families": texts(one(c["target_family"])), "protocols": texts(one(c["protocol"])),
        "ports": F.transform(F.array_compact(F.concat(F.array(c["port"], m["port"]), F.coalesce(m["ports"], F.array().cast("array<int>")))), lambda x: x.cast("string")),
        "paths": F.concat(texts(one(c["path"])), lower(texts(one(m["path"]), m["paths"]))), "endpoints": texts(one(c["endpoint_family"])),
        "query_keys": texts(F.split(c["query_keys"], "&"), F.flatten(F.transform(F.coalesce(m["query_keys"], context.none()), lambda q: F.split(q, "&")))),
        "parameters": lower(texts(one(c["parameter"]), one(m["parameter"]), m["parameters"])), "methods": upper(texts(one(c["method"]), one(m["method"]), m["methods"])),
        "names": texts(one(F.col("_norm"))), "title": texts(F.split("_norm", " ")), "cves": exact_cve_ids(texts(one(m["cve_id"]), m["cve_ids"])), "cwes": upper(texts(one(m["cwe"]), m["cwe_ids"])),
        "idents": lower(texts(one(m["plugin_id"]), one(m["template_id"]), one(m["raw_id"]), m["raw_ids"])), "categories": names_of(texts(one(m["category"]), m["tags"], one(m["risk"]), one(m["module"]))),
        "technologies": names_of(texts(one(m["technology"]), one(m["service"]), one(m["service_version"]))), "scanners": lower(texts(F.col("listed"), one(m["scanner"]))),
        "severities": F.filter(texts(one(level)), lambda x: x.isin(*SCHEMA_RANK)), "confidences": lower(texts(one(m["confidence"]))),
    }
    staged = rows.withColumn("_norm", norm)
    named = lambda k: lambda x: F.struct(F.lit(k).alias("k"), x.alias("v"))
    each = F.flatten(F.array(*[F.transform(v, named(k)) for k, v in values.items()], F.array(F.struct(F.when(F.trim(F.coalesce("remediation", F.lit(""))) != "", "_fix").otherwise("_none").alias("k"), F.lit("1").alias("v")))))
    facts = staged.select("_of", F.explode(each).alias("f")).select("_of", "f.k", "f.v").distinct()
    sets = facts.groupBy("_of").agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("v")))).alias(k) for k in SETS], (F.count_if(F.col("k") == "_fix") > 0).alias("remediation_available"))
    info = F.when(F.size("severities") == 0, F.array(F.lit("info"))).otherwise(F.col("severities"))
    return sets.withColumn("severities", info).withColumnRenamed("_of", "id")


def _is_web(side: str) -> Column:
    return F.array_contains(f"families_{side}", "web")


def compatible() -> Column:
    """Why a pair of profiles can't be one target, or compatible_target; anchors are shared already."""
    apart = lambda k: (F.size(f"{k}_a") > 0) & (F.size(f"{k}_b") > 0) & ~F.arrays_overlap(f"{k}_a", f"{k}_b")
    plain = ~_is_web("a") & ~_is_web("b")
    return F.when(plain & apart("families"), "target_family_mismatch").when(plain & apart("ports"), "port_mismatch").when(plain & apart("protocols"), "protocol_mismatch").otherwise("compatible_target")


def scored_pairs(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Pairs of profiles that share an anchor: a, b, score, accepted and the order of greedy matching.

    An inverted index on (anchor, family of signals): a pair without a shared CVE, id, name, CWE or title
    word is never accepted, so only pairs that share one of these meet.
    """
    marked = lambda k: lambda v: F.concat(F.lit(f"{k}:"), v)
    signals = F.array_distinct(F.flatten(F.array(*[F.transform(k, marked(k)) for k in ("cves", "idents", "names", "cwes", "title")])))
    side = lambda df, s: df.select(F.col("id").alias(s), F.explode("anchors").alias("anchor"), signals.alias("signals")).select(s, "anchor", F.explode("signals").alias("signal"))
    ids = side(current, "a").join(side(previous, "b"), ["anchor", "signal"]).select("a", "b").distinct()
    full = lambda df, s: df.select(F.col("id").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in SETS])
    both = ids.join(full(current, "a"), "a").join(full(previous, "b"), "b").withColumn("reason", compatible()).filter("reason = 'compatible_target'")
    shared = lambda k: F.size(F.array_intersect(f"{k}_a", f"{k}_b"))
    title = jaccard(F.col("title_a"), F.col("title_b"))
    points = match_score(*[{k: F.col(f"{v}_{s}") for k, v in DIMENSIONS.items()} for s in "ab"])
    some = lambda *k: F.greatest(*[shared(x) for x in k], F.lit(0)) > 0
    out = both.withColumns({"score": points, "similarity": title, "strength": F.struct(*[shared(k).alias(k) for k in ("cves", "idents", "names", "endpoints", "paths", "scanners")])})
    accepted = accept_match(F.col("score"), some("cves", "idents"), some("names", "cwes") | (F.col("similarity") >= 0.5), some("families", "ports", "paths", "endpoints", "parameters", "categories", "technologies", "scanners"), F.col("similarity"), some("paths", "endpoints"), some("categories", "technologies"))
    return out.withColumn("accepted", accepted).select("a", "b", "score", "strength", F.round("similarity", 3).alias("similarity"), "accepted")


def endpoint_scope(side: str) -> Column:
    """Coarse place of a profile: the default ports of the web don't count."""
    ports = F.when(_is_web(side), F.filter(f"ports_{side}", lambda p: ~p.isin("80", "443"))).otherwise(F.col(f"ports_{side}"))
    return F.struct(F.col(f"families_{side}").alias("families"), ports.alias("ports"), F.col(f"endpoints_{side}").alias("endpoints"), (F.size(f"paths_{side}") > 0).alias("has_path"), (F.size(f"parameters_{side}") > 0).alias("has_parameter"), F.col(f"methods_{side}").alias("methods"))


def changes() -> Column:
    """Names of the seven compared dimensions in which a matched pair differs."""
    differ = lambda k: F.col(f"{k}_a") != F.col(f"{k}_b")
    tests = (
        ("severity", differ("severities")), ("confidence", differ("confidences")), ("endpoint_scope", endpoint_scope("a") != endpoint_scope("b")), ("source_scanners", differ("scanners")), ("remediation_available", differ("remediation_available")),
        ("cve_ids", differ("cves")), ("cwe_ids", differ("cwes")),
    )
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def compare_runs(current: DataFrame, previous: DataFrame, keep, partial: bool = False, key: str = "finding_id") -> DataFrame:
    """(current_id, previous_id, status, changed_fields, score) of every finding of either run.

    Findings are matched one to one, the best score first, then the strength of what is shared, then the
    smaller ids. NEW and FIXED are those without a partner; in partial mode these have no status. The
    order of ids stands for the order of the findings. ``keep`` cuts a stage off.
    """
    here, there = keep(profiles(current, key)), keep(profiles(previous, key))
    pairs = keep(scored_pairs(here, there).filter("accepted"))
    best = match_greedy(pairs.select("a", "b", "score", "strength"), keep, [F.desc("score"), F.desc("strength"), F.asc("a"), F.asc("b")])
    sides = [df.select(F.col("id").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in (*SETS, "remediation_available")]) for df, s in ((here, "a"), (there, "b"))]
    matched = best.join(sides[0], "a").join(sides[1], "b").select("a", "b", "score", changes().alias("changed_fields"))
    status = F.when(F.size("changed_fields") > 0, "CHANGED").otherwise("PERSISTENT")
    alone = lambda df, s, name: df.select(F.col("id").alias(s)).join(best.select(s), s, "left_anti").withColumn("status", F.lit(None if partial else name).cast("string"))
    out = matched.withColumn("status", status).unionByName(alone(here, "a", "NEW"), allowMissingColumns=True).unionByName(alone(there, "b", "FIXED"), allowMissingColumns=True)
    return out.select(F.col("a").alias("current_id"), F.col("b").alias("previous_id"), "status", F.coalesce("changed_fields", context.none()).alias("changed_fields"), "score")


def counts(compared: DataFrame) -> DataFrame:
    """Counts by status, in one row."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    open_ = F.col("status").isNull()
    return compared.agg(n("NEW", "new"), n("FIXED", "fixed"), n("PERSISTENT", "persistent"), n("CHANGED", "changed"), F.count_if(open_ & F.col("current_id").isNotNull()).alias("unmatched_current"), F.count_if(open_ & F.col("previous_id").isNotNull()).alias("unmatched_previous"), F.count_if(F.col("score").isNotNull()).alias("matched"))


def lookup_key() -> Column:
    """A finding's own id, or the canonical text of what identifies it."""
    m = F.col("meta")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    sources = F.array_sort(F.transform("source_findings", lambda s: F.concat_ws("::", *[text(s[f]) for f in ("scanner", "finding_id", "asset_id", "vulnerability_name")], text(s["meta"]["raw_id"]))))
    own = F.to_json(F.struct(text(F.col("asset_id")).alias("asset_id"), normalize_name(F.col("vulnerability_name")).alias("name"), *[low(m[f]).alias(f) for f in ("scanner", "raw_id", "template_id", "plugin_id", "path", "parameter")], F.upper(text(m["method"])).alias("method"), F.coalesce(sources, context.none()).alias("sources")))
    return F.when(text(F.col("finding_id")) != "", F.concat(F.lit("finding_id::"), F.trim("finding_id"))).otherwise(own)


def attach(findings: DataFrame, compared: DataFrame, keys: tuple[str, str] = ("fp_strict", "lookup")) -> DataFrame:
    """``findings`` with the status of a compared finding of the same strict key, else of the same lookup key.

    Equal keys are paired in order, so each compared row is used once; both frames have the keys and ``ord``.
    """
    from pyspark.sql import Window

    def numbered(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("ord")))

    strict, lookup = keys
    cols = ["status", "changed_fields"]
    pool = numbered(compared.filter(F.coalesce(strict, F.lit("")) != ""), strict).select(strict, "_nth", *cols, F.col("ord").alias("_used"))
    one_ = numbered(findings, strict).join(pool, [strict, "_nth"], "left").drop("_nth")
    done, open_ = one_.filter(F.col("_used").isNotNull()), one_.filter(F.col("_used").isNull()).drop(*cols, "_used")
    rest = numbered(compared.join(done.select("_used"), F.col("ord") == F.col("_used"), "left_anti"), lookup).select(lookup, "_nth", *cols)
    two = numbered(open_, lookup).join(rest, [lookup, "_nth"], "left").drop("_nth")
    return done.drop("_used").unionByName(two)


def same_slug(current: Column, previous: Column) -> Column:
    """Null, or an error where a baseline is of another target."""
    return F.assert_true(F.coalesce(current == previous, F.lit(False)), F.concat(F.lit("baseline is of "), F.coalesce(previous, F.lit("no target")), F.lit(", not "), F.coalesce(current, F.lit("none"))))


def as_findings(rows: DataFrame) -> DataFrame:
    """Rows with the finding schema, sources included."""
    return conform(rows)


SOURCE_FIELDS = SOURCE.names
