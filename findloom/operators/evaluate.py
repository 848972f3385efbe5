"""Labelled cases against what the resolver, the comparison and the advisor made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.coerce import stable_hash
from findloom.operators.context import one, texts
from findloom.operators.merge import all_scanners

CATEGORIES = ("fixed", "added", "removed", "changed", "unchanged")


def rate(x: Column, of: Column, default: float = 1.0, digits: int = 6) -> Column:
    """A share, or the default where there is nothing to have a share of."""
    return F.when(of > 0, F.round(x / of, digits)).otherwise(F.lit(default))


def actual_groups(findings: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, id, grp): which final finding each original one went into."""
    ids = F.array_distinct(F.concat(F.coalesce(F.transform("source_findings", lambda s: s["finding_id"]), F.array().cast("array<string>")), F.when(F.size(F.coalesce(F.transform("source_findings", lambda s: s["finding_id"]), F.array().cast("array<string>"))) == 0, F.array("finding_id")).otherwise(F.array().cast("array<string>"))))
    return findings.select(case, F.explode(ids).alias("id"), F.col("finding_id").alias("grp"))


def _pairs(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Unordered pairs within groups, counted from group sizes."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.groupBy(keys[0]).agg(F.sum(F.expr("n * (n - 1) div 2")).alias(name))


def case_metrics(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: pairs found rightly, wrongly and not at all, and how groups were merged or split.

    Both sides are (case, id, grp). Nothing is formed of pairs: they are counted from the sizes of
    groups and of their intersections.
    """
    e, a = expected.select(case, "id", F.col("grp").alias("ge")), actual.select(case, "id", F.col("grp").alias("ga"))
    both = e.join(a, [case, "id"])
    sizes = lambda df, g: df.groupBy(case, g).agg(F.count("*").alias("n"))
    split = both.groupBy(case, "ge").agg(F.count_distinct("ga").alias("k"), F.count("*").alias("n")).groupBy(case).agg(F.count_if(F.col("k") > 1).alias("undersplit"))
    over = both.groupBy(case, "ga").agg(F.count_distinct("ge").alias("k")).groupBy(case).agg(F.count_if(F.col("k") > 1).alias("overmerged"))
    merges = lambda df, g, name: sizes(df, g).groupBy(case).agg(F.count_if(F.col("n") > 1).alias(name))
    ids = expected.select(case, "id").unionByName(actual.select(case, "id")).distinct().groupBy(case).agg(F.count("*").alias("ids"))
    out = ids
    for part in (_pairs(both, [case, "ge", "ga"], "tp"), _pairs(e, [case, "ge"], "pe"), _pairs(a, [case, "ga"], "pa"), split, over, merges(e, "ge", "expected_merges"), merges(a, "ga", "actual_merges"), both.groupBy(case).agg(F.count("*").alias("met"))):
        out = out.join(part, case, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    tp, pe, pa = zero("tp"), zero("pe"), zero("pa")
    return out.select(
        case, tp.alias("true_positives"), (pa - tp).alias("false_positives"), (pe - tp).alias("false_negatives"), pa.alias("predicted_pairs"), pe.alias("expected_pairs"),
        zero("undersplit").alias("undersplit"), zero("overmerged").alias("overmerged"), zero("expected_merges").alias("expected_merges"), zero("actual_merges").alias("actual_merges"),
        ((zero("undersplit") == 0) & (zero("overmerged") == 0) & (F.col("ids") == zero("met"))).alias("exact_partition"), (zero("expected_merges") == zero("actual_merges")).alias("merge_count_match"),
    )


def totals(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro-averaged totals and rates over cases, all or by group."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    got = metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), *[s(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives", "predicted_pairs", "expected_pairs", "undersplit", "overmerged")],
        F.count_if("exact_partition").alias("exact"), F.count_if("merge_count_match").alias("merge_match"),
    )
    c = F.col
    return got.withColumns(
        {
            "precision": rate(c("true_positives"), c("predicted_pairs")), "recall": rate(c("true_positives"), c("expected_pairs")), "false_merge_rate": rate(c("false_positives"), c("predicted_pairs"), 0.0), "false_split_rate": rate(c("false_negatives"), c("expected_pairs"), 0.0),
            "exact_rate": rate(c("exact"), c("cases")), "merge_count_accuracy": rate(c("merge_match"), c("cases")),
        }
    )


def by_tag(metrics: DataFrame, tags: str = "case_tags") -> DataFrame:
    """Totals of each tag; a case counts for each of its tags."""
    return totals(metrics.withColumn("tag", F.explode(tags)), ["tag"])


def inferred_mode(deterministic: Column, decided: Column) -> Column:
    """How a case was resolved, from the merges that rules made and the pairs that were decided."""
    return F.when((deterministic > 0) & (decided > 0), "hybrid").when(deterministic > 0, "deterministic").when(decided > 0, "llm").otherwise("no_merge")


def provenance_errors(pairs: DataFrame, dimensions: tuple[str, ...] = ("found_by", "meta_scanners", "source_findings", "confirmation_scanners", "has_multi_scanner_confirmation", "degraded_scanners", "degraded_execution")) -> DataFrame:
    """``pairs`` of expected_ and actual_ columns with the dimensions in which an expectation isn't met; null expects nothing."""
    differ = lambda d: F.col(f"expected_{d}").isNotNull() & ~F.col(f"expected_{d}").eqNullSafe(F.col(f"actual_{d}"))
    return pairs.withColumn("errors", F.array_compact(F.array(*[F.when(differ(d), F.lit(d)) for d in dimensions])))


def set_metrics(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``keys``: ids on both sides, only here or there, and their accuracy. Both sides are (keys, id)."""
    e, a = expected.select(*keys, "id").distinct().withColumn("_e", F.lit(1)), actual.select(*keys, "id").distinct().withColumn("_a", F.lit(1))
    n = e.join(a, [*keys, "id"], "full_outer").groupBy(*keys).agg(F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("true_positives"), F.count_if(F.col("_e").isNull()).alias("false_positives"), F.count_if(F.col("_a").isNull()).alias("false_negatives"))
    return n.withColumn("accuracy", rate(F.col("true_positives"), F.col("true_positives") + F.col("false_positives") + F.col("false_negatives")))


def history_metrics(expected: DataFrame, compared: DataFrame, case: str = "case_id") -> DataFrame:
    """Accuracy of each category over the cases of run comparison; ``expected(case, category, id)``, ``compared`` of ``profile.compare_runs`` with the case."""
    name = F.when(F.col("status") == "NEW", F.array(F.lit("added"))).when(F.col("status") == "FIXED", F.array(F.lit("fixed"), F.lit("removed"))).when(F.col("status") == "CHANGED", F.array(F.lit("changed"))).when(F.col("status") == "PERSISTENT", F.array(F.lit("unchanged")))
    actual = compared.select(case, F.explode(name).alias("category"), F.coalesce("current_id", "previous_id").alias("id"))
    each = set_metrics(expected, actual, [case, "category"])
    s = each.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives")])
    spine = compared.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    s = spine.join(s, "category", "left").na.fill(0)
    return s.withColumn("accuracy", rate(F.col("true_positives"), F.col("true_positives") + F.col("false_positives") + F.col("false_negatives")))


def instance_anchors(meta: Column) -> Column:
    """What tells retained instances of one issue apart."""
    ids = lambda *names: F.array_join(F.array_sort(F.array_distinct(texts(*names))), ",")
    return F.struct(*[F.nullif(meta[f].cast("string"), F.lit("")).alias(f) for f in ("method", "path", "parameter", "port", "service")], ids(one(meta["raw_id"]), meta["raw_ids"]).alias("raw"), *[F.nullif(F.trim(meta[f]), F.lit("")).alias(f) for f in ("template_id", "plugin_id")], ids(one(meta["cve_id"]), meta["cve_ids"]).alias("cves"))


def evaluation_key() -> Column:
    """Stable key of a finding by public fields."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    return stable_hash(low("vulnerability_name"), low("asset_id"), F.array_join(F.array_sort(F.transform(all_scanners(), F.lower)), ","), F.to_json(instance_anchors(F.col("meta"))), length=20)


def label_template(findings: DataFrame) -> DataFrame:
    """One row to be labelled per finding, sorted; findings that can't be told apart raise an error."""
    keyed = findings.withColumn("finding_key", evaluation_key())
    twice = keyed.groupBy("finding_key").count().filter("count > 1").limit(1).count()
    if twice:
        raise ValueError("findings that can't be told apart by public instance anchors")
    empty = F.lit(None).cast("string").alias("expected_applicability_status"), F.lit(None).cast("struct<supported:boolean,actionable:boolean,verifiable:boolean>").alias("remediation_review")
    return keyed.select("finding_key", F.trim("vulnerability_name").alias("vulnerability_name"), F.trim("asset_id").alias("asset_id"), instance_anchors(F.col("meta")).alias("instance_anchors"), *empty).orderBy(F.lower("vulnerability_name"), "asset_id", "finding_key")


def label_errors() -> Column:
    """What is wrong with a label row."""
    states = ("applicable", "likely_applicable", "likely_false_positive", "needs_review", "not_applicable")
    return F.array_compact(F.array(F.when(F.coalesce(F.trim("finding_key"), F.lit("")) == "", "finding_key is missing"), F.when(~F.coalesce(F.col("expected_applicability_status").isin(*states), F.lit(False)), "expected_applicability_status is unknown")))


def advice_metrics(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """Agreement of predicted with labelled applicability, and rates, in one row.

    ``labels(finding_key, expected)``; ``findings(finding_key, status, predicted)``.
    """
    both = labels.join(findings, "finding_key", "left")
    met, done = F.col("status").isNotNull(), F.col("status").isin("completed", "cached") & F.col("predicted").isNotNull()
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    got = both.agg(
        F.count("*").alias("labeled_cases"), n(met, "matched_cases"), n(done, "analyzed_cases"), n(done & (F.col("predicted") == F.col("expected")), "agreed"), n(done & (F.col("predicted") == "needs_review"), "review"),
        n(F.col("status") == "unavailable", "unavailable_count"), n(F.col("status") == "skipped_limit", "skipped_limit_count"), n(done & (F.col("predicted") == "likely_false_positive") & (F.col("expected") != "likely_false_positive"), "wrong_false_positives"),
    )
    c = F.col
    return got.withColumns({"match_rate": rate(c("matched_cases"), c("labeled_cases"), 0.0, 4), "analysis_coverage": rate(c("analyzed_cases"), c("matched_cases"), 0.0, 4), "applicability_agreement": rate(c("agreed"), c("analyzed_cases"), 0.0, 4), "needs_review_rate": rate(c("review"), c("analyzed_cases"), 0.0, 4)}).drop("agreed", "review")


def confusion(labels: DataFrame, findings: DataFrame) -> DataFrame:
    done = labels.join(findings, "finding_key").filter("status IN ('completed', 'cached') AND predicted IS NOT NULL")
    return done.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def pair_reduction(findings: DataFrame, records: DataFrame, bucket: str = "bucket") -> DataFrame:
    """How many pairs blocking and the gate leave of all pairs, in one row."""
    n = findings.groupBy(bucket).agg(F.count("*").alias("n"))
    all_ = n.agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n - 1) div 2")).alias("bucket_pairs")).withColumn("all_pairs", F.expr("rows * (rows - 1) div 2"))
    kept = records.agg(F.count("*").alias("candidate_pairs"), F.count_if(F.col("status").isin("decided", "undecided")).alias("sent_pairs"))
    return all_.crossJoin(kept).withColumns({"bucket_ratio": rate(F.col("bucket_pairs"), F.col("all_pairs"), 0.0), "sent_ratio": rate(F.col("sent_pairs"), F.col("bucket_pairs"), 0.0)})
