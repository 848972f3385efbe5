"""From findings of several scanners to one scored, annotated, sanitized set; DataFrames throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.coerce import stable_hash
from findloom.functions.text import normalize_name
from findloom.functions.url import identity_keys, none_if_empty, target_identity, with_target
from findloom.operators import context, export, merge, predicates, resolve, score
from findloom.shared import cut

FINGERPRINTS = ("fp_strict", "fp_general", "fp_host_only")


def finding_id() -> Column:
    """Content hash of a finding: scanner, source id, name, asset, texts and target context."""
    m = F.col("meta")
    source = F.coalesce(*[none_if_empty(m[f]) for f in ("plugin_id", "template_id", "raw_id", "cve_id")])
    return F.concat(F.lit("finding-"), stable_hash(m["scanner"], source, F.col("vulnerability_name"), F.col("asset_id"), F.col("description"), F.col("remediation"), F.to_json("ctx")))


def union_findings(parts: list[DataFrame]) -> DataFrame:
    """All scanners' findings in the schema, with context, ids and their order: the parts in turn, each
    in its own order (``ord`` if it has one, else as read). Ids repeat for identical rows."""
    ordered = []
    for i, part in enumerate(parts):
        own = F.col("ord") if "ord" in part.columns else F.monotonically_increasing_id()
        ordered.append(schema.conform(part.withColumn("ord", own.cast("long") + F.lit(i << 56))))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)
    rows = context.with_context(rows)
    return rows.withColumn("finding_id", F.coalesce("finding_id", finding_id()))


def with_fingerprints(findings: DataFrame) -> DataFrame:
    m = F.col("meta")
    staged, parts = with_target(findings.withColumn("_norm", normalize_name(F.col("vulnerability_name"))), F.col("asset_id"))
    at = target_identity(F.col("asset_id"), m, parts)
    staged = staged.withColumns({f"_at_{k}": v for k, v in at.items()})
    fp = identity_keys(F.col("_norm"), {k: F.col(f"_at_{k}") for k in at}, m)
    return staged.withColumns({f"fp_{k}": fp[k] for k in ("strict", "general", "host_only")}).select(*findings.columns, *FINGERPRINTS)


def resolve_exact(findings: DataFrame) -> DataFrame:
    """Repeats by one scanner merged: same scanner, identity and strict key."""
    m = F.col("meta")
    keyed = findings.withColumn("_ident", merge.identity(m, F.col("vulnerability_name"))).withColumn("_key", resolve.exact_key(m["scanner"], F.col("_ident"), F.col("fp_strict"))).drop("_ident")
    return merge.merge_groups(keyed, "_key", fingerprints=FINGERPRINTS).drop("_key")


_HINTS = ("norm", "tokens", "cves", "cwes", "idents", "categories", "technologies", "families", "bucket")


def hinted(findings: DataFrame) -> DataFrame:
    """Context, keys and hints of findings, made anew after a merge."""
    bare = findings.drop("ctx", *FINGERPRINTS, *_HINTS)
    return context.with_hints(with_fingerprints(context.with_context(bare)))


def resolve_duplicates(findings: DataFrame, decisions: DataFrame | None = None, keep=cut) -> tuple[DataFrame, DataFrame]:
    """The resolver end to end: findings merged, and one record for each pair that was compared.

    Repeats by one scanner, then issues of several scanners that a rule alone joins, then those that
    ``decisions`` approve. ``keep`` cuts a stage off.
    """
    spark = findings.sparkSession
    none = spark.createDataFrame([], "pair_key string, same boolean, confidence double, reason string, canonical_title string")
    exact = keep(hinted(resolve_exact(findings)))
    merged = keep(hinted(resolve.premerge(exact, FINGERPRINTS)))
    records = keep(resolve.comparisons(merged, none if decisions is None else decisions))
    approved = records.filter("approved").select("bucket", "a", "b")
    final = keep(resolve.merge_clusters(merged, approved, "llm", "general", FINGERPRINTS))
    results = resolve.final_results(records, final)
    return with_fingerprints(context.with_context(final.drop("ctx", *FINGERPRINTS, *_HINTS))), results


def run(parts: list[DataFrame], previous: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """The stages in order. Each is cut off by a written table: the next is then planned on plain columns,
    where inlined through all stages the parsing of targets would repeat many times."""
    kept, _ = predicates.split_artifacts(cut(union_findings(parts)))
    resolved, _ = resolve_duplicates(cut(with_fingerprints(kept)), decisions)
    return export.sanitize(score.score(resolved, previous)).drop("ctx")
