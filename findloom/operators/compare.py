"""What changed between two runs: baseline, matching, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.functions.text import jaccard

# Points of a match.
WEIGHTS = {"anchor": 40, "family": 10, "port": 10, "cve": 120, "ident": 110, "name": 55, "cwe": 35, "title": 25, "path": 20, "endpoint": 18, "technology": 14, "category": 12, "parameter": 8, "query_key": 4, "method": 4, "scanner": 4}


def coverage(current: Column, previous: Column) -> Column:
    """Struct shared, added, dropped, mode: full if the sets are equal, partial if they overlap."""
    shared = F.array_sort(F.array_intersect(current, previous))
    added, dropped = F.array_sort(F.array_except(current, previous)), F.array_sort(F.array_except(previous, current))
    mode = F.when((F.size(added) == 0) & (F.size(dropped) == 0), "full").when(F.size(shared) > 0, "partial").otherwise("skipped")
    return F.struct(shared.alias("shared"), added.alias("added"), dropped.alias("dropped"), mode.alias("mode"))


def pick_baseline(runs: DataFrame, key: str, mode: str, at: str) -> DataFrame:
    """Newest full run per key, else newest partial; skipped ones never."""
    rank = F.when(F.col(mode) == "full", 0).when(F.col(mode) == "partial", 1)
    w = Window.partitionBy(key).orderBy(rank, F.desc(at))
    return runs.filter(rank.isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def match_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Points of a pair; the sides give an array per dimension, and ``title`` tokens."""
    out = F.when(jaccard(a["title"], b["title"]) >= 0.5, WEIGHTS["title"]).otherwise(0)
    for k, w in WEIGHTS.items():
        if k != "title" and k in a:
            out = out + F.when(F.coalesce(F.arrays_overlap(a[k], b[k]), F.lit(False)), w).otherwise(0)
    return out


def accept_match(score: Column, strong: Column, identity: Column, context: Column, title: Column, near: Column, alike: Column) -> Column:
    """Struct-free acceptance: by id, by identity with context, or by title with place and kind."""
    return (strong & (score >= 80)) | (identity & context & (score >= 70)) | ((title >= 0.6) & near & alike & (score >= 70))


def candidates(current: DataFrame, previous: DataFrame, anchors: str = "anchors") -> DataFrame:
    """Pairs that share an anchor, by an inverted index and an equi-join."""
    side = lambda df, k: df.select(F.col("id").alias(k), F.explode(anchors).alias("anchor"))
    return side(current, "a").join(side(previous, "b"), "anchor").select("a", "b").distinct()


def changed_dimensions(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the dimensions whose sets differ."""
    return F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(k)) for k, (a, b) in pairs.items()]))


def diff(current: DataFrame, previous: DataFrame, keys: list[str], dimensions: list[str], partial: bool = False) -> DataFrame:
    """keys, status and changed dimensions of every finding of either run (keys are unique in a run).

    In partial mode findings without a partner stay unclassified.
    """
    here = current.select(*keys, F.lit(True).alias("_c"), *[F.col(d).alias(f"{d}_c") for d in dimensions])
    there = previous.select(*keys, F.lit(True).alias("_p"), *[F.col(d).alias(f"{d}_p") for d in dimensions])
    both = here.join(there, keys, "full_outer")
    changed = changed_dimensions({d: (F.col(f"{d}_c"), F.col(f"{d}_p")) for d in dimensions})
    paired = F.col("_c") & F.col("_p")
    alone = F.lit(None).cast("string") if partial else F.when(F.col("_p").isNull(), "new").otherwise("fixed")
    status = F.when(paired & (F.size(changed) > 0), "changed").when(paired, "persistent").otherwise(alone)
    return both.select(*keys, status.alias("status"), F.when(paired, changed).otherwise(F.array().cast("array<string>")).alias("changed"))
