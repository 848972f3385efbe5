"""Counts, ordered views, metrics and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.schema import severity_rank


def zero_filled(rows: DataFrame, level: Column, levels: list[str], name: str = "level") -> DataFrame:
    """Rows per level, all levels present; others don't count. The levels are a fixed, short list."""
    spine = rows.sparkSession.createDataFrame([(x,) for x in levels], f"{name} string")
    return spine.join(rows.select(level.alias(name)).groupBy(name).agg(F.count("*").alias("n")), name, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def count_by_label(rows: DataFrame, labels: str, known: DataFrame | None = None) -> DataFrame:
    """Rows per distinct label in an array column; labels of ``known(label)`` are kept at zero."""
    got = rows.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return got if known is None else known.select("label").distinct().join(got, "label", "full_outer").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def by_severity(findings: DataFrame, *then: str) -> DataFrame:
    """The findings, most severe first (aliases count as their level, unknown as info), then by the columns ``then``."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), *then)


def flag_top(rows: DataFrame, order: list[Column], k: int, flag: str = "selected") -> DataFrame:
    """All rows, the first k in the order flagged. The k-th place is found by a top-k, which combines
    on the map side, and joined back on the order's own columns; no global window."""
    place = F.struct(*order)
    top = rows.select(place.alias("_o")).orderBy("_o").limit(k).agg(F.max("_o").alias("_last"))
    return rows.crossJoin(F.broadcast(top)).withColumn(flag, F.coalesce(place <= F.col("_last"), F.lit(False))).drop("_last")


def group_by_key(rows: DataFrame, keys: str, rank: Column, none: str = "none") -> DataFrame:
    """Rows per key of an array column, with a bucket for rows without any, and the least rank."""
    each = rows.select(F.explode_outer(F.when(F.size(keys) > 0, F.col(keys))).alias("key"), rank.alias("rank"))
    return each.groupBy(F.coalesce("key", F.lit(none)).alias("key")).agg(F.count("*").alias("n"), F.min("rank").alias("best"))


def pair_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall over unordered pairs of ``(id, grp)`` tables.

    Pairs are counted from group sizes, n(n-1)/2 in each, so no pair is formed.
    """
    def pairs(df: DataFrame, keys: list[str]) -> DataFrame:
        n = df.groupBy(*keys).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("p"))

    e, a = expected.select("id", F.col("grp").alias("ge")), actual.select("id", F.col("grp").alias("ga"))
    got = pairs(e.join(a, "id"), ["ge", "ga"]).withColumnRenamed("p", "tp").crossJoin(pairs(e, ["ge"]).withColumnRenamed("p", "pe")).crossJoin(pairs(a, ["ga"]).withColumnRenamed("p", "pa"))
    rate = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 6)).otherwise(1.0)
    return got.select("tp", (F.col("pa") - F.col("tp")).alias("fp"), (F.col("pe") - F.col("tp")).alias("fn"), rate("tp", "pa").alias("precision"), rate("tp", "pe").alias("recall"))


def cluster_metrics(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Groups of either side and how many are split or merged on the other."""
    both = expected.select("id", F.col("grp").alias("ge")).join(actual.select("id", F.col("grp").alias("ga")), "id")
    split = both.groupBy("ge").agg(F.countDistinct("ga").alias("k")).agg(F.count("*").alias("expected_groups"), F.count_if(F.col("k") > 1).alias("split_groups"))
    merged = both.groupBy("ga").agg(F.countDistinct("ge").alias("k")).agg(F.count("*").alias("actual_groups"), F.count_if(F.col("k") > 1).alias("merged_groups"))
    return split.crossJoin(merged).withColumn("exact_partition", (F.col("split_groups") == 0) & (F.col("merged_groups") == 0))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def upsert(store: DataFrame, incoming: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """The store after the upsert, each row marked inserted, updated, skipped or kept; created_at stays."""
    s = store.select(*keys, F.col(digest).alias("_old"), F.col("created_at").alias("_created"))
    i = incoming.select(*keys, F.col(digest).alias("_new"), F.col("created_at").alias("_now"))
    both = s.join(i, keys, "full_outer")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "skipped").otherwise("updated")
    return both.select(*keys, F.coalesce("_new", "_old").alias(digest), F.coalesce("_created", "_now").alias("created_at"), action.alias("action"))


def running_order(rows: DataFrame, partition: list[str], order: list[Column], name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
