"""What is dear to work out of a finding is worked out once."""

from pyspark.sql import functions as F

from findloom import schema
from findloom.operators import context, merge, score, tiers
from findloom.plans import pipeline


def _findings(spark, n=12):
    rows = [{"finding_id": f"f{i}", "ord": i, "vulnerability_name": "Internal Server Error", "severity": "low", "asset_id": f"https://h.org/{i % 2}", "description": "d", "remediation": "r", "meta": {"scanner": "zap"}} for i in range(n)]
    return spark.createDataFrame(rows, schema.FINDING)


def _plan(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "100000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_host_is_taken_from_the_asset_once(spark):
    """some thirty internal names are compared with one host, not each with its own parsing."""
    plan = _plan(spark.createDataFrame([("https://a.local/",)], "a string").select(score.internet_exposed(F.col("a"))))
    assert plan.count("regexp_replace") <= 2 and plan.count("regexp_extract") <= 6


def test_fingerprints_name_the_parts_of_a_target(spark):
    """the keys are joined of columns, so that a path is cleaned once."""
    plan = _plan(pipeline.with_fingerprints(_findings(spark)))
    assert plan.count("regexp_replace") <= 8


def test_groups_are_chosen_by_written_keys(spark, tmp_path):
    """one table with all rows and their keys; sources and scanners aren't written a second time."""
    kept = []

    def keep(df):
        path = str(tmp_path / str(len(kept)))
        df.write.parquet(path)
        kept.append(df)
        return spark.read.schema(df.schema).parquet(path)

    rows = _findings(spark).withColumn("k", F.when(F.col("ord") > 2, (F.col("ord") % 2).cast("string")))
    got = merge.merge_groups(rows, "k", keep=keep)
    assert len(kept) == 1 and kept[0].count() == 12 and not {"_sources", "found_by", "scanners"} & set(kept[0].columns)
    have = sorted((r.ord, r.duplicate_count, r.match_level, tuple(r.found_by), len(r.source_findings or [])) for r in got.collect())
    assert have == [(i, 1, "single", ("zap",), 0) for i in range(3)] + [(3, 5, "strict", ("zap",), 5), (4, 4, "strict", ("zap",), 4)]


def test_tiers_take_the_server_key_they_are_given(spark, tmp_path):
    """two ways of merging parse no target a second time."""
    plans = []

    def keep(df):
        plans.append(_plan(df))
        path = str(tmp_path / str(len(plans)))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = pipeline.with_fingerprints(_findings(spark))
    keyed = keep(tiers.server_error_key(context.with_context(rows)).drop("ctx"))
    given = tiers.merge_tiers(keyed, keep=keep)
    assert len(plans) > 2 and not any("regexp" in p for p in plans[1:])
    assert sorted((r.ord, r.duplicate_count) for r in given.collect()) == sorted((r.ord, r.duplicate_count) for r in tiers.merge_tiers(rows, keep=keep).collect()) == [(0, 6), (1, 6)]
