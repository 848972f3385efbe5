from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from findloom import schema
from findloom.sources import store as s


@pytest.fixture
def store(spark, tmp_path):
    return s.RunStore(spark, f"file://{tmp_path}/store")


def rows(spark, n, at=0):
    return spark.range(at, at + n).withColumn("x", F.col("id") * 2)


def test_versions_are_published_whole_and_in_order(spark, store):
    assert store.read("t") is None and store.versions("t") == [] and store.manifest("t") is None
    assert store.publish("t", rows(spark, 3)) == 1 and store.publish("t", rows(spark, 5), expect=1) == 2
    assert store.read("t").count() == 5 and store.read("t", 1).count() == 3 and store.read("t", 9) is None
    assert store.manifest("t")["rows"] == 5 and store.unpublished("t") == []
    with pytest.raises(s.Conflict):
        store.publish("t", rows(spark, 1), expect=1)
    with pytest.raises(ValueError):
        store.publish("../t", rows(spark, 1))


def test_a_crash_before_publishing_leaves_the_old_version(spark, store, monkeypatch):
    store.publish("t", rows(spark, 3))
    with monkeypatch.context() as m:
        m.setattr(store, "_put", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("the driver dies")))
        with pytest.raises(RuntimeError):
            store.publish("t", rows(spark, 5), digest="d5")
    assert store.read("t").count() == 3 and store.versions("t") == [1]
    left = store.unpublished("t")
    assert len(left) == 1
    # the same rows again: the complete folder is taken over, nothing is written
    assert store.publish("t", rows(spark, 0), digest="d5") == 2 and store.read("t").count() == 5 and store.unpublished("t") == []
    assert store.publish("t", rows(spark, 0), digest="d5") == 2


def test_a_crash_while_writing_leaves_a_folder_that_nobody_takes(spark, store):
    store.publish("t", rows(spark, 3))
    broken = rows(spark, 5).withColumn("x", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.publish("t", broken, digest="d5")
    assert store.publish("t", rows(spark, 4), digest="d5") == 2 and store.read("t").count() == 4


def test_of_two_writers_one_is_told(spark, store, monkeypatch):
    store.publish("t", rows(spark, 3))
    stage = store.stage
    # the other writer publishes while this one writes
    monkeypatch.setattr(store, "stage", lambda *a: (monkeypatch.setattr(store, "stage", stage), store.publish("t", rows(spark, 7)), stage(*a))[2])
    with pytest.raises(s.Conflict):
        store.publish("t", rows(spark, 5), expect=1)
    assert store.read("t").count() == 7 and store.versions("t") == [1, 2] and len(store.unpublished("t")) == 1


def findings(spark, *assets, **meta):
    given = [{"finding_id": f"f{i}", "ord": i, "vulnerability_name": "n", "severity": "low", "asset_id": a, "description": "d", "remediation": "r", "meta": {"scanner": "zap"} | meta} for i, a in enumerate(assets)]
    return schema.conform(spark.createDataFrame(given, schema.FINDING))


def test_runs_and_their_pointer(spark, store):
    assert store.runs("shop").collect() == [] and store.latest("shop") is None and store.read_run("shop", "x") is None
    for ts in ("20260102_000000", "20260103_000000", "20260101_000000"):
        store.save_run(findings(spark, "https://h/a"), "shop", ts)
    store.save_run(findings(spark, "https://h/a", "https://h/b"), "shop", "20260102_000000")
    store.save_run(findings(spark, "https://h/a"), "shop_2", "20260105_000000")
    assert [(r["run_ts"], r["version"], r["rows"]) for r in store.runs("shop").collect()] == [("20260103_000000", 1, 1), ("20260102_000000", 2, 2), ("20260101_000000", 1, 1)]
    assert store.latest("shop") == "20260103_000000" and [r["run_ts"] for r in store.runs("shop", "20260103_000000").collect()] == ["20260102_000000", "20260101_000000"]
    assert store.read_run("shop", "20260102_000000").count() == 2
    with pytest.raises(ValueError):
        store.save_run(findings(spark, "https://h/a", scanner=""), "shop", "20260106_000000")
    assert store.latest("shop") == "20260103_000000"


def test_only_the_columns_asked_for_are_read(spark, store):
    store.publish("t", rows(spark, 3))
    plan = store.read("t").select("x").filter("x > 2")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<x:bigint>" in plan and "GreaterThan(x,2)" in plan


def test_upgrade_fills_what_is_missing(spark):
    got = [r["meta"] for r in s.upgraded(findings(spark, "http://H.x:8080/a/b?z=1&y=2", "", "host:22", path="", parameter=None)).orderBy("ord").collect()]
    assert (got[0]["host"], got[0]["scheme"], got[0]["port"], got[0]["path"], got[0]["query_keys"], got[0]["parameter"]) == ("h.x", "http", 8080, "/a/b", ["y", "z"], None)
    assert (got[1]["host"], got[1]["query_keys"]) == (None, None) and (got[2]["host"], got[2]["port"]) == ("host", 22)
    kept = s.upgraded(findings(spark, "http://h/a?z=1", host="own", port=1, query_keys=[], parameter="p")).first()["meta"]
    assert (kept["host"], kept["port"], kept["query_keys"], kept["parameter"], kept["path"]) == ("own", 1, [], "p", "/a")


def test_files_of_two_versions_and_broken_ones(spark, tmp_path):
    one = {"vulnerability_name": "n", "asset_id": "https://h/a", "color": "red", "meta": {"scanner": "zap", "odd": [1]}}
    for name, body in {"new": {"schema_version": "2.0", "target": "t", "all_findings": [one]}, "old": {"all_findings": [one, 7, {"asset_id": ""}]}, "none": {"all_findings": {}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "broken.json").write_text('{"all_findings": [')
    got = {(r["file"].rsplit("/", 1)[1], r["pos"]): r for r in s.read_results(spark, str(tmp_path)).collect()}
    assert sorted(got) == [("new.json", 0), ("old.json", 0), ("old.json", 1), ("old.json", 2)]
    new, old = got["new.json", 0], got["old.json", 0]
    assert (new["meta"]["host"], new["target"], new["schema_version"]) == (None, "t", "2.0") and (old["meta"]["host"], old["meta"]["parameter"]) == ("h", None)
    assert json.loads(old["extra"].toJson()) == {"finding": {"color": "red"}, "meta": {"odd": [1]}} and got["old.json", 1]["asset_id"] is None


def test_baseline_files(spark):
    runs = spark.createDataFrame([("20260101_000000", "normalized.json", "a/n"), ("20260101_000000", "scan_results.json", "a/s"), ("20260102_000000", "scan_results.json", "b/s"), ("20260103_000000", "normalized.json", "c/n"), ("latest", "normalized.json", "l/n"), ("20260102_000000", "other.json", "b/o")], "run_ts string, name string, path string")
    legacy = spark.createDataFrame([("old1", "2025-01-01 00:00:00"), ("old2", "2025-06-01 00:00:00"), ("b/s", "2025-07-01 00:00:00")], "path string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert [r["path"] for r in s.baseline_files(runs, legacy, "20260103_000000").orderBy("place").collect()] == ["b/s", "a/n", "old2", "old1"]
