import json

from pyspark.sql import functions as F

from findloom.operators import decisions


def test_strict_answers(spark):
    good = {"same_vulnerability": True, "confidence": 0.5, "reason": " r ", "canonical_title": "t"}
    cases = [
        (json.dumps(good), True), (f"```json\n{json.dumps(good)}\n```", True), (json.dumps(good | {"more": 1}), False), (json.dumps({k: v for k, v in good.items() if k != "reason"}), False), (json.dumps(good | {"confidence": 1.5}), False),
        (json.dumps(good | {"confidence": 1}), False), (json.dumps(good | {"same_vulnerability": "true"}), False), (json.dumps(good | {"reason": 3}), False), ("no json", False), (None, False),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, a string").select("i", decisions.parsed(F.col("a")).alias("d")).collect()
    assert {r.i: r.d is not None for r in got} == {i: ok for i, (_, ok) in enumerate(cases)} and got[0].d.reason == "r"


def test_cache_key_ignores_order(spark):
    rows = spark.createDataFrame([("a", "b", 1, 2), ("b", "a", 2, 1), ("a", "b", 1, 3)], "a string, b string, x int, y int")
    got = [r.k for r in rows.select(decisions.cache_key(F.col("a"), F.col("b"), F.struct("x"), F.struct(F.col("y").alias("x")), "m").alias("k")).collect()]
    assert got[0] == got[1] != got[2]


def test_use_and_cost(spark):
    rows = spark.createDataFrame([('{"usage": {"input_tokens": 10, "completion_tokens": 5}}', 429, ""), ("{}", 200, "Timed out"), ('{"usage": {"prompt_tokens": -1, "total_tokens": 7}}', 503, "")], "p string, s int, t string")
    got = rows.select(decisions.usage(F.col("p")).alias("u"), decisions.failure(F.col("s"), F.col("t")).alias("f")).collect()
    assert [tuple(r.u) for r in got] == [(10, 5, 15), (0, 0, 0), (0, 0, 7)] and [r.f for r in got] == ["rate_limit", "timeout", "provider_error"]
    assert rows.limit(1).select(decisions.cost(F.lit(1000), F.lit(500), 2.0, 4.0).alias("c")).first().c == 0.004
    many = spark.createDataFrame([("k", "p1", 0.9, "x", "t"), ("k", "p2", 0.4, "y", "t")], "cluster_id string, pair_key string, confidence double, reason string, canonical_title string")
    assert decisions.conservative(many).first().reason == "y"
