import numpy as np

from findloom.llm import nn_descent
from findloom.llm.scratch import Scratch


def test_rounds_and_hops_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BUCKET", 60)
    rounds = []
    step = nn_descent._descend
    monkeypatch.setattr(nn_descent, "_descend", lambda *a: rounds.append(1) or step(*a))
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    scratch = Scratch(spark, "nnd")
    table = nn_descent.nodes(vectors, 20, scratch)
    graph = nn_descent.build(table, scratch)
    assert len(rounds) > 2
    starts = table.filter("node % 20 = 0").selectExpr("node AS query")
    found = nn_descent.search(table, graph, starts, scratch).collect()
    near = [len(set(np.frombuffer(r.ids, "<i8")[:21]) & set(np.argsort(-(x.astype(float) @ x[r.query]))[:21].tolist())) / 21 for r in found]
    assert len(found) == 75 and np.mean(near) >= 0.95
