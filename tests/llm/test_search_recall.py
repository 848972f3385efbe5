"""Recall against brute force at the parameters that the query uses."""

import numpy as np
import pytest

from findloom.llm import nn_descent


def brute(x, queries, k=20):
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def clustered(rng, n=2500, dims=24, groups=25):
    centres = rng.standard_normal((groups, dims)) * 2
    return centres[rng.integers(0, groups, n)] + 0.4 * rng.standard_normal((n, dims))


def hot(rng):
    x = rng.standard_normal((2500, 24))
    x[::3] = x[0]
    return x


def outliers(rng):
    x = clustered(rng)
    x[[3, 40, 77]] *= 1000.0
    x[100:140] *= 5.0
    return x


@pytest.mark.parametrize("make", [clustered, hot, outliers])
def test_recall(spark, make):
    x = make(np.random.default_rng(4)).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    queries = np.arange(0, len(x), 20)
    true = brute(x, queries)
    assert sorted(got) == queries.tolist() and all(sorted(v) == list(range(1, 21)) for v in got.values())
    share = []
    for q, best in zip(queries.tolist(), true.tolist(), strict=True):
        least = x[q] @ x[best[-1]]
        share.append(np.mean([s >= least - 1e-9 * abs(least) for _, s in got[q].values()]))
        assert all(s == pytest.approx(x[q] @ x[v], rel=1e-12) for v, s in got[q].values())
    assert np.mean(share) >= 0.9


def test_few_rows_and_odd_ids(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [1.0, 0.0]), (21, [1.0, 0.0]), (None, [9.0, 9.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, node string, rank int")
    got = sorted(tuple(r) for r in nn_descent.nearest(docs).collect())
    assert got == [(0, 1, 21, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 21, 0.5)]
    assert nn_descent.nearest(docs.filter("vec_id = 0")).count() == 0
