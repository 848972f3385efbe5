import itertools

import numpy as np
import pytest

from findloom.llm import mixing
from findloom.llm.scratch import Scratch
from tests.conftest import DATA


def brute_targets(words, weights=(5, 2, 1), share=1.5, most=2):
    """Targets of sources in their order, by resharing until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(words))]
    stopped = set()
    while True:
        rest = share * sum(words) - sum(most * words[i] for i in stopped)
        total = sum(weight[i] for i in range(len(words)) if i not in stopped)
        over = {i for i in range(len(words)) if i not in stopped and rest * weight[i] / total > most * words[i]}
        if not over:
            return [most * w if i in stopped else rest * weight[i] / total for i, w in enumerate(words)]
        stopped |= over


@pytest.mark.parametrize("words", [[10, 1000, 500], [5], [0, 0, 7], [1, 2, 3, 400, 5, 60, 7000, 80]])
def test_targets_equal_brute_force(spark, words):
    names = [chr(97 + i) for i in range(len(words) - 1)] + [None]
    table = spark.createDataFrame(list(zip(names, words, strict=True))[::-1], "source string, words long")
    got = {r.source: r.target for r in mixing.targets(table, Scratch(spark, "mix")).collect()}
    assert [got[n] for n in names] == pytest.approx(brute_targets(words))


def test_flow_equals_brute_force():
    """Least convex cost among the largest flows, over all integer choices of small networks."""
    rng = np.random.default_rng(6)
    for _ in range(25):
        patterns = [(("a",), int(rng.integers(1, 4))), (("b",), int(rng.integers(1, 4))), (("a", "b"), int(rng.integers(1, 4)))]
        quota = {"a": int(rng.integers(0, 7)), "b": int(rng.integers(0, 7))}
        cost = lambda took: sum(t + 3 * max(0, t - w) for t, (_, w) in zip(took, patterns, strict=True))
        best = {}
        for a, b, x, y in itertools.product(*(range(2 * patterns[i][1] + 1) for i in (0, 1, 2, 2))):
            if a + x <= quota["a"] and b + y <= quota["b"] and x + y <= 2 * patterns[2][1]:
                total, c = a + b + x + y, cost((a, b, x + y))
                best[total] = min(best.get(total, c), c)
        took = mixing.route(patterns, quota)
        assert sum(took) == max(best) and cost(took) == best[max(best)]


def check(rows, largest_gap=1):
    """Every source's words against its target: what is missing fits no document left over."""
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), own in by.items():
        gap = round(target) - sum(r.taken for r in own)
        free = [r["size"] for r in own if r["size"] and r.taken < 2 * r["size"] and r.taken // r["size"] == min(x.taken // x["size"] for x in own if x["size"])]
        assert gap <= largest_gap or all(s > gap for s in free)
        assert gap >= -max((r["size"] for r in own), default=0) / 2 - 1
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(10_000, None, "a"), (10_001, "x y", None), (10_001, "x y", None), (None, "z", "a"), (None, "z w", "a")], "doc_id long, text string, source string")
    both = docs.unionByName(odd)
    one = sorted(map(tuple, mixing.mix_sources(both).collect()), key=str)
    two = sorted(map(tuple, mixing.mix_sources(both.repartition(7)).collect()), key=str)
    assert one == two and len(one) == docs.count() + 5
    rows = mixing.mix_sources(both).collect()
    check(rows)
    words = {}
    for r in both.collect():
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    assert {(words[s], round(t, 6)) for s, t in zip(order, brute_targets([words[s] for s in order]), strict=True)} == {(r.source_size, round(r.target, 6)) for r in rows}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    taken = sum(r.taken for r in rows)
    again = mixing.mixed_documents(both).collect()
    assert sum(len((r.text or "").split()) for r in again) == taken


def test_columns_with_clashing_names(spark):
    names = ["k", "times", "copy", "row", "key", "pattern", "size", "rules", "hi"]
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 3}", *names) for i in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and all(r.copy == "copy" and r.times == "times" for r in got.collect())


def test_gap_of_a_long_document_is_filled(spark):
    """Far more short documents than one subset takes close the gap that a long one leaves."""
    rows = [("s", i * 7919 % 4001 - 2000 << 52 - 1, 1_000_000 if i % 100 == 0 else 300 + i % 7) for i in range(4000)]
    rows += [("t", (i - 25) << 57, 1_000_000 if i % 5 == 0 else 100_000 * (1 + i % 3)) for i in range(50)]
    words = {p: sum(r[2] for r in rows if r[0] == p) for p in "st"}
    sizes = spark.createDataFrame([([p], k, n) for p, k, n in rows], "pattern array<string>, key long, size long")
    wanted = {"s": 900_001, "t": words["t"] + 700_000}
    scratch = Scratch(spark, "mix")
    rules, places = mixing.decide(sizes, spark.createDataFrame([([p], words[p], wanted[p]) for p in "st"], "pattern array<string>, words long, flow long"), scratch)
    got = {r.p: r.t for r in mixing._times(sizes, rules, places).selectExpr("pattern[0] AS p", "size * copies AS n").groupBy("p").agg({"n": "sum"}).toDF("p", "t").collect()}
    assert abs(got["s"] - wanted["s"]) <= 1 and got["t"] == wanted["t"]


def test_subset_memory_is_bounded():
    sizes = [10**8 + i for i in range(200)]
    chosen = mixing.best_subset(sizes, 10**9)
    assert 0.85 * 10**9 < sum(sizes[i] for i in chosen) <= 10**9


def test_overlapping_sources(spark):
    """Documents of two sources serve both; each source comes near its target."""
    docs = spark.createDataFrame([(i, "w " * (5 + i % 9)) for i in range(400)] + [(None, "x")], "doc_id long, text string")
    members = spark.createDataFrame([(i, "a") for i in range(0, 300)] + [(i, "b") for i in range(200, 400)], "doc_id long, source string")
    got = mixing.mix_members(docs, members).collect()
    assert len(got) == 400 and all(r.taken <= 2 * r["size"] for r in got)
    words = {s: sum(r["size"] for r in got if s in r.sources) for s in "ab"}
    target = brute_targets([words["a"], words["b"]])
    flow = mixing.route([(tuple(p), sum(r["size"] for r in got if r.sources == list(p))) for p in ("a", "ab", "b")], {"a": round(target[0]), "b": round(target[1])})
    for p, f in zip(("a", "ab", "b"), flow, strict=True):
        assert abs(sum(r.taken for r in got if r.sources == list(p)) - f) <= 13
