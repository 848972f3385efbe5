from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from findloom.llm import vector_codes as codes


def by_hand(rows, parts, entries, rounds=2):
    """Every part against every entry; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) or 1
    kept = [(i, v + [0] * (width * parts - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda j: (far(cut(v, p), books[p][j]), j))
    for _ in range(rounds):
        of = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), c in zip(kept, of, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, [nearest(v, p) for p in range(parts)], v, label) for i, v, label in kept]
    errors = [sum(far(cut(v, p), books[p][c[p]]) for p in range(parts)) for _, c, v, _ in out]
    sums = {}
    for (*_, label), e in zip(out, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, "".join(f"{x:02x}" for x in c), e, sums[label], sha) for (i, c, _, label), e in zip(out, errors, strict=True)), key=str)


def found(spark, rows, parts, entries, rounds=2):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, vector int")
    return sorted((tuple(r) for r in codes.compress(df, parts, entries, rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_equals_full_scans(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.randrange(64) / 128 for _ in range(8)], rng.choice([1, 2, None])) for i in rng.sample(range(500), 150)]
    for parts, entries, rounds in ((4, 8, 2), (2, 30, 3), (4, 200, 2), (4, 1, 2)):
        assert found(spark, rows, parts, entries, rounds) == by_hand(rows, parts, entries, rounds)


def test_ties_and_repeats_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 3), 0.0, 1.0, float(i % 2)], 0) for i in range(40)] + [(7, [1.0, 0.0, 1.0, 1.0], None)] * 5
    assert found(spark, rows, 2, 12) == by_hand(rows, 2, 12)


def test_rows_that_take_no_part_and_odd_lengths(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 0.0], 2), (None, [0.5, 2.0], None), (6, [0.25], 3), (7, [], 3), (8, [1.0, 2.0, 3.0], None)]
    assert found(spark, rows, 2, 4) == by_hand(rows, 2, 4)
    assert [r[0] for r in found(spark, rows, 2, 4)] == [6, 7, 8, None]
    assert found(spark, rows[:4], 2, 4) == [] and found(spark, [], 2, 4) == []
    with pytest.raises(ValueError):
        found(spark, rows, 2, 257)


def test_components_beyond_the_limit_stay_at_it(spark):
    rows = [(0, [3e38, 0.0], 1), (1, [-3e38, 0.0], 1), (2, [0.0, 0.0], 2)]
    got = found(spark, rows, 2, 1, 0)
    assert got[1][2] == (2 * codes.limit_of(2)) ** 2 and got[0][1] == "0000"


def test_bounds_spare_scans_and_never_change_a_code():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (12, 3))
    x = centres[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 3))
    old = np.ascontiguousarray(centres[None])
    new = old + rng.integers(-3, 4, old.shape)
    moves = codes.Moves(old, new)
    code, upper, lower = codes.scan(x, old[0])
    got, upper, lower, scanned = codes.bounded(x, new[0], 0, moves, code.copy(), upper, lower)
    d = codes.distances(x, new[0])
    assert (got == d.argmin(axis=1)).all() and scanned < 300
    exact = np.sort(np.sqrt(d.astype(float)), axis=1)
    assert (upper >= exact[:, 0]).all() and (lower <= exact[:, 1]).all()
    # equal entries: the bounds are never strictly apart, so each row is scanned and the lower index wins
    twin = np.repeat(old[:, :1], 4, axis=1)
    code, upper, lower = codes.scan(x, twin[0])
    got, *_, scanned = codes.bounded(x, twin[0], 0, codes.Moves(twin, twin), np.full(len(x), 3), upper, lower)
    assert (got == 0).all() and scanned == len(x)
