import collections
import re

import numpy as np
import pytest

from findloom.llm import exact_dedup, line_dedup, setsketch
from tests.conftest import DATA

W = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


def test_exact_edges(spark):
    rows = [(1, "a  b\tc"), (2, "a b c"), (3, None), (4, ""), (5, " a b c"), (6, "x" * 50_000), (7, "x" * 49_999 + "y"), (8, "x" * 50_000), (9, " \n "), (None, "a b c"), (2, "a b c")]
    got = exact_dedup.exact_duplicates(frame(spark, rows), block_bytes=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert {k: v[0].keep_id for k, v in by.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 6, 9: 9, None: 1}
    assert by[1][0].group_size == 4 and sorted(k for k, v in by.items() for r in v if r.kept) == [1, 3, 5, 6, 7, 9]
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: sets_of(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for base in range(6):
        words = rng.choice(vocabulary, 60 + 20 * base).tolist()
        for copy in range(14):
            own = list(words)
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(len(own))] = f"new{rng.integers(1000)}"
            docs.append((len(docs), " ".join(own) if copy % 3 else "\n".join(own).upper()))
    docs += [(900, None), (901, ""), (902, "one two"), (903, "One  TWO"), (904, "é" * 3), (905, " \t ")]
    expected, sizes = brute(docs)
    got = setsketch.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    extra = spark.createDataFrame([(1, "a b c d e", 7, "k")], "doc_id long, text string, regs int, key string")
    assert setsketch.near_duplicates(extra).count() == 1
    assert setsketch.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("overlap", [0.3, 0.6, 0.9])
def test_estimate_is_close(overlap):
    rng = np.random.default_rng(int(overlap * 10))
    n, trials, errors = 600, 40, []
    for _ in range(trials):
        common = int(2 * n * overlap / (1 + overlap))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        regs = setsketch.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        true = common / (2 * n - common)
        errors.append(setsketch.estimate(regs[:1], regs[1:], np.array([n * 1.0]), np.array([n * 1.0]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_sketches_merge():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b, both = (setsketch.sketches(x, np.array([0, len(x)])) for x in (pool[:500], pool[400:], pool))
    assert (np.maximum(a, b) == both).mean() > 0.97


def brute_lines(docs, least):
    seqs = [(i, [x for x in (t or "").split("\n") if W.search(x)]) for i, t in docs]
    where = collections.defaultdict(list)
    for a, (_, lines) in enumerate(seqs):
        for b, x in enumerate(lines):
            where[x].append((a, b))
    gone = [set() for _ in seqs]
    for places in where.values():
        for x, (a, b) in enumerate(places):
            for c, e in places[:x]:
                n = 0
                while b + n < len(seqs[a][1]) and e + n < len(seqs[c][1]) and (a != c or e + n < b) and seqs[a][1][b + n] == seqs[c][1][e + n]:
                    n += 1
                if sum(len(W.findall(y)) for y in seqs[a][1][b : b + n]) >= least:
                    gone[a].update(range(b, b + n))
    return {i: len(g) for (i, _), g in zip(seqs, gone, strict=True)}


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(1, 8))) for _ in range(12)]
    docs = [(i, "\n".join(pool[rng.integers(12)] if rng.random() < 0.8 else f"own {i} {j}" for j in range(rng.integers(0, 25)))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1]), (104, "\n\n".join(docs[3][1].split("\n")))]
    got = {r.doc_id: r for r in line_dedup.delete_repeated_lines(frame(spark, docs), min_words=12).collect()}
    assert {i: r.n_removed for i, r in got.items()} == brute_lines(docs, 12)
    assert got[100].text is None and got[101].text == ""
    assert line_dedup.delete_repeated_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_few_kinds_equal_brute_force(spark, seed):
    """Periodic documents, copies of copies and long common prefixes, dealt to several pieces."""
    rng = np.random.default_rng(seed)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c"], rng.integers(1, 30), p=[0.7, 0.2, 0.1]).tolist())) for i in range(40)]
    docs += [(50, "x y z\n" * 4), (51, "p q\n" * 31), (52, docs[7][1] + "\n" + docs[9][1]), (53, docs[52 - 10][1] if len(docs) > 52 else docs[8][1])]
    got = {r.doc_id: r.n_removed for r in line_dedup.delete_repeated_lines(frame(spark, docs), min_words=6).collect()}
    assert got == brute_lines(docs, 6)


def test_first_copy_stays_whole(spark):
    rows = [(1, "one two three\n" * 4)]
    got = line_dedup.delete_repeated_lines(frame(spark, rows), min_words=6).collect()[0]
    assert got.removed == [2, 3]


def test_line_edges(spark):
    text = "\n".join(f"line {i} has some words" for i in range(20))
    rows = [(None, text, "k", 1), (None, text, "k", 1), (3, text, "k", 2), (3, text, "k", 2), (3, "other", "k", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, h long")
    got = sorted((r.doc_id or 0, r.n_removed) for r in line_dedup.delete_repeated_lines(docs).collect())
    assert got == [(0, 0), (0, 0), (3, 0), (3, 20), (3, 20)]
    long = frame(spark, [(1, "\n".join(f"w{i % 700} v" for i in range(6000)))])
    assert line_dedup.delete_repeated_lines(long).collect()[0].n_removed == 6000 - 700


def test_whole_table_has_planted_copies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(docs).collect()}
    assert got == brute(rows)[0]
