"""Sets move only for pairs that their sketches don't rule out."""

import numpy as np

from findloom.llm import setsketch


def test_sketches_rule_out_before_sets_move(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    sets = [x, np.concatenate([x[:290], rng.integers(0, 1 << 63, 10).astype(np.uint64)]), rng.integers(0, 1 << 63, 300).astype(np.uint64), x[:100]]
    first = np.cumsum([0, *map(len, sets)])
    regs = setsketch.sketches(np.concatenate(sets), first)
    full = spark.createDataFrame([(i, len(s), bytearray(regs[i].tobytes())) for i, s in enumerate(sets)], "node long, n long, regs binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    assert [tuple(r) for r in setsketch._likely(pairs, full, 80).collect()] == [(0, 1)]


def test_texts_that_no_node_stands_for_stay_where_they_are(spark):
    texts = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "0L as h").union(spark.sql("SELECT cast(null as long), 't', 0L"))
    ids = spark.createDataFrame([(-(1 << 62),), *[(i,) for i in range(0, 20_000, 100)]], "rep long")
    moved = setsketch._wanted(texts, ids)
    got = [r.doc_id for r in moved.collect()]
    assert moved.columns == texts.columns and set(range(0, 20_000, 100)) <= set(got)
    assert len(got) == len(set(got)) < 250
    assert setsketch._wanted(texts, ids.limit(0)).count() == 0
