import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from findloom.llm import nn_descent, packing
from findloom.llm.tokenizer_files import TOKENIZER
from tests.conftest import DATA


def test_fill_is_best():
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 6)}
        sums = {0}
        for k, n in counts.items():
            sums = {s + j * k for s in sums for j in range(n + 1)}
        used = packing.fill(counts, 50)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 50) and all(counts[k] >= n for k, n in used.items())


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(1, None), (2, ""), (3, "it's we'll 'tis \"'s don't 4x5 é ß İ"), (4, "word " * 5000), (5, "日本語 ｆｕｌｌ 😀<|endoftext|>"), (5, "again"), (None, "n"), (6, "tab\tx\x1cy")]
    rows += [(10 + i, "some words here " * (i * 7)) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER).toPandas()
    tok = Tokenizer.from_file(TOKENIZER)
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    assert got.length.sum() == sum(map(len, ids))
    for d, t in ((4, 3), (3, 2), (1, 0), (6, 7)):
        for r in got[got.doc_id == d].itertuples():
            part = np.array(ids[t][r.start : r.start + r.length], "<u4")
            assert (len(part), zlib.crc32(part.tobytes()), len(ids[t])) == (r.length, r.ids_crc32, r.doc_tokens)
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


def brute(rows, k, every=20):
    ok = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: [i for _, i in sorted((-float(ok[q] @ ok[i]), i) for i in ok if i != q)[:k]] for q in ok if q % every == 0}


def test_neighbours_small_and_odd(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [float("nan"), 1.0, 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0, 1.0])] + [(200 + i, [1.0, 2.0, 3.0, 2.0]) for i in range(40)]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute(rows, 20)
    few = nn_descent.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")).count()
    assert few == 4 and nn_descent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_search_recall(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BUCKET", 150)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1200, 12)).astype(np.float32))]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect()
    true = brute(rows, 20)
    assert np.mean([len(set(r.v) & set(true[r.query_id])) / 20 for r in got]) >= 0.9


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.count() > 0 and packed.filter("offset + length > 2048").count() == 0
