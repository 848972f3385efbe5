import numpy as np
import pytest
from pyspark.sql import functions as F

from findloom.llm import pseudo_likelihood as lm
from findloom.llm.scratch import Scratch


def test_every_document_trains(spark):
    """Whatever its id hashes to, a table's only document moves the parameters."""
    ids = spark.range(200).withColumn("h", F.pmod(F.xxhash64("id", F.lit(29)), F.lit(16))).filter("h >= 3").limit(1).collect()
    docs = spark.createDataFrame([(ids[0].id, "a b c a b c")], "doc_id long, text string")
    vocabulary = lm.Vocabulary(lm.slot_counts(docs))
    p = lm.train(docs, vocabulary, Scratch(spark, "lm"))
    assert not np.array_equal(p["prior"], lm.initial(vocabulary)["prior"])


def test_every_token_is_predicted():
    vocabulary = lm.Vocabulary(np.zeros(lm.SLOTS))
    assert len(lm.windows(vocabulary, [b"a b c d e", None, b"f g"])[1]) == 7


def test_rare_words_depend_on_context():
    """Two words far down the frequency list are told apart by their context, and all words sum to one."""
    slots, _ = lm.token_slots([" ".join(f"w{i}" for i in range(160)).encode()])
    counts = np.zeros(lm.SLOTS)
    counts[slots] = 1000 - np.arange(160)
    vocabulary = lm.Vocabulary(counts)
    p = lm.initial(vocabulary)
    texts = [b"w0 w100 w1", b"w2 w132 w3"] * 400
    words, first = lm.token_slots(texts)
    ctx, target = lm.contexts(vocabulary.input[words], first), vocabulary.klass[words]
    for _ in range(12):
        p = lm.train_local(p, ctx, target)
    scorer = lm.Scorer(p, vocabulary)
    said = lambda text: scorer.tokens(*lm.token_slots([text]))[1]
    assert said(b"w0 w100 w1") > said(b"w0 w132 w1") + 2 and said(b"w2 w132 w3") > said(b"w2 w100 w3") + 2
    start = lm.Scorer(lm.initial(vocabulary), vocabulary).tokens(slots, np.array([0, len(slots)]))
    assert start == pytest.approx(vocabulary.unigram[slots], abs=1e-3)


def ways(tree, slot):
    a, b = tree.first[slot], tree.first[slot + 1]
    return list(zip(tree.node[a:b].astype(int), tree.sign[a:b].astype(float), strict=True))


def plain_loss(p, ctx, target):
    """Minus the mean log-probability of the targets, branch by branch in double precision."""
    total = 0.0
    for c, y in zip(ctx, target, strict=True):
        h = np.tanh(np.concatenate([p["embed"][i] for i in c]).astype(float) @ p["mix"].astype(float) + p["bias"])
        total += sum(np.log1p(np.exp(-s * (p["out"][n].astype(float) @ h + p["prior"][n]))) for n, s in ways(p["tree"], y))
    return total / len(target)


def trained(seed=3):
    rng = np.random.default_rng(seed)
    counts = np.zeros(lm.SLOTS)
    counts[rng.choice(lm.SLOTS, 300, replace=False)] = rng.integers(1, 500, 300)
    vocabulary = lm.Vocabulary(counts)
    p = lm.initial(vocabulary)
    p["out"] = rng.standard_normal(p["out"].shape).astype(np.float32) * 0.3
    slots = np.flatnonzero(counts)[rng.integers(0, 300, 60)]
    first = np.array([0, 25, 25, 60])
    return vocabulary, p, slots, first


def test_log_probabilities_equal_brute_force():
    vocabulary, p, slots, first = trained()
    got = lm.Scorer(p, vocabulary).tokens(slots, first)
    ctx = lm.contexts(vocabulary.input[slots], first)
    each = [-plain_loss(p, ctx[i : i + 1], slots[i : i + 1]) for i in range(len(slots))]
    assert got == pytest.approx(each, abs=1e-4)


def test_first_step_follows_the_gradient():
    """Adam's first step is the gradient's sign times the rate: told from differences of the plain loss."""
    vocabulary, p, slots, first = trained()
    ctx = lm.contexts(vocabulary.input[slots], first)
    q = lm.train_local(p, ctx, slots)
    rng = np.random.default_rng(1)
    met = {n for y in slots for n, _ in ways(p["tree"], y)}
    places = {"out": [(n, j) for n in rng.choice(sorted(met), 12) for j in (0, 5)], "prior": [(n,) for n in rng.choice(sorted(met), 12)], "embed": [(i, 3) for i in rng.choice(np.unique(ctx), 12)], "mix": [(i, 2) for i in range(0, 32, 3)], "bias": [(j,) for j in range(lm.HIDDEN)]}
    checked = 0
    for k, at in places.items():
        for i in at:
            up, down = ({n: x.astype(float) if n != "tree" else x for n, x in p.items()} for _ in range(2))
            up[k][i] += 1e-4
            down[k][i] -= 1e-4
            slope = (plain_loss(up, ctx, slots) - plain_loss(down, ctx, slots)) / 2e-4
            if abs(slope) > 1e-4:
                assert q[k][i] - p[k][i] == pytest.approx(-lm.RATE * np.sign(slope), rel=0.05)
                checked += 1
    assert checked > 40


def test_averages_in_a_tree_equal_the_mean_of_all(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(2)
    rows = [(c, g, int(rng.integers(1, 50)), rng.standard_normal(5).astype(np.float32)) for c in range(2) for g in range(20) if g != 7]
    sent = spark.createDataFrame([(c, g, n, bytearray(x.tobytes())) for c, g, n, x in rows], "chunk int, g int, seen long, part binary").repartition(5)
    got = {r["chunk"]: r for r in lm.averaged(sent, 20, Scratch(spark, "lm")).collect()}
    for c in range(2):
        own = [(n, x) for k, _, n, x in rows if k == c]
        assert np.frombuffer(got[c]["part"], np.float32) == pytest.approx(sum(n * x for n, x in own) / sum(n for n, _ in own), abs=1e-5) and got[c]["seen"] == sum(n for n, _ in own)
