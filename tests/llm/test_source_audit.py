from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from findloom.llm import source_audit as audit

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_hand(rows, least=2, top=3):
    """The contract, pair by pair and word by word; rows are (lang, source, text)."""
    word = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, holds, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        words = [w.translate(upper) for w in word.findall(text or "")]
        key = (lang or "", source or "")
        groups.add(key)
        n[key].update(words)
        holds[key[0]].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {w for w, k in holds[lang].items() if k >= least}
        sources = [s for la, s in groups if la == lang]
        total = lambda c: sum(c[w] for w in kept)  # noqa: B023, E731
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])
        p = lambda c, w: 1 + 10**9 * (c[w] + 5) // (total(c) + 5 * len(kept))  # noqa: B023, E731
        for s in sources:
            own = n[lang, s]
            pairs = [(-sum(abs(p(own, w) - p(n[lang, o], w)) for w in kept), o.encode(), "pair", o) for o in sources if o != s]
            terms = [(-(p(own, w) - p(whole, w)), w.encode(), "term", w) for w in kept if own[w] and p(own, w) > p(whole, w)]
            for ranked in (sorted(pairs), sorted(terms)[:top]):
                out += [(lang, s, part, item, -value, i) for i, (value, _, part, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    return sorted(tuple(r) for r in audit.divergence(df, **{"least_docs": 2, "top": 3} | more).select(COLUMNS).collect())


def test_equals_every_pair_and_word(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ALPHA", "été", "ÉTÉ", "x1y", "don't", "straße", "日本", "z", "[tag]"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(60)]
    rows += [("en", "hot", "alpha beta " * 40)] * 9 + [("en", "none", None), ("xx", "one", "rare"), ("yy", "a", ""), ("yy", "b", None)]
    assert found(spark, rows) == by_hand(rows)


def test_no_documents_and_no_kept_words(spark):
    assert found(spark, []) == []
    assert found(spark, [("en", "a", "x"), ("en", "b", "y")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_are_counted_in_pieces(spark):
    text = ("Wort " * 9 + "été ") * 500
    assert [w for part in audit.words_of(text.encode(), 100) for w in part] == text.lower().encode().split()
    rows = [("en", "a", text), ("en", "a", "wort"), ("en", "b", "x" * 300_000 + " wort"), ("en", "b", "été")]
    assert found(spark, rows) == by_hand(rows)


def test_tallies_that_are_handed_on_early_sum_up(spark, monkeypatch):
    monkeypatch.setattr(audit, "TALLY", 3)
    rows = [("en", s, t) for s in "abc" for t in ("one two three", "two three four", "three")]
    assert found(spark, rows) == by_hand(rows)


def test_histogram_counts_every_kept_word_once(spark):
    from findloom.llm.scratch import Scratch

    rows = [("en", "a", "x x y"), ("en", "b", "x z"), ("en", "c", "z z z y w"), ("en", "c", "w")]
    scratch = Scratch(spark, "t")
    groups, terms = audit.groups_and_terms(spark.createDataFrame(rows, "lang string, source string, text string"), scratch, 1)
    cells = audit.histograms(groups, terms, scratch).filter("times <> 0").collect()
    got = {(r["a"], r["b"], r["na"], r["nb"]): r["times"] for r in cells}
    assert got == {("a", "b", 2, 1): 1, ("a", "b", 1, 0): 1, ("a", "b", 0, 1): 1, ("a", "b", 0, 0): 1, ("a", "c", 2, 0): 1, ("a", "c", 1, 1): 1, ("a", "c", 0, 3): 1, ("a", "c", 0, 2): 1, ("b", "c", 1, 0): 1, ("b", "c", 1, 3): 1, ("b", "c", 0, 1): 1, ("b", "c", 0, 2): 1}
