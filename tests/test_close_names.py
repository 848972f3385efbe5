from __future__ import annotations

import random
from difflib import get_close_matches

from pyspark.sql import functions as F

from findloom.operators.close_names import close_matches


def by_hand(wanted, names):
    loose = lambda x: " ".join((x or "").lower().split())
    known = {}
    for x in sorted(y for y in names if y):
        if loose(x):
            known.setdefault(loose(x), x)
    out = []
    for w in {x for x in wanted if loose(x)}:
        got = [loose(w)] if loose(w) in known else get_close_matches(loose(w), list(known), n=3, cutoff=0.6)
        out += [(w, known[k], i) for i, k in enumerate(got, 1)]
    return sorted(out)


def found(spark, wanted, names):
    frame = lambda xs: spark.createDataFrame([(x, 1) for x in xs], "name string, key int").withColumn("marks", F.lit("x"))
    return sorted((r["wanted"], r["name"], r["place"]) for r in close_matches(frame(wanted), frame(names)).collect())


def test_equals_a_comparison_with_every_name(spark):
    rng = random.Random(12)
    word = lambda a, n: "".join(rng.choices(a, k=n))
    names = [f"{word('abcde ', rng.randint(1, 9))}{rng.choice(['', '-prod', ' Test', 'é日'])}" for _ in range(120)] + ["", None, "  ", "Shop", "SHOP", "axbxcxdxexf"]
    wanted = [word("abcde -", rng.randint(1, 10)) for _ in range(60)] + [n.upper() for n in names[:10]] + ["abcdef", "shop ", None, "", "x" * 300, "prod"]
    assert found(spark, wanted, names) == by_hand(wanted, names)


def test_no_names(spark):
    assert found(spark, [], ["a"]) == [] and found(spark, ["a"], []) == []


def test_the_query_equals_a_comparison_with_every_type(spark):
    import re

    from findloom.plans.site_queries import close_part_types
    from tests.conftest import DATA

    types = [r["p_type"] for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    wanted = [re.sub("^([^aeiou]*)[aeiou]", r"\1", t.lower()) for t in types]
    assert sorted((r["wanted"], r["name"], r["place"]) for r in close_part_types(spark, DATA).collect()) == by_hand(wanted, types)
