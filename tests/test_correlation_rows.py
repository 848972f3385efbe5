from __future__ import annotations

import random

from findloom.operators.correlation_rows import report_rows

KIND = "ord long, vulnerability_name string, asset_id string, found_by array<string>, correlation struct<status:string,source:string,confidence:double,review_candidates:array<struct<vulnerability_name:string,scanners:array<string>>>>"


def by_hand(rows, limit):
    key = lambda t, s: " ".join((t or "Unknown").lower().split()) + "|" + ",".join(sorted({x.strip().lower() for x in s or [] if x.strip()}))
    seen, out = set(), []
    for i, name, asset, scanners, c in sorted(rows):
        if not c or c["source"] != "llm" or c["status"] not in ("merged", "needs_review"):
            continue
        if c["status"] == "needs_review":
            signature = tuple(sorted({key(name, scanners), *(key(x["vulnerability_name"], x["scanners"]) for x in c["review_candidates"] or [])}))
            if signature in seen:
                continue
            seen.add(signature)
        out.append((0 if c["status"] == "merged" else 1, (name or "").lower(), ((asset or "").strip() or "Unknown asset").lower(), ",".join(scanners or []), i))
    return [x[-1] for x in sorted(out)[: max(1, limit)]], len(out)


def test_rows_equal_the_plain_list(spark):
    rng = random.Random(6)
    pick = lambda: (rng.choice(["XSS", "xss ", "SQL  injection", None, ""]), rng.choice([["zap"], ["Nikto", "zap"], [" "], None]))
    rows = []
    for i in range(150):
        name, scanners = pick()
        candidates = rng.choice([None, [dict(zip(("vulnerability_name", "scanners"), pick(), strict=True)) for _ in range(rng.randrange(3))]])
        c = rng.choice([None, *[{"status": rng.choice(["merged", "needs_review", "needs_review", "other"]), "source": rng.choice(["llm", "llm", "me"]), "confidence": rng.choice([0.005, 0.125, None]), "review_candidates": candidates}] * 6])
        rows.append((i, name, rng.choice(["a", "B", " ", None]), scanners, c))
    df = spark.createDataFrame(rows, KIND)
    for limit in (0, 10, 1000):
        got = sorted(report_rows(df, limit).collect(), key=lambda r: (r["status"] != "merged", r["title"].lower(), r["asset"].lower(), r["scanners"], r["ord"]))
        want, total = by_hand(rows, limit)
        assert [r["ord"] for r in got] == want and {r["total"] for r in got} == {total}
    assert {(r["percent"]) for r in report_rows(df, 1000).collect()} == {0, 12, None}
    assert report_rows(df.limit(0)).collect() == []


def test_a_hot_review_is_one_row(spark):
    c = {"status": "needs_review", "source": "llm", "confidence": 1.0, "review_candidates": [{"vulnerability_name": "b", "scanners": ["x"]}]}
    got = report_rows(spark.createDataFrame([(i, "a", "h", ["y"], c) for i in range(500)], KIND)).collect()
    assert [(r["ord"], r["total"], r["percent"], r["candidates"]) for r in got] == [(0, 1, 100, 1)]
