from __future__ import annotations

import datetime as dt
import random
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions import site as s
from findloom.operators import site_profiles as sp


def plain_url(target):
    """The canonical address by the standard library."""
    value = (target or "").strip()
    value = value if "://" in value else f"https://{value}"
    try:
        p = urlsplit(value)
        if p.scheme.lower() not in ("http", "https") or not p.hostname or p.username or p.password:
            return None
        host = p.hostname.encode("idna").decode().lower().rstrip(".")
        port = p.port
    except (UnicodeError, ValueError):
        return None
    host = f"[{host}]" if ":" in host else host
    default = 443 if p.scheme.lower() == "https" else 80
    return urlunsplit((p.scheme.lower(), host if port in (None, default) else f"{host}:{port}", p.path or "/", "", "")) if host else None


def test_addresses_equal_the_standard_library(spark):
    rng = random.Random(4)
    label = lambda: "".join(rng.choices("abzé日öß-09", k=rng.randint(1, 6)))
    cases = [f"{rng.choice(['', 'http://', 'HTTPS://', 'ftp://'])}{rng.choice(['', '', 'u:p@', 'u@'])}{'.'.join(label() for _ in range(rng.randint(1, 3)))}{rng.choice(['', '.', ':80', ':443', ':8080', ':x', ':99999', ':'])}{rng.choice(['', '/', '/A/b', '?q', '#f', '/p?q#f'])}" for _ in range(250)]
    cases += ["", None, "  H.org/x ", "http://[::1]:8080/a", "[::1]", "https://", "http://a..b/", "x" * 64 + ".org", "http://ab.c./"]
    got = [r["site_url"] for r in s.with_site(spark.createDataFrame(list(enumerate(cases)), "i int, t string"), F.col("t")).orderBy("i").collect()]
    for case, url in zip(cases, got, strict=True):
        assert url == plain_url(case), case


def test_links_equal_the_standard_library(spark):
    rng = random.Random(5)
    seed = "https://H.org/a/b"
    refs = ["", "x", "../y", "/z?q#f", "//h.org/k", "//other.org/", "http://h.org/", "https://h.org:443/q", "https://u@h.org/", "#f", "?q", "mailto:a@b", "HTTPS://H.ORG/Up", "./../../..", "a/./b/../c;d", "http://[bad", None]
    refs += ["".join(rng.choices(["..", "/", ".", "a", "b?c", "//", "h.org", ":"], k=rng.randint(1, 6))) for _ in range(150)]

    def plain(ref):
        if ref is None:
            return None
        try:
            j = urljoin(seed, ref)
            p = urlsplit(j)
            port = lambda u: None if u.port in (None, 443 if u.scheme.lower() == "https" else 80) else u.port
            if p.scheme.lower() not in ("http", "https") or p.username or p.password or ((p.hostname or "").lower(), port(p)) != ("h.org", None):
                return None
        except ValueError:
            return None
        return urlunsplit((p.scheme.lower(), p.netloc.lower(), p.path or "/", "", ""))

    df = spark.createDataFrame(list(enumerate(refs)), "i int, r string")
    got = [r["u"] for r in df.select("i", s.site_link(F.lit(seed), F.lit(seed), F.col("r")).alias("u")).orderBy("i").collect()]
    for ref, url in zip(refs, got, strict=True):
        assert url == plain(ref), ref


def test_keys_and_priorities(spark):
    urls = ["https://h.org/", "http://h.org:8080/x", "https://h.org/About/us", "https://h.org/a/b", None]
    got = spark.createDataFrame(list(enumerate(urls)), "i int, u string").select("i", s.site_key(F.col("u")).alias("k"), s.link_priority(F.col("u")).alias("p")).orderBy("i").collect()
    assert got[0]["k"] == got[2]["k"] and got[0]["k"].startswith("h-org--") and got[1]["k"].startswith("h-org-8080--") and got[4]["k"] is None
    assert [r["p"]["url"] for r in sorted(got[:4], key=lambda r: tuple(r["p"]))] == [urls[2], urls[1], urls[0], urls[3]]


RISK = {"asset_criticality": "high", "environment": "production", "sensitive_data": True, "requires_auth": None, "confidence": 0.5, "reason": "r", "evidence_ids": ["e"]}
AT = dt.datetime(2026, 1, 1, 12)


def profile(**more):
    return {"target": "h.org", "type": "site", "subject_host": "H.org.", "description": "A shop", "business_processes": ["sells"], "analysis_source": "llm", "sources": ["s1"], "risk_context": RISK, "verified_by": "human:me", "verified_at": AT, "stale_after": dt.date(2027, 1, 1), "profile_revision": None} | more


def frame(spark, *rows):
    df = spark.createDataFrame(list(rows), sp.PROFILE)
    return df.withColumn("profile_revision", F.coalesce("profile_revision", sp.revision_digest()))


@pytest.mark.parametrize(
    "wrong, error",
    [({}, None), ({"profile_revision": "0" * 64}, "content"), ({"profile_revision": "x"}, "no hash"), ({"subject_host": "other.org"}, "another host"), ({"subject_host": None}, None), ({"verified_by": "llm:x"}, "no person"), ({"verified_by": "human: "}, "no person"), ({"type": " "}, "type"), ({"description": None}, "description"),
     ({"target": "ftp://h.org"}, "target"), ({"business_processes": ["a"] * 6}, "business"), ({"business_processes": ["a", " "]}, "business"), ({"risk_context": None}, None), ({"risk_context": RISK | {"environment": "live"}}, "environment"), ({"risk_context": RISK | {"evidence_ids": []}}, "without evidence"),
     ({"risk_context": RISK | {"confidence": None}}, "confidence"), ({"risk_context": RISK | {"evidence_ids": [None]}}, "evidence_ids"), ({"verified_at": None}, "time")],
)
def test_what_makes_a_profile_valid(spark, wrong, error):
    errors = sp.with_errors(frame(spark, profile(**wrong))).first()["errors"]
    assert (errors == []) if error is None else any(error in e for e in errors)


def test_as_of_equals_a_search_of_all_profiles(spark):
    rng = random.Random(3)
    when = lambda: AT + dt.timedelta(hours=rng.randrange(24 * 12))
    made = [profile(target=f"h{rng.randrange(3)}.org", subject_host=None, description=f"d{i}", verified_at=when(), stale_after=rng.choice([None, *[AT.date() + dt.timedelta(days=rng.randrange(16))] * 4]), verified_by=rng.choice(["human:me", "human:me", "bot"])) for i in range(40)]
    profiles = frame(spark, *made)
    keyed = [r.asDict(recursive=True) for r in sp.with_errors(profiles).collect()]
    rows = [(i, f"h{rng.randrange(4)}.org", when()) for i in range(200)] + [(200, None, AT), (201, "h0.org", None)]
    df = spark.createDataFrame(rows, "i int, t string, at timestamp")
    df = s.with_site(df, F.col("t"))
    got = {r["i"]: r for r in sp.as_of(df, profiles).collect()}
    assert len(got) == len(rows)
    for i, _, at in rows:
        own = [p for p in keyed if not p["errors"] and at is not None and p["site"] == got[i]["site"] and p["verified_at"] <= at]
        best = max(own, key=lambda p: (p["verified_at"], p["profile_revision"]), default=None)
        fresh = best is not None and best["stale_after"] is not None and best["stale_after"] >= at.date()
        assert (got[i]["profile"] and got[i]["profile"]["profile_revision"]) == (best["profile_revision"] if fresh else None)


def test_findings_get_what_they_do_not_say(spark):
    given = [{"finding_id": f"f{i}", "ord": i, "vulnerability_name": "n", "severity": "low", "asset_id": "a", "description": "d", "remediation": "r", "meta": {"scanner": "zap", "business_context": b}} for i, b in enumerate([None, {"environment": "test", "sensitive_data": False}, {"asset_criticality": ""}])]
    df = spark.createDataFrame(given, schema.FINDING).withColumns({"target": F.when(F.col("ord") < 2, "HTTPS://h.org/x").otherwise("other.org"), "at": F.lit(AT) + F.expr("interval 1 day")})
    got = [r for r in sp.with_site_context(df, frame(spark, profile())).orderBy("ord").collect()]
    first, second = (r["meta"]["business_context"] for r in got[:2])
    assert (first["asset_criticality"], first["environment"], first["sensitive_data"], first["requires_auth"]) == ("high", "production", True, None) and got[0]["profile_revision"]
    assert (second["environment"], second["sensitive_data"], second["asset_criticality"]) == ("test", False, "high") and got[2]["profile_revision"] is None
    assert sp.with_site_context(df, frame(spark, profile()).limit(0)).filter("profile_revision IS NOT NULL").count() == 0
