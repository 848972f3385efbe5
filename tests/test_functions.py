import pytest
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions import coerce, text, url


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("SQLi in login form", "sql injection login form"), ("Possible XSS vulnerability", "cross site scripting"), ("XSS - cross site", "cross site scripting"), ("", ""), (None, ""),
        ("Content-Security-Policy header not set", "missing content security policy header"), ("CSP missing", "missing content security policy header"), ("X-Frame-Options header deprecated", "x frame options header deprecated"),
        ("Clickjacking protection", "missing clickjacking protection header"),
    ],
)
def test_names(spark, name, expected):
    assert one(spark, text.normalize_name(F.col("v")), name) == expected


@pytest.mark.parametrize(
    ("target", "host", "port", "scheme", "path", "query"),
    [
        ("https://Shop.example.org:8443/A/b?x=1#f", "shop.example.org", 8443, "https", "/A/b", "x=1"), ("db.local:5432", "db.local", 5432, "", "", ""), ("plainhost", "plainhost", None, "", "", ""),
        ("[2001:db8::1]:443", "2001:db8::1", 443, "", "", ""), ("http://user@h_x/ a<b", "h_x", None, "http", "/ a<b", ""), ("", "", None, "", "", ""), (None, "", None, "", "", ""), ("2001:db8::1", "2001:db8::1", None, "", "", ""),
    ],
)
def test_targets(spark, target, host, port, scheme, path, query):
    assert tuple(one(spark, url.parse_target(F.col("v")), target)) == (host, port, scheme, path, query)


def test_fingerprint_defaults(spark):
    a = one(spark, url.fingerprints(F.lit("XSS"), F.col("v")), "https://e.org:443/a//B/?b=1&a=2&c=")
    b = one(spark, url.fingerprints(F.lit("cross site scripting"), F.col("v")), "https://E.org/a/b?a=9&b=3")
    assert a == b
    assert a.strict == "cross site scripting::e.org::/a/b::a&b"
    assert one(spark, url.fingerprints(F.lit("x1"), F.col("v")), "https://e.org:8443/").general == "x1::e.org::8443"


def test_families_and_slugs(spark):
    assert one(spark, url.endpoint_family(F.col("v")), "/api/12345/items") == "/api/{id}"
    assert one(spark, url.endpoint_family(F.col("v")), "/u/deadbeef00/x") == "/u/{id}"
    assert one(spark, url.target_slug(F.col("v")), "https://a-b.org:8080/x") == "a_b_org_8080"
    assert one(spark, url.is_loopback(F.col("v")), "http://127.0.0.1:9/") is True
    assert one(spark, url.remap_origin(F.col("v"), F.lit("http://127.0.0.1:81"), F.lit("https://o.org")), "http://localhost:81/p?q=1") == "https://o.org/p?q=1"


def test_coercions(spark):
    assert one(spark, coerce.to_fraction(F.col("v")), "85 %") == 0.85
    assert one(spark, coerce.to_float(F.col("v")), "n/a") is None
    assert one(spark, coerce.to_bool(F.col("v")), "Unlisted") is False
    assert one(spark, coerce.cve_ids(F.col("v")), "see cve-2024-0001, CVE-2024-0001 and CVE-2023-12345") == ["CVE-2024-0001", "CVE-2023-12345"]
    assert one(spark, coerce.ports(F.col("v")), "443, 80,8000-8002,70000") == [80, 443, 8000, 8001, 8002]
    assert str(one(spark, coerce.lenient_date(F.col("v")), "2024-05-01 rest")) == "2024-05-01"
    assert one(spark, coerce.run_timestamp(F.col("v")), "20241399_000000") is None
    assert one(spark, schema.severity(F.col("v")), " Moderate ") == "medium"
    assert one(spark, schema.severity(F.col("v")), None) == "info"


def test_texts(spark):
    assert one(spark, text.redact(F.col("v")), 'api_key = "abcdef123456" ok') == "api_key = [redacted] ok"
    assert one(spark, text.strip_html(F.col("v")), "<p>a &lt;b&gt;</p>\n<i>c</i>") == "a <b> c"
    assert len(one(spark, text.snippet(F.col("v")), "x" * 500)) == 160
    assert one(spark, text.jaccard(F.col("v"), F.array(F.lit("a"))), [], "array<string>") == 0.0
