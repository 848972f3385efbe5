"""Row predicates and validation as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.text import pattern_of
from findloom.functions.url import is_loopback

#: How scanners say that they could not reach their local adapter.
NO_CONNECTION = (
    "unable to connect to",
    "failed to connect to",
    "could not connect to",
    "cannot connect to",
    "can't connect to",
)
CONNECTION_LOST = (
    "connection refused",
    "connection failed",
    "connection reset",
    "connection timed out",
)
LOCAL_HOSTS = (
    "localhost",
    "127.0.0.1",
    "::1",
    "[::1]",
    "[::1",
    "::1]",
)
#: The adapter's own server, and what is said of it; how far apart the two may stand.
BANNER_CHANGED, ADAPTER_SERVER = "server banner changed", "uvicorn"
APART, LOST_APART = 160, 120


def _local(boundary: str = r"\b") -> str:
    return pattern_of(LOCAL_HOSTS, whole=False) + r"(?::\d+)?" + boundary


def connectivity_patterns() -> tuple[str, str]:
    """A failure and the local host right after it, or a lost connection and the host in the same sentence."""
    return rf"(?i)\b{pattern_of(NO_CONNECTION, whole=False)}\s+(?:https?://)?{_local()}", rf"(?i)\b{pattern_of(CONNECTION_LOST, whole=False)}\b[^.]{{0,{LOST_APART}}}{_local()}"


def banner_patterns() -> tuple[str, str]:
    """Both phrases near one another, in either order."""
    said, server = (rf"\b{pattern_of((x,), whole=False)}\b" for x in (BANNER_CHANGED, ADAPTER_SERVER))
    return rf"(?i){said}.{{0,{APART}}}{server}", rf"(?i){server}.{{0,{APART}}}{said}"


def _adapter() -> Column:
    m = F.col("meta")
    return F.coalesce(m["adapter_mode"].isin("bridge", "proxy") & is_loopback(m["effective_target"]) & ~is_loopback(m["original_target"]), F.lit(False))


def _text() -> Column:
    return F.concat_ws(" ", "vulnerability_name", "asset_id", "description", "meta.effective_target")


def connectivity_artifact() -> Column:
    return _adapter() & reduce(lambda a, b: a | b, [_text().rlike(p) for p in connectivity_patterns()])


def transport_artifact() -> Column:
    return connectivity_artifact() | (_adapter() & reduce(lambda a, b: a | b, [_text().rlike(p) for p in banner_patterns()]))


def split_artifacts(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings, and rows that only report the adapter."""
    return findings.filter(~transport_artifact()), findings.filter(transport_artifact())


def errors(*checks: tuple[Column, str]) -> Column:
    """Messages of the failed checks; a check is the failing condition."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks]))


def finding_errors() -> Column:
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    out = lambda c, lo, hi: (F.col(c) < lo) | (F.col(c) > hi)
    return errors(
        (blank("vulnerability_name"), "vulnerability_name is missing"), (~F.col("severity").isin(*schema.SEVERITIES) | F.col("severity").isNull(), "severity is not a level"),
        (F.col("asset_id").isNull(), "asset_id is missing"), (F.col("description").isNull(), "description is missing"), (F.col("remediation").isNull(), "remediation is missing"), (F.col("meta").isNull(), "meta is missing"),
        (blank("meta.scanner"), "meta.scanner is missing"), (out("meta.port", 0, 65535), "meta.port is out of range"), (out("meta.cvss_score", 0, 10), "meta.cvss_score is out of range"),
        (out("meta.epss_score", 0, 1), "meta.epss_score is out of range"), (out("meta.epss_percentile", 0, 1), "meta.epss_percentile is out of range"),
    )


def assert_valid(findings: DataFrame, shown: int = 20) -> None:
    """Raise with the first violations and their number; nothing more reaches the driver."""
    bad = findings.select("finding_id", finding_errors().alias("e")).filter(F.size("e") > 0)
    head = bad.limit(shown).collect()
    if head:
        raise ValueError(f"{bad.count()} invalid findings, such as " + "; ".join(f"{r.finding_id}: {', '.join(r.e)}" for r in head))


def rule_matches(rule: dict[str, Column], asset: Column, host: Column, path: Column) -> Column:
    """All of the rule's fields agree; suffixes match at a dot."""
    suffix = (host == rule["host_suffix"]) | host.endswith(F.concat(F.lit("."), rule["host_suffix"]))
    tests = ((rule["asset_id"], asset == rule["asset_id"]), (rule["host"], host == rule["host"]), (rule["host_suffix"], suffix), (rule["path_prefix"], path.startswith(rule["path_prefix"])))
    return reduce(lambda x, y: x & y, [field.isNull() | F.coalesce(test, F.lit(False)) for field, test in tests])
