"""Lenient scalars: numbers, flags, labels, dates, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CVE = r"(?i)CVE-[0-9]{4}-[0-9]{4,7}"


def to_float(value: Column) -> Column:
    """A number or numeric text, a trailing percent sign dropped; else null."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\s*%$", "").try_cast("double")


def to_fraction(value: Column) -> Column:
    """Values in (1, 100] are per cent; the result is within 0 and 1."""
    v = to_float(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((v > 1) & (v <= 100), v / 100).otherwise(v))))


def to_bool(value: Column) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "yes", "y", "1", "listed"), True).when(low.isin("false", "no", "n", "0", "unlisted", "not listed"), False)


def to_ints(value: Column) -> Column:
    """All runs of digits, as numbers."""
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"([0-9]+)"), 1), lambda x: x.try_cast("int"))


def first_value(*values: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def cve_id(value: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(value, F.lit("")), f"({CVE})", 1)), F.lit(""))


def cve_ids(*values: Column) -> Column:
    """All CVE ids in the texts, upper case, in order, each once."""
    text = F.concat_ws(" ", *values)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({CVE})"), 1), F.upper))


def exact_cve_ids(values: Column) -> Column:
    """Those entries of an array that are a CVE id in full."""
    return F.array_distinct(F.transform(F.filter(values, lambda v: F.trim(v).rlike(f"^{CVE}$")), lambda v: F.upper(F.trim(v))))


def criticality(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("critical", "high"), "high").when(low.isin("medium", "med", "moderate"), "medium").when(low == "low", "low").otherwise("unknown")


def environment(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return (
        F.when(low.isin("production", "prod", "live"), "production")
        .when(low.isin("development", "dev"), "development")
        .when(low.isin("test", "testing", "qa"), "test")
        .when(low.isin("staging", "stage", "preprod", "pre-prod"), "staging")
        .otherwise("unknown")
    )


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """Hex of the hash of the parts, null as empty, joined by a double colon."""
    return F.substring(F.sha2(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def run_timestamp(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{8}_[0-9]{6}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd_HHmmss")))


def lenient_date(value: Column) -> Column:
    """An ISO date or date-time, or a leading date."""
    return F.coalesce(F.try_to_timestamp(value).cast("date"), F.try_to_timestamp(F.regexp_extract(value, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)).cast("date"))


def _port_parts(spec: Column):
    """The parts of a list of ports, how to tell a good one, and its first and last port."""
    end = lambda p, i: F.split_part(p, F.lit("-"), F.lit(i)).try_cast("int")
    fit = lambda x: F.coalesce((x >= 1) & (x <= 65535), F.lit(False))
    first, last = lambda p: end(p, 1), lambda p: F.when(F.contains(p, F.lit("-")), end(p, 2)).otherwise(end(p, 1))
    good = lambda p: p.rlike(r"^[0-9]{1,5}(-[0-9]{1,5})?$") & fit(first(p)) & fit(last(p)) & (first(p) <= last(p))
    return F.transform(F.split(spec, ","), lambda p: F.trim(p)), good, first, last


def ports(spec: Column) -> Column:
    """80,443,8000-8010 as sorted, distinct numbers; parts that are no ports are left out.

    A range is built only once both its ends are known to be ports.
    """
    parts, good, first, last = _port_parts(spec)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, good), lambda p: F.sequence(first(p), last(p))))))


def ports_valid(spec: Column) -> Column:
    """Whether every part of the list is a port, or a range from a lower to a higher one."""
    parts, good, _, _ = _port_parts(spec)
    return F.forall(parts, good)


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score >= 0.1, "low").otherwise("info")
