"""Profiles of sites that a person has confirmed: what makes one valid, and which one holds at a time.

A profile is a row of ``PROFILE``: one immutable revision. Its ``profile_revision`` is the hash of what it
says; a row that says something else than its hash is not valid. ``as_of`` gives each row of a table the
newest valid profile of its site at its time, and only while that is fresh.

The lookup is by site and day: each day on which a site has rows gets the short staircase of its
profile in the morning and of those confirmed during the day. So a site with a third of all rows is
spread over its days, and no window ever holds its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom import schema
from findloom.functions.site import with_site
from findloom.functions.url import none_if_empty, with_target
from findloom.operators.contract import CRITICALITIES, ENVIRONMENTS
from findloom.shared import cut

RISK = "struct<asset_criticality:string,environment:string,sensitive_data:boolean,requires_auth:boolean,confidence:double,reason:string,evidence_ids:array<string>>"
#: The fields of a profile's row.
PROFILE = f"target string, type string, subject_host string, description string, business_processes array<string>, analysis_source string, sources array<string>, risk_context {RISK}, verified_by string, verified_at timestamp, stale_after date, profile_revision string"
#: Fields that a confirmed profile gives to findings which say nothing of their own.
DEFAULTS = ("asset_criticality", "environment", "sensitive_data", "requires_auth")


def _compact(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), 1, limit)


def risk_errors(risk: Column) -> Column:
    """What is wrong with a risk context; a missing one is not."""
    bad = (
        (F.coalesce(~risk["asset_criticality"].isin(*CRITICALITIES), F.lit(True)), "asset_criticality is invalid"), (F.coalesce(~risk["environment"].isin(*ENVIRONMENTS), F.lit(True)), "environment is invalid"),
        (F.coalesce((risk["confidence"] < 0) | (risk["confidence"] > 1), F.lit(True)), "confidence is not between 0 and 1"), (_compact(risk["reason"], 300) == "", "reason is empty"),
        (F.coalesce(F.exists(risk["evidence_ids"], lambda x: x.isNull() | (F.trim(x) == "")), F.lit(True)), "evidence_ids are not texts"),
        ((risk["confidence"] > 0) & (F.size(risk["evidence_ids"]) == 0), "confidence without evidence"),
    )
    return F.when(risk.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(test, F.lit(f"risk_context: {text}")) for test, text in bad])))


def revision_digest() -> Column:
    """The hash of what a profile says, over its row's fields in the order of their names; lists keep theirs."""
    said = {
        "analysis_source": F.coalesce("analysis_source", F.lit("unknown")), "business_processes": F.transform("business_processes", lambda x: _compact(x, 160)), "description": _compact(F.col("description"), 500),
        "risk_context": F.col("risk_context"), "sources": F.col("sources"), "target": F.coalesce("target", F.lit("")),
    }
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(said.items())])), 256)


def with_errors(profiles: DataFrame) -> DataFrame:
    """``profiles`` with site, site_url and ``errors``: why a profile can't be used, none if it can."""
    staged, t = with_target(with_site(profiles, F.col("target")), F.coalesce("site_url", F.lit("")))
    person = F.regexp_extract(F.coalesce("verified_by", F.lit("")), "^human:(.*)$", 1)
    processes = F.coalesce("business_processes", F.array().cast("array<string>"))
    other = lambda c: F.coalesce(F.regexp_replace(F.lower(c), r"\.$", ""), F.lit(""))
    checks = (
        (F.col("site_error").isNotNull(), F.concat(F.lit("target: "), "site_error")), (F.coalesce(F.trim("type"), F.lit("")) == "", F.lit("type is empty")), (_compact(F.col("description"), 500) == "", F.lit("description is empty")),
        (F.trim(person) == "", F.lit("no person has confirmed it")), (F.col("verified_at").isNull(), F.lit("no time of confirmation")), ((other(F.col("subject_host")) != "") & (other(F.col("subject_host")) != t["host"]), F.lit("another host")),
        ((F.size(processes) > 5) | F.coalesce(F.exists(processes, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False)), F.lit("business_processes are not up to five texts")),
        (~F.coalesce(F.col("profile_revision").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("profile_revision is no hash")), (~F.col("profile_revision").eqNullSafe(revision_digest()), F.lit("profile_revision is not that of its content")),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in checks]))
    return staged.withColumn("errors", F.concat(found, risk_errors(F.col("risk_context")))).select(*profiles.columns, "site", "site_url", "errors")


def as_of(rows: DataFrame, profiles: DataFrame, site: str = "site", time: str = "at", keep=cut) -> DataFrame:
    """``rows`` with ``profile``: the newest valid profile of the row's site at its time, null if none or if it is stale by then.

    ``stale_after`` is the last day on which a profile holds; without one it is stale at once. A newer stale
    profile hides an older one. Of two confirmed at one time the greater revision counts. Rows with a null
    site or time have no profile. ``keep`` cuts off the valid profiles, which are read twice.
    """
    good = with_errors(profiles).filter("size(errors) = 0")
    person = F.regexp_extract("verified_by", "^human:(.*)$", 1)
    shown = F.struct("profile_revision", _compact(F.col("description"), 500).alias("description"), person.alias("reviewer"), "verified_at", "stale_after", F.coalesce("analysis_source", F.lit("legacy")).alias("analysis_source"), F.transform("business_processes", lambda x: _compact(x, 160)).alias("business_processes"), "risk_context")
    known = keep(good.select(F.col("site").alias("s"), F.to_date("verified_at").alias("day"), F.struct(F.col("verified_at").alias("since"), "profile_revision", shown.alias("p")).alias("step")))
    day = F.to_date(time)
    days = rows.filter(F.col(site).isNotNull() & F.col(time).isNotNull()).select(F.col(site).alias("s"), day.alias("day")).distinct()
    # a site's days and profiles: few beside its rows
    last = F.last("step", ignorenulls=True).over(Window.partitionBy("s").orderBy("day", "of_day").rowsBetween(Window.unboundedPreceding, -1))
    newest = known.groupBy("s", "day").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    morning = days.select("s", "day", F.lit(0).alias("of_day"), F.lit(None).cast(known.schema["step"].dataType).alias("step")).unionByName(newest.select("s", "day", F.lit(1).alias("of_day"), F.element_at("steps", -1).alias("step")))
    carried = morning.withColumn("before", last).filter("of_day = 0").select("s", "day", "before")
    stairs = carried.join(newest, ["s", "day"], "left").select("s", "day", F.concat(F.array_compact(F.array("before")), F.coalesce("steps", F.array().cast(newest.schema["steps"].dataType))).alias("steps"))
    joined = rows.withColumn("_day", day).join(stairs.select(F.col("s").alias("_s"), F.col("day").alias("_d"), "steps"), (F.col(site) == F.col("_s")) & (F.col("_day") == F.col("_d")), "left")
    # the greatest time not after the row's; the last of an empty array is null
    held = joined.withColumn("_now", F.try_element_at(F.filter("steps", lambda x: x["since"] <= F.col(time)), F.lit(-1))["p"])
    return held.withColumn("profile", F.when(F.coalesce(F.col("_now.stale_after") >= F.col("_day"), F.lit(False)), F.col("_now"))).drop("_s", "_d", "_day", "steps", "_now")


def with_site_context(findings: DataFrame, profiles: DataFrame, target: str = "target", time: str = "at") -> DataFrame:
    """``findings`` whose business context is filled from the profile of their run's target at its time.

    What a finding says of itself stays; a field that the profile leaves open, too. ``profile_revision``
    says which one was used.
    """
    staged = with_site(findings, F.col(target), "_url", "_site", "_error")
    found = as_of(staged, profiles, "_site", time)
    risk, m = F.col("profile.risk_context"), F.col("meta")
    own = lambda f: m["business_context"][f]
    business = F.struct(*[(F.coalesce(none_if_empty(own(f)) if f in DEFAULTS[:2] else own(f), risk[f]) if f in DEFAULTS else own(f)).cast(schema.BUSINESS[f].dataType).alias(f) for f in schema.BUSINESS.names])
    some = F.when(m["business_context"].isNotNull() | risk.isNotNull(), business)
    meta = F.struct(*[(some if f == "business_context" else m[f]).alias(f) for f in schema.META.names])
    return found.withColumns({"meta": meta, "profile_revision": F.col("profile.profile_revision")}).select(*findings.columns, "profile_revision")
