"""Answers of a decider on pairs: strict parsing, cache keys, bounded requests, use and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.coerce import pair_key
from findloom.functions.text import snippet

#: The fields that an answer has, no more and no fewer.
FIELDS = ("canonical_title", "confidence", "reason", "same_vulnerability")
PROMPT_VERSION, SEMANTICS_VERSION = "1", "1"
TEXT_LENGTH = 1200


def parsed(answer: Column) -> Column:
    """Struct same, confidence, reason, canonical_title of an exact answer, fenced or plain; null for any other.

    The confidence is a number with a fraction within 0 and 1, the verdict true or false, both texts are
    strings; further fields make an answer invalid.
    """
    text = F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")
    raw = F.from_json(text, "map<string,string>")
    kinds = F.from_json(text, "same_vulnerability boolean, confidence double, reason string, canonical_title string")
    names = F.array_sort(F.map_keys(raw))
    quoted = lambda f: text.rlike(rf'"{f}"\s*:\s*"')
    exact = (names == F.array(*map(F.lit, FIELDS))) & quoted("reason") & quoted("canonical_title") & ~quoted("same_vulnerability") & text.rlike(r'"confidence"\s*:\s*[0-9]*\.[0-9]')
    good = exact & kinds["same_vulnerability"].isNotNull() & (kinds["confidence"] >= 0) & (kinds["confidence"] <= 1)
    out = F.struct(kinds["same_vulnerability"].alias("same"), kinds["confidence"].alias("confidence"), F.trim(kinds["reason"]).alias("reason"), F.trim(kinds["canonical_title"]).alias("canonical_title"))
    return F.when(F.coalesce(good, F.lit(False)), out)


def prompt_payload(side: str = "") -> Column:
    """What a decider is shown of a finding: bounded texts and its place."""
    c = lambda n: F.col(f"{n}{side}")
    ctx = c("ctx")
    return F.struct(F.trim(c("vulnerability_name")).alias("title"), c("severity").alias("severity"), snippet(c("description"), TEXT_LENGTH).alias("description"), snippet(c("remediation"), TEXT_LENGTH).alias("remediation"), ctx.alias("target"), c("meta")["cve_ids"].alias("cve_ids"), c("meta")["cwe"].alias("cwe"), c("meta")["evidence"].alias("evidence"))


def cache_key(a: Column, b: Column, payload_a: Column, payload_b: Column, model: str) -> Column:
    """Content hash of an ordered pair with the versions that its answer depends on."""
    first = a <= b
    ordered = F.struct(pair_key(a, b).alias("pair"), F.when(first, payload_a).otherwise(payload_b).alias("a"), F.when(first, payload_b).otherwise(payload_a).alias("b"), F.lit(model).alias("model"), F.lit(PROMPT_VERSION).alias("prompt"), F.lit(SEMANTICS_VERSION).alias("semantics"))
    return F.sha2(F.to_json(ordered), 256)


def conservative(records: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Of the answers of each key the one that is least sure: the smallest confidence, then the pair's key."""
    return records.groupBy(key).agg(F.min_by(F.struct("pair_key", "confidence", "reason", "canonical_title"), F.struct("confidence", "pair_key")).alias("l")).select(key, "l.*")


def usage(payload: Column) -> Column:
    """Struct prompt_tokens, completion_tokens, total_tokens of a provider's JSON, missing ones 0."""
    number = lambda *names: F.coalesce(*[F.when(F.get_json_object(payload, f"$.usage.{n}").rlike("^[0-9]+$"), F.get_json_object(payload, f"$.usage.{n}").try_cast("long")) for n in names], F.lit(0).cast("long"))
    prompt, completion = number("prompt_tokens", "input_tokens"), number("completion_tokens", "output_tokens")
    total = F.get_json_object(payload, "$.usage.total_tokens")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.when(total.rlike("^[0-9]+$"), total.try_cast("long")).otherwise(prompt + completion).alias("total_tokens"))


def cost(prompt: Column, completion: Column, input_per_million: float | None, output_per_million: float | None) -> Column:
    """Price of the tokens, to eight decimals; null without prices."""
    if input_per_million is None or output_per_million is None:
        return F.lit(None).cast("double")
    return F.bround(prompt * F.lit(float(input_per_million)) / 1_000_000 + completion * F.lit(float(output_per_million)) / 1_000_000, 8)


def failure(status: Column, text: Column) -> Column:
    """Kind of a provider's failure, by HTTP status, then by its words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in (*words, words[0])])
    return F.when(status.isin(401, 403), "authentication").when(status == 429, "rate_limit").when(status == 404, "not_found").when(status >= 500, "provider_error").when(has("timeout", "timed out"), "timeout").when(has("connection", "unreachable"), "connection").otherwise("unknown")


def totals(records: DataFrame) -> DataFrame:
    """Run totals of requests, in one row."""
    return records.agg(F.count("*").alias("requests"), F.count_if("hit").alias("cached"), F.count_if(~F.col("hit")).alias("sent"), F.coalesce(F.sum("usage.total_tokens"), F.lit(0)).alias("total_tokens"), F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 8).alias("cost"))
