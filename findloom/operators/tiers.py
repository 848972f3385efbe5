"""Merge of findings by keys of falling strictness, in order, with vetoes.

Findings are taken in order. One joins the oldest group that holds its strict key; else the oldest that
holds its general key; else, where asked for, the oldest of its name and host; else it begins a group. A
group that already stands for another endpoint's internal server error refuses one. A group's level is
the weakest key that brought a member into it.

That is a sequence, but each finding depends only on earlier ones, so its outcome is the one fixed point
of a step that all findings take at once: given everybody's group so far, find the oldest group that held
my key before me. Rounds repeat until nothing changes, starting from the groups of the weakest key alone,
which are already right where keys refine each other and nothing is refused.

A step moves keys and numbers only. What a key's groups were at any time is a short staircase: for each
group the first place where it held the key, of which only those count that are older than all before.
Repeats are combined on the map side, so a key on a third of all findings costs one row a task and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.functions.text import normalize_name
from findloom.functions.url import none_if_empty, with_target
from findloom.operators import predicates
from findloom.operators.context import with_context
from findloom.operators.merge import merge_groups
from findloom.shared import cut

#: Levels by the number of the tier that brought a finding in.
LEVELS = ("strict", "general", "host_only")
KEYS = ("fp_strict", "fp_general", "fp_host_only")


def server_error_key(findings: DataFrame) -> DataFrame:
    """``findings`` (with ctx) and ``server_key``: the endpoint of an internal server error on a known host, else null."""
    staged, t = with_target(findings, F.coalesce("asset_id", F.lit("")))
    ctx, m = F.col("ctx"), F.col("meta")
    port = F.coalesce(t["port"], m["port"])
    key = F.concat_ws("|", ctx["host"], ctx["scheme"], F.coalesce(port.cast("string"), F.lit("")), ctx["path"], ctx["method"])
    is_error = (normalize_name(F.col("vulnerability_name")) == "internal server error") & (ctx["host"] != "")
    return staged.withColumn("server_key", F.when(is_error, key)).select(*findings.columns, "server_key")


def _oldest(state: DataFrame, tier: str) -> DataFrame:
    """(tier, steps): the groups that hold each key, each with the place from which it does, without those that never count."""
    first = state.filter(F.col(tier).isNotNull()).groupBy(tier, "root").agg(F.min("i").alias("since"))
    lead = first.groupBy(F.col(tier).alias("key")).agg(F.min(F.struct("since", "root")).alias("lead"))
    # a group younger than the one that held the key first is never the oldest
    older = first.join(lead, F.col(tier) == F.col("key")).filter(F.col("root") <= F.col("lead.root"))
    return older.groupBy(tier).agg(F.array_sort(F.collect_list(F.struct("since", "root"))).alias(f"steps_{tier}"))


def _step(state: DataFrame, tiers: list[str], vetoes: bool) -> DataFrame:
    """``state`` with the group and tier of every row, given the groups so far."""
    rows = state
    for t in tiers:
        rows = rows.join(_oldest(state, t), t, "left")
    rows = rows.withColumns({f"to_{t}": F.expr(f"array_min(transform(filter(steps_{t}, x -> x.since < i), x -> x.root))") for t in tiers}).drop(*[f"steps_{t}" for t in tiers])
    free = {t: F.col(f"to_{t}").isNotNull() for t in tiers}

    def settled(df: DataFrame, may: dict[str, Column]) -> DataFrame:
        root, tier = F.when(F.lit(False), F.lit(0).cast("long")), F.when(F.lit(False), F.lit(0))
        for n, t in enumerate(tiers):
            root, tier = root.when(may[t], F.col(f"to_{t}")), tier.when(may[t], F.lit(n))
        return df.select("i", *tiers, "veto", root.otherwise(F.col("i")).alias("root"), tier.otherwise(F.lit(-1)).alias("tier"), F.col("root").alias("was"))

    if not vetoes:
        return settled(rows, free)
    held = state.filter("veto IS NOT NULL").groupBy("root").agg(F.min(F.struct("i", "veto")).alias("h")).select(F.col("root").alias("g"), F.col("h.i").alias("since"), F.col("h.veto").alias("holds"))
    checked = rows.filter("veto IS NOT NULL")
    for t in tiers:
        one = held.select(F.col("g").alias(f"g_{t}"), F.col("since").alias(f"since_{t}"), F.col("holds").alias(f"holds_{t}"))
        checked = checked.join(one, F.col(f"to_{t}") == F.col(f"g_{t}"), "left")
    refused = lambda t: F.coalesce((F.col(f"since_{t}") < F.col("i")) & (F.col(f"holds_{t}") != F.col("veto")), F.lit(False))
    return settled(rows.filter("veto IS NULL"), free).unionByName(settled(checked, {t: free[t] & ~refused(t) for t in tiers}))


def tiered_groups(rows: DataFrame, tiers: tuple[str, ...] = KEYS[:2], veto: str | None = None, order: str = "ord", keep=cut) -> DataFrame:
    """(order, root, tier): for each row the order of its group's first row, and the number of the tier that brought it in (-1: it began the group).

    ``order`` is a number that tells rows apart. Null and empty keys match nothing, a null veto refuses
    nothing. ``keep`` cuts the lineage off after each round. Rounds needed: the longest chain of rows
    whose group hangs on the one before, at most; two where keys refine each other.
    """
    names = [f"t{n}" for n in range(len(tiers))]
    slim = rows.select(F.col(order).cast("long").alias("i"), *[none_if_empty(F.col(t)).alias(n) for t, n in zip(tiers, names, strict=True)], (F.col(veto) if veto else F.lit(None)).cast("string").alias("veto"))
    slim = keep(slim)
    weakest = names[-1]
    start = slim.filter(F.col(weakest).isNotNull()).groupBy(weakest).agg(F.min("i").alias("root"))
    state = keep(slim.join(start, weakest, "left").withColumn("root", F.coalesce("root", "i")))
    vetoes = bool(veto) and bool(slim.filter("veto IS NOT NULL").limit(1).count())
    while True:
        state = keep(_step(state, names, vetoes))
        if not state.filter("root <> was").limit(1).count():
            return state.select(F.col("i").alias(order), "root", "tier")
        state = state.drop("was", "tier")


def merge_tiers(findings: DataFrame, use_host_only: bool = False, keep=cut) -> DataFrame:
    """Findings (with ``FINGERPRINTS``) merged by their keys; ``server_key`` is worked out where they don't have it.

    Of one group one row is left, as ``merge_groups`` makes it, with the level of the weakest key that
    brought a member in. Host-only matches may join what is not one issue and are off by default.
    """
    keyed = findings if "server_key" in findings.columns else keep(server_error_key(with_context(findings.drop("ctx"))).drop("ctx"))
    found = tiered_groups(keyed, KEYS if use_host_only else KEYS[:2], "server_key", keep=keep)
    worst = found.groupBy("root").agg(F.max("tier").alias("worst"))
    level = F.try_element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.col("worst"), F.lit(0)) + 1)
    of = found.join(worst, "root").select(F.col("ord").alias("_ord"), F.col("root").cast("string").alias("_root"), level.alias("_level"))
    rows = keyed.drop("server_key").join(of, F.col("ord") == F.col("_ord")).drop("_ord")
    merged = merge_groups(rows, "_root", F.col("_level"), fingerprints=KEYS, keep=keep)
    return merged.drop("_root", "_level")


def deduplicate(findings: DataFrame, use_host_only: bool = False, keep=cut) -> tuple[DataFrame, DataFrame]:
    """``merge_tiers`` without what an adapter's transport made up, and one row of counts: original, deduplicated, merged and suppressed findings."""
    kept, dropped = predicates.split_artifacts(findings)
    merged = keep(merge_tiers(kept, use_host_only, keep))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    counts = n(kept, "original_findings_count").join(n(merged, "deduplicated_findings_count")).join(n(dropped, "suppressed_adapter_findings_count"))
    return merged, counts.withColumn("duplicates_merged", F.col("original_findings_count") - F.col("deduplicated_findings_count"))
