"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network
routes the words of each pattern to the quotas of its sources: every further repetition of a pattern
costs more than the one before (convex costs), so the flow of least cost repeats as little as the
quotas allow. Patterns that share no source, directly or through others, are networks of their own,
so each connected part is solved in a task; one part's size is the number of its patterns and
sources, never of documents. Ranks of sources and their targets are found by Spark jobs, of which
only sums reach the driver.

Then documents are selected in a seeded order, a hash of seed, doc_id and text, until a pattern's
flow would be passed. While the documents next in order can't fill the gap, it is cut again over all
unchosen documents of at most half its size; then those whose sizes fit it best close it. Each such
step takes at least a quarter of the gap, and they end when no document left over fits into it.

The answer is a few rules for each pattern (take what is up to this size and up to this place in the
order) and a few single places, so a row is decided where it is read: no text moves. The order is
cut by running sums over 4096 ranges of the hash; only the one range where a pattern's flow ends is
summed document by document, so a source with most of all rows is spread over the whole cluster.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.arrays import groups
from findloom.llm.components import components
from findloom.llm.scratch import Scratch

SHARE, MOST = 1.5, 2
WEIGHTS = (5, 2, 1)
SEED = 17
#: Documents in the seeded order, of at most half the gap and above it each, that one best subset is taken of.
FILLERS = 256
#: Sizes are told apart to this share of the gap when a best subset is sought, which bounds its memory.
GRAIN = 1 << 20
#: Rules are broadcast up to so many characters and rows; beyond, rows are joined with them.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 4_000_000


def word_count(text: Column) -> Column:
    """Number of runs of other bytes than 0x20 and 0x09-0x0D; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: int) -> Column:
    """A row's place in the seeded order; rows that repeat both doc_id and text share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``rank`` from 0, by code point of the source, null last."""
    order = (F.col("source").isNull(), F.col("source"))
    kept = scratch.keep(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "ranked")
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.p, r.n) for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = kept.sparkSession.createDataFrame(before, "p long, before long")
    return kept.join(F.broadcast(offsets), part == F.col("p")).withColumn("rank", F.col("before") + inside).drop("id", "p", "before")


def targets(sources: DataFrame, scratch: Scratch, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources(source, words)`` with rank and target: ``share`` of all words by weight, at most ``most`` times a source's own.

    The excess of sources that stop is reshared by weight until none is above. Only the sums over the
    sources that have stopped are gathered, round by round.
    """
    by_rank = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    table = scratch.keep(_ranked(sources, scratch).withColumn("weight", by_rank), "weighed")
    total = table.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    rest, weight, stopped = share * (total.words or 0), total.weight or 1.0, 0
    while True:
        full = F.lit(rest) * F.col("weight") / F.lit(weight) > most * F.col("words")
        over = table.filter(full).agg(F.sum("words").alias("words"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
        if over.n == stopped or over.n == total.n:
            break
        stopped, rest, weight = over.n, share * total.words - most * over.words, total.weight - over.weight
    return table.withColumn("target", F.when(full, most * F.col("words").cast("double")).otherwise(F.lit(rest) * F.col("weight") / F.lit(weight)))


class Flow:
    """Minimum-cost flow by successive shortest paths, all arcs with integer capacity and cost."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to, self.cap, self.cost = [], [], []

    def arc(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, d in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(d)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            far = [float("inf")] * len(self.out)
            via, queued, queue = [-1] * len(self.out), [False] * len(self.out), deque([source])
            far[source] = 0
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] and far[a] + self.cost[e] < far[b]:
                        far[b], via[b] = far[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[sink] < 0:
                return
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push


def route(patterns: list[tuple[tuple, int]], quota: dict, most: int = MOST) -> list[int]:
    """Words to take of each pattern (its sources, its words), at most ``most`` times its words."""
    names = list(quota)
    node = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    sink = 1 + len(patterns) + len(names)
    net = Flow(sink + 1)
    arcs = []
    for i, (sources, words) in enumerate(patterns):
        arcs.append([net.arc(0, 1 + i, words, k * k) for k in range(1, most + 1)])
        for s in sources:
            net.arc(1 + i, node[s], most * words, 0)
    for s in names:
        net.arc(node[s], sink, int(quota[s]), 0)
    net.run(0, sink)
    return [sum(net.cap[e ^ 1] for e in es) for es in arcs]


def flows(patterns: DataFrame, sources: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """``patterns(pattern, words)`` with the words to take of each, for ``sources(source, rank, target)``."""
    numbered = scratch.keep(patterns.withColumn("pid", F.monotonically_increasing_id()), "patterns")
    each = numbered.select("pid", F.explode("pattern").alias("source")).alias("e").join(sources.alias("s"), F.expr("e.source <=> s.source")).select("pid", "rank")
    each = scratch.keep(each.groupBy("pid").agg(F.array_sort(F.collect_set("rank")).alias("ranks")), "each")
    shared = each.filter("size(ranks) > 1").select(F.col("ranks")[0].alias("a"), F.explode("ranks").alias("b"))
    parts = components(shared, scratch)
    of = lambda rank: F.coalesce("component", rank).alias("part")
    quotas = sources.join(parts, F.col("rank") == F.col("id"), "left").select(of("rank"), F.lit(0).alias("kind"), F.col("rank").alias("id"), F.round("target").cast("long").alias("words"), F.array().cast("array<long>").alias("ranks"))
    nodes = each.join(numbered, "pid").withColumn("first", F.col("ranks")[0]).join(parts, F.col("first") == F.col("id"), "left").select(of("first"), F.lit(1).alias("kind"), F.col("pid").alias("id"), "words", "ranks")
    dealt = quotas.union(nodes).repartition("part").sortWithinPartitions("part", "kind", "id")

    def solve(batches):
        for g in groups(batches, ["part"]):
            kind, ids, words, ranks = (g.column(c).to_pylist() for c in ("kind", "id", "words", "ranks"))
            n = kind.count(0)
            taken = route(list(zip(map(tuple, ranks[n:]), words[n:], strict=True)), dict(zip(ids[:n], words[:n], strict=True)), most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n:], pa.int64()), pa.array(taken, pa.int64())], names=["p", "flow"])

    solved = dealt.mapInArrow(solve, "p long, flow long")
    return scratch.keep(numbered.join(solved, F.col("pid") == F.col("p")).select("pattern", "words", "flow"), "flows")


def best_subset(sizes: list[int], gap: int) -> list[int]:
    """Indices of those sizes whose sum comes closest to the gap (never above it if sizes are grained)."""
    unit = -(-gap // GRAIN)
    gap, sizes = gap // unit, [-(-x // unit) for x in sizes]
    reach, states = 1, []
    for size in sizes:
        states.append(reach)
        reach |= (reach << size) & ((1 << (2 * gap)) - 1)
    at = (reach & ((1 << (gap + 1)) - 1)).bit_length() - 1
    if unit == 1 and reach >> gap:
        above = (reach >> gap & -(reach >> gap)).bit_length() - 1 + gap
        at = above if above - gap < gap - at else at
    chosen = []
    for i in reversed(range(len(sizes))):
        if not states[i] >> at & 1:
            chosen.append(i)
            at -= sizes[i]
    return chosen


def _closest(group: pd.DataFrame) -> pd.DataFrame:
    """Of the spare places of a pattern those whose sizes sum up closest to its gap."""
    group = group.sort_values("nth", ignore_index=True)
    return group.iloc[best_subset(group["size"].astype(int).tolist(), int(group["gap"].iloc[0]))][["pattern", "key", "size"]]


def _cut(rows: DataFrame, need: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, hi, got): the last place up to which the sizes of ``rows`` are within ``need(pattern, need)``, and their sum.

    If all rows are within it, the last place is the greatest there is.
    """
    span = F.shiftright("key", 52)
    running = Window.partitionBy("pattern").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    words = scratch.keep(rows.groupBy("pattern", span.alias("span")).agg(F.sum("size").alias("words")), "spans")
    spans = words.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    border = spans.join(need, "pattern").filter("before <= need AND before + words > need").select("pattern", F.col("span").alias("last"), "before", "need")
    border = scratch.keep(border, "border")
    inner = Window.partitionBy("pattern").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.join(border, "pattern").filter(span == F.col("last")).withColumn("sum", F.col("before") + F.sum("size").over(inner)).filter("sum <= need")
    ends = inside.groupBy("pattern").agg(F.max("key").alias("end"), F.max("sum").alias("sum"))
    start = F.shiftleft("last", 52) - 1  # the end of the range before; none before the first
    start = F.when(F.col("last") > -2048, start).otherwise(F.lit(-(1 << 63)))
    total = words.groupBy("pattern").agg(F.sum("words").alias("all"))
    none = need.join(border, "pattern", "left_anti").join(total, "pattern", "left").select("pattern", F.lit((1 << 63) - 1).alias("hi"), F.coalesce("all", F.lit(0)).alias("got"))
    return border.join(ends, "pattern", "left").select("pattern", F.coalesce("end", start).alias("hi"), F.coalesce("sum", "before").alias("got")).unionByName(none)


def decide(sizes: DataFrame, wanted: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rules (pattern, times, rules) and single places (pattern, key) that take ``wanted(pattern, words, flow)`` of ``sizes(pattern, key, size)``.

    All rows are taken flow div words times; rows of a rule, and single places, once more.
    """
    need = wanted.select("pattern", F.expr("CASE WHEN words > 0 THEN flow div words ELSE 0 END").alias("times"), F.expr("CASE WHEN words > 0 THEN flow % words ELSE 0L END").alias("need"))
    cut = scratch.keep(_cut(sizes.filter("size > 0"), need.select("pattern", "need"), scratch), "cut")
    no_limit = F.lit((1 << 63) - 1)
    rules, extra = [cut.select("pattern", no_limit.alias("limit"), "hi")], []
    gaps = scratch.keep(need.join(cut, "pattern").select("pattern", (F.col("need") - F.col("got")).alias("gap")).filter("gap > 0"), "gaps")
    left = sizes.filter("size > 0").join(cut, "pattern").filter("key > hi").join(gaps, "pattern").filter("size < 2 * gap")
    left = scratch.keep(left.groupBy("pattern", "key").agg(F.sum("size").alias("size")), "left")
    while gaps.limit(1).count():
        near = left.join(gaps, "pattern").filter("size < 2 * gap").withColumn("small", F.expr("2 * size <= gap"))
        nth = F.row_number().over(Window.partitionBy("pattern", "small").orderBy("key"))
        spare = scratch.keep(near.withColumn("nth", nth).filter(f"nth <= {FILLERS}"), "spare")
        stats = spare.filter("small").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("gap").alias("gap"))
        # the cut leaves a quarter of what a subset can take, for the exact fit
        short = scratch.keep(stats.filter(f"n = {FILLERS} AND words < gap").select("pattern", (F.col("gap") - F.expr("words div 4")).alias("need")), "short")
        single = scratch.keep(spare.join(short, "pattern", "left_anti").groupBy("pattern").applyInPandas(_closest, "pattern array<string>, key long, size long"), "single")
        again = scratch.keep(_cut(near.filter("small").join(short, "pattern", "left_semi").select("pattern", "key", "size"), short, scratch).join(gaps, "pattern"), "again")
        rules.append(again.select("pattern", F.expr("gap div 2").alias("limit"), "hi"))
        extra.append(single.select("pattern", "key"))
        got = single.groupBy("pattern").agg(F.sum("size").alias("got")).union(again.select("pattern", "got"))
        taken = left.join(again.select("pattern", "hi", "gap"), "pattern", "left").filter("hi IS NULL OR key > hi OR 2 * size > gap").select("pattern", "key", "size")
        fresh = scratch.keep(gaps.join(got.filter("got > 0"), "pattern").select("pattern", (F.col("gap") - F.col("got")).alias("gap")).filter("gap > 0"), "gaps")
        rest = scratch.keep(taken.join(single.select("pattern", "key"), ["pattern", "key"], "left_anti").join(fresh, "pattern", "left_semi"), "left")
        scratch.drop(left)
        gaps, left = fresh, rest
    each = reduce(DataFrame.union, rules).groupBy("pattern").agg(F.collect_list(F.struct("limit", "hi")).alias("rules"))
    places = reduce(DataFrame.union, extra) if extra else sizes.select("pattern", "key").limit(0)
    return scratch.keep(need.select("pattern", "times").join(each, "pattern", "left"), "rules"), scratch.keep(places, "places")


def _times(rows: DataFrame, rules: DataFrame, places: DataFrame) -> DataFrame:
    """``rows(pattern, key, size, ...)`` with ``copies``: how often the mix takes each."""
    chars = rules.agg(F.coalesce(F.sum(F.length(F.concat_ws("", "pattern")) + 16 * F.size("rules")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    few = chars.n <= BROADCAST_CHARS and chars.rows <= BROADCAST_ROWS and places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda df: df
    marked = rows.join(hint(rules), "pattern").join(hint(places.withColumn("single", F.lit(True))), ["pattern", "key"], "left")
    ruled = F.exists("rules", lambda r: (F.col("size") <= r["limit"]) & (F.col("key") <= r["hi"]))
    return marked.withColumn("copies", F.col("times").cast("int") + F.when(F.coalesce(ruled, F.lit(False)) | F.coalesce("single", F.lit(False)), 1).otherwise(0)).drop("times", "rules", "single")


def _solved(sizes: DataFrame, scratch: Scratch, share: float, most: int, weights: tuple) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with their sizes and targets, rules and single places for ``sizes(pattern, key, size)``."""
    by = scratch.keep(sizes.groupBy("pattern").agg(F.sum("size").alias("words")), "by")
    sources = scratch.keep(targets(by.select(F.explode("pattern").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words")), scratch, share, most, weights), "sources")
    return sources, *decide(sizes, flows(by, sources, scratch, most), scratch)


def mix_sources(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Each row of ``docs`` with doc_id, size, source_size, target and taken (words, repeats counted).

    Sources in code-point order, null last, take the weights in turn. Null texts have size 0. A
    document belongs to the one source it names, so its pattern is that source; ``mix_members`` takes
    documents of several sources. Rows that repeat doc_id, source and text are taken alike. An empty
    table gives no rows. The order depends on seed, doc_id and text only, so reruns agree.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(F.col("source").cast("string")).alias("pattern"), place(seed).alias("key"), word_count(F.col("text").cast("string")).alias("size")), "sizes")
    sources, rules, places = _solved(sizes.select("pattern", "key", "size"), scratch, share, most, weights)
    named = sources.select(F.array("source").alias("pattern"), F.col("words").alias("source_size"), "target")
    return _times(sizes, rules, places).join(named, "pattern").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_members(docs: DataFrame, members: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, sources, size and taken of each row of ``docs``, for ``members(doc_id, source)`` of overlapping sources.

    A document counts in full for each of its sources. Documents without a source, and rows with a
    null doc_id, are in none and left out.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = members.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("source").cast("string"))).alias("pattern")).filter("size(pattern) > 0")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place(seed).alias("key"), word_count(F.col("text").cast("string")).alias("size"))
    sizes = scratch.keep(rows.join(own, "doc_id"), "sizes")
    _, rules, places = _solved(sizes.select("pattern", "key", "size"), scratch, share, most, weights)
    return _times(sizes, rules, places).select("doc_id", F.col("pattern").alias("sources"), "size", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Documents without words, and null texts, weigh nothing: they come as often as all of their source
    do, at least once if the source is taken at all. Rows are decided where they are read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    keys = (F.array(F.col("source").cast("string")).alias("pattern"), place(seed).alias("key"), word_count(F.col("text").cast("string")).alias("size"))
    _, rules, places = _solved(scratch.keep(docs.select(*keys), "sizes"), scratch, share, most, weights)
    marked = _times(docs.select(F.struct(*docs.columns).alias("row"), *keys), rules, places)
    copies = F.when(F.col("size") == 0, F.greatest("copies", F.lit(1))).otherwise(F.col("copies"))
    return marked.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
