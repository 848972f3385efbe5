"""Near duplicates by SetSketch registers over word shingles.

Sketch. Every shingle draws an ascending series of exponentially spaced points and deals them to
the registers without repetition; a register keeps its least point x as the truncated integer
floor(1 - log_b x). Sketches merge by the register-wise maximum, and two sketches agree in a
register with about the probability of the Jaccard similarity. Only points below a bound that
leaves hardly any register empty are drawn, so the work is in proportion to the set, not to the
set times the registers; a set that leaves a register empty is drawn anew without the bound.

Search. Equal sets are first folded into one node. Bands of registers give buckets. In a bucket all
members are compared with a leader (the one that meets most others), which links nearly all of a
group of near copies in as many comparisons as it has members. Buckets whose members are then still
in different components stay open: their nodes meet by leader, and those outside the commonest
component are compared with all others there, in blocks of bounded size, by the sizes of their
intersections at once. A block gives the best partner in each other component, which is enough to
join components. No step has a cap.

A pair found by sketches is likely by the maximum-likelihood estimate; every link is confirmed on the
full shingle sets of both texts.

Traffic. Texts move once, to those nodes that share a bucket with another; from there on only the
shingle sets of these nodes move. That join never turns into a broadcast, as its list of nodes grows
with the corpus; a bit map of fixed size is broadcast before it, so that nearly all other texts stay
where they are.

Bands are as wide as they can be while two sets at the threshold share a bucket but for 1 in
100,000: 32 bands of 5 registers at 0.8.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.arrays import as_bytes, groups, mix, shingle_sets, slices
from findloom.llm.components import components
from findloom.llm.keep import rows_of, text_key
from findloom.llm.scratch import Scratch

REGISTERS = 160
BASE, RATE, TOP = 1.02, 20.0, 2046
#: Share of the pairs at the threshold that may share no bucket, and standard errors of the estimate
#: below the threshold from which a pair goes on to the exact test.
MISSED, ERRORS = 1e-5, 5
#: Members of one bucket that a task compares with one another at a time.
BLOCK = 1024
#: Words of 64 bits in the map of wanted ids, whatever the corpus.
WORDS = 1 << 18

_LOG = math.log(BASE)
_STRIDES = np.array([x for x in range(1, REGISTERS) if math.gcd(x, REGISTERS) == 1], np.int64)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each set; set i is values[first[i]:first[i + 1]]. Empty sets give zeros."""
    n = np.diff(first)
    least = np.full((len(n), REGISTERS), np.inf)
    bound = (math.log(REGISTERS) + 6) / np.maximum(n, 1)
    _draw(values, np.repeat(np.arange(len(n)), n), bound, least)
    redo = np.flatnonzero((n > 0) & np.isinf(least).any(axis=1))
    if len(redo):
        again = np.full((len(redo), REGISTERS), np.inf)
        _draw(np.concatenate([values[first[i] : first[i + 1]] for i in redo]), np.repeat(np.arange(len(redo)), n[redo]), np.full(len(redo), np.inf), again)
        least[redo] = again
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / RATE) / _LOG)
    k[n == 0] = 0
    return np.clip(k, 0, TOP + 1).astype(np.uint16)


def _draw(h: np.ndarray, doc: np.ndarray, bound: np.ndarray, least: np.ndarray) -> None:
    flat, x, limit = least.reshape(-1), np.zeros(len(h)), bound[doc]
    spot, stride = None, None
    for j in range(REGISTERS):
        x = x - np.log(_unit(mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))) / (REGISTERS - j)
        live = x < limit
        if not live.all():
            h, doc, x, limit = h[live], doc[live], x[live], limit[live]
            if spot is not None:
                spot, stride = spot[live], stride[live]
        if not len(h):
            return
        if spot is None:
            g = mix(h ^ np.uint64(0x5851F42D4C957F2D))
            spot, stride = (g % np.uint64(REGISTERS)).astype(np.int64), _STRIDES[((g >> np.uint64(32)) % np.uint64(len(_STRIDES))).astype(np.int64)]
        np.minimum.at(flat, doc * REGISTERS + (spot + j * stride) % REGISTERS, x)


def estimate(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from registers and known set sizes."""
    more, less = (ku > kv).sum(-1), (ku < kv).sum(-1)
    same = ku.shape[-1] - more - less
    u = nu / (nu + nv)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG

    def likelihood(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(a + tiny) + less * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one maximum
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        up = likelihood(a) < likelihood(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def band_rows(percent: int) -> int:
    """Registers in a band: the most of which two sets at the threshold still share a bucket."""
    s = percent / 100
    fit = [r for r in range(1, REGISTERS) if REGISTERS % r == 0 and (1 - s**r) ** (REGISTERS / r) <= MISSED]
    return max(fit, default=1)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - ERRORS * math.sqrt(s * (1 - s) / REGISTERS)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketch_table(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and t.lower() for t in as_bytes(batch.column("text"))]
            for lo, hi in slices(texts):
                values, first = shingle_sets(texts[lo:hi], k)
                regs = sketches(values, first)
                n = np.diff(first)
                ids = [_digest(values[first[i] : first[i + 1]]) if n[i] else None for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h")), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "h", "n_shingles", "set_id", "regs"])

    return docs.mapInArrow(run, "doc_id long, h long, n_shingles long, set_id binary, regs binary")


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` but for most rows whose doc_id is none of ``ids(rep)``; a join on the ids has to follow."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS))
    bits = ids.select(spot("rep").alias("spot")).selectExpr("shiftright(spot, 6) as word", "shiftleft(1L, cast(spot & 63 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    own = spot("doc_id")
    met = texts.join(F.broadcast(bits), F.shiftright(own, 6) == F.col("word"))
    return met.filter(F.getbit("bits", own.bitwiseAND(F.lit(63)).cast("int")) == 1).select(*texts.columns)


def _full_sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``nodes(node, rep, set_id, n, regs)`` with their sorted shingles, from the text of the row they stand for."""

    def run(batches):
        for t in batches:
            low = [x and x.lower() for x in as_bytes(t.column("text"))]
            want = t.column("set_id").to_pylist()
            for lo, hi in slices(low):
                values, first = shingle_sets(low[lo:hi], k)
                own = [values[first[i] : first[i + 1]] for i in range(hi - lo)]
                same = np.array([_digest(x) == y for x, y in zip(own, want[lo:hi], strict=True)], bool)  # a repeated id has other texts
                part = pa.RecordBatch.from_arrays([*(t.column(c).slice(lo, hi - lo) for c in ("node", "n", "regs")), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "n", "regs", "hashes"])
                yield part.filter(pa.array(same))

    texts = _wanted(texts, nodes)
    joined = texts.join(nodes.hint("merge"), texts.doc_id == nodes.rep).select("node", "n", "regs", "set_id", "text")
    return joined.mapInArrow(run, "node long, n long, regs binary, hashes binary").dropDuplicates(["node"])


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(a, b)`` those that sizes and sketches don't rule out; no set moves for the others."""
    least = least_estimate(percent)
    side = lambda s: full.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))

    def run(batches):
        for t in batches:
            na, nb = (t.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            likely = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            if t.num_rows:
                likely &= estimate(_regs(t.column("regs_a")), _regs(t.column("regs_b")), na, nb) >= least
            yield t.select(["a", "b"]).filter(pa.array(likely))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    return both.mapInArrow(run, "a long, b long")


def _linked(found: DataFrame, full: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of ``found(a, b)`` those that the sketches don't rule out and the full shingle sets confirm.

    The sets of all b are sent to their a; an a with many b is dealt to several groups, each of which
    gets the set of a once, so that neither one task nor the traffic grows with its square.
    """
    per = 512
    pairs = scratch.keep(_likely(found, full, percent), "likely")
    own = full.select(F.col("node").alias("id"), "n", "hashes")
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / per).cast("int").alias("parts"))
    heads = count.join(own, F.col("a") == F.col("id")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "n", "hashes")
    dealt = pairs.join(count, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    tails = dealt.join(own, F.col("b") == F.col("id")).select("a", "part", "b", "n", "hashes")
    together = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        head: tuple = ()
        for t in batches:
            a, b, n = t.column("a").to_pylist(), t.column("b").to_pylist(), t.column("n").to_pylist()
            sets = t.column("hashes").to_pylist()
            links: tuple[list, list] = ([], [])
            for i in range(len(a)):
                own_set = np.frombuffer(sets[i], np.uint64)
                if b[i] is None:
                    head = (own_set, n[i])
                    continue
                common = len(np.intersect1d(head[0], own_set, assume_unique=True))
                if 100 * common >= percent * (head[1] + n[i] - common):
                    links[0].append(a[i])
                    links[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``members(key, node, comp)`` of one key, in different components, that look linked."""
    by = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    size = by.groupBy("key").agg(F.max_by("comp", "n").alias("usual"), F.max("n").alias("most"), F.sum("n").alias("all"))
    size = size.select("key", "usual", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("most") / BLOCK).cast("int").alias("rest"))
    own = members.join(size, "key").join(sets.select("node", "n", "hashes"), "node").withColumn("common", F.col("comp") == F.col("usual"))
    nth = F.xxhash64("node")
    own = own.withColumn("block", F.when(F.col("common"), F.col("few") + F.pmod(nth, "rest")).otherwise(F.pmod(nth, "few")).cast("int"))
    meets = F.when(F.col("common"), F.col("few")).otherwise(F.col("few") + F.col("rest"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).select(
        "key", "node", "comp", "n", "hashes", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def pairs(g: pa.Table) -> tuple[list, list]:
        node, comp, n, block = (g.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        kinds, counts = np.unique(comp, return_counts=True)
        few = np.flatnonzero(comp != kinds[counts.argmax()])
        out: tuple[list, list] = ([], [])
        if not len(few):
            return out
        parts = [np.frombuffer(x, "<u4")[::2] for x in g.column("hashes").to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        _, at, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        again = times > 1
        column = np.cumsum(again) - 1
        keep = again[at]
        row, at = row[keep], column[at[keep]]
        common = np.zeros((len(few), len(parts)), np.float32)
        for lo in range(0, int(again.sum()), 8192):
            inside = (at >= lo) & (at < lo + 8192)
            has = np.zeros((len(parts), 8192), np.float32)
            has[row[inside], at[inside] - lo] = 1
            common += has[few] @ has.T
        common += 1  # a shortened hash may merge two shingles of one set
        linked = 100 * common >= percent * (n[few][:, None] + n[None, :] - common)
        linked &= comp[few][:, None] != comp[None, :]
        if g.column("i")[0] != g.column("j")[0]:
            linked &= block[few][:, None] != block[None, :]
        for x in np.flatnonzero(linked.any(axis=1)).tolist():
            y = np.flatnonzero(linked[x])
            y = y[np.argsort(-(common[x, y] / (n[few[x]] + n[y] - common[x, y])), kind="stable")]
            for z in y[np.unique(comp[y], return_index=True)[1]].tolist():
                a, b = sorted((int(node[few[x]]), int(node[z])))
                out[0].append(a)
                out[1].append(b)
        return out

    def run(batches):
        for g in groups(batches, ["key", "i", "j"]):
            if g.num_rows > 1:
                a, b = pairs(g)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """Keys whose members are in different components."""
    return members.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("open")).filter("open").select("key")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of distinct
    k-word shingles (words lower-cased in A-Z; a shorter text is one shingle of all its words).
    Texts without words, and null texts, have an empty set and link with nothing; component_id is
    then the own doc_id. Rows with equal sets are one class. Rows of different texts under one doc_id
    are one document: all they link with is one component. Rows with a null doc_id take no part in
    linking, have a null component_id and are kept. An empty table gives no rows.
    """
    return _answers(docs, k, percent).drop("h")


def _answers(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``h``, the key of the row's text."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text").cast("string")).alias("h"))
    table = scratch.keep(_sketch_table(texts, k), "sketch")
    real = table.filter("n_shingles > 0 and doc_id is not null")
    sets = real.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
    sets = scratch.keep(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")

    rows = band_rows(percent)
    width = 2 * rows
    parts = F.expr(f"transform(sequence(0, {REGISTERS // rows - 1}), i -> xxhash64(i, substring(regs, cast(i * {width} + 1 as int), {width})))")
    bands = sets.select("node", F.explode(parts).alias("key"))
    shared = bands.groupBy("key").count().filter("count > 1")
    members = scratch.keep(bands.join(shared, "key").select("key", "node", "count"), "members")
    score = members.groupBy("node").agg(F.sum("count").alias("score"))
    lead = scratch.keep(members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", -F.col("node"))).alias("l")).select("key", (-F.col("l.col2")).alias("a")), "lead")
    pairs = scratch.keep(members.join(lead, "key").filter("node != a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = scratch.keep(sets.join(wanted, "node").select("node", "rep", "set_id", "n", "regs"), "nodes")
    full = scratch.keep(_full_sets(nodes, texts, k), "full")
    same = sets.join(scratch.keep(_shared_ids(real), "ids"), "set_id").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).select("a", F.explode("all").alias("b")).filter("a != b")
    links = scratch.keep(_linked(pairs, full, percent, scratch).union(same), "links")
    comps = scratch.keep(components(links, scratch), "comps")
    own = members.join(comps, members.node == comps.id, "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_ = scratch.keep(own.join(_mixed(own), "key", "left_semi").join(lead, "key").select(F.col("a").alias("key"), "node", "comp").distinct(), "open")
    scratch.drop(members, lead, pairs, comps, nodes)
    left = scratch.keep(_across(open_, full, percent), "left")
    more = scratch.keep(_linked(left, full, percent, scratch), "links")
    comps = scratch.keep(components(links.union(more), scratch), "comps")
    scratch.drop(full, open_, left, links, more)

    named = sets.select("set_id", "node", "rep").join(comps, F.col("node") == F.col("id"), "left").select("set_id", "rep", F.coalesce("component", "node").alias("comp"))
    first = named.groupBy("comp").agg(F.min("rep").alias("least"))
    least = scratch.keep(named.join(first, "comp").select("set_id", "least"), "least")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return table.select("doc_id", "h", "n_shingles", "set_id").join(least, "set_id", "left").select("doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _shared_ids(real: DataFrame) -> DataFrame:
    """(doc_id, set_id) of the ids that stand for several different sets."""
    each = real.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).filter("least != most").select("doc_id")
    return real.join(each, "doc_id").select("doc_id", "set_id").distinct()


def without_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the least of its component.

    Rows that repeat both doc_id and text stay once; rows with a null doc_id all stay but for such
    repeats.
    """
    answer = Scratch(docs.sparkSession, "near").keep(_answers(docs, k, percent).filter("kept").select("doc_id", "h"), "kept")
    return rows_of(docs, answer)
