"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Nearness is the inner product. For the graph, vectors get one more component that makes all lengths
equal, so that the greatest inner product is the nearest point. The few longest vectors would press
all others together there; they stay out of the graph and are candidates of every query. Equal vectors are one node with its
smallest row ids (no answer of k rows can need more of them), so a vector with a third of all rows
is one node too.

Graph. Random-projection buckets give each node a first list of neighbours; their split directions
and medians come from a bounded sample. Then NN-descent: every node sends its best neighbours, and
the nodes that list it, to a common place, where all of these are compared with one another, and
those that beat a node's worst neighbour go to that node's list. In a bucket or join the work for
one node is bounded by the list length, whatever the input. Rounds go on until hardly an entry changes.

Search. A query starts at its own node's neighbours and repeatedly expands the best nodes not yet
expanded, until that changes none of its best candidates. Candidates travel as ids to the partition that holds their vectors, and each query's
vector once to each such partition, where exact inner products in double precision are taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.arrays import groups
from findloom.llm.scratch import Scratch

#: Neighbours kept per node, and the best of them that take part in a local join.
LIST, JOIN = 40, 28
TREES, BUCKET, SAMPLE = 6, 256, 20_000
#: The longest vectors, and nodes of the graph by their hash, which every query is compared with.
GIANTS, ENTRIES = 32, 32
#: Rounds end when at most this share of all list entries is new.
SETTLED = 0.001
#: Nodes a query expands per hop, and candidates it holds on to.
EXPAND, POOL = 50, 200
#: Vectors that are held together in the search, about. A query's candidates are packed by the part that
#: holds them, so what a hop sends follows the vectors, not the session's number of partitions.
HELD = 4_000


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1)


def _lists(ids: list[np.ndarray], sims: list[np.ndarray], size: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The best of several lists together, each id once, without the node itself."""
    i, s = np.concatenate(ids), np.concatenate(sims)
    order = np.lexsort((-s, i))
    i, s = i[order], s[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = i[1:] != i[:-1]
    fresh &= i != own
    i, s = i[fresh], s[fresh]
    best = np.lexsort((i, -s))[:size]
    return i[best], s[best]


def nodes(vectors: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(node, vec, ids): each different valid vector, as float32 bytes, with its k + 1 smallest row ids."""
    valid = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)")
    usual = valid.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    valid = valid.filter(F.size("embedding") == (usual.d if usual else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def pack(batches):
        for b in batches:
            parts = [np.asarray(x, "<f8").tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(parts, pa.binary())], names=["vec_id", "vec"])

    rows = valid.mapInArrow(pack, "vec_id long, vec binary").distinct()
    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = rows.withColumn("nth", first).filter(f"nth <= {k + 1}")
    return scratch.keep(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids"), "nodes")


def _first_lists(points: DataFrame, count: int, sample: np.ndarray) -> DataFrame:
    """Neighbours within random-projection buckets, one row per node and tree."""
    depth = max(0, math.ceil(math.log2(max(1, count / BUCKET))))
    rng = np.random.Generator(np.random.PCG64(11))
    trees = []
    for _ in range(TREES if depth else 1):
        a, b = (rng.integers(0, len(sample), max(depth, 1)) for _ in range(2))
        ways = sample[a] - sample[b] + 1e-9 * rng.standard_normal((max(depth, 1), sample.shape[1]))
        trees.append((ways, np.median(sample @ ways.T, axis=0)))

    def deal(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("point").to_pylist()), np.float32).reshape(b.num_rows, -1)
            for t, (ways, cuts) in enumerate(trees):
                code = ((x @ ways.T > cuts) << np.arange(len(cuts))).sum(1) if depth else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(code, pa.int64()), b.column("node"), b.column("point")], names=["tree", "code", "node", "point"])

    dealt = points.select("node", "point").mapInArrow(deal, "tree int, code long, node long, point binary")
    size = dealt.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * BUCKET)).cast("int").alias("parts"))
    dealt = dealt.join(size, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).select("tree", "code", "part", "node", "point")
    dealt = dealt.repartition("tree", "code", "part").sortWithinPartitions("tree", "code", "part")

    def link(batches):
        for g in groups(batches, ["tree", "code", "part"]):
            ids = g.column("node").to_numpy()
            x = _matrix(g.column("point"), np.float32)
            k = min(LIST, len(ids) - 1)
            if k < 1:
                continue
            for lo in range(0, len(ids), 512):
                s = x[lo : lo + 512] @ x.T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                own = np.take_along_axis(s, at, 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + len(s)]), pa.array(list(ids[at]), pa.list_(pa.int64())), pa.array(list(own), pa.list_(pa.float32()))], names=["node", "near", "sims"])

    return dealt.mapInArrow(link, "node long, near array<long>, sims array<float>")


def _merged(rows: DataFrame) -> DataFrame:
    """One list per node from several."""

    def run(batches):
        out: list[list] = [[], [], []]
        for g in groups(batches, ["node"]):
            node = g.column("node")[0].as_py()
            near, sims = g.column("near").combine_chunks().flatten().to_numpy(zero_copy_only=False), g.column("sims").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            i, s = _lists([near], [sims], LIST, node)
            for to, x in zip(out, (node, i, s), strict=True):
                to.append(x)
            if len(out[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float32()))], names=["node", "near", "sims"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float32()))], names=["node", "near", "sims"])

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, near array<long>, sims array<float>")


def _reverse(graph: DataFrame, size: int) -> DataFrame:
    """(node, other, sim): for each node the nodes that list it, the nearest ``size`` of them."""
    arcs = graph.select(F.col("node").alias("other"), F.explode(F.arrays_zip(F.slice("near", 1, size).alias("near"), F.slice("sims", 1, size).alias("sims"))).alias("a")).select(F.col("a.near").alias("node"), "other", F.col("a.sims").alias("sim"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
    return arcs.withColumn("nth", nth).filter(f"nth <= {size}").select("node", "other", "sim")


def _descend(graph: DataFrame, points: DataFrame) -> DataFrame:
    """One round: neighbours of a node, of both directions, are compared with one another."""
    ahead = graph.select(F.col("node").alias("centre"), F.explode(F.slice("near", 1, JOIN)).alias("node"))
    back = _reverse(graph, JOIN).select(F.col("node").alias("centre"), F.col("other").alias("node"))
    worst = F.when(F.size("sims") >= LIST, F.element_at("sims", -1)).otherwise(F.lit(-3e38)).cast("float")
    held = points.select("node", "point").join(graph.select("node", worst.alias("worst")), "node")
    sent = ahead.union(back).distinct().join(held, "node").select("centre", "node", "point", "worst").repartition("centre").sortWithinPartitions("centre")

    def local_join(batches):
        out: list[list] = [[], [], []]
        names, kinds = ["node", "near", "sims"], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32())]
        for g in groups(batches, ["centre"]):
            ids, worst_ = g.column("node").to_numpy(), g.column("worst").to_numpy()
            x = _matrix(g.column("point"), np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            better = s > worst_[:, None]
            for j in np.flatnonzero(better.any(axis=1)).tolist():
                at = np.flatnonzero(better[j])
                for to, v in zip(out, (ids[j], ids[at], s[j, at]), strict=True):
                    to.append(v)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    fresh = sent.mapInArrow(local_join, "node long, near array<long>, sims array<float>")
    return _merged(graph.union(fresh))


def _changed(graph: DataFrame, before: DataFrame) -> float:
    """Share of the list entries of ``graph`` that ``before`` didn't have."""
    both = graph.select("node", "near").join(before.select("node", F.col("near").alias("had")), "node", "left")
    fresh = F.size(F.array_except("near", F.coalesce("had", F.array().cast("array<long>"))))
    r = both.agg(F.sum(fresh).alias("fresh"), F.sum(F.size("near")).alias("all")).first()
    return (r.fresh or 0) / max(1, r.all or 0)


def giants(table: DataFrame) -> list[int]:
    """The nodes of the longest vectors of ``table(node, vec)``; at most half of all."""
    most = min(GIANTS, table.count() // 2)
    return sorted(r.node for r in table.mapInArrow(_squares, "node long, square double").orderBy(F.desc("square"), "node").limit(most).collect())


def build(table: DataFrame, scratch: Scratch) -> DataFrame:
    """The graph over ``table(node, vec)``: node, near and sims (in the lengthened space), best first."""
    stats = table.mapInArrow(_squares, "node long, square double").agg(F.count("*").alias("n"), F.max("square").alias("most")).first()
    count, most = stats.n or 0, stats.most or 0.0

    def lengthen(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), "<f8").reshape(b.num_rows, -1)
            own = (x * x).sum(1)
            y = np.column_stack([x, np.sqrt(np.maximum(most - own, 0))]) / math.sqrt(most)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([r.tobytes() for r in y.astype(np.float32)], pa.binary())], names=["node", "point"])

    points = scratch.keep(table.select("node", "vec").mapInArrow(lengthen, "node long, point binary"), "points")
    some = points.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("point").toPandas()["point"]
    sample = np.frombuffer(b"".join(map(bytes, some)), np.float32).reshape(len(some), -1).astype(np.float64)
    graph = scratch.keep(_merged(_first_lists(points, count, sample)), "graph")
    share = 1.0 if count > 1 else 0.0
    while share > SETTLED:
        before, graph = graph, scratch.keep(_descend(graph, points), "graph")
        share = _changed(graph, before)
        scratch.drop(before)
    return graph


def _squares(batches):
    for b in batches:
        if b.num_rows:
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), "<f8").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array((x * x).sum(1))], names=["node", "square"])


def _scored(wanted: DataFrame, queries: DataFrame, table: DataFrame, parts: int) -> DataFrame:
    """Exact inner products of ``wanted(query, p, ys)``: ids packed by the partition p that holds them."""
    blank = F.lit(None).cast("binary")
    held = table.select(F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("p"), F.lit(0).alias("kind"), F.col("node").alias("id"), F.col("vec"), blank.alias("ys"))
    asked = wanted.select("query", "p").distinct().join(queries, "query").select("p", F.lit(1).alias("kind"), F.col("query").alias("id"), "vec", blank.alias("ys"))
    lists = wanted.select("p", F.lit(2).alias("kind"), F.col("query").alias("id"), blank.alias("vec"), "ys")
    dealt = held.union(asked).union(lists).repartition(parts, "p").sortWithinPartitions("p", "kind", "id")

    def run(batches):
        for g in groups(batches, ["p"]):
            kind, ids = g.column("kind").to_numpy(), g.column("id").to_numpy()
            n, m = int((kind == 0).sum()), int((kind <= 1).sum())
            if m == len(ids):
                continue
            vec = g.column("vec").combine_chunks()
            own, x = ids[:n], np.frombuffer(b"".join(vec.slice(0, n).to_pylist()), "<f8").reshape(n, -1)
            asked_, y = ids[n:m], np.frombuffer(b"".join(vec.slice(n, m - n).to_pylist()), "<f8").reshape(m - n, -1)
            out: list[list] = [[], [], []]
            for q, packed in zip(ids[m:].tolist(), g.column("ys").combine_chunks().slice(m).to_pylist(), strict=True):
                to = np.frombuffer(packed, "<i8")
                s = x[np.searchsorted(own, to)] @ y[np.searchsorted(asked_, q)]
                for c, v in zip(out, (q, packed, s.astype("<f8").tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["query", "ids", "sims"])

    return dealt.mapInArrow(run, "query long, ids binary, sims binary")


def _spread(rows: DataFrame, parts_of: DataFrame) -> DataFrame:
    """``wanted`` rows from (query, near): every id once for each query, packed by partition."""
    each = rows.select("query", F.explode("near").alias("y")).distinct()
    with_p = each.select("query", F.pmod(F.xxhash64("y"), F.lit(parts_of)).cast("int").alias("p"), "y")

    def run(batches):
        out: list[list] = [[], [], []]
        for g in groups(batches, ["query", "p"]):
            for to, v in zip(out, (g.column("query")[0].as_py(), g.column("p")[0].as_py(), g.column("y").to_numpy().astype("<i8").tobytes()), strict=True):
                to.append(v)
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["query", "p", "ys"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["query", "p", "ys"])

    return with_p.repartition("query").sortWithinPartitions("query", "p").mapInArrow(run, "query long, p int, ys binary")


def _pooled(state: DataFrame | None, scored: DataFrame, best: int) -> DataFrame:
    """Per query the best ``POOL`` candidates of all so far, and those to expand next.

    A query whose ``best`` first candidates stay as they were has none to expand.
    """
    rows = scored.select("query", "ids", "sims", F.lit(None).cast("binary").alias("done"))
    rows = rows if state is None else rows.union(state.select("query", "ids", "sims", "done"))
    pool = max(POOL, 2 * best)

    def run(batches):
        out: list[list] = [[] for _ in range(5)]
        for g in groups(batches, ["query"]):
            ids = [np.frombuffer(x, "<i8") for x in g.column("ids").to_pylist()]
            sims = [np.frombuffer(x, "<f8") for x in g.column("sims").to_pylist()]
            marks = g.column("done").to_pylist()
            done = np.concatenate([np.frombuffer(x or b"", "<i8") for x in marks])
            had = [x[:best] for x, mark in zip(ids, marks, strict=True) if mark is not None]
            i, s = _lists(ids, sims, pool, -(1 << 62))
            ahead = i[~np.isin(i, done)][:EXPAND]
            if had and np.array_equal(had[0], i[:best]):
                ahead = ahead[:0]
            for to, v in zip(out, (g.column("query")[0].as_py(), i.astype("<i8").tobytes(), s.astype("<f8").tobytes(), np.concatenate([done, ahead]).astype("<i8").tobytes(), ahead), strict=True):
                to.append(v)
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["query", "ids", "sims", "done", "ahead"])

    return rows.repartition("query").sortWithinPartitions("query").mapInArrow(run, "query long, ids binary, sims binary, done binary, ahead array<long>")


def search(table: DataFrame, graph: DataFrame, starts: DataFrame, scratch: Scratch, best: int = 21, seeds: list[int] = ()) -> DataFrame:
    """(query, ids, sims): the best candidates of each node in ``starts(query)``, itself included.

    A query begins at its own node's neighbours and at ``seeds``. Each query expands until its ``best`` first candidates no longer change.
    """
    count = table.count()
    parts = max(1, math.ceil(count / HELD))
    queries = starts.join(table.select(F.col("node").alias("query"), "vec"), "query")
    back = _reverse(graph, LIST).groupBy("node").agg(F.collect_list("other").alias("back"))
    links = scratch.keep(graph.join(back, "node", "left").select(F.col("node").alias("x"), F.array_union("near", F.coalesce("back", F.array().cast("array<long>"))).alias("near")), "links")
    first = F.array("query", *(F.lit(x).cast("long") for x in seeds))
    own = queries.select("query", first.alias("near")).union(queries.join(links, F.col("query") == F.col("x")).select("query", "near"))
    state, ahead = None, True
    while ahead:
        rows = own if state is None else state.select("query", F.explode("ahead").alias("x")).join(links, "x").select("query", "near")
        wanted = scratch.keep(_spread(rows, parts), "wanted")
        state = scratch.keep(_pooled(state, _scored(wanted, queries, table, parts), best), "state")
        ahead = state.filter("size(ahead) > 0").limit(1).count() > 0
    return state.select("query", "ids", "sims")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its k nearest others.

    ``vectors`` has vec_id and embedding. Vectors that are null, zero, or hold null or non-finite
    components, rows with a null id, and vectors of another than the usual number of components take
    no part. Ties go to the smaller vec_id. With fewer than k other rows all are returned. Rows
    repeated in full count once.
    """
    scratch = Scratch(vectors.sparkSession, "nnd")
    table = nodes(vectors, k, scratch)
    if not table.limit(1).count():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = giants(table)
    others = table.filter(~F.col("node").isin(longest)) if longest else table
    graph = build(others, scratch)
    entries = [r.node for r in others.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    rows = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    asked = _asked(rows, table, scratch)
    found = search(table, graph, asked.select(F.col("node").alias("query")).distinct(), scratch, k + 1, longest + entries)

    def best(batches):
        out: list[list] = [[], [], []]
        for b in batches:
            for q, ids, sims in zip(*(b.column(c).to_pylist() for c in ("query", "ids", "sims")), strict=True):
                i, s = np.frombuffer(ids, "<i8"), np.frombuffer(sims, "<f8")
                last = s[min(k, len(s) - 1)]
                i, s = i[s >= last], s[s >= last]
                for to, v in zip(out, ([q] * len(i), i, s), strict=True):
                    to.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query", "node", "score"])

    top = found.mapInArrow(best, "query long, node long, score double")
    rows = top.join(table.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    per_node = rows.withColumn("nth", nth).filter(f"nth <= {k + 1}").drop("nth")
    each = asked.join(per_node, F.col("node") == F.col("query")).filter("query_id != vec_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _asked(rows: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """(query_id, node) of the query rows; an invalid vector has no node."""

    def pack(batches):
        for b in batches:
            parts = [None if x is None or any(v is None for v in x) else np.asarray(x, "<f8").tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(parts, pa.binary())], names=["query_id", "v"])

    return scratch.keep(rows.mapInArrow(pack, "query_id long, v binary").distinct().join(table.select("node", "vec"), F.col("v") == F.col("vec")).select("query_id", "node"), "asked")
