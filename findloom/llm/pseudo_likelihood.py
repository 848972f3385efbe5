"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Words are hashed to slots; the counts of all slots over all documents are gathered with map-side
sums. The commonest slots are the network's input vocabulary. The output is a hierarchical softmax
over all slots: from the two words before and the two after a token (embedding, one hidden layer)
the network takes each branch of the token's way down the Huffman tree of the counts. The branches
start at the corpus frequencies, so that an untrained network gives the unigram model. A document's
score is the sum of the conditional log-probabilities of its tokens.

Training is in numpy on the executors: in each round groups of documents, dealt and ordered by a hash
of id and text, take local steps from the same parameters, and the results are averaged, weighted by
the tokens seen. The averages are formed chunk by chunk in a tree over the groups, so no task holds more
than a few dozen parts and the driver gets one parameter set per round, whatever the number of groups. The rounds together take every document once, and every
token of it is predicted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.arrays import Words, as_bytes, slices
from findloom.llm.scratch import Scratch

SLOTS = 1 << 16
INPUTS = 4096
EMBED, HIDDEN, SIDE = 8, 8, 2
#: Rounds of training; each takes the documents whose id hashes to its number.
ROUNDS = 4
#: Windows in a step; later steps, whose moments have settled, take several times as many.
BATCH, RATE, SETTLED, LATER = 1024, 0.02, 64, 8
CHUNKS = 16
#: Groups whose results are averaged in one task.
FAN = 32
#: Nodes of the tree that most ways pass; these are taken for all words of a step at once.
TOP = 64
#: Tokens of a round that are trained on together, about; their number of groups follows from the
#: corpus alone, so a score doesn't depend on how the rows lie in files or tasks.
GROUP = 2_000_000

_SHAPES = (("embed", (INPUTS + 2, EMBED)), ("mix", (2 * SIDE * EMBED, HIDDEN)), ("bias", (HIDDEN,)), ("out", (SLOTS - 1, HIDDEN)), ("prior", (SLOTS - 1,)))
_DENSE = ("embed", "mix", "bias")


def token_slots(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each word, and the index of the first word of each text (with the total at the end)."""
    words = Words([t and t.lower() for t in texts])
    return (words.hashes() >> np.uint64(48)).astype(np.int64) % SLOTS, words.first


class Tree:
    """Huffman tree of the slots: the branches of slot s are ``first[s]`` to ``first[s + 1]`` of ``node`` and ``sign``."""

    def __init__(self, weight: np.ndarray):
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        above, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.float32)
        self.prior = np.zeros(n - 1, np.float32)
        for at in range(n, 2 * n - 1):
            (w, a), (x, b) = heapq.heappop(heap), heapq.heappop(heap)
            above[a] = above[b] = at
            side[a], side[b] = 1, -1
            self.prior[at - n] = np.log(w / x)
            heapq.heappush(heap, (w + x, at))
        now, way = np.arange(n), []
        while (now < 2 * n - 2).any():
            inner = now < 2 * n - 2
            way.append((np.where(inner, above[now] - n, -1), side[now]))
            now = np.where(inner, above[now], now)
        nodes, signs = np.stack([x for x, _ in way], 1), np.stack([x for _, x in way], 1)
        self.node, self.sign = nodes[nodes >= 0].astype(np.uint16), signs[nodes >= 0].astype(np.int8)
        self.first = np.concatenate([[0], np.cumsum((nodes >= 0).sum(1))]).astype(np.int32)

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ways without their branches at the ``TOP`` heaviest nodes, the last ones made: where each
        slot's begin, nodes and signs; and per slot its signs at the heaviest nodes, 0 off its way."""
        rare = self.node < len(self.prior) - TOP
        kept = np.concatenate([[0], np.cumsum(rare)])
        slot = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        top = np.zeros((len(self.first) - 1, TOP), np.int8)
        top[slot[~rare], self.node[~rare].astype(np.int64) - (len(self.prior) - TOP)] = self.sign[~rare]
        return kept[self.first], self.node[rare], self.sign[rare], top


class Vocabulary:
    """Slots by falling count: input number, predicted class (the slot itself), tree and unigram log-probability."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(SLOTS), -counts))
        rank = np.empty(SLOTS, np.int64)
        rank[order] = np.arange(SLOTS)
        self.input = np.minimum(rank, INPUTS).astype(np.int32)
        self.klass = np.arange(SLOTS)
        weight = counts + 1.0
        self.tree = Tree(weight)
        self.unigram = np.log(weight / weight.sum())
        self.tokens = float(counts.sum())


def initial(vocabulary: Vocabulary) -> dict:
    """The first parameters, and the tree they are for."""
    rng = np.random.Generator(np.random.PCG64(5))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _SHAPES if k in _DENSE}
    p["out"], p["prior"] = np.zeros((SLOTS - 1, HIDDEN), np.float32), vocabulary.tree.prior.copy()
    p["bias"] = np.zeros(HIDDEN, np.float32)
    return p | {"tree": vocabulary.tree}


def windows(vocabulary: Vocabulary, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The context and the class of every token of the texts."""
    slots, first = token_slots(texts)
    return contexts(vocabulary.input[slots], first), vocabulary.klass[slots]


def contexts(inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inputs at -2, -1, +1 and +2 of each token; beyond the text's ends the edge mark."""
    n = len(inputs)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(n)
    out = np.full((n, 2 * SIDE), INPUTS + 1, np.int32)
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        ok = (place + d >= first[doc]) & (place + d < first[doc + 1])
        out[ok, j] = inputs[place[ok] + d]
    return out


class Steps:
    """Adam steps over windows in their order, for tree nodes where they are met; steps don't depend on how windows are fed."""

    def __init__(self, p: dict):
        self.tree = p["tree"]
        self.first, self.node, self.sign, top = self.tree.split()
        self.top = top.astype(np.float32)
        self.p = {k: v.copy() for k, v in p.items() if k != "tree"}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        self.done = self.seen = 0
        self.ctx, self.target = np.zeros((0, 2 * SIDE), np.int32), np.zeros(0, np.int64)

    def feed(self, ctx: np.ndarray, target: np.ndarray) -> Steps:
        ctx, target = np.concatenate([self.ctx, ctx]), np.concatenate([self.target, target])
        lo = 0
        while lo + (size := BATCH if self.done < SETTLED else LATER * BATCH) <= len(target):
            self._step(ctx[lo : lo + size], target[lo : lo + size])
            lo += size
        self.ctx, self.target = ctx[lo:], target[lo:]
        return self

    def close(self) -> dict:
        if len(self.target):
            self._step(self.ctx, self.target)
        return self.p | {"tree": self.tree}

    def _step(self, c: np.ndarray, y: np.ndarray) -> None:
        p, m, v = self.p, self.m, self.v
        self.done += 1
        self.seen += len(y)
        x = p["embed"][c].reshape(len(c), -1)
        h = np.tanh(x @ p["mix"] + p["bias"])
        # the heaviest nodes, for all tokens at once; off a word's way the sign is 0
        heavy = slice(len(p["prior"]) - TOP, len(p["prior"]))
        s = np.take(self.top, y, axis=0)
        e = h @ p["out"][heavy].T
        e += p["prior"][heavy]
        e *= s
        np.clip(e, None, 60, out=e)
        np.exp(e, out=e)
        e += 1
        np.divide(s, e, out=e)
        e *= np.float32(-1 / len(y))
        dh, g_out, g_prior = e @ p["out"][heavy], e.T @ h, e.sum(0)
        # the others, where they are met
        size = self.first[y + 1] - self.first[y]
        rest = np.flatnonzero(size)
        met = np.zeros(0, np.int64)
        if len(rest):
            size = size[rest]
            begin = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(self.first[y[rest]] - begin, size)
            node, sign = self.node[at].astype(np.intp), self.sign[at].astype(np.float32)
            w, hr = np.take(p["out"], node, axis=0), np.repeat(np.take(h, rest, axis=0), size, axis=0)
            z = sign * (np.einsum("ij,ij->i", w, hr) + p["prior"][node])
            e = -sign / (1 + np.exp(np.clip(z, -60, 60))) / np.float32(len(y))
            dh += _summed(e[:, None] * w, np.repeat(rest, size), len(y))
            met = np.flatnonzero(np.bincount(node, minlength=heavy.start))
            g_out = np.concatenate([_summed(e[:, None] * hr, node, heavy.start)[met], g_out])
            g_prior = np.concatenate([np.bincount(node, e, heavy.start)[met].astype(np.float32), g_prior])
        met = np.concatenate([met, np.arange(heavy.start, heavy.stop)])
        dh *= 1 - h * h
        flat = c.ravel()
        words = np.flatnonzero(np.bincount(flat, minlength=len(p["embed"])))
        g_embed = _summed((dh @ p["mix"].T).reshape(-1, EMBED), flat, len(p["embed"]))[words]
        every = slice(None)
        for k, at, g in (("embed", words, g_embed), ("mix", every, x.T @ dh), ("bias", every, dh.sum(0)), ("out", met, g_out), ("prior", met, g_prior)):
            mean, square = m[k][at], v[k][at]
            mean = mean + 0.1 * (g - mean)
            square = square + 0.01 * (g * g - square)
            m[k][at], v[k][at] = mean, square
            p[k][at] -= RATE * (mean / (1 - 0.9**self.done)) / (np.sqrt(square / (1 - 0.99**self.done)) + 1e-6)


def _summed(rows: np.ndarray, to: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows that go to each of ``size`` places, column by column."""
    return np.stack([np.bincount(to, column, size) for column in rows.T], axis=1).astype(np.float32)


def train_local(p: dict, ctx: np.ndarray, target: np.ndarray) -> dict:
    return Steps(p).feed(ctx, target).close()


class Scorer:
    """Log-probabilities with the first layer folded into one table per position."""

    def __init__(self, p: dict, vocabulary: Vocabulary):
        self.tables = [p["embed"] @ p["mix"][j * EMBED : (j + 1) * EMBED] for j in range(2 * SIDE)]
        self.p, self.vocabulary = p, vocabulary
        self.first, self.node, self.sign, self.top = p["tree"].split()

    def tokens(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        ctx, klass = contexts(self.vocabulary.input[slots], first), self.vocabulary.klass[slots]
        out = np.empty(len(slots))
        weight, prior = self.p["out"], self.p["prior"]
        # in double precision: a row's product then doesn't depend on the rows it is multiplied with
        heavy, heavy_prior = weight[len(prior) - TOP :].T.astype(np.float64), prior[len(prior) - TOP :].astype(np.float64)
        for lo in range(0, len(slots), 8192):
            c, y = ctx[lo : lo + 8192], klass[lo : lo + 8192]
            h = self.p["bias"] + self.tables[0][c[:, 0]]
            for j in range(1, 2 * SIDE):
                h += self.tables[j][c[:, j]]
            h = np.tanh(h)
            s = self.top[y]
            on = np.flatnonzero(s)
            z = np.clip(np.take(s, on) * np.take(h.astype(np.float64) @ heavy + heavy_prior, on), -60, 60)
            sums = -np.bincount(on // TOP, np.log1p(np.exp(-z)), len(y))
            size = self.first[y + 1] - self.first[y]
            rest = np.flatnonzero(size)
            if len(rest):
                size = size[rest]
                begin = np.cumsum(size) - size
                at = np.arange(int(size.sum())) + np.repeat(self.first[y[rest]] - begin, size)
                node = self.node[at].astype(np.intp)
                z = np.clip(self.sign[at] * (np.einsum("ij,ij->i", np.take(weight, node, axis=0), np.repeat(np.take(h, rest, axis=0), size, axis=0)) + prior[node]), -60, 60)
                sums[rest] -= np.add.reduceat(np.log1p(np.exp(-z)).astype(np.float64), begin)
            out[lo : lo + 8192] = sums
        return out


def slot_counts(docs: DataFrame) -> np.ndarray:
    """Tokens of each slot over all documents."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for lo, hi in slices(texts):
                total += np.bincount(token_slots(texts[lo:hi])[0], minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    got = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS)
    counts[got["slot"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return counts


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k, _ in _SHAPES])


def _unflat(flat: np.ndarray, tree: Tree) -> dict:
    p, at = {"tree": tree}, 0
    for k, s in _SHAPES:
        n = int(np.prod(s))
        p[k] = flat[at : at + n].reshape(s).astype(np.float32)
        at += n
    return p


def _sent(p: dict, g: int, seen: int) -> pa.RecordBatch:
    parts = np.array_split(_flat(p), CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([g] * CHUNKS, pa.int32()), pa.array([seen] * CHUNKS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "g", "seen", "part"])


def averaged(sent: DataFrame, many: int, scratch: Scratch) -> DataFrame:
    """(chunk, g, seen, part): the mean of the parts of each chunk of ``many`` groups, weighted by the tokens seen.

    A tree: ``FAN`` neighbouring groups are averaged in one task, then as many of the averages, until one
    is left; a task holds ``FAN`` parts of one chunk, however many groups there are.
    """

    def average(key, table):
        table = table.sort_by("g")
        seen, parts = table.column("seen").to_pylist(), table.column("part").to_pylist()
        total = sum(np.frombuffer(p, np.float32) * (n / sum(seen)) for n, p in zip(seen, parts, strict=True))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "g": pa.array([key[1].as_py()], pa.int32()), "seen": pa.array([sum(seen)], pa.int64()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    while True:
        many = -(-many // FAN)
        level = sent.withColumn("to", F.floor(F.col("g") / FAN).cast("int")).groupBy("chunk", "to").applyInArrow(average, "chunk int, g int, seen long, part binary")
        if many <= 1:
            return level
        sent = scratch.keep(level, "averaged")


def _grouped(batches) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of rows of each group ``g`` in turn; a group is never held as a whole."""
    parts = ((b.column("g")[0].as_py(), b) for batch in batches for b in _cut(batch))
    return groupby(parts, key=itemgetter(0))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    g = batch.column("g").to_numpy()
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
    return (batch.slice(a, b - a) for a, b in pairwise(cuts) if b > a)


def train(docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch, rounds: int = ROUNDS) -> dict:
    """Averaged local training; round r takes the documents that hash to r of ``rounds``."""
    p = initial(vocabulary)
    many = max(1, round(vocabulary.tokens / (rounds * GROUP)))
    h = F.xxhash64("doc_id", "text", F.lit(29))
    dealt = docs.select(F.pmod(h, F.lit(rounds)).alias("r"), F.pmod(F.shiftright(h, 8), F.lit(many)).cast("int").alias("g"), h.alias("h"), "text")
    for r in range(rounds):
        start = p

        def local(batches, start=start):
            for g, own in _grouped(batches):
                steps = Steps(start)
                for _, batch in own:
                    texts = as_bytes(batch.column("text"))
                    for lo, hi in slices(texts):
                        steps.feed(*windows(vocabulary, texts[lo:hi]))
                q = steps.close()
                if steps.seen:
                    yield _sent(q, g, steps.seen)

        own = dealt.filter(F.col("r") == r).repartition(many, "g").sortWithinPartitions("g", "h").select("g", "text")
        sent = scratch.keep(own.mapInArrow(local, "chunk int, g int, seen long, part binary"), "trained")
        got = averaged(sent, many, scratch).select("chunk", "part").collect()
        scratch.drop(sent)
        if len(got) == CHUNKS:
            p = _unflat(np.concatenate([np.frombuffer(x.part, np.float32) for x in sorted(got, key=lambda x: x.chunk)]), vocabulary.tree)
    return p


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum) and mean_log_prob of each row.

    Texts without words, and null texts, have no tokens, a sum of 0 and a null mean. Repeated rows get
    equal scores; an empty table gives none. Scores are the same however the rows lie.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "lm")
    vocabulary = Vocabulary(slot_counts(texts))
    p = train(texts, vocabulary, scratch, rounds)

    def run(batches):
        scorer = Scorer(p, vocabulary)
        for batch in batches:
            data = as_bytes(batch.column("text"))
            for lo, hi in slices(data):
                slots, first = token_slots(data[lo:hi])
                n = np.diff(first)
                total = np.bincount(np.repeat(np.arange(hi - lo), n), scorer.tokens(slots, first), hi - lo).astype(float)
                mean = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(total), pa.array(mean, mask=n == 0)], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
