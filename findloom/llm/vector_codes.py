"""Compression of vectors to short codes: one codebook for each part position, by Hamerly's Lloyd rounds.

Vectors become whole numbers and are cut into equal parts. Every part keeps, beside its code, one upper
bound of its distance to its entry and one lower bound of its distance to the second nearest. After an
update of the codebooks both bounds are moved by how far entries went; a part is scanned against all
entries only where the upper bound isn't strictly below the lower one (or half the way from its entry to
the next). Distances are compared as whole numbers and bounds are rounded outwards, so a code never
rests on rounding and equal distances always go to the lower index.

Scale: one pass a round over a table of vectors, codes and bounds in the shared folder; nothing is
shuffled but the sums of each task, ENTRIES x length of them. Codebooks are that size too: they go to the
tasks with the function.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Numbers worked on at once in a task; and labels whose sums are broadcast (beyond, joined).
SLICE, BROADCAST_LABELS = 1 << 20, 100_000


def limit_of(length: int) -> int:
    """The largest component, as a whole number, with which an error surely fits into a long."""
    return math.isqrt((1 << 62) // max(1, length)) // 2


def whole(vectors: list, length: int) -> np.ndarray:
    """Rows of floor(SCALE * x), short ones padded with 0; beyond ``limit_of`` they stay at it."""
    out = np.zeros((len(vectors), length))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.clip(np.floor(out * SCALE), -limit_of(length), limit_of(length)).astype(np.int64)


def distances(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``part`` to each entry of ``book``."""
    out = np.zeros((len(part), len(book)), np.int64)
    for i in range(part.shape[1]):
        apart = part[:, i, None] - book[None, :, i]
        out += apart * apart
    return out


def above(x: np.ndarray) -> np.ndarray:
    """As 32-bit numbers, rounded up."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def scan(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound of each row, by all entries; the lower bound of one entry alone is infinite."""
    d = distances(part, book)
    code = d.argmin(axis=1)
    rows = np.arange(len(part))
    nearest = d[rows, code]
    if len(book) == 1:
        return code, above(np.sqrt(nearest)), np.full(len(part), np.inf, np.float32)
    d[rows, code] = np.iinfo(np.int64).max
    return code, above(np.sqrt(nearest)), below(np.sqrt(d.min(axis=1)))


class Moves:
    """How far the entries of each part's codebook went, and half their distance to the next entry."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        parts, entries = new.shape[:2]
        self.own = above(np.sqrt(((new - old) ** 2).sum(axis=2)))
        order = np.sort(self.own, axis=1)
        #: the farthest move of any other entry; where several went farthest, each has another beside it
        self.others = np.where(self.own == order[:, -1:], order[:, -2:-1] if entries > 1 else 0, order[:, -1:])
        self.half = np.full((parts, entries), np.inf, np.float32)
        for p in range(parts):
            d = distances(new[p], new[p]).astype(np.float64)
            np.fill_diagonal(d, np.inf)
            if entries > 1:
                self.half[p] = below(np.sqrt(d.min(axis=1)) / 2)


def bounded(part: np.ndarray, book: np.ndarray, p: int, moves: Moves, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after a move of the codebook, and how many rows were scanned."""
    upper = above(upper.astype(np.float64) + moves.own[p][code])
    lower = below(lower.astype(np.float64) - moves.others[p][code])
    safe = np.maximum(lower, moves.half[p][code])
    doubt = np.flatnonzero(~(upper < safe))
    if len(doubt):
        upper[doubt] = above(np.sqrt(((part[doubt] - book[code[doubt]]) ** 2).sum(axis=1)))
        doubt = doubt[~(upper[doubt] < safe[doubt])]
    if len(doubt):
        code[doubt], upper[doubt], lower[doubt] = scan(part[doubt], book)
    return code, upper, lower, len(doubt)


_STATE = "vec_id long, label string, vector array<float>, codes array<int>, upper array<float>, lower array<float>"


def _rows(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1] or 1), pa.int32()), pa.array(np.ascontiguousarray(a).ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _slices(batch: pa.RecordBatch, length: int):
    step = max(1, SLICE // max(1, length))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def assign(table: DataFrame, books: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """Every row with its codes and bounds: by a full scan, or by the bounds it has of the codebooks ``before``."""
    parts, _, width = books.shape
    length = parts * width

    def run(batches):
        moves = None if before is None else Moves(before, books)
        for batch in batches:
            for rows in _slices(batch, length):
                x = whole(rows.column("vector").to_pylist(), length).reshape(-1, parts, width)
                if moves is None:
                    found = [scan(x[:, p], books[p]) for p in range(parts)]
                else:
                    code, upper, lower = (_matrix(rows.column(c), parts) for c in ("codes", "upper", "lower"))
                    found = [bounded(x[:, p], books[p], p, moves, code[:, p].astype(np.int64), upper[:, p], lower[:, p])[:3] for p in range(parts)]
                code, upper, lower = (np.stack([f[i] for f in found], axis=1) for i in range(3))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), rows.column("vector"), _rows(code, pa.int32()), _rows(upper, pa.float32()), _rows(lower, pa.float32())], names=["vec_id", "label", "vector", "codes", "upper", "lower"])

    return table.mapInArrow(run, _STATE)


def updated(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry as the floor of its parts' mean; entries without parts stay."""
    parts, entries, width = books.shape
    length = parts * width

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for rows in _slices(batch, length):
                x, code = whole(rows.column("vector").to_pylist(), length).reshape(-1, parts, width), _matrix(rows.column("codes"), parts)
                for p in range(parts):
                    np.add.at(sums[p], code[:, p], x[:, p])
                    counts[p] += np.bincount(code[:, p], minlength=entries)
        p, j = np.nonzero(counts)
        slot = p * entries + j
        # position -1 holds the count
        columns = [np.repeat(slot, width + 1), np.tile(np.arange(-1, width), len(slot)), np.concatenate([counts[p, j][:, None], sums[p, j]], axis=1).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["slot", "at", "n"])

    sums = table.select("vector", "codes").mapInArrow(run, "slot long, at long, n long").groupBy("slot", "at").agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n")).collect()
    total = {(r["slot"], r["at"]): int(r["n"]) for r in sums}
    out = books.copy()
    for slot, at in total:
        if at >= 0:
            out[slot // entries, slot % entries, at] = total[slot, at] // total[slot, -1]
    return out


def _coded(table: DataFrame, books: np.ndarray) -> DataFrame:
    """Code string and exact error of each row."""
    parts, _, width = books.shape
    length = parts * width

    def run(batches):
        for batch in batches:
            for rows in _slices(batch, length):
                x, code = whole(rows.column("vector").to_pylist(), length).reshape(-1, parts, width), _matrix(rows.column("codes"), parts)
                error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                names = pa.array([bytes(c).hex() for c in code.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), names, pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return table.select("vec_id", "label", "vector", "codes").mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256.

    ``vectors`` needs vec_id, embedding and label; other columns don't matter. Vectors that are null or
    hold null or non-finite components take no part. The codebooks start from the rows with the smallest
    vec_ids (of one id, by their vectors; null ids last); with fewer rows than ``entries`` they are
    shorter. Shorter vectors are padded with zeros to the longest, and all to a multiple of ``parts``.
    Components beyond ``limit_of`` the length stay at that limit, as errors must fit into a long.
    Repeated rows get equal codes and count each. Null labels are one label. An empty table gives none.
    ``entries`` is at most 256, so that an index has two hex digits.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession, "codes")
    finite = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    table = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")).filter(finite).withColumnRenamed("embedding", "vector")
    longest = table.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return table.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = max(1, -(-longest // parts))
    first = [r["vector"] for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    books = np.ascontiguousarray(whole(first, parts * width).reshape(-1, parts, width).transpose(1, 0, 2))
    state, before = scratch.keep(assign(table, books), "codes"), books
    for _ in range(rounds):
        books, before = updated(state, books), books
        moved = scratch.keep(assign(state, books, before), "codes")
        scratch.drop(state)
        state = moved
    coded = scratch.keep(_coded(state, books), "coded")
    scratch.drop(state)
    sums = scratch.keep(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    named = F.lit(hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()).alias("codebooks_sha256")
    few = sums.count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", named)
