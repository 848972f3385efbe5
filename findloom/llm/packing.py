"""Packing token pieces into fixed windows with minimum bin slack.

A document's ids (and one closing id) are cut every ``window`` ids; the last, shorter piece is packed
with others. Only the number of pieces of each length reaches the driver: at most ``window`` rows,
whatever the input. There each window starts with the longest length left, and a bitset subset-sum
over the remaining multiset finds the filling closest to the capacity; counts are backtracked, and
the pattern is used as often as the counts allow. The plan (at most some thousands of rows, bounded
by the window alone) says for the r-th piece of each length its window and offset.

The rank of a piece among those of its length comes from counts by (length, bucket) and a row number
inside the bucket, so one very common length is spread over all buckets, whose number follows the input.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.arrays import _places, mix, slices
from findloom.llm.scratch import Scratch

WINDOW = 2048
END_ID = 1
#: Pieces that are sorted together at most, about, when those of one length are numbered.
SORTED = 50_000
CACHE_WORDS = 700_000
#: Code points of which NFC, lower case and class are those of the single code point in any context.
PLAIN_RANGES = ((0x00, 0x1B), (0x20, 0x7F), (0xA1, 0x2FF), (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2027), (0x2030, 0x203E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xFF01, 0xFF5E))
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


class WordEncoder:
    """Token ids of many texts by a BPE file whose words are encoded one by one.

    The file's rules (NFC, lower case, white space dropped; words, single digits, runs of other signs
    and seven English contractions as units) are applied to whole slices at once, and each different
    unit goes through the file's own BPE model once. Texts with code points outside PLAIN_RANGES or
    with special-token strings are encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        assert sorted(self.letters.values()) == alphabet
        self.kind = np.full(0x10000, 255, np.uint8)
        self.lower = np.arange(0x10000, dtype=np.uint32)
        for lo, hi in PLAIN_RANGES:
            for c in range(lo, hi + 1):
                low, cat = chr(c).lower(), unicodedata.category(chr(c))
                if len(low) == 1 and cat != "Cn":
                    self.lower[c] = ord(low)
                    self.kind[c] = SPACE if chr(c).isspace() else LETTER if cat[0] == "L" else NUMBER if cat[0] == "N" else OTHER
        self.value = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 0x10000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.at, self.size = array("I"), array("q"), array("i")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain, codes = [], []
        for i, t in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            if len(c) and ("<|" in t or c.max() >= 0x10000 or (self.kind[c] == 255).any()):
                out[i] = np.array(self.full.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(i)
                codes.append(c)
        if plain:
            for i, ids in zip(plain, self._encode_plain(codes), strict=True):
                out[i] = ids
        return out

    def _encode_plain(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        newline = np.array([10], np.uint32)
        c = np.concatenate([x for t in codes for x in (t, newline)])
        kind, low = self.kind[c], self.lower[c]
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        self._contractions(c, low, kind, start)
        stops = np.flatnonzero(start | (kind == SPACE))
        is_start = start[stops]
        begin, end = stops[is_start], np.append(stops[1:], len(c))[is_start]
        ends = np.cumsum([len(t) + 1 for t in codes])
        if not len(begin):
            return [np.zeros(0, np.uint32) for _ in codes]
        size = end - begin
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        solid = low[kind != SPACE]
        h = mix(np.add.reduceat(self.value[solid] * _places(int(size.max()))[place], at) + size.astype(np.uint64))
        which, distinct = pd.factorize(h)
        sample = np.empty(len(distinct), np.int64)
        sample[which[::-1]] = np.arange(len(h) - 1, -1, -1)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        index = np.empty(len(distinct), np.int64)
        for j, key in enumerate(distinct.tolist()):
            k = self.known.get(key)
            index[j] = self._learn(key, low[begin[sample[j]] : end[sample[j]]]) if k is None else k
        k = index[which]
        flat, offset, count = np.frombuffer(self.flat, np.uint32).copy(), np.frombuffer(self.at, np.int64).copy(), np.frombuffer(self.size, np.int32).copy()
        n = count[k].astype(np.int64)
        to = np.cumsum(n)
        ids = flat[np.repeat(offset[k] - (to - n), n) + np.arange(int(to[-1]))]
        total = np.concatenate([[0], to])
        cut = total[np.searchsorted(begin, ends)]
        return np.split(ids, cut[:-1])

    @staticmethod
    def _contractions(c: np.ndarray, low: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are units where the apostrophe begins a unit."""
        quote = np.flatnonzero(c[:-1] == 39)
        quote = quote[((quote == 0) | (kind[quote - 1] != OTHER)) & (kind[quote + 1] == LETTER)]
        for i in quote.tolist():
            one, two = chr(low[i + 1]), chr(low[i + 1]) + chr(low[i + 2])
            n = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") and kind[i + 2] == LETTER else 0
            if n:
                start[i + 1] = False
                if kind[i + n] == LETTER:
                    start[i + n] = True

    def _learn(self, key: int, codes: np.ndarray) -> int:
        word = codes.astype("<u4").tobytes().decode("utf-32-le")
        if not (word.isascii() and word.isalnum()):
            word = "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(word)]
        self.known[key] = k = len(self.at)
        self.at.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return k


_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece of each row of ``docs``."""

    def run(batches):
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder = _ENCODERS[tokenizer]
        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in slices(texts, 1_000_000):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(ids_of[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(ids), window):
                        part = ids[s : s + window]
                        for to, x in zip(rows, (doc, s, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is closest to the capacity from below.

    The reachable sums are the bits of one integer; a length used up to n times is added in parts of
    1, 2, 4, ... copies. Walking back through the states gives how often each length is used.
    """
    full, reach, states = 1 << capacity, 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            states.append((reach, length, part))
            reach |= (reach << (length * part)) & (2 * full - 1)
            left -= part
            part *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, part in reversed(states):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def plan(histogram: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """For each length its ranks in order: rank_from, first sequence, pieces in one window, offset."""
    left = {k: v for k, v in histogram.items() if v > 0}
    rank = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        used = fill(rest, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, rank[length], sequence, n, offset))
            offset += n * length
            rank[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "sequence", "each", "offset"]).astype("int64").sort_values(["length", "rank_from"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: their one id is the closing id. Rows that repeat a doc_id are packed each
    on its own; null doc_ids stay null. An empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    table = scratch.keep(pieces(docs, tokenizer, window), "pieces")
    many = 1024 + table.count() // SORTED
    table = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(many)))
    in_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.keep(table.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(in_length), F.lit(0)).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    p = plan(histogram, window)
    cols = {c: p[c].to_numpy() for c in p}
    step = np.int64(1) << np.int64(44)
    key = cols["length"] * step + cols["rank_from"]

    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = table.withColumn("nth", nth).join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        for t in batches:
            length, rank = (t.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, length * step + rank, side="right") - 1
            q = rank - cols["rank_from"][i]
            sequence = cols["sequence"][i] + q // cols["each"][i]
            offset = cols["offset"][i] + q % cols["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
