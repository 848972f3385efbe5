"""Words and word shingles of many texts at once, as numpy arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Texts are worked on in slices of bounded
size, so memory follows the slice (or one longest text), never the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = [np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: As separators all bytes but ASCII letters and those of other scripts: for words without punctuation.
UNLETTERED = np.array([not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_SHIFT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _places(n: int) -> np.ndarray:
    if len(_PLACE[0]) < n:
        size = max(256, 1 << (n - 1).bit_length())
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _PLACE[0] = np.multiply.accumulate(out)
    return _PLACE[0]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of each text, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def lowered(texts: list[bytes | None]) -> list[bytes]:
    """The texts in lower case of all scripts; null as empty."""
    return [t.decode("utf-8", "replace").lower().encode() if t else b"" for t in texts]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most ``limit`` in sum, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal integer keys together; rows must come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Words:
    """``start``/``end`` byte offsets in ``buf`` and ``doc``, the index of the text, of each word."""

    def __init__(self, texts: list[bytes | None], white: np.ndarray = _WHITE):
        self.raw = b"\n".join(t or b"" for t in texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        white = white[self.buf]
        before = np.empty_like(white)
        before[0], before[1:] = True, white[:-1]
        self.start = np.flatnonzero(before & ~white)
        self.end = np.flatnonzero(white & ~before)
        ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(ends, self.start, side="right")
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self._solid = ~white

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        value = _BYTE[self.buf[self._solid]] * _places(int(size.max()))[place]
        return mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _SHIFT[0])

    def text(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles, sorted within each text, and where each text's begin.

    A text of fewer than k words, but of one at least, has its whole sequence as its one shingle;
    a text without words has none. The second array has a last entry: the total.
    """
    words = Words(texts)
    h = words.hashes()
    counts = np.diff(words.first)
    if len(h) >= k:
        joined = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            joined += mix(h[j : len(h) - k + 1 + j] * _SHIFT[j % len(_SHIFT)] + np.uint64(j))
        inside = words.doc[: len(h) - k + 1] == words.doc[k - 1 :]
        value, doc = mix(joined[inside]), words.doc[: len(h) - k + 1][inside]
    else:
        value, doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            whole[has] += mix(h[words.first[short[has]] + j] * _SHIFT[j % len(_SHIFT)] + np.uint64(j))
        value = np.concatenate([value, mix(whole + counts[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))
