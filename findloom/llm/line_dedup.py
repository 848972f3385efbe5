"""Repeated runs of lines by a distributed suffix array over line-ID sequences.

Lines that occur once are set aside, and so are stretches of the others of fewer than ``min_words``
words: no repeated run can cross or lie in them. What is left is one sequence of integer ids in
document order, cut into stretches.

Suffix array. Suffixes are ranked by prefix doubling: the rank by 2h lines is the place of the pair of
ranks by h lines in a distributed sort, and a stretch that ends counts as less than any line. Once h
passes the longest stretch, the ranks and then the places order all suffixes. The longest common
prefix of neighbours in that order is told by going down the kept ranks: where those by h lines agree,
h lines are common.

Longest-common-prefix intervals. For each suffix the longest run that stands earlier is looked for
among the suffixes before and after it in the order, whose common prefixes with it only shrink with
the distance. A frontier holds of each common length the earliest place, so a run is found with its
first copy, and is cut to where it would overlap that copy. The order is dealt to tasks in pieces of
equal size, whatever the intervals; a piece needs of the others only their frontiers, which have at
most as many entries as the longest stretch has lines.

A run counts once it has ``min_words`` words; its later copies are deleted. Texts move once, to meet
their runs; the runs grow with the corpus, so that join is a merge at every size.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.arrays import groups
from findloom.llm.scratch import Scratch

MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"
_FAR = 1 << 60


def _stretches(min_words: int):
    """Lines of stretches of at least ``min_words`` words: lines left, lines before, and lines that make up as many words."""

    def run(batches):
        for t in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, h, lines in zip(t.column("doc_id").to_pylist(), t.column("h").to_pylist(), t.column("lines").to_pylist(), strict=True):
                lo = 0
                while lo < len(lines):
                    hi = lo + 1
                    while hi < len(lines) and lines[hi]["idx"] == lines[hi - 1]["idx"] + 1:
                        hi += 1
                    own = lines[lo:hi]
                    words = [x["words"] for x in own]
                    if sum(words) >= min_words:
                        n, ahead, end, total = len(own), [], 0, 0
                        for i in range(n):
                            while end < n and total < min_words:
                                total += words[end]
                                end += 1
                            ahead.append(end - i if total >= min_words else 0)
                            total -= words[i]
                        for to, x in zip(cols, ([doc] * n, [h] * n, [x["idx"] for x in own], [x["name"] for x in own], range(n, 0, -1), range(n), ahead), strict=True):
                            to.extend(x)
                    lo = hi
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "h", "idx", "name", "left", "seen", "ahead"])

    return run


def sequence(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """(id, doc_id, h, idx, name, left, seen, ahead) of the lines that a repeated run may hold, in document order."""
    split = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.posexplode(split).alias("idx", "line"))
    lines = scratch.keep(rows.select("doc_id", "h", "idx", F.unhex(F.md5("line")).alias("key"), F.xxhash64("line").alias("key2"), F.least(F.regexp_count("line", F.lit(_WORD)), F.lit(min_words)).alias("words")), "lines")
    names = lines.groupBy("key", "key2").agg(F.count("*").alias("n")).filter("n > 1").sortWithinPartitions("key", "key2").select("key", "key2", F.monotonically_increasing_id().alias("name"))
    names = scratch.keep(names, "names")
    some = lines.join(names, ["key", "key2"]).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("idx", "name", "words"))).alias("lines"), F.sum("words").alias("all")).filter(F.col("all") >= min_words).drop("all")
    ordered = some.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(_stretches(min_words), "doc_id long, h long, idx int, name long, left long, seen long, ahead long")
    base = scratch.keep(ordered.select(F.monotonically_increasing_id().alias("id"), "*"), "base")
    scratch.drop(lines, names)
    return base


def ranks(base: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(h, (id, left, rank)) for h = 1, 2, 4, ... until h lines tell all suffixes apart as far as they differ."""
    stats = base.agg(F.max("left").alias("longest"), F.count("*").alias("n")).first()
    levels, h = [(1, base.select("id", "left", F.col("name").alias("rank")))], 1
    while h < (stats.longest or 0):
        now = levels[-1][1]
        after = now.select((F.col("id") - h).alias("id"), F.col("rank").alias("b"))
        pairs = now.select("id", "left", F.col("rank").alias("a")).join(after, "id", "left").withColumn("b", F.when(F.col("left") > h, F.col("b")).otherwise(F.lit(-1)))
        pairs = scratch.keep(pairs, "pairs")
        places = scratch.keep(pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()), "places")
        levels.append((2 * h, scratch.keep(pairs.join(places, ["a", "b"]).select("id", "left", "rank"), "rank")))
        h *= 2
        if places.count() == stats.n:
            break
        scratch.drop(pairs, places)
    return levels


def suffix_array(base: DataFrame, levels: list[tuple[int, DataFrame]], scratch: Scratch) -> DataFrame:
    """(part, place, id, left, seen, ahead, common) of the suffixes of enough words in their order.

    ``common`` is the number of lines that a suffix shares with the one before it, and 0 where these
    have too few words. Pieces of the order are numbered by ``part``.
    """
    last = levels[-1][1].select("id", "rank")
    starts = base.filter("ahead > 0").select("id", "left", "seen", "ahead").join(last, "id")
    order = starts.repartitionByRange("rank", "id").sortWithinPartitions("rank", "id").withColumn("place", F.monotonically_increasing_id())
    order = scratch.keep(order.withColumn("part", F.shiftright("place", 33).cast("int")), "order")
    ends = sorted(tuple(r) for r in order.groupBy("part").agg(F.max(F.struct("place", "id", "left", "ahead")).alias("e")).select("part", "e.id", "e.left", "e.ahead").collect())  # one row a piece
    before = {part: ends[i - 1][1:] if i else (-1, 0, 0) for i, (part, *_) in enumerate(ends)}

    def neighbours(batches):
        for g in groups(batches, ["part"]):
            ids, left, ahead = (g.column(c).to_pylist() for c in ("id", "left", "ahead"))
            was = before[g.column("part")[0].as_py()]
            rows = [(i, j, min(x, y)) for i, x, m, j, y, n in zip(ids, left, ahead, [was[0], *ids], [was[1], *left], [was[2], *ahead]) if m == n]  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["id", "j", "most"])

    pairs = order.repartition("part").sortWithinPartitions("part", "place").mapInArrow(neighbours, "id long, j long, most long")
    pairs = scratch.keep(pairs.withColumn("off", F.lit(0).cast("long")), "neighbours")
    for h, level in reversed(levels):
        at = lambda c, name, level=level: level.select((F.col("id")).alias(f"at_{c}"), F.col("rank").alias(name))
        open_ = pairs.withColumn("at_id", F.when(F.col("off") < F.col("most"), F.col("id") + F.col("off"))).withColumn("at_j", F.col("j") + F.col("off"))
        both = open_.join(at("id", "x"), "at_id", "left").join(at("j", "y"), "at_j", "left")
        fresh = scratch.keep(both.select("id", "j", "most", F.when(F.col("x") == F.col("y"), F.least(F.col("off") + h, "most")).otherwise(F.col("off")).alias("off")), "common")
        scratch.drop(pairs)
        pairs = fresh
    common = F.when(F.col("off") >= F.col("ahead"), F.col("off")).otherwise(F.lit(0)).alias("common")
    return scratch.keep(order.join(pairs.select("id", "off"), "id", "left").select("part", "place", "id", "left", "seen", "ahead", F.coalesce(common, F.lit(0)).alias("common")), "suffixes")


class Frontier:
    """Of each common length with the suffix last met the earliest place; both grow from the first entry on."""

    def __init__(self, entries: list[tuple[int, int]] = ()):
        self.place, self.common = [p for p, _ in entries], [c for _, c in entries]

    def shrink(self, most: int) -> None:
        """The next suffix has ``most`` lines in common with the last."""
        place = None
        while self.common and self.common[-1] >= most:
            place = self.place.pop()
            self.common.pop()
        if place is not None and most:
            self.place.append(place)
            self.common.append(most)

    def earlier(self, at: int, start: int) -> int:
        """The longest run at ``at`` that stands earlier and ends before it; ``start`` is where its stretch begins."""
        while self.place and self.place[-1] > at:
            self.place.pop()
            self.common.pop()
        if not self.place:
            return 0
        free = lambda k: _FAR if self.place[k] < start else at - self.place[k]
        # from the last entry to the first, common lines fall and free ones rise
        k = bisect_left(range(len(self.place)), True, key=lambda k: free(len(self.place) - 1 - k) >= self.common[len(self.place) - 1 - k])
        whole = self.common[len(self.place) - 1 - k] if k < len(self.place) else 0
        return max(whole, free(len(self.place) - k) if k else 0)

    def add(self, at: int) -> None:
        self.place.append(at)
        self.common.append(_FAR)

    def entries(self) -> list[tuple[int, int]]:
        return list(zip(self.place, self.common, strict=True))


def _passed(into: Frontier, most: int, own: Frontier) -> Frontier:
    """The frontier after a piece whose least common length is ``most`` and whose own frontier is ``own``."""
    into.shrink(most)
    kept = [(p, c) for p, c in into.entries() if not own.place or p < own.place[0]]
    entries = kept + own.entries()
    # an earlier entry of the same common length stands for the later one
    return Frontier([e for i, e in enumerate(entries) if not i or e[1] > entries[i - 1][1]])


def _piece(t: pa.Table, forward: bool) -> list[tuple[int, int, int]]:
    """(id, seen, lines in common with the one met before) in the direction; the first's is -1 when going back."""
    ids, seen, common = (t.column(c).to_pylist() for c in ("id", "seen", "common"))
    return list(zip(ids, seen, common, strict=True)) if forward else list(zip(ids[::-1], seen[::-1], [-1, *common[:0:-1]], strict=True))


def _walk(rows: list[tuple[int, int, int]], front: Frontier, first: int) -> list[int]:
    """The longest earlier run of each suffix of a piece; ``front`` goes along."""
    out = []
    for at, seen, common in rows:
        front.shrink(first if common < 0 else common)
        out.append(front.earlier(at, at - seen))
        front.add(at)
    return out


def earlier_runs(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, lines): the longest run at each place that stands earlier without overlap, if it has enough words."""
    pieces = suffixes.repartition("part").sortWithinPartitions("part", "place")

    def fronts(batches):
        for g in groups(batches, ["part"]):
            common = g.column("common").to_pylist()
            out = [g.column("part")[0].as_py(), common[0], min(common), min(common[1:], default=_FAR)]
            for forward in (True, False):
                front = Frontier()
                _walk(_piece(g, forward), front, 0)
                out.append([{"place": p, "common": c} for p, c in front.entries()])
            entry = pa.list_(pa.struct([("place", pa.int64()), ("common", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, [pa.int32(), *[pa.int64()] * 3, entry, entry], strict=True)], names=["part", "first", "least", "inner", "ahead", "back"])

    entry = "array<struct<place:long,common:long>>"
    rows = pieces.mapInArrow(fronts, f"part int, first long, least long, inner long, ahead {entry}, back {entry}").collect()  # one row a piece
    rows.sort(key=lambda r: r.part)
    ahead, back, front = {}, {}, Frontier()
    for r in rows:
        ahead[r.part] = front.entries()
        front = _passed(front, r.least, Frontier([tuple(e) for e in r.ahead]))
    front, following = Frontier(), 0
    for r in reversed(rows):
        back[r.part] = (front.entries(), following)
        front = _passed(front, min(following, r.inner), Frontier([tuple(e) for e in r.back]))
        following = r.first

    def runs(batches):
        for g in groups(batches, ["part"]):
            part = g.column("part")[0].as_py()
            one = _walk(_piece(g, True), Frontier(ahead[part]), 0)
            entries, first = back[part]
            two = _walk(_piece(g, False), Frontier(entries), first)[::-1]
            rows = [(i, max(a, b)) for i, m, a, b in zip(g.column("id").to_pylist(), g.column("ahead").to_pylist(), one, two, strict=True) if max(a, b) >= m]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["id", "lines"])

    return scratch.keep(pieces.mapInArrow(runs, "id long, lines long"), "runs")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, h, from, lines) of the runs of at least ``min_words`` words that stand earlier, at every place.

    ``h`` is a hash of the text, ``from`` counts the lines that are not blank, from 0.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    base = sequence(docs, min_words, scratch)
    runs = earlier_runs(suffix_array(base, ranks(base, scratch), scratch), scratch)
    return runs.join(base.select("id", "doc_id", "h", "idx"), "id").select("doc_id", "h", F.col("idx").alias("from"), F.col("lines").cast("int").alias("lines"))


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, text (without later copies), n_lines, n_removed, removed (line numbers).

    Line p is deleted if it lies in a run of at least ``min_words`` words that equals an earlier run,
    of another document or of lines before its own first. Copies are later in the order of doc_id, then hash of the text, then line; null ids are first.
    Null and empty texts have no lines and stay as they are. Rows that repeat both doc_id and text
    are one document and get equal answers. Lines are numbered from 0, blank ones included; blank
    lines are never deleted.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    copies = repeated_runs(docs, min_words, scratch)
    per_doc = scratch.keep(copies.groupBy("doc_id", "h").agg(F.collect_set(F.struct("from", "lines")).alias("runs")), "runs")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    joined = own.alias("d").join(per_doc.alias("r").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.h") == F.col("r.h")), "left").select("d.doc_id", "text", "runs")
    white = "\x20\x09\x0a\x0b\x0c\x0d"

    def run(batches):
        for t in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, runs in zip(t.column("text").to_pylist(), t.column("runs").to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                gone = {i for r in runs or () for i in range(r["from"], r["from"] + r["lines"])}
                removed, at = [], 0
                for i, line in enumerate(lines):
                    if line.strip(white):
                        if at in gone:
                            removed.append(i)
                        at += 1
                drop = set(removed)
                kept = "\n".join(x for i, x in enumerate(lines) if i not in drop) if removed else text
                for to, x in zip(out, (kept, len(lines), len(removed), removed), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int32()))], names=["doc_id", "text", "n_lines", "n_removed", "removed"])

    return joined.mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long, removed array<int>")
