"""Exact duplicates by deterministic block naming.

Every text, white space normalised, is cut into blocks of a fixed number of bytes. The distinct
blocks are sorted and numbered: a block's number is its name, and different blocks never share
one. Adjacent pairs of names are then sorted and named in the same way, level by level, until one
name is left for each document. Two documents have the same length in blocks and the same last
name exactly when their normalised texts are equal; no hash decides it.

Scale: a block's content is shuffled once, after map-side removal of repeats, so a text with
thousands of copies costs one block per map task. Afterwards only 16-byte keys (checked to be free
of collisions on the table of names itself) and integer names move. The number of levels is the
logarithm of the longest text in blocks; a document leaves the recursion once it has one name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.arrays import SLICE_BYTES, as_bytes
from findloom.llm.keep import rows_of, text_key
from findloom.llm.scratch import Scratch

BLOCK_BYTES = 4096
_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: bytes | None) -> bytes:
    """The text with each run of white space as one space; null counts as empty."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    return b" " * (text[0] in _WHITE) + b" ".join(words) + b" " * (text[-1] in _WHITE)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Every block of every normalised text."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for text in as_bytes(batch.column("text")):
                data = normalised(text)
                out.extend(data[i : i + block_bytes] for i in range(0, len(data), block_bytes))
                size += len(data)
                if size > SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["block"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "block binary")


def _rows(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, text key, the hash of the normalised text and its blocks' routing keys."""

    def run(batches):
        for batch in batches:
            sha, keys = [], []
            for text in as_bytes(batch.column("text")):
                data = normalised(text)
                sha.append(hashlib.sha256(data).hexdigest())
                keys.append([hashlib.sha256(data[i : i + block_bytes]).digest()[:16] for i in range(0, len(data), block_bytes)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sha, pa.string()), pa.array(keys, pa.list_(pa.binary()))], names=["doc_id", "h", "text_sha256", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text").cast("string")).alias("h")).mapInArrow(run, "doc_id long, h long, text_sha256 string, keys array<binary>")


def _named(keys: DataFrame, *cols: str) -> DataFrame:
    """One row for each distinct key, with its rank within its partition as a name of its own."""
    return keys.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """Each row's ``row`` number, ``doc_id``, text key ``h``, ``text_sha256`` and identity ``(n_blocks, name)``.

    ``docs`` needs ``doc_id`` and ``text``; other columns don't matter. Empty and null texts have no
    block and share the identity (0, -1).
    """
    scratch = scratch or Scratch(docs.sparkSession, "naming")
    key = F.substring(F.unhex(F.sha2("block", 256)), 1, 16)
    table = scratch.keep(_named(_blocks(docs, block_bytes), "block").select(key.alias("key"), "name"), "blocks")
    if table.groupBy("key").count().filter("count > 1").limit(1).count():
        raise ValueError("two different blocks have one routing key")
    rows = scratch.keep(_rows(docs, block_bytes).select(F.monotonically_increasing_id().alias("row"), "*"), "rows")

    named = rows.select("row", F.posexplode("keys").alias("pos", "key")).join(table, "key").select("row", "pos", "name")
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    done, open_ = [], None
    while True:
        level = scratch.keep(named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("a")).select("row", F.expr("transform(a, x -> x.name)").alias("names")), "level")
        done.append(level.filter(F.size("names") == 1).select("row", F.col("names")[0].alias("name")))
        if longest <= 1:
            break
        longest = (longest + 1) // 2
        open_ = level.filter(F.size("names") > 1)
        pairs = open_.select("row", F.posexplode(F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] as a, coalesce(get(names, 2 * i + 1), -1L) as b))")).alias("pos", "p")).select("row", "pos", "p.a", "p.b")
        fresh = scratch.keep(_named(pairs, "a", "b"), "pairs")
        named = pairs.join(fresh, ["a", "b"]).select("row", "pos", "name")
    last = done[0]
    for more in done[1:]:
        last = last.union(more)
    return rows.select("row", "doc_id", "h", "text_sha256", F.size("keys").alias("n_blocks")).join(last, "row", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation; null counts as empty, so null
    and empty texts form one group. Of a group the row with the smallest doc_id stays (null ids
    last); of rows that repeat both doc_id and text exactly one is kept. An empty table gives none.
    """
    return _answers(docs, block_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _answers(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``exact_duplicates`` with ``h``, the key of the row's text."""
    scratch = Scratch(docs.sparkSession, "exact")
    ids = scratch.keep(block_names(docs, block_bytes, scratch), "ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # written, so that the join below has exchanges of its own and a large group can be split
    groups = scratch.keep(ids.groupBy("n_blocks", "name").agg(first, F.count("*").alias("group_size")).select("n_blocks", "name", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")
    out = ids.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "h")


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps."""
    scratch = Scratch(docs.sparkSession, "exact")
    return rows_of(docs, scratch.keep(_answers(docs, block_bytes).filter("kept").select("doc_id", "h"), "kept"))
