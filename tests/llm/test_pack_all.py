from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import tokenizers
from pyspark.sql import functions as F

from findloom.llm import packing
from findloom.llm.tokenizer_files import TOKENIZER

WINDOW = 2048


def test_every_id_of_every_document_lies_in_one_piece(spark):
    """Ids, places and sequences told by the tokenizer itself, for all supplied documents and odd rows with clashing columns."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  \n\t "), (-4, "a" * 50_000), (-5, "日本語 " * 3000), (-6, "x y z"), (-7, "x y z")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"start": F.lit(5), "length": F.lit("x"), "sequence_id": F.lit(None).cast("string"), "ids": F.lit(1)})
    tokenizer = tokenizers.Tokenizer.from_file(str(TOKENIZER))
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, TOKENIZER).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for doc, ids in want.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= WINDOW
    padding = sum(WINDOW - sum(n for _, n in p) for p in sequences.values() if sum(n for _, n in p) & (sum(n for _, n in p) - 1))
    assert padding < 2 * WINDOW
