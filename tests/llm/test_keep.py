from __future__ import annotations

from pyspark.sql import functions as F

from findloom.llm.keep import rows_of, text_key


def test_of_repeated_rows_the_first_by_the_other_columns_stays(spark):
    rows = [(1, "x", "b", 2, {"m": 1}), (1, "x", "a", 9, None), (1, "x", None, 5, {"m": 2}), (1, "y", "z", 0, None), (None, "x", "q", 1, None), (None, None, "k", 1, None), (2, "x", "c", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `so.urce` string, n int, m map<string,int>")
    kept = docs.filter("doc_id IS NULL OR doc_id = 1").select("doc_id", text_key(F.col("text")).alias("h"))
    for parts in (1, 7):
        got = sorted(((r["doc_id"], r["text"], r["so.urce"]) for r in rows_of(docs.repartition(parts), kept).collect()), key=str)
        assert got == sorted([(1, "x", None), (1, "y", "z"), (None, "x", "q"), (None, None, "k")], key=str)
    assert rows_of(docs, kept.limit(0)).count() == 0
