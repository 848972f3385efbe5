"""Rows of a table that an operator's answer keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_key(text: Column | str = "text") -> Column:
    """Tells the texts under one doc_id apart."""
    return F.xxhash64(text)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unordered(kind: T.DataType) -> bool:
    """Whether values of the type can't be sorted."""
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind.fields)
    return _unordered(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id and text are in ``kept(doc_id, h)``.

    ``h`` is ``text_key``; of rows that repeat both doc_id and text the first by all other columns stays,
    nulls first (columns that have no order, such as maps, don't decide). Whole rows move once, as
    ``kept`` grows with the corpus and is never broadcast: the join is a merge at every size. The
    text's key keeps rows with a null doc_id from meeting in one task.
    """
    keys = lambda i, h: (F.coalesce(i.cast("long"), F.lit(0)).alias("k1"), i.isNull().alias("k2"), h.alias("k3"))
    rest = [f.name for f in docs.schema.fields if f.name not in ("doc_id", "text") and not _unordered(f.dataType)]
    own = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("row"), *keys(F.col("doc_id"), text_key(F.col("text").cast("string"))))
    wanted = kept.select(*keys(F.col("doc_id"), F.col("h"))).distinct()
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy(*([F.col(f"row.{_quoted(c)}") for c in rest] or [F.lit(0)])))
    return own.join(wanted.hint("merge"), ["k1", "k2", "k3"], "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
