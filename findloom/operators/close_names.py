"""Names that are meant where a name isn't found: the closest by the share of matching characters.

The exact share costs a comparison of both texts, so pairs are chosen first by what it needs at least.
A name is the set of its characters, each with its how-manieth occurrence. For a share of ``cutoff`` two
sets have so much in common that the rarest ``1 - cutoff / (2 - cutoff)`` of each must meet: only those
are joined on. Lengths and the size of the common set then rule out most of what met, before any text
is compared. Nothing that reaches the cutoff is lost on the way.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def loose(name: Column) -> Column:
    """In lower case, without white space around and with single spaces inside."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))


def _marks(key: Column) -> Column:
    """The characters of a key, each with the number of its occurrence."""
    once = lambda chars: F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    return F.get(F.transform(F.array(F.filter(F.split(key, ""), lambda c: c != "")), once), F.lit(0))


def _share(key: Column, wanted: Column) -> Column:
    """Twice the matching characters over all characters."""

    def run(key: pd.Series, wanted: pd.Series) -> pd.Series:
        matcher, last, out = SequenceMatcher(None), None, []
        for k, w in zip(key, wanted, strict=True):
            if w != last:
                matcher.set_seq2(w)
                last = w
            matcher.set_seq1(k)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, T.DoubleType())(key, wanted)


def close_matches(wanted: DataFrame, names: DataFrame, n: int = 3, cutoff: float = 0.6) -> DataFrame:
    """(wanted, name, place, share): for each distinct ``wanted(name)`` up to ``n`` of ``names(name)``, the closest first.

    A name that is the same but for case and white space is the only answer. Of names that are the same
    in that way the least stands for all; equal shares go to the greater name in lower case. Null and
    blank names ask for nothing and answer nothing.
    """
    known = names.select(loose(F.col("name")).alias("key"), "name").filter("key != ''").groupBy("key").agg(F.min("name").alias("name"))
    asked = wanted.select(F.col("name").alias("wanted"), loose(F.col("name")).alias("asked")).filter("asked != ''").distinct()
    same = asked.join(known, F.col("asked") == F.col("key")).select("wanted", "name", F.lit(1).alias("place"), F.lit(1.0).alias("share"))
    open_ = asked.join(known, F.col("asked") == F.col("key"), "left_anti")
    least = cutoff / (2 - cutoff)

    marked = known.select("key", _marks(F.col("key")).alias("marks"))
    often = marked.select(F.explode("marks").alias("mark")).groupBy("mark").agg(F.count("*").alias("often"))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        """Each key with all its marks and, one a row, the rarest of them."""
        each = rows.select(key, F.explode("marks").alias("mark")).join(often, "mark", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "mark")))
        ranked = each.groupBy(key).agg(order.alias("order"))
        first = F.slice("order", F.lit(1), (F.size("order") - F.ceil(F.size("order") * F.lit(least) - 1e-9) + 1).cast("int"))
        return ranked.select(key, F.transform("order", lambda x: x["mark"]).alias("marks"), F.explode(first).alias("x")).select(key, "marks", F.col("x.mark").alias("mark"))

    a = rarest(open_.select("asked").distinct().select("asked", _marks(F.col("asked")).alias("marks")), "asked").withColumnRenamed("marks", "asked_marks")
    b = rarest(marked, "key")
    size, other = F.size("asked_marks"), F.size("marks")
    fits = F.least(size, other) >= F.greatest(size, other) * least - 1e-9
    met = a.join(b, "mark").filter(fits).groupBy("asked", "key").agg(F.first("asked_marks").alias("asked_marks"), F.first("marks").alias("marks"))
    near = met.filter(2 * F.size(F.array_intersect("asked_marks", "marks")) >= (size + other) * cutoff - 1e-9)
    shares = near.select("asked", "key", _share(F.col("key"), F.col("asked")).alias("share")).filter(F.col("share") >= cutoff)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("share"), F.desc("key")))
    best = shares.withColumn("place", place).filter(F.col("place") <= n)
    return open_.join(best, "asked").join(known, "key").select("wanted", "name", "place", "share").unionByName(same)
