"""How the sources of each language differ in their words, by joint count histograms.

Words are counted where the texts are: a task tallies (language, source, word) over its batches, so a
frequent word or a source with a third of all rows costs one row a tally, not one an occurrence.

For each pair of sources of a language the kept words are tallied by their two counts: how many words
occur a times here and b times there. Only words in both sources are joined; the zero cells follow from
each source's own histogram of counts and from the number of kept words, as signed contributions to the
same sum. The divergence is then evaluated once for each combination of counts and multiplied.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findloom.llm.arrays import as_bytes
from findloom.llm.scratch import Scratch

#: A word is kept if so many documents of its language hold it.
LEAST_DOCS = 30
#: Probabilities are whole parts of SCALE, with PSEUDO added to every count.
SCALE, PSEUDO = 1_000_000_000, 5
#: Words of a source that are reported.
TOP = 50
#: A task hands on its tally from so many entries on.
TALLY = 400_000
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased, as UTF-8; of a long text in several lists."""
    letters = (text or b"").translate(_LETTERS)
    at = 0
    while at < len(letters):
        end = letters.find(b" ", at + piece) if len(letters) - at > piece else -1
        end = len(letters) if end < 0 else end
        yield letters[at:end].split()
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each word, in parts that are to be summed.

    A group's own row, with an empty term, says that it occurs.
    """

    def run(batches):
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            size = [len(n) for n, _ in held.values()]
            group = [pa.concat_arrays([pa.repeat(pa.scalar(g[i].decode(), pa.string()), k) for g, k in zip(held, size, strict=True)]) for i in range(2)]
            term = pa.array([t for n, _ in held.values() for t in n], pa.binary()).cast(pa.string())
            counts = pa.array([x for n, _ in held.values() for x in n.values()], pa.int64())
            docs = pa.array([holds[t] for n, holds in held.values() for t in n], pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([*group, term, counts, docs], names=["lang", "source", "term", "n", "docs"])

        entries = 0
        for batch in batches:
            lang, source, text = (as_bytes(batch.column(c)) for c in ("lang", "source", "text"))
            for i in range(len(text)):
                n, holds = held.setdefault((lang[i] or b"", source[i] or b""), (Counter({b"": 0}), Counter()))
                had, distinct = len(n), set()
                for words in words_of(text[i]):
                    n.update(words)
                    distinct.update(words)
                holds.update(distinct)
                entries += len(n) - had
                if entries >= TALLY:
                    yield out()
                    entries = 0
        if held:
            yield out()

    text = lambda c: F.col(c).cast("string").alias(c)
    return docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _part(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PSEUDO) / (total + PSEUDO * terms)), exactly; null where nothing is divided by.

    SCALE * (n + PSEUDO) passes a long's range in a large corpus: it is divided as a decimal.
    """
    whole = lambda x: x.cast("decimal(19,0)")
    above = whole(n + PSEUDO) * F.lit(SCALE).cast("decimal(10,0)")
    below = whole(total + PSEUDO * terms)
    by = F.when(below > 0, below)
    return F.call_function("div", above, by) + 1


def groups_and_terms(docs: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, total, terms, lang_total) and kept counts (lang, source, term, n > 0, lang_n).

    The tallies meet by language and word once, and what is summed by source and what by language stays
    there; a word's rows are its sources' in each tally, so even the commonest word's are few.
    """
    of_word = Window.partitionBy("lang", "term")
    counted = word_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    both = counted.withColumns({"lang_n": F.sum("n").over(of_word), "lang_docs": F.sum("docs").over(of_word)})
    kept = scratch.keep(both.filter((F.col("term") == "") | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n"), "terms")
    terms = kept.filter("term != ''")
    of_lang = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    found = kept.filter("term = ''").select("lang", "source").join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left")
    return scratch.keep(found.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups"), terms


def histograms(groups: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, a, b, na, nb, times): how many kept words occur na times in a and nb times in b, for sources a < b."""
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("terms").alias(f"{name}_terms"))
    pairs = scratch.keep(side("a").join(side("b"), "lang").filter("a < b").select("lang", "a", "b", F.col("a_terms").alias("terms")), "pairs")
    own = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
    # a word's sources meet pair by pair, and are summed before anything is shuffled
    word = lambda name: terms.select("lang", "term", F.col("source").alias(name), F.col("n").alias(f"n{name}"))
    both = word("a").join(word("b"), ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count("*").alias("times"))
    none, cell = F.lit(0).cast("long"), lambda a, b, m: F.struct(a.alias("na"), b.alias("nb"), m.alias("times"))
    spread = lambda df, *cells: df.select("lang", "a", "b", F.explode(F.array(*cells)).alias("x")).select("lang", "a", "b", "x.*")
    n, na, nb, times = F.col("n"), F.col("na"), F.col("nb"), F.col("times")
    signed = (
        spread(pairs, cell(none, none, F.col("terms")))
        .unionAll(spread(both, cell(na, nb, times), cell(na, none, -times), cell(none, nb, -times), cell(none, none, times)))
        .unionAll(spread(pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), cell(n, none, times), cell(none, none, -times)))
        .unionAll(spread(pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), cell(none, n, times), cell(none, none, -times)))
    )
    return signed.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("times").alias("times"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: each other source of the language by falling divergence. Part ``term``: up to ``top``
    words that are more frequent in the source than in the language. Ties go by item in UTF-8 order.

    ``docs`` needs text, lang and source, where null counts as empty; other columns don't matter. A
    repeated row counts as often as it stands there. A source without words has divergences all the
    same; a language without kept words has divergences of 0 and no words. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    groups, terms = groups_and_terms(docs, scratch, least_docs)
    size = lambda name: groups.select("lang", F.col("source").alias(name), F.col("total").alias(f"t{name}"), *([F.col("terms")] if name == "a" else []))
    joint = histograms(groups, terms, scratch).filter("times > 0 OR (na = 0 AND nb = 0)").join(size("a"), ["lang", "a"]).join(size("b"), ["lang", "b"])
    apart = F.abs(_part(F.col("na"), F.col("ta"), F.col("terms")) - _part(F.col("nb"), F.col("tb"), F.col("terms")))
    sums = joint.groupBy("lang", "a", "b").agg(F.sum(F.coalesce(apart, F.lit(0)) * F.col("times")).cast("long").alias("value"))
    both_ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both_ways.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p, q = _part(F.col("n"), F.col("total"), F.col("terms")), _part(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = terms.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).cast("long").alias("value")).filter("value > 0")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked(pairs).select(names).unionAll(ranked(more).filter(F.col("rank") <= top).select(names))
