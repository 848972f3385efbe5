"""Filter of page addresses by rules and, where no rule fits, by a ratio of character language models.

Two variable-order Markov models of characters are counted, one on addresses that a rule allows, one
on those that a rule blocks; an address that no rule judges goes by the difference of their log
likelihoods, divided by its length.

Symbols. An address is its characters (A-Z lower-cased; what is outside ``ALPHABET`` is one symbol)
and an end. A position with the ``ORDER`` symbols before it packs into one long, six bits a symbol, so
each distinct address gives one row a position and the shorter contexts are summed from those counts.

Variable order. A context is kept if it holds at least ``SHARE`` of all counted positions. The
contexts of one order share the positions among them, so an order keeps at most 1 / ``SHARE`` of them
whatever the corpus: this is the proven bound of what is broadcast. Each kept context interpolates its
counts with the next shorter one (Witten-Bell), down to add-one counts of single symbols. A position
takes the longest kept context. Log ratios are whole numbers of 2^-16 bits, so that sums do not depend
on the order of rows.

Calibration. A quarter of the judged addresses (by their md5) trains nothing; on it the threshold is set
that makes the sum of both error rates least, half way between the two scores that it parts (of equally
good ones the nearest to 0, then the lower).

All of it is built-in functions. Python only puts expressions together and learns three counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findloom.llm.scratch import Scratch

# The characters an address may hold, after lower-casing.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
#: Symbols: 0 before the start, 1 to 59 in ``ALPHABET``, 60 any other, 61 the end.
OTHER, END, BITS = 60, 61, 6
#: Symbols of the longest context, the least share of positions of a context, and its least count.
ORDER, SHARE, LEAST = 5, 1 / 10_000, 3
#: Addresses whose md5 begins with a lesser digit are held out for the threshold.
HELD_OUT = "4"
#: Log ratios are in 1 / UNIT bits, means in 1 / BINS bits.
UNIT, BINS = 65_536, 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: on to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.position(F.lit("://"), url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    before_query = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(before_query, "/", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(F.substring(before_query, F.length(host) + 1, F.length(before_query)), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict (both null if none fits).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of
    equally long ones the first. Rules are a short list: each is one condition of every row.
    """
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = None
    for word, at, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(prefix)
        rule = F.when(fits, at + prefix) if rule is None else rule.when(fits, at + prefix)
        verdict = F.when(fits, word) if verdict is None else verdict.when(fits, word)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})


def positions(url: Column) -> Column:
    """One long for each symbol of the address and its end: the symbol in the lowest bits, the context above."""
    characters = F.filter(F.split(lower_ascii(F.coalesce(url, F.lit(""))), ""), lambda c: c != "")
    place = lambda c: F.position(c, F.lit(ALPHABET))
    symbols = F.transform(characters, lambda c: F.when(place(c) > 0, place(c)).otherwise(F.lit(OTHER)).cast("long"))
    padded = F.concat(F.array_repeat(F.lit(0).cast("long"), ORDER), symbols, F.array(F.lit(END).cast("long")))

    def packed(all_: Column, i: Column) -> Column:
        out = F.get(all_, i + ORDER)
        for back in range(1, ORDER + 1):
            out = out.bitwiseOR(F.shiftleft(F.get(all_, i + ORDER - back), BITS * back))
        return out

    # as the one element of an array the symbols are made once, not again for each position
    return F.get(F.transform(F.array(padded), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - (ORDER + 1)), lambda i: packed(p, i))), F.lit(0))


def _context(order: int, packed: str = "at") -> Column:
    return F.shiftright(F.col(packed), BITS).bitwiseAND(F.lit((1 << (BITS * order)) - 1).cast("long"))


def _symbol(packed: str = "at") -> Column:
    return F.col(packed).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")


def _contexts(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, context, allow, block, and their sums and numbers of kinds): counts of each symbol after every kept context, as arrays by symbol."""
    one = lambda word: F.sum((F.col("ruled") == word).cast("long")).alias(word)
    seen = scratch.keep(labelled.select("ruled", F.explode(positions(F.col("url"))).alias("at")).groupBy("at").agg(one("allow"), one("block")), "positions")
    total = seen.agg(F.sum(F.col("allow") + F.col("block"))).first()[0] or 0
    by_order = F.array(*[F.struct(F.lit(k).alias("k"), _context(k).alias("context")) for k in range(ORDER + 1)])
    each = seen.select("allow", "block", _symbol().alias("s"), F.explode(by_order).alias("o")).groupBy("o.k", "o.context", "s").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    cells = F.map_from_entries(F.collect_list(F.struct("s", F.struct("allow", "block").alias("n")))).alias("cells")
    sums = [x for w in ("allow", "block") for x in (F.sum(w).alias(f"{w}_n"), F.sum((F.col(w) > 0).cast("long")).alias(f"{w}_kinds"))]
    grouped = each.groupBy("k", "context").agg(cells, *sums).withColumn("n", F.col("allow_n") + F.col("block_n")).filter((F.col("k") == 0) | (F.col("n") >= max(LEAST, SHARE * total)))
    dense = lambda word: F.expr(f"transform(sequence(0, {END}), s -> coalesce(try_element_at(cells, s).{word}, 0L))").alias(word)
    return scratch.keep(grouped.select("k", "context", dense("allow"), dense("block"), *[f"{w}_{x}" for w in ("allow", "block") for x in ("n", "kinds")]), "contexts")


def _smoothed(word: str) -> str:
    """SQL: the probabilities of all symbols in a context, from the counts along the chain of its shorter ones."""
    size, kinds = f"x.{word}_n", f"x.{word}_kinds"
    return f"""aggregate(chain, transform(sequence(0, {END}), s -> 0D), (p, x) -> CASE
        WHEN x.j = 0 THEN transform(x.{word}, n -> (n + 1) / CAST({size} + {END} AS DOUBLE))
        WHEN {size} = 0 THEN p
        ELSE zip_with(x.{word}, p, (n, q) -> (n + {kinds} * q) / CAST({size} + {kinds} AS DOUBLE)) END)"""


def train(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, context, ratio): for each kept context the log ratio of every symbol, allowed over blocked.

    ``labelled`` has url and ruled, each address once. At most ORDER / SHARE + 1 rows.
    """
    known = _contexts(labelled, scratch)
    shorter = F.explode(F.expr(f"transform(sequence(0, k), j -> struct(j, context & (shiftleft(1L, {BITS} * j) - 1) AS c))"))
    links = known.select("k", "context", shorter.alias("x")).select("k", "context", "x.j", "x.c")
    counts = [c for c in known.columns if c not in ("k", "context")]
    parts = known.select(F.col("k").alias("j"), F.col("context").alias("c"), *counts)
    chains = links.join(parts, ["j", "c"]).groupBy("k", "context").agg(F.array_sort(F.collect_list(F.struct("j", *counts))).alias("chain"))
    probable = chains.select("k", "context", F.expr(_smoothed("allow")).alias("p"), F.expr(_smoothed("block")).alias("q"))
    ratio = F.expr(f"zip_with(p, q, (a, b) -> CAST(floor((log2(a) - log2(b)) * {UNIT} + 0.5D) AS INT))")
    return scratch.keep(probable.select("k", "context", ratio.alias("ratio")), "model")


def score(urls: DataFrame, model: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """``keys`` and ``mean``: the log ratio of each row's url a symbol, in 1 / BINS bits; null where ``only`` is false.

    ``keys`` tell the rows apart. Every order's contexts are looked up in a broadcast table of at most
    1 / SHARE rows; sums are made where the row is, so one row an address is shuffled.
    """
    at = positions(F.col("url"))
    out = urls.select(*keys, F.explode_outer(at if only is None else F.when(only, at)).alias("at"))
    for k in range(ORDER + 1):
        order = model.filter(F.col("k") == k).select(F.col("context").alias(f"c{k}"), F.col("ratio").alias(f"r{k}"))
        out = out.join(F.broadcast(order), _context(k) == F.col(f"c{k}"), "left")
    each = F.coalesce(*[F.get(f"r{k}", _symbol()) for k in range(ORDER, -1, -1)])
    sums = out.select(*keys, each.cast("long").alias("ratio")).groupBy(*keys).agg(F.sum("ratio").alias("total"), F.count("ratio").alias("n"))
    mean = F.floor(F.col("total").cast("double") / (F.col("n") * (UNIT // BINS)).cast("double"))
    return sums.select(*keys, F.when(F.col("n") > 0, mean).alias("mean"))


def threshold(held: DataFrame) -> int | None:
    """The mean from which an address is allowed; ``held`` has mean and ruled. None without both kinds."""
    one = lambda word: F.sum((F.col("ruled") == word).cast("long")).alias(word)
    bins = held.groupBy("mean").agg(one("allow"), one("block"))
    totals = bins.agg(F.sum("allow"), F.sum("block")).first()
    if not totals[0] or not totals[1]:
        return None
    below = "sum(allow) OVER (ORDER BY mean ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    above = "sum(block) OVER (ORDER BY mean DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    # a mean is within the log ratios' range, so the bins, and this window, are bounded
    errors = bins.select((F.coalesce(F.expr(below), F.lit(0)) * F.lit(totals[1]) + F.expr(above) * F.lit(totals[0])).alias("errors"), "mean", F.expr("lag(mean) OVER (ORDER BY mean)").alias("last"))
    between = errors.select("errors", F.expr("coalesce(last + (mean - last + 1) div 2, mean)").alias("least"))
    return between.agg(F.min(F.struct("errors", F.abs("least").alias("size"), "least"))).first()[0]["least"]


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, mean (null where a rule judges).

    Needs ``page_id`` and ``url``; other columns don't matter. Null addresses count as empty: their host
    and path are empty, no rule fits, and the models judge the end alone. Addresses without ``://`` are
    judged by their whole text. Repeated rows get equal answers and train once. Where the rules allow
    none of the addresses, or block none, no model can be trained and what no rule judges is allowed;
    the threshold is 0 where the held-out quarter lacks one of the two. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    all_ = ruled(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), rules)
    known = scratch.keep(all_.filter("ruled IS NOT NULL").select("url", "ruled").distinct(), "known")
    held = F.substring(F.md5("url"), 1, 1) < HELD_OUT
    kinds = known.filter(~held).agg(F.count(F.when(F.col("ruled") == "allow", 1)), F.count(F.when(F.col("ruled") == "block", 1))).first()
    names = ["page_id", "host", "path", "rule"]
    if not kinds[0] or not kinds[1]:
        return all_.select(*names, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("mean"))
    model = train(known.filter(~held), scratch)
    least = threshold(score(known.filter(held), model, ["url", "ruled"]))
    rows = all_.withColumn("row", F.monotonically_increasing_id())
    scored = score(rows, model, ["row", *names, "ruled"], F.col("ruled").isNull())
    verdict = F.coalesce("ruled", F.when(F.col("mean") >= (least or 0), "allow").otherwise("block"))
    return scored.select(*names, verdict.alias("verdict"), "mean")
