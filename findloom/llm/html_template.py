"""Main text of web pages by equivalence-class template deduction.

Tokens. A page is read as elements, each told by its place in the tree with its class and id, and
blocks of text, each told by its place and its words, those of menus and the like too. The occurrence vector of a token is how often
it occurs on each page of a host. Tokens with the same vector form an equivalence class; the vector
is never stored, but as a sum of page hashes weighted with the counts, which pre-aggregates on the
map side, so a host with a third of all pages is spread over all tasks.

Classes. Those on nearly all pages, once on each, of more than one token, make up the template. A
second pass tests them on every page: a token stays if it keeps its place in the order of its class,
and if it lies on nearly all pages in the same slot, that is after the same element of the template.
Valid classes nest this way: text in slots between elements, elements in the slots of others.

Slots. Text tokens of the template are boilerplate and are taken out; what is left differs from page
to page and is what the slots hold. The main slot is the innermost element of the template that holds
nearly all of that text. Where the template's text outweighs what differs, the host's pages are
copies of one another and there is no template.

Names break ties. Menus, headers, footers, sidebars, notices, adverts, forms and comments that are the
same all over a host are text tokens of its template. What of them differs from page to page lies in
slots as the article does, and is told by tag and by class, id and role if these say nothing else. A name
that also says something else (share-price, share-links) only raises a doubt, which a text of mostly links
settles. In a page's own article the name of a paragraph, a heading or a part of a line says how it looks,
and only that of an advert takes it out. Scripts, styles and markup are never text. A page's own article
or main element is taken before the main slot; on a host with too few pages for classes, and without such
an element, the whole body. Nothing else is dropped.

A tag is read once, from left to right, attribute by attribute: names are matched whole and values are
opaque, so neither a title nor an address hides a text. Where a quote is never closed, tags end at their
first ``>`` from there on.

So a page's text is what lies in the main slot of its host's template, or in its own article, without the
template's text and without what names set aside there; ``n_template`` and ``n_named`` count both.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findloom.llm.scratch import Scratch

#: A host needs this many pages for classes, a template token must be on this share of them, and a class has so many tokens.
LEAST_PAGES, SUPPORT, LEAST_TOKENS = 4, 0.9, 2
#: The main slot is the innermost template element with at least this share of the text that differs.
HOLDS = 0.9
#: Share of link text from which a doubtful element is a list of links.
LINKS = 0.6
#: Elements in one another that have a place of their own.
DEPTH = 100
#: Templates are broadcast up to this many tokens of all hosts; beyond, joined.
BROADCAST_TOKENS = 50_000

# Tags by their role in HTML.
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "video", "audio", "textarea", "select", "title", "noembed", "noframes", "xmp"})
ASIDE = frozenset({"nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "fieldset", "label", "input"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
BLOCK = frozenset({"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"})
NOT_ARTICLE = frozenset({"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"})
#: Of these, names that a page's own article may give to its own parts.
OWN_PARTS = frozenset({"header", "banner", "notice"})
#: Words that say nothing of what an element holds.
GENERIC = frozenset({"area", "bar", "block", "bottom", "box", "column", "container", "global", "group", "inner", "left", "list", "main", "outer", "page", "panel", "right", "section", "site", "slot", "top", "wrap", "wrapper"})
#: Elements that end an open paragraph, and items that end an open item of their kind.
_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_QUOTE = re.compile(r"""\s*=\s*["']""")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_READ = frozenset({"class", "id", "role", "hidden", "aria-hidden", "style"})
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


#: In an own article these are set aside only by the names of adverts.
_LINES = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dt", "dd", "td", "th", "figcaption", "caption"})
_ADVERTS = frozenset({"ad", "ads", "advert", "adverts", "advertisement", "promo", "promoted", "sponsor", "sponsored"})
_PARAGRAPH = frozenset({"p"})
_HOLD = frozenset({"table", "ul", "ol", "dl", "div", "article", "section", "body", "td"})


class Node:
    """An open element: its tag and path, whether it is set aside, in an article or a link, and where a doubtful one's blocks begin."""

    __slots__ = ("tag", "path", "skip", "own", "link", "doubt")

    def __init__(self, tag: str, path: str, skip: bool, own: bool, link: bool, doubt: int):
        self.tag, self.path, self.skip, self.own, self.link, self.doubt = tag, path, skip, own, link, doubt


def named_aside(tag: str, marks: list[tuple[str, str]], own: bool) -> tuple[bool, bool]:
    """Whether class, id or role set an element aside: surely, or perhaps."""
    perhaps = False
    names = _ADVERTS if own and (tag in _LINES or tag not in BLOCK) else NOT_ARTICLE
    for _, value in marks:
        for name in value.split():
            parts = [p.lower() for p in _PART.findall(name)]
            listed = [p for p in parts if p in names and not (own and p in OWN_PARTS)]
            if listed:
                if all(p in NOT_ARTICLE or p in GENERIC for p in parts):
                    return True, False
                perhaps = True
    return False, perhaps


def attributes(page: str, at: int, quotes: bool) -> tuple[dict[str, str], int, bool]:
    """The attributes that matter of the tag whose name ends at ``at``, where the tag ends, and if it ends with a slash.

    The end is -1 where a quote is never closed. Without ``quotes`` the tag ends at the first ``>``.
    """
    size = len(page)
    if at < size and page[at] == ">":
        return {}, at + 1, False
    found: dict[str, str] = {}
    stop = size
    if not quotes:
        stop = page.find(">", at)
        stop = size if stop < 0 else stop
    while True:
        m = _ATTR.match(page, at, stop)
        if not m:
            break
        at = m.end()
        if m.lastindex == 1 and _QUOTE.match(page, at, stop):
            if quotes:
                return found, -1, False
            at = stop
        name = m[1].lower()
        if name in _READ and name not in found:
            found[name] = m[2] or m[3] or m[4] or ""
    end = page.find(">", at)
    return found, size if end < 0 else end + 1, end > 0 and page[end - 1] == "/"


def parse(page: str) -> tuple[list[tuple[str, bool, bool, str]], list[tuple[str, int]]]:
    """A page in its order: blocks (element path, if in an article, if set aside, text) and elements (path, blocks before).

    Elements needn't be closed or nested: an end tag closes up to its element, if that is open, and a
    block element closes an open paragraph. Parts of a line have the place of their block, elements that
    are nested deeper than ``DEPTH`` that of the last one above. Time is linear in the page's length.
    """
    stack = [Node("", "", False, False, False, -1)]
    open_tags: Counter = Counter()
    blocks: list = []
    length, links = [0], [0]  # of all blocks so far
    lists: list[tuple[int, int]] = []  # blocks of doubtful elements that are lists of links
    elements: list[tuple[str, int]] = []
    words: list[str] = []
    linked = 0
    at, size, quotes = 0, len(page), True

    def flush() -> None:
        nonlocal linked
        top = stack[-1]
        if words:
            raw = "".join(words)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((top.path, top.own, top.skip, text))
                length.append(length[-1] + len(text))
                links.append(links[-1] + linked)
        words.clear()
        linked = 0

    def close(i: int) -> None:
        if any(x.tag in BLOCK or x.skip != stack[i - 1].skip or x.doubt >= 0 for x in stack[i:]):
            flush()
        for x in reversed(stack[i:]):
            open_tags[x.tag] -= 1
            if x.doubt >= 0 and links[-1] - links[x.doubt] >= LINKS * (length[-1] - length[x.doubt]):
                lists.append((x.doubt, len(blocks)))
        del stack[i:]

    def put(text: str) -> None:
        nonlocal linked
        words.append(text)
        if stack[-1].link:
            linked += len(text)

    while at < size:
        m = _OPEN.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        found, end, slash = attributes(page, at, quotes)
        if end < 0:
            quotes = False
            found, end, slash = attributes(page, at, quotes)
        at = end
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag in RAW:
            words.append(" ")
            if not slash:
                end = _CLOSE[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                words.append(" ")
            continue
        block = tag in BLOCK
        ends = _ITEMS.get(tag) or (_PARAGRAPH if block else None)
        if ends and any(open_tags[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    close(i)
                    break
                if stack[i].tag in _HOLD:
                    break
        top = stack[-1]
        marks = [(k, found[k]) for k in ("class", "id", "role") if found.get(k)]
        skip, doubt = top.skip or tag in ASIDE or (tag == "header" and not top.own), False
        if marks and not skip and tag not in ("html", "body", "article", "main"):
            skip, doubt = named_aside(tag, marks, top.own)
        if found and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(found.get("style", ""))):
            skip = True
        if block or skip != top.skip or doubt:
            flush()
        name = tag + "".join(f"[{k}={v}]" for k, v in sorted(marks) if not any(ch.isdigit() for ch in v)).replace("/", "|")
        own = top.own or tag in ("article", "main") or ("role", "main") in marks
        path = f"{top.path}/{name}" if block and len(stack) <= DEPTH else top.path
        stack.append(Node(tag, path, skip, own, top.link or tag == "a", len(blocks) if doubt else -1))
        open_tags[tag] += 1
        if block:
            elements.append((stack[-1].path, len(blocks)))
    flush()
    close(1)
    if lists:
        edges = Counter(a for a, b in lists if a < b)
        edges.subtract(Counter(b for a, b in lists if a < b))
        within = list(accumulate(edges[i] for i in range(len(blocks))))
        blocks = [(p, own, aside or n > 0, text) for (p, own, aside, text), n in zip(blocks, within, strict=True)]
    return blocks, elements


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def token_of(path: str, text: str | None = None) -> int:
    """The number of an element, or of a block of text in it."""
    return xxhash.xxh3_64_intdigest(path if text is None else f"{path}\0{text}", 1 + (text is None)) >> 1


_BLOCKS = "array<struct<path:string,own:boolean,aside:boolean,text:string,token:long>>"
_TOKENS = "array<struct<token:long,n:int,place:int,path:string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Each page with its host, blocks and tokens: how often each occurs, where first, and the path if an element."""

    def run(batches):
        for batch in batches:
            host, blocks, tokens = [], [], []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own, elements = parse(page or "")
                rows = [{"path": p, "own": o, "aside": a, "text": t, "token": token_of(p, t)} for p, o, a, t in own]
                order = sorted([(at, 0, i, token_of(p), p) for i, (p, at) in enumerate(elements)] + [(i, 1, 0, b["token"], None) for i, b in enumerate(rows)], key=lambda x: x[:3])
                count = Counter(x[3] for x in order)
                first = {x[3]: (i, x[4]) for i, x in reversed(list(enumerate(order)))}
                host.append(host_of(url))
                blocks.append(rows)
                tokens.append([{"token": k, "n": count[k], "place": i, "path": p} for k, (i, p) in sorted(first.items(), key=lambda x: x[1][0])])
            block = pa.struct([("path", pa.string()), ("own", pa.bool_()), ("aside", pa.bool_()), ("text", pa.string()), ("token", pa.int64())])
            token = pa.struct([("token", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("path", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(host, pa.string()), pa.array(blocks, pa.list_(block)), pa.array(tokens, pa.list_(token))], names=["page_id", "url", "host", "blocks", "tokens"])

    return pages.mapInArrow(run, f"page_id long, url string, host string, blocks {_BLOCKS}, tokens {_TOKENS}")


def classes(table: DataFrame) -> DataFrame:
    """(host, total, tokens): the equivalence classes on nearly all pages of each host, once on each, of several tokens.

    ``tokens`` has token, path (null for text) and class of each, in the mean order of their places.
    """
    page = F.pmod(F.xxhash64("page_id", "url"), F.lit((1 << 31) - 1))
    tokens = table.select("host", page.alias("page"), F.explode("tokens").alias("t")).select("host", "page", "t.*")
    stats = tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum(F.pmod(F.col("n") * F.col("page"), F.lit((1 << 31) - 1))).alias("vector"), F.avg("place").alias("place"), F.max("path").alias("path"))
    total = table.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("total")).filter(f"total >= {LEAST_PAGES}")
    frequent = stats.join(total, F.col("host") == F.col("h")).filter(f"pages >= {SUPPORT} * total AND once = pages")
    token = F.struct("place", "token", "path")
    grouped = frequent.groupBy("host", "total", "pages", "vector").agg(F.collect_list(token).alias("all")).filter(F.size("all") >= LEAST_TOKENS)
    each = grouped.select("host", "total", F.xxhash64("pages", "vector").alias("class"), F.explode("all").alias("t")).select("host", "total", F.struct("t.place", "t.token", "t.path", "class").alias("t"))
    return each.groupBy("host", "total").agg(F.array_sort(F.collect_list("t")).alias("tokens"))


def in_order(places: list[int]) -> list[bool]:
    """Which of the places belong to a longest rising sequence."""
    least: list[int] = []  # the least last place of a rising sequence of each length, and whose it is
    ends: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(least, p)
        before[i] = ends[k - 1] if k else -1
        least[k : k + 1], ends[k : k + 1] = [p], [i]
    keep, i = [False] * len(places), ends[-1] if ends else -1
    while i >= 0:
        keep[i] = True
        i = before[i]
    return keep


def tested(table: DataFrame, found: DataFrame) -> DataFrame:
    """(host, token, path, slot, ordered, chars, all): every class token of every page, and the text that differs in it.

    ``slot`` is the element of the template before it; ``chars`` of an element is the page's text in it
    that is no token of a class, of a text its own length; ``all`` is the page's text that differs. What
    names set aside has no length: it neither makes a main slot nor outweighs one.
    """

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for host, blocks, tokens, known in zip(*(batch.column(c).to_pylist() for c in ("host", "blocks", "tokens", "known")), strict=True):
                place = {t["token"]: t["place"] for t in tokens}
                own = [t for t in known if t["token"] in place]
                by_class: dict = {}
                for t in own:
                    by_class.setdefault(t["class"], []).append(t["token"])
                ordered = {x: ok for xs in by_class.values() for x, ok in zip(xs, in_order([place[x] for x in xs]), strict=True)}
                texts = {t["token"] for t in own if t["path"] is None}
                length = {b["token"]: 0 if b["aside"] else len(b["text"]) for b in blocks}
                differs = [(b["path"], len(b["text"])) for b in blocks if b["token"] not in texts and not b["aside"]]
                total, last = sum(n for _, n in differs), 0
                for t in sorted(own, key=lambda t: place[t["token"]]):
                    inside = length[t["token"]] if t["path"] is None else sum(n for p, n in differs if p == t["path"] or p.startswith(t["path"] + "/"))
                    for to, x in zip(out, (host, t["token"], t["path"], last, ordered[t["token"]], inside, total), strict=True):
                        to.append(x)
                    if t["path"] is not None and ordered[t["token"]]:
                        last = t["token"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "token", "path", "slot", "ordered", "chars", "all"])

    joined = table.join(found.select(F.col("host").alias("h"), F.col("tokens").alias("known")), F.col("host") == F.col("h")).select("host", "blocks", "tokens", "known")
    return joined.mapInArrow(run, "host string, token long, path string, slot long, ordered boolean, chars long, all long")


def templates(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, gone, slot): the text tokens of each host's template, and the path of its main slot."""
    found = scratch.keep(classes(table), "classes")
    each = tested(table, F.broadcast(found) if _few(found, "tokens") else found)
    slots = each.groupBy("host", "token", "path", "slot").agg(F.sum(F.col("ordered").cast("long")).alias("good"), F.sum("chars").alias("chars"), F.sum("all").alias("all"))
    sums = slots.groupBy("host", "token", "path").agg(F.max("good").alias("good"), F.sum("chars").alias("chars"), F.sum("all").alias("all"))
    valid = sums.join(found.select(F.col("host").alias("h"), "total"), F.col("host") == F.col("h")).filter(f"good >= {SUPPORT} * total")
    text = F.col("path").isNull()
    inner = F.when(~text & (F.col("chars") >= HOLDS * F.col("all")), F.struct(F.size(F.split("path", "/")).alias("depth"), "path"))
    by_host = valid.groupBy("host").agg(F.collect_set(F.when(text, F.col("token"))).alias("gone"), F.sum(F.when(text, F.col("chars")).otherwise(0)).alias("fixed"), F.max("all").alias("all"), F.max(inner).alias("inner"))
    return by_host.filter("fixed <= all").select("host", "gone", F.col("inner.path").alias("slot"))


def _few(hosts: DataFrame, tokens: str) -> bool:
    """Whether the templates of all hosts are small enough to be broadcast."""
    return (hosts.agg(F.sum(F.size(tokens) + 1).alias("n")).first().n or 0) <= BROADCAST_TOKENS


def extract(page: str | None, slot: str | None = None, gone: frozenset = frozenset()) -> str:
    """The text of one page, given its host's main slot and text tokens."""
    blocks = [b for b in parse(page or "")[0] if token_of(b[0], b[3]) not in gone and not b[2]]
    within = lambda p: bool(slot) and (p == slot or p.startswith(f"{slot}/"))
    own = [(within(p), t) for p, o, _, t in blocks if o]
    inside = [t for p, o, _, t in blocks if within(p) and not o]
    if own and inside and not any(x for x, _ in own):
        return "\n".join(t for p, o, _, t in blocks if o or within(p))
    return "\n".join([t for _, t in own] or inside or [t for *_, t in blocks])


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_template and n_named.

    The last two say how many blocks the host's template took out, and how many more went by a name.

    Null and empty pages have the empty text; pages without a host in their address, or with a null
    address, are one host. Repeated rows get equal answers; an empty table gives none.
    """
    scratch = Scratch(pages.sparkSession, "html")
    table = scratch.keep(parsed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), "parsed")
    known = scratch.keep(templates(table, scratch), "templates").withColumnRenamed("host", "h")
    joined = table.select("page_id", "url", "host", "blocks").join(F.broadcast(known) if _few(known, "gone") else known, F.col("host") == F.col("h"), "left")
    inside = "coalesce(b.path = slot OR startswith(b.path, concat(slot, '/')), false)"
    # what the template says of a block; where a page has no text in the main slot and no article, it says nothing
    fixed = "coalesce(array_contains(gone, b.token), false)"
    outside = f"(slot IS NOT NULL AND NOT b.own AND NOT {inside})"
    of_page = joined.withColumn("slot", F.expr(f"CASE WHEN exists(blocks, b -> NOT {fixed} AND NOT b.aside AND (b.own OR {inside})) THEN slot END"))
    count = lambda test: F.expr(f"size(filter(blocks, b -> {test}))").cast("long")
    counted = of_page.withColumns({"n_template": count(f"{fixed} OR {outside}"), "n_named": count(f"b.aside AND NOT ({fixed} OR {outside})")})
    left = counted.withColumn("blocks", F.expr(f"filter(blocks, b -> NOT b.aside AND NOT {fixed} AND NOT {outside})"))
    texts = lambda keep: F.expr(f"transform({keep}, b -> b.text)")
    own = texts("filter(blocks, b -> b.own)")
    # articles beside a main slot with text of its own, such as teasers, don't replace it
    apart = F.expr(f"exists(blocks, b -> NOT b.own) AND NOT exists(blocks, b -> b.own AND {inside}) AND slot IS NOT NULL")
    chosen = F.when((F.size(own) > 0) & ~apart, own).otherwise(texts("blocks"))
    out = left.select("page_id", "url", F.array_join(chosen, "\n").alias("text"), "n_template", "n_named")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template", "n_named")
