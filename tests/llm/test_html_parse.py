from __future__ import annotations

import random
import time

import pytest

from findloom.llm import html_template as h


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<p title="the hidden treasure">Body</p>', "Body"),
        ('<p data-id="comment">Body</p>', "Body"),
        ('<p>Read <a href="/v?id=comments">the full story</a> now</p>', "Read the full story now"),
        ("<p data-x=it's>Hello it's me</p>", "Hello it's me"),
        ('<p class="menu">Dinner menu</p>', "Dinner menu"),
        ('<p title="a > b" class=x>c</p>', "c"),
        ("<p hidden>no</p><p aria-hidden='TRUE'>no</p><p style=\"color:red; display : none\">no</p><p data-hidden=1 alt='display:none'>yes</p>", "yes"),
        ('<p class="ad">buy</p><h2 class="comment-title">On comments</h2><p>1 < 2 &amp; <3</p>', "On comments\n1 < 2 & <3"),
        ("<p =x class>a</p><p / / id = 'q' >b</p><br/><P>c", "a\nb\nc"),
        ("<!-- x > y --><!doctype x><?php 1 ?>t", "t"),
    ],
)
def test_attributes_hide_no_text(inside, text):
    assert h.extract(f"<nav>menu</nav><article>{inside}</article>") == text


def test_a_quote_that_is_never_closed():
    assert h.extract('<article><p title="x>one</p><p>two</p></article>') == "one\ntwo"


@pytest.mark.parametrize("part", ['<a title="', "<a title='x\"", "<p ", "<a b=c ", "<!-- ", "</", "<p class='", "<", "<a =\"'>", "&amp", "<li>", "<b></i>", "<a  \t ", "<a x\n=\n", "<div>", "<div class=share-x>t", "<span><h1>", "<p><b>x", "<li><ul>", "<b><table>", "<i>x</b>"])
def test_long_hostile_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    h.parse(page[: len(page) // 8])
    h.parse("<article>" + page[: len(page) // 8])
    assert time.process_time() - began < 2.5


def test_random_pages_never_fail():
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<a href=x>", "</a>", "<div class='nav'>", '<div id="share-links">', "</div>", "text ", "&lt;", "<", ">", '"', "'", "=", "/", "<article>", "</article>", "<ul><li>", "<script>", "</script>", "<!--", "-->", "<br>", "<footer>", "</footer>", " hidden"]
    for _ in range(3000):
        blocks, elements = h.parse("".join(rng.choices(parts, k=rng.randrange(30))))
        assert all(t and t == " ".join(t.split()) for *_, t in blocks) and all(0 <= n <= len(blocks) for _, n in elements)


def test_the_template_decides_before_names(spark):
    """Generated hosts: menus, adverts and footers without telling names, equal on every page; the text is what was put in."""
    rng = random.Random(9)
    rows, want = [], {}
    for host in range(3):
        words = lambda n: " ".join(rng.choices(["river", "stone", "light", "seven", "cloud", "paper"], k=n)) + f" {rng.random()}"
        bar, tail = (f"{x} of host {host}" for x in ("Links", "Rights"))
        for i in range(9):
            own = [words(12) for _ in range(rng.randint(2, 5))]
            body = f"<div class=x1><p>{bar}</p></div><div class=x2><div class=x3>{''.join(f'<p>{t}</p>' for t in own)}</div><p>Share this page</p></div><div class=x4>{tail}</div>"
            rows.append((100 * host + i, f"https://h{host}.org/{i}", f"<html><body>{body}</body></html>"))
            want[100 * host + i] = "\n".join(own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in h.main_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_template"] == 3 and r["n_named"] == 0 for r in got.values())
    alone = {r["page_id"]: r["text"] for r in h.main_text(df.filter("page_id % 100 < 3")).collect()}
    assert all(alone[k] != want[k] and want[k] in alone[k] for k in alone)


def test_supplied_pages_lose_their_menus_by_the_template(spark, monkeypatch):
    """Where a host has a template, names take out nothing; without classes names alone are left to tell."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    got = h.main_text(pages)
    hosts = pages.groupBy(h.F.regexp_extract("url", "://([^/]*)", 1).alias("host")).count().filter(f"count >= {h.LEAST_PAGES}")
    many = pages.join(hosts, h.F.regexp_extract("url", "://([^/]*)", 1) == h.F.col("host"), "left_semi").select("page_id")
    sums = got.join(many, "page_id", "left_semi").agg({"n_template": "sum", "n_named": "sum", "*": "count"}).first()
    assert sums["sum(n_template)"] > 5 * sums["count(1)"] > 0 and sums["sum(n_named)"] == 0
    monkeypatch.setattr(h, "LEAST_PAGES", 10**6)
    bare = h.main_text(pages).agg({"n_template": "sum", "n_named": "sum"}).first()
    assert bare["sum(n_template)"] == 0 < bare["sum(n_named)"]


def test_teasers_do_not_replace_the_main_slot(spark):
    page = "<div class=m><p>Story {0} {1}</p><p>More {1} of {0}</p></div><div class=r><article><p>Teaser {1}</p></article></div>"
    rows = [(i, "https://h.org/", page.format("word " * 40, i)) for i in range(8)]
    got = h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).filter("page_id = 3").first()["text"]
    assert got.startswith("Story word") and got.endswith("Teaser 3")
