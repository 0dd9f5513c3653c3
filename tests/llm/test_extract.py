"""Extraction against the known layout of the page table, and against pages of other layouts."""

import html
import re

import pytest

from riskloom.llm import extract


def by_pattern(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in parts) if t)


def test_page_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract.extract(pages).collect()}
    want = {r.page_id: by_pattern(r.html) for r in pages.collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


ARTICLE = "<p>The first paragraph, of some length, says what is to be said.</p><p>A second one, as long as the first, goes on with it.</p>"
TEXT = "The first paragraph, of some length, says what is to be said.\nA second one, as long as the first, goes on with it."


@pytest.mark.parametrize("page, text", [
    ("", ""), (None, ""), ("<p>hello", "hello"), ("a < b &amp; c", "a < b & c"), ("<div>" * 5000 + "x", "x"), ("<script>x</script><!-- y", ""),
    (f"<body><div id=sidebar><p>Menu, more, things</p></div><div class='post-content'>{ARTICLE}<div class=comments><p>nice, very, nice</p></div></div><div class=footer>f</div></body>", TEXT),
    (f"<header><h1>Site</h1></header><main>{ARTICLE}<aside>s</aside><form><p>f</p><input></form></main><footer>x</footer>", TEXT),
    (f"<table><tr><td><a href=x>one</a> <a href=y>two</a><td>{ARTICLE}</table>", TEXT),
    (f"<form id=aspnet><div class=cookie-notice>We use cookies, you know.</div><article>{ARTICLE}</article></form>", TEXT),
    (f"<ul><li><a href=1>a</a><li><a href=2>b</a></ul><div>{ARTICLE}</div><div role=dialog>Subscribe now, please, do!</div>", TEXT),
    ("<article><p>a&nbsp;&lt;b&gt;\n  c<br>d<i>e</i></article>", "a <b> c de"),
    ("<article>one<p>two<ul><li>three<li>four</ul>five</article>", "one\ntwo\nthree\nfour\nfive"),
    ("<article><b>x<p>y</b>z</article>", "x\nyz"),
    ("<article><p>t<a title='a>b'>u</a><style>p{}</style><SCRIPT>'</p>'</SCRIPT>v</article>", "tuv"),
])
def test_layouts(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize("page", [
    *(f"<body><div class='{c}'><article>{ARTICLE}</article></div></body>" for c in ("content has-sidebar", "page no-comments", "with-menu", "sidebar layout", "post share-enabled")),
    *(f"<body><div class='{c}'>{ARTICLE}</div><div class=footer>f</div></body>" for c in ("content has-sidebar", "page no-comments", "page with-menu", "post share-enabled", "content sidebar-left", "content-sidebar-wrap")),
    f"<article><p class=notice>We moved.{ARTICLE}</article>",
    f"<main><ul><li class=share>Share<li class=share>Send</ul>{ARTICLE}</main>",
    f"<div class=content><div class=sidebar><p>Menu</div>{ARTICLE}</div>",
    f"<html><head><title>t</title><body>{ARTICLE}</body></html>",
    # what the names do speak against stays out
    f"<article>{ARTICLE}</article><div class=comments><article>{ARTICLE[:60]}</article></div>",
    f"<div class=sidebar-layout><article>{ARTICLE}<div class=comments><article>nice, very, nice</article></div></article></div>",
    f"<article>{ARTICLE}<div class=post-comments><p>nice, very, nice</p></div><ul class=main-menu><li>m</ul></article>",
    f"<div class=related><article>A teaser.</article></div><div class='sidebar layout'><article>{ARTICLE}</article></div>",
    f"<object><p>no player</object><article>{ARTICLE}</article>",
])
def test_names_of_layouts(page):
    assert extract.main_text(page) == TEXT


@pytest.mark.parametrize("part, text", [
    ("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id=discussion class=comments>Discussion</h2>", "Discussion"),
    ("<p id='search-results-2019'>We searched in 2019.</p>", "We searched in 2019."), ("<p class='social-science'>Of social science.</p>", "Of social science."),
    ("<p class='note notice-board'>On the board.</p>", "On the board."), ("<section id=discussion><h2>Discussion</h2><p>It was so.</p></section>", "Discussion\nIt was so."),
    ("<div id='related-work'><h2>Related <i>work</i></h2></div>", ""), ("<div id='related-work'>Related work is this.</div>", "Related work is this."),
    ("<ul><li class='social-science'>one</ul>", "one"), ("<p class=share>Share this</p>", ""), ("<p class='social-share'>Share this</p>", ""),
    ("<div id=comments><p>nice, very, nice</p></div>", ""), ("<article class=comment><p>nice, very, nice</p></article>", ""),
    ("<section class=comments><h2>Comments</h2><article class=comment>nice</article></section>", ""),
])
def test_names_inside_an_article(part, text):
    for outer in ("article", "main"):
        assert extract.main_text(f"<body><{outer}>{ARTICLE}{part}</{outer}></body>") == TEXT + ("\n" + text) * bool(text)


@pytest.mark.parametrize("page, text", [
    (f"<article class=advert>{ARTICLE}</article><article>{ARTICLE}</article>", TEXT), (f"<article class=advert>{ARTICLE * 3}</article><article><p>Short, but real.</p></article>", "Short, but real."),
    (f"<article class='advert promo'>{ARTICLE}</article>", TEXT), (f"<main><article>{ARTICLE}</article><div><p>More of it.</p></div><div>The end.</div></main>", TEXT + "\nMore of it.\nThe end."),
    (f"<main><h1>Title</h1><article>{ARTICLE}</article><div><a href=1>one</a> <a href=2>two</a></div></main>", "Title\n" + TEXT),
    (f"<main><section><h2>Head</h2><article>{ARTICLE}</article></section><article><p>Another article.</p></article></main>", "Head\n" + TEXT),
    (f"<main><section>{ARTICLE}</section><section><p>Part two.</p></section></main>", TEXT + "\nPart two."),
])
def test_articles_and_parts_of_main(page, text):
    assert extract.main_text(f"<body>{page}</body>") == text


def test_heading_in_a_banner():
    assert extract.main_text(f"<article><div class=banner><h1>Title</h1></div>{ARTICLE}</article>") == "Title\n" + TEXT


def test_nested_names_take_linear_time():
    assert extract.main_text("<div class=sidebar>" * 5000 + f"<article>{ARTICLE}</article>") == TEXT


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (1, "u", "<p>a</p>", 5), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    got = extract.extract(df).select("page_id", "text", "n_chars").collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 'a', 1)", "(1, 'a', 1)", "(None, '', 0)"]
    assert extract.extract(df.limit(0)).count() == 0
    long_page = "<article>" + "<p>" + "word, " * 200_000 + "</p></article>"
    assert extract.main_text(long_page) == ("word, " * 200_000).strip()
