"""Pages with known articles: wrappers, forms, foreign elements, deep nesting and mixed templates."""

import random
import time

import pytest

pytest.importorskip("creditspark.llm")

from creditspark.llm import html_consensus
from creditspark.llm.html_consensus import Page

PARTS = ["Title", "Sentence of the story that goes on. " * 8, "More of it, told again.", "End."]
ARTICLE = "<h1>{}</h1><p>{}</p><p>{}</p><p>{}</p>".format(*PARTS)
WANT = [p.strip() for p in PARTS]
NAV, FOOT = "<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>", "<footer>All rights are reserved</footer>"


@pytest.mark.parametrize("page", [
    f'<div class="content with-sidebar"><article>{ARTICLE}</article></div>',
    f'<div class="no-sidebar">{ARTICLE}</div><div class=sidebar>Text at the side</div>',
    f'<main><div class="legal">{ARTICLE}</div></main>',
    f'<div class="page banner-top"><div class=text>{ARTICLE}</div></div>',
    f'<form id="aspnetForm"><article>{ARTICLE}</article><select><option>One</select><button>Go</button></form>',
    f'<form id="aspnetForm"><div class=text>{ARTICLE}</div><nav><a href=x>More</a></nav></form>',
    f'<article><div class="post-header"><h1>Title</h1></div>{ARTICLE[14:]}</article>',
    f'<div class=post><div class="post-header"><h1>Title</h1></div>{ARTICLE[14:]}</div>',
    f'<svg class="i"/><article>{ARTICLE}</article>',
    f'<svg class="i"><path d=1><article>{ARTICLE}</article>',
    f'<html><head><title>T</title><body><article>{ARTICLE}</article>',
    f'<nav><ul><li><a href=x>Home</a></ul><article>{ARTICLE}</article>',
    f'<article>{ARTICLE}</article><section class=comments>' + "<article>A comment of a reader, rather long. " * 5 + "</section>",
    f'<div class=text>{ARTICLE}</div><div class="sidebar"><p>' + "At the side. " * 10 + "</div>",
    f'<header class=site><b>Site</b></header><article>{ARTICLE}</article><aside>' + "Other text. " * 60 + "</aside>",
    f'<div class=text>{ARTICLE}</div><div class="ad"><p>' + "Buy. </p><p>" * 90 + "</div>",
])
def test_article_is_kept_whole(page):
    assert Page(f"<body>{NAV}{page}{FOOT}").article(None) == WANT


def test_inline_elements_join_words_and_keep_formulas():
    text = "<p>a<wbr>b <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> a<br>c"
    assert Page(text).article(None) == ["ab x=1 a c"]
    assert Page("<p>one<math/> two").article(None) == ["one two"]
    deep = Page("<a href=q><i><b><u><em><i><b><s>all of this is a link</a><p>text")
    assert [(t, links) for _, t, links in deep.blocks] == [("all of this is a link", 21), ("text", 0)]


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<blockquote>" * 100_000 + "x", "<b " * 100_000, "<b '" * 100_001, "<i>x" * 100_000, "<div class=legal>x" * 50_000,
                                    "<svg>" * 50_000, "<tr><td>x" * 50_000, "<" * 200_000, "<!" * 100_000, "&" * 200_000, "<a title='" + "y" * 500_000])
def test_odd_pages_take_linear_time(source):
    began = time.time()
    page = Page(source)
    page.article(page.vote())
    assert time.time() - began < 15


def _generated(rng):
    """A page and its article, from one of several templates with nested parts."""
    words = ["river", "stone", "winter", "market", "letter", "garden", "signal", "harbor", "engine", "paper"]

    def sentence(n):
        return " ".join(rng.choice(words) for _ in range(n)) + "."

    blocks = [sentence(4)] + [sentence(rng.randrange(12, 60)) for _ in range(rng.randrange(4, 12))]
    inner = f"<h1>{blocks[0]}</h1>"
    for i, b in enumerate(blocks[1:]):
        shown = b.replace("stone", "<b>stone</b>").replace("river", '<a href="/r">river</a>', 1)
        inner += rng.choice([f"<p>{shown}</p>", f"<p>{shown}", f"<section><p>{shown}</p></section>", f"<blockquote>{shown}</blockquote>", f"<ul><li>{shown}</ul>",
                             f"<table><tr><td>{shown}</table>", f"<p>{shown}</p><script>var x='{i}<p>';</script>", f"<!-- {i} --><p>{shown}</p>"])
    wrapped = rng.choice(["<article>{}</article>", '<main class="page with-sidebar"><article class="post hentry">{}</article></main>', '<div id="content" class="no-sidebar"><article>{}</article></div>',
                          '<form id="aspnetForm" method=post><input name=q><article>{}</article></form>', '<main><div class="legal">{}</div></main>']).format(inner)
    extra = ["<nav><ul><li><a href=a>Home</a><li><a href=b>About</a></ul></nav>", "<header><p>The site</p></header>", '<div class="ad"><p>' + sentence(8) + "</p></div>",
             '<div class="cookie-notice">We use cookies. <button>Fine</button></div>', '<svg class="logo"/>']
    after = ['<div class="sidebar"><ul><li><a href=c>Read on</a></ul></div>', '<section class="comments"><article>' + sentence(30) + "</article></section>", "<footer>Rights</footer>",
             '<form action="/s"><label>Search</label><input></form>', "<aside>" + sentence(10) + "</aside>"]
    rng.shuffle(extra)
    rng.shuffle(after)
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(extra[:3])}{wrapped}{''.join(after[:4])}</body></html>", "\n\n".join(blocks)


def test_generated_pages_equal_their_articles(spark):
    rng = random.Random(11)
    made = [_generated(rng) for _ in range(300)]
    rows = [(i, f"http://h{i % 7}.org/{i}", page) for i, (page, _) in enumerate(made)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_consensus.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i, (_, text) in enumerate(made) if got[i] != (text, len(text))]
    assert not wrong, (len(wrong), made[wrong[0]], got[wrong[0]])


def test_ties_between_paths_and_repeated_rows(spark):
    one, two = (f"<body><div class={c}>{ARTICLE}</div>" for c in ("b", "a"))
    rows = [(1, "http://x.org/1", one), (2, "http://x.org/2", two), (2, "http://x.org/2", two)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.text for r in html_consensus.extract_pages(pages).orderBy("page_id").collect()] == ["\n\n".join(WANT)] * 3
    votes = html_consensus.host_paths(spark.createDataFrame([("x", one), ("x", two)], "host string, html string")).collect()
    assert [(r.host, r.path) for r in votes] == [("x", "body>div.a")]
