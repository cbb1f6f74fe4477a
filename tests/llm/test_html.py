"""Main text: blocks against the standard library's parser, broken markup, and what the tree uses."""

import random
import time
from html.parser import HTMLParser

import pytest
from tsforge.llm import html_text

LONG = "some words that make up a paragraph of fair length in the middle of the page"


class Plain(HTMLParser):
    """Block texts of well-formed pages, the slow way."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.raw = [], [], 0

    def cut(self):
        if text := " ".join("".join(self.now).split()):
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.raw += 1
            self.now.append(" ")
        elif tag == "br":
            self.now.append(" ")
        elif tag in html_text.BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.raw -= 1
        elif tag in html_text.BLOCK:
            self.cut()

    def handle_data(self, data):
        if not self.raw:
            self.now.append(data)


def slow_blocks(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.cut()
    return parser.blocks


def some_page(rng):
    words = ["alpha", "b&eacute;ta", "&amp;c", "x&lt;y", "  ", "\n", "d&#233;", "it's", 'q"q']

    def piece(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(words) for _ in range(rng.randrange(5)))
        tag = rng.choice(["p", "div", "ul", "li", "b", "span", "article", "nav", "h2", "script", "select", "svg", "a", "em"])
        attrs = rng.choice(["", " class=x", " title=\"it's > that\"", " title='a > b'", " data-a=it's", ' href="/q?a=1&b=2"'])
        inside = "var a = 1;" if tag in html_text.RAW else "".join(piece(depth - 1) for _ in range(rng.randrange(4)))
        return f"<{tag}{attrs}>{inside}</{tag}>" + rng.choice(["", "<br>", "<!-- <p>no</p> -->", "<hr/>"])

    return "".join(piece(4) for _ in range(5))


def test_blocks_equal_the_slow_parser():
    rng = random.Random(21)
    for _ in range(400):
        page = some_page(rng)
        assert [b["text"] for b in html_text.text_blocks(page)] == slow_blocks(page), page


def test_blocks_of_given_pages(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert all([b["text"] for b in html_text.text_blocks(p)] == slow_blocks(p) for p in pages)


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit_tree(spark)


def texts_of(spark, pages, tree):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' AS url", "html")
    return [r["text"] for r in html_text.main_text(frame, tree=tree).orderBy("page_id").collect()]


def test_broken_markup_hides_nothing(spark, tree):
    pages = [
        f"<html><head><title>t</title><meta charset=x><body><p>{LONG}</p><p>{LONG}</p>",
        *(f"<p>{LONG}</p><{tag}><p>{LONG}</p><p>{LONG}</p>" for tag in ("select", "svg", "iframe", "object", "textarea", "template", "noscript")),
        f"<article><p title=it's>{LONG}</p><p>{LONG}</p><p class='x>{LONG}</p></article>",
        f"<p>{LONG}</p><script>var a = '<p>{LONG}</p>';",
    ]
    got = texts_of(spark, pages, tree)
    assert got[0] == f"{LONG}\n\n{LONG}" and all(t == f"{LONG}\n\n{LONG}\n\n{LONG}" for t in got[1:8])
    assert got[8].startswith(f"{LONG}\n\n{LONG}") and got[9] == LONG


def test_names_are_weak_evidence(spark, tree):
    pages = [
        f'<article class="post tags-list related-news single"><h1>Head</h1><p>{LONG}</p></article>',
        f'<div class="form-group content"><p>{LONG}</p><p>{LONG}</p></div>',
        f'<article><p>{LONG}</p></article><div class="comments"><p>{LONG}</p></div><aside>{LONG}</aside><article class="comment"><p>{LONG}</p></article>',
    ]
    assert texts_of(spark, pages, tree) == [f"Head\n\n{LONG}", f"{LONG}\n\n{LONG}", LONG]


def test_an_article_outweighs_the_names_around_it(spark, tree):
    pages = [
        f'<form id="aspnetForm"><article><h1>Head</h1><p>{LONG}</p></article></form>', f'<div class="with-sidebar"><article><h1>Head</h1><p>{LONG}</p></article></div>',
        f'<main class="search-page"><h1>Head</h1><p>{LONG}</p></main>', f'<article class="discussion"><h1>Head</h1><p>{LONG}</p></article>',
        f'<div class="page-header"><h1>Head</h1></div><p>{LONG}</p>', f'<h1>Head</h1><div class="promo-content"><p>{LONG}</p></div>',
    ]
    assert texts_of(spark, pages, tree) == [f"Head\n\n{LONG}"] * 6
    others = [
        f'<article><p>{LONG}</p></article><section id="comments"><article><p>{LONG}</p></article></section>', f'<article><p>{LONG}</p></article><aside><article><p>{LONG}</p></article></aside>',
        f"<article><p>{LONG}</p></article><footer><main><p>{LONG}</p></main></footer>", f'<article><p>{LONG}</p><div class="comment-content"><p>{LONG}</p></div></article>',
        f"<p>{LONG}</p><p>Copyright 2024 House of Words worldwide</p>", f"<article><p>{LONG}</p></article><p>&copy; 2024 House of Words</p>", f"<article><p>{LONG}</p><form><p>your mail please</p></form></article>",
    ]
    assert texts_of(spark, others, tree) == [LONG] * 7


def test_neighbours_decide(spark, tree):
    used = {html_text.FEATURES[int(x.split("feature ")[1].split()[0])] for x in tree.splitlines() if "feature " in x and "If" in x}
    assert used & {"words_before", "words_after"} and used & {"links_before", "links_after"}
    inside, outside = texts_of(spark, [f"<p>{LONG}</p><p>so it is</p><p>{LONG}</p>", f"<p>{LONG}</p><p><a>more</a></p><p>so it is</p><p><a>less</a></p>"], tree)
    assert "so it is" in inside and "so it is" not in outside


def test_deep_and_long_pages_take_linear_time(spark, tree):
    start = time.process_time()
    assert len(html_text.text_blocks("<div>a" * 20000 + "</p>" * 20000)) == 20000
    assert len(html_text.text_blocks("<select><p>a" * 20000)) == 20000
    assert time.process_time() - start < 20
    page = "<article>" + f"<p>{LONG}</p>" * 40000 + "</article>"
    assert len(texts_of(spark, [page], tree)[0]) == 40000 * (len(LONG) + 2) - 2
