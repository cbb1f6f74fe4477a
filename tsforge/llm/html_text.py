"""HTML main text: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each has its word count and link density (the
share of its words inside links), those of the blocks before and after it, and what encloses it:
page furniture (navigation, headers, footers, asides, forms, or a class, id or role that says so,
wholly or in part), an article or main element, a heading, a list. A decision tree trained on the small labelled
table below (LABELLED: pages whose blocks are marked by hand) keeps or drops each block. The tree
becomes one SQL expression over the blocks' features, so that text and features never leave the
row and nothing is shuffled.

Defined results: null and empty pages have no text; comments, scripts, styles, the title, templates
and hidden elements give no blocks; what is never closed ends with its parent or the page and hides
nothing, but for scripts and styles; character references are decoded once, after the markup is
gone; a block is its text with every run of white space as one space, trimmed; kept blocks are
joined by two line feeds in page order; repeated rows are extracted each; nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.llm.common import sliced

#: Comments, tags (quotes count behind an equals sign alone), declarations and what else looks like
#: markup. What an attribute's part has matched is never tried otherwise.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>]))*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose inside is no text of the page. One that is never closed hides nothing, but for
#: scripts and styles, which then run to the page's end.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style template noscript svg iframe object title select textarea".split()}
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: Tags that end a block. Fixed values.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that enclose others until they are closed.
OPEN_ENDED = set("p li dd dt option tr td th".split())
ENCLOSING = BLOCK - OPEN_ENDED - {"hr", "body", "html"}
FURNITURE = set("nav aside footer form menu dialog button fieldset search".split())
#: Those of them whose inside is never main text.
FIRM = set("nav aside footer menu dialog button".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that are often said of page furniture. Fixed values.
SAYS_FURNITURE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright"
    " disclaimer disqus feedback footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager"
    " pagination paywall popup promo promotion promoted reactions recommended related replies reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored subscribe subscription tags teaser toc toolbar tooltip topbar widget widgets alert complementary responses discussion".split()
)
#: Names that are often given to the main text. Fixed values.
SAYS_MAIN = set("article body content entry hentry main post single story text".split())
WORDS_OF = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


#: Names of readers' and advertisers' parts, which no article inside outweighs. Fixed values.
SAYS_OTHERS = set("ad ads advert adverts advertisement advertising comment comments disqus reactions related replies reply respond responses sponsor sponsored".split())
#: Beginnings and parts of legal lines. Fixed values.
LEGAL = re.compile(r"[-+\s]*(?:©|\(c\)|copyright\b)", re.I)
RESERVED = re.compile(r"\ball rights reserved\b", re.I)


def says_furniture(attrs: str) -> tuple[float, bool]:
    """How far the names of an element speak of page furniture: 1.0 by a whole name, 0.5 by a part
    of one, 0.25 by a part of one that also has a part of a name of main text, 0.0 by none, or where
    another name is that of main text; and whether a name is that of readers' or advertisers' parts."""
    whole = part = mixed = main = others = False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role"):
            for said in (a or b or c).split():
                words = set(WORDS_OF.findall(CAMEL.sub(" ", said).lower()))
                whole = whole or said.lower() in SAYS_FURNITURE
                others = others or said.lower() in SAYS_OTHERS
                main = main or said.lower() in SAYS_MAIN
                if words & SAYS_FURNITURE:
                    both = words & (SAYS_MAIN | {"page"}) and not words & SAYS_OTHERS
                    part, mixed = part or not both, mixed or bool(both)
    return (1.0 if whole else 0.0 if main else 0.5 if part else 0.25 if mixed else 0.0), others


LEVELS = (1.0, 0.5, 0.25)


class Opened:
    """The elements that are open, with running counts of what they are. What names say of page
    furniture counts inside the innermost article only; what asides, footers and readers' parts say
    counts however deep (``firm``)."""

    def __init__(self):
        self.stack: list[tuple[str, float, bool, bool, bool]] = []  # tag, furniture, firm, main, hidden
        self.tags: dict[str, int] = {}
        self.names = [dict.fromkeys((0.0, *LEVELS), 0)]
        self.firm = self.main = self.hidden = self.headings = 0

    def furniture(self) -> float:
        return 1.0 if self.firm else next((x for x in LEVELS if self.names[-1][x]), 0.0)

    def _count(self, one: tuple[str, float, bool, bool, bool], by: int) -> None:
        tag, furniture, firm, main, hidden = one
        self.tags[tag] = self.tags.get(tag, 0) + by
        self.names[-1][furniture] += by
        self.firm += by * firm
        self.main += by * main
        self.hidden += by * hidden
        self.headings += by * (tag in HEADINGS)

    def push(self, *one) -> None:
        self.stack.append(one)
        if one[3]:
            self.names.append(dict.fromkeys((0.0, *LEVELS), 0))
        self._count(one, 1)

    def pop(self) -> tuple[str, float, bool, bool, bool]:
        one = self.stack.pop()
        self._count(one, -1)
        if one[3]:
            self.names.pop()
        return one

    def close(self, tag: str) -> None:
        """Up to the innermost element of that tag, if there is one."""
        if self.tags.get(tag):
            while self.pop()[0] != tag:
                pass

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""


def text_blocks(page: str | None) -> list[dict]:
    """The page's flat blocks in order, with their features."""
    page = page or ""
    blocks: list[dict] = []
    opened = Opened()
    parts: list[str] = []
    linked = 0
    in_link = False
    leaf = ""

    def words_in(text: str) -> int:
        return len(html.unescape(text).split())

    def close_block() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not opened.hidden:
            n = len(text.split())
            blocks.append({
                "text": text, "words": float(n), "links": min(1.0, linked / n), "furniture": opened.furniture(), "legal": float(bool(LEGAL.match(text) or RESERVED.search(text))),
                "main": float(opened.main > 0), "heading": float(leaf in HEADINGS or opened.headings > 0), "item": float(leaf in ("li", "dt", "dd", "option")),
            })
        parts, linked = [], 0

    at, unclosed = 0, set()
    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += words_in(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        closing = bool(m["close"])
        if tag in RAW and not closing and not m["attrs"].endswith("/"):
            end = None if tag in unclosed else RAW[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(tag)
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            close_block()
            in_link = in_link and closing
            if not closing and opened.top() in OPEN_ENDED and opened.top() in ("p", tag):
                opened.pop()  # a paragraph ends at the next block, an item at the next item
            leaf = "" if closing else tag
            if closing:
                opened.close(tag)
            elif tag not in ("html", "body", "hr") and not m["attrs"].endswith("/"):
                (said, firm), hidden = says_furniture(m["attrs"]), bool(HIDDEN.search(m["attrs"]))
                if tag in ENCLOSING or said or hidden:
                    inside = opened.main > 0
                    main = tag in ("article", "main") or 'role="main"' in m["attrs"]
                    if tag in FURNITURE or (tag == "header" and not inside):
                        said, firm = 1.0, firm or tag in FIRM
                    elif firm:
                        said = 1.0
                    elif main or (inside and tag in HEADINGS | {"header"}):
                        said = 0.0  # an article's own names are weak beside what it is
                    opened.push(tag, said, firm, main, hidden)
    rest = page[at:]
    parts.append(rest)
    if in_link:
        linked += words_in(rest)
    close_block()
    for i, block in enumerate(blocks):
        for name, j in (("before", i - 1), ("after", i + 1)):
            other = blocks[j] if 0 <= j < len(blocks) else None
            block[f"words_{name}"] = other["words"] if other else 0.0
            block[f"links_{name}"] = other["links"] if other else 0.0
    return blocks


FEATURES = ("words", "links", "furniture", "main", "heading", "item", "legal", "words_before", "links_before", "words_after", "links_after")

#: Pages marked by hand: a block that starts with + is main text, one that starts with - is not.
LONG = "the council met on tuesday to settle how the bridge over the river should be paid for and by whom after years of delay"
LABELLED = (
    f"<body><nav><ul><li><a>-home</a><li><a>-news</a></ul></nav><article><h1>+a title</h1><p>+{LONG}</p><p>+short.</p><p>+{LONG} {LONG}</p></article><footer>-copyright of the house of words</footer></body>",
    f"<div class='menu'><a>-one</a> <a>two</a></div><div class='ad'>-buy now while it lasts.</div><article><h1>+title of it</h1><p>+{LONG}</p><ul><li>+first point</li><li>+second point</li></ul></article><aside><p>-{LONG}</p></aside>",
    f"<header><h1>-site name</h1><p>-a slogan of some words</p></header><main><h2>+heading here</h2><p>+{LONG}</p><blockquote>+he said so</blockquote><form><p>-your mail please</p></form></main><footer><p>-{LONG}</p></footer>",
    f"<div><a>-home</a> <a>about</a> <a>contact</a></div><div><h1>+plain page</h1><p>+{LONG} {LONG}</p><p>+{LONG}</p></div><div><a>-terms of use</a> <a>privacy</a></div><div>-all rights</div>",
    f"<div id='sidebar'><h3>-popular</h3><p>-{LONG}</p></div><div id='content'><p>+{LONG}</p><p>+yes it is.</p><p>+{LONG}</p></div><div class='comments'><p>-{LONG}</p><p>-nice one</p></div>",
    f"<div class='cookie-notice'><p>-{LONG}</p></div><article><header><h1>+the head of it</h1></header><p>+{LONG}</p><p><a>-read more on this</a></p><section class='related'><h3>-related</h3><a>-another story</a></section></article>",
    f"<div><p>-share</p></div><p>-posted by someone</p><p>+{LONG}</p><p>+{LONG} {LONG}</p><p>-tags</p><ul><li><a>-one</a></li><li><a>-two</a></li><li><a>-three four</a></li></ul>",
    f"<article><h1>+word</h1><p>+one</p><p>+{LONG}</p><p>+see <a>this here</a> and {LONG}</p><table><tr><td>+cell</td><td>+{LONG}</td></tr></table></article><div>-tiny</div>",
    f"<main><div class='breadcrumb'><a>-a</a> <a>b</a></div><h1>+big</h1><p>+{LONG}</p><p>+end</p><div class='newsletter'><p>-sign up for our letter today</p></div></main><div class='widget'><p>-{LONG}</p></div>",
    f"<nav>-menu</nav><article><p>+{LONG}</p><p>+ok.</p></article><article><p>+next</p><p>+{LONG}</p></article><footer>-f</footer>",
    f"<div class='banner'>-{LONG} {LONG}</div><h1>+heading</h1><p>+{LONG}</p><h2>+sub</h2><p>+{LONG}</p><p><a>-click here for more</a></p>",
    f"<main><h1>+t</h1><p>+few words in it</p></main><aside>-x</aside><form>-search <button>-go</button></form><article><p>+w</p><nav><a>-next page</a></nav></article>",
    f"<article><p>+a</p><p>+b c</p><p>+{LONG}</p><ul><li><a>-link in a list</a></li><li><a>-other link</a></li></ul></article><div><a>-l</a></div><div>-small print here</div>",
    f"<article><h2><a>+a linked title</a></h2><p>+{LONG}</p><h2>+next</h2><p>+x y z</p></article><article><h1><a>+linked</a></h1><p>+{LONG}</p></article>",
    # Nothing before or behind the article, short last blocks, and pages that break off.
    "<article><p>+w</p></article>",
    f"<article><h1>+t</h1><p>+{LONG}</p></article>",
    f"<article><h1>+t</h1><p>+{LONG}</p><p>+it ended",
    "<main><p>+only this</p><p>+and that</p></main>",
    f"<nav>-menu</nav><main><p>+{LONG}</p><p>+one.</p></main>",
    f"<div>-x</div><article><p>+{LONG}</p><p>+a b c d e</p></article>",
    f"<p>+{LONG}</p><p>+{LONG}</p>",
    f"<div><a>-go</a></div><p>+{LONG}</p>",
    f"<h1>+plain</h1><p>+{LONG}</p><div>-links</div>",
    f"<nav>-m</nav><p>+{LONG} {LONG}",
    f"<footer>-{LONG}</footer>",
    "<nav>-a b c</nav>",
    f"<aside>-{LONG}</aside>",
    "<div>-hello</div>",
    # No element or name tells anything here: short blocks go by what stands beside them.
    f"<div><a>-home</a></div><div>-a slogan of some words</div><div><a>-one</a> <a>two</a></div><p>+{LONG}</p><p>+he said.</p><p>+{LONG}</p><div><a>-next</a></div><div>-share it with friends</div><div><a>-print</a></div>",
    f"<div><a>-start</a></div><div>-today</div><div><a>-shop</a></div><div>-weather of the day</div><div><a>-more</a></div><p>+{LONG}</p><p>+few words here</p><p>+{LONG} {LONG}</p><p>+one more line</p><p>+{LONG}</p>",
    f"<p>+{LONG}</p><p>+why?</p><p>+{LONG}</p><p>+nobody knew it then.</p><p>+{LONG} {LONG}</p><div>-all rights reserved</div><div><a>-terms</a></div><div>-made by us</div><div><a>-contact</a></div>",
    f"<div><a>-a</a></div><div>-by a writer of ours</div><div><a>-b c</a></div><p>+{LONG}</p><p>+so it went on.</p><p>+{LONG}</p><p>+and then?</p><p>+{LONG}</p><div><a>-see also this page</a></div><div>-from the web</div><div><a>-another page</a></div>",
    f"<div><a>-in</a> <a>out</a></div><div>-five stars</div><div><a>-buy</a></div><p>+{LONG} {LONG}</p><p>+yes.</p><p>+{LONG}</p><div><a>-older</a></div><div>-three days ago</div><div><a>-newer</a></div><div>-ten people like it</div><div><a>-top</a></div>",
    f"<div><a>-x</a></div><div>-y z</div><div><a>-u v</a></div><div>-w</div><div><a>-r s t</a></div><div>+{LONG}</div><div>+that was all</div><div>+{LONG}</div>",
    f"<div>+{LONG}</div><div>+no.</div><div>+{LONG}</div><div>+in the end they left</div><div>+{LONG}</div><div><a>-up</a></div><div>-page two of nine</div><div><a>-down</a></div>",
    # Links behind the last paragraph, long or short, inside an article or not.
    *(f"{a}<p>+{LONG}</p><p>+{LONG} {LONG}</p><p>+{last}</p>{b}<div><a>-more of it</a></div><div>-what else there is</div><div><a>-back</a></div>"
      for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>")) for last in (LONG, f"{LONG} {LONG}", "the council will meet again in the spring of next year")),
    *(f"<article><p>+{LONG}</p><p>+{last}</p></article><div><a>-more</a></div>" for last in ("no.", "it was late by then", LONG)),
    # Headings and paragraphs of one to five words among long ones.
    *(f"{a}<h1>+{'head ' * n}</h1><p>+{LONG} {LONG}</p><p>+{'word ' * n}</p><p>+{LONG}</p><p>+{'then ' * n}</p><p>+{LONG} {LONG}</p><p>+{'end ' * n}</p>{b}"
      for n in range(1, 6) for a, b in (("<article>", "</article><footer>-us</footer>"), ("<main>", "</main>"), ("<div>", "</div><div><a>-more</a></div>"))),
    # Text between links.
    f"<article><p><a>-read this</a></p><p>+{LONG}</p><p><a>-and this</a></p><p>+{LONG}</p><p><a>-read on</a></p><p>+end</p></article>",
    f"<article><h2><a>+linked</a></h2><p>+b c</p><p>+{LONG}</p><h2><a>+linked again</a></h2><p>+one two</p><h2><a>+and again</a></h2></article>",
    "<article><p>+a</p><p>+b c</p><p>+d</p><p>+e f g</p></article>",
    "<article><h1>+w</h1><p>+one two three</p><h1><a>+x y</a></h1><p>+one two</p><h1><a>+z</a></h1></article>",
    *(f"<div><a>-home</a></div><p>+{text}</p><div><a>-next</a></div>" for text in (LONG, f"{LONG} {LONG}", f"{LONG} and more", f"{LONG} and even more of it")),
    # Names that are only part of one: of furniture here, of main text there.
    f"<div class='post tags-list'><p>+{LONG}</p><p>+short one</p></div><div class='site-footer'><p>-{LONG}</p></div><div class='form-group content'><p>+{LONG}</p></div>",
    f"<div class='cookie-box'><p>-{LONG} {LONG}</p></div><article class='story related-news'><p>+{LONG}</p><p>+it is</p></article><div id='page-footer'>-{LONG}</div>",
    f"<div class='top-banner'>-{LONG}</div><p>+{LONG}</p><p>+{LONG}</p><div class='comment-list'><p>-{LONG}</p><p>-{LONG} {LONG}</p></div>",
    # Names of both kinds: what stands beside a block and its own length and links decide.
    *(f"<div class='{a}'><h1>+{head}</h1></div><p>+{LONG}</p><p>+{LONG}</p><div class='{b}'><p>-{tail}</p></div>"
      for a, b in (("page-header", "page-footer"), ("entry-header", "content-footer"), ("post-header", "article-footer"), ("articleHeader", "post-share"))
      for head, tail in (("title of it", "shared by us"), ("a rather long title of some more words", "posted in news"))),
    *(f"<div class='{a}'><p>+{LONG}</p><p>+{LONG} {LONG}</p></div>" for a in ("promo-content", "contentBanner", "story-promo", "form-body")),
    *(f"<div><a>-home</a></div><div class='{a}'><p>-{few}</p></div><div><a>-more</a></div><p>+{LONG}</p>" for a in ("promo-content", "content-banner", "body-header") for few in ("buy it now", "only today")),
    f"<div class='site-header'><h1>-site name</h1></div><div><a>-home</a></div><p>+{LONG}</p>",
    # An article or main text inside what has the name or the element of furniture.
    f"<form id='aspnetForm'><div><a>-home</a></div><article><h1>+t</h1><p>+{LONG}</p><p>+short</p></article><div><p>-find it here</p></div></form>",
    f"<div class='with-sidebar'><article><p>+{LONG}</p><p>+so it is</p></article><div class='sidebar'><p>-{LONG}</p></div></div>",
    f"<main class='search-page'><h1>+t</h1><p>+{LONG}</p></main><article class='discussion'><p>+{LONG}</p></article><div class='comments'><article><p>-{LONG}</p></article></div>",
    # Legal lines, short and long, wherever they stand.
    *(f"{a}<p>+{LONG}</p><p>+{LONG}</p>{b}<{tag}>-{line}</{tag}>" for a, b in (("<article>", "</article>"), ("<div>", "</div>")) for tag in ("p", "div")
      for line in ("copyright 2024 the house of words worldwide", "© 2024 house of words", f"all rights reserved {LONG}")),
    f"<article class='entry share-box'><h1>+t of it</h1><p>+{LONG}</p><p>+{LONG}</p></article><div class='side-widget'><p>-{LONG}</p><p>-a b</p></div>",
)


def labelled_table() -> list[tuple]:
    rows = []
    for page in LABELLED:
        # The marks are cut off only after the blocks are known, so that they count for no feature.
        for block in text_blocks(page):
            rows.append((*(block[f] for f in FEATURES), 1.0 if block["text"].startswith("+") else 0.0))
    return rows


def fit_tree(spark: SparkSession, *, depth: int = 8) -> str:
    """Trained on the labelled table; its description as text."""
    table = spark.createDataFrame(labelled_table(), ", ".join(f"{c} double" for c in (*FEATURES, "label"))).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=2, seed=1).fit(rows).toDebugString


def tree_column(description: str, block: Column) -> Column:
    """The tree as nested conditions over a block's features: 1.0 keeps the block."""
    lines = iter([x.strip() for x in description.splitlines()[1:] if x.strip()])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        m = re.fullmatch(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        low = node()
        next(lines)  # the matching Else
        high = node()
        return F.when(block[FEATURES[int(m[1])]] <= float(m[2]), low).otherwise(high)

    return node()


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: str | None = None) -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars and n_blocks (all blocks of the page) of every row."""
    tree = tree or fit_tree(pages.sparkSession)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    fields = pa.struct([("text", pa.string()), *((f, pa.float64()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = pa.array([text_blocks(p.as_py()) for p in batch.column("html")], pa.list_(fields))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), found], names=["id", "url", "blocks"])

    kinds = source.drop("html").dtypes
    schema = ", ".join(f"{n} {t}" for n, t in kinds) + ", blocks array<struct<text string, " + ", ".join(f"{f} double" for f in FEATURES) + ">>"
    blocks = source.mapInArrow(run, schema)
    kept = F.filter("blocks", lambda b: tree_column(tree, b) == 1.0)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    out = blocks.select("id", "url", text.alias("text"), F.size("blocks").alias("n_blocks"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")
