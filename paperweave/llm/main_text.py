"""Main text of HTML pages: flat blocks, classified by a small decision tree.

A page is flattened to text blocks at block-level tags. A block has its number
of words and link density, those of the blocks before and after it, and whether
it stands in an article or in an element that by its tag or name is a menu,
footer, sidebar, notice, advert, form or comment. A decision tree, grown on the
blocks of a small labelled table of pages, says which blocks are main text.

Defined cases: null and empty html give an empty text; markup that is not closed
or not well formed is read on, a ``<`` that starts no tag is text; scripts and
styles are skipped to their end tag, or to the end of the page; character
references are decoded once; equal rows are read each; pages of any length are
read whole, one at a time; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.words import slices

# Fixed values of HTML.
BLOCK_TAGS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul").split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noframes xmp iframe noembed".split())
# Elements that never hold main text, and words of class and id names that say so.
OUTSIDE_TAGS = frozenset("head nav aside footer form menu dialog button select template noscript svg object search".split())
OUTSIDE_NAMES = frozenset((
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer login masthead menu menubar modal nav navbar navigation newsletter notice notices notification popup promo promoted recommended related "
    "replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription topbar "
    "widget widgets").split())
INSIDE_TAGS = frozenset(("article", "main"))
INSIDE_NAMES = frozenset("article content entry main post story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[a-z]+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "inside", "heading"]


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Text and features of every block of a page, in page order."""
    texts: list[str] = []
    rows: list[tuple] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, outside, inside
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading = 0, False
    outside = inside = False
    at = 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            of_links = len(entities.unescape(" ".join(linked)).split())
            texts.append(text)
            rows.append((n, min(of_links / n, 1.0), outside, inside, heading))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        add(page[at:m.start() if m else end])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        tag = m[2].lower()
        if tag in BLOCK_TAGS or tag in INSIDE_TAGS:
            close()
        elif tag == "br":
            add(" ")
        if m[1]:
            if tag == "a":
                in_link = max(in_link - 1, 0)
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    outside, inside = open_[-1][1:] if open_ else (False, False)
                    break
            if len(tag) == 2 and tag[0] == "h":
                heading = False
            continue
        if tag in RAW_TAGS:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
            continue
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        names = {x for g in _NAMES.findall(m[3]) for x in _PARTS.findall("".join(g).lower())} if "=" in m[3] else set()
        now_inside = inside or tag in INSIDE_TAGS or (bool(names & INSIDE_NAMES) and not outside)
        now_outside = outside or tag in OUTSIDE_TAGS or bool(names & OUTSIDE_NAMES) and tag not in ("body", "html", "main") \
            or (tag == "header" and not inside) or ("=" in m[3] or "hidden" in m[3]) and bool(_HIDDEN.search(m[3]))
        if now_outside != outside or now_inside != inside:
            if tag not in BLOCK_TAGS:
                close()
        open_.append((tag, now_outside, now_inside))
        outside, inside = now_outside, now_inside
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = True
        elif tag in ("p", "div", "section"):
            heading = False
    close()
    plain = np.array(rows, float).reshape(len(rows), 5)
    near = np.zeros((len(rows) + 2, 2))
    near[1:-1] = plain[:, :2]
    return texts, np.column_stack([plain[:, :2], near[:-2], near[2:], plain[:, 2:]])


# --------------------------------------------------------------- decision tree

@dataclass
class Tree:
    """Rows of ``feature, threshold, left, right, share``; leaves have no feature."""

    nodes: list[tuple[int, float, int, int, float]]

    def share(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            feature, threshold, left, right, share = self.nodes[node]
            if feature < 0:
                out[rows] = share
                continue
            low = x[rows, feature] <= threshold
            todo += [(left, rows[low]), (right, rows[~low])]
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """Binary splits of least Gini impurity."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        place, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, -1, -1, share))
        best = (len(rows) * share * (1 - share), -1, 0.0)
        for f in range(x.shape[1]) if depth and 0 < share < 1 else ():
            values = np.unique(x[rows, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= t
                a, b = y[rows[low]], y[rows[~low]]
                if min(len(a), len(b)) >= least:
                    cost = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
                    best = min(best, (cost - 1e-9, f, float(t)))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[place] = (best[1], best[2], build(rows[low], depth - 1), build(rows[~low], depth - 1), share)
        return place

    build(np.arange(len(y)), depth)
    return Tree(nodes)


_LONG = "of the long and winding words that make up a sentence in a story about nothing much at all "
_PART = [" ".join(_LONG.split()[i % 4:i % 4 + 10 + i % 7]) for i in range(12)]
_LINKS = " ".join(f"<a>topic number {i}</a>" for i in range(20))
_MENU = "<a>Home</a> <a>News</a> <a>Sport</a>"


def _plain(tag: str, n: int, words: int) -> str:
    """A page without telling tags or names: ``n`` paragraphs between menus, a block of links and a last line."""
    paragraphs = "".join(f"<{tag}>+{' '.join(_PART[(i + words) % 12].split()[:words + i % 4])}</{tag}>" for i in range(n))
    return (f"<div>-{_MENU}</div><div>-{_LINKS}</div><h1>+Walk by the river</h1>{paragraphs}<ul><li>-<a>Older walks</a>"
            f"<li>-<a>All of the walks that we know</a><li>-<a>Next</a></ul><div>-{_LINKS}</div><div>-Copyright 2020</div>")


#: The labelled table: pages whose main blocks start with ``+`` and whose other blocks start with ``-``.
LABELLED = [
    f"<header><h1>-Site</h1></header><nav><ul><li><a>-Home</a><li><a>-News</a></ul></nav><article><h1>+A title</h1>"
    f"<p>+{_LONG}<p>+{_LONG * 3}<p>+Short.</article><footer>-Imprint of the site</footer>",
    f"<div class=ad>-Buy {_LONG}</div><main><h1>+Title of words</h1><p>+{_LONG}with <a>a link</a></p><ul><li>+First item"
    f"<li>+Second item</ul><div class='share'><a>-Share</a></div></main><aside>-{_LONG}</aside>",
    f"<div id=menu><a>-One</a> <a>two</a></div><div class=content><h2>+Head</h2><p>+{_LONG * 2}</p><p>+Yes.</p>"
    f"<p>+{_LONG}</p></div><div class=comments><p>-{_LONG * 2}</p><p>-Nice one</p></div>",
    f"<p><a>-Home</a> <a>About us</a></p><p>+{_LONG * 2}</p><p>+{_LONG * 2}</p><p><a>-Next page</a></p>",
    f"<div class='cookie-notice'>-We use cookies {_LONG}</div><p>+{_LONG * 3}</p><p>+{_LONG * 3}</p>"
    f"<form><label>-Your name</label></form><footer><p>-{_LONG}</p></footer>",
    f"<div><a>-Log in</a></div><div><a>-Sign up now</a></div><h1>+Title of this page</h1><p>+{_LONG * 2}</p>"
    f"<p>+{_LONG}</p><div><a>-Older</a></div><div><a>-Newer posts</a></div><div>-Terms</div>",
    f"<article><header><h1>+Name</h1></header><p>+Few words.</p><p>+{_LONG}</p><blockquote>+{_LONG}</blockquote>"
    f"<p>+Half of this is <a>one link in the article</a></p><aside>-Also read</aside></article><div>-Copyright</div>",
    f"<ul><li><a>-Start</a><li><a>-Contact us here</a></ul><article><h1>+List</h1><p>+A <a>link</a> in a paragraph</p>"
    f"<p>+And <a>one</a> more</p><ul><li><a>-Book one</a><li><a>-Book two</a></ul><p>+{_LONG}</p></article><p><a>-More</a></p>",
    f"<table><tr><td><a>-A</a><td><a>-B c</a></table><div>+{_LONG * 4}</div><div>+{_LONG * 2}</div><div><a>-Top</a></div>",
    f"<article><h1>+Talk</h1><p>+{_LONG}</p><p>+{_LONG}</p></article><section id=comments><p>-{_LONG}</p><p>-{_LONG * 2}</p>"
    f"<p>-I agree with all of it</p></section><footer>-(c) some site and its owner, {_LONG}</footer><div class=newsletter>"
    f"-Get our letter {_LONG}</div>",
    f"<div class='banner notice'>-{_LONG}</div><div class='story'><p>+{_LONG * 2}</p><p>+{_LONG}</p></div>"
    f"<div class='related'><p>-{_LONG}</p><p>-{_LONG}</p></div><footer><p>-{_LONG * 2}</p><p>-All rights reserved</p></footer>",
    f"<main><p>+{_LONG}</p><p>+So it goes.</p></main><aside><p>-{_LONG * 2}</p><p>-{_LONG}</p></aside><form>-{_LONG}</form>"
    f"<footer>-{_LONG}</footer>",
    f"<section class='sidebar'><h3>-Popular</h3><p>-{_LONG * 2}</p></section><article><p>+{_LONG}</p><h2>+Part</h2>"
    f"<p>+One.</p><p>+Two words.</p></article><div class=footer><p>-{_LONG}</p><p>-2024</p></div>",
    _plain("p", 12, 12), _plain("div", 9, 10), _plain("p", 6, 13), _plain("td", 8, 11),
    f"<article><h1>+Town</h1><p>+{_LONG}</p><ul><li><a>-Towns near this one</a><li><a>-Towns by size</a><li><a>-All</a></ul>"
    f"<p>+{_LONG}</p><div>-{_LINKS}</div><p>+The <a>end</a> of it.</p></article>",
    f"<main><p>+{_LONG}</p><div>-{_LINKS}</div><p>+{_PART[3]}</p><p><a>-Part two of this</a></p><p><a>-Part three</a></p></main>",
    # Pages that end with their main text.
    f"<article><h1>+End</h1><p>+{_LONG}</p><p>+That is all.</p></article>", f"<main><p>+{_PART[5]}</p><p>+Bye.</p></main>",
    f"<article><p>+{_LONG * 2}</p><p>+{_PART[6]}</p></article>", f"<div>-{_MENU}</div><h1>+Short</h1><p>+{_PART[1]}</p><p>+{_PART[7]}</p>",
    f"<p>+{_PART[2]}</p><p>+{_LONG}</p><p>+{_PART[9]}</p>", f"<p>+{_LONG}</p>", f"<article><p>+One line.</p></article>",
    f"<p>+{_LONG}</p><p>+{_PART[4]}</p><div>-Imprint</div>", f"<p>+{_LONG}</p><p>+{_PART[8]}</p><div>-All rights reserved</div>",
]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of :data:`LABELLED`."""
    found = [blocks(page) for page in LABELLED]
    return np.vstack([x for _, x in found]), np.array([float(t[0] == "+") for texts, _ in found for t in texts])


def main_text(page: str | None, tree: Tree) -> str:
    texts, x = blocks(page or "")
    keep = tree.share(x) > 0.5
    return "\n\n".join(t for t, k in zip(texts, keep) if k)


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
              tree: Tree | None = None) -> DataFrame:
    """``(id, url, text, n_chars)``, a row per page."""
    tree = tree or grow(*labelled())
    kinds = [pages.schema[c].dataType.simpleString() for c in (id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x.as_py(), tree) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")) \
        .mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long") \
        .withColumnsRenamed({"id": id, "url": url})
