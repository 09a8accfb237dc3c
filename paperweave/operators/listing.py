"""List stage: search requests, hit counts, page plans and links.

Three layouts of result pages are known, called A, B and C.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.clean import is_nonblank, percent_quote
from paperweave.functions.html import (
    all_elements, attributes, direct_texts, first_attribute, first_element, open_tag, text_of, visible,
)
from paperweave.schema import LAYOUT_OF_SITE

# Layout -> (hits per list page, most list pages or None).
PAGING = {"A": (15, None), "B": (10, None), "C": (50, 100)}

# Request addresses and search clauses of the three dialects.
REQUEST_A = "http://search.cnki.com.cn/Search.aspx?q="
REQUEST_B = "http://www.cqvip.com/data/main/search.aspx?action=so&curpage="
REQUEST_C = ("http://g.wanfangdata.com.cn/search/searchList.do"
             "?searchType=all&pageSize=50&searchWord=")
REQUEST_C_TAIL = ("&showType=detail&isHit=null&isHitUnit=&firstAuthor=false"
                  "&rangeParame=all&navSearchType=")
CLAUSES = {
    "A": {"title": " title:", "authors": " author:", "keywords": " qw:", "unit": " 作者单位:"},
    "B": {"title": "&k=", "authors": "&w=", "keywords": "&k=", "unit": "&o="},
    "C": {"title": " 标题:", "authors": " 作者:", "keywords": " 关键词:", "unit": " 作者单位:"},
}
DETAIL_B = "http://www.cqvip.com/"
DETAIL_C = "http://g.wanfangdata.com.cn/details/detail.do?_type="


def hit_count(page: Column | str, layout: str) -> Column:
    """Number of hits a result page reports; NULL when it reports none."""
    page = visible(page)
    if layout == "A":
        shown = text_of(first_element(page, "span", open_tag("span", cls="page-sum")))
        digits = F.trim(F.substr(shown, F.lit(8), F.length(shown) - 8))
    elif layout == "B":
        shown = text_of(first_element(page, "p", open_tag("p")))
        line = F.get(F.split(shown, "\r\n"), F.lit(1))
        digits = F.trim(F.substring_index(
            F.get(F.split(line, '"recordcount":'), F.lit(1)), ",", 1))
    else:
        # a number counts only without point
        pieces = F.filter(direct_texts(page, open_tag("div", cls="left_sidebar_border")),
                          lambda s: s.contains("条结果"))
        numbers = F.transform(
            pieces, lambda s: F.regexp_extract(s, r"\p{Nd}+\.?\p{Nd}*", 0))
        digits = F.get(F.filter(numbers, lambda n: n.rlike(r"^\p{Nd}+$")), F.lit(0))
    return digits.try_cast("bigint")


def page_count(total: Column, per_page: Column | int, cap: Column | int | None = None) -> Column:
    """List pages for a number of hits, at most ``cap``."""
    per_page = F.lit(per_page) if isinstance(per_page, int) else per_page
    pages = F.ceil(total / per_page).cast("bigint")
    return pages if cap is None else F.least(
        pages, (F.lit(cap) if isinstance(cap, int) else cap).cast("bigint"))


def page_plan(searches: DataFrame, start: Column | int = 1, inclusive: bool = True) -> DataFrame:
    """One row per list page still to be read.

    ``searches`` carries ``n_pages``. With ``inclusive=False`` the last page is
    left out, as two of the sites did.
    """
    start = F.lit(start) if isinstance(start, int) else start
    last = F.col("n_pages") if inclusive else F.col("n_pages") - 1
    return (
        searches.withColumn("_from", start.cast("bigint"))
        .withColumn("_to", last.cast("bigint"))
        .where("_from <= _to")  # sequence() would count down
        .withColumn("page", F.explode(F.sequence("_from", "_to")))
        .drop("_from", "_to")
    )


def advanced(cursors: DataFrame, arrived: DataFrame) -> DataFrame:
    """Cursors ``(search, page)`` after list pages ``(search, page)`` arrived.

    A cursor is the last page read of a search, 0 at first, and moves only over
    pages that follow it without a gap: to the first page that has no successor.
    Found by looking for successors, so no task sorts all pages of a search.
    """
    at = F.coalesce(F.col("at"), F.lit(0))
    known = cursors.select("search", F.col("page").alias("at"))
    ahead = arrived.select("search", "page").distinct().join(known, "search", "left").where(
        F.col("page") > at)
    points = ahead.select("search", "page").unionByName(
        ahead.select("search", at.alias("page")).distinct())
    followed = ahead.select("search", (F.col("page") - 1).alias("page"))
    return points.join(followed, ["search", "page"], "left_anti").groupBy("search").agg(
        F.min("page").alias("page"))


def remaining_plan(searches: DataFrame, cursors: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """List pages still to be read: those beyond the cursor of a search.

    ``searches`` has ``search`` and ``n_pages``; ``held`` are pages that were read
    beyond a gap and need not be read again.
    """
    start = searches.join(cursors.select("search", F.col("page").alias("_cursor")), "search", "left")
    plan = page_plan(start, F.coalesce("_cursor", F.lit(0)) + 1).drop("_cursor")
    return plan if held is None else plan.join(held.select("search", "page"), ["search", "page"], "left_anti")


def paging_progress(page: Column, n_pages: Column) -> Column:
    """Share of list pages read, in percent with two decimals."""
    return F.round(page / n_pages * 100, 2)


def search_expression(layout: str, spec: dict[str, Column] | None = None) -> Column:
    """The search text: one clause per non-blank criterion."""
    spec = spec or {name: F.col(name) for name in CLAUSES[layout]}
    return F.concat_ws("", *[
        F.when(is_nonblank(spec[name]), F.concat(
            F.lit(mark), percent_quote(spec[name]) if layout == "B" else spec[name]))
        for name, mark in CLAUSES[layout].items()
    ])


def request_url(layout: str, page: Column, per_page_b: int = PAGING["B"][0]) -> Column:
    """Address of one result page for the criteria columns of a row.

    Needs ``title authors keywords unit`` and, for C, ``starttime endtime``.
    """
    search = search_expression(layout)
    page_text = page.cast("string")
    if layout == "A":
        offset = ((page - 1) * PAGING["A"][0]).cast("string")
        return F.concat(F.lit(REQUEST_A), percent_quote(search), F.lit("&p="), offset)
    if layout == "B":
        return F.concat(F.lit(REQUEST_B), page_text, F.lit(f"&perpage={per_page_b}&"), search)
    return F.concat(
        F.lit(REQUEST_C), search,
        F.lit(" 起始年:"), F.col("starttime").cast("string"),
        F.lit(" 结束年:"), F.col("endtime").cast("string"),
        F.lit(REQUEST_C_TAIL), F.lit("&page="), page_text,
    )


def request_manifest(plan: DataFrame) -> DataFrame:
    """Address of every planned list page; ``layout`` tells the dialect."""
    url = F.when(F.col("layout") == "A", request_url("A", F.col("page"))) \
        .when(F.col("layout") == "B", request_url("B", F.col("page"))) \
        .when(F.col("layout") == "C", request_url("C", F.col("page")))
    return plan.withColumn("request_url", url)


def detail_url_b(path: Column) -> Column:
    return F.concat(F.lit(DETAIL_B), percent_quote(F.replace(path, F.lit("\\"), F.lit(""))))


def detail_url_c(kind: Column, ident: Column) -> Column:
    return F.concat(F.lit(DETAIL_C), kind, F.lit("&id="), ident)


def _links_a(page: Column) -> Column:
    blocks = all_elements(page, "div", open_tag("div", cls="wz_content"))
    return F.transform(blocks, lambda b: first_attribute(b, "a", "href"))


def _links_b(page: Column) -> Column:
    cells = all_elements(page, "th", open_tag("th"))
    paths = F.transform(cells, lambda b: first_attribute(b, "a", "href"))
    local = F.filter(paths, lambda p: ~(p.contains("http") & p.contains("www")))
    return F.transform(local, detail_url_b)


def _links_c(page: Column) -> Column:
    calls = attributes(page, open_tag("i", class_="icon icon_Miner"), "onclick")

    def link(call: Column) -> Column:
        items = F.split(call, ",")
        ident = F.regexp_replace(F.get(items, F.lit(1)), r"^[\\']+|[\\']+$", "")
        kind = F.regexp_replace(F.get(items, F.lit(2)), r"^[\\']+|[\\')]+$", "")
        return detail_url_c(kind, ident)

    return F.transform(calls, link)


def _links_any(page: Column) -> Column:
    return attributes(page, open_tag("a"), "href")


_LINKS = {"A": _links_a, "B": _links_b, "C": _links_c, "any": _links_any}


def extract_links(pages: DataFrame, layout: str | None = None, empty: bool = False) -> DataFrame:
    """Links of result pages with their place on the page.

    ``layout`` is A, B or C, or ``any`` for every anchor; without it the
    ``source`` of a page tells its layout. ``empty`` keeps a row without link for
    pages that have none. The html itself is dropped here, before any shuffle.
    """
    keep = [c for c in pages.columns if c not in ("html", "url")]
    page = visible("html")
    if layout is not None:
        links = _LINKS[layout](page)
    else:
        links = F.coalesce(*[
            F.when(F.col("source") == site, _LINKS[letter](page))
            for site, letter in LAYOUT_OF_SITE.items()])
    if empty:
        return pages.select(*keep, F.posexplode_outer(links).alias("position", "url"))
    return pages.select(
        *keep, F.posexplode(links).alias("position", "url"),
    ).where(F.col("url").isNotNull())
