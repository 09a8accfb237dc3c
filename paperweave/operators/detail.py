"""Detail stage: article pages -> 14-field records.

Every ``extract_*`` returns the identity of the page, the record fields and
``ok``. A page on which any required mark is missing is rejected as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.clean import (
    NBSP, after, before, between, digits_before, first_digits, join_lines, join_values,
    section, squeeze, trim_lines,
)
from paperweave.functions.html import (
    all_elements, attributes, first_element, labelled_values, open_tag, settled, text_of, visible,
)
from paperweave.functions.numerals import replace_numbers
from paperweave.schema import (
    INVALID, LAYOUT_OF_SITE, RECORD_FIELDS, SITES, with_record_defaults,
)

# Style attributes of layout A.
STYLE_TITLE = ("text-align:center; width:740px; font-size: 28px;color: #0000a0; "
               "font-weight:bold; font-family:'宋体';")
STYLE_AUTHORS = "text-align:center; width:740px; height:30px;"
STYLE_ABSTRACT = "text-align:left;word-break:break-all"
STYLE_INFO = "text-align:left;"
STYLE_SOURCE = "float:left;"

# Text in the crumbs -> literature type, first match wins.
TYPES = [("期刊", "J"), ("学位", "D"), ("会议", "C"), ("标准", "S"), ("科技报告", "R"), ("专利", "P")]
OTHER_TYPE = "Z"

_ANY_TABLE = open_tag("table")


def _all(*checks: Column) -> Column:
    """All checks hold; an undecided check counts as failed."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])


def _finish(df: DataFrame, keep: list[str]) -> DataFrame:
    """Page identity, all record fields in order, ``ok``.

    A filter on ``ok`` stays above what reads the pages (see :func:`settled`), and fields that are not
    asked for are not read; :func:`records_of` keeps filters on fields above.
    """
    fields = [name for name in RECORD_FIELDS if name != "url"]
    have = set(df.columns)
    return df.select(
        *keep,
        *[F.coalesce(F.col(n), F.lit("")).alias(n) if n in have else F.lit("").alias(n)
          for n in fields],
        "ok",
    ).select(*keep, *fields, F.explode(F.array("ok")).alias("ok"))


def _identity(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c not in ("html", "layout")]


def extract_a(pages: DataFrame, numbers_first: bool = False) -> DataFrame:
    """Layout A: blocks told apart by their style attribute.

    ``numbers_first`` converts numerals before the publication is read, so
    that numerals inside a journal name change too; off by default because the
    name would then differ from the other sites.
    """
    keep = _identity(pages)
    doc = pages.select(*keep, visible("html").alias("_doc"))

    def block(**attrs) -> Column:
        return first_element("_doc", "div", open_tag("div", **attrs))

    # a block has a text if it is there, so the texts need not be made to tell whether a page is whole
    parts = doc.select(
        *keep,
        block(style=STYLE_TITLE).alias("_title_block"),
        F.array_join(F.transform(
            all_elements("_doc", "div", open_tag("div", style=STYLE_AUTHORS)), text_of), ""
        ).alias("authors"),
        block(style=STYLE_ABSTRACT).alias("_abstract_block"),
        block(cls="xx_font", style=STYLE_INFO).alias("_info_block"),
        squeeze(text_of(block(style=STYLE_SOURCE)), tabs=True).alias("_source"),
    ).withColumns({
        "title": text_of(F.col("_title_block")),
        "_abstract": squeeze(text_of(F.col("_abstract_block"))),
        "_info": squeeze(text_of(F.col("_info_block"))),
        "_numbered": replace_numbers("_source"),
    })

    abstract, info, numbered = F.col("_abstract"), F.col("_info"), F.col("_numbered")
    named = numbered if numbers_first else F.col("_source")
    fields = parts.withColumns({
        "abstract": F.when(abstract.contains("要】："), before(after(abstract, "要】："), "要】："))
        .otherwise(abstract),
        "unit": section(info, "单位】：", "【"),
        "sponser": F.when(info.contains("【基金】："), section(info, "基金】：", "【")),
        "publication": F.regexp_extract(named, "《.*》", 0),
        "year": digits_before(numbered, "年"),
        "issue": digits_before(numbered, "期"),
    }).withColumn("ok", _all(
        F.col("_title_block").isNotNull(), F.col("_abstract_block").isNotNull(),
        F.col("_info_block").isNotNull(), named.isNotNull(),
        ~named.contains("《") | (F.col("publication") != ""),
        ~numbered.contains("年") | (F.col("year") != ""),
        ~numbered.contains("期") | (F.col("issue") != ""),
    ))
    return _finish(fields, keep)


def extract_b(pages: DataFrame) -> DataFrame:
    """Layout B: a heading block and two tables with bracketed labels."""
    keep = _identity(pages)
    heading = first_element("_doc", "span", open_tag("span", cls="detailtitle"))
    tables = all_elements("_doc", "table", _ANY_TABLE)
    parts = pages.select(*keep, visible("html").alias("_doc")).select(
        *keep, heading.alias("_heading"), tables.alias("_tables"),
    ).select(
        *keep,
        first_element("_heading", "h1", open_tag("h1")).alias("_title_block"),
        text_of(first_element("_heading", "strong", open_tag("strong"))).alias("_line"),
        F.replace(text_of(F.get("_tables", F.lit(0))), F.lit("\n"), F.lit("")).alias("_first"),
        F.replace(text_of(F.get("_tables", F.lit(1))), F.lit("\n"), F.lit("")).alias("_second"),
    ).withColumns({
        "title": text_of(F.col("_title_block")),
        "_bar": F.split(before("_line", NBSP * 2), r"\|"),
        "_colons": F.split("_first", "："),
        "_origin": replace_numbers(before(after("_second", "【出　处】"), "【收　录】")),
    }).withColumn("_tokens", F.regexp_extract_all("_origin", F.lit(r"(?U)[^;,\s]+"), F.lit(0)))

    tokens = F.col("_tokens")
    year_text = F.transform(
        F.filter(tokens, lambda t: t.contains("年")),
        lambda t: first_digits(F.when(
            t.contains("》"), F.get(F.split(t, "》"), F.lit(1))).otherwise(t)))
    issue_text = F.transform(F.filter(tokens, lambda t: t.contains("期")), first_digits)
    page_text = F.transform(
        F.filter(tokens, lambda t: t.contains("页") & ~t.contains("共")),
        lambda t: before(t, "页"))
    staged = parts.withColumns({
        "_years": year_text, "_issues": issue_text, "_pages": page_text,
        "publication": F.regexp_extract(F.get("_bar", F.lit(0)), "《.*》", 0),
    })
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    fields = staged.withColumns({
        "authors": F.get("_bar", F.lit(1)),
        "unit": before(after("_line", NBSP * 2), NBSP * 2),
        "abstract": F.get("_colons", F.lit(2)),
        "keywords": before(after("_second", "【关键词】"), "【出　处】"),
        "year": last("_years"),
        "pagecode": last("_pages"),
        "issue": last("_issues"),
    }).withColumn("ok", _all(
        F.col("_title_block").isNotNull(), F.col("publication") != "",
        F.col("authors").isNotNull(), F.col("unit").isNotNull(),
        F.col("abstract").isNotNull(), F.col("keywords").isNotNull(),
        F.col("_origin").isNotNull(),
        ~F.array_contains("_years", ""), ~F.array_contains("_issues", ""),
    ))
    return _finish(fields, keep)


def literature_type(crumbs: Column) -> Column:
    """Type letter from the crumbs text."""
    return reduce(
        lambda other, item: F.when(crumbs.contains(item[0]), item[1]).otherwise(other),
        reversed(TYPES), F.lit(OTHER_TYPE))


def _author_card(kind: Column, page: Column | str) -> Column:
    """The author card of a thesis."""
    return F.when(kind == "D", first_element(page, "a", open_tag("a", id="card01")))


def authors_by_type(kind: Column, page: Column | str, card: Column | None = None) -> Column:
    """Authors of a layout C page; where they stand depends on the type.

    NULL when a thesis has no author card. ``card`` is the card, where it was looked for already.
    """
    inputs = attributes(page, open_tag("input", cls="dw"), "value")
    names = F.transform(
        all_elements(page, "a", open_tag("a", cls="info_right_name")), text_of)
    card = _author_card(kind, page) if card is None else card
    return (F.when(kind == "J", join_values(inputs))
            .when(kind == "D", text_of(card))
            .when(kind == "C", join_values(names))
            .otherwise(""))


def _field_rule(name: str, label: Column, value: Column) -> Column:
    """What one labelled value sets of a field; NULL when it sets nothing.

    Where a value matches several labels of one field, the later label wins.
    """
    has = label.contains
    plain = ~has("作者单位")
    dated = has("年，卷(期)：") & plain
    pieces = F.split(trim_lines(value), ",")
    online = F.regexp_replace(
        F.translate(F.replace(value, F.lit("\r\n"), F.lit("")), "\t", ""), r"(?U)^\s+|\s+$", "")
    apostrophe = lambda c: F.translate(c, "'", "")
    rules = {
        "doi": lambda: F.when(has("doi："), value),
        "keywords": lambda: F.when(has("关键词："), F.replace(trim_lines(value), F.lit("\n\n"), F.lit(";"))),
        "unit": lambda: F.when(has("学位授予单位"), trim_lines(value))
        .when(has("作者单位") & ~has("Author"), join_lines(value)),
        "publication": lambda: F.when(has("刊名：") & plain, apostrophe(trim_lines(value)))
        .when(has("会议名称") | has("学位授予单位"), trim_lines(value)),
        "year": lambda: F.when(has("学位年度"), value)
        .when(has("在线出版日期"), before(online, "年"))
        .when(dated, F.get(pieces, F.lit(0))),
        "volume": lambda: F.when(dated, before(F.get(pieces, F.lit(1)), "(")),
        "issue": lambda: F.when(dated, between(value, "(", ")")),
        "sponser": lambda: F.when(has("基金项目：") & plain, apostrophe(join_lines(value))),
        "pagecode": lambda: F.when(has("页码：") & plain, value),
        "broken": lambda: F.when(dated & (F.size(pieces) < 2), "1"),
    }
    return rules[name]()


def extract_c(pages: DataFrame, require_abstract: bool = False) -> DataFrame:
    """Layout C: labelled values; for every field the last matching label wins.

    ``require_abstract`` rejects pages without an abstract block.
    """
    keep = _identity(pages)
    parts = pages.select(*keep, visible("html").alias("_doc")).select(
        *keep, "_doc",
        first_element("_doc", "font", open_tag("font", style="font-weight:bold;")).alias("_title_block"),
        first_element("_doc", "div", open_tag("div", cls="abstract")).alias("_abstract_block"),
        text_of(first_element("_doc", "div", open_tag("div", cls="crumbs"))).alias("_crumbs"),
        labelled_values("_doc", open_tag("div", cls="info_right")).alias("_values"),
    ).withColumn("type", literature_type(F.col("_crumbs"))) \
        .withColumn("_card", _author_card(F.col("type"), "_doc"))

    def picked(name: str) -> Column:
        found = F.transform("_values", lambda v: _field_rule(name, v["label"], v["value"]))
        return F.coalesce(F.try_element_at(F.filter(found, F.isnotnull), F.lit(-1)), F.lit(""))

    names = ["doi", "keywords", "unit", "publication", "year", "volume", "issue", "sponser",
             "pagecode"]
    fields = parts.select(
        *keep, "type",
        authors_by_type(F.col("type"), "_doc", F.col("_card")).alias("authors"),
        F.translate(text_of(F.col("_title_block")), "'", "").alias("title"),
        F.translate(before(text_of(F.col("_abstract_block")), "摘要"), "\n'", "").alias("abstract"),
        *[picked(n).alias(n) for n in names],
        _all(
            F.col("_title_block").isNotNull(), F.col("_crumbs").isNotNull(),
            (F.col("type") != "D") | F.col("_card").isNotNull(), picked("broken") == "",
            F.col("_abstract_block").isNotNull() if require_abstract else F.lit(True),
        ).alias("ok"),
    )
    return _finish(fields, keep)


_EXTRACT = {"A": extract_a, "B": extract_b, "C": extract_c}


def chosen_sites(mode: str) -> list[str]:
    """Site names whose digit occurs in ``mode``."""
    return [name for digit, name in SITES.items() if str(digit) in mode]


def extract(pages: DataFrame, mode: str = "123") -> DataFrame:
    """Records of the chosen sites in one pass; ``source`` names the site of a page.

    Every reader sees the pages of its own site and NULL for all others, so
    the html is scanned once however many sites are chosen.
    """
    sites = chosen_sites(mode)
    if not sites:
        return extract_a(pages.where(F.lit(False)))
    keep = _identity(pages)
    staged = pages.where(F.col("source").isin(*sites)).select(
        *keep,
        *[F.when(F.col("source") == site, F.col("html")).alias(f"_html_{LAYOUT_OF_SITE[site]}")
          for site in sites])
    fields = [name for name in RECORD_FIELDS if name != "url"] + ["ok"]
    for site in sites:
        layout = LAYOUT_OF_SITE[site]
        rest = [c for c in staged.columns if c != f"_html_{layout}"]
        staged = _EXTRACT[layout](staged.withColumnRenamed(f"_html_{layout}", "html")).select(
            *rest, *[F.col(name).alias(f"_{layout}_{name}") for name in fields])
    return staged.select(*keep, *[
        F.coalesce(*[F.when(F.col("source") == site, F.col(f"_{LAYOUT_OF_SITE[site]}_{name}")) for site in sites])
        .alias(name) for name in fields])


def records_of(extracted: DataFrame) -> DataFrame:
    """The accepted pages as records."""
    return settled(with_record_defaults(extracted.where("ok").drop("ok", "source")))


def failures_of(extracted: DataFrame) -> DataFrame:
    """The rejected pages as links with the state for invalid ones."""
    keep = [c for c in ("page_id", "url", "source") if c in extracted.columns]
    return extracted.where(~F.col("ok")).select(
        *keep, F.lit(INVALID).alias("state"))


def heading_fields(pages: DataFrame) -> DataFrame:
    """``title`` and first ``h1`` of any page."""
    keep = _identity(pages)
    return pages.select(*keep, visible("html").alias("_doc")).select(
        *keep,
        F.coalesce(text_of(first_element("_doc", "title", open_tag("title"))), F.lit(""))
        .alias("title"),
        F.coalesce(text_of(first_element("_doc", "h1", open_tag("h1"))), F.lit(""))
        .alias("heading"),
    )
