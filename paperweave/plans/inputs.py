"""Inputs of the registered queries, derived from whole driver tables.

The tables hold no result or article pages of the three layouts, so those are
built from ``orders``: every order is one article, shown by one or all sites.
The pages carry the difficulties the readers must stand: nested elements,
decoys in comments and scripts, character references, missing marks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.functions.clean import normalise_records
from paperweave.functions.html import settled
from paperweave.operators.frontier import number
from paperweave.schema import LAYOUT_OF_SITE, SITES, with_record_defaults
from paperweave.session import spread

# Style attributes of layout A, written out so that a wrong one in the readers shows.
STYLE_TITLE = ("text-align:center; width:740px; font-size: 28px;color: #0000a0; "
               "font-weight:bold; font-family:'宋体';")
STYLE_AUTHORS = "text-align:center; width:740px; height:30px;"
STYLE_ABSTRACT = "text-align:left;word-break:break-all"
STYLE_INFO = "text-align:left;"
STYLE_SOURCE = "float:left;"

NUMBERS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]
_DECOY = ("<!-- <div style=\"float:left;\">《no》1年</div> <th><a href='no'></a></th> -->"
          "<script>var t=\"<div style='float:left;'>《no》</div></p>\";</script>"
          "<style>div{margin:0}</style>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill(text: str, **columns: Column | str) -> Column:
    """A template with ``{name}`` places as one concatenation."""
    pieces = re.split(r"\{(\w+)\}", text)
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2:
            value = columns.get(piece, piece)
            value = F.col(value) if isinstance(value, str) else value
            parts.append(value.cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


# ------------------------------------------------------------------ documents

def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: title is the first line, publication the source, abstract the rest."""
    site = pick(["cnki", "cqvip", "wanfang"], F.col("doc_id") % 3)
    return with_record_defaults(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("publication"),
        F.substr("text", F.length(F.substring_index("text", "\n", 1)) + 2).alias("abstract"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(
            (1990 + F.col("doc_id") % 30).cast("string")).alias("year"),
        fill("http://www.{site}.example/{doc_id}", site=site).alias("url"),
    ))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_records(raw_records(spark, sf_dir))


# --------------------------------------------------------------------- events

def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state changes: one link per user."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("url"),
        pick(list(SITES.values()), F.col("user_id") % 3).alias("source"),
        F.when(kind == "signup", 0).when(kind == "view", 10).when(kind == "purchase", 20)
        .when(kind == "error", -15).otherwise(-10).alias("state"),
        number(0, place=F.col("event_id")).alias("seq"),
    )


# ------------------------------------------------------------ hits of searches

def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per customer as the hits of one search, with the site's paging."""
    size = pick(["15", "10", "50"], F.col("o_custkey") % 3).cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.count(F.lit(1)) * 37).alias("total")
    ).select("o_custkey", "total", size.alias("size"))


def result_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First result page of every search in all three layouts."""
    heads = {
        "A": "<span title='a > b' class = page-sum>找到相关结果约{total}条</span>",
        "B": "<p>data\r\n {\"pages\":3,\"recordcount\": {total},\"x\":2}\r\n</p><p>2</p>",
        "C": "<div class=left_sidebar_border><b>9条结果</b><div>8条结果</div>共{total}条结果<i>1</i></div>",
    }
    base = hits(spark, sf_dir)
    pages = F.array(*[
        F.struct(F.lit(name).alias("layout"), fill(_DECOY + html).alias("html"))
        for name, html in heads.items()
    ])
    return base.select("o_custkey", F.explode(pages).alias("p")).select(
        F.col("o_custkey").alias("page_id"), "p.layout", "p.html")


# ------------------------------------------------------------- one article each

def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers all article pages are made of."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return spread(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate")).select(
        k.alias("k"), c.alias("c"), F.year("o_orderdate").alias("y"),
        (k % 12 + 1).alias("m"), pick(NUMBERS, k % 12).alias("cn"),
        fill("Study {c}", c=c).alias("title"),
        F.concat(fill("学报{p}", p=c % 10), F.when(k % 4 == 0, "增刊").otherwise("")).alias("pub"),
        F.concat(F.lit("http://www.cnki.example/"), k.cast("string"), F.lit(".htm")).alias("url_a"),
        F.concat(F.lit("http://www.cqvip.com/QK/"), k.cast("string"), F.lit("%22.html")).alias("url_b"),
        F.concat(F.lit("http://g.wanfangdata.com.cn/details/detail.do?_type=perio&id="),
                 k.cast("string")).alias("url_c"),
    )


def _html_a() -> Column:
    k, c = F.col("k"), F.col("c")
    title = F.when(k % 11 == 5, "<div>no title</div>").otherwise(
        fill(f"<div style=\"{STYLE_TITLE}\">{{title}}</div>"))
    abstract = F.when(k % 2 == 0, fill("【摘要】： text {k} <div>nested</div>\r\n end")).otherwise(
        fill("plain &lt;{k}&gt;"))
    fund = F.when(k % 5 == 0, "").otherwise(fill("【基金】：Fund {f}", f=k % 9))
    dated = (F.when(k % 11 == 6, "某年第3期").when(k % 6 == 1, "")
             .otherwise(fill("{y}年 第{cn}期")))
    return fill(
        f"<html>{_DECOY}<div class=\"main\">{{head}}"
        f"<div style='{STYLE_AUTHORS}'>Li &amp; {{c}}</div>"
        f"<div style=\"{STYLE_AUTHORS}\">, <b>Wang</b></div>"
        f"<div style=\"{STYLE_ABSTRACT}\">{{abstract}}</div>"
        f"<div style=\"{STYLE_INFO}\" class=\"xx_font big\">【作者单位】： Unit {{u}}\n{{fund}}【分类号】：T</div>"
        f"<div style=\"{STYLE_SOURCE}\">\t《{{pub}}》 {{dated}}\n</div></div></html>",
        head=title, abstract=abstract, u=c % 7, fund=fund, dated=dated)


def _html_b() -> Column:
    k, c = F.col("k"), F.col("c")
    head = F.when(k % 11 == 5, "<h2>no</h2>").otherwise(fill("<h1>{title}</h1>"))
    bar = F.when(k % 11 == 6, "/").otherwise("|")
    year = F.when(k % 6 == 1, " ").otherwise(fill("{y}年 "))
    issue = F.when(k % 11 == 7, "某期").otherwise(fill("第{cn}期"))
    return fill(
        f"<html>{_DECOY}<span class=\"f14 detailtitle\">{{head}}<strong>《{{pub}}》{{bar}}Li {{c}};Wang"
        "&nbsp;&#160;Unit {u}</strong></span>"
        "<table class=\"datainfo f14\"><tr><td>【作　者】：Li\n【摘　要】：abs {k}\n：tail</td></tr></table>"
        "<table class=\"datainfo f14\"><tr><td>【分　类】x【关键词】kw{w};\nk2【出　处】《{pub}》{year}{issue} "
        "{from}-{to}页,共4页\n【收　录】中国</td></tr></table></html>",
        head=head, bar=bar, u=c % 7, w=c % 5, year=year, issue=issue, to=k % 50 + 3,
        **{"from": k % 50})


TYPE_NAMES = ["期刊", "学位", "会议", "标准", "科技报告", "专利", "其他"]


def _row_c(label: str, value: Column | str, tag: str = "div") -> Column:
    value = fill(value) if isinstance(value, str) else value
    return F.concat(
        F.lit(f"<{tag} class=row><span class=\"info_left\">{label}</span><div class = info_right>"),
        value, F.lit(f"</div></{tag}>"))


def _html_c() -> Column:
    k, c = F.col("k"), F.col("c")
    kind = c % 7
    crumbs = F.when(k % 11 == 5, "<div>no</div>").otherwise(fill(
        "<div class=\"crumbs\">首页 &gt; {name}</div>", name=pick(TYPE_NAMES, kind)))
    authors = (
        F.when(kind == 0, fill("<input class=\"dw\" value=\"Li {c}\"/><input title='x > y' value = Wang class=dw>"))
        .when(kind == 1, fill("<a href=\"#\" id=\"card01\"><b>Li</b> {c}</a>"))
        .when(kind == 2, fill("<a class=\"info_right_name\">Li {c}</a><a class=\"info_right_name\">Zhao</a>"))
        .otherwise("<a>none</a>"))
    abstract = F.when(k % 9 == 0, "").otherwise(fill(
        "<div class=\"abstract\">\nabs {k}'s <div>in</div> end<span>摘要</span>rest</div>"))
    comma = F.when(k % 11 == 6, "").otherwise(",")
    by_kind = (
        F.when(kind == 0, F.concat(
            _row_c("刊名：", "\n{pub}\n"),
            _row_c("年，卷(期)：", fill("\n{y}{comma}{v}({m})\n", comma=comma, v=k % 30))))
        .when(kind == 1, F.concat(
            _row_c("学位授予单位：", fill("\nSchool {s}\n", s=c % 8)), _row_c("学位年度：", "{y}")))
        .when(kind == 2, _row_c("会议名称：", fill("\nConf {s}\n", s=c % 6)))
        .otherwise(""))
    rows = F.concat(
        F.lit("<ul>"), _row_c("doi：", "10.1/{k}", "li"), _row_c("备注：", "1-2", "li"), F.lit("</ul>"),
        F.when(k % 4 == 0, _row_c("doi：", "10.2/{k}")).otherwise(""),
        _row_c("关键词：", fill("\n\nkw{w}\n\nk2\n", w=c % 5)),
        _row_c("作者单位：", fill("\nUnit {u}\nDept\n", u=c % 7)),
        by_kind,
        F.when(k % 5 == 0, _row_c("在线出版日期：", F.lit("\r\n\t 2001年3月1日 "))).otherwise(""),
        _row_c("基金项目：", fill("\nFu'nd {f}\n", f=k % 9)),
        _row_c("页码：", fill("{p}-9", p=k % 8)))
    return fill(
        f"<html>{_DECOY}{{crumbs}}<font style=\"font-weight:bold;\">Stu'dy {{c}}</font>"
        "{authors}{abstract}<div class=\"info\">{rows}</div></html>",
        crumbs=crumbs, authors=authors, abstract=abstract, rows=rows)


_HTML = {"A": _html_a, "B": _html_b, "C": _html_c}


def _maybe_lost(html: Column) -> Column:
    """A few pages could not be fetched."""
    return F.when(F.col("k") % 97 == 3, F.lit(None).cast("string")).when(
        F.col("k") % 97 == 4, " \n").otherwise(html)


def detail_pages(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Every article as a page of one layout."""
    site = next(s for s, letter in LAYOUT_OF_SITE.items() if letter == layout)
    return settled(articles(spark, sf_dir).select(
        F.col("k").alias("page_id"), F.col(f"url_{layout.lower()}").alias("url"),
        _maybe_lost(_HTML[layout]()).alias("html"), F.lit(site).alias("source")))


def _by_site(**values: Column) -> Column:
    rest = F.col("k") % 3
    return F.when(rest == 0, values["a"]).when(rest == 1, values["b"]).otherwise(values["c"])


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article as a page of one of the three sites."""
    return settled(articles(spark, sf_dir).select(
        F.col("k").alias("page_id"),
        _by_site(a=F.col("url_a"), b=F.col("url_b"), c=F.col("url_c")).alias("url"),
        _maybe_lost(_by_site(a=_html_a(), b=_html_b(), c=_html_c())).alias("html"),
        pick(list(SITES.values()), F.col("k") % 3).alias("source")))


def _link(layout: str) -> Column:
    """One entry of a result page."""
    if layout == "A":
        return F.when(F.col("k") % 2 == 0, fill(
            "<div class = wz_content><h3><a title='a > b' target=_blank href = {url_a}>{title}</a></h3></div>")
        ).otherwise(fill("<div class=\"wz_content\"><h3><a target='_blank' href=\"{url_a}\">{title}</a></h3>"
                         "<a href='other'>x</a></div>"))
    if layout == "B":
        return fill("<th title=\"1 > 0\"><a href = 'QK\\/{k}\".html'>{title}</a></th>")
    return fill("<i title='>' class = \"icon icon_Miner\" onclick = \"show(this,'{k}','perio')\"></i>")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of all sites with at most ten links each.

    One article in thirteen is listed nowhere.
    """
    link = _by_site(a=_link("A"), b=_link("B"), c=_link("C"))
    listed = articles(spark, sf_dir).where("k % 13 <> 0").select(
        (F.floor(F.col("k") / 30) * 3 + F.col("k") % 3).alias("page_id"),
        F.struct("k", link.alias("html")).alias("entry"))
    return listed.groupBy("page_id").agg(
        F.array_sort(F.collect_list("entry")).alias("entries")
    ).select(
        "page_id",
        F.concat(F.lit("http://list.example/"), F.col("page_id").cast("string")).alias("url"),
        F.concat(F.lit(f"<html>{_DECOY}"),
                 F.array_join(F.transform("entries", lambda e: e["html"]), "\n"),
                 F.lit("</html>")).alias("html"),
        pick(list(SITES.values()), F.col("page_id") % 3).alias("source"))


def link_pages(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """One result page per order with up to four links, some of them absolute."""
    n = (F.col("o_custkey") % 5).cast("int")
    entry = {
        "A": "<div class=\"wz_content\"><div><h3><a href=\"http://a.example/{c}/{i}?x=1&amp;y=2\">"
             "t</a></h3></div><a href='no'>x</a></div>",
        "B": "<th><a href=\"{p}QK\\\\{c}\\/{i} a.html\">t</a></th>",
        "C": "<i class=\"icon icon_Miner\" onclick=\"f(x,'{c}_{i}','{t}')\"></i><i class=\"icon\" onclick=\"g\"></i>",
    }[layout]

    def one(i: Column) -> Column:
        return fill(entry, c="o_custkey", i=i, p=F.when(i == 3, "http://www.b.example/").otherwise(""),
                    t=F.when(i % 2 == 0, "perio").otherwise("degree"))

    entries = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(
        F.array().cast("array<string>"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).select(
        F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit(f"<html>{_DECOY}"), F.array_join(entries, "\n"), F.lit("</html>")).alias("html"))


# ------------------------------------------------------------------- criteria

def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search criteria from parts; some blank, some without any letter."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        fill("{p_name} 失谐/~*").alias("title"),
        F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("authors"),
        F.when(k % 4 == 0, "--").otherwise(F.col("p_type")).alias("keywords"),
        F.when(k % 5 == 0, " ").otherwise(fill("单位{p_size}")).alias("unit"),
        F.lit(1990).alias("starttime"), F.lit(2019).alias("endtime"),
        (F.col("p_size") % 3 + 1).cast("bigint").alias("n_pages"),
    )


# ------------------------------------------------------------------- numerals

def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities spelt in Chinese, with and without thousands."""
    q = F.col("l_quantity").cast("int")
    line = F.col("l_linenumber").cast("int")
    digit = lambda i: pick(["零", *NUMBERS[:9]], i)
    tens = F.floor(q / 10).cast("int")
    ones = F.when(q % 10 == 0, "").otherwise(digit(q % 10))
    small = (F.when(q < 10, digit(q)).when(q < 20, F.concat(F.lit("十"), ones))
             .otherwise(F.concat(digit(tens), F.lit("十"), ones)))
    after_thousand = F.concat(F.lit("零"), F.when(
        (q >= 10) & (q < 20), F.concat(F.lit("一"), small)).otherwise(small))
    large = F.concat(digit(line), F.lit("千"), after_thousand)
    year = F.year("l_shipdate").cast("string")
    return spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag")).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag",
        F.when(F.col("l_returnflag") == "N", small).otherwise(large).alias("spelt"),
        F.translate(year, "0123456789", "零一二三四五六七八九").alias("spelt_year"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts with every character the cleaning rule knows."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("\"a%b'c\td\re\u00a0f \n"), F.col("text"), F.lit("\t%22 '\r\n")).alias("text"))
