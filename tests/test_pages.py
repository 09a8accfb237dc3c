"""Reading result and article pages; rejection of broken ones."""

import pytest
from pyspark.sql import functions as F

from paperweave.operators import detail, listing

PAGES = "page_id long, url string, html string, source string"


def a_page(title=True, abstract="【摘要】：x", info="【作者单位】：U【基金】：F【", source="《J》2001年第三期"):
    head = f"<div style=\"{detail.STYLE_TITLE}\">T</div>" if title else ""
    block = lambda style, text, more="": (
        "" if text is None else f"<div style=\"{style}\"{more}>{text}</div>")
    return (head + block(detail.STYLE_AUTHORS, "A1") + block(detail.STYLE_AUTHORS, "A2")
            + block(detail.STYLE_ABSTRACT, abstract)
            + block(detail.STYLE_INFO, info, " class='xx_font'") + block(detail.STYLE_SOURCE, source))


def extract_one(spark, html, reader, **options):
    df = spark.createDataFrame([(1, "u", html, "s")], PAGES)
    return reader(df, **options).first()


def test_layout_a(spark):
    row = extract_one(spark, a_page(), detail.extract_a)
    assert row["ok"]
    assert (row["title"], row["authors"], row["abstract"], row["unit"], row["sponser"]) == (
        "T", "A1A2", "x", "U", "F")
    assert (row["publication"], row["year"], row["issue"]) == ("《J》", "2001", "3")
    assert (row["keywords"], row["doi"], row["type"]) == ("", "", "")


def test_layout_a_numbers_in_publication(spark):
    page = a_page(source="《第一文》二年第三期")
    assert extract_one(spark, page, detail.extract_a)["publication"] == "《第一文》"
    row = extract_one(spark, page, detail.extract_a, numbers_first=True)
    assert (row["publication"], row["year"]) == ("《第1文》", "2")


@pytest.mark.parametrize("broken", [
    dict(title=False), dict(abstract=None), dict(info=None), dict(source=None),
    dict(source="《J 2001年"), dict(source="某年"), dict(source="某期"),
])
def test_layout_a_rejects(spark, broken):
    assert not extract_one(spark, a_page(**broken), detail.extract_a)["ok"]


def b_page(h1="<h1>T</h1>", line="《J》|A&nbsp;&nbsp;U", first="x：y：z：w",
           second="【关键词】k【出　处】《J》2001年 第3期 5-6页,共2页【收　录】c"):
    tables = "".join(f"<table><tr><td>{t}</td></tr></table>" for t in (first, second) if t is not None)
    return f"<span class='detailtitle'>{h1}<strong>{line}</strong></span>{tables}"


def test_layout_b(spark):
    row = extract_one(spark, b_page(), detail.extract_b)
    assert row["ok"]
    assert [row[c] for c in ("title", "publication", "authors", "unit", "abstract", "keywords",
                             "year", "issue", "pagecode")] == [
        "T", "《J》", "A", "U", "z", "k", "2001", "3", "5-6"]


@pytest.mark.parametrize("broken", [
    dict(h1=""), dict(line="《J》A&nbsp;&nbsp;U"), dict(line="《J》|A U"), dict(line="J|A&nbsp;&nbsp;U"),
    dict(first="x：y"), dict(second=None), dict(second="【出　处】《J》"), dict(second="【关键词】k"),
    dict(second="【关键词】k【出　处】某年"), dict(second="【关键词】k【出　处】某期"),
])
def test_layout_b_rejects(spark, broken):
    assert not extract_one(spark, b_page(**broken), detail.extract_b)["ok"]


def c_page(crumbs="首页 期刊", rows="", title="<font style='font-weight:bold;'>It's</font>",
           abstract="<div class='abstract'>\na'b摘要c</div>", authors=""):
    trail = "" if crumbs is None else f"<div class='crumbs'>{crumbs}</div>"
    return trail + title + abstract + authors + rows


def c_row(label, value):
    return f"<div><span>{label}</span><div class='info_right'>{value}</div></div>"


def test_layout_c_last_label_wins(spark):
    rows = (c_row("作者单位：", "\nU\nV\n") + c_row("学位授予单位：", "\nS\n") + c_row("年，卷(期)：", "\n1999,2(3)\n")
            + c_row("在线出版日期：", "\r\n\t 2001年1月 ") + c_row("刊名：", "\nJ'x\n") + c_row("Author 作者单位", "no"))
    row = extract_one(spark, c_page(rows=rows), detail.extract_c)
    assert row["ok"]
    assert [row[c] for c in ("title", "abstract", "unit", "publication", "year", "volume", "issue",
                             "type")] == ["Its", "ab", "S", "Jx", "2001", "2", "3", "J"]


def test_layout_c_rejects(spark):
    ok = lambda html, **o: extract_one(spark, html, detail.extract_c, **o)["ok"]
    assert not ok(c_page(crumbs=None))
    assert not ok(c_page(title=""))
    assert not ok(c_page(rows=c_row("年，卷(期)：", "1999")))
    assert not ok(c_page(crumbs="学位"))
    assert ok(c_page(crumbs="学位", authors="<a id='card01'>A</a>"))
    assert ok(c_page(abstract="")) and not ok(c_page(abstract=""), require_abstract=True)


def test_type_first_match(spark):
    texts = ["专利 标准", "科技报告", "x", "会议 期刊"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(detail.literature_type(F.col("t"))).collect()]
    assert got == ["S", "R", "Z", "J"]


def test_dispatch(spark):
    assert detail.chosen_sites("13") == ["Cnki", "Wanfang"]
    pages = spark.createDataFrame([
        (1, "u1", a_page(), "Cnki"), (2, "u2", b_page(), "Cqvip"), (3, "u3", c_page(), "Wanfang"),
        (4, "u4", "<p>", "Cqvip")], PAGES)
    parsed = detail.extract(pages, "12")
    assert sorted(r["page_id"] for r in detail.records_of(parsed).collect()) == [1, 2]
    assert [tuple(r) for r in detail.failures_of(parsed).collect()] == [(4, "u4", "Cqvip", -15)]


def test_hit_counts(spark):
    cases = {
        "A": ("<span class='page-sum'>找到相关结果约1234条</span>", 1234),
        "B": ('<p>a\r\n{"recordcount": 56 ,"x":1}\r\n</p>', 56),
        "C": ("<div class='left_sidebar_border'><b>1</b>共3.5条结果<i></i>共78条结果</div>", 78),
    }
    for layout, (page, wanted) in cases.items():
        df = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
        got = [r[0] for r in df.select(listing.hit_count("html", layout)).collect()]
        assert got == [wanted, None]


def test_page_plan_is_never_counted_down(spark):
    df = spark.createDataFrame([(30,), (0,)], "n_pages long")
    assert listing.page_plan(df, 31).count() == 0
    assert listing.page_plan(df, 29).count() == 2
    assert listing.page_plan(df, 29, inclusive=False).count() == 1


def test_links(spark):
    pages = spark.createDataFrame([
        (1, "<div class='wz_content'><p></p><a href='a1'>x</a><a href='a2'></a></div><div class='wz_content'></div>"
            "<th><a href='\\/p q'>t</a></th><th><a href='http://www.x'>t</a></th><th><a href='http://y'></a></th>"
            "<i class='icon icon_Miner' onclick=\"f(x,'id1','perio')\"></i><i class='icon_Miner' onclick='g'></i>"),
    ], "page_id long, html string")
    urls = lambda layout: [r["url"] for r in listing.extract_links(pages, layout).collect()]
    assert urls("A") == ["a1"]
    assert urls("B") == [listing.DETAIL_B + "/p%20q", listing.DETAIL_B + "http%3A//y"]
    assert urls("C") == [listing.DETAIL_C + "perio&id=id1"]
