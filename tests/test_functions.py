"""Golden values of the column rules, always over a table."""

import random
import re
import time
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from paperweave.functions import clean, html, numerals


def column(spark, values, rule):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    out = rows.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in out]


NUMBERS = {"十": 10, "十三": 13, "二十": 20, "一百零五": 105, "一万二千": 12000, "二十万": 200000}


def test_numbers(spark):
    assert column(spark, NUMBERS, numerals.compat_number) == list(NUMBERS.values())
    assert column(spark, NUMBERS, numerals.strict_number) == list(NUMBERS.values())


def test_number_quirks(spark):
    quirks = {"十万": (0, 100000), "一九九五": (24, 1995), "二零一八": (11, 2018),
              "三百二十万五千": (30205000, 3205000), "三百二十万": (30200000, 3200000)}
    assert column(spark, quirks, numerals.compat_number) == [a for a, _ in quirks.values()]
    assert column(spark, quirks, numerals.strict_number) == [b for _, b in quirks.values()]


def test_numbers_in_text(spark):
    cases = {"第十三期": "第13期", "零五": "零5", "百家": "百家", "": "", "a五十b二十c": "a50b20c",
             "无数": "无数", "九" + "亿" * 5: "9" + "0" * 40, "九亿九" + "亿" * 5: "9" + "0" * 7 + "9" + "0" * 40,
             "九九" + "亿" * 6: "18" + "0" * 48}
    assert column(spark, cases, numerals.replace_numbers) == list(cases.values())


def test_between(spark):
    cases = {"a(b)c": "b", "abc": "ab", "a(bc": "b", ")a(": "", "": ""}
    assert column(spark, cases, lambda c: clean.between(c, "(", ")")) == list(cases.values())


def test_value_rules(spark):
    assert column(spark, ["a-b.c^1 中《文》"], clean.strip_special) == ["ab.c^1中文"]
    assert column(spark, ["a\"b%c'd\n\t\r e"], clean.clean_value) == ["a#b>c^de"]
    assert column(spark, ["http://h/>22x"], clean.restore_url) == ["http://h/%22x"]
    assert column(spark, ["x/cnki/wanfang", "none", "CNKI", "cqvip cnki"], clean.source_of_url) == [
        "wanfang", "", "", "cnki"]
    assert column(spark, ["--", " a", None], clean.is_nonblank) == [False, True, False]
    assert column(spark, ["a \r\n\t b"], clean.squeeze) == ["a\t b"]
    assert column(spark, ["\n\na\nb\n"], clean.join_lines) == ["a;b"]
    assert column(spark, ["卷7 第12期"], lambda c: clean.digits_before(c, "期")) == ["12"]


def test_section(spark):
    cases = {"x单位】：A【y": "A", "x": "", "单位】：A单位】：B": "A", "单位】：A": "A"}
    assert column(spark, cases, lambda c: clean.section(c, "单位】：", "【")) == list(cases.values())


def test_percent_quote(spark):
    values = ["a b/c~*+é%", "失谐 & = ?", "", "x-_.~"]
    assert column(spark, values, clean.percent_quote) == [quote(v) for v in values]


def usual_value(run):
    """The strict rules, with Python's numbers."""
    units = {"十": 1, "百": 2, "千": 3, "万": 4, "亿": 8}
    if not set(run) & set(units):
        return int("".join(str(numerals.DIGITS[ch]) for ch in run))
    total = group = digit = 0
    for ch in run:
        power = units.get(ch)
        if power is None:
            digit = numerals.DIGITS[ch]
            continue
        if power < 4:
            group += max(digit, 1) * 10 ** power
        else:
            group += digit
            total = (total + group) * 10 ** 8 if power == 8 else total + group * 10 ** 4
            group = 0
        digit = 0
    return total + group + digit


def test_strict_numbers_of_any_length(spark):
    rng = random.Random(9)
    runs = ["十", "一亿亿亿亿亿亿", "九" * 50, "三千亿亿亿亿亿二十万零五", "千" * 60, "一" + "零" * 45 + "亿"]
    for n in [3, 12, 40] * 30:
        runs.append(rng.choice("一二两九十") + "".join(rng.choice("零一二九十百千万亿") for _ in range(n)))
    assert column(spark, runs, numerals.strict_text) == [str(usual_value(run)) for run in runs]
    # the digits are those of the number wherever that has room
    terms = column(spark, runs, lambda c: html.bound(numerals._strict_terms(c), numerals._written))
    assert [t for t, run in zip(terms, runs) if set(run) & set("十百千万亿")] == [
        str(usual_value(run)) for run in runs if set(run) & set("十百千万亿")]
    long = "九" * 50
    assert column(spark, [f"第{long}期"], lambda c: numerals.replace_numbers(c, strict=True)) == ["第" + "9" * 50 + "期"]


@pytest.mark.parametrize("page,wanted", [
    ('<div class="y">a</div>', "a"),
    ("<div class='k y z'>a<div>b</div>c</div>d", "abc"),
    ('<div class=y>a', "a"),
    ('<!-- <div class="y">no</div> --><div class="y">a&amp;lt;&#20013;&#x6587;&bogus;</div>',
     "a&lt;中文&bogus;"),
    ('<script>"<div class=\'y\'>no</div>"</script><DIV CLASS="y"><b>a</b> &lt; 2</DIV>', "a < 2"),
    ('<div class="yy">a</div>', None),
    ('<div class="y"></div>', ""),
    ('<div class="y">' + "x" * 50_000 + "<div>y</div>" * 300 + "</div>z", "x" * 50_000 + "y" * 300),
])
def test_first_element(spark, page, wanted):
    rule = lambda c: html.text_of(html.first_element(
        html.visible(c), "div", html.open_tag("div", cls="y")))
    assert column(spark, [page], rule) == [wanted]


def plain_pairs(page):
    """Labels and values by looking for the ends of every element anew."""
    tags = list(re.finditer(r"</?(?:div|span)[^>]*>", page))
    gaps = re.split(r"</?(?:div|span)[^>]*>", page)
    out = []
    for i, tag in enumerate(tags):
        if tag[0] != "<div class='v'>":
            continue
        def end(k):
            depth = 0
            for j in range(k, len(tags)):
                depth += -1 if tags[j][0].startswith("</") else 1
                if depth == 0:
                    return j
            return len(tags)
        depth, outer = 0, None
        for j in range(i - 1, -1, -1):
            if not tags[j][0].startswith("</") and depth == 0:
                outer = j
                break
            depth += 1 if tags[j][0].startswith("</") else -1
        around = "".join(gaps if outer is None else gaps[outer + 1:end(outer) + 1])
        out.append((around, "".join(gaps[i + 1:end(i) + 1])))
    return out


def test_labelled_values_of_broken_pages(spark):
    rng = random.Random(11)
    pages = ["", "x", "<div class='v'>"]
    for _ in range(80):
        pieces = ["<div>", "<div class='v'>", "<span>", "</div>", "</span>", "t", "u "]
        pages.append("".join(rng.choice(pieces) for _ in range(rng.choice([5, 30, 200]))))
    found = column(spark, [*pages, None], lambda c: html.labelled_values(c, html.open_tag("div", cls="v")))
    assert [None if v is None else [tuple(p) for p in v] for v in found] == [*map(plain_pairs, pages), None]


def test_large_pages_cost_as_much_as_their_tags(spark):
    def seconds(n):
        row = "<div><span>L</span><div class='v'>x</div></div>"  # six tags
        df = spark.createDataFrame([(row * (n // 6),)] * 4, "page string").repartition(1).cache()
        df.count()
        values = html.labelled_values("page", html.open_tag("div", cls="v"))
        took = []
        for _ in range(2):
            start = time.perf_counter()
            assert df.select(F.size(F.filter(values, lambda v: v["label"] == "Lx"))).first()[0] == n // 6
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(20_000) < 8 * seconds(5_000) + 1


def test_labelled_values(spark):
    page = ("<div>top<div class='row'><span>L1：</span><div class='v'>a<div>b</div></div></div>"
            "<div class='row'>L2：<div class='v'>c</div><div class='v'>d</div></div></div>")
    got = column(spark, [page], lambda c: html.labelled_values(c, html.open_tag("div", cls="v")))
    assert [tuple(p) for p in got[0]] == [("L1：ab", "ab"), ("L2：cd", "c"), ("L2：cd", "d")]
