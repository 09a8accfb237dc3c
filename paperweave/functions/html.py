"""Reading fixed anchors out of fetched pages with native expressions.

Spark has no HTML tree and ``xpath`` needs well-formed XML, but all anchors are
fixed tags with a fixed class, style or id. Elements are found by a pattern on
the opening tag; their end is found by counting opening and closing tags, so
nested elements of the same name are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.functions.containers import labelled

def _up_to(end: str) -> str:
    """Pattern of all that stands before a closing tag, or to the end of the page."""
    return rf"[^<]*+(?:<(?!{end})[^<]*+)*+"


_HIDDEN = (
    r"(?is)<(?:!--[^-]*+(?:-(?!->)[^-]*+)*+(?:-->|\z)"
    rf"|script\b{_up_to(r'/script\s*>')}(?:</script\s*>|\z)"
    rf"|style\b{_up_to(r'/style\s*>')}(?:</style\s*>|\z))"
)
# What stands in a tag after its name; a quoted value may hold ``>``.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TAG = rf"(?s)</?[a-zA-Z!?](?:{_REST}>|[^>]*>)"
# Names that are also read without ``;``.
_OPEN_ENDED = "amp|lt|gt|quot|nbsp|copy|reg|middot|times|laquo|raquo|deg|sect|para"
_REFERENCE = (r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9}(?=;)"
              rf"|(?:{_OPEN_ENDED})(?![a-zA-Z0-9]*;));?")
_CONTAINERS = "article|dd|div|dl|dt|li|ol|section|span|table|tbody|td|th|tr|ul"
_VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    Rules that mention their input several times would otherwise multiply the
    expression each time they are nested.
    """
    # a fold over nothing; an element of an array would ask the whole rule for its type on every row
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound_value, _: bound_value, use)


def settled(df: DataFrame) -> DataFrame:
    """The same rows with all columns computed at this point.

    A filter on a derived column is normally moved below the projection, which
    repeats the whole derivation inside the filter. It is not moved below a
    generator, so one generated row per input row keeps heavy columns single.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def visible(c: Column | str) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _HIDDEN, "")


def _until(pattern: str) -> str:
    """Pattern of all that stands before the next match of a pattern, or to the end.

    All matches begin with the same character, with which the pattern is written after its flags; only
    where it stands is a match looked for.
    """
    first = pattern.removeprefix("(?i)")[0]
    return rf"[^{first}]*+(?:(?!{pattern}){first}[^{first}]*+)*+"


def gaps(c: Column, pattern: str, found: Column, literal: bool = True) -> Column:
    """What stands between the matches ``found`` of a pattern: one more than there are matches.

    Like ``split``, which compiles its pattern for every row. ``literal`` tells that the pattern begins
    with a character that all its matches begin with.
    """
    gap = _until(pattern) if literal else ".*?"
    return F.slice(
        F.regexp_extract_all(c, F.lit(rf"(?s)({gap})(?:{pattern}|\z)"), F.lit(1)), F.lit(1), F.size(found) + 1)


def _ahead(attribute: str) -> str:
    """Pattern of what stands in a tag before an attribute, to the first place where it matches.

    Whole attributes are passed, so that nothing inside a quoted value counts.
    """
    return rf"""(?:[^>"'\s]++|"[^"]*+"|'[^']*+'|\s(?!{attribute}))*+\s{attribute}"""


def open_tag(tag: str, cls: str | None = None, **exact: str) -> str:
    """Pattern of an opening tag.

    ``cls`` is one word of the class list, ``exact`` are whole attribute values
    (``class_`` for the whole class attribute).
    """
    checks = ""
    if cls is not None:
        word = re.escape(cls)
        attribute = (rf"""class\s*=\s*(?:"(?:[^"]*\s)?{word}(?:\s[^"]*)?\""""
                     rf"""|'(?:[^']*\s)?{word}(?:\s[^']*)?'|{word}(?=[\s/>]))""")
        checks += f"(?={_ahead(attribute)})"
    for name, value in exact.items():
        value = re.escape(value)
        attribute = (rf"""{name.rstrip('_')}\s*=\s*(?:"{value}\""""
                     rf"""|'{value}'|{value}(?=[\s/>]))""")
        checks += f"(?={_ahead(attribute)})"
    return rf"(?i)<{tag}\b{checks}{_REST}>"


def _character(reference: Column) -> Column:
    """The character of a ``#123`` or ``#x7b`` reference."""
    hexadecimal = F.lower(F.substr(reference, F.lit(2), F.lit(1))) == "x"
    code = F.when(
        hexadecimal, F.conv(F.substr(reference, F.lit(3)), 16, 10)
    ).otherwise(F.substr(reference, F.lit(2))).try_cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    ).otherwise("�")


# name, equals sign, character; one entry per line
_NAMES = "\n".join(f"{name}={chr(code)}" for name, code in name2codepoint.items())


def _resolved(c: Column) -> Column:
    names = F.str_to_map(F.lit(_NAMES), F.lit("\n"), F.lit("="))

    def character(r: Column) -> Column:
        return F.when(r.startswith("#"), _character(r)).otherwise(
            F.coalesce(F.try_element_at(names, r), F.concat(F.lit("&"), r, F.lit(";"))))

    def joined(found: Column) -> Column:
        return F.array_join(F.zip_with(
            gaps(c, _REFERENCE, found), found,
            lambda gap, r: F.when(r.isNull(), gap).otherwise(F.concat(gap, character(r)))), "")

    return F.when(c.contains("&"), bound(
        F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(1)), joined)).otherwise(c)


def decode_references(c: Column) -> Column:
    """Resolve character references once, from left to right."""
    return bound(c, _resolved)


def text_of(c: Column) -> Column:
    """Text of a fragment: tags dropped, character references resolved."""
    return decode_references(F.regexp_replace(c, _TAG, ""))


def _closing_index(tags: Column, opened: Column) -> Column:
    """Index in ``tags`` (from 1) of the tag that closes tag ``opened``.

    One past the end when the element is never closed.
    """
    def step(s: Column, tag: Column) -> Column:
        depth = s["depth"] + F.when(tag.startswith("</"), -1).otherwise(1)
        return F.struct(
            depth.alias("depth"),
            (s["at"] + 1).alias("at"),
            F.when((s["found"] == 0) & (depth == 0), s["at"] + 1)
            .otherwise(s["found"]).alias("found"),
        )

    closes = lambda i: F.coalesce(F.get(tags, i - 1).startswith("</"), F.lit(False))
    counted = F.aggregate(
        F.slice(tags, opened + 1, F.size(tags)),
        F.struct(F.lit(1).alias("depth"), opened.alias("at"), F.lit(0).alias("found")),
        step,
        lambda s: F.when(s["found"] > 0, s["found"]).otherwise(F.size(tags) + 1),
    )
    # most elements hold no other, or just one
    return (
        F.when(closes(opened + 1), opened + 1)
        .when(closes(opened + 2) & closes(opened + 3), opened + 3)
        .otherwise(counted)
    )


def _between_tags(texts: Column, opened: Column, closed: Column) -> Column:
    return F.array_join(F.slice(texts, opened + 1, closed - opened), "")


def _element_body(start: Column, tag: str, rest: Column) -> Column:
    """What belongs to an element, given it up to before the first closing tag of its name, and the page
    from its opening tag on, which is read only when elements of that name are nested.

    Tags of the same name are dropped from the result, other tags stay.
    """
    any_tag = rf"(?i)</?{tag}\b{_REST}>"
    up_to_close = rf"(?i)^<{_REST}>({_up_to(rf'/{tag}\s*>')})"

    def body(page: Column) -> Column:
        head = F.regexp_extract(page, up_to_close, 1)
        return bound(head, lambda h: F.when(h.rlike(rf"(?i)<{tag}\b"), bound(rest, nested)).otherwise(h))

    def nested(page: Column) -> Column:
        tags = F.regexp_extract_all(page, F.lit(any_tag), F.lit(0))
        return bound(tags, lambda found: _between_tags(
            gaps(page, any_tag, found), F.lit(1), _closing_index(found, F.lit(1))))

    return bound(start, body)


def first_element(page: Column | str, tag: str, opening: str) -> Column:
    """Body of the first element whose opening tag matches; NULL when none."""
    page = F.col(page) if isinstance(page, str) else page
    start = F.regexp_extract(page, opening + _up_to(rf"/{tag}\s*>"), 0)
    return _element_body(
        F.nullif(start, F.lit("")), tag, F.regexp_extract(page, f"{opening}(?s).*", 0))


def all_elements(page: Column | str, tag: str, opening: str) -> Column:
    """Bodies of all matching elements that do not contain one another."""
    page = F.col(page) if isinstance(page, str) else page
    rests = F.regexp_extract_all(page, F.lit(rf"{opening}({_until(opening)})"), F.lit(1))

    def body(rest: Column) -> Column:
        whole = F.concat(F.lit(f"<{tag}>"), rest)
        return _element_body(whole, tag, whole)

    return F.transform(rests, body)


def attributes(page: Column | str, opening: str, name: str) -> Column:
    """Value of one attribute for every matching opening tag that has it."""
    page = F.col(page) if isinstance(page, str) else page
    written = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
    before = rf"{name}\s*=\s*"
    pattern = rf"(?is)^<{_ahead(f'{before}(?={written})')}({written})"
    # with its quotes, so a value is never blank
    values = F.filter(
        F.transform(F.regexp_extract_all(page, F.lit(opening), F.lit(0)), lambda t: F.regexp_extract(t, pattern, 1)),
        lambda v: v != "")
    quoted = lambda v: v.startswith('"') | v.startswith("'")
    return F.transform(values, lambda v: decode_references(
        F.when(quoted(v), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v)))


def first_attribute(fragment: Column, tag: str, name: str) -> Column:
    """Attribute of the first ``tag`` that has it inside a fragment."""
    return F.get(attributes(fragment, rf"(?i)<{tag}\b{_REST}>", name), F.lit(0))


def labelled_values(page: Column | str, opening: str) -> Column:
    """(label, value) for every matching ``div``.

    The label is the whole text of the element around it, of whatever container
    tag, or of the page when there is none; the value is its own text.
    """
    page = F.col(page) if isinstance(page, str) else page
    found = labelled(page, rf"(?i)(</?(?:{_CONTAINERS})\b{_REST}>)", opening, _TAG)
    return F.transform(found, lambda pair: F.struct(
        decode_references(pair["label"]).alias("label"), decode_references(pair["value"]).alias("value")))


def direct_texts(page: Column | str, opening: str) -> Column:
    """Pieces of text that stand directly in the first matching element, not in a child of it."""
    page = F.col(page) if isinstance(page, str) else page
    any_tag = rf"(?is)</?[a-z]{_REST}>"
    rest = F.nullif(F.regexp_extract(page, f"{opening}(?s)(.*)", 1), F.lit(""))

    def pieces(inner: Column) -> Column:
        tags = F.concat(F.array(F.lit("")), F.regexp_extract_all(inner, F.lit(any_tag), F.lit(0)))
        both = F.zip_with(tags, F.split(inner, any_tag, -1),
                          lambda tag, gap: F.struct(tag.alias("tag"), gap.alias("gap")))

        def step(s: Column, x: Column) -> Column:
            tag = x["tag"]
            alone = (tag == "") | tag.rlike(rf"(?i)^<(?:{_VOID})\b|/>$")
            depth = s["depth"] + F.when(alone, 0).when(tag.startswith("</"), -1).otherwise(1)
            over = s["over"] | (depth < 0)
            return F.struct(
                depth.alias("depth"), over.alias("over"),
                F.when(~over & (depth == 0), F.concat(s["texts"], F.array(x["gap"])))
                .otherwise(s["texts"]).alias("texts"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("over"),
                         F.array().cast("array<string>").alias("texts"))
        return F.aggregate(both, start, step, lambda s: s["texts"])

    return bound(rest, pieces)
