"""Column rules of the normalisation job. All stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.schema import RECORD_FIELDS

NBSP = "\u00a0"

# Text in an address -> source name, later rows win.
SOURCE_MARKS = ["cqvip", "cnki", "wanfang"]

# Characters that are exchanged, and characters that are dropped.
EXCHANGED = {'"': "#", "%": ">", "'": "^"}
DROPPED = "\n\t\r" + NBSP


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_special(c: Column | str) -> Column:
    """Keep Chinese characters, ASCII letters, digits, ``.`` and ``^``."""
    return F.regexp_replace(_col(c), "[^一-龥.^a-zA-Z0-9]", "")


def is_nonblank(c: Column | str) -> Column:
    """True when something is left after ``strip_special``."""
    return strip_special(F.coalesce(_col(c), F.lit(""))) != ""


def clean_value(c: Column | str) -> Column:
    """Exchange quote and percent characters, drop line ends, TAB and NBSP."""
    return F.translate(
        _col(c), "".join(EXCHANGED) + DROPPED, "".join(EXCHANGED.values())
    )


def strip_guillemets(c: Column | str) -> Column:
    return F.translate(_col(c), "《》", "")


def restore_url(c: Column | str) -> Column:
    """Undo the percent exchange in an address (lossy: a real ``>`` changes)."""
    return F.translate(_col(c), ">", "%")


def source_of_url(c: Column | str) -> Column:
    """Source name found in an address; the last mark that matches wins."""
    return reduce(
        lambda other, mark: F.when(_col(c).contains(mark), mark).otherwise(other),
        SOURCE_MARKS,
        F.lit(""),
    )


def between(c: Column | str, start: str, end: str) -> Column:
    """Text after the first ``start`` up to the first ``end``.

    Without ``start`` the text begins at its first character. Without ``end``
    only the last character is cut. ``''`` when ``end`` comes first.
    """
    c = _col(c)
    skip = F.instr(c, start)
    stop = F.instr(c, end)
    length = F.when(stop > 0, stop - 1).otherwise(F.length(c) - 1) - skip
    return F.substr(c, skip + 1, F.greatest(length, F.lit(0)))


def squeeze(c: Column | str, tabs: bool = False) -> Column:
    """Drop CR, LF and space (and TAB on request); NBSP stays."""
    return F.translate(_col(c), "\r\n " + ("\t" if tabs else ""), "")


def first_digits(c: Column | str) -> Column:
    """The first run of digits, or ``''``."""
    return F.regexp_extract(_col(c), r"\p{Nd}+", 0)


def digits_before(c: Column | str, unit: str) -> Column:
    """The first run of digits directly before ``unit``, or ``''``."""
    return F.regexp_extract(_col(c), rf"(\p{{Nd}}+){unit}", 1)


def percent_quote(c: Column | str) -> Column:
    """Percent-encode as UTF-8 with ``/`` left as it is and space as ``%20``."""
    quoted = F.url_encode(_col(c))
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(found), F.lit(wanted))
    return quoted


def after(c: Column | str, mark: str) -> Column:
    """Text after the first ``mark``; NULL when the mark is missing."""
    c = _col(c)
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark)))


def before(c: Column | str, mark: str) -> Column:
    """Text before the first ``mark``, or all of it when the mark is missing."""
    return F.substring_index(_col(c), mark, 1)


def section(c: Column | str, start: str, end: str) -> Column:
    """Text between two markers; ``''`` when the first is missing.

    A repeated start marker also ends the section.
    """
    return F.coalesce(before(before(after(c, start), start), end), F.lit(""))


def trim_lines(c: Column | str) -> Column:
    """Drop line feeds at both ends."""
    return F.trim(_col(c), F.lit("\n"))


def join_values(c: Column) -> Column:
    """Join an array with ``;`` and drop ``;`` at the end."""
    return F.rtrim(F.array_join(c, ";"), F.lit(";"))


def join_lines(c: Column | str) -> Column:
    """Turn the lines of a text into a ``;`` list."""
    return F.replace(trim_lines(c), F.lit("\n"), F.lit(";"))


def normalise_records(records: DataFrame) -> DataFrame:
    """Clean every field, set ``source``, and keep the fetched address.

    ``raw_url`` carries the address as fetched, because the cleaned one cannot
    be restored for certain and the frontier is keyed by the fetched one.
    """
    raw = "raw_url" if "raw_url" in records.columns else "url"
    cleaned = {name: clean_value(name) for name in RECORD_FIELDS}
    cleaned["publication"] = strip_guillemets(cleaned["publication"])
    cleaned["raw_url"] = F.col(raw)
    cleaned["source"] = source_of_url(cleaned["url"])
    return records.withColumns(cleaned)
