"""Search criteria over merged records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.operators.frontier import mark
from paperweave.schema import WRONG_DATE

# The default year range.
FIRST_YEAR, LAST_YEAR = 1990, 2019

_SPECIAL = re.compile("[^一-龥.^a-zA-Z0-9]")


def matches(title: str = "", authors: str = "", keywords: str = "", unit: str = "") -> Column:
    """All given criteria are contained in their field, ignoring case.

    A criterion without any letter, digit or Chinese character is skipped.
    """
    found = F.lit(True)
    for name, text in wanted_texts(title=title, authors=authors, keywords=keywords, unit=unit).items():
        found = found & F.lower(name).contains(text)
    return found


def year_in_range(first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """The year lies in the range; NULL when it is not a number."""
    return F.col("year").try_cast("int").between(first, last)


#: Number of a year, blank for what is none; kept in tables that are read by year.
YEAR_NUMBER = "year_number"


def by_year(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Records in ranges of years, each in order, with the year as a number; to be written as they are.

    Statistics of files and row groups then tell which years they hold. The address
    cuts a year that is as large as others together. ``parts`` is the number of files.
    """
    spot = F.xxhash64("url") if "url" in records.columns else F.xxhash64(*records.columns)
    return records.withColumns({YEAR_NUMBER: F.col("year").try_cast("int"), "_spot": spot}).repartitionByRange(
        *([] if parts is None else [parts]), YEAR_NUMBER, "_spot").sortWithinPartitions(YEAR_NUMBER, "_spot").drop("_spot")


def between_years(records: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Records of a table written :func:`by_year` that lie in the range; the scan skips the others."""
    return records.where(F.col(YEAR_NUMBER).between(first, last)).drop(YEAR_NUMBER)


def wanted_texts(**criteria: str) -> dict[str, str]:
    """Field and text in lower case of the criteria that are not skipped."""
    return {name: text.lower() for name, text in criteria.items() if _SPECIAL.sub("", text) != ""}


def search(records: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, **criteria: str) -> DataFrame:
    return records.where(matches(**criteria) & year_in_range(first, last))


def wrong_dates(frontier: DataFrame, records: DataFrame, seq: Column,
                first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """Transitions for links whose record has a year outside the range.

    Records without a readable year are left alone.
    """
    outside = records.where(~year_in_range(first, last))
    return mark(frontier, outside.select(F.col("raw_url").alias("url")), WRONG_DATE, seq)
