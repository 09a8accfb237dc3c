"""Elements around and in the labelled values of a page, in one walk over its tags.

The element around a value is known only after all tags before it. Expressions can
walk over the tags once per value, or carry arrays along that are copied at every
tag; both cost far more than the rest of a page. So this one walk, over pages that
come by Arrow batches, keeps a stack of open elements. It does nothing else: labels
and values are told apart and read by expressions.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VALUES = "array<struct<label:string,value:string>>"


def pairs(page: str, container: re.Pattern, opening: re.Pattern, tag: re.Pattern,
          known: dict[str, bool]) -> list[tuple[str, str]]:
    """Text of the element around each matching one, or of the page, and its own.

    ``container`` has one group, the whole tag; ``known`` remembers which tags match ``opening``.
    """
    pieces = container.split(page)
    gaps, found, stack = pieces[::2], [], []
    close: dict[int, int] = {}  # of the tags that open an element: tag that closes it
    for n, written in enumerate(pieces[1::2], 1):
        if written[1] == "/":
            if stack:
                close[stack.pop()] = n
            continue
        matches = known.get(written)
        if matches is None:
            matches = known[written] = opening.match(written) is not None
        if matches:
            found.append((stack[-1] if stack else 0, n))
        stack.append(n)
    end = len(gaps)  # of what is never closed

    def text(n: int) -> str:
        inner = "".join(gaps[n:close.get(n, end)])
        return tag.sub("", inner) if "<" in inner else inner

    return [(text(around), text(n)) for around, n in found]


def labelled(page: Column, container: str, opening: str, tag: str) -> Column:
    """:func:`pairs` of every page, NULL for NULL; the patterns tell containers, what is looked for,
    and tags that are dropped."""
    container, opening, tag = re.compile(container), re.compile(opening), re.compile(tag)

    @F.arrow_udf(VALUES)
    def walk(pages: pa.Array) -> pa.Array:
        known: dict[str, bool] = {}  # of this batch
        labels, values, starts = [], [], []
        for page in pages.to_pylist():
            starts.append(None if page is None else len(labels))
            if page is not None:
                for label, value in pairs(page, container, opening, tag, known):
                    labels.append(label)
                    values.append(value)
        texts = pa.StructArray.from_arrays(
            [pa.array(labels, pa.string()), pa.array(values, pa.string())], ["label", "value"])
        return pa.ListArray.from_arrays(pa.array([*starts, len(labels)], pa.int32()), texts)

    return walk(page)
