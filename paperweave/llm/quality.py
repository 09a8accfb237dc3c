"""Quality rules with adaptive thresholds, in DataFrame functions only.

Instead of a fixed cutoff, a document is held against the documents of its own
language and source. The values of every group are kept in a quantile sketch
that merges by addition: counts per bin, where a bin keeps the first two digits
of a whole number (an error of a tenth at most), so a group has at most some
hundred bins however many documents it has. Sketches are summed up before the
shuffle; groups with fewer than :data:`LEAST` documents use the sketch of their
language, or of all documents, made by merging. A value is out of bounds above
``q75 + REACH * max(q75 - q25, slack)``, or, for the length of words, also below
``q25 - REACH * ...``. Thresholds are joined back by language and source.

Defined cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; equal rows are judged alike;
texts are read whole; an empty table gives an empty result; other columns are
carried along, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.shared import stored

LEAST = 50       # documents of a group with thresholds of its own
REACH = 4        # spreads beyond the quartile
WINDOW = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[\x20\x09-\x0D]+"

#: Measure: whole-number expression, least spread, and whether small values are bad too.
MEASURES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", 10, False),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", 120, False),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", 65, False),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", 60, False),
    "word_length": ("100 * word_chars div greatest(n_words, 1)", 80, True),
}


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _repeated(tokens: Column) -> Column:
    """Number of words inside windows that occur twice or more."""
    def of_hashes(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1),
                           lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        return bound(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0))
                     .otherwise(bound(_places(r), _covered)))
    return F.when(F.size(tokens) < WINDOW, F.lit(0)).otherwise(
        bound(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes))


def _places(runs: Column) -> Column:
    """Sorted places of the runs that are not the only one of their kind."""
    order = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bound(order, lambda o: F.sort_array(F.transform(
        F.filter(F.transform(o, lambda x, j: F.struct(
            x["i"].alias("i"),
            (F.coalesce(F.get(o, j - 1)["h"] == x["h"], F.lit(False))
             | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
            lambda x: x["again"]), lambda x: x["i"])))


def _covered(places: Column) -> Column:
    """Words covered by windows at sorted ``places``."""
    return F.aggregate(
        F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    value = F.struct(
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.translate(body, UPPER, ""))).cast("long").alias("n_capitals"),
        bound(words(body), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        bound(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    names = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*[F.col(f"`{c}`") for c in rest], value.alias("__m")).select(
        *[F.col(f"`{c}`") for c in rest], "__m.w.n_words", "__m.word_chars", "__m.n_symbols", "__m.n_capitals",
        "__m.l.n_lines",
        "__m.l.n_dup_lines", "__m.w.n_repeat_words")


def _bin(value: Column) -> Column:
    """The number with all but its first two digits set to zero."""
    unit = F.pow(F.lit(10), F.greatest(F.length(value.cast("string")) - 2, F.lit(0))).cast("long")
    return (value - F.pmod(value, unit)).cast("long")


def sketches(values: DataFrame, *keys: str) -> DataFrame:
    """Counts per group, measure and bin: ``(keys, measure, bin, n)``."""
    return values.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """``(keys, measure, total, q25, q75)``, the bins that hold the lower and upper quartile."""
    group = Window.partitionBy(*keys, "measure")
    below = F.sum("n").over(group.orderBy("bin"))
    ranked = sketch.withColumn("below", below).withColumn("total", F.sum("n").over(group))
    return ranked.groupBy(*keys, "measure").agg(
        F.first("total").alias("total"),
        F.min(F.when(F.col("below") * 4 >= F.col("total"), F.col("bin"))).alias("q25"),
        F.min(F.when(F.col("below") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q75"))


def thresholds(documents: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bounds ``(lang, source, measure, low, high)`` of every group of measured documents."""
    each = documents.select(
        F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(e).cast("long").alias("value"))
                            for m, (e, *_) in MEASURES.items()])).alias("m"))
    own = stored(sketches(each.select("lang", "source", "m.measure", _bin(F.col("m.value")).alias("bin"),
                                      F.lit(1).cast("long").alias("n")), "lang", "source"), "sketches")
    by_lang = sketches(own, "lang")
    one, two, three = quartiles(own, "lang", "source"), quartiles(by_lang, "lang"), quartiles(sketches(by_lang))
    two = two.select(F.col("lang").alias("lang2"), F.col("measure").alias("measure2"),
                     F.struct("total", "q25", "q75").alias("two"))
    three = three.select(F.col("measure").alias("measure3"), F.struct("total", "q25", "q75").alias("three"))
    q = one.withColumn("one", F.struct("total", "q25", "q75")) \
        .join(two, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2"))) \
        .join(three, F.col("measure") == F.col("measure3")) \
        .select("lang", "source", "measure", F.when(F.col("one.total") >= LEAST, F.col("one"))
                .when(F.col("two.total") >= LEAST, F.col("two")).otherwise(F.col("three")).alias("q"))
    slack = F.create_map(*[x for m, (_, s, _) in MEASURES.items() for x in (F.lit(m), F.lit(s))])
    low = F.create_map(*[x for m, (*_, b) in MEASURES.items() for x in (F.lit(m), F.lit(b))])
    spread = REACH * F.greatest(F.col("q.q75") - F.col("q.q25"), slack[F.col("measure")])
    return q.select("lang", "source", "measure", F.when(low[F.col("measure")], F.col("q.q25") - spread).alias("low"),
                    (F.col("q.q75") + spread).alias("high"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents with their measures, ``base_failed``, ``failed`` (measures out of their group's
    bounds) and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]
    counted = measured(docs.select(*[F.col(f"`{c}`") for c in docs.columns
                                     if c not in (*names, "base_failed", "failed", "kept")]), text)
    counted = stored(counted.drop(text), "measures")
    limits = thresholds(counted, lang, source).groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("__limits")) \
        .withColumnsRenamed({"lang": "__lang", "source": "__source"})
    both = counted.join(stored(limits, "limits"), F.col(lang).eqNullSafe(F.col("__lang"))
                        & F.col(source).eqNullSafe(F.col("__source")), "left")
    out = [F.when((F.expr(e) > F.col("__limits")[m]["high"])
                  | F.coalesce(F.expr(e) < F.col("__limits")[m]["low"], F.lit(False)), F.lit(m))
           for m, (e, *_) in MEASURES.items()]
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return both.withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*out))) \
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)) \
        .drop("__limits", "__lang", "__source")
