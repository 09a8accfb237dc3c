"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of :data:`WINDOW` words (a shorter item is
one window). A window is contained in a document if all its shingles are, so a
single shingle is the necessary prefix: the rarest one, by its number of
occurrences in the documents. Windows with a shingle that no document has are
dropped. Document positions with a prefix shingle give the only start a window
can have (positional bound), which must leave room for its length; there the
words are compared exactly.

Documents are never shuffled: their positions meet the prefix shingles in a
broadcast table where it is small, else after a bitmap of 2 MB.

Defined cases: null and empty texts have no words and are clean; items without
words, a null text or a null id have no window; repeated items and windows
count once; rows with one id and different texts are judged each, those without
an id too; equal rows give equal results; an empty benchmark leaves every document clean; other
columns are not read by the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.shared import BROADCAST_ROWS, id_filter, possible, stored

WINDOW = 13
SHINGLE = 3
BROADCAST_LETTERS = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN), "")


def _positions(tokens: DataFrame, size: int) -> DataFrame:
    """``tokens (..., words)`` with every position ``at`` and the hash ``shingle`` of the words there."""
    out = tokens.select("*", F.posexplode("words").alias("at", "word"))
    more = [F.get("words", F.col("at") + i) for i in range(1, size)]
    return out.where(F.col("at") + size <= F.size("words")) \
        .withColumn("shingle", F.xxhash64(F.lit(size), "word", *more)).drop("word")


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(window, words)`` and which items have them ``(window, item)``."""
    tokens = items.select(F.col(id).cast("string").alias("item"), words(F.col(text)).alias("all")) \
        .where(F.col("item").isNotNull() & (F.size("all") > 0))
    length = F.least(F.size("all"), F.lit(WINDOW))
    cut = tokens.select("item", "all", F.explode(F.sequence(F.lit(1), F.size("all") - length + 1)).alias("at")) \
        .select("item", F.slice("all", F.col("at"), F.least(F.size("all"), F.lit(WINDOW))).alias("words"))
    owned = stored(cut.distinct().withColumn("window", F.concat_ws(" ", "words")), "windows")
    return owned.select("window", "words").distinct(), owned.select("window", "item")


def _met(tokens: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Positions of documents whose shingle is in ``wanted``, joined to its rows."""
    at = _positions(tokens, size)
    letters = F.length(F.concat_ws(" ", "wanted")) if "wanted" in wanted.columns else F.lit(0)
    rows, size = wanted.agg(F.count("*"), F.coalesce(F.sum(letters), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_LETTERS:
        return at.join(F.broadcast(wanted), "shingle")
    asked = id_filter(wanted.select(F.col("shingle").alias("id")))
    return possible(at, asked, key="shingle").join(wanted, "shingle")


def occurrences(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """Where windows occur: the columns of ``docs`` but its text, ``window``, ``at`` and ``length``."""
    kept = [c for c in docs.columns if c != text]
    tokens = docs.select(*kept, words(F.col(text)).alias("words"))
    parts = []
    long_enough = F.size("words") >= SHINGLE
    short = sorted(r[0] for r in windows.where(~long_enough).select(F.size("words")).distinct().collect())
    for size in [*short, SHINGLE]:
        own = windows.where(long_enough if size == SHINGLE else F.size("words") == size)
        inside = stored(_positions(own, size), "shingles")
        asked = stored(inside.select("shingle").distinct(), "asked")
        often = stored(_met(tokens.select("words"), size, asked).groupBy("shingle")
                       .agg(F.count("*").alias("n")), "often")
        rare = inside.join(often, "shingle", "left").groupBy("window").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("at").alias("offset"), "shingle")).alias("rare"),
            F.first("words").alias("wanted"))
        prefix = stored(rare.where("rare.n > 0").select("window", "wanted", "rare.offset", "rare.shingle"), "prefix")
        start = F.col("at") - F.col("offset")
        length = F.size("wanted")
        found = _met(tokens, size, prefix) \
            .where((start >= 0) & (start + length <= F.size("words"))) \
            .where(F.slice("words", start + 1, length) == F.col("wanted"))
        parts.append(found.select(*kept, "window", start.alias("at"), length.alias("length")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def judged(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, copy, n_words, n_hit, n_items, items, contaminated)``, a row per document.

    ``copy`` is a hash of the text, which tells rows of one id apart.
    """
    named = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    windows, owners = item_windows(items, item_id, item_text)
    found = stored(occurrences(named, windows).distinct(), "occurrences")
    hits = found.groupBy("id", "copy").agg(F.collect_set(F.struct("at", "length")).alias("hits")) \
        .select("id", "copy", F.size(F.array_distinct(F.flatten(F.transform(
            "hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))).cast("long").alias("n_hit"))
    of_items = found.select("id", "copy", "window").distinct().join(owners, "window") \
        .groupBy("id", "copy").agg(F.sort_array(F.collect_set("item")).alias("items"))
    alike = (F.col("h.id").eqNullSafe(F.col("i.id"))) & (F.col("h.copy") == F.col("i.copy"))
    known = hits.alias("h").join(of_items.alias("i"), alike).select("h.id", "h.copy", "n_hit", "items")
    same = (F.col("d.id").eqNullSafe(F.col("k.id"))) & (F.col("d.copy") == F.col("k.copy"))
    counted = named.select("id", "copy", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.alias("d").join(known.alias("k"), same, "left").select(
        F.col("d.id").alias(id), F.col("d.copy").alias("copy"), "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_items", F.size("items").cast("long")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns as they are, that are not contaminated."""
    bad = judged(docs, items, id, text).where("contaminated").select(F.col(id).alias("__id"), "copy").distinct()
    same = docs[id].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["copy"])
    return docs.join(bad, same, "left_anti")
