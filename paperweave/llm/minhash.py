"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, the smallest and the largest hash
of the document's shingles, so 64 permutations give 128 values at half the hash
evaluations. They are banded into 32 bands of four values (two permutations
each). A pair at the threshold of 0.75 meets in no band with probability
``(1 - 0.75 ** 4) ** 32``, about 5e-6; every candidate is confirmed on its full
shingle sets.

Documents of one shingle set form a class and are represented by the smallest
id. Within a bucket of a band, representatives are compared with leaders, not
with each other, and the confirmed links are contracted to components. What is
left are texts that share a bucket with a text of another component. Among
those, an exact bound on the first common shingle in order of rarity (see
:func:`_by_prefix`) finds every pair that can still be similar, and pairs of
different components are compared. So no candidate is lost, and a large group
of near copies costs a comparison per member and leader instead of all pairs.

Defined cases: null and empty texts have no shingles and are linked with
nothing; repeated ids, equal or with different texts, are one document that has the
links of all its texts, and every row is returned; a row without an id is linked with
nothing and has no component; ties go to the smaller id; very long texts
stay whole in one row and are hashed in bounded slices; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.components import components
from paperweave.llm.shared import stored
from paperweave.llm.words import int64, lists, mixed, slices, windows, words_of

PERMUTATIONS = 64
BAND = 2            # permutations per band, so four values
SHINGLE = 5
PERCENT = 75
LEADERS = (1, 4)    # per bucket, round by round, before the rest is joined by prefix
BLOCK = 32          # comparisons that share one copy of a leader

_random = np.random.default_rng(7)
_XOR = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_ODD = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after the other, and where each starts."""
    words = words_of(texts, lower=True)
    runs = windows(words.hash, SHINGLE)
    sets = []
    for s, e in zip(words.first[:-1], words.first[1:]):
        if e - s >= SHINGLE:
            sets.append(np.unique(runs[s:e - SHINGLE + 1]))
        elif e > s:
            sets.append(windows(words.hash[s:e], e - s))
        else:
            sets.append(words.hash[:0])
    at = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)
    return (np.concatenate(sets) if sets else words.hash[:0]), at


def band_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts (none of them empty) x bands."""
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(at) - 1, PERMUTATIONS // BAND), np.uint64)
    for p in range(PERMUTATIONS):
        values = (narrow ^ _XOR[p]) * _ODD[p]
        values ^= values >> np.uint32(16)
        low = np.minimum.reduceat(values, at[:-1]).astype(np.uint64)
        high = np.maximum.reduceat(values, at[:-1]).astype(np.uint64)
        b = p // BAND
        keys[:, b] = mixed(keys[:, b] + ((low << np.uint64(32)) | high), p + 1)
    return keys


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        shingles, at = shingle_sets(batch["text"])
        n = np.diff(at)
        full = np.flatnonzero(n)
        keys = np.zeros((0, PERMUTATIONS // BAND), np.uint64)
        whole = np.zeros((len(n), 2), np.uint64)
        if len(full):
            starts = at[:-1][full]
            keys = band_keys(shingles, np.append(starts, at[-1]))
            for i in (0, 1):
                whole[full, i] = np.add.reduceat(mixed(shingles, 101 + i), starts)
        per = np.append(0, np.cumsum(np.where(n > 0, PERMUTATIONS // BAND, 0)))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n), int64(whole[:, 0].copy()), int64(whole[:, 1].copy()),
             lists(int64(keys.ravel()), per)],
            ["id", "n", "set_a", "set_b", "bands"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by leader and block, the leader's own row first; only its set is held."""
    held, leader = None, None
    for batch in slices(batches, "text"):
        shingles, at = shingle_sets(batch["text"])
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        left, right, common = [], [], []
        for i in range(len(a)):
            own = shingles[at[i]:at[i + 1]]
            if b[i] is None:
                held, leader = own.copy(), a[i]
                continue
            assert leader == a[i]
            both = len(np.intersect1d(held, own, assume_unique=True))
            left.append(a[i])
            right.append(b[i])
            common.append(100 * both >= PERCENT * (len(held) + len(own) - both))
        yield pa.RecordBatch.from_arrays(
            [pa.array(left, batch.schema.field("a").type), pa.array(right, batch.schema.field("a").type),
             pa.array(common, pa.bool_())], ["a", "b", "similar"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Whether each pair ``(a, b)`` reaches the threshold on its full sets.

    A leader's text is sent once per block of about :data:`BLOCK` partners, so
    neither a task nor a row ever holds a whole group.
    """
    width = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "widths")
    cut = pairs.join(width, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block"))
    wanted = cut.select("a", "b", "block", F.col("b").alias("id")) \
        .union(cut.select("a", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), "block",
                          F.col("a").alias("id")).distinct())
    rows = wanted.join(texts, "id").repartition("a", "block") \
        .sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.select("a", "b", "text").mapInArrow(_compared, f"a {kind}, b {kind}, similar boolean")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_shingles, class_id, component_id, n_links)``, a row per document.

    ``class_id`` is the smallest id with the same set of shingles,
    ``component_id`` the smallest id reachable over links, and ``n_links`` the
    number of confirmed links of the class's representative that were needed.
    """
    # a vertex is a text of an id; texts of one id are united at the end
    named = docs.where(F.col(id).isNotNull()).select(F.struct(
        F.col(id).alias("id"), F.xxhash64(text).alias("copy")).alias("id"), F.col(text).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    signed = stored(named.mapInArrow(
        _signed, f"id {kind}, n long, set_a long, set_b long, bands array<bigint>"), "signatures")
    classes = signed.where("n > 0").groupBy("n", "set_a", "set_b") \
        .agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"))
    every = classes.select("rep", F.posexplode("bands").alias("band", "key")) \
        .select("rep", F.xxhash64("band", "key").alias("key"))
    # tables of their own on one side of a join, so that the other side's hot keys can be split
    shared = stored(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    bucket = stored(every.join(shared, "key").select("key", "rep"), "buckets")
    links, texts = None, None
    if not bucket.isEmpty():
        asked = bucket.select(F.col("rep").alias("id")).distinct()
        texts = stored(named.join(asked, "id", "left_semi").dropDuplicates(["id"]), "texts")
    rest, labels, tested = bucket, None, None
    for leaders in LEADERS if texts is not None else ():
        lead = rest.groupBy("key", F.pmod(F.xxhash64("rep", F.lit(leaders)), F.lit(leaders)).alias("part")) \
            .agg(F.min("rep").alias("leader"))
        lead = stored(lead.select("key", "leader"), "leaders")
        member = rest.join(lead.select("key", F.col("leader").alias("rep"), F.lit(True).alias("leads")),
                           ["key", "rep"], "left")
        pairs = member.join(lead, "key").where("rep <> leader AND (leads IS NULL OR leader < rep)")
        if labels is not None:
            pairs = _apart(pairs, labels)
        pairs = pairs.select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        links, labels, tested = _linked(pairs, texts, tested)
        rest = rest.join(lead.withColumnRenamed("leader", "rep"), ["key", "rep"], "left_anti")
        known = rest.join(labels.withColumnRenamed("v", "rep"), "rep", "left") \
            .select("key", "rep", F.coalesce("c", "rep").alias("c"))
        open_ = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")) \
            .where("lo <> hi").select("key")
        rest = stored(known.join(stored(open_, "keys"), "key").select("key", "rep"), "buckets")
        if rest.isEmpty():
            break
    else:
        if texts is not None:
            left = rest.select(F.col("rep").alias("id")).distinct()
            known = texts.join(left, "id").join(labels.withColumnRenamed("v", "id"), "id", "left") \
                .select("id", "text", F.coalesce("c", "id").alias("c"))
            pairs = _by_prefix(known)
            links, labels, tested = _linked(pairs.select(F.col("leader").alias("a"), F.col("rep").alias("b")),
                                            texts, tested)
    class_of = stored(signed.groupBy("n", "set_a", "set_b").agg(F.min("id").alias("class_id")), "classes")
    members = signed.select("id", "n", "set_a", "set_b").join(class_of, ["n", "set_a", "set_b"]) \
        .select("id", F.col("n").alias("n_shingles"),
                F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
    if links is None:
        found = members.withColumn("component_id", F.col("class_id")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        degree = links.union(links.select("b", "a")).groupBy(F.col("a").alias("class_id")) \
            .agg(F.count("*").alias("n_links"))
        found = members.join(labels.withColumnRenamed("v", "class_id"), "class_id", "left") \
            .join(degree, "class_id", "left") \
            .select("id", "n_shingles", "class_id", F.coalesce("c", "class_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"))
    one = _united(stored(found, "found"))
    without = docs.where(F.col(id).isNull()).select(F.lit(None).cast(kind).alias("id"), F.col(text).alias("text"))
    none = without.mapInArrow(_signed, f"id {kind}, n long, set_a long, set_b long, bands array<bigint>").select(
        "id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links"))
    return one.unionByName(none).select(F.col("id.id").alias(id), "n_shingles", F.col("class_id.id").alias("class_id"),
                                        F.col("component_id.id").alias("component_id"), "n_links")


def _united(found: DataFrame) -> DataFrame:
    """Components that share an id, by different texts of it, as one."""
    several = stored(found.groupBy(F.col("id.id").alias("doc")).agg(
        F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi").select("doc", "lo"),
        "several")
    if several.isEmpty():
        return found
    met = found.join(several, F.col("id.id") == F.col("doc")).where("component_id <> lo")
    over = components(met.select(F.col("component_id").alias("a"), F.col("lo").alias("b")).distinct())
    return found.join(over.withColumnRenamed("v", "component_id"), "component_id", "left").withColumn(
        "component_id", F.coalesce("c", "component_id")).drop("c")


def _linked(pairs: DataFrame, texts: DataFrame, tested: DataFrame | None):
    """Links, labels of components and all compared pairs after comparing ``pairs (a, b)`` too."""
    pairs = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    if tested is not None:
        known = tested.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        pairs = pairs.join(known, ["lo", "hi"], "left_anti")
    pairs = stored(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")),
                   "pairs")
    result = stored(compared(pairs, texts), "compared")
    tested = result if tested is None else tested.unionByName(result)
    links = tested.where("similar").select("a", "b")
    return links, components(links), tested


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        shingles, at = shingle_sets(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["id"], batch["c"], lists(int64(shingles), at)],
                                          ["id", "c", "shingles"])


def _by_prefix(texts: DataFrame) -> DataFrame:
    """Every pair of ``texts (id, text, c)`` of different ``c`` that can reach the threshold:
    ``(leader, rep)``, leader < rep.

    Shingles are ordered by rarity. With ``o`` the least intersection that the
    two sizes allow, the first common shingle of a similar pair has at least
    ``o - 1`` shingles behind it in both texts, so it stands in the first quarter
    of either; only those are joined, under that bound.
    """
    kind = texts.schema["id"].dataType.simpleString()
    sets = texts.mapInArrow(_sets, f"id {kind}, c {kind}, shingles array<bigint>")
    rows = stored(sets.select("id", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "shingle")
    ranked = rows.join(often, "shingle").withColumn("at", F.row_number().over(order) - 1)
    kept = stored(ranked.where(f"df > 1 AND 100 * (n - at) >= {PERCENT} * n")
                  .select("shingle", "id", "c", "n", "at"), "prefixes")
    one = kept.select("shingle", F.col("id").alias("leader"), F.col("c").alias("c1"), F.col("n").alias("n1"),
                      F.col("at").alias("at1"))
    two = kept.select("shingle", F.col("id").alias("rep"), F.col("c").alias("c2"), F.col("n").alias("n2"),
                      F.col("at").alias("at2"))
    reach = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    return one.join(two, (one["shingle"] == two["shingle"]) & (one["leader"] < two["rep"])
                    & (F.col("c1") != F.col("c2"))
                    & ((100 + PERCENT) * reach >= PERCENT * (F.col("n1") + F.col("n2")))) \
        .select("leader", "rep")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components."""
    one = labels.select(F.col("v").alias("rep"), F.col("c").alias("c1"))
    two = labels.select(F.col("v").alias("leader"), F.col("c").alias("c2"))
    return pairs.join(one, "rep", "left").join(two, "leader", "left") \
        .where(F.coalesce("c1", "rep") != F.coalesce("c2", "leader"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, columns as they are, that are the smallest of their component.

    Rows with a null id are no documents of a group and are kept.
    """
    found = near_duplicates(docs.where(F.col(id).isNotNull()), id, text)
    gone = found.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("__gone")).distinct()
    return docs.join(gone, docs[id] == gone["__gone"], "left_anti")
