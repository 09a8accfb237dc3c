"""Removal of passages repeated across documents, by De Bruijn compaction.

Every window of :data:`SPAN` words is an edge between its first and its last 12
words; edges that start in several documents are the repeated part of the graph.

1. An edge is known by its anchor, the smallest hash of its runs of
   :data:`ANCHOR` words. Neighbouring edges with one anchor form a run, so a text
   has about a fifth as many runs as words, and equal edges have equal anchors.
   Only runs whose anchor stands in several documents are looked at further.
2. Runs of equal words are a class, a nonbranching path on its own: one joined to
   a class that an earlier document has is a repeated span as a whole.
3. Where an anchor has several classes the graph branches inside the run. The
   edges of one copy of each class are summed up: first document, place in it,
   whether copies differ in the word before or after. Edges that follow each
   other in their first document are compacted to a path as long as none leaves
   or enters between them.
4. Occurrences are joined to runs and paths. Those that run in parallel to their
   source are one long span with the coordinates of its source.

Edges are compared by 64-bit hashes, runs by 88 bits. No text is compared by
prefix, no count is capped, and what a task holds is bounded by one text.

Defined cases: null and empty texts have no words and stay as they are; texts
shorter than a window lose nothing; a passage repeated inside one document only stays; of several
rows with one id, equal or not, none counts as a repetition of the others; a row without an id is
no source and stays as it is; very long texts stay whole; other columns are carried along, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.shared import id_filter, possible, stored
from paperweave.llm.words import int64, mixed, slices, window_starts, windows, words_of

SPAN = 13
ANCHOR = 5
LONGEST = 15 # windows of a run; longer ones are cut
END = -1     # stands for the word after the last or before the first one

_LOW48, _LOW40 = np.uint64((1 << 48) - 1), np.uint64((1 << 40) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _anchors(words, starts: np.ndarray) -> np.ndarray:
    """Minimizer of the windows at ``starts``, 48 bits: a false match costs work, not results."""
    runs = windows(words.hash, ANCHOR)
    if not len(starts):
        return runs[:0]
    width, least = 1, runs
    wanted = SPAN - ANCHOR + 1
    while width < wanted:  # minimum over 1, 2, 4 ... runs
        step = min(width, wanted - width)
        least = np.minimum(least[:len(least) - step], least[step:])
        width += step
    return least[starts] & _LOW48


def _runs(words):
    """First window, text, anchor, hash of the words and number of windows of every run."""
    starts, text = window_starts(words.first, SPAN)
    anchor = _anchors(words, starts)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(anchor)))
    place = np.arange(len(anchor)) - np.repeat(at, size)
    new |= place % LONGEST == 0
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(anchor)))
    edge = windows(words.hash, SPAN)[starts] if len(starts) else anchor
    place = (np.arange(len(anchor)) - np.repeat(at, size)).astype(np.uint64)
    whole = np.add.reduceat(mixed(edge + place * _ODD), at) & _LOW40 if len(at) else edge
    return starts[at], text[at], anchor[at], whole, size


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch["text"])
        start, text, anchor, whole, size = _runs(words)
        yield pa.RecordBatch.from_arrays(
            [int64(anchor), int64(whole), batch["id"].take(pa.array(text)),
             pa.array((start - words.first[text]) * (LONGEST + 1) + size)],
            ["anchor", "whole", "id", "place"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of the asked runs, each text's as ``start * (LONGEST + 1) + windows``."""
    for batch in slices(batches, "text"):
        batch = batch.filter(batch["asked"].is_valid())
        words = words_of(batch["text"])
        asked = batch["asked"]
        runs = asked.flatten().to_numpy()
        if not len(runs):
            continue
        size = runs % (LONGEST + 1)
        owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        text = np.repeat(owner, size)
        starts = np.repeat(words.first[owner] + runs // (LONGEST + 1), size) \
            + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        short = (words.hash >> np.uint64(49)).astype(np.int64)  # 15 bits of the word
        after = np.append(short, END)[starts + SPAN]
        after = np.where(starts + SPAN == words.first[text + 1], END, after)
        before = np.where(starts == words.first[text], END, short[starts - 1])
        yield pa.RecordBatch.from_arrays(
            [int64(windows(words.hash, SPAN)[starts]), batch["id"].take(pa.array(text)),
             pa.array((starts - words.first[text]).astype(np.int32)),
             pa.array((after * 65536 + before).astype(np.int32))], ["edge", "id", "at", "around"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept words of each text, whose removed stretches come as ``(at, length)``."""
    for batch in slices(batches, "text"):
        words = words_of(batch["text"])
        gone = np.zeros(len(words.start) + 1, np.int64)
        spans = batch["spans"]
        cuts = spans.flatten()
        owner = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy())) if len(cuts) else \
            np.zeros(0, int)
        if len(cuts):
            begin = words.first[owner] + cuts.field("at").to_numpy()
            np.add.at(gone, begin, 1)
            np.add.at(gone, begin + cuts.field("length").to_numpy(), -1)
        gone = np.cumsum(gone[:-1]) > 0
        removed = np.append(0, np.cumsum(gone))
        texts = []
        for i, (s, e) in enumerate(zip(words.first[:-1], words.first[1:])):
            left = np.arange(s, e)[~gone[s:e]]
            data = words.data
            texts.append(b" ".join([data[a:b].tobytes() for a, b in zip(words.start[left], words.end[left])]))
        yield pa.RecordBatch.from_arrays(
            [batch["row"], pa.array(np.diff(words.first)),
             pa.array(removed[words.first[1:]] - removed[words.first[:-1]]),
             batch["spans"], pa.array([own if whole else x.decode("utf-8", "replace") for own, whole, x in zip(
                 batch["text"].to_pylist(), removed[words.first[1:]] == removed[words.first[:-1]], texts)], pa.string()),
             pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
            ["row", "n_words", "n_removed", "spans", "kept", "kept_sha256"])


def shared_runs(docs: DataFrame) -> DataFrame:
    """Runs ``(anchor, whole, id, place)`` of ``docs (id, text)`` whose anchor occurs again."""
    kind = docs.schema["id"].dataType.simpleString()
    runs = docs.select("id", "text").mapInArrow(_run_rows, f"anchor long, whole long, id {kind}, place long")
    # a table of its own, so that the join can split an anchor that many texts have
    again = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    return stored(runs.join(again, "anchor"), "runs")


def classified(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of runs that an earlier document has as a whole, and the runs ``(id, place)`` in
    which the graph branches, those of an earlier copy left out."""
    classes = runs.groupBy("anchor", "whole").agg(F.min(F.struct("id", "place")).alias("first"))
    classes = stored(classes, "classes")
    branching = classes.groupBy("anchor").agg(F.count("*").alias("classes"))
    classes = stored(classes.join(branching, "anchor"), "classes")
    known = stored(runs.join(classes, ["anchor", "whole"]).select("id", "place", "first", "classes"), "known")
    start = F.floor(F.col("place") / (LONGEST + 1)).cast("int")
    spans = known.where("first.id.id < id.id").select(
        "id", start.alias("at"), (F.pmod("place", F.lit(LONGEST + 1)) + SPAN - 1).cast("int").alias("length"),
        F.col("first.id").alias("source"),
        F.floor(F.col("first.place") / (LONGEST + 1)).cast("int").alias("source_at"))
    return spans, known.where("first.id.id = id.id AND classes > 1").select("id", "place")


def paths(edges: DataFrame) -> DataFrame:
    """Compacted repeated edges: ``(edge, source, source_at, path_at)``.

    A path is named by its first document and the place where it starts there.
    """
    graph = edges.groupBy("edge").agg(
        F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("last"),
        F.min("around").alias("around"), F.max("around").alias("around2"))
    repeated = graph.where("first.id.id <> last.id").select(
        "edge", F.col("first.id").alias("source"), F.col("first.at").alias("source_at"),
        (F.col("around") != F.col("around2")).alias("branches"))
    along = Window.partitionBy("source").orderBy("source_at")
    opens = F.coalesce((F.lag("source_at").over(along) + 1 != F.col("source_at"))
                       | F.lag("branches").over(along) | F.col("branches"), F.lit(True))
    return repeated.withColumn("opens", opens) \
        .withColumn("path_at", F.max(F.when(F.col("opens"), F.col("source_at"))).over(along)) \
        .select("edge", "source", "source_at", "path_at")


def merged(spans: DataFrame) -> DataFrame:
    """Spans that overlap and run in parallel to one source, as one: ``(id, at, length, source,
    source_at)``."""
    spans = spans.withColumn("shift", F.col("at") - F.col("source_at"))
    along = Window.partitionBy("id", "source", "shift").orderBy("at")
    reach = F.max(F.col("at") + F.col("length")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    run = F.max(F.when(F.coalesce(reach < F.col("at"), F.lit(True)), F.col("at"))).over(along)
    return spans.withColumn("run", run).groupBy("id", "source", "shift", "run") \
        .agg((F.max(F.col("at") + F.col("length")) - F.min("at")).alias("length"),
             F.min("at").alias("at"), F.min("source_at").alias("source_at")) \
        .select("id", "at", "length", "source", "source_at")


def repeated_spans(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Stretches of words of ``docs (row, id, text)`` that an earlier document has too."""
    kind = docs.schema["id"].dataType.simpleString()
    spans, open_ = classified(runs)
    asked = open_.groupBy("id").agg(F.collect_list("place").alias("asked"))
    edges = docs.join(asked, "id", "left").select("row", "id", "text", "asked") \
        .mapInArrow(_edges, f"edge long, id {kind}, at int, around int")
    on_path = edges.select("edge", "id", "at").join(paths(edges), "edge").where("source.id < id.id")
    single = on_path.select("id", "at", F.lit(SPAN).alias("length"), "source", "source_at")
    return merged(spans.unionByName(single))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``text`` reduced to its kept words, joined by one blank, or as it is
    where nothing is removed, plus ``n_words``, ``n_removed``, ``spans`` (``at, length, source,
    source_at``) and ``kept_sha256`` (of the kept words, joined), which replace columns of those
    names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # rows of one id with different texts have places of their own
    named = docs.select(F.struct(*others).alias("row"), F.struct(
        F.col(id).alias("id"), F.xxhash64(text).alias("copy")).alias("id"), F.col(text).alias("text"))
    runs = shared_runs(named.where("id.id IS NOT NULL"))
    seen = id_filter(runs.select("id"))
    some, rest = possible(named, seen), possible(named, seen, wanted=False)
    kind = docs.schema[id].dataType.simpleString()
    span = f"array<struct<at:int,length:int,source:{kind},source_at:int>>"
    cut = repeated_spans(some, runs).groupBy("id") \
        .agg(F.sort_array(F.collect_list(F.struct(
            "at", "length", F.col("source.id").alias("source"), "source_at"))).alias("spans"))
    spans = some.join(cut, "id", "left").select("row", "text", F.coalesce("spans", F.array().cast(span)).alias("spans"))
    schema = (f"row {named.schema['row'].dataType.simpleString()}, n_words long, n_removed long, "
              f"spans {span}, kept string, kept_sha256 string")
    done = spans.mapInArrow(_without, schema).unionByName(
        rest.select("row", "text", F.array().cast(span).alias("spans")).mapInArrow(_without, schema))
    added = ["n_words", "n_removed", "spans", "kept_sha256"]
    return done.select(*[F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`")
                         for c in docs.columns if c not in added], *added)
