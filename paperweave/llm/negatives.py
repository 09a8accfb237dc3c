"""Hard negatives by bounds along a spanning tree of anchors.

For two anchors p and a and any row x, a's score lies within
``|a - p| * |x|`` of p's score. Anchors are arranged in minimum spanning trees;
the root of a tree scores all rows, every other anchor takes bounds from its
parent (a score, or bounds again, widened by the edge) and scores only the rows
that its bounds cannot settle:

* positives: rows of the anchor's label whose upper bound reaches the fifth
  largest lower bound known so far;
* negatives: rows of another label whose bounds overlap the window of a positive
  and reach the third largest score known to lie in it.

The bounds hold for every row, so nothing is missed; what they save depends on how
near anchors are to each other. Scores are whole numbers and exact.

Anchors are range-partitioned by a code of hyperplane signs and cut into trees.
Trees are dealt to sheets and rows to stripes; a task reads the anchors of a
sheet and then the rows of a stripe, block by block, and keeps the best few of
each anchor and window. Only those go on. So every anchor meets every row in
blocks whose memory is bounded, no pairs are written, and a label, a vector or a
window that is shared by a third of all rows is spread like any other.

Defined cases: rows without label or vector, or with a null or non-finite
component, take no part; shorter vectors are continued by zeros (an empty one
scores 0); rows of one id are rows each, and equal ones an anchor each: results
of anchors with one id and one positive id are those of distinct rows, ordered by
score, id and place; a null id is never an anchor and comes last in ties; an empty
table gives an empty result; other columns are not read. Scores are exact up to 38
digits, larger ones count as the largest of these, and those beyond 64 bits are
returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.shared import stored

POSITIVES, NEGATIVES = 5, 3
TREE = 512       # anchors of a spanning tree
SHEET = 16       # so many trees, on average, are held by a task
BLOCK = 8192     # rows that are scored at once
STRIPE = 1 << 18  # rows that one task reads for one sheet, on average

_NULL_ID = 2**63 - 1
_LARGEST = 10**38 - 1
_BEST = ("anchor long, place long, positive_id long, positive_place long, positive_score {0}, other_id long, "
         "other_place long, score {0}")


def taking_part(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, v)`` of ``(vec_id, embedding, label)`` with components as whole doubles.

    Every seventh id has the next label.
    """
    def floored(x: Column) -> Column:
        scaled = x.cast("double") * 256
        # floor() gives a long; larger doubles are whole already
        return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)

    finite = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform("embedding", floored).alias("v"))


# --------------------------------------------------------------------- vectors

def _packed(vectors: list[np.ndarray]) -> tuple[list, list]:
    """Vectors as bytes: 16-bit numbers where they fit, else doubles."""
    narrow = [v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 2**15 else None for v in vectors]
    return narrow, [None if n is not None else v.astype("<f8").tobytes() for n, v in zip(narrow, vectors)]


def _matrix(narrow: list, wide: list) -> np.ndarray:
    """The vectors as rows of doubles, continued by zeros."""
    if narrow and all(n is not None for n in narrow) and len({len(n) for n in narrow}) == 1:
        return np.frombuffer(b"".join(narrow), "<i2").reshape(len(narrow), -1).astype(np.float64)
    found = [np.frombuffer(n, "<i2") if n is not None else np.frombuffer(w, "<f8") for n, w in zip(narrow, wide)]
    out = np.zeros((len(found), max(map(len, found), default=0)))
    for row, v in zip(out, found):
        row[:len(v)] = v
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths, a little too long rather than too short."""
    with np.errstate(over="ignore"):
        return np.sqrt((v * v).sum(axis=1)) * (1 + 1e-9)


def _exact(v: np.ndarray, longest: float) -> np.ndarray:
    """``v`` in the type in which products up to ``longest`` are exact: doubles, or Python's numbers."""
    return v if longest < 2**52 else np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of ``v`` with parents first, place of each one's parent in that order (the
    first is its own) and length of the edge to it."""
    n = len(v)
    square = (v * v).sum(axis=1)
    order, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    near, over, free = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(n):
            order[i], parent[i], free[at] = at, over[at], False
            distance = np.nan_to_num(square + square[at] - 2 * (v @ v[at]), nan=np.inf)
            closer = free & (distance < near)
            near[closer], over[closer] = distance[closer], i
            if i + 1 < n:
                at = int(np.argmin(np.where(free, near, np.inf)))
                at = at if free[at] else int(np.argmax(free))
    sorted_v = v[order]
    return order, parent, _norms(sorted_v - sorted_v[parent])


_ANCHOR = ("tree long, node long, up long, edge double, vec_id long, place long, label long, narrow binary, wide binary")


def anchor_trees(anchors: DataFrame, tree: int = TREE) -> DataFrame:
    """Anchors with their place in a spanning tree; ``tree`` numbers are unique, not dense."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId(), 0, []
        names = ["vec_id", "place", "label", "narrow", "wide"]

        def planted(rows):
            v = _matrix([r[3] for r in rows], [r[4] for r in rows])
            order, parent, edge = spanning_tree(v)
            columns = list(zip(*[rows[i] for i in order]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), task * (1 << 32) + made)), pa.array(np.arange(len(rows))),
                 pa.array(parent), pa.array(edge), *[pa.array(c, pa.int64()) for c in columns[:3]],
                 *[pa.array(c, pa.binary()) for c in columns[3:]]],
                ["tree", "node", "up", "edge", *names])

        for batch in batches:
            held += list(zip(*[batch[name].to_pylist() for name in names]))
            while len(held) >= tree:
                yield planted(held[:tree])
                held, made = held[tree:], made + 1
        if held:
            yield planted(held)

    ranges = anchors.repartitionByRange("code", "vec_id", "place").sortWithinPartitions("code", "vec_id", "place")
    return ranges.drop("code").mapInArrow(run, _ANCHOR)


def coded(rows: DataFrame, id: str = "vec_id") -> DataFrame:
    """``(vec_id, place, label, code, narrow, wide)``: a number for every row, vectors as bytes and the
    signs of 24 fixed projections. To be stored before it is used twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(batch["v"].value_lengths().to_numpy()))
            vectors = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            narrow, wide = _packed(vectors)
            v = _matrix(narrow, wide)
            planes = np.random.default_rng(12).standard_normal((v.shape[1], 24))
            with np.errstate(over="ignore", invalid="ignore"):
                code = ((v @ planes) > 0) @ (1 << np.arange(23, -1, -1))
            yield pa.RecordBatch.from_arrays(
                [batch[id], pa.array(at + np.arange(len(vectors))), batch["label"], pa.array(code.astype(np.int64)),
                 pa.array(narrow, pa.binary()), pa.array(wide, pa.binary())],
                ["vec_id", "place", "label", "code", "narrow", "wide"])
            at += len(vectors)

    return rows.mapInArrow(run, "vec_id long, place long, label long, code long, narrow binary, wide binary")


# --------------------------------------------------------------------- scoring

@dataclass
class Sheet:
    """Anchors of some trees with what is known of each: one or more lists of best rows.

    ``low`` and ``high`` bound the scores that a list takes, ``best`` has its rows as
    (score, id, place), best first.
    """

    id: np.ndarray
    place: np.ndarray
    label: np.ndarray
    root: np.ndarray
    up: np.ndarray     # row of the parent
    edge: np.ndarray
    v: np.ndarray
    windows: list[list[tuple]]  # per anchor: (positive id, its place, its score, low, high)
    best: list[list[list[tuple]]]
    keep: int
    same_label: bool
    scored: int = 0  # rows that bounds could not settle

    def offer(self, anchor: int, score: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        for (*_, low, high), best in zip(self.windows[anchor], self.best[anchor]):
            inside = np.ones(len(score), bool) if low is None else (score >= low) & (score <= high)
            if len(best) == self.keep:
                inside &= score >= best[-1][0]
            at = np.flatnonzero(inside)
            if len(at) > self.keep:
                floor = np.partition(score[at], len(at) - self.keep)[len(at) - self.keep]
                at = at[score[at] >= floor]
                at = at[np.lexsort((places[at], ids[at], -score[at]))[:self.keep]]
            if len(at):
                best += [(int(s), int(i), int(p)) for s, i, p in zip(score[at], ids[at], places[at])]
                best.sort(key=lambda x: (-x[0], x[1], x[2]))
                del best[self.keep:]

    def wanted(self, anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows that may belong to one of the anchor's lists by their bounds."""
        out = np.zeros(len(low), bool)
        for (*_, least, most), best in zip(self.windows[anchor], self.best[anchor]):
            may = np.ones(len(low), bool) if least is None else (high >= least) & (low <= most)
            sure = low if least is None else low[(low >= least) & (high <= most)]
            floor = best[-1][0] if len(best) == self.keep else -np.inf
            if len(sure) >= self.keep:
                floor = max(floor, np.partition(sure, len(sure) - self.keep)[len(sure) - self.keep])
            out |= may & (high >= floor)
        return out

    def take(self, ids: np.ndarray, places: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """Score a block of rows for every anchor, from the roots of the trees down."""
        mine, rows = _same_width(self.v, v)
        length, longest = _norms(rows), _norms(mine)
        most = float(longest.max(initial=0) * length.max(initial=0))
        mine, rows = _exact(mine, most), _exact(rows, most)
        plain = rows.dtype != object
        last_child = np.arange(len(mine))
        np.maximum.at(last_child, self.up, np.arange(len(mine)))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for a in range(len(mine)):
            if not self.root[a] and plain:
                below, above = bounds[int(self.up[a])]
                if last_child[self.up[a]] == a:
                    del bounds[int(self.up[a])]
            if not self.windows[a] and last_child[a] == a:
                continue
            asked = (labels == self.label[a]) == self.same_label
            if self.same_label:
                asked &= places != self.place[a]
            if self.root[a] or not plain:
                score = rows @ mine[a]
                low = high = score
                need = asked
            else:
                reach = self.edge[a] * length * (1 + 1e-9) + 1e-6
                low, high = below - reach, above + reach
                need, at = np.zeros(len(low), bool), np.flatnonzero(asked)
                if self.windows[a]:
                    need[at] = self.wanted(a, low[at], high[at])
                at = np.flatnonzero(need)
                if 4 * len(at) > len(rows):  # one product over all is cheaper than picking rows
                    score = low = high = rows @ mine[a]
                elif len(at):
                    score = np.zeros(len(rows))
                    score[at] = low[at] = high[at] = rows[at] @ mine[a]
            if last_child[a] > a:
                bounds[a] = (low, high)
            at = np.flatnonzero(need)
            self.scored += len(at)
            if len(at):
                self.offer(a, score[at], ids[at], places[at])

    def rows(self) -> Iterator[tuple]:
        for a in range(len(self.id)):
            for (positive, at, score, _, _), best in zip(self.windows[a], self.best[a]):
                for found, other, place in best:
                    yield (int(self.id[a]), int(self.place[a]), positive, at, score, other, place, found)


def _scorer(keep: int, same_label: bool, kind: str):
    """mapInArrow function over sheets: their anchors come first, then their stripe of rows."""
    number = pa.int64() if kind == "long" else pa.string()
    schema = pa.schema([("anchor", pa.int64()), ("place", pa.int64()), ("positive_id", pa.int64()),
                        ("positive_place", pa.int64()), ("positive_score", number), ("other_id", pa.int64()),
                        ("other_place", pa.int64()),
                        ("score", number)])

    def results(sheet: Sheet):
        rows = list(sheet.rows())
        for at in range(0, len(rows), 1 << 16):
            columns = [list(c) for c in zip(*rows[at:at + (1 << 16)])]
            if kind != "long":
                for i in (4, 7):
                    columns[i] = [None if x is None else str(max(-_LARGEST, min(x, _LARGEST))) for x in columns[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def vectors(rows: pa.Table) -> np.ndarray:
        return _matrix(rows["narrow"].to_pylist(), rows["wide"].to_pylist())

    def sheet_of(rows: pa.Table) -> Sheet:
        column = {name: rows[name].to_numpy() for name in ("vec_id", "place", "label", "tree", "node", "up", "edge")}
        # trees follow one another, their nodes in order
        up = np.arange(rows.num_rows) - column["node"] + column["up"]
        windows = [[(None,) * 5] if asked is None else [
            (w["positive_id"], w["place"], score, -(-score * 50 // 100), score * 95 // 100)
            for w in asked for score in [int(w["score"])]] for asked in rows["windows"].to_pylist()]
        return Sheet(column["vec_id"], column["place"], column["label"], column["node"] == 0, up, column["edge"],
                     vectors(rows), windows, [[[] for _ in w] for w in windows], keep, same_label)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
        """Rows of one sheet and stripe: its anchors all at once, then its rows by blocks."""
        last, held, n = None, [], 0
        for batch in batches:
            names = batch["sheet"].to_numpy().astype(np.int64) << 32 | batch["stripe"].to_numpy()
            keys = names << 1 | batch["anchor"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and (keys[a] != last or (n >= BLOCK and not last & 1)):
                    yield last >> 1, bool(last & 1), pa.Table.from_batches(held)
                    held, n = [], 0
                last = int(keys[a])
                held.append(batch.slice(a, b - a))
                n += b - a
        if held:
            yield last >> 1, bool(last & 1), pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet, of = None, None
        for key, anchors, rows in blocks(batches):
            if anchors:
                if sheet:
                    yield from results(sheet)
                sheet, of = sheet_of(rows), key
            elif key == of:
                sheet.take(rows["vec_id"].fill_null(_NULL_ID).to_numpy(), rows["place"].to_numpy(),
                           rows["label"].to_numpy(), vectors(rows))
        if sheet:
            yield from results(sheet)

    return run


def _met(anchors: DataFrame, rows: DataFrame, sheets: int, stripes: int) -> DataFrame:
    """Anchors of each sheet for every stripe, and rows of each stripe for every sheet, side by side."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = anchors.withColumn("stripe", every(stripes)).withColumn("anchor", F.lit(True))
    other = rows.withColumn("stripe", F.pmod(F.xxhash64("place"), F.lit(stripes)).cast("int")).withColumn(
        "sheet", every(sheets)).withColumn("anchor", F.lit(False)).drop("code")
    both = one.unionByName(other, allowMissingColumns=True)
    return both.repartition(sheets * stripes, "sheet", "stripe").sortWithinPartitions(
        "sheet", "stripe", F.desc("anchor"), "tree", "node")


def _best(found: DataFrame, keep: int, kind: str, by: list[str]) -> DataFrame:
    """The first ``keep`` of each list, of what the stripes found."""
    score = F.col("score") if kind == "long" else F.col("score").cast("decimal(38,0)")
    row = Window.partitionBy(*by).orderBy(F.desc(score), "other_id", "other_place")
    return found.withColumn("rank", F.row_number().over(row)).where(F.col("rank") <= keep)


def _long(c: str) -> Column:
    edge = F.lit(2**63 - 1).cast("decimal(38,0)")
    return F.greatest(F.least(F.col(c).cast("decimal(38,0)"), edge), -edge).cast("long")


def mined(rows: DataFrame, tree: int = TREE, sheet: int = SHEET, stripe: int = STRIPE) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of
    ``(vec_id, embedding, label)``."""
    spark = rows.sparkSession
    all_rows = stored(coded(taking_part(rows)), "rows")
    is_anchor = F.col("vec_id") % 50 == 0
    anchors = stored(anchor_trees(all_rows.where(is_anchor), tree), "trees")
    n, n_anchors, widest = all_rows.agg(F.count("*"), F.count_if(is_anchor), F.count("wide")).first()
    kind = "string" if widest else "long"  # scores of wide vectors as decimal text
    sheets = max(1, -(-n_anchors // (tree * sheet)))
    # only the cut of the work into tasks depends on the cluster
    stripes = max(-(-n // stripe), -(-4 * spark.sparkContext.defaultParallelism // sheets))
    dealt = anchors.withColumn("sheet", F.pmod(F.xxhash64("tree"), F.lit(sheets)).cast("int"))
    windows = "array<struct<positive_id: bigint, place: bigint, score: string>>"

    first = dealt.withColumn("windows", F.lit(None).cast(windows))
    near = _met(first, all_rows, sheets, stripes).mapInArrow(
        _scorer(POSITIVES, True, kind), _BEST.format(kind))
    positives = _best(near, POSITIVES, kind, ["place"])
    asked = positives.groupBy("place").agg(F.collect_list(F.struct(
        F.col("other_id").alias("positive_id"), F.col("other_place").alias("place"), F.col("score").cast("string").alias("score"))).alias("windows"))
    second = dealt.join(asked, "place", "left").withColumn(
        "windows", F.coalesce("windows", F.array().cast(windows)))
    far = _met(stored(second.select(*first.columns), "windows"), all_rows, sheets, stripes).mapInArrow(
        _scorer(NEGATIVES, False, kind), _BEST.format(kind))
    negatives = _best(far, NEGATIVES, kind, ["place", "positive_place"])
    shown = lambda c: F.col(c) if kind == "long" else _long(c)
    known = lambda c: F.nullif(F.col(c), F.lit(_NULL_ID))
    return negatives.select(
        F.col("anchor").alias("anchor_id"), known("positive_id").alias("positive_id"), F.col("rank").cast("int"),
        known("other_id").alias("negative_id"), shown("positive_score").alias("positive_score"),
        shown("score").alias("negative_score"))
