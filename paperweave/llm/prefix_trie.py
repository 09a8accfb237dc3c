"""Prefix trie of conversations as a burst trie.

1. A turn is known by 16 bytes of the SHA-256 of its role and text, so a
   conversation is a binary path of such ids. Texts go no further.
2. All conversations start in the containers under the root, by first turn id.
   A container beyond :data:`CAPACITY` turns and :data:`MEMBERS` members bursts: it becomes a trie
   head, its members go by their next turn id to containers one turn deeper, and
   those that end there stay at the head. Rounds look at 1, 2, 4, ... depths at
   once, so the number of jobs is logarithmic in the depth of what bursts, and
   each reads only members of containers that burst in the round before.
3. Containers are dealt to shards, sorted by path and swept: the stretch that two
   neighbours share is a run of common nodes. A sweep holds the nodes of one
   container, so the capacity bounds its memory.
4. Heads are few (at most a capacity-th of the turns per depth). Their numbers are
   sums over the tops of containers and the members that end at them, added up
   along the heads' own ancestors.

Members that end at one node can be a third of all rows (copies). Below a head
they are hashed while they stream by in order. At a head, ranges of them are
written as text by many tasks and only those texts are hashed in one.

Defined cases: a null conversation id belongs to no conversation; null roles and
texts are empty; turns of one number (null is first) are ordered by turn id, equal
ones are turns each; a conversation that is rebuilt without turns ends at the
root; an empty table has no nodes; other columns are not read. The ids of the
turns of one conversation are held by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweave.llm.shared import small_or_shuffled, stored

#: A container bursts beyond both: turns (and one per member), and members, so that one long
#: conversation is swept as it is instead of making a head of each of its turns.
CAPACITY = 8192
MEMBERS = 64
WIDTH = 16  # bytes of a turn id

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: ids of a conversation's turns in order, and UTF-8 bytes of their texts.

    ``turns`` has ``conv_id, turn, role, text``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    written = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    known = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(written.cast("binary"), 256)), 1, WIDTH).alias("turn_id"),
        F.octet_length(text).cast("long").alias("size"))
    # nulls come first in the order of structs
    ordered = F.sort_array(F.collect_list(F.struct("turn", "turn_id", "size")))
    family = F.col("conv_id") - F.col("conv_id") % 5
    return known.withColumn("family", family).repartition("family").groupBy("family", "conv_id").agg(
        ordered.alias("turns")).select(
        "family", "conv_id", F.col("turns.turn_id").alias("ids"), F.col("turns.size").alias("sizes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)`` of all conversations with the head of their family's first one.

    The first h turns come from conversation ``c - c % 5``, the others are c's own
    after its first h, with h the CRC-32 of the decimal c modulo 9. Families of five
    are dealt to tasks once, for the grouping and for the join.
    """
    own = turn_paths(turns)
    first = own.where(F.col("conv_id") == F.col("family")).select(
        F.col("family"), F.col("ids").alias("first_ids"), F.col("sizes").alias("first_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")

    def joined(first: str, own: str, kind: str) -> Column:
        head = F.coalesce(F.slice(first, F.lit(1), h), F.array().cast(f"array<{kind}>"))
        return F.concat(head, F.slice(own, h + 1, F.size(own)))

    ids = joined("first_ids", "ids", "binary")
    path = F.aggregate(ids, F.lit(b""), lambda a, b: F.concat(a, b))
    return own.join(first, "family", "left").select(
        "conv_id", path.alias("path"), joined("first_sizes", "sizes", "bigint").alias("sizes"))


def _prefix(path: str | Column, depth: Column) -> Column:
    return F.substring(path, F.lit(1), (depth * WIDTH).cast("int"))


def burst(paths: DataFrame, capacity: int = CAPACITY, members: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """Heads ``(head, depth, size)`` below the root, and ``paths`` with the depth of their container.

    A container's turns shrink with its depth, so the heads on a path are those of
    its first depths and the container is the first prefix that did not burst.
    """
    n = F.size("sizes").cast("long")
    live = paths.select("conv_id", "path", "sizes", n.alias("n"), F.lit(1).cast("long").alias("depth"))
    heads, settled, stride = [], [], 1
    while True:
        reached = live.where(F.col("depth") <= F.col("n"))
        tried = reached.select(
            "conv_id", "path", "sizes", (F.col("n") + 1).alias("turns"),
            F.explode(F.sequence("depth", F.least("n", F.col("depth") + stride - 1))).alias("at"))
        keyed = tried.select("conv_id", "at", "turns", _prefix("path", F.col("at")).alias("head"),
                             F.get("sizes", (F.col("at") - 1).cast("int")).alias("size"))
        full = stored(keyed.groupBy("head").agg(
            F.min("at").alias("depth"), F.min("size").alias("size"), F.sum("turns").alias("turns"),
            F.count("*").alias("members"))
            .where((F.col("turns") > capacity) & (F.col("members") > members)).drop("turns", "members"), "heads")
        if full.isEmpty():
            break
        heads.append(full)
        met = keyed.join(small_or_shuffled(full.select("head")), "head").groupBy("conv_id").agg(
            F.max("at").alias("met"))
        moved = stored(live.join(met, "conv_id", "left").select(
            "conv_id", "path", "sizes", "n", F.coalesce(F.col("met") + 1, F.col("depth")).alias("depth"),
            # all depths tried were full, and there are more
            ((F.coalesce("met", F.lit(0)) == F.col("depth") + stride - 1) & (F.col("met") < F.col("n"))).alias("on")),
            "burst")
        settled.append(moved.where(~F.coalesce("on", F.lit(False))).drop("on"))
        live, stride = moved.where("on").drop("on"), 2 * stride
    placed = reduce(DataFrame.unionByName, [*settled, live])
    none = paths.sparkSession.createDataFrame([], "head binary, depth long, size long")
    return reduce(DataFrame.unionByName, heads, none), placed


# ---------------------------------------------------------------- containers

class _Sweep:
    """Nodes of one container, from its members in the order of their paths."""

    def __init__(self, depth: int):
        self.depth = depth
        # per node: depth, parent, smallest member, members, size of the last text, digest of its ends
        self.nodes: list[list] = []
        self.stack: list[int] = []
        self.last = b""

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        nodes, stack, top = self.nodes, self.stack, self.depth
        same, most = top - 1, min(len(path), len(self.last)) // WIDTH
        if stack:
            same = most if path[:most * WIDTH] == self.last[:most * WIDTH] else top
            while same < most and path[same * WIDTH:(same + 1) * WIDTH] == self.last[same * WIDTH:(same + 1) * WIDTH]:
                same += 1
            del stack[same - top + 1:]
        for depth in range(same + 1, len(sizes) + 1):
            nodes.append([depth, stack[-1] if stack else -1, conv, 0, sizes[depth - 1], None])
            stack.append(len(nodes) - 1)
        for at in stack:
            node = nodes[at]
            node[3] += 1
            if conv < node[2]:
                node[2] = conv
        end = nodes[stack[-1]]
        if end[5] is None:
            end[5] = hashlib.sha256(b"%d" % conv)
        else:
            end[5].update(b",%d" % conv)
        self.last = path

    def rows(self) -> Iterator[tuple]:
        """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
        nodes = self.nodes
        children, leaves = [0] * len(nodes), [0] * len(nodes)
        saved = [(node[3] - 1) * node[4] for node in nodes]
        for i in range(len(nodes) - 1, -1, -1):  # parents come before their children
            leaves[i] = leaves[i] or 1
            if (parent := nodes[i][1]) >= 0:
                children[parent] += 1
                leaves[parent] += leaves[i]
                saved[parent] += saved[i]
        for i, (depth, parent, conv, n, _, ends) in enumerate(nodes):
            yield (conv, depth, nodes[parent][2] if parent >= 0 else None, n, children[i], leaves[i], saved[i],
                   ends.hexdigest() if ends else _EMPTY)


_SWEPT = pa.schema([
    *((name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                      "saved_tokens")),
    ("ends_sha256", pa.string()), ("above", pa.binary())])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by container, path and member; ``above`` is the head over a container's top node."""
    sweep, container, found = None, None, []

    def closed():
        above = container[:-WIDTH]
        return [(*row, above if row[1] == sweep.depth else None) for row in sweep.rows()]

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*rows), _SWEPT)], schema=_SWEPT)

    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("conv_id", "path", "sizes", "depth")]
        for conv, path, sizes, depth in zip(*columns):
            if container is None or path[:depth * WIDTH] != container:
                if sweep:
                    found += closed()
                    if len(found) > CAPACITY:
                        yield table(found)
                        found = []
                sweep, container = _Sweep(depth), path[:depth * WIDTH]
            sweep.add(conv, path, sizes)
    if sweep:
        found += closed()
    if found:
        yield table(found)


def swept(held: DataFrame) -> DataFrame:
    """Nodes inside containers; ``parent_conv_id`` is null and ``above`` set for their tops."""
    shards = held.withColumn("container", _prefix("path", F.col("depth"))).repartition("container")
    ordered = shards.drop("container").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_swept, NODE + ", above binary")


# --------------------------------------------------------------------- heads

def _texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Neighbouring members of one head as a text, at most so many at once."""
    schema = pa.schema([("head", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    head, convs = None, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip((head, convs[0], ",".join(map(str, convs))), schema)], schema=schema)

    for batch in batches:
        for new, conv in zip(batch["head"].to_pylist(), batch["conv_id"].to_pylist()):
            if convs and (new != head or len(convs) == most):
                yield row()
                convs = []
            head = new
            convs.append(conv)
    if convs:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("head", pa.binary()), ("ends_sha256", pa.string())])
    head, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([head], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)

    for batch in batches:
        for new, ids in zip(batch["head"].to_pylist(), batch["ids"].to_pylist()):
            if digest is not None and new == head:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                yield row()
            head, digest = new, hashlib.sha256(ids.encode())
    if digest is not None:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(head, ends_sha256)`` of ``(head, conv_id)``, hot heads by ranges of their members."""
    ranges = ends.repartitionByRange("head", "conv_id").sortWithinPartitions("head", "conv_id")
    texts = ranges.mapInArrow(_texts, "head binary, first long, ids string")
    return texts.repartition("head").sortWithinPartitions("head", "first").mapInArrow(
        _digests, "head binary, ends_sha256 string")


def _upwards(heads: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums over every head and the heads below it."""
    above = F.transform(F.sequence(F.lit(0).cast("long"), F.col("depth")), lambda d: _prefix("head", d))
    return heads.withColumn("over", F.explode(above)).groupBy(F.col("over").alias("head")).agg(
        *[value.alias(name) for name, value in sums.items()])


def head_nodes(heads: DataFrame, tops: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of heads, with ``head``; ``parent`` names the head above (null for the root)."""
    below = tops.groupBy(F.col("above").alias("head")).agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.count("*").alias("children"))
    here = ends.groupBy("head").agg(F.count("*").alias("n_here"), F.min("conv_id").alias("least_here"))
    inner = heads.where("depth > 0").groupBy(_prefix("head", F.col("depth") - 1).alias("head")).agg(
        F.count("*").alias("heads"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    own = stored(
        heads.join(below, "head", "left").join(here, "head", "left").join(inner, "head", "left").select(
            "head", "depth", "size", (zero("n") + zero("n_here")).alias("n"),
            F.least("least", "least_here").alias("least"), zero("saved").alias("saved"),
            (zero("children") + zero("heads")).alias("n_children"),
            F.when(zero("children") + zero("heads") == 0, 1).otherwise(zero("leaves")).alias("leaves")), "own")
    members = own.drop("n", "least", "leaves").join(_upwards(own, {
        "n_convs": F.sum("n"), "conv_id": F.min("least"), "n_leaves": F.sum("leaves")}), "head")
    kept = stored(members.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size")), "members")
    return kept.drop("saved", "size").join(
        _upwards(kept, {"saved_tokens": F.sum("saved")}), "head").join(ends_digests(ends), "head", "left").select(
        "*", F.when(F.col("depth") > 0, _prefix("head", F.col("depth") - 1)).alias("parent"))


def prefix_nodes(paths: DataFrame, capacity: int = CAPACITY, members: int = MEMBERS) -> DataFrame:
    """One row per trie node of ``(conv_id, path, sizes)``, with the columns of :data:`NODE`."""
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    full, placed = burst(paths, capacity, members)
    root = spark.createDataFrame([(b"", 0, 0)], "head binary, depth long, size long")
    heads = (full.unionByName(root) if not paths.isEmpty() else full)
    ends = placed.where(F.col("depth") > F.col("n")).select(F.col("path").alias("head"), "conv_id")
    nodes = stored(swept(placed.where(F.col("depth") <= F.col("n")).select("conv_id", "path", "sizes", "depth")),
                   "nodes")
    tops = nodes.where(F.col("above").isNotNull())
    known = stored(head_nodes(heads, tops, ends), "head_nodes")
    parents = small_or_shuffled(known.select(F.col("head").alias("above"), F.col("conv_id").alias("up")))
    names = [field.split()[0] for field in NODE.split(", ")]
    of_tops = tops.join(parents, "above").withColumn("parent_conv_id", F.col("up"))
    of_heads = known.join(parents, F.col("parent") == F.col("above"), "left").select(
        "*", F.col("up").alias("parent_conv_id")).withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    return reduce(DataFrame.unionByName, [
        df.select(*names) for df in (nodes.where(F.col("above").isNull()), of_tops, of_heads)])


def nodes(turns: DataFrame, capacity: int = CAPACITY, members: int = MEMBERS) -> DataFrame:
    """The trie of the rebuilt conversations of ``(conv_id, turn, role, text)``."""
    return prefix_nodes(rebuilt(turns.select("conv_id", "turn", "role", "text")), capacity, members)
