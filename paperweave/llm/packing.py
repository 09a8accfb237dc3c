"""Packing of tokenized documents into windows of a controlled mixture.

Every source is a queue of tokens. Deficit round robin gives each window the
target share of every queue and carries what rounding leaves over to the next
window. The order is that of an even tree over the queues: a node that has been
given n tokens has passed ``n * w // W`` of them to its left side (weight w of
W) and the rest to its right. So after any number of windows each queue is less
than one token per level away from its share, and the deficit at any place is
known without running through the windows before it: partitions are packed
independently and agree. When queues run empty the others go on in a new phase
with their weights as before. All windows but the last are full.

Order in a queue is by task and row of the token table, which is written once to
the shared folder with a running sum per task. A queue of a third of all rows is
thus summed up by parts; only sums per task and queue are shuffled, no tokens.

Defined cases: a null text is an empty document, which still has its end
token; the text of one of the file's added tokens is that token; a null source is a queue of its own; equal rows are packed each; texts
of any length are cut where a window ends; more sources than
:data:`QUEUES` share queues by hash; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweave.llm.shared import small_or_shuffled, stored
from paperweave.llm.words import LOWER, SPACE, hashes, slices, utf8, words_of

LENGTH = 2048
QUEUES = 4096      # at most; also the bound of what reaches the driver
WIDTH = 2          # bytes of an id in the token table
_MEMORY = 1_000_000  # parts of words whose ids a task remembers
_WRITTEN = np.uint64(0x9E3779B97F4A7C15)  # tells words kept as written from parts of the same letters

# Fixed value: the pattern that the short way is right for.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# ------------------------------------------------------------------- tokens

_KIND = np.full(256, 3, np.uint8)  # 0 blank, 1 letter, 2 digit, 3 other
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_KIND[SPACE] = 0


def _odd(data: np.ndarray) -> np.ndarray:
    """Bytes that are not ASCII or letters from U+00C0 to U+023F that stay one under lower-casing
    and composition, and apostrophes, which the pattern treats apart."""
    high = data >= 0x80
    lead = (data >= 0xC3) & (data <= 0xC8)
    after = np.append(False, lead[:-1])
    odd = (high & ~lead & ~after) | (data == 0x27)
    follow = np.append(data[1:], 0)
    bad = ((data == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) | ((data == 0xC4) & (follow == 0xB0))
    return odd | bad


class Encoder:
    """Ids of many texts, every distinct part of a word encoded once per run.

    Right for tokenizers that drop white space and never join across it. For the
    pattern of letters, single digits and other characters, words are cut into
    their parts here and a part is given to the tokenizer's model; words with
    unusual characters or an added token in them, and all words of tokenizers
    built in another way, go through the whole tokenizer.
    """

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self._forget()
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        # Cut out of texts before anything else: words with one are given as they are written.
        self.added = {x["content"].encode().translate(LOWER.tobytes()) for x in setup.get("added_tokens") or []} - {b""}
        steps = [x.get("type") for x in (setup["normalizer"] or {}).get("normalizers", [])]
        cuts = (setup["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cut = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] \
            and cuts[0]["pattern"] == {"Regex": _PATTERN} and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" \
            and not cuts[1]["add_prefix_space"]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = iter(range(0x100, 0x200))  # stand for the bytes that cannot be shown, in their order
        self.shown = "".join(chr(b) if b in visible else chr(next(hidden)) for b in range(256))

    def _encoded(self, part: bytes, odd: bool) -> tuple[int, ...]:
        text = part.decode("utf-8", "replace")
        if odd:
            return tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not (text.isascii() and text.isprintable()):
            text = text.lower().encode().decode("latin-1").translate(self.shown)
        return tuple([t.id for t in self.tokenizer.model.tokenize(text)])

    def _forget(self) -> None:
        """No part is known. Known ones are kept by hash in order, their ids in one array."""
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def _learn(self, raw: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> None:
        encoded, tokenize, found = self._encoded, self.tokenizer.model.tokenize, []
        for a, b, whole in zip(start.tolist(), end.tolist(), odd.tolist()):
            part = raw[a:b]
            if whole or not part.isalnum():  # bytes: ASCII only
                found.append(encoded(part, whole))
            else:
                found.append([t.id for t in tokenize(part.decode("ascii"))])
        size = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
        keys, begin, size = (np.append(x, y) for x, y in ((self.keys, keys), (self.begin, begin), (self.size, size)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], begin[order], size[order]

    def _with_added(self, lower: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words in which the text of an added token stands, in letters of any case."""
        found = []
        for token in self.added:
            at = lower.find(token)
            while at >= 0:
                word = int(np.searchsorted(start, at, "right")) - 1
                if word >= 0 and at + len(token) <= end[word]:
                    found.append(word)
                at = lower.find(token, at + 1)
        return np.unique(np.array(found, np.int64))

    def _parts(self, texts: pa.Array):
        """Bytes in lower case, start, end and key of every part, whether it is a whole odd word,
        and parts per text."""
        data, at = utf8(texts)
        odd_sum = np.append(0, np.cumsum(_odd(data)))
        words = words_of(texts, hashed=False)
        odd = (odd_sum[words.end] > odd_sum[words.start]) | (not self.cut)
        lower = LOWER[data]
        written = self._with_added(lower.tobytes(), words.start, words.end)
        odd[written] = True
        for word in written:
            lower[words.start[word]:words.end[word]] = data[words.start[word]:words.end[word]]
        kind = _KIND[data]
        whole = np.zeros(len(data) + 1, np.int8)  # inside odd words
        np.add.at(whole, words.start[odd], 1)
        np.add.at(whole, words.end[odd], -1)
        inside = np.cumsum(whole[:-1]) > 0
        kind[inside] = 4
        begins = np.append(True, kind[1:] != kind[:-1])[:len(kind)] | (kind == 2)
        begins[words.start] = True
        begins &= kind > 0
        start = np.flatnonzero(begins)
        over = np.flatnonzero(np.append(begins | (kind == 0), True))
        end = over[np.searchsorted(over, start, "right")] if len(start) else start
        keys = hashes(lower, start, end)
        keys[np.searchsorted(start, words.start[written])] ^= _WRITTEN
        return lower, start, end, keys, inside[start] if len(start) else np.zeros(0, bool), np.searchsorted(start, at)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text starts and the last ends."""
        if len(self.keys) > _MEMORY:
            self._forget()
        lower, start, end, keys, odd, first_part = self._parts(texts)
        code, distinct = pd.factorize(keys)
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        new = np.flatnonzero(~self._held(distinct)[1])
        if len(new):
            self._learn(lower.tobytes(), distinct[new], start[first[new]], end[first[new]], odd[first[new]])
        at, _ = self._held(distinct)
        begin, size, flat = self.begin[at], self.size[at], self.flat
        n = size[code] if len(code) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(begin[code] - total[:-1], n) + np.arange(total[-1])] if len(code) else flat[:0]
        bounds = total[first_part]
        if self.end is not None:
            ids = np.insert(ids, bounds[1:], self.end)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


def tokenized(docs: DataFrame, tokenizer: str, end: int | None, id: str, text: str, source: str) -> DataFrame:
    """``(id, source, part, local, n, ids)``: ids as little-endian 16-bit numbers, and where a
    document starts among the tokens of its source in its task. A shared table."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(tokenizer, end), TaskContext.get().partitionId()
        sums: dict[str | None, int] = {}
        for batch in slices(batches, "text"):
            ids, at = encoder.ids(batch["text"])
            if len(ids) and ids.max() >= 1 << (8 * WIDTH):
                raise ValueError("the vocabulary needs wider ids")
            data, local = ids.astype(f"<u{WIDTH}"), []
            for name, n in zip(batch["source"].to_pylist(), np.diff(at).tolist()):
                local.append(sums.get(name, 0))
                sums[name] = local[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["source"], pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64()),
                 pa.array(np.diff(at)), pa.array([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                ["id", "source", "part", "local", "n", "ids"])

    named = docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return stored(named.mapInArrow(run, f"id {kind}, source string, part int, local long, n long, ids binary"), "tokens")


# ------------------------------------------------------------- the round robin

@dataclass
class Phase:
    """A stretch of the stream in which the same queues take turns."""

    queues: list[int]
    weights: list[int]
    start: int = 0   # in the stream
    length: int = 0
    taken: dict[int, int] = field(default_factory=dict)  # of each queue before the phase

    def __post_init__(self):
        self.path: dict[int, list[tuple[int, int, bool]]] = {q: [] for q in self.queues}  # leaf to root
        self._split(0, len(self.queues))

    def _split(self, lo: int, hi: int) -> int:
        if hi - lo == 1:
            return self.weights[lo]
        mid = (lo + hi) // 2
        left, right = self._split(lo, mid), self._split(mid, hi)
        for i in range(lo, hi):
            self.path[self.queues[i]].append((left, left + right, i < mid))
        return left + right

    def given(self, queue: int, n):
        """Tokens of ``queue``, and of the queues left of it, among the first ``n`` of the phase."""
        before = n * 0
        for part, whole, left in reversed(self.path[queue]):
            share = n * part // whole
            before, n = (before, share) if left else (before + share, n - share)
        return n, before

    def place(self, queue: int, x: int) -> int:
        """Where in the phase token ``x`` of ``queue`` comes."""
        for part, whole, left in self.path[queue]:
            x = ((x + 1) * whole - 1) // part if left else x * whole // (whole - part)
        return x


def schedule(tokens: list[int], targets: list[float] | None = None) -> list[Phase]:
    """Phases for queues of so many tokens; targets are their own sizes unless given."""
    left = {q: n for q, n in enumerate(tokens) if n}
    total = sum(left.values())
    room = 2 ** 62 // max(total, 1)  # so that a number of tokens times a weight fits 64 bits
    wanted = [int(n) for n in tokens] if targets is None else [int(t * 2 ** 40) for t in targets]
    phases, start, taken = [], 0, {q: 0 for q in left}
    while left:
        queues = sorted(left)
        whole = sum(max(wanted[q], 1) for q in queues)
        weights = [max(wanted[q], 1) if whole <= room else max(max(wanted[q], 1) * room // (2 * whole), 1)
                   for q in queues]
        phase = Phase(queues, weights, start, 0, dict(taken))
        most = sum(left.values())
        for q in queues:  # the longest stretch that no queue runs out of
            lo, hi = 0, most
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if phase.given(q, mid)[0] <= left[q] else (lo, mid - 1)
            most = lo
        phase.length = most
        if most:
            phases.append(phase)
        for q in queues:
            got = phase.given(q, most)[0]
            taken[q] += got
            left[q] -= got
        done = [q for q in queues if not left[q]]
        for q in done:
            del left[q]
        start += most
    return phases


def pieces(phases: list[Phase], queue: int, begin: int, n: int, length: int = LENGTH):
    """Cut ``n`` tokens that begin at ``begin`` in ``queue``: start, length, sequence and offset."""
    for phase in phases:
        if queue not in phase.path:
            continue
        zero = phase.taken[queue]
        lo, hi = max(begin - zero, 0), min(begin + n - zero, phase.given(queue, phase.length)[0])
        if lo >= hi:
            continue
        first = (phase.start + phase.place(queue, lo)) // length
        last = (phase.start + phase.place(queue, hi - 1)) // length
        cells = np.clip(np.arange(first, last + 2) * length - phase.start, 0, phase.length)
        mine, before = phase.given(queue, cells)
        at, to = np.maximum(mine[:-1], lo), np.minimum(mine[1:], hi)
        inside = phase.start + cells[:-1] - np.arange(first, last + 1) * length  # where the cell starts
        offset = inside + np.diff(before) + at - mine[:-1]
        some = to > at
        yield from zip((at + zero - begin)[some].tolist(), (to - at)[some].tolist(),
                       np.arange(first, last + 1)[some].tolist(), offset[some].tolist())


def packed(docs: DataFrame, tokenizer: str, end: int | None = 1, id: str = "doc_id", text: str = "text",
           source: str = "source", targets: dict[str | None, float] | None = None,
           length: int = LENGTH) -> DataFrame:
    """A row per piece of a document: ``(id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, queue, ids)``. ``targets`` weighs the sources; by default by their tokens."""
    tokens = tokenized(docs, tokenizer, end, id, text, source)
    spark = docs.sparkSession
    many = targets is None and tokens.select("source").distinct().limit(QUEUES + 1).count() > QUEUES
    key = F.concat(F.lit("queue "), F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("string")) if many \
        else F.col("source")
    tokens = tokens.withColumn("queue", key)
    parts = stored(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")), "parts")
    sums = sorted(((r["queue"], r["n"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()),
                  key=lambda r: (r[0] is not None, r[0]))
    names = [q for q, _ in sums]
    phases = schedule([n for _, n in sums], None if targets is None else [targets.get(q, 0.0) for q in names])
    number = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, number int")
    along = Window.partitionBy("queue").orderBy("part")
    base = stored(parts.withColumn("base", F.sum("n").over(along) - F.col("n"))
                  .join(F.broadcast(number), parts["queue"].eqNullSafe(number["queue"])).drop(number["queue"])
                  .select(F.col("queue").alias("queue_"), F.col("part").alias("part_"), "base", "number"), "base")
    placed = tokens.join(small_or_shuffled(base), (F.col("part") == F.col("part_"))
                         & F.col("queue").eqNullSafe(F.col("queue_"))) \
        .select("id", "queue", "number", (F.col("base") + F.col("local")).alias("begin"), "n", "ids")
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            rows, out = [], [[] for _ in range(7)]
            columns = [batch[c].to_pylist() for c in ("number", "begin", "n", "ids")]
            for i, (q, begin, n, ids) in enumerate(zip(*columns)):
                for start, size, sequence, offset in pieces(phases, q, begin, n, length):
                    own = ids[WIDTH * start:WIDTH * (start + size)]
                    if WIDTH == 2:
                        own = np.frombuffer(own, "<u2").astype("<u4").tobytes()
                    rows.append(i)
                    for column, value in zip(out, (start, size, zlib.crc32(own), n, sequence, offset, own)):
                        column.append(value)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(at), batch["queue"].take(at), *[pa.array(x, pa.int64()) for x in out[:6]],
                 pa.array(out[6], pa.binary())],
                ["id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(run, f"id {kind}, queue string, {PIECE}, ids binary").withColumnRenamed("id", id)


def sequences(packed: DataFrame, pad: int = 0, length: int = LENGTH) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: whole sequences of 32-bit ids, padded to ``length`` unless
    their length is a power of two."""
    joined = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    one = F.unhex(F.lit(pad.to_bytes(4, "little").hex()))
    n = F.col("n_tokens")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(length - n).cast("int")
    body = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", "n_tokens", F.concat(
        body, F.unhex(F.repeat(F.hex(one), missing))).alias("ids"))
