"""Byte-pair encoding of whole texts, long unsplit parts by tree concatenation.

Pairs are merged inside the parts that the tokenizer cuts a text into. Parts of
ordinary length are encoded where a text is read. A part longer than
:data:`LEAF` bytes (a run of letters without a blank, as in some scripts, or of
marks) is cut into leaves anywhere, the leaves are encoded by different tasks,
and neighbours are joined pair by pair up a tree: the last tokens of the left
half and the first of the right are encoded anew as one text, twice as many each
time, until the new tokens begin with the left half's first token of the window
and end with the right half's last.

Then the join is exact: tokens are the encoding of their text if and only if
every two neighbours are that of theirs, because merges run by rank and one
across a border can only depend on the two tokens beside it. All neighbours
outside of the window were neighbours in a half, those inside are in the
window's own encoding, and the two tokens at its ends did not change.

The end-of-word mark belongs to the last leaf only: all other leaves and windows
are encoded by the same vocabulary and merges without the mark.

Defined cases: a null text is empty and has no tokens; ids and repeated rows are
returned as they are, each row by itself; texts of added tokens are those tokens;
an empty table gives an empty result; other columns are not read. A text is one
value of a row, so its tokens fit into a task; work on a long part is spread over
leaves, and each join holds the tokens of two halves.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.packing import Encoder
from paperweave.llm.shared import stored
from paperweave.llm.words import slices, utf8, words_of

#: Bytes beyond which a part is cut into leaves of about half as many.
LEAF = 8192
FIRST = 4  # tokens on each side of a join that are encoded anew at first

CODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merger:
    """Encodings of pieces of one part, with and without the mark of its end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        self.ending = Tokenizer.from_file(path)
        self.mark = setup["model"].get("end_of_word_suffix") or ""
        setup["model"]["end_of_word_suffix"] = None
        self.open = Tokenizer.from_str(json.dumps(setup))
        self.added = sorted((x["content"] for x in setup.get("added_tokens") or []), key=len, reverse=True)

    def encode(self, piece: str, last: bool) -> list[int]:
        """Ids of a piece of a part; ``last`` if the part ends with it."""
        return [t.id for t in (self.ending if last else self.open).model.tokenize(piece)]

    def text(self, ids: list[int], last: bool) -> str:
        text = "".join(map(self.ending.model.id_to_token, ids))
        return text[:len(text) - len(self.mark)] if last else text

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The encoding of the text of ``left`` and ``right``, which are encodings of theirs."""
        n = FIRST
        while True:
            a, b = max(len(left) - n, 0), min(n, len(right))
            ends = last and b == len(right)
            window = self.encode(self.text(left[a:], False) + self.text(right[:b], ends), ends)
            agreed = (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1])
            if agreed:
                return left[:a] + window + right[b:]
            n *= 2

    def tree(self, piece: str, last: bool, leaf: int) -> list[int]:
        """The encoding of a piece by halves, in one task."""
        if len(piece) <= leaf:
            return self.encode(piece, last)
        middle = len(piece) // 2
        return self.joined(self.tree(piece[:middle], False, leaf), self.tree(piece[middle:], last, leaf), last)

    def parts(self, text: str) -> Iterator[int | str]:
        """Parts of a text as the model takes them, and ids of added tokens."""
        cuts = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text) if self.added else [text]
        for i, cut in enumerate(cuts):
            if i % 2:
                yield self.ending.token_to_id(cut)
            elif cut:
                normal = self.ending.normalizer
                plain = normal.normalize_str(cut) if normal else cut
                yield from (part for part, _ in self.ending.pre_tokenizer.pre_tokenize_str(plain))


class Decoder:
    """Decoded texts: tokens, each as it stands in the vocabulary, joined by one blank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = np.full(max(names.values()) + 1, b"", object)
        for name, at in names.items():
            self.names[at] = name.encode()
        self.plain = self.tokenizer.decoder is None

    def text(self, ids: np.ndarray) -> bytes:
        if self.plain:
            return b" ".join(self.names[ids].tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()


def _digests(ids: np.ndarray, decoder: Decoder) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoder.text(ids)).hexdigest())


def _binary(ids: list[int] | np.ndarray) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


# Either the digests of a text, or pieces of it: ``ids`` of what is encoded, or a ``leaf`` of a part.
_READ = pa.schema([
    ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
    ("task", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("node", pa.int64()), ("nodes", pa.int64()),
    ("ids", pa.binary()), ("leaf", pa.string())])
_READ_DDL = CODED + ", task long, row long, part long, node long, nodes long, ids binary, leaf string"


def _leaves(part: str, leaf: int) -> list[str]:
    """Halves of halves, at most ``leaf`` long."""
    n = 1
    while len(part) > n * leaf:
        n *= 2
    cuts = [len(part) * i // n for i in range(n + 1)]
    return [part[a:b] for a, b in pairwise(cuts)]


def read(docs: DataFrame, tokenizer: str, id: str, text: str, leaf: int) -> DataFrame:
    """Every text encoded and decoded, those with long parts as pieces. A shared table."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, merger, decoder = Encoder(tokenizer, None), Merger(tokenizer), Decoder(tokenizer)
        task, row = TaskContext.get().partitionId(), 0

        def pieces(raw: bytes, start: np.ndarray, end: np.ndarray) -> list[tuple]:
            """(ids, leaf, part, node, nodes) of a text with long words, in order."""
            out, at = [], 0
            plain = lambda a, b: encoder.ids(pa.array([raw[a:b].decode("utf-8", "replace")]))[0]
            for a, b in zip(start.tolist(), end.tolist()):
                found = [plain(at, a)]
                for part in merger.parts(raw[a:b].decode("utf-8", "replace")):
                    if isinstance(part, int) or len(part) <= leaf:
                        found.append([part] if isinstance(part, int) else merger.encode(part, True))
                        continue
                    out.append((_binary(np.concatenate(found)), None, len(out), 0, 1))
                    cut, found = _leaves(part, leaf), [[]]
                    out += [(None, x, len(out), i, len(cut)) for n in [len(out)] for i, x in enumerate(cut)]
                out.append((_binary(np.concatenate(found)), None, len(out), 0, 1))
                at = b
            out.append((_binary(plain(at, len(raw))), None, len(out), 0, 1))
            return out

        for batch in slices(batches, "text"):
            texts = batch["text"]
            words, begin = words_of(texts, hashed=False), utf8(texts)[1]
            long = np.flatnonzero(words.end - words.start > leaf)
            cut = np.bincount(words.of_word()[long], minlength=batch.num_rows) > 0
            ids, at = encoder.ids(pc.if_else(pa.array(cut), pa.scalar(None, texts.type), texts) if len(long) else texts)
            rows, taken = [], []
            for i in range(batch.num_rows):
                if not cut[i]:
                    rows.append((*_digests(ids[at[i]:at[i + 1]], decoder), task, row, 0, 0, 1, None, None))
                    taken.append(i)
                else:
                    mine = long[words.of_word()[long] == i]
                    raw = words.data[begin[i]:begin[i + 1]].tobytes()
                    found = pieces(raw, words.start[mine] - begin[i], words.end[mine] - begin[i])
                    rows += [(None, None, None, task, row, part, node, nodes, data, piece)
                             for data, piece, part, node, nodes in found]
                    taken += [i] * len(found)
                row += 1
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _READ)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(taken)), *columns], names=["id", *_READ.names])

    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return stored(named.mapInArrow(run, f"id {kind}, {_READ_DDL}"), "coded")


_KEY = ["task", "row", "part"]
_NODE = "task long, row long, part long, node long, nodes long, ids binary"


def _rows(keys: list[tuple], names: str) -> pa.RecordBatch:
    fields = [x.split() for x in names.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array([k[i] for k in keys], kinds[kind]) for i, (_, kind) in enumerate(fields)],
        names=[name for name, _ in fields])


def encoded_leaves(leaves: DataFrame, tokenizer: str) -> DataFrame:
    """Leaves, spread over tasks and encoded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(tokenizer)
        for batch in batches:
            yield _rows([(r["task"], r["row"], r["part"], r["node"], r["nodes"],
                          _binary(merger.encode(r["leaf"], r["node"] == r["nodes"] - 1)))
                         for r in batch.to_pylist()], _NODE)

    return leaves.select(*_KEY, "node", "nodes", "leaf").repartition(*_KEY, "node").mapInArrow(run, _NODE)


def joined_halves(level: DataFrame, tokenizer: str) -> DataFrame:
    """One level up the tree: every two neighbours joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(tokenizer)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                left, right = (np.frombuffer(h["ids"], "<u4").tolist() for h in r["halves"])
                nodes = r["nodes"] // 2
                out.append((r["task"], r["row"], r["part"], r["node"], nodes,
                            _binary(merger.joined(left, right, r["node"] == nodes - 1))))
            yield _rows(out, _NODE)

    pairs = level.withColumn("half", F.col("node")).withColumn("node", F.expr("node div 2"))
    return pairs.groupBy(*_KEY, "node", "nodes").agg(
        F.sort_array(F.collect_list(F.struct("half", "ids"))).alias("halves")).mapInArrow(run, _NODE)


def assembled(pieces: DataFrame, tokenizer: str, kind: str) -> DataFrame:
    """Digests of texts from the ids of their pieces, which stream by in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        key, id, n, ids_hash, text_hash, kept = None, None, 0, None, None, []

        def row(type):
            if kept:
                text_hash.update(decoder.text(np.concatenate(kept)))
            return pa.RecordBatch.from_arrays(
                [pa.array([id], type), pa.array([n]), pa.array([ids_hash.hexdigest()]),
                 pa.array([text_hash.hexdigest()])],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for i, (task, of, data) in enumerate(zip(*[batch[c].to_pylist() for c in ("task", "row", "ids")])):
                if (task, of) != key:
                    if key is not None:
                        yield row(batch.schema.field("id").type)
                    # the first piece of a text is never a long part, so it has the id
                    key, id, n, ids_hash, text_hash, kept = (
                        (task, of), batch["id"][i].as_py(), 0, hashlib.sha256(), hashlib.sha256(), [])
                ids = np.frombuffer(data, "<u4")
                ids_hash.update(data)
                if not decoder.plain:
                    kept.append(ids)
                elif len(ids):
                    text_hash.update((b" " if n else b"") + decoder.text(ids))
                n += len(ids)
            last = batch.schema.field("id").type
        if key is not None:
            yield row(last)

    ordered = pieces.repartition("task", "row").sortWithinPartitions("task", "row", "part")
    return ordered.select("id", "task", "row", "ids").mapInArrow(run, f"id {kind}, {CODED}")


def coded(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every row."""
    kind = docs.schema[id].dataType.simpleString()
    found = read(docs, tokenizer, id, text, leaf)
    names = [F.col("id").alias(id), "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = found.where(F.col("n_tokens").isNotNull()).select(*names)
    leaves = found.where(F.col("leaf").isNotNull())
    if leaves.isEmpty():
        return whole
    done = [found.where(F.col("ids").isNotNull()).select("id", *_KEY, "ids")]
    level = stored(encoded_leaves(leaves, tokenizer), "leaves")
    while True:
        done.append(level.where("nodes = 1").select(F.lit(None).cast(kind).alias("id"), *_KEY, "ids"))
        left = level.where("nodes > 1")
        if left.isEmpty():
            break
        level = stored(joined_halves(left, tokenizer), "joined")
    pieces = reduce(DataFrame.unionByName, done)
    return whole.unionByName(assembled(pieces, tokenizer, kind).select(*names))
