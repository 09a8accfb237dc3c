"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased letters.
A document is a mixture of languages: expectation-maximisation estimates the
proportions, and the set of languages is the nested set (by proportion) of the
largest log-likelihood less ``log(n)`` per language, n trigrams.

The model is ``2 ** BITS`` numbers per language whatever the corpus, so it is
summed up in Spark, fetched and sent with the tasks; texts never leave theirs.

Defined cases: a null text, a text without a letter and a corpus without
learned languages give ``und``, score 0; equal proportions go to the language
first in order; repeated rows are predicted each; rows with a null language are
not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.llm.shared import bucket_of
from paperweave.llm.words import LOWER, slices, utf8

BITS = 16
STEPS = 8          # of expectation-maximisation
SMOOTHING = 0.5    # added to every trigram count
UNKNOWN = "und"
SLICE = 1 << 19    # bytes of text worked on at once

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_NORMAL = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)

PREDICTION = ("lang_pred string, score double, share double, "
              "languages array<string>, shares array<double>")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    probability: np.ndarray  # trigram x language


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and the text each belongs to."""
    data, at = utf8(texts)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    padded = np.full(len(data) + 2 * (len(at) - 1), 0x20, np.uint8)
    padded[np.arange(len(data)) + 2 * text + 1] = _NORMAL[data]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at) + 2)
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    blank = padded == 0x20
    use = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:]) & (owner[:-2] == owner[2:])
    code = (a[use].astype(np.uint32) << 16) | (b[use].astype(np.uint32) << 8) | c[use]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), owner[:-2][use]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of one task by language, given out whenever many languages are held."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(counts[at])], ["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches, "text", SLICE):
        codes = batch["lang"].dictionary_encode()
        of_text = codes.indices.to_numpy(zero_copy_only=False)
        gram, text = trigrams(batch["text"])
        names = codes.dictionary.to_pylist()
        counts = np.bincount((of_text[text].astype(np.int64) << BITS) | gram,
                             minlength=len(names) << BITS).reshape(len(names), 1 << BITS)
        for name, row in zip(names, counts):
            held[name] = held.get(name, 0) + row
        if len(held) > 256:
            yield from out()
    yield from out()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn a trigram distribution for every value of ``lang``."""
    known = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")) \
        .where("text IS NOT NULL AND lang IS NOT NULL")
    sums = known.mapInArrow(_counted, "lang string, gram int, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums["lang"].unique().to_pylist()))
    counts = np.zeros((1 << BITS, len(languages)))
    if languages:
        index = {name: i for i, name in enumerate(languages)}
        codes = sums["lang"].combine_chunks().dictionary_encode()
        place = np.array([index[x] for x in codes.dictionary.to_pylist()])
        counts[sums["gram"].to_numpy(), place[codes.indices.to_numpy()]] = sums["n"].to_numpy()
    smooth = counts + SMOOTHING
    return LanguageModel(languages, (smooth / smooth.sum(0, keepdims=True)).astype(np.float32))


def _mixture(p, n, text, starts, total, theta):
    """Proportions and log-likelihood of each text after :data:`STEPS` steps."""
    for _ in range(STEPS):
        part = p * theta[text]
        part *= (n / np.maximum(part.sum(1), 1e-30))[:, None]
        theta = np.add.reduceat(part, starts) / total[:, None]
    fit_ = np.log(np.maximum((p * theta[text]).sum(1), 1e-30))
    return theta, np.add.reduceat(n * fit_, starts)


def proportions(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Languages' proportions in each text (outside the chosen set 0), and trigram numbers."""
    size = len(model.languages)
    result, total_of = np.zeros((len(texts), size)), np.zeros(len(texts), np.int64)
    gram, text = trigrams(texts)
    if not len(gram) or not size:
        return result, total_of
    key, n = np.unique((text << BITS) | gram, return_counts=True)
    gram, text = key & ((1 << BITS) - 1), key >> BITS
    ids, starts, local = np.unique(text, return_index=True, return_inverse=True)
    p, n = model.probability[gram], n.astype(np.float32)
    total = np.add.reduceat(n, starts)
    single = np.add.reduceat(n[:, None] * np.log(p), starts)
    best = np.argmax(single, 1)
    rows = np.arange(len(ids))
    chosen = np.zeros((len(ids), size))
    chosen[rows, best] = 1
    value = single[rows, best] - np.log(total + 1)
    if size > 1:
        even = np.full((len(ids), size), 1 / size, np.float32)
        full, likely = _mixture(p, n, local, starts, total, even)
        order = np.argsort(-full, 1, kind="stable")
        for k in range(2, size + 1):
            if k == size:
                theta, fit_ = full, likely
            else:
                start = np.zeros_like(full)
                np.put_along_axis(start, order[:, :k], np.float32(1 / k), 1)
                theta, fit_ = _mixture(p, n, local, starts, total, start)
            better = fit_ - k * np.log(total + 1) > value
            value = np.where(better, fit_ - k * np.log(total + 1), value)
            chosen[better] = theta[better]
    result[ids], total_of[ids] = chosen, total
    return result, total_of


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a Unicode letter occurs; read character by character only without an ASCII one."""
    data, at = utf8(texts)
    ascii_letter = np.append(0, np.cumsum(_LETTER[data] & (data < 0x80)))
    high = np.append(0, np.cumsum(data >= 0x80))
    found = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~found & (high[at[1:]] > high[at[:-1]])):
        found[i] = any(c.isalpha() for c in data[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def _predicted(texts: pa.Array, model: LanguageModel) -> list[pa.Array]:
    share, total = proportions(texts, model)
    known = has_letter(texts) & (total > 0)
    size = len(model.languages)
    best = np.argmax(share, 1) if size else np.zeros(len(texts), int)
    top = share[np.arange(len(texts)), best] if size else np.zeros(len(texts))
    score = np.where(known, (top * total + 1) / (total + max(size, 1)), 0.0)
    names = np.array([*model.languages, UNKNOWN], object)
    row, col = np.nonzero((share > 0) & known[:, None])
    at = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))).astype(np.int32)
    return [
        pa.array(names[np.where(known, best, size)], pa.string()), pa.array(np.clip(score, 0, 1)),
        pa.array(np.where(known, top, 0.0)),
        pa.ListArray.from_arrays(pa.array(at), pa.array(names[col], pa.string())),
        pa.ListArray.from_arrays(pa.array(at), pa.array(share[row, col].astype(np.float64))),
    ]


def predict(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its id, language, score (the share of the language, smoothed by the
    number of trigrams), and the languages of its set with their shares."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *_predicted(batch["text"], model)],
                ["id", "lang_pred", "score", "share", "languages", "shares"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")) \
        .mapInArrow(run, f"id {kind}, {PREDICTION}").withColumnRenamed("id", id)


def identified(docs: DataFrame, model: LanguageModel, least: float = 0.5,
               text: str = "text") -> DataFrame:
    """The documents, columns as they are, whose language is known and has at least the share
    ``least`` of the text."""
    def run(batches):
        for batch in slices(batches, text, SLICE):
            name, _, share, *_ = _predicted(batch[text], model)
            keep = (name.to_numpy(False) != UNKNOWN) & (share.to_numpy() >= least)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether a document is kept from learning."""
    return bucket_of(id, folds) == fold
