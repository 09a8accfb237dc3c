"""The corpus pipeline: documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``. A stage works on all that the one before kept:
statistics, models and groups are those of its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import contamination, language, minhash, packing, substrings
from paperweave.llm.queries import tokenizer_file
from paperweave.llm.shared import stored, table

#: Least share of a document that its main language must have.
LEAST_SHARE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or a main language go."""
    return language.identified(docs, language.fit(docs.where(~language.held_out())), LEAST_SHARE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, that of the smallest id."""
    return minhash.deduplicated(docs)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has; ``n_chars`` follows the text."""
    cut = substrings.without_repeats(docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(length).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than a trace of the benchmark."""
    return contamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.packed(docs, tokenizer_file()).drop("ids", "queue")


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("passages", remove_passages),
    ("contamination", decontaminate),
    ("packing", pack),
]

#: Not expressible in SQL: expectation-maximisation and a tokenizer are needed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
