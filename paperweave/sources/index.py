"""An inverted index of the fields that searches ask for.

Every place of a field is listed by the one, two and three characters that stand
there, in lower case: ``(field, gram, id, at)``, in order of the grams. A text is
covered by grams of three characters (of its own length where it is shorter), and a
field contains it exactly where all of them stand at their distances. So a search
reads the places of its grams, neither records nor other places, and needs no look
at the records to be exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.operators.search import wanted_texts
from paperweave.schema import SEARCH_FIELDS

LONGEST = 3


def cover(text: str) -> list[tuple[int, str]]:
    """Grams that make up a text, with their distance from its start."""
    if len(text) <= LONGEST:
        return [(0, text)]
    starts = [*range(0, len(text) - LONGEST, LONGEST), len(text) - LONGEST]
    return [(at, text[at:at + LONGEST]) for at in starts]


def places(records: DataFrame, id: str, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """``(field, gram, id, at)`` of all fields; a null field has no places."""
    def grams(n: int) -> Column:
        size = F.length("text")
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(
            F.substr("text", at, F.lit(n)).alias("gram"), (at - 1).alias("at")))

    texts = records.select(F.col(id).alias("id"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), F.lower(name).alias("text")) for name in fields])).alias("f"))
    return texts.select("id", "f.field", "f.text").select("field", "id", F.explode(
        F.concat(*[grams(n) for n in range(1, LONGEST + 1)])).alias("g")).select("field", "g.gram", "id", "g.at")


class SearchIndex:
    """The places of a table's fields, written once and searched often."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, records: DataFrame, id: str, fields: list[str] = SEARCH_FIELDS) -> None:
        """Write the index. A gram that many records have is cut by their ids."""
        found = places(records, id, fields)
        found.repartitionByRange("field", "gram", "id").sortWithinPartitions("field", "gram", "id").write.partitionBy(
            "field").parquet(f"{self.path}/places")
        records.select(F.col(id).alias("id")).write.parquet(f"{self.path}/ids")

    def _containing(self, field: str, text: str) -> DataFrame:
        """Ids of the records whose field contains a text."""
        grams = cover(text)
        rows = self.spark.read.parquet(f"{self.path}/places").where(
            (F.col("field") == field) & F.col("gram").isin(sorted({gram for _, gram in grams})))
        if len(grams) == 1:
            return rows.select("id").distinct()
        known = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(gram).alias("gram")) for at, gram in grams])
        offsets = F.transform(F.filter(known, lambda g: g["gram"] == F.col("gram")), lambda g: g["at"])
        starts = rows.select("id", "at", F.explode(offsets).alias("offset")).select(
            "id", (F.col("at") - F.col("offset")).alias("start"))
        # a start has at most one place for each gram of the text
        return starts.groupBy("id", "start").count().where(F.col("count") == len(grams)).select("id").distinct()

    def matching(self, **criteria: str) -> DataFrame:
        """Ids of the records that meet all criteria, as ``search.matches`` decides."""
        wanted = wanted_texts(**criteria)
        if not wanted:
            return self.spark.read.parquet(f"{self.path}/ids")
        found = reduce(DataFrame.unionByName, [self._containing(f, text) for f, text in wanted.items()])
        return found.groupBy("id").count().where(F.col("count") == len(wanted)).select("id")
