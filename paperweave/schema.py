"""Schemas and fixed dimensions of the harvest data model.

Absent text is ``''``, never NULL, so a record always carries all its fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of one paper record, in output order.
RECORD_FIELDS = [
    "url", "title", "authors", "unit", "publication", "keywords", "abstract",
    "year", "volume", "issue", "pagecode", "doi", "sponser", "type",
]

# The fields that a search can name.
SEARCH_FIELDS = ["title", "authors", "keywords", "unit"]

# Mode digit -> site name as kept in the frontier.
SITES = {1: "Cnki", 2: "Cqvip", 3: "Wanfang"}

# Page layout of each site.
LAYOUT_OF_SITE = dict(zip(SITES.values(), "ABC"))

# Link states.
INITIAL, IN_PROGRESS, FINISHED = 0, 10, 20
WRONG_DATE, ERROR, INVALID = -5, -10, -15

STATE_LABELS = {
    INVALID: "invalid link",
    ERROR: "error",
    WRONG_DATE: "wrong date",
    INITIAL: "initial",
    IN_PROGRESS: "in progress",
    FINISHED: "finished",
}

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# Place of a transition in the log, compared part by part: run, phase of the run, page, place on the page.
SEQ_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in ("run", "phase", "page_id", "position")])

# One row per state change of a link. A plain file table cannot be updated in
# place, so the current state is the fold of this log (see operators.frontier).
TRANSITION_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("state", T.IntegerType()),
    T.StructField("seq", SEQ_TYPE),
])

RECORD_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in RECORD_FIELDS]
    + [T.StructField("source", T.StringType())]
)

# ``id`` is the arrival number of the record that created the row.
RESULT_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in RECORD_FIELDS]
    + [T.StructField("source", T.StringType())]
)


def state_dimension(spark: SparkSession) -> DataFrame:
    """The six link states with their meaning."""
    return spark.createDataFrame(
        list(STATE_LABELS.items()),
        T.StructType([
            T.StructField("state", T.IntegerType()),
            T.StructField("label", T.StringType()),
        ]),
    )


def with_record_defaults(df: DataFrame) -> DataFrame:
    """Add every missing record field and turn NULL text into ``''``."""
    have = set(df.columns)
    text = RECORD_FIELDS + ["source"]
    keep = [c for c in df.columns if c not in text]
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
            if c in have else F.lit("").alias(c)
            for c in text
        ],
    )
