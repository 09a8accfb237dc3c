"""Frontier of links with processing states.

The frontier is an append-only log of transitions ``(url, source, state, seq)``.
The state of a link is that of its last transition, so leasing, finishing and
recovering links only append rows and never rewrite a table. ``seq`` orders the
log; it has the parts of :func:`number`, wherever a transition comes from. Whatever
makes new rows asks for a ``seq`` beyond those of the log; :func:`following` finds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.schema import (
    ERROR, FINISHED, IN_PROGRESS, INITIAL, INVALID, WRONG_DATE, state_dimension,
)

PENDING = (INITIAL, ERROR)


def number(run: int | Column, phase: int = 0, page: Column | None = None, place: Column | None = None) -> Column:
    """Place of a transition in the log: run, phase, list page, place on the page.

    Compared part by part, so any page number is in order.
    """
    parts = {"run": F.lit(run) if isinstance(run, int) else run, "phase": F.lit(phase),
             "page_id": F.lit(0) if page is None else page, "position": F.lit(0) if place is None else place}
    return F.struct(*[c.cast("bigint").alias(n) for n, c in parts.items()])


def first_arrivals(links: DataFrame) -> DataFrame:
    """One row per url: the one with the lowest ``seq``, whatever its site.

    Aggregates before the shuffle, so an url that fills a third of the input
    still arrives as one row per task.
    """
    rest = [c for c in links.columns if c != "url"]
    first = F.min_by(F.struct(*rest), F.col("seq")).alias("_first")
    return links.groupBy("url").agg(first).select(
        "url", *[F.col("_first")[c].alias(c) for c in rest]
    ).select(*links.columns)


def insert_ignore(links: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """New links only: first arrivals whose url the frontier does not hold."""
    new = first_arrivals(links)
    if frontier is not None:
        new = new.join(frontier.select("url").distinct(), "url", "left_anti")
    return new.select(*links.columns)


def transitions(links: DataFrame, state: int | Column, seq: Column) -> DataFrame:
    """Rows for the transition log."""
    state = F.lit(state) if isinstance(state, int) else state
    return links.select("url", "source", state.cast("int").alias("state"), seq.alias("seq"))


def next_run(log: DataFrame) -> int:
    """Number of the run after all those of a log; reads one column."""
    last = log.agg(F.max("seq.run")).first()[0]
    return 0 if last is None else last + 1


def following(log: DataFrame) -> Column:
    """A place after all those of a log: the start of its next run."""
    return number(next_run(log))


def current_state(log: DataFrame) -> DataFrame:
    """Last state per url (last write wins)."""
    return log.groupBy("url").agg(
        F.max_by("source", "seq").alias("source"),
        F.max_by("state", "seq").alias("state"),
        F.max("seq").alias("seq"),
    )


def pending(frontier: DataFrame, n: int = 20, mode_sources: list[str] | None = None,
            salts: int = 64) -> DataFrame:
    """The first ``n`` waiting links of every source, in order of ``seq``.

    Two steps: the first ``n`` of every slice of a source, then the first ``n``
    of those. No task sorts all links of a source.
    """
    waiting = frontier.where(F.col("state").isin(*PENDING))
    if mode_sources is not None:
        waiting = waiting.where(F.col("source").isin(*mode_sources))
    slices = waiting.withColumn("_slice", F.pmod(F.xxhash64("url"), F.lit(salts)))
    by_slice = Window.partitionBy("source", "_slice").orderBy("seq", "url")
    by_source = Window.partitionBy("source").orderBy("seq", "url")
    return (
        slices.withColumn("_rank", F.row_number().over(by_slice)).where(F.col("_rank") <= n)
        .withColumn("rank", F.row_number().over(by_source)).where(F.col("rank") <= n)
        .drop("_slice", "_rank")
    )


def lease(frontier: DataFrame, seq: Column, n: int = 20) -> DataFrame:
    """Transitions that take the pending links in progress."""
    return transitions(pending(frontier, n), IN_PROGRESS, seq)


def mark(frontier: DataFrame, urls: DataFrame, state: int, seq: Column) -> DataFrame:
    """Transitions to ``state`` for the links of the frontier among ``urls``."""
    named = urls.select("url").distinct()
    return transitions(frontier.join(named, "url", "left_semi"), state, seq)


def complete(frontier: DataFrame, merged: DataFrame, seq: Column) -> DataFrame:
    """Links whose record was inserted or merged are finished."""
    return mark(frontier, merged.select(F.col("raw_url").alias("url")), FINISHED, seq)


def invalidate(frontier: DataFrame, failed: DataFrame, seq: Column) -> DataFrame:
    """Links whose page could not be fetched or parsed are invalid."""
    return mark(frontier, failed, INVALID, seq)


def recover(frontier: DataFrame, seq: Column) -> DataFrame:
    """Transitions that give leased but unfinished links back."""
    return transitions(frontier.where(F.col("state") == IN_PROGRESS), INITIAL, seq)


def recovered(frontier: DataFrame) -> DataFrame:
    """The frontier as it stands after recovery."""
    return frontier.withColumn(
        "state", F.when(F.col("state") == IN_PROGRESS, INITIAL).otherwise(F.col("state")))


def _count(state: int) -> Column:
    return F.count_if(F.col("state") == state)


def progress(frontier: DataFrame) -> DataFrame:
    """Counts per source in one aggregation."""
    counted = frontier.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_all"),
        (_count(FINISHED) + _count(WRONG_DATE) + _count(INVALID)).alias("n_done"),
        _count(WRONG_DATE).alias("n_wrong_date"),
        _count(INVALID).alias("n_invalid"),
    )
    return counted.withColumn(
        "pct", F.when(F.col("n_all") > 0, F.round(F.col("n_done") / F.col("n_all") * 100, 2)))


def completion(report: DataFrame, listing_finished: bool | Column = True) -> DataFrame:
    """A source is complete when its list stage is and no link is left."""
    listed = F.lit(listing_finished) if isinstance(listing_finished, bool) else listing_finished
    return report.select(
        "source", (listed & (F.col("n_all") == F.col("n_done"))).alias("complete"))


def totals(frontier: DataFrame) -> DataFrame:
    """Counts over the whole frontier with the true share of finished links."""
    return frontier.agg(
        F.count(F.lit(1)).alias("n_all"), _count(FINISHED).alias("n_finished"),
    ).withColumn("pct", F.when(
        F.col("n_all") > 0, F.round(F.col("n_finished") / F.col("n_all") * 100, 2)))


def with_labels(frontier: DataFrame) -> DataFrame:
    """Add the meaning of the state; the dimension has six rows."""
    return frontier.join(
        F.broadcast(state_dimension(frontier.sparkSession)), "state", "left")
