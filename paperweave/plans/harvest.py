"""The whole run over fetched pages: lists -> links -> details -> merged papers.

Every stage that later stages read twice is written once. Page html never
passes a shuffle: lists and details are parsed where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweave.functions.clean import normalise_records
from paperweave.operators import detail, frontier, listing, merge, search
from paperweave.operators.frontier import number
from paperweave.schema import INITIAL
from paperweave.session import materialise
from paperweave.sources.tables import with_fetch_status


def links_of_sites(list_pages: DataFrame, run: int = 0) -> DataFrame:
    """Links of all three layouts as ``(url, source, seq)``."""
    return listing.extract_links(list_pages).select(
        "url", "source", number(run, 0, F.col("page_id"), F.col("position")).alias("seq"))


@dataclass
class Harvest:
    frontier: DataFrame
    records: DataFrame
    result: DataFrame


def harvest(list_pages: DataFrame, detail_pages: DataFrame, mode: str = "123",
            first_year: int = search.FIRST_YEAR, last_year: int = search.LAST_YEAR,
            known: DataFrame | None = None, known_links: DataFrame | None = None,
            collation: str | None = None) -> Harvest:
    """Run all stages and return the frontier, the records and the papers.

    Pages carry ``page_id url html source``; only pages whose url is in the
    frontier count. ``known`` is an existing result to merge into, whose rows
    must have smaller numbers than the pages; ``known_links`` is the frontier of
    an earlier run, which this one continues: its links are not new, and its
    transitions come before those of this run. It may have been kept in a
    ``TransitionLog``, leased from and recovered meanwhile. A record outside the year range
    still enters the result; its link is marked.
    """
    run = 0 if known_links is None else frontier.next_run(known_links)
    new = frontier.insert_ignore(links_of_sites(list_pages, run), known_links)
    fresh = frontier.transitions(new, INITIAL, F.col("seq"))
    log = materialise(
        fresh if known_links is None else known_links.select(*fresh.columns).unionByName(fresh), "links")

    # one pass over the html, pages that could not be fetched included
    parsed = materialise(detail.extract(with_fetch_status(detail_pages), mode), "parsed")
    usable = F.col("ok") & F.col("fetched")
    unusable = parsed.where(~usable).select("url")

    kept = normalise_records(detail.records_of(parsed.where("fetched").drop("fetched"))) \
        .withColumnRenamed("page_id", "seq")
    listed = log.select(F.col("url").alias("raw_url")).distinct()
    records = materialise(kept.join(listed, "raw_url", "left_semi"), "records")
    result = (merge.merge_records(records, collation) if known is None
              else merge.merge_into(known, records, collation))

    links = log.select("url", "source").distinct()
    events = [
        log,
        frontier.complete(links, records, number(run, 1)),
        frontier.invalidate(links, unusable, number(run, 2)),
        search.wrong_dates(links, records, number(run, 3), first_year, last_year),
    ]
    states = frontier.current_state(reduce(DataFrame.unionByName, events))
    return Harvest(states, records, result)
