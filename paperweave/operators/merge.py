"""Merging the records of one paper from several sources.

A record finds the rows already there with the same title whose publication
contains its own. If there is none it creates a row; otherwise it fills the
blank fields of *all* rows found and adds its address and source to them.

Two facts turn that record-by-record rule into joins and aggregations: the
title and publication of a row never change, and containment is transitive. In
arrival order ``seq``:

* a record creates a row exactly when no earlier record with its title has a
  publication that contains its own;
* a record joins every creator with its title whose publication contains its
  own and which is not later.

Containment without comparing pairs
-----------------------------------
Publications are first reduced to distinct (title, publication) *groups*. Each
group then lists those substrings of its publication that the title can ask
for: of a length that occurs among its publications, starting with characters
that one of them starts with, each once. They travel as 128-bit hashes, never as
text. "Does an earlier publication contain mine" is the smallest ``seq`` per
(title, hash): an aggregation that is combined before its shuffle, however many
publications share a title. Pairs of groups are confirmed on the texts.

Results
-------
``papers`` has a row per paper with its first-filled fields and number of
contributions; ``membership_ids`` lists the contributions. ``fold`` joins their
addresses and sources to one text, which is as long as a paper has contributions.

Skew
----
A title may hold a third of all rows. Narrow aggregations are combined before
they are shuffled, and every join has a side with one row per key, so that
adaptive execution can split the other one.

``seq`` must be unique.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweave.schema import RECORD_FIELDS
from paperweave.session import materialise

#: Characters of a start that are looked up before a substring is listed.
OPENING = 3
_WORDS = 16  # of 64 bits, for the starts of a title's publications
_KEYS = ["_title", "_pub"]


def _comparable(c: Column, collation: str | None) -> Column:
    """Key form of a text: as it is, or as the named collation compares it."""
    if collation is None:
        return c
    if collation == "UTF8_LCASE":
        return F.lower(c)
    if collation == "UTF8_LCASE_RTRIM":
        return F.lower(F.rtrim(c))
    raise ValueError(f"unknown collation {collation}")


def with_keys(records: DataFrame, collation: str | None = None) -> DataFrame:
    return records.withColumns({
        "_title": _comparable(F.col("title"), collation),
        "_pub": _comparable(F.col("publication"), collation),
    })


@dataclass
class Groups:
    """Distinct (title, publication) pairs of a set of records.

    ``table``: ``_title _pub gid last n n_links is_row``. ``gid`` is the first
    ``seq`` and identifies the group, ``last`` the last ``seq`` and ``n`` the
    number of new records. ``is_row`` marks groups that are a row of an
    existing result, ``n_links`` counts the contributions it already has.
    """

    table: DataFrame

    def __post_init__(self) -> None:
        self._keyed: DataFrame | None = None

    def keyed(self) -> DataFrame:
        """Groups of titles with more than one publication.

        ``tid`` stands for the title, ``lengths`` are the publication lengths
        that occur (bounded by the longest name), ``starts`` is a bitmap of 128
        bytes of the characters that its publications start with.
        """
        if self._keyed is None:
            bit = _start_bit(F.col("_pub"), F.lit(1), F.length("_pub"))
            word = F.call_function(
                "shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int"))
            starts = F.array(*[
                F.bit_or(F.when(F.floor(bit / 64) == i, word).otherwise(F.lit(0).cast("bigint")))
                for i in range(_WORDS)])
            titles = self.table.groupBy("_title").agg(
                F.min("gid").alias("tid"), F.collect_set(F.length("_pub")).alias("lengths"),
                starts.alias("starts"), F.count(F.lit(1)).alias("n_pubs"),
            ).where("n_pubs > 1").drop("n_pubs")
            self._keyed = materialise(self.table.join(titles, "_title"), "keyed")
        return self._keyed


def _start_bit(text: Column, at: Column, length: Column) -> Column:
    """Place in the bitmap for the first characters of a substring."""
    start = F.substr(text, at, F.least(length, F.lit(OPENING)))
    return F.pmod(F.xxhash64(start), F.lit(64 * _WORDS))


def build_groups(records: DataFrame, existing: DataFrame | None = None) -> Groups:
    """Groups of ``records`` (with keys) and of the existing rows they can meet.

    ``existing`` has ``_title _pub id n_links``. Only its rows with a title
    among the records are taken.
    """
    table = records.groupBy(*_KEYS).agg(
        F.min("seq").alias("gid"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    if existing is None:
        table = table.withColumns({
            "n_links": F.lit(0).cast("bigint"), "is_row": F.lit(False)})
    else:
        met = existing.join(records.select("_title").distinct(), "_title", "left_semi")
        rows = met.groupBy(*_KEYS).agg(
            F.min("id").alias("gid"),
            F.sum("n_links").alias("n_links"),
            F.lit(True).alias("is_row"))
        table = table.unionByName(rows, allowMissingColumns=True).groupBy(*_KEYS).agg(
            F.min("gid").alias("gid"), F.max("last").alias("last"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links"),
            F.coalesce(F.max("is_row"), F.lit(False)).alias("is_row"))
    return Groups(materialise(table, "groups"))


def _hashes(part: Column) -> Column:
    return F.struct(F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"))


def substrings(keyed: DataFrame, shorter_only: bool = False) -> DataFrame:
    """``(tid, h1, h2, gid, own, ...)`` for the substrings a title can ask for, each once per
    publication. ``own`` marks the publication itself."""
    size, n = F.length("_pub"), F.col("_len")
    wanted = F.filter("lengths", lambda x: (x < size) if shorter_only else (x <= size))
    # the empty text is contained once
    spots = F.sequence(F.lit(1), F.when(n > 0, F.greatest(size - n + 1, F.lit(1))).otherwise(1))

    def opens(at: Column) -> Column:
        bit = _start_bit(F.col("_pub"), at, n)
        word = F.get("starts", F.floor(bit / 64).cast("int"))
        return F.getbit(word, F.pmod(bit, F.lit(64)).cast("int")) == 1

    parts = F.array_distinct(F.transform(
        F.filter(spots, opens), lambda at: _hashes(F.substr(F.col("_pub"), at, n))))
    return (
        keyed.withColumn("_len", F.explode(wanted))
        .select("tid", F.explode(parts).alias("_part"), (n == size).alias("own"), "gid", "last", "n", "is_row")
        .select("tid", "_part.h1", "_part.h2", "own", "gid", "last", "n", "is_row")
    )


@dataclass
class MergePlan:
    """How the groups of a merge relate.

    ``absorbed``: ``(_title, _pub, gid)`` of groups that create no row, because
    an earlier publication contains theirs. ``pairs``: ``(_title, _pub, row_id,
    _row_pub)`` - records of the group that are later than ``row_id`` also go to
    that row, whose publication properly contains theirs.
    """

    groups: Groups
    absorbed: DataFrame
    pairs: DataFrame


_PART = ["tid", "h1", "h2"]


def plan_merge(groups: Groups) -> MergePlan:
    own, around = F.col("own"), ~F.col("own")
    keyed = groups.keyed()
    asked = materialise(
        substrings(keyed).groupBy(*_PART).agg(
            F.min(F.when(own, F.col("gid"))).alias("gid"),
            F.max(F.when(own, F.col("last"))).alias("last"),
            F.max(own & F.col("is_row")).alias("is_row"),
            F.min(F.when(around, F.col("gid"))).alias("first_around"),
            F.count_if(around).alias("n_around"),
        ).where("gid is not null and n_around > 0").drop("n_around"), "contained")
    late = asked.where("first_around < gid and not is_row").select("gid")
    absorbed = groups.table.join(late, "gid", "left_semi").select(*_KEYS, "gid")
    # rows that can take in records of another group
    rows = substrings(keyed.join(late, "gid", "left_anti"), shorter_only=True) \
        .select(*_PART, F.col("gid").alias("row_id"))
    met = rows.join(asked.select(*_PART, "gid", "last"), _PART).where(F.col("last") > F.col("row_id"))
    pairs = met.select("gid", "row_id").join(groups.table.select("gid", *_KEYS), "gid").join(
        groups.table.select(F.col("gid").alias("row_id"), F.col("_pub").alias("_row_pub")), "row_id",
    ).where(F.col("_row_pub").contains(F.col("_pub"))).select("_title", "_pub", "row_id", "_row_pub")
    return MergePlan(groups, absorbed, materialise(pairs, "pairs"))


_ROW = ["_title", "_row_pub"]
_FOLDED = [name for name in RECORD_FIELDS if name != "url"]


def memberships(records: DataFrame, plan: MergePlan) -> DataFrame:
    """Every record once per row it belongs to, keyed by title and ``_row_pub``.

    Records of an absorbed group also stand under their own publication; one
    marker per such group (``absorbed`` set, no values) makes ``fold`` leave
    that key out without another join.
    """
    shaped = records.select(
        *_KEYS, "seq", *RECORD_FIELDS, "source", F.lit(False).alias("absorbed"))
    members = shaped.withColumnRenamed("_pub", "_row_pub")
    also = shaped.join(plan.pairs, _KEYS) \
        .where(F.col("seq") > F.col("row_id")).drop("_pub", "row_id")
    markers = plan.absorbed.select(
        "_title", F.col("_pub").alias("_row_pub"), F.col("gid").alias("seq"),
        F.lit(True).alias("absorbed"))
    return members.unionByName(also).unionByName(markers, allowMissingColumns=True)


def _first_filled(name: str) -> Column:
    """The first non-blank value in arrival order, with its ``seq``."""
    return F.min(F.when(F.col(name) != "", F.struct("seq", F.col(name).alias("v")))).alias(name)


def _joined(name: str) -> Column:
    return F.expr(f"listagg({name}, ';') within group (order by seq)").alias(name)


def _rows(members: DataFrame, *lists: Column) -> DataFrame:
    """First-filled fields of every row, and what else is asked for."""
    rows = members.groupBy(*_ROW).agg(
        F.min("seq").alias("id"), F.max("absorbed").alias("absorbed"),
        F.count_if(~F.col("absorbed")).alias("n_links"), *lists, *[_first_filled(n) for n in _FOLDED])
    return rows.where(~F.col("absorbed"))


def _values(name: str) -> Column:
    return F.coalesce(F.col(name)["v"], F.lit("")).alias(name)


def papers(members: DataFrame) -> DataFrame:
    """A row per paper: ``id``, its first-filled fields and ``n_links``, the number of its
    contributions. No list is built, so no row grows with them."""
    return _rows(members).select("id", "n_links", *[_values(n) for n in _FOLDED])


def fold(members: DataFrame) -> DataFrame:
    """Result rows from memberships.

    ``url`` and ``source`` are joined with ``;`` in arrival order, every other
    field takes its first non-blank value. The joined texts have no limit; see
    ``papers`` and ``membership_ids`` for the same result without them.
    """
    return _rows(members, _joined("url"), _joined("source")).select(
        "id",
        *[F.coalesce(F.col(n), F.lit("")).alias(n) if n == "url" else _values(n) for n in RECORD_FIELDS],
        F.coalesce("source", F.lit("")).alias("source"),
    )


def merge_records(records: DataFrame, collation: str | None = None) -> DataFrame:
    """Merge a whole table of normalised records into result rows.

    Reads ``records`` more than once: hand in a written table, not a plan that
    still has pages to parse.
    """
    keyed = with_keys(records, collation)
    return fold(memberships(keyed, plan_merge(build_groups(keyed))))


def _as_existing(result: DataFrame, collation: str | None) -> DataFrame:
    return with_keys(result, collation).withColumn(
        "n_links", F.size(F.split("source", ";")).cast("bigint"))


def rows_as_members(result: DataFrame) -> DataFrame:
    """Rows of a result table (with keys) as memberships of themselves."""
    return result.select(
        "_title", F.col("_pub").alias("_row_pub"), F.col("id").alias("seq"), *RECORD_FIELDS, "source",
        F.lit(False).alias("absorbed"))


def merge_into(result: DataFrame, records: DataFrame, collation: str | None = None) -> DataFrame:
    """Merge new records into an existing result.

    Every ``seq`` must be larger than the ids of the rows there; that is
    checked. Rows whose title does not occur among the new records are passed
    through unchanged.
    """
    last, first = result.agg(F.max("id")).first()[0], records.agg(F.min("seq")).first()[0]
    if last is not None and first is not None and first <= last:
        raise ValueError(f"new records start at {first}, but the result holds {last} already")
    old, new = _as_existing(result, collation), with_keys(records, collation)
    plan = plan_merge(build_groups(new, old))
    titles = plan.groups.table.select("_title").distinct()
    touched = rows_as_members(old.join(titles, "_title", "left_semi"))
    untouched = old.join(titles, "_title", "left_anti").drop(*_KEYS, "n_links")
    members = touched.unionByName(memberships(new, plan))
    return untouched.unionByName(fold(members))


#: Columns of a snapshot beside those of a result row: what it is met by, and its contributions.
SNAPSHOT_KEYS = ["title_key", "pub_key", "n_links"]


def as_snapshot(result: DataFrame, collation: str | None = None) -> DataFrame:
    """Result rows with the columns that :func:`merge_into_snapshot` meets them by."""
    return _as_existing(result, collation).withColumnsRenamed({"_title": "title_key", "_pub": "pub_key"})


def merge_into_snapshot(snapshot: DataFrame, records: DataFrame, collation: str | None = None) -> DataFrame:
    """The same rows as :func:`merge_into`, for a snapshot that lies in buckets by ``title_key``.

    The new records are folded by themselves to one row per paper that they touch
    or create. Rows of the snapshot then only look up what is added to them, so its
    wide columns are read once and, where it is bucketed, never shuffled.
    """
    last, first = snapshot.agg(F.max("id")).first()[0], records.agg(F.min("seq")).first()[0]
    if last is not None and first is not None and first <= last:
        raise ValueError(f"new records start at {first}, but the snapshot holds {last} already")
    new = with_keys(records, collation)
    existing = snapshot.select(
        F.col("title_key").alias("_title"), F.col("pub_key").alias("_pub"), "id", "n_links")
    plan = plan_merge(build_groups(new, existing))
    more = materialise(_rows(memberships(new, plan), _joined("url"), _joined("source")).select(
        F.col("_title").alias("title_key"), F.col("_row_pub").alias("pub_key"), F.col("id").alias("new_id"),
        F.col("n_links").alias("new_links"), F.col("url").alias("new_url"), F.col("source").alias("new_source"),
        *[_values(n).alias(f"new_{n}") for n in _FOLDED]), "more")
    old = plan.groups.table.where("is_row").select(
        F.col("_title").alias("title_key"), F.col("_pub").alias("pub_key"))
    created = more.join(old, ["title_key", "pub_key"], "left_anti").select(
        F.col("new_id").alias("id"), *[F.col(f"new_{n}").alias(n) for n in [*RECORD_FIELDS, "source"]],
        "title_key", "pub_key", F.col("new_links").alias("n_links"))

    def both(name: str) -> Column:
        return F.concat_ws(";", name, f"new_{name}").alias(name)

    filled = {n: F.when(F.col(n) != "", F.col(n)).otherwise(F.coalesce(f"new_{n}", F.lit(""))) for n in _FOLDED}
    kept = snapshot.join(more, ["title_key", "pub_key"], "left").select(
        "id", *[both(n) if n == "url" else filled[n].alias(n) for n in RECORD_FIELDS], both("source"),
        "title_key", "pub_key", (F.col("n_links") + F.coalesce("new_links", F.lit(0))).alias("n_links"))
    return kept.unionByName(created)


def count_matches(result: DataFrame, records: DataFrame, collation: str | None = None) -> DataFrame:
    """For every record the number of result rows it would be merged into."""
    old, new = _as_existing(result, collation), with_keys(records, collation)
    groups = build_groups(new, old)
    around = substrings(groups.keyed()).groupBy(*_PART).agg(
        F.min(F.when(F.col("own"), F.col("gid"))).alias("gid"),
        F.count_if(F.col("is_row")).alias("n_rows")).where("gid is not null")
    counts = groups.table.where("n > 0").join(around.select("gid", "n_rows"), "gid", "left").select(
        *_KEYS, F.coalesce("n_rows", F.col("is_row").cast("bigint")).alias("n_matches"))
    return new.join(counts, _KEYS).drop(*_KEYS)


def inserted(records: DataFrame, plan: MergePlan) -> DataFrame:
    """The records that create a row."""
    created = plan.groups.table.where("not is_row").join(
        plan.absorbed.select("gid"), "gid", "left_anti").select(F.col("gid").alias("seq"))
    return records.join(created, "seq", "left_semi")


def membership_ids(members: DataFrame, plan: MergePlan) -> DataFrame:
    """Memberships with the ``id`` of their row; the lists in unjoined form."""
    rows = plan.groups.table.join(plan.absorbed.select("gid"), "gid", "left_anti").select(
        "_title", F.col("_pub").alias("_row_pub"), F.col("gid").alias("id"))
    return members.where(~F.col("absorbed")).join(rows, _ROW).drop(*_ROW, "absorbed")


def listed(members: DataFrame, size: int = 1024) -> DataFrame:
    """Contributions of a paper as pieces of an ordered list: ``(id, chunk, n, url, source)``.

    ``members`` are :func:`membership_ids`. Chunk 0 has the first ``size`` addresses and
    sources in arrival order, chunk 1 the next, and so on; ``fold`` has them all in one
    text. Contributions are dealt to tasks by ranges of (paper, arrival) and counted by
    range, so one of a million contributions is spread over many tasks, and a text has
    ``size`` of them.
    """
    ranges = members.select("id", "seq", "url", "source").repartitionByRange("id", "seq") \
        .sortWithinPartitions("id", "seq")
    placed = materialise(ranges.withColumns({
        "_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "placed")
    runs = placed.groupBy("id", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.col("_before") + F.col("_at") - F.col("_first")
    return placed.join(offsets, ["id", "_task"]).withColumn(
        "chunk", F.floor(rank / size)).groupBy("id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), _joined("url"), _joined("source"))


def contributions(members: DataFrame) -> DataFrame:
    """How many rows were made from each combination of sources.

    Collects the distinct sources of a row, of which there are as many as sites.
    """
    rows = members.groupBy(*_ROW).agg(
        F.max("absorbed").alias("absorbed"), F.collect_set("source").alias("sources"))
    return rows.where(~F.col("absorbed")).groupBy(
        F.array_join(F.array_sort("sources"), ";").alias("sources"),
    ).agg(F.count(F.lit(1)).alias("n_rows"))
