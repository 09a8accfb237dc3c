"""Frontier, tables and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperweave.operators import frontier, listing, merge, search
from paperweave.schema import PAGE_SCHEMA, RECORD_SCHEMA, TRANSITION_SCHEMA
from paperweave.session import shared_folder
from paperweave.sources import jdbc
from paperweave.sources.index import SearchIndex
from paperweave.sources.tables import BucketedResult, ResultTable, TransitionLog, page_files, with_fetch_status
from paperweave.streaming import harvest as stream
from paperweave.streaming import leases
from paperweave.streaming.state import FoldedState
from tests.test_merge import collected, frame, one_by_one, some_records

LINK = "url string, source string, seq long"
STATE = "url string, source string, state int, at long"


def transitions(spark, rows):
    """Rows of the log from ``(url, source, state, n)``."""
    return spark.createDataFrame(rows, STATE).withColumn(
        "seq", frontier.number(0, place=F.col("at"))).drop("at")


def test_first_arrival_wins(spark):
    links = spark.createDataFrame([("a", "S2", 5), ("a", "S1", 2), ("b", "S1", 3), ("c", "S1", 4)], LINK)
    known = spark.createDataFrame([("c", "S0", 1)], LINK)
    got = frontier.insert_ignore(links, known).collect()
    assert sorted(tuple(r) for r in got) == [("a", "S1", 2), ("b", "S1", 3)]


def test_one_hot_url(spark):
    links = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"),
        F.lit("S").alias("source"), F.col("id").alias("seq"))
    got = frontier.insert_ignore(links)
    assert got.count() == 50_000 - 16_667 + 1
    assert got.where("url = 'hot'").first()["seq"] == 0


def test_states(spark):
    log = transitions(spark, [
        ("a", "S", 0, 1), ("a", "S", 10, 5), ("b", "S", 0, 2), ("b", "S", 20, 9), ("c", "S", -10, 3),
        ("d", "R", -5, 4), ("e", "R", -15, 6), ("f", "S", 0, 7)])
    now = frontier.current_state(log)
    assert sorted(r["url"] for r in frontier.pending(now, 1).collect()) == ["c"]
    assert sorted(r["url"] for r in frontier.lease(now, frontier.following(log), 5).collect()) == ["c", "f"]
    assert [r["url"] for r in frontier.recover(now, frontier.following(log)).collect()] == ["a"]
    report = {r["source"]: tuple(r)[1:] for r in frontier.progress(now).collect()}
    assert report == {"S": (4, 1, 0, 0, 25.0), "R": (2, 2, 1, 1, 100.0)}
    done = {r["source"]: r["complete"] for r in frontier.completion(frontier.progress(now)).collect()}
    assert done == {"S": False, "R": True}
    assert tuple(frontier.totals(now).first()) == (6, 1, 16.67)
    assert frontier.with_labels(now).where("label is null").count() == 0


def test_pending_beyond_one_slice(spark):
    links = spark.range(3000).select(
        F.col("id").cast("string").alias("url"), F.lit("S").alias("source"),
        F.lit(0).alias("state"), (3000 - F.col("id")).alias("seq"))
    got = frontier.pending(links, 1500, salts=7).orderBy("rank").collect()
    assert [r["seq"] for r in got] == list(range(1, 1501))


def test_fetch_status(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", " \n"), (3, "u", "<p>")], PAGE_SCHEMA)
    assert [r["fetched"] for r in with_fetch_status(pages).orderBy("page_id").collect()] == [
        False, False, True]


def test_page_files_in_batch_and_stream(spark):
    rows = [(1, "http://a.x/p?q=1&r=%22 z", "<p>\n\nline</p>\n"), (2, "u/ü=文", "x"), (3, "gone", ""), (4, "blank", " \t")]
    folder, out, check = (shared_folder(spark, n) for n in ("files", "out", "check"))
    pages = spark.createDataFrame(rows, PAGE_SCHEMA)
    pages.select("html", "page_id", "url").write.partitionBy("page_id", "url").text(folder)
    wanted = [(i, url, html if html.strip() else None) for i, url, html in rows]
    assert sorted(map(tuple, page_files(spark, folder).collect())) == wanted
    stream.append_stream(page_files(spark, folder, True, 1), out, check, pace=None).awaitTermination()
    assert sorted(map(tuple, spark.read.schema(PAGE_SCHEMA).parquet(out).collect())) == wanted


def test_search(spark):
    rows = spark.createDataFrame([
        ("Big Ring", "A", "k", "U", "1999"), ("ring", "A", "k", "U", "2030"), ("ring", "B", "k", "U", "x")],
        "title string, authors string, keywords string, unit string, year string")
    assert search.search(rows, title="RING", authors="a", unit="--").count() == 1
    assert search.search(rows, 1990, 2050).count() == 2


def test_transition_log(spark):
    log = TransitionLog(spark, shared_folder(spark, "log"))
    assert log.read().count() == 0
    log.append(transitions(spark, [("a", "S", 0, 1)]))
    log.append(transitions(spark, [("a", "S", 20, 2)]))
    assert frontier.current_state(log.read()).first()["state"] == 20
    assert log.read().schema == TRANSITION_SCHEMA


def test_result_table(spark):
    table = ResultTable(spark, shared_folder(spark, "result"))
    records = some_records(60, 11)
    assert table.read().count() == 0
    table.replace(merge.merge_into(table.read(), frame(spark, records[:30])))
    table.replace(merge.merge_into(table.read(), frame(spark, records[30:])))
    assert table.version() == 2
    assert collected(table.read()) == one_by_one(records)


def test_merge_touches_buckets_of_its_titles(spark):
    records = some_records(90, 12, titles=("T", "U", "V", "W"))
    table = ResultTable(spark, shared_folder(spark, "result"), buckets=8)
    table.merge(frame(spark, records[:60]), merge.merge_into)
    before = table.current()
    only = [r for r in records[60:] if r["title"] == "T"]
    table.merge(frame(spark, only), merge.merge_into)
    changed = {b for b, v in table.current().items() if v != before.get(b)}
    assert len(changed) == 1 and len(before) > 1
    assert collected(table.read()) == one_by_one(records[:60] + only)



def test_bucketed_result_equals_the_full_merge(spark):
    records = some_records(120, 14, titles=("T", "U", "V", "W", ""))
    path = shared_folder(spark, "bucketed")
    for a, b in ((0, 50), (50, 51), (51, 120)):  # by another object each time, as after a restart
        BucketedResult(spark, path, buckets=4).merge(frame(spark, records[a:b]))
        spark.sql(f"DROP TABLE {BucketedResult(spark, path)._name(BucketedResult(spark, path).version())}")
    table = BucketedResult(spark, path, buckets=4)
    assert collected(table.read()) == one_by_one(records) and table.version() == 3
    assert table.snapshot().agg(F.sum("n_links")).first()[0] == sum(
        len(row["source"].split(";")) for row in table.read().collect())
    with pytest.raises(ValueError):
        table.merge(frame(spark, records[:1]))


def test_bucketed_result_with_collation(spark):
    records = [{**r, "title": r["title"].upper() if r["seq"] % 2 else r["title"].lower()} for r in some_records(60, 15)]
    table = BucketedResult(spark, shared_folder(spark, "bucketed"), buckets=4, collation="UTF8_LCASE")
    table.merge(frame(spark, records[:30]))
    table.merge(frame(spark, records[30:]))
    assert collected(table.read()) == collected(merge.merge_records(frame(spark, records), "UTF8_LCASE"))


@pytest.fixture
def planned_for_buckets(spark):
    settings = {**BucketedResult._PLANNING, "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_snapshot_is_not_shuffled(spark, planned_for_buckets):
    table = BucketedResult(spark, shared_folder(spark, "bucketed"), buckets=4)
    records = some_records(60, 16)
    table.merge(frame(spark, records[:40]))
    plan = table.merged(frame(spark, records[40:]))._jdf.queryExecution().executedPlan()

    def nodes(node, below_exchange=False):
        yield node, below_exchange
        children = node.children()
        for i in range(children.size()):
            yield from nodes(children.apply(i), below_exchange or node.nodeName() == "Exchange")

    scans = [below for node, below in nodes(plan) if "Scan" in node.nodeName() and "n_links" in node.toString()
             and "title_key" in node.toString() and "new_" not in node.toString()]
    assert scans and not any(scans)
    # nor in finding the rows that share a title
    keys = table.snapshot().select("title_key", "pub_key", "id")
    titles = frame(spark, records[40:]).select(F.col("title").alias("title_key")).distinct()
    probe = keys.join(titles, "title_key", "left_semi")._jdf.queryExecution().executedPlan()
    assert not any(below for node, below in nodes(probe) if "pub_key" in node.toString() and "Scan" in node.nodeName())


def test_years_outside_the_range_are_not_read(spark):
    rows = spark.range(40_000).select(
        F.concat(F.lit("u"), "id").alias("url"),
        F.when(F.col("id") % 3 == 0, "n.d.").otherwise((1980 + F.col("id") % 40).cast("string")).alias("year"))
    path = shared_folder(spark, "by-year")
    search.by_year(rows, 16).write.parquet(path)
    read = {}
    for first, last in ((1990, 1991), (1990, 2009), (1900, 2100)):
        found = search.between_years(spark.read.parquet(path), first, last)
        assert found.where(~search.year_in_range(first, last)).count() == 0
        assert found.count() == rows.where(search.year_in_range(first, last)).count()
        one = search.between_years(spark.read.parquet(path), first, last)
        one.collect()
        plan = one._jdf.queryExecution().executedPlan()
        assert f"GreaterThanOrEqual(year_number,{first}), LessThanOrEqual(year_number,{last})" in plan.toString()
        read[first, last] = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read[1990, 1991] < read[1990, 2009] < read[1900, 2100] < 40_000


def test_index_equals_the_scan(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abAé文 .") for _ in range(rng.randrange(n)))
    rows = [(i, word(12) if rng.random() > 0.1 else None, word(9), word(3), "") for i in range(300)]
    records = spark.createDataFrame(rows, "id long, title string, authors string, keywords string, unit string")
    index = SearchIndex(spark, shared_folder(spark, "index"))
    index.build(records, "id")
    for criteria in ({"title": "a"}, {"title": "Ab"}, {"title": "abA", "authors": "b"}, {"title": "aaaa"}, {"keywords": "文"},
                     {"title": "é a", "authors": "A", "keywords": "b"}, {"unit": "a"}, {"title": "  "}, {"title": "ababa"}):
        wanted = {r["id"] for r in records.where(search.matches(**criteria)).collect()}
        got = [r["id"] for r in index.matching(**criteria).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted, criteria
    plan = index.matching(title="abAb")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(gram, [aba,bab])" in plan and "/ids" not in plan


def test_contributions_of_a_hot_paper_are_spread(spark):
    n = 200_000
    members = spark.range(n).select(
        F.when(F.col("id") < n - 10, 7).otherwise(F.col("id")).alias("id"), (n - F.col("id")).alias("seq"),
        F.concat(F.lit("u"), F.col("id")).alias("url"), F.lit("s").alias("source"))
    found = merge.listed(members, 1000)
    hot = found.where("id = 7").orderBy("chunk").collect()
    assert [r["chunk"] for r in hot] == list(range(200)) and {r["n"] for r in hot[:-1]} == {1000}
    assert ";".join(r["url"] for r in hot) == ";".join(f"u{i}" for i in range(n - 11, -1, -1))
    assert found.where("id <> 7 and chunk = 0 and n = 1").count() == 10
    dealt = members.repartitionByRange(8, "id", "seq").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < n / 2


def list_page(search, page, n=2):
    links = "".join(f"<div class=wz_content><a href='{search}/{page}/{i}'>t</a></div>" for i in range(n))
    return (search, page, links, "Cnki")


LIST_PAGE = "search string, page long, html string, source string"


def test_list_stage_repeats_none_and_skips_none(spark):
    """Killed between writing links and moving the cursor; pages out of order and twice."""
    pages = [list_page(s, p) for s, n in (("a", 9), ("b", 4), ("c", 1)) for p in range(1, n + 1)]
    order = random.Random(2).sample(pages, len(pages))
    inbox, store, check = (shared_folder(spark, n) for n in ("inbox", "store", "check"))

    class Killed(stream.ListStage):
        fail = True

        def take(self, new, batch, layout=None):
            if batch == 2 and Killed.fail:
                append, Killed.fail = self.cursors.append, False
                self.cursors.append = lambda *rows: (_ for _ in ()).throw(RuntimeError("killed"))
                try:
                    super().take(new, batch, layout)
                finally:
                    self.cursors.append = append
            super().take(new, batch, layout)

    searches = spark.createDataFrame([("a", 9), ("b", 4), ("c", 1), ("d", 2)], "search string, n_pages long")
    for k in range(0, len(order), 4):
        batch = order[k:k + 4] + order[max(0, k - 2):k]
        spark.createDataFrame(batch, LIST_PAGE).coalesce(1).write.mode("append").parquet(inbox)
        running = lambda: Killed(spark, store, every=2).start(
            stream.stream_table(spark, inbox, spark.createDataFrame([], LIST_PAGE).schema, 1), check, pace=None)
        try:
            running().awaitTermination()
        except Exception as error:
            assert "killed" in str(error)
            running().awaitTermination()
        stage = stream.ListStage(spark, store)
        read = {p[:2] for p in order[:k + 4]}
        left = {(r["search"], r["page"]) for r in stage.remaining(searches).collect()}
        assert left == {p[:2] for p in pages if p[:2] not in read} | {("d", 1), ("d", 2)}
    assert not Killed.fail
    got = [tuple(r) for r in stage.links().select("search", "page", "url").collect()]
    assert sorted(got) == sorted((s, p, f"{s}/{p}/{i}") for s, p, *_ in pages for i in range(2))
    assert {r["search"]: r["page"] for r in stage.cursors.read().collect()} == {"a": 9, "b": 4, "c": 1}
    assert stage.held.previous(99).count() == 0


def test_a_page_without_links_moves_the_cursor(spark):
    stage = stream.ListStage(spark, shared_folder(spark, "stage"))
    stage.take(spark.createDataFrame([list_page("a", 1), list_page("a", 2, 0), list_page("a", 4)], LIST_PAGE), 0)
    assert [tuple(r) for r in stage.cursors.read().collect()] == [("a", 2)]
    assert [tuple(r) for r in stage.held.previous(1).collect()] == [("a", 4)]


class Recorder:
    """Stands for a reader or writer and keeps the options it is given."""

    def __init__(self):
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def mode(self, name):
        self.seen["mode"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **more):
        self.seen.update(more)
        return self

    def load(self):
        return self

    def save(self):
        return None


def test_jdbc_options():
    source = type("S", (), {"read": Recorder()})()
    got = jdbc.read_query(source, "jdbc:x", "select 1", "id", (0, 9), 4, user="u").seen
    assert got["dbtable"] == "(select 1) t" and got["numPartitions"] == 4 and got["user"] == "u"
    with pytest.raises(ValueError):
        jdbc.read_query(source, "jdbc:x", "select 1", "id")
    rows = type("R", (), {"write": Recorder()})()
    jdbc.append_rows(rows, "jdbc:x", "t", connections=3)
    assert rows.write.seen["mode"] == "append" and rows.write.seen["numPartitions"] == 3
    jdbc.replace_rows(rows, "jdbc:x", "t")
    assert rows.write.seen["mode"] == "overwrite" and rows.write.seen["truncate"] == "true"


def feed(spark, df, inbox, files):
    """Write ``df`` as files that arrive one after another, in order of seq."""
    order = [c for c in ("seq", "page_id") if c in df.columns][0]
    rows = sorted(df.collect(), key=lambda r: r[order])
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(inbox)


def test_streaming_merge_equals_batch(spark):
    records = some_records(90, 12)
    inbox, store, check = (shared_folder(spark, n) for n in ("inbox", "store", "check"))
    sink = stream.MergeSink(spark, store)
    feed(spark, frame(spark, records), inbox, 4)
    sink.start(stream.stream_table(spark, inbox, RECORD_SCHEMA, 1), check, pace=None).awaitTermination()
    assert collected(sink.result()) == one_by_one(records)
    # a batch that runs again leaves the same result
    again = sorted(r["seq"] for r in sink.members.read().where("not absorbed").collect())
    last = frame(spark, records[69:])
    sink.take(last, 3)
    assert sorted(r["seq"] for r in sink.members.read().where("not absorbed").collect()) == again
    assert collected(sink.result()) == one_by_one(records)


def test_late_records_are_refused(spark):
    """A record before those merged already would change rows that stand; the batch merge refuses it too."""
    records = some_records(12, 3)
    sink = stream.MergeSink(spark, shared_folder(spark, "merge"))
    sink.take(frame(spark, records[6:]), 0)
    with pytest.raises(ValueError):
        sink.take(frame(spark, records[:6]), 1)
    sink.take(frame(spark, []), 1)
    with pytest.raises(ValueError):
        sink.take(frame(spark, records[5:7]), 2)
    assert collected(sink.result()) == one_by_one(records[6:])


def test_streaming_progress_and_restart(spark):
    rows = [(str(i % 7), "S" if i % 7 % 2 else "R", [0, 10, 20, -15][i * 5 % 4], i) for i in range(60)]
    log = transitions(spark, rows)
    inbox, store, check = (shared_folder(spark, n) for n in ("inbox", "store", "check"))
    for half in (log.where("seq.position < 30"), log.where("seq.position >= 30")):
        feed(spark, half, inbox, 2)
        sink = stream.ProgressSink(spark, store, every=2)
        sink.start(stream.stream_table(spark, inbox, TRANSITION_SCHEMA, 1), check, pace=None).awaitTermination()
    now = frontier.current_state(log)
    wanted = sorted(tuple(r) for r in now.groupBy("source", "state").count().collect())
    assert sorted(tuple(r) for r in sink.counts().collect()) == wanted
    for _ in range(2):  # a second call writes the same
        assert sink.recover().count() == now.where("state = 10").count()
        assert sink.counts().where("state = 10").count() == 0
        assert sink.counts().agg(F.sum("n")).first()[0] == now.count()
    late = transitions(spark, [(str(i), "S", 20, i) for i in range(7)]).withColumn("seq", frontier.number(5))
    sink.take(late, 4)
    assert {r["state"] for r in sink.counts().collect()} == {20}


def test_folded_state_equals_the_log(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randrange(60)}", "S", rng.choice([0, 10, 20]), i) for i in range(400)]
    state = FoldedState(spark, shared_folder(spark, "state"), TRANSITION_SCHEMA, ["url"], "url", "seq",
                        every=3, buckets=16)
    asked = spark.createDataFrame([("u1",), ("u2",), ("none",)], "url string")
    for batch in range(10):
        new, before = rows[batch * 40:(batch + 1) * 40], rows[:batch * 40]
        for _ in range(2 if batch in (4, 9) else 1):  # some run again, one of them after it folded
            known = {r["url"]: r["state"] for r in state.of(asked, before=batch).collect()}
            last = {u: s for u, _, s, _ in before}
            assert known == {u: last[u] for u in ("u1", "u2") if u in last}
            state.append(transitions(spark, new), batch)
        assert len(state.tail.batches()) <= 4
    last = {u: s for u, _, s, _ in rows}
    assert {r["url"]: r["state"] for r in state.read().collect()} == last


def test_a_batch_reads_its_buckets_and_the_tail(spark):
    state = FoldedState(spark, shared_folder(spark, "state"), TRANSITION_SCHEMA, ["url"], "url", "seq",
                        every=2, buckets=32)
    for batch in range(7):
        state.append(transitions(spark, [(f"u{i}", "S", 0, batch) for i in range(200)]), batch)
    plan = state.of(transitions(spark, [("u1", "S", 0, 0)]))._jdf.queryExecution().executedPlan().toString()
    fold = state.fold()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan)
    assert re.search(rf"PartitionFilters: \[[^]]*batch#\d+L > {fold - 1}\)", plan)
    assert fold == 6 - len(state.tail.batches()) + 1 and len(state.tail.batches()) <= 3
    one = state._based(fold, [3]).select(F.input_file_name().alias("f")).distinct().collect()
    assert one and all("/bucket=3/" in r["f"] for r in one)


def test_counts_are_observed_while_writing(spark):
    pages = spark.createDataFrame([
        (1, "u1", "<p>", "Cnki"), (2, "u2", None, "Cnki"), (3, "u3", "<p>", "Wanfang")],
        "page_id long, url string, html string, source string")
    sink = stream.ExtractionSink(spark, shared_folder(spark, "extraction"))
    for batch in (0, 0):
        sink.take(pages, batch)
    assert sorted(tuple(r) for r in sink.counts().collect()) == [("Cnki", 0, 2), ("Wanfang", 0, 1)]
    records = some_records(40, 6)
    merged = stream.MergeSink(spark, shared_folder(spark, "merge"))
    merged.take(frame(spark, records[:25]), 0)
    merged.take(frame(spark, records[25:]), 1)
    result = one_by_one(records)
    assert merged.counts().first()["papers"] == len(result)
    assert merged.counts().first()["contributions"] == merged.members.read().where("not absorbed").count()


LEASE = "url string, source string, state int, at timestamp, n long"


def lease_rows(spark, rows):
    from datetime import datetime, timezone
    timed = [(u, "S", s, datetime.fromtimestamp(t, timezone.utc), t) for u, s, t in rows]
    return spark.createDataFrame(timed, LEASE).withColumn("seq", frontier.number(3, place=F.col("n"))).drop("n")


def test_leases_return_while_the_stream_runs(spark):
    """By the time of transitions: killed between parts, finished in time, finished late, leased again."""
    parts = [
        [("lost", 10, 100), ("done", 10, 100), ("late", 10, 100), ("again", 10, 100)],
        [("done", 20, 105), ("again", 10, 109), ("tick", 0, 112)],
        [("tick", 0, 113)],  # the time is known to have passed 112
        [("late", 20, 114), ("tick", 0, 125)], [("tick", 0, 126)], [("old", 10, 50), ("tick", 0, 127)],
    ]
    inbox, out, check = (shared_folder(spark, n) for n in ("inbox", "out", "check"))
    schema = lease_rows(spark, []).schema
    for part in parts:
        lease_rows(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        back = leases.returned_leases(stream.stream_table(spark, inbox, schema), 10_000, by_event_time=True)
        stream.append_stream(back, out, check, pace=None).awaitTermination()
    got = sorted((r["url"], r["state"], tuple(r["seq"])) for r in spark.read.schema(TRANSITION_SCHEMA).parquet(out).collect())
    assert [x for x in got if x[0] in ("lost", "late", "again")] == [
        ("again", 0, (3, 0, 0, 110)), ("late", 0, (3, 0, 0, 101)), ("lost", 0, (3, 0, 0, 101))]
    assert not any(x[0] in ("done", "tick") for x in got)
    log = lease_rows(spark, [x for part in parts for x in part]).drop("at").select("url", "source", "state", "seq")
    now = frontier.current_state(log.unionByName(spark.read.schema(TRANSITION_SCHEMA).parquet(out)))
    assert {r["url"]: r["state"] for r in now.collect()} | {"old": 0} == {
        "lost": 0, "done": 20, "late": 20, "again": 0, "tick": 0, "old": 0}


def test_leases_return_by_the_clock(spark):
    import time

    inbox, out, check = (shared_folder(spark, n) for n in ("inbox", "out", "check"))
    lease_rows(spark, [("a", 10, 1), ("b", 20, 1)]).coalesce(1).write.parquet(inbox)
    arriving = stream.stream_table(spark, inbox, lease_rows(spark, []).schema)
    running = stream.append_stream(leases.returned_leases(arriving, 1_000), out, check, pace="200 milliseconds")
    try:
        for _ in range(120):
            got = spark.read.schema(TRANSITION_SCHEMA).parquet(out).collect() if running.recentProgress else []
            if got:
                break
            time.sleep(0.5)
    finally:
        running.stop()
    assert [(r["url"], r["state"]) for r in got] == [("a", 0)]


def test_streaming_links_equal_batch(spark):
    page = "<a href='/x'>1</a><a href='/{}'>2</a>"
    pages = spark.createDataFrame([(i, f"u{i}", page.format(i % 5)) for i in range(20)], PAGE_SCHEMA)
    inbox, out, check = (shared_folder(spark, n) for n in ("inbox", "out", "check"))
    feed(spark, pages, inbox, 4)
    links = stream.distinct_links(stream.stream_table(spark, inbox, PAGE_SCHEMA, 1), "any").select("url")
    stream.append_stream(links, out, check, pace=None).awaitTermination()
    wanted = listing.extract_links(pages, "any").select("url").distinct().collect()
    got = [r["url"] for r in spark.read.schema(links.schema).parquet(out).collect()]
    assert sorted(got) == sorted(r["url"] for r in wanted)


def test_streaming_first_arrivals(spark):
    rows = [(u, i) for i, u in enumerate(["a", "b", "a", "c", "b", "a", "d", "a", "e", "c"] * 3)]
    links = spark.createDataFrame(rows, "url string, seq long")
    inbox, store, check = (shared_folder(spark, n) for n in ("inbox", "store", "check"))
    sink = stream.LinkSink(spark, store)
    for half in (links.where("seq < 4"), links.where("seq >= 4")):
        feed(spark, half, inbox, 2)
        sink.start(stream.stream_table(spark, inbox, links.schema, 1), check, pace=None).awaitTermination()
    assert sorted(tuple(r) for r in sink.links().collect()) == [
        ("a", 0), ("b", 1), ("c", 3), ("d", 6), ("e", 8)]


def test_links_are_new_by_batch_not_by_clock(spark):
    sink = stream.LinkSink(spark, shared_folder(spark, "links"), every=1)
    for batch in range(4):  # all within one tick of a coarse clock
        sink.take(spark.createDataFrame([("a", 10 * batch), ("a", 10 * batch + 1), (f"n{batch}", 10 * batch)],
                                        "url string, seq long"), batch)
        sink.take(spark.createDataFrame([("a", 10 * batch), (f"n{batch}", 10 * batch)], "url string, seq long"), batch)
    assert sorted(tuple(r) for r in sink.links().collect()) == [
        ("a", 0), *((f"n{b}", 10 * b) for b in range(4))]


def test_long_intake_reads_a_bounded_front(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>") for i in range(200)], PAGE_SCHEMA)
    sink = stream.LeasedIntake(spark, shared_folder(spark, "intake"), pages, n=3, every=2)
    links = spark.createDataFrame([(f"u{i}", "S", i) for i in range(200)], "url string, source string, at long").select(
        "url", "source", frontier.number(0, page=F.col("at")).alias("seq"))
    for batch in range(5):
        new = links.where(f"seq.page_id < {100 if batch == 0 else 0} or seq.page_id = {100 + batch}")
        for _ in range(2 if batch == 3 else 1):  # run again after it folded
            sink.take(new, batch)
    taken = [r["page_id"] for r in sink.pages().collect()]
    assert sorted(taken) == list(range(15))
    assert sink.log.spark.read.parquet(sink.front.folder(sink.log.fold())).count() == 3 * 3


def test_intake_is_paced_by_links(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>") for i in range(12)], PAGE_SCHEMA)
    sink = stream.LeasedIntake(spark, shared_folder(spark, "intake"), pages, n=2)
    links = spark.createDataFrame(
        [(f"u{i}", "S" if i % 3 else "R", i) for i in range(12)], "url string, source string, at long").select(
        "url", "source", frontier.number(0, page=F.col("at")).alias("seq"))
    sink.take(links.where("seq.page_id < 8"), 0)
    sink.take(links.where("seq.page_id >= 4"), 1)
    sink.take(links.where("seq.page_id >= 4"), 1)  # run again after a failure
    got = {(r["url"], r["source"]) for r in sink.pages().collect()}
    assert got == {(f"u{i}", "S") for i in (1, 2, 4, 5)} | {(f"u{i}", "R") for i in (0, 3, 6, 9)}
    assert sink.pages().count() == 8
