"""Costly per-row work is dealt out evenly, and done once."""

import hashlib
import pathlib
import re

from pyspark.sql import functions as F

from paperweave.functions import containers, html
from paperweave.functions.html import open_tag
from paperweave.operators import detail
from paperweave.plans import registry
from paperweave.plans.registry import QUERIES
from paperweave.schema import PAGE_SCHEMA
from paperweave.session import spread
from paperweave.sources import tables
from paperweave.sources.tables import few_listings, page_files
from paperweave.streaming.harvest import ExtractionSink


def test_rows_that_lie_in_one_of_many_pieces_are_dealt_to_all(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 4000, 1, 1)
    for _ in range(cores):
        rows = rows.union(spark.range(0, 0, 1, 1))
    sizes = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) == cores and max(sizes) <= 2 * 4000 / cores


def test_a_batch_of_one_file_is_parsed_by_several_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(n, f"http://www.cnki.example/{n}", "<p>x</p>") for n in range(40)], PAGE_SCHEMA)
    sink = ExtractionSink(spark, str(tmp_path))
    # adaptive execution would put so few rows together again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sink.take(pages.coalesce(1).withColumn("source", F.lit("Cnki")), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(sink.table.folder(0)).inputFiles()) > 1
    assert sink.failures().count() == 40


def test_links_that_are_split_in_old_and_new_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([(1, 4), (2, 4)], "o_orderkey bigint, o_custkey bigint").write.parquet(
        f"{tmp_path}/orders.parquet")
    links = QUERIES["frt1_insert_into_existing"](spark, str(tmp_path))
    assert "regexp" not in links._jdf.queryExecution().optimizedPlan().toString()
    assert links.count() == 0


def test_page_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    pages = spark.createDataFrame([(n % 40, f"u{n % 40}", f"<p>{n % 40}") for n in range(43)], PAGE_SCHEMA)
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r["html_sha256"] for r in QUERIES["src1_page_files"](spark, str(tmp_path)).collect()}
    # a page that comes twice is one file with both
    assert found == {n: hashlib.sha256((f"<p>{n}\n<p>{n}" if n < 3 else f"<p>{n}").encode()).hexdigest() for n in range(40)}
    writers = {p.name.split("-")[1] for p in (tmp_path / "files").rglob("part-*")}
    assert len(writers) > 1


def test_pages_of_many_files_go_to_folders_of_few(spark, tmp_path, monkeypatch):
    """What the driver holds of the files of a stream does not grow with the table."""
    monkeypatch.setattr(registry, "shared_folder", lambda _, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(tables, "FOLDER_PAGES", 20, raising=False)
    taken = []

    def seen(spark, path, **options):
        taken.append((path, len(list(pathlib.Path(path).rglob("part-*.txt")))))
        return page_files(spark, path, **options)

    monkeypatch.setattr(registry, "page_files", seen)
    rows = [(n, f"u{n}", f"<p>{n}") for n in range(60)] + [(None, "lost", "x"), (7, "blank", " \n"), (8, None, "y")]
    spark.createDataFrame(rows, PAGE_SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["src1_page_files"](spark, str(tmp_path)).collect()
    wanted = {(n, url, hashlib.sha256(html.encode()).hexdigest()) for n, url, html in rows if html.strip()}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    folders = {path for path, _ in taken}
    assert len(taken) == 2 * len(folders) and len(folders) > 2
    assert max(files for _, files in taken) < 40


def test_a_page_table_of_no_or_one_row_is_taken(spark, tmp_path, monkeypatch):
    for n in (0, 1):
        monkeypatch.setattr(registry, "shared_folder", lambda _, name, n=n: f"{tmp_path}/{n}/{name}")
        rows = spark.createDataFrame([(1, "u", "x")][:n], PAGE_SCHEMA)
        rows.write.parquet(f"{tmp_path}/{n}/pages.parquet")
        assert QUERIES["src1_page_files"](spark, f"{tmp_path}/{n}").count() == n


def test_a_folder_of_many_is_listed_by_few_tasks(spark, tmp_path):
    cores, key = spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for n in range(6 * cores):
        (tmp_path / f"files/page_id={n}/url=u").mkdir(parents=True)
        (tmp_path / f"files/page_id={n}/url=u/part-0.txt").write_text("x")
    before = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listed", "")
    try:
        with few_listings(spark):
            files = page_files(spark, f"{tmp_path}/files")
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(stage).numTasks for job in tracker.getJobIdsForGroup("listed")
             for stage in tracker.getJobInfo(job).stageIds]
    assert tasks and max(tasks) <= 4 * cores
    assert spark.conf.get(key) == before and files.count() == 6 * cores


def test_failures_are_told_without_the_fields_of_records(spark):
    schema = "page_id bigint, url string, html string, source string"
    rows = [(n, f"u{n}", html, site) for site in ("Cnki", "Cqvip", "Wanfang") for n, html in enumerate(
        [None, "", "<p>x", "<div class=crumbs>学位</div><font style='font-weight:bold;'>t</font>"])]
    parsed = detail.extract(spark.createDataFrame(rows, schema))
    found, records = detail.failures_of(parsed), detail.records_of(parsed)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        every, failed, kept, some = (
            df._jdf.queryExecution().optimizedPlan().toString()
            for df in (parsed, found, records, records.where("title = 't'")))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for field in ("info_right_name", "关键词：", "摘要"):
        assert field in every and field not in failed
    # neither a filter on the state of a page nor one on a field reads the page anew
    hidden = "script\\b"
    assert every.count(hidden) == failed.count(hidden) == kept.count(hidden) == some.count(hidden) == 3
    assert found.count() == len(rows)


def test_a_tag_that_stands_often_is_matched_once():
    asked = []

    class Opening:
        def match(self, written):
            asked.append(written)
            return re.match("<div class=v>", written)

    page = "<li>a<div class=v>1<b>2</b></div></li>" * 50
    found = containers.pairs(page, re.compile("(</?(?:div|li)[^>]*>)"), Opening(), re.compile("<[^>]*>"), {})
    assert found == [("a12", "12")] * 50 and sorted(asked) == ["<div class=v>", "<li>"]


def test_elements_and_gaps_look_for_a_match_only_where_one_can_begin(spark):
    """A search that tries every character is lazy; rows are those of a lazy one all the same."""
    texts = ["", "<", "<div", "<div>a<div>b", "x<DIV a='>'>1<divs>2</div>3<div b=\"<div>\">4</div>5", "&amp;&x&lt"]
    opening, reference = open_tag("div"), r"(?i)&(?:amp;|lt;?)"
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select(
        "t", html.all_elements("t", "div", opening).alias("bodies"),
        html.gaps(F.col("t"), reference, F.regexp_extract_all("t", F.lit(reference), F.lit(0))).alias("gaps"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(.*?)" not in plan
    lazy = lambda t: re.findall(rf"(?s)(?:(?i:<div\b{html._REST}>))(.*?)(?=(?i:<div\b{html._REST}>)|\Z)", t)
    for r in found.collect():
        assert [re.split("(?i)</div", b)[0] for b in lazy(r["t"])] == r["bodies"]
        assert re.split(reference, r["t"]) == r["gaps"]
