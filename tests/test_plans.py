"""Properties of the physical plans that matter for large tables."""

from pyspark.sql import functions as F

from paperweave.operators import detail, frontier, listing, merge
from paperweave.session import materialise
from tests.test_merge import frame, some_records

PAGES = "page_id long, url string, html string, source string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pages(spark):
    rows = [(i, f"u{i}", "<p>", s) for i, s in enumerate(["Cnki", "Cqvip", "Wanfang"])]
    return materialise(spark.createDataFrame(rows, PAGES), "pages")


def test_pages_are_scanned_once_without_shuffle(spark):
    for df in (detail.extract(pages(spark)), listing.extract_links(pages(spark)),
               detail.failures_of(detail.extract(pages(spark)))):
        plan = plan_of(df)
        assert plan.count("FileScan") == 1
        assert "Exchange" not in plan
        # only the walk for the labelled values of layout C, by Arrow batches
        assert plan.count("Python") == plan.count("ArrowEvalPython") <= 1


def test_html_is_not_read_for_links_of_known_pages(spark):
    known = frontier.insert_ignore(pages(spark).select("url", F.col("page_id").alias("seq")))
    assert "html" not in plan_of(known)


def test_state_filter_reaches_the_scan(spark):
    log = materialise(spark.createDataFrame(
        [("a", "S", 0, 1)], "url string, source string, state int, seq long"), "log")
    assert "PushedFilters: [In(state, [-10,0])]" in plan_of(frontier.pending(log))


def test_merge_never_compares_all_pairs(spark):
    records = materialise(frame(spark, some_records(80, 21)), "records")
    result = merge.merge_records(records)
    both = merge.merge_into(result, frame(spark, some_records(0, 1)))
    for df in (result, both):
        plan = plan_of(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "Window" not in plan and "Python" not in plan


def test_a_later_run_goes_on_with_the_frontier(spark):
    from paperweave.plans.harvest import harvest, links_of_sites, number

    def listed(page, *urls):
        blocks = "".join(f"<div class=wz_content><a href={u}>t</a></div>" for u in urls)
        return (page, f"http://list/{page}", blocks, "Cnki")
    schema = "page_id long, url string, html string, source string"
    first = spark.createDataFrame([listed(1 << 45, "http://www.cnki.x/a", "http://www.cnki.x/b")], schema)
    gone = spark.createDataFrame([(5, "http://www.cnki.x/a", None, "Cnki"), (6, "http://w.x/c", None, "Wanfang")], schema)
    one = harvest(first, gone, mode="1")
    assert {(r["url"][-1], r["state"]) for r in one.frontier.collect()} == {("a", -15), ("b", 0)}
    second = spark.createDataFrame([listed(1, "http://www.cnki.x/b", "http://www.cnki.x/d")], schema)
    lost = spark.createDataFrame([(7, "http://www.cnki.x/b", " ", "Cnki")], schema)
    two = harvest(second, lost, mode="1", known_links=one.frontier)
    assert {(r["url"][-1], r["state"]) for r in two.frontier.collect()} == {("a", -15), ("b", -15), ("d", 0)}
    assert links_of_sites(second).count() == 2 and str(number(0, 1)) != ""


def test_a_stored_frontier_is_leased_recovered_and_continued(spark):
    from paperweave.plans.harvest import harvest
    from paperweave.session import shared_folder
    from paperweave.sources.tables import TransitionLog

    listed = spark.createDataFrame([
        (3, "http://list/3", "".join(f"<div class=wz_content><a href=http://www.cnki.x/{u}>t</a></div>" for u in "abc"),
         "Cnki")], PAGES)
    gone = spark.createDataFrame([(5, "http://www.cnki.x/a", None, "Cnki")], PAGES)
    log = TransitionLog(spark, shared_folder(spark, "frontier"))
    log.append(harvest(listed, gone, mode="1").frontier)
    log.append(frontier.lease(frontier.current_state(log.read()), frontier.following(log.read()), 1))
    states = {r["url"][-1]: r["state"] for r in frontier.current_state(log.read()).collect()}
    assert states == {"a": -15, "b": 10, "c": 0}
    now = frontier.current_state(log.read())
    log.append(frontier.recover(now, frontier.following(now)))
    more = spark.createDataFrame([(6, "http://www.cnki.x/b", None, "Cnki")], PAGES)
    two = harvest(listed, more, mode="1", known_links=frontier.current_state(log.read()))
    assert {r["url"][-1]: r["state"] for r in two.frontier.collect()} == {"a": -15, "b": -15, "c": 0}
    assert {r["run"] for r in two.frontier.select("seq.run").collect()} == {0, 3}
