"""Registered queries: one per operator, each with its expected result.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` maps the
same name to SQL over the tables. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweave.functions import clean, numerals
from paperweave.operators import detail, frontier, listing, merge, search
from paperweave.plans import inputs as I
from paperweave.plans import oracle as O
from paperweave.plans.harvest import harvest, links_of_sites
from paperweave.schema import PAGE_SCHEMA, RECORD_FIELDS, RECORD_SCHEMA, SEARCH_FIELDS, TRANSITION_SCHEMA
from paperweave.session import materialise, shared_folder, spread
from paperweave.sources import tables
from paperweave.sources.index import SearchIndex
from paperweave.sources.tables import (
    BucketedResult, ResultTable, TransitionLog, few_listings, page_files, read_pages, with_fetch_status,
    write_page_files,
)
from paperweave.streaming import harvest as stream
from paperweave.streaming.state import FoldedState

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.current_state(I.transitions(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all documents, written so that texts are read only once."""
    return materialise(I.records(spark, sf_dir), "records")


def _halves(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records up to the middle arrival number, and those after it."""
    middle = records.agg(F.floor(F.max("seq") / 2)).first()[0]
    return records.where(F.col("seq") <= middle), records.where(F.col("seq") > middle)


_HALF = "(SELECT floor(max(doc_id) / 2) FROM documents)"

# ------------------------------------------------------------ sources and sinks


@query("src1_page_scan", r"""
  SELECT page_id, url, trim(html, ' ' || chr(9) || chr(13) || chr(10)) <> '' AS fetched,
    CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def src1(spark, sf_dir):
    pages = with_fetch_status(read_pages(spark, f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", "fetched", F.length("html").cast("bigint").alias("n_chars"))


def _flat(log: DataFrame, *more: str) -> DataFrame:
    """Transitions with the parts of their place in the log that the tables fill."""
    return log.select("url", "source", "state", "seq.run", F.col("seq.position").alias("seq"), *more)


def _dealt_pages(spark, pages):
    """Pages with the folder and the half they go to, written so that each part is read by itself."""
    folders = max(-(-pages.count() // tables.FOLDER_PAGES), 1)
    path = shared_folder(spark, "dealt-pages")
    dealt = pages.withColumns({
        "folder": F.pmod(F.xxhash64("page_id", "url"), F.lit(folders)), "half": F.pmod(F.xxhash64("url"), F.lit(2))})
    spread(dealt, "folder", "half").write.partitionBy("folder", "half").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


@query("src1_page_files", r"""
  SELECT page_id, url, sha256(html) AS html_sha256 FROM pages
  WHERE trim(html, ' ' || chr(9) || chr(13) || chr(10)) <> ''""")
def src1_files(spark, sf_dir):
    """Pages as files of folders, each taken by a stream in two runs."""
    files, out, checkpoint = (shared_folder(spark, name) for name in ("files", "pages", "stream-checkpoint"))
    dealt = _dealt_pages(spark, read_pages(spark, f"{sf_dir}/pages.parquet"))
    folders = sorted(r["folder"] for r in dealt.select("folder").distinct().collect()) or [0]
    few = 4 * spark.sparkContext.defaultParallelism
    for half in (0, 1):
        for n in folders:
            write_page_files(dealt.where((F.col("folder") == n) & (F.col("half") == half)), f"{files}/{n}")
            with few_listings(spark):
                # Spark takes a task for every few files of a batch, and a file is written by each
                pages = page_files(spark, f"{files}/{n}", stream=True).coalesce(few)
                _run(lambda check, pace, rows=pages, n=n: stream.append_stream(rows, f"{out}/{n}", check, pace),
                     f"{checkpoint}/{n}")
    # one by one, as only so Spark reads what the streams have committed and no more
    taken = reduce(DataFrame.unionByName, [spark.read.schema(PAGE_SCHEMA).parquet(f"{out}/{n}") for n in folders])
    return taken.where("html IS NOT NULL").select("page_id", "url", F.sha2("html", 256).alias("html_sha256"))


@query("src2_frontier_log", f"WITH {O.TRANSITIONS} SELECT url, source, state, run, seq FROM transitions")
def src2(spark, sf_dir):
    log = TransitionLog(spark, shared_folder(spark, "frontier"))
    rows = I.transitions(spark, sf_dir)
    log.append(rows.where("state = 0"))
    log.append(rows.where("state <> 0"))
    return _flat(log.read())


@query("src3_result_table", f"WITH {O.RECORDS}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def src3(spark, sf_dir):
    table = ResultTable(spark, shared_folder(spark, "result"))
    first, second = _halves(_records(spark, sf_dir))
    table.merge(first, merge.merge_into)
    table.merge(second, merge.merge_into)
    return table.read()


# ------------------------------------------------------------------ list stage

@query("lst1_hit_count", f"""WITH {O.HITS}
  SELECT unnest(['A', 'B', 'C']) AS layout, o_custkey AS page_id, total FROM hits""")
def lst1(spark, sf_dir):
    pages = I.result_heads(spark, sf_dir)
    total = F.when(F.col("layout") == "A", listing.hit_count("html", "A")) \
        .when(F.col("layout") == "B", listing.hit_count("html", "B")) \
        .otherwise(listing.hit_count("html", "C"))
    return pages.select("layout", "page_id", total.alias("total"))


def _paged(spark, sf_dir):
    capped = F.when(F.col("size") == 50, listing.page_count(F.col("total"), F.col("size"), 100)) \
        .otherwise(listing.page_count(F.col("total"), F.col("size")))
    return I.hits(spark, sf_dir).select("o_custkey", "total", capped.alias("n_pages"))


@query("lst2_page_count", f"WITH {O.HITS} SELECT o_custkey, total, n_pages FROM paged")
def lst2(spark, sf_dir):
    return _paged(spark, sf_dir)


@query("lst3_page_plan", f"""WITH {O.HITS}
  SELECT o_custkey, n_pages, unnest(range(o_custkey % 4 + 1, n_pages + 1)) AS page FROM paged""")
def lst3(spark, sf_dir):
    return listing.page_plan(
        _paged(spark, sf_dir), F.col("o_custkey") % 4 + 1).select("o_custkey", "n_pages", "page")


@query("lst3_page_plan_last_left_out", f"""WITH {O.HITS}
  SELECT o_custkey, n_pages, unnest(range(1, n_pages)) AS page FROM paged""")
def lst3_exclusive(spark, sf_dir):
    return listing.page_plan(_paged(spark, sf_dir), 1, inclusive=False).select(
        "o_custkey", "n_pages", "page")


@query("lst4_anchors_of_pages", f"""
  WITH found AS (
    SELECT page_id, regexp_extract_all({O.VISIBLE}, '(?i)<a\\b[^>]*\\shref="([^"]*)"', 1) AS urls
    FROM pages)
  SELECT page_id, generate_subscripts(urls, 1) - 1 AS position,
    {O.plain('unnest(urls)')} AS url FROM found""")
def lst4(spark, sf_dir):
    return listing.extract_links(
        read_pages(spark, f"{sf_dir}/pages.parquet"), "any"
    ).select("page_id", F.col("position").cast("bigint").alias("position"), "url")


def _links(spark, sf_dir, layout):
    return listing.extract_links(I.link_pages(spark, sf_dir, layout), layout).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "url")


@query("lst4a_links", f"""WITH {O.LINK_N}
  SELECT page_id, i - 1 AS position, 'http://a.example/' || c || '/' || i || '?x=1&y=2' AS url
  FROM link_rows""")
def lst4a(spark, sf_dir):
    return _links(spark, sf_dir, "A")


@query("lst4b_links", f"""WITH {O.LINK_N}
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position,
    'http://www.cqvip.com/QK' || c || '/' || i || '%20a.html' AS url
  FROM link_rows WHERE i <> 3""")
def lst4b(spark, sf_dir):
    return _links(spark, sf_dir, "B")


@query("lst4c_links", f"""WITH {O.LINK_N}
  SELECT page_id, i - 1 AS position, 'http://g.wanfangdata.com.cn/details/detail.do?_type='
    || CASE WHEN i % 2 = 0 THEN 'perio' ELSE 'degree' END || '&id=' || c || '_' || i AS url
  FROM link_rows""")
def lst4c(spark, sf_dir):
    return _links(spark, sf_dir, "C")


@query("lst5_detail_url", """
  SELECT page_id, 'http://www.cqvip.com/' || replace(url_encode(url), '%2F', '/') AS url_b,
    'http://g.wanfangdata.com.cn/details/detail.do?_type=perio&id=' || page_id AS url_c FROM pages""")
def lst5(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", listing.detail_url_b(F.col("url")).alias("url_b"),
        listing.detail_url_c(F.lit("perio"), F.col("page_id").cast("string")).alias("url_c"))


# Search clauses, written out so that a wrong one in the library shows.
_SEARCH_A = O.search_text(
    {"title": " title:", "authors": " author:", "keywords": " qw:", "unit": " 作者单位:"}, False)
_SEARCH_B = O.search_text({"title": "&k=", "authors": "&w=", "keywords": "&k=", "unit": "&o="}, True)
_SEARCH_C = O.search_text(
    {"title": " 标题:", "authors": " 作者:", "keywords": " 关键词:", "unit": " 作者单位:"}, False)


@query("lst6_requests", f"""WITH {O.CRITERIA},
  planned AS (SELECT *, unnest(range(1, n_pages + 1)) AS page FROM criteria)
  SELECT p_partkey, page, 'A' AS layout, 'http://search.cnki.com.cn/Search.aspx?q='
    || replace(url_encode({_SEARCH_A}), '%2F', '/') || '&p=' || ((page - 1) * 15) AS request_url
  FROM planned
  UNION ALL
  SELECT p_partkey, page, 'B', 'http://www.cqvip.com/data/main/search.aspx?action=so&curpage='
    || page || '&perpage=10&' || {_SEARCH_B} FROM planned
  UNION ALL
  SELECT p_partkey, page, 'C', 'http://g.wanfangdata.com.cn/search/searchList.do'
    || '?searchType=all&pageSize=50&searchWord=' || {_SEARCH_C} || ' 起始年:1990 结束年:2019'
    || '&showType=detail&isHit=null&isHitUnit=&firstAuthor=false&rangeParame=all&navSearchType='
    || '&page=' || page FROM planned""")
def lst6(spark, sf_dir):
    plan = listing.page_plan(I.criteria(spark, sf_dir).withColumn(
        "layout", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C")))))
    return listing.request_manifest(plan).select("p_partkey", "page", "layout", "request_url")


@query("lst7_paging_progress", f"""WITH {O.HITS},
  planned AS (SELECT o_custkey, n_pages, unnest(range(1, n_pages + 1)) AS page FROM paged)
  SELECT o_custkey, page, round(page / n_pages * 100, 2) AS pct FROM planned""")
def lst7(spark, sf_dir):
    plan = listing.page_plan(_paged(spark, sf_dir))
    return plan.select(
        "o_custkey", "page", listing.paging_progress(F.col("page"), F.col("n_pages")).alias("pct"))


def _list_stage(spark, sf_dir, name):
    """Searches with their list pages, a link on each."""
    searches = _paged(spark, sf_dir).select(F.col("o_custkey").cast("string").alias("search"), "n_pages")
    pages = listing.page_plan(searches).select(
        "search", "page", I.fill("<div class=wz_content><a href='http://a.example/{search}/{page}'>t</a></div>")
        .alias("html"), F.lit("Cnki").alias("source"))
    return searches, materialise(pages, "fetched-pages"), stream.ListStage(spark, shared_folder(spark, name), every=2)


@query("lst3_resumed_cursor", f"""WITH {O.HITS},
  planned AS (SELECT o_custkey, unnest(range(1, n_pages + 1)) AS page FROM paged)
  SELECT CAST(o_custkey AS VARCHAR) AS search, page, 'http://a.example/' || o_custkey || '/' || page AS url
  FROM planned""")
def lst3_resumed(spark, sf_dir):
    """All pages in any order, many of them twice, by a stage that is started anew for each part."""
    _, pages, stage = _list_stage(spark, sf_dir, "list-stage")
    part = F.pmod(F.xxhash64("search", "page"), F.lit(4))
    again = F.pmod(F.xxhash64("page", "search"), F.lit(4))
    inbox, checkpoint = shared_folder(spark, "inbox"), _checkpoint(spark)
    for k in range(4):
        pages.where((part == k) | (again == k)).write.mode("append").parquet(inbox)
        _run(stage.start, stream.stream_table(spark, inbox, pages.schema), checkpoint)
    done = stage.cursors.read().withColumnRenamed("page", "last")
    return stage.links().join(done, "search").where("page <= last").select("search", "page", "url")


@query("lst3_remaining_pages", f"""WITH {O.HITS}
  SELECT CAST(o_custkey AS VARCHAR) AS search, unnest(range(n_pages // 2 + 1, n_pages)) AS page FROM paged""")
def lst3_remaining(spark, sf_dir):
    """What is left to fetch after the first half and the last page of every search."""
    searches, pages, stage = _list_stage(spark, sf_dir, "list-stage")
    counted = pages.join(searches, "search")
    stage.take(counted.where("page <= n_pages div 2").drop("n_pages"), 0)
    stage.take(counted.where("page = n_pages").drop("n_pages"), 1)
    return stage.remaining(searches).select("search", "page")


# -------------------------------------------------------------------- frontier

def link_seq():
    """A number for the links of the given pages, which have fewer than 2 ** 20 links each."""
    return F.col("page_id") * 1048576 + F.col("position")


def _numbered_links(spark, sf_dir):
    links = listing.extract_links(I.link_pages(spark, sf_dir, "A"), "A")
    return links.select("url", link_seq().alias("seq"), F.lit("Cnki").alias("source"))


_NUMBERED = f"""{O.LINK_N}, numbered AS (
  SELECT page_id, 'http://a.example/' || c || '/' || i || '?x=1&y=2' AS url,
    page_id * 1048576 + i - 1 AS seq, 'Cnki' AS source FROM link_rows)"""


@query("frt1_insert_ignore", f"""WITH {_NUMBERED}
  SELECT url, min(seq) AS seq, min(source) AS source FROM numbered GROUP BY url""")
def frt1(spark, sf_dir):
    return frontier.insert_ignore(_numbered_links(spark, sf_dir))


@query("frt1_insert_into_existing", f"""WITH {_NUMBERED}
  SELECT url, min(seq) AS seq, min(source) AS source FROM numbered
  WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM numbered WHERE page_id % 2 = 0)
  GROUP BY url""")
def frt1_existing(spark, sf_dir):
    links = materialise(_numbered_links(spark, sf_dir), "numbered")  # pages are parsed once
    odd = F.shiftright("seq", 20) % 2 == 1
    return frontier.insert_ignore(links.where(odd), links.where(~odd))


_PENDING = f"""WITH {O.TRANSITIONS},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq, url) AS rank
             FROM frontier WHERE state IN (0, -10))"""


@query("frt2_pending", f"{_PENDING} SELECT url, source, state, run, seq, rank FROM ranked WHERE rank <= 20")
def frt2(spark, sf_dir):
    return _flat(frontier.pending(_frontier(spark, sf_dir), 20).withColumn(
        "rank", F.col("rank").cast("bigint")), "rank")


# the place of what is appended after the tables' transitions
_NEXT = "CAST(1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS seq"


@query("frt3_lease", f"""{_PENDING} SELECT url, source, CAST(10 AS INTEGER) AS state, {_NEXT}
  FROM ranked WHERE rank <= 20""")
def frt3(spark, sf_dir):
    log = I.transitions(spark, sf_dir)
    return _flat(frontier.lease(frontier.current_state(log), frontier.following(log), 20))


def _late_log(spark, sf_dir):
    """The log with places as large as hashes."""
    place = F.col("seq.position") + F.lit(1 << 61)
    return I.transitions(spark, sf_dir).withColumn("seq", F.col("seq").withField("position", place))


def _after(changed: str, state: int) -> str:
    return f"""SELECT url, source, CAST(CASE WHEN {changed} THEN {state} ELSE state END AS INTEGER) AS state,
    CAST(CASE WHEN {changed} THEN 1 ELSE 0 END AS BIGINT) AS run,
    CASE WHEN {changed} THEN 0 ELSE seq + {1 << 61} END AS seq FROM frontier"""


@query("frt3_lease_fold", f"""{_PENDING}, leased AS (SELECT url FROM ranked WHERE rank <= 20)
  {_after("url IN (FROM leased)", 10)}""")
def frt3_fold(spark, sf_dir):
    log = _late_log(spark, sf_dir)
    taken = frontier.lease(frontier.current_state(log), frontier.following(log), 20)
    return _flat(frontier.current_state(log.unionByName(taken)))


@query("frt6_recover_fold", f"WITH {O.TRANSITIONS} {_after('state = 10', 0)}")
def frt6_fold(spark, sf_dir):
    log = _late_log(spark, sf_dir)
    back = frontier.recover(frontier.current_state(log), frontier.following(log))
    return _flat(frontier.current_state(log.unionByName(back)))


_MARKED = f"""WITH {O.HARVEST},
  frontier AS (SELECT url, site, lost, ok FROM shown WHERE page_id % 13 <> 0)"""


def _listed(spark, sf_dir):
    return frontier.insert_ignore(links_of_sites(I.list_pages(spark, sf_dir)))


def _parsed(spark, sf_dir):
    fetched = with_fetch_status(I.site_pages(spark, sf_dir))
    return fetched, detail.extract(fetched.where("fetched").drop("fetched"))


@query("frt4_complete", f"""{_MARKED}
  SELECT url, site AS source, CAST(20 AS INTEGER) AS state FROM frontier WHERE ok""")
def frt4(spark, sf_dir):
    records = clean.normalise_records(detail.records_of(_parsed(spark, sf_dir)[1]))
    return frontier.complete(_listed(spark, sf_dir), records, F.lit(1)).drop("seq")


@query("frt5_invalidate", f"""{_MARKED}
  SELECT url, site AS source, CAST(-15 AS INTEGER) AS state FROM frontier WHERE NOT ok""")
def frt5(spark, sf_dir):
    fetched, parsed = _parsed(spark, sf_dir)
    unusable = parsed.where(~F.col("ok")).select("url").unionByName(
        fetched.where(~F.col("fetched")).select("url"))
    return frontier.invalidate(_listed(spark, sf_dir), unusable, F.lit(1)).drop("seq")


@query("frt6_recover", f"""WITH {O.TRANSITIONS}
  SELECT url, source, CAST(CASE WHEN state = 10 THEN 0 ELSE state END AS INTEGER) AS state, run, seq
  FROM frontier""")
def frt6(spark, sf_dir):
    return _flat(frontier.recovered(_frontier(spark, sf_dir)))


@query("frt7_current_state", f"WITH {O.TRANSITIONS} SELECT url, source, state, run, seq FROM frontier")
def frt7(spark, sf_dir):
    return _flat(_frontier(spark, sf_dir))


@query("frt7_folded_state", f"WITH {O.TRANSITIONS} SELECT url, source, state, run, seq FROM frontier")
def frt7_folded(spark, sf_dir):
    state = FoldedState(spark, shared_folder(spark, "folded"), TRANSITION_SCHEMA, ["url"], "url", "seq", every=3)
    log = materialise(I.transitions(spark, sf_dir), "log")
    last = log.agg(F.max("seq.position")).first()[0] or 0
    for k in range(10):
        state.append(log.where(F.floor(F.col("seq.position") * 10 / (last + 1)) == k), k)
    return _flat(state.read())


@query("frt8_progress", f"WITH {O.TRANSITIONS} {O.PROGRESS.format(table='frontier')}")
def frt8(spark, sf_dir):
    return frontier.progress(_frontier(spark, sf_dir))


@query("frt9_completion", f"""WITH {O.TRANSITIONS}
  SELECT source, count(*) = count(*) FILTER (WHERE state IN (20, -5, -15)) AS complete
  FROM frontier GROUP BY source""")
def frt9(spark, sf_dir):
    return frontier.completion(frontier.progress(_frontier(spark, sf_dir)))


@query("frt10_totals", f"""WITH {O.TRANSITIONS}
  SELECT count(*) AS n_all, count(*) FILTER (WHERE state = 20) AS n_finished,
    round(count(*) FILTER (WHERE state = 20) / count(*) * 100, 2) AS pct FROM frontier""")
def frt10(spark, sf_dir):
    return frontier.totals(_frontier(spark, sf_dir))


@query("frt11_labels", f"""WITH {O.TRANSITIONS}
  SELECT url, source, state, run, seq, CASE state WHEN 0 THEN 'initial' WHEN 10 THEN 'in progress'
    WHEN 20 THEN 'finished' WHEN -5 THEN 'wrong date' WHEN -10 THEN 'error'
    WHEN -15 THEN 'invalid link' END AS label
  FROM transitions""")
def frt11(spark, sf_dir):
    return _flat(frontier.with_labels(I.transitions(spark, sf_dir)), "label")


# ---------------------------------------------------------------- detail stage

def _extracted(spark, sf_dir, layout, reader):
    fetched = with_fetch_status(I.detail_pages(spark, sf_dir, layout)).where("fetched")
    return detail.records_of(reader(fetched.drop("fetched"))).select("page_id", *RECORD_FIELDS)


def _detail_sql(table: str) -> str:
    return f"""WITH {O.ARTICLES}, {O.DETAIL_A}, {O.DETAIL_B}, {O.DETAIL_C}
  SELECT {O.DETAIL_COLUMNS} FROM {table} WHERE ok"""


@query("det1_layout_a", _detail_sql("detail_a"))
def det1(spark, sf_dir):
    return _extracted(spark, sf_dir, "A", detail.extract_a)


@query("det2_layout_b", _detail_sql("detail_b"))
def det2(spark, sf_dir):
    return _extracted(spark, sf_dir, "B", detail.extract_b)


@query("det3_layout_c", _detail_sql("detail_c"))
def det3(spark, sf_dir):
    return _extracted(spark, sf_dir, "C", detail.extract_c)


@query("det3_heading_of_pages", f"""
  SELECT page_id, url,
    {O.plain(f"regexp_extract({O.VISIBLE}, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
    {O.plain(f"regexp_extract({O.VISIBLE}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading
  FROM pages""")
def det_heading(spark, sf_dir):
    return detail.heading_fields(read_pages(spark, f"{sf_dir}/pages.parquet"))


@query("det4_type", f"""WITH {O.ARTICLES}, {O.DETAIL_C}
  SELECT type, count(*) AS n FROM detail_c WHERE ok GROUP BY type""")
def det4(spark, sf_dir):
    return _extracted(spark, sf_dir, "C", detail.extract_c).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"))


@query("det5_authors", f"""WITH {O.ARTICLES}, {O.DETAIL_C}
  SELECT page_id, type, authors FROM detail_c WHERE ok""")
def det5(spark, sf_dir):
    return _extracted(spark, sf_dir, "C", detail.extract_c).select("page_id", "type", "authors")


@query("det6_defaults", """
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS url,
    CASE WHEN page_id % 2 = 0 THEN 't' || page_id ELSE '' END AS title, '' AS authors, '' AS unit,
    '' AS publication, '' AS keywords, '' AS abstract,
    CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE '' END AS year,
    '' AS volume, '' AS issue, '' AS pagecode, '' AS doi, '' AS sponser, '' AS type FROM pages""")
def det6(spark, sf_dir):
    from paperweave.schema import with_record_defaults
    pages = read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("url"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("t"), "page_id")).alias("title"),
        F.when(F.col("page_id") % 3 == 0, F.col("page_id")).alias("year"),
        F.lit(None).cast("string").alias("doi"))
    return with_record_defaults(pages).drop("source")


@query("det7_failures", f"""WITH {O.ARTICLES}, {O.DETAIL_A}, {O.DETAIL_B}, {O.DETAIL_C}
  SELECT page_id, url, 'Cnki' AS source, CAST(-15 AS INTEGER) AS state FROM detail_a
    WHERE NOT ok AND NOT lost
  UNION ALL SELECT page_id, url, 'Cqvip', -15 FROM detail_b WHERE NOT ok AND NOT lost
  UNION ALL SELECT page_id, url, 'Wanfang', -15 FROM detail_c WHERE NOT ok AND NOT lost""")
def det7(spark, sf_dir):
    pages = [I.detail_pages(spark, sf_dir, layout) for layout in "ABC"]
    fetched = with_fetch_status(pages[0].unionByName(pages[1]).unionByName(pages[2]))
    return detail.failures_of(detail.extract(fetched.where("fetched").drop("fetched")))


@query("det8_dispatch", f"""WITH {O.HARVEST}
  SELECT site AS source, count(*) FILTER (WHERE ok) AS n_ok,
    count(*) FILTER (WHERE NOT ok) AS n_failed
  FROM shown WHERE site <> 'Cqvip' AND NOT lost GROUP BY site""")
def det8(spark, sf_dir):
    fetched = with_fetch_status(I.site_pages(spark, sf_dir)).where("fetched").drop("fetched")
    return detail.extract(fetched, mode="13").groupBy("source").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


# --------------------------------------------------------------- normalisation

_DIRTY = r"""dirty AS (
  SELECT doc_id, '"a%b''c' || chr(9) || 'd' || chr(13) || 'e' || chr(160) || 'f ' || chr(10)
    || text || chr(9) || '%22 ''' || chr(13) || chr(10) AS text FROM documents)"""


@query("nrm1_strip_special", """
  SELECT doc_id, regexp_replace(text, '[^一-龥.^a-zA-Z0-9]', '', 'g') AS text FROM documents""")
def nrm1(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", clean.strip_special("text").alias("text"))


@query("nrm2_nonblank", f"""WITH {O.CRITERIA}
  SELECT p_partkey, authors <> '' AS authors, keywords <> '--' AS keywords, unit <> ' ' AS unit
  FROM criteria""")
def nrm2(spark, sf_dir):
    return I.criteria(spark, sf_dir).select(
        "p_partkey", *[clean.is_nonblank(c).alias(c) for c in ("authors", "keywords", "unit")])


@query("nrm3_clean_value", f"WITH {_DIRTY} SELECT doc_id, {O._clean('text')} AS text FROM dirty")
def nrm3(spark, sf_dir):
    return I.dirty(spark, sf_dir).select("doc_id", clean.clean_value("text").alias("text"))


@query("nrm4_strip_guillemets", f"""WITH {O.ARTICLES}, {O.DETAIL_A}
  SELECT page_id, replace(replace(publication, '《', ''), '》', '') AS publication FROM detail_a""")
def nrm4(spark, sf_dir):
    return I.articles(spark, sf_dir).select(
        F.col("k").alias("page_id"),
        clean.strip_guillemets(I.fill("《{pub}》")).alias("publication"))


@query("nrm5_restore_url", """
  SELECT page_id, replace(replace(url, '%', '>'), '>', '%') || '%22' AS url FROM pages""")
def nrm5(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", clean.restore_url(clean.clean_value(I.fill("{url}%22"))).alias("url"))


@query("nrm6_source_of_url", """
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cqvip' WHEN 1 THEN 'cnki' WHEN 2 THEN 'wanfang'
    ELSE '' END AS source FROM pages""")
def nrm6(spark, sf_dir):
    marks = I.pick(["/cqvip", "/cnki?cqvip", "/wanfang/cnki", "/CNKI"], F.col("page_id") % 4)
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", clean.source_of_url(F.concat("url", marks)).alias("source"))


_SPELT = """CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber * 1000 END + CAST(l_quantity AS INT)"""


@query("nrm7_number", f"""
  SELECT l_orderkey, l_linenumber, l_quantity, CAST({_SPELT} AS BIGINT) AS value,
    CAST(list_sum(list_transform(string_split(CAST(year(l_shipdate) AS VARCHAR), ''),
      lambda d: CAST(d AS INT))) AS BIGINT) AS year_compat,
    CAST(year(l_shipdate) AS BIGINT) AS year_strict
  FROM lineitem""")
def nrm7(spark, sf_dir):
    return I.numerals(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_quantity",
        numerals.compat_number(F.col("spelt")).cast("bigint").alias("value"),
        numerals.compat_number(F.col("spelt_year")).cast("bigint").alias("year_compat"),
        numerals.strict_number(F.col("spelt_year")).cast("bigint").alias("year_strict"))


@query("nrm8_numbers_in_text", f"""
  SELECT l_orderkey, l_linenumber, l_quantity,
    '第' || ({_SPELT}) || '期 ' || l_linenumber || '卷' || l_returnflag || '零百' AS text
  FROM lineitem""")
def nrm8(spark, sf_dir):
    rows = I.numerals(spark, sf_dir)
    text = F.concat(F.lit("第"), "spelt", F.lit("期 "), F.translate(
        F.col("l_linenumber").cast("string"), "0123456789", "零一二三四五六七八九"),
        F.lit("卷"), "l_returnflag", F.lit("零百"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity",
                    numerals.replace_numbers(text).alias("text"))


@query("nrm9_between", """
  SELECT doc_id, substr(text, instr(text, ',') + 1, greatest(0,
    CASE WHEN instr(text, '.') > 0 THEN instr(text, '.') - 1 ELSE length(text) - 1 END
    - instr(text, ','))) AS text FROM documents""")
def nrm9(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", clean.between("text", ",", ".").alias("text"))


@query("nrm10_squeeze", f"""WITH {_DIRTY}
  SELECT doc_id, replace(replace(replace(text, chr(13), ''), chr(10), ''), ' ', '') AS text,
    translate(text, chr(13) || chr(10) || chr(9) || ' ', '') AS text_tabs FROM dirty""")
def nrm10(spark, sf_dir):
    return I.dirty(spark, sf_dir).select(
        "doc_id", clean.squeeze("text").alias("text"),
        clean.squeeze("text", tabs=True).alias("text_tabs"))


@query("nrm11_digits", """
  SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year,
    CAST(month(o_orderdate) AS VARCHAR) AS issue, left(o_orderpriority, 1) AS priority
  FROM orders""")
def nrm11(spark, sf_dir):
    rows = I.table(spark, sf_dir, "orders").withColumn("text", I.fill(
        "卷7 {y}年第{m}期", y=F.year("o_orderdate"), m=F.month("o_orderdate")))
    return rows.select(
        "o_orderkey", clean.digits_before("text", "年").alias("year"),
        clean.digits_before("text", "期").alias("issue"),
        clean.first_digits("o_orderpriority").alias("priority"))


@query("nrm12_percent_quote", """
  SELECT page_id, replace(url_encode(url || ' 失谐~*+'), '%2F', '/') AS url FROM pages""")
def nrm12(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", clean.percent_quote(I.fill("{url} 失谐~*+")).alias("url"))


@query("nrm13_section", """
  SELECT doc_id, CASE WHEN instr(text, '. ') = 0 THEN '' ELSE
    split_part(split_part(text, '. ', 2), ',', 1) END AS text FROM documents""")
def nrm13(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", clean.section("text", ". ", ",").alias("text"))


@query("nrm14_value_lists", """
  SELECT doc_id, rtrim(replace(text, '.', ';'), ';') AS joined,
    replace(trim(text, chr(10)), chr(10), ';') AS lines FROM documents""")
def nrm14(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", clean.join_values(F.split("text", r"\.")).alias("joined"),
        clean.join_lines("text").alias("lines"))


# ----------------------------------------------------------------------- merge

@query("mrg1_match_probe", f"""WITH {O.RECORDS.replace('FROM documents)', f'FROM documents WHERE doc_id <= {_HALF})')}, {O.MERGE},
  probes AS (
    SELECT doc_id AS seq, {O._clean("split_part(text, chr(10), 1)")} AS title,
      source AS publication FROM documents WHERE doc_id > {_HALF})
  SELECT p.seq, count(m.id) AS n_matches FROM probes p LEFT JOIN merged m
    ON m.title = p.title AND contains(m.publication, p.publication) GROUP BY p.seq""")
def mrg1(spark, sf_dir):
    first, second = _halves(_records(spark, sf_dir))
    result = materialise(merge.merge_records(first), "first-half")
    return merge.count_matches(result, second).select("seq", "n_matches")


@query("mrg2_insert", f"""WITH {O.RECORDS}, {O.MERGE}
  SELECT seq, url, source, {O.FIELD_LIST} FROM records WHERE seq IN (SELECT s0 FROM creators)""")
def mrg2(spark, sf_dir):
    records = _records(spark, sf_dir)
    plan = merge.plan_merge(merge.build_groups(merge.with_keys(records)))
    return merge.inserted(records, plan).select("seq", *RECORD_FIELDS, "source")


@query("mrg3_enrich", f"""WITH {O.RECORDS}, {O.MERGE}
  SELECT id, seq, url, source FROM members""")
def mrg3(spark, sf_dir):
    keyed = merge.with_keys(_records(spark, sf_dir))
    plan = merge.plan_merge(merge.build_groups(keyed))
    return merge.membership_ids(merge.memberships(keyed, plan), plan).select(
        "id", "seq", "url", "source")


@query("mrg4_batch", f"WITH {O.RECORDS}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def mrg4(spark, sf_dir):
    return merge.merge_records(_records(spark, sf_dir))


@query("mrg4_papers", f"""WITH {O.RECORDS}, {O.MERGE}, counted AS (SELECT id, count(*) AS n_links FROM members GROUP BY id)
  SELECT id, n_links, {O.FIELD_LIST} FROM merged JOIN counted USING (id)""")
def mrg4_papers(spark, sf_dir):
    keyed = merge.with_keys(_records(spark, sf_dir))
    return merge.papers(merge.memberships(keyed, merge.plan_merge(merge.build_groups(keyed))))


@query("mrg5_incremental", f"WITH {O.RECORDS}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def mrg5(spark, sf_dir):
    first, second = _halves(_records(spark, sf_dir))
    result = materialise(merge.merge_records(first), "first-half")
    return merge.merge_into(result, second)


@query("mrg5_colocated", f"WITH {O.RECORDS}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def mrg5_colocated(spark, sf_dir):
    table = BucketedResult(spark, shared_folder(spark, "bucketed"), buckets=8)
    for part in _halves(_records(spark, sf_dir)):
        table.merge(part)
    return table.read()


@query("mrg3_listed", f"""WITH {O.RECORDS}, {O.MERGE},
  placed AS (SELECT id, seq, url, source, (row_number() OVER (PARTITION BY id ORDER BY seq) - 1) // 4 AS chunk FROM members)
  SELECT id, chunk, count(*) AS n, string_agg(url, ';' ORDER BY seq) AS url,
    string_agg(source, ';' ORDER BY seq) AS source FROM placed GROUP BY id, chunk""")
def mrg3_listed(spark, sf_dir):
    keyed = merge.with_keys(_records(spark, sf_dir))
    plan = merge.plan_merge(merge.build_groups(keyed))
    return merge.listed(merge.membership_ids(merge.memberships(keyed, plan), plan), 4)


@query("mrg6_status", f"""{_MARKED},
  marked AS (SELECT site AS source, CASE WHEN ok THEN 20 ELSE -15 END AS state FROM frontier)
  SELECT source, CAST(state AS INTEGER) AS state, count(*) AS n FROM marked GROUP BY ALL""")
def mrg6(spark, sf_dir):
    run = harvest(I.list_pages(spark, sf_dir), I.site_pages(spark, sf_dir),
                  first_year=0, last_year=9999)
    return run.frontier.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))


@query("mrg7_contributions", f"""WITH {O.RECORDS}, {O.MERGE},
  combined AS (SELECT id, string_agg(DISTINCT source, ';' ORDER BY source) AS sources
               FROM members GROUP BY id)
  SELECT sources, count(*) AS n_rows FROM combined GROUP BY sources""")
def mrg7(spark, sf_dir):
    keyed = merge.with_keys(_records(spark, sf_dir))
    plan = merge.plan_merge(merge.build_groups(keyed))
    return merge.contributions(merge.memberships(keyed, plan))


# ---------------------------------------------------------------------- search

def _part_records(spark, sf_dir):
    return I.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("keywords"),
        F.col("p_type").alias("unit"), F.lit("").alias("authors"))


@query("sea1_field_criteria", """
  SELECT p_partkey, p_name AS title, p_brand AS keywords FROM part
  WHERE contains(lower(p_name), 'ring') AND contains(lower(p_brand), 'brand#1')""")
def sea1(spark, sf_dir):
    return _part_records(spark, sf_dir).where(search.matches(
        title="RING", keywords="Brand#1", unit=" --")).select("p_partkey", "title", "keywords")


# Searches as (title, authors, keywords, unit); texts shorter than a gram, longer ones, none.
_SEARCHES = [("RING", "", "Brand#1", ""), ("e", "", "", ""), ("ue", "", "#2", "SM"), ("all bo", "", "", "econo"),
             ("small ring", "", "Brand#2", "ECONOMY"), ("no such part", "", "", ""), ("", "", "--", "")]


@query("sea1_indexed", " UNION ALL ".join(
    f"SELECT CAST({n} AS INTEGER) AS search, p_partkey FROM part WHERE " + " AND ".join(
        [f"contains(lower({c}), '{text.lower()}')" for c, text in zip(("p_name", "''", "p_brand", "p_type"), texts)
         if text.strip("-")] or ["true"]) for n, texts in enumerate(_SEARCHES)))
def sea1_indexed(spark, sf_dir):
    index = SearchIndex(spark, shared_folder(spark, "index"))
    index.build(_part_records(spark, sf_dir), "p_partkey")
    found = [index.matching(**dict(zip(SEARCH_FIELDS, texts))).select(
        F.lit(n).alias("search"), F.col("id").alias("p_partkey")) for n, texts in enumerate(_SEARCHES)]
    return reduce(DataFrame.unionByName, found)


_YEARS = """
  SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders
  WHERE o_orderkey % 7 <> 0 AND year(o_orderdate) BETWEEN 1995 AND 1998"""


@query("sea2_pruned_years", _YEARS)
def sea2_pruned(spark, sf_dir):
    written = materialise(search.by_year(_dated(spark, sf_dir)), "by-year")
    return search.between_years(written, 1995, 1998)


def _dated(spark, sf_dir):
    return I.table(spark, sf_dir, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 7 == 0, "n.d.").otherwise(
            F.year("o_orderdate").cast("string")).alias("year"))


@query("sea2_year_range", _YEARS)
def sea2(spark, sf_dir):
    return _dated(spark, sf_dir).where(search.year_in_range(1995, 1998))


@query("sea3_wrong_date", f"""WITH {O.HARVEST}
  SELECT raw_url AS url, site AS source, CAST(-5 AS INTEGER) AS state FROM records
  WHERE year <> '' AND CAST(year AS INTEGER) NOT BETWEEN 1995 AND 1998""")
def sea3(spark, sf_dir):
    records = clean.normalise_records(detail.records_of(_parsed(spark, sf_dir)[1]))
    return search.wrong_dates(_listed(spark, sf_dir), records, F.lit(1), 1995, 1998).drop("seq")


# ------------------------------------------------------------------- streaming

def _run(start, *args) -> None:
    """Run a stream over everything that is there, in this call."""
    running = start(*args, pace=None)
    running.awaitTermination()


def _checkpoint(spark):
    return shared_folder(spark, "stream-checkpoint")


def _in_parts(spark, rows, schema, start, order="seq", parts=4) -> None:
    """Feed the rows in so many parts by ``order``; after each the stream stops and is started
    again from its checkpoint."""
    inbox, checkpoint = shared_folder(spark, "inbox"), _checkpoint(spark)
    last = rows.agg(F.max(order)).first()[0] or 0
    part = F.least(F.floor(F.col(order) * parts / (last + 1)), F.lit(parts - 1))
    for k in range(parts):
        rows.where(part == k).select(*schema.names).write.mode("append").parquet(inbox)
        _run(start, stream.stream_table(spark, inbox, schema), checkpoint)


def _pages_in_parts(spark, sf_dir, start) -> None:
    _in_parts(spark, read_pages(spark, f"{sf_dir}/pages.parquet"), PAGE_SCHEMA, start, "page_id")


@query("str1_leased_intake", """WITH
  links AS (SELECT page_id, url, page_id % 3 AS s,
      least(CAST(floor(page_id * 4 / ((SELECT max(page_id) FROM pages) + 1)) AS INTEGER), 3) AS part FROM pages),
  a AS (SELECT s, count(*) FILTER (WHERE part = 0) AS a0, count(*) FILTER (WHERE part = 1) AS a1,
      count(*) FILTER (WHERE part = 2) AS a2, count(*) FILTER (WHERE part = 3) AS a3 FROM links GROUP BY s),
  l0 AS (SELECT *, least(20, a0) AS n0 FROM a),
  l1 AS (SELECT *, least(20, a0 + a1 - n0) AS n1 FROM l0),
  l2 AS (SELECT *, least(20, a0 + a1 + a2 - n0 - n1) AS n2 FROM l1),
  l3 AS (SELECT *, least(20, a0 + a1 + a2 + a3 - n0 - n1 - n2) AS n3 FROM l2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY page_id) AS rank FROM links)
  SELECT page_id, url FROM ranked JOIN l3 USING (s) WHERE rank <= n0 + n1 + n2 + n3""")
def str1_leased(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    links = pages.select("url", F.concat(F.lit("site"), F.col("page_id") % 3).alias("source"),
                         frontier.number(0, page=F.col("page_id")).alias("seq"))
    sink = stream.LeasedIntake(spark, shared_folder(spark, "intake"), pages, every=2)
    _in_parts(spark, links, links.schema, sink.start, "seq.page_id")
    return sink.pages().select("page_id", "url")


@query("str1_paced_intake", "SELECT page_id, url, html FROM pages")
def str1(spark, sf_dir):
    out = shared_folder(spark, "intake")
    _pages_in_parts(spark, sf_dir, lambda pages, check, pace: stream.append_stream(pages, out, check, pace))
    return spark.read.schema(PAGE_SCHEMA).parquet(out)


@query("str2_distinct_links", f"""
  WITH found AS (
    SELECT unnest(regexp_extract_all({O.VISIBLE}, '(?i)<a\\b[^>]*\\shref="([^"]*)"', 1)) AS url
    FROM pages)
  SELECT DISTINCT {O.plain('url')} AS url FROM found""")
def str2(spark, sf_dir):
    out = shared_folder(spark, "links")
    _pages_in_parts(spark, sf_dir, lambda pages, check, pace: stream.append_stream(
        stream.distinct_links(pages, "any").select("url"), out, check, pace))
    return spark.read.schema("url string").parquet(out)


@query("str2_first_arrivals", f"""WITH found AS (
    SELECT page_id, regexp_extract_all({O.VISIBLE}, '(?i)<a\\b[^>]*\\shref="([^"]*)"', 1) AS urls
    FROM pages),
  numbered AS (
    SELECT page_id * 1048576 + generate_subscripts(urls, 1) - 1 AS seq,
      {O.plain('unnest(urls)')} AS url FROM found)
  SELECT url, min(seq) AS seq FROM numbered GROUP BY url""")
def str2_first(spark, sf_dir):
    sink = stream.LinkSink(spark, shared_folder(spark, "frontier"), every=2)
    _pages_in_parts(spark, sf_dir, lambda pages, check, pace: sink.start(
        listing.extract_links(pages, "any").select("url", link_seq().alias("seq")), check, pace))
    return sink.links()


@query("str3_extraction", f"""WITH {O.HARVEST}
  SELECT page_id, url, ok, publication, year FROM shown WHERE ok
  UNION ALL SELECT page_id, url, ok, '', '' FROM shown WHERE NOT ok""")
def str3(spark, sf_dir):
    pages = I.site_pages(spark, sf_dir)
    sink = stream.ExtractionSink(spark, shared_folder(spark, "extraction"))
    inbox = shared_folder(spark, "inbox")
    # as many files as cores, so the stream has the same few batches however finely pages are dealt
    pages.coalesce(spark.sparkContext.defaultParallelism).write.parquet(inbox)
    _run(sink.start, stream.stream_table(spark, inbox, pages.schema, 4), _checkpoint(spark))
    good = sink.records().select("page_id", "url", F.lit(True).alias("ok"), "publication", "year")
    bad = sink.failures().select(
        "page_id", "url", F.lit(False).alias("ok"), F.lit("").alias("publication"),
        F.lit("").alias("year"))
    return good.unionByName(bad)


@query("str3_counts", f"""WITH {O.HARVEST}
  SELECT site AS source, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed
  FROM shown GROUP BY site""")
def str3_counts(spark, sf_dir):
    sink = stream.ExtractionSink(spark, shared_folder(spark, "extraction"))
    pages = materialise(I.site_pages(spark, sf_dir), "pages")
    schema = T.StructType([*PAGE_SCHEMA.fields, T.StructField("source", T.StringType())])
    _in_parts(spark, pages, schema, sink.start, "page_id", parts=2)
    return sink.counts()


@query("str4_counts", f"""WITH {O.RECORDS}, {O.MERGE}
  SELECT CAST((SELECT count(*) FROM members) AS BIGINT) AS contributions,
    CAST((SELECT count(*) FROM creators) AS BIGINT) AS papers""")
def str4_counts(spark, sf_dir):
    sink = stream.MergeSink(spark, shared_folder(spark, "merge"))
    _in_parts(spark, _records(spark, sf_dir), RECORD_SCHEMA, sink.start, parts=2)
    return sink.counts()


@query("str4_merge", f"WITH {O.RECORDS}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def str4(spark, sf_dir):
    sink = stream.MergeSink(spark, shared_folder(spark, "merge"), every=2)
    _in_parts(spark, _records(spark, sf_dir), RECORD_SCHEMA, sink.start)
    return sink.result()


@query("str5_live_progress", f"""WITH {O.TRANSITIONS}
  SELECT source, state, count(*) AS n FROM frontier GROUP BY source, state""")
def str5(spark, sf_dir):
    sink = stream.ProgressSink(spark, shared_folder(spark, "progress"), every=2)
    _in_parts(spark, I.transitions(spark, sf_dir), TRANSITION_SCHEMA, sink.start, "seq.position")
    return sink.counts()


@query("str6_restart_recovery", f"""WITH {O.TRANSITIONS}
  SELECT source, CAST(CASE WHEN state = 10 THEN 0 ELSE state END AS INTEGER) AS state,
    count(*) AS n FROM frontier GROUP BY ALL""")
def str6(spark, sf_dir):
    sink = stream.ProgressSink(spark, shared_folder(spark, "progress"), every=2)
    _in_parts(spark, I.transitions(spark, sf_dir), TRANSITION_SCHEMA, sink.start, "seq.position")
    sink.recover()
    return sink.counts()


# --------------------------------------------------------------- the whole run

@query("harvest_result", f"WITH {O.HARVEST}, {O.MERGE} SELECT {O.MERGED_COLUMNS} FROM merged")
def harvest_result(spark, sf_dir):
    return harvest(I.list_pages(spark, sf_dir), I.site_pages(spark, sf_dir)).result


_HARVEST_STATES = f"""{O.HARVEST},
  states AS (
    SELECT s.site AS source, CASE WHEN r.year <> '' AND CAST(r.year AS INTEGER) NOT BETWEEN 1995 AND 1998
      THEN -5 WHEN r.seq IS NOT NULL THEN 20 ELSE -15 END AS state
    FROM shown s LEFT JOIN records r ON r.seq = s.page_id WHERE s.page_id % 13 <> 0)"""


@query("harvest_progress", f"WITH {_HARVEST_STATES} {O.PROGRESS.format(table='states')}")
def harvest_progress(spark, sf_dir):
    run = harvest(I.list_pages(spark, sf_dir), I.site_pages(spark, sf_dir),
                  first_year=1995, last_year=1998)
    return frontier.progress(run.frontier)


@query("harvest_continued", f"""WITH {_HARVEST_STATES}
  SELECT source, CAST(state AS INTEGER) AS state, count(*) AS n FROM states GROUP BY ALL""")
def harvest_continued(spark, sf_dir):
    """A harvest that is broken off with links waiting and leased, kept in the log, recovered and ended."""
    lists = materialise(I.list_pages(spark, sf_dir), "lists")
    pages = materialise(I.site_pages(spark, sf_dir), "pages")
    log = TransitionLog(spark, shared_folder(spark, "frontier"))
    half = lists.agg(F.floor(F.max("page_id") / 6) * 3).first()[0] or 0
    # thirty articles stand on every three list pages; a third of those listed is not fetched yet
    listed, fetched = F.col("page_id") < half, F.col("page_id") < half * 10 * 2 / 3
    one = harvest(lists.where(listed), pages.where(fetched), first_year=1995, last_year=1998)
    log.append(one.frontier)
    log.append(frontier.lease(frontier.current_state(log.read()), frontier.following(log.read())))
    states = frontier.current_state(log.read())
    log.append(frontier.recover(states, frontier.following(states)))
    two = harvest(lists.where(~listed), pages.where(~fetched), first_year=1995, last_year=1998,
                  known=materialise(one.result, "one"), known_links=frontier.current_state(log.read()))
    return two.frontier.groupBy("source", "state").agg(F.count(F.lit(1)).alias("n"))
