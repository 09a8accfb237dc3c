"""Expected results of the registered queries as plain SQL over the tables.

For built pages the expectation is written down from the numbers the page was
made of, not by reading the page again.
"""

from __future__ import annotations


def _clean(c: str) -> str:
    return (f"translate({c}, '\"%''' || chr(10) || chr(9) || chr(13) || chr(160), '#>^')")


RECORDS = f"""
raw_records AS (
  SELECT doc_id AS seq, split_part(text, chr(10), 1) AS title, source AS publication,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(1990 + doc_id % 30 AS VARCHAR) END AS year,
    'http://www.' || CASE doc_id % 3 WHEN 0 THEN 'cnki' WHEN 1 THEN 'cqvip' ELSE 'wanfang' END
      || '.example/' || doc_id AS raw_url
  FROM documents),
records AS (
  SELECT seq, {_clean('title')} AS title, translate({_clean('publication')}, '《》', '') AS publication,
    {_clean('abstract')} AS abstract, year, {_clean('raw_url')} AS url, raw_url,
    CASE seq % 3 WHEN 0 THEN 'cnki' WHEN 1 THEN 'cqvip' ELSE 'wanfang' END AS source,
    '' AS authors, '' AS unit, '' AS keywords, '' AS volume, '' AS issue, '' AS pagecode,
    '' AS doi, '' AS sponser, '' AS type
  FROM raw_records)"""

_FIELDS = ["title", "authors", "unit", "publication", "keywords", "abstract", "year", "volume",
           "issue", "pagecode", "doi", "sponser", "type"]
FIELD_LIST = ", ".join(_FIELDS)

MERGE = """
grp AS (SELECT title, publication AS pub, min(seq) AS s0 FROM records GROUP BY 1, 2),
creators AS (
  SELECT * FROM grp d WHERE NOT EXISTS (
    SELECT 1 FROM grp b WHERE b.title = d.title AND b.s0 < d.s0 AND contains(b.pub, d.pub))),
members AS (
  SELECT c.s0 AS id, c.title AS ctitle, c.pub AS cpub, r.* FROM creators c
  JOIN records r ON r.title = c.title AND contains(c.pub, r.publication) AND r.seq >= c.s0),
merged AS (
  SELECT id, string_agg(url, ';' ORDER BY seq) AS url,
    string_agg(source, ';' ORDER BY seq) AS source, """ + ", ".join(
    f"coalesce(arg_min({f}, seq) FILTER (WHERE {f} <> ''), '') AS {f}" for f in _FIELDS) + """
  FROM members GROUP BY id)"""

MERGED_COLUMNS = "id, url, source, " + FIELD_LIST

SITE_OF_USER = "CASE user_id % 3 WHEN 0 THEN 'Cnki' WHEN 1 THEN 'Cqvip' ELSE 'Wanfang' END"
TRANSITIONS = f"""
transitions AS (
  SELECT CAST(user_id AS VARCHAR) AS url, {SITE_OF_USER} AS source,
    CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 10 WHEN 'purchase' THEN 20
      WHEN 'error' THEN -15 ELSE -10 END AS INTEGER) AS state, CAST(0 AS BIGINT) AS run, event_id AS seq
  FROM events),
frontier AS (
  SELECT url, arg_max(source, seq) AS source, arg_max(state, seq) AS state,
    CAST(0 AS BIGINT) AS run, max(seq) AS seq FROM transitions GROUP BY url)"""

PROGRESS = """
  SELECT source, count(*) AS n_all,
    count(*) FILTER (WHERE state IN (20, -5, -15)) AS n_done,
    count(*) FILTER (WHERE state = -5) AS n_wrong_date,
    count(*) FILTER (WHERE state = -15) AS n_invalid,
    round(count(*) FILTER (WHERE state IN (20, -5, -15)) / count(*) * 100, 2) AS pct
  FROM {table} GROUP BY source"""

HITS = """
hits AS (
  SELECT o_custkey, count(*) * 37 AS total,
    CASE o_custkey % 3 WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 50 END AS size
  FROM orders GROUP BY o_custkey),
paged AS (
  SELECT o_custkey, total,
    CASE WHEN size = 50 THEN least(CAST(ceil(total / size) AS BIGINT), 100)
      ELSE CAST(ceil(total / size) AS BIGINT) END AS n_pages FROM hits)"""

ARTICLES = """
articles AS (
  SELECT o_orderkey AS k, o_custkey AS c, year(o_orderdate) AS y, o_orderkey % 12 + 1 AS m,
    'Study ' || o_custkey AS title,
    '学报' || (o_custkey % 10) || CASE WHEN o_orderkey % 4 = 0 THEN '增刊' ELSE '' END AS pub,
    o_orderkey % 97 IN (3, 4) AS lost
  FROM orders)"""

# what each layout shows of an article; ``ok`` without the pages that were lost
DETAIL_A = """
detail_a AS (
  SELECT k AS page_id, 'http://www.cnki.example/' || k || '.htm' AS url, title,
    'Li & ' || c || ', Wang' AS authors, 'Unit' || (c % 7) AS unit,
    '《' || pub || '》' AS publication, '' AS keywords,
    CASE WHEN k % 2 = 0 THEN 'text' || k || 'nestedend' ELSE 'plain<' || k || '>' END AS abstract,
    CASE WHEN k % 6 = 1 THEN '' ELSE CAST(y AS VARCHAR) END AS year, '' AS volume,
    CASE WHEN k % 6 = 1 THEN '' ELSE CAST(m AS VARCHAR) END AS issue, '' AS pagecode, '' AS doi,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'Fund' || (k % 9) END AS sponser, '' AS type,
    k % 11 NOT IN (5, 6) AND NOT lost AS ok, lost, k % 3 = 0 AS here
  FROM articles)"""
DETAIL_B = """
detail_b AS (
  SELECT k AS page_id, 'http://www.cqvip.com/QK/' || k || '%22.html' AS url, title,
    'Li ' || c || ';Wang' AS authors, 'Unit ' || (c % 7) AS unit,
    '《' || pub || '》' AS publication, 'kw' || (c % 5) || ';k2' AS keywords,
    'abs ' || k AS abstract,
    CASE WHEN k % 6 = 1 THEN '' ELSE CAST(y AS VARCHAR) END AS year, '' AS volume,
    CAST(m AS VARCHAR) AS issue, (k % 50) || '-' || (k % 50 + 3) AS pagecode, '' AS doi,
    '' AS sponser, '' AS type,
    k % 11 NOT IN (5, 6, 7) AND NOT lost AS ok, lost, k % 3 = 1 AS here
  FROM articles)"""
DETAIL_C = """
detail_c AS (
  SELECT k AS page_id,
    'http://g.wanfangdata.com.cn/details/detail.do?_type=perio&id=' || k AS url, title,
    CASE c % 7 WHEN 0 THEN 'Li ' || c || ';Wang' WHEN 1 THEN 'Li ' || c
      WHEN 2 THEN 'Li ' || c || ';Zhao' ELSE '' END AS authors,
    CASE WHEN c % 7 = 1 THEN 'School ' || (c % 8) ELSE 'Unit ' || (c % 7) || ';Dept' END AS unit,
    CASE c % 7 WHEN 0 THEN pub WHEN 1 THEN 'School ' || (c % 8) WHEN 2 THEN 'Conf ' || (c % 6)
      ELSE '' END AS publication,
    'kw' || (c % 5) || ';k2' AS keywords,
    CASE WHEN k % 9 = 0 THEN '' ELSE 'abs ' || k || 's in end' END AS abstract,
    CASE WHEN k % 5 = 0 THEN '2001' WHEN c % 7 IN (0, 1) THEN CAST(y AS VARCHAR) ELSE '' END AS year,
    CASE WHEN c % 7 = 0 THEN CAST(k % 30 AS VARCHAR) ELSE '' END AS volume,
    CASE WHEN c % 7 = 0 THEN CAST(m AS VARCHAR) ELSE '' END AS issue,
    (k % 8) || '-9' AS pagecode,
    CASE WHEN k % 4 = 0 THEN '10.2/' ELSE '10.1/' END || k AS doi,
    'Fund ' || (k % 9) AS sponser,
    CASE c % 7 WHEN 0 THEN 'J' WHEN 1 THEN 'D' WHEN 2 THEN 'C' WHEN 3 THEN 'S' WHEN 4 THEN 'R'
      WHEN 5 THEN 'P' ELSE 'Z' END AS type,
    k % 11 <> 5 AND NOT (c % 7 = 0 AND k % 11 = 6) AND NOT lost AS ok, lost, k % 3 = 2 AS here
  FROM articles)"""
DETAIL_COLUMNS = "page_id, url, " + FIELD_LIST

# records of the three sites that are listed, in the normalised form
HARVEST = f"""
{ARTICLES}, {DETAIL_A}, {DETAIL_B}, {DETAIL_C},
shown AS (
  SELECT *, 'Cnki' AS site, 'cnki' AS source FROM detail_a WHERE here
  UNION ALL SELECT *, 'Cqvip', 'cqvip' FROM detail_b WHERE here
  UNION ALL SELECT *, 'Wanfang', 'wanfang' FROM detail_c WHERE here),
records AS (
  SELECT page_id AS seq, url AS raw_url, {_clean('url')} AS url, source, site,
    {_clean('title')} AS title, {_clean('authors')} AS authors, {_clean('unit')} AS unit,
    translate(publication, '《》', '') AS publication, keywords, {_clean('abstract')} AS abstract,
    year, volume, issue, pagecode, doi, sponser, type
  FROM shown WHERE ok AND page_id % 13 <> 0)"""

LINK_N = """
link_rows AS (
  SELECT o_orderkey AS page_id, o_custkey AS c, unnest(range(1, o_custkey % 5 + 1)) AS i
  FROM orders)"""

VISIBLE = ("regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)"
           "|<style\\b.*?(?:</style\\s*>|\\z)', '', 'g')")
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"),
              ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")]


def plain(c: str) -> str:
    """Text of a fragment of the given pages."""
    text = f"regexp_replace({c}, '</?[a-zA-Z!?][^>]*>', '', 'g')"
    for found, wanted in REFERENCES:
        text = f"replace({text}, '{found}', '{wanted}')"
    return text


# criteria rows and the text of their searches
_WANTED = "regexp_replace({c}, '[^一-龥.^a-zA-Z0-9]', '', 'g') <> ''"
CRITERIA = """
criteria AS (
  SELECT p_partkey, p_name || ' 失谐/~*' AS title,
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS authors,
    CASE WHEN p_partkey % 4 = 0 THEN '--' ELSE p_type END AS keywords,
    CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE '单位' || p_size END AS unit,
    p_size % 3 + 1 AS n_pages
  FROM part)"""


def search_text(marks: dict[str, str], quoted: bool) -> str:
    parts = []
    for c, mark in marks.items():
        value = f"replace(url_encode({c}), '%2F', '/')" if quoted else c
        parts.append(f"CASE WHEN {_WANTED.format(c=c)} THEN '{mark}' || {value} ELSE '' END")
    return " || ".join(parts)
