"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm import (
    bpe, contamination, language, main_text, minhash, mixing, negatives, packing, prefix_trie, quality, substrings,
    urls, warc,
)
from paperweave.llm.shared import stored, table
from paperweave.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


TOKENIZER = "word_bpe_49k.json"


def tokenizer_file(name: str = TOKENIZER) -> str:
    """The vocabulary file among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


_CONTAMINATION_SQL = r"""WITH
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
  win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
      FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM win),
  place AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  met AS (SELECT r, place.n, i, item FROM place JOIN win ON place.k = win.k AND place.n = win.n),
  hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM
      (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM met)) GROUP BY 1),
  items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
      FROM met GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

_MINHASH_SQL = r"""WITH RECURSIVE
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, chr(10) ORDER BY k)) AS whole FROM s GROUP BY 1),
  c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id
      GROUP BY 1, 2),
  link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * met >= 75 * (x.n + y.n - met)),
  e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  r(v, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a AND r.c < e.b),
  m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept,
    coalesce(class_id, d.doc_id) AS class_id
  FROM d JOIN m ON m.v = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

_SUBSTRINGS_SQL = r"""WITH
  d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
  win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
      FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
  first AS (SELECT k, min(doc_id) AS doc FROM win GROUP BY k),
  gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(i, i + 13)) AS p
      FROM win JOIN first ON first.k = win.k AND doc < doc_id) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END,
      ' ')) AS kept_sha256
  FROM d LEFT JOIN gone USING (r)"""

_QUALITY_SQL = r"""WITH
  t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  runs AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k
      FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
  again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM
      (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM runs) WHERE c > 1) GROUP BY 1),
  lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM
      (SELECT r, unnest(string_split(text, chr(10))) AS x FROM t)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
  m AS (SELECT t.r, doc_id, lang, source, len(w) AS n_words,
      length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
      length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals,
      coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
      FROM t LEFT JOIN lines USING (r) LEFT JOIN again USING (r)),
  v AS (SELECT r, lang, source, unnest([
        {'m': 'symbols', 'v': 1000 * n_symbols // greatest(word_chars, 1), 's': 10, 'low': false},
        {'m': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 's': 120, 'low': false},
        {'m': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 's': 65, 'low': false},
        {'m': 'capitals', 'v': 1000 * n_capitals // greatest(word_chars, 1), 's': 60, 'low': false},
        {'m': 'word_length', 'v': 100 * word_chars // greatest(n_words, 1), 's': 80, 'low': true}]) AS x FROM m),
  bins AS (SELECT r, lang, source, x.m, x.v, x.s, x.low,
      x.v - x.v % CAST(pow(10, greatest(length(CAST(x.v AS VARCHAR)) - 2, 0)) AS BIGINT) AS b FROM v),
  q1 AS (SELECT lang, source, m, count(*) AS n, quantile_disc(b, 0.25) AS q25, quantile_disc(b, 0.75) AS q75
      FROM bins GROUP BY ALL),
  q2 AS (SELECT lang, m, count(*) AS n, quantile_disc(b, 0.25) AS q25, quantile_disc(b, 0.75) AS q75
      FROM bins GROUP BY ALL),
  q3 AS (SELECT m, count(*) AS n, quantile_disc(b, 0.25) AS q25, quantile_disc(b, 0.75) AS q75
      FROM bins GROUP BY ALL),
  q AS (SELECT q1.lang, q1.source, q1.m,
      CASE WHEN q1.n >= 50 THEN q1.q25 WHEN q2.n >= 50 THEN q2.q25 ELSE q3.q25 END AS q25,
      CASE WHEN q1.n >= 50 THEN q1.q75 WHEN q2.n >= 50 THEN q2.q75 ELSE q3.q75 END AS q75
      FROM q1 JOIN q2 ON q1.m = q2.m AND q1.lang IS NOT DISTINCT FROM q2.lang JOIN q3 ON q1.m = q3.m),
  bad AS (SELECT r, bool_or(v > q75 + 4 * greatest(q75 - q25, s)
        OR (low AND v < q25 - 4 * greatest(q75 - q25, s))) AS bad
      FROM bins JOIN q ON bins.m = q.m AND bins.lang IS NOT DISTINCT FROM q.lang
        AND bins.source IS NOT DISTINCT FROM q.source GROUP BY 1)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT bad AS kept
  FROM m JOIN bad USING (r)"""


_WARC_SQL = """WITH
  p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
  d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
  e AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last
      FROM d)
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN last <> page_id THEN last END AS refers_to FROM e"""


_PREFIX_TRIE_SQL = r"""WITH
  t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS size,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k
      FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS k, list(size ORDER BY turn NULLS FIRST, k) AS s,
      xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
        lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
          lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295), 4294967295) % 9 AS h
      FROM t GROUP BY conv_id),
  r AS (SELECT c.conv_id, list_concat(coalesce(b.k[1:c.h], []), c.k[c.h + 1:]) AS k,
      list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s
      FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
  p AS (SELECT conv_id, len(k) AS n, d, array_to_string(k[1:d], ' ') AS node, array_to_string(k[1:d - 1], ' ') AS up,
      CASE WHEN d > 0 THEN s[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM r)),
  n AS (SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
      string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM p GROUP BY node, d),
  kids AS (SELECT up AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
  f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
  sub AS (SELECT array_to_string(string_split(node, ' ')[1:i], ' ') AS node,
      count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1)
  SELECT f.conv_id, f.d AS depth, above.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
  FROM f JOIN sub USING (node) LEFT JOIN f above ON f.d > 0 AND above.node = f.up"""

_NEGATIVES_SQL = """WITH
  v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
      CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score,
      row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
        AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
  FROM n WHERE rank <= 3"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op1_minhash", _MINHASH_SQL)
def op1(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id",
                        (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")


@query("op2_quality", _QUALITY_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept")


@query("op3_substrings", _SUBSTRINGS_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_packing")
def op4(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file()).drop("ids", "queue")


@query("op5_main_text")
def op5(spark, sf_dir):
    return main_text.extracted(table(spark, sf_dir, "pages"))


@query("op6_mixing")
def op6(spark, sf_dir):
    return mixing.scored(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "share",
                        "languages")


@query("op8_contamination", _CONTAMINATION_SQL)
def op8(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination.judged(docs.select("doc_id", "text"), items.select("item_id", "text")).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op9_warc", _WARC_SQL)
def op9(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    # The archives are read once; their records without payloads are a small table.
    captures = warc.assembled(stored(warc.read_archives(spark, folder, payload=False), "records"))
    page = lambda fields: F.col(fields)["page-id"].cast("long")
    return captures.select(page("metadata").alias("page_id"), "response.payload_bytes", "response.payload_digest",
                           F.col("response.type").alias("record_type"), page("response.refers").alias("refers_to"))


@query("op10_urls")
def op10(spark, sf_dir):
    model, shares = urls.fit(urls.labelled(spark))
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), model, shares)


@query("op11_prefix_trie", _PREFIX_TRIE_SQL)
def op11(spark, sf_dir):
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark, sf_dir):
    return negatives.mined(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op13_bpe")
def op13(spark, sf_dir):
    return bpe.coded(table(spark, sf_dir, "documents"), tokenizer_file())
