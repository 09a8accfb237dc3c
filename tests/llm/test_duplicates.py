"""Near duplicates, repeated passages, contamination and quality against plain versions."""

import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperweave.llm import contamination, minhash, quality, substrings
from paperweave.llm.queries import ORACLE, QUERIES
from tests.llm import brute
from tests.llm.helpers import SF, by_id, documents, odd_documents


def near_copies(seed=3):
    """Groups of near copies with no common centre, a chain, and copies of a part."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 100
    for _ in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy), "en", "a", 0, True, 1))
            n += 1
    chain = [rng.choice(words) for _ in range(100)]
    for _ in range(6):
        rows.append((n, " ".join(chain), "en", "a", 0, True, 1))
        chain = chain[8:] + [rng.choice(words) for _ in range(8)]
        n += 1
    return rows


@pytest.fixture(scope="module")
def mixed(spark):
    return odd_documents(spark, near_copies()).cache()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_equal_all_pairs(spark, mixed):
    found = minhash.near_duplicates(mixed)
    assert found.count() == mixed.count()
    assert by_id(found.select("doc_id", "n_shingles", "component_id").collect()) == brute.near_duplicates(pairs(mixed))
    kept = minhash.deduplicated(mixed)
    assert kept.columns == mixed.columns
    wanted = {i for i, (_, c) in brute.near_duplicates(pairs(mixed)).items() if i == c}
    assert {r.doc_id for r in kept.collect()} == wanted


def test_prefix_join_closes_what_leaders_leave(spark, mixed, monkeypatch):
    monkeypatch.setattr(minhash, "LEADERS", (1,))
    found = minhash.near_duplicates(mixed)
    assert by_id(found.select("doc_id", "n_shingles", "component_id").collect()) == brute.near_duplicates(pairs(mixed))


def test_texts_of_one_id_are_united(spark):
    base = {name: [f"{name}{i}" for i in range(60)] for name in "ABCD"}
    near = lambda name, word: " ".join([*base[name], word])
    rows = [(1, near("A", "z")), (5, near("A", "y")), (5, near("B", "y")), (9, near("B", "z")), (9, near("C", "z")),
            (3, near("C", "y")), (12, None), (12, near("D", "y")), (14, near("D", "z")), (None, near("D", "z")),
            (20, "alone"), (20, "apart"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 5):
        found = minhash.near_duplicates(docs.repartition(parts)).collect()
        assert len(found) == len(rows)
        assert {r.doc_id: r.component_id for r in found} == {
            1: 1, 5: 1, 9: 1, 3: 1, 12: 12, 14: 12, 20: 20, None: None}
    kept = minhash.deduplicated(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 12, 12, 20, 20]


def test_passages_of_one_id_with_different_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"t{rng.randrange(40)}" for _ in range(n)) for n in (60, 45, 30, 20)]
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    rows = [(7, texts[0]), (7, texts[1]), (7, cut(0, 10, 40) + " x"), (9, cut(0, 5, 30) + " y " + cut(1, 3, 40)),
            (9, texts[2]), (9, "short"), (4, cut(2, 2, 20)), (4, texts[3]), (None, texts[0]), (7, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = lambda text: [tuple(text.split()[i:i + 13]) for i in range(len(text.split()) - 12)]
    first = {}
    for i, text in rows:
        for gram in grams(text) if i is not None else ():
            first[gram] = min(i, first.get(gram, i))
    wanted = []
    for i, text in rows:
        gone = {k + j for k, gram in enumerate(grams(text)) if i is not None and first[gram] < i for j in range(13)}
        left = [w for k, w in enumerate(text.split()) if k not in gone]
        wanted.append((str(i), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    found = substrings.without_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_sha256) for r in found) == sorted(wanted)


def test_near_duplicates_of_tables(spark):
    docs = documents(spark)
    found = by_id(minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert found == brute.near_duplicates(pairs(docs))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.where("doc_id = 3")).count() == 1


def test_repeated_passages(spark, mixed):
    rng = random.Random(1)
    text = [f"t{rng.randrange(50)}" for _ in range(40)]
    rows = [(500, " ".join(text * 2), "en", "a", 0, True, 1), (501, " ".join(text[5:30]), "en", "a", 0, True, 1),
            (502, " ".join(text[:20] + ["x"] + text[21:]), "en", "a", 0, True, 1), (503, "q " * 60, "en", "a", 0, True, 1),
            (504, "q " * 13, "en", "a", 0, True, 1), (505, "q " * 12, "en", "a", 0, True, 1)]
    docs = mixed.unionByName(spark.createDataFrame(rows, mixed.schema))
    found = substrings.without_repeats(docs)
    assert found.count() == docs.count() and set(docs.columns) <= set(found.columns)
    assert by_id(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute.substrings(pairs(docs))
    for r in found.where("size(spans) > 0").select("doc_id", "spans").collect():
        for s in r.spans:  # a span stands at its source's place too
            words = dict(pairs(docs))
            own = brute.WORD.findall(words[r.doc_id])[s["at"]:s["at"] + s["length"]]
            assert own == brute.WORD.findall(words[s["source"]])[s["source_at"]:s["source_at"] + s["length"]]
    assert substrings.without_repeats(docs.limit(0)).count() == 0


def test_repeated_passages_of_tables(spark):
    docs = documents(spark)
    found = substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert by_id(found) == brute.substrings(pairs(docs))


def test_contamination(spark, mixed):
    items = [(1, "one two"), (2, None), (3, "!!"), (4, " ".join(f"w{i}x{i}" for i in range(20))), (5, "12"),
             (5, "34 nothing"), (None, "one two"), (7, "Éa é"), (8, "éa É"), (9, "ONE-TWO")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.judged(mixed, bench).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256), "contaminated")
    wanted = brute.contamination(pairs(mixed), [(i, t) for i, t in items if i is not None])
    assert found.count() == mixed.count() and by_id(found.collect()) == wanted
    clean = contamination.decontaminated(mixed, bench)
    assert clean.columns == mixed.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in pairs(mixed) if not wanted[i][-1])
    assert contamination.judged(mixed, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_of_documents_without_an_id(spark, mixed):
    text = " ".join(f"w{i}x{i}" for i in range(20))
    rows = [(None, text, "en", "a", 1, True, 5), (None, "clean words only", "en", "a", 1, True, 5)]
    docs = mixed.where("doc_id < 4").unionByName(spark.createDataFrame(rows, mixed.schema))
    bench = spark.createDataFrame([(4, text), (5, text + " more")], "item_id long, text string")
    found = {r.n_words: r for r in contamination.judged(docs, bench).where("doc_id IS NULL").collect()}
    assert (found[20].n_hit, found[20].items, found[20].contaminated) == (20, ["4", "5"], True)
    assert (found[3].n_hit, found[3].n_items, found[3].contaminated) == (0, 0, False)
    clean = contamination.decontaminated(docs, bench).where("doc_id IS NULL").collect()
    assert [r.text for r in clean] == ["clean words only"]


def test_contamination_beyond_the_broadcast_bound(spark, mixed, monkeypatch):
    bench = spark.createDataFrame([(4, " ".join(f"w{i}x{i}" for i in range(40)))], "item_id long, text string")
    wanted = contamination.judged(mixed, bench).collect()
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert sorted(map(str, contamination.judged(mixed, bench).collect())) == sorted(map(str, wanted))


@pytest.mark.parametrize("name", ["op1_minhash", "op2_quality", "op3_substrings", "op8_contamination", "op9_warc"])
def test_queries_equal_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, wanted))


def test_quality_of_odd_rows(spark, mixed):
    rows = [(600, ("a b c d e f g h i j " * 3).strip(), "en", "a", 0, True, 1)] \
        + [(700 + i, " ".join(f"word{i}n{k}" for k in range(40)) + f"\nline {i}", "en", "a", 0, True, 1) for i in range(60)] \
        + [(800, " ".join(f"###{k}%%%" for k in range(40)), "en", "a", 0, True, 1)]
    docs = mixed.where("doc_id < 100").unionByName(spark.createDataFrame(rows, mixed.schema))
    found = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert quality.judged(docs).count() == docs.count()
    assert found[600].n_repeat_words == 30 and found[600].base_failed and not found[600].kept
    assert found[1].n_words == 0 and found[1].base_failed
    assert all(found[700 + i].kept for i in range(60))
    assert not found[800].kept and found[800].failed == ["symbols"] and not found[800].base_failed
    assert quality.judged(docs.limit(0)).count() == 0


def test_sketches_merge_by_addition(spark):
    docs = quality.measured(documents(spark))
    each = quality.thresholds(docs)
    halves = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1"))
    assert sorted(map(str, each.collect())) == sorted(map(str, quality.thresholds(halves).collect()))


def test_digest_of_nothing(spark):
    found = substrings.without_repeats(odd_documents(spark)).where("doc_id = 1").first()
    assert found.kept_sha256 == hashlib.sha256(b"").hexdigest() and found.text is None
