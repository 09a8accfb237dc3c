"""The relational merge equals the record-by-record rule."""

import random

import pytest

from paperweave.operators import merge
from paperweave.schema import RECORD_FIELDS, RECORD_SCHEMA


def one_by_one(records):
    rows = []
    for r in sorted(records, key=lambda r: r["seq"]):
        found = [x for x in rows if x["title"] == r["title"] and r["publication"] in x["publication"]]
        if not found:
            rows.append(dict(r, id=r["seq"]))
        for x in found:
            x["url"] += ";" + r["url"]
            x["source"] += ";" + r["source"]
            for name in RECORD_FIELDS:
                x[name] = x[name] or r[name]
    return sorted((x["id"], *(x[f] for f in RECORD_FIELDS), x["source"]) for x in rows)


def some_records(n, seed, letters="ab", titles=("", "T", "T", "U")):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        row = dict.fromkeys(RECORD_FIELDS, "")
        row.update(
            seq=3 * i + 1, title=rnd.choice(titles), url=f"u{i}",
            publication="".join(rnd.choice(letters) for _ in range(rnd.randrange(5))),
            source=rnd.choice(["cnki", "cqvip", "wanfang"]), year=rnd.choice(["", "1", "2"]),
            abstract=rnd.choice(["", "x", "y"]))
        rows.append(row)
    return rows


def frame(spark, records):
    return spark.createDataFrame(
        [tuple(r[name] for name in RECORD_SCHEMA.names) for r in records], RECORD_SCHEMA)


def collected(result):
    return sorted((r["id"], *(r[f] for f in RECORD_FIELDS), r["source"]) for r in result.collect())


@pytest.mark.parametrize("n,seed", [(1, 0), (40, 1), (200, 2)])
def test_batch(spark, n, seed):
    records = some_records(n, seed)
    assert collected(merge.merge_records(frame(spark, records))) == one_by_one(records)


def test_golden(spark):
    records = some_records(4, 0)
    for r, publication in zip(records, ["", "X", "", "XY"]):
        r.update(title="T", publication=publication)
    rows = collected(merge.merge_records(frame(spark, records)))
    assert [(r[5], r[1]) for r in rows] == [("", "u0;u2"), ("X", "u1;u2"), ("XY", "u3")]


def test_title_with_most_rows(spark):
    records = some_records(300, 3, titles=("T", "T", "T", "U"))
    assert collected(merge.merge_records(frame(spark, records))) == one_by_one(records)


def test_papers_have_no_lists(spark):
    records = some_records(200, 4)
    keyed = merge.with_keys(frame(spark, records))
    got = merge.papers(merge.memberships(keyed, merge.plan_merge(merge.build_groups(keyed))))
    wanted = {r[0]: (r[-1].count(";") + 1, r[2 if RECORD_FIELDS[0] == "url" else 1]) for r in one_by_one(records)}
    assert {r["id"]: r["n_links"] for r in got.collect()} == {i: n for i, (n, _) in wanted.items()}
    assert not {"url", "source"} & set(got.columns)


def test_listed_substrings_stay_few(spark):
    rnd = random.Random(0)
    long = "".join(rnd.choice("abcdefghijklmnop") for _ in range(300))
    for names in ([long[:i] for i in range(1, 301)], ["a" * i for i in range(1, 301)]):
        records = some_records(len(names), 1)
        for r, name in zip(records, names):
            r.update(title="T", publication=name)
        groups = merge.build_groups(merge.with_keys(frame(spark, records)))
        assert merge.substrings(groups.keyed()).count() <= 50 * sum(map(len, names))


@pytest.mark.parametrize("cut", [0, 1, 70, 149])
def test_incremental(spark, cut):
    records = some_records(150, 5)
    first = merge.merge_records(frame(spark, records[:cut]))
    both = merge.merge_into(first, frame(spark, records[cut:]))
    assert collected(both) == one_by_one(records)


def test_incremental_in_three_steps(spark):
    records = some_records(150, 6)
    result = merge.merge_records(frame(spark, records[:50]))
    result = merge.merge_into(result, frame(spark, records[50:100]))
    result = merge.merge_into(result, frame(spark, records[100:]))
    assert collected(result) == one_by_one(records)


def test_earlier_numbers_are_refused(spark):
    records = some_records(20, 6)
    result = merge.merge_records(frame(spark, records[10:]))
    with pytest.raises(ValueError):
        merge.merge_into(result, frame(spark, records[:10]))


def test_number_of_tasks_changes_nothing(spark):
    df = frame(spark, some_records(120, 7))
    assert collected(merge.merge_records(df.repartition(1))) == collected(
        merge.merge_records(df.repartition(13)))


def test_match_counts(spark):
    records = some_records(160, 8)
    old, new = records[:80], records[80:]
    rows = one_by_one(old)
    wanted = {r["seq"]: sum(x[2] == r["title"] and r["publication"] in x[5] for x in rows) for r in new}
    got = merge.count_matches(merge.merge_records(frame(spark, old)), frame(spark, new))
    assert {r["seq"]: r["n_matches"] for r in got.collect()} == wanted


def test_collation(spark):
    records = some_records(3, 9)
    for r, (title, publication) in zip(records, [("Ab", "XY"), ("aB", "x"), ("AB ", "y")]):
        r.update(title=title, publication=publication)
    df = frame(spark, records)
    assert merge.merge_records(df).count() == 3
    assert merge.merge_records(df, "UTF8_LCASE").count() == 2
    assert merge.merge_records(df, "UTF8_LCASE_RTRIM").count() == 1
