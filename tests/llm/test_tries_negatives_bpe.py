"""Prefix trie, hard negatives and byte-pair encoding against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from paperweave.llm import bpe, negatives, prefix_trie
from paperweave.llm.queries import tokenizer_file
from tests.llm.helpers import SF, documents, odd_documents

TURNS = "conv_id long, turn long, role string, text string, path string, depth long, id long"


# ---------------------------------------------------------------- prefix trie

def plain_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    for conv in own:
        own[conv].sort(key=lambda x: x[:2])
    made = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        first = own.get(conv - conv % 5, [])
        made[conv] = tuple(x[2] for x in first[:h] + own[conv][h:])
    members = defaultdict(list)
    for conv, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    saving = {p: (len(c) - 1) * len(p[-1][1].encode()) if p else 0 for p, c in members.items()}
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, convs in members.items():
        below, leaves, saved = [path], 0, 0
        while below:
            at = below.pop()
            saved, leaves = saved + saving[at], leaves + (not children[at])
            below += children[at]
        ends = ",".join(map(str, sorted(c for c in convs if len(made[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
                    len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_turns(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(4 * n), n):
        for turn in range(rng.choice([0, 1, 2, 5, 12])):
            rows.append((conv, turn if rng.random() > 0.1 else None, rng.choice(["user", None, ""]),
                         rng.choice(["a", "é b", None, ""]), "x", 3, 4))
    return rows


def tried(spark, rows, **how):
    return sorted((tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(rows, TURNS), **how).collect()), key=str)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"capacity": 10, "members": 1})])
def test_trie_equals_plain_version(spark, seed, how):
    rows = random_turns(seed)
    copies = [(1000 + 5 * i, t, "user", f"same {t}", "", 0, 0) for i in range(40) for t in range(9)]
    odd = [(None, 1, "user", "x", "", 0, 0), (2, 1, "user", "tie", "", 0, 0), (2, 1, "user", "tie", "", 0, 0),
           (2, 1, "user", "another", "", 0, 0), (2, None, None, None, "", 0, 0)]
    assert tried(spark, rows + copies + odd, **how) == plain_trie(rows + copies + odd)


def test_deep_copies_burst_in_few_rounds(spark):
    rows = [(5 * i, t, "user", f"{t}", "", 0, 0) for i in range(8) for t in range(40)]
    assert tried(spark, rows, capacity=20, members=2) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert tried(spark, []) == []
    # the first conversation is absent and h takes all own turns: only the root
    conv = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert tried(spark, [(conv, 0, "user", "x", "", 0, 0)]) == [
        (conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_ends_of_a_head_are_hashed_by_ranges():
    import pyarrow as pa

    convs = list(range(10))
    batch = pa.RecordBatch.from_pydict({"head": pa.array([b"h"] * 10, pa.binary()), "conv_id": convs})
    texts = [r for b in prefix_trie._texts(iter([batch]), most=3) for r in b.to_pylist()]
    assert [r["ids"] for r in texts] == ["0,1,2", "3,4,5", "6,7,8", "9"]
    whole = pa.RecordBatch.from_pylist(texts, pa.schema([("head", pa.binary()), ("first", pa.int64()), ("ids", pa.string())]))
    (digest,) = [r for b in prefix_trie._digests(iter([whole])) for r in b.to_pylist()]
    assert digest["ends_sha256"] == hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


# -------------------------------------------------------------- hard negatives

def plain_negatives(rows):
    part = []
    for vec, label, v in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(256 * float(x))) for x in v]
            part.append((vec, (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, whole))
    last = 2**63 - 1
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (anchor, label, v) in enumerate(part):
        if anchor is None or anchor % 50:
            continue
        known = sorted((-score(v, w), last if o is None else o, other == label) for j, (o, other, w) in enumerate(part)
                       if j != i)
        for positive, id, _ in [x for x in known if x[2]][:5]:
            found = [x for x in known if not x[2] and -50 * positive <= -100 * x[0] <= -95 * positive][:3]
            out += [(anchor, None if id == last else id, k + 1, None if o == last else o, -positive, -s)
                    for k, (s, o, _) in enumerate(found)]
    return sorted(out, key=str)


def random_vectors(seed, n=400, dims=6, centres=5, noise=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    v = middle[rng.integers(0, centres, n)] + noise * rng.standard_normal((n, dims))
    return [(i * 5, int(rng.integers(0, 3)), [float(x) for x in row]) for i, row in enumerate(v.astype(np.float32))]


def mined(spark, rows, **how):
    df = spark.createDataFrame([(a, c, b, "x", 1) for a, b, c in rows],
                               "vec_id long, embedding array<float>, label int, place string, sheet long")
    return sorted((tuple(r) for r in negatives.mined(df, **how).collect()), key=str)


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"tree": 3, "sheet": 2, "stripe": 50})])
def test_negatives_equal_plain_version(spark, seed, how):
    rows = random_vectors(seed) + [(100, 1, [0.5] * 6)] * 30  # copies of one vector and id, anchors too
    found = mined(spark, rows, **how)
    assert found == plain_negatives(rows) and found


def test_negatives_of_odd_rows(spark):
    odd = [(0, 1, None), (50, None, [1.0]), (100, 1, [1.0, None]), (150, 1, [float("nan")]), (200, 1, [float("inf")]),
           (250, 1, []), (300, 1, [1.0, 2.0]), (301, 1, [1.0, 2.0, 3.0]), (302, 2, [0.75, 1.5]), (None, 2, [0.7, 1.5]),
           (None, 1, [1.0, 2.0]), (307, 1, [1.5])]
    found = mined(spark, odd)
    assert found == plain_negatives(odd) and found
    assert mined(spark, []) == []


def test_negatives_of_large_numbers(spark):
    rows = [(0, 1, [3e38, 1.0]), (1, 1, [1e5, 2.0]), (2, 2, [7e4, 3.0]), (3, 2, [6e4, 1e30]), (50, 1, [4e9, 1e9]),
            (51, 2, [3e9, 1e9])]
    cut = lambda x: max(-2**63 + 1, min(x, 2**63 - 1))
    assert mined(spark, rows) == sorted(((*r[:4], cut(r[4]), cut(r[5])) for r in plain_negatives(rows)), key=str)


def test_bounds_settle_rows_and_lose_none():
    rng = np.random.default_rng(5)
    v = np.floor(256 * (rng.standard_normal(8) + 0.02 * rng.standard_normal((60, 8))))
    order, parent, edge = negatives.spanning_tree(v)
    assert parent[0] == 0 and all(parent[i] < i for i in range(1, 60))
    v = v[order]
    assert np.allclose(edge, np.sqrt(((v - v[parent]) ** 2).sum(1)))
    rows = np.floor(256 * rng.standard_normal((3000, 8)))
    labels, ids = rng.integers(0, 2, 3000), np.arange(1000, 4000)
    sheet = negatives.Sheet(
        np.arange(60), np.arange(60), np.zeros(60, int), np.arange(60) == 0, parent, edge, v,
        [[(None,) * 5]] * 60, [[[]] for _ in range(60)], 5, True)
    for at in range(0, 3000, 1000):
        sheet.take(ids[at:at + 1000], ids[at:at + 1000], labels[at:at + 1000], rows[at:at + 1000])
    for a in range(60):
        mine = np.flatnonzero(labels == 0)
        score = rows[mine] @ v[a]
        assert [x[1] for x in sheet.best[a][0]] == ids[mine[np.lexsort((mine, -score))[:5]]].tolist()
    assert sheet.scored < 0.2 * 60 * (labels == 0).sum()


# ------------------------------------------------------------------- encoding

@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def wanted(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_joined_halves_are_the_encoding_of_the_whole(tokenizer):
    merger, rng = bpe.Merger(tokenizer_file()), random.Random(7)
    alphabets = ["ab", "a", "thein ", "abcdefghijklmnopqrstuvwxyz", "!?.", "日本語漢字仮名", "ünäöß", "0"]
    for i in range(400):
        letters = rng.choice(alphabets).replace(" ", "")
        text = "".join(rng.choice(letters) for _ in range(rng.choice([2, 9, 40, 300])))
        if i % 3 == 0:
            text = rng.choice(["internationalization", "aaaaab", "thethe", "ingin"]) * rng.choice([2, 17])
        for part in merger.parts(text):
            want = [t.id for t in tokenizer.model.tokenize(part)]
            assert merger.tree(part, True, rng.choice([1, 2, 5, 16])) == want


def test_windows_grow_until_both_sides_agree(tokenizer):
    """A window that starts too small is not taken: a join may change tokens far from it."""
    merger = bpe.Merger(tokenizer_file())
    text = "a" * 999
    half = merger.encode(text[:501], False), merger.encode(text[501:], True)
    assert merger.joined(*half, True) == merger.encode(text, True)


def test_texts_equal_the_tokenizer(spark, tokenizer):
    rng = random.Random(3)
    long = ["".join(rng.choice("abcdefgh") for _ in range(30_000)), "漢字仮名交じり文" * 900, "-=" * 9000,
            "x" * 9000 + " and " + "é" * 9000 + "\n<|endoftext|>" + "Y" * 20_000 + "<|startoftext|>,,;1a2b" * 600,
            "don't'll" * 3000 + "́" * 3]
    rows = [(100 + i, text, "en", "a", 1, True, 5) for i, text in enumerate(long)] + [(100, long[0], "en", "a", 1, True, 5)]
    docs = odd_documents(spark, rows)
    texts = defaultdict(list)
    for row in docs.collect():
        texts[row.doc_id].append(wanted(tokenizer, row.text))
    for leaf in (300, bpe.LEAF):
        found = defaultdict(list)
        for row in bpe.coded(docs.repartition(3), tokenizer_file(), leaf=leaf).collect():
            found[row.doc_id].append(tuple(row)[1:])
        assert found == texts


def test_encoding_of_tables(spark, tokenizer):
    docs = documents(spark)
    found = {r.doc_id: tuple(r)[1:] for r in bpe.coded(docs, tokenizer_file()).collect()}
    assert found == {r.doc_id: wanted(tokenizer, r.text) for r in docs.collect()}
    assert bpe.coded(docs.limit(0), tokenizer_file()).count() == 0


def test_trie_of_tables(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in prefix_trie.nodes(turns).collect()), key=str) == plain_trie(rows)
