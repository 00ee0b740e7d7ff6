import random
import re

import pytest
from actionflow.llm import near_duplicates as nd
from actionflow.llm import scratch
from actionflow.llm.graph import components
from actionflow.llm.near_duplicates import keep_one, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text, size):
    table = {c: c + 32 for c in range(65, 91)}
    w = WORD.findall((text or "").translate(table))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(rows, size, percent=80):
    """{position: least id reachable}"""
    sets = [brute_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for ids in by.values():
        for i in ids:
            for j in ids:
                if i < j and find(i) != find(j):
                    inter = len(sets[i] & sets[j])
                    if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(60):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 8, 30, 120, 400]))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.02, 0.05, 0.2]))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = r.choice([" ", "\n", "  "]).join(w)
            rows.append((len(rows) * 7 % 997, t.upper() if r.random() < 0.2 else t))
    chain = [r.choice(vocabulary) for _ in range(100)]
    for i in range(0, 60, 2):
        rows.append((2000 + i, " ".join(chain[i : i + 40])))
    return rows + [(3000, None), (3001, ""), (3002, " \n"), (3003, "É é"), (3004, "é é"), (3005, "a\x0bb"), (3006, "A b")]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_match_brute_force(spark, size):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), words=size).collect()
    assert sorted(map(tuple, got)) == sorted((*x, x[0] == x[2]) for x in brute(rows, size))


def test_keep_one(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, 1), (3, a, 2), (4, a + " more", 3), (4, a + " more", 3), (None, a, 4), (7, b, 5), (7, b, 5), (None, "only null id here", 6), (None, "only null id here", 6), (9, None, 7), (9, None, 7), (10, "", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").selectExpr("*", "'x' AS th", "1 AS component")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted(r.n for r in out.collect()) == [2, 5, 6, 7, 7, 8]
    assert keep_one(df.limit(0)).collect() == []
    assert near_duplicates(df.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    """Also names that differ from ours in case only, or that the operator uses inside."""
    t = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, "x", 1), (2, t, "y", 2)], "doc_id int, text string, Text string, hash int")
    out = keep_one(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, t, "x", 1)]


def test_very_long_texts_and_many_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(30_000)}" for _ in range(150_000)]
    other = list(base)
    other[5] = "other"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:100_000]))] + [(10 + i, "the same words in every row of it") for i in range(3000)]
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3} | {10 + i: 10 for i in range(3000)}


def test_salted_join_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1, i) for i in range(95)] + [(2, 5), (3, 6)], "k bigint, x bigint")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k bigint, name string")
    hot = scratch.hot_keys(rows, "k", 97)
    assert [tuple(r) for r in hot.collect()] == [(1, 10)]
    assert sorted(map(tuple, scratch.salted_join(rows, facts, "k", "x", hot).select("k", "x", "name").collect())) == [(1, i, "a") for i in range(95)] + [(2, 5, "b")]


def test_mixed_buckets_in_tiles(spark, monkeypatch):
    """Sets that share buckets but few links: every pair is tested, however the bucket is cut."""
    monkeypatch.setattr(nd, "TILE", (3, 5))
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.choice([4, 8, 12])):
            w[r.randrange(300)] = f"x{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((*x, x[0] == x[2]) for x in brute(rows, 5))


def test_recall_against_all_pairs(spark):
    """On a table of the driver's: the groups are those of brute force, none is missed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    got = sorted((x.doc_id, x.component_id) for x in near_duplicates(docs, words=4).collect())
    assert got == sorted((d, c) for d, _, c in brute(rows, 4))


def test_components(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_ROWS", 20)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, 1049), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(201)} | {i: -5 for i in range(1000, 1050)} | {-5: -5}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
