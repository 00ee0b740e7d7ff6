import random

import numpy as np
import pytest
from actionflow.llm.hamming_search import Index, sign_code, top_k
from pyspark.sql import functions as F


def brute(rows, queries, k):
    known = {(i, c) for i, c in rows if i is not None and c is not None}
    out = []
    for q, code in {(i, c) for i, c in queries if i is not None and c is not None}:
        near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**12 + i for i, c in known if i != q)[:k]
        out += [(q, n + 1, x % 10**12, x // 10**12) for n, x in enumerate(near)]
    return sorted(out)


def codes(seed, n):
    r = random.Random(seed)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    base = [r.getrandbits(64) for _ in range(20)]
    rows = [(i, signed(r.getrandbits(64) if r.random() < 0.5 else r.choice(base) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))) for i in range(n)]
    rows += [(n + i, signed(base[0])) for i in range(n // 3)]  # one code has many rows
    return rows


def test_index_is_exact():
    for n in (1, 2, 30, 700):
        rows = codes(n, n)
        index = Index(np.array([c for _, c in rows], np.int64).view(np.uint64), np.array([i for i, _ in rows]))
        for q, c in rows[:: max(1, n // 15)]:
            for k in (1, 7):
                d, ids = index.search(np.int64(c).view(np.uint64), q, k)
                assert [(q, r + 1, int(i), int(x)) for r, (i, x) in enumerate(zip(ids, d, strict=True))] == brute(rows, [(q, c)], k)
        assert not index.met.any()


def test_frames(spark):
    rows = codes(3, 900) + [(None, 5), (7000, None), (5, codes(3, 900)[5][1]), (8000, 0), (8000, -1)]
    df = spark.createDataFrame(rows, "id bigint, code bigint").selectExpr("*", "1 AS block", "2 AS distance", "'x' AS Code2")
    asked = df.where("id % 50 = 0 OR id IS NULL")
    want = brute(rows, [r for r in rows if r[0] is None or r[0] % 50 == 0], 10)
    for size in ({}, {"index_rows": 100}, {"index_rows": 7}, {"least_rows": 50}):
        # two codes under one id are two queries
        assert sorted(map(tuple, top_k(df, asked, 10, **size).collect())) == want
    assert top_k(df.limit(0), asked).collect() == [] and top_k(df, asked.limit(0)).collect() == []
    assert sorted(map(tuple, top_k(df.limit(3), df.limit(1), 10).collect())) == brute(rows[:3], rows[:1], 10)


def test_sign_code(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(64)]) for i in range(20)] + [(20, None), (21, [1.0] * 63), (22, [None] + [1.0] * 63), (23, [0.0] * 64)]
    for x in spark.createDataFrame(rows, "i int, e array<float>").select("i", "e", sign_code(F.col("e")).alias("c")).collect():
        if x.i in (20, 21, 22):
            assert x.c is None
        else:
            assert x.c & (2**64 - 1) == sum(1 << b for b in range(64) if x.e[b] >= 0)


def test_wide_vectors_are_an_error(spark):
    """They would be searched on their first components only."""
    df = spark.createDataFrame([(0, [1.0] * 65)], "i int, e array<float>")
    with pytest.raises(Exception, match="components: 65"):
        df.select(sign_code(F.col("e"))).collect()
