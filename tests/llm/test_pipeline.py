import corpus_pipeline
import numpy as np
from actionflow.llm import scratch
from actionflow.llm.packing import cuts, default_tokenizer, encoder

from tests.llm.test_near_duplicates import brute as brute_groups
from tests.llm.test_quality import brute as brute_counts

BASE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BASE}/labels.parquet").collect()}
    (_, classify), (_, rules), (_, dedup), (_, pack) = corpus_pipeline.STAGES

    one = classify(spark, docs, BASE)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.97 * len(labels)

    two = rules(spark, one, BASE)
    passed = {i for i in kept if (lambda c: c[0] >= 10 and 100 * c[4] <= 20 * c[0])(brute_counts(text[i]))}
    assert {r.doc_id for r in two.collect()} == passed  # no host is rejected here

    three = dedup(spark, two, BASE)
    groups = brute_groups([(i, text[i]) for i in sorted(passed)], 5)
    single = {c if n else d for d, n, c in groups}
    assert {r.doc_id for r in three.collect()} == single and three.columns == docs.columns

    encode = encoder(default_tokenizer())
    want = sorted((i, k, s, n) for i in single for k, (s, n) in enumerate(cuts(len(encode(text[i])) + 1, 1024)))
    got = pack(spark, three, BASE).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    filled = np.zeros(1 + max(r.sequence_id for r in got), int)
    np.add.at(filled, [r.sequence_id for r in got], [r.length for r in got])
    assert filled.max() <= 1024 and filled.min() > 0

    start = scratch.mark()
    whole = corpus_pipeline.run(spark, BASE)
    assert scratch.mark() == start + 1  # only the result's table is left
    assert sorted(map(tuple, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got)


def test_nulls_ties_clashing_names_and_nothing(spark, tmp_path):
    """Every stage on odd rows, with the results its docstring gives."""
    good = [". ".join(f"the a{i}x{k} of b{k}y{i} and c{i + k} sat" for k in range(4 + i % 9)) + "." for i in range(60)]
    junk = [" ".join(f"{'xyzw'[(i + k) % 4]}{k * i}###" for k in range(20 + i % 30)) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(good)] + [(100 + i, t, "en", f"s{i % 3}") for i, t in enumerate(junk)]
    odd = [(200, None, "en", "s1"), (201, "", None, None), (202, " \n\t", "en", "s1"), (203, good[5], None, None), (None, good[7], "en", "s0"), (3, good[3], "en", "s0"), (3, good[3], "en", "s0"), (204, good[9] + " " + "the cat sat on a mat near it. " * 20_000, "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "T", 1, "x") for r in rows + odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, Text string, kept int, hash string")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (_, classify), (_, rules), (_, dedup), (_, pack) = corpus_pipeline.STAGES
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())

    one = classify(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and ids(one) == sorted([*range(60), 203, -1, 3, 3, 204])
    two = rules(spark, one, str(tmp_path))
    assert two.columns == docs.columns and ids(two) == sorted([*range(60), 203, -1, 3, 3])
    three = dedup(spark, two, str(tmp_path))
    left = ids(three)
    assert three.columns == docs.columns and len(left) == len(set(left)) and set(left) <= set(range(60)) and {3, 5, 7} <= set(left)
    placed = pack(spark, three, str(tmp_path)).collect()
    assert {r.doc_id for r in placed} == set(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
