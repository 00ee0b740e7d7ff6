import random
import zlib

import numpy as np
import pytest
from actionflow.llm.sentencepiece_codec import decode_one, decoded, default_model, encode_batch, encoded, model, occurrences, round_trip, suffix_array
from pyspark.sql import functions as F

CASES = [
    "", " ", "a", "Hello  world \n\t x é漢😀", "  a  ", "ﬁ Ａ①", "a" * 300, "aaaa bbbb" * 50, "<s> </s> <unk> <0x41>", "\x01a\x00b", "the cat sat", "x▁y", "é",
    *[" " * k for k in range(1, 70)], *["x" + " " * k + "y" for k in range(1, 40)], "word " * 5000, "".join(chr(33 + i % 90) for i in range(20_000)),
]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=default_model())


def test_ids_are_the_library_s(library):
    m = model(default_model())
    r = random.Random(4)
    alphabet = "aàbcde  ftheringon.,\nßé1漢"
    texts = CASES + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    for t, ids in zip(texts, encode_batch(m, texts), strict=True):
        assert ids.tolist() == library.encode(t), repr(t[:60])
        assert decode_one(m, ids.tolist()) == library.decode(ids.tolist())
    for _ in range(200):
        ids = [r.randrange(len(m.text)) if r.random() < 0.3 else r.randrange(3, 259) for _ in range(r.randint(1, 12))]
        if 0 not in ids:
            assert decode_one(m, ids) == library.decode(ids)


def test_suffix_array_and_occurrences():
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(300))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = suffix_array(codes, 8)
    assert [text[i : i + 8] for i in order] == sorted(text[i : i + 8] for i in range(300))
    pieces = ["a", "ab", "bba", "abab", "bbbbbbbb"]
    table = np.zeros((5, 8), np.int64)
    for i, p in enumerate(pieces):
        table[i, : len(p)] = [ord(c) for c in p]
    start, which = occurrences(codes, order, table, np.array([len(p) for p in pieces]))
    assert sorted(zip(start.tolist(), which.tolist(), strict=True)) == sorted((i, k) for k, p in enumerate(pieces) for i in range(300) if text.startswith(p, i))


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(900, None, "x"), (2, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, n_ids string")
    got = {r.doc_id: r for r in round_trip(df).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "")
        assert (got[i].n_ids, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert got[i].round_trip == (library.decode(ids) == (t or ""))
    back = df.select("text", decoded(encoded(F.col("text"))).alias("back")).collect()
    assert all(r.back == (r.text or "").replace("▁", " ") for r in back)
    assert round_trip(df.limit(0)).collect() == []


def test_documents_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in docs.select("doc_id", encoded(F.col("text")).alias("ids")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode(r.text)
