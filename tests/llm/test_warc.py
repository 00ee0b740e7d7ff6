import gzip
import hashlib
import io
import os

import pytest
from actionflow.llm import warc
from actionflow.llm.scratch import new_path
from pyspark.sql import functions as F

ROWS = [
    (1, "http://a/1", "x" * 999), (2, "http://a/2", "x" * 999), (3, "http://a/3", "y" * 1000), (9, "http://a/9", "y" * 1000), (4, "http://a/\r\n4%0D", "y" * 1000), (5, None, None), (6, "u", ""),
    (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 90_000), (None, "u", "z" * 2000), (8, "u", "z" * 2000), (None, "u", "q" * 1500), (None, "u", "q" * 1500), (10, "u", "r" * 1200), (10, "u", "r" * 1200),
]


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b]
        top = max((j for j in same if j is not None), default=None)
        revisit = len(b) >= 1000 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return out


key = lambda r: tuple(-1 if v is None else v for v in r)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS body").repartition(3)
    got = [tuple(r)[:5] for r in warc.round_trip(df).collect()]
    assert sorted(got, key=key) == sorted(brute(ROWS), key=key)


def test_chunks_carry_running_digests_and_whole_payloads(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    manifest = warc.write(df, new_path(spark, "warc"), archive_bytes=3000)
    assert manifest.count() > 1
    chunks = warc.read(manifest, chunk_bytes=1000)
    rows = chunks.where("record_id = 7").orderBy("chunk_no").collect()
    body, sha = ROWS[7][2].encode(), hashlib.sha1()
    for k, r in enumerate(rows):
        sha.update(body[k * 1000 : (k + 1) * 1000])
        assert (r.chunk_no, r.chunk_start, bytes(r.chunk), r.digest_so_far) == (k, k * 1000, body[k * 1000 : (k + 1) * 1000], sha.hexdigest())
    assert [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True] and rows[-1].payload_bytes == len(body)
    whole = warc.assemble(chunks).where("record_type = 'response'").collect()
    assert sorted((r.record_id or -1, bytes(r.payload).decode()) for r in whole) == sorted((r[0] or -1, r[2] or "") for r, b in zip(ROWS, brute(ROWS), strict=True) if b[3] == "response")
    assert chunks.where("record_id = 4").first().target_uri == "http://a/\r\n4%0D"
    for r in manifest.collect():
        text = gzip.decompress(open(r.archive.removeprefix("file://").removeprefix("file:"), "rb").read())
        assert text.count(b"WARC/1.1\r\nWARC-Type") == r.records + 1 and text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_leftovers_of_other_attempts_are_not_read(spark):
    folder = new_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame(ROWS[:2], "page_id bigint, url string, html string"), folder)
    first = manifest.first().archive
    path = first.removeprefix("file://").removeprefix("file:")
    with open(path.replace(".warc.gz", "-other.warc.gz"), "wb") as f:
        f.write(open(path, "rb").read())
    assert warc.read(manifest).count() == 2


def test_no_rows_and_a_broken_archive(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc"
    try:
        list(warc.records(io.BytesIO(gzip.compress(head))))
    except ValueError:
        return
    raise AssertionError("a cut archive was read")


def test_every_cut_of_an_archive_is_an_error(spark):
    """Two records, cut at every byte: what is left is never read as complete."""
    folder = new_path(spark, "warc")
    manifest = warc.write(spark.createDataFrame([(1, "u", "first payload"), (2, "u", "second")], "page_id bigint, url string, html string").coalesce(1), folder)
    entry = manifest.first()
    path = entry.archive.removeprefix("file://").removeprefix("file:")
    with open(path, "rb") as f:
        whole = f.read()
    assert len(list(warc.records(io.BytesIO(whole)))) == entry.records == 2
    alone = 0
    for n in range(len(whole)):
        try:
            alone += len(list(warc.records(io.BytesIO(whole[:n])))) != 2
        except (ValueError, KeyError):
            continue
    assert alone == 3  # an empty file and the ends of the first records look whole; the manifest knows better
    first = next(n for n in range(1, len(whole)) if whole[n : n + 3] == b"\x1f\x8b\x08")
    for n in (0, 20, first, first + 40, len(whole) - 1):
        with open(path, "wb") as f:
            f.write(whole[:n])
        with pytest.raises(Exception, match="archive|record|manifest"):
            warc.read(manifest).collect()
    os.remove(path)
    with pytest.raises(Exception, match="(?i)no such file|not.?found"):
        warc.read(manifest).collect()


def test_sf(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = warc.round_trip(pages).select("page_id", "payload_digest")
    assert got.exceptAll(pages.select("page_id", F.sha1("html"))).count() == 0 and got.count() == pages.count()
