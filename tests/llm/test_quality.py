import math
import re
from collections import Counter

import pytest
from actionflow.llm import quality_classifier as qc
from actionflow.llm import quality_rules as qr
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "x\ny\nx\n\n\nx \n x", "été été été été été été", "漢字 " * 12, "\n", "a\x0bb\x0cc\rd",
    "# $ % & | < > *" * 3, ("the cat sat on the mat " * 40).strip(), " ".join(f"w{i}" for i in range(3000)), "same words here now ok " + " ".join(f"v{i}" for i in range(50)) + " same words here now ok", "tail\n", "   a",
]


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in qr.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(ODD)], "doc_id int, text string, source string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.report(df).collect()}
    for i, t in enumerate(ODD):
        want = brute(t)
        assert got[i] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0]), t


def test_bad_host_goes_and_sparse_host_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, f"h{i % 10}", 1, "x") for i in range(300)] + [(1000 + i, "short", "bad", 1, "x") for i in range(60)]
    rows += [(2000, good, "bad", 1, "x"), (2000, good, "bad", 1, "x"), (3000, "short", "sparse", 1, "x"), (3001, good, "sparse", 1, "x"), (4000, good, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string, kept int, host string")
    out = qr.keep_good(df)
    assert out.columns == df.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == [*range(300), 3001, 4000]
    assert sorted(r.doc_id for r in qr.report(df).where("kept").collect()) == kept
    assert qr.keep_good(df.limit(0)).collect() == []


@pytest.mark.parametrize("rule, text", [
    ("symbols", " ".join(f"w{i} ## $$" for i in range(15))), ("lines", "\n".join(f"line {i % 4} of it" for i in range(24))), ("word_length", " ".join(f"{'abcdefghijklmnopqrstuvwxyz' * 2}{i}" for i in range(20))),
])
def test_each_rule_speaks_of_hosts(spark, rule, text):
    """Documents that pass the base rule go with their host if it fails another rule too often; elsewhere they stay."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, f"h{i % 10}") for i in range(300)] + [(1000 + i, text, "bad") for i in range(40)] + [(1100, good, "bad"), (1200, text, "h1"), (1300, text, "single")]
    got = {r.doc_id: r for r in qr.report(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    if rule == "lines":  # repeated lines of it fail the base rule as well
        assert got[1000].base_failed and not got[1100].base_failed and not got[1100].kept
    else:
        assert not got[1000].base_failed and not got[1000].kept and not got[1100].kept and got[1200].kept
    assert got[0].kept and got[1]["host_" + rule + "_rate"] < 0.25 < got[1000]["host_" + rule + "_rate"]
    if rule != "lines":
        assert got[1300].kept and got[1300]["host_" + rule + "_rate"] < 1


def test_columns_of_any_name(spark):
    good = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, good, "h", "T", 5, 6), (2, "short", "h", "T", 5, 6)], "doc_id int, text string, source string, Text string, counts int, odds int")
    out = qr.keep_good(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, good, "h", "T", 5, 6)]
    named = df.withColumn("lang", F.lit("en")).withColumn("p_path", F.lit(3))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "id int, good int")
    out = qc.keep_good(named, labels)
    assert out.columns == named.columns and {r.doc_id for r in out.collect()} <= {1, 2}


def junk(i):
    return " ".join(f"{'xyzw'[(i + k) % 4]}{k * i}###" for k in range(20 + i % 30))


def prose(i):
    return ". ".join(" ".join(["the", "cat", "of", "mine", f"w{(i * k) % 97}a", "sat"]) for k in range(2 + i % 9)) + "."


def test_classifier(spark):
    rows = [(i, junk(i) if i % 5 == 0 else prose(i), f"h{i % 4}", "en", 1, "p") for i in range(400)]
    rows += [(900, None, "h1", "en", 1, "p"), (901, "", None, None, 1, "p"), (902, prose(3), None, None, 1, "p"), (902, prose(3), None, None, 1, "p"), (None, prose(4), "h1", "x", 1, "p")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string, score int, host string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 3)] + [(None, 1), (5000, 0), (8, None)], "id int, good int")
    out = qc.keep_good(docs, labels)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in out.collect())
    assert kept == sorted([i for i in range(400) if i % 5] + [902, 902, -1])
    named = docs.selectExpr("doc_id AS id", "text", "source AS host", "lang AS path")
    report = qc.report(named, labels)
    assert report.count() == len(rows)
    assert sorted((r.id if r.id is not None else -1) for r in report.where("kept").collect()) == kept
    assert qc.report(named.limit(0), labels).collect() == []
    assert qc.report(named, labels.limit(0)).count() == len(rows)


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 0.9)] * 500 + [("b", "x", 0.1)] * 500 + [("c", "x", 0.05)] + [("a", "y", 0.2)]
    sites, mean = qc.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r.host, r.path): r for r in sites.collect()}
    assert got["a", "x"].p_path == pytest.approx(0.9, abs=0.02) and got["b", "x"].p_path == pytest.approx(0.1, abs=0.02)
    assert 0.05 < got["c", "x"].p_host < mean
    assert 0.2 < got["a", "y"].p_path < got["a", "y"].p_host


def brute_sites(rows, labels):
    """Posteriors by plain Python. rows: (id, host, path, odds or None)."""
    p = [(h, q, labels.get(i, 1 / (1 + math.exp(-o)))) for i, h, q, o in rows if o is not None]
    paths, hosts = {}, {}
    for h, q, x in p:
        for table, key in ((paths, (h, q)), (hosts, h)):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + x)
    n, mean = len(p), sum(x for *_, x in p) / len(p)

    def strength(spread, degrees):
        between = (spread - degrees * mean * (1 - mean)) / n
        return min(max(mean * (1 - mean) / between - 1, qc.WEAKEST), qc.STRONGEST) if between > 0 else qc.STRONGEST

    a = strength(sum(m * (s / m - mean) ** 2 for m, s in hosts.values()), len(hosts) - 1)
    b = strength(sum(m * (s / m - hosts[h][1] / hosts[h][0]) ** 2 for (h, _), (m, s) in paths.items()), len(paths) - len(hosts))
    p_host = {h: (s + mean * a) / (m + a) for h, (m, s) in hosts.items()}
    return p_host, {(h, q): (s + p_host[h] * b) / (m + b) for (h, q), (m, s) in paths.items()}, mean


def test_sites_turn_verdicts_as_their_posteriors_say(spark):
    """Texts of one kind, told apart by their sites alone; each level turns verdicts, as recomputed by hand."""
    rows, labels = [], {}
    for host, path, good, many in [("up", "x", 0.95, 120), ("up", "y", 0.95, 80), ("down", "x", 0.05, 120), ("down", "z", 0.1, 60), ("split", "a", 0.97, 100), ("split", "b", 0.03, 100), (None, None, 0.5, 5), ("new", "x", 0.0, 2)]:
        for k in range(many):
            i = len(rows)
            rows.append((i, prose(k), host, path))
            if k % 2 == 0:
                labels[i] = int(k / many < good)
    docs = spark.createDataFrame(rows, "id int, text string, host string, path string")
    said = spark.createDataFrame(list(labels.items()), "id int, good int")
    got = {r.id: r for r in qc.report(docs, said).collect()}
    odds = dict(map(tuple, docs.select("id", qc.evidence(qc.fit(docs, said), F.col("text"))).collect()))
    p_host, p_path, mean = brute_sites([(i, h, q, odds[i]) for i, _, h, q in rows], labels)
    logit = lambda x: math.log(x / (1 - x))
    by_host = 0
    for i, _, h, q in rows:
        score = 1 / (1 + math.exp(-(odds[i] + logit(p_path[h, q]) - logit(mean))))
        assert got[i].p_host == pytest.approx(p_host[h], abs=2e-6) and got[i].p_path == pytest.approx(p_path[h, q], abs=2e-6)
        assert got[i].score == pytest.approx(score, abs=2e-6) and (got[i].kept == (score >= 0.5) or abs(score - 0.5) < 1e-6)
        by_host += h in ("up", "down") and got[i].kept != (odds[i] >= 0)
    assert by_host  # the host level turns verdicts of the text
    share = lambda h, q: sum(got[i].kept for i, _, a, b in rows if (a, b) == (h, q)) / sum((a, b) == (h, q) for _, _, a, b in rows)
    assert share("up", "x") > 0.9 and share("down", "x") < 0.1
    assert share("split", "a") > 0.9 and share("split", "b") < 0.1  # one host, told apart by path


def test_very_long_text(spark):
    rows = [(1, "the cat sat. " * 200_000, "h", "p"), (2, "#$%" * 500_000, "h", "p")] + [(i, prose(i), "h", "p") for i in range(3, 30)]
    labels = spark.createDataFrame([(2, 0)] + [(i, 1) for i in range(3, 30)], "id int, good int")
    assert qc.report(spark.createDataFrame(rows, "id int, text string, host string, path string"), labels).count() == 29


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet").selectExpr("doc_id AS id", "text", "source AS host", "lang AS path")
    labels = spark.read.parquet(f"{base}/labels.parquet").selectExpr("doc_id AS id", "quality AS good")
    fitted, held = labels.where("id % 3 != 0"), labels.where("id % 3 = 0")
    got = qc.report(docs, fitted).join(held, "id").selectExpr("avg(int(kept = (good = 1)))").first()[0]
    assert got > 0.97
