"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on features of the whole text gives each document a probability
of being good. Sites are a hierarchy: hosts, and paths within hosts. A document
counts for its site with its label where it has one, else with its probability;
a grouped aggregation gives each site's number of good documents. The host's rate is
shrunk towards the rate of all documents, and each path's rate towards its host's, by
beta priors whose strengths are fitted to the spread between hosts and between paths.
Sparse sites thus stay near the level above. A document's verdict is its own log
odds, moved by how far its path's log odds are from those of all documents.

The model is fitted on the driver on at most ``MOST_TRAINING_ROWS`` labelled
documents (those with the smallest hashes of their ids); only their features, a
row of numbers each, are collected. Scores, sums, labels in the sums and verdicts
cover all documents.

Defined results: a null or empty text has no evidence of its own, doesn't count for
its site and is rejected (there is nothing in it); null hosts or paths are sites of
their own; equal rows are scored alike; of several labels of an id the best counts; an
empty table gives no rows; without both kinds of labels the model gives every document
with text the prior rate of the labels. Columns besides those named are passed on,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionflow.llm.rawtext import mix, slices, windows
from actionflow.llm.scratch import number_of, numbered, picked, restored, small_broadcast, written

MOST_TRAINING_ROWS = 20_000
THRESHOLD = 0.5
WEAKEST, STRONGEST = 2.0, 1e6  # of a prior, in documents

FEATURES = (
    "log_words", "word_length", "long_words", "capital", "digit", "symbol", "pipe", "exclaim", "stop", "comma",
    "other_punctuation", "non_ascii", "space", "line_words", "short_lines", "repeated_words", "repeated_lines", "distinct_words", "symbol_ends", "brackets",
)

_CLASSES = {
    "capital": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#*$%&~^@=+\\",
    "pipe": b"|",
    "exclaim": b"!",
    "stop": b".?",
    "comma": b",;:",
    "other_punctuation": b"'\"`_/-",
    "brackets": b"<>()[]{}",
    "non_ascii": bytes(range(128, 256)),
    "space": b" \t\r\x0b\x0c\n",
}


def _table(values: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(values)] = True
    return flags


_FLAGS = {k: _table(v) for k, v in _CLASSES.items()}
_OF_CLASS = np.stack(list(_FLAGS.values()), 1).astype(np.int64)


def _repeats(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys of each document equal an earlier one, and how many there are."""
    own = mix(key + doc.astype(np.uint64))
    order = np.argsort(own)
    again = own[order[1:]] == own[order[:-1]]
    return np.bincount(doc[order[1:][again]], minlength=n), np.bincount(doc, minlength=n)


def features_of(part) -> np.ndarray:
    """A row for each document of a slice."""
    start, end = part.words()
    doc = part.doc_of(start)
    hashes = part.hashes(start, end, lower=True)
    size = np.maximum(np.diff(part.at), 1)
    words = np.bincount(doc, minlength=part.n)
    some = np.maximum(words, 1)
    length = end - start
    line, line_end = part.lines()
    in_line = np.searchsorted(start, line_end) - np.searchsorted(start, line)
    line, line_end, in_line = line[in_line > 0], line_end[in_line > 0], in_line[in_line > 0]
    line_doc = part.doc_of(line)
    lines = np.maximum(np.bincount(line_doc, minlength=part.n), 1)
    window, first = windows(hashes, doc, 3)
    again, all_windows = _repeats(window, doc[first], part.n)
    line_again, _ = _repeats(part.hashes(line, line_end, lower=True), line_doc, part.n)
    word_again, _ = _repeats(hashes, doc, part.n)
    ends = _FLAGS["symbol"][part.data[np.maximum(end - 1, 0)]] if len(end) else np.zeros(0, bool)
    found = {
        "log_words": np.log1p(words),
        "word_length": np.bincount(doc, length, part.n) / some / 5,
        "long_words": np.bincount(doc, length > 20, part.n) / some,
        "line_words": np.log1p(words / lines),
        "short_lines": np.bincount(line_doc, in_line < 4, part.n) / lines,
        "repeated_words": again / np.maximum(all_windows, 1),
        "repeated_lines": line_again / lines,
        "distinct_words": 1 - word_again / some,
        "symbol_ends": np.bincount(doc, ends, part.n) / some,
    } | dict(zip(_FLAGS, (part.byte_counts() @ _OF_CLASS).T / size, strict=True))
    return np.stack([found[f] for f in FEATURES], 1)


def _all_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features, and if a document has any word."""
    parts = [features_of(x) for x in slices(text)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return x, x[:, 0] > 0


class Model:
    """Logistic regression on standardised features, a little shrunk, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> None:
        n, k = x.shape
        self.mean = x.mean(0) if n else np.zeros(k)
        self.spread = np.maximum(x.std(0), 1e-9) if n else np.ones(k)
        self.rate = (y.sum() + 1.0) / (n + 2.0)
        self.weight = np.zeros(k + 1)
        self.weight[-1] = math.log(self.rate / (1 - self.rate))
        if n == 0 or y.min() == y.max():
            return
        z = self._basis(x)
        cost = np.full(k + 1, penalty)
        cost[-1] = 0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(cost + 1e-9), z.T @ (y - p) - cost * self.weight)
            self.weight += step
            if np.abs(step).max() < 1e-8:
                break

    def _basis(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.spread, -8, 8), np.ones(len(x))])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._basis(x) @ self.weight, -30, 30)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents. docs: id, text; labels: id, good (0 or 1)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(text: pa.Array) -> pa.Array:
        x = _all_features(text)[0]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    chosen = labels.where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    met = docs.where("id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen), "id")  # `most` rows of two numbers at most
    rows = met.groupBy("id").agg(F.min("text").alias("text"), F.max("good").alias("good")).select("id", features("text").alias("x"), "good").collect()
    rows.sort(key=lambda r: r["id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return x, np.array([r["good"] for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS) -> Model:
    return Model(*training_rows(docs, labels, most))


def evidence(model: Model, text: Column) -> Column:
    """Log odds from the text alone; null where it has no words."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        x, some = _all_features(text)
        return pa.array(model.log_odds(x), mask=~some)

    return score(text)


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(good: float, n: float, squares: float, groups: int, degrees: int, mean: float) -> float:
    """Documents that a beta prior counts for, from the spread of group rates beyond what chance gives.

    squares: the sum of n * (rate - parent's rate)^2 over groups.
    """
    noise = mean * (1 - mean)
    between = (squares - degrees * noise) / n if n else 0.0
    return min(max(noise / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path, p of documents with evidence: their label where they have one, else the model's probability. scored: id, host, path, odds."""
    said = labels.where("id IS NOT NULL AND good IS NOT NULL").groupBy(F.col("id").alias("label_id")).agg(F.max("good").alias("good"))
    met = scored.where("odds IS NOT NULL").join(small_broadcast(said), F.col("id") == F.col("label_id"), "left")
    return met.select("host", "path", F.coalesce(F.col("good").cast("double"), _sigmoid(F.col("odds"))).alias("p"))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p_host, p_path) for every site, and the rate of all documents.

    scored: host, path, p. Sums are partial on the map side; a host with a third of
    all rows costs one row for each task and path.
    """
    paths = written(scored.where("p IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("path_sq"), F.count("*").alias("paths"))
    t = hosts.agg(F.count("*").alias("hosts"), F.sum("host_n").alias("n"), F.sum("host_good").alias("good"), F.sum(F.col("host_good") * F.col("host_good") / F.col("host_n")).alias("host_sq"), F.sum("path_sq").alias("path_sq"), F.sum("paths").alias("paths")).first()
    n, good = t["n"] or 0, t["good"] or 0.0
    mean = good / n if n else 0.5
    of_hosts = _strength(good, n, (t["host_sq"] or 0.0) - good * mean, t["hosts"], t["hosts"] - 1, mean)
    of_paths = _strength(good, n, (t["path_sq"] or 0.0) - (t["host_sq"] or 0.0), t["paths"] or 0, (t["paths"] or 0) - t["hosts"], mean)
    hosts = hosts.select(F.col("host").alias("own_host"), ((F.col("host_good") + mean * of_hosts) / (F.col("host_n") + of_hosts)).alias("p_host"))
    met = paths.join(hosts, F.col("host").eqNullSafe(F.col("own_host")))
    return met.select("host", "path", "p_host", ((F.col("good") + F.col("p_host") * of_paths) / (F.col("n") + of_paths)).alias("p_path")), mean


def _combined(odds: Column, p_path: Column, mean: float) -> Column:
    return _sigmoid(odds + F.coalesce(_logit(p_path) - _logit(F.lit(mean)), F.lit(0.0)))


def report(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING_ROWS) -> DataFrame:
    """A narrow row for each document. docs: id, text, host, path; labels: id, good."""
    model = fit(docs.select("id", "text"), labels, most)
    scored = written(docs.select("id", "host", "path", evidence(model, F.col("text")).alias("odds")), "evidence")
    sites, mean = site_posteriors(labelled(scored, labels))
    sites = small_broadcast(written(sites.withColumnsRenamed({"host": "own_host", "path": "own_path"}), "posteriors"))
    met = scored.join(sites, F.col("host").eqNullSafe(F.col("own_host")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    met = met.withColumn("score", F.coalesce(_combined(F.col("odds"), F.col("p_path"), mean), F.lit(0.0)))
    return met.select("id", "host", "path", F.round(_sigmoid(F.col("odds")), 6).alias("p_document"), F.round("p_host", 6).alias("p_host"), F.round("p_path", 6).alias("p_path"), F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", most: int = MOST_TRAINING_ROWS) -> DataFrame:
    """The documents that pass, with their columns as they were.

    The texts are gone through once for the sums by site and once for the documents,
    so that none is shuffled: a document then needs only its site's row.
    """
    read = picked(docs, id=doc_id, text=text, host=host, path=path)
    model = fit(read.select("id", "text"), labels, most)
    sites, mean = site_posteriors(labelled(read.select("id", "host", "path", evidence(model, F.col("text")).alias("odds")), labels))
    sites = small_broadcast(written(sites.select("host", "path", "p_path"), "posteriors"))
    of = lambda name: F.col(number_of(docs, name))
    met = numbered(docs).withColumn("odds", evidence(model, of(text))).join(sites, of(host).eqNullSafe(F.col("host")) & of(path).eqNullSafe(F.col("path")), "left")
    return restored(met.where(F.coalesce(_combined(F.col("odds"), F.col("p_path"), mean), F.lit(0.0)) >= THRESHOLD), docs)
