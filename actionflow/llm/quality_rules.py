"""Quality rules with verdicts on hosts.

Rules are judged on each document: the base rule (too few words, or too many of them
in repeated windows), symbols, repeated lines, and the length of words. Failures are
summed by host, and each host's rates are shrunk towards the rates of all documents
with beta priors fitted to the hosts (method of moments). A host is rejected if for
any rule its rate is credibly bad: the mean of its posterior less ``DEVIATIONS``
standard deviations is over ``HOST_LIMIT`` and over ``HOST_FACTOR`` times the rate of
all documents (while that leaves room). All its documents go with it. A document
alone goes by the base rule only; the other rules speak of hosts.

Defined results: a null or empty text has no words, so it fails; a null host is a
host of its own; equal rows are judged alike and all stay or all go; an empty
table gives an empty result. Columns besides those named are passed on, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionflow.llm.rawtext import SPACE, classes, mix, slices, windows
from actionflow.llm.scratch import number_of, numbered, picked, restored, small_broadcast, written

MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 20
LINE_PERCENT = 30
SHORT_WORDS, LONG_WORDS = 2, 15  # characters a word, on average
HOST_LIMIT, HOST_FACTOR, HIGHEST = 0.25, 2.0, 0.9
DEVIATIONS = 2.0
WEAKEST, STRONGEST = 1.0, 1e6  # of a prior, in documents
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
RULES = ("base", "symbols", "lines", "word_length")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _of_slice(part) -> dict[str, np.ndarray]:
    """The counts of each document of a slice."""
    start, end = part.words()
    doc = part.doc_of(start)
    first_byte = ((part.data & 0xC0) != 0x80) & ~SPACE[part.data]

    line, line_end = part.lines()
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line)
    line, line_end = line[with_word], line_end[with_word]
    line_doc = part.doc_of(line)
    key = mix(part.hashes(line, line_end) + line_doc.astype(np.uint64))
    distinct = classes(key, lambda a, b: (line_doc[a] == line_doc[b]) & part.same(a, b, line, line_end))
    distinct_doc = np.zeros(distinct.max(initial=-1) + 1, np.int64)
    distinct_doc[distinct] = line_doc

    word = classes(part.hashes(start, end), lambda a, b: part.same(a, b, start, end))
    key, first = windows(mix(word.astype(np.uint64)), doc, WINDOW)
    key = mix(key + doc[first].astype(np.uint64))

    def same_window(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = first[a], first[b]
        return np.logical_and.reduce([doc[x] == doc[y], *(word[x + k] == word[y + k] for k in range(WINDOW))])

    window = classes(key, same_window)
    repeated = np.bincount(window)[window] > 1
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, first[repeated], 1)
    np.add.at(cover, first[repeated] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    count = lambda docs: np.bincount(docs, minlength=part.n)
    return {
        "n_words": count(doc),
        "word_chars": part.per_doc(first_byte),
        "n_symbols": part.byte_counts()[:, _SYMBOL].sum(axis=1),
        "n_dup_lines": count(line_doc) - count(distinct_doc),
        "n_repeat_words": count(doc[covered]),
        "n_lines": count(line_doc),
    }


@F.arrow_udf(COUNT_TYPE)
def text_counts(text: pa.Array) -> pa.Array:
    parts = [_of_slice(x) for x in slices(text)]
    columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(COUNTS))


def failed(counts: Column) -> dict[str, Column]:
    """Each rule as a condition on the counts of a document."""
    return {
        "base": (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"]),
        "symbols": 100 * counts["n_symbols"] > SYMBOL_PERCENT * counts["word_chars"],
        "lines": 100 * counts["n_dup_lines"] > LINE_PERCENT * counts["n_lines"],
        "word_length": (counts["word_chars"] < SHORT_WORDS * counts["n_words"]) | (counts["word_chars"] > LONG_WORDS * counts["n_words"]),
    }


def host_verdicts(judged: DataFrame) -> DataFrame:
    """A row for each host: its shrunk failure rates and if it is rejected.

    judged: ``host`` and a boolean column for each rule. Summed on the map side
    first, so a host with a third of all rows costs a row for each task.
    """
    hosts = written(judged.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in RULES]), "hosts")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in RULES], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in RULES]).first()
    n = total["n"] or 0
    rates, bad = [], []
    for r in RULES:
        failures = total[r] or 0
        mean = failures / n if n else 0.0
        noise = mean * (1 - mean)
        between = ((total[f"{r}_sq"] or 0.0) - failures * mean - (total["hosts"] - 1) * noise) / n if n else 0.0
        strength = min(max(noise / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST
        rate = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        low = rate - F.lit(DEVIATIONS) * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(strength + 1)))
        rates.append(rate.alias(f"{r}_rate"))
        bad.append(low > F.lit(max(HOST_LIMIT, min(HIGHEST, HOST_FACTOR * mean))))
    rejected = bad[0]
    for b in bad[1:]:
        rejected = rejected | b
    return hosts.select("host", *rates, rejected.alias("host_rejected"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their columns as they were.

    The texts are gone through twice, once for the sums by host and once for the
    documents, so that no text is shuffled: the second time a document needs only
    the row of its host, broadcast if the hosts are counted to be few, else joined
    with skewed hosts split.
    """
    counts = picked(docs, host=host, text=text).select("host", text_counts("text").alias("c"))
    verdicts = host_verdicts(counts.select("host", *[c.alias(r) for r, c in failed(F.col("c")).items()]))
    own = small_broadcast(verdicts.where("host_rejected").select("host"))
    good = numbered(docs).withColumn("counts", text_counts(F.col(number_of(docs, text)))).where(~failed(F.col("counts"))["base"])
    return restored(good.join(own, F.col(number_of(docs, host)).eqNullSafe(F.col("host")), "left_anti"), docs)


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """A narrow row for each document. The counts are written once and used for both the sums and the verdicts."""
    counted = written(picked(docs, id=id_column, host=host, text=text).select("id", "host", text_counts("text").alias("c")), "quality_rules")
    verdicts = host_verdicts(counted.select("host", *[c.alias(r) for r, c in failed(F.col("c")).items()]))
    own = small_broadcast(verdicts.withColumnRenamed("host", "own_host"))
    base = failed(F.col("c"))["base"]
    joined = counted.join(own, F.col("host").eqNullSafe(F.col("own_host")), "left")
    return joined.select(F.col("id").alias(id_column), "c.*", base.alias("base_failed"), (~base & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"), "host", *[F.round(f"{r}_rate", 6).alias(f"host_{r}_rate") for r in RULES])
