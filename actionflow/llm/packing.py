"""Best-fit packing of tokenised documents into sequences, with large-item matching.

Every document becomes its token ids and an end id. A document longer than a
sequence is cut into full sequences, the shorter piece first. Pieces over a third
of the capacity fit at most twice into a sequence: the largest is paired with the
largest that fits, greedily. Smaller pieces, the largest first, go into the
smallest gap that holds them; what fits nowhere opens a sequence.

A plan needs only how many pieces there are of each length, so the driver gets a
histogram of at most ``capacity`` numbers and plans for whole groups of equal
sequences at once; the plan's size depends on the capacity, not on the data. A
piece finds its rank among those of its length (its rank in its partition, plus
the counts of the partitions before) and looks its place up in the plan.

Defined results: a null or empty text is the end id alone; equal rows are packed
one by one; a null id stays null; an empty table gives no rows; strings of special
tokens inside a text become those tokens, as the library has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from actionflow.llm.scratch import picked, written

CAPACITY = 1024
END_ID = 2

# Fixed value: how byte-level BPE of this family cuts a text before merging.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, from their rule: visible Latin-1 stands for itself, the rest follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> array of uint32 ids, as ``tokenizers`` gives them for the file at ``path``.

    A byte-level BPE whose merges are numbered in the order of its ids goes
    through ``tiktoken``, which gives the same ids about five times as fast; texts
    that hold the string of an added token don't, as only the library knows its rules.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if model.get("type", "BPE") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return plain
    alphabet = _byte_alphabet()
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocabulary.get(t, -1) for t in merged]
    if order != sorted(order) or len(set(order)) != len(order) or len(vocabulary) != len(order) + 256:
        return plain

    import tiktoken

    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items()}
    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except ValueError:  # a run of white space too long for its regular expressions
            return plain(text)

    return quick


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be short."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go, and the number of sequences.

    Rows: length, first rank, last rank + 1, first sequence, pieces in each
    sequence, offset of the first piece there. Ranks of a length follow each other
    through the sequences of a row.
    """
    left = dict(histogram)
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens -> groups (first sequence, how many)
    sequences = 0

    def put(length: int, first: int, many: int, each: int, offset: int) -> None:
        n = many * each
        rows.append((length, rank[length], rank[length] + n, first, each, offset))
        rank[length] += n
        left[length] -= n
        gaps.setdefault(capacity - offset - each * length, []).append((first, many))

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    for a in large:
        for b in large:
            if not left[a]:
                break
            if b > a or a + b > capacity or not left[b]:
                continue
            many = left[a] // 2 if a == b else min(left[a], left[b])
            if not many:
                continue
            if a == b:
                put(a, sequences, many, 2, 0)
            else:
                put(a, sequences, many, 1, 0)
                gaps[capacity - a].pop()
                put(b, sequences, many, 1, a)
            sequences += many
        if left[a]:
            many = left[a]
            put(a, sequences, many, 1, 0)
            sequences += many

    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= s):
            if not left[s]:
                break
            each, groups, stay = gap // s, gaps.pop(gap), []
            for first, many in groups:
                full = min(many, left[s] // each)
                if full:
                    put(s, first, full, each, capacity - gap)
                if full < many and left[s]:
                    if left[s] < each:
                        put(s, first + full, 1, left[s], capacity - gap)
                        full += 1
                if full < many:
                    stay.append((first + full, many - full))
            if stay:
                gaps.setdefault(gap, []).extend(stay)
        each = capacity // s
        if full := left[s] // each:
            put(s, sequences, full, each, 0)
            sequences += full
        if left[s]:
            put(s, sequences, 1, left[s], 0)
            sequences += 1
    return np.array(rows, np.int64).reshape(-1, 6), sequences


def pieces(docs: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document, with ``block`` (their partition) and ``rank`` among its pieces of that length."""
    read = picked(docs, doc_id=doc_id, text=text)
    fields = [T.StructField("doc_id", read.schema["doc_id"].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32", "block", "rank")]
    fields[1] = T.StructField("piece", T.IntegerType())
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            source, out, kept = [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    source.append(i)
                    out.append((k, start, length, zlib.crc32(part.tobytes()), seen[length]))
                    seen[length] += 1
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            if not out:
                continue
            k, start, length, crc, rank = np.array(out, np.int64).T
            columns = [batch.column(0).take(pa.array(source)), pa.array(k.astype(np.int32)), *map(pa.array, (start, length, crc, np.full(len(k), block), rank))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return read.mapInArrow(cut, T.StructType(fields))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: its document, place in it, checksum (or ids), sequence and offset there."""
    table = written(pieces(docs, doc_id, text, tokenizer or default_tokenizer(), capacity, end_id, keep_ids), "pieces")
    sizes = table.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    shift = np.int64(1) << 44  # ranks stay below: 2^44 pieces of a length
    rows = rows[np.argsort(rows[:, 0] * shift + rows[:, 1])]
    keys = rows[:, 0] * shift + rows[:, 1]

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = np.asarray(length), np.asarray(rank)
        row = rows[np.searchsorted(keys, n * shift + r, "right") - 1]
        i = r - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + i % row[:, 4] * n)], ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = table.join(starts, ["length", "block"]).withColumn("place", place(F.col("length"), F.col("before") + F.col("rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", *["ids"] * keep_ids)
