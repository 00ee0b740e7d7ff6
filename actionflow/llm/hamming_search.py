"""Exact top-k search by Hamming distance: incremental multi-index hashing.

A code of up to 64 bits is cut into ``m`` segments. A block of codes keeps, for each
segment, its positions sorted by the segment's value and where each value starts. A
query looks up all values within a radius of its own segments. Radii grow one segment
at a time: after step t, segment t mod m has radius t div m, so every code within
distance t has been met (were it further off in each segment than that segment's
radius, its distance would be over t). Codes met are verified by their whole distance, and the
search of a query ends when its k-th best verified distance is at most t: no code
that it hasn't met can be nearer or as near.

Codes are cut by value into blocks of about ``INDEX_ROWS``; a task indexes one block
once and streams its queries past it. A query goes to the block its own code falls in
first. The k-th distance found there bounds what can still be wanted, so it then goes
only to blocks whose codes begin with bits that differ from its own in no more
places, and a search there ends at that bound. The best k of all are the result.
Codes are shuffled once; besides them only queries travel, once for each block that
may hold something for them.

Of equal codes only the k + 1 with the least ids are indexed (more can't be among the
nearest k other than the query itself), found by a rank that Spark limits before its
shuffle, so a code of a third of all rows is a few rows. Queries equal in code are
one search for k + 1, from which each takes those that aren't its own; ids with several
codes are searched for one by one.

Ties in distance go to the smaller id. Defined results: rows whose code or id is null
aren't indexed and don't search; rows equal in id and code are one; a query doesn't
find its own id; with fewer than k other codes all are found; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actionflow.llm.scratch import picked, written

BITS = 64
INDEX_ROWS = 1 << 20
LEAST_ROWS = 1 << 12  # of a block, where more blocks would only keep more tasks busy
MOST_SEGMENT_BITS = 16


def sign_code(embedding: Column, bits: int = BITS) -> Column:
    """A bigint whose bit i says if component i is not negative; null for a null or short vector or one with a null component there; a wider one is an error."""
    at = lambda i: F.get(embedding, i)
    parts = [F.when(at(i) >= 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")).when(at(i) < 0, F.lit(0).cast("bigint")) for i in range(bits)]
    code = parts[0]
    for p in parts[1:]:
        code = code.bitwiseOR(p)
    wide = F.raise_error(F.concat(F.lit(f"a code has {bits} bits, a vector here has this many components: "), F.size(embedding).cast("string")))
    return F.when(F.size(embedding) > bits, wide.cast("bigint")).otherwise(code)


@lru_cache(maxsize=256)
def masks(width: int, radius: int) -> np.ndarray:
    """Every value of ``width`` bits with exactly ``radius`` ones."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """A block of codes under every segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int = BITS) -> None:
        self.codes, self.ids, self.bits = codes.astype(np.uint64), ids, bits
        wanted = min(MOST_SEGMENT_BITS, max(4, math.ceil(math.log2(max(2, len(codes))))))
        self.m = max(1, round(bits / wanted))
        edges = [bits * i // self.m for i in range(self.m + 1)]
        self.parts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        self.orders, self.starts = [], []
        for shift, width in self.parts:
            value = self.segment(self.codes, shift, width)
            order = np.argsort(value, kind="stable")
            self.orders.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << width) + 1)))
        self.met = np.zeros(len(codes), bool)

    @staticmethod
    def segment(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, code: int, own: int | None, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the nearest k codes of other ids than ``own``, ties to the smaller id; with a bound those within it."""
        bound = self.bits if bound is None else bound
        code = np.uint64(code)
        values = [int(self.segment(code, s, w)) for s, w in self.parts]
        found: list[np.ndarray] = []
        tally = np.zeros(self.bits + 1, np.int64)  # verified codes by distance, the query's own id left out
        for t in range(bound + 1):
            s, radius = t % self.m, t // self.m
            width = self.parts[s][1]
            if radius <= width:
                value = values[s] ^ masks(width, radius)
                low, high = self.starts[s][value], self.starts[s][value + 1]
                many = high - low
                at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                position = self.orders[s][at]
                position = position[~self.met[position]]
                if len(position):
                    self.met[position] = True
                    found.append(position)
                    others = position if own is None else position[self.ids[position] != own]
                    tally += np.bincount(np.bitwise_count(self.codes[others] ^ code), minlength=self.bits + 1)
            if tally[: t + 1].sum() >= k:  # the k-th best is at most t, and all within t have been met
                break
        position = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.met[position] = False
        if own is not None:
            position = position[self.ids[position] != own]
        distance = np.bitwise_count(self.codes[position] ^ code).astype(np.int64)
        position, distance = position[distance <= bound], distance[distance <= bound]
        best = np.lexsort((self.ids[position], distance))[:k]
        return distance[best], self.ids[position][best]


class Blocks:
    """The value range of every block, and what a query can find in each."""

    def __init__(self, rows: list) -> None:
        self.number = np.array([r["block"] for r in rows], np.int64)
        self.low = np.array([r["low"] for r in rows], np.int64)
        differ = self.low ^ np.array([r["high"] for r in rows], np.int64)
        free = np.array([int(x).bit_length() if x >= 0 else 64 for x in differ.tolist()])  # low bits that aren't the same in all codes
        self.fixed = np.array([(-1 << int(b)) & ((1 << 64) - 1) for b in free], np.uint64)

    def home(self, code: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.low, code, "right") - 1, 0)

    def near(self, code: int, bound: int) -> np.ndarray:
        """Places of blocks that may hold a code within the bound."""
        least = np.bitwise_count((self.low ^ np.int64(code)).view(np.uint64) & self.fixed)
        return np.flatnonzero(least <= bound)


SEARCH = "code bigint, own bigint, want int, bound int"
FOUND = "code bigint, own bigint, distance int, neighbor_id bigint"


def _routed(asked: DataFrame, blocks: Blocks, home: bool) -> DataFrame:
    """(block, code, own, want, bound): each query once for its home block, or for each other block near enough."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, bound = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            at = blocks.home(code)
            for low in range(0, len(code), 1024):
                if home:
                    source, target = np.arange(low, min(low + 1024, len(code))), at[low : low + 1024]
                else:
                    each = [(i, places[places != at[i]]) for i in range(low, min(low + 1024, len(code))) for places in [blocks.near(code[i], bound[i])]]
                    source = np.repeat([i for i, _ in each], [len(p) for _, p in each]).astype(np.int64)
                    target = np.concatenate([p for _, p in each])
                if len(source):
                    yield pa.RecordBatch.from_arrays([pa.array(blocks.number[target]), *batch.take(pa.array(source)).columns], ["block", *batch.schema.names])

    return asked.mapInArrow(route, "block bigint, " + SEARCH)


def _searched(codes: DataFrame, routed: DataFrame, blocks: int, bits: int) -> DataFrame:
    """FOUND: what each block has for the queries that came to it. A block's codes come before its queries in its partition."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            block, is_query = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(block)], strict=True):
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, held, index = block[a], [], None
                code = np.asarray(part.column(2))
                if not is_query[a]:
                    held.append((code, np.asarray(part.column(3))))
                    continue
                if index is None:
                    index = Index(np.concatenate([c for c, _ in held]).view(np.uint64), np.concatenate([i for _, i in held]), bits)
                    held = []
                own = part.column(3).to_pylist()
                want, bound = part.column(4).to_pylist(), part.column(5).to_pylist()
                found = [index.search(c, own[i], want[i], bound[i]) for i, c in enumerate(code.view(np.uint64))]
                many = [len(d) for d, _ in found]
                if sum(many):
                    source = pa.array(np.repeat(np.arange(len(many)), many))
                    yield pa.RecordBatch.from_arrays([part.column(2).take(source), part.column(3).take(source), pa.array(np.concatenate([d for d, _ in found]).astype(np.int32)), pa.array(np.concatenate([i for _, i in found]))], ["code", "own", "distance", "neighbor_id"])

    rows = codes.select("block", F.lit(False).alias("is_query"), "code", F.col("id").alias("own"), F.lit(0).alias("want"), F.lit(0).alias("bound"))
    both = rows.unionByName(routed.withColumn("is_query", F.lit(True)))
    return both.repartition(blocks, "block").sortWithinPartitions("block", "is_query").mapInArrow(search, FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, index_rows: int = INDEX_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance. rows, queries: id and code (bigint)."""
    spark = rows.sparkSession
    typed = lambda df: picked(df, id="id", code="code").where("id IS NOT NULL AND code IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.col("code").cast("bigint").alias("code")).distinct()
    place = Window.partitionBy("code").orderBy("id")
    indexed = written(typed(rows).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).select("id", "code"), "indexed")
    many = indexed.count()
    wanted = max(1, -(-many // index_rows), min(spark.sparkContext.defaultParallelism, many // least_rows))
    codes = written(indexed.repartitionByRange(wanted, "code").withColumn("block", F.spark_partition_id().cast("bigint")), "codes")
    ranges = codes.groupBy("block").agg(F.min("code").alias("low"), F.max("code").alias("high")).orderBy("low").collect()  # a row for each block

    asked = typed(queries)
    several = asked.groupBy("id").agg(F.count("*").alias("codes")).where("codes > 1").select(F.col("id").alias("own"))
    asked = written(asked.join(several, F.col("id") == F.col("own"), "left"), "queries")
    searches = asked.select("code", "own").distinct().withColumns({"want": F.when(F.col("own").isNull(), k + 1).otherwise(k), "bound": F.lit(bits)})
    if not ranges:
        return spark.createDataFrame([], "query_id bigint, rank bigint, neighbor_id bigint, distance bigint")
    blocks = Blocks(ranges)
    near = written(_searched(codes, _routed(searches, blocks, True), len(ranges), bits), "found")
    worst = near.groupBy("code", "own").agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
    met = searches.drop("bound").alias("s").join(worst.alias("w"), (F.col("s.code") == F.col("w.code")) & F.col("s.own").eqNullSafe(F.col("w.own")), "left")
    bounded = met.select("s.code", "s.own", "want", F.when(F.col("n") >= F.col("want"), F.col("worst")).otherwise(bits).alias("bound"))
    found = near.unionByName(_searched(codes, _routed(bounded, blocks, False), len(ranges), bits)) if len(ranges) > 1 else near

    best = Window.partitionBy("code", "own").orderBy("distance", "neighbor_id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("code", "own").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))  # k + 1 at most
    mine = asked.alias("q").join(lists.alias("l"), (F.col("q.code") == F.col("l.code")) & F.col("q.own").eqNullSafe(F.col("l.own")))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("id")), 1, k)
    ranked = mine.select(F.col("q.id").alias("query_id"), F.posexplode(others).alias("n", "x"))
    return ranked.select("query_id", (F.col("n") + 1).cast("bigint").alias("rank"), "x.neighbor_id", F.col("x.distance").cast("bigint").alias("distance"))
