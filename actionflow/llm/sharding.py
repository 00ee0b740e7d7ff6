"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of slots. Every shard owns the slots up to each of
its virtual nodes; a key belongs to the slot its hash falls in. Loads are bounded
exactly: of ``n`` rows each shard takes ``n // shards`` or one more, the first
``n % shards`` shards one more. Keys of a slot whose shard is full continue
clockwise to the next virtual node of a shard with room.

Only the counts by slot reach the driver (``SLOTS`` numbers at most, however many
rows there are). It walks the ring once over those counts and gives a plan: which
ranks of which slot go to which shard, from which place on. Rows then find their
rank in their slot and look the plan up.

Defined results: a null text has no bytes; a null id hashes like any value; equal
rows are counted first and dealt out by the plan as so many rows, so a key that
holds a third of all rows is one row until the end; an empty table gives no rows.
The key on the ring is the id together with the text's checksum, so rows that
share an id but not a text still spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actionflow.llm.scratch import picked, written

SLOTS = 1 << 14
VIRTUAL_NODES = 128
RUN = 4096  # equal rows of one shard that a task writes out in one go

PLAN = "slot int, home int, seg_start bigint, seg_end bigint, shard int, seg_offset bigint"


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise. A shard's nodes don't depend on how many shards there are."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % slots
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> Iterable[tuple]:
    """Rows of PLAN: each slot's ranks dealt to the shards clockwise, none over its bound."""
    nodes = ring(shards, virtual_nodes, slots)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    given = [0] * shards
    ahead = list(range(len(nodes)))  # the next node that may have room

    def with_room(i: int) -> int:
        i %= len(nodes)
        path = []
        while given[nodes[i][1]] >= room[nodes[i][1]]:
            path.append(i)
            i = (i + 1) % len(nodes) if ahead[i] == i else ahead[i]
        for p in path:
            ahead[p] = i
        return i

    at = 0
    for slot in sorted(counts):
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        node, done = at % len(nodes), 0
        home = nodes[node][1]
        while done < counts[slot]:
            node = with_room(node)
            shard = nodes[node][1]
            take = min(counts[slot] - done, room[shard] - given[shard])
            yield slot, home, done, done + take, shard, given[shard]
            given[shard] += take
            done += take


def assign(rows: DataFrame, key: list[str], shards: int, virtual_nodes: int = VIRTUAL_NODES, slots: int = SLOTS) -> DataFrame:
    """``rows`` with shard, slot (place in the shard, gapless from 0) and home_shard (of the ring alone).

    key: the columns hashed onto the ring. All columns of ``rows`` must be comparable.
    """
    spark, names = rows.sparkSession, rows.columns
    columns = [F.col(f"`{c}`") for c in names]
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    ringed = counted.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in key])).withColumn("__slot", F.pmod("__hash", F.lit(slots)).cast("int"))
    ringed = written(ringed, "ring")
    counts = {r[0]: r[1] for r in ringed.groupBy("__slot").agg(F.sum("__n")).collect()}  # at most `slots` rows
    plan = spark.createDataFrame(list(walk(counts, shards, virtual_nodes, slots)), PLAN)  # at most slots + shards rows
    before = Window.partitionBy("__slot").orderBy("__hash", *columns).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ringed.withColumn("__end", F.sum("__n").over(before)).withColumn("__start", F.col("__end") - F.col("__n"))
    met = ranked.join(F.broadcast(plan), (F.col("__slot") == F.col("slot")) & (F.col("seg_start") < F.col("__end")) & (F.col("seg_end") > F.col("__start")))
    part = met.select(*columns, "shard", "home", (F.col("seg_offset") - F.col("seg_start")).alias("__shift"), F.greatest("__start", "seg_start").alias("__from"), F.least("__end", "seg_end").alias("__to"))
    runs = part.where(F.col("__to") - F.col("__from") > RUN).withColumn("__from", F.explode(F.sequence("__from", F.col("__to") - 1, F.lit(RUN).cast("bigint"))))
    runs = runs.withColumn("__to", F.least("__to", F.col("__from") + RUN)).repartition(F.xxhash64(*columns, "__from"))  # few rows: the runs of a key go to many tasks
    short = part.where(F.col("__to") - F.col("__from") <= RUN).unionByName(runs)
    placed = short.withColumn("__rank", F.explode(F.sequence("__from", F.col("__to") - 1)))
    return placed.select(*columns, F.col("shard"), (F.col("__shift") + F.col("__rank")).alias("slot"), F.col("home").alias("home_shard"))


def shard_documents(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    rows = picked(docs, doc_id=doc_id, text=text).select("doc_id", (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    placed = assign(rows, ["doc_id", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
