"""Near-duplicate documents: MinHash bands, odd sketches, exact sets, components.

1. A document's set of word shingles gives MinHash values. Bands of them name
   buckets of likely similar documents; all of them folded into a parity bitmap are
   its odd sketch. The whole set folded into a wider bitmap is a second one.
   Documents with equal sets are one node from here on.
2. Every node is held against the leaders of its buckets. Pairs whose sketches
   differ in too many bits (the population count of their XOR) are dropped; of the
   others, those with the leaders it shares most bands with are compared on their
   full sets. That joins most of each group.
3. What is left are pairs of one bucket in different components. Members outside
   the bucket's largest component are held against all others by a join on the
   bucket that tests sizes and sketches in its condition, so only survivors become
   rows; those are compared on their full sets too. Large buckets are cut into
   tiles. No pair of a bucket that could link two components is skipped, so no link
   between components is lost to the shortcut of step 2.
4. Components of the confirmed links, by rounds of stars in shared tables.

With 40 bands of 6 values, two sets at the threshold of 0.8 share no band with a
chance of 5e-6; the test on the sketch of MinHash values then fails by chance for
2e-8 (it lets pass what is estimated at 0.6 or more). The test on the sketch of the
whole set loses nothing: sets differ in at least as many elements as bits. For sets
of up to some thousand shingles it lets little through that isn't a link. Sets are
sets of 64-bit hashes of shingles (two different sets of a and b shingles have one in
common by chance in a * b of 2^64 cases); equal sets are found by a cryptographic
digest of 128 bits of the whole sorted set.

Defined results: a null or empty text, or one of white space, has an empty set and
is linked with nothing; fewer words than a shingle make one shingle; equal rows are
copies of each other; rows with a null id join groups but name them only if no
other id does; an empty table gives no rows. Other columns are passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from actionflow.llm.graph import components
from actionflow.llm.rawtext import BASE, U, Slice, mix, slices, windows
from actionflow.llm.scratch import hot_keys, number_of, numbered, picked, restored, salted_join, small_broadcast, written

WORDS = 5
PERCENT = 80
BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_LONGS = SKETCH_BITS // 64
LEAST_ESTIMATE = 0.6
SET_BITS = 2048
SET_LONGS = SET_BITS // 64
LEADERS = 3  # pairs of a node in step 2; step 3 covers the rest
TILE = 1000, 20_000  # of a bucket: members outside its largest component, and others, that meet in one place

_seed = np.random.RandomState(20_231)
_MULTIPLY = (_seed.randint(0, 1 << 31, SAMPLES).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _seed.randint(0, 1 << 31, SAMPLES).astype(np.uint32)[:, None] * np.uint32(2)
_SAMPLE = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * U(BASE))
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xA24BAED4963EE407))

SIGNATURE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("parity", T.ArrayType(T.LongType())),
])


def shingle_sets(part: Slice, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    start, end = part.words()
    doc = part.doc_of(start)
    hashes = part.hashes(start, end, lower=True)
    many = np.bincount(doc, minlength=part.n)
    key, first = windows(hashes, doc, words)
    key_at = np.searchsorted(doc[first], np.arange(part.n + 1))
    word_at = np.concatenate([[0], np.cumsum(many)])
    out = []
    for i in range(part.n):
        if many[i] >= words:
            out.append(np.unique(key[key_at[i] : key_at[i + 1]]))
        elif many[i]:
            own = hashes[word_at[i] : word_at[i + 1]]
            out.append(windows(own + U(many[i]), np.zeros(len(own), int), len(own))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(own: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES hash functions over a set, which isn't empty."""
    x = (own >> U(32)).astype(np.uint32)[None, :]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 2048):
        h = x[:, k : k + 2048] * _MULTIPLY
        h += _ADD
        np.minimum(least, h.min(axis=1), out=least)
    return least


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of whole sets."""
    flips = np.zeros((len(sets), SET_BITS), np.uint8)
    for i, s in enumerate(sets):
        flips[i] = np.bincount((mix(s + U(0x2545F491)) % U(SET_BITS)).astype(np.int64), minlength=SET_BITS) & 1
    return np.packbits(flips, axis=1).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (as 64-bit words) of rows of MinHash values: each value flips one bit."""
    n = len(samples)
    bit = (mix(samples.astype(np.uint64) + _SAMPLE) % U(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.int64)


def estimate(different_bits: float) -> float:
    """The Jaccard similarity that an XOR of so many bits speaks for."""
    rest = 1 - 2 * different_bits / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(rest) if rest > 0 else -1.0


MOST_BITS = max(z for z in range(SKETCH_BITS) if estimate(z) >= LEAST_ESTIMATE)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def signature(text: Column, words: int) -> Column:
    """Set size, a 128-bit identity of the set, band keys and odd sketch (no keys and no sketch for an empty set)."""

    @F.arrow_udf(SIGNATURE)
    def signed(text: pa.Array) -> pa.Array:
        sizes, c1, c2, bands, sketches, parities = [], [], [], [], [], []
        for part in slices(text):
            sets = shingle_sets(part, words)
            size = np.array([len(s) for s in sets])
            sizes.append(size)
            names = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            c1.append(names[:, 0])
            c2.append(names[:, 1])
            full = [minhash(s) for s in sets if len(s)]
            if full:
                samples = np.stack(full)
                rows = samples.reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(_BAND, rows.shape[:2]).copy()
                for k in range(ROWS):
                    key = mix(key + rows[:, :, k])
                bands.append(key.view(np.int64).ravel())
                sketches.append(odd_sketches(samples).ravel())
                parities.append(set_sketches([s for s in sets if len(s)]).ravel())
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        columns = [pa.array(size.astype(np.int64)), pa.array(flat(c1)), pa.array(flat(c2)), _lists(flat(bands), (size > 0) * BANDS), _lists(flat(sketches), (size > 0) * SKETCH_LONGS), _lists(flat(parities), (size > 0) * SET_LONGS)]
        return pa.StructArray.from_arrays(columns, SIGNATURE.names)

    return signed(text)


def full_set(text: Column, words: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(text: pa.Array) -> pa.Array:
        found = [s for part in slices(text) for s in shingle_sets(part, words)]
        return _lists(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), np.array([len(s) for s in found], np.int64))

    return sets(text)


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and odd sketches of two nodes leave it possible that they are linked."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")

    def bits(letter: str, longs: int) -> Column:
        each = [F.bit_count(F.col(f"{a}.{letter}{k}").bitwiseXOR(F.col(f"{b}.{letter}{k}"))) for k in range(longs)]
        return sum(each[1:], each[0])

    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    differ = (100 + percent) * bits("f", SET_LONGS) <= (100 - percent) * (na + nb)  # elements that two such sets can differ in
    return sizes & differ & (bits("s", SKETCH_LONGS) <= MOST_BITS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, nodes: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. Nodes of very many pairs are spread."""
    pairs = written(pairs, "pairs", nodes)
    many = pairs.count()
    right = sets.select(F.col("node").alias("v"), F.col("own").alias("sv"))
    left = sets.select(F.col("node").alias("u"), F.col("own").alias("su"))
    met = salted_join(salted_join(pairs, right, "v", "u", hot_keys(pairs, "v", many)), left, "u", "v", hot_keys(pairs, "u", many))
    shared = F.size(F.array_intersect("su", "sv"))
    return met.where(100 * shared >= percent * (F.size("su") + F.size("sv") - shared)).select("u", "v")


def _signed(read: DataFrame, words: int) -> DataFrame:
    """read: id, text."""
    return written(read.select("id", F.xxhash64("text").alias("th"), signature(F.col("text"), words).alias("s")).select("id", "th", "s.*"), "signatures")


def _open_pairs(member: DataFrame, first: DataFrame, slim: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of one bucket in different components that sizes and sketches leave possible."""
    joined = member.select("bucket", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = joined.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most < all")
    tiles = [F.ceil(n / size).cast("int").alias(name) for name, n, size in (("few_parts", F.col("all") - F.col("most"), TILE[0]), ("all_parts", F.col("all"), TILE[1]))]
    open_ = written(joined.join(mixed.select("bucket", "main", *tiles), "bucket").join(slim, "node"), "open")
    part = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    a = open_.where("component != main").withColumn("few", part("few_parts")).withColumn("every", each("all_parts")).alias("a")
    b = open_.withColumn("every", part("all_parts")).withColumn("few", each("few_parts")).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("bucket", "few", "every")]
    once = (F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    met = b.join(a, on[0] & on[1] & on[2] & (F.col("a.component") != F.col("b.component")) & once & _alike("a", "b", percent))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _groups(read: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """For every set that more than one row or a link has: c1, c2 and the group's first row (id, th)."""
    key = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    same = rows.where("n > 0").groupBy("c1", "c2").agg(F.min(key).alias("row"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    many = rows.count()
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "nodes", many)
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("many"), F.min("node").alias("leader")).where("many > 1")
    member = written(member.join(shared, "bucket"), "members")

    slim = nodes.select("node", "n", *[F.element_at("sketch", k + 1).alias(f"s{k}") for k in range(SKETCH_LONGS)], *[F.element_at("parity", k + 1).alias(f"f{k}") for k in range(SET_LONGS)])
    busy = member.select("node").distinct()
    slim = written(slim.join(busy, "node"), "sketches", many)
    wanted = nodes.join(busy, "node").select("node", "row.id", "row.th")
    hashed = read.select(F.col("id").alias("doc"), "text", F.xxhash64("text").alias("hash"))
    met = hashed.join(small_broadcast(wanted), F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")))
    sets = written(met.select("node", full_set(F.col("text"), words).alias("own")), "sets")
    if rows.groupBy("id", "th").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])

    votes = written(member.where("node != leader").groupBy("node", "leader").agg(F.count("*").alias("bands")).select(F.col("node").alias("u"), F.col("leader").alias("v"), "bands"), "votes", many)
    mine, theirs = slim.select("node", F.struct(*slim.columns).alias("a")), slim.select("node", F.struct(*slim.columns).alias("b"))
    voted = votes.join(mine.withColumnRenamed("node", "u"), "u")
    voted = salted_join(voted, theirs.withColumnRenamed("node", "v"), "v", "u", hot_keys(votes, "v", votes.count())).where(_alike("a", "b", percent)).select("u", "v", "bands")
    best = Window.partitionBy("u").orderBy(F.desc("bands"), "v")
    near = voted.withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEADERS).select("u", "v")
    first = components(_confirmed(near, sets, percent, many))

    rest = _open_pairs(member, first, slim, percent)
    links = first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(_confirmed(rest, sets, percent, many))
    final = components(links)

    known = nodes.select("node", "c1", "c2", "row", "rows").join(final, "node", "left").where("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "known", many)
    firsts = known.groupBy("component").agg(F.min("row").alias("first"))
    met = salted_join(known, firsts, "component", "node", hot_keys(known, "component", many))
    return met.select("c1", "c2", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of the group) and kept (its row has that id)."""
    read = picked(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("bigint"))
    rows = _signed(read, words)
    groups = _groups(read, rows, words, percent).withColumnsRenamed({"c1": "g1", "c2": "g2"})
    met = rows.join(groups, (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("g1").isNull(), F.col("id")).otherwise(F.col("first_id"))
    return met.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each group, with their columns as they were.

    Documents with an empty set are in no group and stay.
    """
    read = picked(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("bigint"))
    rows = _signed(read, words)
    groups = _groups(read, rows, words, percent).withColumnsRenamed({"c1": "g1", "c2": "g2"})
    met = rows.join(groups, (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2")) & (F.col("n") > 0))
    gone = met.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))).select("id", "th").distinct()
    gone = written(gone, "gone", rows.count())
    flat = numbered(docs)
    hashed = flat.withColumns({"own": F.col(number_of(docs, doc_id)).cast("bigint"), "hash": F.xxhash64(number_of(docs, text))})
    on = F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th"))
    left = hashed.join(small_broadcast(gone), on, "left_anti")
    twice = rows.where("n > 0").groupBy("id", "th").agg(F.count("*").alias("many")).where("many > 1").select("id", "th")
    twice = written(twice, "twice", rows.count())
    if twice.limit(1).count():  # rows alike in id and text: one of each stays
        again = hashed.join(small_broadcast(twice), on, "left_semi").join(small_broadcast(gone), on, "left_anti")
        one = again.groupBy("own", "hash").agg(F.first(F.struct(*flat.columns)).alias("row")).select("row.*", "own", "hash")
        left = left.join(small_broadcast(twice), on, "left_anti").unionByName(one)
    return restored(left, docs)
