"""Intermediate tables in the folder that the whole cluster shares, and what keys and columns need to be safe."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 25_000
BROADCAST_ROWS = 500_000  # of a few numbers or short names each
HOT_KEYS = 10_000  # a key is hot if it has more than that part of all rows
HOT_ROWS = 1_000  # and more rows than this

# Of whole texts a batch of the default 10,000 rows takes tens of megabytes, and some hundred when texts are long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds what a task holds of texts at once: batches to and from Python, and of the Parquet reader.

    These are settings of the session; every query of this subpackage asks for the
    same ones, so none depends on which ran before. What the session has set itself
    is left as it is.
    """
    for name, most in BATCHES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may do without: it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: list[str] = []  # folders of this process, oldest first


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _made.append(folder)
    return f"{folder}/{name}"


def mark() -> int:
    """A place in the list of tables made, for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Deletes the tables made since a mark, but what ``keep`` was read from. What hasn't been run yet may need them: call it when all has."""
    kept = "\n".join(keep.inputFiles()) if keep is not None else ""
    stay = [folder for folder in _made[since:] if folder.rpartition("/")[2] in kept]
    for folder in set(_made[since:]) - set(stay):
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[since:] = stay


def written(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder.

    Cuts the lineage: what follows survives the loss of any executor and doesn't
    compute ``df`` again. The table stays until it is cleared, by ``clear`` or the owner of the folder.
    most_rows: if it is known how many narrow rows there are at most, the table gets
    a file for each ROWS_PER_FILE of them instead of one for each partition.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_broadcast(df: DataFrame) -> DataFrame:
    """A narrow table, marked for broadcast if its rows are counted to be few; else it is left to a shuffle join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hot_keys(rows: DataFrame, key: str, many: int) -> DataFrame:
    """(key, parts) of keys with very many of the ``many`` rows, and how many parts they are best cut into.

    A hot key has over 1/HOT_KEYS of the rows, so there are HOT_KEYS at most (twice
    as many if ``rows`` may be up to twice ``many``): a broadcast of proven size.
    """
    most = max(HOT_ROWS, many // HOT_KEYS)
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def salted_join(rows: DataFrame, facts: DataFrame, key: str, salt: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row for each key) in which hot keys are spread.

    Rows of a hot key go to one of its parts by the hash of ``salt``; its fact is
    copied to each. hot: of ``hot_keys``.
    """
    of = hot.select(F.col(key).alias("__hot"), F.col("parts").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(F.broadcast(of), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(salt), parts).cast("int")).drop("__hot", "__parts")
    right = facts.join(F.broadcast(of), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns, called c0, c1 and so on: whatever they were called, no name of ours meets them, nor they each other."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def number_of(df: DataFrame, name: str) -> str:
    """What column ``name`` is called in ``numbered(df)``: the one of just that name, else one that differs in case only."""
    names = df.columns
    if name not in names:
        names, name = [n.lower() for n in names], name.lower()
    if name not in names:
        raise ValueError(f"no column {name} among {', '.join(df.columns)}")
    return f"c{names.index(name)}"


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, under the names given to them here."""
    return numbered(df).select(*[F.col(number_of(df, name)).alias(own) for own, name in columns.items()])


def restored(rows: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``numbered(df)`` in ``rows``, under their own names again."""
    found: list[Column] = [F.col(f"c{i}") for i in range(len(df.columns))]
    return rows.select(*found).toDF(*df.columns)
