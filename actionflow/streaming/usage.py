"""Usage counts kept by Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counting(log: DataFrame) -> DataFrame:
    """Count and last use by action of a stream (or table) of uses (skill_id, used_at): a state of one row for each action."""
    return log.groupBy("skill_id").agg(F.count("*").alias("count"), F.max("used_at").alias("last_used"))


def count_once(spark: SparkSession, path: str, action: str, used_at: str) -> DataFrame:
    """Streams all files at ``path`` through the counter and gives the final state.

    Every micro-batch writes the whole state to a table of its own in the folder the
    cluster shares; the last is the result.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="usage-")
    base = f"{base.rstrip('/')}/usage-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    log = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    state = counting(log.select(F.col(action).alias("skill_id"), F.col(used_at).alias("used_at")))
    done: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/state-{number}")
        done.append(f"{base}/state-{number}")

    state.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(done[-1])


def _is_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
