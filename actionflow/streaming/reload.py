"""Reloading the catalog when definition files change."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from actionflow.sources import catalog

DEBOUNCE = "150 milliseconds"
TRIES, PAUSE_SECONDS = 20, 0.1  # of a listing


def listing(spark: SparkSession, roots: list[tuple[str, str]]) -> list[list]:
    """[path, time of change, length] of every watched file under the roots, sorted; a missing root has none.

    By Hadoop's file systems, on the driver: definitions are few.
    """
    jvm, found = spark._jvm, []
    for _, root in roots:
        where = jvm.org.apache.hadoop.fs.Path(root)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            continue
        files = system.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if name.lower().endswith(".json") and not name.startswith("."):  # as ``catalog.is_watched`` has it
                found.append([f.getPath().toString(), f.getModificationTime(), f.getLen()])
    return sorted(found)


def settled(spark: SparkSession, roots: list[tuple[str, str]]) -> list[list]:
    """The listing, taken again if files go away while it is made."""
    for k in range(TRIES):
        try:
            return listing(spark, roots)
        except Py4JJavaError:
            if k + 1 == TRIES:
                raise
            time.sleep(PAUSE_SECONDS)
    raise AssertionError("TRIES is over 0")


def _remembered(spark: SparkSession, path: str) -> list | None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    source = system.open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def _remember(spark: SparkSession, path: str, what: list) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(json.dumps(what).encode()))
    finally:
        out.close()


def watch(spark: SparkSession, roots: list[tuple[str, str]], changed: Callable[[DataFrame, DataFrame], None], progress: str, once: bool = False):
    """Starts a stream that looks at the folders in every micro-batch and loads all of them anew if anything has changed.

    A file stream would see new files only. This one compares listings, so new
    files, edits and deletions all count, in folders made later as well; changes that
    come close together are one reload. What was seen last is kept in ``progress``, so
    a restarted stream reloads only what changed meanwhile. ``changed`` gets the
    catalog and the quarantine, also for the first look.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    seen = f"{progress.rstrip('/')}-seen.json"

    def look(batch: DataFrame, number: int) -> None:
        now = settled(spark, roots)
        if now == _remembered(spark, seen):
            return
        try:
            changed(*catalog.load(spark, roots))
        except Exception:
            if settled(spark, roots) == now:
                raise
            return  # files changed while they were read: the next look finds that
        _remember(spark, seen, now)  # only now: what failed is tried again

    writer = ticks.writeStream.foreachBatch(look).option("checkpointLocation", progress)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime=DEBOUNCE).start()
