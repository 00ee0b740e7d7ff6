"""Working files, settings, usage and trust as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from actionflow.functions import paths
from actionflow.schemas import SETTINGS, TRUST, USES
from actionflow.sources import storage

DEFAULT_SETTINGS = {"output_folder": "", "naming_pattern": paths.DEFAULT_PATTERN, "accent_color": "99,102,241"}


def identity(path: str = "path", strict: bool = False) -> list:
    """Columns of a file's name, extension and folder."""
    p = F.col(path)
    return [paths.stem(p, strict).alias("name"), paths.extension(p).alias("extension"), paths.parent(p).alias("folder")]


def read_files(spark: SparkSession, given: list[str], first_position: int = 0) -> DataFrame:
    """A row for each given path in order, the same path as often as it is given; unreadable ones are left out. Paths may be URIs."""
    at = [(i + first_position, storage.full_path(p)) for i, p in enumerate(given) if storage.readable(p)]
    listed = spark.createDataFrame(at, "position bigint, given string")
    if not at:
        read = spark.createDataFrame([], "path string, content binary, length bigint")
    else:
        read = spark.read.format("binaryFile").load(sorted({p for _, p in at})).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content", "length")
    met = listed.join(read, F.col("given") == F.col("path"))
    return met.select(F.expr("uuid()").alias("id"), "position", *identity()[:2], F.col("given").alias("original_path"), F.col("length").alias("size"), "content").withColumn("current_extension", F.col("extension"))


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table; one that was never written is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def store(df: DataFrame, path: str) -> None:
    """``df`` must not be read from ``path``."""
    df.write.mode("overwrite").json(path)


class Kept:
    """Settings, trust and uses between sessions, each a table in one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def settings(self) -> dict:
        """What was stored, over the defaults."""
        row = stored(self.spark, f"{self.folder}/settings", SETTINGS).first()
        return DEFAULT_SETTINGS | ({k: v for k, v in row.asDict().items() if v is not None} if row else {})

    def keep_settings(self, settings: dict) -> None:
        store(self.spark.createDataFrame([settings], SETTINGS), f"{self.folder}/settings")

    def trusted(self) -> set[str]:
        return {r[0] for r in stored(self.spark, f"{self.folder}/trust", TRUST).collect()}  # decisions of one user

    def keep_trusted(self, trusted: set[str]) -> None:
        store(self.spark.createDataFrame([(t,) for t in sorted(trusted)], TRUST), f"{self.folder}/trust")

    def uses(self) -> DataFrame:
        """The log of uses (skill_id, used_at), read anew."""
        return stored(self.spark, f"{self.folder}/uses", USES)

    def add_use(self, action: str, at) -> None:
        self.spark.createDataFrame([(action, at)], USES).write.mode("append").json(f"{self.folder}/uses")
