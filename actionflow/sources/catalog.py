"""The catalog of actions: JSON files of layered sources to one row for each action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from actionflow.functions import permissions
from actionflow.schemas import DEFINITION

LAYERS = ("core:embedded", "core:disk", "community")
RESERVED = ("manifest.json", "pack.json")


def is_definition(file_name: Column) -> Column:
    low = F.lower(file_name)
    return F.endswith(low, F.lit(".json")) & ~F.startswith(file_name, F.lit(".")) & ~F.startswith(file_name, F.lit("_")) & ~low.isin(*RESERVED)


def is_watched(file_name: Column) -> Column:
    """Files whose change makes a reload worth while: wider than what is loaded."""
    return F.endswith(F.lower(file_name), F.lit(".json")) & ~F.startswith(file_name, F.lit("."))


def files_of(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """(source, layer, path, text) of the files under (source, folder) pairs; a missing folder is passed over."""
    found = None
    for source, root in roots:
        try:
            one = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        one = one.select(F.lit(source).alias("source"), F.lit(LAYERS.index(source)).alias("layer"), F.col("_metadata.file_path").alias("definition_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "source string, layer int, definition_path string, file_name string, text string")
    return found


def normalize(rows: DataFrame) -> DataFrame:
    """Empty strings and arrays for what is missing, sorted permissions, the driver inferred; ``error`` says what is wrong."""
    d = F.col("d")
    text = lambda c: F.coalesce(c, F.lit(""))
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    kind = F.lower(F.trim(text(F.col("d.executor.type"))))
    driver = F.when(text(d["driver"]) != "", d["driver"]).when(kind.isin("cli", "pipeline", "meta"), kind).when(kind == "native", F.lit("image")).otherwise(F.lit("meta"))
    blank = lambda c: F.trim(text(c)) == ""
    error = F.when(d.isNull() | F.col("broken"), F.lit("malformed definition"))
    for c in ("id", "name", "version"):
        error = F.coalesce(error, F.when(blank(d[c]), F.lit(f"missing {c}")))
    return rows.select(
        text(d["id"]).alias("id"), text(d["name"]).alias("name"), text(d["version"]).alias("version"), text(d["author"]).alias("author"), words(d["aliases"]).alias("aliases"),
        text(d["category"]).alias("category"), text(d["description"]).alias("description"), words(d["inputTypes"]).alias("input_types"), text(d["outputType"]).alias("output_type"),
        d["params"].alias("params"), driver.alias("driver"), F.coalesce(d["isMeta"], F.lit(False)).alias("is_meta"), d["executor"].alias("executor"),
        permissions.normalized(d["permissions"]).alias("permissions"), F.coalesce(d["dangerLevel"], F.lit(0)).alias("danger_level"), "source", "layer", "definition_path", error.alias("error"),
    )


def parsed(files: DataFrame) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    kind = DEFINITION[:-1] + ", __bad string>"
    return files.withColumn("d", F.from_json("text", kind, options)).withColumn("broken", F.col("d.__bad").isNotNull())


def last_wins(rows: DataFrame, key: str = "id", order: tuple[str, ...] = ("layer", "definition_path")) -> DataFrame:
    """Of rows with the same key, the one of the highest layer, and there the lexically last path."""
    window = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__place", F.row_number().over(window)).where("__place = 1").drop("__place")


def load_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, quarantine): good definitions, the last of each id, and the files that were refused with the reason.

    files: source, layer, definition_path, file_name, text.
    """
    rows = normalize(parsed(files.where(is_definition(F.col("file_name")))))
    return last_wins(rows.where("error IS NULL")).drop("error"), rows.where("error IS NOT NULL").select("source", "definition_path", "id", "error")


def load(spark: SparkSession, roots: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    return load_files(files_of(spark, roots))


def errors_line(quarantine: DataFrame) -> DataFrame:
    """One row: all refusals in one text, in the order of their paths."""
    line = F.array_join(F.array_sort(F.collect_list(F.concat("definition_path", F.lit(": "), "error"))), "; ")
    return quarantine.agg(line.alias("text"))


def errors_text(quarantine: DataFrame) -> str:
    return errors_line(quarantine).first()[0]
