"""Ordered collections as tables: selections, upserts, step logs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def between_positions(files: DataFrame, a: int, b: int) -> DataFrame:
    return files.where(F.col("position").between(min(a, b), max(a, b)))


def inverted(files: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    return files.join(selected, key, "left_anti")


def toggled(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Ids in exactly one of the two."""
    both = selected.select("id", F.lit(1).alias("n")).unionByName(clicked.select("id", F.lit(1).alias("n")))
    return both.groupBy("id").agg(F.sum("n").alias("n")).where("n = 1").select("id")


def upserted(files: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Updated rows take the place of those with their key; new ones are added."""
    return files.join(updates.select(key), key, "left_anti").unionByName(updates)


def indexed(steps: DataFrame, group: str, *order: str) -> DataFrame:
    return steps.withColumn("step_index", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def without_step(steps: DataFrame, group: str, index: int) -> DataFrame:
    """Every group's steps without the one at ``index``, the gap closed."""
    kept = steps.where(F.col("step_index") != index)
    return kept.withColumn("step_index", F.when(F.col("step_index") > index, F.col("step_index") - 1).otherwise(F.col("step_index")))


def last_step(steps: DataFrame, group: str, value: str, *order: str) -> DataFrame:
    """Each group's value of the last step by ``order``, and how many steps it has. Aggregated on the map side, without a sort."""
    return steps.groupBy(group).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("steps"))


def folded_extensions(steps: DataFrame, group: str, extension: str, start: str, *order: str) -> DataFrame:
    """The extension after all of a group's steps, each of which sets one or ('') keeps the current: that of the last step that sets one."""
    sets = F.when(F.col(extension) != "", F.struct(*order))
    return steps.groupBy(group).agg(F.count("*").alias("steps"), F.coalesce(F.max_by(extension, sets), F.lit(start)).alias("final_extension"))


def chains(steps: DataFrame) -> DataFrame:
    """(file_id, chain): each file's steps in order, as ``apply_chains`` takes them."""
    each = F.array_sort(F.collect_list(F.struct("step_index", "skill_id", "params_text")))
    text = steps.withColumn("params_text", F.to_json("params"))
    link = lambda s: F.struct(s["skill_id"].alias("skill_id"), F.from_json(s["params_text"], "map<string,string>").alias("params"))
    return text.groupBy("file_id").agg(F.transform(each, link).alias("chain"))


def previous_snapshot(snapshots: DataFrame, group: str, index: Column) -> DataFrame:
    """Where a run again from step ``index`` on starts: each group's last snapshot before it; no row means the file as it came."""
    before = snapshots.where(F.col("step_index") < index)
    return before.groupBy(group).agg(F.max_by("snapshot", "step_index").alias("start_from"), F.max("step_index").alias("step_index"))


def truncated(snapshots: DataFrame, index: Column) -> DataFrame:
    """Snapshots of the steps before ``index``; later ones are of steps that are run again."""
    return snapshots.where(F.col("step_index") < index)


def with_snapshot(snapshots: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Snapshots with ``new`` ones (group, step_index, snapshot) put in their places, over what was there."""
    key = [group, "step_index"]
    return snapshots.join(new.select(*key), key, "left_anti").unionByName(new)


def gaps_filled(snapshots: DataFrame, group: str) -> DataFrame:
    """A row for each index up to a group's last; where nothing was kept the snapshot is null."""
    ends = snapshots.groupBy(group).agg(F.max("step_index").alias("last"))
    every = ends.select(group, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("step_index"))
    return every.join(snapshots, [group, "step_index"], "left")


PUBLIC = ("id", "position", "name", "extension", "current_extension", "original_path", "size", "preview")


def public_view(files: DataFrame) -> DataFrame:
    """What may be shown of files: no contents, no places of tables."""
    return files.select(*[c for c in PUBLIC if c in files.columns])


def appended(files: DataFrame, new: DataFrame) -> DataFrame:
    """New files behind all others, in the order of their own positions."""
    behind = files.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("position")).first()[0]
    return files.unionByName(new.withColumn("position", F.col("position") + F.lit(behind).cast("bigint")))


def targets(files: DataFrame, selected: DataFrame, mode: str, active: Any = None) -> DataFrame:
    """What an action is for: the selected files; if there are none, in per-file mode the active one; else all."""
    if selected.limit(1).count():
        return files.join(selected.select("id").distinct(), "id", "left_semi")
    return files.where(F.col("id") == F.lit(active)) if mode == "per_file" and active is not None else files


def selection_count(selected: DataFrame, active: Any = None) -> DataFrame:
    """One row: how many files are selected; one if none is but a file is active."""
    n = F.count_distinct("id")
    return selected.agg(F.when((n == 0) & F.lit(active is not None), F.lit(1).cast("bigint")).otherwise(n).alias("selected"))


def joined_lines(rows: DataFrame, value: str, order: str) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return rows.agg(F.array_join(lines, "\n").alias("text"))
