"""Export: names from a pattern, free paths, copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actionflow.functions import paths
from actionflow.sources import storage

#: Ranges of positions, so that one name's requests are counted in many tasks.
RANGES = 128


def split_name(name: str) -> tuple[str, str]:
    base, dot, ext = name.rpartition(".")
    return (base, dot + ext) if dot else (name, "")


def assign_free(names: list[str], taken: set[str]) -> list[str]:
    """In order: the name itself, else with -1, -2, ... before its extension, as far as it takes."""
    used, last, out = set(taken), {}, []
    for name in names:
        base, ext = split_name(name)
        k = last.get(name, 0)
        pick = name if k == 0 else f"{base}-{k}{ext}"
        while pick in used:
            k += 1
            pick = f"{base}-{k}{ext}"
        last[name] = k
        used.add(pick)
        out.append(pick)
    return out


def resolve(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests: folder, position, name. existing: folder, name. Adds ``resolved``.

    Only names of one folder, extension and root (the name without trailing -numbers)
    can meet. In most such families no name made for one file is another's own or there
    already; then a request's number is its rank among those of its name, counted by
    ranges of positions. The assignment of the other families is sequential by nature:
    each is a group of its own.
    """
    dot = F.when(F.contains(F.col("name"), F.lit(".")), F.regexp_extract("name", r"(\.[^.]*)$", 1)).otherwise(F.lit(""))
    base = F.expr("left(name, length(name) - length(__ext))")
    root = F.regexp_replace(base, r"(-[0-9]+)+$", "")
    keyed = lambda df: df.withColumn("__ext", dot).withColumn("__root", root)
    same = lambda a, b, *keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    asked = requests.select("folder", F.col("position").cast("bigint").alias("position"), "name")
    cuts = asked.agg(F.percentile_approx("position", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or []
    ends = F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<bigint>")
    asked = asked.withColumn("__range", F.size(F.filter(ends, lambda c: c < F.col("position"))))
    there = existing.select("folder", "name").distinct()

    by_name = Window.partitionBy("folder", "name")
    counts = asked.groupBy("folder", "name", "__range").agg(F.count(F.lit(1)).alias("__many"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__many").over(by_name.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__many").over(by_name))
    counts = keyed(counts.alias("c").join(there.alias("t"), same("c", "t", "folder", "name"), "left").select("c.*", F.col("t.name").isNotNull().cast("bigint").alias("__taken")))

    names = counts.groupBy("folder", "name", "__root", "__ext").agg(F.max(F.col("__all") + F.col("__taken")).alias("__tries"))
    own = names.select("folder", "name", "__root", "__ext").unionByName(keyed(there))
    numbered = own.withColumn("__base", base).where(F.col("__base").rlike(r"-[1-9][0-9]*\z"))
    made = numbered.select("folder", "__root", "__ext", F.concat(F.regexp_replace("__base", r"-[1-9][0-9]*\z", ""), "__ext").alias("name"), F.regexp_extract("__base", r"([0-9]+)\z", 1).try_cast("bigint").alias("__k"))
    clashing = made.alias("m").join(names.alias("n"), [*same("m", "n", "folder", "name"), F.col("__k") < F.col("__tries")]).select("m.folder", "m.__root", "m.__ext").distinct()

    told = counts.alias("c").join(clashing.alias("x"), same("c", "x", "folder", "__root", "__ext"), "left").select("c.*", F.col("x.__root").isNotNull().alias("__clash"))
    all_asked = asked.alias("a").join(told.alias("c"), same("a", "c", "folder", "name", "__range")).select("a.*", *(f"c.{k}" for k in ("__root", "__ext", "__before", "__taken", "__clash")))

    k = F.row_number().over(Window.partitionBy("folder", "name", "__range").orderBy("position")) - 1 + F.col("__before") + F.col("__taken")
    plain = all_asked.where(~F.col("__clash")).withColumn("__k", k)
    plain = plain.select("folder", "position", "name", F.when(F.col("__k") == 0, F.col("name")).otherwise(F.concat(base, F.lit("-"), F.col("__k").cast("string"), "__ext")).alias("resolved"))

    taken = keyed(there).alias("t").join(clashing.alias("x"), same("t", "x", "folder", "__root", "__ext"), "left_semi")
    both = all_asked.where("__clash").select("folder", "position", "name", "__root", "__ext", F.lit(False).alias("taken")).unionByName(taken.select("folder", F.lit(None).cast("bigint").alias("position"), "name", "__root", "__ext", F.lit(True).alias("taken")))

    def family(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[~rows["taken"]].sort_values("position", kind="stable")
        names = assign_free(asked["name"].tolist(), set(rows.loc[rows["taken"], "name"]))
        return pd.DataFrame({"folder": asked["folder"], "position": asked["position"].astype("int64"), "name": asked["name"], "resolved": pd.Series(names, index=asked.index, dtype=object)})

    return plain.unionByName(both.groupBy("folder", "__root", "__ext").applyInPandas(family, "folder string, position bigint, name string, resolved string"))


def planned(files: DataFrame, steps: DataFrame, pattern: str, folder: str = "", default_action: str = "file") -> DataFrame:
    """(id, folder, position, name): where each file is to go, named after its last step."""
    last = steps.groupBy("file_id").agg(F.max_by("skill_id", "step_index").alias("action"))
    met = files.join(last, F.col("id") == F.col("file_id"), "left")
    to = F.lit(folder) if folder else paths.parent(F.col("original_path"))
    return met.select("id", to.alias("folder"), "position", paths.export_name(F.lit(pattern), F.col("name"), F.col("current_extension"), F.coalesce("action", F.lit(default_action))).alias("name"))


def export(files: DataFrame, steps: DataFrame, pattern: str, folder: str = "") -> DataFrame:
    """Writes every file's content; (id, position, output_path) in order. files: with original_path, current_extension and content.

    Folders are listed and files written by tasks, on any file system (``sources.storage``).
    A row's path is settled before it is written, so a repeated task writes the same file again.
    """
    plan = planned(files, steps, pattern, folder)
    free = resolve(plan.select("folder", "position", "name"), storage.names_in(plan.select("folder").distinct()))
    ready = plan.select("id", "position").join(free, "position").join(files.select("id", "content"), "id").select("id", "position", F.concat_ws("/", "folder", "resolved").alias("output_path"), "content")

    def copy(frames):
        for frame in frames:
            for path, content in zip(frame["output_path"], frame["content"], strict=True):
                storage.put(path, content)
            yield frame[["id", "position", "output_path"]]

    return ready.mapInPandas(copy, "id string, position bigint, output_path string").orderBy("position")
