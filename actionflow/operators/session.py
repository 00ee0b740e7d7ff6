"""A session: working files, their applied steps and snapshots, settings, trust and usage."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.functions.paths import DEFAULT_PATTERN
from actionflow.operators import execute, export, search, sequences
from actionflow.plans.compile import Catalog, PlanError, Step, compile_action
from actionflow.schemas import CONTENTS, FILES, SNAPSHOTS, STEPS, USAGE
from actionflow.sources import files as sources

MODES = ("batch", "per_file")
EXPORTED = "id string, position bigint, output_path string"


@dataclass
class Result:
    files: DataFrame  # without contents
    settings: dict
    message: str


class Session:
    """Every change is a table in ``folder`` (shared by the cluster), so no plan grows with the session.

    Contents are written once and never rewritten: a table of (id, snapshot, content)
    that grows by one set of files with each step. A file's row names the snapshot it is
    at, ``snapshots`` those after each of its steps. A step that is taken out runs again
    only what came behind it. Parameters of steps are kept as JSON, so a run again
    gets the values of the first. Settings, trust and uses are in ``kept``, which
    sessions may share.
    """

    def __init__(self, spark: SparkSession, catalog: DataFrame, folder: str, kept: str | None = None, mode: str = "batch") -> None:
        self.spark, self.catalog, self.folder, self.mode = spark, catalog, folder.rstrip("/"), mode
        self.kept = sources.Kept(spark, kept or f"{self.folder}/kept")
        self.settings, self.trusted = self.kept.settings(), self.kept.trusted()
        self.plans = Catalog.from_rows(catalog)
        self.active: str | None = None
        self._empty()

    def _empty(self) -> None:
        self.files: DataFrame | None = None
        self.steps = self.spark.createDataFrame([], STEPS)
        self.snapshots = self.spark.createDataFrame([], SNAPSHOTS)
        self.contents = f"{self.folder}/contents-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self) -> DataFrame:
        return self.files if self.files is not None else self.spark.createDataFrame([], FILES)

    def _with_contents(self, files: DataFrame) -> DataFrame:
        """Files (id, snapshot and more) with the content of that snapshot."""
        held = self.spark.read.schema(CONTENTS).parquet(self.contents)
        return files.join(held, ["id", "snapshot"])

    def _keep_contents(self, rows: DataFrame) -> None:
        rows.select("id", "snapshot", "content").write.mode("append").parquet(self.contents)

    @property
    def uses(self) -> DataFrame:
        return self.kept.uses()

    def search(self, query: str = "", types: list[str] | None = None, limit: int | None = None) -> DataFrame:
        return search.search(self.catalog, search.usage_of(self.uses), query, types, limit=limit)

    def usage(self) -> DataFrame:
        return search.usage_of(self.uses).to(self.spark.createDataFrame([], USAGE).schema)

    def set_trust(self, action: str, yes: bool) -> None:
        (self.trusted.add if yes else self.trusted.discard)(action)
        self.kept.keep_trusted(self.trusted)

    def add_files(self, paths: list[str]) -> DataFrame:
        """The public view of all files. Unreadable paths are passed over."""
        new = self._write(sources.read_files(self.spark, paths).withColumn("snapshot", F.lit("base")), "read")
        self._keep_contents(new)
        shown = execute.apply_steps(new, []).select("id", "preview")
        rows = new.drop("content").join(shown, "id").select(*self._files().columns)
        self.files = self._write(rows if self.files is None else sequences.appended(self.files, rows), "files")
        return self.view()

    def view(self) -> DataFrame:
        return sequences.public_view(self._files()).orderBy("position")

    def content(self, ids: list[str] | None = None) -> DataFrame:
        """(id, content) as files are now."""
        if self.files is None:
            return self.spark.createDataFrame([], "id string, content binary")
        chosen = self.files if ids is None else self.files.where(F.col("id").isin(ids))
        return self._with_contents(chosen.select("id", "snapshot")).select("id", "content")

    def types(self) -> list[str]:
        return sorted(r[0] for r in self._files().select("current_extension").distinct().collect())

    def set_active(self, file_id: str | None) -> None:
        self.active = file_id

    def _ids(self, ids: list[str] | None) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids or []], "id string")

    def targets(self, ids: list[str] | None) -> DataFrame:
        """The files an action is for; an id that isn't there is an error."""
        if self.files is None:
            raise PlanError("no files")
        wanted = self._ids(ids)
        missing = [r[0] for r in wanted.join(self.files, "id", "left_anti").collect()]
        if missing:
            raise PlanError(f"unknown files: {', '.join(sorted(missing))}")
        return sequences.targets(self.files, wanted, self.mode, self.active)

    def apply(self, ids: list[str] | None, action: str, params: dict | None = None) -> Result:
        if self.plans.get(action)["is_meta"]:
            return self._meta(action, params or {}, ids)
        steps = compile_action(self.plans, action, params, frozenset(self.trusted))
        if self.files is None or ids == []:
            return Result(self.spark.createDataFrame([], execute.RESULT).drop("content"), self.settings, "")
        now = dt.datetime.now().replace(microsecond=0)
        done = self._run(self.targets(ids), steps)
        good = done.where("error IS NULL")
        held = self.steps.groupBy("file_id").agg(F.count("*").alias("n"))
        given = F.create_map(*[F.lit(x) for k, v in params.items() for x in (str(k), json.dumps(v))]) if params else F.lit(None).cast("map<string,string>")
        row = good.join(held, F.col("id") == F.col("file_id"), "left").select(F.col("id").alias("file_id"), F.coalesce("n", F.lit(0)).cast("int").alias("step_index"), F.lit(action).alias("skill_id"), given.alias("params"), F.lit(now).alias("applied_at"))
        row = self._write(row, "step")
        self.steps = self._write(self.steps.unionByName(row), "steps")
        self._take(good, row)
        if not done.where("error IS NOT NULL").limit(1).count():
            self.kept.add_use(action, now)
        return Result(done.drop("content", "snapshot"), self.settings, execute.first_error(done).first()[0] or "")

    def _run(self, files: DataFrame, steps: list[Step]) -> DataFrame:
        """Results of the steps on files as their snapshots have them, each with a snapshot of its own."""
        ready = self._with_contents(files)
        return self._write(execute.apply_steps(ready, steps).withColumn("snapshot", F.lit(uuid.uuid4().hex)), "results")

    def _take(self, results: DataFrame, row: DataFrame) -> None:
        """Results become the files' state and the snapshots of the steps in ``row`` (file_id, step_index). Only their own contents are written."""
        self._keep_contents(results)
        made = results.join(row.select(F.col("file_id").alias("id"), "step_index"), "id").select(F.col("id").alias("file_id"), "step_index", "snapshot", F.col("current_extension").alias("extension"))
        self.snapshots = self._write(sequences.with_snapshot(self.snapshots, made, "file_id"), "snapshots")
        new = results.select("id", "current_extension", "size", "preview", "snapshot")
        changed = self.files.drop("current_extension", "size", "preview", "snapshot").join(new, "id")
        self.files = self._write(sequences.upserted(self.files, changed.select(*self.files.columns)), "files")

    def remove_step(self, file_id: str, index: int) -> DataFrame:
        """Takes a step out of a file's chain and runs what came behind it again, from the snapshot before it.

        Nothing changes if a step fails. Gives the file's public view.
        """
        own = self.steps.where(F.col("file_id") == file_id).orderBy("step_index").collect()
        if not 0 <= index < len(own):
            raise PlanError(f"no step {index}")
        later = [compile_action(self.plans, r["skill_id"], {k: json.loads(v) for k, v in (r["params"] or {}).items()}, frozenset(self.trusted)) for r in own[index + 1 :]]
        mine = self.snapshots.where(F.col("file_id") == file_id)
        before = mine.where(F.col("step_index") == index - 1).first()
        start = self.targets([file_id])
        start = start.withColumns({"snapshot": F.lit(before["snapshot"]), "current_extension": F.lit(before["extension"])} if before else {"snapshot": F.lit("base"), "current_extension": F.col("extension")})
        now = self._write(execute.apply_steps(self._with_contents(start), []).withColumn("snapshot", F.lit(before["snapshot"] if before else "base")), "results")
        made = []
        for k, steps in enumerate(later):
            done = self._write(execute.apply_steps(now, steps).withColumn("snapshot", F.lit(uuid.uuid4().hex)), "results")
            if error := execute.first_error(done).first()[0]:
                raise PlanError(error)  # nothing has changed yet
            made.append((index + k, done))
            now = done
        for _, done in made:
            self._keep_contents(done)
        kept = sequences.without_step(self.steps.where(F.col("file_id") == file_id), "file_id", index)
        self.steps = self._write(self.steps.where(F.col("file_id") != file_id).unionByName(kept), "steps")
        snapshots = self.snapshots.where(F.col("file_id") != file_id).unionByName(sequences.truncated(mine, F.lit(index)))
        for k, done in made:
            snapshots = snapshots.unionByName(done.select(F.col("id").alias("file_id"), F.lit(k).alias("step_index"), "snapshot", F.col("current_extension").alias("extension")))
        self.snapshots = self._write(snapshots, "snapshots")
        changed = self.files.drop("current_extension", "size", "preview", "snapshot").join(now.select("id", "current_extension", "size", "preview", "snapshot"), "id")
        self.files = self._write(sequences.upserted(self.files, changed.select(*self.files.columns)), "files")
        return sequences.public_view(self.files.where(F.col("id") == file_id))

    def set_mode(self, mode: str) -> None:
        if mode not in MODES:
            raise PlanError(f"no mode {mode!r}")
        self.mode = mode

    def export(self, ids: list[str] | None = None) -> DataFrame:
        """(id, position, output_path) of the files of these ids, of all if none are given; ids that aren't there are passed over."""
        if self.files is None:
            return self.spark.createDataFrame([], EXPORTED)
        chosen = self.files if not ids else self.files.join(self._ids(ids), "id", "left_semi")
        return self._write(export.export(self._with_contents(chosen), self.steps, self.settings["naming_pattern"], self.settings["output_folder"]), "exported").orderBy("position")

    def remove_files(self, ids: list[str]) -> None:
        if self.files is not None:
            self.files = self._write(sequences.inverted(self.files, self._ids(ids)), "files")

    def clear(self) -> None:
        """Files, steps, mode and where exports go; the colour and what is kept stay."""
        self._empty()
        self.mode, self.active = "batch", None
        self.settings |= {"output_folder": "", "naming_pattern": DEFAULT_PATTERN}

    def _meta(self, action: str, params: dict, ids: list[str] | None) -> Result:
        message = ""
        if action in ("switch_to_batch", "switch_to_per_file"):
            self.set_mode(action.removeprefix("switch_to_"))
        elif action in ("set_output_folder", "set_naming_pattern", "set_accent_color"):
            name = {"set_output_folder": "output_folder", "set_naming_pattern": "naming_pattern", "set_accent_color": "accent_color"}[action]
            value = str(next((params[k] for k in (name, name.rpartition("_")[2], "folder", "path") if params.get(k)), ""))
            if value.strip():
                self.settings[name] = value
                self.kept.keep_settings(self.settings)
        elif action == "export":
            n = self.export(ids).count()
            message = f"Exported {n} file{'' if n == 1 else 's'}"
        elif action == "clear_all":
            self.clear()
        else:
            raise PlanError(f"no meta action {action}")
        return Result(self.view(), self.settings, message)
