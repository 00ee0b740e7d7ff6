"""Queries for files: selections and views, snapshots, rasters, and a session from adding files to exporting them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.functions import params, paths
from actionflow.operators import execute, export, images, sequences
from actionflow.operators.session import Session
from actionflow.plans.catalog_queries import known_actions
from actionflow.plans.compile import Catalog
from actionflow.plans.tables import query, shared_folder, table
from actionflow.sources import catalog as catalogs
from actionflow.sources import files as sources
from actionflow.sources import storage
from actionflow.sources.definitions import write_shipped
from actionflow.sources.images import dropped_files, read_rasters


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), F.col("source").alias("name"), F.lit(".txt").alias("current_extension"), F.col("n_chars").alias("size"), F.col("text").alias("content"), F.col("text").alias("snapshot"))


@query
def mode_targets(spark, sf_dir):
    """What an action is for with a selection, with an active file only, and with neither."""
    d = _documents(spark, sf_dir)
    some, none = d.where("size > 3000").select("id"), d.where("size < 0").select("id")
    cases = {"selected": (some, "per_file", 5), "active": (none, "per_file", 5), "batch": (none, "batch", 5), "all": (none, "per_file", None)}
    found = [sequences.targets(d, s, mode, active).select(F.lit(name).alias("rule"), "id") for name, (s, mode, active) in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query
def selection_counts(spark, sf_dir):
    d = _documents(spark, sf_dir)
    some, none = d.where("size > 3000").select("id"), d.where("size < 0").select("id")
    cases = {"selected": (some, 5), "active": (none, 5), "nothing": (none, None)}
    found = [sequences.selection_count(s, active).select(F.lit(name).alias("rule"), "selected") for name, (s, active) in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def public_view(spark, sf_dir):
    return sequences.public_view(_documents(spark, sf_dir))


@query
def files_by_id(spark, sf_dir):
    d = _documents(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return sequences.targets(d, wanted, "batch").select("id", "position", F.col("name").alias("source"))


@query
def files_appended(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"))
    return sequences.appended(c, s)


@query
def files_removed(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return sequences.inverted(d, table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))).select("id", "position")


@query
def first_error(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    error = F.when(F.contains("url", F.lit("?")), F.concat(F.lit("no codec for "), F.col("url")))
    return execute.first_error(p.select(F.col("page_id").alias("position"), error.alias("error")))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = sequences.indexed(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select("conv_id", "step_index", paths.snapshot_name(F.col("step_index"), F.lit(".png")).alias("snapshot"))


@query
def previous_step(spark, sf_dir):
    """Where runs again from each conversation's third step on start."""
    return sequences.previous_snapshot(_snapshots(spark, sf_dir), "conv_id", F.lit(2)).select("conv_id", "start_from", "step_index")


@query
def snapshot_list(spark, sf_dir):
    """Second snapshots lost, those from the fifth on cut off, the first and a sixth put in anew, gaps filled."""
    s = _snapshots(spark, sf_dir).where("step_index != 1")
    ids = s.where("step_index = 0").select("conv_id")
    new = ids.select("conv_id", F.lit(0).alias("step_index"), F.lit("again.png").alias("snapshot")).unionByName(ids.where("conv_id % 2 = 0").select("conv_id", F.lit(5).alias("step_index"), F.lit("late.png").alias("snapshot")))
    return sequences.gaps_filled(sequences.with_snapshot(sequences.truncated(s, F.lit(4)), new, "conv_id"), "conv_id").select("conv_id", "step_index", "snapshot")


@query
def timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", paths.rfc3339(F.col("ts")).alias("applied_at"), paths.workspace_stamp(F.col("ts")).alias("workspace"))


@query
def preset_labels(spark, sf_dir):
    """Presets as objects with a value, a label or both, and as plain values."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 4
    text = lambda *parts: F.parse_json(F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts]))
    preset = F.when(kind == 0, text('{"label": "L', "$event_type", '", "value": "V', "$event_type", '"}')).when(kind == 1, text('{"value": "V', "$event_type", '"}')).when(kind == 2, text('{"label": "L', "$event_type", '"}')).otherwise(text('"', "$event_type", '"'))
    return e.select("event_id", params.preset_value(preset).alias("value"), params.preset_label(preset).alias("label"))


@query
def data_urls(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.data_url(F.encode("text", "UTF-8")).alias("url"))


@query
def export_plan(spark, sf_dir):
    """Where each page is to be exported, named after the last step of the conversation of its number."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?:/", "")
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("page_id").alias("position"), path.alias("original_path"))
    files = p.select("id", "position", "original_path", paths.stem(F.col("original_path")).alias("name"), paths.extension(F.col("original_path")).alias("current_extension"))
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("step_index"), F.col("role").alias("skill_id"))
    return export.planned(files, steps, "{name}_{skill}.{ext}")


@query
def exported_message(spark, sf_dir):
    d = _documents(spark, sf_dir).where("size > 3000")
    return d.agg(F.concat(F.lit("Exported "), paths.plural(F.count("*"), "file", "files")).alias("message"))


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.raster_files(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")))


def _link(action: str, **given: str):
    pairs = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(action).alias("skill_id"), pairs.alias("params"))


@query
def raster_thumbnails(spark, sf_dir):
    """Embeddings as 8 by 8 rasters: sizes, sums of the channels, of grey, and their previews' first characters."""
    found = images.raster_report(_rasters(spark, sf_dir))
    return found.select(F.col("id").cast("bigint").alias("id"), "width", "height", "half_width", "half_height", "sum", "grey_sum", F.left("preview", F.lit(30)).alias("preview"))


@query
def apply_rasters(spark, sf_dir):
    """Every raster through one of seven chains; each seventh file is broken."""
    kind = F.col("position") % 6
    chains = [
        [_link("compress", quality="60")], [_link("grayscale"), _link("convert_to_png")], [_link("resize", percent="50"), _link("blur", radius="1.5")], [_link("convert_to_jpeg", quality="80"), _link("resize", percent="300")],
        [_link("deep6")], [_link("own_chain")],
    ]
    chain = F.array(*chains[5])
    for k in range(5):
        chain = F.when(kind == k, F.array(*chains[k])).otherwise(chain)
    files = _rasters(spark, sf_dir).withColumn("content", F.when(F.col("position") % 7 == 0, F.lit(b"xx")).otherwise(F.col("content"))).withColumn("chain", chain)
    done = execute.apply_chains(files, known_actions(spark))
    seen = execute.measured(done)
    exact = F.col("position") % 6 <= 1
    met = done.select("id", "position", F.col("error").isNotNull().alias("failed"), F.col("preview").isNotNull().alias("shown")).join(seen, "id")
    known = lambda c: F.coalesce(c, F.lit(-1))  # noqa: E731  -1: can't be read, or a sum that rounding decides
    return met.select("position", "current_extension", "failed", "shown", known("width").alias("width"), known("height").alias("height"), known(F.when(exact, F.col("sum"))).alias("sum"))


@query
def replay_rasters(spark, sf_dir):
    """Four steps for every raster; one of them is taken out of its log and the rest run again."""
    files = _rasters(spark, sf_dir)
    given = [("resize", {"percent": "50"}), ("grayscale", {}), ("convert_to_jpeg", {"quality": "90"}), ("resize", {"percent": "200"})]
    log = F.array(*[F.struct(F.lit(k).alias("step_index"), _link(a, **p).alias("l")) for k, (a, p) in enumerate(given)])
    steps = files.select(F.col("id").alias("file_id"), "position", F.explode(log).alias("s")).select("file_id", "position", "s.step_index", "s.l.skill_id", "s.l.params")
    gone = F.col("position") % 4
    kept = steps.where(F.col("step_index") != gone).withColumn("step_index", F.when(F.col("step_index") > gone, F.col("step_index") - 1).otherwise(F.col("step_index")))
    chained = files.join(sequences.chains(kept).withColumnRenamed("file_id", "id"), "id")
    seen = execute.measured(execute.apply_chains(chained, known_actions(spark)))
    return chained.select("id", F.size("chain").alias("steps")).join(seen, "id").select(F.col("id").cast("bigint").alias("id"), "steps", "current_extension", "width", "height")


@query
def export_files(spark, sf_dir):
    """Nations written as files named after their region, and read back."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").cast("bigint").alias("position"), F.col("r_name").alias("name"), F.lit(".txt").alias("current_extension"), F.lit("/x/y.txt").alias("original_path"), F.encode("n_name", "UTF-8").alias("content"))
    steps = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("file_id"), F.lit(0).alias("step_index"), F.lit("up-case").alias("skill_id"))
    folder = shared_folder(spark, "exported")
    storage.put(f"{folder}/ASIA_file.txt", b"was here")
    export.export(files, steps, "", folder).write.format("noop").mode("overwrite").save()
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.decode("content", "UTF-8").alias("content"))


@query
def kept_trust(spark, sf_dir):
    """Decisions stored and read back, the last one counting."""
    kept = sources.Kept(spark, shared_folder(spark, "kept"))
    names = {r.n_name: r.n_regionkey for r in table(spark, sf_dir, "nation").collect()}
    kept.keep_trusted(set(names))
    kept.keep_trusted({n for n in kept.trusted() if names[n] == 1})
    kept.keep_settings(kept.settings() | {"accent_color": "1,2,3"})
    return spark.createDataFrame([(n, kept.settings()["accent_color"], kept.settings()["naming_pattern"]) for n in sorted(kept.trusted())], "skill_id string, accent_color string, naming_pattern string")


@query
def session_flow(spark, sf_dir):
    """A file for each region: added, resized, the active one in grey, a step taken out, all exported."""
    base = shared_folder(spark, "session")
    regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    for r in regions:
        storage.put(f"{base}/in/{r.r_name}.png", images.encode_png(np.full((8, 12, 3), 40 * r.r_regionkey, np.uint8)))
    core = write_shipped(f"{base}/core")
    s = Session(spark, catalogs.load(spark, [("core:embedded", core)])[0], f"{base}/tables")
    added = s.add_files([f"{base}/in/{r.r_name}.png" for r in regions] + [f"{base}/in/missing.png"]).collect()
    s.apply(None, "resize", {"percent": 50})
    s.apply(None, "switch_to_per_file")
    s.set_active(added[1].id)
    s.apply(None, "grayscale")
    s.apply([added[2].id], "convert_to_jpeg", {"quality": 80})
    s.remove_step(added[1].id, 0)
    s.apply(None, "set_naming_pattern", {"pattern": "{name}-{skill}.{ext}"})
    s.apply(None, "set_output_folder", {"folder": f"{base}/out"})
    s.remove_files([added[4].id])
    s.apply(None, "export")
    out = spark.read.format("binaryFile").load(f"{base}/out").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")
    seen = execute.measured(out.select(F.col("file").alias("id"), "content", paths.extension(F.col("file")).alias("current_extension")))
    uses = {r.skill_id: r["count"] for r in s.usage().collect()}
    return seen.select(F.col("id").alias("file"), "width", "height", F.lit(sum(uses.values())).alias("uses"), F.lit(s.snapshots.count()).alias("snapshots"))


@query
def drop_folder(spark, sf_dir):
    """Files put into a folder, in two goes, as the stream over it gives them."""
    base = shared_folder(spark, "dropped")
    for half in (0, 1):
        for r in table(spark, sf_dir, "nation").where(F.col("n_regionkey") % 2 == half).collect():
            storage.put(f"{base}/in/{r.n_regionkey}/{r.n_name}.txt", r.n_name.encode())
        stream = dropped_files(spark, f"{base}/in").writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).format("parquet").option("path", f"{base}/out")
        stream.start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "length", F.decode("content", "UTF-8").alias("content"))


@query
def decoded_rasters(spark, sf_dir):
    """Raster files of every kind through Spark's decoder; one of them isn't what its name says."""
    base = shared_folder(spark, "rasters")
    for r in table(spark, sf_dir, "region").collect():
        pixels = np.full((3 + r.r_regionkey, 7, 3), 50 * r.r_regionkey, np.uint8)
        for ext in (".png", ".bmp", ".gif", ".tif"):
            storage.put(f"{base}/{r.r_regionkey}{ext}", images.encode_png(pixels) if ext == ".png" else execute.WRITERS[ext](pixels))
    storage.put(f"{base}/broken.png", b"xx")
    read = read_rasters(spark, base)
    return read.select(F.regexp_extract("origin", "([^/]*)$", 1).alias("file"), "width", "height")


@query
def tool_runs(spark, sf_dir):
    """An external tool for each file: one that works, one that fails, one that isn't there, one that takes too long."""
    commands = {"copies": ("cp", ["{{input}}", "{{output}}"]), "fails": ("ls", ["/no/such/place"]), "missing": ("no-such-tool", []), "sleeps": ("sleep", ["{{seconds}}"])}
    known = Catalog({n: {"id": n, "is_meta": False, "driver": "cli", "output_type": "", "source": "core:embedded", "permissions": ["tools.exec"], "params": [], "executor": {"type": "cli", "command": c, "args": a, "outputExtension": "OUT", "timeoutMs": 300}} for n, (c, a) in commands.items()})
    key, names = F.col("n_nationkey"), list(commands)
    action = F.element_at(F.array(*map(F.lit, names)), (key % 4 + 1).cast("int"))
    link = F.struct(action.alias("skill_id"), F.create_map(F.lit("seconds"), F.lit("20")).alias("params"))
    files = table(spark, sf_dir, "nation").select(key.cast("string").alias("id"), key.cast("bigint").alias("position"), F.encode("n_name", "UTF-8").alias("content"), F.lit(".txt").alias("current_extension"), F.array(link).alias("chain"))
    done = execute.apply_chains(files, known)
    return done.select("position", F.decode("content", "UTF-8").alias("content"), "current_extension", F.coalesce(F.regexp_extract("error", "(took more|started|No such)", 1), F.lit("")).alias("why"))
