"""Queries for the catalog: loading, trust, tools, and compiling requests to steps."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.functions import permissions
from actionflow.operators import search
from actionflow.plans.compile import Catalog, compile_requests
from actionflow.plans.tables import query, shared_folder, table
from actionflow.sources import catalog as catalogs
from actionflow.sources import storage
from actionflow.sources.definitions import SHIPPED
from actionflow.streaming.reload import watch

# Definition files made of parts, as expressions that both engines read: some aren't definitions by name, some are broken.
PART_FILES = {
    "source": "CASE p_partkey % 3 WHEN 0 THEN 'core:embedded' WHEN 1 THEN 'core:disk' ELSE 'community' END",
    "layer": "CAST(p_partkey % 3 AS INT)",
    "file_name": "CASE p_partkey % 11 WHEN 0 THEN '_draft.json' WHEN 1 THEN '.hidden.json' WHEN 2 THEN 'Manifest.JSON' WHEN 3 THEN 'note.txt' ELSE concat(p_name, '.JSON') END",
}
PART_ID = "concat('a', CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS VARCHAR(20)))"
PART_PATH = "concat('/actions/', lpad(CAST(p_partkey AS VARCHAR(20)), 9, '0'), '/', file_name)"
PART_TEXT = (
    "CASE p_partkey % 13 WHEN 0 THEN '{\"id\": \"cut\", \"na' WHEN 1 THEN concat('{\"id\": \"', id, '\", \"name\": \"x\", \"version\": \"1\", \"dangerLevel\": \"high\"}') "
    "WHEN 2 THEN '{\"id\": \"  \", \"name\": \"x\", \"version\": \"1\"}' WHEN 3 THEN concat('{\"id\": \"', id, '\", \"version\": \"1\"}') WHEN 4 THEN concat('{\"id\": \"', id, '\", \"name\": \"x\"}') "
    "ELSE concat('{\"id\": \"', id, '\", \"name\": \"', p_name, '\", \"version\": \"1\", \"aliases\": [\"', p_brand, '\"], \"isMeta\": ', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, "
    "', \"executor\": {\"type\": \"', CASE p_size % 5 WHEN 0 THEN 'native' WHEN 1 THEN 'cli' WHEN 2 THEN 'Pipeline' WHEN 3 THEN 'meta' ELSE '' END, '\"}', "
    "CASE p_size % 3 WHEN 0 THEN ', \"permissions\": [\"tools.exec\", \"\", \"network\", \"tools.exec\"]' WHEN 1 THEN ', \"permissions\": []' ELSE '' END, '}') END"
)


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").selectExpr("*", f"{PART_ID} AS id", *[f"{e} AS {c}" for c, e in PART_FILES.items()])
    return named.selectExpr("source", "layer", f"{PART_PATH} AS definition_path", "file_name", f"{PART_TEXT} AS text")


@query
def definition_files(spark, sf_dir):
    """Which files are definitions, and which are worth a reload."""
    f = F.col("file_name")
    return _part_files(spark, sf_dir).select("definition_path", catalogs.is_definition(f).alias("is_definition"), catalogs.is_watched(f).alias("is_watched"))


@query
def catalog_load(spark, sf_dir):
    good, _ = catalogs.load_files(_part_files(spark, sf_dir))
    return good.select("id", "name", "source", "definition_path", "driver", "is_meta", F.array_join("permissions", ",").alias("permissions"), F.array_join("aliases", ",").alias("aliases"), F.size("input_types").alias("n_types"))


@query
def catalog_quarantine(spark, sf_dir):
    _, bad = catalogs.load_files(_part_files(spark, sf_dir))
    return bad.select("source", "definition_path", "error")


@query
def catalog_errors(spark, sf_dir):
    return catalogs.errors_line(catalogs.load_files(_part_files(spark, sf_dir))[1])


def _folder_of_definitions(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """Definition files of nations and regions in two layers, written to a folder; their roots, and one that isn't there."""
    base = shared_folder(spark, "definitions")
    for r in table(spark, sf_dir, "nation").collect():
        storage.put(f"{base}/core/{r.n_regionkey}/{r.n_nationkey:03d}.json", json.dumps({"id": r.n_name, "name": r.n_name, "version": "1", "executor": {"type": "native"}}).encode())
    for r in table(spark, sf_dir, "region").collect():
        own = {"id": f"NATION_{r.r_regionkey}", "name": r.r_name, "version": "2", "executor": {"type": "cli"}}
        storage.put(f"{base}/own/{r.r_regionkey}.json", json.dumps(own if r.r_regionkey else {"id": "x"}).encode())
        storage.put(f"{base}/own/_{r.r_regionkey}.json", json.dumps(own | {"id": "hidden"}).encode())
    return [("core:embedded", f"{base}/core"), ("core:disk", f"{base}/missing"), ("community", f"{base}/own")]


@query
def catalog_from_folders(spark, sf_dir):
    """Folders scanned recursively, layers laid over each other, a missing folder passed over."""
    good, _ = catalogs.load(spark, _folder_of_definitions(spark, sf_dir))
    return good.select("id", "name", "version", "driver", "source")


@query
def catalog_reloaded(spark, sf_dir):
    """The same through the stream that watches the folders: what its last reload gave."""
    roots = _folder_of_definitions(spark, sf_dir)
    path = shared_folder(spark, "reloaded")
    watch(spark, roots, lambda good, bad: good.select("id", "name", "version", "driver", "source").write.mode("overwrite").parquet(f"{path}/catalog"), f"{path}/progress", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/catalog")


def _trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("skill_id"))


@query
def trust_gate(spark, sf_dir):
    """Loaded actions that may not run before they are trusted."""
    good, _ = catalogs.load_files(_part_files(spark, sf_dir))
    return search.undecided(good, _trust(spark, sf_dir)).select("id", "definition_path")


@query
def trust_decisions(spark, sf_dir):
    good, _ = catalogs.load_files(_part_files(spark, sf_dir))
    return search.with_trust(good, _trust(spark, sf_dir)).select("id", "trusted", permissions.needs_decision(F.col("source"), F.col("permissions")).alias("asks"))


@query
def tool_gate(spark, sf_dir):
    strings = lambda *a: F.array(*map(F.lit, a)).cast("array<string>")
    size, key = F.col("p_size") % 6, F.col("p_partkey") % 4
    command = F.when(size == 0, "ffmpeg").when(size == 1, " Magick ").when(size == 2, "/bin/ffmpeg").when(size == 3, "").when(size == 4, "rm").otherwise("convert")
    held = F.when(key == 0, strings("tools.exec")).when(key == 1, strings()).when(key == 2, strings("tools.exec.any")).otherwise(strings("files.read", "tools.exec"))
    source = F.when(F.col("p_partkey") % 3 == 0, "community").otherwise("core:disk")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), permissions.tool_error(source, command, held).alias("error"), permissions.has(held, "tools.exec").alias("has_exec"))


def _own(id: str, kind: str, source: str = "community", **more) -> dict:
    run = {"type": kind} | more.pop("executor", {})
    return {"id": id, "name": id, "version": "1", "executor": run, "source": source} | more


def _chain(id: str, *steps: str | tuple[str, dict], source: str = "community") -> dict:
    return _own(id, "pipeline", source, executor={"steps": [{"skillId": s} if isinstance(s, str) else {"skillId": s[0], "params": s[1]} for s in steps]})


#: Besides the shipped actions: chains in chains, and everything that is refused.
OWN = [
    _chain("own_chain", ("resize", {"percent": "25"}), "inner_chain"), _chain("inner_chain", "grayscale", ("compress", {"quality": "55"})), _chain("lossy", ("inner_chain", {"quality": "66", "radius": "4"}), "convert_to_jpeg"),
    _chain("deep0", "grayscale"), *[_chain(f"deep{k}", f"deep{k - 1}") for k in range(1, 8)],
    _chain("with_meta", "resize", "export"), _chain("lost", "resize", "nowhere"), _chain("empty_chain"), _chain("hides", "blur", "risky"),
    _own("risky", "native", permissions=["network", "files.read"]), _own("trusted_net", "native", permissions=["network"]), _own("core_net", "native", "core:disk", permissions=["network"]),
    _own("own_tool", "cli", permissions=["tools.exec"], executor={"command": "FFmpeg", "outputExtension": "WAV"}), _own("path_tool", "cli", permissions=["tools.exec"], executor={"command": "/bin/ffmpeg"}), _own("poor_tool", "cli", permissions=["files.read"], executor={"command": "ffmpeg"}),
    _own("bare_tool", "cli", permissions=["tools.exec"]), _own("no_driver", "native", driver="sound"),
]
TRUSTED = frozenset(["trusted_net"])
ASKED = [*[d["id"] for d in SHIPPED], *[d["id"] for d in OWN], "missing"]


def known_actions(spark: SparkSession) -> Catalog:
    """The shipped actions and OWN, through the loader."""
    rows = [("core:embedded", 0, f"/core/{d['id']}.json", f"{d['id']}.json", json.dumps({"version": "1.0.0"} | d)) for d in SHIPPED]
    rows += [(d["source"], catalogs.LAYERS.index(d["source"]), f"/own/{d['id']}.json", f"{d['id']}.json", json.dumps({k: v for k, v in d.items() if k != "source"})) for d in OWN]
    return Catalog.from_rows(catalogs.load_files(spark.createDataFrame(rows, "source string, layer int, definition_path string, file_name string, text string"))[0])


@query
def compile_plans(spark, sf_dir):
    """A request for each order; all known actions are asked for in turn."""
    key = F.col("o_orderkey")
    action = F.element_at(F.array(*map(F.lit, ASKED)), (key % len(ASKED) + 1).cast("int"))
    given = F.when(key % 3 == 0, F.create_map().cast("map<string,string>")).when(key % 3 == 1, F.create_map(F.lit("quality"), (key % 60 + 40).cast("string"))).otherwise(F.create_map(F.lit("percent"), F.lit("50"), F.lit("radius"), F.lit("3")))
    asked = table(spark, sf_dir, "orders").select(key.alias("id"), action.alias("action"), given.alias("params"), F.when(key % 2 == 0, ".heic").otherwise(".png").alias("extension"))
    found = compile_requests(asked, known_actions(spark), TRUSTED)
    return found.select(F.col("id").cast("bigint").alias("id"), "step", "action", "driver", *[F.element_at("params", p).alias(p) for p in ("quality", "percent", "radius")], "extension", "error")
