"""One query for each operator, over the driver's tables standing in for catalogs, files and logs.

Catalog: part (name, brand as alias, type as category, input types by size). Usage:
events by user. Files: pages by URL, documents. Steps: lineitem and conversations.
Layers: customer and supplier. Trust: labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.functions import params, paths, permissions, text
from actionflow.operators import export, search, sequences
from actionflow.plans import catalog_queries, file_queries  # noqa: F401  they register themselves
from actionflow.plans.tables import QUERIES, query, table
from actionflow.sources import catalog as catalogs

AS_OF = "2024-01-31 00:00:00"
CATEGORY = {"ECONOMY": "convert", "STANDARD": "transform", "SMALL": "compress", "MEDIUM": "filter", "LARGE": "meta"}
def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    category = F.lit("")
    for k, v in CATEGORY.items():
        category = F.when(F.col("p_type") == k, v).otherwise(category)
    strings = lambda *a: F.array(*map(F.lit, a)).cast("array<string>")
    size = F.col("p_size") % 4
    types = F.when(size == 0, strings("*")).when(size == 1, strings(".png", ".jpg")).when(size == 2, strings()).otherwise(strings(".HEIC"))
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.lower("p_type").alias("description"), category.alias("category"), (category == "meta").alias("is_meta"), types.alias("input_types"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.usage_of(table(spark, sf_dir, "events").select(F.col("user_id").alias("skill_id"), F.col("ts").alias("used_at")))


def _path(url: str = "url"):
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "^https?:/", "")


@query
def search_ranked(spark, sf_dir):
    found = search.search(_catalog(spark, sf_dir), _usage(spark, sf_dir), "cold wiget", [".png"], _as_of(), search.SUGGESTIONS)
    return found.select("id", "name", F.round("score", 6).alias("score"))


@query
def search_empty_query(spark, sf_dir):
    return search.search(_catalog(spark, sf_dir), _usage(spark, sf_dir), " ", [], _as_of()).select("id", "name", F.round("score", 6).alias("score"))


@query
def search_with_types(spark, sf_dir):
    found = search.search(_catalog(spark, sf_dir), None, "brand#1", [".heic", ".PNG"], _as_of())
    return found.select("id", "name", F.round("score", 6).alias("score"))


@query
def fuzzy_score(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", F.round(text.fuzzy_score(F.col("name"), "small bolt"), 6).alias("score"), text.byte_distance(F.lower("name"), F.lit("small bolt")).cast("bigint").alias("distance"))


@query
def text_match(spark, sf_dir):
    return _catalog(spark, sf_dir).where(text.text_match(F.col("name"), F.col("aliases"), F.col("description"), "Hot wid")).select("id", "name")


@query
def input_match(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return c.select("id", text.input_match(F.col("input_types"), [".heic"]).alias("heic"), text.input_match(F.col("input_types"), [".Png", ".bmp"]).alias("png"), text.input_match(F.col("input_types"), []).alias("nothing"))


@query
def alias_match(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", text.alias_match(F.col("aliases"), " Brand#1 ").alias("matched"))


@query
def frecency(spark, sf_dir):
    return _usage(spark, sf_dir).select(F.col("skill_id").alias("id"), "count", "last_used", F.round(text.frecency(F.col("count"), F.col("last_used"), _as_of()), 6).alias("boost"))


@query
def usage_counts(spark, sf_dir):
    return search.usage_of(table(spark, sf_dir, "events").select(F.col("event_type").alias("skill_id"), F.col("ts").alias("used_at")))


@query
def layer_merge(spark, sf_dir):
    """Customers are two layers, suppliers the third; of each nation's the last name of the highest layer stays."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1).alias("layer"), F.col("c_name").alias("definition_path"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_nationkey").alias("id"), F.lit(2).alias("layer"), F.col("s_name").alias("definition_path"))
    return catalogs.last_wins(c.unionByName(s))


@query
def permission_normalize(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in ("tools.exec", "", "network", "files.read", "system", "tools.exec")])
    part = table(spark, sf_dir, "part")
    held = F.slice(names, 1, (F.col("p_size") % 6 + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.array_join(permissions.normalized(held), ",").alias("permissions"), F.array_join(permissions.elevated(held), ",").alias("elevated"), permissions.needs_trust(held).alias("needs_trust"))


@query
def file_identity(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _path().alias("path"))
    return p.select("page_id", paths.stem(F.col("path")).alias("name"), paths.extension(F.col("path")).alias("ext"), paths.parent(F.col("path")).alias("folder"))


@query
def distinct_types(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(paths.extension(_path()).alias("ext")).distinct()


ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


@query
def last_step(spark, sf_dir):
    return sequences.last_step(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", *ORDER)


@query
def remove_step(spark, sf_dir):
    steps = sequences.indexed(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return sequences.without_step(steps, "conv_id", 1).select("conv_id", "turn", "role", F.col("step_index").cast("bigint").alias("step_index"))


@query
def replay_fold(spark, sf_dir):
    sets = F.when(F.col("l_returnflag") == "A", ".png").when(F.col("l_returnflag") == "R", ".jpg").otherwise("")
    return sequences.folded_extensions(table(spark, sf_dir, "lineitem").withColumn("sets", sets), "l_orderkey", "sets", ".heic", *ORDER)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), "source", "n_chars")


@query
def selection_range(spark, sf_dir):
    return sequences.between_positions(_documents(spark, sf_dir), 120, 40).select("id", "source")


@query
def selection_invert(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return sequences.inverted(d, d.where("n_chars > 1000").select("id")).select("id", "n_chars")


@query
def selection_toggle(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return sequences.toggled(d.where("n_chars > 1000").select("id"), d.where("source = 'src0'").select("id"))


@query
def upsert_files(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("size"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("size"))
    return sequences.upserted(c, s)


@query
def export_name(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _path().alias("path"))
    action = F.when(F.col("page_id") % 3 == 0, "heic-to jpeg").when(F.col("page_id") % 3 == 1, "blur").otherwise("file")
    pattern = F.when(F.col("page_id") % 4 == 0, " ").when(F.col("page_id") % 4 == 1, "{name}").when(F.col("page_id") % 4 == 2, "{name}-{ext}").otherwise("{skill}.{ext}")
    return p.select("page_id", paths.export_name(pattern, paths.stem(F.col("path")), paths.extension(F.col("path")), action).alias("name"))


@query
def export_collision(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", _path().alias("path"))
    asked = p.select(F.regexp_extract("path", "^/([^/]*)", 1).alias("folder"), F.col("page_id").alias("position"), F.concat(F.regexp_extract("path", "/([a-z]+)/", 1), F.lit(".html")).alias("name"))
    there = asked.where("position % 100 = 0").select("folder", "name").distinct()
    return export.resolve(asked, there).select(F.col("position").alias("page_id"), "folder", "resolved")


@query
def output_ext(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "cli").otherwise("native")
    wanted = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "none").otherwise(".JPG")
    own = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 == 1, ".WAV").otherwise("WAV")
    return p.select(F.col("p_partkey").alias("id"), params.output_extension(wanted, kind, own, F.lit(".png")).alias("ext"))


def _props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.parse_json("props").alias("v"))


@query
def param_coerce(spark, sf_dir):
    k = params.number_or(F.variant_get("v", "$.k", "variant"), 90.0)
    return _props(spark, sf_dir).select("event_id", F.when(F.col("v").isNotNull(), k).alias("number"), params.jpeg_quality(k).alias("quality"), params.text_number_or(F.col("event_type"), 7.5).alias("fallback"))


@query
def param_merge(spark, sf_dir):
    e = _props(spark, sf_dir).withColumn("k", F.try_variant_get("v", "$.k", "string"))
    base = F.create_map(F.lit("q"), F.col("k"), F.lit("r"), F.lit("2"))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("q"), F.lit("5"))).otherwise(F.create_map(F.lit("s"), F.col("event_type")))
    out = params.merged(base, over)
    return e.select("event_id", *[F.element_at(out, x).alias(x) for x in ("q", "r", "s")], F.size(out).cast("bigint").alias("entries"))


@query
def template_render(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    given = F.create_map(F.lit("quality"), F.col("p_size").cast("string"), F.lit("name"), F.concat(F.col("p_brand"), F.lit("{{quality}}")))
    line = params.rendered(F.lit("{{input}} -q {{quality}} {{output}} {{name}} {{missing}}"), F.concat(F.lit("/in/"), F.col("p_name")), F.lit("/out"), given)
    return p.select(F.col("p_partkey").alias("id"), line.alias("line"))


@query
def resize_dims(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 13).cast("double").alias("w"), (F.col("p_partkey") % 30 - 3).cast("double").alias("percent"))
    side = lambda x: F.coalesce(params.resized(x, F.col("percent")), F.lit(-1))  # noqa: E731  -1: an error
    return p.select("id", side(F.col("w")).alias("width"), side(F.lit(3.0)).alias("height"))


@query
def color_parse(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    hexed = F.lpad(F.lower(F.hex((k * 31337).cast("bigint"))), 6, "0")
    given = F.when(k % 4 == 0, F.concat(F.lit("#"), hexed)).when(k % 4 == 1, F.concat(F.lit("#"), F.right(hexed, F.lit(3)))).when(k % 4 == 2, F.concat(F.lit("rgb("), k * 12, F.lit(", 2, 3)"))).otherwise(F.concat_ws(" ", k, k * 2, k * 3))
    rgb = params.colour(given)
    return n.select(F.col("n_nationkey").alias("id"), given.alias("given"), *[F.coalesce(rgb[c], F.lit(-1)).alias(c) for c in "rgb"], F.coalesce(params.darkened(rgb["r"], 0.85), F.lit(-1)).alias("dark"))


@query
def preset_cycle(spark, sf_dir):
    p, presets = table(spark, sf_dir, "part"), F.array(*[F.lit(x) for x in (90, 75, 50, 25)])
    return p.select(F.col("p_partkey").alias("id"), params.next_preset(presets, (F.col("p_size") * 5).cast("int")).alias("next"))


@query
def typed_entry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_size"), F.lit("px"))
    return p.select(F.col("p_partkey").alias("id"), *[params.typed(raw, F.lit(k)).alias(k) for k in ("int", "string")])


@query
def truncate_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.shortened(_path()).alias("short"))


@query
def snapshot_names(spark, sf_dir):
    steps = sequences.indexed(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return steps.select("conv_id", "turn", paths.snapshot_name(F.col("step_index"), F.lit(".png")).alias("name"))


@query
def action_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name"), F.concat(F.col("p_type"), F.lit("_"), F.col("p_size")).alias("action"))
    return p.select("id", paths.action_label(F.when(F.col("id") % 2 == 0, F.col("p_name")), F.col("action")).alias("label"), paths.plural(F.col("id") % 3, "file", "files").alias("message"))


@query
def copied_names(spark, sf_dir):
    return sequences.joined_lines(table(spark, sf_dir, "nation"), "n_name", "n_nationkey")


@query
def usage_stream(spark, sf_dir):
    from actionflow.streaming.usage import count_once

    return count_once(spark, f"{sf_dir}/events.parquet", "event_type", "ts")
