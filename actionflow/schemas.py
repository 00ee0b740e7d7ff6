"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

PARAM = "struct<name string, type string, label string, default variant, presets array<variant>, options array<string>, min double, max double, unit string>"
STEP = "struct<skillId string, params map<string,string>>"
EXECUTOR = f"struct<type string, handler string, command string, args array<string>, outputExtension string, timeoutMs int, script string, steps array<{STEP}>>"
DEFINITION = (
    "struct<version string, author string, id string, name string, aliases array<string>, category string, description string, inputTypes array<string>, "
    f"outputType string, params array<{PARAM}>, driver string, isMeta boolean, executor {EXECUTOR}, permissions array<string>, dangerLevel int>"
)

STEPS = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("step_index", T.IntegerType()), T.StructField("skill_id", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("applied_at", T.TimestampType()),
])
USES = "skill_id string, used_at timestamp"
USAGE = "skill_id string, count bigint, last_used timestamp"
SETTINGS = "output_folder string, naming_pattern string, accent_color string"
TRUST = "skill_id string"
SNAPSHOTS = "file_id string, step_index int, snapshot string, extension string"
FILES = "id string, position bigint, name string, extension string, current_extension string, original_path string, size bigint, preview string, snapshot string"
CONTENTS = "id string, snapshot string, content binary"
