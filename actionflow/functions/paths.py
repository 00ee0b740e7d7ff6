"""Paths and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PATTERN = "{name}_{skill}.{ext}"


def extension(path: Column) -> Column:
    """From the last dot of the last element, in lower case; a name that is all extension is one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column, strict: bool = False) -> Column:
    """Base name without its extension. strict: an extension in capitals stays, as the source application has it."""
    base, ext = base_name(path), extension(path)
    ends = F.endswith(base, ext) if strict else F.endswith(F.lower(base), ext)
    return F.when(ends, F.left(base, F.length(base) - F.length(ext))).otherwise(base)


def without_dot(ext: Column) -> Column:
    return F.regexp_replace(ext, r"^\.", "")


def export_name(pattern: Column, name: Column, ext: Column, action: Column) -> Column:
    """The placeholders in this order: a name that holds one is filled in too."""
    clean = F.replace(F.replace(action, F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    used = F.when(F.trim(pattern) == "", F.lit(DEFAULT_PATTERN)).otherwise(pattern)
    out = F.replace(used, F.lit("{name}"), name)
    out = F.replace(out, F.lit("{ext}"), without_dot(ext))
    out = F.replace(out, F.lit("{skill}"), clean)
    return F.when(F.contains(out, F.lit(".")), out).otherwise(F.concat(out, F.lit("."), without_dot(ext)))


def shortened(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("Same as original")).when(F.size(parts) <= 3, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(parts, -2, 2), "/")))


def snapshot_name(index: Column, ext: Column) -> Column:
    return F.concat(F.format_string("snapshot-%03d", index), ext)


def plural(count: Column, one: str, many: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, F.lit(one)).otherwise(F.lit(many)))


def data_url(png: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(png), r"[\r\n]", ""))


def action_label(name: Column, action_id: Column) -> Column:
    return F.coalesce(name, F.replace(action_id, F.lit("_"), F.lit(" ")))


def rfc3339(at: Column) -> Column:
    """Whole seconds, in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")


def workspace_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HHmmss")
