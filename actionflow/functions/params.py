"""Parameters of actions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number_or(value: Column, fallback: float) -> Column:
    """A variant as a number: numbers and numeric strings are taken, all else is the fallback."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(value, "$", "double")).when((kind == "STRING") & text.rlike(NUMBER), text.try_cast("double"))
    return F.coalesce(number, F.lit(float(fallback)))


def text_number_or(value: Column, fallback: float) -> Column:
    return F.coalesce(F.when(value.rlike(NUMBER), value.try_cast("double")), F.lit(float(fallback)))


def jpeg_quality(value: Column) -> Column:
    return F.greatest(F.lit(40), F.least(F.lit(100), value.cast("int")))


def resized(size: Column, percent: Column) -> Column:
    """A side at so many percent, 1 at least; percents of 0 and below are an error (null here)."""
    return F.when(percent > 0, F.greatest(F.lit(1.0), size * percent / F.lit(100.0)).cast("int"))


def output_extension(output_type: Column, executor_type: Column, executor_extension: Column, current: Column) -> Column:
    dotted = F.when(F.startswith(executor_extension, F.lit(".")), executor_extension).otherwise(F.concat(F.lit("."), executor_extension))
    tool = (F.lower(executor_type) == "cli") & (executor_extension != "")
    return F.when(~output_type.isin("", "none"), F.lower(output_type)).when(tool, F.lower(dotted)).otherwise(current)


def merged(base: Column, over: Column) -> Column:
    """Entries of both maps, those of ``over`` winning; null if both are empty."""
    kept = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(over, k), F.lit(False)))
    out = F.map_concat(kept, F.coalesce(over, F.create_map().cast("map<string,string>")))
    return F.when(F.size(out) > 0, out)


def rendered(template: Column, source: Column, target: Column, params: Column) -> Column:
    """{{input}} and {{output}}, then every {{parameter}} in the order of their names."""
    text = F.replace(F.replace(template, F.lit("{{input}}"), source), F.lit("{{output}}"), target)
    entries = F.array_sort(F.map_entries(params))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def colour(text: Column) -> Column:
    """struct<r,g,b> of #rgb, #rrggbb, rgb(r,g,b), "r,g,b" or "r g b"; null for anything else or over 255."""
    t = F.trim(text)
    short, long = r"^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", r"^#([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})$"
    listed = r"^(?:rgb\(\s*)?([0-9]{1,9})\s*[, ]\s*([0-9]{1,9})\s*[, ]\s*([0-9]{1,9})\s*\)?$"

    def part(k: int) -> Column:
        one = F.regexp_extract(t, short, k)
        return (
            F.when(t.rlike(short), F.conv(F.concat(one, one), 16, 10).cast("int"))
            .when(t.rlike(long), F.conv(F.regexp_extract(t, long, k), 16, 10).cast("int"))
            .when(t.rlike(listed), F.regexp_extract(t, listed, k).try_cast("int"))
        )

    r, g, b = part(1), part(2), part(3)
    return F.when(F.greatest(r, g, b) <= 255, F.struct(r.alias("r"), g.alias("g"), b.alias("b")))


def darkened(channel: Column, factor: float) -> Column:
    return F.floor(channel * F.lit(factor) + F.lit(0.5)).cast("int")


def preset_value(preset: Column) -> Column:
    """A preset (variant) is a plain value, or an object of value and label either of which may be missing."""
    return F.coalesce(F.try_variant_get(preset, "$.value", "string"), F.try_variant_get(preset, "$.label", "string"), F.try_variant_get(preset, "$", "string"))


def preset_label(preset: Column) -> Column:
    return F.coalesce(F.try_variant_get(preset, "$.label", "string"), F.try_variant_get(preset, "$.value", "string"), F.try_variant_get(preset, "$", "string"))


def next_preset(presets: Column, current: Column) -> Column:
    """The one after the current, cyclic; the first if it isn't among them."""
    return F.element_at(presets, (F.pmod(F.array_position(presets, current), F.size(presets)) + 1).cast("int"))


def typed(raw: Column, kind: Column) -> Column:
    """A raw entry as its parameter's type has it, as a string: whole numbers by their leading digits."""
    whole = F.regexp_extract(raw, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint").cast("string")
    real = F.regexp_extract(raw, r"^\s*([+-]?[0-9]+(?:[.][0-9]*)?|[+-]?[.][0-9]+)", 1).try_cast("double").cast("string")
    return F.when(kind == "int", whole).when(kind == "float", real).otherwise(raw)
