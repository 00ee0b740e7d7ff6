"""Ranked search of the catalog: filter, score, order, best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actionflow.functions import permissions, text

SUGGESTIONS = 6


def usage_of(log: DataFrame) -> DataFrame:
    """(skill_id, count, last_used) of a log of uses (skill_id, used_at)."""
    return log.groupBy("skill_id").agg(F.count("*").alias("count"), F.max("used_at").alias("last_used"))


def candidates(catalog: DataFrame, query: str, given: list[str]) -> DataFrame:
    found = catalog
    if query.strip():
        found = found.where(text.text_match(F.col("name"), F.col("aliases"), F.col("description"), query))
    return found if not given else found.where(F.col("is_meta") | text.input_match(F.col("input_types"), given))


def scored(catalog: DataFrame, usage: DataFrame | None, query: str, given: list[str], as_of: Column | None = None) -> DataFrame:
    """Candidates with their score. catalog: id, name, aliases, description, category, is_meta, input_types."""
    found = candidates(catalog, query, given)
    if usage is None:
        met = found.withColumns({"count": F.lit(0).cast("bigint"), "last_used": F.lit(None).cast("timestamp")})
    else:
        met = found.join(usage.withColumnRenamed("skill_id", "id"), "id", "left")
    row = {c: F.col(c) for c in ("name", "aliases", "category", "is_meta", "input_types", "count", "last_used")}
    return met.withColumn("score", text.total_score(row, query, given, as_of if as_of is not None else F.current_timestamp())).drop("count", "last_used")


def search(catalog: DataFrame, usage: DataFrame | None, query: str = "", given: list[str] | None = None, as_of: Column | None = None, limit: int | None = None) -> DataFrame:
    """Best first; ties by name, then by id, so that the order is always the same."""
    ranked = scored(catalog, usage, query, given or [], as_of).orderBy(F.desc("score"), "name", "id")
    return ranked.limit(limit) if limit else ranked


def with_trust(catalog: DataFrame, trust: DataFrame) -> DataFrame:
    """The catalog with what has been decided on each action; no decision is no trust. trust: skill_id."""
    known = trust.select(F.col("skill_id").alias("id"), F.lit(True).alias("trusted")).distinct()
    return catalog.join(known, "id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def undecided(catalog: DataFrame, trust: DataFrame) -> DataFrame:
    """Actions that can't be run before they are trusted. catalog: id, source, permissions."""
    asked = catalog.where(permissions.needs_decision(F.col("source"), F.col("permissions")))
    return asked.join(trust.select(F.col("skill_id").alias("id")), "id", "left_anti")
