"""Text matching and ranking scores as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each part of a score is worth.
CATEGORY_BOOST = {"convert": 800.0, "transform": 700.0, "compress": 650.0, "filter": 600.0, "meta": 400.0}
META_BOOST, ALIAS_BOOST, INPUT_BOOST = 150.0, 500.0, 600.0
USE_WEIGHT, RECENT_BOOST, HALF_LIFE_DAYS = 400.0, 250.0, 14.0
EQUAL_SCORE, PREFIX_SCORE, CONTAINS_SCORE, DISTANCE_SCORE = 900.0, 700.0, 450.0, 400.0
TYPO_BYTES, TYPO_EDITS = 3, 2


def as_bytes(text: Column) -> Column:
    """Each UTF-8 byte as one character, so that edits and lengths count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(as_bytes(a), as_bytes(b))


def fuzzy_score(text: Column, query: str | Column) -> Column:
    q = F.lower(F.lit(query)) if isinstance(query, str) else F.lower(query)
    t = F.lower(text)
    longest = F.greatest(F.octet_length(t), F.octet_length(q))
    near = F.greatest(F.lit(0.0), 1 - byte_distance(t, q) / longest) * DISTANCE_SCORE
    return F.when((t == "") | (q == ""), 0.0).when(t == q, EQUAL_SCORE).when(F.startswith(t, q), PREFIX_SCORE).when(F.contains(t, q), CONTAINS_SCORE).otherwise(near)


def alias_match(aliases: Column, query: str) -> Column:
    q = query.strip().lower()
    return F.exists(aliases, lambda a: F.startswith(F.lower(a), F.lit(q))) if q else F.lit(False)


def text_match(name: Column, aliases: Column, description: Column, query: str) -> Column:
    """The text filter: cheapest tests first."""
    q = query.strip().lower()
    low = F.lower(name)
    found = F.contains(low, F.lit(q)) | F.exists(aliases, lambda a: F.contains(F.lower(a), F.lit(q))) | F.contains(F.lower(description), F.lit(q))
    for word in q.split():
        found = found | starts_a_word(low, word)
    if len(q.encode()) >= TYPO_BYTES:
        found = found | (F.levenshtein(as_bytes(low), as_bytes(F.lit(q)), TYPO_EDITS) >= 0)  # -1 beyond, told without the whole table
    return found


def starts_a_word(text: Column, word: str) -> Column:
    return F.exists(F.split(text, r"\s+"), lambda w: F.startswith(w, F.lit(word)))


def input_match(supported: Column, given: list[str] | Column) -> Column:
    """A declared type equals a given one, or is ``*``; nothing declared matches nothing given."""
    given = F.array(*[F.lit(g) for g in given]).cast("array<string>") if isinstance(given, list) else given
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    return F.when(F.size(supported) == 0, F.size(given) == 0).when(F.array_contains(supported, "*"), True).otherwise(F.arrays_overlap(low(supported), low(given)))


def frecency(count: Column, last_used: Column, as_of: Column) -> Column:
    """Uses, decayed by the age of the last one, and a bonus for a use of the last day. Null counts as never."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    age = F.greatest(F.lit(0.0), (micros(as_of) - micros(last_used)) / F.lit(86_400e6))
    boost = count * USE_WEIGHT * F.exp(F.lit(-math.log(2) / HALF_LIFE_DAYS) * age) + F.when(age < 1, RECENT_BOOST).otherwise(0.0)
    return F.when(F.coalesce(count, F.lit(0)) == 0, 0.0).otherwise(boost)


def category_boost(category: Column, is_meta: Column) -> Column:
    boost = F.lit(0.0)
    for name, value in CATEGORY_BOOST.items():
        boost = F.when(category == name, value).otherwise(boost)
    return boost + F.when(is_meta, META_BOOST).otherwise(0.0)


def total_score(row: dict[str, Column], query: str, given: list[str], as_of: Column) -> Column:
    """row: name, aliases, category, is_meta, input_types, count, last_used."""
    score = category_boost(row["category"], row["is_meta"])
    if query.strip():
        score = score + fuzzy_score(row["name"], query.strip()) + F.when(alias_match(row["aliases"], query), ALIAS_BOOST).otherwise(0.0)
    score = score + F.when(input_match(row["input_types"], given), INPUT_BOOST).otherwise(0.0)
    return score + frecency(row["count"], row["last_used"], as_of)
