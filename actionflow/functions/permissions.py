"""Permissions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The permission model.
BASE = ("files.read", "files.write", "files.temp", "tools.exec")
ELEVATED = ("files.anywhere", "network", "tools.exec.any", "system")
ALLOWED_TOOLS = ("ffmpeg", "magick", "convert", "identify")


def normalized(permissions: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(permissions, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != ""))))


def elevated(permissions: Column) -> Column:
    return F.filter(normalized(permissions), lambda p: p.isin(*ELEVATED))


def needs_trust(permissions: Column) -> Column:
    return F.size(elevated(permissions)) > 0


def has(permissions: Column, wanted: str) -> Column:
    return F.array_contains(permissions, wanted)


def tool_allowed(command: Column, tools: tuple[str, ...] = ALLOWED_TOOLS) -> Column:
    """A bare name on the list; a path to a tool of that name isn't."""
    return F.lower(command).isin(*tools)


def needs_decision(source: Column, permissions: Column) -> Column:
    """A community action with an elevated permission runs only once it is trusted."""
    return (source == "community") & needs_trust(permissions)


def tool_error(source: Column, command: Column, permissions: Column, tools: tuple[str, ...] = ALLOWED_TOOLS) -> Column:
    """Why an action may not run its tool; null if it may."""
    name = F.trim(F.coalesce(command, F.lit("")))
    any_tool = has(permissions, "tools.exec.any")
    return (
        F.when(name == "", "no command")
        .when(~has(permissions, "tools.exec") & ~any_tool, "no permission to run tools")
        .when((source == "community") & ~any_tool & ~tool_allowed(name, tools), "not an allowed tool")
    )
