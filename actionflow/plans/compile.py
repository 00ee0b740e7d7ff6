"""An action and its parameters to a flat, checked list of steps. Plain Python: the catalog has tens of rows."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionflow.functions.permissions import ALLOWED_TOOLS, ELEVATED

MAX_DEPTH = 6


class PlanError(ValueError):
    """The action can't be run as asked."""


@dataclass(frozen=True)
class Step:
    action: str
    driver: str
    params: dict[str, Any]
    output_type: str
    executor_type: str
    command: str = ""
    args: tuple[str, ...] = ()
    output_extension: str = ""
    timeout_ms: int = 0

    def next_extension(self, current: str) -> str:
        if self.output_type not in ("", "none"):
            return self.output_type.lower()
        if self.executor_type == "cli" and self.output_extension:
            ext = self.output_extension.lower()
            return ext if ext.startswith(".") else f".{ext}"
        return current


@dataclass
class Catalog:
    """Definitions by id, as ``from_rows`` takes them from the catalog table."""

    rows: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def from_rows(cls, catalog) -> Catalog:
        columns = ["id", "is_meta", "driver", "output_type", "executor", "permissions", "source"]
        chosen = catalog.selectExpr(*columns, "transform(params, p -> named_struct('name', p.name, 'type', p.type, 'default', cast(p.default AS string))) AS params").collect()
        return cls({r["id"]: r.asDict(recursive=True) for r in chosen})

    def get(self, action: str) -> dict:
        if action not in self.rows:
            raise PlanError(f"unknown action: {action}")
        return self.rows[action]


def merge_params(base: dict | None, over: dict | None) -> dict | None:
    return ({**(base or {}), **(over or {})}) or None


def _typed(kind: str, value: Any) -> Any:
    try:
        return int(float(value)) if kind == "int" else float(value) if kind == "float" else value
    except (TypeError, ValueError):
        return value


def with_defaults(definition: dict, params: dict | None) -> dict:
    own = {p["name"]: _typed(p["type"], p["default"]) for p in definition.get("params") or [] if p.get("default") is not None}
    return {**own, **(params or {})}


def typed_params(catalog: Catalog, action: str, params: dict[str, str]) -> dict[str, Any]:
    """Parameters kept as text, with the types the action declares; of others numbers become numbers."""
    kinds = {p["name"]: p["type"] for p in catalog.get(action).get("params") or []}

    def value(name: str, text: str) -> Any:
        if name in kinds:
            return _typed(kinds[name], text)
        try:
            return json.loads(text) if text not in ("NaN", "Infinity", "-Infinity") else text
        except (TypeError, ValueError):
            return text

    return {k: value(k, v) for k, v in params.items()}


def check_trust(definition: dict, trusted: frozenset[str]) -> None:
    risky = [p for p in definition.get("permissions") or [] if p in ELEVATED]
    if definition.get("source") == "community" and risky and definition["id"] not in trusted:
        raise PlanError(f"{definition['id']} needs a decision on {', '.join(sorted(risky))}")


def check_tool(definition: dict, tools: tuple[str, ...]) -> None:
    run, held = definition.get("executor") or {}, definition.get("permissions") or []
    command = (run.get("command") or "").strip()
    if not command:
        raise PlanError(f"{definition['id']}: no command")
    if "tools.exec" not in held and "tools.exec.any" not in held:
        raise PlanError(f"{definition['id']}: no permission to run tools")
    if definition.get("source") == "community" and "tools.exec.any" not in held and command.lower() not in tools:
        raise PlanError(f"{definition['id']}: {command} isn't an allowed tool")


def compile_action(catalog: Catalog, action: str, params: dict | None = None, trusted: frozenset[str] = frozenset(), tools: tuple[str, ...] = ALLOWED_TOOLS) -> list[Step]:
    """The steps in order. Given parameters reach every step; those of a step win over them; defaults fill what is left.

    Every step is checked: that it exists, is no meta action, isn't nested over six
    deep, is trusted if it has to be, and may run its tool.
    """
    steps: list[Step] = []

    def expand(name: str, given: dict | None, depth: int) -> None:
        d = catalog.get(name)
        if depth > MAX_DEPTH:
            raise PlanError(f"{action}: nested over {MAX_DEPTH} deep")
        if d["is_meta"]:
            raise PlanError(f"{name} is a meta action: it can't be applied to files")
        check_trust(d, trusted)
        run = d.get("executor") or {}
        kind = (run.get("type") or "").strip().lower()
        if kind == "pipeline":
            if not run.get("steps"):
                raise PlanError(f"{name}: a pipeline without steps")
            for s in run["steps"]:
                expand(s["skillId"], merge_params(given, s.get("params")), depth + 1)
            return
        if d["driver"] not in ("image", "cli"):
            raise PlanError(f"{name}: no driver {d['driver']!r}")
        if d["driver"] == "cli":
            check_tool(d, tools)
        steps.append(Step(name, d["driver"], with_defaults(d, given), d.get("output_type") or "", kind, run.get("command") or "", tuple(run.get("args") or ()), run.get("outputExtension") or "", run.get("timeoutMs") or 0))

    expand(action, params, 0)
    return steps


PLANNED = "id string, step int, action string, driver string, params map<string,string>, extension string, error string"


def compile_requests(requests: DataFrame, catalog: Catalog, trusted: frozenset[str] = frozenset()) -> DataFrame:
    """A row for each step of each request, or one with what is wrong with it.

    requests: id, action, params (map of text) and extension (of the file it is for).
    The catalog travels with the tasks; requests are gone through where they lie.
    """

    def work(frames):
        for frame in frames:
            rows = []
            for i, action, params, now in frame[["id", "action", "params", "extension"]].itertuples(index=False):
                try:
                    steps = compile_action(catalog, action, typed_params(catalog, action, dict(params or {})), trusted)
                except PlanError as e:
                    rows.append((i, -1, action, None, None, now, str(e)))
                    continue
                for k, (s, ext) in enumerate(zip(steps, extensions(steps, now)[1:], strict=True)):
                    rows.append((i, k, s.action, s.driver, {n: f"{v:g}" if isinstance(v, float) else str(v) for n, v in s.params.items()}, ext, None))
            yield pd.DataFrame(rows, columns=["id", "step", "action", "driver", "params", "extension", "error"])

    return requests.select(F.col("id").cast("string").alias("id"), "action", "params", "extension").mapInPandas(work, PLANNED)


def extensions(steps: list[Step], current: str) -> list[str]:
    out = [current]
    for s in steps:
        out.append(s.next_extension(out[-1]))
    return out
