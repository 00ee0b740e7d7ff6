"""Applying compiled steps to files: one pass over the rows, each with a status of its own."""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionflow.functions.paths import data_url
from actionflow.operators import codecs, images, jpeg
from actionflow.plans.compile import Catalog, Step, compile_action, typed_params

READERS = {".png": images.decode_png, ".jpg": jpeg.decode, ".jpeg": jpeg.decode, ".gif": codecs.decode_gif, ".bmp": codecs.decode_bmp, ".tif": codecs.decode_tiff, ".tiff": codecs.decode_tiff}
WRITERS = {".gif": codecs.encode_gif, ".bmp": codecs.encode_bmp, ".tif": codecs.encode_tiff, ".tiff": codecs.encode_tiff}  # PNG and JPEG have settings
QUALITY_FALLBACK = 90.0


class Driver(Protocol):
    def run(self, content: bytes, current: str, step: Step, extension: str) -> bytes: ...


def number(params: dict, name: str, fallback: float) -> float:
    value = params.get(name, fallback)
    if isinstance(value, bool):
        return fallback
    try:
        return float(value)
    except (TypeError, ValueError):
        return fallback


class ImageDriver:
    """The shipped native actions on the bytes of all raster types they declare."""

    def run(self, content: bytes, current: str, step: Step, extension: str) -> bytes:
        if current not in READERS or extension not in READERS:
            raise images.Unsupported(f"no codec for {current} to {extension}")
        pixels = READERS[current](content)
        if step.action == "resize":
            pixels = images.resize_percent(pixels, number(step.params, "percent", 100))
        elif step.action == "grayscale":
            pixels = images.grayscale(pixels)
        elif step.action == "blur":
            pixels = images.blur(pixels, number(step.params, "radius", 2.0))
        elif step.action not in ("compress", "convert_to_png", "convert_to_jpeg"):
            raise ValueError(f"no native action {step.action}")
        if extension in WRITERS:
            return WRITERS[extension](pixels)
        if extension == ".png":
            return images.encode_png(pixels, 9 if step.action == "compress" else 6)
        return jpeg.encode(pixels, int(min(100, max(40, number(step.params, "quality", QUALITY_FALLBACK)))))


def render(template: str, source: str, target: str, params: dict) -> str:
    text = template.replace("{{input}}", source).replace("{{output}}", target)
    for name in sorted(params):
        value = params[name]
        text = text.replace("{{" + name + "}}", f"{value:g}" if isinstance(value, float) else str(value))
    return text


class ToolDriver:
    """An external tool for each file, never through a shell."""

    def run(self, content: bytes, current: str, step: Step, extension: str) -> bytes:
        with tempfile.TemporaryDirectory() as folder:
            source, target = os.path.join(folder, f"in{current}"), os.path.join(folder, f"out{extension}")
            with open(source, "wb") as f:
                f.write(content)
            args = [step.command, *(render(a, source, target, step.params) for a in step.args)]
            try:
                done = subprocess.run(args, capture_output=True, timeout=step.timeout_ms / 1000 or None)
            except subprocess.TimeoutExpired:
                raise RuntimeError(f"{step.command} took more than {step.timeout_ms} ms") from None
            except OSError as e:
                raise RuntimeError(f"{step.command} can't be started: {e.strerror}") from None
            if done.returncode:
                said = (done.stderr or done.stdout or b"").decode(errors="replace").strip()
                raise RuntimeError(said or f"{step.command} ended with {done.returncode}")
            with open(target, "rb") as f:
                return f.read()


DRIVERS: dict[str, Driver] = {"image": ImageDriver(), "cli": ToolDriver()}


def run_steps(content: bytes, current: str, steps: list[Step]) -> tuple[bytes, str]:
    for step in steps:
        extension = step.next_extension(current)
        content = DRIVERS[step.driver].run(content, current, step, extension)
        current = extension
    return content, current


RESULT = "id string, position bigint, content binary, current_extension string, size bigint, preview string, error string"
RAW = "id string, position bigint, content binary, current_extension string, size bigint, preview binary, error string"
CHAIN = "array<struct<skill_id:string,params:map<string,string>>>"


def _applied(files: DataFrame, column: str | None, steps_of: Callable[[Any], list[Step]], batch_rows: int) -> DataFrame:
    """A row for each file with its new content, or its old one and what went wrong."""
    names = ["id", "position", "content", "current_extension", *([column] if column else [])]

    def work(frames):
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                rows = []
                for i, position, content, current, *more in frame.iloc[at : at + batch_rows][names].itertuples(index=False):
                    shown = error = None
                    content = bytes(content)
                    try:
                        content, current = run_steps(content, current, steps_of(more[0] if more else i))
                    except Exception as e:  # whatever it is, it is this file's
                        error = f"{type(e).__name__}: {e}"
                    try:
                        shown = images.preview(READERS[current](content))
                    except Exception:
                        shown = None  # no stale preview stays
                    rows.append((i, position, content, current, len(content), shown, error))
                yield pd.DataFrame(rows, columns=["id", "position", "content", "current_extension", "size", "preview", "error"])

    return files.select(*names).mapInPandas(work, RAW).withColumn("preview", data_url(F.col("preview")))


def apply_steps(files: DataFrame, steps: list[Step], batch_rows: int = 16) -> DataFrame:
    """The same steps for all files. files: id, position, content, current_extension.

    Every file keeps its place; an error is that file's alone and leaves its content as it was.
    """
    return _applied(files, None, lambda _: steps, batch_rows)


def apply_chains(files: DataFrame, catalog: Catalog, trusted: frozenset[str] = frozenset(), batch_rows: int = 16) -> DataFrame:
    """Each file's own ``chain`` (CHAIN), compiled where it is run; an action that can't be compiled is that file's error.

    What differs by file travels with the file, so any number of files has chains of its own.
    """

    def steps_of(chain) -> list[Step]:
        return [s for link in (chain if chain is not None else []) for s in compile_action(catalog, link["skill_id"], typed_params(catalog, link["skill_id"], dict(link["params"] or {})), trusted)]

    return _applied(files, "chain", steps_of, batch_rows)


def first_error(results: DataFrame) -> DataFrame:
    """One row: the error of the first file in order that failed, null if none did."""
    return results.where("error IS NOT NULL").agg(F.min_by("error", "position").alias("error"))


def measured(files: DataFrame) -> DataFrame:
    """id, current_extension, width, height and sum of the three colour channels; null where a file can't be read."""

    def work(frames):
        for frame in frames:
            rows = []
            for i, content, current in frame[["id", "content", "current_extension"]].itertuples(index=False):
                try:
                    p = READERS[current](bytes(content))
                    rows.append((i, current, p.shape[1], p.shape[0], int(p[:, :, :3].astype(int).sum())))
                except Exception:  # no codec, or not what its name says
                    rows.append((i, current, None, None, None))
            yield pd.DataFrame(rows, columns=["id", "current_extension", "width", "height", "sum"]).astype({c: "Int64" for c in ("width", "height", "sum")})

    return files.select("id", "content", "current_extension").mapInPandas(work, "id string, current_extension string, width int, height int, sum bigint")
