"""Rasters: PNG in and out, and the kernels of the shipped image actions, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionflow.functions.paths import data_url

PREVIEW_WIDTH = 520
LANCZOS = 3
LUMA = np.array([299, 587, 114])  # Rec. 601, in thousandths: ties are the same everywhere


class Unsupported(ValueError):
    """No codec here for that kind of file."""


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """pixels: (height, width) grey or (height, width, 3 or 4), 8 bit."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    kind = 0 if pixels.ndim == 2 else {3: 2, 4: 6}[pixels.shape[2]]
    height, width = pixels.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, n: int) -> np.ndarray:
    """Scan lines without their filters. rows: a filter byte and the bytes of each line; n: bytes of a pixel.

    A byte needs those to its left, above and between; all on one diagonal are worked out together.
    """
    height, width = rows.shape[0], (rows.shape[1] - 1) // n
    how, raw = rows[:, 0], rows[:, 1:].reshape(height, width, n).astype(np.int64)
    if (how == 0).all():
        return rows[:, 1:]
    out = np.zeros((height + 1, width + 1, n), np.int64)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], how[y, None]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, width * n)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 4) of 8 bits; of 16-bit samples the high byte."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unsupported("not a PNG")
    at, body, palette, alpha = 8, [], None, b""
    width = height = depth = kind = lace = 0
    while at < len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif tag == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif tag == b"tRNS":
            alpha = part
        elif tag == b"IDAT":
            body.append(part)
        at += size + 12
    if kind not in (0, 2, 3, 4, 6) or depth not in (1, 2, 4, 8, 16):
        raise Unsupported("a PNG of another kind")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw, used = zlib.decompress(b"".join(body)), 0
    pixels = np.zeros((height, width, n), np.uint16)
    # First row and column, and steps, of the interlaced passes.
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)] if lace else [(0, 0, 1, 1)]
    for top, left, down, across in passes:
        h, w = -(-(height - top) // down), -(-(width - left) // across)
        if h <= 0 or w <= 0:
            continue
        stride = (w * n * depth + 7) // 8
        rows = np.frombuffer(raw, np.uint8, h * (stride + 1), used).reshape(h, stride + 1)
        used += rows.size
        lines = np.ascontiguousarray(_unfiltered(rows, max(1, n * depth // 8)))
        if depth == 16:
            samples = lines.view(">u2").reshape(h, w, n)
        elif depth == 8:
            samples = lines.reshape(h, w, n)
        else:
            samples = (np.unpackbits(lines, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth - 1, -1, -1)))[:, :w, None]
        pixels[top::down, left::across] = samples
    full = np.full((height, width, 4), 255, np.uint8)
    if kind == 3:
        full[:, :, :3] = palette[pixels[:, :, 0]]
        see = np.full(len(palette), 255, np.uint8)
        see[: len(alpha)] = np.frombuffer(alpha, np.uint8)
        full[:, :, 3] = see[pixels[:, :, 0]]
        return full
    eight = pixels >> 8 if depth == 16 else pixels * (255 // ((1 << depth) - 1))
    full[:, :, :3] = eight[:, :, : (3 if n >= 3 else 1)]
    if n in (2, 4):
        full[:, :, 3] = eight[:, :, -1]
    elif alpha:  # one colour is transparent
        full[(pixels == np.frombuffer(alpha, ">u2")[:n]).all(axis=2), 3] = 0
    return full


def _weights(source: int, target: int) -> np.ndarray:
    """Rows of Lanczos weights: each target sample from the source samples around it."""
    scale = source / target
    width = max(1.0, scale)
    centre = (np.arange(target) + 0.5) * scale - 0.5
    x = (np.arange(source)[None] - centre[:, None]) / width
    w = np.where(np.abs(x) < LANCZOS, np.sinc(x) * np.sinc(x / LANCZOS), 0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    if (height, width) == pixels.shape[:2]:
        return pixels
    out = np.einsum("yh,hwc->ywc", _weights(pixels.shape[0], height), pixels.astype(float))
    out = np.einsum("xw,ywc->yxc", _weights(pixels.shape[1], width), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def resize_percent(pixels: np.ndarray, percent: float) -> np.ndarray:
    if percent <= 0:
        raise ValueError("percent must be over 0")
    height, width = pixels.shape[:2]
    return resize(pixels, int(max(1.0, width * percent / 100)), int(max(1.0, height * percent / 100)))


def grayscale(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[:, :, :3] = ((pixels[:, :, :3].astype(np.int64) @ LUMA + 500) // 1000)[:, :, None]
    return out


def blur(pixels: np.ndarray, sigma: float) -> np.ndarray:
    """A truncated Gaussian, renormalised at the borders."""
    if sigma <= 0:
        return pixels
    out = pixels.astype(float)
    for axis in (0, 1):
        n = pixels.shape[axis]
        d = np.arange(n)[:, None] - np.arange(n)[None]
        w = np.where(np.abs(d) <= np.ceil(3 * sigma), np.exp(-(d**2) / (2 * sigma**2)), 0)
        w /= w.sum(axis=1, keepdims=True)
        out = np.moveaxis(np.tensordot(w, out, (1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preview(pixels: np.ndarray) -> bytes:
    """A PNG of 520 columns at most, its shape kept."""
    height, width = pixels.shape[:2]
    if width > PREVIEW_WIDTH:
        pixels = resize(pixels, PREVIEW_WIDTH, max(1, round(height * PREVIEW_WIDTH / width)))
    return encode_png(pixels)


def raster_of(values: np.ndarray) -> bytes:
    """64 numbers as an 8 by 8 PNG: scaled to 0 to 255, turned, and inverted in its three channels."""
    v = np.asarray(values, float)[:64]
    grey = np.clip(np.rint((v - v.min()) / max(np.ptp(v), 1e-9) * 255), 0, 255).astype(np.uint8).reshape(8, 8)
    return encode_png(np.stack([grey, grey.T, 255 - grey], 2))


def raster_files(vectors: DataFrame) -> DataFrame:
    """Files (id, position, content, current_extension, extension) of rasters. vectors: id, values (64 numbers)."""

    def work(frames):
        for frame in frames:
            yield pd.DataFrame({"position": frame["id"].astype("int64"), "content": [raster_of(v) for v in frame["values"]]})

    made = vectors.mapInPandas(work, "position bigint, content binary")
    return made.select(F.col("position").cast("string").alias("id"), "position", "content", F.lit(".png").alias("current_extension"), F.lit(".png").alias("extension"))


def raster_report(files: DataFrame) -> DataFrame:
    """id, size of a raster and of its half, what its channels sum up to as it is, in grey and blurred, and its preview."""

    def work(frames):
        for frame in frames:
            rows = []
            for i, png in zip(frame["id"], frame["content"], strict=True):
                pixels = decode_png(bytes(png))
                half, soft = resize_percent(pixels, 50), blur(pixels, 1.5)
                total = lambda p: int(p[:, :, :3].astype(int).sum())
                rows.append((i, *pixels.shape[1::-1], *half.shape[1::-1], total(pixels), int(grayscale(pixels)[:, :, 0].astype(int).sum()), total(soft), preview(pixels)))
            yield pd.DataFrame(rows, columns=["id", "width", "height", "half_width", "half_height", "sum", "grey_sum", "soft_sum", "png"])

    found = files.mapInPandas(work, "id string, width int, height int, half_width int, half_height int, sum bigint, grey_sum bigint, soft_sum bigint, png binary")
    return found.withColumn("preview", data_url(found["png"])).drop("png")
