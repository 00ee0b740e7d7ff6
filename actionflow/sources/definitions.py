"""The shipped action definitions, and writing them out as JSON files."""

from __future__ import annotations

import json

from actionflow.sources import storage

RASTER = [".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".gif"]
HEIC = [".heic", ".heif"]
FILES = ["files.read", "files.write", "files.temp"]


def _number(name: str, label: str, default: float, presets: list, least: float, most: float, unit: str, kind: str = "int") -> dict:
    return {"name": name, "type": kind, "label": label, "default": default, "presets": presets, "min": least, "max": most, "unit": unit}


def _quality(default: int, presets: list[int]) -> dict:
    return _number("quality", "Quality", default, presets, 40, 100, "%")


PERCENT = _number("percent", "Percent", 100, [90, 75, 50, 25], 10, 300, "%")
RADIUS = _number("radius", "Radius", 2.0, [1.5, 3.0, 6.0], 0.5, 12, "px", "float")
COLOURS = {"Indigo": "99,102,241", "Sky": "14,165,233", "Emerald": "16,185,129", "Orange": "249,115,22", "Red": "239,68,68", "Violet": "168,85,247"}


def _native(id: str, name: str, aliases: list[str], category: str, description: str, params: list[dict], output: str = "", types: list[str] = RASTER) -> dict:
    return {"id": id, "name": name, "aliases": aliases, "category": category, "description": description, "inputTypes": types, "outputType": output, "params": params, "driver": "image", "isMeta": False, "executor": {"type": "native", "handler": f"image.{id}"}, "permissions": FILES, "dangerLevel": 0}


def _tool(id: str, name: str, aliases: list[str], description: str, types: list[str], output: str, params: list[dict], extra: list[str]) -> dict:
    run = {"type": "cli", "command": "magick", "args": ["{{input}}", *extra, "{{output}}"], "timeoutMs": 600_000}
    return {"id": id, "name": name, "aliases": aliases, "category": "convert", "description": description, "inputTypes": types, "outputType": output, "params": params, "driver": "cli", "isMeta": False, "executor": run, "permissions": [*FILES, "tools.exec"], "dangerLevel": 0}


def _chain(id: str, name: str, aliases: list[str], category: str, description: str, params: list[dict], steps: list[str]) -> dict:
    run = {"type": "pipeline", "steps": [{"skillId": s} for s in steps]}
    return {"id": id, "name": name, "aliases": aliases, "category": category, "description": description, "inputTypes": HEIC, "outputType": ".heic", "params": params, "driver": "pipeline", "isMeta": False, "executor": run, "permissions": [*FILES, "tools.exec"], "dangerLevel": 0}


def _meta(id: str, name: str, aliases: list[str], description: str, params: list[dict] | None = None, danger: int = 0) -> dict:
    return {"id": id, "name": name, "aliases": aliases, "category": "meta", "description": description, "inputTypes": ["*"], "outputType": "none", "params": params or [], "driver": "meta", "isMeta": True, "executor": {"type": "meta"}, "permissions": [], "dangerLevel": danger}


# Ids, names, aliases and descriptions decide what a search finds and in what order.
SHIPPED = [
    _native("resize", "Resize", ["scale", "resize image", "size"], "transform", "Resize by percentage", [PERCENT]),
    _native("grayscale", "Grayscale", ["bw", "black and white", "monochrome"], "filter", "Convert to grayscale", []),
    _native("blur", "Blur", ["soften", "gaussian"], "filter", "Apply gaussian blur", [RADIUS]),
    _native("compress", "Compress", ["compress file", "reduce size", "shrink"], "compress", "Reduce file size by lowering quality", [_quality(85, [90, 80, 70, 60])], types=[".jpg", ".jpeg", ".png"]),
    _native("convert_to_jpeg", "Convert to JPEG", ["jpg", "jpeg", "to jpg", "to jpeg"], "convert", "Convert images to JPEG format", [_quality(90, [95, 90, 85, 80, 70])], ".jpg"),
    _native("convert_to_png", "Convert to PNG", ["png", "to png"], "convert", "Convert images to PNG format", [], ".png"),
    _tool("convert_heic_to_jpeg", "HEIC to JPEG", ["heic jpg", "heic jpeg", "heif jpg"], "Convert HEIC/HEIF images to JPEG", HEIC, ".jpg", [_quality(90, [95, 90, 85, 80, 70])], ["-quality", "{{quality}}"]),
    _tool("convert_heic_to_png", "HEIC to PNG", ["heic png", "heif png", "convert heic"], "Convert HEIC/HEIF images to PNG", HEIC, ".png", [], []),
    _tool("convert_jpeg_to_heic", "JPEG to HEIC", ["jpg heic", "jpeg heic", "to heic"], "Convert JPEG images to HEIC", [".jpg", ".jpeg"], ".heic", [], []),
    _tool("convert_png_to_heic", "PNG to HEIC", ["png heic", "png heif", "to heic"], "Convert PNG images to HEIC", [".png"], ".heic", [], []),
    _chain("heic_resize", "HEIC Resize", ["heic scale", "resize heic"], "transform", "Resize for HEIC via convert -> transform -> convert", [PERCENT], ["convert_heic_to_png", "resize", "convert_png_to_heic"]),
    _chain("heic_grayscale", "HEIC Grayscale", ["heic bw", "heic black and white", "heic monochrome"], "filter", "Grayscale for HEIC via convert -> filter -> convert", [], ["convert_heic_to_png", "grayscale", "convert_png_to_heic"]),
    _chain("heic_blur", "HEIC Blur", ["heic soften", "heic gaussian"], "filter", "Blur for HEIC via convert -> filter -> convert", [RADIUS], ["convert_heic_to_png", "blur", "convert_png_to_heic"]),
    _chain("heic_compress", "HEIC Compress", ["compress heic", "reduce heic size"], "compress", "Compress HEIC via JPEG quality reduction", [_quality(85, [90, 80, 70, 60])], ["convert_heic_to_jpeg", "compress", "convert_jpeg_to_heic"]),
    _meta("switch_to_batch", "Switch to Batch", ["batch", "apply to all"], "Apply skills to all files"),
    _meta("switch_to_per_file", "Switch to Per-File", ["per file", "single file", "per-file"], "Apply skills to a single file"),
    _meta("set_output_folder", "Set Output Folder", ["output folder", "destination"], "Choose where exports are saved"),
    _meta("set_naming_pattern", "Set Naming Pattern", ["file name pattern", "naming pattern"], "Configure output file names", [{"name": "pattern", "type": "string", "label": "Pattern", "default": "{name}_{skill}.{ext}"}]),
    _meta("set_accent_color", "Accent Color", ["accent", "theme color", "highlight color"], "Set the UI accent color", [{"name": "color", "type": "string", "label": "Color", "default": "99,102,241", "presets": [{"label": k, "value": v} for k, v in COLOURS.items()]}]),
    _meta("export", "Export Files", ["save", "export", "write"], "Save outputs to your chosen folder"),
    _meta("clear_all", "Clear All", ["reset", "clear"], "Clear all files and actions", danger=1),
]


def write_shipped(folder: str) -> str:
    for d in SHIPPED:
        storage.put(f"{folder}/{'meta' if d['isMeta'] else 'image'}/{d['id']}.json", json.dumps({"version": "1.0.0", "author": "core"} | d, indent=2).encode())
    return folder
