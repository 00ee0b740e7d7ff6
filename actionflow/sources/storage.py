"""Files on whatever file system a path names: local paths and any URI that ``pyarrow.fs`` opens."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(quote(path, safe="/:@?=&,+~!$'()*;"))  # names as they are, not as in a URI
    return fs.LocalFileSystem(), os.path.abspath(re.sub("^file:(//)?", "", path))


def readable(path: str) -> bool:
    from pyarrow import fs

    system, inside = opened(path)
    if isinstance(system, fs.LocalFileSystem) and not os.access(inside, os.R_OK):
        return False
    return system.get_file_info(inside).type == fs.FileType.File


def full_path(path: str) -> str:
    """As Spark's file sources give it: local ones without a scheme."""
    return path if "://" in path and not path.startswith("file:") else opened(path)[1]


def names_in(folders: DataFrame) -> DataFrame:
    """(folder, name) of all entries, hidden ones too, of the folders; each is listed where its row lies. One that isn't there has none."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for folder in frame["folder"]:
                system, inside = opened(folder)
                found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
                yield pd.DataFrame({"folder": folder, "name": [x.base_name for x in found]}, dtype=object)

    return folders.mapInPandas(listed, "folder string, name string")


def put(path: str, content: bytes) -> None:
    """Writes a file; what is local is on disk when this returns."""
    from pyarrow import fs

    system, inside = opened(path)
    system.create_dir(inside.rpartition("/")[0] or "/", recursive=True)
    if isinstance(system, fs.LocalFileSystem):
        with open(inside, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        return
    with system.open_output_stream(inside, compression=None) as f:
        f.write(content)
