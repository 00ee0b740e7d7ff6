"""Image files as rasters, through Spark's own decoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionflow.operators.images import encode_png


def read_rasters(spark: SparkSession, path: str | list[str], drop_invalid: bool = False) -> DataFrame:
    """origin, width, height, channels and data (BGR order) of PNG, JPEG, GIF, BMP and TIFF files; -1 high where one can't be decoded."""
    found = spark.read.format("image").option("dropInvalid", drop_invalid).load(path)
    return found.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def to_png(data: bytes, width: int, height: int, channels: int) -> bytes:
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return encode_png(p[:, :, 0] if channels == 1 else p[:, :, [2, 1, 0]] if channels == 3 else p[:, :, [2, 1, 0, 3]])


def as_png(rasters: DataFrame) -> DataFrame:
    """(origin, content): every decoded raster as a PNG file, so that any readable image can be worked on."""

    def work(frames):
        for f in frames:
            made = [to_png(bytes(d), w, h, c) if h > 0 else None for d, w, h, c in f[["data", "width", "height", "channels"]].itertuples(index=False)]
            yield pd.DataFrame({"origin": f["origin"], "content": made})

    return rasters.mapInPandas(work, "origin string, content binary")


def dropped_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that are put into a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)
