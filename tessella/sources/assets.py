"""Artwork folders: layer inventory, metadata and pixel tables."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.quality import REQUIRED_LAYERS

LAYERS = (*REQUIRED_LAYERS, "shade")
META_SCHEMA = "id string, title string, category string, notes string"
PIXEL_SCHEMA = "folder_id string, layer string, x int, y int, r int, g int, b int, a int"

_PATH = r"([^/]+)/([^/.]+)\.([^/.]+)$"


def list_assets(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder with a flag per layer; file contents are not read.

    The folder name is the id.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    named = files.select(
        F.regexp_extract("path", _PATH, 1).alias("folder_id"),
        F.regexp_extract("path", _PATH, 2).alias("layer"),
        "path",
        "length",
    )
    return named.groupBy("folder_id").pivot("layer", [*LAYERS, "meta"]).agg(F.first("path"))


def layer_rows(assets: DataFrame) -> DataFrame:
    """``folder_id, layer, path`` of the layers that are there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("path")) for n in LAYERS]))
    return assets.select("folder_id", pairs.alias("p")).select("folder_id", "p.*").where("path is not null")


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every folder with a fixed schema; extra fields are ignored."""
    return (
        spark.read.schema(META_SCHEMA)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "meta.json")
        .json(root)
        .select(F.regexp_extract(F.input_file_name(), _PATH, 1).alias("folder_id"), "*")
    )


def expand_channels(px: DataFrame, mode: Column) -> DataFrame:
    """8-bit RGBA from pixels of another layout.

    ``c0..c3`` are the stored channels; ``mode`` is ``rgba``, ``rgb``, ``gray`` or ``gray-alpha``.
    """
    gray = mode.startswith("gray")
    r = F.col("c0")
    g = F.when(gray, F.col("c0")).otherwise(F.col("c1"))
    b = F.when(gray, F.col("c0")).otherwise(F.col("c2"))
    a = F.when(mode == "rgba", F.col("c3")).when(mode == "gray-alpha", F.col("c1")).otherwise(F.lit(255))
    keep = [c for c in px.columns if c not in ("c0", "c1", "c2", "c3")]
    return px.select(*keep, r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


_PAM_MODES = {1: "gray", 2: "gray-alpha", 3: "rgb", 4: "rgba"}


def _pam_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of uncompressed 8-bit PAM images, one frame per image row."""
    import numpy as np

    for batch in batches:
        for folder, layer, data in zip(batch["folder_id"], batch["layer"], batch["content"]):
            head, _, body = bytes(data).partition(b"ENDHDR\n")
            field = {k.decode(): int(v) for k, v in re.findall(rb"(WIDTH|HEIGHT|DEPTH|MAXVAL) (\d+)", head)}
            if not head.startswith(b"P7") or field.get("MAXVAL") != 255 or field.get("DEPTH") not in _PAM_MODES:
                raise ValueError(f"{folder}/{layer} is not an 8-bit PAM image")
            w, h, depth = field["WIDTH"], field["HEIGHT"], field["DEPTH"]
            if len(body) < w * h * depth:
                raise ValueError(f"{folder}/{layer} is cut short (crc {zlib.crc32(body)})")
            plane = np.frombuffer(body, np.uint8, w * h * depth).reshape(h, w, depth)
            for y in range(h):
                row = {"folder_id": folder, "layer": layer, "mode": _PAM_MODES[depth], "x": np.arange(w, dtype="int32"), "y": y}
                for c in range(4):
                    row[f"c{c}"] = plane[y, :, c].astype("int32") if c < depth else 0
                yield pd.DataFrame(row)


def read_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Pixels of all uncompressed (PAM) layers below ``root``.

    Compressed images are decoded by Spark's own ``image`` source or by a separate job; this
    reader keeps one image row at a time in a batch.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.pam")
        .load(root)
        .select(
            F.regexp_extract("path", _PATH, 1).alias("folder_id"),
            F.regexp_extract("path", _PATH, 2).alias("layer"),
            "content",
        )
    )
    raw = files.mapInPandas(
        _pam_rows,
        "folder_id string, layer string, mode string, x int, y int, c0 int, c1 int, c2 int, c3 int",
    )
    return expand_channels(raw, F.col("mode")).drop("mode")


def _images(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")


def unreadable_images(spark: SparkSession, root: str) -> DataFrame:
    """One ``source-unreadable`` row for each file below ``root`` that is no image."""
    bad = _images(spark, root).where("width <= 0 or height <= 0")
    return bad.select(
        F.regexp_extract("origin", _PATH, 1).alias("folder_id"),
        F.regexp_extract("origin", _PATH, 2).alias("layer"),
        F.lit("source-unreadable").alias("code"),
    )


def image_source_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Pixels of compressed images through Spark's ``image`` source (no alpha in it for RGB).

    The source stores BGR(A) bytes row by row; they are expanded in the JVM.  Files that do not decode
    have no pixels; ``unreadable_images`` lists them.
    """
    files = _images(spark, root).where("width > 0 and height > 0")
    pixel = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    cells = files.select("origin", "width", "nChannels", "data", pixel.alias("i"))

    def byte(k: int) -> Column:
        at = F.col("i") * F.col("nChannels") + k + 1
        return F.conv(F.hex(F.substring("data", at, F.lit(1))), 16, 10).cast("int")

    n = F.col("nChannels")
    return cells.select(
        F.regexp_extract("origin", _PATH, 1).alias("folder_id"),
        F.regexp_extract("origin", _PATH, 2).alias("layer"),
        (F.col("i") % F.col("width")).cast("int").alias("x"),
        F.call_function("div", F.col("i"), F.col("width")).cast("int").alias("y"),
        F.when(n >= 3, byte(2)).otherwise(byte(0)).alias("r"),
        F.when(n >= 3, byte(1)).otherwise(byte(0)).alias("g"),
        byte(0).alias("b"),
        F.when(n == 4, byte(3)).otherwise(F.lit(255)).alias("a"),
    )
