"""Run-length form of a label plane, its byte layout, and the content hash."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.color import idiv
from tessella.functions.shape import ROW_SHIFT, raster_key
from tessella.operators.chunked import attach_totals, fan_out, islands, row_numbers, running, seq_block
from tessella.session import materialize

# Fixed values of the run format.
MAGIC = b"CLR1"
HEADER_BYTES = 8
RUN_BYTES = 4
MAX_RUN = 65_535
HASH_PREFIX = "sha256:"


def encode_runs(px: DataFrame) -> DataFrame:
    """Raster-order runs ``image_id, run_no, len, id`` of a dense label plane.

    Pixels are folded to runs row by row; only those row runs are stitched across rows.
    """
    row = W.partitionBy("image_id", "y").orderBy("x")
    opened = px.select(
        "image_id", "y", "x", "label", (~F.lag("label").over(row).eqNullSafe(F.col("label"))).alias("new")
    )
    numbered = opened.withColumn("part", F.sum(F.col("new").cast("int")).over(row))
    pieces = numbered.groupBy("image_id", "y", "part").agg(
        F.min("x").alias("x"), F.count(F.lit(1)).alias("len"), F.first("label").alias("label")
    )
    return stitch_runs(pieces)


def stitch_runs(pieces: DataFrame) -> DataFrame:
    """Join row pieces ``image_id, y, x, len, label`` to runs, and split the overlong ones."""
    at = pieces.withColumn("key", raster_key("x", "y"))
    grouped = islands(at, ["image_id"], F.col("y").cast("long"), ["key"], "label", "gid")
    # Written, as the numbering looks at the runs twice.
    whole = materialize(
        grouped.groupBy("image_id", "gid").agg(
            F.min("key").alias("key"), F.sum("len").alias("total"), F.first("label").alias("id")
        ),
        "runs",
    )
    split = whole.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.col("total") - 1, MAX_RUN)))
    )
    length = F.least(F.col("total") - F.col("part") * MAX_RUN, F.lit(MAX_RUN).cast("long"))
    return row_numbers(
        split.select("image_id", "key", "part", length.cast("int").alias("len"), "id"),
        ["image_id"],
        F.shiftright("key", ROW_SHIFT),
        [F.col("key"), F.col("part")],
        "run_no",
    ).select("image_id", "run_no", "len", "id")


def run_offsets(runs: DataFrame) -> DataFrame:
    """Adds ``start``, the raster index of the first pixel of every run."""
    return running(
        runs, ["image_id"], seq_block("run_no"), [F.col("run_no")], {"_end": ("sum", F.col("len").cast("long"))}
    ).withColumn("start", F.col("_end") - F.col("len")).drop("_end")


def decode_runs(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Pixels ``image_id, x, y, label`` of runs; ``images`` holds ``image_id, width``."""
    cells = run_offsets(runs).where("len > 0").join(images.select("image_id", "width"), "image_id")
    index = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
    return cells.select("image_id", "width", F.col("id").alias("label"), index.alias("i")).select(
        "image_id",
        (F.col("i") % F.col("width")).cast("int").alias("x"),
        idiv("i", F.col("width")).cast("int").alias("y"),
        "label",
    )


def run_errors(runs: DataFrame, images: DataFrame) -> DataFrame:
    """First decoding error per image (NULL when sound); ``images`` holds ``image_id, pixels``.

    A zero run and an overrun are told apart by which comes first in the runs.
    """
    ends = run_offsets(runs).join(images.select("image_id", "pixels"), "image_id")
    found = ends.groupBy("image_id").agg(
        F.min(F.when(F.col("len") == 0, F.col("run_no"))).alias("zero"),
        F.min(F.when(F.col("start") + F.col("len") > F.col("pixels"), F.col("run_no"))).alias("over"),
        F.sum("len").alias("total"),
    )
    far = F.lit((1 << 62))
    zero, over = F.coalesce("zero", far), F.coalesce("over", far)
    total = F.coalesce("total", F.lit(0))
    error = (
        F.when((zero < far) & (zero <= over), "zero-run")
        .when(over < far, "too-long")
        .when(total < F.col("pixels"), "too-short")
    )
    return images.select("image_id", "pixels").join(found, "image_id", "left").select("image_id", error.alias("error"))


# --- bytes ----------------------------------------------------------------------------------


def le_hex(v: Column, size: int) -> Column:
    """Hex digits of a number in little-endian byte order."""
    digits = F.lpad(F.hex(v.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)])


def le_number(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned little-endian number from a binary column, ``at`` counted from zero."""
    start = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, start + 1, F.lit(size)))
    swapped = F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)])
    return F.conv(swapped, 16, 10).cast("long")


def run_bytes(runs: DataFrame, images: DataFrame, block: int = 4096) -> DataFrame:
    """Byte chunks ``image_id, chunk_no, data`` of the run format; chunk -1 is the header."""
    body = (
        runs.withColumn("chunk_no", idiv("run_no", block))
        .withColumn("h", F.concat(le_hex(F.col("len"), 2), le_hex(F.col("id"), 2)))
        .groupBy("image_id", "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("run_no", "h"))).alias("runs"))
        .select(
            "image_id", "chunk_no", F.unhex(F.concat_ws("", F.transform("runs", lambda r: r["h"]))).alias("data")
        )
    )
    head = images.select(
        "image_id",
        F.lit(-1).cast("long").alias("chunk_no"),
        F.unhex(F.concat(F.lit(MAGIC.hex().upper()), le_hex(F.col("pixels"), 4))).alias("data"),
    )
    return head.unionByName(body)


def parse_run_bytes(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and per-image verdict of ``image_id, data`` blobs in the run format."""
    body = F.length("data") - HEADER_BYTES
    head = blobs.select(
        "image_id",
        "data",
        F.when((body < 0) | (F.hex(F.substring("data", 1, 4)) != MAGIC.hex().upper()), "bad-magic")
        .when(body % RUN_BYTES != 0, "ragged-body")
        .alias("error"),
    )
    sound = head.where("error is null").withColumn("pixels", le_number(F.col("data"), 4, 4))
    counted = sound.where(body >= RUN_BYTES).withColumn(
        "run_no", F.explode(F.sequence(F.lit(0).cast("long"), idiv(body, RUN_BYTES) - 1))
    )
    at = (F.col("run_no") * RUN_BYTES + HEADER_BYTES).cast("int")
    runs = counted.select(
        "image_id",
        "run_no",
        le_number(F.col("data"), at, 2).cast("int").alias("len"),
        le_number(F.col("data"), at + 2, 2).alias("id"),
    )
    verdict = run_errors(runs, sound.select("image_id", "pixels")).unionByName(
        head.where("error is not null").select("image_id", "error")
    )
    return runs, verdict


def label_bytes(px: DataFrame) -> DataFrame:
    """Little-endian 16-bit ids, one chunk per image row: ``image_id, chunk_no, data``."""
    return (
        px.withColumn("h", le_hex(F.col("label"), 2))
        .groupBy("image_id", F.col("y").cast("long").alias("chunk_no"))
        .agg(F.array_sort(F.collect_list(F.struct("x", "h"))).alias("cells"))
        .select("image_id", "chunk_no", F.unhex(F.concat_ws("", F.transform("cells", lambda c: c["h"]))).alias("data"))
    )


# --- content hash ---------------------------------------------------------------------------


def _hash_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running digest over chunks sorted by image, entry and chunk; only the digest is kept."""
    image = entry = digest = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.image_id != image:
                if digest is not None:
                    out.append((image, HASH_PREFIX + digest.hexdigest()))
                image, entry, digest = row.image_id, None, hashlib.sha256()
            if row.entry != entry:
                entry = row.entry
                name = row.name.encode()
                digest.update(struct.pack("<I", len(name)) + name + struct.pack("<Q", row.total))
            digest.update(row.data)
        yield pd.DataFrame(out, columns=["image_id", "content_hash"])
    if digest is not None:
        yield pd.DataFrame([(image, HASH_PREFIX + digest.hexdigest())], columns=["image_id", "content_hash"])


def content_hash(entries: DataFrame) -> DataFrame:
    """Canonical hash per image of ``image_id, entry, name, chunk_no, data``.

    Entries are taken in the order of ``entry``; each is framed by its name and total length, so
    the way its bytes are cut into chunks does not matter.
    """
    rows = attach_totals(
        materialize(entries, "entries"), ["image_id", "entry"], seq_block("chunk_no"), {"total": ("sum", F.length("data").cast("long"))}
    )
    return (
        fan_out(rows.select("image_id", "entry", "name", "chunk_no", "data", "total"), "image_id")
        .sortWithinPartitions("image_id", "entry", "chunk_no")
        .mapInPandas(_hash_entries, "image_id long, content_hash string")
    )
