"""Data sources of the library: strips of uncompressed images in batch, frames of samples as a stream.

Files are listed on the driver by name and size alone and opened by the tasks, through ``pyarrow.fs``, so a path may be
local or in a store that it knows. ``register`` makes the formats known to a session.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of an image that one task reads, and pixels in one Arrow batch.
STRIP_BYTES, BATCH_PIXELS = 16 << 20, 1 << 16
HEADER_BYTES = 1024
#: From so many strips on, small ones share a task, up to so many bytes; opening a file counts as some.
MANY_STRIPS, TASK_BYTES, OPEN_BYTES = 256, 1 << 20, 4096
PIXEL_SCHEMA = "folder_id string, layer string, x int, y int, r int, g int, b int, a int"
SAMPLE_SCHEMA = (
    "frame long, place int, stroke_id long, seq long, x double, y double, t double, pressure double, radius double, predicted boolean"
)
#: From so many folders of frames on, small ones share a task, up to so many frames.
MANY_FRAMES, TASK_FRAMES = 256, 1024
# How the channels of an image of so many are to be read as red, green, blue and alpha.
CHANNELS = {1: (0, 0, 0, None), 2: (0, 0, 0, 1), 3: (0, 1, 2, None), 4: (0, 1, 2, 3)}


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def listed(path: str, recursive: bool = True) -> list[fs.FileInfo]:
    files, root = place(path)
    return sorted(files.get_file_info(fs.FileSelector(root, recursive=recursive, allow_not_found=True)), key=lambda f: f.path)


@dataclass
class Strip(InputPartition):
    """Part ``number`` of ``of`` of the rows of a file."""

    path: str
    number: int
    of: int


@dataclass
class Strips(InputPartition):
    """The strips that one task reads, one after the other."""

    strips: list[Strip]


def packed(strips: list[Strip], sizes: list[int]) -> list[Strips]:
    """A task for each strip; of many small ones, a task for some neighbours."""
    tasks, room = [], 0
    for strip, size in zip(strips, sizes):
        cost = max(size, OPEN_BYTES)
        if len(strips) < MANY_STRIPS or cost > room:
            tasks.append(Strips([]))
            room = TASK_BYTES
        tasks[-1].strips.append(strip)
        room -= cost
    return tasks


class PamReader(DataSourceReader):
    def __init__(self, root: str, strip_bytes: int):
        self.root, self.strip_bytes = root, strip_bytes

    def partitions(self) -> list[Strips]:
        images = [f for f in listed(self.root) if f.is_file and f.path.endswith(".pam")]
        strips = [(Strip(f.path, k, n), f.size // n) for f in images for n in [math.ceil(max(f.size, 1) / self.strip_bytes)] for k in range(n)]
        return packed([strip for strip, _ in strips], [size for _, size in strips])

    def read(self, task: Strips) -> Iterator[pa.RecordBatch]:
        for strip in task.strips:
            yield from self.read_strip(strip)

    def read_strip(self, strip: Strip) -> Iterator[pa.RecordBatch]:
        folder, layer = strip.path.split("/")[-2], strip.path.split("/")[-1].removesuffix(".pam")
        with place(self.root)[0].open_input_file(strip.path) as file:
            head = file.read(HEADER_BYTES)
            width, height, depth, start = header(head, f"{folder}/{layer}")
            row = width * depth
            if file.size() - start < row * height:
                raise ValueError(f"{folder}/{layer} is cut short")
            y, end = height * strip.number // strip.of, height * (strip.number + 1) // strip.of
            step = max(1, BATCH_PIXELS // max(width, 1))
            while y < end:
                n = min(step, end - y)
                file.seek(start + y * row)
                plane = np.frombuffer(file.read(n * row), np.uint8).reshape(n * width, depth).astype(np.int32)
                opaque = np.full(n * width, 255, np.int32)
                columns = [opaque if c is None else plane[:, c] for c in CHANNELS[depth]]
                names = [pa.array(np.repeat([v], n * width)) for v in (folder, layer)]
                xs, ys = np.tile(np.arange(width, dtype=np.int32), n), np.repeat(np.arange(y, y + n, dtype=np.int32), width)
                arrays = [*names, *(pa.array(v) for v in (xs, ys, *columns))]
                yield pa.RecordBatch.from_arrays(arrays, names=["folder_id", "layer", "x", "y", "r", "g", "b", "a"])
                y += n


def header(head: bytes, name: str) -> tuple[int, int, int, int]:
    """Width, height, depth and where the pixels begin."""
    text, mark, _ = head.partition(b"ENDHDR\n")
    field = {k.decode(): int(v) for k, v in re.findall(rb"(WIDTH|HEIGHT|DEPTH|MAXVAL) (\d+)", text)}
    if not mark or not text.startswith(b"P7") or field.get("MAXVAL") != 255 or field.get("DEPTH") not in CHANNELS:
        raise ValueError(f"{name} is not an 8-bit PAM image")
    return field["WIDTH"], field["HEIGHT"], field["DEPTH"], len(text) + len(mark)


class PamStrips(DataSource):
    """``folder/layer.pam`` files below ``path`` as pixels; a large image is read in strips by several tasks."""

    @classmethod
    def name(cls) -> str:
        return "pam_strips"

    def schema(self) -> str:
        return PIXEL_SCHEMA

    def reader(self, schema) -> PamReader:
        return PamReader(self.options["path"], int(self.options.get("strip_bytes", STRIP_BYTES)))


@dataclass
class Frames(InputPartition):
    """The folders that one task reads, one after the other."""

    folders: list[str]


class FrameReader(DataSourceStreamReader):
    """The offset is the number of frames; a folder is complete once the next one or a ``_SUCCESS`` is there."""

    def __init__(self, root: str):
        self.root = root

    def _listed(self) -> tuple[list[tuple[int, int, str]], bool]:
        """First and last frame of each folder with its name, in order, and whether no more will come."""
        names = [f.path.split("/")[-1] for f in listed(self.root, False)]
        found = [m for name in names if (m := re.fullmatch(r"frames?=(\d+)(?:-(\d+))?", name))]
        return sorted((int(m[1]), int(m[2] or m[1]), m[0]) for m in found), "_SUCCESS" in names

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        folders, done = self._listed()
        if not folders:
            return {"frames": 0}
        first, last, _ = folders[-1]
        return {"frames": last + 1 if done else first}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        folders = [f for f in self._listed()[0] if start["frames"] <= f[0] < end["frames"]]
        tasks, room = [], 0
        for first, last, name in folders:
            if len(folders) < MANY_FRAMES or last - first >= room:
                tasks.append(Frames([]))
                room = TASK_FRAMES
            tasks[-1].folders.append(name)
            room -= last - first + 1
        return tasks

    def read(self, task: Frames) -> Iterator[pa.RecordBatch]:
        files, root = place(self.root)
        for folder in task.folders:
            rows = []
            for info in files.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True)):
                if info.path.endswith((".json", ".json.gz")):
                    with files.open_input_stream(info.path) as file:
                        rows += [json.loads(line) for line in file.read().splitlines() if line]
            if rows:
                yield in_frames(rows, int(re.search(r"\d+", folder)[0]))


def in_frames(rows: list[dict], first: int) -> pa.RecordBatch:
    """Rows of whole frames with their places: real samples first, predicted ones last. Rows without a frame are of the ``first``."""
    frames = [r.get("frame", first) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (frames[i], rows[i]["predicted"], rows[i]["seq"]))
    rows, frames = [rows[i] for i in order], [frames[i] for i in order]
    starts: dict[int, int] = {}
    columns = [frames, [i - starts.setdefault(f, i) for i, f in enumerate(frames)]]
    columns += [[r.get(c) for r in rows] for c in ("stroke_id", "seq")]
    columns += [[None if (v := r.get(c)) is None else float(v) for r in rows] for c in ("x", "y", "t", "pressure", "radius")]
    columns.append([r["predicted"] for r in rows])
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 5, pa.bool_()]
    names = [c.strip().split(" ")[0] for c in SAMPLE_SCHEMA.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class SampleFrames(DataSource):
    """Folders of JSON samples below ``path`` as a stream: ``frame=<n>`` with one frame or ``frames=<first>-<last>``, whose rows tell theirs.

    A folder is read at once by one task; of many folders with few frames, a task reads some neighbours.
    """

    @classmethod
    def name(cls) -> str:
        return "sample_frames"

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def streamReader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PamStrips)
    spark.dataSource.register(SampleFrames)


def write_pam(px: DataFrame, root: str, layer: str) -> int:
    """Writes dense RGBA images (``image_id, x, y, r, g, b, a``), a file per image; gives their number."""

    def write(table: pd.DataFrame) -> pd.DataFrame:
        rows = table.sort_values(["y", "x"])
        width, height = int(rows.x.max()) + 1, int(rows.y.max()) + 1
        body = rows[["r", "g", "b", "a"]].to_numpy().astype(np.uint8).tobytes()
        files, base = place(root)
        files.create_dir(f"{base}/{table.image_id.iloc[0]}", recursive=True)
        with files.open_output_stream(f"{base}/{table.image_id.iloc[0]}/{layer}.pam") as out:
            out.write(f"P7\nWIDTH {width}\nHEIGHT {height}\nDEPTH 4\nMAXVAL 255\nENDHDR\n".encode() + body)
        return pd.DataFrame({"n": [1]})

    return px.select("image_id", "x", "y", "r", "g", "b", "a").groupBy("image_id").applyInPandas(write, "n int").count()
