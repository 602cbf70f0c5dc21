"""A data source `npy` of per-camera arrays: read in ranges of frames, written in two phases.

Below `path` a camera has a folder `camera_id=<name>` with files of (frames, points, values) arrays of doubles, each with
its first frame in its name; frames without any number are not told when it is read, but for those that a row of nulls was
written for. Where less than half of the frames between a file's first and last are there, it has only these, and their
numbers as a second array. Tasks write into a folder of the writing; only the commit moves whole files to their places,
and an abort takes the folder away, so that a failed task leaves no file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "camera_id string, frame long, point long, v0 double, v1 double, v2 double"
FRAMES_A_TASK = 100_000
#: Where ranges of fewer frames would make more tasks than this, a task reads several of them.
TASKS = 200
#: Frames of an array that a task holds while it writes.
FRAMES_A_FILE = 10_000
#: Frames that are not there may fill a file up to this many in a row; a longer gap begins another file.
GAP_FRAMES = 1_000
#: Frames that are read or told at once.
FRAMES_A_BATCH = 1_000
#: The bits of a null that was written: a NaN of its own, so that a frame of nulls is told and a frame that fills a gap is not.
NULL = np.uint64(0x7FF8_0000_0000_0001)


def _place(path: str):
    """File system and path within it: of the local machine, or any that Arrow knows by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, kind and length of the header of an array in C order."""
    major, minor = np.lib.format.read_magic(file)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(file) if (major, minor) == (1, 0) else np.lib.format.read_array_header_2_0(file)
    if fortran or len(shape) != 3 or shape[2] > 3:
        raise ValueError(f"an array of shape {shape}{' in Fortran order' if fortran else ''} is not (frames, points, values)")
    return shape, kind, file.tell()


@dataclass
class Frames:
    file: str
    camera_id: str
    first: int  # frame number of the file's first row
    numbered: bool  # whether the file has the numbers of its frames
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: at least one range of frames of a file."""

    frames: list[Frames]


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("framespertask", FRAMES_A_TASK))

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, top = _place(self.path)
        files = []
        for info in sorted(system.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda i: i.path):
            named = re.search(r"/camera_id=([^/]+)/(frames|numbered)-(-?\d+)-[0-9a-f]+\.npy$", info.path)
            if named is None or "/_" in info.path[len(top) :]:
                continue
            with system.open_input_file(info.path) as file:
                frames = _header(file)[0][0]
            files.append(Frames(info.path, unquote(named[1]), int(named[3]), named[2] == "numbered", 0, frames))
        step = max(self.step, min(FRAMES_A_TASK, -(-sum(f.stop for f in files) // TASKS)))
        out, room = [], 0
        for whole in files:
            at = 0
            while at < whole.stop:
                if not room:
                    out.append(Ranges([]))
                    room = step
                n = min(room, whole.stop - at)
                out[-1].frames.append(replace(whole, start=at, stop=at + n))
                at, room = at + n, room - n
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        for part in partition.frames if partition is not None else []:
            with system.open_input_file(part.file) as file:
                (frames, points, values), kind, head = _header(file)
                row = points * values * kind.itemsize
                if part.numbered:
                    file.seek(head + frames * row)
                    np.lib.format.read_magic(file)
                    np.lib.format.read_array_header_1_0(file)
                    numbers = file.tell()
                for at in range(part.start, part.stop, FRAMES_A_BATCH):
                    n = min(FRAMES_A_BATCH, part.stop - at)
                    file.seek(head + at * row)
                    block = np.frombuffer(file.read(n * row), kind).reshape(n * points, values).astype(np.float64)
                    wide = np.full((n * points, 3), np.nan)
                    wide[:, :values] = block
                    told = np.repeat((~np.isnan(wide) | (wide.view(np.uint64) == NULL)).reshape(n, -1).any(axis=1), points)
                    number = np.arange(at, at + n) + part.first
                    if part.numbered:
                        file.seek(numbers + 8 * at)
                        number = np.frombuffer(file.read(8 * n), "<i8").astype(np.int64)
                    frame, point, wide = np.repeat(number, points)[told], np.tile(np.arange(points), n)[told], wide[told]
                    arrays = [pa.array([part.camera_id] * len(frame), pa.string()), pa.array(frame), pa.array(point), *(pa.array(wide[:, c], from_pandas=True) for c in range(3))]
                    yield pa.RecordBatch.from_arrays(arrays, ["camera_id", "frame", "point", "v0", "v1", "v2"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and where it goes


class NpyWriter(DataSourceArrowWriter):
    """Rows come sorted by camera_id, frame and point within a task, as `write_npy` deals them."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.points = int(options["points"])
        self.own = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, top = _place(self.path)
        files, held, numbers, used, camera = [], np.empty((0, self.points, 3)), np.empty(FRAMES_A_FILE, np.int64), 0, None

        def flush():
            if used:
                first, span, arrays = int(numbers[0]), int(numbers[used - 1] - numbers[0]) + 1, [held[:used], numbers[:used]]
                if span <= 2 * used:
                    arrays = [np.full((span, self.points, 3), np.nan)]  # frames between have no numbers
                    arrays[0][numbers[:used] - first] = held[:used]
                name = f"camera_id={quote(camera, safe='')}/{'frames' if len(arrays) == 1 else 'numbered'}-{first:012d}-{uuid.uuid4().hex}.npy"
                here = f"{top}/{self.own}/{name}"
                system.create_dir(here.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(here) as out:
                    for array, kind in zip(arrays, ("<f8", "<i8"), strict=False):  # numbers of frames where there are any
                        np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": array.shape})
                        out.write(array.astype(kind, copy=False).tobytes())
                files.append((here, f"{top}/{name}"))

        for batch in batches:
            frames, points = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "point"))
            values = np.column_stack([np.asarray(batch.column(f"v{k}").to_numpy(zero_copy_only=False), float) for k in range(3)])
            values[np.isnan(values)] = NULL.view(np.float64)
            names = batch.column("camera_id").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(frames) > GAP_FRAMES)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frames)], strict=True):
                while lo < hi:  # one camera's frames without a long gap
                    name = names.dictionary[int(code[lo])].as_py()
                    if name != camera or not used or frames[lo] - numbers[used - 1] > GAP_FRAMES or used == FRAMES_A_FILE and frames[lo] != numbers[used - 1]:
                        flush()
                        camera, used = name, 0
                    at = used - (used > 0 and frames[lo] == numbers[used - 1])  # a frame goes on in the next batch
                    rows = at + np.concatenate(([0], np.cumsum(np.diff(frames[lo:hi]) != 0)))
                    rows = rows[: np.searchsorted(rows, FRAMES_A_FILE)]
                    end, more = lo + len(rows), int(rows[-1]) + 1
                    if more > len(held):
                        held = np.concatenate((held, np.empty((min(FRAMES_A_FILE, 2 * more) - len(held), self.points, 3))))
                    held[used:more] = np.nan  # points that have no row
                    held[rows, points[lo:end]], numbers[rows] = values[lo:end], frames[lo:end]
                    used, lo = more, end
        flush()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        system, top = _place(self.path)
        done = [f for m in messages if m is not None for f in m.files]
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if "/camera_id=" in info.path:
                    system.delete_dir(info.path)
        for _, there in done:
            system.create_dir(there.rsplit("/", 1)[0], recursive=True)
        for here, there in done:
            system.move(here, there)
        self._clear()

    def abort(self, messages: list[Written]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, top = _place(self.path)
        if system.get_file_info(f"{top}/{self.own}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.own}")


class NpyDataSource(DataSource):
    """options: path; points (when written: points of a frame); framesPerTask (when read)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_npy(spark, path: str, frames_per_task: int = FRAMES_A_TASK):
    """camera_id, frame, point, v0, v1, v2 (null: not a number, or not there)."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("framesPerTask", frames_per_task).load(path)


def write_npy(df, path: str, points: int, frames_per_task: int = FRAMES_A_TASK, mode: str = "append") -> None:
    """Writes camera_id, frame, point (0 to points - 1), v0, v1, v2, one row each. A camera's frames are dealt in ranges, neighbours
    to one writer, so that a long recording has many writers whose files do not overlap; points that have no row are not numbers."""
    from pyspark.sql import functions as F

    df.sparkSession.dataSource.register(NpyDataSource)
    rows = df.select("camera_id", F.col("frame").cast("long").alias("frame"), F.col("point").cast("long").alias("point"), *[F.col(f"v{k}").cast("double").alias(f"v{k}") for k in range(3)])
    dealt = rows.repartitionByRange("camera_id", F.floor(F.col("frame") / frames_per_task)).sortWithinPartitions("camera_id", "frame", "point")
    dealt.write.format("npy").option("points", points).mode(mode).save(path)
