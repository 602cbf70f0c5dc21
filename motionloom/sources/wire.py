"""The binary message of a frame's keypoints: header, blocks of points, footer; written and read in Arrow batches.

A message is a 24-byte header, for each block a 60-byte header and its data, and a footer equal to the header but for its
type. Data are x, y, (z,) visibility of every point in the order of its tracker's names, before them the names themselves
where a block carries them. Not-a-number with visibility 0 stands for a point that was not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the message format.
HEADER, BLOCK, FOOTER = 3, 4, 5
KEYPOINTS_3D, SKELETON_3D, SKELETON_2D, CHARUCO_2D = 0, 1, 2, 3
FLOATS = {0: np.dtype("<f4"), 1: np.dtype("<f8")}
ENDS = np.dtype([("message_type", "<u1"), ("frame_number", "<i8"), ("num_blocks", "<u4")], align=True)
HEAD = np.dtype(
    [("message_type", "<u1"), ("block_kind", "<u1"), ("dtype_code", "<u1"), ("dims", "<u1"), ("camera_id", "S16"), ("tracker_id", "S32"), ("num_points", "<u4"), ("data_byte_length", "<u4")],
    align=True,
)


def names_blob(names: list[str]) -> bytes:
    """Length, names that end in a zero byte each, and zeros up to a multiple of four."""
    blob = b"".join(n.encode("ascii", "ignore") + b"\0" for n in names)
    return len(blob).to_bytes(4, "little") + blob + b"\0" * (-len(blob) % 4)


def blocks(points: DataFrame, names: DataFrame, by: list[str], kind: int = KEYPOINTS_3D) -> DataFrame:
    """by, frame, block: one row for each camera and tracker of a frame. points: by, frame, camera_id ('' for points in space),
    tracker_id, keypoint, x, y, z. names: tracker_id, keypoint, ord (0 to n - 1; a tracker's few rows, broadcast)."""
    listed = names.groupBy("tracker_id").agg(F.sort_array(F.collect_list(F.struct("ord", "keypoint"))).alias("names"))
    entry = F.struct("keypoint", F.struct(*[F.col(c).cast("float").alias(c) for c in ("x", "y", "z")]).alias("at"))
    seen = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), entry)
    frames = points.groupBy(*by, "frame", "camera_id", "tracker_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(seen))).alias("at"))
    whole = frames.join(F.broadcast(listed), "tracker_id")
    nan = F.lit(float("nan")).cast("float")

    def values(name):
        at = F.try_element_at(F.col("at"), name["keypoint"])
        return F.when(at.isNotNull(), F.array(at["x"], at["y"], at["z"], F.lit(1.0).cast("float"))).otherwise(F.array(nan, nan, nan, F.lit(0.0).cast("float")))

    block = F.struct(
        F.lit(kind).alias("kind"), F.coalesce("camera_id", F.lit("")).alias("camera_id"), "tracker_id",
        F.flatten(F.transform("names", values)).alias("values"), F.transform("names", lambda n: n["keypoint"]).alias("names"),
    )
    return whole.select(*by, "frame", block.alias("block"))


def encoded(blocks_: DataFrame, by: list[str], embed_names: bool = False) -> DataFrame:
    """by, frame, payload: the message of every frame, its blocks in order of kind, camera and tracker."""
    frames = blocks_.groupBy(*by, "frame").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    keys = [*by, "frame"]
    schema = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys) + ", payload binary"

    def write(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            flat = lists.flatten()
            fields = {name: flat.field(name) for name in ("kind", "camera_id", "tracker_id", "values", "names")}
            floats = fields["values"].flatten().to_numpy(zero_copy_only=False).astype("<f4")
            sizes = fields["values"].value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
            blobs = [names_blob(n) for n in fields["names"].to_pylist()] if embed_names else [b""] * len(flat)
            heads = np.zeros(len(flat), HEAD)
            heads["message_type"], heads["block_kind"], heads["dims"] = BLOCK, fields["kind"].to_numpy(), 3
            heads["camera_id"] = [c.encode("ascii", "ignore")[:16] for c in fields["camera_id"].to_pylist()]
            heads["tracker_id"] = [c.encode("ascii", "ignore")[:32] for c in fields["tracker_id"].to_pylist()]
            heads["num_points"] = sizes // 4
            heads["data_byte_length"] = [4 * n + len(b) for n, b in zip(sizes.tolist(), blobs, strict=True)]
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends, feet = np.zeros(len(counts), ENDS), np.zeros(len(counts), ENDS)  # zeros between the fields, too
            for both, message_type in ((ends, HEADER), (feet, FOOTER)):
                both["message_type"], both["frame_number"], both["num_blocks"] = message_type, batch.column(len(keys) - 1).to_numpy(), counts
            payloads, at = [], 0
            for n, count in enumerate(counts.tolist()):
                parts = [ends[n].tobytes()]
                for k in range(at, at + count):
                    parts += [heads[k].tobytes(), blobs[k], floats[starts[k] : starts[k + 1]].tobytes()]
                at += count
                payloads.append(b"".join([*parts, feet[n].tobytes()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(payloads, pa.binary())], [*keys, "payload"])

    return frames.mapInArrow(write, schema)


def _read(payload: bytes) -> tuple[int, list[tuple[np.void, list[str] | None, np.ndarray]]]:
    """Frame number and blocks (header, names or None, (n, dims + 1) values); a ValueError where the message is not whole."""
    if len(payload) < 2 * ENDS.itemsize:
        raise ValueError(f"a message of {len(payload)} bytes has no header and footer")
    head, foot = np.frombuffer(payload, ENDS, 1)[0], np.frombuffer(payload, ENDS, 1, len(payload) - ENDS.itemsize)[0]
    if head["message_type"] != HEADER or foot["message_type"] != FOOTER or head["frame_number"] != foot["frame_number"] or head["num_blocks"] != foot["num_blocks"]:
        raise ValueError("header and footer of a message do not agree")
    at, end, found = ENDS.itemsize, len(payload) - ENDS.itemsize, []
    for _ in range(int(head["num_blocks"])):
        if at + HEAD.itemsize > end:
            raise ValueError("a block's header is cut off")
        block = np.frombuffer(payload, HEAD, 1, at)[0]
        at += HEAD.itemsize
        size, n, columns = int(block["data_byte_length"]), int(block["num_points"]), int(block["dims"]) + 1
        kind = FLOATS.get(int(block["dtype_code"]))
        if block["message_type"] != BLOCK or kind is None or at + size > end or size < n * columns * kind.itemsize:
            raise ValueError("a block is not one, or is cut off")
        data, names = size - n * columns * kind.itemsize, None
        if data:
            length = int.from_bytes(payload[at : at + 4], "little")
            names = payload[at + 4 : at + 4 + length].decode("ascii").split("\0")[:-1]
            if len(names) != n or 4 + length + (-length % 4) != data:
                raise ValueError("a block's names do not fit its points")
        found.append((block, names, np.frombuffer(payload, kind, n * columns, at + data).reshape(n, columns)))
        at += size
    if at != end:
        raise ValueError("bytes between the last block and the footer")
    return int(head["frame_number"]), found


def decoded(messages: DataFrame, by: list[str]) -> DataFrame:
    """by, frame, kind, camera_id, tracker_id, ord, name (null where a block has no names), x, y, z (null in two dimensions),
    visibility of every point of every message. messages: by, payload. A message that is not whole fails the query."""
    schema = ", ".join(f"`{k}` {messages.schema[k].dataType.simpleString()}" for k in by)
    schema += ", frame long, kind int, camera_id string, tracker_id string, ord int, name string, x double, y double, z double, visibility double"
    names = [*by, "frame", "kind", "camera_id", "tracker_id", "ord", "name", "x", "y", "z", "visibility"]

    def read(batches):
        for batch in batches:
            rows, frames, heads, texts, values = [], [], [], [], []
            for n, payload in enumerate(batch.column(len(by)).to_pylist()):
                frame, found = _read(payload or b"")
                for block, known, points in found:
                    wide = np.full((len(points), 4), np.nan)
                    wide[:, : points.shape[1] - 1], wide[:, 3] = points[:, :-1], points[:, -1]
                    rows.append(n), frames.append(frame), heads.append(block), values.append(wide)
                    texts += known or [None] * len(points)
            sizes = [len(v) for v in values]
            which = np.repeat(np.arange(len(rows)), sizes)
            flat = np.concatenate(values) if values else np.empty((0, 4))
            picked = lambda items, kind: pa.array(items, kind).take(pa.array(which))
            arrays = [
                *(batch.column(k).take(pa.array(np.array(rows, np.int64)[which])) for k in range(len(by))),
                picked(frames, pa.int64()), picked([int(h["block_kind"]) for h in heads], pa.int32()),
                picked([h["camera_id"].decode() for h in heads], pa.string()), picked([h["tracker_id"].decode() for h in heads], pa.string()),
                pa.array(np.concatenate([np.arange(s) for s in sizes]) if sizes else [], pa.int32()), pa.array(texts, pa.string()),
                *(pa.array(flat[:, c], pa.float64(), from_pandas=True) for c in range(4)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return messages.select(*by, "payload").mapInArrow(read, schema)
