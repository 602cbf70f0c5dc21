"""Frames of cameras that wait for the skeleton of the same frame, with bounded state.

A recording has at most `most` results that no frame has asked for (the smallest frame numbers go first) and one frame
that waits. A frame meets a result that is there, or the one that comes within `wait`; it goes on without where the
time is over or the next frame comes. One loop, whether rows come in one batch or one by one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .replay import together

MOST_PENDING = 2
OUT = "recording long, frame long, ts timestamp, result double, status string"


@dataclass
class Pending:
    """Results by frame, and the frame that waits: (frame, ts) in microseconds."""

    wait: int
    most: int = MOST_PENDING
    results: dict[int, float] = field(default_factory=dict)
    waiting: tuple[int, int] | None = None

    def passed(self, now: int) -> list[tuple]:
        """What the time lets go: (frame, ts, result, status)."""
        if self.waiting is None or self.waiting[1] + self.wait >= now:
            return []
        gone, self.waiting = self.waiting, None
        return [(*gone, None, "timed_out")]

    def camera(self, frame: int, ts: int) -> list[tuple]:
        out = self.passed(ts)
        if self.waiting is not None:
            out.append((*self.waiting, None, "overtaken"))
            self.waiting = None
        if frame in self.results:
            return [*out, (frame, ts, self.results.pop(frame), "matched")]
        self.waiting = (frame, ts)
        return out

    def result(self, frame: int, ts: int, value: float) -> list[tuple]:
        out = self.passed(ts)
        if self.waiting is not None and self.waiting[0] == frame:
            out.append((*self.waiting, value, "matched"))
            self.waiting = None
        else:
            self.results[frame] = value
            for old in sorted(self.results)[: -self.most]:
                del self.results[old]
        return out


HELD = "owners array<long>, frames array<long>, results array<double>, waiters array<long>, waiting array<long>, since array<long>, timer long"


class PendingFrames(StatefulProcessor):
    """The state of a few recordings (`replay.together`): of each `most` results and one frame that waits; and a timer for the
    first of these."""

    def __init__(self, wait_seconds: float, most: int = MOST_PENDING):
        self.wait, self.most = int(wait_seconds * 1_000_000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def _due(self, since: int) -> int:
        """The first millisecond at which a frame has waited too long."""
        return (since + self.wait) // 1000 + 1

    def _load(self) -> tuple[dict[int, Pending], int | None]:
        pending: dict[int, Pending] = defaultdict(lambda: Pending(self.wait, self.most))
        if not self.held.exists():
            return pending, None
        owners, frames, results, waiters, waiting, since, timer = self.held.get()
        for recording, frame, value in zip(owners, frames, results, strict=True):
            pending[recording].results[frame] = value
        for recording, frame, ts in zip(waiters, waiting, since, strict=True):
            pending[recording].waiting = (frame, ts)
        return pending, timer

    def _store(self, pending: dict[int, Pending], timer: int | None) -> None:
        """timer: the one that is registered."""
        results = [(recording, *result) for recording, p in pending.items() for result in p.results.items()]
        waiting = [(recording, *p.waiting) for recording, p in pending.items() if p.waiting is not None]
        first = min((self._due(since) for _, _, since in waiting), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        self.held.update((*([row[k] for row in results] for k in range(3)), *([row[k] for row in waiting] for k in range(3)), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (pending, timer), out = self._load(), []
        come = pd.concat(list(rows)).sort_values(["micros", "kind"], kind="stable")
        for recording, kind, frame, micros, value in zip(*(come[c].tolist() for c in ("recording", "kind", "frame", "micros", "value")), strict=True):
            mine = pending[recording]
            told = mine.camera(frame, micros) if kind == "camera" else mine.result(frame, micros, value)
            out += [(recording, *one) for one in told]
        self._store(pending, timer)
        yield self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Tells all frames whose time is over at the watermark, not just the one of the timer."""
        (pending, _), now, over = self._load(), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        gone = [(r, self._due(p.waiting[1])) for r, p in pending.items() if p.waiting is not None]
        out = [(r, *one) for r, due in gone if due <= now or due < over for one in pending[r].passed(due * 1000)]
        self._store(pending, None)
        yield self._told(out)

    def _told(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["recording", "frame", "ts", "result", "status"])
        return frame.assign(ts=pd.to_datetime(frame["ts"], unit="us"), result=frame["result"].astype(float)).astype({"recording": "int64", "frame": "int64"})

    def close(self) -> None:
        pass


def pending_frames(events: DataFrame, wait_seconds: float, most: int = MOST_PENDING, late: str = "0 seconds") -> DataFrame:
    """recording, frame, ts, result, status (matched, overtaken, timed_out) of camera frames. events: a stream of recording,
    kind (camera or result), frame, ts, value; the session keeps state in RocksDB (`replay.stateful_session`). A frame
    that waits is told when the watermark is over its time, at the latest."""
    rows = events.withColumn("micros", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.withColumn("_state", together()).groupBy("_state").transformWithStateInPandas(PendingFrames(wait_seconds, most), OUT, "Append", "EventTime")


def pending_in_order(events: DataFrame, wait_seconds: float, most: int = MOST_PENDING) -> DataFrame:
    """The same over a table, where frames and results each come in order of their numbers. A frame's result is still there if
    fewer than `most` later ones came before it."""
    ordered = Window.partitionBy("recording").orderBy("frame")
    cameras = events.where("kind = 'camera'").select("recording", "frame", "ts", F.lead("ts").over(ordered).alias("next"))
    came = events.where("kind = 'result'").select("recording", "frame", F.col("ts").alias("came"), "value", F.lead("ts", most).over(ordered).alias("gone"))
    last = events.agg(F.max("ts").alias("end"))
    met = cameras.join(came, ["recording", "frame"], "left").join(F.broadcast(last))  # one row
    until = F.timestamp_micros((F.unix_micros("ts") + int(wait_seconds * 1_000_000)).cast("long"))
    there = (F.col("came") <= F.col("ts")) & F.coalesce(F.col("gone") > F.col("ts"), F.lit(True))
    soon = (F.col("came") > F.col("ts")) & (F.col("came") <= until) & F.coalesce(F.col("came") < F.col("next"), F.lit(True))
    status = F.when(there | soon, "matched").when(F.col("next") <= until, "overtaken").when(until < F.col("end"), "timed_out")
    told = met.withColumn("status", status).where("status is not null")
    return told.select("recording", "frame", "ts", F.when(F.col("status") == "matched", F.col("value")).alias("result"), "status")
