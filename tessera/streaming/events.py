"""Streams: the slide at a playhead, new records as they come, sessions and windows of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.timeline import as_of


def current_slides(moments: DataFrame, slides: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, key: str = "video_name", at: str = "at"):
    """A query that gives each moment of a stream its slide, batch by batch, against a table of slides."""

    def each(batch: DataFrame, number: int) -> None:
        emit(as_of(batch, slides, key, at, "start_time", "slide"), number)

    return moments.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_records(records: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands new records to ``apply`` in batches, each once by its number."""
    return records.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None, user: str = "user_id", at: str = "ts") -> DataFrame:
    """(user, start, end, n): events of a user no further than ``gap`` apart; the same on a table and on a stream."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None, at: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    rows = events.withWatermark(at, late) if late else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = rows.groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


def cuts(frames: DataFrame, video: str = "video", threshold: float = 0.96, gap: float = 2.0) -> DataFrame:
    """(video, t) of new slides from a stream of frames (video, t, score), as :func:`tessera.operators.timeline.slide_cuts`
    finds them on a table, where a video's frames come in order. Its last cut is the state of a video."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values("t", kind="stable")
        kept = []
        for t, score in zip(pdf["t"], pdf["score"], strict=True):
            if last is None or (score < threshold and t - last > gap):
                kept.append(t)
                last = float(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({video: [key[0]] * len(kept), "t": kept})

    kind = frames.schema[video].dataType.simpleString()
    return frames.groupBy(video).applyInPandasWithState(step, f"{video} {kind}, t double", "last double", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """What streams have done so far: ``status`` is (batches, rows, state) by a stream's name or id, for a client to poll.
    Register it with ``spark.streams.addListener``."""

    def __init__(self):
        self.status: dict[str, tuple[int, int, str]] = {}
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.names[str(event.id)] = event.name or str(event.id)
        self.status[self.names[str(event.id)]] = (0, 0, "running")

    def onQueryProgress(self, event):
        name = self.names.get(str(event.progress.id), str(event.progress.id))
        batches, rows, _ = self.status.get(name, (0, 0, ""))
        self.status[name] = (batches + 1, rows + event.progress.numInputRows, "running")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        name = self.names.get(str(event.id), str(event.id))
        batches, rows, _ = self.status.get(name, (0, 0, ""))
        self.status[name] = (batches, rows, "failed" if event.exception else "done")
