"""Videos and slides as files, and what plugged-in models make of them: speech, frames, slides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X

#: What an analysed slide has; chart is null where there is none.
SLIDE = "path string, status string, title string, content array<string>, kind string, chart_data string, error string"


def files(spark: SparkSession, folder: str, pattern: str = "*.mp4", per_batch: int = 0) -> DataFrame:
    """(path, length, modificationTime) of files below a folder, contents unread. With ``per_batch`` it is a stream that takes
    so many at a time, so that what waits for a model stays in storage and not in memory."""
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    if per_batch:
        schema = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(schema).options(**options, maxFilesPerTrigger=str(per_batch)).load(folder).drop("content")
    return spark.read.format("binaryFile").options(**options).load(folder).select("path", "length", "modificationTime")


def speech_segments(videos: DataFrame, transcribe: Callable[[str], list[tuple[float, float, str]]]) -> DataFrame:
    """(video_name, start, end, text) of each file: times to two places, texts stripped, one file at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf["path"]:
                rows = [(path, float(a), float(b), t) for a, b, t in transcribe(path)]
                yield pd.DataFrame(rows, columns=["path", "start", "end", "text"])

    said = videos.select("path").mapInPandas(run, "path string, start double, end double, text string")
    return said.select(X.basename("path").alias("video_name"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), X.strip_ws("text").alias("text"))


def analysed_slides(images: DataFrame, analyse: Callable[[str], dict]) -> DataFrame:
    """A row (SLIDE) for each image, on a table or a stream. ``analyse`` gives title, content, type and chart_data; where it
    fails, the row says so and has a title to show."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path in pdf["path"]:
                try:
                    got = analyse(path)
                    rows.append((path, "done", got.get("title"), list(got.get("content") or []), got.get("type"), got.get("chart_data"), None))
                except Exception as e:  # a model may fail in any way
                    rows.append((path, "failed", "Parse failed", [], "unknown", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SLIDE.split(", ")])

    return images.select("path").mapInPandas(run, SLIDE)
