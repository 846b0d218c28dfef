"""Slides and speech on one clock: intervals, overlap and as-of joins, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X
from tessera.sources.scratch import saved


def slide_intervals(slides: DataFrame, segments: DataFrame | None = None, video: str = "video_name", start: str = "start_time", order: tuple[str, ...] = ()) -> DataFrame:
    """``slides`` with end_time: the next slide's start; for a video's last, the end of its speech, else its own start.

    A video's slides are as many as it has cuts, so its window is small however many videos there are.
    """
    out = slides.withColumn("end_time", F.lead(start).over(W.partitionBy(video).orderBy(start, *order)))
    if segments is None:
        return out.withColumn("end_time", F.coalesce("end_time", start))
    last = segments.groupBy(F.col(video).alias("__video")).agg(F.max("end").alias("__last"))
    return out.join(last, F.col(video) == F.col("__video"), "left").withColumn("end_time", F.coalesce("end_time", "__last", start)).drop("__video", "__last")


def overlap_join(slides: DataFrame, segments: DataFrame, keys: list[str], video: str = "video_name", bucket: float = 60.0, counted: bool = False) -> DataFrame:
    """(keys, transcript[, segments]): the speech that overlaps each slide, in order of start, and how many segments it is;
    every slide stays.

    An overlap is ``seg.end > slide.start and seg.start < slide.end``. Both sides are dealt into time buckets of a
    video, so the join is on equal keys; a pair is kept in the one bucket where its overlap begins.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    left = slides.where("end_time >= start_time").select(*keys, F.col(video).alias("v"), F.col("start_time").alias("a"), F.col("end_time").alias("b"), spread(F.col("start_time"), F.col("end_time")).alias("bucket"))
    right = segments.where("end >= start").select(F.col(video).alias("v"), F.col("start").alias("s"), F.col("end").alias("e"), "text", spread(F.col("start"), F.col("end")).alias("bucket"))
    met = left.join(right, ["v", "bucket"]).where((F.col("e") > F.col("a")) & (F.col("s") < F.col("b")) & (F.col("bucket") == F.floor(F.greatest("a", "s") / bucket)))
    said = met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "e", "text"))), lambda x: x.text), " ").alias("transcript"), F.count("*").alias("segments"))
    out = slides.join(said, keys, "left").withColumns({"transcript": F.coalesce("transcript", F.lit("")), "segments": F.coalesce("segments", F.lit(0))})
    return out if counted else out.drop("segments")


def as_of(moments: DataFrame, slides: DataFrame, key: str, at: str, start: str, value: str, bucket: float = 3600.0) -> DataFrame:
    """``moments`` with the ``value`` of the last row of ``slides`` of the same key that starts at or before ``at``.

    The two are laid on one line for each key and bucket of time, and the last value is carried forward; what a bucket
    begins with comes from an aggregate of the earlier ones, so no window spans a key.
    """
    line = moments.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t"), F.lit(1).alias("asks"), F.struct(*moments.columns).alias("row"), F.lit(None).cast(slides.schema[value].dataType).alias("v"))
    marks = slides.select(F.col(key).alias("k"), F.col(start).cast("double").alias("t"), F.lit(0).alias("asks"), F.lit(None).cast(line.schema["row"].dataType).alias("row"), F.col(value).alias("v"))
    all_ = line.unionByName(marks).withColumn("b", F.floor(F.col("t") / bucket))
    ends = marks.withColumn("b", F.floor(F.col("t") / bucket)).groupBy("k", "b").agg(F.max_by("v", F.struct("t", "v")).alias("last"))
    buckets = all_.select("k", "b").distinct().join(ends, ["k", "b"], "left")
    before = buckets.withColumn("first", F.last("last", ignorenulls=True).over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))).select("k", "b", "first")
    within = F.last("v", ignorenulls=True).over(W.partitionBy("k", "b").orderBy("t", "asks", "v").rowsBetween(W.unboundedPreceding, 0))
    out = all_.withColumn("v", within).where("asks = 1").join(before, ["k", "b"], "left")
    return out.select("row.*", F.coalesce("v", "first").alias(value))


def segments_view(records: DataFrame, video: str | None = None) -> DataFrame:
    """Slide segments of records, one row each with nested time range and content; :func:`numbered` gives the index."""
    rows = records if video is None else records.where(F.col("video_name") == video)
    start = F.coalesce(F.col("start_time").cast("double"), F.lit(0.0))
    end = F.coalesce(F.col("end_time").cast("double"), start + 1800)
    lines = F.filter(F.transform(F.split(F.coalesce("ocr_text", F.lit("")), r"\R"), X.strip_ws), lambda x: x != "")
    chart = X.clean_placeholder("chart_description")
    rows = rows.withColumns({"__lines": lines, "__chart": chart, "__start": start, "__end": end})
    content = F.concat(F.when(F.size("__lines") > 1, F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")), F.when(F.col("__chart") != "", F.array("__chart")).otherwise(F.array().cast("array<string>")))
    title = F.coalesce(F.try_element_at("__lines", F.lit(1)), F.concat(F.lit("Segment "), F.col("ord").cast("string")))
    return rows.select(
        "ord", "video_name", F.coalesce("slide_image", F.lit("")).alias("slide_image"),
        F.struct(F.col("__start").alias("start_sec"), F.col("__end").alias("end_sec"), X.hhmmss("__start").alias("display_timestamp")).alias("time_range"),
        F.struct(F.struct(title.alias("title"), content.alias("content")).alias("visual_info"), X.strip_ws(F.coalesce("transcript", F.lit(""))).alias("audio_transcript")).alias("multimodal_content"),
    )


def numbered(df: DataFrame, *order: str, name: str = "slide_index") -> DataFrame:
    """Rows numbered 1..n over the whole table: numbers within range partitions, after the rows of those before.

    ``order`` has to tell rows apart. The sizes of the partitions are one row each.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "ranged")
    sizes = ranged.groupBy("__part").count()
    before = sizes.select("__part", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def slide_records(slides: DataFrame, video: str = "video_name") -> DataFrame:
    """Records of analysed slides (title, content, chart, start, end, transcript): texts joined, mentions found."""
    chart = F.when(F.col("chart_data").isin("null", "String or null"), "").otherwise(F.coalesce("chart_data", F.lit("")))
    ocr = X.strip_ws(F.concat_ws("\n", F.coalesce(X.blank_to_null("title"), F.lit("Untitled Slide")), "content"))
    number = F.row_number().over(W.partitionBy(video).orderBy("start_time"))
    out = slides.withColumns({"ocr_text": ocr, "chart_description": chart, "id": X.zero_filled(number.cast("string"))})
    every = F.concat_ws(" ", "transcript", "ocr_text", F.coalesce("chart_data", F.lit("")))
    entities = F.struct(X.rfc_mentions(every).alias("documents_mentioned"), X.protocol_mentions(every).alias("protocols_mentioned"))
    return out.select("id", video, F.round("start_time", 2).alias("start_time"), F.round("end_time", 2).alias("end_time"), "ocr_text", "chart_description", "transcript", entities.alias("extracted_entities"))


def slide_cuts(frames: DataFrame, video: str = "video", threshold: float = 0.96, gap: float = 2.0) -> DataFrame:
    """New slides of a video from frames (video, t, score, similarity to the anchor): below ``threshold`` and more than
    ``gap`` seconds after the last cut. What is next depends on the last accepted cut, so each video is folded."""

    def fold(pdf):
        kept, last = [], None
        for i, (t, s) in enumerate(zip(pdf["t"], pdf["score"])):
            if last is None or (s < threshold and t - last > gap):
                kept.append(i)
                last = t
        out = pdf.iloc[kept][[video, "t"]].copy()
        out["slide_id"] = range(1, len(out) + 1)
        return out

    kind = frames.schema[video].dataType.simpleString()
    return frames.groupBy(video).applyInPandas(lambda pdf: fold(pdf.sort_values("t", kind="stable")), f"{video} {kind}, t double, slide_id int")
