"""Answers from evidence, their citations, and what a client is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X

FALLBACK = "I could not find relevant information in the indexed meetings."


def extractive_answers(queries: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, answer, is_fallback): the first sentences of the best chunks, each with its citation. A question
    without evidence gets the fallback text."""
    first = X.cut(X.strip_ws(X.sentences(X.without_meeting_prefix("content"))[0]), 300)
    said = chunks.where(F.col("place") <= most).select("query_id", "place", F.concat(first, F.lit(" [REF:"), F.col("chunk_id"), F.lit("]")).alias("s"))
    texts = said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "s"))), lambda x: x.s), " ").alias("answer"))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(FALLBACK)).alias("answer"), F.col("answer").isNull().alias("is_fallback"))


def resolved_citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, ordinal, chunk_id, chunk_type, title, source_refs): each known id an answer cites, once, in order."""
    marks = answers.select("query_id", F.posexplode(X.citations("answer")).alias("at", "chunk_id"))
    met = marks.join(chunks.select("query_id", "chunk_id", "chunk_type", "title", "source_refs", "entities"), ["query_id", "chunk_id"])
    return met.withColumn("ordinal", F.row_number().over(W.partitionBy("query_id").orderBy("at"))).drop("at")


def cited_entity_names(citations: DataFrame) -> DataFrame:
    """(query_id, names): entity names of the cited chunks, once each, in order."""
    rows = citations.select("query_id", "ordinal", F.posexplode("entities").alias("at", "e"))
    first = rows.groupBy("query_id", F.col("e.name").alias("name")).agg(F.min(F.struct("ordinal", "at")).alias("o"))
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("names"))


def reference_list(citations: DataFrame) -> DataFrame:
    """(query_id, references): a numbered list, with two sources of a chunk at most, or its title without any."""
    of = lambda r: F.concat(F.lit("  ["), F.col("ordinal").cast("string"), F.lit("] "), r["source_video"], F.lit("  "), F.format_string("%.1fs-%.1fs", r["start_time"], r["end_time"]))
    lines = F.when(F.size("source_refs") > 0, F.array_join(F.transform(F.slice("source_refs", 1, 2), of), "\n")).otherwise(F.concat(F.lit("  ["), F.col("ordinal").cast("string"), F.lit("] "), F.col("title")))
    rows = citations.select("query_id", "ordinal", lines.alias("l")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "l"))).alias("ls"))
    return rows.select("query_id", F.concat(F.lit("References:\n"), F.array_join(F.transform("ls", lambda x: x.l), "\n")).alias("references"))


def with_urls(df: DataFrame, links: DataFrame, video: str = "source_video") -> DataFrame:
    """``df`` with video_url by the stem of its video; an unknown one is empty. Of repeated links the last counts."""
    known = links.groupBy(F.col("meet").alias("__meet")).agg(F.max_by("link", "ord").alias("video_url"))
    return df.join(known, X.stem(X.without_meeting_prefix(video)) == F.col("__meet"), "left").drop("__meet").withColumn("video_url", F.coalesce("video_url", F.lit("")))


def tab_meetings(tabs: DataFrame, links: DataFrame) -> DataFrame:
    """``tabs`` (url, ...) with the meeting whose link shows the same video, the first by name; null without one."""
    known = links.select(X.youtube_id("link").alias("__video"), "meet").where("__video is not null").groupBy("__video").agg(F.min("meet").alias("meeting"))
    return tabs.join(known, X.youtube_id("url") == F.col("__video"), "left").drop("__video")


def without_evidence(queries: DataFrame, chunks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, is_fallback): whether a question has neither chunks nor entities to start from."""
    any_ = chunks.select("query_id").unionByName(seeds.select("query_id")).distinct().withColumn("__has", F.lit(True))
    return queries.select("query_id").join(any_, "query_id", "left").select("query_id", F.col("__has").isNull().alias("is_fallback"))


def response(queries: DataFrame, answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, body): the JSON a client is sent."""
    cited = citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "chunk_type", "title", "source_refs"))).alias("citations"))
    all_ = queries.select("query_id", "query_type").join(answers, "query_id").join(cited, "query_id", "left").join(cited_entity_names(citations), "query_id", "left")
    empty = F.array().cast(cited.schema["citations"].dataType)
    body = F.struct("answer", "query_type", "is_fallback", F.coalesce("citations", empty).alias("citations"), F.coalesce("names", F.array().cast("array<string>")).alias("cited_entity_names"))
    return all_.select("query_id", F.to_json(body).alias("body"))
