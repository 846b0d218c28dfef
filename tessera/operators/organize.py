"""Evidence for an answer: cut-off, near-copies out, truncation, entities and references put together, prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X


def unit_chunks(hits: DataFrame) -> DataFrame:
    """Text units found (query_id, id, text, source_video, start_time, end_time, score, related_entities) as chunks."""
    title = F.when(F.coalesce("source_video", F.lit("")) == "", F.col("id")).otherwise(F.format_string("%s  %.1fs-%.1fs", "source_video", "start_time", "end_time"))
    ref = F.struct(F.col("id").alias("text_unit_id"), "source_video", "start_time", "end_time")
    return hits.select("query_id", F.col("id").alias("chunk_id"), F.lit("text_unit").alias("chunk_type"), title.alias("title"), F.col("text").alias("content"), "score", F.col("related_entities").alias("entities"), F.array(ref).alias("source_refs"))


def community_chunks(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("id").alias("chunk_id"), F.lit("community").alias("chunk_type"), "title", F.col("summary").alias("content"), "score", "entities", "source_refs")


def keep_distinct(ranked: Column, threshold: float) -> Column:
    """Of an array of (rank, chunk_id, words) in order, those not too alike to any kept before; a fold, so it suits the
    few chunks of one question."""
    step = lambda kept, c: F.when(F.exists(kept, lambda k: X.jaccard(k.words, c.words) >= threshold), kept).otherwise(F.concat(kept, F.array(c)))
    return F.aggregate(ranked, F.slice(ranked, 1, 0), step)


def organize(chunks: DataFrame, cutoff: float = -0.5, threshold: float = 0.8, most: int = 5) -> DataFrame:
    """Chunks at or above the cut-off, best first, without near-copies of better ones, at most ``most`` a question."""
    good = chunks.where(F.col("score") >= cutoff).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    lists = good.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", X.space_set("content").alias("words")))).alias("all"))
    kept = lists.select("query_id", F.posexplode(F.slice(keep_distinct(F.col("all"), threshold), 1, most)).alias("at", "k")).select("query_id", F.col("k.rank").alias("rank"), (F.col("at") + 1).alias("place"))
    return good.join(kept, ["query_id", "rank"]).drop("rank")


def consolidated_entities(chunks: DataFrame) -> DataFrame:
    """(query_id, name, type, description, frequency, rank): entities of all chunks by lower-case name. The first stands
    for it, or the first with a description where the first has none; the most frequent come first."""
    rows = chunks.select("query_id", "place", F.posexplode("entities").alias("at", "e")).where("e is not null")
    bare = F.coalesce("e.description", F.lit("")) == ""
    out = rows.groupBy("query_id", F.lower("e.name").alias("key")).agg(F.count("*").alias("frequency"), F.min_by("e", F.struct(bare.alias("bare"), "place", "at")).alias("e"), F.min(F.struct("place", "at")).alias("first"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("frequency"), "first"))
    return out.withColumn("rank", rank).select("query_id", "e.name", "e.type", "e.description", "frequency", "rank")


def consolidated_refs(chunks: DataFrame) -> DataFrame:
    """(query_id, reference columns) first of each video and start, in that order by rank."""
    rows = chunks.select("query_id", "place", F.posexplode("source_refs").alias("at", "r"))
    first = rows.groupBy("query_id", "r.source_video", "r.start_time").agg(F.min_by("r", F.struct("place", "at")).alias("r"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("source_video", "start_time"))
    return first.select("query_id", "r.*", rank.alias("rank"))


def _named(e: Column) -> Column:
    return F.concat(e["name"], F.lit("("), e["type"], F.lit(")"))


def _list(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))


def _seconds(r: Column) -> Column:
    return F.format_string("%.1fs-%.1fs", r["start_time"], r["end_time"])


def chunk_section(limit: int = 800) -> Column:
    """A chunk as it is shown to a model: its id, topic, content cut to size, up to three entities and two sources."""
    sources = F.transform(F.slice("source_refs", 1, 2), lambda r: F.concat(F.lit("[SOURCE: "), r["source_video"], F.lit("  "), _seconds(r), F.lit("]")))
    return F.concat_ws(
        "\n", F.concat(F.lit("[CHUNK_ID: "), F.col("chunk_id"), F.lit("]  ("), F.col("chunk_type"), F.lit(")")),
        F.when((F.col("chunk_type") == "community") & (F.col("title") != ""), F.concat(F.lit("Topic: "), F.col("title"))),
        X.cut("content", limit, "..."), _list("Entities: ", F.transform(F.slice("entities", 1, 3), _named)), F.when(F.size(sources) > 0, F.array_join(sources, "\n")),
    )


def prompt_text(chunks: DataFrame, key_entities: DataFrame, limit: int = 800) -> DataFrame:
    """(query_id, prompt): the sections in order, then up to ten key entities."""
    sections = chunks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", chunk_section(limit).alias("s")))), lambda x: x.s), "\n\n---\n\n").alias("body"))
    line = F.concat(F.lit("  "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), F.substring("description", 1, 80))).otherwise(""))
    keys = key_entities.where("rank <= 10").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x.l), "\n").alias("names"))
    return sections.join(keys, "query_id", "left").select("query_id", F.concat_ws("\n\n", "body", F.when(F.col("names").isNotNull(), F.concat(F.lit("KEY ENTITIES:\n"), F.col("names")))).alias("prompt"))


def context_text(hits: DataFrame) -> DataFrame:
    """(query_id, context): text units found, each with its source line and up to five entities."""
    piece = F.concat_ws(
        "\n", F.concat(F.lit("[SOURCE_ID: "), F.col("id"), F.lit("  video="), F.col("source_video"), F.lit("  time="), _seconds(F.struct("start_time", "end_time")), F.lit("]")), "text",
        _list("Related entities: ", F.transform(F.slice("related_entities", 1, 5), _named)),
    )
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", piece.alias("p")))), lambda x: x.p), "\n\n").alias("context"))
