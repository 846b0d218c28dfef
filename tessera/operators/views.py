"""What a browser is shown: the graph, parts of it, and profiles of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.communities import member_rows
from tessera.operators.graph import both_ways, degrees
from tessera.operators.resolve import mention_rows


def graph_nodes(entities: DataFrame, units: DataFrame, communities: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(id, type, description, community_id, meetings) for every entity; the community of lowest level, and first in it."""
    places = mention_rows(entities, mentions).select("key", F.col("text_unit_id").alias("tu")).join(units.select(F.col("id").alias("tu"), X.stem("source_video").alias("m")), "tu")
    meetings = places.groupBy("key").agg(F.array_sort(F.collect_set("m")).alias("meetings"))
    members = member_rows(communities).select(F.col("id").alias("c"), "level", F.substring_index("key", "|", 1).alias("name"))
    first = members.groupBy("name").agg(F.min_by("c", F.struct("level", "c")).alias("community_id"))
    out = entities.join(meetings, "key", "left").join(first, F.lower(entities.name) == first.name, "left")
    return out.select(entities.name.alias("id"), "type", "description", F.coalesce("community_id", F.lit("")).alias("community_id"), F.coalesce("meetings", F.array().cast("array<string>")).alias("meetings"))


def graph_links(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Links whose both ends are nodes."""
    rows = relationships.select("source", "target", "weight", "description").where("source <> '' and target <> ''")
    names = entities.select("name").distinct()
    for end in ("source", "target"):
        rows = rows.join(names.withColumnRenamed("name", end), end, "left_semi")
    return rows.select("source", "target", "weight", "description")


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among ``nodes`` (node)."""
    out = links
    for end in ("source", "target"):
        out = out.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return out.select(*links.columns)


def visible(links: DataFrame, nodes: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) whose type isn't hidden, and links between them."""
    shown = nodes.where(~F.col("type").isin(hidden)) if hidden else nodes
    return shown, induced(links, shown.select(F.col("id").alias("node")))


def neighbourhood(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (node) and all they link to."""
    near = both_ways(links).join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("neighbour").alias("node"))
    return nodes.select("node").unionByName(near).distinct()


def top_degree(links: DataFrame, k: int = 40) -> DataFrame:
    return degrees(links).orderBy(F.desc("degree"), "node").limit(k)


def answer_subgraph(links: DataFrame, cited: DataFrame, k: int = 40, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes and links shown with an answer: the cited entities (node) and neighbours by name up to ``most``; without a
    cited one, the ``k`` nodes of most links."""
    if not cited.limit(1).count():
        nodes = top_degree(links, k).select("node")
    else:
        near = neighbourhood(links, cited).join(cited, "node", "left_anti").withColumn("far", F.lit(1))
        nodes = cited.select("node").distinct().withColumn("far", F.lit(0)).unionByName(near).orderBy("far", "node").limit(most).select("node")
    return nodes, induced(links, nodes)


def node_search(nodes: DataFrame, word: str) -> DataFrame:
    w = F.lit(word.lower())
    return nodes.where(F.contains(F.lower("id"), w) | F.contains(F.lower("type"), w))


def keyword_search(entities: DataFrame, word: str) -> DataFrame:
    w = F.lit(word.lower())
    return entities.where(F.contains(F.lower(F.coalesce("name", F.lit(""))), w) | F.contains(F.lower(F.coalesce("description", F.lit(""))), w))


def table_profile(df: DataFrame) -> DataFrame:
    """(column, kind, row_count, null_count) for each column, in one pass."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"c{i}")).alias("null_count")) for i, (c, t) in enumerate(df.dtypes)))
    return counts.select(F.inline(each))


def column_profile(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row: different values, nulls, and for numbers least, greatest, mean and deviation."""
    c = F.col(column)
    distinct = F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    number = df.schema[column].dataType.simpleString() in ("int", "bigint", "double", "float", "smallint", "tinyint") or df.schema[column].dataType.typeName() == "decimal"
    more = [F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("deviation")] if number else []
    return df.agg(distinct.alias("distinct_count"), F.count_if(c.isNull()).alias("null_count"), *more)


def value_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value is not null").orderBy(F.desc("n"), "value").limit(k)


def categorical_profile(df: DataFrame, column: str, most: int = 20, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values (value, n) of a column of at most ``most`` different ones, none of any other."""
    different = df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1)
    few = different.agg(F.count("*").alias("n")).where(F.col("n") <= most)  # one row, or none
    return value_counts(df, column, k).join(F.broadcast(few), how="left_semi")


def missing_meetings(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Meetings asked for that there are none of, once each."""
    return wanted.select("meeting").distinct().join(available.select("meeting"), "meeting", "left_anti")


def numeric_means(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(metric, average): the mean of every numeric column to four places."""
    numbers = [c for c, t in df.dtypes if c not in skip and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    each = F.array(*(F.struct(F.lit(c).alias("metric"), F.round(F.avg(F.col(f"`{c}`")), 4).alias("average")) for c in numbers))
    return df.agg(each.alias("all")).select(F.inline("all"))


def image_matches(records: DataFrame) -> DataFrame:
    """(with_image): how many records have an image."""
    return records.agg(F.count_if(F.coalesce("slide_image", F.lit("")) != "").alias("with_image"))


def token_usage(calls: DataFrame, *by: str) -> DataFrame:
    """(by, tokens): what prompts and completions took together; a count that is missing is none."""
    used = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    return calls.groupBy(*by).agg(F.sum(used).alias("tokens"))
