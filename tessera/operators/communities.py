"""Communities of entities: members, text units, inner relationships, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X
from tessera.operators.resolve import mention_rows



#: Members of a community that its report is made of, at most; and those that its summary names.
REPORTED, NAMED = 20, 5


def members(partition: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, level, key) of ``partition`` (node = entity key, community), a row for each member. The id is a digest of the
    smallest member, so it does not change from run to run; the level is 0."""
    rows = partition.join(entities.select("key"), partition.node == entities.key).select("community", "key")
    ids = rows.groupBy("community").agg(F.min("key").alias("least")).select("community", X.md5_id(F.col("least"), 8).alias("id"))
    return rows.join(ids, "community").select("id", F.lit(0).alias("level"), "key")


def member_rows(communities: DataFrame) -> DataFrame:
    """(id, [level,] key), a row for each member: of a table that is so already, or that has them in lists."""
    if "key" in communities.columns:
        return communities
    level = [c for c in communities.columns if c == "level"]
    return communities.select("id", *level, F.explode("entity_names").alias("key"))


def _structs(entities: DataFrame) -> DataFrame:
    return entities.select("key", F.struct("key", "id", "name", "type", "description").alias("e"))


def described(belong: DataFrame, entities: DataFrame) -> DataFrame:
    """Communities of :func:`members`, a row each: how many members and who comes first, which is all that reports are
    made of. The whole of a community is in the long table only."""
    place = F.row_number().over(W.partitionBy("id").orderBy("key"))
    first = belong.withColumn("place", place).where(F.col("place") <= REPORTED)
    shown = first.select("id", "key").join(_structs(entities), "key")
    lists = shown.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    sizes = belong.groupBy("id", "level").agg(F.count("*").alias("entity_count"))
    rows = sizes.join(lists, "id")
    return rows.select("id", "level", F.transform("entities", lambda x: x.key).alias("entity_names"), "entity_count", "entities")


def assemble(partition: DataFrame, entities: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Communities with their members and text units in lists, for communities that fit in a row; :func:`members` and
    :func:`described` hold them whatever their size."""
    belong = members(partition, entities)
    named = mention_rows(entities, mentions).select("key", F.col("text_unit_id").alias("tu"))
    units = belong.join(named, "key").groupBy("id").agg(F.array_sort(F.collect_set("tu")).alias("text_unit_ids"))
    lists = belong.join(_structs(entities), "key").groupBy("id", "level").agg(F.array_sort(F.collect_list("e")).alias("entities"))
    out = lists.join(units, "id", "left").withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast("array<string>")))
    return out.select("id", "level", F.transform("entities", lambda x: x.key).alias("entity_names"), "text_unit_ids", F.size("entities").alias("entity_count"), "entities")


def inner_relationships(communities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, relationship columns) of relationships with both canonical ends among a community's members, by two equal
    joins on (community, name); types of members play no part."""
    names = member_rows(communities).select(F.col("id").alias("community"), F.substring_index("key", "|", 1).alias("name")).distinct()
    rows = relationships.join(names.withColumnRenamed("name", "source_name"), "source_name")
    return rows.join(names.withColumnRenamed("name", "target_name"), ["community", "target_name"], "left_semi")


def reports(communities: DataFrame) -> DataFrame:
    """A title and summary by template where no model gives them: the first members, at most twenty with descriptions."""
    line = lambda e: F.concat(F.lit("- "), e["name"], F.lit(" ("), e["type"], F.lit("): "), F.substring(e["description"], 1, 120))
    summary = F.array_join(F.slice("entity_names", 1, NAMED), ", ")
    return communities.withColumns({
        "report_input": F.array_join(F.transform(F.slice("entities", 1, REPORTED), line), "\n"),
        "title": F.concat(F.lit("Community "), F.col("id")),
        "summary": F.when(F.size("entity_names") > 0, summary).otherwise("No members."),
    })
