"""Entities and relationships as extracted, resolved into one row each."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in ``order``: an aggregate that is summed map-side, so no key gathers in a task."""
    rest = [c for c in df.columns if c not in keys]
    head = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(head).select(*keys, "__row.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def folded(descriptions: Column) -> Column:
    """Descriptions joined in order, each left out that the text so far contains."""
    add = lambda so_far, d: F.when((d == "") | F.contains(so_far, d), so_far).when(so_far == "", d).otherwise(F.concat_ws("; ", so_far, d))
    return F.aggregate(descriptions, F.lit(""), add)


def _named_entities(found: DataFrame) -> DataFrame:
    return found.withColumns({"canonical": X.canonical_name("name"), "kind": X.entity_type("type")}).where("canonical <> ''")


def _named_relationships(found: DataFrame) -> DataFrame:
    return found.withColumns({"cs": X.canonical_name("source"), "ct": X.canonical_name("target"), "kind": X.relation_type("rel_type")})


#: Names are sent to every task up to so many bytes, as measured; beyond that they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: An entity's and a relationship's key.
ENTITY_KEY, RELATIONSHIP_KEY = ("canonical", "kind"), ("cs", "kind", "ct")


def _key(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *columns).alias("key")


def _mentions(rows: DataFrame) -> DataFrame:
    return rows.where("text_unit_id is not null").select("key", "text_unit_id").distinct().withColumn("id", X.md5_id(F.col("key"), 12))


def _merged(rows: DataFrame, columns: tuple[str, ...], first: str, *sums: Column) -> DataFrame:
    """A row for each key: ``first`` of the first mention, sums, ord, and units, the number of different text units.

    Mentions are summed up by unit and then by key, so a hot key is spread over its units. Values of the first mention
    can't be summed up in a hash table, so Spark sorts; a hash of the key leads the order, and settles most comparisons.
    """
    rows = rows.withColumn("head", F.struct("ord", first))
    least = F.min("head").alias("head")
    by_unit = rows.groupBy(F.xxhash64(*columns).alias("h"), *columns, "text_unit_id").agg(least, *sums)
    merged = by_unit.groupBy("h", *columns).agg(least, *sums, F.count("text_unit_id").alias("units"))
    return merged.withColumns({"ord": F.col("head.ord"), first: F.col(f"head.{first}")}).drop("h", "head")


def _descriptions(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(key, descriptions): the different descriptions that are not empty, in order. Each is reduced to its first place
    before, so a group gathers descriptions and not mentions."""
    firsts = rows.where("description <> ''").groupBy(_key(columns), F.col("description").alias("d")).agg(F.min("ord").alias("o"))
    return firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x.d).alias("descriptions"))


def entity_mentions(found: DataFrame) -> DataFrame:
    """(key, id, text_unit_id): which text units name an entity, a row each, so that no name gathers all of its units."""
    return _mentions(_named_entities(found).select(_key(ENTITY_KEY), "text_unit_id"))


def relationship_mentions(found: DataFrame) -> DataFrame:
    """(key, id, text_unit_id): which text units hold a relationship, a row each; also of those between unknown ends."""
    return _mentions(_named_relationships(found).select(_key(RELATIONSHIP_KEY), "text_unit_id"))


def unit_counts(mentions: DataFrame) -> DataFrame:
    """(key, units): number of text units."""
    return mentions.groupBy("key").agg(F.count("*").alias("units"))


def with_unit_ids(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """``rows`` (key) with text_unit_ids, sorted: for tables whose hottest name's units fit in a row."""
    lists = mentions.groupBy("key").agg(F.array_sort(F.collect_list("text_unit_id")).alias("text_unit_ids"))
    return rows.join(lists, "key", "left").withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast("array<string>")))


def mention_rows(entities: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``mentions``, or what the lists of ``entities`` say where there are none."""
    return entities.select("key", "id", F.explode("text_unit_ids").alias("text_unit_id")) if mentions is None else mentions


def entity_rows(found: DataFrame) -> DataFrame:
    """``found`` (name, type, description, text_unit_id, ord) by canonical name and type: first spelling, descriptions
    folded in order, number of text units. Which units is in :func:`entity_mentions`."""
    rows = _named_entities(found)
    merged = _merged(rows, ENTITY_KEY, "name")
    merged = merged.withColumn("key", _key(ENTITY_KEY)).join(_descriptions(rows, ENTITY_KEY), "key", "left")
    description = F.coalesce(folded(F.col("descriptions")), F.lit("")).alias("description")
    return merged.select(X.md5_id(F.col("key"), 12).alias("id"), "name", F.col("kind").alias("type"), description, "canonical", "key", "ord", "units")


def keyed(found: Column) -> Column:
    """A list of (name, type) as one of (name, type, canonical, key); a name of which nothing is left has an empty canonical."""
    named = F.transform(found, lambda e: F.struct(e["name"].alias("name"), X.entity_type(e["type"]).alias("type"), X.canonical_name(e["name"]).alias("canonical")))
    return F.transform(named, lambda e: F.struct(e["name"].alias("name"), e["type"].alias("type"), e["canonical"].alias("canonical"), F.concat_ws("|", e["canonical"], e["type"]).alias("key")))


def found_keys() -> Column:
    """The different keys in ``found``."""
    return F.array_distinct(F.transform(F.filter("found", lambda e: e["canonical"] != ""), lambda e: e["key"]))


def entity_rows_of_units(units: DataFrame) -> DataFrame:
    """:func:`entity_rows` of ``units`` (ord, found), a row each with its list of (name, type, canonical, key), where nothing is
    described. A unit is counted at the first place of a key in its list, so mentions are summed up in one pass."""
    rows = units.select("ord", F.col("found.key").alias("keys"), F.posexplode("found").alias("at", "e")).where("e.canonical <> ''")
    first = (F.array_position("keys", F.col("e.key")) == F.col("at") + 1).cast("long").alias("first")
    rows = rows.select("e.canonical", F.col("e.type").alias("type"), F.struct(F.struct("ord", "at").alias("ord"), "e.name").alias("head"), first)
    merged = rows.groupBy("canonical", "type").agg(F.min("head").alias("head"), F.sum("first").alias("units")).withColumn("key", _key(("canonical", "type")))
    return merged.select(X.md5_id(F.col("key"), 12).alias("id"), "head.name", "type", F.lit("").alias("description"), "canonical", "key", "head.ord", "units")


def merge_entities(found: DataFrame) -> DataFrame:
    """:func:`entity_rows` with each entity's text units in a list."""
    return with_unit_ids(entity_rows(found), entity_mentions(found))


def relationship_rows(found: DataFrame, entities: DataFrame) -> DataFrame:
    """``found`` (source, target, rel_type, description, weight, text_unit_id, ord) between known entities, by canonical
    ends and type: weights summed, different descriptions in order, number of text units. Which units is in :func:`relationship_mentions`."""
    rows = _named_relationships(found)
    merged = _merged(rows.withColumn("ends", F.struct("source", "target")), RELATIONSHIP_KEY, "ends", F.sum("weight").alias("weight"))
    # the ends are looked up after mentions are summed up, so that as few rows as possible are joined
    names = entities.select("canonical").distinct()
    length = names.agg(F.sum(F.octet_length("canonical") + 16)).first()[0] or 0
    names = F.broadcast(names) if length <= BROADCAST_BYTES else names.hint("merge")
    for end in ("cs", "ct"):
        merged = merged.join(names.withColumnRenamed("canonical", end), end, "left_semi")
    merged = merged.withColumn("key", _key(RELATIONSHIP_KEY)).join(_descriptions(rows, RELATIONSHIP_KEY), "key", "left")
    merged = merged.withColumn("descriptions", F.coalesce("descriptions", F.array().cast("array<string>")))
    return merged.select(
        X.md5_id(F.col("key"), 12).alias("id"), "ends.source", "ends.target", F.col("kind").alias("rel_type"), F.array_join("descriptions", "; ").alias("description"),
        "weight", X.is_directional("kind").alias("is_directional"), "descriptions", F.col("cs").alias("source_name"), F.col("ct").alias("target_name"), "ord", "key", "units",
    )


def merge_relationships(found: DataFrame, entities: DataFrame) -> DataFrame:
    """:func:`relationship_rows` with each relationship's text units in a list."""
    return with_unit_ids(relationship_rows(found, entities), relationship_mentions(found))


def unit_entities(entities: DataFrame, units: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """``units`` with entity_ids, the sorted ids of the entities that name them; none is an empty list."""
    named = mention_rows(entities, mentions).groupBy(F.col("text_unit_id").alias("tu")).agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))
    return units.drop("entity_ids").join(named, units.id == named.tu, "left").drop("tu").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))


def index_meta(units: DataFrame, entities: DataFrame, relationships: DataFrame, communities: DataFrame) -> DataFrame:
    """One row of counts and different types."""
    counts = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    kinds = lambda c, name: F.array_sort(F.collect_set(c)).alias(name)
    parts = [counts(units, "text_units"), counts(entities, "entities", kinds("type", "entity_types")), counts(relationships, "relationships", kinds("rel_type", "rel_types")), counts(communities, "communities")]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = ["text_units", "entities", "relationships", "communities", "entity_types", "rel_types"]
    return rows.agg(*(F.max(c).alias(c) for c in names)).withColumn("indexed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def upsert_links(old: DataFrame, new: DataFrame, key: str = "meet", value: str = "link") -> DataFrame:
    """Links by meeting, the new one where there is one."""
    fresh = new.select(F.col(key).alias("k"), F.col(value).alias("v"))
    return old.join(fresh, old[key] == fresh.k, "full").select(F.coalesce("k", key).alias(key), F.coalesce("v", value).alias(value))
