"""Local, global and entity-graph search for batches of questions, each keyed by ``query_id``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X
from tessera.operators import linked
from tessera.operators.communities import member_rows
from tessera.operators.graph import expand
from tessera.operators.resolve import mention_rows
from tessera.sources.scratch import saved

#: Weight of the graph in a blended score, and what a community without a hit needs to be found by graph alone.
GRAPH_WEIGHT, DISCOVER = 0.3, 0.05


def related_entities(hits: DataFrame, entities: DataFrame, unit: str = "id", mentions: DataFrame | None = None) -> DataFrame:
    """``hits`` with related_entities, the entities that name the text unit, in table order."""
    wanted = hits.select(F.col(unit).alias("tu")).distinct()
    named = mention_rows(entities, mentions).select("key", F.col("text_unit_id").alias("tu")).join(wanted, "tu", "left_semi")
    named = named.join(entities.select("key", "ord", F.struct("name", "type", "description").alias("e")), "key")
    lists = named.groupBy("tu").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "e"))), lambda x: x.e).alias("related_entities"))
    return hits.join(lists, hits[unit] == lists.tu, "left").drop("tu").withColumn("related_entities", F.coalesce("related_entities", F.array().cast(lists.schema["related_entities"].dataType)))


def in_meetings(df: DataFrame, meetings: list[str], video: str = "source_video") -> DataFrame:
    """Rows of the named meetings, by lower-case stem."""
    return df.where(F.lower(X.stem(video)).isin([m.lower() for m in meetings])) if meetings else df


def any_in_meetings(df: DataFrame, meetings: list[str], refs: str = "source_refs") -> DataFrame:
    """Rows without references, or with one to a named meeting."""
    if not meetings:
        return df
    known = [m.lower() for m in meetings]
    return df.where((F.size(refs) == 0) | F.exists(refs, lambda r: F.lower(X.stem(r["source_video"])).isin(known)))


def community_graph_scores(communities: DataFrame, relevance: DataFrame) -> DataFrame:
    """(query_id, id, g): mean relevance of a community's members, 0 for one not reached. Only communities that some
    member of is reached come out; the others' mean is 0."""
    rows = member_rows(communities)
    members = rows.select("id", F.substring_index("key", "|", 1).alias("node"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    reached = relevance.join(members, "node").groupBy("query_id", "id").agg(F.sum("score").alias("s"))
    return reached.join(sizes, "id").select("query_id", "id", (F.col("s") / F.col("n")).alias("g"))


def global_search(hits: DataFrame, communities: DataFrame, adjacent: DataFrame, k: int, hops: int = 1, graph_weight: float = GRAPH_WEIGHT) -> DataFrame:
    """The k best communities a question: vector ``hits`` (query_id, id, score) of a double pool and those the graph
    reaches from their members, ranked by the blended score; graph scores are taken to nine decimals, so that the order in
    which they were summed up settles nothing. ``via_graph`` marks a vector score of exactly 0."""
    pool = hits.select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("v"))
    return blended(pool, community_graph_scores(communities, _relevance(pool, communities, adjacent, hops)), k, graph_weight)


def global_search_by_links(hits: DataFrame, nodes: DataFrame, links: DataFrame, k: int, graph_weight: float = GRAPH_WEIGHT) -> DataFrame:
    """:func:`global_search` in one hop over the packed blocks of :mod:`tessera.operators.linked`; ``nodes`` (node, stands, community,
    id): an entity's number, the number whose neighbours its name has, and its community's number and id."""
    pool = saved(hits.select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("v")), "pool")
    heads = nodes.where("node = community").select("id", "community")
    pairs = heads.join(F.broadcast(pool.select("query_id", "id").distinct()), "id").select("query_id", "community").collect()
    asked: dict = {}
    for q, c in sorted(tuple(r) for r in pairs):
        asked.setdefault(q, []).append(c)
    t = nodes.select("node", "stands", "community").toArrow()
    node, stands, label = (t[c].to_numpy() for c in ("node", "stands", "community"))
    order = np.argsort(node)
    found = linked.reached(links, [np.array(c) for c in asked.values()], label[order], stands[order])
    names = pool.sparkSession.createDataFrame(list(enumerate(asked)), f"q int, query_id {pool.schema['query_id'].dataType.simpleString()}")
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n"))
    g = found.join(sizes, "community").join(heads, "community").join(F.broadcast(names), "q").select("query_id", "id", (F.col("s") / F.col("n")).alias("g"))
    return blended(pool, g, k, graph_weight)


def blended(pool: DataFrame, g: DataFrame, k: int, graph_weight: float = GRAPH_WEIGHT) -> DataFrame:
    """The k best of ``pool`` (query_id, id, v) and of communities with graph scores ``g`` (query_id, id, g), as
    :func:`global_search` ranks them."""
    both = pool.join(g, ["query_id", "id"], "full").select("query_id", "id", F.coalesce("v", F.lit(0.0)).alias("v"), F.round(F.coalesce("g", F.lit(0.0)), 9).alias("g"), F.col("v").isNotNull().alias("hit"))
    kept = both.where(F.col("hit") | (F.col("g") >= DISCOVER))
    ranked = kept.withColumn("score", F.round((1 - graph_weight) * F.col("v") + graph_weight * F.col("g"), 6)).withColumn("via_graph", F.col("v") == 0.0)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "v", "g", "score", "via_graph", "rank")


def _relevance(pool: DataFrame, communities: DataFrame, adjacent: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, score) of what the graph reaches from the members of each question's communities. The first hop is
    made once a community, whatever the questions: the best over a union is the best of each part's best."""
    members = member_rows(communities).join(pool.select("id").distinct(), "id", "left_semi")
    seeds = members.select("id", F.substring_index("key", "|", 1).alias("node")).where("node <> ''")
    asked = pool.select("query_id", "id").distinct()
    if hops > 1:
        return expand(adjacent, asked.join(seeds, "id"), hops, by=("query_id",))
    near = expand(adjacent, seeds, hops, by=("id",))
    return asked.join(near, "id").groupBy("query_id", "node").agg(F.max("score").alias("score"))


def match_seeds(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, asked, node): entities by exact lower-case name; for a name without one, the first entity in table order
    where either name holds the other. Where one holds the other it holds its first three characters, so the two meet by
    those: a name is looked up by its own beginning among the grams of entities, and by its grams among their beginnings."""
    names = asked.select("query_id", X.strip_ws(F.lower(F.col("name"))).alias("asked")).distinct()
    known = entities.groupBy(F.lower("name").alias("node")).agg(F.min("ord").alias("o"))
    exact = names.join(known, names.asked == known.node).select("query_id", "asked", "node")
    rest = names.join(exact, ["query_id", "asked"], "left_anti").select("asked").distinct()
    inner = rest.select("asked", _beginning("asked").alias("gram")).join(known.select("node", "o", F.explode(_grams("node")).alias("gram")), "gram")
    outer = rest.select("asked", F.explode(_grams("asked")).alias("gram")).join(known.select("node", "o", _beginning("node").alias("gram")), "gram")
    met = inner.where(F.contains("node", "asked")).unionByName(outer.where(F.contains("asked", "node")))
    near = met.groupBy("asked").agg(F.min_by("node", "o").alias("node"))
    return exact.unionByName(names.join(exact, ["query_id", "asked"], "left_anti").join(near, "asked").select("query_id", "asked", "node"))


def _beginning(name: str) -> Column:
    return F.substring(name, 1, 3)


def _grams(name: str) -> Column:
    """All different stretches of up to three characters of a name, and the empty one."""
    at = F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1)))
    parts = F.flatten(F.transform(at, lambda i: F.array(*(F.substring(F.col(name), i, F.lit(n)) for n in (0, 1, 2, 3)))))
    return F.array_distinct(parts)


def neighbours(seeds: DataFrame, adjacent: DataFrame, hops: int = 1, most: int = 10) -> DataFrame:
    """(query_id, node, score, rank) of the best nodes reached besides the seeds."""
    reached = expand(adjacent, seeds, hops, by=("query_id",)).join(seeds.select("query_id", "node"), ["query_id", "node"], "left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    return reached.withColumn("rank", rank).where(F.col("rank") <= most)


def seed_relationships(seeds: DataFrame, near: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships among seeds and neighbours with a seed at one end at least; of each pair of ends the first row."""
    nodes = seeds.select("query_id", "node").distinct().withColumn("seed", F.lit(1)).unionByName(near.select("query_id", "node").withColumn("seed", F.lit(0)))
    rows = relationships.select(F.lower("source").alias("s"), F.lower("target").alias("t"), "source", "target", "description", "weight", "ord").where("s <> '' and t <> ''")
    left = nodes.select("query_id", F.col("node").alias("s"), F.col("seed").alias("s_seed"))
    right = nodes.select("query_id", F.col("node").alias("t"), F.col("seed").alias("t_seed"))
    met = rows.join(left, "s").join(right, ["query_id", "t"]).where("s_seed + t_seed > 0")
    pair = [F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")]
    first = met.groupBy("query_id", *pair).agg(F.min_by(F.struct("source", "target", "description", "weight", "ord"), "ord").alias("r"))
    return first.select("query_id", "r.*").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "ord")))
