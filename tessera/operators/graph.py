"""Weighted graphs as two tables: adjacency, expansion, components and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.scratch import once, saved


#: Edges of a component that Louvain takes into one task, at most.
MOST_EDGES = 250_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, neighbour, weight) from (source, target, weight), each edge in both directions."""
    there = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), F.col("weight").cast("double").alias("weight"))
    return there.unionByName(there.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "weight"))


def adjacency(relationships: DataFrame, key: str = "lower") -> DataFrame:
    """Undirected adjacency by lower-case name, or by canonical name with ``key="canonical"``; parallel edges stay."""
    name = F.lower if key == "lower" else X.canonical_name
    rows = relationships.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    return both_ways(rows.select(name(F.col("source")).alias("source"), name(F.col("target")).alias("target"), "weight"))


def expand(adjacent: DataFrame, seeds: DataFrame, hops: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, node, score) of what ``seeds`` (by, node) reach in ``hops``: 1 for a seed; for a node first reached at hop h the
    best of its neighbours' scores times the weight relative to the largest, times one half for each hop before."""
    adjacent = once(adjacent, "adjacent")
    most = adjacent.agg(F.max("weight")).first()[0] or 1.0
    share = adjacent.select(F.col("node").alias("at"), "neighbour", (F.col("weight") / F.lit(most)).alias("share"))
    seen = seeds.select(*by, "node").distinct().withColumn("score", F.lit(1.0))
    frontier = seen
    for hop in range(hops):
        step = frontier.join(share, frontier.node == share.at).select(*by, F.col("neighbour").alias("node"), (F.col("score") * F.col("share") * 0.5**hop).alias("score"))
        # the best of each node first: that is summed map-side, and leaves the anti join a row a node, placed by its keys
        best = step.groupBy(*by, "node").agg(F.max("score").alias("score")).where("score > 0")
        frontier = best.join(seen.select(*by, "node"), [*by, "node"], "left_anti")
        frontier = saved(frontier, "frontier") if hop + 1 < hops else frontier
        seen = seen.unionByName(frontier)
    return seen


def entity_graph(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, weight) between entity keys, parallel and opposite edges summed. A name of several types stands
    for the one that came first."""
    first = entities.groupBy("canonical").agg(F.min_by("key", "ord").alias("key"))
    side = lambda end: first.select(F.col("canonical").alias(end + "_name"), F.col("key").alias(end + "_key"))
    rows = relationships.join(side("source"), "source_name").join(side("target"), "target_name")
    return collapsed(rows.select(F.col("source_key").alias("source"), F.col("target_key").alias("target"), "weight"))


def collapsed(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    return ends.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): incident edges, a loop counting twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def components(vertices: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component) with the smallest node of each component. Labels spread to neighbours and then jump to their
    label's label, so rounds are about the logarithm of the longest path; each round is written."""
    pairs = edges.where("source <> target").select("source", "target")
    pairs = saved(pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "pairs")
    now = saved(vertices.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct(), "labels")
    while True:
        lent = pairs.join(now.withColumnRenamed("node", "target"), "target").groupBy("source").agg(F.min("label").alias("near"))
        near = now.join(lent, now.node == lent.source, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        # a label's own label may be lower by now; it is known by that node's row
        hop = near.select(F.col("node").alias("n"), F.col("low").alias("lower"))
        jumped = near.join(hop, near.low == hop.n, "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label"), (F.least("low", F.coalesce("lower", "low")) != F.col("label")).alias("moved"))
        after = saved(jumped, "labels")
        now = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return now.withColumnRenamed("label", "component")


def label_propagation(vertices: DataFrame, edges: DataFrame, rounds: int = 5, node: str = "node") -> DataFrame:
    """(node, community) after ``rounds`` in which each node takes the label of most weight around it, its own included and
    ties to the smaller: a distributed community search whose result does not change from run to run."""
    adjacent = saved(both_ways(edges.where("source <> target")), "adjacent")
    now = vertices.select(F.col(node).alias("node"), F.col(node).alias("label")).distinct()
    for _ in range(rounds):
        votes = adjacent.join(now.withColumnRenamed("node", "neighbour"), "neighbour").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        tied = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("won"))
        now = saved(now.join(tied, "node", "left").select("node", F.least("label", F.coalesce("won", "label")).alias("label")), "labels")
    return now.withColumnRenamed("label", "community")


def louvain(vertices: DataFrame, edges: DataFrame, component: DataFrame | None = None, resolution: float = 1.0, node: str = "node", numbered: int | None = None, most: int = MOST_EDGES) -> DataFrame:
    """(node, community) by greedy modularity, component by component: communities never span components, so each is a
    group of its own, and nodes are visited in order, so runs agree. A component that is given has to fit in a task. Where
    none is, a graph of more than ``most`` edges goes through :func:`numbered.louvain`, in blocks, whatever the size of its components.
    ``numbered``: nodes are numbers below this already."""
    if component is None:
        edges = once(edges, "edges")
        if edges.count() > most:
            return _louvain_in_blocks(vertices, edges, resolution, node, numbered, most)
    parts = component if component is not None else components(vertices, edges, node)
    kind = vertices.schema[node].dataType.simpleString()
    total = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    rows = edges.join(parts.withColumnRenamed("node", "source"), "source").select("component", "source", "target", F.col("weight").cast("double").alias("weight"))

    def run(pdf):
        import pandas as pd

        out = modularity_groups(list(zip(pdf["source"], pdf["target"], pdf["weight"])), total, resolution)
        return pd.DataFrame({"node": list(out), "community": list(out.values())})

    grouped = rows.groupBy("component").applyInPandas(run, f"node {kind}, community {kind}")
    alone = parts.join(grouped, "node", "left_anti").select("node", F.col("node").alias("community"))
    return grouped.unionByName(alone)


def _louvain_in_blocks(vertices: DataFrame, edges: DataFrame, resolution: float, node: str, count: int | None, most: int) -> DataFrame:
    import pyarrow as pa

    from tessera.operators import numbered as by_number

    known = None
    if count is None:
        known = by_number.numbers(vertices, node)
        edges, count = by_number.looked_up(edges, known, ["source", "target"]), known.nodes
    label = by_number.louvain(edges, count, resolution, most)
    table = pa.table({"id": pa.array(range(count), pa.int32()), "label": pa.array(label, pa.int32())})
    found = saved(edges.sparkSession.createDataFrame(table), "found")
    if known is None:
        return vertices.select(F.col(node).alias("id")).join(found, "id").select(F.col("id").alias("node"), F.col("label").alias("community"))
    named = known.join(found, "id").select("node", "label")
    return named.join(known.select(F.col("id").alias("label"), F.col("node").alias("community")), "label").select("node", "community")


def louvain_or_labels(vertices: DataFrame, edges: DataFrame, resolution: float = 1.0, most: int = MOST_EDGES, node: str = "node") -> DataFrame:
    """(node, community) by :func:`louvain`, and by :func:`label_propagation` in components of more than ``most`` edges."""
    parts = saved(components(vertices, edges, node), "parts")
    ends = edges.join(parts.select(F.col("node").alias("source"), "component"), "source")
    large = saved(ends.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most).select("component"), "large")
    found = louvain(vertices, edges, parts.join(large, "component", "left_anti"), resolution, node)
    if not large.limit(1).count():
        return found
    inside = parts.join(large, "component", "left_semi").select("node")
    return found.unionByName(label_propagation(inside, ends.join(large, "component", "left_semi").select("source", "target", "weight")))


def modularity_groups(edges: list[tuple], total: float, resolution: float = 1.0) -> dict:
    """Each node's community, named by its smallest node."""
    members = {n: [n] for n in sorted({x for a, b, _ in edges for x in (a, b)})}
    while True:
        near: dict = {n: {} for n in members}
        degree: dict = dict.fromkeys(members, 0.0)
        for a, b, w in edges:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        group, size = {n: n for n in members}, dict(degree)
        moved = True
        while moved:
            moved = False
            for n in members:
                own = group[n]
                size[own] -= degree[n]
                pull: dict = {own: 0.0}
                for m, w in near[n].items():
                    pull[group[m]] = pull.get(group[m], 0.0) + w
                gain = lambda g: pull[g] - resolution * degree[n] * size[g] / (2 * total or 1.0)  # noqa: B023, E731
                best = max(pull, key=lambda g: (gain(g), g == own))
                best = own if gain(best) <= gain(own) + 1e-12 else best
                size[best] = size.get(best, 0.0) + degree[n]
                group[n] = best
                moved |= best != own
        merged: dict = {}
        for n, g in group.items():
            merged.setdefault(g, []).extend(members[n])
        if len(merged) == len(members):
            return {x: min(m) for m in merged.values() for x in m}
        summed: dict = {}
        for a, b, w in edges:
            ends = tuple(sorted((group[a], group[b])))
            summed[ends] = summed.get(ends, 0.0) + w
        edges, members = [(a, b, w) for (a, b), w in summed.items()], merged
