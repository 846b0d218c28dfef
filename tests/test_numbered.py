"""Graphs by number against the same steps over names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, numbered
from tessera.plans import catalog
from test_whole import NAMES, tables


def test_numbers_follow_names(spark):
    names = spark.createDataFrame([(w,) for w in ("b", "a", "c", "a", None, "é")], "node string")
    got = numbered.numbers(names)
    assert {r.node: r.id for r in got.collect()} == {"a": 0, "b": 1, "c": 2, "é": 3} and got.nodes == 4


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_reach_is_expand(spark, monkeypatch, hops):
    monkeypatch.setattr(numbered, "BLOCK_EDGES", 40)
    monkeypatch.setattr(numbered, "SENT", 10)  # several rounds of questions
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 60, (2, 90)), rng.integers(1, 9, 90))]
    edges = spark.createDataFrame([*rows, (3, 4, 2.0), (4, 3, 7.0), (5, 5, 9.0)], "source int, target int, weight double")
    seeds = spark.createDataFrame([("p", 3), ("p", 4), ("q", 5), ("r", 61), ("s", 0), ("s", 0)], "query_id string, node int")
    want = graph.expand(graph.both_ways(edges), seeds, hops, ("query_id",))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "node", "score").collect())
    assert rows(numbered.reach(edges, seeds, hops, "query_id", 62)) == rows(want)


def test_two_hops_make_no_row_an_edge_and_question(spark, tmp_path):
    """The number of joined rows was edges times questions; now edges are only read in blocks."""
    path = tables(spark, tmp_path, [(1, " ".join(NAMES), "a")], [(7, "About Alpha"), (8, "Nothing"), (9, "Lima")])
    out = catalog.queries()["bfs_2hop"](spark, path)
    assert {r.query_id: r.nodes for r in out.collect()} == {7: 13, 8: 1, 9: 12}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "LeftAnti" not in plan and "neighbour" not in plan


def modularity(edges, label):
    total = sum(w for *_, w in edges)
    volume: dict = {}
    for a, b, w in edges:
        for x in (a, b):
            volume[label[x]] = volume.get(label[x], 0.0) + w
    return sum(w for a, b, w in edges if label[a] == label[b]) / total - sum((v / (2 * total)) ** 2 for v in volume.values())


@pytest.mark.parametrize("most", [0, 100])
def test_louvain_in_blocks(spark, monkeypatch, most):
    """A component too large for a task is parted too, about as well as a node at a time; all nodes are there once."""
    monkeypatch.setattr(numbered, "BLOCK_EDGES", 100)
    rng = np.random.default_rng(3)
    made = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (4000, 2)).tolist() if a != b and (a // 20 == b // 20 or rng.random() < 0.05)}
    rows = [(f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in sorted(made)] + [("z1", "z2", 1.0), ("n000", "n000", 2.0)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    nodes = edges.select(F.explode(F.array("source", "target", F.lit("lonely"))).alias("node")).distinct()
    got = graph.louvain(nodes, edges, most=most).collect()
    label = {r.node: r.community for r in got}
    assert len(got) == len(label) == 123 and label["lonely"] == "lonely" and label["z2"] == "z1"
    assert all(c == min(n for n in label if label[n] == c) for c in label.values())
    plain = graph.modularity_groups(rows, float(sum(w for *_, w in rows)))
    assert modularity(rows, label) >= 0.97 * modularity(rows, plain)
