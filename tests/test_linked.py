"""The graph in packed blocks against the same steps over rows of names, and what an index writes."""

import dataclasses
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, linked
from tessera.plans import flows
from tessera.sources import readers, sinks

RECORD = readers.RECORD.rsplit(", extracted", 1)[0] + ", ord int"


def records(spark, texts):
    return spark.createDataFrame([(str(i), "m.mp4", float(i), i + 1.0, "", None, t, "", i) for i, t in enumerate(texts)], RECORD)


def test_packed():
    for values in (np.array([3, 9, 2**40, 2**40 + 1], np.uint64), np.array([5, 1, 7], np.int32), np.zeros(0, np.int32)):
        for steps in (True, False):
            assert linked.unpacked(linked.packed(values, steps), values.dtype.type, steps).tolist() == values.tolist()


@pytest.fixture(scope="module")
def mentions():
    rng = np.random.default_rng(7)
    return [(r, at, int(n)) for r in range(70) for at, n in enumerate(rng.permutation(40)[: rng.integers(0, 7)] + 40 * (r % 2))]


def test_links_are_pairs(spark, mentions, monkeypatch):
    monkeypatch.setattr(linked, "BLOCK_EDGES", 50)
    rows = spark.createDataFrame(mentions, "row long, at int, id int").repartition(3, "row")
    table, want, size = linked.links(rows, 2, 85, len(mentions)), {}, 85
    of = {(r, at): n for r, at, n in mentions}
    for (r, at), n in of.items():
        for k in (1, 2):
            if (r, at + k) in of:
                want[n, of[r, at + k]] = want.get((n, of[r, at + k]), 0) + 1
    got = {}
    for nodes, own, near, there, back in linked.arrays(table.toArrow().to_batches()):
        for a, b, t, w in zip(nodes[own].tolist(), near.tolist(), there.tolist(), back.tolist()):
            assert (a, b) not in got
            got[a, b] = t
            assert w == want.get((b, a), 0)
    assert {k: v for k, v in got.items() if v} == want and table.count() > 6

    ends = spark.createDataFrame([(a, b, float(w)) for (a, b), w in want.items()], "source int, target int, weight double")
    edges, nodes = graph.collapsed(ends), spark.range(size).select(F.col("id").cast("int").alias("node"))
    as_rows = lambda label: sorted(enumerate(label.tolist()))
    collected = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(linked.components(table, size)) == collected(graph.components(nodes, edges))
    assert as_rows(linked.label_propagation(table, size)) == collected(graph.label_propagation(nodes, edges))
    assert as_rows(linked.louvain_or_labels(table, size, most=0)) == collected(graph.louvain_or_labels(nodes, edges, most=0))
    plain = graph.modularity_groups(sorted(tuple(r) for r in edges.collect()), float(sum(want.values())))
    assert as_rows(linked.louvain_or_labels(table, size)) == [(n, plain.get(n, n)) for n in range(size)]


TEXTS = ["Alpha meets Bravo and Charlie.", "Bravo meets Charlie, Alpha.", "Kilogram, Lima, Mike", "Mike and Lima met Alpha over tls, Http and RFC 9000", "none here", "Http Lonely"]


def test_index_writes_no_row_a_relationship(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/tessera-*"))
    index = flows.build_index(records(spark, TEXTS))
    wrote = [os.path.basename(p).split("-")[1] for p in set(glob.glob(f"{root}/tessera-*")) - before]
    assert not {"relationships", "edges", "pairs", "adjacent", "mentions", "named"} & set(wrote) and wrote.count("units") == 1
    assert {r.type for r in index.entities.collect()} == {"CONCEPT", "PROTOCOL", "RFC"}  # not the place in a list of names
    assert index.relationships.where("source_name = 'alpha'").count() == 3 and index.mentions.count() == 19
    assert index.units.where("text <> concat(format_string('[Meeting: %s | %.1fs ~ %.1fs]\n\n', source_video, start_time, end_time), raw_text)").count() == 0
    ids = {r.key: r.id for r in index.entities.collect()}
    assert index.units.where("raw_text like '%Lonely'").first().entity_ids == sorted([ids["http|PROTOCOL"], ids["http|CONCEPT"], ids["lonely|CONCEPT"]])


def test_search_by_links_is_search_by_relationships(spark):
    index = flows.build_index(records(spark, TEXTS))
    asked = [(1, "Overview of Alpha"), (2, "overall Lima"), (3, "Who met Mike?"), (4, "history of Http")]
    questions = spark.createDataFrame(asked, "query_id int, query string")
    rows = lambda i, q=questions: sorted(tuple(r) for r in flows.ask(i, q)["responses"].collect())
    assert rows(index) == rows(dataclasses.replace(index, links=None, nodes=None)) and len(rows(index)) == 4
    assert len(rows(index, questions.where("query_id = 3"))) == 1  # no question asks for communities


def test_index_without_names(spark):
    index = flows.build_index(records(spark, ["nothing", "at all"]))
    assert (index.units.count(), index.entities.count(), index.nodes.count()) == (2, 0, 0)
    assert flows.ask(index, spark.createDataFrame([(1, "Overview")], "query_id int, query string"))["responses"].count() == 1


def test_texts_apart(spark):
    rows = records(spark, ["first", "second", "third"])
    twice = rows.unionByName(rows.where("ord < 2").withColumns({"transcript": F.lit("later"), "ord": F.col("ord") + 10}))
    for some in (rows, twice):
        want = sorted(tuple(r) for r in sinks.texts(some).collect())
        assert sorted(tuple(r) for r in sinks.texts_apart(some).collect()) == want and len(want) == 3
