"""Queries over whole texts: nothing past a first few names or characters is lost."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import extract, graph
from tessera.plans import catalog, flows
from tessera.sources import readers

NAMES = ["Alpha", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot", "Golf", "Hotel", "India", "Juliett", "Kilo", "Lima"]


def test_names_of_all_scripts(spark):
    units = spark.createDataFrame([("u", 1, "Über Écoles und Wien, Çalışma; Ab IBM")], "id string, ord int, raw_text string")
    assert units.select(extract.names(F.col("raw_text")).alias("n")).first().n == ["Über", "Écoles", "Wien", "Çalışma"]


def tables(spark, path, documents, benchmark=()):
    """Documents (doc_id, text, source) and questions (item_id, text) as the driver's tables."""
    docs = [(d, text, "en", source, len(text)) for d, text, source in documents]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def near(names):
    """Pairs of names at most WITHIN places apart, in order of the first and then the second."""
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 : i + 1 + extract.WITHIN]]


def test_all_names_of_a_unit_are_related(spark):
    units = spark.createDataFrame([("u", 1, " x ".join(NAMES)), ("one", 2, "Alpha"), ("none", 3, ""), ("null", 4, None)], "id string, ord int, raw_text string")
    got = extract.rule_relationships(units).orderBy("ord").collect()
    assert [(r.source, r.target) for r in got] == near(NAMES)
    assert {(r.text_unit_id, r.weight) for r in got} == {("u", 1.0)}


def test_graph_queries_know_late_names(spark, tmp_path):
    path = tables(spark, tmp_path, [(1, " ".join(NAMES), "a"), (2, " ".join(NAMES[8:]), "b")], [(7, "About " + " and ".join(NAMES))])
    run = lambda name: catalog.queries()[name](spark, path).collect()
    pairs = {(r.source_name, r.target_name): (r.weight, r.units) for r in run("merge_relationships")}
    assert pairs.keys() == {(a.lower(), b.lower()) for a, b in near(NAMES)}
    assert pairs["india", "lima"] == (2.0, 2) and pairs["delta", "lima"] == (1.0, 1) and pairs["alpha", "india"] == (1.0, 1)
    degrees = Counter(x.lower() for pair in near(NAMES) for x in pair)
    assert {r.node: r.degree for r in run("node_degrees")} == degrees
    assert {r.node for r in run("bfs_1hop") if r.score == 1.0} == {"about", *map(str.lower, NAMES)}


def test_cases_and_scalars_see_whole_texts(spark, tmp_path):
    text = "start " * 200 + "<the> end"
    path = tables(spark, tmp_path, [(1, text, "a"), (2, text, "b, c")])
    case = catalog._cases(catalog.Tables(spark, path)).where("case_id = '1'").first()
    assert case.context == text and case.answer == text + " [REF:1] [REF:x]" and case.query == "What is the " + text
    run = lambda name: {r[0]: r for r in catalog.queries()[name](spark, path).collect()}
    assert run("scalar_functions")[1].shown == text.replace("<the>", "&lt;the&gt;")
    got = run("source_headers")
    assert [(got[d].rest, got[d].video) for d in (1, 2)] == [(text, "a"), (text, None)]
    assert catalog._testset(catalog.Tables(spark, path)).first().query == text


def cliques(pairs):
    return [(f"{g}{i}", f"{g}{j}", 1.0) for g in pairs for i in range(5) for j in range(i)] + [(f"{pairs[0]}0", f"{pairs[1]}0", 0.1)]


def test_large_components_are_split_too(spark):
    rows = cliques("ab") + cliques("cd") + [("e0", "e1", 1.0)]
    edges = spark.createDataFrame(rows, "source string, target string, weight double")
    nodes = edges.select(F.explode(F.array("source", "target", F.lit("z"))).alias("node")).distinct()
    want = {f"{g}{i}": f"{g}0" for g in "abcd" for i in range(5)} | {"e0": "e0", "e1": "e0", "z": "z"}
    for most in (100, 5, 0):
        got = [tuple(r) for r in graph.louvain_or_labels(nodes, edges, most=most).collect()]
        assert dict(got) == want and len(got) == len(want)


def test_index_splits_a_component_into_communities(spark):
    texts = [f"{a} meets {b}." for g in ("Alpha Bravo Charlie Delta", "Kilogram Lima Mike November") for a, b in combinations(g.split(), 2)] + ["Alpha meets Kilogram."]
    records = spark.createDataFrame([(str(i), "m.mp4", float(i), i + 1.0, "", None, t, "", i) for i, t in enumerate(texts)], readers.RECORD.rsplit(", extracted", 1)[0] + ", ord int")
    assert sorted(r.entity_count for r in flows.build_index(records).communities.where("entity_count > 1").collect()) == [4, 4]


def test_index_writes_texts_once(spark):
    """Units' texts are in one table, and mentions of relationships are read out of them when asked for."""
    texts = ["Alpha meets Bravo.", "Bravo meets Charlie and Alpha."]
    records = spark.createDataFrame([(str(i), "m.mp4", float(i), i + 1.0, "", None, t, "", i) for i, t in enumerate(texts)], readers.RECORD.rsplit(", extracted", 1)[0] + ", ord int")
    index = flows.build_index(records)
    assert index.unit_vectors.columns == ["id", "vector"] and not hasattr(index.relationship_mentions, "saved_at")
    held = index.relationship_mentions.join(index.relationships.select("key", "units"), "key").groupBy("key", "units").count().collect()
    assert held and len(held) == index.relationships.count() and all(r["units"] == r["count"] for r in held)
    assert index.unit_vectors.join(index.units, "id").count() == index.units.count() == 2
