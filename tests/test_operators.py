import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk, communities, evaluate, extract, graph, organize, resolve, search, timeline, vectors, views
from tessera.operators import answer as answers
from tessera.plans import flows
from tessera.sources import readers, sinks
from tessera.streaming import events


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_chunks():
    assert chunk.chunks("aaaa bbbb\n\ncccc", 2) == ["aaaa bbbb", "cccc"]
    assert chunk.chunks("aaaa\n\nbbbb", 100) == ["aaaa\n\nbbbb"]
    assert chunk.chunks("One two. Three four! " + "x" * 25, 2) == ["One two.", "Three four!", "x" * 8, "x" * 8, "x" * 8, "x"]
    assert chunk.chunks("  ", 2) == ["  "]
    text = "\n\n".join(f"Sentence {i} is here. And {'w' * (i % 50)} there?" for i in range(60))
    for size in (3, 10, 40):
        parts = chunk.chunks(text, size)
        assert all(len(p) <= 4 * size + 3 for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())


def test_text_units(spark):
    df = spark.createDataFrame([("f", "aaaa bbbb\n\ncccc", "v.mp4", 0.0, 2.0), ("g", "[SOURCE: a, START: 1, END: 2]", "a", 1.0, 2.0)], "source_file string, body string, source_video string, start_time double, end_time double")
    got = chunk.text_units(df, 2, 1).orderBy("i").collect()
    assert [r.raw_text for r in got] == ["aaaa bbbb", "cccc"]
    assert got[1].text == "[Meeting: v.mp4 | 0.0s ~ 2.0s]\n\nbbbb\n\ncccc" and len(got[0].id) == 16


def test_overlap_and_intervals(spark):
    slides = spark.createDataFrame([("v", float(s)) for s in (0, 10, 20)], "video_name string, start_time double")
    speech = spark.createDataFrame([("v", 8.0, 12.0, "x"), ("v", 12.0, 19.0, "y"), ("v", 20.0, 25.0, "z"), ("w", 0.0, 9.0, "no")], "video_name string, start double, end double, text string")
    timed = timeline.slide_intervals(slides, speech)
    assert rows(timed.select("end_time"), "end_time") == [(10.0,), (20.0,), (25.0,)]
    for bucket in (3.0, 60.0):
        got = timeline.overlap_join(timed, speech, ["start_time"], bucket=bucket)
        assert rows(got.select("start_time", "transcript"), "start_time") == [(0.0, "x"), (10.0, "x y"), (20.0, "z")]


@pytest.mark.parametrize("bucket", [2.0, 3600.0])
def test_as_of(spark, bucket):
    slides = spark.createDataFrame([("v", 0.0, "a"), ("v", 10.0, "b"), ("w", 5.0, "c")], "k string, start double, slide string")
    moments = spark.createDataFrame([("v", -1.0), ("v", 0.0), ("v", 9.9), ("v", 99.0), ("w", 5.0), ("u", 1.0)], "k string, at double")
    got = timeline.as_of(moments, slides, "k", "at", "start", "slide", bucket)
    assert sorted(rows(got), key=str) == sorted([("v", -1.0, None), ("v", 0.0, "a"), ("v", 9.9, "a"), ("v", 99.0, "b"), ("w", 5.0, "c"), ("u", 1.0, None)], key=str)


def test_slide_cuts(spark):
    frames = spark.createDataFrame([("v", t, s) for t, s in [(0.0, 1.0), (1.0, 0.5), (2.5, 0.5), (4.0, 0.99), (5.0, 0.9)]], "video string, t double, score double")
    assert rows(timeline.slide_cuts(frames), "t") == [("v", 0.0, 1), ("v", 2.5, 2), ("v", 5.0, 3)]


def test_segments_view(spark):
    df = spark.createDataFrame([("1", "b.mp4", None, None, " \nTitle\nline", "none", " t "), ("2", "a.mp4", 3725.0, 3730.0, "", "chart", None)], "id string, video_name string, start_time double, end_time double, ocr_text string, chart_description string, transcript string").withColumn("slide_image", F.lit(None).cast("string")).withColumn("ord", F.col("id").cast("int"))
    got = {r.ord: r for r in timeline.segments_view(df).collect()}
    assert got[1].time_range.end_sec == 1800.0 and got[1].multimodal_content.visual_info.title == "Title" and got[1].multimodal_content.visual_info.content == ["line"]
    assert got[2].multimodal_content.visual_info.title == "Segment 2" and got[2].multimodal_content.visual_info.content == ["chart"] and got[2].time_range.display_timestamp == "01:02:05"


def found(spark):
    e = [("HTTP/3", "protocol", "transport protocol", "u1", 1), ("http/3", "PROTOCOL", "protocol", "u2", 2), ("HTTP/3", "protocol", "UDP based", "u1", 3), ("QUIC", None, "", "u2", 4), ("  ", "x", "", "u", 5)]
    r = [("HTTP/3", "QUIC", "uses", "a", 1.0, "u1", 1), ("http/3", "quic", "USES", "b", 2.0, "u2", 2), ("HTTP/3", "QUIC", None, "", 1.0, "u2", 3), ("HTTP/3", "nobody", "uses", "", 1.0, "u1", 4)]
    return spark.createDataFrame(e, "name string, type string, description string, text_unit_id string, ord int"), spark.createDataFrame(r, "source string, target string, rel_type string, description string, weight double, text_unit_id string, ord int")


def test_resolution(spark):
    e, r = found(spark)
    entities = resolve.merge_entities(e)
    got = {x.key: x for x in entities.collect()}
    assert got["http/3|PROTOCOL"].description == "transport protocol; UDP based" and got["http/3|PROTOCOL"].text_unit_ids == ["u1", "u2"] and set(got) == {"http/3|PROTOCOL", "quic|OTHER"}
    relations = {x.rel_type: x for x in resolve.merge_relationships(r, entities).collect()}
    assert relations["USES"].weight == 3.0 and relations["USES"].descriptions == ["a", "b"] and relations["USES"].is_directional and not relations["RELATED_TO"].is_directional
    edges = graph.entity_graph(resolve.merge_relationships(r, entities), entities)
    assert rows(edges) == [("http/3|PROTOCOL", "quic|OTHER", 4.0)]
    groups = communities.reports(communities.assemble(graph.components(entities.select(F.col("key").alias("node")), edges).toDF("node", "community"), entities)).collect()
    assert groups[0].entity_count == 2 and groups[0].summary == "http/3|PROTOCOL, quic|OTHER" and groups[0].text_unit_ids == ["u1", "u2"]


def test_long_tables_say_what_lists_say(spark):
    e, r = found(spark)
    mentions, entities = resolve.entity_mentions(e), resolve.entity_rows(e)
    lists = {x.key: x.text_unit_ids for x in resolve.merge_entities(e).collect()}
    assert {(k, u) for k, us in lists.items() for u in us} == {(x.key, x.text_unit_id) for x in mentions.collect()}
    assert {x.key: x.units for x in resolve.unit_counts(resolve.relationship_mentions(r)).collect()}["http/3|USES|quic"] == 2
    units = spark.createDataFrame([("u1",), ("u2",), ("none",)], "id string")
    short = resolve.unit_entities(resolve.merge_entities(e), units).orderBy("id").collect()
    assert resolve.unit_entities(entities, units, mentions).orderBy("id").collect() == short and short[0].entity_ids == []


def test_ends_are_looked_up_alike_whatever_their_number(spark, monkeypatch):
    e, r = found(spark)
    few = resolve.relationship_rows(r, resolve.entity_rows(e)).orderBy("key").collect()
    monkeypatch.setattr(resolve, "BROADCAST_BYTES", 0)
    assert resolve.relationship_rows(r, resolve.entity_rows(e)).orderBy("key").collect() == few
    assert {x.key: (x.units, x.weight, x.source) for x in few} == {"http/3|USES|quic": (2, 3.0, "HTTP/3"), "http/3|RELATED_TO|quic": (1, 1.0, "HTTP/3")}


def test_large_community_shows_its_first_members(spark):
    rows = [(f"Name{i:03d}", "x", "", f"u{i % 7}", i) for i in range(60)] + [("Single", "x", "", None, 99)]
    e = spark.createDataFrame(rows, "name string, type string, description string, text_unit_id string, ord int")
    entities = resolve.entity_rows(e)
    partition = entities.select(F.col("key").alias("node"), F.when(F.col("canonical") == "single", "s").otherwise("n").alias("community"))
    belong = communities.members(partition, entities)
    got = {x.entity_count: x for x in communities.reports(communities.described(belong, entities)).collect()}
    whole = {x.entity_count: x for x in communities.reports(communities.assemble(partition, resolve.merge_entities(e))).collect()}
    assert set(got) == set(whole) == {60, 1} and belong.count() == 61 and whole[1].text_unit_ids == []
    for n, x in got.items():
        assert (x.id, x.title, x.summary, x.report_input, x.entities) == (whole[n].id, whole[n].title, whole[n].summary, whole[n].report_input, whole[n].entities[:20])
    assert communities.member_rows(communities.assemble(partition, resolve.merge_entities(e))).count() == 61


def test_expansion(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 1.0), ("b", "d", 4.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([(1, "a"), (2, "d")], "query_id int, node string")
    got = graph.expand(graph.both_ways(edges), seeds, 2, ("query_id",))
    assert rows(got.where("query_id = 1").select("node", "score"), "node") == [("a", 1.0), ("b", 0.5), ("c", 0.25), ("d", 0.25)]


def test_components_and_communities(spark):
    rng = np.random.default_rng(2)
    pairs = [(f"n{a:03d}", f"n{b:03d}", 1.0) for a, b in rng.integers(0, 150, (90, 2))] + [(f"p{i:03d}", f"p{i + 1:03d}", 1.0) for i in range(60)]
    edges = spark.createDataFrame(pairs, "source string, target string, weight double")
    nodes = edges.select(F.explode(F.array("source", "target", F.lit("alone"))).alias("node")).distinct()
    root = {}
    for a, b, _ in pairs:
        sa, sb = root.setdefault(a, {a}), root.setdefault(b, {b})
        if sa is not sb:
            sa |= sb
            for x in sb:
                root[x] = sa
    got = dict(rows(graph.components(nodes, edges)))
    assert got == {x: min(s) for x, s in root.items()} | {"alone": "alone"}
    two = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.1)]
    edges = spark.createDataFrame(two, "source string, target string, weight double")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    want = {f"{g}{i}": f"{g}0" for g in "ab" for i in range(5)}
    assert dict(rows(graph.louvain(nodes, edges))) == want
    assert dict(rows(graph.label_propagation(nodes, edges))) == want


def test_search(spark):
    e, r = found(spark)
    entities = resolve.merge_entities(e)
    hits = spark.createDataFrame([(1, "u2")], "query_id int, id string")
    assert [x["name"] for x in search.related_entities(hits, entities).first().related_entities] == ["HTTP/3", "QUIC"]
    asked = spark.createDataFrame([(1, "quic"), (1, "ttp"), (2, "zzz")], "query_id int, name string")
    assert rows(search.match_seeds(asked, entities), "asked") == [(1, "quic", "quic"), (1, "ttp", "http/3")]
    known = spark.createDataFrame([("c1", ["a|X", "b|X"]), ("c2", ["c|X"]), ("c3", ["z|X"])], "id string, entity_names array<string>")
    adjacent = graph.both_ways(spark.createDataFrame([("a", "c", 2.0)], "source string, target string, weight double"))
    got = search.global_search(spark.createDataFrame([(1, "c1", 0.4)], "query_id int, id string, score double"), known, adjacent, 3)
    assert rows(got.select("id", "score", "via_graph"), "rank") == [("c1", 0.58, False), ("c2", 0.3, True)]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    table = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(50)], "id int, embedding array<float>")
    queries = table.where("id < 5").withColumnRenamed("id", "q")
    batch = rows(vectors.top_k_batched(table, queries, 3, "id", "q").select("q", "id", "score"), "q", "rank")
    single = [(q, *r) for q, v in rows(queries, "q") for r in rows(vectors.top_k(table, v, 3, "id").select("id", "score"))]
    assert [b[:2] for b in batch] == [s[:2] for s in single] and np.allclose([b[2] for b in batch], [s[2] for s in single], atol=2e-6)
    got = [r.v for r in spark.createDataFrame([("a b",), (None,), ("a b",)], "t string").select(vectors.hashed_embedding(F.col("t"), 8).alias("v")).collect()]
    assert got[0] == got[2] and abs(np.linalg.norm(got[0]) - 1) < 1e-6 and not any(got[1])


def test_organize(spark):
    data = [("q", "1", "a b c", 0.9), ("q", "2", "a b c d", 0.8), ("q", "3", "x y", 0.7), ("q", "4", "low", -0.9)]
    chunks = spark.createDataFrame(data, "query_id string, chunk_id string, content string, score double").withColumns({
        "chunk_type": F.lit("text_unit"), "title": F.concat(F.lit("t"), "chunk_id"), "entities": F.array(F.struct(F.lit("QUIC").alias("name"), F.lit("P").alias("type"), F.when(F.col("chunk_id") == "3", "d").otherwise("").alias("description"))),
        "source_refs": F.array(F.struct(F.col("chunk_id").alias("text_unit_id"), F.lit("v").alias("source_video"), F.lit(1.0).alias("start_time"), F.lit(2.0).alias("end_time"))),
    })
    kept = organize.organize(chunks, threshold=0.6)
    assert rows(kept.select("chunk_id", "place"), "place") == [("1", 1), ("3", 2)]
    assert rows(organize.consolidated_entities(kept)) == [("q", "QUIC", "P", "d", 2, 1)]
    assert rows(organize.consolidated_refs(kept).select("text_unit_id")) == [("1",)]
    prompt = organize.prompt_text(kept, organize.consolidated_entities(kept)).first().prompt
    assert prompt.startswith("[CHUNK_ID: 1]  (text_unit)\na b c\nEntities: QUIC(P)\n[SOURCE: v  1.0s-2.0s]\n\n---\n\n") and prompt.endswith("KEY ENTITIES:\n  QUIC (P) — d")
    said = answers.extractive_answers(spark.createDataFrame([("q",), ("none",)], "query_id string"), kept)
    got = {r.query_id: r for r in said.collect()}
    assert got["q"].answer == "a b c [REF:1] x y [REF:3]" and got["none"].is_fallback
    cited = answers.resolved_citations(said, kept)
    assert rows(cited.select("ordinal", "chunk_id"), "ordinal") == [(1, "1"), (2, "3")]
    assert answers.reference_list(cited).first().references == "References:\n  [1] v  1.0s-2.0s\n  [2] v  1.0s-2.0s"


def case(spark, **given):
    base = {"case_id": "1", "query_type": "local", "error": None, "is_fallback": False, "query": "", "answer": "", "context": "", "query_entities": [], "retrieved": [], "cited": [], "expected": [], "found_entities": [], "true_entities": [], "cited_videos": [], "expected_videos": []}
    lists = [k for k, v in base.items() if isinstance(v, list)]
    schema = ", ".join(f"{k} {'array<string>' if k in lists else 'boolean' if k == 'is_fallback' else 'string'}" for k in base)
    return {r.metric: r.score for r in evaluate.scores(spark.createDataFrame([tuple((base | given).values())], schema)).collect()}


def test_metrics(spark):
    assert case(spark, answer="QUIC uses UDP", context="QUIC runs over UDP")["faithfulness"] == 1.0
    got = case(spark, answer="x [REF:a] [REF:b]", cited=["a"], cited_videos=["v1"], expected_videos=["v1", "v2"], retrieved=["1", "2", "3"], expected=["2", "9"])
    assert got["citation_accuracy"] == 0.5 and got["context_precision"] == 0.333333 and got["context_recall"] == 0.5
    assert set(case(spark, error="down").values()) == {0.0}
    assert case(spark, is_fallback=True)["faithfulness"] == 1.0 and case(spark, is_fallback=True)["answer_relevance"] == 0.5


def test_views(spark):
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("d", "d", 1.0)], "source string, target string, weight double")
    cited = spark.createDataFrame([("a",)], "node string")
    nodes, inner = views.answer_subgraph(links, cited)
    assert {r.node for r in nodes.collect()} == {"a", "b"} and rows(inner) == [("a", "b", 1.0)]
    assert dict(rows(graph.degrees(links))) == {"a": 1, "b": 2, "c": 1, "d": 2}
    shown, left = views.visible(links, spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", "X")], "id string, type string"), ["Y"])
    assert shown.count() == 2 and left.count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "video_name": "v.mp4", "start_time": 1.0, "ocr_text": "T"}, {"id": "", "video_name": "v"}, {"id": "2", "video_name": "v.mp4", "extracted_entities": {"documents_mentioned": ["RFC 1"]}}]))
    (tmp_path / "b.json").write_text(json.dumps({"id": "3", "video_name": "w.mp4"}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "link.json").write_text(json.dumps([{"meet": "v", "link": "l1"}, {"meet": "v", "link": "l2"}]))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "transcript.json").write_text(json.dumps({"status": "ok", "meeting_metadata": {"meeting_name": "M"}, "slides": [{"id": "4", "video_name": "v.mp4", "start_time": 5.0}, {"id": "1", "video_name": "v.mp4", "start_time": 1.0}]}))
    (tmp_path / "m" / "slide_004_00-01-17.JPG").write_bytes(b"x")
    records = readers.records(spark, str(tmp_path))
    assert sorted(r.id for r in records.collect()) == ["1", "2", "3"]
    assert rows(readers.links(spark, str(tmp_path / "link.json")).select("meet", "link")) == [("v", "l2")]
    assert readers.links(spark, str(tmp_path / "none.json")).count() == 0
    assert rows(readers.meetings(spark, str(tmp_path))) == [("m",)]
    slides = readers.with_images(readers.transcripts(spark, str(tmp_path)), readers.slide_images(spark, str(tmp_path)))
    assert {r.id: r.slide_image.endswith(".JPG") for r in slides.collect()} == {"4": True, "1": False}
    assert sorted(r.id for r in readers.all_slides(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4"]
    texts = sinks.texts(records)
    bodies = {r.source_file: r.body for r in texts.collect()}
    assert bodies["v_1.txt"] == "[SOURCE: v.mp4, START: 1.0, END: 0.0, ID: 1]\n\nT" and set(bodies) == {"v_1.txt", "v_2.txt", "w_3.txt"}
    for name, body in bodies.items():
        (tmp_path / "m" / name).write_text(body)
    (tmp_path / "map.json").write_text(json.dumps({"w_3.txt": {"source_video": "mapped", "start_time": 3.0, "end_time": 4.0, "id": "3", "slide_image": ""}}))
    known = readers.with_sources(readers.texts(spark, str(tmp_path)), readers.source_map(spark, str(tmp_path / "map.json")))
    assert {r.source_file: (r.source_video, r.start_time) for r in known.collect()} == {"v_1.txt": ("v.mp4", 1.0), "v_2.txt": ("v.mp4", 0.0), "w_3.txt": ("mapped", 3.0)}
    sinks.save_index(str(tmp_path / "out"), texts=texts.drop("ord"))
    assert readers.index_table(spark, str(tmp_path / "out"), "texts", "source_file string, body string").count() == 3
    assert readers.index_table(spark, str(tmp_path / "out"), "nothing", "a int").count() == 0
    with pytest.raises(ValueError):
        readers.Settings(top_k=0)


def test_model_replies(spark):
    units = spark.createDataFrame([("u1", 1, "good"), ("u2", 2, "bad"), ("u3", 3, "odd")], "id string, ord int, raw_text string")

    def complete(text):
        if text == "bad":
            raise RuntimeError("down")
        return '```json\n{"entities": [{"name": "QUIC"}, {"name": " "}], "relationships": [{"source": "a", "target": "b"}]}\n```' if text == "good" else "no json"

    replies = extract.retried(units, complete, rounds=1)
    assert dict(rows(replies.select("text_unit_id", "status"))) == {"u1": "done", "u2": "failed", "u3": "done"}
    entities, relations = extract.parsed_replies(replies)
    assert rows(entities.select("name", "text_unit_id")) == [("QUIC", "u1")] and rows(relations.select("source", "weight")) == [("a", 1.0)]


def test_flow(spark):
    texts = ["Alice chairs the Transport group. Alice likes Quic.", "Robert reviews Transport drafts with Alice.", "Gardening tips for Roses."]
    records = spark.createDataFrame([(str(i), "m.mp4", float(i), i + 1.0, "", None, t, "", i) for i, t in enumerate(texts)], readers.RECORD.rsplit(", extracted", 1)[0] + ", ord int")
    index = flows.build_index(records, method="louvain")
    out = flows.ask(index, spark.createDataFrame([(1, "Who chairs the Transport group?"), (2, "Overview of Roses")], "query_id int, query string"))
    bodies = {r.query_id: json.loads(r.body) for r in out["responses"].collect()}
    assert bodies[1]["query_type"] == "local" and bodies[1]["citations"] and "Alice" in bodies[1]["cited_entity_names"]
    assert bodies[2]["query_type"] == "global"


def test_streams(spark, tmp_path):
    slides = spark.createDataFrame([("v", 0.0, "a"), ("v", 10.0, "b")], "video_name string, start_time double, slide string")
    spark.createDataFrame([("v", 3.0), ("v", 11.0)], "video_name string, at double").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("video_name string, at double").parquet(str(tmp_path / "in"))
    events.current_slides(stream, slides, lambda df, n: got.extend(rows(df)), str(tmp_path / "ck")).awaitTermination()
    assert sorted(got) == [("v", 3.0, "a"), ("v", 11.0, "b")]
