import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import backends
from tessera.functions.prompts import prompt
from tessera.operators import evaluate, judge, testsets
from tessera.plans import flows
from tessera.sources import media, readers, sinks
from tessera.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def service():
    """A chat service whose first key is over its rate."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization")))
            code = 429 if self.headers.get("Authorization") == "Bearer spent" else 200
            reply = {"choices": [{"message": {"content": None, "reasoning": "thought"}}]}
            if self.path.endswith("/embeddings"):
                reply = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path.endswith("/api/chat"):
                reply = {"message": {"content": body["messages"][0]["content"].upper()}}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_services(service):
    url, seen = service
    llm = {"provider": "groq", "model": "m", "url": url, "api_keys": ["spent", "good"], "wait": 0}
    assert backends.completion({"llm": llm})("hi") == "thought"
    assert [key for _, key in seen] == ["Bearer spent", "Bearer good"]
    assert backends.embedding({"llm": llm, "embeddings": {"model": "e"}})(["a", "bcd"]) == [[1.0], [3.0]]
    assert backends.completion({"llm": {"model": "m", "url": url}})("hi") == "HI"
    with pytest.raises(RuntimeError, match="over its rate"):
        backends.completion({"llm": llm | {"api_keys": ["spent"]}})("hi")
    with pytest.raises(ValueError, match="no provider"):
        backends.completion({"llm": {"provider": "nobody"}})


def test_replies_and_prompts(spark):
    units = spark.createDataFrame([(1, "a {query} b"), (2, "bad"), (3, None)], "n int, t string")

    def complete(text):
        if "bad" in text:
            raise ValueError("no")
        return text[-11:]

    got = {r.n: (r.reply, r.reply_error) for r in backends.replies(units, prompt("extract", text=F.col("t")), complete, tries=2).collect()}
    assert got == {1: ("a {query} b", None), 2: (None, "ValueError: no"), 3: ("\n\nPassage:\n", None)}


def test_judge(spark):
    base = {"query_type": "local", "is_fallback": False, "query": "Who?", "answer": "It is A. It is B [REF:x] [REF:gone].", "context": "A", "expected_answer": "- A\n- C", "query_entities": [], "retrieved": ["x", "y"], "cited": ["x"], "expected": [], "found_entities": [], "true_entities": [], "cited_videos": ["v"], "expected_videos": ["v", "w"]}
    lists = {k for k, v in base.items() if isinstance(v, list)}
    chunks = "array<struct<chunk_id:string,content:string>>"
    schema = "case_id string, error string, chunks " + chunks + ", " + ", ".join(f"{k} {'array<string>' if k in lists else 'boolean' if k == 'is_fallback' else 'string'}" for k in base)
    cases = spark.createDataFrame([("1", None, [("x", "has B"), ("y", "none")], *base.values()), ("2", "down", [], *base.values()), ("3", None, [], *(base | {"answer": "...", "expected_answer": ""}).values())], schema)

    def complete(text):
        if text.startswith("From 0"):
            return "8"
        if "Claim: " in text:
            return "YES" if "Claim: It is A\n" in text or "Claim: A\n" in text else "NO"
        return "YES" if "has B" in text else "partial"

    got = {(r.case_id, r.metric): r.score for r in judge.judged_scores(cases, complete).collect()}
    assert got["1", "faithfulness"] == 0.5 and got["1", "context_recall"] == 0.5 and got["1", "answer_relevance"] == 0.8 and got["1", "context_precision"] == 0.75
    assert got["1", "citation_accuracy"] == 0.4 * 0.5 + 0.4 * 0.5 + 0.2 * 0.5  # one of two marks, one of two passages, one of two sources
    assert {got["2", m] for m in evaluate.METRICS} == {0.0}
    assert got["3", "faithfulness"] == 0.5


def test_testsets(spark, tmp_path):
    by_hand = testsets.added(spark.createDataFrame([(2, "q2", "b"), (1, "q1", "a")], "n int, query string, expected_answer string"), "n", since=4)
    assert rows(by_hand.select("id", "query", "query_type", "difficulty")) == [("case_0005", "q1", "auto", "medium"), ("case_0006", "q2", "auto", "medium")]
    units = spark.createDataFrame([("abcdefghij", "text", "v.mp4"), ("zz", "odd", None)], "id string, raw_text string, source_video string")
    complete = lambda t: json.dumps({"questions": [{"question": f"{i}?", "expected_answer": "x", "key_entities": ["K"]} for i in range(3)]}) if t.endswith("text") else "no"
    made = testsets.generated(units, complete, per_unit=2)
    assert rows(made.select("id", "query", "relevant_source_videos", "difficulty")) == [("auto_abcdefgh_001", "0?", ["v.mp4"], "medium"), ("auto_abcdefgh_002", "1?", ["v.mp4"], "medium")]
    case = {"id": "1", "query": "q", "expected_answer": "a", "query_type": "odd", "tags": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"version": "1", "created_at": "", "source_videos": ["s"]}, "test_cases": [case, 5, case | {"query_type": "local", "tags": None, "difficulty": "hard"}, {"id": "2", "expected_chunks": {}}]}))
    assert rows(testsets.file_errors(spark, str(tmp_path / "a.json"))) == [
        (-1, "metadata without description"), (0, "invalid query_type: odd"), (0, "tags is no list"), (1, "not an object"), (2, "repeated id: 1"),
        (3, "expected_chunks is no list"), (3, "missing expected_answer"), (3, "missing query"), (3, "missing query_type"),
    ]
    assert testsets.metadata(spark, str(tmp_path / "a.json")).first().source_videos == ["s"]
    for text, error in (("{", "not JSON"), ("[]", "not an object"), ('{"metadata": {}}', "no list test_cases")):
        (tmp_path / "b.json").write_text(text)
        assert error in {r.error for r in testsets.file_errors(spark, str(tmp_path / "b.json")).collect()}


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"llm": {"model": "big"}, "extra": {"a": 1}, "chunking": 5}))
    got = readers.sections(str(tmp_path / "none.json"), str(tmp_path / "s.json"))
    assert got["llm"] == {"provider": "ollama", "model": "big"} and got["extra"] == {"a": 1} and got["chunking"] == 5 and got["community"] == {"resolution": 1.0}
    assert readers.SECTIONS["llm"]["model"] == "mistral"
    for bad in ({"temperature": 3}, {"max_tokens": 1}):
        with pytest.raises(ValueError):
            readers.Settings(**bad)
    with pytest.raises(ValueError):
        readers.checked_query("")


def test_flow_with_models(spark, tmp_path):
    texts = ["Alice chairs the Transport group. Alice likes Quic.", "Robert reviews Transport drafts with Alice.", "Gardening tips for Roses."]
    records = spark.createDataFrame([(str(i), "m.mp4", float(i), i + 1.0, "", None, t, "", i) for i, t in enumerate(texts)], readers.RECORD.rsplit(", extracted", 1)[0] + ", ord int")
    index = flows.build_index(records, report=lambda t: '{"title": "Chairs"}' if "Alice" in t else "nothing")
    assert "Chairs" in {r.title for r in index.communities.collect()}
    flows.save_index(index, str(tmp_path / "index"))
    index = flows.load_index(spark, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "Who chairs the Transport group?"), (2, "Roses?")], "query_id int, query string")
    out = flows.ask(index, questions, classify=lambda t: "GLOBAL" if "Roses" in t else "perhaps", complete=lambda t: "Said （REF:x） 【REF:y】")
    bodies = {r.query_id: json.loads(r.body) for r in out["responses"].collect()}
    assert bodies[1]["query_type"] == "local" and bodies[2]["query_type"] == "global" and bodies[1]["answer"] == "Said （REF:x） [REF:y]"
    near = flows.similar_entities(index, spark.createDataFrame([(1, "Transport")], "query_id int, query string"), 1).first()
    assert near["name"] == "Transport"
    found = flows.neighbours_of(index, spark.createDataFrame([(1, "alice")], "query_id int, name string"))
    assert rows(found["seeds"].select("node")) == [("alice",)] and "transport" in {r.node for r in found["neighbours"].collect()} and found["relationships"].count() > 0
    with pytest.raises(Exception, match="no answer: "):
        flows.ask(index, questions, complete=lambda t: 1 / 0)["responses"].collect()


def test_reports(spark, tmp_path):
    long = spark.createDataFrame([("1", "local", None, "m", 0.123456, True), ("2", "global", "down", "m", 0.0, False)], "case_id string, query_type string, error string, metric string, score double, passed boolean")
    body = json.loads(evaluate.report_json(long, evaluate.case_scores(long), "r1", '{"version": "1"}').first().body)
    assert body["summary"]["metric_averages"] == {"m": 0.1235} and body["summary"]["failed_cases"] == 1 and body["testset_metadata"] == {"version": "1"}
    cases = spark.createDataFrame([("1", "q", "local", False, None, "x" * 600)], "case_id string, query string, query_type string, is_fallback boolean, error string, answer string")
    one = json.loads(evaluate.case_json(cases, long).first().body)
    assert len(one["answer"]) == 500 and one["metric_scores"] == {"m": 0.1235}
    assert sinks.summary_lines(evaluate.report(evaluate.case_scores(long)))[0].startswith("total=2  succeeded=1  failed=1  overall=0.1235")


def test_media(spark, tmp_path):
    for name in ("a.mp4", "b.mp4"):
        (tmp_path / name).write_bytes(b"xy")
    files = media.files(spark, str(tmp_path))
    assert [r.length for r in files.collect()] == [2, 2]
    assert rows(media.speech_segments(files, lambda p: [(0.001, 1.239, " hi ")] if p.endswith("a.mp4") else [])) == [("a.mp4", 0.0, 1.24, "hi")]

    def analyse(path):
        if path.endswith("b.mp4"):
            raise ValueError("odd")
        return {"title": "T", "content": ["c"], "type": "text"}

    want = [("done", "T", ["c"], None), ("failed", "Parse failed", [], "ValueError: odd")]
    assert rows(media.analysed_slides(files, analyse).select("status", "title", "content", "error")) == want
    got, batches = [], []
    stream = media.analysed_slides(media.files(spark, str(tmp_path), per_batch=1), analyse)
    progress = events.Progress()
    spark.streams.addListener(progress)
    query = stream.writeStream.queryName("slides").foreachBatch(lambda df, n: (got.extend(r.status for r in df.collect()), batches.append(n))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == ["done", "failed"] and len(batches) == 2
    for _ in range(100):
        if progress.status.get("slides", ("", "", ""))[2] == "done":
            break
        threading.Event().wait(0.1)
    spark.streams.removeListener(progress)
    assert progress.status["slides"][2] == "done"


def test_cuts_on_a_stream(spark, tmp_path):
    schema = "video string, t double, score double"
    for n, part in enumerate(([("v", 0.0, 0.1), ("v", 1.0, 0.5), ("v", 3.0, 0.5)], [("v", 4.0, 0.2), ("v", 5.5, 0.2), ("w", 1.0, 1.0)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    got = []
    for n in (0, 1):  # each folder's file moves in after the one before it is read
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{n}").glob("*.parquet"):
            f.rename(folder / f"{n}-{f.name}")
        stream = events.cuts(spark.readStream.schema(schema).parquet(str(folder)))
        stream.writeStream.foreachBatch(lambda df, i: got.extend(rows(df))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("v", 0.0), ("v", 3.0), ("v", 5.5), ("w", 1.0)]
