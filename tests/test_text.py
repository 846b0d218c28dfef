from pyspark.sql import functions as F

from tessera.functions import text as X


def values(spark, expr, *rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expr("v").alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, X.canonical_name, "GPT-4", "GPT4", "HTTP/3", "  TLS  1.3 ", "é-GPT_4!") == ["gpt 4", "gpt4", "http/3", "tls 1.3", "é gpt 4"]
    assert values(spark, lambda c: X.entity_id(c, F.lit("protocol")), "gpt 4") == ["77f88289f01e"]
    assert values(spark, lambda c: X.relation_id(c, F.lit("uses"), F.lit("QUIC")), "http/3") == ["7cc904f9663f"]
    assert values(spark, X.stem, "a/b.c.mp4", ".hidden", "x") == ["b.c", ".hidden", "x"]
    assert values(spark, lambda c: X.safe_filename(c, F.lit("a/1")), "RFC 9114é.mp4") == ["RFC_9114é_a_1.txt"]
    assert values(spark, X.safe_stem, "--a b", "  ", "!!") == ["--a_b", "meeting", "meeting"]
    assert values(spark, X.safe_meeting_name, "a:b  c", "") == ["a_b c", "YouTube Meeting"]
    assert values(spark, X.zero_filled, "4", "1234") == ["004", "1234"]
    assert values(spark, X.relation_type, None, " uses ") == ["RELATED_TO", "USES"]


def test_times_and_links(spark):
    assert values(spark, X.hhmmss, 3725.9, 0.0, kind="double") == ["01:02:05", "00:00:00"]
    links = ["https://www.youtube.com/watch?v=abc&t=1", "https://youtu.be/xyz", "http://youtube.com/watch?v=a", "https://youtube.com/live/q1?x", "https://example.com/?v=1", "nothing", None]
    assert values(spark, X.youtube_id, *links) == ["abc", "xyz", None, "q1", None, None, None]
    assert values(spark, lambda c: X.url_at(c, F.lit(7.9)), "https://y/w?v=a&t=3s", "https://y/w") == ["https://y/w?v=a&t=7s", "https://y/w?t=7s"]


def test_citations(spark):
    assert values(spark, X.citations, "x [REF:a1] y [REF: b2 ] [REF:a1]") == [["a1", "b2"]]
    assert values(spark, X.normal_citations, "(REF:a)", "<REF:a>", "【REF：a】") == ["[REF:a]"] * 3
    got = values(spark, X.cited_sentences, "One is so. [REF:a] [REF:b] Two! three")[0]
    assert [(p.sentence, p.ids) for p in got] == [("One is so.", ["a", "b"]), ("Two!", []), ("three", [])]
    assert values(spark, X.plain_answer, " a [REF:x]") == ["a"]


def test_sets(spark):
    df = spark.createDataFrame([("a b c", "b c d"), ("", "x"), ("A  b", "a B")], "a string, b string")
    assert [r.x for r in df.select(F.round(X.jaccard(X.space_set("a"), X.space_set("b")), 3).alias("x")).collect()] == [0.5, 0.0, 1.0]
    assert values(spark, X.content_words, "What is the QUIC?") == [["quic"]]
    assert values(spark, X.rfc_mentions, "rfc 9000, RFC9001 RFC9001") == [["RFC9001", "rfc 9000"]]


def test_queries_and_replies(spark):
    assert values(spark, X.classify_query, "Overview of QUIC", "Who chairs ADD?", "整體 view") == ["global", "local", "global"]
    assert values(spark, X.query_type, "global", "both", None) == ["global", "local", "local"]
    assert values(spark, X.judged_yes_no, "Yes", "partial", "no", "so YES", "hm") == [1.0, 0.5, 0.0, 1.0, 0.5]
    assert values(spark, X.judged_score, "8/10", "0.4", "12", "-") == [0.8, 0.4, 1.0, 0.5]
    assert values(spark, X.claims, "- a\n-- b\nc", "One. Two! ") == [["a", "b"], ["One", "Two"]]
    assert values(spark, X.clean_placeholder, "String or null", " x ", None) == ["", "x", ""]
    assert values(spark, X.friendly_error, "HTTP 429", None, "odd")[0].startswith("API usage")
    replies = ['{"n": 1}', '```json\n{"n": 2}\n```', "so: “n” {“n”: 3} ok", "none"]
    assert values(spark, lambda c: X.repaired_json(c, "n int").n, *replies) == [1, 2, 3, None]
    assert values(spark, X.string_list, '["a","b"]', "x", None) == [["a", "b"], [], []]
    head = values(spark, X.source_header, "[SOURCE: v.mp4, START: 1.5, END: 2, ID: 7]\nbody", "body")
    assert (head[0].video, head[0].start, head[0].end, head[0].id) == ("v.mp4", 1.5, 2.0, "7") and head[1] is None
    assert values(spark, X.without_headers, "[SOURCE: v, START: 1, END: 2]\n\nbody ") == ["body"]
