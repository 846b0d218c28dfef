"""Named queries over the driver's tables, each beside the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X
from tessera.operators import chunk, communities, evaluate, extract, graph, numbered, organize, resolve, search, timeline, vectors, views
from tessera.operators import answer as answers
from tessera.plans import flows
from tessera.plans.fixtures import ASKED, ENTITIES, HITS, HOP1, NAMES, PAIRS, RECORDS, SPEECH, Tables
from tessera.sources import sinks
from tessera.sources.scratch import saved
from tessera.sources.shipping import ship
from tessera.streaming import events

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query over :class:`Tables`, with its SQL where that can express it."""

    def wrap(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- vectors and search --------------------------------------------------------------------------------------------


def _batch(t: Tables, k: int) -> DataFrame:
    table = t["embeddings"]
    return vectors.top_k_batched(table, table.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k, "vec_id", "query_id")


@query("SELECT e.vec_id, e.label, round(1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 10")
def vector_topk(t):
    asked = t["embeddings"].where("vec_id = 0").select("embedding").first()
    return vectors.top_k(t["embeddings"], asked[0] if asked else [], 10, "vec_id").select("vec_id", "label", "score")


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 10")
def vector_topk_cosine(t):
    asked = t["embeddings"].where("vec_id = 0").select("embedding").first()
    return vectors.top_k(t["embeddings"], asked[0] if asked else [], 10, "vec_id", metric="cosine").select("vec_id", "score")


@query(f"WITH {HITS} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10")
def vector_topk_batched(t):
    return _batch(t, 10).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HITS} SELECT query_id, vec_id, source, lang, score, rank FROM ranked JOIN documents ON doc_id = vec_id WHERE rank <= 10 AND score >= -0.5")
def local_search(t):
    """Top-k of a batch of vectors joined to their documents, above the cut-off."""
    docs = t["documents"].select("doc_id", "source", "lang")
    hits = _batch(t, 10).where(F.col("score") >= -0.5)
    return hits.join(docs, hits.vec_id == docs.doc_id).select("query_id", "vec_id", "source", "lang", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {HITS} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM ranked WHERE score >= -0.35 AND rank <= 20 QUALIFY place <= 5")
def score_cutoff_topk(t):
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return _batch(t, 20).where("score >= -0.35").withColumn("place", place.cast("long")).where("place <= 5").select("query_id", "vec_id", "score", "place")


@query(f"WITH {RECORDS} SELECT id, video_name FROM records WHERE lower(regexp_replace(video_name, '\\.[^.]+$', '')) IN ('src0', 'src3')")
def meeting_filter_local(t):
    return search.in_meetings(t.records(), ["SRC0", "src3"], "video_name").select("id", "video_name")


@query("SELECT label, count(*) AS vectors FROM embeddings LEFT JOIN documents ON doc_id = vec_id GROUP BY label HAVING bool_or(source IN ('src1', 'src4')) OR count(source) = 0")
def meeting_filter_global(t):
    docs = t["documents"].select("doc_id", F.struct(F.concat("source", F.lit(".mp4")).alias("source_video")).alias("ref"), "source")
    rows = t["embeddings"].join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    groups = rows.groupBy("label").agg(F.count("*").alias("vectors"), F.collect_set(F.when(F.col("source").isNotNull(), F.col("ref"))).alias("source_refs"))
    return search.any_in_meetings(groups, ["src1", "src4"]).select("label", "vectors")


# --- records and slides --------------------------------------------------------------------------------------------


@query(rf"WITH {RECORDS} SELECT regexp_replace(regexp_replace(video_name, '\.[^.]+$', ''), '[^\p{{L}}\p{{N}}_\-]', '_', 'g') || '_' || id || '.txt' AS source_file, md5('[SOURCE: ' || video_name || ', START: ' || CAST(start_time AS VARCHAR) || ', END: ' || CAST(end_time AS VARCHAR) || ', ID: ' || id || ']' || CASE WHEN trim(ocr_text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN chr(10) || chr(10) || trim(ocr_text, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END || CASE WHEN trim(transcript, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN chr(10) || chr(10) || trim(transcript, ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END) AS body FROM records")
def records_to_txt(t):
    return sinks.texts(t.records()).select("source_file", F.md5("body").alias("body"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '(.)\.[^.]+$', '\1'), '[^\p{L}\p{N}_\-]', '_', 'g') || '_' || CAST(page_id AS VARCHAR) || '.txt' AS file, substr(regexp_replace(url, '[<>:\"/\\|?*]', '_', 'g'), 1, 120) AS meeting FROM pages")
def safe_names(t):
    return t["pages"].select("page_id", X.safe_filename("url", "page_id").alias("file"), X.safe_meeting_name("url").alias("meeting"))


@query(rf"""WITH {RECORDS}, lines AS (SELECT *, list_filter(list_transform(string_split(trim(ocr_text, ' ' || chr(9) || chr(10) || chr(13)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM records)
SELECT id, row_number() OVER (ORDER BY video_name, start_time, ord) AS slide_index, video_name, start_time AS start_sec, end_time AS end_sec,
 printf('%02d:%02d:%02d', CAST(floor(start_time / 3600) AS BIGINT), CAST(floor(start_time % 3600 / 60) AS BIGINT), CAST(start_time % 60 AS BIGINT)) AS stamp, CASE WHEN len(l) > 0 THEN l[1] ELSE 'Segment ' || id END AS title FROM lines""")
def slide_segments(t):
    rows = timeline.segments_view(t.records())
    flat = rows.select(F.col("ord").cast("string").alias("id"), "video_name", "time_range.start_sec", "time_range.end_sec", F.col("time_range.display_timestamp").alias("stamp"), "multimodal_content.visual_info.title", "ord")
    return timeline.numbered(flat, "video_name", "start_sec", "ord").drop("ord")


@query(f"WITH {RECORDS} SELECT id, video_name, start_time, coalesce(lead(start_time) OVER (PARTITION BY video_name ORDER BY start_time, ord), (SELECT max(\"end\") FROM (WITH {SPEECH} SELECT * FROM speech) s WHERE s.video_name = records.video_name), start_time) AS end_time FROM records")
def slide_intervals(t):
    rows = t.records().select("id", "video_name", "start_time", "ord")
    return timeline.slide_intervals(rows, t.speech(), order=("ord",)).select("id", "video_name", "start_time", "end_time")


@query(f"""WITH {RECORDS}, {SPEECH}, met AS (SELECT r.id, s.text, s."start" AS s, s."end" AS e FROM records r JOIN speech s ON s.video_name = r.video_name AND s."end" > r.start_time AND s."start" < r.end_time)
SELECT r.id, count(m.id) AS n, md5(coalesce(string_agg(m.text, ' ' ORDER BY m.s, m.e, m.text), '')) AS transcript FROM records r LEFT JOIN met m ON m.id = r.id GROUP BY r.id""")
def transcript_overlap_join(t):
    slides = t.records().select("id", "video_name", "start_time", "end_time")
    out = timeline.overlap_join(slides, t.speech(), ["id"], counted=True)
    return out.select("id", F.col("segments").cast("long").alias("n"), F.md5("transcript").alias("transcript"))


@query(f"""WITH {RECORDS}, {SPEECH}, slides AS (SELECT video_name, start_time, max(id) AS slide FROM records GROUP BY 1, 2)
SELECT conv_id, turn, s.video_name, slide FROM speech s ASOF LEFT JOIN slides r ON s.video_name = r.video_name AND s."start" >= r.start_time""")
def asof_slide(t):
    slides = t.records().select("video_name", "start_time", F.col("id").alias("slide"))
    return timeline.as_of(t.speech().select("conv_id", "turn", "video_name", "start"), slides, "video_name", "start", "start_time", "slide").select("conv_id", "turn", "video_name", "slide")


@query("SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) = 1")
def dedup_keep_first(t):
    return resolve.first_by(t["documents"].select("doc_id", "lang", "n_chars"), ["lang", "n_chars"], "doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id DESC) = 1")
def dedup_keep_last(t):
    return resolve.last_by(t["documents"].select("doc_id", "lang", "n_chars"), ["lang", "n_chars"], "doc_id")


@query("SELECT video || '.mp4' AS meet, coalesce(b.link, a.link) AS link FROM (SELECT DISTINCT source AS video, 'old/' || source AS link FROM documents WHERE source IS NOT NULL) a FULL JOIN (SELECT DISTINCT 'src' || CAST(conv_id % 20 + 5 AS VARCHAR) AS video, 'new/' || CAST(conv_id % 20 + 5 AS VARCHAR) AS link FROM conversations) b USING (video)")
def link_upsert(t):
    old = t["documents"].where("source is not null").select(F.concat("source", F.lit(".mp4")).alias("meet"), F.concat(F.lit("old/"), "source").alias("link")).distinct()
    n = (F.col("conv_id") % 20 + 5).cast("string")
    new = t["conversations"].select(F.concat(F.lit("src"), n, F.lit(".mp4")).alias("meet"), F.concat(F.lit("new/"), n).alias("link")).distinct()
    return resolve.upsert_links(old, new)


# --- names, texts, chunks ------------------------------------------------------------------------------------------

_CANON = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '[-_]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s/.]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_CANON.format('split_part(text, chr(10), 1)')} AS name, substr(md5({_CANON.format('split_part(text, chr(10), 1)')} || '|CONCEPT'), 1, 12) AS id FROM documents")
def canonical_names(t):
    line = F.split("text", "\n")[0]
    return t["documents"].select("doc_id", X.canonical_name(line).alias("name"), X.entity_id(line, F.lit(" concept ")).alias("id"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)RFC\s?\d+'))), ',') AS rfcs, array_to_string(list_sort(list_distinct(regexp_extract_all(text || ' Quic uses UDP; quic, TLSv', '(?i)\b(?:QUIC|TCP|UDP|HTTP|TLS)\b'))), ',') AS protocols FROM documents")
def mention_extract(t):
    more = F.concat("text", F.lit(" Quic uses UDP; quic, TLSv"))
    return t["documents"].select("doc_id", F.array_join(X.rfc_mentions("text"), ",").alias("rfcs"), F.array_join(X.protocol_mentions(more), ",").alias("protocols"))


@query(r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents) SELECT doc_id, unnest(list_transform(l, lambda x: md5(x))) AS sentence, generate_subscripts(l, 1) - 1 AS idx FROM s")
def sentence_split(t):
    return t["documents"].select("doc_id", F.posexplode(X.sentences("text")).alias("at", "s")).select("doc_id", F.md5("s").alias("sentence"), F.col("at").cast("long").alias("idx"))


@query()
def chunk_documents(t):
    """Text units of 150 tokens with 10 of overlap from the exported records; the packing is a fold that SQL lacks."""
    texts = sinks.texts(t.records()).select("source_file", "body", "source_video", "start_time", "end_time")
    return chunk.text_units(texts, 150, 10).select("source_file", F.col("i").cast("long").alias("i"), "id", F.length("raw_text").alias("chars"), F.md5("text").alias("text"))


@query("SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens, right(text, 40) AS tail, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS head FROM documents")
def token_estimates(t):
    return t["documents"].select("doc_id", X.approx_tokens("text").alias("tokens"), X.tail_tokens("text", 10).alias("tail"), X.cut("text", 80, "...").alias("head"))


@query("SELECT doc_id, lower(text) LIKE '%overview%' OR lower(text) LIKE '%trend%' OR lower(text) LIKE '%history%' OR lower(text) LIKE '%compare%' OR lower(text) LIKE '%evolution%' OR lower(text) LIKE '%what are all%' OR lower(text) LIKE '%which groups%' OR lower(text) LIKE '%overall%' OR lower(text) LIKE '%summary%' OR text LIKE '%概述%' OR text LIKE '%趨勢%' OR text LIKE '%整體%' OR text LIKE '%比較%' OR text LIKE '%歷史%' OR text LIKE '%哪些%' AS breadth, CASE WHEN doc_id % 3 = 0 THEN 'global' ELSE 'local' END AS kind FROM documents")
def classify_fallback(t):
    given = F.element_at(F.array(F.lit("global"), F.lit("both"), F.lit("local")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t["documents"].select("doc_id", (X.classify_query("text") == "global").alias("breadth"), X.query_type(given).alias("kind"))


@query("SELECT doc_id, 'see [REF:' || CAST(doc_id AS VARCHAR) || '] and [REF: b ] or [REF:c], [REF:' || CAST(doc_id % 7 AS VARCHAR) || '] [REF:' || CAST(doc_id AS VARCHAR) || ']' AS normal, CAST(doc_id AS VARCHAR) || ',b,c' || CASE WHEN doc_id = doc_id % 7 THEN '' ELSE ',' || CAST(doc_id % 7 AS VARCHAR) END AS cited, 'see  and  or ,' AS plain FROM documents")
def citation_extract(t):
    i = F.col("doc_id").cast("string")
    made = F.concat(F.lit("see [REF:"), i, F.lit("] and (REF: b ) or <REF:c>, 【REF："), (F.col("doc_id") % 7).cast("string"), F.lit("】 [REF:"), i, F.lit("]"))
    rows = t["documents"].select("doc_id", X.normal_citations(made).alias("normal"))
    return rows.select("doc_id", "normal", F.array_join(X.citations("normal"), ",").alias("cited"), X.plain_answer("normal").alias("plain"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'n' || CAST(doc_id AS VARCHAR) END AS name, CASE doc_id % 4 WHEN 3 THEN NULL ELSE CAST(doc_id % 10 AS BIGINT) END AS n FROM documents")
def json_repair(t):
    body = F.format_string('{"name": "n%d", "n": %d}', "doc_id", F.col("doc_id") % 10)
    reply = F.element_at(F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Sure! "), F.translate(body, '"', "“"), F.lit(" Done.")), F.lit("no json here")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t["documents"].select("doc_id", X.repaired_json(reply, "name string, n long").alias("r")).select("doc_id", "r.name", "r.n")


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 's' || page_id WHEN 2 THEN 'l' || page_id END AS video, regexp_extract(url, '^\w+://([^/:?#]+)', 1) AS host FROM pages""")
def url_video_id(t):
    i = F.col("page_id").cast("string")
    made = F.element_at(F.array(F.concat(F.lit("https://www.youtube.com/watch?v=v"), i, F.lit("&t=3")), F.concat(F.lit("https://youtu.be/s"), i), F.concat(F.lit("https://m.youtube.com/live/l"), i, F.lit("?x=1")), F.concat(F.lit("http://youtube.com/watch?v="), i), F.col("url")), (F.col("page_id") % 5 + 1).cast("int"))
    return t["pages"].select("page_id", X.youtube_id(made).alias("video"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query(r"""SELECT doc_id, printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS stamp, printf('%d:%02d', n_chars // 60, n_chars % 60) AS short,
 CASE WHEN doc_id < 1000 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS padded, 'https://x/?a=1&t=' || CAST(n_chars AS VARCHAR) || 's' AS link,
 replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS shown, least(greatest(n_chars / 5000.0, 0), 1)::DOUBLE AS clamped,
 CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS judged, CASE doc_id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 ELSE 1.0 END::DOUBLE AS rated FROM documents""")
def scalar_functions(t):
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % 4 + 1).cast("int"))
    return t["documents"].select(
        "doc_id", X.hhmmss("n_chars").alias("stamp"), X.minutes_seconds("n_chars").alias("short"), X.zero_filled(F.col("doc_id").cast("string")).alias("padded"), X.url_at(F.lit("https://x/?t=9s&a=1"), "n_chars").alias("link"),
        X.html_escaped(F.col("text")).alias("shown"), X.clamped(F.col("n_chars") / 5000.0).alias("clamped"),
        X.judged_yes_no(pick("Yes, it is", "partial support", "NO.", "I say YES")).alias("judged"), X.judged_score(pick("8 of 10", "none", "0.4", "score 12")).alias("rated"),
    )


@query(r"SELECT doc_id, text AS rest, CASE WHEN source LIKE '%,%' THEN NULL ELSE coalesce(source, 'unknown') END AS video, CASE WHEN source LIKE '%,%' THEN NULL ELSE n_chars / 10.0::DOUBLE END AS seconds FROM documents")
def source_headers(t):
    """Headers read back; a source with a comma in it is no header to the pattern, so video and seconds are null."""
    made = F.concat(F.lit("[SOURCE: "), F.coalesce("source", F.lit("unknown")), F.lit(", START: "), (F.col("n_chars") / 10.0).cast("string"), F.lit(", END: 9.5, ID: x]"))
    rows = t["documents"].select("doc_id", X.source_header(made).alias("h"), X.without_meeting_prefix(F.concat(F.lit("[Meeting: m | 1.0s ~ 2.0s]\n\n"), F.col("text"))).alias("rest"))
    return rows.select("doc_id", "rest", "h.video", F.col("h.start").alias("seconds"))


# --- entities, relationships, graph ---------------------------------------------------------------------------------


@query(f"WITH {ENTITIES} SELECT canonical, name, CAST(units AS BIGINT) AS units, substr(md5(canonical || '|CONCEPT'), 1, 12) AS id FROM entities")
def merge_entities(t):
    return t.entities().select("canonical", "name", "units", "id")


@query(f"WITH {PAIRS} SELECT lower(source) AS source_name, lower(target) AS target_name, CAST(count(*) AS DOUBLE) AS weight, count(DISTINCT unit) AS units, substr(md5(lower(source) || '|RELATED_TO|' || lower(target)), 1, 12) AS id FROM pairs GROUP BY 1, 2")
def merge_relationships(t):
    return resolve.relationship_rows(t.relationships(), t.entities()).select("source_name", "target_name", "weight", "units", "id")


@query(f"WITH {NAMES}, e AS (SELECT DISTINCT unit, substr(md5(lower(name) || '|CONCEPT'), 1, 12) AS id FROM names) SELECT u.id, md5(coalesce(string_agg(e.id, ',' ORDER BY e.id), '')) AS entities FROM (SELECT substr(md5('doc:' || CAST(doc_id AS VARCHAR)), 1, 16) AS id FROM documents) u LEFT JOIN e ON e.unit = u.id GROUP BY u.id")
def unit_entities(t):
    return resolve.unit_entities(t.entities(), t.units(), t.mentions()).select(F.col("id"), F.md5(F.array_join("entity_ids", ",")).alias("entities"))


@query(f"WITH {PAIRS} SELECT least(source, target) AS source, greatest(source, target) AS target, sum(weight) AS weight FROM edges GROUP BY 1, 2")
def edge_collapse(t):
    return graph.collapsed(t.edges())


@query("SELECT 'P' || CAST(l_partkey AS VARCHAR) AS source, 'S' || CAST(l_suppkey AS VARCHAR) AS target, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def part_supplier_edges(t):
    rows = t["lineitem"].groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    return graph.collapsed(rows.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target"), "weight"))


@query(f"WITH {PAIRS} SELECT node, count(*) AS degree FROM adjacent GROUP BY node")
def node_degrees(t):
    return graph.degrees(t.edges())


@query(f"WITH {PAIRS} SELECT node, count(*) AS degree FROM adjacent GROUP BY node ORDER BY degree DESC, node LIMIT 40")
def top_degree_nodes(t):
    return views.top_degree(t.edges())


@query(f"WITH {HOP1} SELECT query_id, node, round(score, 6) AS score FROM reach1")
def bfs_1hop(t):
    return graph.expand(graph.both_ways(t.edges()), t.seeds(), 1, ("query_id",)).withColumn("score", F.round("score", 6))


@query(f"""WITH {HOP1}, hop2 AS (SELECT h.query_id, a.neighbour AS node, max(h.score * (a.weight / m) * 0.5) AS score FROM hop1 h JOIN adjacent a USING (node), most
 WHERE NOT EXISTS (SELECT 1 FROM reach1 r WHERE r.query_id = h.query_id AND r.node = a.neighbour) GROUP BY 1, 2)
SELECT query_id, count(*) AS nodes, round(sum(score), 4) AS total, round(min(score), 6) AS least FROM (SELECT * FROM reach1 UNION ALL SELECT * FROM hop2) GROUP BY query_id""")
def bfs_2hop(t):
    names, edges = t.numbered(t.seeds())
    seeds = numbered.looked_up(t.seeds(), names, ["node"])
    reached = numbered.reach(edges, seeds, 2, "query_id", names.nodes)
    return reached.groupBy("query_id").agg(F.count("*").alias("nodes"), F.round(F.sum("score"), 4).alias("total"), F.round(F.min("score"), 6).alias("least"))


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY n_chars) AS component FROM documents")
def connected_components(t):
    """Documents chained to the next of the same length; a chain's component is its smallest."""
    docs = t["documents"].select("doc_id", "n_chars")
    chain = docs.withColumn("source", F.lag("doc_id").over(W.partitionBy("n_chars").orderBy("doc_id"))).where("source is not null").select("source", F.col("doc_id").alias("target"))
    return graph.components(docs.select(F.col("doc_id").alias("node")), chain)


def _label_rounds(rounds: int) -> str:
    """SQL of rounds of label propagation: the label of most weight around a node, ties to the smaller, if it is smaller."""
    sql = ""
    for i in range(1, rounds + 1):
        sql += f""", votes{i} AS (SELECT a.node, l.label, sum(a.weight) AS w FROM around a JOIN label{i - 1} l ON l.node = a.neighbour GROUP BY a.node, l.label),
won{i} AS (SELECT node, arg_min(label, (-w, label)) AS label FROM votes{i} GROUP BY node),
label{i} AS MATERIALIZED (SELECT l.node, least(l.label, coalesce(w.label, l.label)) AS label FROM label{i - 1} l LEFT JOIN won{i} w ON w.node = l.node)"""
    return sql


@query(f"""WITH {PAIRS}, around AS MATERIALIZED (SELECT node, neighbour, sum(weight) AS weight FROM adjacent WHERE node <> neighbour GROUP BY node, neighbour),
label0 AS MATERIALIZED (SELECT DISTINCT lower(name) AS node, lower(name) AS label FROM names){_label_rounds(5)}
SELECT label AS community, count(*) AS members FROM label5 GROUP BY label""")
def label_communities(t):
    """Label propagation over the graph of names, in five rounds."""
    edges = saved(graph.collapsed(t.edges()), "edges")
    nodes = t.entities().select(F.col("canonical").alias("node"))
    return graph.label_propagation(nodes, edges).groupBy("community").agg(F.count("*").alias("members"))


@query()
def louvain_communities(t):
    names, edges = t.numbered()
    edges = saved(graph.collapsed(edges), "edges")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    found = graph.louvain(nodes, edges, numbered=names.nodes).groupBy("community").agg(F.count("*").alias("members"))
    return found.join(names, found.community == names.id).select(F.col("node").alias("community"), "members")


def _letters(found: DataFrame) -> DataFrame:
    """Communities of names by first letter, with reports."""
    belong = communities.members(found.select(F.col("key").alias("node"), F.substring("key", 1, 1).alias("community")), found)
    return communities.reports(communities.described(belong, found))


@query(f"WITH {ENTITIES} SELECT substr(canonical, 1, 1) AS letter, substr(md5(min(canonical || '|CONCEPT')), 1, 8) AS id, CAST(count(*) AS BIGINT) AS entity_count FROM entities GROUP BY 1")
def community_members(t):
    found = t.entities()
    out = _letters(found)
    return out.select(F.substring(F.col("entity_names")[0], 1, 1).alias("letter"), "id", F.col("entity_count").cast("long").alias("entity_count"))


@query(f"WITH {PAIRS} SELECT substr(source, 1, 1) AS community, source AS source_name, target AS target_name, weight FROM edges WHERE substr(source, 1, 1) = substr(target, 1, 1)")
def community_internal_rels(t):
    relationships = resolve.relationship_rows(t.relationships(), t.entities())
    return communities.inner_relationships(t.communities(), relationships).select("community", "source_name", "target_name", "weight")


_SCORED = HOP1 + """, letters AS (SELECT substr(lower(name), 1, 1) AS id, count(DISTINCT lower(name)) AS n FROM names GROUP BY 1),
scored AS (SELECT query_id, id, sum(score) / n AS g FROM (SELECT r.query_id, r.node, r.score FROM reach1 r WHERE EXISTS (SELECT 1 FROM names WHERE lower(name) = r.node)) JOIN letters ON id = substr(node, 1, 1) GROUP BY query_id, id, n)"""


@query(f"WITH {_SCORED} SELECT query_id, id, round(g, 6) AS g FROM scored")
def community_graph_score(t):
    reached = graph.expand(graph.both_ways(t.edges()), t.seeds(), 1, ("query_id",))
    return search.community_graph_scores(t.communities(), reached).withColumn("g", F.round("g", 6))


@query(f"""WITH {PAIRS}, {ASKED}, hits AS (SELECT query_id, substr(lower(name), 1, 1) AS id, max(round(0.9 - (idx - 1) * 0.2, 6)) AS v FROM asked GROUP BY 1, 2),
letters AS (SELECT substr(lower(name), 1, 1) AS id, count(DISTINCT lower(name)) AS n FROM names GROUP BY 1), members AS (SELECT DISTINCT substr(lower(name), 1, 1) AS id, lower(name) AS node FROM names),
start AS (SELECT DISTINCT query_id, node FROM hits JOIN members USING (id)), most AS (SELECT max(weight) AS m FROM adjacent),
hop AS (SELECT s.query_id, a.neighbour AS node, max(a.weight / m) AS score FROM start s JOIN adjacent a USING (node), most WHERE NOT EXISTS (SELECT 1 FROM start t WHERE t.query_id = s.query_id AND t.node = a.neighbour) GROUP BY 1, 2),
reach AS (SELECT query_id, node, 1.0::DOUBLE AS score FROM start UNION ALL SELECT * FROM hop), g AS (SELECT query_id, id, sum(score) / n AS g FROM reach JOIN members USING (node) JOIN letters USING (id) GROUP BY query_id, id, n),
merged AS (SELECT query_id, id, coalesce(v, 0)::DOUBLE AS v, round(coalesce(g, 0)::DOUBLE, 9) AS g, v IS NOT NULL AS hit FROM hits FULL JOIN g USING (query_id, id)),
top AS (SELECT query_id, id, round(0.7 * v + 0.3 * g, 6) AS score, v = 0 AS via_graph FROM merged WHERE hit OR g >= 0.05)
SELECT query_id, id, score, via_graph FROM top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def global_search(t):
    """Communities by blended score; the vector hits are the letters of a question's first names."""
    hits = t.asked().groupBy("query_id", F.substring(F.lower("name"), 1, 1).alias("id")).agg(F.max(F.round(0.9 - F.col("at") * 0.2, 6)).alias("score"))
    known = saved(t.communities(), "communities")
    return search.global_search(hits, known, saved(graph.both_ways(t.edges()), "adjacent"), 5).select("query_id", "id", "score", "via_graph")


_CUT = "(SELECT DISTINCT query_id, CASE WHEN idx % 2 = 1 THEN lower(name) ELSE substr(lower(name), 2, 5) END AS asked FROM asked)"


@query(f"""WITH {ENTITIES}, {ASKED}, want AS {_CUT}, exact AS (SELECT query_id, asked, canonical AS node FROM want JOIN entities ON canonical = asked),
near AS (SELECT query_id, asked, arg_min(canonical, ord) AS node FROM want JOIN entities ON contains(canonical, asked) OR contains(asked, canonical) WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = want.query_id AND e.asked = want.asked) GROUP BY 1, 2)
SELECT * FROM exact UNION ALL SELECT * FROM near""")
def entity_seed_match(t):
    asked = t.asked().select("query_id", F.when(F.col("at") % 2 == 0, F.lower("name")).otherwise(F.substring(F.lower("name"), 2, 5)).alias("name"))
    return search.match_seeds(asked, t.entities())


@query(f"WITH {HOP1} SELECT query_id, node, round(score, 6) AS score FROM hop1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 10")
def entity_graph_search(t):
    near = search.neighbours(t.seeds().distinct(), graph.both_ways(t.edges()))
    return near.select("query_id", "node", F.round("score", 6).alias("score"))


@query(f"""WITH {HOP1}, near AS (SELECT query_id, node FROM hop1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 10),
n AS (SELECT query_id, node, 1 AS seed FROM seeds UNION ALL SELECT query_id, node, 0 FROM near)
SELECT a.query_id, least(e.source, e.target) AS a, greatest(e.source, e.target) AS b, arg_min(e.weight, e.source || ' ' || e.target) AS weight FROM edges e JOIN n a ON a.node = e.source JOIN n b ON b.node = e.target AND b.query_id = a.query_id WHERE a.seed + b.seed > 0 GROUP BY 1, 2, 3""")
def seed_relationships(t):
    edges = saved(t.edges(), "edges")
    seeds = t.seeds().distinct()
    rows = edges.select("source", "target", "weight", F.lit("").alias("description"), F.concat_ws(" ", "source", "target").alias("ord"))
    out = search.seed_relationships(seeds, search.neighbours(seeds, graph.both_ways(edges)), rows)
    return out.select("query_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")


@query(f"WITH {ENTITIES}, m AS (SELECT DISTINCT lower(n.name) AS canonical, coalesce(d.source, 'unknown') AS meeting FROM names n JOIN documents d USING (doc_id)) SELECT e.name AS id, substr(e.canonical, 1, 1) AS community_id, (SELECT string_agg(meeting, ',' ORDER BY meeting) FROM m WHERE m.canonical = e.canonical) AS meetings FROM entities e")
def graph_view_nodes(t):
    nodes = views.graph_nodes(t.entities(), t.units(), t.communities(), t.mentions())
    return nodes.select("id", "community_id", F.array_join("meetings", ",").alias("meetings"))


@query(f"WITH {PAIRS}, first AS (SELECT lower(name) AS c, arg_min(name, (doc_id, idx)) AS name FROM names GROUP BY 1), best AS (SELECT node FROM adjacent GROUP BY node ORDER BY count(*) DESC, node LIMIT 40) SELECT source, target, weight FROM edges WHERE source IN (SELECT node FROM best) AND target IN (SELECT node FROM best)")
def answer_subgraph(t):
    edges = saved(t.edges(), "edges")
    return views.answer_subgraph(edges, edges.sparkSession.createDataFrame([], "node string"))[1]


@query(f"WITH {PAIRS}, {ASKED} SELECT DISTINCT neighbour AS node FROM adjacent WHERE node IN (SELECT node FROM seeds) UNION SELECT node FROM seeds")
def graph_neighbourhood(t):
    return views.neighbourhood(t.edges(), t.seeds())


@query(f"WITH {ENTITIES} SELECT canonical, name FROM entities WHERE contains(canonical, 'ther')")
def keyword_search(t):
    return views.keyword_search(t.entities(), "THER").select("canonical", "name")


@query(f"WITH {PAIRS}, u AS (SELECT count(*) AS n FROM documents) SELECT (SELECT n FROM u) AS text_units, (SELECT count(DISTINCT lower(name)) FROM names) AS entities, (SELECT count(*) FROM edges) AS relationships, (SELECT count(DISTINCT substr(lower(name), 1, 1)) FROM names) AS communities, 'CONCEPT' AS entity_types, 'RELATED_TO' AS rel_types")
def index_meta(t):
    entities = t.entities()
    meta = resolve.index_meta(t.units(), entities, resolve.relationship_rows(t.relationships(), entities), t.communities().select("id").distinct())
    return meta.select("text_units", "entities", "relationships", "communities", F.array_join("entity_types", ",").alias("entity_types"), F.array_join("rel_types", ",").alias("rel_types"))


# --- evidence and answers -------------------------------------------------------------------------------------------


def _chunks(t: Tables) -> DataFrame:
    """The five best documents of each vector question as chunks, with their names as entities."""
    docs = t["documents"].select("doc_id", "text", F.concat(F.coalesce("source", F.lit("unknown")), F.lit(".mp4")).alias("source_video"), (F.col("doc_id") * 1.0).alias("start_time"), (F.col("doc_id") + 1.0).alias("end_time"))
    hits = _batch(t, 5).join(docs, F.col("vec_id") == F.col("doc_id"))
    entities = F.transform(extract.names(F.col("text")), lambda n: F.struct(n.alias("name"), F.lit("CONCEPT").alias("type"), F.when(F.length(n) > 6, F.lit("long")).otherwise("").alias("description")))
    hits = hits.select("query_id", F.col("vec_id").cast("string").alias("id"), "text", "source_video", "start_time", "end_time", "score", entities.alias("related_entities"), F.col("rank").alias("place"))
    return organize.unit_chunks(hits).join(hits.select("query_id", F.col("id").alias("chunk_id"), "place"), ["query_id", "chunk_id"])


_TOP = HITS + """, best AS (SELECT r.query_id, r.vec_id, r.rank AS place, d.text, coalesce(d.source, 'unknown') || '.mp4' AS video FROM ranked r JOIN documents d ON d.doc_id = r.vec_id WHERE r.rank <= 5)"""


@query(f"""WITH {_TOP}, {NAMES}, e AS (SELECT query_id, place, idx, n.name FROM best b JOIN names n ON n.doc_id = b.vec_id)
SELECT query_id, arg_min(name, (CASE WHEN length(name) > 6 THEN 0 ELSE 1 END, place, idx)) AS name, count(*) AS frequency FROM e GROUP BY query_id, lower(name)""")
def consolidate_entities(t):
    return organize.consolidated_entities(_chunks(t)).select("query_id", "name", "frequency")


@query(f"WITH {_TOP} SELECT query_id, video AS source_video, vec_id::DOUBLE AS start_time, row_number() OVER (PARTITION BY query_id ORDER BY video, vec_id) AS rank FROM best")
def consolidate_refs(t):
    return organize.consolidated_refs(_chunks(t)).select("query_id", "source_video", "start_time", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TOP} SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS ordinal, video || '  ' || printf('%.1f', vec_id::DOUBLE) || 's-' || printf('%.1f', vec_id + 1.0::DOUBLE) || 's' AS title FROM best WHERE place <= 3")
def cited_chunks(t):
    """Extractive answers, and the chunks that their citations lead back to."""
    chunks = saved(_chunks(t), "chunks")
    said = answers.extractive_answers(chunks.select("query_id").distinct(), chunks)
    return answers.resolved_citations(said, chunks).select("query_id", "chunk_id", F.col("ordinal").cast("long").alias("ordinal"), "title")


@query(f"WITH {_TOP}, {NAMES}, e AS (SELECT query_id, n.name, min((place, idx)) AS o FROM best b JOIN names n ON n.doc_id = b.vec_id WHERE place <= 3 GROUP BY 1, 2) SELECT query_id, string_agg(name, ',' ORDER BY o) AS names FROM e GROUP BY query_id")
def cited_entities(t):
    chunks = saved(_chunks(t), "chunks")
    said = answers.extractive_answers(chunks.select("query_id").distinct(), chunks)
    return answers.cited_entity_names(answers.resolved_citations(said, chunks)).select("query_id", F.array_join("names", ",").alias("names"))


_WORDS = r"list_filter(list_distinct(string_split_regex(lower({0}), '\s+')), lambda x: x <> '')"


@query(f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w, lead(doc_id) OVER (PARTITION BY n_chars ORDER BY doc_id) AS other FROM documents) SELECT a.doc_id, b.doc_id AS other, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END::DOUBLE AS likeness FROM d a JOIN d b ON a.other = b.doc_id")
def jaccard_pairs(t):
    docs = t["documents"].select("doc_id", "n_chars", X.space_set("text").alias("w"))
    nxt = F.lead(F.struct("doc_id", "w")).over(W.partitionBy("n_chars").orderBy("doc_id"))
    return docs.withColumn("o", nxt).where("o is not null").select("doc_id", F.col("o.doc_id").alias("other"), F.round(X.jaccard("w", "o.w"), 6).alias("likeness"))


@query(f"""WITH RECURSIVE {_TOP}, c AS (SELECT b.query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id, r.score, {_WORDS.format('b.text')} AS w, row_number() OVER (PARTITION BY b.query_id ORDER BY r.score DESC, CAST(b.vec_id AS VARCHAR)) AS rank
 FROM best b JOIN ranked r ON r.query_id = b.query_id AND r.vec_id = b.vec_id),
alike AS (SELECT a.query_id, a.rank, list(b.rank) AS before FROM c a JOIN c b ON b.query_id = a.query_id AND b.rank < a.rank WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.5 GROUP BY 1, 2),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS kept FROM c
 UNION ALL SELECT walk.query_id, c.rank, CASE WHEN len(list_intersect(coalesce(alike.before, []), kept)) > 0 THEN kept ELSE list_append(kept, c.rank) END FROM walk JOIN c ON c.query_id = walk.query_id AND c.rank = walk.rank + 1 LEFT JOIN alike ON alike.query_id = c.query_id AND alike.rank = c.rank),
last AS (SELECT query_id, arg_max(kept, rank) AS kept FROM walk GROUP BY query_id)
SELECT c.query_id, chunk_id, score, row_number() OVER (PARTITION BY c.query_id ORDER BY c.rank) AS place FROM c JOIN last ON last.query_id = c.query_id WHERE list_contains(kept, c.rank)""")
def greedy_dedup(t):
    """Evidence of each question without near-copies of better chunks, by a fold over ranks."""
    found = organize.organize(_chunks(t).drop("place"), -1.0, 0.5, 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {_TOP}, {NAMES}, e AS (SELECT query_id, place, idx, n.name FROM best b JOIN names n ON n.doc_id = b.vec_id),
keyed AS (SELECT query_id, arg_min(name, (CASE WHEN length(name) > 6 THEN 0 ELSE 1 END, place, idx)) AS name, count(*) AS frequency, min((place, idx)) AS first FROM e GROUP BY query_id, lower(name)),
keys AS (SELECT query_id, '  ' || name || ' (CONCEPT)' || CASE WHEN length(name) > 6 THEN ' — long' ELSE '' END AS line, row_number() OVER (PARTITION BY query_id ORDER BY frequency DESC, first) AS rank FROM keyed),
lists AS (SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS names FROM keys WHERE rank <= 10 GROUP BY query_id),
shown AS (SELECT query_id, place, string_agg(name || '(CONCEPT)', ', ' ORDER BY idx) AS names FROM e WHERE idx <= 3 GROUP BY query_id, place),
sections AS (SELECT query_id, place, concat_ws(chr(10), '[CHUNK_ID: ' || CAST(vec_id AS VARCHAR) || ']  (text_unit)', CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END,
 'Entities: ' || names, '[SOURCE: ' || video || '  ' || printf('%.1fs-%.1fs', vec_id::DOUBLE, vec_id + 1.0::DOUBLE) || ']') AS section FROM best LEFT JOIN shown USING (query_id, place)),
bodies AS (SELECT query_id, string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS body FROM sections GROUP BY query_id)
SELECT query_id, concat_ws(chr(10) || chr(10), body, 'KEY ENTITIES:' || chr(10) || names) AS prompt FROM bodies LEFT JOIN lists USING (query_id)""")
def prompt_texts(t):
    chunks = saved(_chunks(t), "chunks")
    return organize.prompt_text(chunks, organize.consolidated_entities(chunks))


@query()
def ask_batch(t):
    """The benchmark's questions against an index of the documents, end to end."""
    index = flows.build_index(t.records())
    return flows.ask(index, t.questions())["responses"]


# --- evaluation -----------------------------------------------------------------------------------------------------


def _cases(t: Tables) -> DataFrame:
    """Documents as cases: the whole text asked, answered and given as context."""
    d, s = F.col("doc_id"), lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    rows = t["documents"].join(t["labels"], "doc_id", "left").select(
        s(d).alias("case_id"), F.when(d % 5 == 0, F.lit(None)).when(d % 2 == 0, "local").otherwise("global").alias("query_type"), F.when(d % 11 == 0, "failed").alias("error"), (d % 13 == 0).alias("is_fallback"),
        F.concat(F.lit("What is the "), F.col("text")).alias("query"), F.concat(F.col("text"), F.lit(" [REF:"), s(d), F.lit("] [REF:x]")).alias("answer"), F.col("text").alias("context"),
        F.when(d % 3 == 0, none).otherwise(F.array(F.coalesce("lang", F.lit("en")), F.lit("the"))).alias("query_entities"), F.array(s(d), s(d + 1), s(d + 2)).alias("retrieved"), F.array(s(d)).alias("cited"),
        F.when(F.col("quality") == 1, F.array(s(d), s(d + 5))).otherwise(none).alias("expected"), F.array("lang").alias("found_entities"), F.when(F.col("toxic") == 1, F.array(F.lit("EN"), F.lit("fr"))).otherwise(none).alias("true_entities"),
        F.array("source").alias("cited_videos"), F.when(d % 2 == 0, none).otherwise(F.array(F.lit("src1"), F.lit("src0"))).alias("expected_videos"),
    )
    return rows


_CASES = r"""d AS (SELECT documents.*, quality, toxic, CASE WHEN doc_id % 11 = 0 THEN 'failed' END AS error, doc_id % 13 = 0 AS fb, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'local' ELSE 'global' END AS query_type,
 lower('What is the ' || text) AS q, text || ' [REF:' || CAST(doc_id AS VARCHAR) || '] [REF:x]' AS a, text AS c FROM documents LEFT JOIN labels USING (doc_id)),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{N}_]+')) AS aw, list_distinct(regexp_extract_all(lower(c), '[\p{L}\p{N}_]+')) AS cw,
 list_filter(list_distinct(regexp_extract_all(q, '[\p{L}\p{N}_]+')), lambda x: NOT list_contains(['the','a','an','is','are','was','were','what','who','how','when','where','which','that','this','of','in','to','for','with','on','at','by','from','and','or'], x)) AS qw FROM d),
m AS (SELECT *, CASE WHEN error IS NOT NULL THEN 0 WHEN fb THEN 1 WHEN len(cw) = 0 THEN 0 ELSE least(1, 3 * len(list_intersect(aw, cw)) / len(list_distinct(list_concat(aw, cw)))) END::DOUBLE AS faithfulness,
 CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, aw)) / len(qw) END::DOUBLE AS cov, CASE WHEN doc_id % 3 <> 0 THEN (CAST(contains(lower(a), coalesce(lang, 'en')) AS INT) + CAST(contains(lower(a), 'the') AS INT)) / 2 END::DOUBLE AS con FROM w),
long AS (SELECT doc_id, query_type, error, 'faithfulness' AS metric, round(faithfulness, 6) AS score, faithfulness >= 0.7 AS passed FROM m
 UNION ALL SELECT doc_id, query_type, error, 'answer_relevance', round(s, 6), s >= 0.6 FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 0 WHEN fb THEN 0.5 ELSE coalesce((cov + con) / 2, cov, con, 0.5) END::DOUBLE AS s FROM m)
 UNION ALL SELECT doc_id, query_type, error, 'context_precision', round(s, 6), s >= 0.5 FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 0 ELSE 1.0 / 3 END::DOUBLE AS s FROM m)
 UNION ALL SELECT doc_id, query_type, error, 'context_recall', round(s, 6), s >= 0.5 FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 0 WHEN quality = 1 THEN 0.5 WHEN toxic = 1 THEN CASE WHEN lang IN ('en', 'fr') THEN 0.5 ELSE 0 END ELSE 0.5 END::DOUBLE AS s FROM m)
 UNION ALL SELECT doc_id, query_type, error, 'citation_accuracy', round(s, 6), s >= 0.6 FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 0 ELSE 0.3 + 0.4 * CASE WHEN doc_id % 2 = 0 THEN 1 WHEN source IN ('src0', 'src1') THEN 0.5 ELSE 0 END END::DOUBLE AS s FROM m)),
cases AS (SELECT doc_id, query_type, error, CASE WHEN error IS NULL THEN round(avg(score), 6) ELSE 0 END AS overall FROM long GROUP BY 1, 2, 3)"""


@query(f"WITH {_CASES} SELECT CAST(doc_id AS VARCHAR) AS case_id, metric, score, passed FROM long")
def eval_scores(t):
    return evaluate.scores(_cases(t)).select("case_id", "metric", "score", "passed")


@query(f"WITH {_CASES} SELECT metric, round(avg(score), 6) AS average, round(avg(CAST(passed AS INT)), 6) AS pass_rate, count(*) AS cases FROM long WHERE error IS NULL GROUP BY metric")
def eval_aggregate(t):
    return evaluate.metric_summary(evaluate.scores(_cases(t)))


@query(f"WITH {_CASES} SELECT coalesce(query_type, 'unknown') AS query_type, count(*) AS cases, round(avg(overall), 6) AS average FROM cases WHERE error IS NULL GROUP BY 1")
def eval_by_type(t):
    return evaluate.by_group(evaluate.case_scores(evaluate.scores(_cases(t))), "query_type")


@query(f"WITH {_CASES} SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, round(avg(overall) FILTER (error IS NULL), 6) AS overall FROM cases")
def eval_report(t):
    return evaluate.report(evaluate.case_scores(evaluate.scores(_cases(t))))


def _testset(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t["documents"].select(
        F.when(d % 17 == 0, "same").otherwise(d.cast("string")).alias("id"), F.when(d % 19 != 0, F.col("text")).alias("query"), F.element_at(F.array(*map(F.lit, ["local", "global", "auto", "both"])), (d % 4 + 1).cast("int")).alias("query_type"),
        F.lit("").alias("expected_answer"), F.element_at(F.array(*map(F.lit, ["easy", "medium", "hard", "odd", "easy"])), (d % 5 + 1).cast("int")).alias("difficulty"), F.array("lang", "source").alias("tags"),
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 5 IN (0, 1, 4) AND (lang = 'fr' OR source = 'src3')")
def testset_filter(t):
    return evaluate.select_cases(_testset(t), difficulties=["easy", "medium"], tags=["fr", "src3"]).where("id <> 'same'").select("id")


@query("""WITH c AS (SELECT *, CASE WHEN doc_id % 17 = 0 THEN 'same' ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents) SELECT id, 'missing query' AS error FROM c WHERE doc_id % 19 = 0 OR text IS NULL
UNION ALL SELECT id, 'invalid query_type: both' FROM c WHERE doc_id % 4 = 3 UNION ALL SELECT id, 'invalid difficulty: odd' FROM c WHERE doc_id % 5 = 3 UNION ALL SELECT id, 'repeated id' FROM c GROUP BY id HAVING count(*) > 1""")
def testset_validate(t):
    return evaluate.case_errors(_testset(t))


# --- profiles, events ------------------------------------------------------------------------------------------------


@query("SELECT 'doc_id' AS \"column\", count(*) AS row_count, count(*) - count(doc_id) AS null_count FROM documents UNION ALL SELECT 'text', count(*), count(*) - count(text) FROM documents UNION ALL SELECT 'lang', count(*), count(*) - count(lang) FROM documents UNION ALL SELECT 'source', count(*), count(*) - count(source) FROM documents UNION ALL SELECT 'n_chars', count(*), count(*) - count(n_chars) FROM documents")
def table_profile(t):
    return views.table_profile(t["documents"]).select("column", "row_count", "null_count")


@query("SELECT count(DISTINCT n_chars) AS distinct_count, count(*) - count(n_chars) AS null_count, min(n_chars)::DOUBLE AS least, max(n_chars)::DOUBLE AS greatest, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS deviation FROM documents")
def column_profile(t):
    out = views.column_profile(t["documents"], "n_chars")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "deviation")})


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def value_counts(t):
    return views.value_counts(t["documents"], "source")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(t):
    return t["events"].groupBy("event_type", F.from_json("props", "k long").k.alias("k")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return events.sessions(t["events"]).select("user_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("first"), "n")


@query("SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS first, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_events(t):
    return events.windows(t["events"]).select("event_type", F.unix_seconds(F.col("start").cast("timestamp")).alias("first"), "n", "value")
