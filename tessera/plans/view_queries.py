"""Named queries over projections, filters and displays, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import communities, evaluate, graph, organize, resolve, search, timeline, vectors, views
from tessera.operators import answer as answers
from tessera.plans.catalog import _CASES, _TOP, _cases, _chunks, query
from tessera.plans.fixtures import ASKED, NAMES, PAIRS, Tables
from tessera.sources import sinks
from tessera.sources.scratch import saved

#: White space of any kind, as the engine strips it.
_SPACE = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_FIRST = "first AS (SELECT lower(name) AS canonical, arg_min(name, (doc_id, idx)) AS name FROM names GROUP BY 1)"
_RELATED = """related AS (SELECT lower(source) AS source_name, lower(target) AS target_name, arg_min(source, (doc_id, i, j)) AS source, arg_min(target, (doc_id, i, j)) AS target,
 CAST(count(*) AS DOUBLE) AS weight FROM pairs GROUP BY 1, 2)"""


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _relationships(t: Tables) -> DataFrame:
    return resolve.relationship_rows(t.relationships(), t.entities())


def _one_of(column: str, *values: str | None):
    """The value at the place that ``column`` names, round and round."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


# --- the graph as it is kept and shown ------------------------------------------------------------------------------


@query(f"WITH {PAIRS}, {_FIRST}, {_RELATED} SELECT source, target, weight FROM related WHERE source IN (SELECT name FROM first) AND target IN (SELECT name FROM first)")
def graph_view_links(t):
    return views.graph_links(_relationships(t), t.entities()).select("source", "target", "weight")


@query(f"WITH {PAIRS}, {_RELATED} SELECT source, target, 'RELATED_TO' AS rel_type, weight, FALSE AS is_directional, '' AS description FROM related")
def graph_edges(t):
    return sinks.graph_edges(_relationships(t))


@query(f"WITH {PAIRS} SELECT least(source || '|CONCEPT', target || '|CONCEPT') AS source, greatest(source || '|CONCEPT', target || '|CONCEPT') AS target, sum(weight) AS weight FROM edges GROUP BY 1, 2")
def entity_graph(t):
    return graph.entity_graph(_relationships(t), t.entities())


@query(f"WITH {PAIRS} SELECT node, neighbour, weight FROM adjacent")
def adjacency(t):
    return graph.adjacency(_relationships(t))


@query(f"""WITH {PAIRS}, {_RELATED} SELECT DISTINCT 'MENTIONS' AS kind, unit AS source, substr(md5(lower(name) || '|CONCEPT'), 1, 12) AS target FROM names
UNION ALL SELECT 'RELATED_TO', source, target FROM related
UNION ALL SELECT DISTINCT 'BELONGS_TO', lower(name) || '|CONCEPT', substr(lower(name), 1, 1) FROM names""")
def property_edges(t):
    return sinks.property_edges(t.entities(), _relationships(t), t.communities(), t.mentions())


@query(f"WITH {PAIRS} SELECT source, target, weight FROM edges WHERE substr(source, 1, 1) NOT IN ('s', 'm') AND substr(target, 1, 1) NOT IN ('s', 'm')")
def hidden_types(t):
    """Links left when the nodes of two types are hidden; a node's type is its first letter."""
    nodes = t.entities().select(F.col("canonical").alias("id"), F.substring("canonical", 1, 1).alias("type"))
    return views.visible(t.edges(), nodes, ["s", "m"])[1]


@query(f"WITH {NAMES} SELECT DISTINCT lower(name) AS id, upper(substr(name, 1, 1)) AS type FROM names WHERE contains(lower(name), 'er') OR contains(lower(substr(name, 1, 1)), 'er')")
def node_search(t):
    nodes = t.entities().select(F.col("canonical").alias("id"), F.upper(F.substring("name", 1, 1)).alias("type"))
    return views.node_search(nodes, "ER")


@query(f"WITH {PAIRS} SELECT node, round(6 + sqrt(count(*)) * 2.5, 6) AS radius FROM adjacent GROUP BY node")
def node_display(t):
    return graph.degrees(t.edges()).select("node", F.round(X.node_radius("degree"), 6).alias("radius"))


@query(f"WITH {PAIRS} SELECT source, target, round(sqrt(weight) * 1.2, 6) AS width FROM edges")
def edge_display(t):
    return t.edges().select("source", "target", F.round(X.edge_width("weight"), 6).alias("width"))


@query(f"WITH {NAMES}, {_FIRST} SELECT canonical, name || ': ' AS embed_text FROM first")
def entity_embed_texts(t):
    return t.entities().select("canonical", vectors.EMBED_TEXTS["entities"]().alias("embed_text"))


@query(f"""WITH {NAMES}, keys AS (SELECT DISTINCT lower(name) || '|CONCEPT' AS key FROM names),
c AS (SELECT substr(key, 1, 1) AS letter, substr(md5(min(key)), 1, 8) AS id, list_sort(list(key)) AS keys FROM keys GROUP BY 1)
SELECT letter, 'Community ' || id || chr(10) || array_to_string(keys[1:5], ', ') AS embed_text FROM c""")
def community_embed_texts(t):
    found = t.entities()
    belong = communities.members(found.select(F.col("key").alias("node"), F.substring("key", 1, 1).alias("community")), found)
    groups = communities.reports(communities.described(belong, found))
    return groups.select(F.substring(F.col("entity_names")[0], 1, 1).alias("letter"), vectors.EMBED_TEXTS["communities"]().alias("embed_text"))


@query(f"""WITH {NAMES}, {_FIRST}, o AS (SELECT lower(name) AS canonical, min((doc_id, idx)) AS ord FROM names GROUP BY 1),
n AS (SELECT DISTINCT doc_id, lower(name) AS canonical FROM names)
SELECT d.doc_id, md5(coalesce(string_agg(first.name, ',' ORDER BY o.ord), '')) AS related FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN first USING (canonical) LEFT JOIN o USING (canonical) GROUP BY d.doc_id""")
def related_entities(t):
    """The entities of every unit, in the order in which they came first."""
    hits = search.related_entities(t.units().select("id", F.col("ord").alias("doc_id")), t.entities(), mentions=t.mentions())
    return hits.select("doc_id", F.md5(F.array_join(F.transform("related_entities", lambda e: e["name"]), ",")).alias("related"))


# --- texts ----------------------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, '- ' || coalesce(lang, 'none') || chr(10) || text AS listed, text FROM documents),
a AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(listed, chr(10)), lambda x: {_stripped('x')}), lambda x: starts_with(x, '-')), lambda x: {_stripped("regexp_replace(x, '^-+', '')")}), lambda x: x <> '') AS listed,
 list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: {_stripped('x')}), lambda x: x <> '') AS plain,
 list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_stripped('x')}), lambda x: starts_with(x, '-')), lambda x: {_stripped("regexp_replace(x, '^-+', '')")}), lambda x: x <> '') AS own FROM d)
SELECT doc_id, md5(array_to_string(listed, '|')) AS listed, md5(array_to_string(CASE WHEN len(own) > 0 THEN own ELSE plain END, '|')) AS plain FROM a""")
def claims(t):
    """Claims of whole texts, led by a dash or not."""
    listed = F.concat(F.lit("- "), F.coalesce("lang", F.lit("none")), F.lit("\n"), F.col("text"))
    digest = lambda c: F.md5(F.array_join(X.claims(c), "|"))
    return t["documents"].select("doc_id", digest(listed).alias("listed"), digest(F.col("text")).alias("plain"))


@query(rf"""SELECT doc_id, md5({_stripped(r"regexp_extract(text, '([^.!?\[\]]*[.!?]?)\s*$', 1)")}) AS sentence, CAST(doc_id AS VARCHAR) || ',x' AS ids FROM documents WHERE text IS NOT NULL""")
def cited_sentences(t):
    """The last sentence of every text with the two citations after it."""
    said = F.concat(F.col("text"), F.lit(" [REF:"), F.col("doc_id").cast("string"), F.lit("] [REF:x]"))
    found = t["documents"].where("text is not null").select("doc_id", F.element_at(X.cited_sentences(said), -1).alias("s"))
    return found.select("doc_id", F.md5("s.sentence").alias("sentence"), F.array_join("s.ids", ",").alias("ids"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN '[Meeting context: a] ' || text ELSE '[Meeting context: a, b c] ' || text END AS asked FROM benchmark")
def scoped_queries(t):
    none = F.array().cast("array<string>")
    meetings = F.when(F.col("item_id") % 3 == 0, none).when(F.col("item_id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b c")))
    return t["benchmark"].select("item_id", X.effective_query("text", meetings).alias("asked"))


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'x' ELSE '' END AS shown, md5({_stripped('text')}) AS body, CASE doc_id % 3 WHEN 0 THEN 'a,b' ELSE '' END AS items FROM documents")
def cleaned_values(t):
    """Placeholders emptied, header lines taken off whole texts, lists parsed."""
    header = F.lit("[SOURCE: v, START: 1.0, END: 2.0, ID: i]\n")
    return t["documents"].select(
        "doc_id", X.clean_placeholder(_one_of("doc_id", "string or null", " NULL ", "None", " x ")).alias("shown"), F.md5(X.without_headers(F.concat(header, F.col("text")))).alias("body"),
        F.array_join(X.string_list(_one_of("doc_id", '["a", "b"]', "no list", None)), ",").alias("items"),
    )


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'API usage limit reached. Please try again later.' WHEN 1 THEN 'Cannot connect to server. Please check if the backend is running.'
 WHEN 2 THEN 'Request timed out. Please try again.' WHEN 3 THEN 'Server error. Please try again later.' WHEN 4 THEN 'An unknown error occurred. Please try again.' ELSE 'Failed to generate a response. Please try again.' END AS shown FROM documents""")
def error_messages(t):
    return t["documents"].select("doc_id", X.friendly_error(_one_of("doc_id", "Error 429", "NetworkError when fetching", "Timed out", "status 503", None, "odd")).alias("shown"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, coalesce(lang, 'Untitled Slide') || CASE WHEN source IS NULL THEN '' ELSE chr(10) || source END AS ocr_text,
 CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'UDP' END AS chart_description, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '(?i)\\b(?:QUIC|TCP|UDP|HTTP|TLS)\\b'), CASE doc_id % 3 WHEN 2 THEN ['UDP'] ELSE [] END))), ',') AS protocols FROM s""")
def slide_records(t):
    """Documents as analysed slides, made into records."""
    slides = t["documents"].select(
        "doc_id", F.col("source").alias("video_name"), F.col("lang").alias("title"), F.array_compact(F.array("source")).alias("content"), _one_of("doc_id", "null", None, "UDP").alias("chart_data"),
        F.col("doc_id").cast("double").alias("start_time"), (F.col("doc_id") + 1.0).alias("end_time"), F.col("text").alias("transcript"),
    )
    out = timeline.slide_records(slides)
    return out.select(F.col("start_time").cast("long").alias("doc_id"), "id", "ocr_text", "chart_description", F.array_join("extracted_entities.protocols_mentioned", ",").alias("protocols"))


# --- links, meetings, counts ----------------------------------------------------------------------------------------


def _links(t: Tables) -> DataFrame:
    """A link for each nation, taken as a meeting."""
    n = F.col("n_nationkey")
    return t["nation"].select(F.concat(F.lit("src"), n.cast("string")).alias("meet"), F.concat(F.lit("https://www.youtube.com/watch?v=v"), (n % 15).cast("string")).alias("link"), n.alias("ord"))


@query("SELECT doc_id, CASE WHEN n_nationkey IS NULL THEN '' ELSE 'https://www.youtube.com/watch?v=v' || CAST(n_nationkey % 15 AS VARCHAR) END AS video_url FROM documents LEFT JOIN nation ON source = 'src' || CAST(n_nationkey AS VARCHAR)")
def video_links(t):
    rows = t["documents"].select("doc_id", F.concat(F.lit("[Meeting: m] "), F.coalesce("source", F.lit("")), F.lit(".mp4")).alias("source_video"))
    return answers.with_urls(rows, _links(t)).select("doc_id", "video_url")


@query("""WITH m AS (SELECT n_nationkey % 15 AS v, min('src' || CAST(n_nationkey AS VARCHAR)) AS meeting FROM nation GROUP BY 1)
SELECT s_suppkey, meeting, s_suppkey % 20 = 7 AS same FROM supplier LEFT JOIN m ON v = s_suppkey % 20""")
def tab_meetings(t):
    """The meeting that a browser's tab shows, and whether it shows one given video."""
    tabs = t["supplier"].select("s_suppkey", F.concat(F.lit("https://youtu.be/v"), (F.col("s_suppkey") % 20).cast("string")).alias("url"))
    return answers.tab_meetings(tabs, _links(t)).select("s_suppkey", "meeting", X.same_video("url", F.lit("https://m.youtube.com/live/v7")).alias("same"))


@query("SELECT DISTINCT 'src' || CAST(c_nationkey AS VARCHAR) AS meeting FROM customer WHERE c_nationkey IS NOT NULL AND 'src' || CAST(c_nationkey AS VARCHAR) NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def missing_meetings(t):
    wanted = t["customer"].where("c_nationkey is not null").select(F.concat(F.lit("src"), F.col("c_nationkey").cast("string")).alias("meeting"))
    return views.missing_meetings(wanted, t["documents"].select(F.col("source").alias("meeting")))


@query("SELECT count(*) AS read, count(source) AS written, count(*) - count(source) AS skipped, count(*) FILTER (lang = 'fr') AS with_image FROM documents")
def record_counts(t):
    """What an export takes and leaves, and how many records have an image."""
    rows = t["documents"].select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("video_name"), F.when(F.col("lang") == "fr", "a.jpg").otherwise("").alias("slide_image"))
    return sinks.record_counts(rows).join(F.broadcast(views.image_matches(rows)))


@query("SELECT event_type, CAST(sum(event_id % 100 + user_id % 10) AS BIGINT) AS tokens FROM events GROUP BY 1")
def token_usage(t):
    used = t["events"].select("event_type", (F.col("event_id") % 100).alias("prompt_tokens"), (F.col("user_id") % 10).alias("completion_tokens"))
    return views.token_usage(used, "event_type")


@query(f"WITH {ASKED} SELECT item_id AS query_id, item_id % 2 = 1 AND item_id NOT IN (SELECT query_id FROM seeds) AS is_fallback FROM benchmark")
def without_evidence(t):
    chunks = t.questions().where("query_id % 2 = 0")
    return answers.without_evidence(t.questions(), chunks, t.seeds())


@query("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def categorical_profile(t):
    docs = t["documents"]
    return views.categorical_profile(docs, "lang").unionByName(views.categorical_profile(docs.withColumn("id", F.col("doc_id").cast("string")), "id"))


@query("SELECT 'n_chars' AS metric, round(avg(n_chars), 4) AS average FROM documents UNION ALL SELECT 'doc_id', round(avg(doc_id), 4) FROM documents")
def numeric_means(t):
    return views.numeric_means(t["documents"])


# --- evidence and evaluation ----------------------------------------------------------------------------------------


@query(f"""WITH {_TOP} SELECT query_id, 'References:' || chr(10) || string_agg('  [' || CAST(place AS VARCHAR) || '] ' || video || '  ' || printf('%.1f', vec_id::DOUBLE) || 's-' || printf('%.1f', vec_id + 1.0::DOUBLE) || 's', chr(10) ORDER BY place) AS "references"
FROM (SELECT query_id, vec_id, video, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM best WHERE place <= 3) GROUP BY query_id""")
def reference_lists(t):
    chunks = saved(_chunks(t), "chunks")
    said = answers.extractive_answers(chunks.select("query_id").distinct(), chunks)
    return answers.reference_list(answers.resolved_citations(said, chunks))


@query(f"""WITH {_CASES} SELECT CAST(doc_id AS VARCHAR) AS case_id, round(max(score) FILTER (metric = 'answer_relevance'), 4) AS answer_relevance, round(max(score) FILTER (metric = 'citation_accuracy'), 4) AS citation_accuracy,
 round(max(score) FILTER (metric = 'context_precision'), 4) AS context_precision, round(max(score) FILTER (metric = 'context_recall'), 4) AS context_recall, round(max(score) FILTER (metric = 'faithfulness'), 4) AS faithfulness FROM long GROUP BY doc_id""")
def eval_table(t):
    return evaluate.summary_table(evaluate.scores(_cases(t)))


@query("SELECT CAST(doc_id AS VARCHAR) AS case_id, md5('What is the ' || text) AS user_input, CASE WHEN lang = 'en' THEN [text] ELSE [] END AS contexts, CASE WHEN source = 'src1' THEN NULL ELSE source END AS reference FROM documents WHERE doc_id % 11 <> 0")
def eval_samples(t):
    """Cases as an outer evaluation reads them."""
    own = F.when(F.col("lang") == "en", F.array("text"))
    extra = t["documents"].select(F.col("doc_id").cast("string").alias("case_id"), own.alias("contexts"), F.when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("expected_answer"))
    out = evaluate.samples(_cases(t).join(extra, "case_id"))
    return out.select("case_id", F.md5("user_input").alias("user_input"), F.col("retrieved_contexts").alias("contexts"), "reference")


@query("SELECT substr(md5('doc:' || CAST(doc_id AS VARCHAR)), 1, 16) AS id FROM documents WHERE length(text) > 100 AND contains(coalesce(source, 'unknown') || '.mp4', 'src1')")
def testset_units(t):
    return evaluate.testset_units(t.units(), "src1").select("id")


@query("SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.5 WHEN 2 THEN 0 ELSE 1 END + CASE lang WHEN 'en' THEN 1 ELSE 0 END) / 2::DOUBLE AS score FROM documents")
def claim_means(t):
    """The mean of a judge's replies, one for each claim."""
    replies = t["documents"].select("doc_id", F.explode(F.array(_one_of("doc_id", "YES", "Partial", "no", "well, yes"), F.when(F.col("lang") == "en", "YES: so it is").otherwise("NO"))).alias("reply"))
    return evaluate.judged_means(replies, "doc_id")
