"""The three flows end to end: build an index, answer a batch of questions, score answers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import backends
from tessera.functions import text as X
from tessera.functions.prompts import prompt
from tessera.operators import answer, chunk, communities, evaluate, extract, graph, linked, numbered, organize, resolve, search, vectors
from tessera.sources import readers, scratch, sinks
from tessera.sources.readers import Settings
from tessera.sources.scratch import SENT_ROWS, once, saved
from tessera.sources.shipping import ship


@dataclass
class Index:
    """Tables of an index. What may grow without bound for one entity, relationship or community stands in long tables:
    ``mentions`` and ``relationship_mentions`` (key, id, text_unit_id) and ``members`` (community id, level, entity key).
    ``links`` is the graph in packed blocks, between the numbers in ``nodes`` (key, node, stands, community, id); an older
    index has neither, and is searched by its relationships."""

    units: DataFrame
    entities: DataFrame
    relationships: DataFrame
    communities: DataFrame
    mentions: DataFrame
    relationship_mentions: DataFrame
    members: DataFrame
    unit_vectors: DataFrame
    community_vectors: DataFrame
    entity_vectors: DataFrame
    links: DataFrame | None = None
    nodes: DataFrame | None = None


def build_index(records: DataFrame, options: Settings | None = None, method: str = "louvain", report: backends.Complete | None = None) -> Index:
    """Records (with ``ord``) to text units, entities, relationships, communities and vectors. Texts, entities, the graph in
    packed blocks, communities and vectors are written once; ``units``, ``mentions``, ``members``, ``relationships`` and
    ``relationship_mentions`` are plans over these, as a row for each relationship takes several times the text.
    Communities are Louvain's, or those of label propagation in components too large for a task; ``method`` may name
    "components" or "labels" for all. ``report`` is a model that names and sums up communities."""
    ship(records.sparkSession)
    o = options or Settings()
    plain = chunk.text_units(sinks.texts_apart(records).select("source_file", "body", "source_video", "start_time", "end_time", "slide_image"), o.chunk_size, o.overlap)
    # what stands before the raw text in the text to embed is kept, and not the text twice
    lead = F.expr("left(text, length(text) - length(raw_text))").alias("lead")
    stored = saved(plain.select(*(c for c in plain.columns if c != "text"), lead, resolve.keyed(extract.rule_names()).alias("found")), "units", "zstd")
    ids = F.array_sort(F.transform(resolve.found_keys(), lambda k: X.md5_id(k, 12)))
    units = stored.select(*(c for c in plain.columns if c != "text"), F.concat("lead", "raw_text").alias("text"), F.struct("source_file", "i").alias("ord"), ids.alias("entity_ids"))
    entities = saved(resolve.entity_rows_of_units(stored.select(F.struct("source_file", "i").alias("ord"), "found")), "entities", "zstd")
    named = stored.select(F.explode(resolve.found_keys()).alias("key"), F.col("id").alias("text_unit_id"))
    mentions = named.withColumn("id", X.md5_id(F.col("key"), 12))
    related = extract.rule_relationships(units)
    relationships = resolve.relationship_rows(related, entities)
    held = resolve.relationship_mentions(related).join(relationships.select("key"), "key", "left_semi").select("key", "id", "text_unit_id")
    links, nodes = _graph(stored, entities, method, o.resolution)
    belong = nodes.select("id", F.lit(0).alias("level"), "key")
    groups = saved(reported(communities.described(belong, entities), report), "communities", "zstd")
    # the text that a unit's vector stands for is the unit's own, so it isn't written again
    kept = lambda kind, rows: rows.select("id", "vector") if kind == "text_units" else rows
    tables = [saved(kept(kind, vectors.vector_table(rows, kind)), "vectors", "zstd") for rows, kind in ((units, "text_units"), (groups, "communities"), (entities, "entities"))]
    return Index(units, entities, relationships, groups, mentions, held, belong, *tables, links, nodes)


def _graph(stored: DataFrame, entities: DataFrame, method: str, resolution: float) -> tuple[DataFrame, DataFrame]:
    """``links`` and ``nodes`` of an index. A node is an entity's number, in order of the keys; a name of several types stands for
    the entity that came first. A community's number is that of its smallest member, and its id a digest of that one's key."""
    known = numbered.numbers(entities, "key")
    size = known.nodes
    number = known.select(F.col("node").alias("key"), F.col("id").alias("node"))
    firsts = saved(entities.groupBy("canonical").agg(F.min_by("key", "ord").alias("first"), F.collect_list("key").alias("keys")), "firsts", "zstd")
    names = saved(firsts.join(number.withColumnRenamed("key", "first"), "first").select(F.col("canonical").alias("node"), F.col("node").alias("id")), "names", "zstd")
    concepts = F.transform(F.filter("found", lambda e: e["type"] == "CONCEPT"), lambda e: e["canonical"])
    rows = stored.select(F.monotonically_increasing_id().alias("row"), concepts.alias("all")).select("row", F.posexplode("all").alias("at", "id"))
    rows = numbered.looked_up(rows, names, ["id"])
    if not numbered.fits(names):
        rows = rows.repartition("row")
    links = linked.links(rows, extract.WITHIN, size, stored.agg(F.sum(F.size("found"))).first()[0] or 0)
    found = {"components": linked.components, "labels": linked.label_propagation, "louvain": lambda t, n: linked.louvain_or_labels(t, n, resolution)}[method](links, size)
    least = np.full(size, size, np.int32)
    np.minimum.at(least, found, np.arange(size, dtype=np.int32))
    community = least[found]
    heads = number.join(F.broadcast(_ints(number, node=np.unique(community))), "node").select(F.col("node").alias("community"), X.md5_id(F.col("key"), 8).alias("id"))
    heads = saved(heads, "heads", "zstd")
    for r in heads.groupBy("id").agg(F.collect_list("community").alias("all")).where(F.size("all") > 1).collect():
        community[np.isin(community, r["all"])] = min(r["all"])  # communities of equal ids are one
    others = firsts.where(F.size("keys") > 1).select("first", F.explode("keys").alias("key")).where("key <> first")
    others = others.join(number, "key").select("node", "first").join(number.select(F.col("key").alias("first"), F.col("node").alias("stands")), "first").select("node", "stands").toArrow()
    stands = np.arange(size, dtype=np.int32)
    stands[others["node"].to_numpy()] = others["stands"].to_numpy()
    sent = number.sparkSession.sparkContext.broadcast((stands, community))

    def run(frames):
        for b in frames:
            node = b.column("node").to_numpy()
            yield pa.record_batch({"key": b.column("key"), "node": b.column("node"), "stands": sent.value[0][node], "community": sent.value[1][node]})

    all_ = number.mapInArrow(run, "key string, node int, stands int, community int")
    return links, saved(all_.join(scratch.sent(heads), "community").select("key", "node", "stands", "community", "id"), "nodes", "zstd")


def _ints(like: DataFrame, **column: np.ndarray) -> DataFrame:
    """A table of one column of whole numbers."""
    return like.sparkSession.createDataFrame(pa.table({c: pa.array(v, pa.int32()) for c, v in column.items()}))


def similar_entities(index: Index, questions: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, score, rank, name, type): the entities nearest to each question (query_id, query) by vector."""
    asked = questions.withColumn("vector", vectors.hashed_embedding(F.col("query")))
    found = vectors.top_k_batched(index.entity_vectors, asked, k, "id", "query_id", "vector")
    return found.join(index.entities.select("id", "name", "type"), "id")


def neighbours_of(index: Index, questions: DataFrame, hops: int = 1, most: int = 10) -> dict[str, DataFrame]:
    """Entities that each question (query_id, name: one row a name asked for) starts from, their best neighbours in the
    graph, and the relationships among both."""
    seeds = saved(search.match_seeds(questions, index.entities), "seeds")
    relationships = once(index.relationships, "relationships")
    near = saved(search.neighbours(seeds, graph.adjacency(relationships), hops, most), "near")
    return {"seeds": seeds, "neighbours": near, "relationships": search.seed_relationships(seeds, near, relationships)}


def classified(questions: DataFrame, complete: backends.Complete | None = None) -> DataFrame:
    """``questions`` with query_type, by a model where there is one; where it fails or says something else, by rule."""
    if complete is None:
        return questions.withColumn("query_type", X.classify_query("query"))
    told = backends.replies(questions, prompt("classify", query=F.col("query")), complete)
    said = F.lower(X.strip_ws("reply"))
    by_rule = X.classify_query("query")
    return told.withColumn("query_type", F.when(said.isin("local", "global"), said).otherwise(by_rule)).drop("reply", "reply_error")


def reported(groups: DataFrame, complete: backends.Complete | None = None) -> DataFrame:
    """Communities with title and summary, by a model where there is one; by template where it fails or isn't read."""
    plain = communities.reports(groups)
    if complete is None:
        return plain
    told = backends.replies(plain, prompt("report", members=F.col("report_input")), complete, back_off=1.0)
    read = X.repaired_json("reply", "title string, summary string")
    own = lambda c: F.coalesce(X.blank_to_null(read[c]), F.col(c))
    return told.withColumns({"title": own("title"), "summary": own("summary")}).drop("reply", "reply_error")


def answered(questions: DataFrame, chunks: DataFrame, prompts: DataFrame, complete: backends.Complete | None = None) -> DataFrame:
    """(query_id, answer, is_fallback): from a model that reads each question's prompt, or extracted where there is none. A
    question without evidence gets the fallback text and isn't asked; a model that fails ends the job."""
    plain = answer.extractive_answers(questions, chunks)
    if complete is None:
        return plain
    asked = prompts.join(questions.select("query_id", "query"), "query_id")
    told = backends.replies(asked.select("query_id", "query", "prompt"), prompt("answer", context=F.col("prompt"), query=F.col("query")), complete)
    failed = F.when(F.col("reply_error").isNotNull(), F.raise_error(F.concat(F.lit("no answer: "), F.col("reply_error"))).cast("string"))
    said = told.select("query_id", F.coalesce(failed, X.normal_citations("reply")).alias("said"))
    return plain.join(said, "query_id", "left").select("query_id", F.when(F.col("is_fallback"), F.col("answer")).otherwise(F.col("said")).alias("answer"), "is_fallback")


def save_index(index: Index, folder: str) -> None:
    """The index's tables in a folder, with a row of counts, to be asked in a later session."""
    meta = resolve.index_meta(index.units, index.entities, index.relationships, index.communities)
    sinks.save_index(folder, **vars(index), meta=meta)


def load_index(spark: SparkSession, folder: str) -> Index:
    tables = readers.load_index(spark, folder)
    tables.pop("meta", None)
    return Index(**tables)


def _evidence(index: Index, ranked: DataFrame) -> DataFrame:
    """(id, entities, source_refs): members and sources of the communities found, as a chunk lists them; of no other."""
    belong = saved(index.members.join(ranked.select("id").distinct(), "id", "left_semi").select("id", "key"), "found_members")
    # where members fit in memory they go to the mentions, and a unit's are made one where they are read
    length = belong.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    belong = F.broadcast(belong) if length <= numbered.BROADCAST_BYTES else belong
    e = F.struct("key", "name", "type", "description").alias("e")
    who = belong.join(index.entities.select("key", e), "key").groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    plain = F.transform("es", lambda x: F.struct(x["name"].alias("name"), x.type.alias("type"), x.description.alias("description")))
    tu = index.mentions.select("key", F.col("text_unit_id").alias("tu")).join(belong, "key").select("id", "tu").distinct()
    places = index.units.select(F.col("id").alias("tu"), "source_video", "start_time", "end_time")
    ref = F.struct(F.col("tu").alias("text_unit_id"), "source_video", "start_time", "end_time")
    where = tu.join(places, "tu").groupBy("id").agg(F.array_sort(F.collect_list(ref)).alias("source_refs"))
    return who.select("id", plain.alias("entities")).join(where, "id", "left")


def ask(index: Index, questions: DataFrame, options: Settings | None = None, meetings: list[str] = (), classify: backends.Complete | None = None, complete: backends.Complete | None = None) -> dict[str, DataFrame]:
    """Answers of a batch of ``questions`` (query_id, query): classified, searched, organised, answered and cited. Models
    that classify and answer are plugged in; without them both are by rule."""
    ship(questions.sparkSession)
    o = options or Settings()
    rows = classified(questions, classify)
    rows = (rows if classify is None else saved(rows, "classified")).withColumn("vector", vectors.hashed_embedding(F.col("query")))
    k = 2 * o.top_k if meetings else o.top_k
    local, wide = rows.where("query_type = 'local'"), rows.where("query_type = 'global'")
    found = saved(vectors.top_k_batched(index.unit_vectors, local, k, "id", "query_id", "vector"), "found")
    # the units found go to all tasks where they are few, so that texts and mentions of others stay where they lie
    near = F.broadcast if found.count() <= SENT_ROWS else lambda df: df
    hits = saved(index.units.select("id", "text", "source_video", "start_time", "end_time").join(near(found), "id"), "hits", "zstd")
    named = saved(index.mentions.join(near(found.select(F.col("id").alias("text_unit_id")).distinct()), "text_unit_id", "left_semi"), "named", "zstd")
    hits = search.in_meetings(search.related_entities(hits, index.entities, mentions=named), list(meetings))
    pool = vectors.top_k_batched(index.community_vectors, wide, 2 * o.top_k, "id", "query_id", "vector")
    if index.links is not None and o.hops == 1:
        ranked = saved(search.global_search_by_links(pool, index.nodes, index.links, o.top_k), "ranked")
    else:
        ranked = saved(search.global_search(pool, index.members, graph.adjacency(index.relationships), o.top_k, o.hops), "ranked")
    groups = ranked.join(index.communities.select("id", "title", "summary"), "id").join(_evidence(index, ranked), "id", "left")
    groups = search.any_in_meetings(groups, list(meetings))
    chunks = organize.unit_chunks(hits).unionByName(organize.community_chunks(groups))
    chunks = saved(organize.organize(chunks, o.cutoff, o.dedup, o.max_chunks), "chunks")
    prompts = organize.prompt_text(chunks, organize.consolidated_entities(chunks))
    answers = saved(answered(rows, chunks, prompts, complete), "answers")
    cited = answer.resolved_citations(answers, chunks)
    return {"chunks": chunks, "answers": answers, "citations": cited, "responses": answer.response(rows, answers, cited), "prompts": prompts, "references": organize.consolidated_refs(chunks)}


def score_answers(cases: DataFrame) -> dict[str, DataFrame]:
    long = saved(evaluate.scores(cases), "scores")
    by_case = evaluate.case_scores(long)
    return {"scores": long, "cases": by_case, "metrics": evaluate.metric_summary(long), "by_type": evaluate.by_group(by_case, "query_type"), "report": evaluate.report(by_case)}
