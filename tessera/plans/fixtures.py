"""The driver's tables read as the notions of a meeting index, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import extract, numbered, resolve
from tessera.sources.scratch import saved


class Tables:
    """Tables of a folder, and what is derived from them. Each is a plan, read when it is used; what several steps of a
    query read is written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._names: DataFrame | None = None
        self._entities: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def records(self) -> DataFrame:
        start = F.floor(F.col("doc_id") / 20) * F.lit(60.0)
        return self["documents"].select(
            F.col("doc_id").cast("string").alias("id"), F.concat(F.coalesce("source", F.lit("unknown")), F.lit(".mp4")).alias("video_name"), start.alias("start_time"),
            F.round(start + F.length("text") / 15.0, 2).alias("end_time"), F.split("text", "\n")[0].alias("ocr_text"), F.lit(None).cast("string").alias("chart_description"),
            F.col("text").alias("transcript"), F.lit("").alias("slide_image"), F.col("doc_id").alias("ord"),
        )

    def speech(self) -> DataFrame:
        start = F.col("conv_id") * 7.0 + F.col("turn") * 11.0
        return self["conversations"].select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"), F.lit(".mp4")).alias("video_name"), start.alias("start"), (start + F.length("text") / 15.0).alias("end"), "text", "conv_id", "turn")

    def units(self) -> DataFrame:
        return self["documents"].select(F.substring(F.md5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))), 1, 16).alias("id"), F.col("text").alias("raw_text"), F.concat(F.coalesce("source", F.lit("unknown")), F.lit(".mp4")).alias("source_video"), F.col("doc_id").alias("ord"))

    def names(self) -> DataFrame:
        """(unit, doc_id, at, name): different capitalised words of a document in order."""
        if self._names is None:
            found = self.units().select(F.col("id").alias("unit"), F.col("ord").alias("doc_id"), F.posexplode(extract.names(F.col("raw_text"))).alias("at", "name"))
            self._names = saved(found, "names")
        return self._names

    def _found(self) -> DataFrame:
        return self.names().select("name", F.lit("concept").alias("type"), F.lit("").alias("description"), F.col("unit").alias("text_unit_id"), F.struct("doc_id", "at").alias("ord"))

    def entities(self) -> DataFrame:
        if self._entities is None:
            self._entities = saved(resolve.entity_rows(self._found()), "entities")
        return self._entities

    def mentions(self) -> DataFrame:
        return resolve.entity_mentions(self._found())

    def relationships(self) -> DataFrame:
        return extract.rule_relationships(self.units())

    def edges(self) -> DataFrame:
        """(source, target, weight): co-mentions by name, parallel ones summed."""
        rows = self.relationships().select(F.lower("source").alias("source"), F.lower("target").alias("target"), "weight")
        return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight"))

    def numbered(self, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(node, id) of all names and those of ``more`` (node), and :meth:`edges` between their numbers."""
        rows = self.units().select(F.monotonically_increasing_id().alias("row"), extract.names(F.col("raw_text")).alias("all"))
        found = saved(rows.select("row", F.posexplode("all").alias("at", "name")).select("row", "at", F.lower("name").alias("id")), "mentions")
        names = found.select(F.col("id").alias("node")).distinct()
        known = numbered.numbers(names if more is None else names.unionByName(more.select("node")))
        return known, saved(numbered.co_mentions(numbered.looked_up(found, known, ["id"]), extract.WITHIN), "edges")

    def communities(self) -> DataFrame:
        """Names by first letter, a row for each member."""
        return self.entities().select(F.substring("key", 1, 1).alias("id"), F.lit(0).alias("level"), "key")

    def questions(self) -> DataFrame:
        return self["benchmark"].select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def asked(self) -> DataFrame:
        """(query_id, at, name): the names of each question."""
        return self.questions().select("query_id", F.posexplode(extract.names(F.col("query"))).alias("at", "name"))

    def seeds(self) -> DataFrame:
        return self.asked().select("query_id", F.lower("name").alias("node"))


RECORDS = """records AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, 'unknown') || '.mp4' AS video_name, floor(doc_id / 20) * 60.0::DOUBLE AS start_time,
 round(floor(doc_id / 20) * 60.0::DOUBLE + length(text) / 15.0::DOUBLE, 2) AS end_time, split_part(text, chr(10), 1) AS ocr_text, text AS transcript, doc_id AS ord FROM documents)"""
SPEECH = """speech AS (SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) || '.mp4' AS video_name, conv_id * 7.0::DOUBLE + turn * 11.0::DOUBLE AS "start",
 conv_id * 7.0::DOUBLE + turn * 11.0::DOUBLE + length(text) / 15.0::DOUBLE AS "end", text, conv_id, turn FROM conversations)"""
NAMES = r"""raw_names AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}')) AS name, generate_subscripts(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'), 1) AS p FROM documents),
names AS (SELECT doc_id, substr(md5('doc:' || CAST(doc_id AS VARCHAR)), 1, 16) AS unit, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) AS idx FROM raw_names GROUP BY doc_id, name)"""
ENTITIES = NAMES + """,
entities AS (SELECT lower(name) AS canonical, arg_min(name, (doc_id, idx)) AS name, count(DISTINCT unit) AS units, min((doc_id, idx)) AS ord FROM names GROUP BY lower(name))"""
PAIRS = NAMES + """,
pairs AS (SELECT a.doc_id, a.unit, a.name AS source, b.name AS target, a.idx AS i, b.idx AS j FROM names a JOIN names b ON a.doc_id = b.doc_id AND a.idx < b.idx AND b.idx <= a.idx + 8),
edges AS (SELECT lower(source) AS source, lower(target) AS target, CAST(count(*) AS DOUBLE) AS weight FROM pairs GROUP BY 1, 2),
adjacent AS (SELECT source AS node, target AS neighbour, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"""
ASKED = r"""raw_asked AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}')) AS name, generate_subscripts(regexp_extract_all(text, '\p{Lu}\p{Ll}{3,}'), 1) AS p FROM benchmark),
asked AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) AS idx FROM raw_asked GROUP BY query_id, name),
seeds AS (SELECT DISTINCT query_id, lower(name) AS node FROM asked)"""
HOP1 = PAIRS + ", " + ASKED + """,
most AS (SELECT max(weight) AS m FROM adjacent),
hop1 AS (SELECT s.query_id, a.neighbour AS node, max(a.weight / m) AS score FROM seeds s JOIN adjacent a USING (node), most
 WHERE NOT EXISTS (SELECT 1 FROM seeds t WHERE t.query_id = s.query_id AND t.node = a.neighbour) GROUP BY 1, 2),
reach1 AS (SELECT query_id, node, 1.0::DOUBLE AS score FROM seeds UNION ALL SELECT * FROM hop1)"""
HITS = """hits AS (SELECT q.vec_id AS query_id, e.vec_id, round(1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits)"""
