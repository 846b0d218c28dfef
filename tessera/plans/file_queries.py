"""Named queries that write files or tables into the shared folder and read them back, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.catalog import query
from tessera.plans.fixtures import RECORDS
from tessera.plans.view_queries import _links, _stripped
from tessera.sources import readers, scratch, sinks


@query(f"""WITH {RECORDS} SELECT id, video_name, start_time, end_time, md5(transcript) AS transcript FROM records""")
def json_records(t):
    """Records as JSON lists in files, read back; rows without an id or a video are no records."""
    folder = scratch.folder(t.spark, "json")
    empty = t.records().limit(1).withColumn("id", F.lit(""))  # a row that the reader has to leave out
    sinks.save_record_lists(t.records().unionByName(empty), folder, "records")
    return readers.records(t.spark, folder).select("id", "video_name", "start_time", "end_time", F.md5("transcript").alias("transcript"))


@query("SELECT 'v.mp4' AS source_video, CAST(item_id AS DOUBLE) AS start_time, item_id + 0.5::DOUBLE AS end_time, md5(" + _stripped("text") + ") AS body FROM benchmark")
def text_files(t):
    """Benchmark passages as text files, a file each; their source is read from the header."""
    folder = scratch.folder(t.spark, "texts")
    rows = t["benchmark"].select(F.col("item_id").cast("string").alias("id"), F.lit("v.mp4").alias("video_name"), F.col("item_id").cast("double").alias("start_time"), (F.col("item_id") + 0.5).alias("end_time"), F.col("text").alias("ocr_text"), F.lit("").alias("chart_description"), F.lit("").alias("transcript"), F.lit("").alias("slide_image"), F.col("item_id").alias("ord"))
    sinks.texts(rows).select("body").write.option("maxRecordsPerFile", 1).text(folder)
    none = t.spark.createDataFrame([], "source_file string, " + readers.SOURCE_MAP)
    read = readers.with_sources(readers.texts(t.spark, folder), none)
    return read.select("source_video", "start_time", "end_time", F.md5(X.without_headers("body")).alias("body"))


@query(f"""WITH {RECORDS} SELECT id, CASE WHEN ord % 2 = 0 THEN 'later' ELSE video_name END AS source_video, start_time, end_time FROM records""")
def source_maps(t):
    """Two maps from file to source, the later with every second file under another video; the later one wins."""
    first, second = scratch.folder(t.spark, "map"), scratch.folder(t.spark, "map")
    texts = sinks.texts(t.records())
    sinks.save_source_map(texts, first)
    sinks.save_source_map(texts.where("ord % 2 = 0").withColumn("source_video", F.lit("later")), second)
    return readers.source_map(t.spark, first, second).select("id", "source_video", "start_time", "end_time")


@query("SELECT doc_id, lang, md5(text) AS text, 'parquet' AS kind FROM documents UNION ALL SELECT doc_id, lang, md5(text), 'json' FROM documents")
def index_tables(t):
    """Tables of an index read as Parquet, as JSON where there is no Parquet, and empty where there is neither."""
    folder = scratch.folder(t.spark, "index")
    docs = t["documents"].select("doc_id", "text", "lang")
    sinks.save_index(folder, units=docs)
    sinks.save_json(docs, folder, "others")
    schema = "doc_id long, text string, lang string"
    tables = [readers.index_table(t.spark, folder, name, schema).withColumn("kind", F.lit(kind)) for name, kind in (("units", "parquet"), ("others", "json"), ("nothing", "none"))]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).select("doc_id", "lang", F.md5("text").alias("text"), "kind")


@query("SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS meet, 'https://www.youtube.com/watch?v=v' || CAST(n_nationkey % 15 AS VARCHAR) AS link FROM nation")
def link_files(t):
    folder = scratch.folder(t.spark, "links")
    one = _links(t).agg(F.to_json(F.collect_list(F.struct("meet", "link"))).alias("value"))
    one.write.text(folder)
    return readers.links(t.spark, folder).select("meet", "link")
