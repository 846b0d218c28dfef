"""Writers of texts, index tables, vectors, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.communities import member_rows
from tessera.operators.resolve import last_by, mention_rows
from tessera.sources.scratch import SENT_ROWS, saved


def record_text(unknown: str = "unknown") -> Column:
    """A record as text: its source in a header, then what is not blank of slide text, chart and transcript."""
    header = F.format_string("[SOURCE: %s, START: %s, END: %s, ID: %s]", F.coalesce("video_name", F.lit(unknown)), F.coalesce("start_time", F.lit(0.0)).cast("string"), F.coalesce("end_time", F.lit(0.0)).cast("string"), F.coalesce("id", F.lit(unknown)))
    return F.concat_ws("\n\n", header, *(X.blank_to_null(c) for c in ("ocr_text", "chart_description", "transcript")))


def _texts(records: DataFrame) -> DataFrame:
    rows = records.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("video_name", F.lit("")) != ""))
    return rows.select(X.safe_filename("video_name", "id").alias("source_file"), record_text().alias("body"), F.col("video_name").alias("source_video"), "start_time", "end_time", "id", F.coalesce("slide_image", F.lit("")).alias("slide_image"), "ord")


def texts(records: DataFrame) -> DataFrame:
    """(source_file, body, source columns) for records with an id and a video; of equal file names the last stays."""
    return last_by(_texts(records), ["source_file"], "ord")


def texts_apart(records: DataFrame) -> DataFrame:
    """:func:`texts`, of which only those whose file name is there more than once are dealt out by name: bodies of others
    stay where they are read."""
    names = records.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("video_name", F.lit("")) != ""))
    names = names.select(X.safe_filename("video_name", "id").alias("source_file"))
    often = saved(names.groupBy("source_file").agg(F.count("*").alias("n")).where("n > 1").select(F.col("source_file").alias("often")), "often")
    if not often.limit(1).count():
        return _texts(records)
    if often.count() > SENT_ROWS:
        return texts(records)
    rows = _texts(records)
    known = F.broadcast(often)
    alone = rows.join(known, rows.source_file == known.often, "left_anti")
    return alone.unionByName(last_by(rows.join(known, rows.source_file == known.often, "left_semi"), ["source_file"], "ord"))


def save_table(df: DataFrame, folder: str, name: str, force: bool = True) -> None:
    """An index table as Parquet with native lists and structs. An empty table is written too, so no older one shows."""
    df.write.mode("overwrite" if force else "ignore").option("compression", "zstd").parquet(f"{folder}/{name}")


def save_json(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").json(f"{folder}/{name}.json")


def save_index(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        if df is not None:
            save_table(df, folder, name)


def source_map_json(texts_: DataFrame) -> DataFrame:
    """(source_file, entry): entries of a map from file to source, as JSON."""
    return texts_.select("source_file", F.to_json(F.struct("source_video", "start_time", "end_time", "id", "slide_image")).alias("entry"))


def graph_edges(relationships: DataFrame) -> DataFrame:
    return relationships.select("source", "target", "rel_type", "weight", "is_directional", "description")


def property_edges(entities: DataFrame, relationships: DataFrame, communities: DataFrame, mentioned: DataFrame | None = None) -> DataFrame:
    """(kind, source, target) edges of a property graph: units mention entities, entities relate, members belong."""
    mentions = mention_rows(entities, mentioned).select(F.lit("MENTIONS").alias("kind"), F.col("text_unit_id").alias("source"), F.col("id").alias("target"))
    relate = relationships.select(F.lit("RELATED_TO").alias("kind"), "source", "target")
    belong = member_rows(communities).select(F.lit("BELONGS_TO").alias("kind"), F.col("key").alias("source"), F.col("id").alias("target"))
    return mentions.unionByName(relate).unionByName(belong)


def save_cases(rows: DataFrame, folder: str) -> None:
    """One folder of JSON a case."""
    rows.write.mode("overwrite").partitionBy("case_id").json(folder)


def save_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def save_record_lists(records: DataFrame, folder: str, name: str, per_file: int = 1000) -> None:
    """Records as files that each hold a JSON list of about ``per_file``, dealt by hash, so no video gathers in one."""
    files = -(-max(1, records.count()) // per_file)
    row = F.struct(*[c for c in records.columns if c != "ord"])
    dealt = records.groupBy(F.pmod(F.xxhash64("id", "video_name"), F.lit(files)).alias("__file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    dealt.select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/{name}.json")


def save_source_map(texts_: DataFrame, folder: str, per_file: int = 1000) -> None:
    """The map from file to source as JSON objects of about ``per_file`` entries, one a file of
    ``folder``. Files are named once, as :func:`texts` gives them."""
    files = -(-max(1, texts_.count()) // per_file)
    entry = F.struct("source_file", F.struct("source_video", "start_time", "end_time", "id", "slide_image"))
    dealt = texts_.groupBy(F.pmod(F.xxhash64("source_file"), F.lit(files)).alias("__file"))
    whole = dealt.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(folder)


def record_counts(records: DataFrame) -> DataFrame:
    """(read, written, skipped): what :func:`texts` takes of the records and what it leaves."""
    usable = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("video_name", F.lit("")) != "")
    return records.agg(F.count("*").alias("read"), F.count_if(usable).alias("written"), F.count_if(~usable).alias("skipped"))


def summary_lines(summary: DataFrame) -> list[str]:
    """A summary of one row, or of few, as lines for a console."""
    rows = summary.limit(100).collect()
    return ["  ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in row.asDict().items()) for row in rows]
