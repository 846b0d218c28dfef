"""Sets of test cases: written by hand or asked of a model, numbered, and checked as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import backends
from tessera.functions import text as X
from tessera.functions.prompts import prompt
from tessera.operators.evaluate import ALLOWED, REQUIRED
from tessera.operators.timeline import numbered

REPLY = "questions array<struct<question:string,expected_answer:string,query_type:string,difficulty:string,key_entities:array<string>>>"

#: What a set says of itself, and the fields of a case that are lists.
REQUIRED_METADATA = ["version", "created_at", "source_videos", "description"]
LISTS = ["expected_chunks", "relevant_source_videos", "ground_truth_entities", "tags"]
FIELDS = ["id", "query", "query_type", "expected_answer", *LISTS, "difficulty", "notes"]


def _filled(rows: DataFrame) -> DataFrame:
    """The fields of a case in order, with their defaults where ``rows`` has none."""
    defaults = {"query_type": F.lit("auto"), "difficulty": F.lit("medium"), "notes": F.lit("")} | {c: F.array().cast("array<string>") for c in LISTS}
    value = lambda c: F.coalesce(F.col(c), defaults[c]) if c in rows.columns and c in defaults else F.col(c) if c in rows.columns else defaults[c]
    return rows.select(*(value(c).alias(c) for c in FIELDS))


def added(rows: DataFrame, *order: str, since: int = 0) -> DataFrame:
    """``rows`` (query, expected_answer, other fields of a case if any) as cases case_0001 and on in order, after those of a
    set that has ``since`` already."""
    return _filled(numbered(rows, *order, name="__n").withColumn("id", F.format_string("case_%04d", F.col("__n") + since)))


def generated(units: DataFrame, complete: backends.Complete, per_unit: int = 2, since: int = 0) -> DataFrame:
    """Cases that a model writes about text units (id, raw_text, source_video), ``per_unit`` each: auto_<first eight of the
    unit's id>_<number in the set>. Units without a reply that reads as JSON give none."""
    told = backends.replies(units.select("id", "raw_text", "source_video"), prompt("questions", n=F.lit(per_unit), text=F.col("raw_text")), complete)
    each = told.select("id", "source_video", F.posexplode(F.slice(X.repaired_json("reply", REPLY)["questions"], 1, per_unit)).alias("at", "q"))
    rows = numbered(each.select(F.col("id").alias("unit"), "source_video", "at", "q"), "unit", "at", name="__n")
    video = F.coalesce("source_video", F.lit(""))
    return _filled(rows.select(
        F.format_string("auto_%s_%03d", F.substring("unit", 1, 8), F.col("__n") + since).alias("id"), F.coalesce("q.question", F.lit("")).alias("query"), F.coalesce("q.query_type", F.lit("local")).alias("query_type"),
        F.coalesce("q.expected_answer", F.lit("")).alias("expected_answer"), F.when(video != "", F.array(video)).alias("relevant_source_videos"), F.col("q.key_entities").alias("ground_truth_entities"),
        F.array(F.lit("auto-generated")).alias("tags"), F.col("q.difficulty").alias("difficulty"), F.concat(F.lit("generated from text_unit "), F.col("unit")).alias("notes"),
    ))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: what a file of cases says of itself."""
    kind = "metadata struct<version:string,created_at:string,source_videos:array<string>,description:string>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select("metadata.*")


def file_errors(spark: SparkSession, path: str) -> DataFrame:
    """(place, error) for each rule that a file of cases breaks: its own form, and each case's fields, values, lists and id.
    ``place`` is the case's number from 0, -1 for the file."""
    files = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return text_errors(files)


def text_errors(files: DataFrame) -> DataFrame:
    """:func:`file_errors` of parsed files (v)."""
    at = lambda v, p: F.try_variant_get(v, p, "variant")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    whole = files.select("v", kind(F.col("v")).alias("kind")).withColumn("object", F.col("kind").startswith("OBJECT"))
    meta, cases = at(F.col("v"), "$.metadata"), at(F.col("v"), "$.test_cases")
    listed = kind(cases).startswith("ARRAY")
    own = whole.select(F.array_compact(F.array(
        F.when(F.col("v").isNull(), "not JSON"), F.when(F.col("v").isNotNull() & ~F.col("object"), "not an object"),
        F.when(F.col("object") & ~kind(meta).startswith("OBJECT"), "no metadata"),
        *(F.when(F.col("object") & kind(meta).startswith("OBJECT") & at(meta, f"$.{c}").isNull(), f"metadata without {c}") for c in REQUIRED_METADATA),
        F.when(F.col("object") & ~listed, "no list test_cases"), F.when(F.col("object") & listed & at(cases, "$[0]").isNull(), "no test cases"),
    )).alias("errors")).select(F.lit(-1).alias("place"), F.explode("errors").alias("error"))
    rows = whole.where(F.col("object") & listed).select(F.posexplode(F.try_variant_get(cases, "$", "array<variant>")).alias("place", "c"))
    rows = rows.withColumn("object", kind(F.col("c")).startswith("OBJECT"))
    text = lambda c: F.try_variant_get("c", f"$.{c}", "string")
    given = lambda c: F.coalesce(text(c), F.lit("")) != ""
    broken: list[Column] = [F.when(~F.col("object"), "not an object")]
    broken += [F.when(F.col("object") & at(F.col("c"), f"$.{f}").isNull(), f"missing {f}") for f in REQUIRED]
    broken += [F.when(given(f) & ~text(f).isin(v), F.concat(F.lit(f"invalid {f}: "), text(f))) for f, v in ALLOWED.items()]
    broken += [F.when(at(F.col("c"), f"$.{f}").isNotNull() & ~kind(at(F.col("c"), f"$.{f}")).startswith("ARRAY") & (kind(at(F.col("c"), f"$.{f}")) != "VOID"), f"{f} is no list") for f in LISTS]
    each = rows.select("place", F.explode(F.array_compact(F.array(*broken))).alias("error"))
    ids = rows.select("place", text("id").alias("id")).where("id <> ''")
    first = ids.groupBy("id").agg(F.min("place").alias("first"))
    again = ids.join(first, "id").where("place > first").select("place", F.concat(F.lit("repeated id: "), F.col("id")).alias("error"))
    return own.unionByName(each).unionByName(again)
