"""Scans of records, transcripts, texts, links and index tables, all with explicit schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.resolve import last_by

RECORD = "id string, video_name string, start_time double, end_time double, ocr_text string, chart_description string, transcript string, slide_image string, extracted_entities struct<documents_mentioned:array<string>,protocols_mentioned:array<string>>"
TRANSCRIPT = f"status string, meeting_metadata struct<meeting_name:string,video_name:string,video_url:string,total_slides:int>, slides array<struct<{RECORD.replace(' string', ':string').replace(' double', ':double').replace(' struct<', ':struct<').replace(', ', ',')}>>"
SOURCE_MAP = "source_video string, start_time double, end_time double, id string, slide_image string"
CASE = "id string, query string, query_type string, expected_answer string, expected_chunks array<string>, relevant_source_videos array<string>, ground_truth_entities array<string>, tags array<string>, difficulty string, notes string"
LINKS_FILE = "link.json"


def _json(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt string").options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ``*.json`` of a folder but the link file: lists or single objects. What isn't a record, or has no
    id or video, is left out; ``ord`` follows file and place."""
    rows = _json(spark, RECORD, f"{folder}/*.json").withColumn("source_file", F.col("_metadata.file_name")).where(F.col("source_file") != LINKS_FILE)
    rows = rows.where("_corrupt is null").drop("_corrupt").withColumn("ord", F.struct("source_file", F.monotonically_increasing_id().alias("at")))
    return valid_records(rows)


def valid_records(rows: DataFrame) -> DataFrame:
    return rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("video_name", F.lit("")) != ""))


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Slides of ``*/transcript.json``, with meeting_name and defaults filled in."""
    rows = _json(spark, TRANSCRIPT, f"{folder}/*/transcript.json").withColumn("source_file", F.col("_metadata.file_path"))
    slides = rows.select("source_file", "meeting_metadata.meeting_name", F.posexplode("slides").alias("at", "s")).select("source_file", "meeting_name", "at", "s.*")
    empty = {c: "" for c in ("ocr_text", "chart_description", "transcript", "slide_image")}
    return slides.fillna({**empty, "start_time": 0.0}).withColumn("ord", F.struct("source_file", "at"))


def meetings(spark: SparkSession, folder: str) -> DataFrame:
    """(meeting): folders that hold a transcript, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "transcript.json").option("recursiveFileLookup", True).load(folder).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("meeting")).distinct().orderBy("meeting")


def slide_images(spark: SparkSession, folder: str) -> DataFrame:
    """(slide, path) of ``slide_<number>_*.jpg`` files; of equal numbers the later name. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    number = F.regexp_extract("path", r"(?i)slide_(\d+)_[^/]*\.jpe?g$", 1)
    found = files.select(number.alias("digits"), "path").where("digits <> ''")
    return found.select(X.zero_filled(F.col("digits")).alias("slide"), "path").groupBy("slide").agg(F.max("path").alias("path"))


def with_images(slides: DataFrame, images: DataFrame) -> DataFrame:
    named = slides.withColumn("__slide", X.zero_filled(F.col("id")))
    return named.join(images.withColumnRenamed("slide", "__slide"), "__slide", "left").withColumn("slide_image", F.coalesce("path", F.lit(""))).drop("__slide", "path")


def all_slides(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the folder and of its transcripts, the first of each video, id and start."""
    from tessera.operators.resolve import first_by

    columns = [c.split(" ")[0] for c in RECORD.replace("extracted_entities struct", "extracted_entities s").split(", ")]
    a = records(spark, folder).select(*columns, F.concat_ws("/", "ord.source_file", F.format_string("%012d", "ord.at")).alias("ord"))
    b = transcripts(spark, folder).select(*columns, F.concat_ws("/", "ord.source_file", F.format_string("%012d", "ord.at")).alias("ord"))
    return first_by(a.unionByName(b), ["video_name", "id", "start_time"], "ord")


def links(spark: SparkSession, path: str) -> DataFrame:
    """(meet, link): the last of each meeting; a missing file is empty."""
    try:
        rows = _json(spark, "meet string, link string", path).where("meet is not null and link is not null")
    except AnalysisException:
        return spark.createDataFrame([], "meet string, link string, ord long")
    return last_by(rows.select("meet", "link", F.monotonically_increasing_id().alias("ord")), ["meet"], "ord")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, body) of all ``*.txt`` below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))


def source_map(spark: SparkSession, *paths: str) -> DataFrame:
    """(source_file, source columns) of one or more maps from file name to source; later paths win."""
    out = None
    for n, path in enumerate(paths):
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{SOURCE_MAP.replace(' ', ':').replace(',:', ',')}>>")).alias("source_file", "m"))
        rows = raw.select("source_file", "m.*", F.lit(n).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return last_by(out, ["source_file"], "ord").drop("ord")


def with_sources(texts_: DataFrame, known: DataFrame) -> DataFrame:
    """``texts`` with source_video, start_time, end_time, slide_image: from the map, else from the header in the text, else
    the file's name and zeros."""
    rows = texts_.join(known.drop("id"), "source_file", "left").withColumn("__h", X.source_header("body"))
    return rows.withColumns({
        "source_video": F.coalesce("source_video", "__h.video", "source_file"), "start_time": F.coalesce("start_time", "__h.start", F.lit(0.0)),
        "end_time": F.coalesce("end_time", "__h.end", F.lit(0.0)), "slide_image": F.coalesce("slide_image", F.lit("")),
    }).drop("__h")


def index_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of an index: Parquet, else JSON, else empty."""
    for kind in ("parquet", "json"):
        try:
            found = spark.read.schema(schema).format(kind).load(f"{folder}/{name}" + (".json" if kind == "json" else ""))
        except AnalysisException:
            continue
        return found
    return spark.createDataFrame([], schema)


#: Tables of an index that a build saves, its graph in packed blocks, and one row of counts beside them.
INDEX_TABLES = ["units", "entities", "relationships", "communities", "mentions", "relationship_mentions", "members", "unit_vectors", "community_vectors", "entity_vectors", "links", "nodes", "meta"]
#: Those that an index may do without.
OPTIONAL = {"links", "nodes", "meta"}


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an index as they were saved, by name; all but :data:`OPTIONAL` must be there."""
    out = {}
    for name in INDEX_TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            if name not in OPTIONAL:
                raise FileNotFoundError(f"no table {name} of an index in {folder}") from None
    return out


def decoded_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of lists that an older layout wrote as JSON text."""
    return df.withColumns({c: X.string_list(c) for c in columns})


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    kind = f"test_cases array<struct<{CASE.replace(', ', ',').replace(' ', ':')}>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.posexplode("test_cases").alias("ord", "c")).select("ord", "c.*")


@dataclass
class Settings:
    """Options with their defaults; :func:`settings` reads the first file there is."""

    chunk_size: int = 600
    overlap: int = 0
    top_k: int = 5
    cutoff: float = -0.5
    dedup: float = 0.8
    max_chunks: int = 5
    hops: int = 1
    max_neighbours: int = 10
    resolution: float = 1.0
    temperature: float = 0.0
    max_tokens: int = 4096
    more: dict = field(default_factory=dict)

    def __post_init__(self):
        limits = {"top_k": (1, 20), "max_chunks": (1, 10), "dedup": (0, 1), "temperature": (0, 2), "max_tokens": (64, 16384)}
        for name, (low, high) in limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


def settings(*paths: str) -> Settings:
    """Options of the first file there is, defaults without one."""
    found = _first_file(*paths)
    known = {k: v for k, v in found.items() if k in Settings.__dataclass_fields__}
    return Settings(**known, more={k: v for k, v in found.items() if k not in known})


#: Sections of a settings file with what holds where a file says nothing.
SECTIONS = {
    "llm": {"provider": "ollama", "model": "mistral"}, "embeddings": {"model": "nomic-embed-text"}, "chunking": {"size": 600, "overlap": 100}, "community": {"resolution": 1.0},
}


def sections(*paths: str, defaults: dict | None = None) -> dict:
    """Settings by section: those of the first file there is over the defaults. A section is merged key by key, one level
    deep; any other value takes the default's place."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in (SECTIONS if defaults is None else defaults).items()}
    for key, value in _first_file(*paths).items():
        out[key] = out[key] | value if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _first_file(*paths: str) -> dict:
    for path in map(Path, paths):
        if path.exists():
            text = path.read_text()
            if path.suffix in (".yaml", ".yml"):
                import yaml

                return yaml.safe_load(text) or {}
            return json.loads(text)
    return {}


def checked_query(text: str) -> str:
    """A question of 1 to 1,000 characters, as a request may bring it."""
    if not 1 <= len(text) <= 1000:
        raise ValueError("a query has 1 to 1,000 characters")
    return text
