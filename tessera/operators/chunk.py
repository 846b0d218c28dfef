"""Texts into chunks that keep paragraphs and sentences together, with their source and some overlap."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text as X


def packed(parts: list[str], glue: str, size: int, smaller: Callable[[str], list[str]]) -> list[str]:
    """Neighbouring parts joined by ``glue`` while they fit ``size`` tokens of four characters; a part that doesn't fit
    alone is taken apart by ``smaller``."""
    out: list[str] = []
    held = ""
    for part in parts:
        joined = f"{held}{glue}{part}" if held else part
        if len(joined) // 4 <= size:
            held = joined
            continue
        out += [held] if held else []
        held = "" if len(part) // 4 > size else part
        out += [] if held else smaller(part)
    return out + ([held] if held else [])


def chunks(body: str, size: int) -> list[str]:
    """Paragraphs first, then sentences, then slices; a body of white space alone is one chunk."""
    slices = lambda s: [s[i : i + 4 * size] for i in range(0, len(s), 4 * size)]
    by_sentence = lambda p: packed(re.split(r"(?<=[.!?])\s+", p), " ", size, slices)
    paragraphs = [p for p in map(str.strip, re.split(r"\n{2,}", body)) if p]
    return packed(paragraphs, "\n\n", size, by_sentence) or [body]


def chunk_column(body: Column, size: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: chunks(x, size) if x else [])

    return run(body)


def text_units(texts: DataFrame, size: int = 600, overlap: int = 0) -> DataFrame:
    """Text units of ``texts`` (source_file, body, source_video, start_time, end_time): one row a chunk, with id, the text
    to embed (source and the end of the chunk before in front) and the raw text. Empty bodies have none."""
    rows = texts.withColumn("body", X.without_headers("body")).where("body <> ''")
    units = rows.select("*", F.posexplode(chunk_column(F.col("body"), size)).alias("i", "raw_text")).drop("body")
    if overlap:
        before = F.lag("raw_text").over(W.partitionBy("source_file").orderBy("i"))
        units = units.withColumn("__before", F.when(before.isNotNull(), F.concat(X.tail_tokens(before, overlap), F.lit("\n\n"))))
    else:
        units = units.withColumn("__before", F.lit(None).cast("string"))
    prefix = F.format_string("[Meeting: %s | %.1fs ~ %.1fs]\n\n", "source_video", "start_time", "end_time")
    name = F.concat_ws(":", "source_file", F.col("i").cast("string"), F.substring("raw_text", 1, 64))
    return units.withColumn("text", F.concat(prefix, F.coalesce("__before", F.lit("")), F.col("raw_text"))).withColumn("id", X.md5_id(name, 16)).drop("__before")
