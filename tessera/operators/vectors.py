"""Vector tables: embedding, squared distance, and top-k for one query or a batch."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def score(a, b, metric: str = "l2") -> Column:
    """1 less the squared Euclidean distance, or the cosine; six decimals, double precision."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    wide = lambda x: x.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(wide(p), wide(q), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return F.round(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), 6)
    return F.round(1 - F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 6)


def top_k(table: DataFrame, query: Sequence[float], k: int, key: str, vector: str = "embedding", metric: str = "l2") -> DataFrame:
    """The k best rows for one query, ties to the smaller key."""
    asked = F.array(*(F.lit(float(x)) for x in query))
    return table.withColumn("score", score(vector, asked, metric)).orderBy(F.desc("score"), key).limit(k)


#: Queries that are sent to every task at once; more are asked in further rounds.
QUERY_BLOCK = 4096


#: Queries whose distances to a batch of rows are one matrix; scores are rounded, so rows this near the k-th are looked at.
MATRIX, SLACK = 256, 1e-5


def _matrix(values, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are usable, those as rows): not null, of ``dim`` components, all finite."""
    ok = np.array([v is not None and len(v) == dim for v in values], dtype=bool)
    x = np.array([np.asarray(v, dtype=np.float64) for v, good in zip(values, ok) if good]).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    ok[np.flatnonzero(ok)[~fine]] = False
    return ok, x[fine]


class Best:
    """The k best rows so far of each query, by score, then key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.norm = (queries**2).sum(axis=1)
        self.kept: list[tuple] = [(None, None)] * len(queries)

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        norm, k = (x**2).sum(axis=1), min(self.k, len(x))
        for at in range(0, len(self.q), MATRIX):
            q = self.q[at : at + MATRIX]
            far = norm[None, :] - 2 * q @ x.T + self.norm[at : at + MATRIX, None]
            reach = np.partition(far, k - 1, axis=1)[:, k - 1] + SLACK * (1 + self.norm[at : at + MATRIX])
            for i, some in enumerate(far <= reach[:, None], at):
                near = np.flatnonzero(some)
                self._keep(i, keys[near], np.round(1 - ((x[near] - self.q[i]) ** 2).sum(axis=1), 6))

    def _keep(self, i: int, keys: np.ndarray, scores: np.ndarray) -> None:
        if self.kept[i][0] is not None:
            keys, scores = np.concatenate([self.kept[i][0], keys]), np.concatenate([self.kept[i][1], scores])
        best = np.lexsort((keys, -scores))[: self.k]
        self.kept[i] = keys[best], scores[best]


def top_k_batched(table: DataFrame, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding") -> DataFrame:
    """(query_key, key, score, rank) for a batch of queries by squared distance.

    Queries come in blocks of QUERY_BLOCK vectors, which bounds what is broadcast; a task multiplies matrices, computes the
    nearest anew in full precision, and keeps its k best for each query, so what is shuffled is k rows for each query and
    task. Vectors that are null, of another length than the queries' first or not finite take no part.
    """
    spark = table.sparkSession
    ids = [f"{query_key} {queries.schema[query_key].dataType.simpleString()}", f"{key} {table.schema[key].dataType.simpleString()}"]
    out = None
    rows = queries.select(query_key, vector).where(F.col(vector).isNotNull())
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)
        asked = block.collect()
        if not asked:
            continue
        dim = len(asked[0][1])
        ok, q = _matrix([[np.nan if c is None else c for c in r[1]] for r in asked], dim)
        sent = spark.sparkContext.broadcast(([r[0] for r, good in zip(asked, ok) if good], q))

        def run(frames, dim=dim, sent=sent):
            names, q = sent.value
            best = Best(q, k)
            for pdf in frames:
                good, x = _matrix(pdf[vector].tolist(), dim)
                if len(x) and len(q):
                    best.add(pdf[key].to_numpy()[good], x)
            parts = [pd.DataFrame({query_key: name, key: keys, "score": scores}) for name, (keys, scores) in zip(names, best.kept) if keys is not None]
            if parts:
                yield pd.concat(parts)

        found = table.select(key, vector).mapInPandas(run, f"{ids[0]}, {ids[1]}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"{ids[0]}, {ids[1]}, score double, rank int")
    rank = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


#: Words whose buckets a batch of texts remembers, at most.
WORDS = 1_000_000


def hashed_embedding(texts: Column, dim: int = 64) -> Column:
    """The offline embedder: words hashed into ``dim`` signed buckets, then scaled to unit length; the same everywhere."""

    @F.pandas_udf("array<float>")
    def run(col: pd.Series) -> pd.Series:
        known: dict[str, int] = {}  # a word's bucket, and dim more if it counts as -1

        def bucket(w):
            h = zlib.crc32(w.encode())
            if len(known) >= WORDS:
                known.clear()
            known[w] = at = h % dim + (0 if h >> 16 & 1 else dim)
            return at

        def one(text):
            at = [known[w] if w in known else bucket(w) for w in re.findall(r"\w+", (text or "").lower())]
            counts = np.bincount(np.array(at, dtype=np.int64), minlength=2 * dim)
            v = (counts[:dim] - counts[dim:]).astype(np.float64)
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32)

        return col.map(one)

    return run(texts)


EMBED_TEXTS: dict[str, Callable[[], Column]] = {
    "text_units": lambda: F.col("text"),
    "entities": lambda: F.concat_ws(": ", "name", "description"),
    "communities": lambda: F.concat_ws("\n", "title", "summary"),
}


def vector_table(rows: DataFrame, kind: str, embed: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """``rows`` with the text to embed and its vector; communities without a summary have none."""
    if kind == "communities":
        rows = rows.where(F.coalesce("summary", F.lit("")) != "")
    return rows.withColumn("embed_text", EMBED_TEXTS[kind]()).withColumn("vector", embed(F.col("embed_text")))
