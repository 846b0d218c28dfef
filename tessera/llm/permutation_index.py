"""Approximate nearest neighbours by a permutation index over pivots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import arrow_batch, empty, map_arrow, parts
from tessera.llm.vectors import as_bytes, dimension, from_bytes, rows_of, width

#: Pivots, drawn from a sample of so many rows of least hash; nearest pivots that a vector is posted under.
PIVOTS, SAMPLE, PREFIX = 128, 2048, 32
#: Share of a shard's vectors, by footrule distance, whose true distance is computed; so many at least.
RERANK, LEAST = 0.35, 128
#: Vectors of a shard: at most, and at least where tasks are idle otherwise. Queries of a block.
SHARD_MOST, SHARD_LEAST, BLOCK = 1 << 16, 512, 1 << 10


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Ids of the nearest pivots, nearest first."""
    d = (pivots**2).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix]


class PivotFiles:
    """Inverted files of a shard: for each pivot, the vectors that have it in their prefix and at which place."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        self.n, self.prefix = prefixes.shape
        flat = prefixes.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.prefix).astype(np.int32)
        self.place = (order % self.prefix).astype(np.int32)
        self.ends = np.searchsorted(flat[order], np.arange(pivots + 1))

    def footrule(self, query: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector's prefix to the query's; a pivot outside a prefix counts as at its end.

        That is a constant for prefixes without a common pivot, less what each common pivot takes off.
        """
        k = self.prefix
        off = np.zeros(self.n, dtype=np.int32)
        for at, pivot in enumerate(query):
            a, b = self.ends[pivot], self.ends[pivot + 1]
            place = self.place[a:b]
            off[self.vector[a:b]] += 2 * k - at - place - np.abs(place - at)
        return k * (k + 1) - off


class Shard:
    """The vectors of a shard in the order of their ids, with their inverted files."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots = ids[order], x[order], pivots
        self.prefix = min(PREFIX, len(pivots))
        self.files = PivotFiles(nearest_pivots(self.x, pivots, self.prefix), len(pivots))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, rerank: float = RERANK) -> list[tuple]:
        """(query, id, distance) of the k nearest found for each query."""
        ids, out = self.ids, []
        most = max(LEAST, int(np.ceil(rerank * len(ids))))
        for query, vector, own in zip(query_ids.tolist(), queries, nearest_pivots(queries, self.pivots, self.prefix), strict=True):
            if len(ids) > most:  # all up to the distance that reaches the share, so ties need no choice
                far = self.files.footrule(own)
                chosen = np.flatnonzero(far <= np.partition(far, most - 1)[most - 1])
            else:
                chosen = np.arange(len(ids))
            chosen = chosen[ids[chosen] != query]
            d = np.sqrt(((self.x[chosen] - vector) ** 2).sum(axis=1))
            best = np.lexsort((ids[chosen], d))[:k]
            out += [(query, int(i), float(s)) for i, s in zip(ids[chosen[best]], d[best])]
        return out


def search(vectors: DataFrame, k: int, is_query: Callable[[Column], Column], key: str = "vec_id", embedding: str = "embedding", rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key ``is_query`` takes, the k nearest found.

    Vectors are ordered by their nearest pivots and posted in the pivots' inverted files, shard by shard. Each goes to its
    shard once; the queries go to every shard and pass through it in blocks. There the files give all footrule distances, and the nearest RERANK of the shard by that
    measure are compared by Euclidean distance in double precision, with ``rerank=1`` exactly all. All rows are indexed
    and all are candidates except those with the query's own key. Null, zero, non-finite or odd-length vectors and null
    keys take no part; repeated query keys are asked once, with the vector of least bytes; repeated other keys are candidates each. Ties go to the
    smaller key. No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v")).where("id is not null")
    schema = "query_id long, rank int, vec_id long, score double"
    dim, kind = dimension(rows, "v"), width(rows, "v")
    if not dim:
        return empty(spark, schema)

    def usable(batches):
        for batch in batches:
            mask, x = rows_of(batch.column("v"), dim)
            yield arrow_batch([("id", pa.int64()), ("raw", pa.binary())], [batch.column("id").filter(pa.array(mask)), as_bytes(x, kind)])

    known = map_arrow(rows, usable, "id long, raw binary")
    queries = known.where(is_query(F.col("id"))).groupBy("id").agg(F.min("raw").alias("raw"))
    size = known.agg(F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q")).first()
    sample = known.orderBy(F.xxhash64("raw"), "id").limit(SAMPLE).collect()
    if not size.q:
        return empty(spark, schema)
    distinct = list(dict.fromkeys(bytes(r.raw) for r in sample))[:PIVOTS]
    pivots = spark.sparkContext.broadcast(from_bytes(distinct, kind, dim))
    shards = max(-(-size.n // SHARD_MOST), min(4 * parts(spark), -(-size.n // SHARD_LEAST)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    base = known.select("id", "raw", F.lit(0).alias("asks"), F.pmod(F.xxhash64("id", "raw"), F.lit(shards)).alias("shard"))
    n = max(parts(spark), min(shards, 4 * parts(spark)))
    cells = base.unionByName(queries.select("id", "raw", F.lit(1).alias("asks"), every.alias("shard"))).repartition(n, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches):
        now, shard, ids, raws = None, None, [], []
        asked: list[tuple[int, bytes]] = []

        def flush():
            nonlocal shard
            if ids:
                shard = Shard(np.array(ids), from_bytes(raws, kind, dim), pivots.value)
                ids.clear()
                raws.clear()
            if asked and shard is not None:
                found = shard.search(np.array([i for i, _ in asked]), from_bytes([raw for _, raw in asked], kind, dim), k, rerank)
                yield arrow_batch([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())], [list(x) for x in zip(*found)] or [[], [], []])
            asked.clear()

        for batch in batches:
            for at, asks, i, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "id", "raw")), strict=True):
                if at != now or len(asked) == BLOCK:
                    yield from flush()
                if at != now:
                    now, shard = at, None
                if asks:
                    asked.append((i, raw))
                else:
                    ids.append(i)
                    raws.append(raw)
        yield from flush()

    found = map_arrow(cells, run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
