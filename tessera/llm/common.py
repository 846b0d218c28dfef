"""What the operators of this subpackage share: scratch tables, Arrow maps and components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shipping import ship

#: Rows of an Arrow batch are cut into pieces of about so many bytes of text, which bounds a worker's memory.
PIECE_BYTES = 2 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a folder of our own where it is unset and all runs in one
    process, as in tests. On a cluster a folder of this machine would not do, so there it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return written(df, scratch_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``."""
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`saved` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "scratch", None)
        if path:
            delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    store, where = hadoop_path(spark, path)
    store.delete(where, True)


def hadoop_path(spark: SparkSession, path: str):
    """The driver's file system for a path, and the path in it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def file_system(uri: str):
    """The file system and path of a URI for a task, in any store that Arrow reaches; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def parts(spark: SparkSession, least: int = 1) -> int:
    """The shuffle width the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batches`` that hold about ``most`` bytes of ``column``, one row at least."""
    import numpy as np

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Bytes of an Arrow batch between Spark and a worker, where the session has Spark's own default of 64 MB.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand, small batches, and a worker that gives memory back when a task ends."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(BATCH_CONF, "67108864b") == "67108864b":
        spark.conf.set(BATCH_CONF, BATCH_BYTES)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Workers live on between tasks; what the allocators keep would count against the executor meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)],
        names=[n for n, _ in schema],
    )


def local_forest(pairs: list[tuple]) -> list[tuple]:
    """Edges of a spanning forest of ``pairs``; each joins a node to its tree's smallest."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root if find(x) != x]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Alternates large-star and small-star rounds until the edges stand still, O(log n) rounds in practice. Each round's
    minima are aggregated map-side and written, so the join back is between two plain tables whose hot nodes the
    adaptive skew join can split. Edges with a null end and loops are left out; no edges give an empty table.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = saved(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = saved(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = saved(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = saved(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, low, large, lower)
        was, now, mark = mark, after, _mark(after)
        if was == mark:
            break
    ends = now.unionByName(now.select(F.col("b").alias("a"), "b"))
    return ends.groupBy(F.col("a").cast(kind).alias("node")).agg(F.min("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
