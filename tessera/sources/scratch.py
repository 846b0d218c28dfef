"""Tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Our own folder where none is set and all runs in one process; on a cluster it has
    to be set, as a folder of this machine would not do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` and read it back: lineage is cut and lost executors lose nothing."""
    path = folder(df.sparkSession, name)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that is read rather than computed again; one that :func:`saved` gave is that already."""
    return df if hasattr(df, "saved_at") else saved(df, name)


#: Rows that are sent to every task of a join, at most; more are dealt out by key.
SENT_ROWS = 200_000


def sent(df: DataFrame) -> DataFrame:
    """``df``, a written table, as the side of a join that goes to every task where it has few rows: so a large other side
    is read where it lies."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def dropped(*tables: DataFrame) -> None:
    """Deletes what :func:`saved` wrote, where nothing that is still to run reads it."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
