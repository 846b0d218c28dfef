"""Vectors of an array column as numpy rows, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, column: str) -> int:
    """The most frequent length of the vectors, 0 without any; vectors of another length take no part."""
    sizes = df.select(F.size(column).alias("n")).where("n > 0").groupBy("n").count()
    top = sizes.orderBy(F.desc("count"), "n").first()
    return top.n if top else 0


def width(df: DataFrame, column: str) -> str:
    """How components are stored between steps: as they came if single precision, else double."""
    return "<f4" if df.schema[column].dataType.elementType.simpleString() == "float" else "<f8"


def rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, those as a double matrix). A row is not if null, of another length, zero, or with a
    component that is null or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(sizes == dim) if dim else np.empty(0, dtype=np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1][ok]
    x = values[starts[:, None] + np.arange(dim)] if len(ok) else np.empty((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    mask = np.zeros(len(column), dtype=bool)
    mask[ok[fine]] = True
    return mask, x[fine]


def as_bytes(x: np.ndarray, kind: str) -> list[bytes]:
    return [r.tobytes() for r in x.astype(kind)]


def from_bytes(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(-1, dim).astype(np.float64)
