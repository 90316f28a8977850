"""Reading and packing of vectors for the searches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import numbered, ship

#: Vectors in a packed block: bounds what one step of a search holds.
BLOCK = 4096


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", first: Column | None = None) -> DataFrame:
    """row, vec_id, v: the vectors that can take part, each row for itself, numbered in the order of ``first``
    (of v), id and vector, so the numbers follow from the rows alone. A null vector or id, an empty vector and one with a
    null or non-finite component cannot take part."""
    ship(vectors.sparkSession)
    v = F.col(vector).cast("array<double>")

    def finite(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    ok = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    ok = ok.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    ok = ok.withColumn("first", F.lit(0) if first is None else first)
    return numbered(ok, "row", "first", "vec_id", "v").select("row", "vec_id", "v")


def nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


PACKED = "dim int, rows binary, ids binary, data binary"


def pack(batches, block: int = BLOCK):
    """Rows (row, vec_id, v) of a partition as blocks of equal dimension: rows and ids int64, data float64 or float32, as bytes."""
    held: dict[int, list] = {}

    def out(dim):
        columns = [np.concatenate(c) for c in zip(*held.pop(dim), strict=True)]
        for i in range(0, len(columns[0]), block):
            data = columns[2][i : i + block]
            exact = data.astype(np.float32)
            data = exact if (exact == data).all() else data  # half the bytes where nothing is lost
            parts = [pa.array([c.tobytes()], pa.binary()) for c in (columns[0][i : i + block], columns[1][i : i + block], data)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *parts], names=["dim", "rows", "ids", "data"])

    for batch in batches:
        rows, ids = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        v = batch.column(2)
        sizes = np.diff(v.offsets.to_numpy())
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            held.setdefault(int(dim), []).append((rows[at], ids[at], matrix(v.take(pa.array(at)), int(dim))))
            if sum(len(x[0]) for x in held[int(dim)]) >= block:
                yield from out(int(dim))
    for dim in list(held):
        yield from out(dim)


def unpack(dim: int, rows: bytes, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.float64 if len(data) == len(rows) * dim else np.float32
    return np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
