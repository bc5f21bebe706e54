"""Embedding columns as packed rows of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        column = column.cast(pa.list_(pa.float64()))
        flat = column.flatten()
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
        sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        bad = np.r_[0, np.cumsum(~np.isfinite(values))]
        some = np.r_[0, np.cumsum(values != 0)]
        ok = (bad[ends] == bad[ends - sizes]) & (some[ends] > some[ends - sizes])
        data = values.tobytes()
        packed = [data[8 * (e - s) : 8 * e] if good else None for e, s, good in zip(ends.tolist(), sizes.tolist(), ok.tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "vector"])


def packed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of every row; vector holds the components as doubles, null for a vector that is null, zero or holds null or non-finite components."""
    flat = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return flat.mapInArrow(_pack, "vec_id long, vector binary")


def matrix(column) -> np.ndarray:
    """Packed vectors of one length as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
