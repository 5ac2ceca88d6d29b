"""Embedding vectors as whole numbers, for the operators on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entry(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def integral(rows: DataFrame, scale: int, dims: int | None = None) -> DataFrame:
    """vec_id and x = floor(scale * entry) as longs (beyond a long: its bounds), of the rows whose embedding is
    not null and holds neither nulls nor entries that are not finite (and, where dims is given, so many entries)."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", entry)
    if dims is not None:
        whole &= F.size("embedding") == dims
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(whole)
    return found.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of a matrix; what a list lacks is 0."""
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(lists) * dims and (not len(ends) or (np.diff(ends, prepend=0) == dims).all()):
        return flat.reshape(-1, dims).astype(np.int64, copy=False)
    out = np.zeros((len(lists), dims), np.int64)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        out[k, : b - a] = flat[a:b]
    return out
