"""Vectors of a table as matrices: what the operators on embeddings share.

A vector takes part if it is not null, has the table's width and holds neither nulls nor values that are not
finite.  The width is the most frequent length of the table's vectors, the longer one of equals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def width_of(df: DataFrame, column: str) -> int:
    """The most frequent length of the vectors; 0 if there are none."""
    lengths = df.filter(F.size(column) > 0).groupBy(F.size(column).alias("width")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    return first["width"] if first else 0


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the places in the batch of the vectors that take part, and a row of doubles for each."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    whole = np.diff(offsets) == width
    if column.null_count:
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    places = np.flatnonzero(whole)
    rows = values[offsets[places][:, None] + np.arange(width)]
    finite = np.isfinite(rows).all(axis=1)
    return places[finite], rows[finite]


def whole_numbers(rows: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * entry) as longs; beyond the limit they are the limit."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(rows * scale), -limit, limit).astype(np.int64)
