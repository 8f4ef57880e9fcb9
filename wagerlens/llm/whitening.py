"""Whitening of embeddings by merged moments.

Entries become whole numbers, floor(scale * c) + shift.  Each partition computes its count, exact sums and the
scatter around its own mean; treeReduce merges two such states by Chan's formula,

    scatter = scatter_a + scatter_b + (mean_b - mean_a) (mean_b - mean_a)' * n_a * n_b / (n_a + n_b),

so nothing is ever subtracted from sums of squares, however large the shift.  The driver gets one matrix of
width x width and decomposes it.  A second pass over all vectors merges the moments of what was whitened, and
the largest deviation of their covariance from the identity is returned with every row.

Defined results: vectors that are null, hold a null or an entry that is not finite, or have another length than
most (vectors.width_of) are left out, also of the fit; a null id is an id like any other; repeated rows and ties
count each; an empty table gives an empty result; entries beyond 2^53 are cut there, so that doubles hold them; a
component without variance (equal vectors, fewer vectors than dimensions) has null in whitened and doesn't count
for the identity; without any variance explained is null; a deviation of over 38 digits is null.  Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .vectors import matrix, whole_numbers, width_of

LIMIT = 1 << 53
DIGITS = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Moments:
    """Count, sums by dimension (Python's whole numbers where they must be exact) and the scatter around the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(float)

    @classmethod
    def none(cls, width: int, kind: type = object) -> Moments:
        return cls(0, np.zeros(width, dtype=kind), np.zeros((width, width)))

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        if not len(rows):
            return cls.none(rows.shape[1], object if rows.dtype == np.int64 else float)
        if rows.dtype == np.int64:  # in two halves, whose sums fit a long
            sums = (rows >> 32).sum(axis=0).astype(object) * (1 << 32) + (rows & 0xFFFFFFFF).sum(axis=0).astype(object)
        else:
            sums = rows.sum(axis=0)
        centred = rows - (sums / len(rows)).astype(float)
        return cls(len(rows), sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n)))


@dataclass(frozen=True)
class Whitening:
    """What a fit found: count, exact sums, and by component its unit vector, variance and share of the variance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Rows (of whole numbers) centred, projected and scaled: a column for each component that varies."""
        return (rows - (self.sums / self.n).astype(float)) @ (self.vectors / np.sqrt(self.variances))


def _reduced(df: DataFrame, column: str, width: int, rows_of: Callable[[np.ndarray], np.ndarray], none: Moments) -> Moments:
    """The moments of rows_of(vectors' matrix) over the whole table: a state a partition, merged in a tree."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = none
        for batch in batches:
            state = state.merged(Moments.of(rows_of(matrix(batch.column(0), width)[1])))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    found = df.select(column).mapInArrow(states, "state binary").rdd.map(lambda row: pickle.loads(bytes(row["state"])))
    return found.treeReduce(Moments.merged) if found.getNumPartitions() else none


def fit(df: DataFrame, column: str, *, components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Components of the vectors' covariance, the largest first, verified over all vectors; None without vectors."""
    width = width_of(df, column)
    state = _reduced(df, column, width, lambda rows: whole_numbers(rows, scale, LIMIT) + shift, Moments.none(width)) if width else None
    if not state or not state.n:
        return None
    variances, vectors = np.linalg.eigh(state.scatter / state.n)
    variances, vectors = variances[::-1], vectors[:, ::-1]
    taken = slice(0, min(components, width))
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(width)])  # the largest entry is positive
    trace = float(np.trace(state.scatter)) / state.n
    share = variances[taken] / trace if trace > 0 else np.full(min(components, width), np.nan)
    varies = variances[taken] > width * np.finfo(float).eps * variances[0] if variances[0] > 0 else np.zeros(min(components, width), bool)
    known = int(varies.sum())  # the first ones: variances fall
    model = Whitening(state.n, state.sums, vectors[:, taken][:, :known], variances[taken][:known], share)
    if not known:
        return model
    check = _reduced(df, column, width, lambda rows: model.whitened(whole_numbers(rows, scale, LIMIT) + shift), Moments.none(known, float))
    error = float(np.abs(check.scatter / check.n - np.eye(known)).max())
    return Whitening(model.n, model.sums, model.vectors, model.variances, model.explained, error)


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Per row the exact sum over dimensions of (n * x - S)^2."""
    apart = int(max(n * int(np.abs(rows).max(initial=0)), max(map(abs, sums.tolist()), default=0)))
    if apart < 1 << 61:
        off = n * rows - sums.astype(np.int64)
        most = int(np.abs(off).max(initial=0))
        if most * most * max(1, rows.shape[1]) < 1 << 63:
            return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(19, 0)).cast(DIGITS)
    off = n * rows.astype(object) - sums
    return pa.array([Decimal(v) if v < 10**38 else None for v in (off * off).sum(axis=1)], DIGITS)


def whiten(
    df: DataFrame, *, row_id: str = "vec_id", column: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000
) -> DataFrame:
    """Per vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    small_batches(df.sparkSession)
    kind = df.schema[row_id].dataType.simpleString()
    schema = f"{row_id} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(df, column, components=components, scale=scale, shift=shift)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared, width = df.sparkSession.sparkContext.broadcast(model), len(model.sums)  # components x width doubles

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        each, known = len(m.explained), m.vectors.shape[1]
        for batch in batches:
            places, entries = matrix(batch.column(1), width)
            x = whole_numbers(entries, scale, LIMIT) + shift
            out = np.full((len(x), each), np.nan)
            out[:, :known] = m.whitened(x) if known else 0.0
            again = pa.array(np.repeat(np.arange(len(x)), each))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(places)).take(again),
                    pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(again), m.n)),
                    deviations(x, m.n, m.sums).take(again),
                    pa.array(out.ravel(), from_pandas=True),
                    pa.array(np.tile(m.explained, len(x)), from_pandas=True),
                    pa.array(np.full(len(again), m.identity_error)),
                ],
                [row_id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return df.select(row_id, column).mapInArrow(rows_of, schema)
