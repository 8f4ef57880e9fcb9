"""Product codes of vectors: a codebook for each part of the vector, by Lloyd's rounds with Hamerly's bounds.

Entries become whole numbers, floor(scale * x).  With every vector its codes are kept, and for each part an upper
bound of the distance to its entry and a lower bound of the distance to any other.  When entries move, the upper
bound grows by what its entry moved and the lower one shrinks by the largest move of the others.  A part whose
upper bound is below the lower bound, or below half of its entry's distance to the nearest other entry, keeps its
code unseen.  Else the upper bound becomes the distance itself, and if that isn't below either, all entries are
compared, in whole numbers.  Below means strictly, and bounds are rounded outwards: a part that may be as near to
another entry is always compared, and the lower index wins.

A round is one pass that writes the vectors with their new codes and bounds to the shared folder, and with them
a row of counts and sums from each task, which Spark adds up: what reaches the driver is bounded by the codebooks.
All is exact, so results don't depend on tasks, retries or order.

Defined results: vectors that are null, hold a null or an entry that is not finite, or have another length than
most (vectors.width_of) are left out; a null id is an id like any other but starts no codebook as long as others
are there; of equal ids the smaller vector starts first; with fewer vectors than entries there are fewer entries;
a vector that can't be cut into equal parts is padded with zeros; an empty table gives an empty result; whole numbers beyond
what keeps a squared distance within a long are cut there (1.9e8 for 64 dimensions); equal labels and null labels
are summed, and a sum beyond a long is null.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, small_batches
from .vectors import matrix, whole_numbers, width_of

Books = np.ndarray  # parts x entries x dimensions of a part


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of whole vectors, over the last axis."""
    off = a - b
    return (off * off).sum(axis=-1)


def other_half(book: np.ndarray) -> np.ndarray:
    """Of each entry half its distance to the nearest other one, rounded down."""
    apart = squared(book[:, None], book[None]).astype(float)
    np.fill_diagonal(apart, np.inf)
    return np.sqrt(apart.min(axis=1)) / 2 * (1 - 1e-6)


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, upper, lower, how many were compared with all entries) of one part; moved: how far entries moved."""
    code, upper, lower = code.copy(), upper.copy(), lower.copy()
    if moved is None:
        unsure = np.arange(len(x))
    else:
        most = np.argsort(moved)[::-1]
        others = np.where(code == most[0], moved[most[1]] if len(most) > 1 else 0.0, moved[most[0]])
        upper, lower = _up(upper.astype(float) + moved[code]), _down(lower.astype(float) - others)
        least = np.maximum(lower, other_half(book)[code]) if len(book) > 1 else np.full(len(x), np.inf)
        unsure = np.flatnonzero(~(upper < least))
        upper[unsure] = _up(np.sqrt(squared(x[unsure], book[code[unsure]])))
        unsure = unsure[~(upper[unsure] < least[unsure])]
    for k in range(0, len(unsure), 4096):
        some = unsure[k : k + 4096]
        d = squared(x[some][:, None], book[None])
        code[some] = best = d.argmin(axis=1)  # the first of equals
        nearest = d[np.arange(len(some)), best]
        upper[some] = _up(np.sqrt(nearest))
        if len(book) > 1:
            d[np.arange(len(some)), best] = np.iinfo(np.int64).max
            lower[some] = _down(np.sqrt(d.min(axis=1)))
        else:
            lower[some] = np.inf
    return code, upper, lower, len(unsure)


def _flat(column: pa.Array, n: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _round(state: DataFrame, books: Books, older: Books | None) -> DataFrame:
    """state with codes and bounds for these codebooks, and a row of counts, sums and comparisons from each task."""
    parts, entries, wide = books.shape
    names = ["vec_id", "label", "x", "code", "upper", "lower", "sums"]
    kinds = dict(state.dtypes)
    fresh = "code" not in kinds
    moved = None if older is None else np.sqrt(squared(books, older).astype(float)) * (1 + 1e-6)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, scans, last = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64), 0, None
        for batch in batches:
            n, last = batch.num_rows, batch
            x = _flat(batch.column(2), n, np.int64).reshape(n, parts, wide)
            code, upper, lower = (np.zeros((n, parts), t) for t in (np.int32, np.float32, np.float32)) if fresh else (_flat(batch.column(3 + i), n, t) for i, t in enumerate((np.int32, np.float32, np.float32)))
            found = [reassign(x[:, p], books[p], None if moved is None else moved[p], code[:, p], upper[:, p], lower[:, p]) for p in range(parts)]
            for p, (now, _, _, compared) in enumerate(found):
                counts[p] += np.bincount(now, minlength=entries)
                np.add.at(sums[p], now, x[:, p])
                scans += compared
            code, upper, lower = (np.stack([f[i] for f in found], axis=1) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _lists(code, pa.int32()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), pa.nulls(n, pa.list_(pa.int64()))], names
            )
        if last is not None:
            row = _lists(np.concatenate([counts.ravel(), sums.ravel(), [scans]])[None], pa.int64())
            empty = [pa.nulls(1, c.type) for c in last.columns[:3]]
            bounds = [pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.float32(), pa.float32())]
            yield pa.RecordBatch.from_arrays([*empty, *bounds, row], names)

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, code array<int>, upper array<float>, lower array<float>, sums array<bigint>"
    return state.mapInArrow(step, schema)


def _summed(state: DataFrame, books: Books) -> tuple[np.ndarray, np.ndarray, int]:
    """(counts, sums, comparisons) over all tasks, as Python's whole numbers."""
    parts, entries, wide = books.shape
    rows = state.filter("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "part_sum"))
    added = rows.groupBy("place").agg(F.sum(F.col("part_sum").cast("decimal(38,0)")).alias("total")).collect()
    flat = np.zeros(parts * entries * (wide + 1) + 1, dtype=object)
    for r in added:
        flat[r["place"]] = int(r["total"])
    counts, sums = flat[: parts * entries].reshape(parts, entries), flat[parts * entries : -1].reshape(parts, entries, wide)
    return counts, sums, flat[-1]


def _whole(df: DataFrame, row_id: str, column: str, label: str, width: int, padded: int, scale: int) -> DataFrame:
    """(vec_id, label, x): the vectors that take part, as whole numbers."""
    limit = math.isqrt(((1 << 63) - 1) // padded) // 2
    kinds = dict(df.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, entries = matrix(batch.column(2), width)
            x = np.zeros((len(places), padded), np.int64)
            x[:, :width] = whole_numbers(entries, scale, limit)
            at = pa.array(places)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _lists(x, pa.int64())], ["vec_id", "label", "x"])

    return df.select(row_id, label, column).mapInArrow(cut, f"vec_id {kinds[row_id]}, label {kinds[label]}, x array<bigint>")


def train(whole: DataFrame, *, parts: int, entries: int, rounds: int) -> tuple[DataFrame, Books, Books, list[int]]:
    """(state, codebooks it was assigned by, final codebooks, comparisons of each round)."""
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    state, older, compared = whole, None, []
    for _ in range(rounds):
        before, state = state, keep(_round(state, books, older))
        discard(before)
        counts, sums, scans = _summed(state, books)
        compared.append(scans)
        older, books = books, books.copy()
        used = counts > 0
        books[used] = (sums[used] // counts[used][:, None]).astype(np.int64)  # floors down
        state = state.filter("x IS NOT NULL").drop("sums")
    return state, older, books, compared


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(
    df: DataFrame, *, row_id: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """Per vector: the id, label, code (two hex digits a part), error, label_error, codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    small_batches(df.sparkSession)
    kinds, width = dict(df.dtypes), width_of(df, column)
    padded = -(-width // parts) * parts
    whole = keep(_whole(df, row_id, column, label, width, padded, scale)) if width else None
    if whole is None or whole.isEmpty():
        return df.sparkSession.createDataFrame([], f"{row_id} {kinds[row_id]}, {label} {kinds[label]}, code string, error long, label_error long, codebooks_sha256 string")
    state, older, books, _ = train(whole, parts=parts, entries=entries, rounds=rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            code = _flat(batch.column(3), n, np.int32)
            x = _flat(batch.column(2), n, np.int64).reshape(n, parts, -1)
            error = squared(x, books[np.arange(parts), code]).sum(axis=1)
            shown = [bytes(c).hex() for c in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shown, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    last = _round(state, books, older).filter("x IS NOT NULL").drop("sums")
    rows = keep(last.mapInArrow(coded, f"vec_id {kinds[row_id]}, label {kinds[label]}, code string, error long"))
    discard(state)
    sums = rows.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(F.col("vec_id").alias(row_id), F.col("label").alias(label), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
