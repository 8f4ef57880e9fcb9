"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad.
A text is cut into blocks of fixed size and every block is compressed with both dictionaries.  The evidence
is the difference of the summed sizes, normalised by the geometric mean of the text's length and its mean
compressed size: text that repeats itself, which shrinks under either dictionary, keeps little of it.  It is
the only input of the score: a logistic curve, fitted on other labelled rows, turns it into a probability.
Blocks keep the dictionaries' weight the same over a whole long text.

Learning uses a bounded sample, chosen by a hash of doc_id: at most `per_class` labelled rows of each
class; of these, rows of over `longest` bytes teach nothing.  Half of them build the dictionaries, half fit
the curve.  Scoring covers every whole text.

Defined results: a null or empty text has evidence 0; null labels and labels without a document teach
nothing; with no labels of one class every text scores the other class's share (0.5 without labels); very long
texts are scored whole, block by block; repeated rows and ties are scored alike; an empty table gives an empty
result; further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

BLOCK = 512
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    weight: float = 0.0
    offset: float = 0.0

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.weight * evidence + self.offset, -30, 30)))


class _Sizer:
    """Compressed size of a text under one dictionary."""

    def __init__(self, dictionary: bytes):
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        self._press = zstandard.ZstdCompressor(
            dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
        )

    def __call__(self, text: bytes) -> int:
        return sum(len(self._press.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def evidence_of(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(size under bad - size under good) / sqrt(length * mean of both sizes) of each text; 0 for an empty one."""
    by_good, by_bad = _Sizer(good), _Sizer(bad)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            g, b = by_good(text), by_bad(text)
            out[i] = (b - g) / math.sqrt(len(text) * (b + g) / 2)
    return out


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the sample itself as raw content where it is too small to train on."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    if sum(map(len, blocks)) > size:
        try:
            return zstandard.train_dictionary(size, blocks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(blocks)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and offset by Newton steps on the standardised evidence, with a weak pull of the weight towards 0."""
    centre, scale = x.mean(), max(x.std(), 1e-9)
    rows = np.stack([(x - centre) / scale, np.ones(len(x))], axis=1)
    pull = np.array([0.01, 1e-9])
    theta = np.zeros(2)
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ theta, -30, 30)))
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(pull)
        step = np.linalg.solve(hessian, rows.T @ (p - y) + pull * theta)
        theta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0] / scale), float(theta[1] - theta[0] * centre / scale)


def fit_on_sample(texts: list[bytes], good: list[bool], *, dictionary_bytes: int = 262_144) -> CompressionModel:
    """Fit on a list in its given order: even rows build dictionaries, odd rows fit the curve."""
    y = np.array(good, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        return CompressionModel(b"", b"", offset=float(np.log(share / (1 - share))))
    place = {True: 0, False: 0}
    build: dict[bool, list[bytes]] = {True: [], False: []}
    held: list[int] = []
    for i, (text, label) in enumerate(zip(texts, good, strict=True)):
        if place[label] % 2 == 0:
            build[label].append(text)
        else:
            held.append(i)
        place[label] += 1
    bad_dict, good_dict = _dictionary(build[False], dictionary_bytes), _dictionary(build[True], dictionary_bytes)
    rows = held if len({good[i] for i in held}) == 2 else list(range(len(texts)))
    weight, offset = _logistic(evidence_of([texts[i] for i in rows], good_dict, bad_dict), y[rows])
    return CompressionModel(good_dict, bad_dict, weight, offset)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, longest: int = 32768) -> CompressionModel:
    """Fit from labelled documents outside the held-out third.

    Each class's rows are the `per_class` smallest by a hash of doc_id among all labelled rows; only
    that bounded sample of labels (ids and a bit) is broadcast to find the texts.
    """
    rows = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("draw", F.xxhash64("doc_id"))
    )
    share = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label in (0, 1):
        part = rows.filter(F.col("quality") == label).orderBy("draw", "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    taken = (
        docs.select("doc_id", "text")
        .filter(F.octet_length("text").between(1, longest))
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "quality", "draw")
        .agg(F.max("text").alias("text"))
        .collect()
    )
    taken.sort(key=lambda r: (r["draw"], r["doc_id"]))
    model = fit_on_sample([r["text"].encode() for r in taken], [r["quality"] == 1 for r in taken])
    return _to_prior(model, share, per_class)


def _to_prior(model: CompressionModel, share: dict[int, int], per_class: int) -> CompressionModel:
    """Undo the change of class shares that a sample bounded per class makes."""
    bad, good = share.get(0, 0), share.get(1, 0)
    if not bad or not good or not model.weight:
        return model
    shift = np.log(good / bad) - np.log(min(good, per_class) / min(bad, per_class))
    return replace(model, offset=model.offset + float(shift))


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """Per row: doc_id, held_out, evidence, score, predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            evidence = evidence_of([text_bytes(t) for t in batch.column(1)], m.good, m.bad)
            p = m.probability(evidence)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(evidence, pa.float64()),
                    pa.array(p, pa.float64()),
                    pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                ],
                ["doc_id", "held_out", "evidence", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        scored, f"doc_id {kind}, held_out boolean, evidence double, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """The rows that the classifier does not reject, with their columns unchanged."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p = m.probability(evidence_of([text_bytes(t) for t in batch.column(at)], m.good, m.bad))
            yield batch.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(passing, docs.schema)
