"""Substring deduplication by super-k-mer partitioning.

A window is `window` consecutive words of one document.  Consecutive windows that share a minimiser (the
rarest run of `k` words) travel as one packed string to the minimiser's bucket.  There words
become numbers, and sorting pairs of ranks of runs of 1, 2, 4 ... words numbers the windows exactly; the
places of each are summed.  Pieces none of whose windows' hashes occur twice need no numbers.  Every word covered by a window that occurs more than once, in the same
document or another, is removed; windows are judged on the input.

Defined results: null text has no words; documents shorter than a window lose nothing; repeated rows and
rows of one doc_id are further documents, so their windows repeat; null doc_id is kept as null; a very long
text is cut whole, in a worker with some 60 bytes of memory for each of its bytes; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Corpus, RangeHash, exchange, expand, may_repeat, runs_of

WINDOW, K = 35, 6


def word_corpus(texts: list[bytes]) -> Corpus:
    """Documents as their words, `[^\\x20\\x09-\\x0D]+`, joined by one space."""
    lines = [b" ".join(t.split()) for t in texts]
    data = np.frombuffer(b" ".join(lines), dtype=np.uint8)
    ends_doc = np.cumsum([len(line) + 1 for line in lines], dtype=np.int64) - 1
    space = np.flatnonzero(data == 32)
    empty = np.array([not line for line in lines], dtype=bool)
    breaks = np.concatenate([[-1], space, [len(data)]]).astype(np.int64)
    start, end = breaks[:-1] + 1, breaks[1:]
    real = end > start
    start, end = start[real], end[real]
    last = np.searchsorted(end, ends_doc, side="right")
    first = np.concatenate([[0], last[:-1]]).astype(np.int64) if len(last) else last
    return Corpus(data, start, end, first, np.where(empty, first, last).astype(np.int64))


def window_numbers(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of `window` ids, equal for equal runs only; the ends' runs are cut short."""
    ranks, have = ids.astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        n = len(ranks) - step
        if n <= 0:
            return ranks[:0]
        pairs = ranks[:n] * (int(ranks.max()) + 1) + ranks[step:]
        ranks = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        have += step
    return ranks


def spaced(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces with a space behind each, and where each starts there."""
    start = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(len(data) + len(sizes), 32, dtype=np.uint8)
    out[expand(start, sizes)] = data
    return out, start


def repeated_windows(window: int):
    def judge(data, sizes, counts, smallest, largest):
        lined, start = spaced(data, sizes)
        word_end = np.flatnonzero(lined == 32) + 1  # a word and the space behind it
        word_start = np.concatenate([[0], word_end[:-1]]).astype(np.int64)
        first = np.searchsorted(word_start, start)
        many = np.diff(np.append(first, len(word_start)))
        windows = np.maximum(many - window + 1, 0)
        at = expand(first, windows)
        piece = np.repeat(np.arange(len(sizes)), windows)
        hashes = RangeHash(lined)(word_start[at], word_end[at + window - 1])
        some = may_repeat(hashes, piece, counts > 1)
        # the others' windows are their own; of these, sorting counts each window exactly
        offsets = np.concatenate([[0], word_end]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(word_end), [None, pa.py_buffer(offsets), pa.py_buffer(lined)])
        chosen = expand(first[some], many[some])
        ids = words.take(pa.array(chosen)).dictionary_encode().indices.to_numpy()
        piece = np.repeat(np.arange(len(some)), many[some])
        ends = np.cumsum(many[some])
        at = np.arange(len(ids)) - (ends - many[some])[piece]
        numbers = window_numbers(ids, window)
        inside = np.flatnonzero((at + window <= many[some][piece])[: len(numbers)])
        total = np.bincount(numbers[inside], weights=counts[some][piece[inside]], minlength=1)
        hit = inside[total[numbers[inside]] > 1]
        begins, long = runs_of(some[piece[hit]], hit)
        head = hit[begins]
        return some[piece[head]], at[head], long, np.full(len(head), np.iinfo(np.int64).min)

    return judge


def _finish(ids, texts, corpus: Corpus, marked: np.ndarray, with_text: bool) -> list[pa.Array]:
    removed = np.concatenate([[0], np.cumsum(marked)])
    lost = removed[corpus.last] - removed[corpus.first]
    digests, kept_texts = [], []
    for i in range(len(ids)):
        words = texts[i].split()
        if lost[i]:
            keep = ~marked[corpus.first[i] : corpus.last[i]]
            words = [words[j] for j in np.flatnonzero(keep).tolist()]
        kept = b" ".join(words)
        digests.append(hashlib.sha256(kept).hexdigest())
        kept_texts.append(kept if with_text else None)
    return [
        pa.array(ids, pa.int64()), pa.array(corpus.last - corpus.first, pa.int64()), pa.array(lost, pa.int64()),
        pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string()),
    ]


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, k: int = K, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space; null
    unless with_text)."""
    return exchange(
        docs, word_corpus, repeated_windows(window), partial(_finish, with_text=with_text),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string",
        window=window, k=k, across_docs=False,
    )
