"""Windows of a corpus, brought together by super-k-mers.

An item sequence (words or bytes of documents) is cut so that equal windows of `window` items meet: the
minimiser of a window is its rarest run of `k` items, consecutive windows of one document that share it form
a piece, and a piece travels as one string to the bucket that its minimiser names.

Runs are ordered by how often a bounded sample of the documents has them, then by hash.  So a common run
is a minimiser only where a window has no rarer one, and no bucket gathers what is merely common.  The order
is the same for all documents, and whatever it is, equal windows have equal minimisers: it decides how much
travels and never what is found.

    documents -> chunks (by a hash of the document) -> pieces, of which 24 bits of the minimiser are sent
    buckets   -> which pieces share their minimiser with another chunk's or may repeat by themselves
    chunks    -> those pieces' strings, one copy a chunk, packed by bucket
    buckets   -> windows of all chunks compared exactly -> verdicts, packed by chunk
    chunks    -> verdicts applied to every place of a piece

Most pieces are alone and never travel.  Hot groups: a piece is sent once a chunk however often the chunk has it, and a verdict is returned once,
so that a passage in a third of all documents costs its bucket one string a chunk.  Chunks are dealt by
document, so copies never share one.  Pieces are rebuilt, not stored: a chunk's documents are sorted by
their content, which makes its pieces the same whenever and wherever they are computed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_bytes

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 17
#: Runs are counted by hash in so many counters; the sample has so many documents of so many bytes at most.
SLOT_BITS, SAMPLE_DOCS, SAMPLE_BYTES = 20, 512, 32768
#: Bytes of pieces that are judged at once.
PART_BYTES = 1 << 19
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT + (1 << 14)), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class RangeHash:
    """Polynomial hashes of any byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        sums = np.empty(len(data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(data)), out=sums[1:])
        self._sums, self._shift = sums, _power(BASE_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._shift[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each range, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, dtype=np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - ends + lengths, lengths)


@dataclass
class Corpus:
    """A chunk's documents, sorted: one buffer, the byte range of each item, the item range of each document."""

    data: np.ndarray
    item_start: np.ndarray
    item_end: np.ndarray
    first: np.ndarray
    last: np.ndarray


@dataclass
class Pieces:
    """Distinct pieces of a chunk, in order of (bucket, first place), and all their places."""

    bucket: np.ndarray
    tag: np.ndarray
    byte_start: np.ndarray
    byte_end: np.ndarray
    place_first: np.ndarray  # of each piece, into place_item
    place_count: np.ndarray
    place_item: np.ndarray
    place_doc: np.ndarray
    twice: np.ndarray  # the minimiser occurs again within the piece, so that windows may


def ranks_of(corpus: Corpus, k: int) -> np.ndarray:
    """Per slot of a run's hash, how often the corpus has such runs, on a logarithmic scale from 0 to 15."""
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    sizes = np.maximum(corpus.last - corpus.first - k + 1, 0)
    at = expand(corpus.first, sizes)
    if len(at):
        grams = RangeHash(corpus.data)(corpus.item_start[at], corpus.item_end[at + k - 1])
        counts += np.bincount((grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
    return np.minimum(np.ceil(np.log2(counts + 1)), 15).astype(np.uint8)


def cut(corpus: Corpus, window: int, k: int, buckets: int, ranks: np.ndarray, repeats: bool = True) -> Pieces:
    """All pieces of the corpus, a run of documents of about SEGMENT bytes at a time.

    repeats: find out which pieces have their minimiser twice.
    """
    found: list[tuple[np.ndarray, ...]] = []
    low, n_docs = 0, len(corpus.first)
    bounds = corpus.item_start
    while low < n_docs:
        a = corpus.first[low]
        high = low + 1
        if a < len(bounds):
            limit = bounds[a] + SEGMENT
            ends = np.where(corpus.last[low:] > corpus.first[low:], corpus.item_end[np.maximum(corpus.last[low:] - 1, 0)], 0)
            high = max(high, low + int(np.searchsorted(np.maximum.accumulate(ends), limit, side="right")))
        found += _cut_segment(corpus, low, high, window, k, ranks, repeats)
        low = high
    if not found:
        found = [tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, *[np.int64] * 4, bool))]
    return _distinct(corpus.data, *(np.concatenate(x) for x in zip(*found, strict=True)), buckets)


def _cut_segment(corpus: Corpus, low: int, high: int, window: int, k: int, ranks: np.ndarray, repeats: bool) -> list[tuple[np.ndarray, ...]]:
    a, b = corpus.first[low], corpus.last[high - 1]
    if b - a < window:
        return []
    origin = corpus.item_start[a]
    start, end = corpus.item_start[a:b] - origin, corpus.item_end[a:b] - origin
    ranges = RangeHash(corpus.data[origin : corpus.item_end[b - 1]])
    grams = ranges(start[: b - a - k + 1], end[k - 1 :])
    grams = (ranks[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(60)) | (grams >> np.uint64(4))
    least = sliding_min(grams, window - k + 1)
    sizes = corpus.last[low:high] - corpus.first[low:high]
    docs = np.repeat(np.arange(low, high), sizes)[: len(least)]
    whole = np.arange(len(least)) + window <= corpus.last[docs] - a
    at = np.flatnonzero(whole)
    if not len(at):
        return []
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (docs[at[1:]] != docs[at[:-1]])
    begins = np.flatnonzero(new)
    item = at[begins]
    last = at[np.append(begins[1:], len(at)) - 1] + window - 1
    s, e = start[item], end[last]
    twice = np.zeros(len(item), dtype=bool)
    if repeats:
        sizes = last - item + 2 - k
        again = grams[expand(item, sizes)] == np.repeat(least[item], sizes)
        twice = np.add.reduceat(again.astype(np.int32), np.cumsum(sizes) - sizes) > 1
    return [(least[item], ranges(s, e), s + origin, e + origin, item + a, docs[item], twice)]


def _distinct(data, minimiser, content, start, end, item, doc, twice, buckets: int) -> Pieces:
    """Equal strings become one piece; equal hashes are compared byte by byte."""
    while True:
        order = np.argsort(content, kind="stable")  # places come in order and stay so
        c, n = content[order], (end - start)[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (n[1:] != n[:-1])
        group = np.cumsum(new) - 1
        heads = order[new]
        again = np.flatnonzero(~new)
        mine, theirs, length = order[again], heads[group[again]], n[again]
        differs = data[expand(start[mine], length)] != data[expand(start[theirs], length)]
        if not differs.any():
            break
        odd = np.unique(np.repeat(mine, length)[differs])
        content = content.copy()
        content[odd] += np.arange(1, len(odd) + 1, dtype=np.uint64)
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    bucket = (mixed(minimiser[heads]) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((item[heads], bucket))
    places = order[expand(np.flatnonzero(new)[by], counts[by])]
    heads = heads[by]
    return Pieces(
        bucket[by], (minimiser[heads] & np.uint64(0xFFFFFF)).astype(np.uint32), start[heads], end[heads],
        np.cumsum(counts[by]) - counts[by], counts[by], item[places], doc[places], twice[heads],
    )


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; bytes of equal weight stand together."""
    parts, head = [], [len(arrays)]
    for x in arrays:
        head += [x.dtype.char.encode()[0], len(x)]
        parts.append(x.tobytes() if x.dtype.itemsize == 1 else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")
    raw = struct.pack(f"<{len(head)}q", *head) + b"".join(parts)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    head = struct.unpack_from(f"<{2 * n}q", raw, 8)
    at, out = 8 + 16 * n, []
    for code, length in zip(head[::2], head[1::2], strict=True):
        kind = np.dtype(chr(code))
        flat = np.frombuffer(raw, dtype=np.uint8, count=length * kind.itemsize, offset=at)
        out.append(flat.view(kind) if kind.itemsize == 1 else np.ascontiguousarray(flat.reshape(kind.itemsize, length).T).view(kind).reshape(length))
        at += len(flat)
    return out


def binary_rows(column: pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def sorted_docs(rows: pa.Table) -> tuple[list, list[bytes]]:
    """doc_ids (None last) and texts, in an order that only their content decides."""
    ids, texts = rows.column("doc_id").to_pylist(), binary_rows(rows.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def runs_of(piece: np.ndarray, at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (piece, at) in order: the first of each run of consecutive ones with equal `more`, and its length."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(at)))


def may_repeat(hashes: np.ndarray, piece: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Pieces that are sure to repeat or of which another piece may have a window: the windows of all others
    are proved to be their own, as equal windows have equal hashes."""
    bits = max(int(len(sure)).bit_length(), 1)
    key = (hashes & ~np.uint64((1 << bits) - 1)) | piece.astype(np.uint64)
    key.sort()
    equal = key[1:] >> np.uint64(bits) == key[:-1] >> np.uint64(bits)
    owner = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    keep = sure.copy()
    keep[owner[1:][equal]] = True
    keep[owner[:-1][equal]] = True
    return np.flatnonzero(keep)


def in_parts(judge: Callable, data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, tags: np.ndarray, smallest: np.ndarray, largest: np.ndarray) -> list[np.ndarray]:
    """judge() over all pieces of one minimiser and then another, some PART_BYTES at a time; its runs by piece."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(tags, kind="stable")
    filled = np.cumsum(sizes[order])
    last_of_tag = np.flatnonzero(np.append(np.diff(tags[order]), 1) != 0) if len(order) else np.empty(0, dtype=np.int64)
    runs, low, begun = [], 0, 0
    for end in last_of_tag:
        if filled[end] - begun >= PART_BYTES or end == last_of_tag[-1]:
            part = order[low : end + 1]
            piece, *rest = judge(data[expand(start[part], sizes[part])], sizes[part], counts[part], smallest[part], largest[part])
            runs.append((part[piece], *rest))
            low, begun = end + 1, filled[end]
    if not runs:
        return [np.empty(0, dtype=np.int64)] * 4
    out = [np.concatenate(x) for x in zip(*runs, strict=True)]
    by = np.argsort(out[0], kind="stable")
    return [x[by] for x in out]


NO_ID = np.iinfo(np.int64).max


def exchange(
    docs: DataFrame,
    corpus_of: Callable[[list[bytes]], Corpus],
    judge: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
    finish: Callable[[list, list[bytes], Corpus, np.ndarray], list[pa.Array]],
    schema: str,
    *,
    window: int,
    k: int,
    across_docs: bool,
    chunk_bytes: int = 2 << 20,
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """Run the steps over docs (doc_id, text); doc_id is a whole number.

    judge(data, sizes, counts, smallest, largest) sees a bucket's pieces, one after another in data: a piece
    is there once for each chunk that has it, with how often the chunk has it and the smallest and largest
    doc_id there; it returns runs (piece, first window, windows, limit) in order of pieces.
    A run marks its windows at every place of the piece in its chunk whose doc_id is over the limit.
    finish(ids, texts, corpus, marked items) makes the result's columns.  A piece whose minimiser no other
    piece shares is judged only if it may repeat by itself: in several documents, or, unless across_docs,
    at several places.
    """
    spark = docs.sparkSession
    small_batches(spark)
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    total = facts["bytes"] or 0
    chunks, buckets = total // chunk_bytes + 1, total // bucket_bytes + 1
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    names = [field.split()[0] for field in schema.split(", ")]
    drawn = F.pmod(F.xxhash64("text"), F.lit(facts["n"] // SAMPLE_DOCS + 1)) == 0
    sample = docs.filter(F.octet_length("text").between(1, SAMPLE_BYTES) & drawn).select("text").limit(SAMPLE_DOCS).collect()
    shared_ranks = spark.sparkContext.broadcast(ranks_of(corpus_of([text_bytes(r["text"]) for r in sample]), k))  # 2 ** SLOT_BITS bytes

    def ids_of(ids: list) -> np.ndarray:
        return np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)

    def pieces_of(rows: pa.Table) -> tuple[list, list[bytes], Corpus, np.ndarray, Pieces]:
        ids, texts = sorted_docs(rows)
        corpus = corpus_of(texts)
        return ids, texts, corpus, ids_of(ids), cut(corpus, window, k, buckets, shared_ranks.value, not across_docs)

    def extremes(numbers: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
        if not len(p.bucket):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return numbers[p.place_doc[p.place_first]], np.maximum.reduceat(numbers[p.place_doc], p.place_first)

    def by_bucket(p: Pieces) -> list[tuple[int, slice]]:
        edges = np.flatnonzero(np.diff(p.bucket, prepend=-1))
        return [(int(p.bucket[a]), slice(a, b)) for a, b in zip(edges, np.append(edges[1:], len(p.bucket)), strict=True)]

    def mail(key: tuple[pa.Scalar, ...], name: str, to: list[int], blobs: list[bytes], what: str) -> pa.Table:
        own = "chunk" if name == "bucket" else "bucket"
        return pa.table({name: pa.array(to, pa.int64()), own: pa.array([key[0].as_py()] * len(to), pa.int64()), what: pa.array(blobs, pa.binary())})

    def announce(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        *_, numbers, p = pieces_of(rows)
        smallest, largest = extremes(numbers, p)
        alone = largest > smallest if across_docs else (p.place_count > 1) | p.twice
        parts = by_bucket(p)
        return mail(key, "bucket", [b for b, _ in parts], [packed(p.tag[part], alone[part].astype(np.uint8)) for _, part in parts], "tags")

    def answer(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        read = [unpacked(blob) for blob in rows.column("tags").to_pylist()]
        _, inverse, often = np.unique(np.concatenate([r[0] for r in read]), return_inverse=True, return_counts=True)
        wanted = (often[inverse] > 1) | (np.concatenate([r[1] for r in read]) != 0)
        ends = np.cumsum([len(r[0]) for r in read])
        masks = [np.flatnonzero(m).astype(np.uint32) for m in np.split(wanted, ends[:-1])]
        to = [(chunk, packed(np.diff(m, prepend=np.uint32(0)))) for chunk, m in zip(rows.column("chunk").to_pylist(), masks, strict=True) if len(m)]
        return mail(key, "chunk", [c for c, _ in to], [blob for _, blob in to], "wanted")

    def send(key: tuple[pa.Scalar, ...], rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not wanted.num_rows:
            return mail(key, "bucket", [], [], "pieces")
        *_, corpus, numbers, p = pieces_of(rows)
        smallest, largest = extremes(numbers, p)
        to, blobs = [], []
        for bucket, blob in zip(wanted.column("bucket").to_pylist(), wanted.column("wanted").to_pylist(), strict=True):
            (steps,) = unpacked(blob)
            at = np.cumsum(steps, dtype=np.int64) + np.searchsorted(p.bucket, bucket)
            length = p.byte_end[at] - p.byte_start[at]
            blobs.append(packed(
                steps, length.astype(np.uint32), p.place_count[at].astype(np.uint32), p.tag[at],
                smallest[at], largest[at] - smallest[at], corpus.data[expand(p.byte_start[at], length)],
            ))
            to.append(bucket)
        return mail(key, "bucket", to, blobs, "pieces")

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        places = sorted(zip(rows.column("chunk").to_pylist(), rows.column("pieces").to_pylist(), strict=True))
        read = [unpacked(blob) for _, blob in places]
        sizes, counts, tags, smallest, spread, data = (np.concatenate(x) for x in list(zip(*read, strict=True))[1:])
        piece, first, many, limit = in_parts(judge, data, sizes.astype(np.int64), counts.astype(np.int64), tags, smallest, smallest + spread)
        ends = np.cumsum([len(r[0]) for r in read])
        edges = np.searchsorted(piece, np.concatenate([[0], ends]))
        to, blobs = [], []
        for i, (chunk, _) in enumerate(places):
            part = slice(edges[i], edges[i + 1])
            if part.start < part.stop:
                here = np.cumsum(read[i][0], dtype=np.int64)
                mine = here[piece[part] - (ends[i] - len(here))]
                to.append(chunk)
                blobs.append(packed(mine.astype(np.uint32), first[part].astype(np.uint32), many[part].astype(np.uint32), limit[part]))
        return mail(key, "chunk", to, blobs, "verdicts")

    def apply(key: tuple[pa.Scalar, ...], rows: pa.Table, verdicts: pa.Table) -> pa.Table:
        if verdicts.num_rows:
            ids, texts, corpus, numbers, p = pieces_of(rows)
        else:
            ids, texts = sorted_docs(rows)
            corpus = corpus_of(texts)
        change = np.zeros(len(corpus.item_start) + 1, dtype=np.int32)
        if verdicts.num_rows:
            for bucket, blob in zip(verdicts.column("bucket").to_pylist(), verdicts.column("verdicts").to_pylist(), strict=True):
                piece, first, many, limit = unpacked(blob)
                piece = piece.astype(np.int64) + np.searchsorted(p.bucket, bucket)
                count = p.place_count[piece]
                place = expand(p.place_first[piece], count)
                begin = p.place_item[place] + np.repeat(first.astype(np.int64), count)
                over = numbers[p.place_doc[place]] > np.repeat(limit, count)
                begin, end = begin[over], (begin + np.repeat(many.astype(np.int64), count) + window - 1)[over]
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
        columns = finish(ids, texts, corpus, np.cumsum(change[:-1]) > 0)
        return pa.table(dict(zip(names, columns, strict=True)))

    chunked = dealt.groupBy("chunk")
    announced = chunked.applyInArrow(announce, "bucket long, chunk long, tags binary")
    answered = announced.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, wanted binary")
    sent = chunked.cogroup(answered.groupBy("chunk")).applyInArrow(send, "bucket long, chunk long, pieces binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "chunk long, bucket long, verdicts binary")
    return chunked.cogroup(met.groupBy("chunk")).applyInArrow(apply, schema)
