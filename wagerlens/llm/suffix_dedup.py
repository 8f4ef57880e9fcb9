"""Suffix-array deduplication: bytes covered by a string that an earlier document has too.

Texts are cut into pieces by content (see pieces.py), so that equal strings of `length` bytes are always
in one bucket.  A bucket's pieces, one copy for each chunk of documents that has it, are split into shards of
bounded size.  Equal pieces of several chunks are one piece there.  Pieces none of whose strings' hashes occur
twice, and which stand in one document only, are proved to repeat nothing and left out; suffix arrays decide all
others.  Each shard gets a
suffix array by Larsson-Sadakane refinement (groups by the first 5 bytes, then unsorted groups only,
doubling the sorted depth by the ranks there; a suffix ends with its piece) and its common prefixes by
Kasai's relation: they are compared only where the byte before differs and carried on, less one, elsewhere.
Neighbours with common prefixes of at least `length` have the same string; shards are merged by binary search
of one's strings among another's.  Each string's smallest document then decides: later documents lose its
bytes.

Defined results: null text is empty; strings are judged on the input and never cross documents; rows of
one doc_id do not count against each other; a null doc_id ranks after all others, and such rows not against
each other; repeated rows lose the same bytes; a very long text is cut whole, in a worker with some 60 bytes
of memory for each of its bytes; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Corpus, RangeHash, exchange, expand, may_repeat, runs_of

LENGTH, K = 50, 20
SHARD_BYTES = 1 << 18


def byte_corpus(texts: list[bytes]) -> Corpus:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    last = np.cumsum([len(t) for t in texts], dtype=np.int64)
    at = np.arange(len(data) + 1, dtype=np.int64)
    return Corpus(data, at[:-1], at[1:], np.concatenate([[0], last[:-1]]).astype(np.int64) if len(last) else last, last)


def _heads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as numbers in the bytes' order; zeros beyond the end."""
    wide = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype=">u8", buffer=wide, strides=(1,)).astype(np.uint64)


#: Suffixes of shards of up to 2 ** PLACE_BITS bytes are sorted as whole numbers that end with their places.
PLACE_BITS, FIRST = 20, 5


def _by_rank(group: np.ndarray, follow: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, group, follow) in order of group, follow and place."""
    if n <= 1 << PLACE_BITS:
        key = (group.astype(np.int64) << (2 * PLACE_BITS + 1)) | (follow.astype(np.int64) << PLACE_BITS) | places
        key.sort()
        return (key & ((1 << PLACE_BITS) - 1)).astype(np.int32), key >> (2 * PLACE_BITS + 1), (key >> PLACE_BITS) & ((2 << PLACE_BITS) - 1)
    by = np.lexsort((places, follow, group))
    return places[by], group[by], follow[by]


def suffix_array(data: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes in order; a suffix stands before those that it begins, equal ones by place.

    end: where each place's piece ends, and with it the suffix.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    room = (n if end is None else end) - np.arange(n)
    # the first bytes, padded with zeros, which may equal zero bytes: the shorter go first
    near = np.minimum(room, FIRST)
    head = (_heads(data) >> (64 - 8 * near).astype(np.uint64)).astype(np.int64) << (8 * (FIRST - near) + 3) | near
    if n <= 1 << PLACE_BITS:
        key = (head << PLACE_BITS) | np.arange(n)
        key.sort()
        order, key = (key & ((1 << PLACE_BITS) - 1)).astype(np.int32), key >> PLACE_BITS
    else:
        order = np.argsort(head, kind="stable")
        key = head[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    short = (key & 7) < FIRST  # equal ones among these are in order already
    new |= short
    # the rank of a suffix is the first place of its group
    rank = np.empty(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=rank.dtype), 0))
    depth = FIRST
    while True:
        lone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~lone)
        if not len(open_at):
            return order
        places = order[open_at]
        follow = np.where(room[places] > depth, rank[np.minimum(places + depth, n - 1)] + 1, 0)
        places, group, follow = _by_rank(rank[places], follow, places, n)
        order[open_at] = places
        fresh = follow == 0  # ended: equal suffixes stay in order of place
        fresh[0] = True
        fresh[1:] |= (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[open_at] = fresh
        open_at = open_at.astype(rank.dtype)
        rank[places] = np.maximum.accumulate(np.where(fresh, open_at, open_at.dtype.type(0)))
        depth *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
    """For each place in the suffix array, the common prefix with its predecessor there."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.int64)
    end = np.full(n, n) if end is None else end
    first = np.ones(n, dtype=bool)  # of its piece
    first[1:] = end[1:] != end[:-1]
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    prior = np.where(first, -1, data[np.maximum(place - 1, 0)].astype(np.int16))
    theirs = np.where((before < 0) | first[before], -2, data[np.maximum(before - 1, 0)].astype(np.int16))
    measured = np.flatnonzero((before >= 0) & (prior != theirs))
    wide = np.append(_heads(data), np.uint64(0))
    left, right = measured, before[measured]
    length = np.zeros(len(measured), dtype=np.int64)
    going = np.arange(len(measured))
    while len(going):  # 8 bytes at once, while both have so many
        a, b = left[going] + length[going], right[going] + length[going]
        going = going[(wide[a] == wide[b]) & (np.minimum(end[left[going]] - a, end[right[going]] - b) >= 8)]
        length[going] += 8
    a, b = left + length, right + length
    odd = wide[a] ^ wide[b]
    # leading bytes in which they agree
    same = sum((odd < np.uint64(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 9))
    length += np.minimum(same, np.minimum(end[left] - a, end[right] - b))
    known = np.full(n, np.iinfo(np.int64).min // 2, dtype=np.int64)
    known[measured] = length + measured
    known[before < 0] = place[before < 0]
    return np.maximum(np.maximum.accumulate(known) - place, 0)[order]


def strings_of_shard(data: np.ndarray, end: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the strings of `length` bytes at valid places, in order: (places by order, their number)."""
    order = suffix_array(data, end)
    apart = common_prefixes(data, order, end) < length
    number = np.cumsum(apart) - 1
    real = valid[order]
    number = number[real]  # ascending
    return order[real], np.cumsum(np.diff(number, prepend=number[:1]) > 0)


def equal_pieces(data: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first piece of each different string, which of these each piece equals); equal hashes are compared
    byte by byte, and a piece of another string than its hash's first one stays its own."""
    start = np.cumsum(sizes) - sizes
    order = np.lexsort((sizes, hashes))  # stable
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (sizes[order[1:]] != sizes[order[:-1]])
    again = np.flatnonzero(~new)
    mine, theirs = order[again], order[new][np.cumsum(new) - 1][again]
    differs = data[expand(start[mine], sizes[mine])] != data[expand(start[theirs], sizes[mine])]
    alike = np.ones(len(mine), dtype=bool)
    alike[np.repeat(np.arange(len(mine)), sizes[mine])[differs]] = False
    head = np.arange(len(sizes))
    head[mine[alike]] = theirs[alike]
    return np.unique(head, return_inverse=True)


def judge_strings(length: int, shard_bytes: int):
    """Runs of strings whose smallest document is under the largest that has the piece, by suffix arrays.

    Equal pieces of several chunks stand in the arrays once, with the smallest and largest document of all.
    """

    def judge(data, sizes, counts, smallest, largest):
        start, hashes_of = np.cumsum(sizes) - sizes, RangeHash(data)
        one, same = equal_pieces(data, sizes, hashes_of(start, start + sizes))
        low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(low, same, smallest)
        np.maximum.at(high, same, largest)
        windows = np.maximum(sizes[one] - length + 1, 0)
        at = expand(start[one], windows)
        some = may_repeat(hashes_of(at, at + length), np.repeat(np.arange(len(one)), windows), low < high)
        chosen = one[some]
        piece, first, many, least = _indexed(data[expand(start[chosen], sizes[chosen])], sizes[chosen], low[some], high[some], length, shard_bytes)
        # a run holds for every piece of its string that has a document over its smallest
        found = np.bincount(some[piece], minlength=len(one))
        runs = expand((np.cumsum(found) - found)[same], found[same])
        owner = np.repeat(np.arange(len(sizes)), found[same])
        real = least[runs] < largest[owner]
        runs, owner = runs[real], owner[real]
        return owner, first[runs], many[runs], least[runs]

    return judge


def _indexed(data: np.ndarray, sizes: np.ndarray, smallest: np.ndarray, largest: np.ndarray, length: int, shard_bytes: int) -> tuple[np.ndarray, ...]:
    """The runs of pieces that may share strings: suffix arrays of their shards, merged."""
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    end = ends[piece]
    at = np.arange(len(data), dtype=np.int64) - (end - sizes[piece])
    valid = at + length <= sizes[piece]
    least = np.full(len(data), np.iinfo(np.int64).max)
    shard = (ends - 1) // shard_bytes
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(sizes))
    shards = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        a, b = ends[low] - sizes[low], ends[high - 1]
        places, number = strings_of_shard(data[a:b], end[a:b] - a, valid[a:b], length)
        if len(places):
            places = places + a
            first = np.flatnonzero(np.diff(number, prepend=-1))
            shards.append([places, number, places[first], np.minimum.reduceat(smallest[piece[places]], first)])
    if len(shards) > 1:
        _merge(shards, data, length)
    for places, number, _, best in shards:
        least[places] = best[number]
    hit = np.flatnonzero(valid & (least < largest[piece]))
    begins, many = runs_of(piece[hit], hit, least[hit])
    head = hit[begins]
    return piece[head].astype(np.int64), at[head], many, least[head]


def _merge(shards: list[list[np.ndarray]], data: np.ndarray, length: int) -> None:
    """Give strings that several shards have their smallest document: each shard's strings are sorted, so
    one shard's are searched among another's by bisection."""
    view = np.lib.stride_tricks.sliding_window_view(data, length)

    def keys(places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(view[places]).view(f"S{length}").ravel()

    for i in range(len(shards)):
        own = keys(shards[i][2])
        for j in range(i):
            theirs = keys(shards[j][2])
            spot = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
            mine = np.flatnonzero(theirs[spot] == own)
            best = np.minimum(shards[i][3][mine], shards[j][3][spot[mine]])
            shards[i][3][mine] = best
            shards[j][3][spot[mine]] = best


def _finish(ids, texts, corpus: Corpus, marked: np.ndarray, with_text: bool) -> list[pa.Array]:
    total = np.concatenate([[0], np.cumsum(marked)])
    lost = total[corpus.last] - total[corpus.first]
    begins = np.flatnonzero(marked & ~np.concatenate([[False], marked[:-1]])) if len(marked) else np.empty(0, dtype=np.int64)
    starts = np.searchsorted(begins, corpus.first), np.searchsorted(begins, corpus.last)
    spans = starts[1] - starts[0]
    # a run that goes on from the end of the document before starts anew here
    into = (corpus.first > 0) & (corpus.last > corpus.first)
    here, prior = np.minimum(corpus.first, max(len(marked) - 1, 0)), np.maximum(corpus.first - 1, 0)
    if len(marked):
        spans = spans + (into & marked[here] & marked[prior])
    kept = []
    for i, text in enumerate(texts):
        if lost[i]:
            part = slice(corpus.first[i], corpus.last[i])
            text = corpus.data[part][~marked[part]].tobytes()
        kept.append(text)
    return [
        pa.array(ids, pa.int64()), pa.array(corpus.last - corpus.first, pa.int64()), pa.array(lost, pa.int64()),
        pa.array(spans, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
        pa.array(kept if with_text else [None] * len(kept), pa.binary()),
    ]


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, k: int = K, shard_bytes: int = SHARD_BYTES, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay; null unless with_text)."""
    return exchange(
        docs, byte_corpus, judge_strings(length, shard_bytes), partial(_finish, with_text=with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
        window=length, k=k, across_docs=True,
    )
