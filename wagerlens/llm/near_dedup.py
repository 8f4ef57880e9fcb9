"""Near-duplicate detection by order MinHash and banded alignment.

Words are folded (A-Z lower-cased, between ASCII breaks).  A text's grams are its single words (up to 40
words) or its pairs of neighbours (from 33 words on), each labelled with how often it occurred before in
the text; texts of 33 to 40 words have both.  64 hash functions each have a minimum among the grams; a
sketch is three of these minima in the order in which they stand in the text, and a text has 64 sketches.

Equal texts are one text with many documents from the start.  Texts with a common sketch form a bucket,
and two texts of a bucket are candidates.  First each meets its bucket's smallest text, so that a group of
near copies of any size becomes one class.  Then all texts of a bucket that are still in different classes
meet: of each two classes first the pair that may be nearest, then all pairs that are left.  A bucket of over
BLOCK texts is dealt to pairs of blocks.  One of over LARGE texts (a passage that very many documents share)
is not compared pair by pair: of each of its texts the rarest grams are taken, as many as an edit distance
within the limit can destroy and one more, so that linked texts have one of them in common (the prefix lemma),
and the texts of a rare gram meet instead.  So the classes are those of all candidates.

Candidates carry two summaries that bound their edit distance from below, words counted by hash (an edit
changes one) and a bitmap of labelled pairs of words (an edit changes two), and texts that meet in a bucket the
words in more counters too: of a passage that many texts share, whose own words differ, most pairs end there,
before any text or row of theirs is sent.  What these leave is verified by
alignment of the words, of long texts along common anchors if that stays within the limit, else in bands: a
link is an edit similarity, 1 - edits / words of the longer, of at least 0.8.  Linked texts form classes, by
connected components; links found later join classes, and are looked for and followed only where some are left.

A place in a text counts to 16,777,215: of longer texts the grams beyond have one place, and minima among them
stand in the order of their hashes.

Two texts with the same share s of labelled grams have a given sketch in common with chance s^3.  A
similarity of 0.8 means s of some 0.66 at least for single words and 0.43 for pairs (every fifth word
replaced; 0.47 if scattered).  In a simulation of 200,000 draws no sketch was common to 1.7 % of pairs with
s = 0.43, 0.5 % with 0.47, 0.02 % with 0.55, and to none with 0.667.

Defined results: null and empty texts, and texts without words, are linked to equal texts only; repeated
rows are further documents of their text, and exactly one row of a class is kept, of equal rows the first of
the table as it was read; ties of doc_id are broken so too; a null doc_id ranks after all others; very long
texts are compared whole, in time that grows with words x edits; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FOLD_TABLE, MOST_ROWS, bitmap_of, bitmap_rows, discard, in_bitmap, keep, small_batches, text_bytes, whole_hash, whole_rows
from .components import components, joined_by
from .pieces import RangeHash, expand, mixed
from .substring_dedup import word_corpus

SKETCHES = 64
#: Sketch j takes the minima j, j + 1 and j + 5: no two sketches have more than one in common.
STEPS = (0, 1, 5)
#: Texts of at most SHORT words by single words, those over 0.8 SHORT by pairs: linked texts share a kind.
SHORT = 40
#: Counters of words in the summary that all pairs are judged by, and in that of the texts that meet in buckets.
COUNTERS, WIDE, PAIR_BITS = 128, 1024, 2048
#: Texts that are compared pair by pair in one group, and buckets from which on rare grams take less work than pairs.
BLOCK, LARGE = 512, 8192
#: Buckets of over MANY texts are listed with their texts: a pair that has several of these meets in the first.
MANY = 32
SIMILARITY = 0.8
#: Pairs that are aligned together, and words from which on an alignment along anchors is tried first.
SLICE, ANCHORED = 1024, 400


class Grams:
    """Texts' words and labelled grams: of each kind, the texts that have it, their grams' hashes and counts."""

    def __init__(self, texts: list[bytes]):
        corpus = word_corpus([t.translate(FOLD_TABLE) for t in texts])
        self.words = corpus.last - corpus.first
        self._corpus, self._of = corpus, RangeHash(corpus.data)

    def word_counts(self, counters: int) -> np.ndarray:
        """Each text's words by hash, in so many counters that stop at 255."""
        item = expand(self._corpus.first, self.words)
        kind = (mixed(self._of(self._corpus.item_start[item], self._corpus.item_end[item])) % np.uint64(counters)).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(self.words)), self.words) * counters + kind, minlength=len(self.words) * counters)
        return np.minimum(counts, 255).astype(np.uint8).reshape(len(self.words), counters)

    def labelled(self, k: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the runs of k words of some texts, with their occurrence labels, in text order; how many of each)."""
        many = np.maximum(self.words[some] - k + 1, 0)
        first = expand(self._corpus.first[some], many)
        value = self._of(self._corpus.item_start[first], self._corpus.item_end[first + k - 1])
        doc = np.repeat(np.arange(len(some)), many)
        order = np.lexsort((value, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (value[order[1:]] != value[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        at = np.arange(len(order))
        label = np.empty(len(order), dtype=np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        return mixed(value + label * np.uint64(0x9E3779B97F4A7C15)), many

    def kinds(self) -> list[tuple[int, np.ndarray]]:
        kinds = ((1, (self.words > 0) & (self.words <= SHORT)), (2, self.words * 5 > SHORT * 4))
        return [(k, np.flatnonzero(some)) for k, some in kinds if some.any()]


def sketches_of(grams: Grams, *, sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """(text, its sketches) for each text and kind of gram that it has."""
    owners, made = [], []
    for k, some in grams.kinds():
        value, many = grams.labelled(k, some)
        starts = np.cumsum(many) - many
        place = np.minimum(np.arange(len(value)) - np.repeat(starts, many), (1 << 24) - 1).astype(np.uint64)
        # a minimum is 40 bits of the gram's hash and then its place in the text
        least = np.empty((sketches, len(some)), dtype=np.uint64)
        for j in range(sketches):
            salt = np.uint64((0xD1B54A32D192ED03 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
            hashed = (value ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(29)
            least[j] = np.minimum.reduceat((hashed & np.uint64(0xFFFFFFFFFF000000)) | place, starts)
        placed = (least << np.uint64(40)) | (least >> np.uint64(24))
        out = np.empty((len(some), sketches), dtype=np.uint64)
        for j in range(sketches):
            chosen = np.sort(np.stack([placed[(j + step) % sketches] for step in STEPS]), axis=0)  # in text order
            value = np.full(len(some), 2 * j + k, dtype=np.uint64)
            for minimum in chosen:
                value = mixed(value * np.uint64(3) + (minimum & np.uint64((1 << 40) - 1)))
            out[:, j] = value
        owners.append(some)
        made.append(out)
    if not made:
        return np.empty(0, dtype=np.int64), np.empty((0, sketches), dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(made)


def summaries_of(grams: Grams) -> np.ndarray:
    """Per text its words by hash and, in bits, its labelled pairs of words by hash."""
    every = np.arange(len(grams.words))
    value, many = grams.labelled(2, every)
    bits = np.zeros((len(every), PAIR_BITS), dtype=bool)
    bits[np.repeat(every, many), (value % np.uint64(PAIR_BITS)).astype(np.int64)] = True
    return np.concatenate([grams.word_counts(COUNTERS), np.packbits(bits, axis=1)], axis=1)


def least_edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the edit distances of pairs with summaries x and y."""
    a, b = x[:, :COUNTERS].astype(np.int16), y[:, :COUNTERS].astype(np.int16)
    words = np.maximum(np.maximum(a - b, 0).sum(axis=1), np.maximum(b - a, 0).sum(axis=1))
    p, q = (np.ascontiguousarray(z[:, COUNTERS:]).view(np.uint64) for z in (x, y))
    lost = np.maximum(np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
    return np.maximum(words, (lost + 1) // 2)


def fewest_changes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lower bounds of the edit distances of pairs with word counts x and y: the words that the other text lacks."""
    either = np.maximum(x, y).sum(axis=1, dtype=np.int64)
    return either - np.minimum(x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64))


def _banded(a: list[np.ndarray], b: list[np.ndarray], width: int) -> np.ndarray:
    """Edit distances of pairs along a band of `width` diagonals to either side; right if <= width."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows, span = int(n.max()), 2 * width + 1
    left = np.full((len(a), rows), -1, dtype=np.int32)
    right = np.full((len(a), rows + span + 1), -2, dtype=np.int32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)] = x
        y = y[: rows + width]
        right[i, width : width + len(y)] = y
    far = np.int32(1 << 28)
    offset = np.arange(-width, width + 1, dtype=np.int32)
    cost = np.where(offset >= 0, offset, far)[None, :].repeat(len(a), axis=0).astype(np.int32)
    end = np.clip(m - n + width, 0, span - 1)
    out = np.where(n == 0, m, far).astype(np.int64)
    done_at = {int(i): np.flatnonzero(n == i) for i in np.unique(n) if i}
    for i in range(1, rows + 1):
        step = cost + (right[:, i - 1 : i - 1 + span] != left[:, i - 1 : i])
        np.minimum(step[:, :-1], cost[:, 1:] + 1, out=step[:, :-1])
        if i <= width:
            step[:, : width - i] = far
            step[:, width - i] = i
        step -= offset
        np.minimum.accumulate(step, axis=1, out=step)
        cost = step + offset
        if i in done_at:
            out[done_at[i]] = cost[done_at[i], end[done_at[i]]]
    out[np.abs(m - n) > width] = far
    return out


def edits_within(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> np.ndarray:
    """Edit distance of each pair of word numbers if at most its limit, else -1.

    Common beginnings and ends are cut; pairs whose words alone, whatever their order, differ too much
    are done; the others are aligned in batches along bands that widen until the distance fits.
    """
    out = np.full(len(pairs), -1, dtype=np.int64)
    waiting: dict[int, list[int]] = {}
    cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (x, y) in enumerate(pairs):
        n = min(len(x), len(y))
        odd = np.flatnonzero(x[:n] != y[:n])
        head = int(odd[0]) if len(odd) else n
        x, y = x[head:], y[head:]
        n = min(len(x), len(y))
        odd = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        tail = int(odd[0]) if len(odd) else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not len(x) or not len(y):
            least = max(len(x), len(y))
            out[i] = least if least <= limits[i] else -1
            continue
        kinds, count = np.unique(np.concatenate([x, y]), return_inverse=True)
        mine, theirs = np.bincount(count[: len(x)], minlength=len(kinds)), np.bincount(count[len(x) :], minlength=len(kinds))
        least = max(len(x), len(y)) - int(np.minimum(mine, theirs).sum())
        if max(least, abs(len(x) - len(y))) > limits[i]:
            continue
        cut[i] = (x, y)
        width = 8
        while width < least + 2 or (width < limits[i] and max(len(x), len(y)) < ANCHORED):  # short ones at once
            width *= 2
        waiting.setdefault(min(width, max(limits[i], 1)), []).append(i)
    while waiting:
        width = min(waiting)
        ready = sorted(waiting.pop(width), key=lambda i: len(cut[i][0]))
        room = max(1, 60_000 // (2 * width + 1))
        for low in range(0, len(ready), room):
            part = ready[low : low + room]
            got = _banded([cut[i][0] for i in part], [cut[i][1] for i in part], width)
            for i, d in zip(part, got.tolist(), strict=True):
                if d <= width:
                    out[i] = d if d <= limits[i] else -1
                elif width < limits[i]:
                    waiting.setdefault(min(2 * width, limits[i]), []).append(i)
    return out


def anchored_edits(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the edit distance: the alignment along pairs of neighbours that both have once.

    Of these the ones that stand in the same order on both sides are anchors; what lies between two is
    compared place by place if it is as long on both sides, and taken for all different if not.
    """
    n, m = len(x), len(y)
    if min(n, m) < 2:
        return max(n, m)
    wide = np.int64(max(int(x.max()), int(y.max())) + 1)
    once = []
    for words in (x, y):
        pairs, at, count = np.unique(words[:-1] * wide + words[1:], return_index=True, return_counts=True)
        once.append((pairs[count == 1], at[count == 1]))
    _, a, b = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    a, b = once[0][1][a], once[1][1][b]
    order = np.argsort(a)
    a, b = a[order], b[order]
    same = (b == np.maximum.accumulate(b)) & (b == np.minimum.accumulate(b[::-1])[::-1])
    a, b = np.concatenate([[0], a[same]]), np.concatenate([[0], b[same]])
    long, wide = np.diff(np.append(a, n)), np.diff(np.append(b, m))
    even = long == wide
    different = int((x[expand(a[even], long[even])] != y[expand(b[even], wide[even])]).sum())
    # what follows an anchor begins with a word that both have
    begins = np.minimum(np.minimum(long, wide), 1)
    begins[0] = 0
    return different + int((np.maximum(long, wide) - begins)[~even].sum())


def linked(left: list[bytes], right: list[bytes], similarity: float = SIMILARITY) -> list[bool]:
    """Whether the edit similarity of the folded words of each pair is at least `similarity`.

    Long pairs of which an alignment along common anchors needs few enough edits are linked; all others are
    aligned in bands.
    """
    numbers: dict[bytes, int] = {}
    known: dict[bytes, np.ndarray] = {}

    def numbered(text: bytes) -> np.ndarray:
        got = known.get(text)
        if got is None:
            got = known[text] = np.array([numbers.setdefault(w, len(numbers)) for w in text.translate(FOLD_TABLE).split()], dtype=np.int64)
        return got

    pairs = [(numbered(a), numbered(b)) for a, b in zip(left, right, strict=True)]
    longest = [max(len(a), len(b)) for a, b in pairs]
    limits = [int((1 - similarity) * n + 1e-9) for n in longest]
    out = [n >= ANCHORED and anchored_edits(a, b) <= most for (a, b), n, most in zip(pairs, longest, limits, strict=True)]
    rest = [i for i, n in enumerate(longest) if n and not out[i]]
    for i, d in zip(rest, edits_within([pairs[i] for i in rest], [limits[i] for i in rest]).tolist(), strict=True):
        out[i] = d >= 0
    return out


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                found = linked([text_bytes(t) for t in part.column(2)], [text_bytes(t) for t in part.column(3)], similarity)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(found))

    return verify


def _in_parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, or of one text."""
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= most):
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


def _sketched(rows: DataFrame, sketches: int) -> DataFrame:
    """Per row (node, text) with words: node, its sketches, n_words, its summary, and its words in WIDE counters."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = batch.column(0), [text_bytes(t) for t in batch.column(1)]
            for low, high in _in_parts(texts):
                grams = Grams(texts[low:high])
                owner, made = sketches_of(grams, sketches=sketches)
                summary, wide = summaries_of(grams), grams.word_counts(WIDE)
                order = np.argsort(owner, kind="stable")
                real, kinds = np.unique(owner, return_counts=True)
                ends = np.concatenate([[0], np.cumsum(kinds * sketches)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        nodes.slice(low, high - low).take(pa.array(real)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(made[order].view(np.int64).ravel())),
                        pa.array(grams.words[real], pa.int32()),
                        pa.array([c.tobytes() for c in summary[real]], pa.binary()),
                        pa.array([c.tobytes() for c in wide[real]], pa.binary()),
                    ],
                    ["node", "sketches", "n_words", "summary", "wide"],
                )

    return rows.mapInArrow(sketch, "node binary, sketches array<long>, n_words int, summary binary, wide binary")


def _summaries(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _limits(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return np.floor(np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)


def _near_enough(similarity: float):
    """Of pairs (a, b, words_a, words_b, summary_a, summary_b) those whose summaries allow a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                n, m = part.column(2).to_numpy(), part.column(3).to_numpy()
                least = np.maximum(np.abs(n - m), least_edits(_summaries(part.column(4)), _summaries(part.column(5))))
                yield part.select(["a", "b"]).filter(pa.array(least <= _limits(n, m, similarity)))

    return near


def _earlier(listed: pa.Array, cell: int) -> np.ndarray:
    """In bits, which of the listed buckets before cell each text has; those of one text only are left out."""
    owner = np.repeat(np.arange(len(listed)), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    bucket = listed.flatten().to_numpy(zero_copy_only=False)
    owner, bucket = owner[bucket < cell], bucket[bucket < cell]
    _, which, texts = np.unique(bucket, return_inverse=True, return_counts=True)
    number = np.cumsum(texts > 1) - 1
    several = texts[which] > 1
    bits = np.zeros((len(listed), max(int((texts > 1).sum()), 1)), dtype=bool)
    bits[owner[several], number[which[several]]] = True
    return np.packbits(bits, axis=1)


def _meet(similarity: float):
    """Of a cell's texts the pairs in different classes whose summaries allow a link, but those that an earlier
    listed bucket has too.  A cell has one block of a bucket, or two of which each text meets the other's."""

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        cell, low, high = (k.as_py() for k in key)
        rows = rows.sort_by("n_words")
        keys, roots, n, own = (rows.column(c).to_numpy() for c in ("key", "root", "n_words", "own"))
        summary, wide = (_summaries(rows.column(c).combine_chunks()) for c in ("summary", "wide"))
        earlier = _earlier(rows.column("listed").combine_chunks(), cell)
        found = [np.empty((3, 0), dtype=np.int64)]
        for i in range(len(keys)):
            # only texts that are not too long, and come later in the order of length
            end = int(np.searchsorted(n, n[i] / similarity + 1, side="right"))
            others = np.arange(i + 1, end)
            others = others[(roots[others] != roots[i]) & ((own[others] != own[i]) if low < high else (keys[others] != keys[i]))]
            others = others[~(earlier[i] & earlier[others]).any(axis=1)]
            if len(others):
                least = np.maximum(least_edits(summary[i][None, :], summary[others]), n[others] - n[i])
                most = _limits(n[others], n[i], similarity)
                near = least <= most
                others, least, most = others[near], least[near], most[near]
                least = np.maximum(least, fewest_changes(wide[i][None, :], wide[others]))
                near = least <= most
                others, least = others[near], least[near]
                found.append(np.stack([np.minimum(keys[i], keys[others]), np.maximum(keys[i], keys[others]), least]))
        return pa.table(dict(zip(("a", "b", "least"), (pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)), strict=True)))

    return meet


def _node():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("node")


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("place").alias("place"))


def _key(name: str):
    """A node in 8 bytes; pairs of keys become nodes again, all that have the key, before they are verified."""
    return F.xxhash64(name)


def _rare_grams(nodes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(cell, key) of the rarest grams of the texts of nodes (key, node): linked texts have one in common.

    A text of n words loses at most k grams with an edit, of which a link has e at most, e = (1 - similarity)
    / similarity * n if the other is longer.  So k e + 1 of its grams, in an order that is the same for all
    texts, are enough; the order is by the number of these texts that have a gram.
    """
    loss = (1 - similarity) / similarity

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), [text_bytes(t) for t in batch.column(1)]
            for low, high in _in_parts(texts):
                grams = Grams(texts[low:high])
                for k, some in grams.kinds():
                    value, many = grams.labelled(k, some)
                    most = k * np.floor(grams.words[some] * loss + 1e-9).astype(np.int64) + 1
                    value = mixed(value + np.uint64(k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(keys[low:high][some], many)), pa.array(np.full(len(value), k, dtype=np.int32)), pa.array(np.repeat(most, many)), pa.array(value)],
                        ["key", "kind", "most", "cell"],
                    )

    wanted = nodes.select("key", F.col("node").alias("wanted"))
    texts = docs.select(_node(), "text").join(wanted, F.col("node") == F.col("wanted")).groupBy("key").agg(F.first("text").alias("text"))
    grams = keep(texts.mapInArrow(grams_of, "key long, kind int, most long, cell long"))
    often = grams.groupBy("cell").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("key", "kind").orderBy("n", "cell")  # the grams of one text
    return grams.join(often, "cell").withColumn("at", F.row_number().over(rarest)).filter(F.col("at") <= F.col("most")).select("cell", "key")


def _by_key(roots: DataFrame) -> DataFrame:
    """(key, root) of (node, root)."""
    return roots.select(_key("node").alias("key"), _key("root").alias("root"))


def _apart(members: DataFrame, roots: DataFrame, facts: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of keys that share a bucket, are not in one class of links, and may be near enough, with the
    least number of edits between them.

    members has sketch, key and n, the bucket's size; facts has node, key, n_words, summary, wide.
    """
    placed = keep(members.join(roots, "key", "left").select("sketch", "key", "n", F.coalesce("root", "key").alias("root")))
    several = placed.groupBy("sketch").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("sketch")
    split = keep(placed.join(several, "sketch"))
    cells = split.filter(F.col("n") <= LARGE).select(F.col("sketch").alias("cell"), "key", "root")
    hot = keep(split.filter(F.col("n") > LARGE).select("key", "root").distinct())
    if not hot.isEmpty():
        cells = cells.unionByName(_rare_grams(facts.join(hot, "key").select("key", "node"), docs, similarity).join(hot, "key").select("cell", "key", "root"))
    cells = keep(cells)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    listed = split.filter(F.col("n").between(MANY + 1, LARGE)).groupBy("key").agg(F.collect_list("sketch").alias("listed"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = cells.join(sizes.select("cell", "n"), "cell").join(facts.drop("node").join(listed, "key", "left"), "key").select("*", F.pmod(F.xxhash64("key"), blocks).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", "root", "n_words", "own", "summary", "wide", "listed")
    return dealt.groupBy("cell", "low", "high").applyInArrow(_meet(similarity), "a long, b long, least long").distinct()


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of keys whose classes, low and high, still differ."""
    side = lambda s: roots.select(F.col("key").alias(s), F.col("root").alias(f"root_{s}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    one, two = F.coalesce("root_a", "a"), F.coalesce("root_b", "b")
    return rows.select(*[F.col(c) for c in pairs.columns], F.least(one, two).alias("low"), F.greatest(one, two).alias("high")).filter("low < high")


def _logged(docs: DataFrame) -> DataFrame:
    """doc_id, node and place of each row, written once so that a row's place is the same for all its readers."""
    return keep(docs.select("doc_id", _node(), F.monotonically_increasing_id().alias("place")))


def links(docs: DataFrame, log: DataFrame | None = None, *, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, links, roots): texts has node (digest of the text), best (its smallest document), n; links has pairs
    (a, b) of different texts, enough of them for the classes of all candidates; roots has (node, root) of their classes."""
    small_batches(docs.sparkSession)
    log = _logged(docs) if log is None else log
    texts = keep(log.groupBy("node").agg(F.min(_rank()).alias("best"), F.count("*").alias("n")))
    sketched = _sketched(docs.select(_node(), "text"), sketches).groupBy("node")
    sketched = keep(sketched.agg(*[F.first(c).alias(c) for c in ("sketches", "n_words", "summary", "wide")]))
    facts = keep(sketched.select("node", _key("node").alias("key"), "n_words", "summary", "wide"))
    rows = sketched.select(_key("node").alias("key"), F.explode("sketches").alias("sketch"))
    leaders = rows.groupBy("sketch").agg(F.min("key").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    members = keep(rows.join(leaders, "sketch"))
    discard(sketched)

    def compared(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b) of keys, a written table."""
        if pairs.isEmpty():
            return docs.sparkSession.createDataFrame([], "a binary, b binary")
        wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        chosen = texts.withColumn("key", _key("node")).join(wanted, "key").select(F.col("node").alias("wanted"), F.col("best.doc_id").alias("best_id"))
        chosen = keep(chosen)
        size = min(bitmap_rows(chosen.count()), MOST_ROWS)
        bits = F.broadcast(keep(bitmap_of(chosen, "wanted", size)))  # MOST_ROWS rows of 4 KB at most
        d = in_bitmap(docs.select("doc_id", "text", _node()), "node", bits, size)  # other texts don't travel
        found = d.join(chosen, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
        candidates = keep(found.groupBy("node").agg(F.first("text").alias("text")))
        first = candidates.select(_key("node").alias("a"), F.col("node").alias("node_a"), F.col("text").alias("text_a"))
        second = candidates.select(_key("node").alias("b"), F.col("node").alias("node_b"), F.col("text").alias("text_b"))
        both = pairs.join(first, "a").join(second, "b").select("node_a", "node_b", "text_a", "text_b")
        found = keep(both.mapInArrow(_verify(similarity), "a binary, b binary"))
        discard(candidates)
        return found

    led = keep(members.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct())
    side = lambda s: facts.select(F.col("key").alias(s), F.col("n_words").alias(f"words_{s}"), F.col("summary").alias(f"summary_{s}"))
    near = led.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "words_b", "summary_a", "summary_b")
    near = keep(near.mapInArrow(_near_enough(similarity), "a long, b long"))
    first = compared(near)
    roots = keep(components(first))
    met = _apart(members.select("sketch", "key", "n"), _by_key(roots), facts, docs, similarity)
    discard(led)
    met = keep(met.join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    # of each two classes the pair that may be nearest goes first; what that joins needs no other pair
    nearest = _between(met, _by_key(roots)).groupBy("low", "high").agg(F.min(F.struct("least", "a", "b")).alias("pair")).select("pair.a", "pair.b")
    nearest = keep(nearest)
    second = compared(nearest)
    roots = joined_by(roots, second)
    rest = keep(_between(met.join(nearest, ["a", "b"], "left_anti"), _by_key(roots)).select("a", "b"))
    third = compared(rest)
    return texts, first.unionByName(second).unionByName(third), joined_by(roots, third)


def classes(docs: DataFrame, log: DataFrame | None = None, *, similarity: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """Per different text: node, best (document), class_best (the class's smallest document), n_found_links, class_size."""
    texts, found, roots = links(docs, log, similarity=similarity, sketches=sketches)
    # both are written, so that a class of very many texts is split in the join of the two
    rooted = keep(texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node"))))
    heads = keep(rooted.groupBy("root").agg(F.min("best").alias("class_best"), F.sum("n").alias("class_size")))
    many = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_found_links"))
    return (
        rooted.join(heads, "root")
        .join(many, "node", "left")
        .select("node", "best", "class_best", "class_size", F.coalesce("n_found_links", F.lit(0)).alias("n_found_links"))
    )


def near_dedup(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id (smallest doc_id of its class), class_size (documents), n_found_links (links
    of its text that were verified: enough to join its class, not all that exist), kept (it is the row that stays)."""
    log = _logged(docs)
    of_text = keep(classes(docs, log, similarity=similarity))
    return log.join(of_text, "node").select(
        "doc_id",
        F.col("class_best.doc_id").alias("class_id"),
        "class_size",
        "n_found_links",
        (_rank() == F.col("class_best")).alias("kept"),
    )


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the smallest doc_id's, with its columns unchanged."""
    heads = classes(docs, similarity=similarity).filter(F.col("best") == F.col("class_best"))
    heads = keep(heads.select(F.col("node").alias("head"), F.col("best.doc_id").alias("head_id")).dropDuplicates(["head"]))
    rows = whole_rows(docs, F.col("doc_id").alias("own_id"), _node(), whole_hash(docs).alias("tie"))
    joined = rows.join(heads, (F.col("node") == F.col("head")) & F.col("own_id").eqNullSafe(F.col("head_id")))
    return joined.groupBy("node").agg(F.min_by("row", "tie").alias("row")).select("row.*")
