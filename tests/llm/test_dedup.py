import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows, same_as_sql
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wagerlens.llm import common, exact_dedup, near_dedup, pieces, queries, substring_dedup, suffix_dedup
from wagerlens.llm.components import components, joined_by

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, chunk string, tag long, row string, digest string, node int, size int"


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, "r", "d", 3, 4) for i, t in pairs], SCHEMA)


def cases():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages, runs of one word."""
    shared, long = text(1, 60), text(2, 30_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, text(3, 20)), (5, shared + " a " + text(4, 50)), (6, text(5, 40) + "\n" + shared), (6, text(5, 40) + "\n" + shared),
        (None, shared), (8, long), (9, long[: len(long) // 2] + " z " + shared), (10, "go " * 120), (11, "éà " * 60 + "Ω" * 50), (12, "éà " * 60), (13, "a\x1fb\xa0c " * 30), (14, "x"), (14, "y"), (15, "\x00" * 200), (16, "\x00" * 120 + "q" * 80),
        (17, "abcde" * 400), (18, text(6, 36)), (19, text(6, 36)), (20, text(6, 35)), (None, None),
    ]


def brute_substring(pairs, n=35):
    split = [(t or "").encode().split() for _, t in pairs]
    seen = Counter(tuple(w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(pairs, split, strict=True):
        gone = {p for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup_equals_brute_force(spark):
    got = rows(substring_dedup.substring_dedup(docs_of(spark, cases())))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute_substring(cases())
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def brute_suffix(pairs, n=50):
    top = float("inf")
    raw = [((top if i is None else i), i, (t or "").encode()) for i, t in pairs]
    first = {}
    for key, _, t in raw:
        for k in range(len(t) - n + 1):
            s = t[k : k + n]
            first[s] = min(first.get(s, top), key)
    out = []
    for key, i, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - n + 1):
            if first[t[k : k + n]] < key:
                gone[k : k + n] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [2 << 20, 300])
def test_suffix_dedup_equals_brute_force(spark, shard_bytes):
    data = [(i, t if t is None else t[:40_000]) for i, t in cases()]
    got = rows(suffix_dedup.suffix_dedup(docs_of(spark, data), shard_bytes=shard_bytes))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute_suffix(data)


def test_many_chunks_and_buckets_give_the_same(spark):
    data = [(i, text(i % 40, 90) + " " + text(100, 70) * (i % 3 == 0)) for i in range(200)]
    exchange = pieces.exchange

    def small(*args, **more):
        return exchange(*args, chunk_bytes=8_000, bucket_bytes=5_000, **more)

    for module, brute, run in ((substring_dedup, brute_substring, substring_dedup.substring_dedup), (suffix_dedup, brute_suffix, suffix_dedup.suffix_dedup)):
        module.exchange = small
        try:
            got = rows(run(docs_of(spark, data)))
        finally:
            module.exchange = exchange
        names = [n for n in ("doc_id", "n_words", "n_bytes", "n_removed", "n_spans", "kept_sha256") if n in got[0]]
        assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute(data)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.lists(st.sampled_from([0, 1, 97]), max_size=400).map(bytes))
def test_suffix_array_and_common_prefixes(raw):
    data = np.frombuffer(raw, dtype=np.uint8)
    order = suffix_dedup.suffix_array(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffix_dedup.common_prefixes(data, order)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k] == n


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 97]), min_size=1, max_size=70).map(bytes), min_size=1, max_size=12))
def test_suffixes_end_with_their_pieces(parts):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    end = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
    raw = data.tobytes()
    order = suffix_dedup.suffix_array(data, end)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : end[i]], i))
    common = suffix_dedup.common_prefixes(data, order, end)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1] : end[order[k - 1]]], raw[order[k] : end[order[k]]]
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert common[k] == n


def test_every_removed_byte_comes_from_the_suffix_arrays(spark, monkeypatch):
    """Without the arrays nothing is removed: no other path decides."""
    monkeypatch.setattr(suffix_dedup, "strings_of_shard", lambda data, end, valid, length: (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)))
    judge = suffix_dedup.judge_strings(50, 1 << 20)
    data = np.frombuffer(text(1, 40).encode() * 2, dtype=np.uint8)
    n = len(data) // 2
    facts = (np.array([n, n]), np.array([1, 3]), np.array([1, 2]), np.array([1, 9]))
    assert len(judge(data, *facts)[0]) == 0
    monkeypatch.undo()
    piece, first, many, least = judge(data, *facts)
    assert piece.tolist() == [1] and first.tolist() == [0] and many.tolist() == [n - 49] and least.tolist() == [1]


def test_equal_pieces_of_many_chunks_stand_in_the_suffix_arrays_once(monkeypatch):
    seen, plain = [], suffix_dedup.strings_of_shard
    monkeypatch.setattr(suffix_dedup, "strings_of_shard", lambda data, *more: seen.append(len(data)) or plain(data, *more))
    one, two = text(1, 30).encode(), text(2, 30).encode()
    pieces = [one, two, one, one + two[:60], two, one]
    smallest, largest = np.array([5, 8, 1, 7, 8, 0]), np.array([5, 8, 4, 7, 8, 0])
    judge = suffix_dedup.judge_strings(50, 1 << 20)
    piece, first, many, least = judge(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces]), np.ones(6, dtype=int), smallest, largest)
    assert sum(seen) == len(one) + len(two) + len(one + two[:60])
    windows = len(one) - 49
    assert list(zip(piece.tolist(), first.tolist(), many.tolist(), least.tolist(), strict=True)) == [(0, 0, windows, 0), (1, 0, 11, 7), (2, 0, windows, 0), (3, 0, windows, 0), (4, 0, 11, 7)]


def test_pieces_of_one_hash_are_told_apart():
    pieces = [b"aaa", b"bbb", b"aaa", b"bbb", b"aa"]
    one, same = suffix_dedup.equal_pieces(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([3, 3, 3, 3, 2]), np.zeros(5, dtype=np.uint64))
    assert [pieces[one[i]] for i in same] == pieces and same[0] == same[2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(1, 40))
def test_window_numbers(ids, window):
    got = substring_dedup.window_numbers(np.array(ids), window)
    texts = [tuple(ids[k : k + window]) for k in range(len(ids) - window + 1)]
    assert len(got) == max(len(texts), 0) and all((got[i] == got[j]) == (texts[i] == texts[j]) for i in range(len(texts)) for j in range(i))


def test_packing_round_trip():
    arrays = [np.array([], dtype=np.uint32), np.arange(5, dtype=np.int64) * -7, np.array([1, 255], dtype=np.uint8)]
    got = pieces.unpacked(pieces.packed(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, got, strict=True))


def test_exact_dedup(spark):
    data = [(5, "a  b"), (3, "a\tb"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (None, "a b"), (None, None), (7, "Long " * 40_000), (8, "Long\n" * 40_000)]
    got = rows(exact_dedup.exact_dedup(docs_of(spark, data)))
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    ab = by[hashlib.sha256(b"a b").hexdigest()]
    assert {r["keep_id"] for r in ab} == {3} and all(r["group_size"] == 4 for r in ab) and [r["doc_id"] for r in ab if r["kept"]] == [3]
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {1} and len(by) == 4 and len(got) == len(data)
    assert [r["doc_id"] for r in by[hashlib.sha256(b"a b ").hexdigest()]] == [9]


def test_index_probes_older_runs_and_compacts_levels(spark):
    index = exact_dedup.DigestIndex(spark, fanout=2)
    found = []
    for batch in ([(5, 1, b"a"), (6, 2, b"b")], [(2, 3, b"a"), (3, 9, b"e")], [(9, 4, b"c"), (1, 5, b"b"), (8, 6, b"c")], [(4, 7, b"d")], [(7, 8, b"d")]):
        found.append({bytes(r["digest"]) for r in index.insert(spark.createDataFrame(batch, "doc_id long, row long, digest binary")).collect()})
    assert found == [set(), {b"a"}, {b"b", b"c"}, set(), {b"d"}]
    assert [len(level) for level in index.levels] == [1, 0, 1]
    hits = spark.createDataFrame([(d,) for d in set().union(*found)], "digest binary")
    got = {bytes(r["digest"]): (r["best"]["doc_id"], r["n"]) for r in index.groups(hits).collect()}
    assert got == {b"a": (2, 2), b"b": (1, 2), b"c": (8, 2), b"d": (4, 2)}


def test_filters_pass_what_they_were_built_of_and_little_else(spark):
    digests = lambda low, high: spark.range(low, high).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    n = 5_000
    rows = common.bitmap_rows(n)
    bits = common.bitmap_of(digests(0, n), "digest", rows)
    assert common.in_bitmap(digests(0, n), "digest", bits, rows).count() == n
    assert common.in_bitmap(digests(n, 3 * n), "digest", bits, rows).count() < 0.1 * 2 * n


def test_exact_dedup_over_many_memtables_equals_brute_force(spark):
    rng = random.Random(8)
    data = [(rng.randrange(300) if rng.random() < 0.9 else None, rng.choice([None, "", "a  b", "a\nb", f"t{rng.randrange(150)}  x", "hot copy"])) for _ in range(600)]
    df = docs_of(spark, data).repartition(12, F.rand(1))
    got = rows(exact_dedup.exact_dedup(df, memtable_rows=25, fanout=3))
    norm = lambda t: " ".join((t or "").split(" ")) if t is None else __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    key = lambda i: (i is None, i or 0)
    wanted = sorted(((i, min(groups[norm(t)], key=key), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in data), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == wanted
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def edited(base, seed, share):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())


def brute_classes(pairs):
    """Components over all pairs of different texts with edit similarity of at least 0.8, by plain dynamic programming."""
    texts = sorted({t or "" for _, t in pairs})
    fold = {t: t.encode().translate(near_dedup.FOLD_TABLE).split() for t in texts}

    def close(a, b):
        x, y = fold[a], fold[b]
        n = max(len(x), len(y))
        if not x or not y or abs(len(x) - len(y)) > 0.2 * n:
            return False
        line = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (w != v)))
            line = new
        return line[-1] <= int(0.2 * n + 1e-9)

    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if find(a) != find(b) and close(a, b):
                root[find(a)] = find(b)
    groups = {}
    for i, t in pairs:
        groups.setdefault(find(t or ""), []).append(i)
    return sorted(sorted(g, key=repr) for g in groups.values())


def near_cases():
    base = [text(50 + k, 120) for k in range(4)]
    data = [(100 * k + j, edited(base[k], 9 * j, 0.02) if j else base[k]) for k in range(4) for j in range(7)]
    passage = text(77, 60)
    data += [(1000 + i, passage + " " + text(500 + i, 110)) for i in range(15)]
    return data + [(2000, None), (2001, ""), (2002, "..."), (2003, "one two"), (2004, "One, two!"), (2005, base[0]), (2005, base[0]), (2006, text(90, 6_000)), (2007, edited(text(90, 6_000), 5, 0.01)), (None, base[1])]


def test_near_dedup_equals_brute_force(spark):
    data = [p for p in near_cases() if p[0] not in (2006, 2007)]
    got = {}
    for r in rows(near_dedup.near_dedup(docs_of(spark, data))):
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(g, key=repr) for g in got.values()) == brute_classes(data)


def test_near_dedup_keeps_one_row_with_its_columns(spark):
    df = docs_of(spark, near_cases())
    found = rows(near_dedup.near_dedup(df))
    assert {r["class_id"] for r in found if r["doc_id"] == 2007} == {2006}
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({r["class_id"] for r in found})


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = text(7, 150)
    data = [(i, edited(base, i, 0.03)) for i in range(400)] + [(1000 + i, text(3000 + i, 150)) for i in range(50)]
    got = Counter(r["class_id"] for r in rows(near_dedup.near_dedup(docs_of(spark, data))))
    assert got[0] == 400 and sum(n == 1 for n in got.values()) == 50


def test_near_copies_meet_although_longer_texts_share_their_passage(spark):
    data = []
    for g in range(4):
        passage = text(9_000 + g, 40)
        data += [(10_000 * g, passage + " alpha"), (10_000 * g + 1, passage + " beta")]
        data += [(10_000 * g + 10 + i, text(20_000 + 1_000 * g + i, 40) + " " + passage) for i in range(900)]
    found = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_dedup(docs_of(spark, data)))}
    assert [found[10_000 * g + 1] for g in range(4)] == [10_000 * g for g in range(4)]
    assert len(set(found.values())) == len(data) - 4


def test_texts_of_one_passage_end_by_their_own_words_before_any_row_is_sent(spark):
    """70 % of each text is one passage, the rest its own: of 780 pairs none is linked, and all but a few end in their bucket."""
    passage = text(71, 560)
    data = [f"{passage} {' '.join(f'v{random.Random(1000 * i + j).randrange(3000)}' for j in range(240))}" for i in range(40)]
    grams = near_dedup.Grams([t.encode() for t in data])
    summary, wide = near_dedup.summaries_of(grams), grams.word_counts(near_dedup.WIDE)
    cell = pa.table({
        "key": pa.array(range(40), pa.int64()), "root": pa.array(range(40), pa.int64()), "n_words": pa.array(grams.words, pa.int32()), "own": pa.array([0] * 40, pa.int64()),
        "summary": pa.array([x.tobytes() for x in summary], pa.binary()), "wide": pa.array([x.tobytes() for x in wide], pa.binary()),
        "listed": pa.array([None] * 40, pa.list_(pa.int64())),
    })
    left = near_dedup._meet(0.8)((pa.scalar(1), pa.scalar(0), pa.scalar(0)), cell)
    assert left.num_rows < 20
    assert len({r["class_id"] for r in rows(near_dedup.near_dedup(docs_of(spark, list(enumerate(data)))))}) == 40


def test_a_pair_of_many_buckets_meets_in_the_first_only():
    """Sixty near copies of one text in four buckets: each pair comes once, whatever buckets its texts have."""
    base = text(72, 100).split()
    data = [" ".join(base[:i] + ["x"] + base[i + 1 :]).encode() for i in range(60)]
    grams = near_dedup.Grams(data)
    summary, wide = near_dedup.summaries_of(grams), grams.word_counts(near_dedup.WIDE)
    buckets = [-5, 3, 8, 11]
    has = [sorted({-5, b} if i % 3 == 0 else {3, 8, b} if i % 3 == 1 else {8, b}) for i in range(60) for b in [11]]
    found = []
    for cell in buckets:
        own = [i for i in range(60) if cell in has[i]]
        rows_ = pa.table({
            "key": pa.array(own, pa.int64()), "root": pa.array(own, pa.int64()), "n_words": pa.array(grams.words[own], pa.int32()), "own": pa.array([0] * len(own), pa.int64()),
            "summary": pa.array([summary[i].tobytes() for i in own], pa.binary()), "wide": pa.array([wide[i].tobytes() for i in own], pa.binary()), "listed": pa.array([has[i] for i in own], pa.list_(pa.int64())),
        })
        met = near_dedup._meet(0.8)((pa.scalar(cell), pa.scalar(0), pa.scalar(0)), rows_)
        found += list(zip(met.column("a").to_pylist(), met.column("b").to_pylist(), strict=True))
    assert sorted(found) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


@pytest.mark.parametrize("many", [1, 3])
def test_listed_buckets_lose_no_link(spark, monkeypatch, many):
    monkeypatch.setattr(near_dedup, "MANY", many)
    test_near_dedup_equals_brute_force(spark)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=400), st.lists(st.sampled_from("abcdefg"), max_size=400), st.sampled_from([1, 3, 1024]))
def test_word_counts_bound_the_edits_from_below(a, b, counters):
    a, b = a + ["a"] * (300 if len(a) > 100 else 0), b + ["a"] * (290 if len(b) > 200 else 0)  # counters stop at 255
    wide = near_dedup.Grams([" ".join(a).encode(), " ".join(b).encode()]).word_counts(counters)
    mine, theirs = Counter(a), Counter(b)
    assert 0 <= near_dedup.fewest_changes(wide[:1], wide[1:])[0] <= max((mine - theirs).total(), (theirs - mine).total())


def test_near_dedup_finds_pairs_at_its_threshold(spark):
    """Scattered replacements down to a similarity of 0.8, and short texts with one middle word replaced."""
    rng, data, pairs = random.Random(3), [], []
    for i in range(300):
        n = rng.choice([5, 6, 7, 8, 9]) if i < 100 else rng.randrange(30, 50) if i < 200 else rng.randrange(60, 200)
        words = [f"t{i}w{rng.randrange(10**6)}" for _ in range(n)]
        other = list(words)
        for p in [n // 2] if i < 100 else rng.sample(range(n), int(n * 0.2)):
            other[p] = f"x{i}p{p}"
        data += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append((2 * i, 2 * i + 1))
    assert all(brute_classes(data[a : b + 1]) == [[a, b]] for a, b in pairs)
    found = {r["doc_id"]: r["class_id"] for r in rows(near_dedup.near_dedup(docs_of(spark, data)))}
    assert all(found[b] in (a, b) for a, b in pairs)
    assert all(found[b] == a for a, b in pairs[:100])
    assert sum(found[b] == a for a, b in pairs[100:]) >= 196


def test_links_at_and_beyond_the_limit():
    rng = random.Random(5)
    for n in (10, 45, 200, 3_000):
        words = [f"w{rng.randrange(10**5)}" for _ in range(n)]
        for edits, wanted in ((n // 5, True), (n // 5 + 1, False)):
            for kind in ("replace", "drop"):
                other = list(words)
                for p in sorted(rng.sample(range(n), edits), reverse=True):
                    other[p : p + 1] = ["x"] if kind == "replace" else []
                assert near_dedup.linked([" ".join(words).encode()], [" ".join(other).encode()]) == [wanted]


def test_exactly_one_row_of_a_class_stays(spark):
    base = text(31, 60)
    data = [(1, base), (1, base), (1, edited(base, 3, 0.03)), (2, base), (None, base), (5, text(32, 60)), (5, text(32, 60)), (None, None), (None, None)]
    got = rows(near_dedup.near_dedup(docs_of(spark, data).repartition(3)))
    kept = Counter(r["class_id"] for r in got if r["kept"])
    assert kept == {1: 1, 5: 1, None: 1} and all(r["doc_id"] == r["class_id"] for r in got if r["kept"])
    assert sorted(near_dedup.keep_one(docs_of(spark, data)).select("doc_id").collect(), key=repr) == sorted([(None,), (1,), (5,)], key=repr)


def test_a_bucket_of_several_blocks_compares_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    test_near_dedup_equals_brute_force(spark)


def test_a_large_bucket_meets_by_rare_grams(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", 2)
    test_near_dedup_equals_brute_force(spark)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.lists(st.integers(0, 4), max_size=60), st.integers(0, 60))
def test_banded_alignment(a, b, limit):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    assert not a or not b or near_dedup.anchored_edits(np.array(a), np.array(b)) >= line[-1]
    (got,) = near_dedup.edits_within([(np.array(a, dtype=np.int32), np.array(b, dtype=np.int32))], [limit])
    assert got == (line[-1] if line[-1] <= limit else -1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40), st.integers(0, 40))
def test_components(spark, links, early):
    """Of all links at once, and of some of them that the others join later."""
    import itertools

    root = {x: x for x in itertools.chain(*links)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    wanted = sorted((x, find(x)) for x in root if any(find(x) == find(y) for y in root if y != x))
    table = lambda some: spark.createDataFrame(some, "a int, b int")
    assert sorted(map(tuple, components(table(links)).collect())) == wanted
    some = common.keep(components(table(links[:early])))
    assert sorted(map(tuple, joined_by(some, table(links[early:])).collect())) == wanted


def test_a_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).groupBy("root").count().collect() == [(0, 301)]


def test_empty_tables(spark):
    df = docs_of(spark, [])
    for run in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, exact_dedup.exact_dedup, near_dedup.near_dedup, near_dedup.keep_one):
        assert run(df).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, queries.queries()[name], queries.oracle_sql()[name])


def test_rows_of_a_lost_order_are_the_same(spark):
    data = [(i, text(i % 9, 60)) for i in range(60)]
    one = rows(substring_dedup.substring_dedup(docs_of(spark, data)))
    two = rows(substring_dedup.substring_dedup(docs_of(spark, data[::-1]).repartition(5).orderBy(F.rand(3))))
    assert one == two
