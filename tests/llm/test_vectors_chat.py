import hashlib
import math
import random

import numpy as np
import pytest
from conftest import rows, same_as_sql

from wagerlens.llm import chat_format, queries, vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, code string, n int, component string"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, data):
    return spark.createDataFrame([(i, v, k, 1, "c", 2, "d") for i, v, k in data], SCHEMA)


def random_vectors(n, width, seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(width, width)) * spread
    return (rng.normal(size=(n, width)) @ mix + rng.normal(size=width)).astype(np.float32)


ODD = [
    (900, None, 1), (901, [0.5] * 15 + [None], 1), (902, [0.5] * 15 + [NAN], 2), (903, [INF] + [0.5] * 15, 2), (904, [0.5] * 3, 1), (905, [], 1), (906, [-INF] * 16, None),
]


def mixed_vectors(n=300, width=16):
    v = random_vectors(n, width)
    data = [(i * 3 - 50, v[i].tolist(), i % 5 if i % 7 else None) for i in range(n)]
    return [*data, *data[:9], (None, v[3].tolist(), 1), (None, [0.25] * width, None), *ODD]


# ---- whitening -----------------------------------------------------------------------------------


def exact_whitening(data, width, components=8):
    kept = [(i, v) for i, v, _ in data if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(cov)
    return kept, n, [sum(c * c for c in r) for r in off], np.array(off, dtype=float) / n, values[::-1][:components], axes[:, ::-1][:, :components], np.trace(cov)


def test_whitening_equals_exact_moments(spark):
    data = mixed_vectors()
    got = whitening.whiten(vectors_of(spark, data).repartition(7)).collect()
    kept, n, deviation, centred, values, axes, trace = exact_whitening(data, 16)
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"])) for r in got if r["component"] == 1) == sorted((i is None, i or 0, d) for (i, _), d in zip(kept, deviation, strict=True))
    for k in range(8):
        mine = sorted((int(r["deviation"]), r["whitened"]) for r in got if r["component"] == k + 1)
        wanted = centred @ axes[:, k] / math.sqrt(values[k])
        order = sorted(zip(deviation, wanted, strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(mine, order, strict=True)))
        assert max(abs(sign * a[1] - b[1]) for a, b in zip(mine, order, strict=True)) < 1e-9
        assert all(abs(r["explained"] - values[k] / trace) < 1e-12 for r in got if r["component"] == k + 1)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert rows(whitening.whiten(vectors_of(spark, []))) == []
    assert rows(whitening.whiten(vectors_of(spark, ODD[:4] + ODD[5:]))) == []
    one = rows(whitening.whiten(vectors_of(spark, [(5, [0.5, -0.25], 1), (5, [0.5, -0.25], 1)])))
    assert [(r["component"], r["whitened"], r["explained"], int(r["deviation"]), r["n"]) for r in one] == [(1, None, None, 0, 2)] * 2 + [(2, None, None, 0, 2)] * 2
    line = rows(whitening.whiten(vectors_of(spark, [(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 1)])))
    assert sorted((r["component"], r["whitened"] is None) for r in line) == [(1, False), (1, False), (2, True), (2, True)]
    assert sorted(round(abs(r["whitened"]), 9) for r in line if r["component"] == 1) == [1.0, 1.0]


def test_moments_merge_like_one_pass_whatever_the_shift_and_size():
    x = np.floor(random_vectors(500, 6) * 1024).astype(np.int64) + (1 << 40)
    parts = [whitening.Moments.of(p) for p in np.split(x, [0, 1, 7, 400])]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    centred = (x - (1 << 40)) - (x - (1 << 40)).mean(axis=0)
    assert merged.n == 500 and merged.sums.tolist() == [sum(map(int, c)) for c in x.T]
    assert np.abs(merged.scatter / (centred.T @ centred) - 1).max() < 1e-6
    big = np.array([[1 << 53, -(1 << 53)]] * 3 + [[0, 1]])
    sums = np.array([sum(map(int, c)) for c in big.T], dtype=object)
    wanted = [sum((4 * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in big]
    assert [int(v) for v in whitening.deviations(big, 4, sums).to_pylist()] == wanted
    assert whitening.deviations(big, 10**6, sums).to_pylist()[0] is None  # more than 38 digits


def test_whitened_covariance_is_the_identity_on_the_table(spark, sf):
    got = queries.op11_whiten_embeddings(spark, sf).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(8)).max() < 1e-9 and got["identity_error"].max() < 1e-9
    assert str(got["deviation"].dtype) == "int64"


# ---- vector codes --------------------------------------------------------------------------------


def plain_codes(data, width, parts=8, entries=16, rounds=6):
    """Lloyd's rounds by Python's whole numbers, all entries compared for each part."""
    kept = [(i, [math.floor(4096 * float(np.float32(c))) for c in v], k) for i, v, k in data if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    wide = -(-width // parts)
    cut = [[(v + [0] * (wide * parts - width))[p * wide : (p + 1) * wide] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[list(cut[i][p]) for i in order] for p in range(parts)]
    near = lambda v, book: min(range(len(book)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, book[j], strict=True)), j))
    for _ in range(rounds):
        for p in range(parts):
            codes = [near(c[p], books[p]) for c in cut]
            for j in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out = []
    for (i, _, k), c in zip(kept, cut, strict=True):
        codes = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{x:02x}" for x in codes), sum(sum((a - b) ** 2 for a, b in zip(c[p], books[p][codes[p]], strict=True)) for p in range(parts)), k))
    sums = {}
    for _, _, e, k in out:
        sums[k] = sums.get(k, 0) + e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return sorted(((i, code, e, sums[k], hashlib.sha256(text.encode()).hexdigest()) for i, code, e, k in out), key=repr)


def codes_of(df, **kw):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.encode(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("width,coarse", [(16, False), (16, True), (11, False)])
def test_codes_equal_plain_lloyd(spark, width, coarse):
    data = mixed_vectors(260, width)
    if width != 16:
        data = [(i, v, k) for i, v, k in data if v is None or len(v) != 16]
    if coarse:  # entries on a coarse grid: many equal distances
        data = [(i, v and [c if c is None or not math.isfinite(c) else round(c * 2) / 4 for c in v], k) for i, v, k in data]
    assert codes_of(vectors_of(spark, data).repartition(5)) == plain_codes(data, width)


def test_codes_of_little(spark):
    assert codes_of(vectors_of(spark, [])) == [] and codes_of(vectors_of(spark, ODD[:4] + ODD[5:])) == []
    few = [(4, [0.5] * 8, 1), (2, [0.25] * 8, None), (2, [-0.25] * 8, None)]
    assert codes_of(vectors_of(spark, few)) == plain_codes(few, 8)
    same = [(i, [0.125] * 8, i % 2) for i in range(40)]
    assert codes_of(vectors_of(spark, same)) == plain_codes(same, 8)
    huge = [(i, [3e38 * (-1) ** i] * 8, 0) for i in range(20)]
    assert len(codes_of(vectors_of(spark, huge))) == 20
    assert codes_of(vectors_of(spark, mixed_vectors(40)), entries=1) == plain_codes(mixed_vectors(40), 16, entries=1)


def test_bounds_spare_comparisons_and_never_change_a_code(spark):
    v = random_vectors(3000, 16, seed=5)
    df = vectors_of(spark, [(i, r.tolist(), 0) for i, r in enumerate(v)]).repartition(3)
    whole = vector_codes.keep(vector_codes._whole(df, "vec_id", "embedding", "label", 16, 16, 4096))
    _, _, _, compared = vector_codes.train(whole, parts=8, entries=16, rounds=6)
    assert compared[0] == 8 * 3000 and compared[5] < compared[0] / 2


def test_reassign_compares_all_where_bounds_only_touch():
    rng = np.random.default_rng(2)
    for trial in range(300):
        x = rng.integers(-4, 5, (50, 2))
        old, new = rng.integers(-4, 5, (5, 2)), None
        new = np.clip(old + rng.integers(-1, 2, old.shape), -4, 4)
        code, upper, lower, _ = vector_codes.reassign(x, old, None, np.zeros(50, np.int32), np.zeros(50, np.float32), np.zeros(50, np.float32))
        moved = np.sqrt(vector_codes.squared(new, old).astype(float)) * (1 + 1e-6)
        again, upper, lower, _ = vector_codes.reassign(x, new, moved, code, upper, lower)
        d = vector_codes.squared(x[:, None], new[None])
        assert (again == d.argmin(axis=1)).all(), trial
        assert (upper.astype(float) >= np.sqrt(d[np.arange(50), again])).all()
        d[np.arange(50), again] = 10**6
        assert (lower.astype(float) <= np.sqrt(d.min(axis=1))).all()


# ---- chats ---------------------------------------------------------------------------------------

CHATS = "conv_id long, turn long, role string, text string, formatted string, turns int, loss int"
NASTY = ["<s>", "</s>", "[INST]", "[\\INST]", "[/INST]", "<\\\\/s>", "[SYS]", "[/ROLE]", "\\", "[", "<", "INST]", "s>", "<|endoftext|>", "\n", " ", "é", "😀", "é", "ok", "\x00", "\r\n"]


def plain_digests(data):
    """Digests straight from the rows."""
    chats = {}
    for i, turn, role, text in data:
        chats.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for i, turns in chats.items():
        turns.sort()
        said, learned = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out.append((i, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(spark, data):
    made = chat_format.format_chats(spark.createDataFrame([(*r, "f", 1, 2) for r in data], CHATS))
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    return sorted((tuple(r[n] for n in names) for r in chat_format.read_back(made).collect()), key=repr)


def test_escapes_are_undone_and_leave_no_control_string():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choices(NASTY, k=rng.randrange(9)))
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text and not any(mark in shown for mark in chat_format.CONTROL)


def test_turns_and_spans_come_back():
    rng = random.Random(2)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[ROLE]x", "</s>"]), "".join(rng.choices(NASTY, k=rng.randrange(6)))) for _ in range(rng.randrange(6))]
        text, spans = chat_format.render(turns)
        assert chat_format.turns_of(text) == turns
        assert [chat_format.unescape(text[a:z]) for a, z in spans] == [t for r, t in turns if r == "assistant"] and spans == sorted(spans)


def test_loss_mask_by_binary_search_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), 12))
        spans = [(cuts[k], cuts[k + 1]) for k in range(0, 12, 3)]
        edges = sorted({0, 60, *rng.sample(range(60), 20)})
        tokens = np.array([*zip(edges, edges[1:], strict=False), (5, 5)])
        wanted = [a < z and any(s <= a and z <= e for s, e in spans) for a, z in tokens]
        assert chat_format.loss_mask(tokens, spans).tolist() == wanted
    assert chat_format.loss_mask(np.zeros((0, 2), np.int64), [(1, 2)]).tolist() == [] and chat_format.loss_mask(np.array([[0, 1]]), []).tolist() == [False]


def test_chats_equal_plain_digests(spark):
    rng = random.Random(4)
    data = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), "".join(rng.choices(NASTY, k=rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 6))]
    data += [(100, 0, "user", None), (100, 1, "assistant", None), (101, None, "assistant", "x"), (101, None, "assistant", "x"), (101, 3, None, "y"), (None, 1, "assistant", "of no id"), (None, 0, "user", "q")]
    data += [(102, 0, "user", "z" * 300_000), (102, 1, "assistant", "wörd </s> " * 40_000), (-7, 0, "user", chat_format.HOSTILE), (-7, 1, "assistant", chat_format.HOSTILE)]
    assert digests(spark, data) == plain_digests(data)
    assert digests(spark, data[:0]) == []


def test_tokens_cover_the_text_and_masks_the_answers(spark):
    data = [(1, 0, "user", "[INST] a"), (1, 1, "assistant", " b</s>\n"), (1, 2, "assistant", ""), (1, 3, "assistant", "\nc ")]
    made = chat_format.format_chats(spark.createDataFrame([(*r, "f", 1, 2) for r in data], CHATS)).first()
    t = chat_format.tokenizer(open(chat_format.VOCABULARY, encoding="utf-8").read())
    assert t.decode(made["token_ids"], skip_special_tokens=False) == made["formatted"] == "[INST][\\INST] a[/INST]<s> b<\\/s>\n</s><s></s><s>\nc </s>"
    assert len(made["token_ids"]) == len(made["loss"])
    assert chat_format.loss_texts(np.array(made["token_ids"]), np.array(made["loss"]), t) == [" b</s>\n", "\nc "]


def test_chats_equal_sql(spark, sf):
    same_as_sql(spark, sf, queries.op13_format_chats, queries.oracle_sql()["op13_format_chats"])


def test_width_is_the_most_frequent_length(spark):
    df = vectors_of(spark, [(1, [0.0] * 3, 1), (2, [0.0] * 4, 1), (3, [0.0] * 4, 1), (4, [0.0] * 3, 1), (5, None, 1)])
    assert vectors.width_of(df, "embedding") == 4
