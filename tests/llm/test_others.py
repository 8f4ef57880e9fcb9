import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

import corpus_pipeline
from wagerlens.llm import common, decontaminate, license_scan, line_dedup, mixing, quality, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h int, shard int, copies int, text_key int"


def docs_of(spark, pairs, source="s"):
    return spark.createDataFrame([(p[0], p[1], None, p[2] if len(p) > 2 else source, None, "r", 1, 2, 3, 4) for p in pairs], SCHEMA)


def words(n, seed=0, kinds=300):
    rng = random.Random(seed)
    return " ".join(f"t{rng.randrange(kinds)}" for _ in range(n))


# ---- license scan --------------------------------------------------------------------------------

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy"


def test_license_scan_base_equals_brute_force(spark):
    data = [
        (1, "Released under the MIT License. MIT-license, mit  license!"), (2, None), (3, ""), (4, "the mitlicense is none; éMIT License neither"), (5, "GNU General Public License and Apache License"),
        (6, words(50_000) + " apache license " + words(10)), (7, "mit"), (None, "Mit License"), (7, "mit license"), (7, "mit license"),
    ]
    got = rows(license_scan.license_scan(docs_of(spark, data)))
    wanted = []
    for i, t in data:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        wanted.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(wanted, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_every_match_within_the_bound_has_a_seed():
    finder = license_scan.NoticeFinder()
    rng = random.Random(4)
    notice, edits = NOTICE.lower().replace(",", ""), license_scan.allowed_edits(NOTICE.lower().replace(",", ""))
    for _ in range(200):
        t = list(notice)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([["z"], [], [t[k], "q"]])
        folded = f" some words {''.join(t)} more ".encode()
        assert any(f[2] == "mit" and f[3] <= edits for f in finder.find(folded))
    assert finder.find(b" " + b"nothing of the kind " * 50) == []


def test_a_license_of_another_name_is_no_match():
    finder = license_scan.NoticeFinder()
    for name in ("MPL", "MS", "NIST", "WIT", "Mitt", "Permit", "XIT"):
        for form in ("this is licensed under the {} license", "released under the {} license today"):
            assert finder.find(b" " + form.format(name).lower().encode() + b" ") == [], name
    assert [f[2] for f in finder.find(b" it is lisensed under the mit licence here ")] == ["mit"]
    assert [f[2] for f in finder.find(b" under the terms of the gnu lesser general public license ")] == ["lgpl"]
    assert [f[2] for f in finder.find(b" under the terms of the gnu afero general public license ")] == []
    assert [f[2] for f in finder.find(b" permission is hereby granted free of charge to any person or organization obtaining a copy ")] == ["boost"]
    two = b" released under the mit license or licensed under the bsd license released under the mit license "
    assert [f[2] for f in finder.find(two)] == ["mit", "bsd", "mit"]


def substring_distance(notice, text):
    """Smallest edit distance of the notice to any part of the text, by plain dynamic programming."""
    line = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (c != d)))
        line = new
    return min(line)


def test_fuzzy_labels_equal_brute_force():
    """Each notice with up to one error more than allowed: its label and score are those of the nearest notice over all."""
    finder, rng = license_scan.NoticeFinder(), random.Random(11)
    for notice, _, _ in license_scan.NOTICES:
        for extra in (0, 1, 2, license_scan.allowed_edits(notice), license_scan.allowed_edits(notice) + 2):
            t = list(notice)
            for _ in range(extra):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([["z"], [], [t[k], "q"]])
            folded = " ".join(f"pad {''.join(t)} end".split())
            near = []
            for other, label, telling in license_scan.NOTICES:
                errors = substring_distance(other, f" {folded} ")
                if label and errors <= license_scan.allowed_edits(other) and set(telling) <= set(folded.split()):
                    near.append((errors / len(other), -len(other), label))
            got = license_scan.scan_text(folded.encode(), finder, phrases=())
            assert got["labels"] == (min(near)[2] if near else ""), folded
            assert got["score"] == pytest.approx(1 - min(near)[0] if near else 0.0)


#: Headers and openings as they stand in files; the labels are what a reader would say (base labels stay, so LGPL and AGPL have gpl too).
HEADERS = {
    "Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in\n# compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/": "mpl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file": "mpl",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.": "cddl",
    "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may\nnot use this file except in compliance with the License.": "ecl",
    "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.": "eupl",
    "The Apache Software License, Version 1.1\n *\n * Copyright (c) 1999 The Apache Software Foundation.  All rights\n * reserved.\n *\n * Redistribution and use in source and binary forms, with or without modification, are permitted provided": "apache",
    "Copyright (c) 1998 The OpenSSL Project.  All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted": "openssl",
    "Copyright (c) 2009, A. Person. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Copyright 2001 A. Person. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software": "mit",
    "University of Illinois/NCSA Open Source License. Copyright (c) 2004 A. Group. All rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy of": "ncsa",
    "PERMISSION & CONDITIONS: Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use": "ofl",
    "This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held liable for any damages": "zlib",
    "This software is provided \"as is\" without any express or implied warranty, and the maker keeps all rights": "",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this": "isc",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS": "0bsd",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided": "postgresql",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation": "boost",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by": "gpl,lgpl",
    "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3": "agpl,gpl",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy": "unlicense",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at": "epl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc",
    "You may not use this file except in compliance with the license of your company's handbook": "",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)": "boost",
}


@pytest.mark.parametrize("header", list(HEADERS))
def test_headers_of_real_files(header):
    finder = license_scan.NoticeFinder()
    for text in (header, f"/* {header} */ int main() {{}} " + "and more code " * 50, "x " * 400 + header.upper()):
        got = license_scan.scan_text(text.encode(), finder)
        assert got["labels"] == HEADERS[header]
        assert (got["score"] > 0.8) == bool(HEADERS[header])


def test_two_licenses_each_with_a_shared_sentence():
    finder = license_scan.NoticeFinder()
    both = [h for h in HEADERS if "EUPL" in h or "Version 1.1 (the" in h]
    for texts in (both, both[::-1]):
        assert license_scan.scan_text((" . ".join(texts)).encode(), finder)["labels"] == "eupl,mpl"
        assert license_scan.scan_text((" pad" * 500).join(texts).encode(), finder)["labels"] == "eupl,mpl"
    far = "the mozilla public license " + "word " * 80 + "you may not use this file except in compliance with the license"
    assert license_scan.scan_text(far.encode(), finder)["labels"] == ""


def test_base_columns_equal_sql(spark, sf):
    """The base half of the contract in SQL: words, phrases' places, first and last, labels."""
    import duckdb

    con = duckdb.connect()
    wanted = con.execute(rf"""
      WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM '{sf}/documents.parquet'),
      p AS (SELECT doc_id, len(w) AS n, list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m, list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
            list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM w)
      SELECT doc_id, n, len(m) + len(a) + len(g), list_min(m || a || g), list_max(m || a || g), concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) FROM p""").fetchall()
    got = license_scan.license_scan(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and any(r[2] for r in wanted)


def test_license_scan_without_documents(spark):
    assert license_scan.license_scan(docs_of(spark, [])).count() == 0


def test_license_scan_reports_spans(spark):
    (r,) = rows(license_scan.license_scan(docs_of(spark, [(1, "x " + NOTICE.replace("granted", "grantd") + " of this")])))
    (s,) = r["spans"]
    assert s["label"] == "mit" and 1 <= s["errors"] <= 2 and r["labels"] == "mit" and r["base_labels"] == "" and 0.9 < r["score"] < 1 and s["start"] <= 2


# ---- line dedup ----------------------------------------------------------------------------------


def test_line_dedup(spark):
    page = lambda i, host, body: (i, f"https://{host}/p{i}?q", f"<html><nav>Menu</nav><p>{body}</p>Foot\n Foot </html>", 1, 2)
    data = [page(i, "a.com", f"own {i}" if i else "Menu and more") for i in range(6)] + [page(9, "b.com", "only"), (10, None, "<p>x</p>", 1, 2), (11, "nonsense", None, 1, 2), (None, "https://A.com/x", "Menu", 1, 2), (12, "https://a.com", "", 1, 2)]
    df = spark.createDataFrame(data, "page_id long, url string, html string, host int, lines int")
    got = {r["page_id"]: r for r in rows(line_dedup.line_dedup(df))}
    assert got[1]["kept_text"] == "own 1" and got[1]["n_lines"] == 4 and got[1]["n_dropped"] == 3 and got[None]["n_dropped"] == 1 and got[None]["host"] == "a.com"
    assert got[9]["n_dropped"] == 0 and got[10]["kept_text"] == "x" and got[11]["n_lines"] == 0 and got[10]["host"] == "" and got[12]["n_lines"] == 0
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    assert rows(line_dedup.line_dedup(df, broadcast_bytes=0)) == rows(line_dedup.line_dedup(df))


def test_long_and_repeated_pages(spark):
    long = "<p>" + "</p><p>".join(f"line {i % 7000}" for i in range(60_000)) + "</p>"
    data = [(1, "http://h/1", long), (2, "http://h/2", "<p>line 5</p>"), (2, "http://h/2", "<p>line 5</p>"), (3, "http://h/3", "<p>line 6</p>")]
    got = rows(line_dedup.line_dedup(spark.createDataFrame(data, "page_id long, url string, html string")))
    assert [(r["page_id"], r["n_lines"], r["n_dropped"]) for r in got] == [(1, 60_000, 60_000 // 7000 + 1), (2, 1, 1), (2, 1, 1), (3, 1, 0)]


def test_line_ratio_is_strict(spark):
    df = spark.createDataFrame([(i, "http://h/", "<p>same</p>" if i < 3 else f"<p>{i}</p>") for i in range(10)], "page_id long, url string, html string")
    assert all(r["n_dropped"] == 0 for r in rows(line_dedup.line_dedup(df, ratio=0.3)))
    assert sum(r["n_dropped"] for r in rows(line_dedup.line_dedup(df, ratio=0.29))) == 3


# ---- decontamination -----------------------------------------------------------------------------


def brute_hits(docs, items, n=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {}
    for i, t in items:
        w = fold(t)
        for k in range(max(len(w) - n + 1, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for g, of in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= of
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contamination():
    items = [(1, words(30, 1)), (2, "Short item, here"), (10, words(30, 1)), (3, None), (4, "..."), (5, words(13, 5)), (None, words(20, 6)), (7, "one")]
    body = words(30, 1).split()
    docs = [
        (1, None), (2, ""), (3, words(300, 9)), (4, words(100, 8) + " " + " ".join(body[5:20]).upper() + " " + words(100, 7)), (5, words(5000, 3) + " SHORT-item; here " + words(10, 2)), (6, " ".join(body[:12])),
        (6, "one"), (6, "one"), (None, "x One y"), (8, words(13, 5) + " " + words(13, 5)), (9, (words(30, 1) + " ") * 40), (10, words(20, 6)), (11, "Éone one² ONE"),
    ]
    return docs, items


def test_decontamination_equals_brute_force(spark):
    docs, items = contamination()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.decontaminate(docs_of(spark, docs), bench))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == brute_hits(docs, items)
    spans = [r["spans"] for r in got if r["doc_id"] == 4][0]
    assert spans[0]["start"] == 100 and spans[0]["end"] == 115


def test_a_text_of_many_thousand_hit_windows(spark):
    """Spans of all lengths, some that touch, some a word apart, in one text that stands in the table three times."""
    passage, rng = words(2000, 11, 900).split(), random.Random(4)
    bench = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    text, wanted, at = [], [], 0
    for i in range(1500):
        low = rng.randrange(1900)
        part = passage[low : low + rng.choice((13, 13, 14, 20, 60))]
        wanted.append((at, at + len(part)))
        gap = i % 3  # without a gap spans touch and are one
        text += part + [f"gap{i}x{k}" for k in range(gap)]
        at += len(part) + gap
    merged = []
    for start, end in wanted:
        if merged and merged[-1][1] == start:
            merged[-1] = (merged[-1][0], end)
        else:
            merged.append((start, end))
    got = rows(decontaminate.decontaminate(docs_of(spark, [(1, " ".join(text))] * 3), bench))
    assert len(got) == 3 and len(merged) == 1000
    for r in got:
        assert [tuple(s.values() if isinstance(s, dict) else s) for s in r["spans"]] == merged
        assert r["n_hit"] == sum(e - s for s, e in merged) and r["n_words"] == len(text)


def test_large_benchmarks_find_the_same(spark, monkeypatch):
    """Windows joined by a shuffle, and a filter of the largest and the smallest size."""
    docs, items = contamination()
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda n: rows(decontaminate.spans(*decontaminate.hits(docs_of(spark, docs), bench, broadcast_rows=n)).drop("text_key"))
    whole = run(500_000)
    assert run(7) == whole
    for sizes in ((1, 1), (4096, 4096)):
        monkeypatch.setattr(decontaminate, "FILTER_WORDS", sizes)
        assert run(500_000) == whole


def test_keep_clean_returns_all_columns(spark):
    docs, items = contamination()
    df, bench = docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.keep_clean(df, bench)
    wanted = sorted(repr(i) for i, *_, bad in brute_hits(docs, items) if not bad)
    assert kept.columns == df.columns and sorted(repr(r["doc_id"]) for r in kept.collect()) == wanted
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(docs) and decontaminate.decontaminate(df.limit(0), bench).count() == 0


# ---- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        left -= over
    return target


def mixture(n=900):
    rng = random.Random(5)
    names = ["a", "b", "ä", "Z", None, "c", "d"]
    return [(i, None if i % 97 == 0 else words(rng.randrange(1, 60), i), names[min(rng.randrange(14), 6)]) for i in range(n)]


def test_mixing_meets_targets(spark):
    data = mixture() + [(5000, words(9, 1), "a"), (5000, words(9, 1), "a"), (None, words(4, 2), "b"), (6000, "", "void")]
    got = rows(mixing.mix(docs_of(spark, data)))
    sizes, largest = Counter(), Counter()
    for _, t, s in data:
        n = len((t or "").split())
        sizes[s] += n
        largest[s] = max(largest[s], n)
    wanted = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]], rel=1e-12) and r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[r["source"]] += r["taken"]
    assert len(got) == len(data) and all(abs(taken[s] - wanted[s]) <= max(largest[s], 18) / 2 + 1e-6 for s in sizes)
    again = rows(mixing.mix(docs_of(spark, data[::-1]).repartition(3)))
    assert again == got


def test_targets_are_met_where_most_rows_are_equal(spark):
    """60 % of a source are equal rows without id: its sum is still within half of one document."""
    data = [(None, words(30, 1), "a")] * 240 + [(i, words(20 + i % 9, i), "a") for i in range(160)] + [(1000 + i, words(25, i), "b") for i in range(200)] + [(7, words(10, 3), None)]
    for frame in (docs_of(spark, data), docs_of(spark, data).repartition(7)):
        taken, target = Counter(), {}
        for r in rows(mixing.mix(frame)):
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 15 + 1e-6 for s in target)
        out = Counter(r["source"] for r in mixing.mixed_docs(frame).collect())
        assert sum(out.values()) == sum(r["copies"] for r in rows(mixing.mix(frame)))


def test_larger_budgets_take_supersets(spark):
    df = docs_of(spark, mixture(300))
    small = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(df, total=0.5))}
    large = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(df, total=0.9))}
    assert all(large[i] >= n for i, n in small.items()) and sum(large.values()) > sum(small.values())


def test_mixed_docs_repeat_rows(spark):
    df = docs_of(spark, mixture(200))
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(df))}
    out = mixing.mixed_docs(df)
    assert out.columns == df.columns and Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_docs(df.limit(0)).count() == 0
    blank = docs_of(spark, [(1, None, None), (2, " ", "a")])
    assert [r["target"] for r in rows(mixing.mix(blank))] == [0.0, 0.0]


# ---- sharding ------------------------------------------------------------------------------------


def test_shards_are_even_and_slots_gapless(spark):
    data = [(i, words(i % 30, i)) for i in range(1003)] + [(None, None), (7, "same"), (7, "same"), (8, "é" * 40_000)]
    df = docs_of(spark, data)
    got = rows(sharding.shard_rows(df))
    count = Counter(r["shard"] for r in got)
    assert len(got) == len(data) and set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    text = dict(data)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] not in (7, 8))
    positions = [r["p"] for r in df.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("p")).collect()]
    assert Counter(sharding.brute_force(positions)) == count
    alone = [(r["doc_id"], r["shard"]) for r in rows(sharding.shard_rows(df.filter("doc_id not in (7, 8)")))]
    ids = [r["doc_id"] for r in df.filter("doc_id not in (7, 8)").collect()]
    positions = [r["p"] for r in df.filter("doc_id not in (7, 8)").select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("p")).collect()]
    assert dict(alone) == dict(zip(ids, sharding.brute_force(positions), strict=True))


def test_equal_rows_are_spread_over_the_ring(spark, monkeypatch):
    data = [(None, "same")] * 6_000 + [(i, words(4, i)) for i in range(500)]
    got = rows(sharding.shard_rows(docs_of(spark, data).repartition(5)))
    count = Counter(r["shard"] for r in got)
    assert len(got) == 6_500 and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s])) for s in range(16))
    equal = [r for r in got if r["doc_id"] is None]
    assert len({r["shard"] for r in equal}) == 16 and len(equal) == 6_000


def test_one_more_shard_moves_few_rows():
    """From 16 to 17 equal shards at least 1/17 of the rows must move; overflow at the exact bound moves more."""
    rng = random.Random(2)
    positions = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(20_000)]
    before, after = sharding.brute_force(positions, 16), sharding.brute_force(positions, 17)
    moved = sum(a != b for a, b in zip(before, after, strict=True)) / len(positions)
    assert 1 / 17 <= moved < 0.25, moved


def test_slots_of_equal_rows_are_the_same_again(spark):
    data = [(i % 3, "x" if i % 2 else "y", f"s{i}") for i in range(60)]
    runs = [sorted((r["source"], r["shard"], r["slot"]) for r in sharding.sharded_docs(docs_of(spark, d).repartition(n)).collect()) for d, n in ((data, 2), (data[::-1], 5))]
    assert runs[0] == runs[1]


def test_sharded_docs_keep_columns(spark):
    df = docs_of(spark, [(i, "x") for i in range(40)])
    out = sharding.sharded_docs(df)
    assert out.columns == [c for c in df.columns if c != "shard"] + ["shard", "slot"] and out.count() == 40
    assert sharding.sharded_docs(df.limit(0)).count() == 0


def test_overflow_moves_only_the_excess():
    _, owners = sharding.ring(4, 8)
    counts = [0] * 32
    counts[3] = 40
    got = sharding.plan(owners.tolist(), counts, 4)
    assert sum(high - low for _, low, high, _, _ in got) == 40 and {s for *_, s, _ in got} == {0, 1, 2, 3}
    assert got[0][:4] == (3, 0, 10, int(owners[3]))


# ---- quality -------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.fit(docs, labels))
    joined = out.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("accuracy"), F.avg("quality").alias("base"), F.count("*").alias("n")).first()
    clean = out.join(labels, "doc_id").filter("held_out and quality = 1").agg(F.avg("predicted")).first()[0]
    assert joined["n"] > 500 and joined["accuracy"] > 0.97 and joined["accuracy"] > joined["base"] + 0.08 and clean > 0.985


def test_scores_equal_brute_force(spark, sf):
    """Every document of a table against both dictionaries by zstandard's plain interface."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)

    def size(text, dictionary):
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(press.compress(text[i : i + 512])) for i in range(0, len(text), 512))

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in rows(quality.score(docs, model)):
        t = texts[r["doc_id"]]
        good, bad = size(t, model.good), size(t, model.bad)
        evidence = (bad - good) / math.sqrt(len(t) * (bad + good) / 2) if t else 0.0
        assert r["evidence"] == pytest.approx(evidence, abs=1e-12)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.weight * evidence + model.offset))), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)


def test_classifier_edge_cases(spark):
    good, bad = [words(80, i) for i in range(40)], ["### $$$ %%% " * 30 + str(i) for i in range(40)]
    data = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (None, good[0]), (5, good[5]), (1002, words(200_000, 1))]
    labels = [(i, 1 if i < 40 else 0) for i in range(80)] + [(2, 1), (3000, 0), (None, 1), (6, None)]
    df, marks = docs_of(spark, data), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(df, marks)
    got = rows(quality.score(df, model))
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == (r["doc_id"] < 40) for r in got if r["doc_id"] is not None and r["doc_id"] < 80) >= 78
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    for few in (marks.limit(0), marks.filter("quality = 1")):
        assert len({r["score"] for r in rows(quality.score(df, quality.fit(df, few)))}) == 1
    assert quality.score(df.limit(0), model).count() == 0
    flipped = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(df, flipped) == model  # held-out labels teach nothing


# ---- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "shards"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bad = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated")
    assert max(ids.values()) <= 2 and not ids.keys() & {r["doc_id"] for r in bad.collect()}
    assert sum(labels.get(i) == 0 for i in ids) <= 2 and len(ids) > 80
    texts = [r["text"] for r in out.select("doc_id", "text").distinct().collect()]
    assert len(texts) == len(set(texts))


def plain_quality(docs, model):
    import zstandard

    def size(text, dictionary):
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(press.compress(text[i : i + 512])) for i in range(0, len(text), 512))

    kept = []
    for i, t in docs:
        t = (t or "").encode()
        good, bad = size(t, model.good), size(t, model.bad)
        evidence = (bad - good) / (len(t) * (bad + good) / 2) ** 0.5 if t else 0.0
        if model.weight * evidence + model.offset >= 0:
            kept.append(i)
    return kept


def plain_near(docs):
    """The smallest doc_id of each class: all pairs, those ruled out whose words differ too much in any order."""
    folded = [(i, tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))), t or "") for i, t in docs]
    bags = [Counter(w) for _, w, _ in folded]
    root = list(range(len(folded)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(folded)):
        for b in range(a):
            x, y = folded[a][1], folded[b][1]
            most = int(0.2 * max(len(x), len(y)) + 1e-9)
            if folded[a][2] != folded[b][2]:
                if not x or not y or max(len(x), len(y)) - sum((bags[a] & bags[b]).values()) > most:
                    continue
                line = list(range(len(y) + 1))
                for i, w in enumerate(x, 1):
                    new = [i]
                    for j, v in enumerate(y, 1):
                        new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (w != v)))
                    line = new
                if line[-1] > most:
                    continue
            root[find(a)] = find(b)
    best = {}
    for k, (i, _, _) in enumerate(folded):
        best[find(k)] = min(best.get(find(k), i), i)
    return sorted(best.values())


def plain_clean(docs, items, n=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = {tuple(w[k : k + n]) for w in map(fold, items) if w for k in range(max(len(w) - n + 1, 1))}
    lengths, kept = {len(g) for g in grams}, []
    for i, t in docs:
        w = fold(t)
        hit = {p for m in lengths for k in range(len(w) - m + 1) if tuple(w[k : k + m]) in grams for p in range(k, k + m)}
        if not hit or 20 * len(hit) < len(w):
            kept.append(i)
    return kept


def plain_mixture(docs):
    """How often each document is taken: whole times its source, and the remainder in order of hashes."""
    sources = {}
    for i, t, s in docs:
        h = int(hashlib.md5(f"{'' if i is None else i}\x1f{t or ''}".encode()).hexdigest()[:12], 16)
        sources.setdefault(s, []).append((h, i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    target, taken = brute_targets({s: sum(r[2] for r in rows_) for s, rows_ in sources.items()}), Counter()
    for s, rows_ in sources.items():
        size = sum(r[2] for r in rows_)
        whole = int(target[s] // size) if size else 0
        rest, before = target[s] - whole * size, 0
        for _, i, n in sorted(rows_):
            taken[i] += whole + (rest > 0 and (rest - before > n / 2 if n else before <= rest))
            before += n
    return +taken


def test_each_stage_equals_brute_force(spark, sf):
    """Every stage over its own input, against a plain version of the same decision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = {
        "quality": lambda d: Counter(plain_quality([(i, t) for i, t, _ in d], model)), "near_duplicates": lambda d: Counter(plain_near([(i, t) for i, t, _ in d])),
        "decontamination": lambda d: Counter(plain_clean([(i, t) for i, t, _ in d], items)), "mixture": plain_mixture, "shards": lambda d: Counter(i for i, _, _ in d),
    }
    for name, stage in corpus_pipeline.STAGES:
        given = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = common.keep(stage(spark, docs, sf))
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == plain[name](given), name
        docs = out


def test_stages_take_nulls_repeated_rows_and_clashing_columns(spark, sf):
    data = [(i, words(60, i), f"s{i % 3}") for i in range(30)] + [(1, words(60, 1), "s1"), (None, words(60, 2), None), (40, None, "s1"), (41, "", None), (42, words(60_000, 9), "s0")]
    first = docs_of(spark, data)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = common.keep(stage(spark, first, sf))
        assert out.columns == (first.columns if name != "shards" else [*[c for c in first.columns if c != "shard"], "shard", "slot"]), name
        ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        assert 42 in ids and set(ids) <= {i for i, *_ in data}, name
        if name == "near_duplicates":
            assert ids[1] == 1 and len(ids) == sum(ids.values())


def test_pipeline_without_documents(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
