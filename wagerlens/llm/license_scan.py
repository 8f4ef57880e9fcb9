"""License scans: exact short phrases, and fuzzy search for short notices.

Texts are folded to lower-case words.  A notice may occur with up to `edits` character errors.  By the
pigeonhole principle, a notice cut into edits + 1 seeds keeps one seed intact in any such occurrence, so
exact search for the seeds finds every candidate place; the regex library's bounded-error matching then
verifies the stretch around it and reports the span and its errors.

The words that tell a notice from another license's must stand in the span exactly: an error in the name of
the license is another license.  Sentences that several licenses share don't label by themselves: the license
named nearest to the sentence, within NEAR letters, is the label; where none is named, it is the license that
never names itself, if there is such a one, else there is no match.  Where matches of several notices overlap,
the nearest wins: the smallest share of letters in error, then the longer notice.

One pass over the documents, no shuffle.  score: 1 with an exact notice or phrase, less by the share of
letters in error for the best fuzzy match, 0 without any.

Defined results: null counts as empty, with no words and no labels; whole texts are searched however
long; repeated rows and ties of doc_id are scanned alike; an empty table gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import FOLD_TABLE, small_batches, text_bytes

#: Phrases of the base labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

#: Short notices, as folded words, the labels that the fuzzy search adds, and their telling words.
#: The label of a sentence in SHARED is the license that never names itself, or empty.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ()),
    ("released under the mit license", "mit", ("mit",)),
    ("licensed under the mit license", "mit", ("mit",)),
    ("distributed under the terms of the mit license", "mit", ("mit",)),
    ("licensed under the apache license version 2 0", "apache", ("apache",)),
    ("released under the apache license", "apache", ("apache",)),
    ("the apache software license version 1 1", "apache", ("apache",)),
    ("you may not use this file except in compliance with the license", "", ()),
    ("under the terms of the gnu general public license", "gpl", ("gnu", "general")),
    ("released under the gnu general public license", "gpl", ("gnu", "general")),
    ("under the terms of the gnu lesser general public license", "lgpl", ("gnu", "lesser")),
    ("under the terms of the gnu library general public license", "lgpl", ("gnu", "library")),
    ("under the terms of the gnu affero general public license", "agpl", ("gnu", "affero")),
    ("subject to the terms of the mozilla public license", "mpl", ("mozilla",)),
    ("licensed under the mozilla public license", "mpl", ("mozilla",)),
    ("this file are subject to the mozilla public license", "mpl", ("mozilla",)),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ()),
    ("released under the bsd license", "bsd", ("bsd",)),
    ("licensed under the bsd license", "bsd", ("bsd",)),
    ("with or without fee is hereby granted provided that the above copyright notice", "isc", ("provided",)),
    ("with or without fee is hereby granted the software is provided as is", "0bsd", ()),
    ("licensed under the isc license", "isc", ("isc",)),
    ("without any express or implied warranty in no event will the authors be held liable", "zlib", ()),
    ("released under the zlib license", "zlib", ("zlib",)),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy", "boost", ("organization",)),
    ("distributed under the boost software license", "boost", ("boost",)),
    ("made available under the terms of the eclipse public license", "epl", ("eclipse",)),
    ("under the terms of the common development and distribution license", "cddl", ("development", "distribution")),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered",)),
    ("this work is licensed under a creative commons attribution", "cc", ("creative", "commons")),
    ("licensed under the creative commons attribution license", "cc", ("creative", "commons")),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0", ()),
    ("licensed under the artistic license", "artistic", ("artistic",)),
    ("licensed under the european union public licence", "eupl", ("european", "union")),
    ("licensed under the eupl version", "eupl", ("eupl",)),
    ("licensed under the educational community license", "ecl", ("educational", "community")),
    ("this font software is licensed under the sil open font license", "ofl", ("font",)),
    ("licensed under the microsoft public license", "ms-pl", ("microsoft",)),
    ("released under the postgresql license", "postgresql", ("postgresql",)),
    ("without fee and without a written agreement is hereby granted", "postgresql", ()),
    ("licensed under the python software foundation license", "psf", ("python", "foundation")),
    ("licensed under the university of illinois ncsa open source license", "ncsa", ("illinois",)),
)

#: Sentences of several licenses, and the names by which each of these is told.
SHARED = {
    "permission is hereby granted free of charge to any person obtaining a copy": (
        ("mit license", "mit"), ("university of illinois", "ncsa"), ("ncsa open source license", "ncsa"), ("font software", "ofl"), ("sil open font license", "ofl"),
    ),
    "you may not use this file except in compliance with the license": (
        ("apache license", "apache"), ("mozilla public license", "mpl"), ("netscape public license", "npl"), ("common development and distribution license", "cddl"),
        ("educational community license", "ecl"), ("eupl", "eupl"), ("european union public licence", "eupl"), ("common public attribution license", "cpal"),
    ),
    "redistribution and use in source and binary forms with or without modification": (
        ("bsd license", "bsd"), ("apache software license", "apache"), ("apache software foundation", "apache"), ("openssl project", "openssl"), ("php license", "php"),
    ),
}

#: How far from a shared sentence, in letters of folded text, its license may be named.
NEAR = 300


def allowed_edits(notice: str) -> int:
    """One error for each twelve letters."""
    return max(1, len(notice) // 12)


def seeds_of(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 consecutive pieces of nearly equal length, with their places."""
    raw, n = notice.encode(), edits + 1
    cuts = [len(raw) * k // n for k in range(n + 1)]
    return [(cuts[k], raw[cuts[k] : cuts[k + 1]]) for k in range(n)]


def named_near(folded: bytes, start: int, end: int, names: list[tuple[bytes, str]], label: str) -> str:
    """The label of the name nearest to a span, in front of it or behind; else the given one."""
    best = (NEAR + 1, -1, label)
    for i, (key, of) in enumerate(names):
        at = folded.rfind(key, max(start - NEAR, 0), start + 1)
        if at >= 0:
            best = min(best, (start + 1 - at - len(key), i, of))
        at = folded.find(key, max(end - 1, 0), end + NEAR)
        if at >= 0:
            best = min(best, (at + 1 - end, i, of))
    return best[2]


class NoticeFinder:
    def __init__(self, notices=NOTICES, shared=SHARED):
        self.notices = []
        self.names = {text.encode(): [(f" {name} ".encode(), label) for name, label in names] for text, names in shared.items()}
        for text, label, telling in notices:
            edits = allowed_edits(text)
            pattern = regex.compile(b"(?:" + regex.escape(text.encode(), literal_spaces=True) + b"){e<=%d}" % edits, regex.BESTMATCH)
            self.notices.append((text.encode(), label, {t.encode() for t in telling}, edits, seeds_of(text, edits), pattern))

    def find(self, folded: bytes) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, errors, letters) of notices in folded text, in order; of overlapping ones the nearest."""
        found = []
        for notice, label, telling, edits, seeds, pattern in self.notices:
            places = set()
            for offset, seed in seeds:
                at = folded.find(seed)
                while at >= 0:
                    places.add(at - offset)
                    at = folded.find(seed, at + 1)
            # seeds of one occurrence agree in its place but for the errors
            places = sorted(places)
            begins = [p for i, p in enumerate(places) if not i or p - places[i - 1] > 2 * edits]
            ends = [p for i, p in enumerate(places) if i + 1 == len(places) or places[i + 1] - p > 2 * edits]
            stretches = [(max(a - edits, 0), min(b + len(notice) + edits, len(folded))) for a, b in zip(begins, ends, strict=True)]
            while stretches:
                low, high = stretches.pop()
                m = pattern.search(folded, low, high) if high - low >= len(notice) - edits else None
                if m:
                    stretches += [(low, m.start()), (m.end(), high)]
                    first, last = folded.rfind(b" ", 0, m.start() + 1) + 1, folded.find(b" ", max(m.end() - 1, 0))
                    if telling <= set(folded[first : last if last >= 0 else None].split()):
                        of = named_near(folded, m.start(), m.end(), self.names.get(notice, []), label)
                        if of:
                            found.append((sum(m.fuzzy_counts) / len(notice), -len(notice), m.start(), m.end(), of, sum(m.fuzzy_counts)))
        out: list[tuple[int, int, str, int, int]] = []
        for _, length, start, end, label, errors in sorted(set(found)):
            at = bisect.bisect_left(out, (start,))
            if (not at or out[at - 1][1] <= start) and (at == len(out) or out[at][0] >= end):
                out.insert(at, (start, end, label, errors, -length))
        return out


def scan_text(text: bytes, finder: NoticeFinder, phrases=PHRASES) -> dict:
    words = text.translate(FOLD_TABLE).split()
    folded = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    starts = None
    for phrase, label in phrases:
        key = b" " + phrase.encode() + b" "
        at = folded.find(key)
        while at >= 0:
            if starts is None:
                starts = []
                s = 1
                for w in words:
                    starts.append(s)
                    s += len(w) + 1
            places.append(bisect.bisect_left(starts, at + 1))
            labels.add(label)
            at = folded.find(key, at + 1)
    found = finder.find(folded)
    best = max([1.0 - errors / letters for *_, errors, letters in found], default=0.0)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {f[2] for f in found})),
        "score": 1.0 if places else best,
        "spans": [{"start": s - 1, "end": e - 1, "label": label, "errors": n} for s, e, label, n, _ in found],
    }


SPANS = "array<struct<start:long,end:long,label:string,errors:int>>"


def license_scan(docs: DataFrame, notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: bytes of the folded text (words joined by one space) that match a notice, with the errors.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("errors", pa.int32())]))),
    ]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = NoticeFinder(notices)
        for batch in batches:
            rows = [scan_text(text_bytes(t), finder, phrases) for t in batch.column(1)]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(name for name, _ in fields)])

    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}",
    )
