"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Items and documents are folded alike (A-Z lower-cased, words between ASCII breaks).  An item's windows
are its runs of `n` words, or all of it if it is shorter.  The windows, joined by spaces, form a set;
a document's windows of the same lengths, where their outer words pass a filter, are probed against it by a
hash join on the window text itself, so a hit is verified by the equality of the words.  Documents are read
twice, whatever the benchmark's size: for their windows, and for their numbers of words.  Only hits are
shuffled; sorted by place, a hit that begins after all that came before it has ended opens a span, so time
and memory are in proportion to a text's hits.  The items of a window are looked up for hits alone.

The set is broadcast if it has at most `broadcast_rows` windows, counted before; a larger one is joined by a
shuffle of the windows that pass.  The filter has 16 bits a window, within 8 KB and 512 KB.

Defined results: null text has no words and no hits; items without words have no windows; an item without id
is named by the empty text; ties and repeated rows of one doc_id and text get the same result each; null
doc_id is a key like any other; very long texts are cut into windows whole; an empty table or benchmark gives
no hits; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BREAK_CLASS, fold_case, keep, whole_rows


def words_of(text: Column) -> Column:
    return F.filter(F.split(fold_case(F.coalesce(text, F.lit(""))), BREAK_CLASS), lambda w: w != "")


def count_of(text: Column) -> Column:
    """Number of words_of(text), whose case doesn't matter: it splits at the same breaks, letters unfolded."""
    breaks = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), breaks), lambda w: w != "")).cast("long")


#: Least and most words of the filter, of 64 bits.
FILTER_WORDS = (1024, 65536)


def _slot(first: Column, last: Column, size: int) -> tuple[Column, Column]:
    """Word and bit of a filter of `size` words for a window with these outer words."""
    h = F.xxhash64(first, last)
    return h.bitwiseAND(F.lit(size - 1)).cast("int"), F.shiftrightunsigned(h, 58).cast("int")


def outer_words(grams: DataFrame, n_grams: int) -> tuple[Column, int]:
    """A filter over the windows' first and last words, as an array of 64-bit numbers, and its size.

    It lets every window of the benchmark pass; beyond its largest size more others pass too.
    """
    size = FILTER_WORDS[0]
    while size < FILTER_WORDS[1] and size * 4 < n_grams:
        size *= 2
    word, bit = _slot(F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1), size)
    slots = grams.select(word.alias("word"), bit.alias("bit"))
    rows = slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    masks = {r["word"]: r["mask"] for r in rows.collect()}  # at most `size` rows
    # one constant: the optimiser reads the text once
    return F.from_json(F.lit(json.dumps([masks.get(i, 0) for i in range(size)])), "array<bigint>"), size


def _windows(words: Column, length: int, outer: tuple[Column, int] | None = None) -> Column:
    """Structs of the place and text of all windows of one length, or of those whose outer words pass."""
    last = F.size(words) - length
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    if outer is not None:

        def passes(i: Column) -> Column:
            word, bit = _slot(F.get(words, i), F.get(words, i + (length - 1)), outer[1])
            return F.getbit(F.get(outer[0], word), bit) == 1

        at = F.filter(at, passes)
    return F.transform(
        at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, length), " ").alias("gram"))
    )


def grams_of(items: DataFrame, n: int) -> DataFrame:
    """The benchmark's windows: gram, n_gram (its words), item (an id, as text)."""
    worded = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    short = F.array(F.struct(F.lit(0).alias("at"), F.array_join("words", " ").alias("gram")))
    size = F.size("words")
    rows = worded.filter(size > 0).select("item", F.least(size, F.lit(n)).alias("n_gram"), F.explode(F.when(size < n, short).otherwise(_windows(F.col("words"), n))).alias("w"))
    return rows.select(F.col("w.gram").alias("gram"), "n_gram", "item").distinct()


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def hits(docs: DataFrame, items: DataFrame, *, n: int = 13, broadcast_rows: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, at, n_gram, gram of every window of docs that the benchmark has; grams of items)."""
    named = keep(grams_of(items, n))
    grams = named.select("gram", "n_gram").distinct()
    facts = grams.groupBy("n_gram").agg(F.count("*").alias("n")).collect()  # at most n rows
    total = sum(r["n"] for r in facts)
    words = docs.select(*_key(docs), words_of(F.col("text")).alias("words"))
    outer = outer_words(grams, total)
    windows = F.concat(*[_windows(F.col("words"), r["n_gram"], outer) for r in facts]) if facts else _windows(F.col("words"), n, outer)
    probed = words.select("doc_id", "text_key", F.explode(windows).alias("w")).select("doc_id", "text_key", "w.at", "w.gram")
    found = probed.join(F.broadcast(grams) if total <= broadcast_rows else grams, "gram")
    return keep(found.select("doc_id", "text_key", "at", "n_gram", "gram")), named


def spans(hit_rows: DataFrame, named: DataFrame) -> DataFrame:
    """Per document with hits: merged spans [start, end) of words, n_hit, found (item ids, sorted as text)."""
    which = hit_rows.select("doc_id", "text_key", "gram").distinct().join(named.select("gram", "item"), "gram")
    which = which.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).agg(F.array_sort(F.collect_set("item")).alias("found"))
    ends = hit_rows.groupBy("doc_id", "text_key", "at").agg(F.max(F.col("at") + F.col("n_gram")).alias("end"))  # repeated rows are one
    text = Window.partitionBy("doc_id", "text_key").orderBy("at")  # the hits of one text, sorted and read once
    reached = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opens = ends.withColumn("opens", F.when(F.col("at") <= reached, 0).otherwise(1))
    placed = opens.withColumn("span", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = placed.groupBy("doc_id", "text_key", "span").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    whole = merged.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit")
    )
    joined = whole.join(which, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    return joined.select("doc_id", "text_key", "spans", "found", "n_hit")


def decontaminate(docs: DataFrame, items: DataFrame, *, n: int = 13, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    contaminated: at least one word in `share` is covered by benchmark windows.
    """
    counted = docs.select(*_key(docs), count_of(F.col("text")).alias("n_words")).alias("d")
    marked = spans(*hits(docs, items, n=n)).alias("h")
    joined = counted.join(
        marked, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left"
    )
    n_hit = F.coalesce("h.n_hit", F.lit(0))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("h.found"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("h.found", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("h.spans").alias("spans"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, n: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns unchanged."""
    marked = spans(*hits(docs, items, n=n)).alias("h")
    rows = whole_rows(docs, *_key(docs)).alias("d")
    joined = rows.join(
        marked, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_key") == F.col("h.text_key")), "left"
    )
    clean = F.col("h.n_hit").isNull() | (share * F.col("h.n_hit") < count_of(F.col("row.text")))
    return joined.filter(clean).select("row.*")


#: The same rows in DuckDB's SQL, by joining all windows.
DECONTAMINATE_SQL = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k + 1 : k + least(len(w), 13)], ' ') AS gram
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS k FROM i WHERE len(w) > 0)),
d AS (
  SELECT doc_id, xx, w, len(w) AS n_words FROM (
    SELECT doc_id, row_number() OVER () AS xx, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents)),
windows AS (
  SELECT xx, n, k, array_to_string(w[k + 1 : k + n], ' ') AS gram
  FROM (SELECT d.xx, d.w, l.n, unnest(range(greatest(len(d.w) - l.n + 1, 0))) AS k FROM d, (SELECT DISTINCT n FROM grams) l)),
hit AS (SELECT xx, k, windows.n, item FROM windows JOIN grams USING (gram)),
covered AS (SELECT xx, count(DISTINCT p) AS n_hit FROM (SELECT xx, unnest(range(k, k + n)) AS p FROM hit) GROUP BY xx),
named AS (SELECT xx, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT xx, item FROM hit) GROUP BY xx)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n_words AS contaminated
FROM d LEFT JOIN covered USING (xx) LEFT JOIN named USING (xx)
"""
