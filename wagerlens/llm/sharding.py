"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring of 64-bit hashes, and a row belongs to the first point
clockwise from its own hash.  The stretch that ends in a point is an arc.  Shards are bounded to equal
counts of rows (at most one apart).  What exceeds a shard's bound, the last rows of its last arcs,
continues clockwise to the next shards with room, so that only the excess moves.

Only the counts of the arcs (16 x 256 numbers, whatever the input) come to the driver; the plan made
from them gives each stretch of an arc's rows a shard and the slots there.  Rows are ranked within
their arc, a window over thousands of small groups.  Rows of equal doc_id and text have one hash; a group of
them that would fill a quarter of a mean arc is numbered, and its rows are placed by hash and number, so that
no arc gathers it.

The law is `rows`: counts of shards differ by one at most.  Bounded loads make a row's shard depend on
other rows, so the law `key` can't hold with this method, and grown_shard is null.

Defined results: null text counts as no bytes (size 1, crc32 0); null doc_id is a key like any other;
repeated rows and ties have slots of their own, and rows that differ elsewhere are ordered by all their columns;
a very long text is one row like any other; an empty table gives an empty result; further columns are not read
by shard_rows and kept by sharded_docs, which replaces columns named shard and slot.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, numbered, whole_hash


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points, as signed 64-bit integers, and the shards that own them."""
    points = {}
    for shard in range(shards):
        for v in range(virtual):
            points.setdefault(xxhash.xxh64_intdigest(f"shard {shard} point {v}") - (1 << 63), shard)
    at = sorted(points)
    return np.array(at, dtype=np.int64), np.array([points[p] for p in at], dtype=np.int32)


def plan(owners: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, slot of the first rank) from the arcs' counts."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    given = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []

    def place(arc: int, low: int, high: int, shard: int) -> int:
        n = min(high - low, room[shard])
        if n > 0:
            out.append((arc, low, low + n, shard, given[shard]))
            room[shard] -= n
            given[shard] += n
        return low + max(n, 0)

    over = []
    for arc, (owner, count) in enumerate(zip(owners, counts, strict=True)):
        if (low := place(arc, 0, count, owner)) < count:
            over.append((arc, low, count))
    for arc, low, count in over:
        step = 1
        while low < count:
            low = place(arc, low, count, owners[(arc + step) % len(owners)])
            step += 1
    return out


def _placed(docs: DataFrame, shards: int, virtual: int, *columns, tie=None) -> DataFrame:
    """The given columns of docs, size and text_crc32 with each row's shard and slot."""
    spark = docs.sparkSession
    points, owners = ring(shards, virtual)
    where = spark.sparkContext.broadcast(points)

    @F.pandas_udf(T.IntegerType())
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(where.value, position.to_numpy(), side="left") % len(where.value)).astype("int32"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *columns,
        F.col("doc_id").alias("own_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("position"),
        (F.lit(0) if tie is None else tie).alias("tie"),
    )
    equal = keep(docs.select(F.xxhash64("doc_id", text).alias("of_position")).groupBy("of_position").agg(F.count("*").alias("n")).filter("n > 1"))
    large = max(docs.count() // (4 * len(points)), 1000)
    hot = keep(equal.filter(F.col("n") > large).select("of_position"))
    if not hot.isEmpty():  # 4 x 16 x 256 positions at most
        hot = F.broadcast(hot)
        same = F.col("position") == F.col("of_position")
        apart = numbered(keep(rows.join(hot, same, "left_semi").withColumn("place", F.monotonically_increasing_id())), ["position"], "place", "number")
        apart = apart.withColumn("position", F.xxhash64("position", "number")).select(*rows.columns)
        rows = keep(rows.join(hot, same, "left_anti").unionByName(apart))
    rows = rows.withColumn("arc", arc_of("position"))
    counted = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    stretches = plan(owners.tolist(), [counted.get(a, 0) for a in range(len(points))], shards)
    plan_rows = spark.createDataFrame(
        stretches or [(0, 0, 0, 0, 0)], "arc int, low long, high long, shard int, start long"
    )
    order = Window.partitionBy("arc").orderBy("position", "own_id", "size", "text_crc32", "tie")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1)
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(plan_rows), "arc").filter(inside).withColumn("slot", F.col("start") + F.col("rank") - F.col("low"))


def shard_rows(docs: DataFrame, *, shards: int = 16, virtual: int = 256) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return _placed(docs, shards, virtual).select(
        F.col("own_id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_docs(docs: DataFrame, *, shards: int = 16, virtual: int = 256) -> DataFrame:
    """The rows with all their columns, and shard and slot (which replace columns of these names)."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return _placed(docs, shards, virtual, F.struct(*rest).alias("row"), tie=whole_hash(docs)).select("row.*", "shard", "slot")


def brute_force(positions: list[int], shards: int = 16, virtual: int = 256) -> list[int]:
    """The same law row by row, for tests: shards of rows given in the order of their positions."""
    points, owners = ring(shards, virtual)
    at = points.tolist()
    arcs = [bisect_left(at, p) % len(at) for p in positions]
    room = [len(positions) // shards + (s < len(positions) % shards) for s in range(shards)]
    got = [-1] * len(positions)
    order = sorted(range(len(positions)), key=lambda i: (arcs[i], positions[i]))
    for i in order:
        if room[owners[arcs[i]]] > 0:
            got[i] = int(owners[arcs[i]])
            room[got[i]] -= 1
    for i in order:
        step = arcs[i]
        while got[i] < 0:
            step += 1
            shard = int(owners[step % len(at)])
            if room[shard] > 0:
                got[i] = shard
                room[shard] -= 1
    return got
