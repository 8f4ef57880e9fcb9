"""Position, lag and idle exit from the query; refresh classes at their intervals; comparison of whole tables."""

from conftest import rows
from pyspark.sql import functions as F

from wagerlens.operators import legs as L
from wagerlens.plans import differences as D
from wagerlens.sources import sinks
from wagerlens.streaming import cadence, events as E, watch


def test_a_stream_ends_when_idle_at_the_position_of_the_table(spark, tmp_path):
    events = E.generate(spark, 400)
    sinks.write_events(events.repartition(3), f"file:{tmp_path / 'in'}")
    start = lambda: E.ingest(E.read_event_files(spark, str(tmp_path / "in"), streaming=True), str(tmp_path / "log"), str(tmp_path / "check"), drain=False, every="200 milliseconds")
    seen = watch.run_until_idle(start, spark, 4.0)
    log = E.read_log(spark, str(tmp_path / "log"))
    at = L.stream_position(log).first()
    assert (seen.position, seen.rows) == (at["position"], at["rows_stored"]) and seen.batches >= 2 and all(v == 0 for v in seen.lag.values())
    again = watch.run_until_idle(start, spark, 1.0)  # nothing new: it ends, and says nothing of rows
    assert (again.rows, again.position) == (0, None) and E.read_log(spark, str(tmp_path / "log")).count() == at["rows_stored"]
    assert not spark.streams.active


def test_classes_run_at_their_intervals_from_one_snapshot(monkeypatch):
    now, reads, written = [0.0], [], []

    def refresh(log, classes, where=None):
        now[0] += 7.0 if 3 in classes else 1.0
        return {"of": classes}

    monkeypatch.setattr(cadence.refresh, "refresh", refresh)
    monkeypatch.setattr(cadence.refresh, "write", lambda made, out: written.append(made["of"]))
    sleep = lambda s: now.__setitem__(0, now[0] + s)
    done = cadence.run(lambda: reads.append(now[0]), "out", turns=70, clock=lambda: now[0], sleep=sleep, check=lambda made: ["bad"] if len(reads) == 2 else [])
    assert done[0] == (1, 2, 3) and done[1] == (1,) and len(reads) == 70 and len(written) == 69
    at = {c: [t for t, classes in zip(reads, done, strict=True) if c in classes] for c in (1, 2, 3)}
    gaps = {c: {round(b - a) for a, b in zip(t, t[1:], strict=False)} for c, t in at.items()}
    assert min(gaps[1]) == 5 and max(gaps[1]) <= 12 and all(60 <= g <= 68 for g in gaps[2]) and all(300 <= g <= 308 for g in gaps[3]) and len(at[3]) == 2


def test_differences_of_two_large_tables(spark):
    left = spark.range(600_000).select("id", (F.col("id") % 7).alias("n"), (F.col("id") / 100).cast("decimal(18,2)").alias("turnover"), F.col("id").cast("string").alias("name"), F.rand(1).alias("seen_at"))
    right = left.filter("id <> 17").withColumns({
        "turnover": F.when(F.col("id") == 30, F.col("turnover") + 5).when(F.col("id") == 31, F.col("turnover") + F.lit("0.01").cast("decimal(3,2)")).otherwise(F.col("turnover")).cast("decimal(18,2)"),
        "name": F.when(F.col("id") == 40, None).otherwise(F.col("name")), "seen_at": F.lit(0.0),
    }).unionByName(left.filter("id = 50")).unionByName(left.limit(1).withColumn("id", F.lit(None).cast("long")))
    found = D.differences(left, right, ["id"], ignored=("seen_at",))
    assert {(r["section"], r["id"], r["column"]) for r in found.collect()} == {("only_left", 17, None), ("only_right", None, None), ("values", 30, "turnover"), ("values", 40, "name"), ("repeated", 50, None)}
    shown = {(r["section"], r["column"]): r["n"] for r in rows(D.report(found))}
    assert shown == {("only_left", None): 1, ("only_right", None): 1, ("values", "turnover"): 1, ("values", "name"): 1, ("repeated", None): 1}
    assert D.differences(left, left, ["id"]).isEmpty()


def test_differences_of_odd_values(spark):
    a = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "x"), (None, 2.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, float("nan"), 3), (2, 1.0 + 1e-12, 4), (None, None, 5)], "k int, v double, more int")
    got = {(r["k"], r["column"], r["left"], r["right"]) for r in D.differences(a, b, ["k"]).collect()}
    assert got == {(2, "s", "x", None), (None, "s", "y", None), (None, "v", "2.0", None), (1, "more", None, "3"), (2, "more", None, "4"), (None, "more", None, "5")}
    assert D.differences(a, b, ["k"], ignored=("s", "more"), allowed={"v": 5.0}).count() == 1
