"""Class 1 kept up by corrections: equal to a recomputation after every batch, reading touched months only."""

import random

import pytest
from conftest import rows
from legs_data import SCHEMA, leg
from pyspark.sql import functions as F

from wagerlens.operators import legs as L
from wagerlens.plans import artifacts as A
from wagerlens.sources import sinks
from wagerlens.streaming import events as E, partials, refresh

LOG = SCHEMA + ", event_kind string"
MONTH = 60 * 24 * 31
MARKETS = ["1X2", "Shots {PLAYER}", "Anytime goalscorer", "{COMPETITOR1}", "Corners"]


def stream(n, seed=11):
    """n batches over four months: new bets of several legs a second, reversals, changed labels, late and repeated versions."""
    rng, seen, out = random.Random(seed), [], []
    for b in range(n):
        data = []
        for i in range(10):
            if seen and rng.random() < 0.5:
                key, kw = rng.choice(seen)  # a version of a leg that is there: newer, older or the same
                data.append((*leg(key, **kw | {"version": rng.choice([1, 2, 50 + b]), "turnover": rng.choice(["10.00", "12.00"]), "unit": rng.choice(["RETA A", "B"]), "ggr": f"{rng.randrange(-9, 9)}.00", "currency": rng.choice(["EUR", "PEN", None])}), rng.choice(["settlement", "reversal"])))
            else:
                key, kw = f"k{b}-{i}", {
                    "uid": str(rng.randrange(4)), "minutes": rng.choice([0, 0, 1, 2, 3]) * MONTH + rng.randrange(3), "bet_type": rng.choice(["SIMPLE", "COMBINED"]), "match_id": rng.randrange(25),
                    "market": rng.choice(MARKETS), "player": rng.choice(["Shots on target Harry Kane", "Shots on target Bukayo Saka", None]), "selection": rng.choice(["1", "2", "Cole Palmer", "X"]),
                    "lead": rng.choice([-70, -3, 0, 4, 30, 2000]), "price": rng.choice(["2.000", "1.500"]),
                }
                seen.append((key, kw))
                data.append((*leg(key, **kw | {"version": 2}), "placement"))
        out.append(data)
    return out


def state(parts):
    """All rows of cells and sets, in one job."""
    shown = [p.select(F.to_json(F.struct(*sorted(p.columns))).alias("v")) for p in parts]
    return sorted(r["v"] for r in shown[0].unionAll(shown[1]).collect())


@pytest.fixture(autouse=True)
def interpreted(spark):
    """A few rows in many plans: compiling them would take longer than running them."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_corrections_equal_a_recomputation_after_each_of_twenty_batches(spark, tmp_path):
    log, kept, whole = str(tmp_path / "log"), str(tmp_path / "partials"), []
    batches = stream(20)
    batches[7] = batches[5]  # delivered again as a batch of its own
    for b, data in enumerate(batches):
        df = spark.createDataFrame(data, LOG)
        whole += data
        sinks.append_log(df, log, batch=f"b{b:02d}")
        months = partials.update(spark.read.parquet(log), df, kept, f"b{b:02d}")
        assert set(months) == {r["m"] for r in df.select(F.date_format("placed_at", "yyyy-MM").alias("m")).distinct().collect()}
        if b % 6 == 4:  # the batch fails after its corrections were written, and runs again
            partials.update(spark.read.parquet(log), df, kept, f"b{b:02d}")
        wanted, have = partials.contributions(refresh.snapshot(spark.createDataFrame(whole, LOG))), partials.current(spark, kept)
        assert state(have) == state(wanted), b
    once, full = partials.class_one(spark, kept), refresh.refresh(E.read_log(spark, log), (1,))
    for name in full:
        assert A.compare(once[name]["data"], full[name]["data"]) == [] and len(once[name]["data"]) == len(full[name]["data"])
        assert all(once[name]["meta"][k] == full[name]["meta"][k] for k in ("position", "rows_stored", "identities", "pending_supersedence"))
    # folding a month changes what is stored, not what it says
    before = state(partials.current(spark, kept))
    month = rows(spark.read.parquet(log).select("placed_month").distinct())[0]["placed_month"]
    sinks.compact_month(spark, log, month, L.collapse)
    spark.catalog.clearCache()
    partials.fold(spark, kept, month, spark.read.parquet(log).filter(F.col("placed_month") == month).count())
    assert state(partials.current(spark, kept)) == before
    assert {r["batch"] for r in partials.read(spark, kept, "cells").filter(F.col("placed_month") == month).select("batch").distinct().collect()} == {"fold"}


def test_a_tick_reads_touched_months_only(spark, tmp_path):
    log, kept = tmp_path / "log", str(tmp_path / "partials")
    first = spark.createDataFrame([(*leg("a"), "placement"), (*leg("b", minutes=MONTH), "placement")], LOG)
    sinks.append_log(first, str(log), batch="b0")
    partials.update(spark.read.parquet(str(log)), first, kept, "b0")
    for path in (log / "placed_month=2025-07").rglob("*.parquet"):  # a month that can't be read
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        path.write_bytes(b"PAR1 broken PAR1")
    late = spark.createDataFrame([(*leg("a", version=9, ggr="-5.00"), "reversal"), (*leg("c", bet_type="COMBINED"), "placement")], LOG)
    sinks.append_log(late, str(log), batch="b1")
    table = spark.read.schema(first.schema.add("placed_month", "string").add("batch", "string")).parquet(str(log))
    assert partials.update(table, late, kept, "b1") == ["2025-06"]
    universe = partials.class_one(spark, kept)["overview"]["data"]["universe"][0]
    assert (universe["legs"], universe["betslips"], universe["last_day"]) == (3, 3, "2025-07-02")


def test_nothing_yet(spark, tmp_path):
    made = partials.class_one(spark, str(tmp_path / "none"))
    assert made["overview"]["data"]["universe"][0]["legs"] == 0 and len(made["timing"]["data"]["phases"]["rows"]) == 10 and A.check_invariants(made) == []
