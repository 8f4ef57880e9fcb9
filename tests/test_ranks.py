"""Ranks, running sums and order statistics against numpy, and bounds on what a task gets."""

import numpy as np
import pytest
from conftest import rows
from legs_data import leg, legs_of
from pyspark.sql import functions as F

from wagerlens.functions import ranks
from wagerlens.operators import breakdown, legs as L


@pytest.mark.parametrize("kind", ["uniform", "one octave", "few", "one"])
def test_running_sums_equal_cumsum(spark, kind):
    rng = np.random.default_rng(4)
    values = {"uniform": rng.integers(0, 10**9, 900), "one octave": rng.integers(2**30, 2**30 + 5000, 900), "few": np.array([3, 3, 9, 1]), "one": np.array([7])}[kind]
    got = {}
    for key in "ab":
        kinds, many = np.unique(values + (key == "b"), return_counts=True)
        got[key] = (kinds, many)
    df = spark.createDataFrame([(k, int(v), int(n)) for k, (kinds, many) in got.items() for v, n in zip(kinds, many, strict=True)], "k string, v long, n long").repartition(3)
    out = ranks.running(df, "v", ["n"], ["k"])
    for key, (kinds, many) in got.items():
        mine = sorted((r["v"], r["upto_n"], r["all_n"]) for r in out.collect() if r["k"] == key)
        assert mine == [(int(v), int(c), int(many.sum())) for v, c in zip(kinds, np.cumsum(many), strict=True)]
    whole = sorted((r["v"], r["upto_n"]) for r in ranks.running(df.filter("k = 'a'").drop("k"), "v", ["n"], []).collect())
    assert whole == [(int(v), int(c)) for v, c in zip(got["a"][0], np.cumsum(got["a"][1]), strict=True)]


def test_null_keys_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 5, 2)], "k string, v long, n long")
    assert {(r["k"], r["v"], r["upto_n"]) for r in ranks.running(df, "v", ["n"], ["k"]).collect()} == {(None, 1, 1), (None, 2, 2), ("a", 5, 2)}
    assert ranks.running(df.limit(0), "v", ["n"], []).count() == 0 and ranks.quantile(df.limit(0), "v", 0.5, ["k"]).count() == 0
    assert {(r["k"], r["result"]) for r in ranks.quantile(df, "v", 0.5, ["k"]).collect()} == {(None, 1.5), ("a", 5.0)}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_equal_percentile(spark, q):
    rng = np.random.default_rng(5)
    data = [("x", int(v)) for v in np.round(np.exp(rng.normal(8, 3, 801)))] + [("y", int(v)) for v in rng.integers(-50, 50, 400)] + [("z", None), ("w", -(2**58)), ("w", 2**58)]
    df = spark.createDataFrame(data, "k string, v long").repartition(4)
    mine = {r["k"]: r["result"] for r in ranks.quantile(df, "v", q, ["k"], scale=100.0).collect()}
    wanted = {r["k"]: r["p"] for r in df.groupBy("k").agg(F.percentile(F.col("v") / F.lit(100.0), F.lit(q)).alias("p")).filter("p IS NOT NULL").collect()}
    assert mine.keys() == wanted.keys() and all(mine[k] == pytest.approx(wanted[k], rel=1e-12) for k in mine)
    with pytest.raises(ValueError):
        ranks.quantile(spark.createDataFrame([("w", -(2**62)), ("w", 2**62)], "k string, v long"), "v", 0.5, ["k"])


def test_ten_million_values_of_one_currency(spark):
    df = spark.range(10_000_000, numPartitions=8).select(F.lit("EUR").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**11))).alias("v"))
    (got,) = ranks.quantile(df, "v", 0.9, ["k"]).collect()
    assert df.filter(F.col("v") < got["low"]).count() == int(0.9 * 9_999_999) and got["low"] <= got["result"] <= got["high"]
    values = df.groupBy("v").agg(F.count("*").alias("n")).filter("v < 2000000000")
    last = ranks.running(values, "v", ["n"], []).orderBy(F.desc("v")).first()
    assert last["upto_n"] == last["all_n"] == df.filter("v < 2000000000").count()


def plain_betslips(data, key, top_n):
    counts = {}
    for k, _ in data:
        counts[k] = counts.get(k, 0) + 1
    head = sorted(counts, key=lambda k: (-counts[k], k))[:top_n]
    out = {}
    for k, s in data:
        out.setdefault(k if k in head else "__other__", set()).add(s)
    return {k: len(s) for k, s in out.items()}


@pytest.mark.parametrize("top_n", [2, 61, 62, 70])
def test_betslips_by_bits_equal_sets(spark, top_n):
    rng = np.random.default_rng(top_n)
    data = [(f"k{int(k):02d}", f"s{int(s)}") for k, s in zip(rng.integers(0, 80, 900) ** 2 // 80, rng.integers(0, 200, 900), strict=True)]
    df = spark.createDataFrame(data, "key string, betslip_id string").withColumns({"currency": F.lit("EUR"), "turnover": F.lit(1).cast("decimal(18,2)")})
    counts, _ = breakdown.breakdown(df, "key", top_n=top_n)
    assert {r["key"]: r["betslips"] for r in counts.collect()} == plain_betslips(data, "key", top_n)


def test_universe_of_nulls_is_one_scan(spark):
    df = legs_of(spark, [leg("a"), leg("b", uid="8", bet_type="COMBINED"), leg("c", uid="8", bet_type="COMBINED", match_id=2, lead=-5), (*leg("n")[:4], None, None, None, None, *leg("n")[8:])])
    (u,) = rows(L.universe(df))
    assert (u["legs"], u["betslips"], u["uids"], u["fixtures"], u["competitions"], u["markets"], u["inplay_legs"], u["first_day"]) == (4, 3, 2, 2, 1, 2, 1, "2025-06-01")
    assert L.universe(df)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
