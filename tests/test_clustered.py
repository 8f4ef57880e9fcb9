"""The clustered log: collapse without exchange, pruned months, compaction; and the order of versions."""

import random

import pytest
from conftest import rows
from legs_data import SCHEMA, leg
from pyspark.sql import functions as F

from wagerlens.operators import findings, legs as L
from wagerlens.sources import pruning
from wagerlens.streaming import clustered, events as E

LOG = SCHEMA + ", event_kind string"
MONTH = 60 * 24 * 31


def batches(n=4, seed=1):
    """Batches of versions over three months: placements, later and earlier versions, repeats and ties."""
    rng = random.Random(seed)
    keys = [(f"k{i}", rng.choice([0, 1, 2]) * MONTH + i) for i in range(60)]
    return [
        [(*leg(k, minutes=m, uid=str(m % 9), version=rng.randrange(5), ggr=f"{rng.randrange(-3, 4)}.00", turnover=f"{rng.choice([10, 10, 11])}.00"), rng.choice(["placement", "settlement", "reversal"])) for k, m in rng.choices(keys, k=40)]
        for _ in range(n)
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(spark, make):
    """Files that the scans of make() open, once their folders are pruned."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        leaves = make()._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(i).selectedPartitions().totalNumberOfFiles() for i in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered") / "log")
    for i, data in enumerate(batches()):
        clustered.append(spark.createDataFrame(data, LOG), path, batch=f"b{i}", buckets=4)
    return path


def whole(spark):
    return spark.createDataFrame([r for data in batches() for r in data], LOG)


def test_current_state_needs_no_exchange_and_equals_the_plain_collapse(spark, log):
    now = clustered.current(spark, log)
    assert "Exchange" not in plan_of(now) and "Bucketed: true" in plan_of(now)
    assert rows(now.drop("placed_month")) == rows(L.collapse(whole(spark)))


def test_a_repeated_batch_replaces_itself(spark, log):
    before = rows(clustered.read(spark, log))
    clustered.append(spark.createDataFrame(batches()[2], LOG), log, batch="b2", buckets=4)
    assert rows(clustered.read(spark, log)) == before


def test_placed_at_prunes_months(spark, log):
    everything = files_read(spark, lambda: clustered.current(spark, log))
    read_some = lambda: clustered.current(spark, log, "placed_at >= '2025-07-01' AND placed_at < '2025-07-31' AND match_id = 1")
    some = read_some()
    assert "Exchange" not in plan_of(some) and "placed_month" in plan_of(some).split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < files_read(spark, read_some) < everything
    wanted = L.collapse(whole(spark).filter("placed_at >= '2025-07-01' AND placed_at < '2025-07-31'"))
    assert rows(some.drop("placed_month")) == rows(wanted)
    june = lambda: findings.current_legs(clustered.read(spark, log), "placed_at < timestamp '2025-06-30 00:00:00'")
    assert files_read(spark, june) < everything and {r["placed_month"] for r in rows(june())} == {"2025-06"}


def test_compacted_months_need_no_sort(spark, tmp_path):
    path = str(tmp_path / "log")
    for i, data in enumerate(batches()):
        clustered.append(spark.createDataFrame(data, LOG), path, batch=f"b{i}", buckets=4)
    before = rows(clustered.current(spark, path))
    assert "Sort " in plan_of(clustered.current(spark, path, "placed_at < '2025-07-01'"))
    for month in sorted({r["placed_month"] for r in before}):
        clustered.compact(spark, path, month)
    assert rows(clustered.current(spark, path)) == before
    june = clustered.current(spark, path, "placed_at < '2025-07-01'")
    assert "Sort " not in plan_of(june) and "Exchange" not in plan_of(june) and "SortAggregate" in plan_of(june)
    assert clustered.read(spark, path).count() == len(before)
    clustered.append(spark.createDataFrame([(*leg("k1", minutes=1, version=99), "reversal")], LOG), path, buckets=4)
    assert {r["version"] for r in rows(clustered.current(spark, path)) if r["row_key"] == "k1"} == {99}


def test_opening_a_log_that_is_not_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        clustered.open_log(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(
    "where,months",
    [
        ("placed_at >= '2025-07-02'", {"2025-07", "2025-08"}), ("(placed_at < timestamp '2025-07-01 10:00:00') and uid in ('1', '2')", {"2025-06", "2025-07"}),
        ("placed_at between '2025-07-03' and '2025-07-20'", {"2025-07"}), ("placed_at = '2025-08-03 10:00:00'", {"2025-08"}), ("match_id = 3", None),
        ("uid = 'x and placed_at > ''2026''' and match_id = 1", None), ("placed_at > '2025-07-01' or match_id = 1", None), ("not (uid = '1' and placed_at > '2025-07-01')", None),
        ("isnull(uid = '1' and placed_at > '2025-07-01')", None), ("false = (uid = '1' and placed_at > '2025-07-01')", None), ("price between 1 and 3 and (uid = '1' and placed_at > '2025-08-01')", {"2025-08"}),
    ],
)
def test_months_of_a_condition(spark, where, months):
    condition = pruning.months_of(where)
    months_there = spark.createDataFrame([(m,) for m in ("2025-06", "2025-07", "2025-08")], "placed_month string")
    assert (condition is None) if months is None else {r[0] for r in months_there.filter(condition).collect()} == months


def test_collapse_and_fingerprint_do_not_depend_on_the_order_of_rows(spark):
    rng, data = random.Random(5), [r for b in batches(6, seed=3) for r in b]
    prints, states = set(), set()
    for _ in range(4):
        rng.shuffle(data)
        df = spark.createDataFrame(data, LOG).repartition(rng.randrange(1, 5))
        prints.add(tuple(L.fingerprint(df).first()))
        states.add(repr(rows(L.collapse(df.select(*rng.sample(df.columns, len(df.columns))).select(*df.columns)))))
    assert len(prints) == len(states) == 1


def test_fingerprint_tells_nulls_and_separators_apart(spark):
    made = lambda **kw: L.fingerprint(spark.createDataFrame([(*leg("a", **kw), "placement")], LOG)).first()["digest"]
    assert len({made(market="a|b", player="c"), made(market="a", player="b|c"), made(player=""), made(player=None)}) == 4


def test_a_plain_log_is_pruned_too(spark, tmp_path):
    from wagerlens.sources.sinks import append_log

    append_log(whole(spark), str(tmp_path / "log"))
    everything = lambda: E.read_log(spark, str(tmp_path / "log"))
    some = lambda: pruning.pruned(everything(), "placed_at >= '2025-08-01'")
    assert {r["placed_month"] for r in rows(some())} == {"2025-08"} and 0 < files_read(spark, some) < files_read(spark, everything)
    assert some().count() == whole(spark).filter(F.col("placed_at") >= "2025-08-01").count()
