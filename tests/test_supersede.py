"""The stateful stream of changes against the collapse of all versions."""

import json
import random

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from wagerlens.operators import legs as L
from wagerlens.streaming import events as E, supersede

BASE = dict(
    placed_at="2025-06-01T10:00:00.000Z", event_at="2025-06-01T12:00:00.000Z", bet_type="SIMPLE", match_id=1, fixture="F", competition="C", market="M", player="P", selection="1",
    region="R", currency="EUR", price=2.0, net_revenue=0.1, source="s", is_inplay=0, minutes_to_kickoff=-120.0,
)


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, events)) + "\n")


def test_changes_equal_the_collapse_over_files_in_any_order_and_a_restart(spark, tmp_path):
    rng = random.Random(3)
    versions = [
        BASE | {"uid": str(u), "emitted_at": v, "event_kind": rng.choice(["placement", "settlement", "reversal", None]), "ggr": rng.choice([-3.0, 10.0, None]), "turnover": rng.choice([10.0, 11.0]), "fixture": rng.choice(["F", "G"])}
        for u in range(12) for v in (1, 1, 2, 3, 3, 3)
    ]
    rng.shuffle(versions)
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: supersede.write_changes(E.read_event_files(spark, str(source), streaming=True), out, check).awaitTermination()
    for i in range(2):
        write(source, f"{i}.json", versions[i * 30 : i * 30 + 30])
    run()
    write(source, "2.json", versions[60:] + versions[:20])  # late versions and repeated ones, after a restart
    run()
    made = spark.read.parquet(out)
    last = made.withColumn("n", F.row_number().over(Window.partitionBy("row_key").orderBy(F.desc("batch")))).filter("n = 1").drop("n", "batch", "replaced_version")
    wanted = L.collapse(E.canonicalise(E.read_event_files(spark, str(source))).drop("placed_month"))
    assert rows(last.select(*wanted.columns)) == rows(wanted)
    # changes only: once a batch for an identity, each after the one it replaces
    assert made.groupBy("row_key", "batch").count().filter("count > 1").isEmpty()
    chain = {}
    for r in made.orderBy("batch").collect():
        assert r["replaced_version"] == chain.get(r["row_key"]) and (r["replaced_version"] or 0) <= r["version"]
        chain[r["row_key"]] = r["version"]
    count = made.count()
    write(source, "3.json", versions)  # all of it again
    run()
    assert spark.read.parquet(out).count() == count
