import json

from conftest import rows
from pyspark.sql import functions as F

from wagerlens.__main__ import main
from wagerlens.plans import payload as P
from wagerlens.sources import exports
from wagerlens.streaming.events import generate


def write_export(spark, folder, name, df):
    """Legs of the generator as a billing export."""
    back = {v: k for k, v in exports.COLUMNS.items()}
    stamp = lambda c: F.date_format(F.to_timestamp(c), "dd/MM/yyyy HH:mm:ss")
    out = df.filter("event_kind = 'placement'").select(
        F.lit("Football").alias("sport"), "competition", "match_id", "fixture", stamp("event_at").alias("event_at"), "market", "bet_type", "player", "selection",
        stamp("placed_at").alias("placed_at"), "uid", F.col("region").alias("management_unit"), "price", "turnover", "ggr", "net_revenue", "currency",
    ).withColumnsRenamed(back).select(*exports.COLUMNS)
    folder.mkdir(parents=True, exist_ok=True)
    out.toPandas().to_csv(folder / name, index=False)


def test_build_check_and_drift(spark, tmp_path):
    events = generate(spark, 1500)
    write_export(spark, tmp_path / "raw", "book-01062025_101500.csv", events)
    run = ["build", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "out")]
    assert main(run) == 0
    payload = json.loads((tmp_path / "out" / "payload.json").read_text())
    assert P.check(payload) == [] and set(payload) == {"overview", "data_quality", "flow", "timing", "prices", "concentration", "anomalies", "sharp", "meta"}
    assert payload["overview"]["universe"]["legs"] > 1400 and len(payload["timing"]["phases"]["rows"]) == 10
    assert main([*run, "--check"]) == 0
    write_export(spark, tmp_path / "raw", "more-02062025_101500.csv", generate(spark, 200, seed=8))
    assert main([*run, "--check"]) == 1
    broken = json.loads(json.dumps(payload))
    broken["flow"]["by_market"]["rows"][0]["legs"] += 1
    assert len(P.check(broken)) >= 2


def test_commands_of_the_stream(spark, tmp_path):
    assert main(["generate", "--events", "400", "--sink", f"file:{tmp_path / 'lines'}"]) == 0
    assert main(["ingest", "--source", str(tmp_path / "lines"), "--log", str(tmp_path / "log"), "--checkpoint", str(tmp_path / "check")]) == 0
    assert main(["refresh", "--log", str(tmp_path / "log"), "--out", str(tmp_path / "out"), "--classes", "1"]) == 0
    assert {p.stem for p in (tmp_path / "out").glob("*.json")} == {"overview", "flow", "timing"}
    assert spark.read.parquet(str(tmp_path / "log")).count() > 400


def test_command_of_reconciliation(spark, tmp_path):
    from test_reconcile import ALPHA, BETA

    (tmp_path / "m_alpha.json").write_text(json.dumps(ALPHA))
    (tmp_path / "m_beta.json").write_text(json.dumps(BETA))
    assert main(["reconcile", "--alpha", str(tmp_path / "m_alpha.json"), "--beta", str(tmp_path / "m_beta.json"), "--out", str(tmp_path / "out")]) == 0
    (doc,) = json.loads((tmp_path / "out" / "canonical.json").read_text())
    assert doc["score"]["value"] == {"home": 2, "away": 1} and len(json.loads((tmp_path / "out" / "reviews.json").read_text())) == len(doc["reviews"])
    assert rows(spark.range(1))


def test_findings(spark, tmp_path):
    import pytest

    from wagerlens.operators import findings
    from wagerlens.plans import artifacts
    from wagerlens.sources.sinks import write_json

    assert [findings.freshness(s) for s in (None, 3, 100, 500, 5000)] == ["unknown", "fresh", "ageing", "stale", "down"] and findings.oldest([1, 9]) == 9 and findings.oldest([]) is None
    with pytest.raises(ValueError):
        findings.by_dimension(None, None, "uid; drop table")
    write_json(artifacts.envelope("a", {"n": 1}, {}), tmp_path / "a.json")
    assert artifacts.read_artifacts(str(tmp_path)) == {"a": {"n": 1}}
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert artifacts.dataset_fingerprint(spark.read.parquet(str(tmp_path / "p"))) == artifacts.dataset_fingerprint(spark.read.parquet(str(tmp_path / "p")))
    table = spark.createDataFrame([("Alpha", 1), ("beta", 3), ("ALPINE", 2)], "label string, n int")
    assert [r["label"] for r in findings.view(table, label="label", contains="alp", order="n").collect()] == ["ALPINE", "Alpha"]
