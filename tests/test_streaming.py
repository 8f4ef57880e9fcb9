import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wagerlens.operators import legs as L
from wagerlens.plans import artifacts as A
from wagerlens.sources import exports, sinks
from wagerlens.streaming import events as E, refresh


@pytest.fixture(scope="module")
def generated(spark):
    return E.generate(spark, 3000).cache()


def test_generator_repeats_itself_and_has_its_shape(spark, generated):
    again = E.generate(spark, 3000)
    assert generated.exceptAll(again).isEmpty() and again.exceptAll(generated).isEmpty()
    odd = generated.filter((F.col("event_kind") == "reversal") & (F.col("ggr") != F.col("turnover")))
    assert odd.isEmpty() and generated.filter("event_kind = 'reversal'").count() > 30 and generated.count() > 3030
    share = generated.filter("event_kind = 'placement'").agg(F.avg((F.col("bet_type") == "SIMPLE").cast("int")), F.avg((F.col("currency") == "EUR").cast("int"))).first()
    assert 0.74 < share[0] < 0.82 and 0.85 < share[1] < 0.91


def test_stream_equals_batch_in_any_order_and_on_replay(spark, generated, tmp_path):
    lines = tmp_path / "lines"
    sinks.write_events(generated.repartition(5), f"file:{tmp_path / 'written'}")
    lines.mkdir()
    for path in (tmp_path / "written").glob("*.txt"):
        (lines / path.name).write_text(path.read_text() + "\n\n")  # blank lines are skipped
    prints = []
    for run in ("one", "two"):
        source = E.read_event_files(spark, str(lines), streaming=True, files_per_trigger=1 if run == "one" else 3)
        E.ingest(source, str(tmp_path / run), str(tmp_path / f"{run}-check")).awaitTermination()
        # a restart finds nothing new
        E.ingest(E.read_event_files(spark, str(lines), streaming=True), str(tmp_path / run), str(tmp_path / f"{run}-check")).awaitTermination()
        prints.append(tuple(L.fingerprint(E.read_log(spark, str(tmp_path / run))).first()))
    batch = L.fingerprint(E.canonicalise(E.read_event_files(spark, str(lines)))).first()
    assert prints[0] == prints[1] == tuple(batch)
    assert E.read_log(spark, str(tmp_path / "one")).count() == generated.count()


def test_identity_ignores_how_prices_and_instants_are_written(spark):
    base = {"uid": "1", "bet_type": "SIMPLE", "match_id": 1, "market": "m", "player": "p", "selection": "s", "event_at": "2025-01-01T10:00:00Z"}
    texts = [json.dumps(base | {"placed_at": t, "price": 2.5}) for t in ("2025-01-01T09:00:00.000Z", "2025-01-01T09:00:00+00:00", "2025-01-01T10:00:00.000+01:00")]
    texts.append(json.dumps(base | {"placed_at": "2025-01-01T09:00:00.000Z"})[:-1] + ', "price": 2.500}')
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(F.from_json("v", E.EVENT).alias("e")).select("e.*")
    assert E.canonicalise(df).select("row_key").distinct().count() == 1


def test_blank_and_nan_currencies_are_unknown(spark):
    df = spark.createDataFrame([(c,) for c in ("", " ", "nan", "EUR", None)], "currency string")
    for name in [f.split()[0] for f in E.EVENT.split(", ")]:
        if name != "currency":
            kind = [f.split()[1] for f in E.EVENT.split(", ") if f.split()[0] == name][0]
            df = df.withColumn(name, F.lit(None).cast(kind))
    assert [r["currency"] for r in E.canonicalise(df).collect()] == [None, None, None, "EUR", None]


def test_keyed_log_keeps_a_uid_in_one_partition(generated):
    spread = sinks.keyed(generated).withColumn("part", F.spark_partition_id()).groupBy("key").agg(F.countDistinct("part").alias("n"))
    assert spread.filter("n > 1").isEmpty()


def test_latest_state_runs_as_a_stream(spark, generated, tmp_path):
    sinks.write_events(generated.repartition(2), f"file:{tmp_path / 'in'}")
    query = E.latest_state(E.read_event_files(spark, str(tmp_path / "in"), streaming=True)).writeStream.outputMode("complete").format("memory").queryName("latest_state_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("latest_state_test").count() == L.collapse(E.canonicalise(generated)).count()


def test_stream_and_batch_agree_where_versions_tie(spark, tmp_path):
    base = dict(uid="1", placed_at="2025-06-01T10:00:00.000Z", event_at="2025-06-01T12:00:00.000Z", bet_type="SIMPLE", match_id=1, fixture="F", competition="C", market="M", player="P", selection="1",
                region="R", currency="EUR", price=2.0, turnover=10.0, net_revenue=0.1, source="s", is_inplay=0, minutes_to_kickoff=-120.0, emitted_at=5)
    events = [base | {"event_kind": k, "ggr": g} for k, g in (("settlement", -3.0), ("reversal", 10.0), ("placement", 0.0))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, events)) + "\n")
    query = E.latest_state(E.read_event_files(spark, str(tmp_path / "in"), streaming=True)).writeStream.outputMode("complete").format("memory").queryName("ties_test").trigger(availableNow=True).start()
    query.awaitTermination()
    now = L.collapse(E.canonicalise(E.read_event_files(spark, str(tmp_path / "in")))).first()
    assert [(r["event_kind"], r["ggr"]) for r in spark.table("ties_test").collect()] == [(now["event_kind"], now["ggr"])] == [("reversal", now["ggr"])]
    assert all(v == 0 for v in E.lag(query.lastProgress).values())
    assert E.lag({"sources": [{"description": "k", "latestOffset": {"t": {"0": 7, "1": 3}}, "endOffset": {"t": {"0": 5}}}, {"description": "f", "latestOffset": {"logOffset": 3}, "endOffset": {"logOffset": 1}}]}) == {"k": 5, "f": 2}


def test_a_predicate_reaches_every_section(spark, generated):
    made = refresh.refresh(E.canonicalise(generated), (1,), where="match_id < 100")
    universe = made["overview"]["data"]["universe"][0]
    assert 0 < universe["legs"] < L.collapse(E.canonicalise(generated)).count() and A.check_invariants(made) == []
    assert {"by_selection", "by_player"} <= set(made["flow"]["data"]) and made["overview"]["meta"]["where"] == "match_id < 100"


def test_windows_over_a_stream(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(2).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    query = E.windowed_counts(stream, size="1 day", late="10000 days").writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows_test").agg(F.sum("n")).first()[0] == source.count()


def test_refresh_touches_its_class_only_and_holds_invariants(spark, generated, tmp_path):
    log = E.canonicalise(generated)
    first = refresh.refresh(log, (1,))
    refresh.write(first, str(tmp_path))
    assert {p.stem for p in tmp_path.glob("*.json")} == {"overview", "flow", "timing"}
    everything = refresh.refresh(log)
    assert A.check_invariants(everything) == []
    assert A.compare(first["overview"]["data"], everything["overview"]["data"]) == [] and first["flow"]["hash"] == everything["flow"]["hash"]
    meta = everything["overview"]["meta"]
    assert meta["pending_supersedence"] == meta["rows_stored"] - meta["identities"] > 0
    broken = json.loads(json.dumps(everything))
    broken["flow"]["data"]["by_market"]["rows"][0]["legs"] += 1
    assert any("market" in f for f in A.check_invariants(broken)) and any("hash" in f for f in A.check_invariants(broken))


def test_refresh_cuts_long_tables_with_an_account(spark, monkeypatch):
    names = ("uid", "cluster_size", "placed_at", "excess_ratio", "share", "day", "match_id", "score")
    many = spark.range(60).selectExpr(*[f"id AS {n}" for n in names], "'EUR' AS currency", "true AS flagged")
    monkeypatch.setattr(refresh.leg_ops, "betslips", lambda legs: legs)
    monkeypatch.setattr(refresh.prices, "attach_value", lambda legs: legs)
    monkeypatch.setattr(refresh.sharp, "score", lambda priced: many)
    for name in ("turnover_spikes", "abnormal_exposure", "same_second_clusters"):
        monkeypatch.setattr(refresh.anomalies, name, lambda rows: many)
    data = refresh._anomalies(many) | {"flagged": refresh._sharp(many)["flagged"]}
    accounts = data.pop("truncation") | refresh._sharp(many)["truncation"]
    assert len(data) == 4 and all([r["uid"] for r in rows_] == list(range(59, 9, -1)) for rows_ in data.values())
    assert all(accounts[name] == {"total": 60, "shipped": 50, "omitted": 10} for name in data)


def test_log_is_partitioned_and_compacted(spark, generated, tmp_path):
    path = str(tmp_path / "log")
    rows_ = E.canonicalise(generated).drop("placed_month")
    sinks.append_log(rows_.limit(500), path)
    sinks.append_log(rows_, path)
    table = spark.read.parquet(path)
    month = table.first()["placed_month"]
    before = L.fingerprint(table).first()
    assert max(r["files"] for r in rows(sinks.file_counts(table))) > 1
    for m in [r["placed_month"] for r in table.select("placed_month").distinct().collect()]:
        sinks.compact_month(spark, path, m, L.collapse)
    spark.catalog.clearCache()
    after = spark.read.parquet(path)
    assert tuple(L.fingerprint(after).first()) == tuple(before) and after.count() == before["n_rows"] and month


def test_exports(spark, tmp_path):
    head = ",".join(exports.COLUMNS)
    good = 'Football,L,7,"A v B",02/06/2025 18:00:00,Shots {PLAYER},SIMPLE,P,Over,01/06/2025 10:00:00,00123,RETA X,2.5,10.00,-3.50,-0.28,EUR'
    bad = "Football,L,7,A v B,,1X2,SIMPLE,P,1,junk,U1,X,abc,1,1,1,"
    (tmp_path / "book-01062025_101500.csv").write_text("\n".join([head, good, bad]) + "\n")
    (tmp_path / "other.csv").write_text("\n".join([head, good]) + "\n")
    df = exports.read_exports(spark, str(tmp_path))
    got = rows(df)
    assert {r["uid"] for r in got} == {"00123", "U1"} and {r["version"] for r in got} == {0, 1748772900000}
    odd = [r for r in got if r["uid"] == "U1"][0]
    assert odd["placed_at"] is None and odd["price"] is None and odd["currency"] is None
    assert L.cross_source_overlap(df.drop("version")).first()["overlap"] == 1
    sent = rows(exports.to_events(df))
    assert len(sent) == 2 and all(r["minutes_to_kickoff"] == -1920.0 and r["is_inplay"] == 0 for r in sent)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        exports.read_exports(spark, str(tmp_path / "none*.csv")).count()


def test_report_values(tmp_path):
    assert A.plain({"turnover": 1.005, "share": 0.123456, "x": float("nan"), "y": float("inf"), "n": 3}) == {"n": 3, "share": 0.1235, "turnover": 1.0, "x": None, "y": None}
    assert A.payload_hash({"a": 1, "b": 2}) == A.payload_hash({"b": 2, "a": 1}) and len(A.payload_hash({})) == 16
    assert A.compare({"turnover": 1.0, "n": 1}, {"turnover": 1.005, "m": 2}) == ["/m: on one side only", "/n: on one side only"]
    assert A.money_shape({"rows": [{"currency": "EUR", "turnover": 1.0}, {"turnover": 2.0}]}) == ["/rows[1]/turnover"]
    sinks.write_json({"a": "ñ"}, tmp_path / "deep" / "x.json")
    assert json.loads((tmp_path / "deep" / "x.json").read_text()) == {"a": "ñ"} and len(list((tmp_path / "deep").iterdir())) == 1
    with pytest.raises(ValueError):
        sinks.write_json({"a": float("nan")}, tmp_path / "y.json")
    assert A.resolve_ref({"s": {"t": [{"k": "a", "v": 1}, {"k": "b"}]}}, "s/t#k=a") == [{"k": "a", "v": 1}]


def test_truncation_reconciles(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "n int, stake double")
    shown, account = A.truncate(df, [F.desc("n")], 3, stake="stake")
    assert [r["n"] for r in shown] == [9, 8, 7] and account == {"total": 10, "shipped": 3, "omitted": 7, "omitted_stake": 21.0}
