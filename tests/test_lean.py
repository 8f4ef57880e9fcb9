"""Plans of large books: what is left out, joined by codes or kept apart gives the same rows."""

from conftest import rows
from legs_data import SCHEMA, leg

from pyspark.sql import functions as F

from wagerlens.functions import lookups
from wagerlens.functions.lookups import bitmap, looked_up, lookup, several, sieved
from wagerlens.operators import anomalies, legs as L, prices, sharp
from wagerlens.operators.prices import attach_value
from wagerlens.sources.staged import written


def book(spark):
    data = [leg(f"k{i}", uid=u, minutes=i // 4, match_id=i % 3, selection=s, bet_type=b, price=p, currency=c, version=i) for i, (u, s, b, p, c) in enumerate(
        (u, s, b, p, c) for u in ("7", "8", "x") for s in ("1", "2") for b in ("SIMPLE", "COMBINED") for p in ("2.000", "2.100", None) for c in ("EUR", None)
    )]
    data += [leg("rare", uid="9"), leg("null", uid="7", selection=None), *[leg("twin", uid="8", match_id=2, minutes=3)] * 3]
    return spark.createDataFrame(data, SCHEMA)


def test_backing_of_likely_legs_is_that_of_the_book(spark):
    df = book(spark)
    whole = attach_value(L.enrich(df))
    some = anomalies.may_repeat(L.facts(df))
    assert rows(anomalies.repeat_backing(some)) == rows(anomalies.repeat_backing(whole)) != []
    assert "rare" not in {r["row_key"] for r in some.collect()}


def test_looked_up_is_a_join(spark):
    table = spark.createDataFrame([(-3, "a", None), (0, None, 1), (4095, "b", 1), (4096, "a", None), (4100, None, None), (None, "c", 2)], "k long, name string, n int")
    data = spark.createDataFrame([(k, i) for i, k in enumerate([-3, -3, 0, 4095, 4096, 4097, 4100, 99999, None])], "key long, i int")
    found = lookup(table, "k", ["name", "n"])
    values = found.values("code")
    got = looked_up(data, "key", found, "code").select("key", "i", values["name"].alias("name"), values["n"].alias("n"))
    assert rows(got) == rows(data.join(table, data["key"] == table["k"]).drop("k"))
    assert lookup(table.union(table), "k", ["name"]) is None and lookup(table.limit(0), "k", ["name"]) is None
    assert lookup(spark.createDataFrame([(0,), (1 << 60,)], "k long").selectExpr("k", "'x' AS name"), "k", ["name"]) is None  # too sparse


def test_sieve_keeps_all_that_repeats(spark):
    df = spark.range(3000).selectExpr("id", "id % 2000 AS v")
    within = bitmap(several(df, ["v"]))
    kept, rest = sieved(df, ["v"], within), sieved(df, ["v"], within, inside=False)
    assert {r["v"] for r in kept.collect()} >= set(range(1000)) and kept.count() < 2500
    assert kept.union(rest).count() == 3000 and kept.intersect(rest).count() == 0


def test_written_leaves_no_shuffle_files(spark):
    df = spark.range(100_000).repartition(4, "id").groupBy("id").count()
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before = files()
    df = written(df)
    assert not files() - before
    assert df.count() == 100_000


def test_slices_and_late_keys_give_the_book_s_values(spark, monkeypatch):
    monkeypatch.setattr(lookups, "SLICE_ROWS", 20)
    df = written(L.facts(book(spark)))
    whole = attach_value(L.enrich(df))
    late = df.withColumn("as_key", F.col("row_key")).drop("row_key")
    groups = prices.large_price_groups(df)
    priced = lambda of_slice: attach_value(of_slice(late), groups=of_slice(groups), row_key=F.col("as_key"))
    names = [*df.columns, "reference_price", "value_winsorised", "value_eligible", "reference_is_own_bet", "group_leg_count", "group_price_moves"]
    assert rows(lookups.in_slices(df, "match_id", lambda f: priced(f).select(*names))) == rows(whole.select(*names))
    sums = written(sharp.added(lookups.in_slices(df, "match_id", lambda f: sharp.unit_sums(sharp.scoring_units(priced(f))))))
    wanted = sharp.score(whole, least_betslips=1, least_units=1)
    got = sharp.score_sums(sums, sharp.betslips_by_uid(df), least_betslips=1, least_units=1)
    assert rows(got) == rows(wanted.select(*got.columns)) != []
    assert rows(sharp.dominant_currency(sums)) == rows(sharp.dominant_currency(sharp.scoring_units(whole)))
    counts = lookups.in_slices(df, "match_id", lambda f: prices.coverage_counts(priced(f)))
    assert rows(prices.coverage_of_slices(counts, groups)) == rows(prices.coverage(whole))


def versions(spark):
    from pyspark.sql import types as T

    rows_ = [leg(f"k{i % 7}", match_id=1 + (i == 9), turnover="11.00" if i == 5 else "10.00", currency=None if i == 3 else "EUR", version=i // 2) for i in range(12)]
    rows_ += [leg("alone", version=3), rows_[0], rows_[0]]
    return written(spark.createDataFrame(rows_, SCHEMA).withColumn("event_kind", F.when(F.col("version") > 4, "reversal").otherwise("placement").cast(T.StringType())))


def test_large_log_is_that_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lookups, "SLICE_ROWS", 10)
    log = versions(spark)
    now = L.large_collapse(log, ["row_key"])
    assert rows(now) == rows(L.collapse(log).select(*now.columns)) != []
    assert rows(L.large_immutable_conflicts(log, ["row_key"])) == rows(L.immutable_conflicts(log)) != []
    tagged = log.withColumn("source_file", F.when(F.col("version") % 2 == 0, "one").otherwise("two"))
    tagged = tagged.union(tagged.filter("version = 3"))
    assert rows(L.large_dedup_funnel(tagged, ["version"])) == rows(L.dedup_funnel(tagged)) != []


def test_betslips_without_ids(spark):
    df = L.facts(book(spark))
    slips = L.betslips(L.enrich(df))
    stakes = L.stakes(df)
    assert rows(stakes) == rows(slips.select(*stakes.columns)) != []
    clusters = anomalies.same_second_clusters(L.enrich(df)).select("uid", "placed_at")
    assert rows(anomalies.clustered_seconds(df)) == rows(clusters) != []
    assert rows(anomalies.days_of(stakes)) == rows(anomalies.days_of(slips)) != []


def test_folded_words_of_repeated_documents(spark, tmp_path):
    from wagerlens.catalogue import normalise_text

    data = [("a", "Ünïted  FC\tØre ünited ΣΑΣ"), ("a", "FC Zz"), ("b", "İx ́ x"), ("c", ""), ("d", None), (None, "Q q")]
    spark.createDataFrame(data, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["names"], r["first_name"], r["last_name"], r["n"]) for r in normalise_text(spark, str(tmp_path)).collect()}
    _, first, _, n = got.pop("b")  # a lone accent is an empty name
    assert (first, n) == ("", 3)
    assert got == {"a": (5, "fc", "σας", 7), "c": (0, None, None, 0), "d": (0, None, None, 0), None: (1, "q", "q", 2)}
