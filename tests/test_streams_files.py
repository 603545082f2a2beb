import json

import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators import drift as D
from marketloom.operators import journal as J
from marketloom.sources import files as FL
from marketloom.streaming import live as V


def land(spark, pdf, path):
    spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).parquet(str(path))


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_live_bars_and_prices(spark, tmp_path):
    t = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-01 10:00", periods=60, freq="min"), "price": range(60), "size": 1.0}).astype({"price": float})
    bars = drain(V.live_bars(land(spark, t, tmp_path / "t")), "live_bars_out", tmp_path).orderBy("timestamp").toPandas()
    assert bars.iloc[0][["open", "high", "low", "close", "volume"]].tolist() == [0.0, 4.0, 0.0, 4.0, 5.0]
    last = drain(V.latest_prices(land(spark, t, tmp_path / "t2")), "live_prices_out", tmp_path, "complete").first()
    assert last["price"] == 59.0


def test_alerts_fire_once(spark, tmp_path):
    alerts = spark.createDataFrame([(1, "A", "above", 10.0, "active"), (2, "A", "below", -5.0, "active"), (3, "A", "above", 1.0, "triggered")], "id bigint, symbol string, alert_type string, threshold double, status string")
    q = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-01", periods=30, freq="min"), "price": [float(i) for i in range(30)]})
    src, out, ck = land(spark, q, tmp_path / "q"), str(tmp_path / "hits"), str(tmp_path / "ck")
    V.write_alerts_once(V.alert_hits(src, alerts), out, ck).awaitTermination(120)
    land(spark, q.assign(timestamp=q.timestamp + pd.Timedelta(days=1)), tmp_path / "q")
    V.write_alerts_once(V.alert_hits(src, alerts), out, ck).awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert [(r["id"], r["price"]) for r in got] == [(1, 11.0)]


def test_news_dedupe_and_mentions(spark, tmp_path):
    a = pd.DataFrame({"title": ["Big news!", "big NEWS", "Other"], "published": pd.date_range("2024-01-01", periods=3, freq="h")})
    assert drain(V.dedupe_news(land(spark, a, tmp_path / "n")), "news_out", tmp_path).count() == 2
    m = pd.DataFrame({"symbol": ["A", "A", "B"], "timestamp": pd.date_range("2024-01-01", periods=3, freq="D"), "score": [1.0, 0.0, 0.5]})
    w = drain(V.mention_windows(land(spark, m, tmp_path / "m")), "mentions_out", tmp_path, "complete")
    assert w.filter("symbol = 'A'").agg(F.max("mention_count")).first()[0] == 2


def test_kill_switch_state_survives_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = pd.DataFrame({"account": "a", "timestamp": pd.date_range("2024-01-01", periods=3), "equity": [100.0, 80.0, 99.0]})
        d = V.kill_switch(land(spark, e, tmp_path / "e"))
        run = lambda: d.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "oc")).trigger(availableNow=True).start().awaitTermination(180)
        run()
        land(spark, pd.DataFrame({"account": ["a"], "timestamp": [pd.Timestamp("2024-01-05")], "equity": [100.0]}), tmp_path / "e")
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "o")).orderBy("timestamp").toPandas()["kill_switch"].tolist()
    assert got == [False, True, True, True]


def test_pairing_stream(spark, tmp_path):
    s = pd.DataFrame({"signal_id": ["x", "y"], "timestamp": pd.to_datetime(["2024-01-01", "2024-01-01"])})
    o = pd.DataFrame({"signal_id": ["x"], "outcome_timestamp": pd.to_datetime(["2024-01-02"]), "pnl": [1.0]})
    j = drain(V.pair_signals(land(spark, s, tmp_path / "s"), land(spark, o, tmp_path / "o")), "pairs_out", tmp_path)
    assert [(r["signal_id"], r["pnl"]) for r in j.filter("pnl is not null").collect()] == [("x", 1.0)]


def test_event_log_round_trip_and_review(spark, tmp_path):
    s = spark.createDataFrame([("1", "2026-02-05", "A", 0.7, "calm", 0.6, [" rsi ", ""]), ("2", "2026-02-06", "B", 0.7, "calm", 0.6, ["rsi"]), ("3", "2026-01-06", "C", 0.7, "calm", 0.6, ["x"])], "signal_id string, t string, symbol string, confidence double, regime string, prediction double, top_features array<string>").withColumn("timestamp", F.col("t").cast("timestamp"))
    o = spark.createDataFrame([("1", "2026-02-08", 0.02), ("2", "2026-02-09", -0.01)], "signal_id string, t string, realized_return double").withColumn("outcome_timestamp", F.col("t").cast("timestamp"))
    path = str(tmp_path / "log")
    FL.append_events(FL.signal_events(s), path)
    FL.append_events(FL.outcome_log_events(o), path)
    ev = FL.scan_events(spark, path, "2026-02-01", "2026-02-28")
    assert ev.count() == 4
    assert "PartitionFilters: [isnotnull(month" in ev._jdf.queryExecution().toString()
    sig, out = FL.split_events(ev)
    assert sig.filter("signal_id = '1'").first()["top_features"] == ["rsi"]
    r = D.weekly_review(sig, out, "2026-02-10").first()
    assert (r["total_signals"], r["resolved_signals"], r["win_rate"]) == (2, 2, 0.5) and r["regimes"][0]["count"] == 2


def test_streamed_log(spark, tmp_path):
    e = pd.DataFrame({"event_type": ["signal"], "signal_id": ["1"], "event_time": pd.to_datetime(["2024-05-05"])})
    V.append_event_log(land(spark, e, tmp_path / "i"), str(tmp_path / "l"), str(tmp_path / "lc")).awaitTermination(120)
    assert (tmp_path / "l" / "month=2024-05").exists()


def test_readers(spark, tmp_path, bars):
    p = str(tmp_path / "b")
    FL.write_table(bars, p)
    d = FL.read_bars(spark, p, symbols=["AAA"], start="2015-01-05", end="2015-01-09")
    assert d.count() == 5
    plan = d._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "EqualTo(symbol" in plan or "In(symbol" in plan
    (tmp_path / "dir.txt").write_text("Symbol|Security Name|Test Issue|ETF\nAAPL|Apple Inc. - Common Stock|N|N\nQQQ|Fund|N|Y\nZZT|Test - Common Stock|Y|N\nABC|ABC Warrant|N|N\nFile Creation Time: 0|||\n")
    from marketloom.operators.universe import listed_symbols
    assert [r["symbol"] for r in listed_symbols(FL.read_directory(spark, str(tmp_path / "dir.txt"))).collect()] == ["AAPL"]


def test_documents(spark, tmp_path):
    for i, m in enumerate([{"classification": {"f1": 0.5}}, {"trading": {"sharpe": 1.2}}]):
        d = tmp_path / "runs" / f"r{i}"
        d.mkdir(parents=True)
        (d / "artifact.json").write_text(json.dumps({"run_id": f"r{i}", "created_at": f"2024-01-0{i + 1}", "MetricsSummary" if i else "metrics_summary": m}, indent=1))
    r = FL.list_runs(spark, str(tmp_path / "runs" / "*" / "artifact.json")).collect()
    assert [(x["run_id"], x["primary_score"], x["horizon"]) for x in r] == [("r1", 1.2, 5), ("r0", 0.5, 5)]
    a = spark.createDataFrame([("aapl", "2024-01-01 10:00:00", 0.7)], "ticker string, t string, c double").select("ticker", F.col("t").cast("timestamp").alias("created_at"), F.struct(F.struct(F.col("c").alias("confidence")).alias("model_signals")).alias("report"))
    FL.write_analyses(a, str(tmp_path / "an"))
    x = FL.list_analyses(spark, str(tmp_path / "an"), "AAPL").first()
    assert x["confidence"] == 0.7 and x["id"] == "aapl-20240101100000"


def test_journal(spark, tmp_path):
    t = spark.createDataFrame([(1, "A", "breakout", 10.0, 5.0), (2, "A", "breakout", -4.0, -2.0), (3, "B", "breakout", 6.0, 3.0)], "id bigint, symbol string, strategy string, pnl double, pnl_percent double").withColumns({"thesis": F.lit("t"), "lessons": F.lit("l")})
    s = J.trade_stats(t).first()
    assert (s["total_trades"], s["winning_trades"], s["profit_factor"]) == (3, 2, 2.0)
    rank = J.strategy_rankings(J.trade_lessons(t)).first()
    assert rank["wins"] == 2 and rank["losses"] == 1
    FL.export_rows(J.trade_lessons(t), str(tmp_path / "mem"))
    assert FL.import_rows(spark, str(tmp_path / "mem"), "trade_id bigint, category string, content string, importance double").count() == 6
    up = spark.createDataFrame([("k", 1, 1), ("k", 2, 2)], "id string, v int, recorded_at int")
    assert FL.upsert_view(up, ["id"]).first()["v"] == 2
    pos = spark.createDataFrame([(1, 10.0, 2.0)], "id bigint, entry_price double, quantity double")
    ex = spark.createDataFrame([(1, 12.0)], "id bigint, exit_price double")
    assert J.close_rows(pos, ex).first()["pnl"] == 4.0
    assert len(J.TABLES) == 12


def test_csv_bounds_are_stamps(spark, tmp_path):
    from marketloom.sources.files import read_bars

    (tmp_path / "b.csv").write_text("symbol,Date,close\nA,2024-01-30 00:00:00,1\nA,2024-01-31 00:00:00,2\nA,2024-02-01 00:00:00,3\n")
    got = read_bars(spark, str(tmp_path / "b.csv"), fmt="csv", start="2024-01-31", end="2024-01-31")
    assert got.count() == 1


def test_rows_without_a_feature_keep_their_place(spark):
    from marketloom.operators import models as M

    rows = [(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)] + [(100, None, 1.0, 1), (101, float("nan"), 1.0, 0)]
    df = spark.createDataFrame(rows, "n int, a double, b double, y int")
    for family in ("logistic", "random_forest"):
        s = M.score(M.fit(df, ["a", "b"], "y", family), df)
        assert s.count() == 62 and {r["n"] for r in s.filter("probability is null and prediction is null").collect()} == {100, 101}
