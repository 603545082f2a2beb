import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import bars as B
from marketloom.operators import quality as Q
from marketloom.plans.dataset import DatasetRequest, build_dataset


def canon(spark, rows):
    pdf = pd.DataFrame(rows)
    pdf["seq"] = range(len(pdf))
    return B.canonicalize(spark.createDataFrame(pdf), symbol="AAA")


def test_aliases_and_split_factor(spark):
    pdf = pd.DataFrame({"Date": ["2026-01-02", "2026-01-03", "2026-01-04"], "Open": ["1", "2", "x"], "High": [1.0, 2.0, 3.0], "Low": [1.0, 2.0, 3.0], "Close": [1.0, 2.0, 3.0], "Volume": [1, 2, 3], "Stock Splits": [0.0, 2.0, None]})
    d = B.canonicalize(spark.createDataFrame(pdf), symbol="aaa").orderBy("timestamp").toPandas()
    assert d["split_factor"].tolist() == [1.0, 2.0, 1.0]
    assert d["symbol"].eq("AAA").all() and d["adj_close"].tolist() == [1.0, 2.0, 3.0]
    assert pd.isna(d["open"][2])
    with pytest.raises(ValueError):
        B.canonicalize(spark.createDataFrame(pdf.drop(columns="Close")), symbol="A")


def test_gate_repairs_and_counts(spark):
    rows = [dict(timestamp=t, open=10.0, high=11.0, low=9.0, close=c, volume=v) for t, c, v in
            [("2024-01-02 14:30", 10.0, 100.0), ("2024-01-03 14:30", 10.5, -200.0), ("2024-01-03 14:30", 10.6, 500.0), ("2024-01-05 14:30", 10.7, 300.0)]]
    flags = Q.gate_flags(canon(spark, rows), order=["seq"])
    rep = Q.gate_report(flags).first()
    assert (rep["rows_before"], rep["duplicates"], rep["negative_volume"]) == (4, 1, 1) and rep["repaired"] >= 1
    out = Q.gate_rows(flags).orderBy("timestamp").toPandas()
    assert (out["volume"] >= 0).all() and out["is_synthetic"].sum() == rep["repaired"]
    made = out[out.is_synthetic].iloc[0]
    assert made.close == 10.6 and made.volume == 0


def test_outlier_and_rebound_are_dropped(spark):
    days = pd.bdate_range("2024-01-01", periods=5)
    rows = [dict(timestamp=str(d), open=c, high=c, low=c, close=c, volume=1000.0) for d, c in zip(days, [100.0, 101.0, 180.0, 102.0, 103.0])]
    pol = Q.QualityPolicy(outlier_return_threshold=0.3, missing_timestamp_policy="keep")
    flags = Q.gate_flags(canon(spark, rows), pol, order=["seq"], tz="UTC")
    assert Q.gate_report(flags, pol).first()["outliers"] == 2
    assert Q.gate_rows(flags).count() == 3


def test_stale_runs_cross_block_borders(spark):
    closes = [1.0, 2.0] + [5.0] * 12 + [6.0] * 3 + [7.0, 8.0] + [9.0] * 10
    pdf = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-01", periods=len(closes)), "close": closes})
    from marketloom.operators.series import DAY, Layout
    for block in (4, 7, 100):
        d = Q.stale_flags(spark.createDataFrame(pdf), 10, Layout(span=2 * DAY, block_rows=block)).toPandas()
        assert d["is_stale"].sum() == 22 and len(d) == len(closes)


def test_resample_first_bar(spark):
    pdf = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-03 14:30", periods=6, freq="5min"), "open": [100.0 + i for i in range(6)], "volume": [1000.0, 1200, 900, 1100, 1300, 1400]})
    pdf["high"], pdf["low"], pdf["close"] = pdf.open + 1, pdf.open - 1, pdf.open + 0.5
    r = B.resample(spark.createDataFrame(pdf), "15m").orderBy("timestamp").first()
    assert (r["open"], r["high"], r["low"], r["volume"]) == (100.0, 103.0, 99.0, 3100.0)
    with pytest.raises(ValueError):
        B.resample(spark.createDataFrame(pdf), "7m")


def test_week_is_labelled_by_its_sunday(spark):
    pdf = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-01", periods=21)})
    for c in ("open", "high", "low", "close", "volume"):
        pdf[c] = range(21)
    got = B.resample(spark.createDataFrame(pdf), "1w").orderBy("timestamp").toPandas()
    want = pdf.set_index("timestamp").resample("1W").agg({"volume": "sum"}).reset_index()
    assert got["timestamp"].tolist() == want["timestamp"].tolist() and got["volume"].tolist() == want["volume"].tolist()


def test_day_buckets_follow_new_york(spark):
    d = spark.createDataFrame(pd.DataFrame({"t": [pd.Timestamp("2024-01-03 04:59"), pd.Timestamp("2024-01-03 05:00")]}))
    got = [r[0] for r in d.select(B.bucket_start("t", "1d", "America/New_York")).collect()]
    assert [str(x) for x in got] == ["2024-01-02 05:00:00", "2024-01-03 05:00:00"]


def test_dataset_build_end_to_end(spark, bars):
    d, rep = build_dataset(bars, DatasetRequest(timeframe="1w"))
    assert rep.count() == 2 and d.filter("symbol = 'AAA'").count() > 100


def test_dropped_rows_are_counted(spark):
    """Three rows, two of one stamp, one of them with a negative volume that is dropped."""
    rows = [("2024-01-02", 10.0, 5.0), ("2024-01-03", 11.0, -7.0), ("2024-01-05", 12.0, 6.0), ("2024-01-05", 12.5, 6.0)]
    df = spark.createDataFrame([("A", t, c, v, i) for i, (t, c, v) in enumerate(rows)], "symbol string, d string, close double, volume double, seq int").withColumn("timestamp", F.to_timestamp("d"))
    df = df.withColumns({c: F.col("close") for c in ("open", "high", "low", "adj_close")} | {"dividend": F.lit(0.0), "split_factor": F.lit(1.0), "session": F.lit("regular"), "is_market_holiday": F.lit(False), "is_synthetic": F.lit(False)}).drop("d")
    got = {}
    for dup in ("drop", "keep"):
        pol = Q.QualityPolicy(duplicate_policy=dup, negative_volume_policy="drop", missing_timestamp_policy="report")
        flags = Q.gate_flags(df, pol, order=["seq"], tz="UTC")
        r = Q.gate_report(flags, pol).first()
        got[dup] = (r["rows_before"], r["rows_after"], r["duplicates"], r["negative_volume"], r["missing"], r["repaired"])
        assert Q.gate_rows(flags).filter("volume < 0").isEmpty()
    assert got == {"drop": (4, 2, 1, 1, 2, 0), "keep": (4, 3, 1, 1, 2, 0)}


def test_stale_runs_need_no_second_sort(spark, capsys):
    """Runs at both ends, of exactly the length, one too short, and missing closes, which are never equal."""
    import pandas as pd

    from marketloom.operators.quality import stale_flags
    from marketloom.operators.series import DAILY, declare_daily

    closes = [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, None, None, None, 4.0, 5.0, 5.0, 5.0, 5.0, 6.0, 6.0]
    rows = [("A" if k else "B", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), c) for k in (0, 1) for i, c in enumerate(closes)]
    df = declare_daily(spark.createDataFrame(rows, "symbol string, timestamp timestamp, close double"))
    for length in (1, 2, 3, 4, 5):
        run, runs = [], []
        for i, c in enumerate(closes):
            if run and c is not None and closes[run[-1]] == c:
                run.append(i)
            else:
                run = [i]
                runs.append(run)
        want = {i for r in runs for i in r if len(r) >= length}
        out = stale_flags(df, length, DAILY)
        got = out.filter("is_stale").selectExpr("symbol", "datediff(timestamp, date'2024-01-01') as i").collect()
        assert {(r.symbol, r.i) for r in got} == {(s, i) for s in "AB" for i in want}
        capsys.readouterr()
        out.explain()
        assert capsys.readouterr().out.count("Sort [") <= 1
