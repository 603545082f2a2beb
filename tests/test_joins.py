import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import asof as A
from marketloom.operators import backtest as BT
from marketloom.operators import fundamentals as FU
from marketloom.operators import macro as M
from marketloom.operators import regime as R
from marketloom.operators.series import DAY


def ts(x):
    return pd.Timestamp(x)


@pytest.mark.parametrize("span", [DAY // 4, 3 * DAY, 400 * DAY])
def test_asof_equals_pandas(spark, span):
    rng = np.random.default_rng(3)
    n, m = 400, 150
    left = pd.DataFrame({"symbol": rng.choice(["A", "A", "A", "B", "C"], n), "timestamp": ts("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, n), unit="h"), "id": range(n)})
    right = pd.DataFrame({"symbol": rng.choice(["A", "B"], m), "timestamp": ts("2024-01-01") + pd.to_timedelta(rng.integers(0, 40 * 24, m), unit="h"), "v": rng.normal(size=m), "seq": range(m)})
    right.loc[::7, "v"] = np.nan
    kw = dict(prefix="r", right_order=("seq",), span=span)
    rdf = spark.createDataFrame(right).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    got = A.asof_join(spark.createDataFrame(left), rdf, **kw).toPandas().sort_values("id").reset_index(drop=True)
    want = pd.merge_asof(left.sort_values("timestamp"), right.sort_values(["timestamp", "seq"]), on="timestamp", by="symbol").sort_values("id").reset_index(drop=True)
    np.testing.assert_allclose(got["r__v"].astype(float), want["v"])
    np.testing.assert_array_equal(got["r__seq"].astype(float), want["seq"])
    got = A.asof_join(spark.createDataFrame(left), rdf, tolerance="10 hours", **kw).toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("timestamp"), right.sort_values(["timestamp", "seq"]), on="timestamp", by="symbol", tolerance=pd.Timedelta("10h")).sort_values("id")
    np.testing.assert_array_equal(got["r__seq"].astype(float), want["seq"])
    got = A.asof_join(spark.createDataFrame(left), rdf, strict=True, **kw).toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("timestamp"), right.sort_values(["timestamp", "seq"]), on="timestamp", by="symbol", allow_exact_matches=False).sort_values("id")
    np.testing.assert_array_equal(got["r__seq"].astype(float), want["seq"])


def test_macro_release_is_not_seen_early(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-03 14:30", periods=6, freq="5min"), "close": range(6)}))
    macro = spark.createDataFrame(pd.DataFrame({"timestamp": [ts("2024-01-03 14:20"), ts("2024-01-03 14:45")], "cpi_surprise": [0.1, -0.2]}))
    out = A.align(bars, None, macro, None)
    got = out.orderBy("timestamp").toPandas()["macro__cpi_surprise"].tolist()
    assert got == [0.1, 0.1, 0.1, -0.2, -0.2, -0.2]
    A.assert_no_peek(out)
    with pytest.raises(AssertionError):
        A.assert_no_peek(out.withColumn("macro__asof_timestamp", F.lit("2030-01-01").cast("timestamp")))


def test_next_known_event_brute_force(spark):
    rng = np.random.default_rng(5)
    ev = pd.DataFrame({"symbol": rng.choice(["A", "B"], 60), "event_timestamp": ts("2024-01-01") + pd.to_timedelta(rng.integers(0, 200, 60), unit="D")})
    ev["known_since"] = ev["event_timestamp"] - pd.to_timedelta(rng.integers(1, 60, 60), unit="D")
    left = pd.DataFrame({"symbol": ["A"] * 150 + ["B"] * 150, "timestamp": list(pd.date_range("2024-01-01", periods=150)) * 2})
    got = A.next_known_event(spark.createDataFrame(left), spark.createDataFrame(ev)).toPandas().set_index(["symbol", "timestamp"])["next_event"]
    for _, r in left.iterrows():
        c = ev[(ev.symbol == r.symbol) & (ev.known_since <= r.timestamp) & (r.timestamp < ev.event_timestamp)]["event_timestamp"]
        g = got.loc[(r.symbol, r.timestamp)]
        assert (pd.isna(g) and c.empty) or g == c.min()


def test_fundamentals_known_from_release(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-03-01 13:00", periods=8, freq="h"), "close": 1.0}))
    f = spark.createDataFrame(pd.DataFrame({"symbol": "A", "filing_timestamp": [ts("2024-03-01 15:00"), ts("2024-03-01 17:00")], "revenue": [100.0, 120.0], "free_cash_flow": [10.0, 12.0],
                                            "total_debt": [60.0, 66.0], "total_equity": [40.0, 44.0], "ebit": [20.0, 22.0], "interest_expense": [5.0, 5.5]}))
    d = FU.with_fundamentals(bars, f).orderBy("timestamp").toPandas()
    assert d["fund_debt_to_equity"][:2].isna().all() and d["fund_debt_to_equity"][2:].round(6).eq(1.5).all()
    assert d["fund_revenue_growth_qoq"][:4].isna().all() and d["fund_revenue_growth_qoq"][4:].round(6).eq(0.2).all()


def test_earnings_event_timeline(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-03-01 13:00", periods=6, freq="h"), "close": 1.0}))
    e = spark.createDataFrame(pd.DataFrame({"symbol": ["A"], "event_timestamp": [ts("2024-03-01 16:00")], "known_since": [ts("2024-03-01 15:00")], "earnings_surprise": [0.3], "guidance_change_proxy": [-0.1]}))
    d = FU.with_earnings(bars, e).orderBy("timestamp").toPandas()
    assert d["earnings_days_to_event"][:2].isna().all() and d["earnings_days_to_event"][2] > 0 and d["earnings_days_to_event"][3:].isna().all()
    assert d["earnings_surprise"][:3].isna().all() and (d["earnings_surprise"][3:] == 0.3).all()
    assert d["earnings_post_window_d1"].tolist() == [0, 0, 0, 1, 1, 1]


def test_macro_levels_and_vix_flag(spark):
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2024-01-03 13:00", periods=8, freq="h"), "close": [100.0 + i for i in range(8)]}))
    macro = spark.createDataFrame(pd.DataFrame({"release_timestamp": [ts("2024-01-03 13:00"), ts("2024-01-03 16:00")], "vix": [14.0, 34.0]}))
    d = R.with_regime(M.with_macro_levels(bars, macro)).orderBy("timestamp").toPandas()
    assert d["regime_high_vol_flag"].tolist() == [0, 0, 0, 1, 1, 1, 1, 1]
    assert d["regime_risk_off_flag"].isna().all()


def test_decision_flag_lasts_until_24h_after_midnight(spark):
    d = spark.createDataFrame(pd.DataFrame({"timestamp": [ts("2024-03-20 17:59"), ts("2024-03-20 18:00"), ts("2024-03-21 03:59"), ts("2024-03-21 04:00")]}))
    assert [r[0] for r in d.select(M.decision_flag("timestamp", ["2024-03-20"])).collect()] == [0.0, 1.0, 1.0, 0.0]


def test_first_exit_brute_force(spark, bars, bars_pdf):
    pdf = bars_pdf[bars_pdf.timestamp.dt.day.isin([1, 8, 15])][["symbol", "timestamp", "close"]].copy()
    pdf["is_long"] = np.arange(len(pdf)) % 2 == 0
    s = np.where(pdf.is_long, 1, -1)
    pdf["stop_price"], pdf["take_price"] = pdf.close * (1 - s * 0.05), pdf.close * (1 + s * 0.08)
    ent = spark.createDataFrame(pdf.drop(columns="close"))
    got = BT.first_exit(ent, bars, fan=4).toPandas().set_index(["symbol", "timestamp"])
    assert len(got) == len(pdf)
    for _, r in pdf.iterrows():
        later = bars_pdf[(bars_pdf.symbol == r.symbol) & (bars_pdf.timestamp > r.timestamp)]
        hit = later[(later.low <= r.stop_price) | (later.high >= r.take_price)] if r.is_long else later[(later.high >= r.stop_price) | (later.low <= r.take_price)]
        g = got.loc[(r.symbol, r.timestamp)]["exit_timestamp"]
        assert (pd.isna(g) and hit.empty) or g == hit.iloc[0].timestamp
