"""Blocked windows must equal whole-series windows for any block size."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import macro as M
from marketloom.operators import series as S
from marketloom.operators import technical as T


def small(block=50, span=20):
    return S.Layout(span=span * S.DAY, block_rows=block)


def collect(df):
    return df.toPandas().sort_values(["symbol", "timestamp"]).reset_index(drop=True)


@pytest.mark.parametrize("block,span", [(17, 3), (50, 20), (400, 90), (8192, 32)])
def test_rolling_lag_lead(bars, bars_pdf, block, span):
    b = S.blocked(bars, small(block, span), back=30, ahead=5).indexed()
    b.stage({"m": S.full(b, F.col("close"), 30, F.avg), "hi": S.prior(b, F.col("high"), 20, F.max), "l": S.lag(b, "close", 7), "f": F.lead("close", 5).over(b.window), "ix": F.col("_ix")})
    got = collect(b.owned())
    g = bars_pdf.groupby("symbol")
    assert len(got) == len(bars_pdf)
    np.testing.assert_allclose(got["m"], g["close"].transform(lambda s: s.rolling(30).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["hi"], g["high"].transform(lambda s: s.rolling(20).max().shift(1)), rtol=1e-12)
    np.testing.assert_allclose(got["l"], g["close"].shift(7), rtol=1e-12)
    np.testing.assert_allclose(got["f"], g["close"].shift(-5), rtol=1e-12)
    assert (got["ix"] == g.cumcount()).all()


@pytest.mark.parametrize("block", [100, 8192])
def test_ema_matches_pandas(spark, block):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2000-01-01", periods=4000, freq="D"), "close": 100 + rng.normal(0, 1, 4000).cumsum()})
    b = S.blocked(spark.createDataFrame(pdf), S.Layout(span=50 * S.DAY, block_rows=block), back=S.EMA_BACK).indexed()
    S.ema_layers(b, {"a": (F.col("close"), 26, False), "c": (F.col("close"), 12, True), "d": (F.col("close"), 9, True)})
    got = collect(b.owned())
    np.testing.assert_allclose(got["a"], pdf["close"].ewm(span=26, adjust=False).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["c"], pdf["close"].ewm(span=12).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["d"], pdf["close"].ewm(span=9).mean(), rtol=1e-10)


def test_ema_of_long_and_short_spans(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("1990-01-01", periods=9000, freq="D"), "close": 100 + rng.normal(0, 1, 9000).cumsum()})
    b = S.blocked(spark.createDataFrame(pdf), S.Layout(span=50 * S.DAY, block_rows=1500), back=S.ema_back(1, 5, 100, 300)).indexed()
    S.ema_layers(b, {f"e{n}": (F.col("close"), n, False) for n in (1, 5, 100, 300)} | {"a300": (F.col("close"), 300, True)})
    got = collect(b.owned())
    for n in (1, 5, 100, 300):
        np.testing.assert_allclose(got[f"e{n}"], pdf["close"].ewm(span=n, adjust=False).mean(), rtol=1e-10)
    np.testing.assert_allclose(got["a300"], pdf["close"].ewm(span=300).mean(), rtol=1e-10)


def test_running_and_previous(bars, bars_pdf):
    lay = small(50, 11)
    d = S.running(bars, {"cs": (F.col("volume"), "sum"), "mx": (F.col("close"), "max"), "n": (F.col("close"), "count"), "pr": (F.col("close") / 100.0, "product")}, lay)
    d = S.previous(d, {"pv": F.when(F.dayofmonth("timestamp") == 3, F.col("close"))}, lay)
    got = collect(d)
    g = bars_pdf.groupby("symbol")
    np.testing.assert_allclose(got["cs"], g["volume"].cumsum(), rtol=1e-12)
    np.testing.assert_allclose(got["mx"], g["close"].cummax(), rtol=1e-12)
    assert (got["n"] == g.cumcount() + 1).all()
    np.testing.assert_allclose(got["pr"], (bars_pdf["close"] / 100).groupby(bars_pdf["symbol"]).cumprod(), rtol=1e-9)
    marked = bars_pdf["close"].where(bars_pdf["timestamp"].dt.day == 3)
    want = marked.groupby(bars_pdf["symbol"]).transform(lambda s: s.ffill().shift(1))
    np.testing.assert_allclose(got["pv"], want, rtol=1e-12)


def test_no_task_holds_a_whole_key(bars):
    """The widest window partition is a block, not a symbol."""
    b = S.blocked(bars, small(60, 20), back=10)
    widest = b.df.groupBy("symbol", "_blk").count().agg(F.max("count")).first()[0]
    assert widest < 150


def test_top_per_key_cuts_before_the_exchange(bars):
    plan = S.top_per_key(bars, ["symbol"], [F.desc("close")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_exponential_means_share_one_sort(spark, capsys):
    """Windows inside runs and over the block need one order of the rows: one sort for the index, one for all means."""
    import pandas as pd
    from pyspark.sql import functions as F

    from marketloom.operators import technical as T
    from marketloom.operators.series import blocked, declare_daily

    rows = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2020-01-01", periods=1200, tz="UTC"), "close": [100.0 + (i * 37 % 11) for i in range(1200)]})
    b = blocked(declare_daily(spark.createDataFrame(rows)), back=T.EMA_BACK).indexed()
    cols = T.trend_ema(b) + T.macd(b)
    out = b.owned().select("symbol", "timestamp", *cols)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("Sort [") <= 2
    want = rows["close"].ewm(span=12, adjust=False).mean() - rows["close"].ewm(span=26, adjust=False).mean()
    got = [r[0] for r in out.orderBy("timestamp").select("macd_12_26_9").collect()]
    assert max(abs(g - w) for g, w in zip(got, want)) < 1e-9 and "_sub" not in b.owned().columns


def test_sliding_equals_frames(spark):
    """Same values as plain frames, with missing and flat values."""
    rows = [(f"S{i % 2}", datetime(2020, 1, 1) + timedelta(days=i), None if i % 17 == 3 else 7.0 if i < 60 else float((i * 7919) % 101), float((i * 31) % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, timestamp timestamp, x double, y double")
    b = S.Blocked(df.withColumns({S.BLK: F.lit(0).cast("bigint"), S.OWN: F.lit(True)}), S.DAILY, True)
    x, y = F.col("x"), F.col("y")
    both = F.when(x.isNotNull() & y.isNotNull(), 1)
    plain, quick = {}, {}
    for w in (5, 14, 63):
        for need in (None, 3):
            fr, n = b.rows(-(w - 1), 0), f"{w}_{need}"
            k = w if need is None else need
            one = {"avg": F.avg(x), "sum": F.sum(x), "min": F.min(x), "max": F.max(x), "stddev": F.stddev_samp(x), "var": F.var_samp(x)}
            plain |= {f"p_{a}_{n}": F.when(F.count(x).over(fr) >= k, c.over(fr)) for a, c in one.items()}
            quick |= {f"q_{a}_{n}": (a, w, need, x) for a in one}
            two = {"covar": F.covar_samp(x, y), "slope": F.regr_slope(x, y)}
            plain |= {f"p_{a}_{n}": F.when(F.count(both).over(fr) >= k, c.over(fr)) for a, c in two.items()}
            quick |= {f"q_{a}_{n}": (a, w, need, x, y) for a in two}
    S.sliding(b, quick)
    got = b.stage(plain).owned().collect()
    assert len(got) == 300
    for r in got:
        for n in plain:
            p, q = r[n], r["q" + n[1:]]
            assert (p is None) == (q is None), (n, p, q)
            assert p is None or abs(p - q) <= 1e-9 * max(1.0, abs(p)), (n, p, q)
    flat = [r["q_stddev_5_3"] for r in got if r["timestamp"].replace(tzinfo=None) < datetime(2020, 2, 20) and r["q_stddev_5_3"] is not None]
    assert flat and not any(flat)


def test_plugins_with_long_windows_take_up_no_row_per_window(spark):
    """Their plans hold no frame of several rows, only lags of merged states."""
    cols = ["open", "high", "low", "close", "volume", "bench__close", "sector__close", "macro_vix_proxy"]
    df = spark.createDataFrame([], "symbol string, timestamp timestamp, " + ", ".join(f"{c} double" for c in cols))
    for stage in (M.stage, T.volatility, T.relative_strength):
        b = S.blocked(S.declare_daily(df)).indexed()
        names = stage(b)
        plan = b.df.select(*names)._jdf.queryExecution().optimizedPlan().toString().lower()
        wide = [w for w in (5, 10, 14, 20, 60, 63) if f"rowframe, -{w - 1}, currentrow" in plan]
        assert "lag(" in plan and not wide, (stage.__name__, wide)
