"""Steps that ended large tables: what their plans no longer do, and that the results stay."""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketloom.operators import scan as SC


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_slope_needs_no_join(spark):
    """Missing keys, expiries, strikes and volatilities, repeated quotes, one and four expiries."""
    rows = [(1, 0, 10.0, 0.2), (1, 0, 9.0, 0.1), (1, 1, 9.0, 0.5), (1, 2, 9.0, 0.4), (1, 2, 9.0, 0.4), (1, 3, 9.0, 0.9), (2, 0, 9.0, 0.3), (3, None, 9.0, 0.7), (3, 1, 9.0, 0.1),
            (3, 2, 8.0, None), (3, 2, 9.0, 0.6), (4, 0, None, 0.3), (4, 1, 5.0, 0.2), (5, None, 1.0, 0.1), (5, 4, 1.0, 0.2), (5, 5, 1.0, 0.4), (5, 6, 1.0, 0.9), (None, 0, 9.0, 0.1), (None, 1, 9.0, 0.2)]
    q = spark.createDataFrame(rows, "k int, expiry int, strike double, iv double")
    d = SC.term_slope(q, "k", "expiry")
    got = {r[0]: None if r[1] is None else round(r[1], 9) for r in d.collect()}
    # a missing expiry takes one of the three places, as it did
    assert got == {1: 0.3, 3: None, 4: None, 5: 0.2}
    assert "Join" not in plan_of(d)


def test_dataset_cleans_once(spark, bars):
    """The as-of joins read cleaned bars that are written once, not the steps before them again."""
    from marketloom.plans.dataset import DatasetRequest, build_dataset

    at = "cast('2016-01-01' as timestamp)"
    funds = spark.sql(f"SELECT 'AAA' AS symbol, {at} AS filing_timestamp, 5.0 AS revenue")
    macro = spark.sql(f"SELECT {at} AS release_timestamp, 17.0 AS vix")
    plain, _ = build_dataset(bars, DatasetRequest(timeframe="1w"))
    d, _ = build_dataset(bars, DatasetRequest(timeframe="1w"), fundamentals=funds, macro=macro)
    assert "week" in plan_of(plain) and "week" not in plan_of(d)
    key = ["symbol", "timestamp"]
    assert sorted(map(tuple, d.select(*key, "close").collect())) == sorted(map(tuple, plain.select(*key, "close").collect()))
    late = F.col("timestamp") >= F.expr(at)
    assert d.filter((F.col("macro__vix") == 17.0) != late).isEmpty() and d.filter((F.col("fund__revenue") == 5.0) != (late & (F.col("symbol") == "AAA"))).isEmpty()
    assert d.filter("macro__vix is null").count() + d.filter(late).count() == d.count()


def test_model_features_take_no_long_frames(spark):
    """Averages and deviations against pandas, with a missing stretch and a flat one; no frame takes up a long window again for every row."""
    from marketloom.operators.model_features import model_frame

    rng = np.random.default_rng(5)
    n = 320
    x = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    x[250:300] = x[250]
    p = pd.DataFrame({"symbol": "A", "timestamp": pd.date_range("2015-01-01", periods=n), "open": x, "high": x * 1.01, "low": x * 0.99, "close": x, "volume": rng.integers(1, 1000, n).astype(float)})
    p.loc[100:103, "volume"] = None
    d = model_frame(spark.createDataFrame(p).withColumn("volume", F.nanvl("volume", F.lit(None))), horizon=None, drop_missing=False)
    assert not re.search(r"RowFrame, -(19|49|199), currentrow", plan_of(d))
    got = d.orderBy("timestamp").toPandas()
    want = {"sma_200": p["close"].rolling(200).mean(), "vol_sma_20": p["volume"].rolling(20).mean(), "bb_upper": p["close"].rolling(20).mean() + 2 * p["close"].rolling(20).std(),
            "hvol_50": p["close"].pct_change().rolling(50).std() * np.sqrt(252)}
    for c, w in want.items():
        np.testing.assert_allclose(got[c].to_numpy(dtype=float), w.to_numpy(), atol=1e-6, equal_nan=True)
    lo, hi = p["low"].rolling(14).min(), p["high"].rolling(14).max()
    np.testing.assert_allclose(got["stoch_k"].to_numpy(dtype=float), (100 * (p["close"] - lo) / (hi - lo + 1e-8)).to_numpy(), atol=1e-6, equal_nan=True)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_relative_strength_stores_its_bars(spark, tmp_path):
    """Bars are made once and never tagged for the as-of joins; a supplier that comes twice and one without a row leave the benchmark as it is."""
    from marketloom.operators.asof import asof_join
    from marketloom.plans import load_all
    from marketloom.plans.catalog import REGISTRY
    from marketloom.sources import tables as src

    load_all()
    day = "timestamp '2020-01-01' + make_dt_interval(cast(id % 30 as int))"
    li = spark.range(180).selectExpr("id as l_orderkey", "id as l_partkey", "id % 6 as l_suppkey", "1 as l_linenumber", "1.0D + id % 7 as l_quantity", "100.0D + id as l_extendedprice", f"{day} as l_shipdate")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 2), (3, 0), (4, 3)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, None)], "n_nationkey int, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    d = REGISTRY["features_relative_strength"].run(spark, str(tmp_path))
    assert "FileScan" not in plan_of(d) and "Union" not in plan_of(d)
    bars = src.bars_daily(spark, str(tmp_path))
    want = asof_join(bars, src.benchmark_daily(spark, str(tmp_path)), prefix="bench", keys=(), columns=["close"]).join(src.sector_map(spark, str(tmp_path)), "symbol")
    want = asof_join(want, src.sector_daily(spark, str(tmp_path)), prefix="sector", keys=("sector",), columns=["close"])
    p = want.select("symbol", "timestamp", "close", "bench__close", "sector__close").orderBy("symbol", "timestamp").toPandas()
    for c in ("bench__close", "sector__close"):
        # every supplier but the one that comes twice has one row a day
        one = p[p["symbol"] != "S00002"]
        ret = (one[c] / one.groupby("symbol")[c].shift() - 1).to_numpy()
        name = "bench_ret_h1" if c.startswith("bench") else "sector_ret_h1"
        got = d.filter("symbol <> 'S00002'").orderBy("symbol", "timestamp").toPandas()[name].to_numpy(dtype=float)
        np.testing.assert_allclose(got, ret, atol=2e-6, equal_nan=True)
    assert d.count() == len(p) and d.filter("symbol = 'S00005'").isEmpty()
