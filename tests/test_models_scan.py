"""Grid search against single fits, and the composed scan: failures, resuming."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import make_bars
from marketloom.operators import models as M
from marketloom.operators import scan as SC
from marketloom.operators.quality import QualityPolicy


def test_grid_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1] + [0.0, 3.0, 1.0]
    y = (x[:, 0] + 8 * x[:, 2] + rng.normal(size=n) > 8).astype(int)
    pdf = pd.DataFrame({"timestamp": pd.date_range("2020-01-01", periods=n // 2).repeat(2), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    d = M.walk_forward_folds(spark.createDataFrame(pdf), 3).cache()
    strengths = [0.0, 0.05, 0.5]
    got = {(r.strength, r.fold): r.f1 for r in M.logistic_grid(d, ["a", "b", "c"], "y", strengths, 3).collect()}
    assert len(got) == 9
    for s in strengths:
        for fold in (1, 2, 3):
            m = M.fit(d.filter(F.col("fold") < fold), ["a", "b", "c"], "y", "logistic", regParam=s, maxIter=200)
            p = M.score(m, d.filter(F.col("fold") == fold)).toPandas()
            tp = ((p["prediction"] == 1) & (p["y"] == 1)).sum()
            want = 2 * tp / ((p["prediction"] == 1).sum() + (p["y"] == 1).sum())
            assert got[s, fold] == pytest.approx(want, abs=1e-6)
    best, mean = M.grid_search(d.drop("fold"), ["a", "b", "c"], "y", "logistic")
    assert best["regParam"] in (0.0, 0.01, 0.1) and 0.5 < mean <= 1.0


REPORT = QualityPolicy("report", "report", "report", "report", "report", min_history_rows_multiplier=60)


@pytest.fixture(scope="module")
def market(spark):
    bars = pd.concat([make_bars("GOOD", 420, 1), make_bars("NEXT", 420, 2), make_bars("SHORT", 100, 3), make_bars("THIN", 290, 4)], ignore_index=True)
    universe = spark.createDataFrame([(s, "tech") for s in ("GOOD", "NEXT", "SHORT", "THIN", "NONE", "GOOD")], "symbol string, sector string")
    bench = spark.createDataFrame([(0.01,)], "ret double")
    etf = spark.createDataFrame([("XT", 0.02)], "etf string, ret double")
    funds = spark.createDataFrame([("tech", "XT")], "sector string, etf string")

    def run(done=None, modelled=("GOOD",), **kw):
        predict = lambda newest: newest.filter(F.col("symbol").isin(*modelled)).select("symbol", F.lit(0.8).alias("probability_up"))
        return SC.universe_scan(universe, spark.createDataFrame(bars), predict, bench, funds, etf, horizon=5, policy=REPORT, done=done, **kw)

    return run


def test_failures_are_rows(market):
    got = {r.symbol: r for r in market().collect()}
    assert {s: (r.status, r.stage, r.code) for s, r in got.items()} == {
        "GOOD": ("completed", None, None), "NEXT": ("failed", "prediction", "no_prediction"), "SHORT": ("failed", "history", "insufficient_history"), "THIN": ("failed", "history", "insufficient_history"), "NONE": ("failed", "history", "no_data")}
    good = got["GOOD"]
    assert good.bias == "LONG" and good.analogs == 5 and good.primary_score == pytest.approx(0.65 * 0.6 + 0.35 * 0.5) and good.distance_to_high <= 0 <= good.distance_to_low
    assert all(got[s].bias is None and got[s].primary_score is None for s in got if s != "GOOD") and got["THIN"].rows == 290


def test_a_scan_goes_on_where_it_stopped(spark, market, tmp_path):
    folder = str(tmp_path / "run")
    first = {r.symbol: r.attempt for r in SC.resume_scan(spark, folder, lambda done: market(done)).collect()}
    assert set(first.values()) == {1}
    again = {r.symbol: r for r in SC.resume_scan(spark, folder, lambda done: market(done, modelled=("GOOD", "NEXT"))).collect()}
    assert again["GOOD"].attempt == 1 and again["NEXT"].attempt == 2 and again["NEXT"].status == "completed" and again["NONE"].code == "no_data" and len(again) == 5


def test_scan_computes_its_bars_once(spark):
    """Every stage reads the bars; they are computed once."""
    import pandas as pd

    from marketloom.operators import scan as SC
    from marketloom.operators.series import declare_daily

    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    days = pd.date_range("2022-01-03", periods=420, tz="UTC")
    rows = pd.concat([pd.DataFrame({"symbol": s, "timestamp": days, "open": p, "high": p + 1.0, "low": p - 1.0, "close": [p + (i * 7 % 13) * 0.1 for i in range(420)], "volume": 1000.0}) for s, p in (("A", 50.0), ("B", 80.0))])
    bars = spark.createDataFrame(rows)
    bars = declare_daily(bars.mapInPandas(counted, bars.schema))
    universe = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "X")], "symbol string, sector string")
    one = spark.createDataFrame([(0.01,)], "ret double")
    funds, etf = spark.createDataFrame([("X", "EX")], "sector string, etf string"), spark.createDataFrame([("EX", 0.02)], "etf string, ret double")
    out = SC.universe_scan(universe, bars, lambda d: d.selectExpr("symbol", "0.7D AS probability_up"), one, funds, etf)
    assert {r.symbol: r.code for r in out.collect()}["C"] == "no_data"
    assert seen.value == len(rows)
