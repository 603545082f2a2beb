import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import model_features as MF
from marketloom.operators import models as M
from marketloom.operators.series import DAY, Layout
from marketloom.plans.registry import FeatureSpec, Plugin, default_registry

PLUGINS = ["returns", "trend", "trend_ema", "momentum", "macd", "volatility", "volume", "structure", "gaps"]


def run(df, layout=Layout()):
    out, cat = default_registry().generate(df, [FeatureSpec(p) for p in PLUGINS], layout=layout)
    return out, [f for c in cat for f in c["features"]]


def test_truncating_the_future_changes_nothing(spark, bars, bars_pdf):
    full, feats = run(bars)
    assert len(feats) > 80
    cut = bars_pdf[bars_pdf.symbol == "AAA"].timestamp.iloc[600]
    part, _ = run(bars.filter(F.col("timestamp") <= F.lit(cut)))
    a = full.filter((F.col("symbol") == "AAA") & (F.col("timestamp") == F.lit(cut))).select(*feats).toPandas()
    b = part.filter((F.col("symbol") == "AAA") & (F.col("timestamp") == F.lit(cut))).select(*feats).toPandas()
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), atol=1e-9)


def test_block_size_does_not_change_features(bars):
    a, feats = run(bars)
    b, _ = run(bars, Layout(span=10 * DAY, block_rows=130))
    key = ["symbol", "timestamp"]
    x, y = (d.select(*key, *feats).toPandas().sort_values(key)[feats].to_numpy(dtype=float) for d in (a, b))
    np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


def test_rsi_and_atr_against_pandas(bars, bars_pdf):
    out, _ = run(bars)
    got = out.filter("symbol = 'AAA'").orderBy("timestamp").toPandas()
    p = bars_pdf[bars_pdf.symbol == "AAA"].reset_index(drop=True)
    d = p.close.diff()
    g, l = d.where(d > 0, 0.0).rolling(14).mean(), (-d).where(d < 0, 0.0).rolling(14).mean()
    np.testing.assert_allclose(got["rsi_w14"], 100 - 100 / (1 + g / (l + 1e-9)), rtol=1e-9)
    macd = p.close.ewm(span=12, adjust=False).mean() - p.close.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(got["macd_signal_12_26_9"], macd.ewm(span=9, adjust=False).mean(), rtol=1e-7, atol=1e-9)


def test_registry_surface(bars):
    reg = default_registry()
    assert reg.has("trend") and "macro" in reg.list()
    with pytest.raises(KeyError):
        reg.get("nope")
    with pytest.raises(ValueError):
        reg.register(reg.get("trend"))
    reg.register(Plugin("twice", "custom", lambda b, p: (b.stage({"twice": F.col("close") * 2}), ["twice"])[1], 0))
    d, cat = reg.generate(bars, [FeatureSpec("twice")])
    assert d.count() == bars.count() and cat[0]["features"] == ["twice"]
    reg.unregister("twice")
    assert not reg.has("twice")


def test_context_plugins_keep_the_row_count(spark, bars):
    macro = spark.createDataFrame(pd.DataFrame({"release_timestamp": pd.date_range("2014-12-31", periods=60, freq="ME"), "vix": np.linspace(10, 40, 60), "yield_2y": 1.0, "yield_10y": np.linspace(1, 3, 60), "credit_spread": np.sin(np.arange(60.0))}))
    bench = bars.filter("symbol = 'AAA'").select("timestamp", "close")
    d, _ = default_registry().generate(bars, [FeatureSpec("macro"), FeatureSpec("regime"), FeatureSpec("relative_strength")], {"macro": macro, "benchmark": bench})
    assert d.count() == bars.count()
    assert {"macro_vix_proxy_z63", "regime_state_code", "beta_vs_bench_w60"} <= set(d.columns)


def test_model_frame_and_lookahead(spark, bars):
    f = MF.model_frame(bars, horizon=5)
    feats = MF.feature_names(f.columns)
    assert len(feats) == 75
    assert f.filter("symbol = 'BBB'").count() == 0
    gen = lambda d: MF.model_frame(d, horizon=None, drop_missing=False)
    v = M.lookahead_violations(bars.filter("symbol = 'AAA'"), gen, ["sma_50", "ema_26", "macd_signal", "adx", "ad_line"], cuts=3, tol=1e-6)
    assert v.count() == 0


def test_walk_forward_folds_expand(bars):
    d = M.walk_forward_folds(bars, 5).groupBy("fold").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("z"), F.countDistinct("timestamp").alias("n")).orderBy("fold").toPandas()
    assert d["fold"].tolist() == [0, 1, 2, 3, 4, 5] and (d["n"][1:] == 900 // 6).all()
    assert (d["a"][1:].to_numpy() > d["z"][:-1].to_numpy()).all()


def test_scaler_uses_only_the_fitted_frame(bars, bars_pdf):
    from marketloom.operators import technical as T
    a = T.apply_scaler(bars, T.fit_scaler(bars, ["close", "volume"], "robust"), ["close", "volume"]).toPandas()
    q = bars_pdf["close"].quantile([0.25, 0.5, 0.75]).to_numpy()
    np.testing.assert_allclose(np.sort(a["close"]), np.sort((bars_pdf["close"] - q[1]) / (q[2] - q[0])), rtol=1e-9)
