"""Indicator snapshot, pivots and chart patterns per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, safe_div
from .series import DAILY, EMA_BACK, IX, TOTAL, Blocked, Layout, blocked, ema_layers, full, lag, top_per_key
from .technical import macd, momentum, true_range

col = F.col


def pivot_flags(b: Blocked, x: str, k: int, high: bool) -> Column:
    """True where x is at least (at most) all k values on both sides."""
    agg = F.max if high else F.min
    left, right = b.rows(-k, -1), b.rows(1, k)
    whole = (F.count(x).over(left) >= k) & (F.count(x).over(right) >= k)
    edge = (lambda w: col(x) >= agg(x).over(w)) if high else (lambda w: col(x) <= agg(x).over(w))
    return whole & edge(left) & edge(right)


def pivots(bars: DataFrame, k: int = 3, layout: Layout = DAILY) -> DataFrame:
    """(symbol, ix, timestamp, kind, level) of local highs and lows."""
    b = blocked(bars, layout, back=k, ahead=k).indexed()
    b.stage({"_h": pivot_flags(b, "high", k, True), "_l": pivot_flags(b, "low", k, False)})
    d = b.owned(keep=(IX,))
    items = F.array_compact(F.array(F.when(col("_h"), F.struct(F.lit("high").alias("kind"), col("high").alias("level"))), F.when(col("_l"), F.struct(F.lit("low").alias("kind"), col("low").alias("level")))))
    return d.select(*layout.keys, col(IX).alias("ix"), layout.time, F.inline(items))


def last_pivots(p: DataFrame, n: int) -> DataFrame:
    """The newest n pivots of each kind, rank 1 being the newest."""
    return top_per_key(p, ["symbol", "kind"], [F.desc("ix")], n, "rank")


def newest_close(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "timestamp").alias("last_close"))


def support_resistance(bars: DataFrame, k: int = 3, n: int = 20) -> DataFrame:
    """Three nearest distinct pivot levels below and above the close."""
    p = last_pivots(pivots(bars, k), n).join(newest_close(bars), "symbol")
    lows = F.collect_set(F.when((col("kind") == "low") & (col("level") <= col("last_close")), col("level")))
    highs = F.collect_set(F.when((col("kind") == "high") & (col("level") >= col("last_close")), col("level")))
    g = p.groupBy("symbol").agg(F.reverse(F.array_sort(lows)).alias("_s"), F.array_sort(highs).alias("_r"))
    r4 = lambda a: F.transform(F.slice(a, 1, 3), lambda v: F.round(v, 4))
    out = g.select("symbol", r4("_s").alias("supports"), r4("_r").alias("resistances"))
    return newest_close(bars).select("symbol").join(out, "symbol", "left").withColumns({c: F.coalesce(c, F.array().cast("array<double>")) for c in ("supports", "resistances")})


def indicator_rows(bars: DataFrame, layout: Layout = DAILY) -> DataFrame:
    """Indicators of the newest bar with their text labels."""
    b = blocked(bars, layout, back=EMA_BACK).indexed()
    ema_layers(b, {"ema20": (col("close"), 20, False)})
    momentum(b)
    macd(b)
    b.stage({"_tr": true_range(b), "sma20": full(b, col("close"), 20, F.avg), "sma50": full(b, col("close"), 50, F.avg), "_sd": full(b, col("close"), 20, F.stddev_samp),
             "avg_volume_20": full(b, col("volume"), 20, F.avg), "avg_volume_60": full(b, col("volume"), 60, F.avg), "_pc": lag(b, "close"), "_v20": F.avg("volume").over(b.rows(-19, 0))})
    b.stage({"atr14": full(b, col("_tr"), 14, F.avg), "boll_upper": col("sma20") + 2 * col("_sd"), "boll_lower": col("sma20") - 2 * col("_sd")})
    d = b.owned(keep=(IX, TOTAL)).filter(col(IX) == col(TOTAL) - 1)
    x = col("close")
    d = d.withColumns({
        "rsi14": col("rsi_w14"), "macd_line": col("macd_12_26_9"), "macd_signal": col("macd_signal_12_26_9"), "macd_histogram": col("macd_hist_12_26_9"),
        "close_vs_sma20": safe_div(x, F.coalesce("sma20", x)) - 1.0, "close_vs_sma50": safe_div(x, F.coalesce("sma50", x)) - 1.0, "close_vs_ema20": safe_div(x, "ema20") - 1.0,
        "atr_pct": F.coalesce(safe_div("atr14", "close"), F.lit(0.0)), "boll_position": F.coalesce(safe_div(x - col("boll_lower"), col("boll_upper") - col("boll_lower")), F.lit(0.5)),
        "volume_ratio_20_60": F.coalesce(safe_div("avg_volume_20", "avg_volume_60"), F.lit(1.0)), "daily_change_pct": safe_div(x, F.coalesce("_pc", x)) - 1.0,
        "volume_ratio": safe_div("volume", "_v20"),
    })
    d = d.withColumns({
        "rsi_view": F.when(col("rsi14") >= 70, "overbought momentum").when(col("rsi14") <= 30, "oversold momentum").otherwise("neutral momentum"),
        "macd_view": F.when(col("macd_histogram") > 0, "bullish momentum bias").otherwise("bearish momentum bias"),
        "sma_view": F.when(x >= F.coalesce("sma20", x), "trend above moving averages").otherwise("trend below short moving average"),
        "ema_view": F.when(x >= F.coalesce("ema20", x), "price leading EMA").otherwise("price lagging EMA"),
        "atr_view": F.when(col("atr_pct") > 0.03, "elevated realized range").otherwise("contained realized range"),
        "boll_view": F.when(col("boll_position") > 0.8, "near upper band").when(col("boll_position") < 0.2, "near lower band").otherwise("inside band range"),
        "volume_view": F.when(col("volume_ratio_20_60") > 1.1, "rising participation").when(col("volume_ratio_20_60") < 0.9, "cooling participation").otherwise("stable participation"),
    })
    return d.select(*layout.keys, layout.time, col("close").alias("latest_close"), col("volume").alias("latest_volume"), "sma20", "sma50", "ema20", "rsi14", "macd_line", "macd_signal", "macd_histogram",
                    "atr14", "atr_pct", "boll_upper", "boll_lower", "boll_position", "avg_volume_20", "avg_volume_60", "volume_ratio_20_60", "daily_change_pct", "volume_ratio", "close_vs_sma20", "close_vs_sma50",
                    "close_vs_ema20", "rsi_view", "macd_view", "sma_view", "ema_view", "atr_view", "boll_view", "volume_view")


def _tail(bars: DataFrame, n: int) -> DataFrame:
    """Newest n bars per symbol with their index."""
    b = blocked(bars, DAILY).indexed()
    return b.df.filter(col(IX) >= col(TOTAL) - n)


def trend_channel(bars: DataFrame, window: int = 40) -> DataFrame:
    t = _tail(bars, max(window, 20)).withColumn("_x", (col(IX) - col(TOTAL)).cast("double"))
    g = t.groupBy("symbol").agg(F.regr_slope("close", "_x").alias("slope"), F.regr_r2("close", "_x").alias("r2"), F.avg("close").alias("m"), F.count("*").alias("n"))
    p = safe_div("slope", "m")
    lab = F.when(p > 0.001, "uptrend").when(p < -0.001, "downtrend").otherwise("sideways")
    r2 = F.coalesce("r2", F.lit(0.0))
    conf = clip(0.45 + F.least(F.lit(0.35), F.abs(p) * 900.0) + F.greatest(F.lit(0.0), F.least(F.lit(0.15), r2 * 0.15)), 0.35, 0.95)
    return g.select("symbol", F.lit("trend_channel").alias("name"), lab.alias("signal"), F.round(conf, 3).alias("confidence"),
                    F.to_json(F.struct(F.round(p, 6).alias("slope_pct_per_bar"), F.round(r2, 6).alias("r2"))).alias("metrics"))


def range_breakout(bars: DataFrame, lookback: int = 20) -> DataFrame:
    t = _tail(bars, lookback + 5).withColumn("_age", col(TOTAL) - col(IX))
    prior = (col("_age") >= 2) & (col("_age") <= lookback + 1)
    g = t.groupBy("symbol").agg(F.max(F.when(prior, col("high"))).alias("hi"), F.min(F.when(prior, col("low"))).alias("lo"), F.max(F.when(col("_age") == 1, col("close"))).alias("x"),
                                F.max(F.when(col("_age") == 1, col("volume"))).alias("v"), F.avg(F.when(col("_age") <= 20, col("volume"))).alias("v20"), F.count("*").alias("n"))
    vr = safe_div("v", "v20")
    up, dn = col("x") > col("hi") * 1.003, col("x") < col("lo") * 0.997
    dist = F.when(up, safe_div("x", "hi") - 1.0).when(dn, 1.0 - safe_div("x", "lo")).otherwise(0.0)
    enough = col("n") >= lookback + 5
    conf = F.least(F.lit(0.95), 0.55 + F.least(F.lit(0.25), dist * 20.0) + F.least(F.lit(0.15), F.greatest(F.lit(0.0), vr - 1.0) * 0.2))
    return g.select("symbol", F.lit("range_breakout").alias("name"), F.when(~enough, "insufficient_data").when(up, "upside_breakout").when(dn, "downside_breakout").otherwise("inside_range").alias("signal"),
                    F.when(~enough, 0.2).when(up | dn, F.round(conf, 3)).otherwise(0.35).alias("confidence"),
                    F.to_json(F.struct(F.round("hi", 6).alias("prior_high"), F.round("lo", 6).alias("prior_low"), F.round(dist, 6).alias("distance"))).alias("metrics"))


def double_patterns(bars: DataFrame) -> DataFrame:
    """Double tops and bottoms from the last two pivots (k = 4)."""
    p = last_pivots(pivots(bars, 4), 2)
    pair = p.groupBy("symbol", "kind").agg(*[F.max(F.when(col("rank") == r, F.struct("ix", "level"))).alias(f"_{n}") for r, n in ((2, "l"), (1, "r"))]).filter("_l is not null and _r is not null")
    pair = pair.select("symbol", "kind", col("_l.ix").alias("i1"), col("_l.level").alias("p1"), col("_r.ix").alias("i2"), col("_r.level").alias("p2"))
    base = F.when(col("kind") == "high", F.greatest("p1", "p2")).otherwise(F.least("p1", "p2"))
    pair = pair.withColumn("diff", safe_div(F.abs(col("p2") - col("p1")), base)).filter((col("i2") - col("i1") >= 5) & (col("diff") <= 0.03))
    b = blocked(bars, DAILY).indexed()
    rows = b.df.select("symbol", "close", col(IX).alias("ix"), col(TOTAL).alias("n"))
    span = pair.join(rows, "symbol").filter(((col("ix") >= col("i1")) & (col("ix") <= col("i2"))) | (col("ix") == col("n") - 1))
    inside = (col("ix") >= col("i1")) & (col("ix") <= col("i2"))
    g = span.groupBy("symbol", "kind", "p1", "p2", "diff").agg(F.min(F.when(inside, col("close"))).alias("lo"), F.max(F.when(inside, col("close"))).alias("hi"), F.max(F.when(col("ix") == col("n") - 1, col("close"))).alias("x"))
    top = col("kind") == "high"
    done = F.when(top, col("x") < col("lo") * 0.995).otherwise(col("x") > col("hi") * 1.005)
    conf = clip(0.55 + 0.25 * (1.0 - F.least(F.lit(1.0), col("diff") / 0.03)) + F.when(done, 0.1).otherwise(0.0), 0.2, 0.95)
    return g.select("symbol", F.when(top, "double_top").otherwise("double_bottom").alias("name"),
                    F.when(top, F.when(done, "bearish_reversal").otherwise("potential_double_top")).otherwise(F.when(done, "bullish_reversal").otherwise("potential_double_bottom")).alias("signal"),
                    F.round(conf, 3).alias("confidence"), F.to_json(F.struct(F.round("p1", 6).alias("first"), F.round("p2", 6).alias("second"), F.round("diff", 6).alias("diff_pct"))).alias("metrics"))


def head_and_shoulders(bars: DataFrame) -> DataFrame:
    p = last_pivots(pivots(bars, 3).filter("kind = 'high'"), 3)
    g = p.groupBy("symbol").agg(*[F.max(F.when(col("rank") == r, col(c))).alias(f"{c}{r}") for r in (1, 2, 3) for c in ("ix", "level")], F.count("*").alias("n")).filter("n = 3")
    big = F.greatest("level3", "level1")
    sim, margin = safe_div(F.abs(col("level3") - col("level1")), big), safe_div(col("level2") - big, "level2")
    ok = (col("ix2") - col("ix3") >= 3) & (col("ix1") - col("ix2") >= 3) & (sim <= 0.05) & (margin >= 0.03)
    conf = F.least(F.lit(0.9), 0.55 + 0.2 * (1.0 - sim / 0.05) + F.least(F.lit(0.15), margin * 1.2))
    return g.filter(ok).select("symbol", F.lit("head_and_shoulders").alias("name"), F.lit("bearish_reversal_pattern").alias("signal"), F.round(conf, 3).alias("confidence"),
                               F.to_json(F.struct(F.round("level3", 6).alias("left"), F.round("level2", 6).alias("head"), F.round("level1", 6).alias("right"))).alias("metrics"))


def chart_patterns(bars: DataFrame) -> DataFrame:
    return trend_channel(bars).unionByName(range_breakout(bars)).unionByName(double_patterns(bars)).unionByName(head_and_shoulders(bars))


def model_section(symbols: DataFrame, preds: DataFrame) -> DataFrame:
    """Model probabilities with defaults, or an unavailable row."""
    d = symbols.select("symbol").join(preds.withColumn("_has", F.lit(True)), "symbol", "left")
    have = F.coalesce("_has", F.lit(False))
    dflt = lambda c: F.when(have, F.coalesce(c, F.lit(0.5)) if c in preds.columns else F.lit(0.5))
    return d.select("symbol", have.alias("model_available"), *[dflt(c).alias(c) for c in ("probability_up", "probability_down", "confidence")])


def risk_notes(df: DataFrame) -> DataFrame:
    """Note codes in a fixed order; `none` when nothing stands out."""
    rsi = F.coalesce("rsi14", F.lit(50.0))
    notes = F.array_compact(F.array(
        F.when(col("atr_pct") > 0.03, "elevated_volatility"), F.when(rsi >= 70, "overbought").when(rsi <= 30, "oversold"),
        F.when(col("breakout_signal").isin("upside_breakout", "downside_breakout"), F.concat(F.lit("breakout:"), col("breakout_signal"))),
        F.when(col("volatility_regime") == "high_volatility", "high_volatility_regime"),
        F.when(~col("model_available"), "no_model_output").when(F.coalesce("confidence", F.lit(0.5)) < 0.60, "modest_model_confidence"),
        F.when(F.coalesce("headline_count", F.lit(0)) == 0, "no_headlines")))
    return df.withColumn("risk_notes", F.when(F.size(notes) == 0, F.array(F.lit("none"))).otherwise(notes))


def next_steps(df: DataFrame) -> DataFrame:
    steps = F.array_compact(F.array(
        F.lit("confirm_levels"), F.lit("track_volume"), F.lit("rerun_after_catalyst"), F.when(col("breakout_signal") != "inside_range", "watch_retest"),
        F.when(col("model_available"), "compare_model_with_indicators").otherwise("compare_when_model_available")))
    return df.withColumn("next_steps", F.slice(steps, 1, 5))


def report(bars: DataFrame, preds: DataFrame, headlines: DataFrame | None = None) -> DataFrame:
    """One analysis row per symbol."""
    from .regime import report_regime

    ind = indicator_rows(bars)
    brk = range_breakout(bars).select("symbol", col("signal").alias("breakout_signal"))
    pat = chart_patterns(bars).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("name", "signal", "confidence"))).alias("patterns"))
    d = ind.join(brk, "symbol", "left").join(pat, "symbol", "left").join(report_regime(bars.select("symbol", "timestamp", "close")).drop("timestamp"), "symbol", "left")
    d = d.join(support_resistance(bars), "symbol", "left").join(model_section(ind, preds), "symbol", "left")
    d = d.join(headlines, "symbol", "left") if headlines is not None else d.withColumns({"headline_count": F.lit(0).cast("bigint"), "tone": F.lit("neutral")})
    return next_steps(risk_notes(d))
