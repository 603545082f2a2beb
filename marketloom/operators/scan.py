"""Universe scan: analogs, trade set-ups, context flags, option tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, div, mid_price, relative_spread
from ..session import cut_lineage
from .bars import canonicalize
from .model_features import model_frame
from .quality import QualityPolicy, gate_flags, gate_report, gate_rows
from .series import DAILY, IX, TOTAL, Layout, attach_row, blocked, declare_daily, full, lag, latest, top_per_key
from .technical import YEAR

z = lambda c, d: F.coalesce(F.col(c), F.lit(d))


def pattern_analogs(closes: DataFrame, *, window: int = 30, horizon: int = 5, k: int = 5, layout: Layout = DAILY) -> DataFrame:
    """The k past return windows closest to the newest one, per symbol."""
    b = blocked(closes, layout, back=window + 1, ahead=horizon).indexed()
    x = F.greatest(F.col("close"), F.lit(1e-9))
    b.stage({"_r": F.ln(x) - F.ln(lag(b, x))})
    fr = b.rows(-(window - 1), 0)
    b.stage({"_vec": F.when(F.count("_r").over(fr) >= window, F.collect_list("_r").over(fr)), "_fwd": div(F.lead("close", horizon).over(b.window), "close") - 1.0,
             "window_start": F.first(layout.time).over(fr)})
    rows = b.owned(keep=(IX, TOTAL)).filter(F.col(TOTAL) >= window + horizon + 15)
    newest = rows.filter(F.col(IX) == F.col(TOTAL) - 1).select(*layout.keys, F.col("_vec").alias("_new"))
    # windows that end before the newest one starts and whose outcome is known
    old = rows.filter((F.col(IX) >= window) & (F.col(IX) < F.col(TOTAL) - 1 - window) & (F.col(IX) < F.col(TOTAL) - 1 - horizon) & F.col("_fwd").isNotNull() & F.col("_vec").isNotNull())
    d = old.join(newest, [*layout.keys])
    dist = F.sqrt(F.aggregate(F.zip_with("_vec", "_new", lambda a, c: (a - c) * (a - c)), F.lit(0.0), lambda acc, v: acc + v))
    d = d.select(*layout.keys, "window_start", F.col(layout.time).alias("window_end"), dist.alias("distance"), F.col("_fwd").alias("forward_return"))
    return top_per_key(d, [*layout.keys], [F.col("distance"), F.col("window_end")], k, "rank").withColumn("outcome", F.when(F.col("forward_return") > 0, "up").otherwise("down"))


def analog_outcomes(analogs: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Count, mean, median and win rate of at most k analogs per symbol."""
    r = F.col("forward_return")
    return analogs.groupBy(*keys).agg(F.count("*").alias("count"), F.avg(r).alias("mean_forward_return"), F.percentile(r, 0.5).alias("median_forward_return"), F.avg((r > 0).cast("double")).alias("win_rate"))


def trade_setup(df: DataFrame, *, horizon_days: int = 5, portfolio: float = 100_000.0, max_risk_pct: float = 2.0, max_position_pct: float = 5.0) -> DataFrame:
    """Bias, prices, size, reasons and flags from newest features and a
    prediction.  Reads price, the model features, probability_up and,
    optionally, confidence and model_accuracy."""
    px = F.col("price")
    atr = F.greatest(F.coalesce("atr_14", px * 0.01), px * 0.004)
    votes = F.lit(0)
    for c in ("price_sma20_ratio", "price_sma50_ratio", "price_sma200_ratio"):
        votes = votes + F.when(z(c, 1.0) > 1.0, 1).otherwise(0)
    h = z("hvol_20", 0.2)
    up = clip(z("probability_up", 0.5), 0.0, 1.0)
    acc = F.coalesce(clip((F.col("model_accuracy") - 0.5) / 0.25, 0.0, 1.0), F.lit(0.5)) if "model_accuracy" in df.columns else F.lit(0.5)
    d = df.withColumns({
        "atr": atr, "trend": F.when(votes >= 2, "BULLISH").otherwise("BEARISH"), "volatility": F.when(h >= 0.40, "HIGH").when(h <= 0.18, "LOW").otherwise("NORMAL"),
        "momentum": F.when(z("roc_5", 0.0) > 0, "POSITIVE").otherwise("NEGATIVE"), "bias": F.when(up >= 0.60, "LONG").when(up <= 0.40, "SHORT").otherwise("NO_TRADE"),
        "setup_confidence": clip(0.65 * F.abs(up - 0.5) * 2.0 + 0.35 * acc, 0.05, 0.95),
    })
    s = F.when(F.col("bias") == "LONG", 1.0).when(F.col("bias") == "SHORT", -1.0)
    a = F.col("atr")
    d = d.withColumn("entry_trigger", px + s * 0.25 * a)
    e = F.col("entry_trigger")
    near, far = px + s * 0.10 * a, px + s * 0.50 * a
    d = d.withColumns({
        "setup_type": F.when(F.col("bias") == "LONG", F.when(F.col("trend") == "BULLISH", "BREAKOUT_CONTINUATION").otherwise("PULLBACK_LONG"))
        .when(F.col("bias") == "SHORT", F.when(F.col("trend") == "BEARISH", "BREAKDOWN_CONTINUATION").otherwise("RALLY_FADE")).otherwise("WAIT_FOR_EDGE"),
        "zone_low": F.when(s.isNotNull(), F.least(near, far)), "zone_high": F.when(s.isNotNull(), F.greatest(near, far)),
        "stop_loss": e - s * 1.6 * a, "target_1": e + s * 2.0 * a, "target_2": e + s * 3.5 * a, "risk_per_share": 1.6 * a * F.abs(s),
    })
    by_risk = F.floor(F.try_divide(F.lit(portfolio * max_risk_pct / 100.0), F.col("risk_per_share")))
    by_pos = F.when(e > 0, F.floor(F.lit(portfolio * max_position_pct / 100.0) / e)).otherwise(0)
    shares = F.coalesce(F.greatest(F.least(by_risk, by_pos), F.lit(0)), F.lit(0))
    d = d.withColumn("suggested_shares", shares)
    rr = lambda t: F.abs(F.col(t) - e) / F.col("risk_per_share")
    d = d.withColumns({"suggested_notional": F.coalesce(F.col("suggested_shares") * e, F.lit(0.0)), "rr_target_1": rr("target_1"), "rr_target_2": rr("target_2")})
    rsi, adx, vr = z("rsi_14", 50.0), z("adx", 18.0), z("vol_ratio_20", 1.0)
    flags = F.array_compact(F.array(
        F.when(F.col("bias") == "NO_TRADE", "weak_edge"), F.when(F.col("volatility") == "HIGH", "high_volatility"), F.when(adx < 16, "weak_trend"), F.when(rsi >= 72, "overbought"),
        F.when(rsi <= 28, "oversold"), F.when((F.col("bias") != "NO_TRADE") & (F.col("suggested_shares") <= 0), "risk_budget_too_small")))
    reasons = F.array_compact(F.array(
        F.format_string("Model probability up=%.1f%%.", up * 100.0), F.format_string("Trend regime: %s; momentum: %s; RSI=%.1f.", "trend", "momentum", rsi),
        F.format_string("Volatility regime: %s (ATR=%.2f%% of price).", F.col("volatility"), div("atr", "price") * 100.0),
        F.when(vr >= 1.2, F.format_string("Volume is expanding (%.2fx 20-day average).", vr)), F.when(adx >= 20, F.format_string("Trend strength is constructive (ADX %.1f).", adx))))
    return d.withColumns({"risk_flags": flags, "reasons": reasons, "position_pct": F.col("suggested_notional") / portfolio * 100.0, "horizon_days": F.lit(horizon_days),
                          "options_stance": F.when(s > 0, "Bullish").when(s < 0, "Bearish").otherwise("Neutral")})


def context_flags(df: DataFrame) -> DataFrame:
    """Trend, volatility, risk, spike and gap flags of the newest bar.

    Reads adx, hvol_20, vol_ratio_20, gap, bench_ret_20."""
    h = z("hvol_20", 0.0)
    return df.withColumns({
        "trend_state": F.when(z("adx", 0.0) >= 20, "trend").otherwise("chop"), "vol_state": F.when(h >= 0.40, "high_vol").when(h <= 0.18, "low_vol").otherwise("mid_vol"),
        "risk_proxy": F.when(F.col("bench_ret_20") < 0, "risk_off").otherwise("risk_on"), "volume_spike": z("vol_ratio_20", 1.0) >= 1.8,
        "gap_flag": F.coalesce(F.abs("gap") >= 0.02, F.lit(False)),
    })


def risk_mode(confidence, vol_state) -> Column:
    c = F.coalesce(F.col(confidence), F.lit(0.5))
    return F.when((c < 0.58) | (F.col(vol_state) == "high_vol"), "conservative").when((c >= 0.75) & (F.col(vol_state) == "low_vol"), "aggressive").otherwise("standard")


def relative_strength(symbols: DataFrame, bench: DataFrame, sector_etf: DataFrame, etf: DataFrame) -> DataFrame:
    """Return over benchmark and over the sector's fund (J15)."""
    d = symbols.join(sector_etf, "sector", "left").join(etf.select(F.col("etf"), F.col("ret").alias("etf_ret")), "etf", "left")
    d = attach_row(d, bench.agg(F.max("ret").alias("bench_ret")))
    return d.withColumns({"rel_vs_bench": F.col("ret") - F.col("bench_ret"), "rel_vs_sector": F.col("ret") - F.col("etf_ret")})


def guards(bars: DataFrame, horizon: int = 5, flags_ok: DataFrame | None = None) -> DataFrame:
    """Per-symbol scan status: `ok` or why the symbol is a failed row."""
    need = max(260, 60 * horizon)
    g = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.max_by("close", "timestamp").alias("last_close"))
    return g.withColumn("status", F.when(F.col("rows") < need, "insufficient_history").when(~F.coalesce(F.col("last_close") > 0, F.lit(False)), "invalid_price").otherwise("ok"))


def remaining(universe: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Symbols still to scan: completed ones are skipped unless forced."""
    return universe if force else universe.join(done.filter("status = 'completed'").select("symbol"), "symbol", "left_anti")


# ---- the composed scan -------------------------------------------------------------

#: What a symbol can fail with, by stage.
SCAN_CODES = {"history": ("no_data", "insufficient_history"), "quality": ("minimum_history",), "features": ("no_features", "invalid_price"), "prediction": ("no_prediction",)}


def failing(rows: DataFrame, stage: str, **codes: Column) -> DataFrame:
    """Rows with (status, stage, code): the first condition that holds fails a row, unless an earlier stage did. Failed rows stay."""
    code = F.lit(None).cast("string")
    for name, hit in reversed(codes.items()):
        code = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(code)
    if "code" not in rows.columns:
        rows = rows.withColumns({"stage": F.lit(None).cast("string"), "code": F.lit(None).cast("string")})
    fresh = F.col("code").isNull() & code.isNotNull()
    return rows.withColumns({"stage": F.when(fresh, stage).otherwise(F.col("stage")), "code": F.when(fresh, code).otherwise(F.col("code"))})


def passing(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The part of `df` whose symbols have not failed."""
    return df.join(rows.filter("code IS NULL").select("symbol"), "symbol", "left_semi")


def universe_scan(universe: DataFrame, bars: DataFrame, predict: Callable[[DataFrame], DataFrame], bench: DataFrame, sector_etf: DataFrame, etf: DataFrame,
                  *, horizon: int = 5, policy: QualityPolicy = QualityPolicy(), done: DataFrame | None = None, force: bool = False) -> DataFrame:
    """One row per symbol of `universe`: status, stage and code of a failure, and for the others the whole set-up.

    `bars` are daily; `predict` turns the newest features (`symbol`, `price`, ...)
    into (symbol, probability_up); `bench` has (ret), `sector_etf` (sector, etf),
    `etf` (etf, ret), returns over 20 bars. Failure is data: each stage adds its
    code to the rows that it cannot serve, and later stages work on the bars of
    the others only. Symbols that `done` has as completed are left out unless
    `force`, so a scan that was broken off goes on where it stopped. The bars and
    the rows that several stages read are checkpointed, each is computed once.
    """
    bars = cut_lineage(bars)
    rows = universe.select("symbol", "sector").dropDuplicates(["symbol"])
    rows = rows if done is None else remaining(rows, done, force)
    seen = guards(bars, horizon).select("symbol", "rows", F.col("status").alias("_guard"))
    span = bars.groupBy("symbol").agg(F.min("timestamp").alias("first_bar"), F.max("timestamp").alias("last_bar"))
    rows = rows.join(seen, "symbol", "left").join(span, "symbol", "left")
    rows = failing(rows, "history", no_data=F.col("rows").isNull(), insufficient_history=F.col("_guard") == "insufficient_history").drop("_guard")

    rows = cut_lineage(rows)
    flags = gate_flags(canonicalize(passing(bars, rows)), policy)
    report = gate_report(flags, policy, horizon).select("symbol", "history_ok", "rows_after")
    rows = cut_lineage(failing(rows.join(report, "symbol", "left"), "quality", minimum_history=~F.col("history_ok")).drop("history_ok"))
    clean = declare_daily(cut_lineage(passing(gate_rows(flags), rows).select("symbol", "timestamp", "open", "high", "low", "close", "volume")))

    frame = latest(model_frame(clean, horizon=None), ["symbol"], ["timestamp"]).withColumnRenamed("close", "price").drop("open", "high", "low", "volume", "timestamp")
    b = blocked(clean.select("symbol", "timestamp", "close"), DAILY, back=20)
    near = b.rows(-19, 0)
    b.stage({"ret": F.try_divide(F.col("close"), lag(b, "close", 20)) - 1.0, "gap": F.try_divide(F.col("close"), lag(b, "close")) - 1.0, "recent_high": F.max("close").over(near), "recent_low": F.min("close").over(near)})
    moves = latest(b.owned(), ["symbol"], ["timestamp"], ["ret", "gap", "recent_high", "recent_low"]).select("symbol", "ret", "gap", "recent_high", "recent_low")
    rows = cut_lineage(rows.join(frame, "symbol", "left").join(moves, "symbol", "left"))
    rows = failing(rows, "features", no_features=F.col("rows_after").isNotNull() & F.col("price").isNull(), invalid_price=F.col("price") <= 0)
    predicted = predict(rows.filter("code IS NULL")).select("symbol", "probability_up")
    rows = cut_lineage(failing(rows.join(predicted, "symbol", "left"), "prediction", no_prediction=F.col("probability_up").isNull()))

    d = attach_row(rows, bench.agg(F.max("ret").alias("bench_ret_20")))
    d = d.join(sector_etf, "sector", "left").join(etf.select("etf", F.col("ret").alias("sector_ret_20")), "etf", "left")
    d = context_flags(trade_setup(d, horizon_days=horizon))
    past = pattern_analogs(passing(clean.select("symbol", "timestamp", "close"), rows), window=max(20, min(45, horizon * 6)), horizon=max(1, horizon))
    d = d.join(analog_outcomes(past).select("symbol", F.col("count").alias("analogs"), F.col("mean_forward_return").alias("analog_return")), "symbol", "left")
    ok = F.col("code").isNull()
    out = {
        "price": F.col("price"), "bias": F.col("bias"), "setup_type": F.col("setup_type"), "primary_score": F.col("setup_confidence"), "stop_loss": F.col("stop_loss"), "target_1": F.col("target_1"),
        "trend_state": F.col("trend_state"), "vol_state": F.col("vol_state"), "risk_proxy": F.col("risk_proxy"), "risk_mode": risk_mode("setup_confidence", "vol_state"),
        "volume_spike": F.col("volume_spike"), "gap_flag": F.col("gap_flag"), "rel_vs_bench": F.col("ret") - F.col("bench_ret_20"), "rel_vs_sector": F.col("ret") - F.col("sector_ret_20"),
        "distance_to_high": F.try_divide(F.col("price"), F.col("recent_high")) - 1.0, "distance_to_low": F.try_divide(F.col("price"), F.col("recent_low")) - 1.0, "analogs": F.col("analogs"), "analog_return": F.col("analog_return"),
    }
    return d.select("symbol", F.when(ok, "completed").otherwise("failed").alias("status"), "stage", "code", "rows", "first_bar", "last_bar", *[F.when(ok, c).alias(k) for k, c in out.items()])


def resume_scan(spark, folder: str, run: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
    """Run a scan into a folder, or go on with one: completed symbols are not run again, failed ones are. The newest row of each symbol.

    Each call appends one attempt, so a scan whose driver or executors were lost
    is called again with the same folder.
    """
    def rows() -> DataFrame | None:
        try:
            return spark.read.parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    before = rows()
    attempt = 1 if before is None else before.agg(F.max("attempt")).first()[0] + 1
    run(before).withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(folder)
    return latest(rows(), ["symbol"], ["attempt"])


def momentum_screen(bars: DataFrame, lookback: int = 20, least: float = 0.05) -> DataFrame:
    """Symbols whose newest close is at least 5% over the close lookback-1
    bars earlier, strongest first."""
    b = blocked(bars, DAILY).indexed()
    age = F.col(TOTAL) - F.col(IX)
    g = b.df.filter(age.isin(1, lookback)).withColumn("_a", age).groupBy("symbol").agg(F.max(F.when(F.col("_a") == 1, F.col("close"))).alias("close"), F.max(F.when(F.col("_a") == lookback, F.col("close"))).alias("past"))
    m = F.try_divide(F.col("close") - F.col("past"), F.col("past"))
    return g.withColumn("momentum", m).filter(F.col("momentum") >= least).orderBy(F.desc("momentum"), "symbol")


# ---- options ---------------------------------------------------------------------

def iv_metrics(closes: DataFrame, quotes: DataFrame) -> DataFrame:
    """hv20, hv50, near-the-money IV, spread and rank per symbol."""
    b = blocked(closes, DAILY, back=52)
    b.stage({"_r": F.try_divide(F.col("close"), lag(b, "close")) - 1.0})
    b.stage({"hv_20": full(b, F.col("_r"), 20, F.stddev_samp) * YEAR, "hv_50": full(b, F.col("_r"), 50, F.stddev_samp) * YEAR})
    hv = latest(b.owned(), ["symbol"], ["timestamp"], ["hv_20", "hv_50"])
    near = (F.abs(F.col("strike") - F.col("spot")) / F.col("spot") < 0.05) & (F.col("type") == "call") & (F.coalesce("iv", F.lit(0.0)) != 0)
    iv = quotes.filter(near).groupBy("symbol").agg(F.avg("iv").alias("current_iv"))
    d = hv.join(iv, "symbol")
    rank = clip(F.try_divide(F.col("current_iv") - F.col("hv_50"), F.col("hv_20") - F.col("hv_50") + 0.01) * 100.0, 0.0, 100.0)
    return d.withColumns({"iv_hv_spread": F.col("current_iv") - F.col("hv_20"), "iv_rank": rank})


def iv_rank_screen(metrics: DataFrame, least: float = 50.0) -> DataFrame:
    return metrics.filter(F.col("iv_rank") >= least).orderBy(F.desc("iv_rank"), "symbol")


def option_liquidity(quotes: DataFrame, key: str, order: list[str], n: int = 25) -> DataFrame:
    """Spread and volume of the first calls of each underlying."""
    first = top_per_key(quotes.filter("type = 'call'"), [key], [F.col(o) for o in order], n)
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull() & (mid_price("bid", "ask") > 0)
    g = first.groupBy(key).agg(F.avg(F.when(both, relative_spread("bid", "ask"))).alias("avg_relative_spread"), F.avg("volume").alias("avg_volume"))
    bad = F.coalesce(F.col("avg_relative_spread") > 0.35, F.lit(False)) | F.coalesce(F.col("avg_volume") < 20, F.lit(False))
    return g.withColumn("liquidity_ok", ~bad)


def term_slope(quotes: DataFrame, key: str, expiry: str) -> DataFrame:
    """Far IV minus near IV, where far is at most the third expiry."""
    iv = quotes.groupBy(key, expiry).agg(F.min_by("iv", "strike").alias("_iv"))
    first = top_per_key(iv.filter(F.col(key).isNotNull()), [key], [F.col(expiry)], 3)
    g = first.groupBy(key).agg(F.min(expiry).alias("_near"), F.max(expiry).alias("_far"), F.min_by("_iv", expiry).alias("near_iv"), F.max_by("_iv", expiry).alias("far_iv"))
    return g.filter("_near < _far").select(key, (F.col("far_iv") - F.col("near_iv")).alias("term_structure_slope"))


def option_candidates(df: DataFrame, horizon_days: int = 5) -> DataFrame:
    """Ranked option plans per set-up row (bias, confidence, iv_rank, price)."""
    c, px = clip("confidence", 0.0, 1.0), F.col("price")
    dte = F.lit(max(14, min(60, max(1, horizon_days) * 4)))
    mv = px * F.greatest(F.lit(0.01), F.least(F.lit(0.2), 0.015 + 0.12 * z("iv_rank", 0.0) / 100.0))
    rich = F.coalesce(F.col("iv_rank") >= 55.0, F.lit(False))
    spread_pop, single_pop = clip(0.52 + c * 0.30, 0.05, 0.95), clip(0.45 + c * 0.35, 0.05, 0.95)
    r2, r4 = (lambda x: F.round(x, 2)), (lambda x: F.round(x, 4))

    def plan(rank, kind, strikes, side, mid, loss, gain, be, pop, ev, conf):
        return F.struct(F.lit(rank).alias("rank"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("strategy_type"), dte.alias("expiry_dte"), F.array(*[r2(s) for s in strikes]).alias("strikes"),
                        F.lit(side).alias("debit_credit"), r2(mid).alias("mid_estimate"), r2(loss).alias("max_loss"), r2(gain).alias("max_gain"), F.array(r2(be)).alias("breakevens"),
                        r4(pop).alias("pop"), r4(ev).alias("ev"), r4(conf).alias("confidence"))

    debit = F.greatest(F.lit(0.25), mv * 0.35)
    pop1 = F.when(rich, spread_pop).otherwise(single_pop)
    ev1 = spread_pop * mv - (1 - spread_pop) * (mv * 0.35)
    put_credit, call_credit = F.greatest(F.lit(0.2), mv * 0.20), F.greatest(F.lit(0.2), mv * 0.18)
    long_ = F.array(
        plan(1, F.when(rich, "bull_call_spread").otherwise("long_call"), [px, px + mv], "debit", debit, debit, F.greatest(F.lit(0.5), mv), px + debit, pop1, ev1, c),
        plan(2, "cash_secured_put", [px * 0.97], "credit", put_credit, px * 0.97, put_credit, px * 0.97 - put_credit, clip(0.55 + c * 0.25, 0.05, 0.98), mv * 0.12, clip(c * 0.95, 0.01, 0.99)))
    short_ = F.array(
        plan(1, F.when(rich, "bear_put_spread").otherwise("long_put"), [px, F.greatest(F.lit(0.01), px - mv)], "debit", debit, debit, F.greatest(F.lit(0.5), mv), px - debit, pop1, ev1, c),
        plan(2, "bear_call_spread", [px * 1.02, px * 1.05], "credit", call_credit, F.greatest(F.lit(0.35), mv * 0.50), call_credit, px * 1.02 + call_credit, clip(0.55 + c * 0.22, 0.05, 0.98), mv * 0.08, clip(c * 0.93, 0.01, 0.99)))
    none = F.array(F.struct(F.lit(1).alias("rank"), F.lit("no_trade").alias("strategy_type"), dte.alias("expiry_dte"), F.array().cast("array<double>").alias("strikes"), F.lit("n/a").alias("debit_credit"),
                            F.lit(0.0).alias("mid_estimate"), F.lit(0.0).alias("max_loss"), F.lit(0.0).alias("max_gain"), F.array().cast("array<double>").alias("breakevens"), F.lit(0.0).alias("pop"), F.lit(0.0).alias("ev"), r4(c).alias("confidence")))
    plans = F.when(F.col("bias") == "LONG", long_).when(F.col("bias") == "SHORT", short_).otherwise(none)
    return df.select("symbol", "bias", F.inline(plans))


MOVES = (-0.05, -0.02, 0.0, 0.02, 0.05)


def scenario_table(df: DataFrame) -> DataFrame:
    """Estimated result in R for five underlying moves per set-up row."""
    s = F.when(F.col("bias") == "LONG", 1.0).when(F.col("bias") == "SHORT", -1.0).otherwise(0.0)
    m = df.select("symbol", "bias", F.explode(F.array(*[F.lit(x) for x in MOVES])).alias("underlying_move_pct"))
    pnl = F.when(s == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), s * F.col("underlying_move_pct") * 40.0))
    return m.withColumn("pnl_estimate_r", F.round(pnl, 4))
