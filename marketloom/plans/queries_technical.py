"""Technical features over daily bars, and the flagship ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import technical as T
from ..operators.series import blocked, latest
from ..session import cut_lineage
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts

K = "symbol, " + ts("ts")


def over(w: int, prior: bool = False) -> str:
    span = f"{w} PRECEDING AND 1 PRECEDING" if prior else f"{w - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {span})"


def roll(agg: str, x: str, w: int, m: int | None = None, prior: bool = False) -> str:
    o = over(w, prior)
    return f"CASE WHEN count({x}) {o} >= {m or w} THEN {agg}({x}) {o} END"


LAG = "OVER (PARTITION BY symbol ORDER BY ts)"
TR = f"greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG}))"


def run_plugin(spark, sf, name, stage, prep=None):
    df = src.bars_daily(spark, sf)
    b = blocked(prep(df) if prep else df, back=T.PLUGIN_BACK[name]).indexed()
    cols = stage(b)
    return present(b.owned().select("symbol", "timestamp", *cols))


@query("indicator_ranking", "S4 W2 W7 W10 K1",
       f"""SELECT symbol, {ts('ts')}, {rds('close sma_w20 rsi_w14 atr_w14 ret_20')},
             rank() OVER (ORDER BY round(ret_20, 9) DESC NULLS LAST, symbol) AS ret_rank
           FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM g) WHERE rn = 1""",
       {"d": f"SELECT *, close - lag(close) {LAG} AS dl, {TR} AS tr, close / lag(close, 20) {LAG} - 1 AS ret_20 FROM bars",
        "e": "SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss FROM d",
        "g": f"""SELECT *, {roll('avg', 'close', 20)} AS sma_w20, {roll('avg', 'tr', 14)} AS atr_w14,
                 100 - 100 / (1 + {roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + 1e-9)) AS rsi_w14 FROM e"""})
def indicator_ranking(spark, sf):
    b = blocked(src.bars_daily(spark, sf), back=24).indexed()
    T.momentum(b)
    b.stage({"_tr": T.true_range(b)})
    b.stage({"sma_w20": T.full(b, F.col("close"), 20, F.avg), "atr_w14": T.full(b, F.col("_tr"), 14, F.avg),
             "ret_20": F.try_divide(F.col("close"), T.lag(b, "close", 20)) - 1.0})
    rows = b.owned().select("symbol", "timestamp", "close", "sma_w20", "rsi_w14", "atr_w14", "ret_20")
    last = latest(rows, ["symbol"], ["timestamp"])
    # one row per symbol is left, so the global ranking is over a reduced table
    w = Window.orderBy(F.round("ret_20", 9).desc_nulls_last(), "symbol")
    return present(last.withColumn("ret_rank", F.rank().over(w)))


@query("features_returns", "W1 C4",
       f"SELECT {K}, " + ", ".join(rd(f"close / lag(close, {h}) {LAG} - 1", f"ret_simple_h{h}") + ", " +
                                   rd(f"ln(close / (lag(close, {h}) {LAG} + 1e-9))", f"ret_log_h{h}") for h in (1, 3, 5, 10, 20)) + " FROM bars")
def features_returns(spark, sf):
    return run_plugin(spark, sf, "returns", T.returns)


_SMA = (10, 20, 50, 200)


@query("features_trend", "W2 W3 W5 W6",
       f"SELECT {K}, " + rds([f"sma_w{w}" for w in _SMA]) + ", " + ", ".join(rd(f"close / (sma_w{w} + 1e-9) - 1", f"close_vs_sma_w{w}") for w in _SMA)
       + ", " + ", ".join(rd(f"sma_w{a} / (sma_w{b} + 1e-9) - 1", f"sma_cross_{a}_{b}") + ", " +
                          rd(f"coalesce(CAST(sma_w{a} > sma_w{b} AS DOUBLE), 0)", f"sma_cross_flag_{a}_{b}") for a, b in zip(_SMA, _SMA[1:]))
       + ", " + rds("slope_close_w5 slope_close_w10 slope_close_w20 plus_di_w14 minus_di_w14") + ", "
       + rd(roll("avg", "dx", 14), "adx_w14") + ", " + rd(roll("avg", "dx", 14), "trend_strength_adx_w14") + ", "
       + rd("sign(plus_di_w14 - minus_di_w14)", "trend_direction_w14") + " FROM t4",
       {"t1": f"SELECT *, {TR} AS tr, high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS dn, CAST(row_number() {LAG} AS DOUBLE) AS ix FROM bars",
        "t2": "SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm FROM t1",
        "t2b": "SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS ndm FROM t2",
        "t3": "SELECT *, " + ", ".join(f"{roll('avg', 'close', w)} AS sma_w{w}" for w in _SMA) + ", " + ", ".join(
            f"CASE WHEN count(close) {over(w)} >= {w} THEN regr_slope(close, ix) {over(w)} END AS slope_close_w{w}" for w in (5, 10, 20))
            + f", 100 * {roll('avg', 'pdm', 14)} / ({roll('avg', 'tr', 14)} + 1e-9) AS plus_di_w14"
            + f", 100 * {roll('avg', 'ndm', 14)} / ({roll('avg', 'tr', 14)} + 1e-9) AS minus_di_w14 FROM t2b",
        "t4": "SELECT *, 100 * abs(plus_di_w14 - minus_di_w14) / (plus_di_w14 + minus_di_w14 + 1e-9) AS dx FROM t3"})
def features_trend(spark, sf):
    return run_plugin(spark, sf, "trend", T.trend)


def _recursive(cols: str, seed: str, step: str) -> str:
    """Body of a recursive CTE walking each symbol row by row."""
    return f"""SELECT symbol, ts, ix, close, {seed} FROM nb WHERE ix = 1
      UNION ALL SELECT n.symbol, n.ts, n.ix, n.close, {step} FROM em e JOIN nb n ON n.symbol = e.symbol AND n.ix = e.ix + 1"""


def ema_sql(body: str, seed: str, step: str, more: dict[str, str] | None = None) -> tuple[str, dict]:
    ctes = {"nb": f"SELECT *, row_number() {LAG} AS ix FROM bars",
            "em(symbol, ts, ix, close, e12, e26, sg)": _recursive("", seed, step), **(more or {})}
    return body, ctes


_A12, _A26, _A9 = "(2.0/13.0)::DOUBLE", "(2.0/27.0)::DOUBLE", "0.2::DOUBLE"
_S12 = f"n.close * {_A12} + (1 - {_A12}) * e.e12"
_S26 = f"n.close * {_A26} + (1 - {_A26}) * e.e26"
_EMA_SEED = "close, close, 0.0::DOUBLE"
_EMA_STEP = f"{_S12}, {_S26}, (({_S12}) - ({_S26})) * {_A9} + (1 - {_A9}) * e.sg"


@query("features_ema_macd", "W4 W8",
       f"SELECT {K}, " + rd("e12", "ema_w12") + ", " + rd("e26", "ema_w26") + ", " + rd("close / (e12 + 1e-9) - 1", "close_vs_ema_w12") + ", "
       + rd("close / (e26 + 1e-9) - 1", "close_vs_ema_w26") + ", " + rd("e12 / (e26 + 1e-9) - 1", "ema_cross_12_26") + ", "
       + rd("e12 - e26", "macd_12_26_9") + ", " + rd("sg", "macd_signal_12_26_9") + ", " + rd("e12 - e26 - sg", "macd_hist_12_26_9") + " FROM em",
       ema_sql("", _EMA_SEED, _EMA_STEP)[1])
def features_ema_macd(spark, sf):
    b = blocked(src.bars_daily(spark, sf), back=T.EMA_BACK).indexed()
    cols = T.trend_ema(b) + T.macd(b)
    return present(b.owned().select("symbol", "timestamp", *cols))


@query("features_momentum", "W7 W9",
       f"SELECT {K}, {rds('rsi_w14 stoch_k_w14')}, {rd(roll('avg', 'stoch_k_w14', 3), 'stoch_d_w14_s3')} FROM m3",
       {"m1": f"SELECT *, close - lag(close) {LAG} AS dl FROM bars",
        "m2": "SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss FROM m1",
        "m3": f"""SELECT *, 100 - 100 / (1 + {roll('avg', 'gain', 14)} / ({roll('avg', 'loss', 14)} + 1e-9)) AS rsi_w14,
           100 * (close - {roll('min', 'low', 14)}) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)} + 1e-9) AS stoch_k_w14 FROM m2"""})
def features_momentum(spark, sf):
    return run_plugin(spark, sf, "momentum", T.momentum)


_BM, _BS = roll("avg", "close", 20), roll("stddev_samp", "close", 20)


@query("features_volatility", "W10 W11 W12 W13",
       f"SELECT {K}, {rd('atr', 'atr_w14')}, {rd('atr / (close + 1e-9)', 'atr_pct_w14')}, "
       + ", ".join(rd(f"({roll('stddev_samp', 'lr', w)}) * sqrt(252.0)", f"rv_w{w}") for w in (5, 10, 20))
       + f", {rd('(4 * sd) / (mid + 1e-9)', 'boll_width_w20_k2')}, {rd('(close - (mid - 2 * sd)) / (4 * sd + 1e-9)', 'boll_pos_w20_k2')}, "
       + ", ".join(rd(f"sqrt(({roll('avg', 'hl2', w)}) * 252.0 / (4 * ln(2.0) + 1e-9))", f"parkinson_vol_w{w}") for w in (10, 20)) + " FROM v2",
       {"v1": f"SELECT *, {TR} AS tr, ln(close / (lag(close) {LAG} + 1e-9)) AS lr, pow(ln(high / (low + 1e-9)), 2) AS hl2 FROM bars",
        "v2": f"SELECT *, {roll('avg', 'tr', 14)} AS atr, {_BM} AS mid, {_BS} AS sd FROM v1"})
def features_volatility(spark, sf):
    return run_plugin(spark, sf, "volatility", T.volatility)


@query("features_volume", "W14 W15",
       f"SELECT {K}, {rd('obv', 'obv')}, "
       + ", ".join(rd(f"(volume - ({roll('avg', 'volume', w)})) / (({roll('stddev_samp', 'volume', w)}) + 1e-9)", f"vol_z_w{w}") for w in (10, 20, 50))
       + f", {rd('(' + roll('avg', 'volume', 5) + ') / ((' + roll('avg', 'volume', 20) + ') + 1e-9)', 'vol_trend_ratio_5_20')}, "
       + ", ".join(rd(f"CASE WHEN count(obv) {over(w)} >= {w} THEN regr_slope(obv, ix) {over(w)} END", f"obv_slope_w{w}") for w in (5, 20)) + " FROM o2",
       {"o1": f"SELECT *, coalesce(sign(close - lag(close) {LAG}), 0) * volume AS sv, CAST(row_number() {LAG} AS DOUBLE) AS ix FROM bars",
        "o2": "SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM o1"})
def features_volume(spark, sf):
    return run_plugin(spark, sf, "volume", T.volume, T.with_obv)


@query("features_structure", "W16",
       f"SELECT {K}, " + ", ".join(
           rd(f"close / (hi{w} + 1e-9) - 1", f"dist_to_high_w{w}") + ", " + rd(f"close / (lo{w} + 1e-9) - 1", f"dist_to_low_w{w}") + ", "
           + rd(f"(close - lo{w}) / (hi{w} - lo{w} + 1e-9)", f"range_pos_w{w}") + ", "
           + rd(f"coalesce(CAST(close > hi{w} AS DOUBLE), 0)", f"breakout_up_w{w}") + ", "
           + rd(f"coalesce(CAST(close < lo{w} AS DOUBLE), 0)", f"breakout_dn_w{w}") for w in (20, 50)) + " FROM s1",
       {"s1": "SELECT *, " + ", ".join(f"{roll('max', 'high', w, prior=True)} AS hi{w}, {roll('min', 'low', w, prior=True)} AS lo{w}" for w in (20, 50)) + " FROM bars"})
def features_structure(spark, sf):
    return run_plugin(spark, sf, "structure", T.structure)


def _prob(side: str, w: int) -> str:
    return roll("avg", f"{side}_hit", w, max(5, w // 2), prior=True)


@query("features_gaps", "W17 W18",
       f"SELECT {K}, {rds('gap_overnight gap_up_flag gap_dn_flag gap_fill_up_flag gap_fill_dn_flag')}, {rd('abs(gap_overnight)', 'gap_abs')}, "
       + rd(f"gap_overnight / (({roll('avg', 'tr', 14)}) / (close + 1e-9) + 1e-9)", "gap_atr_norm_w14") + ", "
       + ", ".join(rd(_prob("up", w), f"gap_fill_prob_up_w{w}") + ", " + rd(_prob("dn", w), f"gap_fill_prob_dn_w{w}") + ", "
                   + rd(f"CASE WHEN gap_overnight >= 0 THEN {_prob('up', w)} ELSE {_prob('dn', w)} END", f"gap_fill_prob_w{w}") for w in (10, 20)) + " FROM g3",
       {"g1": f"SELECT *, {TR} AS tr, lag(close) {LAG} AS pc, open / (lag(close) {LAG} + 1e-9) - 1 AS gap_overnight FROM bars",
        "g2": """SELECT *, coalesce(CAST(gap_overnight > 0 AS DOUBLE), 0) AS gap_up_flag, coalesce(CAST(gap_overnight < 0 AS DOUBLE), 0) AS gap_dn_flag,
            coalesce(CAST(gap_overnight > 0 AND low <= pc AS DOUBLE), 0) AS gap_fill_up_flag,
            coalesce(CAST(gap_overnight < 0 AND high >= pc AS DOUBLE), 0) AS gap_fill_dn_flag FROM g1""",
        "g3": "SELECT *, CASE WHEN gap_overnight > 0 THEN gap_fill_up_flag END AS up_hit, CASE WHEN gap_overnight < 0 THEN gap_fill_dn_flag END AS dn_hit FROM g2"})
def features_gaps(spark, sf):
    return run_plugin(spark, sf, "gaps", T.gaps)


def _corr(fn: str, side: str, w: int) -> str:
    return (f"CASE WHEN count(CASE WHEN ret_base_h1 IS NOT NULL AND {side}_ret_h1 IS NOT NULL THEN 1 END) {over(w)} >= {w} "
            f"THEN {fn}(ret_base_h1, {side}_ret_h1) {over(w)} END")


_H = (1, 5, 10, 20)


@query("features_relative_strength", "W19 W20 W21 J4",
       f"SELECT {K}, " + rds([f"{s}_h{h}" for h in _H for s in ("ret_base", "bench_ret", "sector_ret")]) + ", "
       + ", ".join(rd(f"ret_base_h{h} - {s}_ret_h{h}", f"rel_ret_vs_{s}_h{h}") for h in _H for s in ("bench", "sector")) + ", "
       + rds("corr_vs_bench_w20 corr_vs_bench_w60 corr_vs_sector_w20 corr_vs_sector_w60 beta_vs_bench_w60") + ", "
       + ", ".join(rd(f"CASE WHEN corr_vs_bench_w{w} > 0.6 THEN 1.0 WHEN corr_vs_bench_w{w} < 0.2 THEN -1.0 ELSE 0.0 END", f"corr_regime_vs_bench_w{w}") for w in (20, 60))
       + " FROM r3",
       {"r1": """SELECT b.*, n.close AS bc, x.close AS sc FROM (SELECT * FROM bars JOIN sectors USING (symbol)) b
            ASOF LEFT JOIN bench n ON b.ts >= n.ts ASOF LEFT JOIN sector_bars x ON b.sector = x.sector AND b.ts >= x.ts""",
        "r2": "SELECT *, " + ", ".join(f"close / lag(close, {h}) {LAG} - 1 AS ret_base_h{h}, bc / lag(bc, {h}) {LAG} - 1 AS bench_ret_h{h}, "
                                       f"sc / lag(sc, {h}) {LAG} - 1 AS sector_ret_h{h}" for h in _H) + " FROM r1",
        "r3": "SELECT *, " + ", ".join(f"{_corr('corr', s, w)} AS corr_vs_{s}_w{w}" for s in ("bench", "sector") for w in (20, 60))
              + f", ({_corr('covar_samp', 'bench', 60)}) / (({roll('var_samp', 'bench_ret_h1', 60)}) + 1e-9) AS beta_vs_bench_w60 FROM r2"})
def features_relative_strength(spark, sf):
    # benchmark, sectors and features read the same bars, which are stored once; the benchmark counts each bar once, with or without sectors
    sectors = src.sector_map(spark, sf).groupBy("symbol").agg(F.collect_list(F.struct("sector")).alias("sectors"))
    bars = cut_lineage(src.bars_daily(spark, sf).select("symbol", "timestamp", "close", "volume").join(sectors, "symbol", "left"))
    known = bars.select("symbol", "timestamp", "close", F.inline("sectors"))
    df = T.with_reference_close(known, src.benchmark_daily(spark, sf, bars), "bench", shared=True)
    df = T.with_reference_close(df, src.sector_daily(spark, sf, known), "sector", ("sector",), shared=True)
    b = blocked(df, back=T.PLUGIN_BACK["relative_strength"]).indexed()
    cols = T.relative_strength(b)
    return present(b.owned().select("symbol", "timestamp", *cols))


_SC = "volume close".split()


@query("feature_scaling", "W22",
       f"""SELECT {K}, {rd('(b.volume - s.vm) / s.vs', 'volume_std')}, {rd('(b.volume - s.vq[2]) / (s.vq[3] - s.vq[1])', 'volume_rob')},
          {rd('(b.close - s.cm) / s.cs', 'close_std')}, {rd('(b.close - s.cq[2]) / (s.cq[3] - s.cq[1])', 'close_rob')} FROM bars b, sc s""",
       {"sc": """SELECT avg(volume) AS vm, stddev_pop(volume) AS vs, quantile_cont(volume, [0.25, 0.5, 0.75]) AS vq,
              avg(close) AS cm, stddev_pop(close) AS cs, quantile_cont(close, [0.25, 0.5, 0.75]) AS cq FROM bars WHERE ts < TIMESTAMP '2000-01-01'"""})
def feature_scaling(spark, sf):
    """Both scalers fitted on the years before 2000, applied to every bar."""
    bars = src.bars_daily(spark, sf)
    train = bars.filter(F.col("timestamp") < F.lit("2000-01-01").cast("timestamp"))
    wide = bars.select("symbol", "timestamp", *[F.col(x).alias(f"{x}_{m}") for x in _SC for m in ("std", "rob")])
    tw = train.select(*[F.col(x).alias(f"{x}_{m}") for x in _SC for m in ("std", "rob")])
    for m, method in (("std", "standard"), ("rob", "robust")):
        names = [f"{x}_{m}" for x in _SC]
        wide = T.apply_scaler(wide, T.fit_scaler(tw, names, method), names)
    return present(wide)
