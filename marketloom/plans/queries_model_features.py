"""Model features and targets over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model_features as MF
from ..operators import regime as R
from ..operators.series import blocked
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_technical import K, LAG, TR, over, roll

_div = lambda a, b: f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END"
_g = lambda a: f"(2.0/({a}+1.0))::DOUBLE"
_r = {s: f"(1 - {_g(s)})" for s in (12, 26, 9)}
_n12, _n26 = f"n.close + {_r[12]} * e.n12", f"n.close + {_r[26]} * e.n26"
_ema = lambda num, s, ix: f"(({num}) / ((1 - pow({_r[s]}, {ix})) / (1 - {_r[s]})))"
_macd = f"({_ema(_n12, 12, 'n.ix')} - {_ema(_n26, 26, 'n.ix')})"
EM = {
    "nb": f"SELECT *, row_number() {LAG} AS ix FROM bars",
    "em(symbol, ts, ix, n12, n26, nsg)": f"""SELECT symbol, ts, ix, close, close, 0.0::DOUBLE FROM nb WHERE ix = 1
      UNION ALL SELECT n.symbol, n.ts, n.ix, {_n12}, {_n26}, {_macd} + {_r[9]} * e.nsg FROM em e JOIN nb n ON n.symbol = e.symbol AND n.ix = e.ix + 1""",
    "a1": f"""SELECT nb.*, {_ema('em.n12', 12, 'ix')} AS ema_12, {_ema('em.n26', 26, 'ix')} AS ema_26, {_ema('em.nsg', 9, 'ix')} AS macd_signal FROM nb JOIN em USING (symbol, ts, ix)""",
    "a2": f"""SELECT *, ema_12 - ema_26 AS macd, {TR} AS tr, close - lag(close) {LAG} AS dl, high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS dn, (high + low + close) / 3 AS tp,
        sign(close - lag(close) {LAG}) * volume AS sv, ((close - low) - (high - close)) / (high - low + 1e-8) * volume AS adv, """
        + ", ".join(f"close / lag(close, {h}) {LAG} - 1 AS return_{h}d" for h in (1, 5, 10, 20)) + ", "
        + ", ".join(f"close - lag(close, {h}) {LAG} AS momentum_{h}, (close - lag(close, {h}) {LAG}) / lag(close, {h}) {LAG} AS roc_{h}" for h in (5, 10, 20)) + ", "
        + ", ".join(f"{roll('avg', 'close', w)} AS sma_{w}" for w in (5, 10, 20, 50, 200)) + ", "
        + ", ".join(f"{roll('avg', 'volume', w)} AS vol_sma_{w}" for w in (5, 20, 50))
        + f", {roll('stddev_samp', 'close', 20)} AS sd20, {roll('min', 'low', 14)} AS lo14, {roll('max', 'high', 14)} AS hi14 FROM a1",
    "a3": f"""SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dl > 0 THEN dl ELSE 0 END AS gain, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS loss,
        sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv, sum(adv) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ad_line, macd - macd_signal AS macd_hist,
        """ + ", ".join(f"({roll('stddev_samp', 'return_1d', w)}) * sqrt(252.0) AS hvol_{w}" for w in (5, 10, 20, 50)) + f", {roll('avg', 'tr', 14)} AS atr_14 FROM a2",
    "a4": "SELECT *, CASE WHEN dn > pdm AND dn > 0 THEN dn ELSE 0 END AS ndm FROM a3",
    "a5": f"""SELECT *, {roll('avg', 'obv', 20)} AS obv_sma_20, ({roll('sum', 'close * volume', 20)}) / ({roll('sum', 'volume', 20)}) AS vwap_20,
        100 - 100 / (1 + ({roll('avg', 'gain', 14)}) / (({roll('avg', 'loss', 14)}) + 1e-8)) AS rsi_14, 100 * (close - lo14) / (hi14 - lo14 + 1e-8) AS stoch_k, -100 * (hi14 - close) / (hi14 - lo14 + 1e-8) AS williams_r,
        (tp - ({roll('avg', 'tp', 20)})) / (0.015 * ({roll('stddev_samp', 'tp', 20)})) AS cci, 100 * ({roll('avg', 'pdm', 14)}) / (atr_14 + 1e-8) AS plus_di, 100 * ({roll('avg', 'ndm', 14)}) / (atr_14 + 1e-8) AS minus_di,
        CAST(coalesce(macd > macd_signal AND lag(macd) {LAG} <= lag(macd_signal) {LAG}, false) AS BIGINT) AS macd_cross_up,
        sma_20 AS bb_middle, sma_20 + 2 * sd20 AS bb_upper, sma_20 - 2 * sd20 AS bb_lower FROM a4""",
    "a6": """SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-8) AS dx FROM a5""",
    "feat": f"""SELECT *, {roll('avg', 'dx', 14)} AS adx, {roll('avg', 'dx', 14)} AS trend_strength, {roll('avg', 'stoch_k', 3)} AS stoch_d,
        close / sma_5 AS price_sma5_ratio, close / sma_20 AS price_sma20_ratio, close / sma_50 AS price_sma50_ratio, close / sma_200 AS price_sma200_ratio,
        sma_5 / sma_20 AS sma5_sma20_ratio, sma_20 / sma_50 AS sma20_sma50_ratio, sma_50 / sma_200 AS sma50_sma200_ratio,
        (high - low) / close AS high_low_range, (close - low) / (high - low + 1e-8) AS close_position,
        hvol_5 / (hvol_20 + 1e-8) AS hvol_ratio_5_20, hvol_10 / (hvol_50 + 1e-8) AS hvol_ratio_10_50, atr_14 / close AS atr_percent, atr_14 * 2 / close AS kc_width,
        (bb_upper - bb_lower) / bb_middle AS bb_width, (close - bb_lower) / (bb_upper - bb_lower + 1e-8) AS bb_position,
        volume / (vol_sma_5 + 1) AS vol_ratio_5, volume / (vol_sma_20 + 1) AS vol_ratio_20, obv / (obv_sma_20 + 1e-8) AS obv_trend, close / (vwap_20 + 1e-8) AS price_vwap_ratio,
        CAST(coalesce(rsi_14 < 30, false) AS BIGINT) AS rsi_oversold, CAST(coalesce(rsi_14 > 70, false) AS BIGINT) AS rsi_overbought,
        CAST(CASE WHEN plus_di > minus_di THEN 1 ELSE -1 END AS BIGINT) AS trend_direction,
        isodow(ts) - 1 AS day_of_week, day(ts) AS day_of_month, month(ts) AS month, quarter(ts) AS quarter, week(ts) AS week_of_year,
        CAST(ts::DATE = last_day(ts) AS BIGINT) AS is_month_end, CAST(day(ts) = 1 AS BIGINT) AS is_month_start, dayofyear(ts) AS days_into_year FROM a6""",
}
INTS = "rsi_oversold rsi_overbought trend_direction day_of_week day_of_month month quarter week_of_year is_month_end is_month_start days_into_year macd_cross_up".split()
DBL = """return_1d return_5d return_10d return_20d sma_5 sma_10 sma_20 sma_50 sma_200 price_sma5_ratio price_sma20_ratio price_sma50_ratio price_sma200_ratio sma5_sma20_ratio
 sma20_sma50_ratio sma50_sma200_ratio ema_12 ema_26 momentum_5 momentum_10 momentum_20 roc_5 roc_10 roc_20 high_low_range close_position hvol_5 hvol_10 hvol_20 hvol_50
 hvol_ratio_5_20 hvol_ratio_10_50 atr_14 atr_percent bb_middle bb_upper bb_lower bb_width bb_position kc_width vol_sma_5 vol_sma_20 vol_sma_50 vol_ratio_5 vol_ratio_20 obv obv_sma_20
 vwap_20 price_vwap_ratio rsi_14 macd macd_signal macd_hist stoch_k stoch_d williams_r cci adx plus_di minus_di trend_strength""".split()


@query("model_features", "E1 E2 E3 E4 E5 E6 E10 Q19",
       f"SELECT {K}, {rds(DBL)}, {rd('ad_line', 'ad_line', 3)}, {rd('obv_trend', 'obv_trend', 4)}, " + ", ".join(f"CAST({i} AS BIGINT) AS {i}" for i in INTS) + " FROM feat WHERE sma_200 IS NOT NULL", EM)
def model_features(spark, sf):
    d = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    d = d.drop("open", "high", "low", "close", "volume")
    d = d.withColumns({"ad_line": F.round("ad_line", 3), "obv_trend": F.round("obv_trend", 4)})
    return present(d)


AHEAD = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
ONE = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)"


@query("model_targets", "E7 E8 E9",
       f"""SELECT {K}, {rd('tr', 'target_return')}, CAST(coalesce(tr > 0, false) AS BIGINT) AS target_direction,
         {rd('CASE WHEN tr <= -0.05 THEN 0 WHEN tr <= -0.02 THEN 1 WHEN tr <= 0.02 THEN 2 WHEN tr <= 0.05 THEN 3 WHEN tr IS NOT NULL THEN 4 END', 'target_magnitude')},
         {rd(f'CASE WHEN count(r1) {AHEAD} >= 5 THEN stddev_samp(r1) {AHEAD} * sqrt(252.0) END', 'target_volatility')},
         {rd(f'CASE WHEN nx IS NOT NULL AND count(close) {ONE} >= 5 THEN max(close) {ONE} / close - 1 END', 'target_max_gain')},
         {rd(f'CASE WHEN nx IS NOT NULL AND count(close) {ONE} >= 5 THEN min(close) {ONE} / close - 1 END', 'target_max_loss')}
         FROM (SELECT *, lead(close, 5) {LAG} / close - 1 AS tr, close / lag(close) {LAG} - 1 AS r1, lead(close) {LAG} AS nx FROM bars)""")
def model_targets(spark, sf):
    b = blocked(src.closes_daily(spark, sf), back=4, ahead=6)
    cols = MF.stage_targets(b, 5)
    return present(b.owned().select("symbol", "timestamp", *cols))


@query("feature_snapshot", "E11 E12", None)
def feature_snapshot(spark, sf):
    d = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    feats = MF.feature_names(d.columns)
    s = MF.snapshot(d, feats)
    return present(s.select("symbol", "timestamp", F.size("features").alias("n_features"), F.transform("top_features", lambda e: e["name"]).alias("top")))


@query("inspector_regime", "R6",
       f"""SELECT {K}, trend, volatility, momentum, lower(trend || '_' || volatility || '_' || momentum) AS label FROM (
         SELECT symbol, ts, CASE WHEN CAST(price_sma20_ratio > 1 AS INT) + CAST(price_sma50_ratio > 1 AS INT) + CAST(price_sma200_ratio > 1 AS INT) >= 2 THEN 'BULLISH' ELSE 'BEARISH' END AS trend,
           CASE WHEN hvol_20 >= 0.40 THEN 'HIGH' WHEN hvol_20 <= 0.18 THEN 'LOW' ELSE 'NORMAL' END AS volatility, CASE WHEN roc_5 >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS momentum
         FROM feat WHERE sma_200 IS NOT NULL)""", EM)
def inspector_regime(spark, sf):
    d = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    return present(R.inspector_regime(d).select("symbol", "timestamp", "trend", "volatility", "momentum", "label"))
