"""Bars: canonical form, quality gate, resampling, as-of features, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import asof as A
from ..operators import bars as B
from ..operators import fundamentals as FU
from ..operators import macro as M
from ..operators import quality as Q
from ..operators import regime as R
from ..operators.series import blocked
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_technical import K, LAG, over, roll

POLICY = Q.QualityPolicy(outlier_return_threshold=0.20)


def raw_bars(spark, sf):
    """Daily bars in a vendor spelling, with some repeats and bad volumes."""
    b = src.bars_daily(spark, sf)
    n = F.substring("symbol", 2, 5).cast("int") + F.dayofyear("timestamp")
    base = b.select("symbol", F.col("timestamp").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                    F.col("close").alias("Close"), F.when(n % 97 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("Volume"),
                    F.when(n % 53 == 0, F.col("close") * 0.5).otherwise(F.col("close")).alias("Adj Close"),
                    F.when(n % 53 == 0, 2.0).when(n % 41 == 0, 0.0).alias("Stock Splits"), F.lit(0).cast("bigint").alias("seq"))
    again = base.filter(n % 89 == 0).withColumns({"seq": F.lit(1).cast("bigint"), "Close": F.col("Close") + 1.0})
    return base.unionByName(again)


RAW = {
    "rb": """SELECT symbol, ts, open, high, low, close, CASE WHEN n % 97 = 0 THEN -volume ELSE volume END AS volume,
        CASE WHEN n % 53 = 0 THEN close * 0.5 ELSE close END AS adj_close, CASE WHEN n % 53 = 0 THEN 2.0 ELSE 1.0 END AS split_factor, n, 0 AS seq
      FROM (SELECT *, CAST(symbol[2:] AS INTEGER) + dayofyear(ts) AS n FROM bars)""",
    "raw": "SELECT * EXCLUDE (n) FROM rb UNION ALL SELECT symbol, ts, open, high, low, close + 1.0, volume, adj_close, split_factor, 1 FROM rb WHERE n % 89 = 0",
}


@query("canonical_bars", "Q1 Q2 Q3 Q4 Q5 S4",
       f"""SELECT symbol, {ts('ts')}, {rds('volume split_factor')}, {rd('CASE WHEN abs(close) > 1e-12 THEN adj_close / close ELSE 1 END * open', 'open')},
         {rd('CASE WHEN abs(close) > 1e-12 THEN adj_close / close ELSE 1 END * close', 'close')}, 0.0::DOUBLE AS dividend, 'regular' AS session, CAST(seq AS BIGINT) AS seq FROM raw""", RAW)
def canonical_bars(spark, sf):
    out = B.adjust(B.canonicalize(raw_bars(spark, sf)))
    return present(out.select("symbol", "timestamp", "volume", "split_factor", "open", "close", "dividend", "session", "seq"))


@query("session_labels", "Q4 X3 V8",
       """SELECT session, in_hours, count(*) AS n FROM (
            SELECT CASE WHEN t < 34200 THEN 'pre' WHEN t <= 57600 THEN 'regular' WHEN t <= 72000 THEN 'after' ELSE 'closed' END AS session,
              isodow(l) <= 5 AND t BETWEEN 34200 AND 57600 AS in_hours
            FROM (SELECT l, hour(l) * 3600 + minute(l) * 60 + second(l) AS t FROM (SELECT ts - INTERVAL 5 HOUR AS l FROM events))) GROUP BY 1, 2""")
def session_labels(spark, sf):
    """January stamps, when New York is five hours behind UTC."""
    t = src.ticks(spark, sf).select(X.session_label("timestamp", True).alias("session"), X.market_hours("timestamp").alias("in_hours"))
    return present(t.groupBy("session", "in_hours").agg(F.count("*").alias("n")))


GATE = {
    **RAW,
    "q1": "SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY symbol, ts) AS copies, sum(CAST(volume < 0 AS INT)) OVER (PARTITION BY symbol, ts) AS neg FROM raw",
    "q2": "SELECT symbol, ts, close, greatest(volume, 0.0) AS volume, split_factor, copies, neg, 0 AS made FROM q1 WHERE rn = 1",
    "lim": "SELECT symbol, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM q2 GROUP BY 1",
    "cal": "SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS TIMESTAMP) AS ts FROM lim",
    "gone": "SELECT c.* FROM cal c ANTI JOIN q2 USING (symbol, ts) WHERE isodow(c.ts) <= 5",
    "made": "SELECT g.symbol, g.ts, q.close, 0.0 AS volume, 1.0 AS split_factor, 0 AS copies, 0 AS neg, 1 AS made FROM gone g ASOF JOIN q2 q ON g.symbol = q.symbol AND g.ts > q.ts",
    "q3": "SELECT * FROM q2 UNION ALL SELECT * FROM made",
    "q4": f"SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN close = lag(close) {LAG} THEN 0 ELSE 1 END AS chg FROM q3)",
    "q5": "SELECT *, count(*) OVER (PARTITION BY symbol, run) >= 3 AS stale FROM q4",
    "q6": f"SELECT *, abs(close / lag(close) {LAG} - 1) AS mv FROM q5 WHERE NOT stale",
    "q7": """SELECT *, coalesce(mv, 0) > 0.20 AND split_factor = 1 AS outl FROM q6
      UNION ALL SELECT *, NULL AS mv, false AS outl FROM q5 WHERE stale""",
}
GATE_POLICY = Q.QualityPolicy(outlier_return_threshold=0.20, stale_run_length=3)


def gate(spark, sf):
    return Q.gate_flags(B.canonicalize(raw_bars(spark, sf)), GATE_POLICY, order=["seq"], tz="UTC")


@query("quality_gate_rows", "Q6 Q7 Q8 Q10 Q11 Q12 Q14 N2 N4 J20",
       f"SELECT {K}, {rds('close volume')}, made = 1 AS is_synthetic FROM q7 WHERE NOT stale AND NOT outl", GATE)
def quality_gate_rows(spark, sf):
    return present(Q.gate_rows(gate(spark, sf)).select("symbol", "timestamp", "close", "volume", "is_synthetic"))


@query("quality_gate_report", "Q13 Q14 Q15 A17 S13",
       """SELECT symbol, CAST(sum(copies) AS BIGINT) AS rows_before, count(*) FILTER (NOT stale AND NOT outl) AS rows_after,
          CAST(sum(greatest(copies - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(neg) AS BIGINT) AS negative_volume, CAST(sum(made) AS BIGINT) AS missing, CAST(sum(made) AS BIGINT) AS repaired,
          count(*) FILTER (stale) AS stale, count(*) FILTER (outl) AS outliers, 400::BIGINT AS required_rows,
          count(*) FILTER (NOT stale AND NOT outl) >= 400 AS history_ok FROM q7 GROUP BY 1""", GATE)
def quality_gate_report(spark, sf):
    return present(Q.gate_report(gate(spark, sf), GATE_POLICY, 5))


DROP_POLICY = Q.QualityPolicy(missing_timestamp_policy="report", negative_volume_policy="drop", stale_price_policy="report", outlier_policy="report", outlier_return_threshold=0.20, stale_run_length=3)


@query("gate_report_drop_policy", "Q6 Q7 Q14 Q15",
       f"""SELECT t.symbol, t.rows_before, coalesce(k.rows_after, 0) AS rows_after, t.duplicates, t.negative_volume, coalesce(m.missing, 0) AS missing, 0::BIGINT AS repaired,
          coalesce(k.stale, 0) AS stale, coalesce(k.outliers, 0) AS outliers, 400::BIGINT AS required_rows, coalesce(k.rows_after, 0) >= 400 AS history_ok
          FROM (SELECT symbol, count(*) AS rows_before, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (volume < 0) AS negative_volume FROM raw GROUP BY 1) t
          LEFT JOIN (SELECT symbol, count(*) AS missing FROM dgone GROUP BY 1) m USING (symbol)
          LEFT JOIN (SELECT symbol, count(*) AS rows_after, count(*) FILTER (stale) AS stale, count(*) FILTER (coalesce(mv, 0) > 0.20 AND split_factor = 1) AS outliers FROM d4 GROUP BY 1) k USING (symbol)""",
       {**RAW,
        "d1": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) AS rn FROM raw) WHERE rn = 1 AND NOT coalesce(volume < 0, false)",
        "dlim": "SELECT symbol, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM d1 GROUP BY 1",
        "dcal": "SELECT symbol, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS TIMESTAMP) AS ts FROM dlim",
        "dgone": "SELECT c.* FROM dcal c ANTI JOIN d1 USING (symbol, ts) WHERE isodow(c.ts) <= 5",
        "d2": "SELECT *, CASE WHEN close = lag(close) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS chg, abs(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1) AS mv FROM d1",
        "d3": "SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM d2",
        "d4": "SELECT *, count(*) OVER (PARTITION BY symbol, run) >= 3 AS stale FROM d3"})
def gate_report_drop_policy(spark, sf):
    return present(Q.gate_report(Q.gate_flags(B.canonicalize(raw_bars(spark, sf)), DROP_POLICY, order=["seq"], tz="UTC"), DROP_POLICY, 5))


@query("missing_intraday_bars", "Q9",
       """SELECT symbol, strftime(p + to_microseconds(CAST(k * 900000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS timestamp FROM (
            SELECT symbol, p, unnest(generate_series(1, CAST(floor(gap / 900.0) AS BIGINT) - 1)) AS k FROM (
              SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p, date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS gap FROM (
                SELECT DISTINCT symbol, date_trunc('minute', ts) AS ts FROM ticks))
            WHERE gap > 900 * 1.5 AND CAST(p AS DATE) = CAST(ts AS DATE))""")
def missing_intraday_bars(spark, sf):
    t = src.ticks(spark, sf).select("symbol", F.date_trunc("minute", "timestamp").alias("timestamp"))
    return present(Q.missing_intraday(t, 900))


@query("missing_daily_bars", "Q8 N4", f"SELECT symbol, {ts('ts')} FROM gone", {**GATE})
def missing_daily_bars(spark, sf):
    return present(Q.missing_daily(B.canonicalize(raw_bars(spark, sf)), tz="UTC"))


@query("history_guard", "Q16 Q17 Q19",
       "SELECT symbol, count(*) AS rows FROM bars WHERE close IS NOT NULL AND volume > 30 GROUP BY 1 HAVING count(*) >= 200")
def history_guard(spark, sf):
    d = B.prepare_history(B.validate_market(src.bars_daily(spark, sf)).filter("volume > 30"), 200)
    return present(d.groupBy("symbol").agg(F.count("*").alias("rows")))


@query("asof_truncation", "Q18 S2",
       """SELECT symbol, '1998-03-01 00:00:00' AS requested, strftime(max(ts) FILTER (ts <= TIMESTAMP '1998-03-01'), '%Y-%m-%d %H:%M:%S') AS resolved,
          strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) AS rows_total, count(*) FILTER (ts <= TIMESTAMP '1998-03-01') AS rows_used,
          CASE WHEN max(ts) FILTER (ts <= TIMESTAMP '1998-03-01') < TIMESTAMP '1998-03-01' THEN 'moved_back' ELSE 'exact' END AS status FROM bars GROUP BY 1""")
def asof_truncation(spark, sf):
    return present(B.as_of_summary(src.bars_daily(spark, sf), "1998-03-01 00:00:00"))


def _resample_sql(bucket: str) -> str:
    return f"""SELECT symbol, {ts('b')}, {rd('arg_min(open, ts)', 'open')}, {rd('max(high)', 'high')}, {rd('min(low)', 'low')}, {rd('arg_max(close, ts)', 'close')},
      {rd('sum(volume)', 'volume')}, {rd('sum(dividend)', 'dividend')} FROM (SELECT *, {bucket} AS b FROM minute_bars) GROUP BY symbol, b"""


for _tf, _bucket in {"15m": "time_bucket(INTERVAL 15 MINUTE, ts)", "1h": "date_trunc('hour', ts)", "4h": "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01')",
                     "1d": "date_trunc('day', ts)", "1w": "date_trunc('week', ts) + INTERVAL 6 DAY"}.items():
    def _run(spark, sf, tf=_tf):
        return present(B.resample(src.minute_bars(spark, sf), tf, seq="event_id").select("symbol", "timestamp", "open", "high", "low", "close", "volume", "dividend"))

    query(f"resample_{_tf}", "A1 A2", _resample_sql(_bucket))(_run)


@query("resample_weekly_daily_bars", "A1",
       f"""SELECT symbol, {ts('b')}, {rd('arg_min(open, ts)', 'open')}, {rd('max(high)', 'high')}, {rd('min(low)', 'low')}, {rd('arg_max(close, ts)', 'close')},
         {rd('sum(volume)', 'volume')} FROM (SELECT *, date_trunc('week', ts) + INTERVAL 6 DAY AS b FROM bars) GROUP BY symbol, b""")
def resample_weekly_daily_bars(spark, sf):
    return present(B.resample(src.bars_daily(spark, sf), "1w"))


@query("average_dollar_volume", "A18",
       f"SELECT symbol, {rd('avg(close * volume)', 'avg_dollar_volume')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 63 GROUP BY 1")
def average_dollar_volume(spark, sf):
    return present(B.average_dollar_volume(src.bars_daily(spark, sf)))


@query("recent_activity", "A19",
       f"""SELECT symbol, {ts('max(ts)')}, {rd('max(close) FILTER (rn = 1)', 'price')}, {rd('avg(volume)', 'avg_volume_7d')},
         {rd('round((max(close) FILTER (rn = 1) / max(close) FILTER (rn = 2) - 1) * 100, 4)', 'change_pct_1d')}
         FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 7 GROUP BY 1""")
def recent_activity(spark, sf):
    return present(B.recent_activity(src.bars_daily(spark, sf)))


@query("asof_join_fundamentals", "J1 J2 J3",
       f"""SELECT b.symbol, {ts('b.ts')}, {rd('f.revenue', 'fund__revenue')}, {ts('f.filing_ts', 'fund__asof_timestamp')} FROM bars b
         ASOF LEFT JOIN funds f ON b.symbol = f.symbol AND b.ts >= f.filing_ts""")
def asof_join_fundamentals(spark, sf):
    j = A.asof_join(src.closes_daily(spark, sf), src.fundamentals(spark, sf), prefix="fund", right_time="filing_timestamp", columns=["revenue"])
    return present(j.select("symbol", "timestamp", "fund__revenue", "fund__asof_timestamp"))


@query("asof_join_tolerance", "J1",
       f"""SELECT symbol, {ts('ts')}, CASE WHEN ats + INTERVAL 20 DAY >= ts THEN ebit END AS fund__ebit, CASE WHEN ats + INTERVAL 20 DAY >= ts THEN {ts('ats', '').replace(' AS ', '')} END AS fund__asof_timestamp
         FROM (SELECT b.symbol, b.ts, {rd('f.ebit', 'ebit')}, f.filing_ts AS ats FROM bars b ASOF LEFT JOIN funds f ON b.symbol = f.symbol AND b.ts >= f.filing_ts)""")
def asof_join_tolerance(spark, sf):
    j = A.asof_join(src.closes_daily(spark, sf), src.fundamentals(spark, sf), prefix="fund", right_time="filing_timestamp", columns=["ebit"], tolerance="20 days")
    return present(j.select("symbol", "timestamp", "fund__ebit", "fund__asof_timestamp"))


@query("dataset_alignment", "J2 J3 Q20 S3",
       f"""SELECT b.symbol, {ts('b.ts')}, {rd('b.close', 'close')}, {rd('f.revenue', 'fund__revenue')}, {rd('m.vix', 'macro__vix')}, {ts('m.release_ts', 'macro__asof_timestamp')}
         FROM bars b ASOF LEFT JOIN funds f ON b.symbol = f.symbol AND b.ts >= f.filing_ts ASOF LEFT JOIN macro m ON b.ts >= m.release_ts""")
def dataset_alignment(spark, sf):
    j = A.align(src.closes_daily(spark, sf), src.fundamentals(spark, sf), src.macro(spark, sf), None)
    return present(j.select("symbol", "timestamp", "close", "fund__revenue", "macro__vix", "macro__asof_timestamp"))


@query("dataset_peek_check", "J3", "SELECT 0::BIGINT AS peeking_rows, count(*) AS rows FROM bars")
def dataset_peek_check(spark, sf):
    j = A.align(src.closes_daily(spark, sf), src.fundamentals(spark, sf), src.macro(spark, sf), None)
    bad = F.coalesce(F.col("fund__asof_timestamp") > F.col("timestamp"), F.lit(False)) | F.coalesce(F.col("macro__asof_timestamp") > F.col("timestamp"), F.lit(False))
    return present(j.agg(F.count_if(bad).alias("peeking_rows"), F.count("*").alias("rows")))


FLAG = "OVER (PARTITION BY symbol ORDER BY filing_ts)"
_pct = lambda c, n: f"CASE WHEN lag({c}, {n}) {FLAG} <> 0 THEN {c} / lag({c}, {n}) {FLAG} - 1 END"
FUND_COLS = "fund_revenue_growth_qoq fund_revenue_growth_yoy fund_margin_gross_level fund_margin_gross_trend fund_fcf_growth_qoq fund_fcf_growth_yoy fund_fcf_trend fund_debt_to_equity fund_interest_coverage fund_pe_ratio fund_ev_ebitda fund_fcf_yield".split()


@query("features_fundamentals", "F1 F2 F3 F4 F5 J5",
       f"""SELECT b.symbol, {ts('b.ts')}, {rds(FUND_COLS)}, {ts('f.filing_ts', 'fund_last_release_timestamp')},
         {rd("date_diff('second', f.filing_ts, b.ts) / 86400.0", 'fund_days_since_release')} FROM bars b ASOF LEFT JOIN rel f ON b.symbol = f.symbol AND b.ts >= f.filing_ts""",
       {"rel": f"""SELECT symbol, filing_ts, {_pct('revenue', 1)} AS fund_revenue_growth_qoq, {_pct('revenue', 4)} AS fund_revenue_growth_yoy,
           gross_margin AS fund_margin_gross_level, gross_margin - lag(gross_margin, 4) {FLAG} AS fund_margin_gross_trend,
           {_pct('free_cash_flow', 1)} AS fund_fcf_growth_qoq, {_pct('free_cash_flow', 4)} AS fund_fcf_growth_yoy,
           free_cash_flow - lag(free_cash_flow, 4) {FLAG} AS fund_fcf_trend, total_debt / (total_equity + 1e-9) AS fund_debt_to_equity,
           ebit / (abs(interest_expense) + 1e-9) AS fund_interest_coverage, market_cap / (net_income + 1e-9) AS fund_pe_ratio,
           enterprise_value / (ebitda + 1e-9) AS fund_ev_ebitda, free_cash_flow / (market_cap + 1e-9) AS fund_fcf_yield FROM funds"""})
def features_fundamentals(spark, sf):
    out = FU.with_fundamentals(src.closes_daily(spark, sf), src.fundamentals(spark, sf))
    return present(out.drop("close"))


@query("features_earnings", "F6 F7 F8 J7 J8",
       f"""SELECT symbol, {ts('ts')}, {ts('nxt', 'earnings_next_event_timestamp')}, {ts('lst', 'earnings_last_event_timestamp')},
         {rd('earnings_surprise', 'earnings_surprise')}, {rd('guidance_change_proxy', 'earnings_guidance_change_proxy')},
         {rd("date_diff('second', ts, nxt) / 86400.0", 'earnings_days_to_event')}, {rd('d', 'earnings_days_since_event')},
         {rd('coalesce(CAST(d BETWEEN 0 AND 5 AS INT), 0)', 'earnings_post_window_flag')}, {rd('coalesce(CAST(d BETWEEN 0 AND 1 AS INT), 0)', 'earnings_post_window_d1')},
         {rd('coalesce(CAST(d BETWEEN 0 AND 3 AS INT), 0)', 'earnings_post_window_d3')}, {rd('coalesce(CAST(d BETWEEN 0 AND 5 AS INT), 0)', 'earnings_post_window_d5')}
         FROM (SELECT *, date_diff('second', lst, ts) / 86400.0 AS d FROM j)""",
       {"nx": "SELECT b.symbol, b.ts, min(e.event_ts) AS nxt FROM bars b JOIN earn e ON b.symbol = e.symbol AND e.known_since <= b.ts AND b.ts < e.event_ts GROUP BY 1, 2",
        "j": """SELECT b.symbol, b.ts, nx.nxt, e.event_ts AS lst, e.earnings_surprise, e.guidance_change_proxy
           FROM bars b LEFT JOIN nx ON b.symbol = nx.symbol AND b.ts = nx.ts ASOF LEFT JOIN earn e ON b.symbol = e.symbol AND b.ts >= e.event_ts"""})
def features_earnings(spark, sf):
    return present(FU.with_earnings(src.closes_daily(spark, sf), src.earnings(spark, sf)).drop("close"))


MAC = {n: s for n, s in M.SERIES.items() if s != "jobs_proxy"}
MSQL = {
    "bm": "SELECT b.symbol, b.ts, b.close, " + ", ".join(f"m.{'yield_10y - m.yield_2y' if s == 'yield_slope_2s10s' else s} AS {n}" for n, s in MAC.items())
          + " FROM bars b ASOF LEFT JOIN macro m ON b.ts >= m.release_ts",
}
_z = lambda n, w, m: f"({n} - ({roll('avg', n, w, m)})) / (({roll('stddev_samp', n, w, m)}) + 1e-9)"
# months of constant values make the z-score denominator a rounding residue; compare it where the spread is real
_zc = lambda n, w, m: f"CASE WHEN ({roll('stddev_samp', n, w, m)}) > 1e-6 THEN {_z(n, w, m)} END"


@query("features_macro", "M1 M2 J6 N3",
       f"SELECT {K}, " + ", ".join(rd(n, n) + ", " + rd(f"{n} - lag({n}) {LAG}", f"{n}_diff1") + ", " + rd(_zc(n, 63, 21), f"{n}_z63") for n in MAC)
       + ", CASE WHEN (ts >= TIMESTAMP '1998-06-16 18:00:00' AND ts < TIMESTAMP '1998-06-17 04:00:00') OR (ts >= TIMESTAMP '1999-02-02 19:00:00' AND ts < TIMESTAMP '1999-02-03 05:00:00') THEN 1.0 ELSE 0.0 END::DOUBLE AS macro_fed_decision_flag FROM bm", MSQL)
def features_macro(spark, sf):
    df = M.with_macro_levels(src.closes_daily(spark, sf), src.macro(spark, sf))
    b = blocked(df, back=64)
    cols = M.stage(b, {"fed_decision_dates": ["1998-06-16", "1999-02-02"]})
    out = b.owned()
    out = out.withColumns({f"{n}_z63": F.when(F.col(f"_sd_{n}") > 1e-6, F.col(f"{n}_z63")) for n in MAC})
    return present(out.select("symbol", "timestamp", *cols))


@query("features_regime", "R1 R2 R3 R8",
       f"""SELECT {K}, {rds('regime_trend_flag regime_high_vol_flag')}, {rd('macro_vix_proxy', 'regime_vol_proxy')}, {rd('score', 'regime_risk_score')},
         {rd('CAST(score > 0 AS DOUBLE)', 'regime_risk_off_flag')}, {rd('regime_trend_flag + 2 * regime_high_vol_flag + 4 * coalesce(CAST(score > 0 AS DOUBLE), 0)', 'regime_state_code')} FROM (
           SELECT *, (cv * hc + dv * hd + rv2 * hr) / nullif(hc + hd + hr, 0) AS score FROM (
             SELECT *, CASE WHEN cz > 0 THEN 1.0 ELSE -1.0 END AS cv, CASE WHEN dz > 0 THEN 1.0 ELSE -1.0 END AS dv, CASE WHEN rz < 0 THEN 1.0 ELSE -1.0 END AS rv2,
               max(CAST(cz IS NOT NULL AS INT)) OVER (PARTITION BY symbol) AS hc, max(CAST(dz IS NOT NULL AS INT)) OVER (PARTITION BY symbol) AS hd,
               max(CAST(rz IS NOT NULL AS INT)) OVER (PARTITION BY symbol) AS hr,
               coalesce(CAST(abs(tr) >= 0.03 AND rv <= 0.35 AS DOUBLE), 0) AS regime_trend_flag, coalesce(CAST(macro_vix_proxy >= 25 AS DOUBLE), 0) AS regime_high_vol_flag FROM r2))""",
       {**MSQL, "r1": f"SELECT *, close / lag(close, 20) {LAG} - 1 AS tr, ln(close / (lag(close) {LAG} + 1e-9)) AS lr FROM bm",
        "r2": f"SELECT *, ({roll('stddev_samp', 'lr', 20)}) * sqrt(252.0) AS rv, round({_z('macro_credit_spread_proxy', 60, 20)}, 6) AS cz, round({_z('macro_dollar_strength_proxy', 60, 20)}, 6) AS dz, round({_z('macro_benchmark_rotation_proxy', 60, 20)}, 6) AS rz FROM r1"})
def features_regime(spark, sf):
    d = M.with_macro_levels(src.closes_daily(spark, sf), src.macro(spark, sf))
    return present(R.with_regime(d).select("symbol", "timestamp", *R.OUTPUT))


@query("report_regime", "R7",
       f"""SELECT symbol, {ts('ts')}, {rd('vol20', 'volatility_annualized_20')}, {rd('vol60', 'volatility_annualized_60')}, {rd('pct', 'volatility_percentile_1y')},
         CASE WHEN close > s50 AND s20 > s50 THEN 'trend_up' WHEN close < s50 AND s20 < s50 THEN 'trend_down' ELSE 'range_transition' END AS trend_regime,
         CASE WHEN pct >= 0.8 THEN 'high_volatility' WHEN pct <= 0.3 THEN 'calm_volatility' ELSE 'normal_volatility' END AS volatility_regime FROM (
           SELECT n.*, (SELECT count(*) FILTER (x.vol20 <= n.vol20) / count(*)::DOUBLE FROM v x WHERE x.symbol = n.symbol AND x.rn <= 252) AS pct FROM v n WHERE rn = 1)""",
       {"v0": f"SELECT *, close / lag(close) {LAG} - 1 AS r FROM bars",
        "v": f"SELECT *, ({roll('stddev_samp', 'r', 20)}) * sqrt(252.0) AS vol20, ({roll('stddev_samp', 'r', 60)}) * sqrt(252.0) AS vol60, {roll('avg', 'close', 20)} AS s20, {roll('avg', 'close', 50)} AS s50, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM v0"})
def report_regime(spark, sf):
    return present(R.report_regime(src.closes_daily(spark, sf)))


@query("market_snapshot_regime", "R5 C10",
       """SELECT CAST(d AS VARCHAR) AS day, CASE WHEN vix < 15 THEN 'low_vol' WHEN vix < 20 THEN 'normal' WHEN vix < 30 THEN 'elevated' ELSE 'crisis' END AS volatility,
          CASE WHEN price > prev THEN 'bullish' ELSE 'bearish' END AS direction FROM (
            SELECT b.ts::DATE AS d, b.close AS price, lag(b.close) OVER (ORDER BY b.ts) AS prev, m.vix FROM bench b ASOF JOIN macro m ON b.ts >= m.release_ts)""")
def market_snapshot_regime(spark, sf):
    """One market-wide series, so blocks of it are the unit of work."""
    b = src.benchmark_daily(spark, sf).withColumn("symbol", F.lit("MKT"))
    j = A.asof_join(b, src.macro(spark, sf), prefix="m", keys=(), right_time="release_timestamp", columns=["vix"]).filter("m__asof_timestamp is not null")
    k = blocked(j, back=1)
    k.stage({"_prev": F.lag("close").over(k.window)})
    d = k.owned().select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), R.snapshot_bucket("m__vix", "close", "_prev").alias("s"))
    return present(d.select("day", "s.volatility", "s.direction"))
