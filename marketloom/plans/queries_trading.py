"""Backtest, risk, scan, options, pattern and journal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as BT
from ..operators import journal as J
from ..operators import model_features as MF
from ..operators import patterns as P
from ..operators import quality as Q
from ..operators import regime as R
from ..operators import risk as RK
from ..operators import scan as SC
from ..operators.series import DAY, Layout, blocked, lag, latest
from ..session import cut_lineage
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_metrics import RETS, signal_returns
from .queries_model_features import EM
from .queries_technical import K, LAG, over, roll

# ---- trades -----------------------------------------------------------------------


@query("trade_stats", "A3",
       f"""SELECT strategy, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades, {rd('avg(pnl)', 'avg_pnl')}, {rd('avg(pnl) FILTER (pnl > 0)', 'avg_win')},
         {rd('avg(pnl) FILTER (pnl <= 0)', 'avg_loss')}, {rd('sum(pnl)', 'total_pnl', 2)}, {rd('max(pnl)', 'best_trade')}, {rd('min(pnl)', 'worst_trade')}, {rd('count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100', 'win_rate')},
         {rd('abs(avg(pnl) FILTER (pnl > 0) / avg(pnl) FILTER (pnl <= 0))', 'profit_factor')} FROM trades GROUP BY 1""")
def trade_stats(spark, sf):
    return present(J.trade_stats(src.trades(spark, sf), ["strategy"]).withColumn("total_pnl", F.round("total_pnl", 2)))


@query("trade_attribution", "A4 B9",
       f"SELECT strategy, regime, count(pnl) AS trades, {rd('sum(pnl)', 'pnl', 2)}, {rd('avg(CAST(pnl > 0 AS INT))', 'win_rate')}, {rd('avg(pnl / notional)', 'avg_return')} FROM trades GROUP BY 1, 2")
def trade_attribution(spark, sf):
    t = src.trades(spark, sf).withColumn("return", F.col("pnl") / F.col("notional"))
    return present(BT.attribution(t, ["strategy", "regime"]).withColumn("pnl", F.round("pnl", 2)))


@query("trade_pnl_histogram", "B11",
       """SELECT CAST(least(floor((pnl - lo) / ((hi - lo) / n)), n - 1) AS BIGINT) AS bin, count(*) AS count FROM trades, (SELECT min(pnl) AS lo, max(pnl) AS hi, least(greatest(floor(sqrt(count(*))), 8), 30) AS n FROM trades) GROUP BY 1""")
def trade_pnl_histogram(spark, sf):
    return present(BT.pnl_histogram(src.trades(spark, sf)).select(F.col("bin").cast("bigint").alias("bin"), "count"))


@query("trade_close", "B10 DB04 X4",
       f"SELECT l_orderkey, l_linenumber, {rd('pnl - notional * 0.0001', 'pnl')}, {rd('(pnl - notional * 0.0001) / notional', 'return')} FROM trades", None)
def trade_close(spark, sf):
    t = src.trades(spark, sf).select("l_orderkey", "l_linenumber", F.col("pnl").alias("realized_pnl"), (F.col("notional") * 0.0001).alias("costs"), F.col("notional").alias("entry_price"), F.lit(1.0).alias("entry_qty"), F.lit(3).alias("bars_held"))
    return present(BT.close_trades(t).select("l_orderkey", "l_linenumber", "pnl", "return"))


@query("trade_lessons", "T15", f"SELECT l_orderkey AS trade_id, category, {rd('importance', 'importance')}, content FROM (SELECT l_orderkey, unnest([{{'category': CASE WHEN pnl > 0 THEN 'success_pattern' ELSE 'mistake_pattern' END, 'importance': CASE WHEN pnl > 0 THEN least(0.8, 0.5 + abs(pc) / 100) ELSE least(0.9, 0.5 + abs(pc) / 50) END::DOUBLE, 'content': CASE WHEN pnl > 0 THEN strategy || ' on ' || symbol || ' was profitable (' || printf('%.1f', pc) || '%). Thesis: . Lessons: ' ELSE strategy || ' on ' || symbol || ' lost (' || printf('%.1f', pc) || '%). Thesis: . What went wrong: ' END}}, {{'category': 'strategy_performance', 'importance': CASE WHEN pnl > 0 THEN 0.6 ELSE 0.7 END::DOUBLE, 'content': strategy || ' strategy: ' || CASE WHEN pnl > 0 THEN 'WIN' ELSE 'LOSS' END || ' on ' || symbol || ' (' || printf('%.1f', pc) || '%)'}}], recursive := true) FROM (SELECT *, round(pnl / notional * 100, 3) + 0.0001 AS pc FROM trades))")
def trade_lessons(spark, sf):
    return present(J.trade_lessons(lesson_trades(spark, sf)).select("trade_id", "category", "importance", "content"))


def lesson_trades(spark, sf):
    t = src.trades(spark, sf)
    return t.select(F.col("l_orderkey").alias("id"), "symbol", "strategy", "pnl", (F.round(F.col("pnl") / F.col("notional") * 100.0, 3) + 0.0001).alias("pnl_percent"), F.lit(None).cast("string").alias("thesis"), F.lit(None).cast("string").alias("lessons"))


@query("strategy_rankings", "A13",
       f"SELECT strategy, wins, losses, wins + losses AS total_trades, {rd('wins / (wins + losses)::DOUBLE * 100', 'win_rate')} FROM (SELECT strategy, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses FROM trades GROUP BY 1)")
def strategy_rankings(spark, sf):
    mem = J.trade_lessons(lesson_trades(spark, sf))
    r = J.strategy_rankings(mem)
    return present(r.withColumn("strategy", F.trim(F.regexp_replace("strategy", "strategy$", ""))))


@query("memory_category_counts", "A14 DB10",
       "SELECT 'success_pattern' AS category, count(*) FILTER (pnl > 0) AS count FROM trades UNION ALL SELECT 'mistake_pattern', count(*) FILTER (pnl <= 0) FROM trades UNION ALL SELECT 'strategy_performance', count(*) FROM trades UNION ALL SELECT 'risk_tolerance', 0")
def memory_category_counts(spark, sf):
    return present(J.category_counts(J.trade_lessons(lesson_trades(spark, sf)), ["success_pattern", "mistake_pattern", "strategy_performance", "risk_tolerance"]))


# ---- signals and exposures ---------------------------------------------------------

@query("signals_on_bars", "J9 B1 Y2",
       f"""SELECT b.symbol, {ts('b.ts')}, {rd('s.p', 'prediction')}, {rd('CASE WHEN s.p >= 0.6 THEN greatest(least(abs(2 * s.p - 1), 1.0), 0.1) WHEN s.p <= 0.4 THEN -greatest(least(abs(2 * s.p - 1), 1.0), 0.1) END', 'target_exposure')},
         CASE WHEN s.p >= 0.6 THEN 'buy' WHEN s.p <= 0.4 THEN 'sell' ELSE 'hold' END AS action FROM bars b ASOF LEFT JOIN pp s ON b.symbol = s.symbol AND b.ts >= s.ts""", {k: RETS[k] for k in ("rr", "pp")})
def signals_on_bars(spark, sf):
    s = signal_returns(spark, sf).select("symbol", "timestamp", F.col("probability").alias("prediction"), F.abs(2.0 * F.col("probability") - 1.0).alias("confidence"), F.lit(None).cast("string").alias("regime"))
    return present(BT.decide(BT.merge_signals(src.closes_daily(spark, sf), s)).select("symbol", "timestamp", "prediction", "target_exposure", "action"))


@query("exposure_to_quantity", "B12",
       f"SELECT {K}, {rd('CASE WHEN abs((p - 0.5) * 2 * 100000 / nxt_close - 10) >= 1e-9 THEN (p - 0.5) * 2 * 100000 / nxt_close - 10 END', 'delta_qty', 4)} FROM (SELECT pp.*, b.close AS nxt_close FROM pp JOIN bars b USING (symbol, ts))", {k: RETS[k] for k in ("rr", "pp")})
def exposure_to_quantity(spark, sf):
    d = signal_returns(spark, sf).join(src.closes_daily(spark, sf), ["symbol", "timestamp"])
    d = d.withColumn("e", (F.col("probability") - 0.5) * 2.0)
    return present(d.select("symbol", "timestamp", F.round(BT.order_quantity("e", F.lit(100000.0), "close", F.lit(10.0)), 4).alias("delta_qty")))


EX = BT.Execution(commission_bps=1.0, commission_per_share=0.01, commission_min=1.0, spread_bps=2.0, slippage_bps=3.0, volume_participation=0.5)


def proposals(spark, sf):
    """One market or limit order per bar."""
    b = src.bars_daily(spark, sf)
    n = F.substring("symbol", 2, 5).cast("int") + F.dayofyear("timestamp")
    side = F.when(n % 2 == 0, 1.0).otherwise(-1.0)
    return b.select("symbol", "timestamp", (side * (10.0 + n % 40)).alias("requested_qty"), F.when(n % 3 == 0, "limit").otherwise("market").alias("order_type"), F.when(n % 3 == 0, F.col("close") * (1.0 + side * 0.001)).alias("limit_price"))


@query("order_fills", "B2 B3",
       f"""SELECT symbol, {ts('ts')}, {rds('filled_qty fill_price reference_price')}, {rd('CASE WHEN c > 0 THEN greatest(c, 1.0) ELSE c END', 'commission')}, {rd('abs(filled_qty * (fill_price - reference_price))', 'slippage_cost')}, {rd('s / abs(q)', 'fill_ratio')} FROM (
         SELECT *, side * s AS filled_qty, ref0 AS reference_price, ref0 * (1 + side * 0.0004) AS fill_price, abs(s * ref0 * (1 + side * 0.0004)) * 0.0001 + s * 0.01 AS c FROM (
           SELECT *, CASE WHEN ref IS NOT NULL AND least(abs(q), CASE WHEN xv > 0 THEN xv * 0.5 ELSE abs(q) END) > 1e-12 THEN least(abs(q), CASE WHEN xv > 0 THEN xv * 0.5 ELSE abs(q) END) END AS s, ref AS ref0 FROM (
             SELECT *, CASE WHEN lim IS NULL THEN xo WHEN side > 0 AND xl <= lim THEN least(lim, xo) WHEN side < 0 AND xh >= lim THEN greatest(lim, xo) END AS ref FROM (
               SELECT symbol, ts, xo, xh, xl, xv, side, side * (10.0 + n % 40) AS q, CASE WHEN n % 3 = 0 THEN close * (1 + side * 0.001) END AS lim FROM (
                 SELECT *, CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS side FROM (
                   SELECT *, CAST(symbol[2:] AS INTEGER) + dayofyear(ts) AS n, lead(open) {LAG} AS xo, lead(high) {LAG} AS xh, lead(low) {LAG} AS xl, lead(volume) {LAG} AS xv FROM bars)
                 WHERE xo IS NOT NULL)))))""")
def order_fills(spark, sf):
    o = BT.with_execution_bar(proposals(spark, sf), src.bars_daily(spark, sf))
    d = BT.fill_orders(o, EX)
    d = d.withColumn("reference_price", F.col("reference_price"))
    return present(d.select("symbol", "timestamp", "filled_qty", "fill_price", "reference_price", "commission", "slippage_cost", "fill_ratio"))


def entries(b):
    up = F.month("timestamp") % 2 == 0
    s = F.when(up, 1.0).otherwise(-1.0)
    return b.select("symbol", "timestamp", up.alias("is_long"), (F.col("close") * (1.0 - s * 0.06)).alias("stop_price"), (F.col("close") * (1.0 + s * 0.09)).alias("take_price"))


EXITS = {
    "eb": f"SELECT *, row_number() {LAG} AS ix FROM bars",
    "en": "SELECT symbol, ts, ix, month(ts) % 2 = 0 AS is_long, close * (1 - CASE WHEN month(ts) % 2 = 0 THEN 0.06 ELSE -0.06 END) AS stop, close * (1 + CASE WHEN month(ts) % 2 = 0 THEN 0.09 ELSE -0.09 END) AS take FROM eb",
    "hits": """SELECT e.symbol, e.ts, min(b.ix) AS hit FROM en e JOIN eb b ON b.symbol = e.symbol AND b.ix > e.ix AND CASE WHEN e.is_long THEN b.low <= e.stop OR b.high >= e.take ELSE b.high >= e.stop OR b.low <= e.take END GROUP BY 1, 2""",
}


@query("first_exits", "B4 B5",
       f"""SELECT symbol, {ts('ts')}, {ts('xt', 'exit_timestamp')}, CASE WHEN sp IS NOT NULL THEN 'stop_loss' WHEN tp IS NOT NULL THEN 'take_profit' END AS exit_reason, {rd('coalesce(sp, tp)', 'exit_price')}, bars_held FROM (
         SELECT e.symbol, e.ts, b.ts AS xt, h.hit - e.ix AS bars_held, CASE WHEN e.is_long THEN CASE WHEN b.open <= e.stop THEN b.open WHEN b.low <= e.stop THEN e.stop END ELSE CASE WHEN b.open >= e.stop THEN b.open WHEN b.high >= e.stop THEN e.stop END END AS sp,
           CASE WHEN e.is_long THEN CASE WHEN b.open >= e.take THEN b.open WHEN b.high >= e.take THEN e.take END ELSE CASE WHEN b.open <= e.take THEN b.open WHEN b.low <= e.take THEN e.take END END AS tp
         FROM en e LEFT JOIN hits h ON h.symbol = e.symbol AND h.ts = e.ts LEFT JOIN eb b ON b.symbol = e.symbol AND b.ix = h.hit)""", EXITS)
def first_exits(spark, sf):
    b = cut_lineage(src.bars_daily(spark, sf))  # read by the entries and by the ladder
    d = BT.first_exit(entries(b), b)
    return present(d.select("symbol", "timestamp", "exit_timestamp", "exit_reason", "exit_price", "bars_held"))


def equity_rows(spark, sf):
    """Running pnl of each supplier's trades as an equity series."""
    from ..operators.series import running

    d = src.trades(spark, sf).groupBy("symbol", "timestamp").agg(F.sum("pnl").alias("day_pnl"))
    return running(d, {"cum": (F.col("day_pnl"), "sum")}).withColumn("equity", F.round(1_000_000.0 + F.col("cum"), 4))


EQ = {
    "e0": "SELECT symbol, ts, sum(pnl) AS day_pnl FROM trades GROUP BY 1, 2",
    "e1": "SELECT *, round(1000000.0 + sum(day_pnl) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS equity FROM e0",
    "e2": f"SELECT *, coalesce(equity / lag(equity) {LAG} - 1, 0) AS equity_return, max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM e1",
}


@query("equity_drawdown", "B7 DB02", f"SELECT {K}, {rd('equity', 'equity')}, {rds('equity_return')}, {rd('equity / peak - 1', 'drawdown')} FROM e2", EQ)
def equity_drawdown(spark, sf):
    d = BT.equity_curve(equity_rows(spark, sf))
    return present(d.select("symbol", "timestamp", "equity", "equity_return", "drawdown"))


@query("backtest_metrics", "B8",
       f"""SELECT e.symbol, {rd('f0', 'initial_equity')}, {rd('f1', 'final_equity')}, {rd('f1 / f0 - 1', 'total_return')}, {rd('pow(f1 / f0, 252.0 / n) - 1', 'cagr')}, {rd('mu / sd * sqrt(252.0)', 'sharpe')}, {rd('mu / dsd * sqrt(252.0)', 'sortino')}, {rd('dd', 'max_drawdown')},
         {rd('tn / ae', 'turnover')}, {rd('tc', 'trade_count')}, {rd('wr', 'win_rate')}, {rd('gw / gl', 'profit_factor')}, {rd('aw', 'average_win', 4)}, {rd('al', 'average_loss', 4)}, {rd('f1 - f0', 'net_pnl')} FROM (
         SELECT symbol, arg_min(equity, ts) AS f0, arg_max(equity, ts) AS f1, count(*) AS n, avg(equity_return) AS mu, stddev_pop(equity_return) AS sd, stddev_pop(equity_return) FILTER (equity_return < 0) AS dsd, abs(min(equity / peak - 1)) AS dd, avg(equity) AS ae FROM e2 GROUP BY 1) e
         JOIN (SELECT symbol, count(*)::DOUBLE AS tc, avg(CAST(pnl > 0 AS INT)) AS wr, sum(pnl) FILTER (pnl > 0) AS gw, abs(sum(pnl) FILTER (pnl < 0)) AS gl, avg(pnl) FILTER (pnl > 0) AS aw, avg(pnl) FILTER (pnl < 0) AS al, sum(notional) AS tn FROM trades GROUP BY 1) t USING (symbol)""", EQ)
def backtest_metrics(spark, sf):
    e = BT.equity_curve(equity_rows(spark, sf)).withColumn("exposure", F.lit(0.0))
    t = src.trades(spark, sf).withColumns({"commission": F.lit(0.0), "slippage": F.lit(0.0)})
    d = BT.backtest_metrics(e, t, ["symbol"])
    d = d.withColumns({c: F.round(c, 4) for c in ("average_win", "average_loss")})
    return present(d.drop("exposure", "commission_total", "slippage_total", "cost_total", "gross_pnl"))


@query("drawdown_kill_switch", "P1",
       f"SELECT symbol AS account, {ts('ts')}, {rd('1 - equity / peak', 'drawdown')}, max(CAST(1 - equity / peak >= 0.01 AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) = 1 AS kill_switch FROM e2", EQ)
def drawdown_kill_switch(spark, sf):
    d = RK.drawdown_latch(equity_rows(spark, sf).withColumnRenamed("symbol", "account"), 0.01)
    return present(d.select("account", "timestamp", "drawdown", "kill_switch"))


# ---- risk ----------------------------------------------------------------------------

def holdings(spark, sf):
    """Accounts are customers modulo 50, their symbols the ordered suppliers."""
    o = src.load(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).cast("string").alias("account"))
    li = src.load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    g = j.groupBy("account", (F.col("l_suppkey") % 40).alias("k")).agg(F.sum(signed).alias("qty"))
    return g.select("account", src.symbol_of(F.col("k")).alias("symbol"), "qty", (50.0 + F.col("k")).alias("price"), F.concat(F.lit("sec"), (F.col("k") % 6).cast("string")).alias("sector"))


def account_equity(spark, sf):
    h = holdings(spark, sf)
    return h.groupBy("account").agg((F.sum(F.abs(F.col("qty") * F.col("price"))) * 1.1).alias("equity"))


HO = {
    "hg": "SELECT CAST(o_custkey % 50 AS VARCHAR) AS account, l_suppkey % 40 AS k, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "ho": "SELECT account, printf('S%05d', k) AS symbol, k, qty, 50.0 + k AS price, qty * (50.0 + k) AS v, 'sec' || CAST(k % 6 AS VARCHAR) AS sector FROM hg",
    "he": "SELECT account, sum(abs(v)) * 1.1 AS equity FROM ho GROUP BY 1",
}


@query("account_exposures", "A16 P10", f"SELECT account, {rd('sum(abs(v)) / any_value(equity)', 'gross_exposure_pct')}, {rd('sum(v) / any_value(equity)', 'net_exposure_pct')} FROM ho JOIN he USING (account) GROUP BY 1", HO)
def account_exposures(spark, sf):
    return present(RK.exposures(RK.normalize_holdings(holdings(spark, sf).withColumnRenamed("qty", "quantity")), account_equity(spark, sf)))


@query("sector_exposures", "A16", f"SELECT account, sector, {rd('sum(abs(v)) / any_value(equity)', 'sector_exposure_pct')} FROM ho JOIN he USING (account) GROUP BY 1, 2", HO)
def sector_exposures(spark, sf):
    return present(RK.sector_exposures(RK.normalize_holdings(holdings(spark, sf)), account_equity(spark, sf)))


def correlations(spark, sf, n: int = 40):
    """Long correlation table of the yearly closes of held symbols."""
    b = src.bars_daily(spark, sf)
    m = b.groupBy((F.substring("symbol", 2, 5).cast("int") % n).alias("k"), F.date_trunc("quarter", "timestamp").alias("q")).agg(F.avg("close").alias("c"))
    a, c = m.alias("a"), m.alias("c")
    j = a.join(c, F.col("a.q") == F.col("c.q")).groupBy(F.col("a.k").alias("ka"), F.col("c.k").alias("kc")).agg(F.corr("a.c", "c.c").alias("corr"))
    return j.select(src.symbol_of(F.col("ka")).alias("sym_a"), src.symbol_of(F.col("kc")).alias("sym_b"), F.round("corr", 6).alias("corr"))


@query("correlated_exposure", "J22",
       f"""SELECT h.account, h.symbol, {rd('sum(abs(p.v))', 'corr_base', 3)} FROM ho h JOIN co ON co.ka = h.k AND co.ka <> co.kc AND abs(co.corr) >= 0.4 JOIN ho p ON p.account = h.account AND p.k = co.kc GROUP BY 1, 2""",
       {**HO, "mm": "SELECT CAST(symbol[2:] AS INTEGER) % 40 AS k, date_trunc('quarter', ts) AS q, avg(close) AS c FROM bars GROUP BY 1, 2",
        "co": "SELECT a.k AS ka, c.k AS kc, round(corr(a.c, c.c), 6) AS corr FROM mm a JOIN mm c ON a.q = c.q GROUP BY 1, 2"})
def correlated_exposure(spark, sf):
    h = RK.normalize_holdings(holdings(spark, sf))
    v = h.withColumn("value", F.col("qty") * F.col("price"))
    d = RK.correlated_values(h.select("account", "symbol"), v, correlations(spark, sf), 0.4)
    return present(d.withColumn("corr_base", F.round("corr_base", 3)))


def order_book(spark, sf):
    o = src.load(spark, sf, "orders")
    k = F.col("o_orderkey") % 40
    return o.select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 50).cast("string").alias("account"), src.symbol_of(k).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("qty"), (50.0 + k).alias("price"),
        F.when(F.col("o_orderkey") % 4 == 0, 1.0 + k / 10.0).alias("atr"), F.when(F.col("o_orderkey") % 4 == 1, 0.02).alias("realized_vol"), F.lit(None).cast("double").alias("stop_price"),
        F.when(F.col("o_orderkey") % 7 == 0, "high_vol").otherwise("calm").alias("regime"), F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("fomc_day"))).when(F.col("o_orderkey") % 13 == 0, F.array(F.lit("CPI_day"))).alias("event_flags"),
        F.col("o_orderdate").alias("timestamp"))


@query("order_budgets", "P2 P3 P4 N5",
       f"""SELECT o_orderkey AS order_id, {rd('CASE WHEN o_orderkey % 4 = 0 THEN 1.0 + k / 10.0 WHEN o_orderkey % 4 = 1 THEN (50.0 + k) * 0.02 ELSE (50.0 + k) * 0.0025 END', 'unit_risk')},
         {rd('0.01 * CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 1 END * CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 0.5 ELSE 1 END', 'trade_pct')},
         CASE WHEN equity IS NULL THEN 'invalid_equity' WHEN o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 THEN 'no_trade_window' END AS early FROM (SELECT o_orderkey, o_orderkey % 40 AS k, CAST(o_custkey % 50 AS VARCHAR) AS account FROM orders) LEFT JOIN he USING (account)""", HO)
def order_budgets(spark, sf):
    d = RK.budgets(order_book(spark, sf).join(account_equity(spark, sf), "account", "left"))
    return present(d.select("order_id", "unit_risk", "trade_pct", "early"))


CAP = "(({0}) + 1e-12) * greatest(equity, 1e-9)"
SCREEN = {
    **HO, "mm": "SELECT CAST(symbol[2:] AS INTEGER) % 40 AS k, date_trunc('quarter', ts) AS q, avg(close) AS c FROM bars GROUP BY 1, 2",
    "co": "SELECT a.k AS ka, c.k AS kc, round(corr(a.c, c.c), 6) AS corr FROM mm a JOIN mm c ON a.q = c.q GROUP BY 1, 2",
    "cb": "SELECT h.account, co.ka AS k, sum(abs(p.v)) AS corr_base FROM (SELECT DISTINCT account FROM ho) h JOIN co ON co.ka <> co.kc AND abs(co.corr) >= 0.4 JOIN ho p ON p.account = h.account AND p.k = co.kc GROUP BY 1, 2",
    "ac": "SELECT account, sum(abs(v)) AS g, sum(v) AS n FROM ho GROUP BY 1",
    "se": "SELECT account, sector, sum(abs(v)) AS s FROM ho GROUP BY 1, 2",
    "o1": """SELECT order_id, ts, account, k, x.qty, x.price, sign, unit_risk, trade_pct, equity, coalesce(h.v, 0) AS own, coalesce(h.sector, 'unknown') AS t_sector, coalesce(g, 0) - abs(coalesce(h.v, 0)) AS gross_base, coalesce(n, 0) - coalesce(h.v, 0) AS net_base,
        coalesce(s, 0) - CASE WHEN h.sector IS NULL THEN 0 ELSE abs(h.v) END AS sector_base, coalesce(corr_base, 0) AS corr_base, k IN (SELECT ka FROM co) AS correlated, list_filter([CASE WHEN hot THEN 'regime_throttle' END, CASE WHEN event THEN 'event_throttle' END], lambda x: x IS NOT NULL) AS notes,
        CASE WHEN equity IS NULL OR equity <= 0 THEN 'invalid_equity' WHEN order_id % 13 = 0 AND order_id % 11 <> 0 THEN 'no_trade_window' WHEN x.qty <= 1e-12 THEN 'empty_order' END AS early
      FROM (SELECT o_orderkey AS order_id, o_orderdate AS ts, CAST(o_custkey % 50 AS VARCHAR) AS account, o_orderkey % 40 AS k, floor(o_totalprice / 1000.0)::DOUBLE AS qty, (50.0 + o_orderkey % 40)::DOUBLE AS price, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END::DOUBLE AS sign,
              o_orderkey % 7 = 0 AS hot, o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 AS event,
              (CASE WHEN o_orderkey % 4 = 0 THEN 1.0 + (o_orderkey % 40) / 10.0 WHEN o_orderkey % 4 = 1 THEN (50.0 + o_orderkey % 40) * 0.02 ELSE (50.0 + o_orderkey % 40) * 0.0025 END)::DOUBLE AS unit_risk,
              (0.01::DOUBLE * CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 1 END::DOUBLE * CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 0.5 ELSE 1 END::DOUBLE) AS trade_pct FROM orders) x
      LEFT JOIN ho h USING (account, k) LEFT JOIN ac USING (account) LEFT JOIN he USING (account) LEFT JOIN se ON se.account = ac.account AND se.sector = coalesce(h.sector, 'unknown') LEFT JOIN cb ON cb.account = ac.account AND cb.k = x.k""",
    "o2": f"""SELECT *, {CAP.format(1.5)} - gross_base AS cg, {CAP.format(0.35)} - sector_base AS cs, {CAP.format(0.45)} - corr_base AS cc, {CAP.format(1.0)} AS net, t_sector NOT IN ('', 'unknown') AS known FROM o1""",
    "o3": "SELECT *, least(cg, CASE WHEN known THEN cs END, CASE WHEN correlated THEN cc END) AS size, own + sign * price AS one FROM o2",
    "o4": """SELECT *, CASE WHEN (NOT correlated AND cc < 0) OR size < 0 THEN 0 ELSE floor(least((size - sign * own) / price, (net - sign * (own + net_base)) / price) + 1e-9) END AS room_to,
        ceil(greatest((-size - sign * own) / price, (-net - sign * (own + net_base)) / price) - 1e-9) AS room_from,
        list_filter([CASE WHEN abs(one) > cg THEN 'gross_exposure_cap' END, CASE WHEN abs(net_base + one) > net THEN 'net_exposure_cap' END, CASE WHEN known AND abs(one) > cs THEN 'sector_exposure_cap' END, CASE WHEN CASE WHEN correlated THEN abs(one) ELSE 0 END > cc THEN 'correlated_exposure_cap' END], lambda x: x IS NOT NULL) AS broken,
        row_number() OVER (PARTITION BY account, ts ORDER BY order_id) AS rn FROM o3""",
    "r0": "SELECT account, ts, 0::BIGINT AS rn, 0.0::DOUBLE AS used FROM o4 GROUP BY 1, 2",
    "rec(account, ts, rn, order_id, lots, risk, used, reasons, sign)": """SELECT account, ts, rn, NULL::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, used, NULL::VARCHAR[], 1.0::DOUBLE FROM r0
      UNION ALL SELECT account, ts, rn, order_id, lots, lots * unit_risk / greatest(equity, 1e-9), used + coalesce(lots * unit_risk / greatest(equity, 1e-9), 0),
        CASE WHEN early IS NOT NULL THEN [early] WHEN budget <= 1e-12 THEN ['daily_risk_cap_exceeded'] WHEN wanted <= 0 THEN ['sized_to_zero'] WHEN NOT fits THEN broken WHEN fitting < wanted THEN list_append(notes, 'size_reduced_for_constraints') ELSE notes END, sign
      FROM (SELECT *, CASE WHEN early IS NOT NULL OR budget <= 1e-12 OR wanted <= 0 OR NOT fits THEN 0.0 ELSE fitting END::DOUBLE AS lots FROM (SELECT *, fitting >= greatest(1.0, room_from) AS fits FROM (SELECT *, trunc(least(wanted, room_to)) AS fitting FROM (
        SELECT *, floor(least(abs(qty), equity * budget / greatest(unit_risk, 1e-9), equity * 0.2 / price)) AS wanted FROM (SELECT o.*, r.used, least(o.trade_pct, greatest(0.03 - r.used, 0)) AS budget FROM rec r JOIN o4 o ON o.account = r.account AND o.ts = r.ts AND o.rn = r.rn + 1)))))""",
}


@query("order_screen", "P5 P6 P7 P8 P9",
       f"SELECT order_id, account, lots > 0 AS approved, {rd('CASE WHEN lots > 0 THEN sign * lots ELSE 0 END', 'approved_qty')}, {rd('coalesce(risk, 0)', 'trade_risk_pct')}, {rd('used', 'daily_used_pct')}, array_to_string(reasons, ',') AS reasons FROM rec WHERE order_id IS NOT NULL", SCREEN)
def order_screen(spark, sf):
    d = RK.screen_orders(order_book(spark, sf), holdings(spark, sf), account_equity(spark, sf), correlations(spark, sf), RK.RiskConfig(correlation_threshold=0.4))
    return present(d.withColumn("reasons", F.array_join("reasons", ",")))


# ---- scan -----------------------------------------------------------------------------

@query("pattern_analogs", "C2",
       f"""SELECT symbol, rank, {ts('wts', 'window_end')}, {rd('distance', 'distance')}, {rd('fwd', 'forward_return')} FROM (
         SELECT o.symbol, o.ts AS wts, o.fwd, sqrt(list_sum([(o.v[i] - n.v[i]) * (o.v[i] - n.v[i]) for i in range(1, 31)])) AS distance, row_number() OVER (PARTITION BY o.symbol ORDER BY sqrt(list_sum([(o.v[i] - n.v[i]) * (o.v[i] - n.v[i]) for i in range(1, 31)])), o.ts) AS rank
         FROM av o JOIN av n ON n.symbol = o.symbol AND n.ix = n.total - 1 WHERE o.ix >= 30 AND o.ix < o.total - 31 AND o.ix < o.total - 6 AND o.fwd IS NOT NULL) WHERE rank <= 5""",
       {"ar": f"SELECT symbol, ts, close, ln(close) - ln(lag(close) {LAG}) AS r, row_number() {LAG} - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS total, lead(close, 5) {LAG} / close - 1 AS fwd FROM bars",
        "av": f"SELECT *, CASE WHEN count(r) {over(30)} >= 30 THEN list(r) {over(30)} END AS v FROM ar"})
def pattern_analogs(spark, sf):
    d = SC.pattern_analogs(src.closes_daily(spark, sf))
    return present(d.select("symbol", "rank", "window_end", "distance", "forward_return"))


@query("analog_outcomes", "C2")
def analog_outcomes(spark, sf):
    return present(SC.analog_outcomes(SC.pattern_analogs(src.closes_daily(spark, sf))))


def newest_features(spark, sf):
    d = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    n = latest(d, ["symbol"], ["timestamp"]).withColumnRenamed("close", "price")
    return n.withColumn("probability_up", F.greatest(F.least(0.5 + F.col("roc_20") * 5.0, F.lit(0.99)), F.lit(0.01)))


NEW = {**EM, "nf": "SELECT *, greatest(least(0.5 + roc_20 * 5.0, 0.99), 0.01) AS p FROM feat WHERE sma_200 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
       "tsu": """SELECT *, CASE WHEN p >= 0.6 THEN 1.0 WHEN p <= 0.4 THEN -1.0 END AS s, greatest(atr_14, close * 0.004) AS atr, CAST(price_sma20_ratio > 1 AS INT) + CAST(price_sma50_ratio > 1 AS INT) + CAST(price_sma200_ratio > 1 AS INT) >= 2 AS bull FROM nf"""}


@query("trade_setups", "C3 C6 L17 L18 L20",
       f"""SELECT symbol, CASE WHEN s > 0 THEN 'LONG' WHEN s < 0 THEN 'SHORT' ELSE 'NO_TRADE' END AS bias, CASE WHEN s > 0 THEN CASE WHEN bull THEN 'BREAKOUT_CONTINUATION' ELSE 'PULLBACK_LONG' END WHEN s < 0 THEN CASE WHEN bull THEN 'RALLY_FADE' ELSE 'BREAKDOWN_CONTINUATION' END ELSE 'WAIT_FOR_EDGE' END AS setup_type,
         {rd('greatest(least(0.65 * abs(p - 0.5) * 2 + 0.35 * 0.5, 0.95), 0.05)', 'setup_confidence')}, {rd('close + s * 0.25 * atr', 'entry_trigger')}, {rd('close + s * 0.25 * atr - s * 1.6 * atr', 'stop_loss')}, {rd('close + s * 0.25 * atr + s * 2 * atr', 'target_1')},
         CAST(coalesce(greatest(least(floor(2000.0 / (1.6 * atr * abs(s))), floor(5000.0 / (close + s * 0.25 * atr))), 0), 0) AS BIGINT) AS suggested_shares,
         CASE WHEN hvol_20 >= 0.4 THEN 'HIGH' WHEN hvol_20 <= 0.18 THEN 'LOW' ELSE 'NORMAL' END AS volatility FROM tsu""", NEW)
def trade_setups(spark, sf):
    d = SC.trade_setup(newest_features(spark, sf))
    return present(d.select("symbol", "bias", "setup_type", "setup_confidence", "entry_trigger", "stop_loss", "target_1", "suggested_shares", "volatility"))


@query("context_flags", "C5 C6",
       """SELECT symbol, CASE WHEN adx >= 20 THEN 'trend' ELSE 'chop' END AS trend_state, CASE WHEN hvol_20 >= 0.4 THEN 'high_vol' WHEN hvol_20 <= 0.18 THEN 'low_vol' ELSE 'mid_vol' END AS vol_state, vol_ratio_20 >= 1.8 AS volume_spike, abs(return_1d) >= 0.02 AS gap_flag,
          CASE WHEN return_20d < 0 THEN 'risk_off' ELSE 'risk_on' END AS risk_proxy, CASE WHEN p < 0.58 OR hvol_20 >= 0.4 THEN 'conservative' WHEN p >= 0.75 AND hvol_20 <= 0.18 THEN 'aggressive' ELSE 'standard' END AS risk_mode FROM nf""", NEW)
def context_flags(spark, sf):
    d = newest_features(spark, sf).withColumns({"gap": F.col("return_1d"), "bench_ret_20": F.col("return_20d")})
    d = SC.context_flags(d).withColumn("risk_mode", SC.risk_mode("probability_up", "vol_state"))
    return present(d.select("symbol", "trend_state", "vol_state", "volume_spike", "gap_flag", "risk_proxy", "risk_mode"))


@query("scan_guards", "C1 C11", "SELECT symbol, count(*) AS rows, CASE WHEN count(*) < 480 THEN 'insufficient_history' ELSE 'ok' END AS status FROM bars GROUP BY 1")
def scan_guards(spark, sf):
    return present(SC.guards(src.closes_daily(spark, sf), 8).drop("last_close"))


@query("scan_remaining", "C11 N4", "SELECT symbol FROM bars GROUP BY 1 HAVING count(*) < 540")
def scan_remaining(spark, sf):
    g = src.closes_daily(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"))
    return SC.remaining(g.select("symbol"), g.select("symbol", F.when(F.col("n") >= 540, "completed").otherwise("failed").alias("status")))


SCAN_POLICY = Q.QualityPolicy("report", "report", "report", "report", "report", min_history_rows_multiplier=61)
SCAN = {
    **NEW,
    "uni": "SELECT symbol, sector FROM sectors UNION ALL SELECT printf('N%05d', n_nationkey), NULL FROM nation",
    "hist": "SELECT symbol, count(*) AS rows, min(ts) AS first_bar, max(ts) AS last_bar FROM bars GROUP BY 1",
    "last20": f"SELECT symbol, close / lag(close, 20) {LAG} - 1 AS ret, close / max(close) {over(20)} - 1 AS dhi, close / min(close) {over(20)} - 1 AS dlo FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "secret": "SELECT sector, avg(ret) AS er FROM last20 JOIN sectors USING (symbol) GROUP BY 1",
    "ar": f"SELECT symbol, ts, close, ln(close) - ln(lag(close) {LAG}) AS r, row_number() {LAG} - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS total, lead(close, 9) {LAG} / close - 1 AS fwd FROM bars",
    "av": f"SELECT *, CASE WHEN count(r) {over(45)} >= 45 THEN list(r) {over(45)} END AS v FROM ar",
    "an": """SELECT symbol, count(*) AS analogs, avg(fwd) AS analog_return FROM (SELECT o.symbol, o.fwd FROM av o JOIN av n ON n.symbol = o.symbol AND n.ix = n.total - 1 WHERE o.ix >= 45 AND o.ix < o.total - 46 AND o.ix < o.total - 10 AND o.fwd IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY o.symbol ORDER BY sqrt(list_sum([(o.v[i] - n.v[i]) * (o.v[i] - n.v[i]) for i in range(1, 46)])), o.ts) <= 5) GROUP BY 1""",
    "st": """SELECT u.symbol, u.sector, h.*, CASE WHEN h.rows IS NULL THEN 'no_data' WHEN h.rows < 540 THEN 'insufficient_history' WHEN h.rows < 549 THEN 'minimum_history' WHEN s_acctbal < 0 THEN 'no_prediction' END AS code
        FROM uni u LEFT JOIN hist h ON h.symbol = u.symbol LEFT JOIN supplier ON printf('S%05d', s_suppkey) = u.symbol""",
    "sc": "SELECT *, greatest(least(0.65 * abs(p - 0.5) * 2 + 0.35 * 0.5, 0.95), 0.05) AS score, CASE WHEN hvol_20 >= 0.4 THEN 'high_vol' WHEN hvol_20 <= 0.18 THEN 'low_vol' ELSE 'mid_vol' END AS vs FROM tsu",
}


@query("universe_scan", "C1 C3 C5 C6 C11 J15",
       f"""SELECT st.symbol, CASE WHEN code IS NULL THEN 'completed' ELSE 'failed' END AS status, CASE WHEN code IN ('no_data', 'insufficient_history') THEN 'history' WHEN code = 'minimum_history' THEN 'quality' WHEN code = 'no_prediction' THEN 'prediction' END AS stage, code, st.rows,
         {ts('first_bar', 'first_bar')}, {ts('last_bar', 'last_bar')}, {rd('close', 'price')}, CASE WHEN p IS NULL THEN NULL WHEN s > 0 THEN 'LONG' WHEN s < 0 THEN 'SHORT' ELSE 'NO_TRADE' END AS bias,
         CASE WHEN p IS NULL THEN NULL WHEN s > 0 THEN CASE WHEN bull THEN 'BREAKOUT_CONTINUATION' ELSE 'PULLBACK_LONG' END WHEN s < 0 THEN CASE WHEN bull THEN 'RALLY_FADE' ELSE 'BREAKDOWN_CONTINUATION' END ELSE 'WAIT_FOR_EDGE' END AS setup_type,
         {rd('score', 'primary_score')}, {rd('close + s * 0.25 * atr - s * 1.6 * atr', 'stop_loss')}, {rd('close + s * 0.25 * atr + s * 2 * atr', 'target_1')}, CASE WHEN adx >= 20 THEN 'trend' WHEN p IS NOT NULL THEN 'chop' END AS trend_state, vs AS vol_state,
         CASE WHEN p IS NOT NULL THEN CASE WHEN (SELECT avg(ret) FROM last20) < 0 THEN 'risk_off' ELSE 'risk_on' END END AS risk_proxy, CASE WHEN p IS NULL THEN NULL WHEN score < 0.58 OR vs = 'high_vol' THEN 'conservative' WHEN score >= 0.75 AND vs = 'low_vol' THEN 'aggressive' ELSE 'standard' END AS risk_mode,
         vol_ratio_20 >= 1.8 AS volume_spike, abs(return_1d) >= 0.02 AS gap_flag, {rd('ret - (SELECT avg(ret) FROM last20)', 'rel_vs_bench')}, {rd('ret - er', 'rel_vs_sector')}, {rd("dhi", "distance_to_high")}, {rd("dlo", "distance_to_low")}, analogs, {rd('analog_return', 'analog_return')}
       FROM st LEFT JOIN sc ON sc.symbol = st.symbol AND code IS NULL LEFT JOIN last20 l ON l.symbol = sc.symbol LEFT JOIN secret ON secret.sector = st.sector AND code IS NULL LEFT JOIN an ON an.symbol = sc.symbol""", SCAN)
def universe_scan(spark, sf):
    """All suppliers and, without bars, all nations; suppliers with a negative balance have no model."""
    listed = src.sector_map(spark, sf).select("symbol", "sector")
    universe = listed.unionByName(src.load(spark, sf, "nation").select(src.symbol_of(F.col("n_nationkey"), "N").alias("symbol"), F.lit(None).cast("string").alias("sector")))
    modelled = src.load(spark, sf, "supplier").filter("s_acctbal >= 0").select(src.symbol_of(F.col("s_suppkey")).alias("symbol"))
    bars = src.bars_daily(spark, sf)
    b = blocked(bars.select("symbol", "timestamp", "close"), back=20)
    b.stage({"ret": F.try_divide(F.col("close"), lag(b, "close", 20)) - 1.0})
    moved = latest(b.owned(), ["symbol"], ["timestamp"], ["ret"]).join(listed, "symbol")
    etf = moved.groupBy(F.concat(F.lit("E"), F.col("sector")).alias("etf")).agg(F.avg("ret").alias("ret"))
    funds = listed.select("sector").distinct().withColumn("etf", F.concat(F.lit("E"), F.col("sector")))

    def predict(newest):
        up = F.greatest(F.least(0.5 + F.col("roc_20") * 5.0, F.lit(0.99)), F.lit(0.01))
        return newest.join(modelled, "symbol", "left_semi").select("symbol", up.alias("probability_up"))

    return present(SC.universe_scan(universe, bars, predict, moved.agg(F.avg("ret").alias("ret")), funds, etf, horizon=9, policy=SCAN_POLICY))


@query("momentum_screen", "K11", f"SELECT symbol, {rd('a.close', 'close')}, {rd('past', 'past')}, {rd('(a.close - past) / past', 'momentum')} FROM (SELECT symbol, max(close) FILTER (rn = 1) AS close, max(close) FILTER (rn = 20) AS past FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) GROUP BY 1) a WHERE (a.close - past) / past >= 0.05")
def momentum_screen(spark, sf):
    return present(SC.momentum_screen(src.closes_daily(spark, sf)))


@query("relative_strength_scan", "J15",
       f"""SELECT s.symbol, {rd('s.ret', 'ret')}, {rd('s.ret - (SELECT avg(ret) FROM r20)', 'rel_vs_bench')}, {rd('s.ret - e.er', 'rel_vs_sector')} FROM r20 s JOIN sectors USING (symbol) LEFT JOIN (SELECT sector, avg(ret) AS er FROM r20 JOIN sectors USING (symbol) GROUP BY 1) e ON e.sector = sectors.sector""",
       {"r20": f"SELECT symbol, close / lag(close, 20) {LAG} - 1 AS ret FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"})
def relative_strength_scan(spark, sf):
    b = blocked(src.closes_daily(spark, sf), back=20)
    b.stage({"ret": F.try_divide(F.col("close"), lag(b, "close", 20)) - 1.0})
    s = latest(b.owned(), ["symbol"], ["timestamp"], ["ret"]).join(src.sector_map(spark, sf), "symbol")
    etf = s.groupBy(F.concat(F.lit("E"), F.col("sector")).alias("etf")).agg(F.avg("ret").alias("ret"))
    m = src.sector_map(spark, sf).select("sector").distinct().withColumn("etf", F.concat(F.lit("E"), F.col("sector")))
    d = SC.relative_strength(s, s.agg(F.avg("ret").alias("ret")), m, etf)
    return present(d.select("symbol", "ret", "rel_vs_bench", "rel_vs_sector"))


# ---- options ---------------------------------------------------------------------------

def quotes(spark, sf):
    q = src.option_quotes(spark, sf)
    return q.withColumn("symbol", src.symbol_of(F.col("underlying") % 100))


@query("iv_metrics", "C7 K12",
       f"""SELECT symbol, {rds('hv_20 hv_50 current_iv')}, {rd('current_iv - hv_20', 'iv_hv_spread')}, {rd('greatest(least((current_iv - hv_50) / (hv_20 - hv_50 + 0.01) * 100, 100), 0)', 'iv_rank', 4)} FROM (
         SELECT symbol, arg_max(h20, ts) AS hv_20, arg_max(h50, ts) AS hv_50 FROM (SELECT *, ({roll('stddev_samp', 'r', 20)}) * sqrt(252.0) AS h20, ({roll('stddev_samp', 'r', 50)}) * sqrt(252.0) AS h50 FROM (SELECT *, close / lag(close) {LAG} - 1 AS r FROM bars)) GROUP BY 1)
         JOIN (SELECT printf('S%05d', underlying % 100) AS symbol, avg(iv) AS current_iv FROM quotes WHERE type = 'call' AND abs(strike - spot) / spot < 0.05 GROUP BY 1) USING (symbol)""")
def iv_metrics(spark, sf):
    return present(SC.iv_metrics(src.closes_daily(spark, sf), quotes(spark, sf)).withColumn("iv_rank", F.round("iv_rank", 4)))


@query("option_liquidity", "C8 X12",
       f"""SELECT underlying, {rd('sp', 'avg_relative_spread')}, {rd('vo', 'avg_volume')}, NOT (coalesce(sp > 0.35, false) OR coalesce(vo < 20, false)) AS liquidity_ok FROM (SELECT underlying, avg((ask - bid) / ((ask + bid) / 2)) FILTER ((ask + bid) > 0) AS sp, avg(volume) AS vo FROM (
         SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY rung) AS rn FROM quotes WHERE type = 'call') WHERE rn <= 25 GROUP BY 1)""")
def option_liquidity(spark, sf):
    return present(SC.option_liquidity(src.option_quotes(spark, sf), "underlying", ["rung"]))


@query("iv_term_slope", "C8",
       f"""SELECT underlying, {rd('f.iv - n.iv', 'term_structure_slope')} FROM (SELECT underlying, iv FROM quotes WHERE type = 'call' AND rung = 0) n JOIN (SELECT underlying, iv FROM quotes WHERE type = 'call' AND rung = 2) f USING (underlying)""")
def iv_term_slope(spark, sf):
    """Rungs stand in for expiries."""
    q = src.option_quotes(spark, sf).filter("type = 'call'").withColumnRenamed("rung", "expiry")
    return present(SC.term_slope(q, "underlying", "expiry"))


def setups(spark, sf):
    p = src.load(spark, sf, "part")
    n = F.col("p_partkey")
    return p.select(n.cast("string").alias("symbol"), F.when(n % 3 == 0, "LONG").when(n % 3 == 1, "SHORT").otherwise("NO_TRADE").alias("bias"), ((n % 90) / 100.0).alias("confidence"),
                    F.when(n % 5 != 0, (n % 100).cast("double")).alias("iv_rank"), (F.col("p_retailprice") / 10.0).alias("price"))


@query("option_candidates", "C9",
       f"""SELECT symbol, rank, strategy_type, {rd('mid', 'mid_estimate', 2)}, {rd('pop', 'pop', 4)} FROM (
         SELECT symbol, 1::BIGINT AS rank, CASE bias WHEN 'LONG' THEN CASE WHEN rich THEN 'bull_call_spread' ELSE 'long_call' END WHEN 'SHORT' THEN CASE WHEN rich THEN 'bear_put_spread' ELSE 'long_put' END ELSE 'no_trade' END AS strategy_type,
           CASE WHEN bias = 'NO_TRADE' THEN 0 ELSE greatest(0.25, mv * 0.35) END AS mid, CASE WHEN bias = 'NO_TRADE' THEN 0 WHEN rich THEN greatest(least(0.52 + c * 0.3, 0.95), 0.05) ELSE greatest(least(0.45 + c * 0.35, 0.95), 0.05) END AS pop FROM oc
         UNION ALL SELECT symbol, 2, CASE bias WHEN 'LONG' THEN 'cash_secured_put' ELSE 'bear_call_spread' END, CASE bias WHEN 'LONG' THEN greatest(0.2, mv * 0.2) ELSE greatest(0.2, mv * 0.18) END, CASE bias WHEN 'LONG' THEN greatest(least(0.55 + c * 0.25, 0.98), 0.05) ELSE greatest(least(0.55 + c * 0.22, 0.98), 0.05) END FROM oc WHERE bias <> 'NO_TRADE')""",
       {"oc": """SELECT *, coalesce(iv >= 55, false) AS rich, px * greatest(0.01, least(0.2, 0.015 + 0.12 * coalesce(iv, 0) / 100)) AS mv FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'NO_TRADE' END AS bias,
           (p_partkey % 90) / 100.0 AS c, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 100)::DOUBLE END AS iv, p_retailprice / 10.0 AS px FROM part)"""})
def option_candidates(spark, sf):
    return present(SC.option_candidates(setups(spark, sf)).select("symbol", "rank", "strategy_type", "mid_estimate", "pop"))


@query("scenario_table", "C9",
       f"""SELECT symbol, {rd('m', 'underlying_move_pct')}, {rd("CASE bias WHEN 'NO_TRADE' THEN 0 WHEN 'LONG' THEN greatest(-1.0, m * 40) ELSE greatest(-1.0, -m * 40) END", 'pnl_estimate_r', 4)} FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'NO_TRADE' END AS bias, unnest([-0.05, -0.02, 0.0, 0.02, 0.05])::DOUBLE AS m FROM part)""")
def scenario_table(spark, sf):
    return present(SC.scenario_table(setups(spark, sf)).drop("bias"))


# ---- patterns -----------------------------------------------------------------------------

PIV = lambda x, k, op, agg: f"{x} {op} {agg}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AND {x} {op} {agg}({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"
PV = lambda k: f"""SELECT symbol, ts, ix, 'high' AS kind, high AS level FROM (SELECT *, row_number() {LAG} - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS total, {PIV('high', k, '>=', 'max')} AS f FROM bars) WHERE f AND ix >= {k} AND ix < total - {k}
  UNION ALL SELECT symbol, ts, ix, 'low', low FROM (SELECT *, row_number() {LAG} - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS total, {PIV('low', k, '<=', 'min')} AS f FROM bars) WHERE f AND ix >= {k} AND ix < total - {k}"""


@query("price_pivots", "G2", f"SELECT symbol, {ts('ts')}, kind, {rd('level', 'level')} FROM pv", {"pv": PV(3)})
def price_pivots(spark, sf):
    return present(P.pivots(src.bars_daily(spark, sf), 3).drop("ix"))


@query("support_resistance", "G3",
       """SELECT l.symbol, (SELECT string_agg(printf('%.4f', level), ',' ORDER BY level DESC) FROM (SELECT DISTINCT level FROM rk WHERE rk.symbol = l.symbol AND kind = 'low' AND level <= l.last_close ORDER BY level DESC LIMIT 3)) AS supports,
          (SELECT string_agg(printf('%.4f', level), ',' ORDER BY level) FROM (SELECT DISTINCT level FROM rk WHERE rk.symbol = l.symbol AND kind = 'high' AND level >= l.last_close ORDER BY level LIMIT 3)) AS resistances FROM (SELECT symbol, arg_max(close, ts) AS last_close FROM bars GROUP BY 1) l""",
       {"pv": PV(3), "rk": "SELECT * FROM pv QUALIFY row_number() OVER (PARTITION BY symbol, kind ORDER BY ix DESC) <= 20"})
def support_resistance(spark, sf):
    d = P.support_resistance(src.bars_daily(spark, sf))
    txt = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda v: F.format_string("%.4f", v)), ",")).alias(c)
    return d.select("symbol", txt("supports"), txt("resistances"))


@query("indicator_snapshot", "G1 G9",
       f"""SELECT symbol, {ts('ts')}, {rd('close', 'latest_close')}, {rds('sma20 sma50')}, {rd('close / (sma20 + 1e-9) - 1', 'close_vs_sma20')}, {rd('atr / (close + 1e-9)', 'atr_pct')}, {rd('v20 / (v60 + 1e-9)', 'volume_ratio_20_60')}, {rd('close / (pc + 1e-9) - 1', 'daily_change_pct')}, {rd('volume / (v20 + 1e-9)', 'volume_ratio')},
         {rd('(close - (sma20 - 2 * sd)) / (4 * sd + 1e-9)', 'boll_position')}, CASE WHEN close >= sma20 THEN 'trend above moving averages' ELSE 'trend below short moving average' END AS sma_view, CASE WHEN atr / (close + 1e-9) > 0.03 THEN 'elevated realized range' ELSE 'contained realized range' END AS atr_view FROM ix
         QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""",
       {"i0": f"SELECT *, lag(close) {LAG} AS pc, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS tr FROM bars",
        "ix": f"SELECT *, {roll('avg', 'close', 20)} AS sma20, {roll('avg', 'close', 50)} AS sma50, {roll('stddev_samp', 'close', 20)} AS sd, {roll('avg', 'tr', 14)} AS atr, {roll('avg', 'volume', 20)} AS v20, {roll('avg', 'volume', 60)} AS v60 FROM i0"})
def indicator_snapshot(spark, sf):
    d = P.indicator_rows(src.bars_daily(spark, sf))
    return present(d.select("symbol", "timestamp", "latest_close", "sma20", "sma50", "close_vs_sma20", "atr_pct", "volume_ratio_20_60", "daily_change_pct", "volume_ratio", "boll_position", "sma_view", "atr_view"))


@query("trend_channel", "G4",
       f"""SELECT symbol, CASE WHEN p > 0.001 THEN 'uptrend' WHEN p < -0.001 THEN 'downtrend' ELSE 'sideways' END AS signal, {rd('greatest(0.35, least(0.95, 0.45 + least(0.35, abs(p) * 900) + greatest(0.0, least(0.15, r2 * 0.15))))', 'confidence', 3)} FROM (
         SELECT symbol, regr_slope(close, x) / (avg(close) + 1e-9) AS p, regr_r2(close, x) AS r2 FROM (SELECT *, -row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)::DOUBLE AS x FROM bars) WHERE x >= -40 GROUP BY 1)""")
def trend_channel(spark, sf):
    return present(P.trend_channel(src.bars_daily(spark, sf)).select("symbol", "signal", "confidence"), 3)


@query("range_breakout", "G5",
       f"""SELECT symbol, CASE WHEN x > hi * 1.003 THEN 'upside_breakout' WHEN x < lo * 0.997 THEN 'downside_breakout' ELSE 'inside_range' END AS signal,
         {rd('CASE WHEN x > hi * 1.003 OR x < lo * 0.997 THEN least(0.95, 0.55 + least(0.25, d * 20) + least(0.15, greatest(0.0, v / (v20 + 1e-9) - 1) * 0.2)) ELSE 0.35 END', 'confidence', 3)} FROM (SELECT *, CASE WHEN x > hi * 1.003 THEN x / (hi + 1e-9) - 1 ELSE 1 - x / (lo + 1e-9) END AS d FROM (
         SELECT symbol, max(high) FILTER (rn BETWEEN 2 AND 21) AS hi, min(low) FILTER (rn BETWEEN 2 AND 21) AS lo, max(close) FILTER (rn = 1) AS x, max(volume) FILTER (rn = 1) AS v, avg(volume) FILTER (rn <= 20) AS v20 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) GROUP BY 1))""")
def range_breakout(spark, sf):
    return present(P.range_breakout(src.bars_daily(spark, sf)).select("symbol", "signal", "confidence"), 3)


@query("double_patterns", "G6",
       f"""SELECT symbol, CASE kind WHEN 'high' THEN 'double_top' ELSE 'double_bottom' END AS name, {rd('p1', 'p1')}, {rd('p2', 'p2')} FROM (SELECT symbol, kind, max(level) FILTER (rn = 2) AS p1, max(level) FILTER (rn = 1) AS p2, max(ix) FILTER (rn = 2) AS i1, max(ix) FILTER (rn = 1) AS i2 FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY ix DESC) AS rn FROM pv) WHERE rn <= 2 GROUP BY 1, 2 HAVING count(*) = 2) WHERE i2 - i1 >= 5 AND abs(p2 - p1) / (CASE kind WHEN 'high' THEN greatest(p1, p2) ELSE least(p1, p2) END + 1e-9) <= 0.03""", {"pv": PV(4)})
def double_patterns(spark, sf):
    d = P.double_patterns(src.bars_daily(spark, sf))
    return present(d.select("symbol", "name", F.get_json_object("metrics", "$.first").cast("double").alias("p1"), F.get_json_object("metrics", "$.second").cast("double").alias("p2")))


@query("head_and_shoulders", "G7",
       """SELECT symbol FROM (SELECT symbol, max(level) FILTER (rn = 3) AS l, max(level) FILTER (rn = 2) AS h, max(level) FILTER (rn = 1) AS r, max(ix) FILTER (rn = 3) AS i3, max(ix) FILTER (rn = 2) AS i2, max(ix) FILTER (rn = 1) AS i1 FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ix DESC) AS rn FROM pv WHERE kind = 'high') WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3) WHERE i2 - i3 >= 3 AND i1 - i2 >= 3 AND abs(l - r) / (greatest(l, r) + 1e-9) <= 0.05 AND (h - greatest(l, r)) / (h + 1e-9) >= 0.03""", {"pv": PV(3)})
def head_and_shoulders(spark, sf):
    return P.head_and_shoulders(src.bars_daily(spark, sf)).select("symbol")


@query("chart_patterns", "G8 X8")
def chart_patterns(spark, sf):
    return present(P.chart_patterns(src.bars_daily(spark, sf)), 3)


@query("analysis_report", "G10 G11 G12 G13 S16")
def analysis_report(spark, sf):
    p = src.predictions(spark, sf).groupBy("symbol").agg(F.avg("probability").alias("probability_up"))
    p = p.withColumns({"probability_down": 1.0 - F.col("probability_up"), "confidence": F.greatest(F.col("probability_up"), 1.0 - F.col("probability_up"))})
    d = P.report(src.bars_daily(spark, sf), p)
    return present(d.select("symbol", "timestamp", "latest_close", "rsi14", "breakout_signal", "volatility_regime", F.size("patterns").alias("n_patterns"), F.array_join("risk_notes", ",").alias("risk_notes"), F.array_join("next_steps", ",").alias("next_steps"), "model_available"))


# ---- journal -------------------------------------------------------------------------------

@query("latest_order_per_customer", "K1 K19 DB01 DB07 DB08 S5 S15",
       f"SELECT o_custkey, o_orderkey, {rd('o_totalprice', 'o_totalprice')} FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order_per_customer(spark, sf):
    o = src.load(spark, sf, "orders")
    return present(J.current(o.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate"))


@query("watchlist_current", "DB06 U10", "SELECT symbol, priority FROM (SELECT o_custkey % 200 AS symbol, o_orderdate, o_orderkey, o_orderkey % 5 AS priority, o_orderstatus = 'F' AS removed FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE NOT removed")
def watchlist_current(spark, sf):
    o = src.load(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("symbol"), "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 5).alias("priority"), (F.col("o_orderstatus") == "F").alias("removed"))
    return present(J.current(o, ["symbol"], ["o_orderdate", "o_orderkey"], "removed").select("symbol", "priority"))


@query("recent_trades", "K9 K20", f"SELECT o_orderkey, {ts('o_orderdate', 'o_orderdate')} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 40")
def recent_trades(spark, sf):
    return present(J.recent(src.load(spark, sf, "orders"), "o_orderdate", 40, F.col("o_orderstatus") == "F", ("o_orderkey",)).select("o_orderkey", "o_orderdate"))


@query("recent_conversation", "DB09", "SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id LIMIT 30")
def recent_conversation(spark, sf):
    c = src.load(spark, sf, "conversations").withColumn("at", F.timestamp_seconds("turn"))
    return present(J.recent_in_order(c, "at", 30, ("conv_id",)).select("conv_id", "turn", "role"))


@query("position_marks", "J19 DB03", f"SELECT s_suppkey, {rd('close', 'current_price')}, {rd('(close - 100.0) * s_acctbal', 'unrealized_pnl', 3)} FROM supplier LEFT JOIN (SELECT symbol, arg_max(close, ts) AS close FROM bars GROUP BY 1) b ON b.symbol = printf('S%05d', s_suppkey) WHERE s_acctbal > 0")
def position_marks(spark, sf):
    s = src.load(spark, sf, "supplier")
    pos = s.select("s_suppkey", src.symbol_of(F.col("s_suppkey")).alias("symbol"), F.col("s_acctbal").alias("quantity"), F.lit(100.0).alias("entry_price"), F.lit(None).cast("double").alias("current_price"), F.when(F.col("s_acctbal") > 0, "open").otherwise("closed").alias("status"))
    px = src.closes_daily(spark, sf).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("price"))
    d = J.mark_to_market(pos, px)
    return present(d.select("s_suppkey", "current_price", F.round("unrealized_pnl", 3).alias("unrealized_pnl")))


@query("triggered_alerts", "J18 DB05 K15",
       f"SELECT p_partkey, symbol, {rd('price', 'price')} FROM (SELECT p_partkey, printf('S%05d', p_partkey % 100) AS symbol, 110.0 + p_size AS th, p_partkey % 2 = 0 AS above, p_size % 5 <> 0 AS active FROM part) a JOIN (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY 1) q USING (symbol) WHERE active AND CASE WHEN above THEN price > th ELSE price < th END")
def triggered_alerts(spark, sf):
    p = src.load(spark, sf, "part")
    a = p.select("p_partkey", src.symbol_of(F.col("p_partkey") % 100).alias("symbol"), (110.0 + F.col("p_size")).alias("threshold"), F.when(F.col("p_partkey") % 2 == 0, "above").otherwise("below").alias("alert_type"),
                 F.when(F.col("p_size") % 5 != 0, "active").otherwise("triggered").alias("status"))
    q = src.closes_daily(spark, sf).groupBy("symbol").agg(F.max_by("close", "timestamp").alias("price"))
    return present(J.triggered_alerts(q, a).select("p_partkey", "symbol", "price"))


@query("goal_progress", "DB11", f"SELECT s_suppkey AS id, {rd('(s_acctbal - 1000) / (10000.0 - 1000) * 100', 'progress_pct')} FROM supplier")
def goal_progress(spark, sf):
    s = src.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1000.0).alias("start_value"), F.col("s_acctbal").alias("current_value"), F.lit(10000.0).alias("target_value"))
    return present(J.goal_progress(s).select("id", "progress_pct"))


@query("tagged_outcomes", "J17 DB12 X8", f"SELECT 'e' || CAST(event_id AS VARCHAR) AS signal_id, {rd('value - 70', 'pnl')} FROM events WHERE event_type = 'purchase' AND event_id % 3 < 2")
def tagged_outcomes(spark, sf):
    """Tags as a JSON list, a comma list, or without a signal id."""
    e = src.load(spark, sf, "events").filter("event_type = 'purchase'")
    sid = F.concat(F.lit("signal_id:e"), F.col("event_id").cast("string"))
    tags = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.lit("swing"), sid))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("swing, "), sid)).otherwise("swing")
    t = e.select((F.col("value") - 70.0).alias("pnl"), F.col("ts").alias("exit_date"), F.lit(1.0).alias("pnl_percent"), tags.alias("tags"))
    return present(J.outcome_events(t).select("signal_id", "pnl"))


def scan_results(spark, sf):
    o = src.load(spark, sf, "orders")
    st = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("failed")
    return o.select(F.concat(F.lit("run"), (F.col("o_custkey") % 20).cast("string")).alias("run_id"), F.col("o_orderkey").cast("string").alias("ticker"), st.alias("status"), F.when(st == "completed", F.col("o_totalprice") / 1e6).alias("primary_score"))


@query("scan_status_counts", "A11 A12",
       f"""SELECT 'run' || CAST(o_custkey % 20 AS VARCHAR) AS run_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS queued, 0::BIGINT AS running, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed,
         {rd("max(o_totalprice / 1e6) FILTER (o_orderstatus = 'F')", 'max_score')}, {rd("count(*) FILTER (o_orderstatus <> 'O') / count(*)::DOUBLE * 100", 'progress_pct')} FROM orders GROUP BY 1""")
def scan_status_counts(spark, sf):
    return present(J.status_counts(scan_results(spark, sf)))


@query("scan_results_page", "K8", f"SELECT CAST(o_orderkey AS VARCHAR) AS ticker, {rd('o_totalprice / 1e6', 'primary_score')} FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 25")
def scan_results_page(spark, sf):
    return present(J.scan_page(scan_results(spark, sf), "completed", 2, 25).select("ticker", "primary_score"))


@query("scan_run_listing", "K17", f"SELECT run_id, {ts('greatest(u, c)', 'last_change')} FROM (SELECT 'run' || CAST(o_custkey % 20 AS VARCHAR) AS run_id, max(o_orderdate) AS u, min(o_orderdate) AS c FROM orders GROUP BY 1) ORDER BY u DESC, run_id LIMIT 8")
def scan_run_listing(spark, sf):
    o = src.load(spark, sf, "orders")
    r = o.groupBy(F.concat(F.lit("run"), (F.col("o_custkey") % 20).cast("string")).alias("run_id")).agg(F.max("o_orderdate").alias("updated_at"), F.min("o_orderdate").alias("created_at"))
    return present(J.scan_runs(r, None, 8).select("run_id", F.col("updated_at").alias("last_change")))


@query("last_analysis_per_symbol", "J14 K18",
       """SELECT symbol, report_id, CASE WHEN report_id IS NULL THEN run_id END AS run_id, strftime(coalesce(rep, run), '%Y-%m-%d %H:%M:%S') AS analysis_date FROM (SELECT DISTINCT c_custkey % 150 AS symbol FROM customer)
          LEFT JOIN (SELECT l_suppkey % 100 AS symbol, l_orderkey AS report_id, CAST(l_shipdate AS TIMESTAMP) AS rep FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey % 100 ORDER BY l_shipdate DESC, l_orderkey DESC) = 1) USING (symbol)
          LEFT JOIN (SELECT user_id % 150 AS symbol, event_id AS run_id, ts AS run FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 150 ORDER BY ts DESC, event_id DESC) = 1) USING (symbol)""")
def last_analysis_per_symbol(spark, sf):
    """Reports on the first hundred symbols, runs on all."""
    q = src.load(spark, sf, "customer").select((F.col("c_custkey") % 150).alias("symbol")).distinct()
    rep = src.load(spark, sf, "lineitem").select((F.col("l_suppkey") % 100).alias("symbol"), F.col("l_orderkey").alias("report_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    runs = src.load(spark, sf, "events").select(F.array(F.col("user_id") % 150).alias("tickers"), F.col("event_id").alias("run_id"), F.col("ts").alias("completed_at"))
    return present(J.last_analysis(q, rep, runs))


@query("memory_recall", "K16", "SELECT doc_id AS id FROM documents WHERE contains(upper(replace(text, 'ß', 'SS')), 'LICENSE') ORDER BY (doc_id % 10) / 10.0 DESC, doc_id LIMIT 50")
def memory_recall(spark, sf):
    m = src.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), ((F.col("doc_id") % 10) / 10.0).alias("importance"))
    return present(J.recall_symbol(m, "license").select("id"))


@query("similar_memories", "T14 X11",
       """SELECT n.doc_id AS new_id, existing_id FROM toks n LEFT JOIN (SELECT a AS doc_id, arg_min(m.doc_id, m.rn) AS existing_id FROM cand JOIN toks x ON x.doc_id = a JOIN toks m ON m.doc_id = b
          WHERE len(list_intersect(m.tok, x.tok)) / greatest(len(m.tok), len(x.tok))::DOUBLE >= 0.8::DOUBLE - 1e-9 GROUP BY 1) USING (doc_id)""",
       {"toks": r"SELECT doc_id, lang, list_distinct([x for x in regexp_split_to_array(lower(trim(text, ' ')), '\s+') if length(x) > 0]) AS tok, row_number() OVER (ORDER BY (doc_id * 7) % 13 DESC, doc_id) AS rn FROM documents",
        "each": "SELECT doc_id, lang, len(tok) AS n, unnest(tok) AS t FROM toks",
        "freq": "SELECT lang, t, count(*) AS df FROM each GROUP BY 1, 2",
        "pre": "SELECT doc_id, lang, n, t FROM each JOIN freq USING (lang, t) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY df, t) <= n - ceil(0.8::DOUBLE * n - 1e-9) + 1",
        "cand": "SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM pre p JOIN pre q ON p.lang = q.lang AND p.t = q.t WHERE least(p.n, q.n) >= 0.8::DOUBLE * greatest(p.n, q.n) - 1e-9"})
def similar_memories(spark, sf):
    d = src.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("content"), ((F.col("doc_id") * 7) % 13).alias("importance"))
    return present(J.similar_memory(d, d).select("new_id", "existing_id"))


@query("top_insights", "A14", "SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def top_insights(spark, sf):
    m = src.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("importance"))
    return present(J.top_insights(m).select("id"))
