"""Evaluation, calibration and drift over predictions and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import metrics as ME
from ..operators.series import DAY, Layout
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_technical import LAG

ONE_MODEL = Layout(keys=("model",), ties=("doc_id",), span=DAY)


def preds(spark, sf):
    return src.predictions(spark, sf).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")))


PM = {"pm": "SELECT *, 'm' || CAST(doc_id % 3 AS VARCHAR) AS model, least(greatest(probability, 1e-6), 1 - 1e-6) AS p FROM preds"}
_E = ME.bin_edges(10)
_BIN = "least(greatest(" + " + ".join(f"CAST(p > {e!r}::DOUBLE AS INT)" for e in _E) + " - 1, 0), 9)"
REL = {**PM, "pb": f"SELECT *, {_BIN} AS b FROM pm",
       "edges": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_E[i]!r}::DOUBLE, {_E[i + 1]!r}::DOUBLE)" for i in range(10)) + ") t(b, lo, hi)",
       "curve": """SELECT m.model, e.b AS bin, lo AS bin_low, hi AS bin_high, count(pb.p)::DOUBLE AS count, coalesce(avg(pb.p), 0) AS mean_predicted, coalesce(avg(pb.y_true), 0) AS observed_frequency
         FROM (SELECT DISTINCT model FROM pm) m CROSS JOIN edges e LEFT JOIN pb ON pb.model = m.model AND pb.b = e.b GROUP BY ALL"""}


@query("reliability_curve", "L11", f"SELECT model, CAST(bin AS BIGINT) AS bin, {rds('bin_low bin_high count mean_predicted observed_frequency')} FROM curve", REL)
def reliability_curve(spark, sf):
    return present(ME.reliability_curve(preds(spark, sf), ["model"]))


@query("classification_metrics", "L10 L6",
       f"""SELECT c.model, samples, {rds('brier_score accuracy precision recall f1 roc_auc calibration_error')} FROM (
         SELECT model, count(*) AS samples, avg(pow(p - y_true, 2)) AS brier_score, avg(CAST(y_true = prediction AS INT)) AS accuracy,
           coalesce(sum(y_true * prediction) / nullif(sum(prediction), 0)::DOUBLE, 0) AS precision, coalesce(sum(y_true * prediction) / nullif(sum(y_true), 0)::DOUBLE, 0) AS recall,
           coalesce(2.0 * sum(y_true * prediction) / nullif(sum(y_true) + sum(prediction), 0), 0) AS f1 FROM pm GROUP BY 1) c
         LEFT JOIN (SELECT a.model, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS roc_auc FROM pm a JOIN pm b ON a.model = b.model AND a.y_true = 1 AND b.y_true = 0 GROUP BY 1) u ON u.model = c.model
         LEFT JOIN (SELECT model, sum(abs(mean_predicted - observed_frequency) * count) / sum(count) AS calibration_error FROM curve GROUP BY 1) e ON e.model = c.model""", REL)
def classification_metrics(spark, sf):
    return present(ME.classification_metrics(preds(spark, sf), ["model"]))


@query("calibrated_probabilities", "L9",
       f"SELECT doc_id, {rd('least(greatest(1 / (1 + exp(-(1.7 * p - 0.4))), 1e-6), 1 - 1e-6)', 'calibrated')} FROM pm", PM)
def calibrated_probabilities(spark, sf):
    return present(preds(spark, sf).select("doc_id", ME.apply_platt("probability", F.lit(1.7), F.lit(-0.4)).alias("calibrated")))


@query("rolling_oos_metrics", "D5",
       f"""SELECT model, {ts('ts')}, {rds('accuracy precision recall f1 roc_auc brier_score calibration_error')}, 40::BIGINT AS sample_size FROM (
         SELECT e.model, e.ts, e.ix, avg(CAST(w.y_true = w.prediction AS INT)) AS accuracy, coalesce(sum(w.y_true * w.prediction) / nullif(sum(w.prediction), 0)::DOUBLE, 0) AS precision,
           coalesce(sum(w.y_true * w.prediction) / nullif(sum(w.y_true), 0)::DOUBLE, 0) AS recall, coalesce(2.0 * sum(w.y_true * w.prediction) / nullif(sum(w.y_true) + sum(w.prediction), 0), 0) AS f1,
           avg(pow(w.p - w.y_true, 2)) AS brier_score, (SELECT sum(abs(g)) / 40.0 FROM (SELECT sum(z.p - z.y_true) AS g FROM ob z WHERE z.model = e.model AND z.ix BETWEEN e.ix - 39 AND e.ix GROUP BY z.b)) AS calibration_error,
           (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM ob a, ob b WHERE a.model = e.model AND b.model = e.model AND a.y_true = 1 AND b.y_true = 0
              AND a.ix BETWEEN e.ix - 39 AND e.ix AND b.ix BETWEEN e.ix - 39 AND e.ix) AS roc_auc
         FROM ob e JOIN ob w ON w.model = e.model AND w.ix BETWEEN e.ix - 39 AND e.ix WHERE e.ix >= 40 AND (e.ix - 40) % 10 = 0 GROUP BY e.model, e.ts, e.ix)""",
       {**REL, "ob": "SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts, doc_id) AS ix FROM pb"})
def rolling_oos_metrics(spark, sf):
    return present(ME.rolling_metrics(preds(spark, sf), window=40, step=10, layout=ONE_MODEL))


@query("performance_alerts", "D6")
def performance_alerts(spark, sf):
    r = ME.rolling_metrics(preds(spark, sf), window=40, layout=ONE_MODEL)
    return present(D.performance_alerts(r, ["model"]).select("model", "timestamp", "accuracy", "alerts", "alert"))


RETS = {
    "rr": f"SELECT symbol, ts, close / lag(close, 5) {LAG} - 1 AS r5, lead(close) {LAG} / close - 1 AS nxt FROM bars",
    "pp": "SELECT symbol, ts, nxt, 0.5 + greatest(least(r5 * 20, 0.49), -0.49) AS p FROM rr WHERE r5 IS NOT NULL AND nxt IS NOT NULL",
    "po": "SELECT *, CASE WHEN p >= 0.6 THEN 1.0 WHEN p <= 0.4 THEN -1.0 ELSE 0.0 END AS pos FROM pp",
    "pc": f"SELECT *, abs(pos - coalesce(lag(pos) {LAG}, 0)) AS chg FROM po",
    "pn": "SELECT *, pos * nxt AS gross, chg * 0.0007 AS cost, pos * nxt - chg * 0.0007 AS net FROM pc",
    "pe": "SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM pn",
    "pk": "SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM pe",
}


def signal_returns(spark, sf):
    """A momentum probability per bar and the next bar's return."""
    from ..operators.series import blocked, lag

    b = blocked(src.closes_daily(spark, sf), back=5, ahead=1)
    b.stage({"_r5": lag(b, "close", 0) / lag(b, "close", 5) - 1.0, "realized_return": F.lead("close", 1).over(b.window) / F.col("close") - 1.0})
    d = b.owned().filter("_r5 is not null and realized_return is not null")
    return d.select("symbol", "timestamp", "realized_return", (0.5 + F.greatest(F.least(F.col("_r5") * 20.0, F.lit(0.49)), F.lit(-0.49))).alias("probability"))


TRADE_COLS = "cagr sharpe sortino max_drawdown profit_factor win_rate average_win average_loss exposure turnover gross_pnl net_pnl cost_total trades total_return".split()


@query("trading_metrics", "L13 B6 L14",
       f"""SELECT symbol, {rds(TRADE_COLS)}, {rd('sharpe - greatest(max_drawdown - 0.2, 0) * 10 - CASE WHEN trades < 20 THEN 0.5 ELSE 0 END + 0.1 * win_rate', 'primary_score')} FROM (
         SELECT symbol, pow(product(1 + net), 252.0 / count(*)) - 1 AS cagr, avg(net) / stddev_pop(net) * sqrt(252.0) AS sharpe, avg(net) / (stddev_pop(net) FILTER (net < 0)) * sqrt(252.0) AS sortino,
           abs(min(eq / peak - 1)) AS max_drawdown, (sum(net) FILTER (pos <> 0 AND net > 0)) / abs(sum(net) FILTER (pos <> 0 AND net < 0)) AS profit_factor,
           avg(CAST(net > 0 AS INT)) FILTER (pos <> 0) AS win_rate, avg(net) FILTER (pos <> 0 AND net > 0) AS average_win, avg(net) FILTER (pos <> 0 AND net < 0) AS average_loss,
           avg(abs(pos)) AS exposure, avg(chg) AS turnover, sum(gross) AS gross_pnl, sum(net) AS net_pnl, sum(cost) AS cost_total, sum(chg) AS trades, product(1 + net) - 1 AS total_return FROM pk GROUP BY 1)""", RETS)
def trading_metrics(spark, sf):
    m = ME.trading_metrics(ME.trading_curve(signal_returns(spark, sf)), ["symbol"])
    return present(m.withColumn("primary_score", ME.primary_score("sharpe", "win_rate", "max_drawdown", "trades", "win_rate")))


@query("regression_metrics", "L12",
       f"""SELECT symbol, {rd('avg(abs(y - q))', 'mae')}, {rd('sqrt(avg(pow(y - q, 2)))', 'rmse')}, {rd('avg(abs((y - q) / y)) FILTER (abs(y) > 1e-8)', 'mape', 2)}, {rd('avg(CAST(sign(y) = sign(q) AS INT))', 'directional_accuracy')},
         {rd('corr(y, q)', 'correlation')}, """ + ", ".join(rd(f"coalesce(avg(CAST(sign(y) = sign(q) AS INT)) FILTER (abs(q) >= {h}), 0)", f"hit_rate_{h:.4f}".replace(".", "_")) for h in (0.0, 0.005, 0.01)) +
       " FROM (SELECT symbol, nxt AS y, (p - 0.5) / 20 AS q FROM pp) GROUP BY 1", {k: RETS[k] for k in ("rr", "pp")})
def regression_metrics(spark, sf):
    d = signal_returns(spark, sf).withColumn("q", (F.col("probability") - 0.5) / 20.0)
    return present(ME.regression_metrics(d, ["symbol"], "realized_return", "q").withColumn("mape", F.round("mape", 2)))


def drift_sides(spark, sf):
    b = src.bars_daily(spark, sf).select("symbol", "timestamp", "close", "volume", (F.col("high") - F.col("low")).alias("spread"),
                                         (F.col("close") + F.month("timestamp") * 0.1).alias("shifted"))
    cut = F.lit("2000-01-01").cast("timestamp")
    return b.filter(F.col("timestamp") < cut), b.filter(F.col("timestamp") >= cut).withColumn("shifted", F.col("shifted") + 2.0)


FEATS = ["close", "volume", "spread", "shifted"]
DR = {
    "db": "SELECT ts, close, volume, high - low AS spread, close + month(ts) * 0.1 + CASE WHEN ts >= TIMESTAMP '2000-01-01' THEN 2.0 ELSE 0.0 END AS shifted, CAST(ts >= TIMESTAMP '2000-01-01' AS INT) AS live FROM bars",
    "lg": " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, live FROM db" for f in FEATS),
    "tot": "SELECT feature, sum(1 - live) AS n1, sum(live) AS n2, avg(value) FILTER (live = 0) AS m0, stddev_pop(value) FILTER (live = 0) AS s0, avg(value) FILTER (live = 1) AS m1 FROM lg GROUP BY 1",
    "dv": "SELECT feature, value, sum(1 - live) AS a, sum(live) AS b FROM lg GROUP BY 1, 2",
    "cum": "SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM dv WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)",
    "ks": "SELECT c.feature, max(abs(ca / n1::DOUBLE - cb / n2::DOUBLE)) AS d FROM cum c JOIN tot t ON t.feature = c.feature GROUP BY 1",
    "qe": "SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS e FROM lg WHERE live = 0 GROUP BY 1",
    "bn": "SELECT l.feature, len([x for x in e[2:-2] if x <= value]) AS b, sum(1 - live) AS r, sum(live) AS c FROM lg l JOIN qe ON qe.feature = l.feature GROUP BY 1, 2",
    "ps": "SELECT b.feature, sum((greatest(c / n2::DOUBLE, 1e-6) - greatest(r / n1::DOUBLE, 1e-6)) * ln(greatest(c / n2::DOUBLE, 1e-6) / greatest(r / n1::DOUBLE, 1e-6))) AS psi FROM bn b JOIN tot t ON t.feature = b.feature GROUP BY 1",
    "rep": """SELECT t.feature, CAST(n1 AS BIGINT) AS train_samples, CAST(n2 AS BIGINT) AS live_samples, d AS ks_stat, least(1.0, 2 * exp(-2 * pow(sqrt(n1 * n2 / (n1 + n2)::DOUBLE) * d, 2))) AS ks_pvalue, psi, (m1 - m0) / (s0 / sqrt(n2)) AS zscore_shift
       FROM tot t JOIN ks ON ks.feature = t.feature JOIN ps ON ps.feature = t.feature""",
    "lev": "SELECT *, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR (ks_stat >= 0.15 AND ks_pvalue <= 0.01) OR abs(zscore_shift) >= 3 THEN 'warning' ELSE 'stable' END AS level FROM rep",
}


@query("drift_report", "D1 D2 D3 D4 J21 N5",
       f"SELECT feature, train_samples, live_samples, {rds('ks_stat ks_pvalue psi zscore_shift')}, level FROM lev", DR)
def drift_report(spark, sf):
    train, live = drift_sides(spark, sf)
    return present(D.drift_report(train, live).drop("reasons"))


@query("drift_summary", "D4",
       """SELECT count(*) AS total_features, count(*) FILTER (level = 'stable') AS stable_features, count(*) FILTER (level = 'warning') AS warning_features,
          count(*) FILTER (level = 'critical') AS critical_features, 0::BIGINT AS insufficient_features, count(*) FILTER (level <> 'stable') > 0 AS alert FROM lev""", DR)
def drift_summary(spark, sf):
    train, live = drift_sides(spark, sf)
    return present(D.drift_summary(D.drift_report(train, live)))


@query("retrain_decisions", "D7",
       """SELECT symbol, nullif(concat_ws(',', CASE WHEN age >= 30 THEN 'scheduled_retrain_due' END, CASE WHEN age >= 45 THEN 'max_model_age_exceeded' END,
            CASE WHEN lossy THEN 'live_performance_degradation' END), '') AS reasons, age >= 30 OR lossy AS retrain
          FROM (SELECT symbol, date_diff('second', max(ts), TIMESTAMP '2001-12-05') / 86400.0 AS age, avg(pnl) < 0 AS lossy FROM trades GROUP BY 1)""")
def retrain_decisions(spark, sf):
    m = src.trades(spark, sf).groupBy("symbol").agg(F.max("timestamp").alias("last_trained_at"), (F.avg("pnl") < 0).alias("performance_alert"))
    d = D.retrain_decision(m, "2001-12-05 00:00:00", D.RetrainingPolicy(cadence="monthly"))
    return present(d.select("symbol", F.when(F.size("reasons") > 0, F.array_join("reasons", ",")).alias("reasons"), "retrain"))


def signal_log(spark, sf):
    """Events of one kind as signals, and purchases as their outcomes."""
    e = src.load(spark, sf, "events")
    feats = F.array(F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string")), F.concat(F.lit("g"), (F.col("event_id") % 5).cast("string")))
    sig = e.filter("event_type in ('view', 'click')").select((F.col("event_id") % 1000).alias("signal_id"), F.col("ts").alias("timestamp"),
                                                             F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("regime"), feats.alias("top_features"))
    out = e.filter("event_type = 'purchase'").select((F.col("event_id") % 1000).alias("signal_id"), F.col("ts").alias("outcome_timestamp"), (F.col("value") - 70.0).alias("pnl"))
    return sig, out


SG = {
    "sig": """SELECT event_id % 1000 AS signal_id, max(ts) AS ts, arg_max(CASE WHEN user_id % 4 <> 0 THEN event_type ELSE 'unknown' END, ts) AS regime,
        arg_max(['f' || CAST(user_id % 7 AS VARCHAR), 'g' || CAST(event_id % 5 AS VARCHAR)], ts) AS feats FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""",
    "oc": "SELECT event_id % 1000 AS signal_id, arg_max(value, ts) - 70.0 AS pnl FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "pr": "SELECT s.*, o.pnl IS NOT NULL AS resolved, coalesce(o.pnl > 0, false) AS win FROM sig s LEFT JOIN oc o USING (signal_id)",
}


@query("signal_outcome_pairs", "J16 D8", f"SELECT signal_id, {ts('ts')}, resolved, win FROM pr", SG)
def signal_outcome_pairs(spark, sf):
    return present(D.pair_outcomes(*signal_log(spark, sf)).select("signal_id", "timestamp", "resolved", "win"))


@query("win_rate_by_regime", "A5", f"SELECT regime, count(*) AS count, {rd('avg(CAST(win AS INT))', 'win_rate')} FROM pr WHERE resolved GROUP BY 1", SG)
def win_rate_by_regime(spark, sf):
    return present(D.win_rate_by_regime(D.pair_outcomes(*signal_log(spark, sf))))


@query("win_rate_by_feature", "A6", f"SELECT feature, count(*) AS count, {rd('avg(CAST(win AS INT))', 'win_rate')} FROM (SELECT unnest(feats) AS feature, win FROM pr WHERE resolved) GROUP BY 1", SG)
def win_rate_by_feature(spark, sf):
    return present(D.win_rate_by_feature(D.pair_outcomes(*signal_log(spark, sf))))


@query("weekly_review", "D9")
def weekly_review(spark, sf):
    return present(D.weekly_review(*signal_log(spark, sf), "2024-01-14"))
