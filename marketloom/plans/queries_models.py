"""Folds, panel models, scoring, registry and run-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as ME
from ..operators import model_features as MF
from ..operators import models as M
from ..operators import technical as T
from ..operators.series import blocked, full, lag, latest
from ..session import cut_lineage
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_metrics import RETS
from .queries_technical import K, LAG, over, roll

FEATS = ["r1", "r5", "r20", "rv20", "vol_z"]


def panel(spark, sf):
    """Five features and the five-bar direction per bar."""
    b = blocked(src.bars_daily(spark, sf), back=22, ahead=5)
    b.stage({f"r{h}": F.try_divide(F.col("close"), lag(b, "close", h)) - 1.0 for h in (1, 5, 20)})
    b.stage({"rv20": full(b, F.col("r1"), 20, F.stddev_samp), "vol_z": F.col("volume") / (full(b, F.col("volume"), 20, F.avg) + 1.0),
             "y": (F.lead("close", 5).over(b.window) > F.col("close")).cast("int"), "fwd": F.lead("close", 5).over(b.window) / F.col("close") - 1.0})
    # fitting passes over the panel many times, so it is stored once
    return cut_lineage(b.owned().select("symbol", "timestamp", *FEATS, "y", "fwd").dropna("any"))


@query("walk_forward_fold_sizes", "L2 L7",
       """SELECT CAST(CASE WHEN ix < n - 5 * (n // 6) THEN 0 ELSE (ix - (n - 5 * (n // 6))) // (n // 6) + 1 END AS BIGINT) AS fold, count(*) AS rows, count(DISTINCT b.ts) AS stamps FROM bars b JOIN (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS ix, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)) d ON d.ts = b.ts GROUP BY 1""")
def walk_forward_fold_sizes(spark, sf):
    d = M.walk_forward_folds(src.closes_daily(spark, sf), 5)
    return present(d.groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("timestamp").alias("stamps")))


@query("time_split_sizes", "L1", "SELECT symbol, count(*) FILTER (ix < floor(n * 0.8)) AS train_rows, count(*) FILTER (ix >= floor(n * 0.8)) AS test_rows FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ix, count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY 1")
def time_split_sizes(spark, sf):
    d = M.time_split(src.closes_daily(spark, sf))
    return present(d.groupBy("symbol").agg(F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train")).alias("test_rows")))


@query("data_window", "A15", f"SELECT symbol, count(*) AS rows, {ts('min(ts)', 'start')}, {ts('max(ts)', 'end')}, 5::BIGINT AS horizon FROM bars GROUP BY 1")
def data_window(spark, sf):
    return present(M.data_window(src.closes_daily(spark, sf), ["symbol"]))


@query("walk_forward_predictions", "L2 L4 L6 L7")
def walk_forward_predictions(spark, sf):
    d = M.walk_forward(panel(spark, sf), FEATS, "y", 3, "logistic", maxIter=20)
    return present(d.groupBy("fold").agg(F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"), F.avg("probability").alias("mean_probability")))


@query("grid_search_folds", "L5")
def grid_search_folds(spark, sf):
    """Scores of every penalty on three time folds; tests compare them with single fits."""
    d = M.walk_forward_folds(panel(spark, sf), 3)
    return present(M.logistic_grid(d, FEATS, "y", [s["regParam"] for s in M.GRIDS["logistic"]], 3))


@query("calibrated_panel_model", "L4 L8 L9 L10 L13 L15")
def calibrated_panel_model(spark, sf):
    d = panel(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp")
    m = M.fit(d.filter(F.col("timestamp") < cut), FEATS, "y", "logistic", maxIter=20)
    s = M.score(m, d.filter(F.col("timestamp") >= cut)).withColumnRenamed("y", "y_true")
    cal = M.fit_platt(s) or {"coef": None, "intercept": None}
    s = s.withColumn("probability", ME.apply_platt("probability", F.lit(cal["coef"]), F.lit(cal["intercept"]))).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    return present(ME.classification_metrics(s.withColumn("model", F.lit("panel")), ["model"]))


@query("forest_model_scores", "L4 L15 L19 K14")
def forest_model_scores(spark, sf):
    d = panel(spark, sf)
    cut = F.lit("2000-01-01").cast("timestamp")
    m = M.fit(d.filter(F.col("timestamp") < cut), FEATS, "y", "random_forest", numTrees=10, maxDepth=5)
    return present(M.historical_scores(M.score(m, d.filter(F.col("timestamp") >= cut)), ["symbol"], "y"))


@query("historical_scores", "L19",
       f"""SELECT symbol, count(*) AS total, count(*) FILTER (pr = y) AS correct, {rd('avg(CAST(pr = y AS INT))', 'accuracy')}, {rd('coalesce(sum(pr * y) / nullif(sum(pr), 0)::DOUBLE, 0)', 'precision')}, {rd('coalesce(sum(pr * y) / nullif(sum(y), 0)::DOUBLE, 0)', 'recall')}
         FROM (SELECT symbol, CAST(p >= 0.5 AS INT) AS pr, CAST(nxt > 0 AS INT) AS y FROM pp) GROUP BY 1""", {k: RETS[k] for k in ("rr", "pp")})
def historical_scores(spark, sf):
    from .queries_metrics import signal_returns

    d = signal_returns(spark, sf).withColumns({"prediction": (F.col("probability") >= 0.5).cast("int"), "y": (F.col("realized_return") > 0).cast("int")})
    return present(M.historical_scores(d, ["symbol"], "y"))


@query("sequence_windows", "L22",
       f"""SELECT {K}, 60::BIGINT AS steps, {rd('list_sum(xs)', 'x_sum', 4)}, {rd('xs[1]', 'x_first')}, {rd('xs[60]', 'x_last')}, {rd('close', 'y')} FROM (SELECT *, list(close) {over(60, True)} AS xs FROM bars) WHERE len(xs) = 60""")
def sequence_windows(spark, sf):
    d = M.sequence_windows(src.bars_daily(spark, sf), ["close", "volume"], "close")
    x = F.transform("x", lambda r: r[0])
    d = d.select("symbol", "timestamp", F.size("x").alias("steps"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 4).alias("x_sum"), x[0].alias("x_first"), x[59].alias("x_last"), "y")
    return present(d)


@query("lookahead_check", "L3 E10", "SELECT 0::BIGINT AS violations")
def lookahead_check(spark, sf):
    """Trend, momentum and volatility features on truncated histories."""
    def gen(bars):
        b = blocked(bars, back=T.PLUGIN_BACK["trend"]).indexed()
        T.momentum(b)
        T.volatility(b)
        T.structure(b)
        return b.owned()

    v = M.lookahead_violations(src.bars_daily(spark, sf), gen, ["rsi_w14", "stoch_d_w14_s3", "atr_w14", "boll_pos_w20_k2", "dist_to_high_w20"], cuts=3, tol=1e-7)
    return present(v.agg(F.count("*").alias("violations")))


@query("prediction_labels", "L6 L17 L20",
       f"""SELECT doc_id, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS prediction_label, {rd('greatest(p, 1 - p)', 'confidence')}, CASE WHEN p >= 0.7 THEN 'STRONG_BUY' WHEN p >= 0.55 THEN 'BUY' WHEN p <= 0.3 THEN 'STRONG_SELL' WHEN p <= 0.45 THEN 'SELL' ELSE 'NEUTRAL' END AS strength,
         CASE WHEN greatest(p, 1 - p) < 0.55 THEN 'NO_TRADE' WHEN p >= 0.6 THEN 'BUY' WHEN p <= 0.4 THEN 'SELL' ELSE 'HOLD' END AS decision FROM (SELECT doc_id, probability::DOUBLE AS p FROM preds)""")
def prediction_labels(spark, sf):
    p = src.predictions(spark, sf)
    d = p.select("doc_id", "probability", *[v.alias(k) for k, v in M.prediction_row("probability").items() if k != "prediction"])
    return present(d.select("doc_id", "prediction_label", "confidence", M.signal_strength("probability").alias("strength"), M.trade_decision("probability", "confidence").alias("decision")))


@query("ensemble_vote", "L16",
       f"""SELECT symbol, {rd('sum(prediction * w)', 'ensemble_score')}, {rd('sum(pu * w)', 'probability_up')}, count(*) AS models_used, CAST(sum(prediction * w) > 0.5 AS BIGINT) AS prediction, {rd('greatest(sum(pu * w), 1 - sum(pu * w))', 'confidence')} FROM (
         SELECT printf('S%05d', l_suppkey) AS symbol, l_returnflag, CASE l_returnflag WHEN 'A' THEN 0.5 WHEN 'N' THEN 0.3 ELSE 0.2 END AS w, CAST(avg(l_discount) >= 0.05 AS INT) AS prediction, avg(l_discount) * 10 AS pu FROM lineitem WHERE NOT (l_suppkey % 10 = 0 AND l_returnflag = 'R') GROUP BY l_suppkey, l_returnflag) GROUP BY 1""")
def ensemble_vote(spark, sf):
    li = src.load(spark, sf, "lineitem").filter(~((F.col("l_suppkey") % 10 == 0) & (F.col("l_returnflag") == "R")))
    m = li.groupBy(src.symbol_of(F.col("l_suppkey")).alias("symbol"), F.col("l_returnflag").alias("model")).agg((F.avg("l_discount") >= 0.05).cast("int").alias("prediction"), (F.avg("l_discount") * 10.0).alias("probability_up"))
    w = spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "model string, weight double")
    return present(M.ensemble(m, w))


@query("prediction_sources", "L28",
       f"""SELECT symbol, coalesce(a.s, b.s) AS source, {rd('coalesce(a.p, b.p)', 'probability_up')}, {rd('greatest(coalesce(a.p, b.p), 1 - coalesce(a.p, b.p))', 'confidence')}, CASE WHEN coalesce(a.s, b.s) IS NULL THEN 'failed' ELSE 'ok' END AS status FROM (SELECT DISTINCT user_id AS symbol FROM events) u
         LEFT JOIN (SELECT user_id AS symbol, 'sequence' AS s, avg(value) / 500 AS p FROM events WHERE event_type = 'purchase' AND user_id % 3 = 0 GROUP BY 1) a USING (symbol) LEFT JOIN (SELECT user_id AS symbol, 'direction' AS s, avg(value) / 500 AS p FROM events WHERE event_type = 'view' AND user_id % 3 < 2 GROUP BY 1) b USING (symbol)""")
def prediction_sources(spark, sf):
    e = src.load(spark, sf, "events")
    u = F.col("user_id")
    side = lambda t, cond, s: e.filter((F.col("event_type") == t) & cond).groupBy(u.alias("symbol")).agg((F.avg("value") / 500.0).alias("probability_up")).withColumns({"source": F.lit(s), "confidence": F.lit(None).cast("double")})
    preds = side("purchase", u % 3 == 0, "sequence").unionByName(side("view", u % 3 < 2, "direction"))
    return present(M.prefer_source(e.select(u.alias("symbol")).distinct(), preds, ["sequence", "direction", "symbol"]))


@query("prediction_actuals", "L27 DB13",
       f"SELECT symbol, count(*) AS n, count(*) FILTER (a IS NOT NULL) AS resolved, {rd('avg(CAST(a = pr AS INT))', 'accuracy')} FROM (SELECT symbol, CAST(close > 115 AS INT) AS pr, CASE WHEN lead(close, 5) {LAG} IS NOT NULL THEN CAST(lead(close, 5) {LAG} > close AS INT) END AS a FROM bars) GROUP BY 1")
def prediction_actuals(spark, sf):
    c = src.closes_daily(spark, sf)
    d = M.fill_actual(c.select("symbol", "timestamp", (F.col("close") > 115).cast("int").alias("prediction")), c)
    return present(d.groupBy("symbol").agg(F.count("*").alias("n"), F.count("actual").alias("resolved"), F.avg(F.col("is_correct").cast("double")).alias("accuracy")))


@query("prediction_trace", "L21 L18 Q18")
def prediction_trace(spark, sf):
    f = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    names = ["rsi_14", "roc_5", "hvol_20", "price_sma20_ratio", "price_sma50_ratio", "price_sma200_ratio"]
    s = f.select("symbol", "timestamp", *names, F.greatest(F.least(0.5 + F.col("roc_5") * 5.0, F.lit(0.99)), F.lit(0.01)).alias("probability"))
    req = src.load(spark, sf, "supplier").select(src.symbol_of(F.col("s_suppkey")).alias("symbol"), F.lit("2000-06-30 12:00:00").cast("timestamp").alias("timestamp"))
    d = M.inspect(req, s, names)
    return present(d.select("symbol", "timestamp", "resolved", "probability_up", "decision", "label", M.signal_context().alias("ctx")).select("symbol", "timestamp", "resolved", "probability_up", "decision", "label", "ctx.trend", "ctx.volatility"))


def registry_events(spark, sf):
    o = src.load(spark, sf, "orders")
    return o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 30).cast("string")).alias("model_name"), F.format_string("v%04d", (F.col("o_orderkey") % 7).cast("int")).alias("version"),
                    F.when(F.col("o_orderstatus") == "F", "status").otherwise("register").alias("event"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("status"),
                    (F.unix_timestamp("o_orderdate") * 10000000 + F.col("o_orderkey")).alias("at"))


REG = {"ev": "SELECT 'm' || CAST(o_custkey % 30 AS VARCHAR) AS model_name, printf('v%04d', o_orderkey % 7) AS version, o_orderstatus <> 'F' AS reg, CASE WHEN o_orderstatus = 'F' THEN 'retired' ELSE 'active' END AS status, epoch(o_orderdate)::BIGINT * 10000000 + o_orderkey AS seen FROM orders",
       "nw": "SELECT model_name, arg_max(version, seen) AS newest FROM ev WHERE reg GROUP BY 1",
       "st": "SELECT e.model_name, version, CASE WHEN arg_max(status, seen) = 'active' AND version <> any_value(newest) THEN 'superseded' ELSE arg_max(status, seen) END AS status, max(seen) AS seen FROM ev e JOIN nw USING (model_name) GROUP BY 1, 2"}


@query("model_registry_state", "L26 X10", "SELECT model_name, version, status FROM st", REG)
def model_registry_state(spark, sf):
    return present(M.registry_state(registry_events(spark, sf)).select("model_name", "version", "status"))


@query("model_registry_best", "L26 K19 X10",
       "SELECT b.model_name, b.version, b.status, n.next_version FROM (SELECT model_name, arg_max(version, k) AS version, arg_max(status, k) AS status FROM (SELECT *, CASE WHEN status = 'active' THEN 1 ELSE 0 END * 10000000000000000000::HUGEINT + seen AS k FROM st) GROUP BY 1) b JOIN (SELECT model_name, printf('v%04d', max(CAST(version[2:] AS INTEGER)) + 1) AS next_version FROM st GROUP BY 1) n USING (model_name)", REG)
def model_registry_best(spark, sf):
    st = M.registry_state(registry_events(spark, sf))
    return present(M.best_model(st).join(M.next_version(st), "model_name"))


def run_documents(spark, sf):
    """One run document per supplier, in the new or the camel-case spelling."""
    li = src.load(spark, sf, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.round(F.avg("l_discount") * 10.0, 4).alias("f1"), F.round(F.avg("l_tax") * 30.0, 4).alias("sharpe"), F.round(F.max("l_discount"), 4).alias("dd"), F.count("*").alias("n"))
    rid = F.format_string("run%05d", "l_suppkey")
    metrics = F.to_json(F.struct(F.struct(F.col("f1")).alias("classification"), F.when(F.col("l_suppkey") % 4 != 0, F.struct(F.col("sharpe"), F.col("dd").alias("max_drawdown"))).alias("trading")))
    snake = F.concat(F.lit('{"run_id":"'), rid, F.lit('","run_summary":{"status":"completed"},"metrics_summary":'), metrics, F.lit("}"))
    camel = F.concat(F.lit('{"run_id":"'), rid, F.lit('","status":"failed","RunSummary":{},"MetricsSummary":'), metrics, F.lit("}"))
    return g.select("l_suppkey", F.when(F.col("l_suppkey") % 2 == 0, snake).otherwise(camel).alias("doc"))


RUN = {"rd": "SELECT l_suppkey, round(avg(l_discount) * 10.0, 4) AS f1, CASE WHEN l_suppkey % 4 <> 0 THEN round(avg(l_tax) * 30.0, 4) END AS sharpe, CASE WHEN l_suppkey % 4 <> 0 THEN max(l_discount) END AS dd FROM lineitem GROUP BY 1"}


@query("run_table", "L23 L24 S10", f"SELECT printf('run%05d', l_suppkey) AS run_id, CASE WHEN l_suppkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, 5::BIGINT AS horizon, {rd('f1', 'f1')}, {rd('sharpe', 'sharpe')}, {rd('coalesce(sharpe, f1)', 'primary_score')} FROM rd", RUN)
def run_table(spark, sf):
    return present(M.run_table(run_documents(spark, sf)).select("run_id", "status", "horizon", "f1", "sharpe", "primary_score"))


@query("best_runs", "K13 L23",
       "SELECT (SELECT printf('run%05d', l_suppkey) FROM rd ORDER BY f1 DESC, l_suppkey DESC LIMIT 1) AS best_f1_run, (SELECT printf('run%05d', l_suppkey) FROM rd WHERE sharpe IS NOT NULL ORDER BY sharpe DESC, l_suppkey DESC LIMIT 1) AS best_sharpe_run, (SELECT printf('run%05d', l_suppkey) FROM rd WHERE dd IS NOT NULL ORDER BY dd, l_suppkey LIMIT 1) AS lowest_drawdown_run", RUN)
def best_runs(spark, sf):
    return present(M.best_runs(M.run_table(run_documents(spark, sf))))


@query("run_sections", "L29 L24", "SELECT l_suppkey, t AS type FROM (SELECT l_suppkey, unnest(CASE WHEN l_suppkey % 2 = 0 THEN ['run_summary', 'metrics_summary'] ELSE ['metrics_summary'] END) AS t FROM rd)", RUN)
def run_sections(spark, sf):
    return present(M.run_sections(run_documents(spark, sf)).select("l_suppkey", "type"))


@query("reproducibility_scores", "L25", "SELECT o_orderkey, CAST(round((CAST(a AS INT) + CAST(b AS INT) + CAST(a AND b AS INT)) * 100.0 / 3) AS BIGINT) AS score FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS a, o_orderstatus = 'F' AS b FROM orders)")
def reproducibility_scores(spark, sf):
    o = src.load(spark, sf, "orders")
    k = F.col("o_orderkey")
    return present(M.reproducibility(o.select("o_orderkey", (k % 2 == 0).alias("has_config"), (k % 3 != 0).alias("has_dependencies"), (k % 5 != 0).alias("has_hashes"), (F.col("o_orderstatus") == "F").alias("hashes_resolvable"))).select("o_orderkey", "score"))


@query("signal_feature_ranking", "E12")
def signal_feature_ranking(spark, sf):
    d = MF.model_frame(src.bars_daily(spark, sf), horizon=None)
    n = latest(d, ["symbol"], ["timestamp"])
    return present(MF.rank_signal_features(n).select("symbol", F.array_join("signal_features", ",").alias("features")))


@query("regime_model", "R4")
def regime_model(spark, sf):
    """Logistic trend model on the six regime inputs, pooled over symbols."""
    from ..operators import macro as MC
    from ..operators import regime as R

    d = R.regime_inputs(MC.with_macro_levels(src.closes_daily(spark, sf), src.macro(spark, sf)))
    cols = ["trend_return", "realized_vol", "vol_proxy", "credit_z", "dollar_z", "rotation_z"]
    d = d.select("symbol", "timestamp", *cols).dropna("any").withColumn("y", (F.abs("trend_return") >= 0.03).cast("int"))
    d = cut_lineage(d)
    m = M.fit(d, cols, "y", "logistic", maxIter=20)
    s = M.score(m, d)
    return present(s.groupBy("symbol").agg(F.count("*").alias("rows"), F.avg((F.col("probability") >= 0.5).cast("double")).alias("trend_share")))
