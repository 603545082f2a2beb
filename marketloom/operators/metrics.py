"""Evaluation: classification, calibration, regression and trading metrics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from .ordered import ordered_scan
from .series import DAILY, Layout, attach_row, blocked, lag, running

LOW, HIGH = 1e-6, 1 - 1e-6


def clamp(p) -> Column:
    return clip(p, LOW, HIGH)


def zero_div(a, b) -> Column:
    return F.coalesce(div(a, b), F.lit(0.0))


def confusion(y: Column, pred: Column) -> dict[str, Column]:
    return {"tp": F.sum(F.when((y == 1) & (pred == 1), 1).otherwise(0)), "fp": F.sum(F.when((y == 0) & (pred == 1), 1).otherwise(0)),
            "fn": F.sum(F.when((y == 1) & (pred == 0), 1).otherwise(0)), "tn": F.sum(F.when((y == 0) & (pred == 0), 1).otherwise(0))}


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, f1; an empty denominator counts as 0."""
    return {"accuracy": zero_div(tp + tn, tp + fp + fn + tn), "precision": zero_div(tp, tp + fp), "recall": zero_div(tp, tp + fn), "f1": zero_div(2 * tp, 2 * tp + fp + fn)}


def roc_auc(df: DataFrame, group: list[str], y: str = "y_true", p: str = "probability") -> DataFrame:
    """Mann-Whitney area with half credit for ties; NULL for one class."""
    s = ordered_scan(df.withColumn("_p", clamp(p)), group, "_p", {"pos": F.col(y).cast("bigint"), "neg": 1 - F.col(y).cast("bigint")})
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return s.groupBy(*group).agg(F.try_divide(won, (F.max("pos_total") * F.max("neg_total")).cast("double")).alias("roc_auc"))


def bin_edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_of(p: Column, bins: int) -> Column:
    """Right-closed equal bin of a clamped probability, zero based."""
    above = reduce(lambda a, b: a + b, [(p > e).cast("int") for e in bin_edges(bins)])
    return F.least(F.greatest(above - 1, F.lit(0)), F.lit(bins - 1))


def reliability_curve(df: DataFrame, group: list[str], y: str = "y_true", p: str = "probability", bins: int = 10) -> DataFrame:
    """All bins per group, empty ones as zeros: one combining aggregate."""
    e = bin_edges(bins)
    d = df.withColumn("_p", clamp(p)).withColumn("_b", bin_of(F.col("_p"), bins))
    parts = []
    for i in range(bins):
        hit = F.col("_b") == i
        parts.append(F.struct(
            F.lit(i).alias("bin"), F.lit(e[i]).alias("bin_low"), F.lit(e[i + 1]).alias("bin_high"), F.count_if(hit).cast("double").alias("count"),
            F.coalesce(F.avg(F.when(hit, F.col("_p"))), F.lit(0.0)).alias("mean_predicted"),
            F.coalesce(F.avg(F.when(hit, F.col(y).cast("double"))), F.lit(0.0)).alias("observed_frequency")).alias(f"_{i}"))
    one = d.groupBy(*group).agg(*parts)
    return one.select(*group, F.inline(F.array(*[F.col(f"_{i}") for i in range(bins)])))


def expected_calibration_error(curve: DataFrame, group: list[str]) -> DataFrame:
    gap = F.abs(F.col("mean_predicted") - F.col("observed_frequency")) * F.col("count")
    return curve.groupBy(*group).agg(F.try_divide(F.sum(gap), F.sum("count")).alias("calibration_error"))


def classification_metrics(df: DataFrame, group: list[str], y: str = "y_true", pred: str = "prediction", p: str = "probability", bins: int = 10) -> DataFrame:
    c = df.groupBy(*group).agg(
        *[v.alias(k) for k, v in confusion(F.col(y), F.col(pred)).items()],
        F.avg(F.pow(clamp(p) - F.col(y), 2.0)).alias("brier_score"), F.count("*").alias("samples"))
    out = c.select(*group, "samples", "brier_score", *[v.alias(k) for k, v in scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()])
    auc = roc_auc(df, group, y, p)
    ece = expected_calibration_error(reliability_curve(df, group, y, p, bins), group)
    return out.join(auc, group, "left").join(ece, group, "left") if group else attach_row(attach_row(out, auc), ece)


def regression_metrics(df: DataFrame, group: list[str], y: str, pred: str, thresholds: tuple[float, ...] = (0.0, 0.005, 0.01)) -> DataFrame:
    t, q = F.col(y), F.col(pred)
    same = (F.signum(t) == F.signum(q)).cast("double")
    aggs = [
        F.avg(F.abs(t - q)).alias("mae"), F.sqrt(F.avg(F.pow(t - q, 2.0))).alias("rmse"),
        F.avg(F.when(F.abs(t) > 1e-8, F.abs((t - q) / t))).alias("mape"), F.avg(same).alias("directional_accuracy"), F.corr(t, q).alias("correlation"),
    ]
    for h in thresholds:
        name = f"hit_rate_{h:.4f}".replace(".", "_")
        aggs.append(F.coalesce(F.avg(F.when(F.abs(q) >= h, same)), F.lit(0.0)).alias(name))
    return df.groupBy(*group).agg(*aggs)


def trading_curve(df: DataFrame, *, p: str = "probability", r: str = "realized_return", long_threshold: float = 0.6, short_threshold: float = 0.4,
                  cost_bps: float = 5.0, slippage_bps: float = 2.0, layout: Layout = DAILY) -> DataFrame:
    """Position, cost, net return, equity and its running peak per row."""
    q = clamp(p)
    pos = F.when(q >= long_threshold, 1.0).when(q <= short_threshold, -1.0).otherwise(0.0)
    b = blocked(df.withColumn("position", pos), layout, back=1)
    b.stage({"change": F.abs(F.col("position") - F.coalesce(lag(b, "position"), F.lit(0.0)))})
    d = b.owned()
    rate = (cost_bps + slippage_bps) / 10_000.0
    d = d.withColumns({"cost": F.col("change") * rate, "gross": F.col("position") * F.col(r)}).withColumn("net", F.col("gross") - F.col("cost"))
    d = running(d, {"equity": (1.0 + F.col("net"), "product")}, layout)
    return running(d, {"peak": (F.col("equity"), "max")}, layout)


def trading_metrics(curve: DataFrame, group: list[str], periods: int = 252) -> DataFrame:
    """Fifteen trading metrics per group from a `trading_curve`."""
    net, on = F.col("net"), F.col("position") != 0
    win, lose = on & (net > 0), on & (net < 0)
    a = curve.groupBy(*group).agg(
        F.count("*").alias("n"), F.product(1.0 + net).alias("eq"), F.avg(net).alias("mu"), F.stddev_pop(net).alias("sd"),
        F.stddev_pop(F.when(net < 0, net)).alias("dsd"), F.min(F.col("equity") / F.col("peak") - 1.0).alias("dd"),
        F.sum(F.when(win, net)).alias("gw"), F.sum(F.when(lose, net)).alias("gl"), F.avg(F.when(win, net)).alias("aw"), F.avg(F.when(lose, net)).alias("al"),
        F.avg(F.when(on, (net > 0).cast("double"))).alias("wr"), F.avg(F.abs("position")).alias("exposure"), F.avg("change").alias("turnover"),
        F.sum("gross").alias("gross_pnl"), F.sum("net").alias("net_pnl"), F.sum("cost").alias("cost_total"), F.sum("change").alias("trades"),
    )
    year = math.sqrt(periods)
    gw, gl = F.coalesce("gw", F.lit(0.0)), F.abs(F.coalesce("gl", F.lit(0.0)))
    ratio = lambda s: F.when(F.col(s) > 1e-12, F.col("mu") / F.col(s) * year).otherwise(0.0)
    return a.select(
        *group, F.when(F.col("eq") > 0, F.pow("eq", periods / F.col("n")) - 1.0).otherwise(0.0).alias("cagr"), ratio("sd").alias("sharpe"), ratio("dsd").alias("sortino"),
        F.abs("dd").alias("max_drawdown"), F.when(gl > 1e-12, gw / gl).when(gw > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"),
        F.coalesce("wr", F.lit(0.0)).alias("win_rate"), F.coalesce("aw", F.lit(0.0)).alias("average_win"), F.coalesce("al", F.lit(0.0)).alias("average_loss"),
        "exposure", "turnover", "gross_pnl", "net_pnl", "cost_total", "trades", (F.col("eq") - 1.0).alias("total_return"),
    )


def primary_score(metric, fallback, max_dd, trades, f1, *, objective: str = "maximize_sharpe_with_drawdown_cap", drawdown_cap: float = 0.2, min_trades: int = 20) -> Column:
    """Objective-aligned score of one run."""
    z = lambda x: F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))
    if objective == "maximize_f1":
        return z(f1)
    if objective == "maximize_sharpe_with_drawdown_cap":
        over = F.greatest(z(max_dd) - drawdown_cap, F.lit(0.0)) * 10.0
        return z(metric) - over - F.when(z(trades) < min_trades, 0.5).otherwise(0.0) + 0.1 * z(fallback)
    return 0.7 * z(metric) + 0.3 * z(fallback)


def apply_platt(p, coef, intercept) -> Column:
    """Calibrated probability; missing parameters leave it clamped only."""
    q = clamp(p)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (coef, intercept))
    return F.coalesce(clamp(1.0 / (1.0 + F.exp(-(a * q + b)))), q)


def rolling_metrics(df: DataFrame, *, window: int = 120, step: int = 1, bins: int = 10, layout: Layout = DAILY) -> DataFrame:
    """Classification metrics of every `window` consecutive predictions.

    Counts, Brier score and calibration error are row-frame sums.  The area
    under the curve folds over the window's own rows, a list of fixed length.
    """
    d = df.dropna(subset=[layout.time, "y_true", "probability", "prediction"])
    b = blocked(d, layout, back=window).indexed()
    fr = b.rows(-(window - 1), 0)
    b.stage({"_p": clamp("probability")})
    y, pr, p = F.col("y_true"), F.col("prediction"), F.col("_p")
    b.stage({"_b": bin_of(p, bins)})
    sums = {k: v.over(fr) for k, v in confusion(y, pr).items()}
    sums["brier_score"] = F.avg(F.pow(p - y, 2.0)).over(fr)
    for i in range(bins):
        sums[f"_g{i}"] = F.coalesce(F.sum(F.when(F.col("_b") == i, p - y)).over(fr), F.lit(0.0))
    due = (F.col("_ix") + 1 >= window) & ((F.col("_ix") + 1 - window) % step == 0)
    b.stage({**sums, "_rows": F.when(due, F.collect_list(F.struct(p.alias("p"), y.cast("int").alias("y"))).over(fr))})
    out = b.owned(keep=("_ix",)).filter(due)
    zero = F.struct(F.lit(-1.0).alias("p"), F.lit(0.0).alias("below"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0.0).alias("won"), F.lit(0.0).alias("tp"))

    def fold(acc, e):
        same = acc["p"] == e["p"]
        yy = e["y"].cast("double")
        close = acc["won"] + acc["pos"] * (acc["below"] + acc["neg"] / 2.0)
        return F.struct(
            e["p"].alias("p"), F.when(same, acc["below"]).otherwise(acc["below"] + acc["neg"]).alias("below"),
            F.when(same, acc["pos"] + yy).otherwise(yy).alias("pos"), F.when(same, acc["neg"] + 1.0 - yy).otherwise(1.0 - yy).alias("neg"),
            F.when(same, acc["won"]).otherwise(close).alias("won"), (acc["tp"] + yy).alias("tp"))

    auc = F.aggregate(F.array_sort("_rows"), zero, fold, lambda a: F.try_divide(a["won"] + a["pos"] * (a["below"] + a["neg"] / 2.0), a["tp"] * (window - a["tp"])))
    ece = reduce(lambda a, c: a + c, [F.abs(F.col(f"_g{i}")) for i in range(bins)]) / float(window)
    return out.select(*layout.keys, layout.time, *[v.alias(k) for k, v in scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()],
                      auc.alias("roc_auc"), "brier_score", ece.alias("calibration_error"), F.lit(window).alias("sample_size"))
