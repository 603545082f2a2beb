"""Feature drift, live performance, retraining decisions, weekly review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import melt, ordered_scan, quantile_aggs, quantile_values
from .series import attach_row, latest


@dataclass(frozen=True)
class DriftThresholds:
    ks_stat: float = 0.15
    ks_pvalue: float = 0.01
    psi_warning: float = 0.10
    psi_critical: float = 0.20
    zscore: float = 3.0
    min_samples: int = 60
    psi_bins: int = 10


@dataclass(frozen=True)
class PerformanceThresholds:
    window: int = 120
    min_accuracy: float = 0.50
    min_f1: float = 0.50
    min_roc_auc: float = 0.55
    max_brier_score: float = 0.25
    max_calibration_error: float = 0.12
    reliability_bins: int = 10


@dataclass(frozen=True)
class RetrainingPolicy:
    cadence: str = "weekly"
    cadence_days: int = 7
    max_model_age_days: int = 45
    drift_triggers: tuple[str, ...] = ("critical",)
    retrain_on_performance_alert: bool = True

    @property
    def days(self) -> int:
        return {"weekly": 7, "monthly": 30}.get(self.cadence.strip().lower(), max(1, int(self.cadence_days)))


def shared_numeric(train: DataFrame, live: DataFrame) -> list[str]:
    """Numeric columns of both frames, decided from the schemas."""
    kinds = {"double", "float", "integer", "long", "short", "byte", "bigint", "int"}
    num = lambda d: {f.name for f in d.schema.fields if f.dataType.typeName() in kinds}
    return sorted(num(train) & num(live))


def sided(train: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, live 0/1) rows of both samples."""
    return melt(train, features).withColumn("live", F.lit(0)).unionByName(melt(live, features).withColumn("live", F.lit(1)))


def counted(long: DataFrame) -> DataFrame:
    """(feature, value, a, b): how often each value stands in the reference and in the live sample."""
    return long.groupBy("feature", "value").agg(F.sum(1 - F.col("live")).alias("a"), F.sum("live").alias("b"))


def ordered_facts(counts: DataFrame, bins: int = 10) -> DataFrame:
    """What one ordered scan of the counted values gives per feature: sizes and means of both samples, their largest
    gap with its p-value, and the inner edges of the reference's decile bins."""
    n = max(2, bins)
    qs = [i / n for i in range(n + 1)]
    s = ordered_scan(counts, ["feature"], "value", {"a": F.col("a"), "b": F.col("b")}, combined=True)
    share = lambda x: (F.col(f"{x}_below") + F.col(x)) / F.nullif(F.col(f"{x}_total"), F.lit(0))
    mean = lambda x: F.sum(F.when(F.col(x) > 0, F.col("value") * F.col(x))) / F.nullif(F.sum(x), F.lit(0))
    g = s.groupBy("feature").agg(F.max(F.abs(share("a") - share("b"))).alias("ks_stat"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"),
                                 mean("a").alias("m0"), mean("b").alias("m1"), *quantile_aggs("value", "a", qs))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    p = F.least(F.lit(1.0), 2.0 * F.exp(-2.0 * F.pow(en * F.col("ks_stat"), 2.0)))
    q = quantile_values("n1", qs)
    cut = F.array_sort(F.array_distinct("_q"))
    lo, hi = F.element_at(cut, 1), F.element_at(cut, -1)
    flat = lo == hi
    lo2, hi2 = F.when(flat, lo - 1e-6).otherwise(lo), F.when(flat, hi + 1e-6).otherwise(hi)
    even = F.transform(F.array(*[F.lit(x) for x in qs]), lambda t: lo2 + (hi2 - lo2) * t)
    g = g.select("feature", "n1", "n2", "m0", "m1", "ks_stat", p.alias("ks_pvalue"), F.when(F.col("n1") > 0, q).alias("_q"))
    g = g.withColumn("_e", F.when(F.size(cut) < 3, even).otherwise(cut))
    # the outer bins are open, so only inner edges matter
    return g.withColumn("_inner", F.slice("_e", 2, F.size("_e") - 2)).drop("_q", "_e")


def binned(counts: DataFrame, facts: DataFrame, bins: int = 10) -> DataFrame:
    """psi and the shift of the live mean, from one pass over the counted values against the facts of their feature.

    psi is the population stability index over decile bins of the reference, left
    closed; the shift is in standard errors and NULL where undefined.
    """
    # there is one short row of facts per feature named in the plan
    d = counts.join(F.broadcast(facts.select("feature", "n1", "n2", "m0", "m1", "_inner")), "feature")
    place = sum((F.coalesce((F.get("_inner", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0)) for i in range(max(2, bins) + 1)), F.lit(0))
    far = F.when(F.col("a") > 0, F.col("a") * (F.col("value") - F.col("m0")) * (F.col("value") - F.col("m0")))
    by_bin = d.groupBy("feature", place.alias("_b")).agg(F.sum("a").alias("r"), F.sum("b").alias("c"), F.sum(far).alias("_q"), *[F.first(x).alias(x) for x in ("n1", "n2", "m0", "m1")])
    eps = F.lit(1e-6)
    share = lambda x, t: F.greatest(F.col(x) / F.greatest(F.col(t), F.lit(1)), eps)
    rp, cp = share("r", "n1"), share("c", "n2")
    # a bin empty on both sides adds (eps - eps) * ln(1) = 0, so it may be absent
    g = by_bin.groupBy("feature").agg(F.when(F.max("n1") > 0, F.sum((cp - rp) * F.ln(cp / rp))).alias("psi"), F.sum("_q").alias("_q"), *[F.first(x).alias(x) for x in ("n1", "n2", "m0", "m1")])
    g = g.withColumn("s0", F.sqrt(F.col("_q") / F.nullif(F.col("n1"), F.lit(0))))
    se = F.col("s0") / F.sqrt(F.greatest(F.col("n2"), F.lit(1)))
    z = F.when(F.col("s0") < 1e-12, F.when(F.abs(F.col("m1") - F.col("m0")) < 1e-12, 0.0)).otherwise(
        (F.col("m1") - F.col("m0")) / F.when(se < 1e-12, F.col("s0")).otherwise(se))
    return g.select("feature", "psi", z.alias("zscore_shift"))


def drift_report(train: DataFrame, live: DataFrame, features: list[str] | None = None, cfg: DriftThresholds = DriftThresholds()) -> DataFrame:
    """One row per feature: statistics, level and reasons."""
    names = features or shared_numeric(train, live)
    # both passes read the counted values and the facts, so they are stored once
    counts = cut_lineage(counted(sided(train, live, names)))
    facts = cut_lineage(ordered_facts(counts, cfg.psi_bins))
    all_names = train.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    sizes = facts.select("feature", F.col("n1").alias("train_samples"), F.col("n2").alias("live_samples"), "ks_stat", "ks_pvalue")
    d = all_names.join(sizes, "feature", "left").fillna(0, ["train_samples", "live_samples"]).join(binned(counts, facts, cfg.psi_bins), "feature", "left")
    d = d.select("feature", "train_samples", "live_samples", "ks_stat", "ks_pvalue", "psi", "zscore_shift")
    enough = (F.col("train_samples") >= cfg.min_samples) & (F.col("live_samples") >= cfg.min_samples)
    d = d.withColumns({x: F.when(enough, F.col(x)) for x in ("ks_stat", "ks_pvalue", "psi", "zscore_shift")})
    ks = (F.col("ks_stat") >= cfg.ks_stat) & (F.coalesce("ks_pvalue", F.lit(0.0)) <= cfg.ks_pvalue)
    crit, warn = F.col("psi") >= cfg.psi_critical, F.col("psi") >= cfg.psi_warning
    z = F.coalesce(F.abs("zscore_shift") >= cfg.zscore, F.lit(False))
    reasons = F.array_compact(F.array(F.when(ks, "ks"), F.when(crit, "psi_critical").when(warn, "psi_warning"), F.when(z, "zscore")))
    return d.withColumns({
        "level": F.when(~enough, "insufficient_data").when(crit, "critical").when(ks | warn | z, "warning").otherwise("stable"),
        "reasons": F.when(~enough, F.array(F.lit("min_samples"))).otherwise(reasons),
    })


def drift_summary(report: DataFrame) -> DataFrame:
    n = lambda lv: F.count_if(F.col("level") == lv)
    return report.agg(
        F.count("*").alias("total_features"), n("stable").alias("stable_features"), n("warning").alias("warning_features"), n("critical").alias("critical_features"),
        n("insufficient_data").alias("insufficient_features"), ((n("critical") > 0) | (n("warning") > 0)).alias("alert"))


def performance_alerts(rolling: DataFrame, keys: list[str], time: str = "timestamp", cfg: PerformanceThresholds = PerformanceThresholds()) -> DataFrame:
    """Newest rolling metrics per key and the thresholds they break."""
    last = latest(rolling, keys, [time])
    z = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    alerts = F.array_compact(F.array(
        F.when(z("accuracy") < cfg.min_accuracy, "accuracy_below_threshold"), F.when(z("f1") < cfg.min_f1, "f1_below_threshold"),
        F.when(F.col("roc_auc") < cfg.min_roc_auc, "roc_auc_below_threshold"), F.when(F.col("brier_score") > cfg.max_brier_score, "brier_above_threshold"),
        F.when(F.col("calibration_error") > cfg.max_calibration_error, "calibration_error_above_threshold")))
    return last.withColumn("alerts", alerts).withColumn("alert", F.size("alerts") > 0)


def retrain_decision(models: DataFrame, now, policy: RetrainingPolicy = RetrainingPolicy()) -> DataFrame:
    """Reasons to retrain, one row per model.

    Columns read: last_trained_at, warning_features, critical_features,
    performance_alert (missing ones count as no report).
    """
    t = F.lit(now).cast("timestamp")
    age = (F.unix_micros(t) - F.unix_micros("last_trained_at")) / 86_400_000_000.0
    have = set(models.columns)
    n = lambda x: F.coalesce(F.col(x), F.lit(0)) if x in have else F.lit(0)
    trig = {x.strip().lower() for x in policy.drift_triggers}
    parts = [F.when(F.col("last_trained_at").isNull(), "no_previous_training"), F.when(age >= policy.days, "scheduled_retrain_due"),
             F.when(age >= policy.max_model_age_days, "max_model_age_exceeded")]
    parts += [F.when(n(f"{lv}_features") > 0, f"drift_{lv}") for lv in ("critical", "warning") if lv in trig]
    if policy.retrain_on_performance_alert and "performance_alert" in have:
        parts.append(F.when(F.col("performance_alert"), "live_performance_degradation"))
    return models.withColumn("reasons", F.array_compact(F.array(*parts))).withColumn("retrain", F.size("reasons") > 0)


# ---- signals and outcomes ------------------------------------------------------

def is_win(label="outcome_label", pnl="pnl", ret="realized_return") -> Column:
    """An explicit label, else a positive pnl, else a positive return."""
    return F.coalesce(F.col(label).cast("boolean"), F.col(pnl) > 0, F.col(ret) > 0, F.lit(False))


def pair_outcomes(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Last signal and last outcome of each id; unresolved ids stay."""
    s = latest(signals, ["signal_id"], ["timestamp"])
    o = latest(outcomes, ["signal_id"], ["outcome_timestamp"])
    cols = [c for c in ("outcome_label", "pnl", "realized_return") if c in o.columns]
    j = s.join(o.select("signal_id", "outcome_timestamp", *cols), "signal_id", "left")
    for c, t in (("outcome_label", "boolean"), ("pnl", "double"), ("realized_return", "double")):
        if c not in j.columns:
            j = j.withColumn(c, F.lit(None).cast(t))
    return j.withColumns({"resolved": F.col("outcome_timestamp").isNotNull(), "win": is_win()})


def win_rate_by_regime(pairs: DataFrame) -> DataFrame:
    d = pairs.filter("resolved")
    return d.groupBy(F.coalesce("regime", F.lit("unknown")).alias("regime")).agg(F.count("*").alias("count"), F.avg(F.col("win").cast("double")).alias("win_rate"))


def win_rate_by_feature(pairs: DataFrame) -> DataFrame:
    d = pairs.filter("resolved").select(F.explode("top_features").alias("feature"), "win")
    return d.groupBy("feature").agg(F.count("*").alias("count"), F.avg(F.col("win").cast("double")).alias("win_rate"))


def effective_features(stats: DataFrame, worked: bool, top: int = 5) -> DataFrame:
    """Features seen at least twice that mostly won (or mostly lost)."""
    ok = (F.col("win_rate") >= 0.55) if worked else (F.col("win_rate") <= 0.45)
    return stats.filter(ok & (F.col("count") >= 2)).orderBy(F.desc("count"), F.desc("win_rate"), "feature").limit(top)


def clean_top_features(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def weekly_review(signals: DataFrame, outcomes: DataFrame, week_ending: str) -> DataFrame:
    """One row: totals, win rate, and the regime and feature sections."""
    end = F.lit(week_ending).cast("date")
    inside = lambda c: F.to_date(c).between(F.date_sub(end, 6), end)
    pairs = pair_outcomes(signals.filter(inside(F.col("timestamp"))), outcomes.filter(inside(F.col("outcome_timestamp"))))
    pack = lambda d, k: d.agg(F.array_sort(F.collect_list(F.struct(k, "count", "win_rate"))).alias("_x"))
    stats = win_rate_by_feature(pairs)
    head = pairs.agg(F.count("*").alias("total_signals"), F.count_if("resolved").alias("resolved_signals"), F.count_if(~F.col("resolved")).alias("unresolved_signals"),
                     F.coalesce(F.avg(F.when(F.col("resolved"), F.col("win").cast("double"))), F.lit(0.0)).alias("win_rate"))
    for name, part in (("regimes", pack(win_rate_by_regime(pairs), "regime")), ("worked", pack(effective_features(stats, True), "feature")),
                       ("failed", pack(effective_features(stats, False), "feature"))):
        head = attach_row(head, part.withColumnRenamed("_x", name))
    return head.withColumn("week_ending", end)
