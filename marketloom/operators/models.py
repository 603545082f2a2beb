"""Folds, panel models with MLlib, scoring, registry and run records."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from ..session import cut_lineage
from . import metrics as ME
from .series import DAILY, DAY, IX, TOTAL, Layout, blocked, lag, latest

# ---- folds -------------------------------------------------------------------


def stamp_index(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Zero-based index of each distinct stamp and their number."""
    d = df.select(time).distinct().withColumn("_k", F.lit(0))
    b = blocked(d, Layout(keys=("_k",), time=time, span=366 * DAY)).indexed()
    return b.df.select(time, F.col(IX).alias("t_ix"), F.col(TOTAL).alias("t_n"))


def walk_forward_folds(df: DataFrame, k: int = 5, time: str = "timestamp") -> DataFrame:
    """`fold` 1..k of the test block a row is in (0 = only ever trained on).

    The last k * (n // (k + 1)) stamps form k equal blocks; fold i trains on
    every stamp before block i.  Whole dates stay together, so one panel model
    over all symbols never sees the test day of another symbol.
    """
    ix = stamp_index(df, time)
    size = F.floor(F.col("t_n") / (k + 1))
    start = F.col("t_n") - size * k
    fold = F.when(F.col("t_ix") < start, 0).otherwise(F.floor((F.col("t_ix") - start) / size) + 1)
    return df.join(ix.select(time, fold.cast("int").alias("fold")), time)


def time_split(df: DataFrame, test: float = 0.2, layout: Layout = DAILY) -> DataFrame:
    """`is_train` for the first part of every series."""
    b = blocked(df, layout).indexed()
    return b.stage({"is_train": F.col(IX) < F.floor(F.col(TOTAL) * (1.0 - test))}).owned()


def data_window(df: DataFrame, keys: list[str], horizon: int = 5, time: str = "timestamp") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(time).alias("start"), F.max(time).alias("end"), F.lit(horizon).alias("horizon"))


# ---- fitting --------------------------------------------------------------------

# Default settings of each family.
FAMILIES = {
    "logistic": lambda **kw: LogisticRegression(featuresCol="x", labelCol="label", maxIter=kw.get("maxIter", 100), regParam=kw.get("regParam", 0.0)),
    "random_forest": lambda **kw: RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=kw.get("numTrees", 200), maxDepth=kw.get("maxDepth", 20), seed=42),
    "gradient_boosting": lambda **kw: GBTClassifier(featuresCol="x", labelCol="label", maxIter=kw.get("maxIter", 200), maxDepth=kw.get("maxDepth", 5), stepSize=kw.get("stepSize", 0.1), seed=42),
}
GRIDS = {
    "logistic": [{"regParam": r} for r in (0.0, 0.01, 0.1)],
    "random_forest": [{"numTrees": n, "maxDepth": d} for n in (100, 200) for d in (10, 20)],
    "gradient_boosting": [{"maxIter": n, "maxDepth": d} for n in (100, 200) for d in (3, 5)],
}


def complete(features: list[str]):
    """Whether a row has every feature."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return ok


def fit(train: DataFrame, features: list[str], label: str, family: str = "logistic", **settings):
    """Scaler and classifier fitted on the training rows that have a label and all features (`complete` tells which)."""
    train = train.filter(complete(features) & F.col(label).isNotNull())
    if family == "logistic" and "regParam" not in settings:
        settings["regParam"] = 1.0 / max(train.count(), 1)  # the summed loss against half the squared weights
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True), FAMILIES[family](**settings)]
    return Pipeline(stages=stages).fit(train.withColumn("label", F.col(label).cast("double")))


def score(model, df: DataFrame) -> DataFrame:
    """Every row comes back; one that lacks a feature has a null probability and prediction."""
    ok = complete(model.stages[0].getInputCols())
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.withColumns({"_p": F.when(ok, p), "_y": F.when(ok, F.col("prediction").cast("int"))}).drop("raw", "x", "rawPrediction", "probability", "prediction").withColumnsRenamed({"_p": "probability", "_y": "prediction"})


def walk_forward(df: DataFrame, features: list[str], label: str, k: int = 5, family: str = "logistic", **settings) -> DataFrame:
    """Out-of-fold predictions: one fit per fold on all earlier dates."""
    d = cut_lineage(walk_forward_folds(df, k))
    parts = []
    for i in range(1, k + 1):
        m = fit(d.filter(F.col("fold") < i), features, label, family, **settings)
        parts.append(score(m, d.filter(F.col("fold") == i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logistic_grid(d: DataFrame, features: list[str], label: str, strengths: list[float], folds: int, steps: int = 30, tolerance: float = 1e-10) -> DataFrame:
    """(strength, fold, rows, f1): every penalty on every time fold, all fits in one job a step.

    `d` has `fold` as `walk_forward_folds` gives it. Newton's method needs of the
    data only the gradient and the Gram matrix; both are sums, grouped by
    (fold, strength), so one pass advances all fits together. Features are
    standardised by the fold's training rows; the penalty is half the squared
    weights times the strength, against the mean loss, without the intercept.
    What comes to the driver are these sums: folds x strengths rows.
    """
    import numpy as np

    n = len(features)
    rows = d.filter(complete(features) & F.col(label).isNotNull()).select("fold", F.col(label).cast("double").alias("_y"), F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    train = rows.withColumn("_f", F.explode(F.when(F.col("fold") < folds, F.sequence(F.col("fold") + 1, F.lit(folds)))))
    stats = {r["_f"]: r for r in train.groupBy("_f").agg(F.count(F.lit(1)).alias("n"), *[g(F.col("_x")[i]).alias(f"{k}{i}") for i in range(n) for k, g in (("m", F.avg), ("s", F.stddev_samp))]).collect()}
    fits = {(f, s): np.zeros(n + 1) for f in stats for s in range(len(strengths))}
    doubles = lambda v: F.array(*[F.lit(float(x)) for x in v])

    def placed(frame: DataFrame, fold: str) -> DataFrame:
        """Rows times strengths, with the standardised features and the probability under each fit so far."""
        pick = lambda make: F.element_at(F.array(*[make(f) for f in range(1, folds + 1)]), F.col(fold))
        none = [0.0] * n
        mean = pick(lambda f: doubles([stats[f][f"m{i}"] for i in range(n)] if f in stats else none))
        scale = pick(lambda f: doubles([stats[f][f"s{i}"] or 1.0 for i in range(n)] if f in stats else none))
        betas = pick(lambda f: F.array(*[doubles(fits.get((f, s), np.zeros(n + 1))) for s in range(len(strengths))]))
        z = [F.lit(1.0)] + [(F.col("_x")[i] - F.col("_mean")[i]) / F.col("_scale")[i] for i in range(n)]
        out = frame.withColumns({"_mean": mean, "_scale": scale}).select(F.col(fold).alias("_f"), "_y", *[c.alias(f"z{i}") for i, c in enumerate(z)], F.posexplode(betas).alias("_s", "_b"))
        dot = F.col("_b")[0]
        for i in range(1, n + 1):
            dot = dot + F.col("_b")[i] * F.col(f"z{i}")
        return out.withColumn("_p", 1.0 / (1.0 + F.exp(-dot)))

    for _ in range(steps):
        w, miss = F.col("_p") * (1.0 - F.col("_p")), F.col("_p") - F.col("_y")
        sums = placed(train, "_f").groupBy("_f", "_s").agg(*[F.sum(miss * F.col(f"z{i}")).alias(f"g{i}") for i in range(n + 1)], *[F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]).collect()
        moved = 0.0
        for r in sums:
            key, count = (r["_f"], r["_s"]), stats[r["_f"]]["n"]
            ridge = np.full(n + 1, strengths[r["_s"]])
            ridge[0] = 0.0
            hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(n + 1)] for i in range(n + 1)]) / count + np.diag(ridge + 1e-12)
            step = np.linalg.solve(hess, np.array([r[f"g{i}"] for i in range(n + 1)]) / count + ridge * fits[key])
            step *= min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-300))  # keeps the first steps of separable data short
            fits[key] = fits[key] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    tested = placed(rows.filter("fold > 0"), "fold")
    counts = ME.confusion(F.col("_y").cast("int"), (F.col("_p") > 0.5).cast("int"))
    tested = tested.groupBy("_s", "_f").agg(F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in counts.items()])
    f1 = ME.scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])["f1"]
    return tested.select(F.element_at(doubles(strengths), F.col("_s") + 1).alias("strength"), F.col("_f").alias("fold"), "rows", f1.alias("f1"))


def grid_search(df: DataFrame, features: list[str], label: str, family: str, folds: int = 3) -> tuple[dict, float]:
    """Settings of the best mean f1 over expanding time folds (the first of equal ones), and that mean."""
    if family == "logistic":
        strengths = [s["regParam"] for s in GRIDS["logistic"]]
        means = {r["strength"]: r["f1"] for r in logistic_grid(cut_lineage(walk_forward_folds(df, folds)), features, label, strengths, folds).groupBy("strength").agg(F.avg("f1").alias("f1")).collect()}
        best = max(strengths, key=lambda s: (means[s], -strengths.index(s)))
        return {"regParam": best}, means[best]
    found = None
    for settings in GRIDS.get(family, [{}]):
        oof = walk_forward(df, features, label, folds, family, **settings)
        per_fold = oof.groupBy("fold").agg(*[v.alias(n) for n, v in ME.confusion(F.col(label), F.col("prediction")).items()])
        f1 = per_fold.agg(F.avg(ME.scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])["f1"]).alias("f1")).first()["f1"]
        if found is None or f1 > found[1]:
            found = (settings, f1)
    return found


def fit_platt(df: DataFrame, y: str = "y_true", p: str = "probability") -> dict | None:
    """Logistic fit on the clamped probability; None without enough data."""
    facts = df.agg(F.count("*").alias("n"), F.countDistinct(y).alias("c")).first()
    if facts["n"] < 30 or facts["c"] < 2:
        return None
    d = VectorAssembler(inputCols=["_p"], outputCol="x").transform(df.select(ME.clamp(p).alias("_p"), F.col(y).cast("double").alias("label")))
    m = LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / facts["n"], standardization=False).fit(d)
    return {"method": "platt", "coef": float(m.coefficients[0]), "intercept": float(m.intercept), "samples": int(facts["n"])}


def feature_importance(model, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    """Largest importances (or absolute coefficients) of a fitted pipeline."""
    last = model.stages[-1]
    v = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    return sorted(zip(features, (float(x) for x in v)), key=lambda t: -t[1])[:n]


def sequence_windows(df: DataFrame, features: list[str], label: str, length: int = 60, layout: Layout = DAILY) -> DataFrame:
    """The `length` rows before each row as a matrix, with that row's label."""
    b = blocked(df, layout, back=length)
    fr = b.rows(-length, -1)
    b.stage({"x": F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(fr)})
    return b.owned().filter(F.size("x") == length).select(*layout.keys, layout.time, "x", F.col(label).alias("y"))


def lookahead_violations(bars: DataFrame, generate, names: list[str], cuts: int = 12, tol: float = 1e-9, warmup: int = 0) -> DataFrame:
    """Feature cells that change when everything after their row is removed."""
    b = blocked(bars, DAILY).indexed()
    rows = b.df.select(*bars.columns, F.col(IX).alias("_i"), F.col(TOTAL).alias("_t"))
    step = F.greatest(F.floor((F.col("_t") - warmup) / cuts), F.lit(1))
    at = F.transform(F.sequence(F.lit(1), F.lit(cuts)), lambda c: F.least(warmup + c * step, F.col("_t")) - 1)
    copies = rows.withColumn("_cut", F.explode(F.array_distinct(at))).filter(F.col("_i") <= F.col("_cut"))
    copies = copies.withColumns({"_sym": F.col("symbol"), "symbol": F.concat_ws("#", "symbol", F.col("_cut").cast("string"))})
    part = generate(copies.select("symbol", *[c for c in bars.columns if c != "symbol"]))
    ends = copies.filter(F.col("_i") == F.col("_cut")).select("symbol", "_sym", "timestamp")
    cut_rows = part.join(ends, ["symbol", "timestamp"]).drop("symbol").withColumnRenamed("_sym", "symbol").select("symbol", "timestamp", *[F.col(n).alias(f"_c_{n}") for n in names])
    j = generate(bars).select("symbol", "timestamp", *names).join(cut_rows, ["symbol", "timestamp"])
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("full"), F.col(f"_c_{n}").cast("double").alias("cut")) for n in names])
    e = j.select("symbol", "timestamp", F.inline(items))
    gap = F.abs(F.col("full") - F.col("cut"))
    return e.filter((gap > tol) | (F.col("full").isNull() != F.col("cut").isNull()))


# ---- scoring ---------------------------------------------------------------------

def prediction_row(p: str | Column) -> dict[str, Column]:
    q = F.col(p) if isinstance(p, str) else p
    return {"prediction": (q >= 0.5).cast("int"), "prediction_label": F.when(q >= 0.5, "UP").otherwise("DOWN"), "confidence": F.greatest(q, 1.0 - q)}


def signal_strength(p) -> Column:
    q = F.col(p)
    return F.when(q >= 0.70, "STRONG_BUY").when(q >= 0.55, "BUY").when(q <= 0.30, "STRONG_SELL").when(q <= 0.45, "SELL").otherwise("NEUTRAL")


def signal_context() -> Column:
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return F.struct(z("rsi_14", 50.0).alias("rsi"), F.when(z("price_sma50_ratio", 1.0) > 1, "BULLISH").otherwise("BEARISH").alias("trend"),
                    F.when(z("hvol_20", 0.2) > 0.3, "HIGH").otherwise("NORMAL").alias("volatility"), F.when(z("roc_5", 0.0) > 0, "POSITIVE").otherwise("NEGATIVE").alias("momentum"))


def trade_decision(p, c, long=0.60, short=0.40, least=0.55) -> Column:
    q, conf = clip(p, 0.0, 1.0), clip(c, 0.0, 1.0)
    return F.when(conf < least, "NO_TRADE").when(q >= long, "BUY").when(q <= short, "SELL").otherwise("HOLD")


def ensemble(members: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted vote per symbol; a missing member keeps its weight lost."""
    j = members.join(weights, "model")
    g = j.groupBy("symbol").agg(F.sum(F.col("prediction") * F.col("weight")).alias("ensemble_score"), F.sum(F.col("probability_up") * F.col("weight")).alias("probability_up"), F.count("*").alias("models_used"))
    return g.withColumns({"prediction": (F.col("ensemble_score") > 0.5).cast("int"), "confidence": F.greatest(F.col("probability_up"), 1.0 - F.col("probability_up"))})


def prefer_source(symbols: DataFrame, preds: DataFrame, order: list[str]) -> DataFrame:
    """Prediction of the first available source per symbol, else failed."""
    rank = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    d = preds.withColumn("_r", F.try_element_at(rank, F.col("source"))).filter("_r is not null")
    best = d.groupBy("symbol").agg(F.min_by(F.struct("source", "probability_up", "confidence"), "_r").alias("_b"))
    j = symbols.join(best, "symbol", "left")
    p = F.col("_b.probability_up")
    return j.select("symbol", F.col("_b.source").alias("source"), p.alias("probability_up"), F.coalesce(F.col("_b.confidence"), F.greatest(p, 1.0 - p)).alias("confidence"),
                    F.when(F.col("_b").isNull(), "failed").otherwise("ok").alias("status"))


def historical_scores(scored: DataFrame, keys: list[str], y: str, pred: str = "prediction") -> DataFrame:
    g = scored.groupBy(*keys).agg(*[v.alias(n) for n, v in ME.confusion(F.col(y), F.col(pred)).items()], F.count("*").alias("total"))
    s = ME.scores(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    return g.select(*keys, "total", (F.col("tp") + F.col("tn")).alias("correct"), *[s[n].alias(n) for n in ("accuracy", "precision", "recall")])


def fill_actual(preds: DataFrame, closes: DataFrame, horizon: int = 5, layout: Layout = DAILY) -> DataFrame:
    """Actual direction of each prediction, once its horizon has passed."""
    b = blocked(closes, layout, ahead=horizon)
    b.stage({"_f": F.lead("close", horizon).over(b.window)})
    act = b.owned().select("symbol", "timestamp", F.when(F.col("_f").isNotNull(), (F.col("_f") > F.col("close")).cast("int")).alias("actual"))
    return preds.join(act, ["symbol", "timestamp"], "left").withColumn("is_correct", F.col("actual") == F.col("prediction"))


def inspect(requests: DataFrame, scored: DataFrame, feature_names: list[str]) -> DataFrame:
    """Prediction trace per (symbol, instant): newest scored feature row at or
    before the instant, its decision and regime words."""
    from .asof import asof_join
    from .regime import inspector_regime

    j = asof_join(requests, scored.select("symbol", "timestamp", "probability", *feature_names), prefix="f")
    d = j.select(*requests.columns, F.col("f__asof_timestamp").alias("resolved"), F.col("f__probability").alias("probability_up"), *[F.col(f"f__{n}").alias(n) for n in feature_names])
    d = d.withColumn("confidence", F.greatest(F.col("probability_up"), 1.0 - F.col("probability_up")))
    return inspector_regime(d).withColumn("decision", F.when(F.col("resolved").isNotNull(), trade_decision("probability_up", "confidence")))


# ---- registry and run records --------------------------------------------------------

def registry_state(events: DataFrame) -> DataFrame:
    """Current status of every version from append-only events.

    Events: model_name, version, event ('register' | 'status'), status, at.
    A newer registration supersedes the older active versions of its name.
    """
    own = latest(events, ["model_name", "version"], ["at"], ["status", "at"])
    reg = events.filter("event = 'register'").groupBy("model_name").agg(F.max_by("version", "at").alias("_newest"))
    d = own.join(reg, "model_name", "left")
    old = (F.col("status") == "active") & (F.col("version") != F.col("_newest"))
    return d.withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("_newest")


def best_model(state: DataFrame) -> DataFrame:
    """The active version of each name, else the newest one."""
    act = F.when(F.col("status") == "active", 1).otherwise(0)
    return state.groupBy("model_name").agg(F.max_by(F.struct("version", "status"), F.struct(act, "at")).alias("_r")).select("model_name", "_r.*")


def next_version(state: DataFrame) -> DataFrame:
    n = F.max(F.regexp_extract("version", r"^v(\d+)$", 1).try_cast("int"))
    return state.groupBy("model_name").agg(F.format_string("v%04d", F.coalesce(n, F.lit(0)) + 1).alias("next_version"))


SECTIONS = ["run", "data", "feature", "split", "model", "metrics", "backtest", "diagnostics", "reproducibility"]


def normalize_artifact(raw: Column) -> Column:
    """Nine sections of a run document from either spelling, as JSON text."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    return F.struct(*[F.coalesce(get(f"{s}_summary"), get(f"{s.capitalize()}Summary"), F.lit("{}")).alias(f"{s}_summary") for s in SECTIONS])


def run_table(docs: DataFrame, raw: str = "doc") -> DataFrame:
    """One row per run with defaults, metrics and the resolved score."""
    d = docs.withColumn("_a", normalize_artifact(F.col(raw)))
    top = lambda k: F.get_json_object(raw, f"$.{k}")
    run = lambda k, default=None: F.coalesce(F.get_json_object("_a.run_summary", f"$.{k}"), top(k), *([F.lit(default)] if default else []))
    m = lambda k: F.get_json_object("_a.metrics_summary", f"$.{k}").try_cast("double")
    return d.select(
        *[c for c in docs.columns if c != raw], run("run_id", "unknown").alias("run_id"), run("status", "unknown").alias("status"), run("created_at").alias("created_at"), run("model_type", "unknown").alias("model_type"),
        F.coalesce(run("horizon").try_cast("int"), F.lit(5)).alias("horizon"), m("classification.accuracy").alias("accuracy"), m("classification.f1").alias("f1"), m("trading.sharpe").alias("sharpe"),
        m("trading.max_drawdown").alias("max_drawdown"), F.coalesce(m("primary_score"), m("trading.sharpe"), m("classification.f1")).alias("primary_score"),
        F.get_json_object("_a.reproducibility_summary", "$.score").try_cast("int").alias("reproducibility_score"), F.get_json_object("_a.data_summary", "$.start").alias("data_start"), F.get_json_object("_a.data_summary", "$.end").alias("data_end"))


def best_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("run_id", F.struct("f1", "run_id")).alias("best_f1_run"), F.max_by("run_id", F.struct("sharpe", "run_id")).alias("best_sharpe_run"),
                    F.min_by("run_id", F.when(F.col("max_drawdown").isNotNull(), F.struct("max_drawdown", "run_id"))).alias("lowest_drawdown_run"))


def reproducibility(df: DataFrame) -> DataFrame:
    """Share of three checks passed, in percent."""
    snaps = F.col("has_config") & F.col("has_dependencies") & F.col("has_hashes")
    ok = [snaps, F.col("hashes_resolvable"), snaps & F.col("hashes_resolvable")]
    n = ok[0].cast("int") + ok[1].cast("int") + ok[2].cast("int")
    return df.withColumn("score", F.round(n * 100.0 / 3.0).cast("int"))


def run_sections(docs: DataFrame, raw: str = "doc") -> DataFrame:
    """(type, title, data) rows of the non-empty sections of each run."""
    a = normalize_artifact(F.col(raw))
    rows = F.array(*[F.struct(F.lit(f"{s}_summary").alias("type"), F.lit(f"{s.capitalize()} summary").alias("title"), a[f"{s}_summary"].alias("data")) for s in SECTIONS])
    keep = F.filter(rows, lambda r: ~r["data"].isin("{}", "[]", "null"))
    return docs.select(*[c for c in docs.columns if c != raw], F.inline(keep))
