"""Scored text events and decayed sentiment windows on a bar timeline."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.expr import first_alias, flag
from .dedupe import dedupe_near_identical
from .series import DAY, Layout, blocked, full, lag


@dataclass(frozen=True)
class SentimentConfig:
    similarity: float = 0.9
    dedupe_hours: int = 48
    windows: tuple[str, ...] = ("4H", "1D")
    spike_lookback: int = 20
    half_life_minutes: float = 360.0
    default_weight: float = L.DEFAULT_SOURCE_WEIGHT
    social_multiplier: float = L.SOCIAL_MULTIPLIER
    include_unlinked: bool = True
    credibility: dict = field(default_factory=dict)
    positive: tuple[str, ...] = tuple(L.HEADLINE_POSITIVE)
    negative: tuple[str, ...] = tuple(L.HEADLINE_NEGATIVE)


def window_seconds(token: str) -> int:
    """`15m`, `4H`, `1D`, `2w` as seconds."""
    unit = {"m": 60, "h": 3600, "d": DAY, "w": 7 * DAY}[token.strip()[-1].lower()]
    return int(float(token.strip()[:-1]) * unit)


def text_rows(news: DataFrame | None, social: DataFrame | None = None) -> DataFrame:
    """News and social frames under one set of columns."""
    parts = []
    for df, channel, texts, sources, missing in ((news, "news", ["headline", "title", "text"], ["source"], "news_unknown"),
                                                 (social, "social", ["text", "headline", "title"], ["source", "platform"], "social_unknown")):
        if df is None:
            continue
        s = first_alias(df.columns, sources)
        k = first_alias(df.columns, ["ticker", "symbol", "provided_ticker"])
        who = F.upper(F.col(k).cast("string")) if k else F.lit(None).cast("string")
        extra = [F.col(x) for x in ("doc_id",) if x in df.columns]
        parts.append(df.select(
            F.col("timestamp"), F.col(first_alias(df.columns, texts)).cast("string").alias("text"),
            (F.lower(F.trim(F.col(s))) if s else F.lit(missing)).alias("source"), F.when(~who.isin("NAN", "NONE", ""), who).alias("provided_ticker"),
            F.lit(channel).alias("channel"), *extra))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.filter(F.col("timestamp").isNotNull())


def score_events(rows: DataFrame, cfg: SentimentConfig = SentimentConfig(), universe: list[str] | None = None) -> DataFrame:
    """Linked tickers, sentiment score and label, and source weight."""
    linked = X.extract_tickers("text", universe)
    given = F.col("provided_ticker")
    ok = given.isNotNull() & (given.isin(universe) if universe is not None else F.lit(True))
    d = rows.withColumns({"_l": linked, "_n": X.normalize_text("text")}).withColumn("sentiment_score", X.lexicon_score("_n", cfg.positive, cfg.negative, normalized=True)).drop("_n")
    d = d.withColumn("linked_tickers", F.when(ok & ~F.array_contains("_l", F.coalesce(given, F.lit(""))), F.concat(F.array(given), F.col("_l"))).otherwise(F.col("_l")))
    return d.withColumns({
        "sentiment_label": X.three_way(F.col("sentiment_score"), 0.08), "primary_ticker": F.try_element_at("linked_tickers", F.lit(1)),
        "source_weight": X.source_weight("source", "channel", cfg.credibility, cfg.default_weight, cfg.social_multiplier),
    }).drop("_l")


def process_texts(news, social=None, cfg: SentimentConfig = SentimentConfig(), universe: list[str] | None = None) -> DataFrame:
    """Union, near-duplicate removal, scoring."""
    rows = text_rows(news, social)
    if "doc_id" not in rows.columns:
        rows = rows.withColumn("doc_id", F.xxhash64("timestamp", "text", "source", F.coalesce("provided_ticker", F.lit("")), "channel"))
        rows = rows.dropDuplicates(["timestamp", "text", "source", "provided_ticker", "channel"])  # exact repeats would share an id
    kept = dedupe_near_identical(rows, id_col="doc_id", threshold=cfg.similarity, window_hours=cfg.dedupe_hours)
    return score_events(rows.join(kept.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), cfg, universe)


def moment(n: Column, weight: Column, mean: Column, m2: Column) -> Column:
    """Count, weight, weighted mean and centred second moment of some events, decayed to one point in time."""
    return F.struct(n.alias("n"), weight.alias("w"), mean.alias("mean"), m2.alias("m2"))


def merged(a: Column, b: Column) -> Column:
    """The moment of two disjoint sets of events; null stands for none. Sums only, so nothing cancels."""
    w = a["w"] + b["w"]
    away = b["mean"] - a["mean"]
    both = moment(a["n"] + b["n"], w, a["mean"] + away * b["w"] / w, a["m2"] + b["m2"] + away * away * a["w"] * b["w"] / w)
    none = lambda x: x.isNull() | (x["w"] <= 0)
    count = lambda x, y: moment(x["n"] + F.coalesce(y["n"], F.lit(0)), x["w"], x["mean"], x["m2"])
    return F.when(a.isNull(), b).when(b.isNull(), a).when(none(a), count(b, a)).when(none(b), count(a, b)).otherwise(both)


def decayed_moments(timeline: DataFrame, events: DataFrame, windows: dict[str, int], half_life_minutes: float, key: str = "symbol") -> DataFrame:
    """Every (key, timestamp) with a moment of the events in (t-win, t] for each window, named like it; null where there is none.

    Time is cut into cells as wide as the window, so (t-win, t] is a prefix of
    the stamp's own cell and a suffix of the cell before. Both are running sums
    over one sorted cell: events and probes of the stamps lie in it together.
    Events of one stamp and score are combined first, so a cell holds at most its
    different stamps and scores, however many events there are. Sums are taken
    about the cell's mean, and the two parts are merged; nothing is subtracted.
    All windows share one exchange to the cells and one back. Weights older than
    about a thousand half-lives are zero.
    """
    rate = math.log(2.0) / (half_life_minutes * 60.0 * 1e6)
    names = list(windows)
    wide = F.element_at(F.array(*[F.lit(windows[w] * 1_000_000) for w in names]), F.col("_w") + 1)
    each = F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("_w")
    ev = events.groupBy(key, F.unix_micros("timestamp").alias("_s"), F.col("sentiment_score").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum("source_weight").alias("_x"))
    ev = ev.select("*", each).withColumn("_span", wide)
    ev = ev.select(key, "_w", F.floor(F.col("_s") / F.col("_span")).alias("_c"), F.col("_s").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_t"), "_n", "_x", "_v", "_span")
    stamps = timeline.select(key, F.unix_micros("timestamp").alias("_t")).distinct().select("*", each).withColumn("_span", wide)
    probes = stamps.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_kind")).withColumn("_at", F.when(F.col("_kind") == 1, F.col("_t")).otherwise(F.col("_t") - F.col("_span")))
    probes = probes.select(key, "_w", F.floor(F.col("_at") / F.col("_span")).alias("_c"), "_at", "_kind", "_t", F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_x"), F.lit(None).cast("double").alias("_v"), "_span")
    cell = Window.partitionBy(key, "_w", "_c")
    end = (F.col("_c") + 1) * F.col("_span")
    d = ev.unionByName(probes).withColumn("_x", F.col("_x") * F.exp((F.col("_at") - end) * F.lit(rate)))  # weights at the end of the cell
    d = d.withColumn("_mid", F.sum(F.col("_x") * F.col("_v")).over(cell) / F.sum("_x").over(cell))
    off = F.coalesce(F.col("_v") - F.col("_mid"), F.lit(0.0))
    d = d.withColumns({"_d1": F.col("_x") * off, "_d2": F.col("_x") * off * off})
    # Up to the stamp: events before the probe at equal times. After the stamp less the window: backwards, the probe before events.
    up = cell.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    down = cell.orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    part = lambda c: F.when(F.col("_kind") == 1, F.sum(c).over(up)).otherwise(F.sum(c).over(down))
    d = d.withColumns({f"_r{c}": part(c) for c in ("_n", "_x", "_d1", "_d2")}).filter(F.col("_kind") > 0)
    now = F.exp((end - F.col("_t")) * F.lit(rate))
    centre = F.try_divide(F.col("_r_d1"), F.col("_r_x"))
    d = d.withColumn("_m", F.when(F.col("_r_n") > 0, moment(F.col("_r_n"), F.col("_r_x") * now, F.col("_mid") + centre, F.greatest(F.col("_r_d2") - F.col("_r_d1") * centre, F.lit(0.0)) * now)))
    side = lambda i, k: F.max(F.when((F.col("_w") == i) & (F.col("_kind") == k), F.col("_m")))  # noqa: E731  one row each
    g = d.groupBy(key, "_t").agg(*[side(i, k).alias(f"_{i}_{k}") for i in range(len(names)) for k in (1, 2)])
    return g.select(key, F.timestamp_micros("_t").alias("timestamp"), *[merged(F.col(f"_{i}_1"), F.col(f"_{i}_2")).alias(w) for i, w in enumerate(names)])


def sentiment_features(timeline: DataFrame, events: DataFrame, cfg: SentimentConfig = SentimentConfig(), layout: Layout = Layout(span=32 * DAY)) -> DataFrame:
    """sent_* columns for every (symbol, timestamp) of the timeline; unlinked events count for every symbol and are summed once per stamp."""
    base = timeline.select("symbol", "timestamp").distinct()
    windows = {w: window_seconds(w) for w in cfg.windows}
    half = max(cfg.half_life_minutes, 1.0)
    who = F.upper("primary_ticker")
    everyone = "\u0000"  # no symbol
    events = events.filter(F.col("sentiment_score").isNotNull())
    if cfg.include_unlinked:
        events = events.withColumn("symbol", F.coalesce(who, F.lit(everyone)))
        stamps = timeline.select(F.explode(F.array("symbol", F.lit(everyone))).alias("symbol"), "timestamp")
    else:
        events, stamps = events.filter(F.col("primary_ticker").isNotNull()).withColumn("symbol", who), base
    out = decayed_moments(stamps, events, windows, half)
    if cfg.include_unlinked:
        at = Window.partitionBy("timestamp")  # a row for each symbol of the universe
        loose = {w: F.max(F.when(F.col("symbol") == everyone, F.col(w))).over(at) for w in windows}
        out = out.withColumns({w: merged(F.col(w), loose[w]) for w in windows}).filter(F.col("symbol") != everyone)
    cols = {}
    for w in windows:
        m, weight = F.col(w), F.coalesce(F.col(w)["w"], F.lit(0.0))
        known = weight > 1e-12
        cols |= {f"sent_sentiment_mean_w{w}": F.when(known, m["mean"]), f"sent_sentiment_vol_w{w}": F.when(known, F.sqrt(m["m2"] / weight)),
                 f"sent_attention_count_w{w}": F.coalesce(m["n"], F.lit(0)).cast("double"), f"sent_attention_weighted_w{w}": weight}
    out = out.withColumns(cols).drop(*windows)
    n = max(cfg.spike_lookback, 1)
    m = min(n, max(3, n // 2))
    b = blocked(out, layout, back=n, like=base)
    z = lambda x: (F.col(x) - full(b, F.col(x), n, F.avg, m)) / (full(b, F.col(x), n, F.stddev_samp, m) + 1e-9)
    b.stage({k: v for w in cfg.windows for k, v in {
        f"sent_sentiment_change_w{w}": F.col(f"sent_sentiment_mean_w{w}") - lag(b, f"sent_sentiment_mean_w{w}"),
        f"sent_attention_z_w{w}": z(f"sent_attention_weighted_w{w}"), f"sent_sentiment_z_w{w}": z(f"sent_sentiment_mean_w{w}")}.items()})
    hot = lambda w: F.coalesce(F.abs(f"sent_attention_z_w{w}") >= 2.0, F.lit(False)) | F.coalesce(F.abs(f"sent_sentiment_z_w{w}") >= 2.0, F.lit(False))
    b.stage({f"sent_spike_flag_w{w}": flag(hot(w)) for w in cfg.windows})
    return b.owned()


def prepare(df: DataFrame, params: dict, context: dict) -> DataFrame:
    news, social = context.get("headlines"), context.get("social")
    if news is None and social is None:
        return df
    names = SentimentConfig.__dataclass_fields__
    cfg = SentimentConfig(**{k: (tuple(v) if isinstance(v, list) else v) for k, v in params.items() if k in names})
    ev = context.get("scored_events")
    ev = process_texts(news, social, cfg, context.get("ticker_universe")) if ev is None else ev
    return df.join(sentiment_features(df, ev, cfg), ["symbol", "timestamp"], "left")


def stage(b, params: dict | None = None) -> list[str]:
    return [x for x in b.df.columns if x.startswith("sent_")]
