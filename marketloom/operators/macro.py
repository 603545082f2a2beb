"""Macro series on the bar timeline: level, change, z-score, decision days."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .series import Blocked, lag, sliding

# Source column of each output series.
SERIES = {
    "macro_yield_2y_level": "yield_2y",
    "macro_yield_10y_level": "yield_10y",
    "macro_yield_curve_slope_10y_2y": "yield_slope_2s10s",
    "macro_inflation_proxy": "inflation_proxy",
    "macro_jobs_proxy": "jobs_proxy",
    "macro_vix_proxy": "vix",
    "macro_credit_spread_proxy": "credit_spread",
    "macro_dollar_strength_proxy": "dollar_index",
    "macro_benchmark_rotation_proxy": "benchmark_rotation",
}


def with_macro_levels(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """The newest released value of every series at each bar."""
    rt = "release_timestamp" if "release_timestamp" in macro.columns else "timestamp"
    have = set(macro.columns)
    side = macro
    if "yield_slope_2s10s" not in have and {"yield_2y", "yield_10y"} <= have:
        side = side.withColumn("yield_slope_2s10s", F.col("yield_10y") - F.col("yield_2y"))
    pick = {n: s for n, s in SERIES.items() if s in side.columns}
    side = side.select(rt, *[F.col(s).cast("double").alias(n) for n, s in pick.items()])
    j = asof_join(bars, side, prefix="_m", keys=(), right_time=rt)
    return j.select(*bars.columns, *[F.col(f"_m__{n}").alias(n) for n in pick])


def decision_flag(ts: str | Column, days: list[str], release: str = "14:00", tz: str = "America/New_York") -> Column:
    """1.0 from the release time to 24 hours after that local midnight."""
    t = F.col(ts) if isinstance(ts, str) else ts
    hh, mm = (int(x) for x in release.split(":"))
    hit = F.lit(False)
    for d in days:
        midnight = datetime.fromisoformat(d).replace(tzinfo=ZoneInfo(tz)).astimezone(timezone.utc)
        a, z = midnight + timedelta(hours=hh, minutes=mm), midnight + timedelta(days=1)
        hit = hit | ((t >= F.lit(a)) & (t < F.lit(z)))
    return F.coalesce(hit.cast("double"), F.lit(0.0))


def prepare(df: DataFrame, params: dict, context: dict) -> DataFrame:
    m = context.get("macro")
    if m is None or any(n in df.columns for n in SERIES):
        return df
    return with_macro_levels(df, m)


def stage(b: Blocked, params: dict | None = None) -> list[str]:
    params = params or {}
    w = params.get("zscore_window", 63)
    names = [n for n in SERIES if n in b.df.columns]
    out = {}
    need = max(10, w // 3)
    sliding(b, {f"_{m}_{n}": (agg, w, need, F.col(n)) for n in names for m, agg in (("mu", "avg"), ("sd", "stddev"))})
    for n in names:
        out[f"{n}_diff1"] = F.col(n) - lag(b, n)
        out[f"{n}_z{w}"] = F.try_divide(F.col(n) - F.col(f"_mu_{n}"), F.col(f"_sd_{n}") + F.lit(1e-9))
    if params.get("fed_decision_dates"):
        out["macro_fed_decision_flag"] = decision_flag("timestamp", params["fed_decision_dates"], params.get("fed_release_time", "14:00"))
    b.stage(out)
    return [*names, *out]
