"""Fundamental and earnings-event features, known only from their release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import flag, safe_div, secs
from .asof import asof_join, next_known_event
from .series import DAY, Layout, blocked, lag

RELEASES = Layout(time="filing_timestamp", span=3660 * DAY)
QOQ, YOY, TREND = 1, 4, 4


def release_features(f: DataFrame) -> DataFrame:
    """Growth, level, trend and ratio columns on the release timeline."""
    have = set(f.columns)
    b = blocked(f, RELEASES, back=max(QOQ, YOY, TREND))
    pct = lambda c, n: F.try_divide(F.col(c), lag(b, c, n)) - 1.0
    out = {}
    if "revenue" in have:
        out |= {"fund_revenue_growth_qoq": pct("revenue", QOQ), "fund_revenue_growth_yoy": pct("revenue", YOY)}
    for side in ("gross", "operating", "net"):
        if f"{side}_margin" in have:
            m = F.col(f"{side}_margin")
            out |= {f"fund_margin_{side}_level": m, f"fund_margin_{side}_trend": m - lag(b, m, TREND)}
    if "free_cash_flow" in have:
        c = F.col("free_cash_flow")
        out |= {"fund_fcf_growth_qoq": pct("free_cash_flow", QOQ), "fund_fcf_growth_yoy": pct("free_cash_flow", YOY), "fund_fcf_trend": c - lag(b, c, TREND)}
    if {"total_debt", "total_equity"} <= have:
        out["fund_debt_to_equity"] = safe_div("total_debt", "total_equity")
    if {"ebit", "interest_expense"} <= have:
        out["fund_interest_coverage"] = safe_div("ebit", F.abs("interest_expense"))
    # a given ratio wins over one derived from its parts
    for name, given, top, bottom in (("pe_ratio", "pe_ratio", "market_cap", "net_income"), ("ev_ebitda", "ev_ebitda", "enterprise_value", "ebitda"),
                                     ("fcf_yield", "fcf_yield", "free_cash_flow", "market_cap")):
        if given in have:
            out[f"fund_{name}"] = F.col(given)
        elif {top, bottom} <= have:
            out[f"fund_{name}"] = safe_div(top, bottom)
    return b.stage(out).owned().select("symbol", "filing_timestamp", *out)


def with_fundamentals(bars: DataFrame, f: DataFrame) -> DataFrame:
    rel = release_features(f)
    names = [x for x in rel.columns if x.startswith("fund_")]
    j = asof_join(bars, rel, prefix="_f", right_time="filing_timestamp")
    out = j.select(*bars.columns, *[F.col(f"_f__{x}").alias(x) for x in names], F.col("_f__asof_timestamp").alias("fund_last_release_timestamp"))
    return out.withColumn("fund_days_since_release", (secs("timestamp") - secs("fund_last_release_timestamp")) / 86400.0)


def with_earnings(bars: DataFrame, e: DataFrame, windows: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    cols = [x for x in ("earnings_surprise", "guidance_change_proxy") if x in e.columns]
    known = "known_since" if "known_since" in e.columns else None
    nxt = next_known_event(bars, e, known=known)
    j = asof_join(nxt, e.select("symbol", "event_timestamp", *cols), prefix="_e", right_time="event_timestamp")
    rename = {"earnings_surprise": "earnings_surprise", "guidance_change_proxy": "earnings_guidance_change_proxy"}
    out = j.select(
        *bars.columns, F.col("next_event").alias("earnings_next_event_timestamp"), F.col("_e__asof_timestamp").alias("earnings_last_event_timestamp"),
        *[F.col(f"_e__{x}").alias(rename[x]) for x in cols],
    )
    out = out.withColumns({
        "earnings_days_to_event": (secs("earnings_next_event_timestamp") - secs("timestamp")) / 86400.0,
        "earnings_days_since_event": (secs("timestamp") - secs("earnings_last_event_timestamp")) / 86400.0,
    })
    d = F.col("earnings_days_since_event")
    return out.withColumns({
        "earnings_post_window_flag": flag(d.between(0.0, float(max(windows)))),
        **{f"earnings_post_window_d{w}": flag(d.between(0.0, float(w))) for w in windows},
    })


def prepare(df: DataFrame, params: dict, context: dict) -> DataFrame:
    f = context.get("fundamentals")
    return df if f is None else with_fundamentals(df, f)


def stage(b, params: dict | None = None) -> list[str]:
    return [x for x in b.df.columns if x.startswith("fund_")]


def prepare_earnings(df: DataFrame, params: dict, context: dict) -> DataFrame:
    e = context.get("earnings")
    return df if e is None else with_earnings(df, e)


def stage_earnings(b, params: dict | None = None) -> list[str]:
    return [x for x in b.df.columns if x.startswith("earnings_")]
