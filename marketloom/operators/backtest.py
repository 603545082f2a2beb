"""Backtest analytics as table operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, div
from ..session import cut_lineage
from .asof import asof_join
from .series import DAILY, IX, Layout, attach_row, blocked, lag, running


@dataclass(frozen=True)
class Execution:
    commission_bps: float = 1.0
    commission_per_share: float = 0.0
    commission_min: float = 0.0
    spread_bps: float = 2.0
    slippage_bps: float = 2.0
    allow_partial: bool = True
    max_fill_fraction: float = 1.0
    volume_participation: float = 0.1
    intrabar_priority: str = "worst"

    @property
    def rate(self) -> float:
        return self.spread_bps / 20_000.0 + self.slippage_bps / 10_000.0


def target_exposure(pred, conf, *, long_threshold=0.6, short_threshold=0.4, allow_short=True, base_size=1.0, use_confidence=True, lo=0.1, hi=1.0) -> Column:
    """Signed exposure from a prediction; NULL where there is no edge."""
    p, q = F.col(pred), F.abs(F.col(conf))
    size = clip(q, lo, hi) if use_confidence else F.lit(base_size)
    out = F.when(p >= long_threshold, size)
    return out.when(p <= short_threshold, -size) if allow_short else out


def decide(df: DataFrame, **kw) -> DataFrame:
    e = target_exposure("prediction", "confidence", **kw)
    return df.withColumn("target_exposure", e).withColumns({
        "action": F.when(F.col("target_exposure") > 0, "buy").when(F.col("target_exposure") < 0, "sell").otherwise("hold"),
        "reason": F.when(F.col("target_exposure") > 0, "prob_up").when(F.col("target_exposure") < 0, "prob_down").otherwise("no_edge")})


def order_quantity(exposure, equity, price, position, allow_short: bool = True) -> Column:
    """Quantity that moves a position to its target; NULL if nothing to do."""
    e, q, p, pos = (F.col(x) if isinstance(x, str) else x for x in (exposure, equity, price, position))
    t = clip(e, -1.0, 1.0)
    t = t if allow_short else F.greatest(t, F.lit(0.0))
    delta = F.try_divide(t * q, p) - pos
    return F.when((q > 0) & (p > 0) & (F.abs(delta) >= 1e-9), delta)


def commission(qty: Column, price: Column, ex: Execution) -> Column:
    c = F.abs(qty * price) * (ex.commission_bps / 10_000.0) + F.abs(qty) * ex.commission_per_share
    return F.when(c > 0, F.greatest(c, F.lit(ex.commission_min))).otherwise(c)


def fill_orders(df: DataFrame, ex: Execution = Execution()) -> DataFrame:
    """Fill columns for orders joined to their execution bar.

    Reads requested_qty, order_type, limit_price, open, high, low, volume.
    """
    q, side = F.col("requested_qty"), F.signum("requested_qty")
    lim = F.coalesce("limit_price", "open")
    limit_ref = F.when(side > 0, F.when(F.col("low") <= lim, F.least(lim, F.col("open")))).otherwise(F.when(F.col("high") >= lim, F.greatest(lim, F.col("open"))))
    ref = F.when(F.abs(q) < 1e-12, F.lit(None)).when(F.col("order_type") == "limit", limit_ref).otherwise(F.col("open"))
    size = F.abs(q)
    if ex.allow_partial:
        cap = size * max(min(ex.max_fill_fraction, 1.0), 0.0)
        size = F.when(F.col("volume") > 0, F.least(cap, F.col("volume") * max(ex.volume_participation, 0.0))).otherwise(cap)
    size = F.when(ref.isNotNull() & (size > 1e-12), size)
    d = df.withColumns({"reference_price": F.when(size.isNotNull(), ref), "_s": size})
    d = d.withColumn("fill_price", F.col("reference_price") * (1.0 + side * ex.rate))
    return d.withColumns({
        "filled_qty": side * F.col("_s"), "commission": commission(F.col("_s"), F.col("fill_price"), ex),
        "slippage_cost": F.abs(F.col("_s") * (F.col("fill_price") - F.col("reference_price"))), "was_partial": F.col("_s") + 1e-12 < F.abs(q),
        "fill_ratio": div(F.col("_s"), F.abs(q)),
    }).drop("_s")


def with_execution_bar(orders: DataFrame, bars: DataFrame, delay: int = 1, layout: Layout = DAILY) -> DataFrame:
    """Orders on the bar `delay` bars after the bar they were placed on."""
    b = blocked(bars, layout, ahead=delay)
    cols = ["timestamp", "open", "high", "low", "volume"]
    b.stage({f"_x_{c}": F.lead(c, delay).over(b.window) for c in cols})
    nxt = b.owned().select("symbol", "timestamp", *[F.col(f"_x_{c}").alias("exec_timestamp" if c == "timestamp" else c) for c in cols])
    return orders.join(nxt, ["symbol", "timestamp"]).filter("exec_timestamp is not null")


def exit_trigger(is_long: Column, stop: Column, take: Column, ex: Execution = Execution()) -> Column:
    """struct(reason, price) of a bar that stops or takes a position, or NULL."""
    o, h, l = F.col("open"), F.col("high"), F.col("low")
    s = F.when(is_long, F.when(o <= stop, o).when(l <= stop, stop)).otherwise(F.when(o >= stop, o).when(h >= stop, stop))
    t = F.when(is_long, F.when(o >= take, o).when(h >= take, take)).otherwise(F.when(o <= take, o).when(l <= take, take))
    pair = lambda r, p: F.struct(F.lit(r).alias("reason"), p.alias("price"))
    first, second = (("take_profit", t), ("stop_loss", s)) if ex.intrabar_priority == "best" else (("stop_loss", s), ("take_profit", t))
    return F.when(first[1].isNotNull(), pair(*first)).when(second[1].isNotNull(), pair(*second))


def first_exit(entries: DataFrame, bars: DataFrame, ex: Execution = Execution(), layout: Layout = DAILY, fan: int = 64) -> DataFrame:
    """First bar after each entry that hits its stop or its target.

    Entries carry symbol, timestamp (of a bar), is_long, stop_price,
    take_price.  Low/high summaries of 64, 64*64, ... bars form a ladder; an
    entry climbs until some later sibling range is hit and then descends.  The
    64 siblings of a range are one row, so an entry meets one partner per step
    however long the series is, and travels once per step.
    """
    # entries, both ends of the ladder and its height read the indexed bars, so they are stored once
    ix = cut_lineage(blocked(bars, layout).indexed().owned(keep=(IX,)).select("symbol", "timestamp", "open", "high", "low", F.col(IX).alias("ix")))
    top = ix.agg(F.max("ix").alias("m")).first()["m"] or 0
    levels = max(1, math.ceil(math.log(top + 2, fan)))
    ladder = [ix.select("symbol", F.col("ix").alias("n"), F.col("low").alias("lo"), F.col("high").alias("hi"), "timestamp", "open")]
    for k in range(1, levels):
        ladder.append(ladder[0].groupBy("symbol", F.floor(F.col("n") / fan**k).alias("n")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))

    def siblings(k: int) -> DataFrame:
        """The up to `fan` ranges of level k below each range of the next one, in order."""
        parts = [c for c in ladder[k].columns if c != "symbol"]
        return ladder[k].groupBy("symbol", F.floor(F.col("n") / fan).alias("_up")).agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("_parts"))

    up = F.col("is_long")

    def hit(r: Column) -> Column:
        stop = F.when(up, r["lo"] <= F.col("stop_price")).otherwise(r["hi"] >= F.col("stop_price"))
        take = F.when(up, r["hi"] >= F.col("take_price")).otherwise(r["lo"] <= F.col("take_price"))
        return F.coalesce(stop, F.lit(False)) | F.coalesce(take, F.lit(False))

    def first_hit(after: Column | None = None) -> Column:
        return F.get(F.filter("_parts", (lambda r: hit(r)) if after is None else (lambda r: (r["n"] > after) & hit(r))), 0)

    e = entries.join(ix.select("symbol", "timestamp", F.col("ix").alias("e_ix")), ["symbol", "timestamp"])
    packs = [siblings(k) for k in range(levels)]
    cur, done = e, []  # entries still climbing, and by level those that found a range
    for k in range(levels):
        probe = cur.withColumn("_up", F.floor(F.col("e_ix") / fan ** (k + 1)))
        got = probe.join(packs[k], ["symbol", "_up"], "left").withColumn("_at", first_hit(F.floor(F.col("e_ix") / fan**k))).drop("_up", "_parts")
        got = cut_lineage(got) if k + 1 < levels else got  # read by the next level and by the way down
        done.append(got.filter("_at is not null") if k + 1 < levels else got)
        cur = got.filter("_at is null").drop("_at")
    found = done[-1]
    for k in range(levels - 1, 0, -1):
        probe = found.withColumn("_up", F.col("_at.n")).drop("_at")
        found = probe.join(packs[k - 1], ["symbol", "_up"], "left").withColumn("_at", first_hit()).drop("_up", "_parts").unionByName(done[k - 1])
    own = F.struct(*[c for c in e.columns if c != "e_ix"]).alias("_e")
    bar = found.select(own, "e_ix", "is_long", "stop_price", "take_price", "_at", F.col("_at.open").alias("open"), F.col("_at.hi").alias("high"), F.col("_at.lo").alias("low"))
    bar = bar.withColumn("_x", F.when(F.col("_at").isNotNull(), exit_trigger(up, F.col("stop_price"), F.col("take_price"), ex)))
    return bar.select("_e.*", F.col("_at.timestamp").alias("exit_timestamp"), F.col("_x.reason").alias("exit_reason"), F.col("_x.price").alias("exit_price"), (F.col("_at.n") - F.col("e_ix")).alias("bars_held"))


def merge_signals(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Newest signal at or before each bar; a missing regime is `unknown`."""
    cols = [c for c in ("prediction", "confidence", "regime") if c in signals.columns]
    j = asof_join(bars, signals, prefix="_s", columns=cols)
    out = j.select(*bars.columns, *[F.col(f"_s__{c}").alias(c) for c in cols])
    return out.withColumn("regime", F.coalesce("regime", F.lit("unknown"))) if "regime" in cols else out


def equity_curve(df: DataFrame, layout: Layout = DAILY, equity: str = "equity") -> DataFrame:
    """Per-bar return (first one 0), running peak and drawdown."""
    b = blocked(df, layout, back=1)
    b.stage({"equity_return": F.coalesce(F.try_divide(F.col(equity), lag(b, equity)) - 1.0, F.lit(0.0))})
    d = running(b.owned(), {"peak": (F.col(equity), "max")}, layout)
    return d.withColumn("drawdown", F.col(equity) / F.col("peak") - 1.0)


def close_trades(df: DataFrame) -> DataFrame:
    """pnl after costs and its ratio to the entry notional."""
    notional = F.abs(F.col("entry_price") * F.col("entry_qty"))
    d = df.withColumns({"pnl": F.coalesce("realized_pnl", F.lit(0.0)) - F.coalesce("costs", F.lit(0.0)), "bars_held": F.greatest(F.coalesce("bars_held", F.lit(0)), F.lit(1))})
    return d.withColumn("return", F.when(notional > 1e-12, F.col("pnl") / notional).otherwise(0.0))


def backtest_metrics(equity: DataFrame, trades: DataFrame, keys: list[str], *, time: str = "timestamp", periods: int = 252) -> DataFrame:
    """Nineteen metrics per key from equity and trade tables.

    Equity rows carry equity, equity_return, drawdown, exposure; trades carry
    pnl, notional (turnover), commission, slippage.
    """
    r = F.coalesce("equity_return", F.lit(0.0))
    e = equity.groupBy(*keys).agg(
        F.min_by("equity", time).alias("initial_equity"), F.max_by("equity", time).alias("final_equity"), F.count("*").alias("n"), F.avg(r).alias("mu"),
        F.stddev_pop(r).alias("sd"), F.stddev_pop(F.when(r < 0, r)).alias("dsd"), F.abs(F.min("drawdown")).alias("max_drawdown"), F.avg("equity").alias("avg_eq"),
        F.avg(F.coalesce("exposure", F.lit(0.0))).alias("exposure"))
    p = F.coalesce("pnl", F.lit(0.0))
    t = trades.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.avg((p > 0).cast("double")).alias("win_rate"), F.sum(F.when(p > 0, p)).alias("gw"), F.abs(F.sum(F.when(p < 0, p))).alias("gl"),
        F.avg(F.when(p > 0, p)).alias("average_win"), F.avg(F.when(p < 0, p)).alias("average_loss"), F.sum("commission").alias("commission_total"),
        F.sum("slippage").alias("slippage_total"), F.sum("notional").alias("tn"))
    d = e.join(t, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tr = F.col("final_equity") / F.greatest(F.col("initial_equity"), F.lit(1e-9)) - 1.0
    ratio = lambda s: F.when(F.col(s) > 1e-12, F.col("mu") / F.col(s) * math.sqrt(periods)).otherwise(0.0)
    cost = z("commission_total") + z("slippage_total")
    return d.select(
        *keys, "initial_equity", "final_equity", tr.alias("total_return"), F.when(1.0 + tr > 0, F.pow(1.0 + tr, periods / F.col("n")) - 1.0).otherwise(0.0).alias("cagr"),
        ratio("sd").alias("sharpe"), ratio("dsd").alias("sortino"), "max_drawdown", "exposure", (z("tn") / F.greatest(F.col("avg_eq"), F.lit(1e-9))).alias("turnover"),
        z("trade_count").cast("double").alias("trade_count"), z("win_rate").alias("win_rate"),
        F.when(z("gl") > 1e-12, z("gw") / z("gl")).when(z("gw") > 0, F.lit(float("inf"))).otherwise(0.0).alias("profit_factor"), z("average_win").alias("average_win"),
        z("average_loss").alias("average_loss"), z("commission_total").alias("commission_total"), z("slippage_total").alias("slippage_total"), cost.alias("cost_total"),
        (F.col("final_equity") - F.col("initial_equity") + cost).alias("gross_pnl"), (F.col("final_equity") - F.col("initial_equity")).alias("net_pnl"))


def attribution(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, pnl, win rate and mean return; missing keys form a group."""
    return trades.groupBy(*keys).agg(F.count("pnl").alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.coalesce("pnl", F.lit(0.0)) > 0).cast("double")).alias("win_rate"), F.avg("return").alias("avg_return"))


def pnl_histogram(trades: DataFrame, value: str = "pnl") -> DataFrame:
    """Equal-width bins, their number the clamped square root of the count."""
    facts = trades.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.least(F.greatest(F.floor(F.sqrt(F.count(value))), F.lit(8)), F.lit(30)).alias("_n"))
    d = attach_row(trades.filter(F.col(value).isNotNull()).select(value), facts)
    w = (F.col("_hi") - F.col("_lo")) / F.col("_n")
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), w)), F.lit(0)), F.col("_n") - 1)
    return d.groupBy(b.alias("bin"), (F.col("_lo") + b * w).alias("low"), (F.col("_lo") + (b + 1) * w).alias("high")).agg(F.count("*").alias("count"))
