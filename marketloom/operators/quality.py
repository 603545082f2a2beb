"""Data-quality gate for canonical bars of a whole universe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ny_clock
from .series import DAILY, INTRADAY, Layout, blocked, lag, previous

NY = "America/New_York"


@dataclass(frozen=True)
class QualityPolicy:
    """What to do with each kind of bad row; values are fixed defaults."""

    duplicate_policy: str = "drop"
    missing_timestamp_policy: str = "repair"
    negative_volume_policy: str = "repair"
    stale_price_policy: str = "drop"
    outlier_policy: str = "drop"
    stale_run_length: int = 10
    outlier_return_threshold: float = 0.35
    min_history_rows_multiplier: int = 80

    def required_rows(self, horizon: int) -> int:
        return max(horizon * self.min_history_rows_multiplier, horizon + 1)


def dedupe_bars(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per (symbol, timestamp), the last by `order`, with counts."""
    cols = [x for x in df.columns if x not in ("symbol", "timestamp")]
    g = df.groupBy("symbol", "timestamp").agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"), F.count("*").alias("_copies"),
        (F.count("*") - 1).alias("_repeats"), F.count_if(F.col("volume") < 0).alias("_negatives"),
    )
    out = g.select("symbol", "timestamp", *[F.col(f"_r.{x}").alias(x) for x in cols], "_copies", "_repeats", "_negatives")
    return out.withMetadata("timestamp", df.schema["timestamp"].metadata)


def counted_bars(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows, with the counts that `dedupe_bars` gives: each stands for itself, all but one of a stamp are repeats."""
    nth = F.row_number().over(Window.partitionBy("symbol", "timestamp").orderBy(*[F.col(x).desc() for x in order]))
    return df.withColumns({"_copies": F.lit(1).cast("bigint"), "_repeats": (nth > 1).cast("bigint"), "_negatives": F.coalesce(F.col("volume") < 0, F.lit(False)).cast("bigint")})


def missing_daily(df: DataFrame, holidays: DataFrame | None = None, tz: str = NY) -> DataFrame:
    """Weekdays without a bar between each symbol's first and last date."""
    day = F.to_date(ny_clock("timestamp")) if tz == NY else F.to_date(F.from_utc_timestamp("timestamp", tz))
    seen = df.select("symbol", day.alias("_d"))
    span = seen.groupBy("symbol").agg(F.min("_d").alias("_a"), F.max("_d").alias("_z"))
    want = span.select("symbol", F.explode(F.sequence("_a", "_z")).alias("_d")).filter(F.weekday("_d") < 5)
    if holidays is not None:
        want = want.join(holidays.select(F.col("date").alias("_d")), "_d", "left_anti")
    gone = want.join(seen.distinct(), ["symbol", "_d"], "left_anti")
    return gone.select("symbol", F.to_utc_timestamp(F.col("_d").cast("timestamp"), tz).alias("timestamp"))


def missing_intraday(df: DataFrame, delta_seconds: int, layout: Layout = INTRADAY) -> DataFrame:
    """Stamps skipped inside a UTC day where the gap exceeds 1.5 steps."""
    b = blocked(df.select("symbol", "timestamp").distinct(), layout, back=1)
    b.stage({"_p": lag(b, "timestamp")})
    step = F.lit(delta_seconds * 1_000_000)
    gap = F.unix_micros("timestamp") - F.unix_micros("_p")
    rows = b.owned().filter((F.to_date("_p") == F.to_date("timestamp")) & (gap > step * 1.5))
    steps = F.floor(gap / step) - 1
    rows = rows.withColumn("_n", steps).filter("_n >= 1").select("symbol", "_p", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_k"))
    return rows.select("symbol", F.timestamp_micros(F.unix_micros("_p") + F.col("_k") * step).alias("timestamp"))


def with_missing(df: DataFrame, layout: Layout, *, delta_seconds: int | None = None, holidays: DataFrame | None = None, tz: str = NY, fill: bool = True) -> DataFrame:
    """Rows plus a flat synthetic bar for every stamp missing before the next
    row: weekdays of the exchange calendar, or steps inside a UTC day.

    The bar before a gap is the row itself, so one look at the next stamp both
    finds the gap and fills it; nothing is joined. `_missing` counts stamps;
    without `fill` it is all that is added, at the row before the gap.
    """
    b = blocked(df, layout, ahead=1)
    b.stage({"_next": F.lead(layout.time).over(b.window)})
    d = b.owned()
    if delta_seconds is None:
        local = lambda c: F.to_date(F.from_utc_timestamp(c, tz))
        a, z = F.date_add(local("timestamp"), 1), F.date_sub(local("_next"), 1)
        days = F.when(a <= z, F.filter(F.sequence(a, z), lambda x: F.weekday(x) < 5))
        gone = F.transform(days, lambda x: F.to_utc_timestamp(x.cast("timestamp"), tz))
    else:
        step = F.lit(delta_seconds * 1_000_000)
        gap = F.unix_micros("_next") - F.unix_micros("timestamp")
        steps = F.floor(gap / step) - 1
        hit = (gap > step * 1.5) & (F.to_date("_next") == F.to_date("timestamp")) & (steps >= 1)
        gone = F.when(hit, F.transform(F.sequence(F.lit(1).cast("bigint"), steps), lambda k: F.timestamp_micros(F.unix_micros("timestamp") + k * step)))
    if not fill:
        rest = F.coalesce(gone, F.array().cast("array<timestamp>"))
        if holidays is None:
            return d.withColumn("_missing", F.size(rest).cast("bigint")).drop("_next")
        off = holidays.select(F.col("date").alias("_d")).distinct().groupBy().agg(F.collect_set("_d").alias("_off"))  # dates of a calendar
        d = d.crossJoin(F.broadcast(off))
        return d.withColumn("_missing", F.size(F.filter(rest, lambda t: ~F.array_contains("_off", F.to_date(F.from_utc_timestamp(t, tz))))).cast("bigint")).drop("_next", "_off")
    stamps = F.concat(F.array(F.struct(F.col("timestamp").alias("at"), F.lit(False).alias("syn"))),
                      F.transform(F.coalesce(gone, F.array().cast("array<timestamp>")), lambda t: F.struct(t.alias("at"), F.lit(True).alias("syn"))))
    d = d.withColumn("_s", F.explode(stamps)).drop("_next")
    if holidays is not None:
        off = holidays.select(F.col("date").alias("_d"), F.lit(True).alias("_off")).distinct()
        d = d.withColumn("_d", F.to_date(F.from_utc_timestamp("_s.at", tz))).join(off, "_d", "left")
        d = d.filter(~(F.col("_s.syn") & F.coalesce("_off", F.lit(False)))).drop("_d", "_off")
    syn, pick = F.col("_s.syn"), lambda c, v: F.when(F.col("_s.syn"), v).otherwise(F.col(c)).alias(c)
    flat = {c: F.col("close") for c in ("open", "high", "low")} | {"volume": F.lit(0.0), "dividend": F.lit(0.0), "split_factor": F.lit(1.0), "is_market_holiday": F.lit(False),
                                                                   "is_synthetic": F.lit(True), "_copies": F.lit(0).cast("bigint"), "_repeats": F.lit(0).cast("bigint"), "_negatives": F.lit(0).cast("bigint")}
    out = d.select("symbol", F.col("_s.at").alias("timestamp"), *[pick(c, flat[c]) if c in flat else F.col(c) for c in df.columns if c not in ("symbol", "timestamp")], syn.cast("bigint").alias("_missing"))
    grain = df.schema["timestamp"].metadata
    return out.withMetadata("timestamp", grain) if grain and delta_seconds is None else out


def stale_flags(df: DataFrame, length: int, layout: Layout) -> DataFrame:
    """`is_stale`: the row belongs to a run of >= length equal closes.

    A row ends such a run if none of the last length - 1 closes changed, and is
    in one if it or one of the next length - 1 rows ends one. Both frames are
    bounded and keep the order of the rows, so no second sort is needed.
    """
    if length <= 1:
        return df.withColumn("is_stale", F.lit(True))
    b = blocked(df, layout, back=length + 1, ahead=length + 1)
    b.stage({"_chg": F.coalesce((F.col("close") != lag(b, "close")).cast("int"), F.lit(1))})
    b.stage({"_end": F.max("_chg").over(b.rows(-(length - 2), 0)) == 0})
    b.stage({"is_stale": F.max("_end").over(b.rows(0, length - 1))})
    return b.owned(drop=("_chg", "_end"))


def outlier_flags(df: DataFrame, threshold: float, layout: Layout, skip: Column) -> DataFrame:
    """`is_outlier`: jump from the previous kept close without an action."""
    d = previous(df, {"_pk": F.when(~skip, F.struct("close"))}, layout)
    move = F.coalesce(F.abs(F.try_divide(F.col("close"), F.col("_pk.close")) - 1.0), F.lit(0.0))
    action = (F.abs(F.coalesce("dividend", F.lit(0.0))) > 1e-12) | (F.coalesce("split_factor", F.lit(1.0)) != 1.0)
    return d.withColumn("is_outlier", ~skip & (move > threshold) & ~action).drop("_pk")


def gate_flags(df: DataFrame, policy: QualityPolicy = QualityPolicy(), *, interval: str = "1d", order: list[str] | None = None,
               holidays: DataFrame | None = None, tz: str = NY) -> DataFrame:
    """All rows of all steps with flags; `gate_rows`/`gate_report` read them."""
    from .bars import timeframe_seconds

    daily = interval.lower().endswith("d")
    layout = DAILY if daily else INTRADAY
    plain = df.drop(*[x for x in ("_copies", "_repeats", "_negatives") if x in df.columns])
    base = dedupe_bars(plain, order or ["volume"]) if policy.duplicate_policy == "drop" else counted_bars(plain, order or ["volume"])
    base = base.select("symbol", "timestamp", "open", "high", "low", "close", "volume", "adj_close", "dividend", "split_factor", "session",
                       "is_market_holiday", "is_synthetic", "_copies", "_repeats", "_negatives")
    if policy.negative_volume_policy == "repair":
        base = base.withColumn("volume", F.when(F.col("volume") < 0, 0.0).otherwise(F.col("volume")))
    negative = F.coalesce(F.col("volume") < 0, F.lit(False)) if policy.negative_volume_policy == "drop" else F.lit(False)
    # Dropped rows take no part in the later steps, but are counted.
    rows = with_missing(base.filter(~negative), layout, delta_seconds=None if daily else timeframe_seconds(interval), holidays=holidays, tz=tz, fill=policy.missing_timestamp_policy == "repair")
    rows = stale_flags(rows, policy.stale_run_length, layout)
    drop_stale = F.col("is_stale") if policy.stale_price_policy == "drop" else F.lit(False)
    rows = outlier_flags(rows, policy.outlier_return_threshold, layout, drop_stale)
    drop_out = F.col("is_outlier") if policy.outlier_policy == "drop" else F.lit(False)
    rows = rows.withColumn("keep", ~(drop_stale | drop_out))
    if policy.negative_volume_policy != "drop":
        return rows
    no = F.lit(False)
    return rows.unionByName(base.filter(negative).withColumns({"_missing": F.lit(0).cast("bigint"), "is_stale": no, "is_outlier": no, "keep": no}))


def gate_rows(flags: DataFrame) -> DataFrame:
    return flags.filter("keep").drop("keep", "is_stale", "is_outlier", "_copies", "_repeats", "_negatives", "_missing")


def gate_report(flags: DataFrame, policy: QualityPolicy = QualityPolicy(), horizon: int = 5) -> DataFrame:
    """One row of counts per symbol."""
    need = policy.required_rows(horizon)
    return flags.groupBy("symbol").agg(
        F.sum("_copies").alias("rows_before"), F.count_if("keep").alias("rows_after"),
        F.sum("_repeats").alias("duplicates"), F.sum("_negatives").alias("negative_volume"),
        F.sum("_missing").alias("missing"), F.sum("_missing" if policy.missing_timestamp_policy == "repair" else F.lit(0)).alias("repaired"), F.count_if("is_stale").alias("stale"), F.count_if("is_outlier").alias("outliers"),
    ).withColumns({"required_rows": F.lit(need).cast("bigint"), "history_ok": F.col("rows_after") >= need})
