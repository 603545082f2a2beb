"""Canonical price bars: naming, coercion, adjustment and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import first_alias, num, session_label

# Column names of a canonical bar and accepted vendor spellings.
CANONICAL = [
    "timestamp", "open", "high", "low", "close", "volume", "adj_close", "dividend",
    "split_factor", "session", "is_market_holiday", "is_synthetic",
]
ALIASES = {
    "timestamp": ["timestamp", "date", "datetime", "time"],
    "open": ["open"],
    "high": ["high"],
    "low": ["low"],
    "close": ["close"],
    "volume": ["volume"],
    "adj_close": ["adj_close", "adj close", "adjusted_close"],
    "dividend": ["dividend", "dividends"],
    "split_factor": ["split_factor", "stock splits", "splits"],
}
REQUIRED = ["timestamp", "open", "high", "low", "close", "volume"]
# Accepted timeframes, in seconds; a week is a calendar week.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 7 * 86400}


def timeframe_seconds(tf: str) -> int:
    key = tf.strip().lower()
    if key not in TIMEFRAMES:
        raise ValueError(f"unsupported timeframe: {tf}")
    return TIMEFRAMES[key]


def split_factor(x: Column) -> Column:
    """Missing and zero mean `no split`."""
    v = num(x)
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(v)


def utc_stamp(df: DataFrame, name: str, source_tz: str) -> Column:
    """Text and zone-less stamps are read in `source_tz`; others are UTC."""
    kind = df.schema[name].dataType.typeName()
    if kind == "timestamp":
        return F.col(name)
    t = F.try_to_timestamp(F.col(name)) if kind == "string" else F.col(name).cast("timestamp")
    return t if source_tz == "UTC" else F.to_utc_timestamp(t, source_tz)


def canonicalize(df: DataFrame, *, source_tz: str = "UTC", intraday: bool = False, symbol: str | None = None) -> DataFrame:
    """Any vendor spelling to the canonical columns, led by `symbol`."""
    cols = {k: first_alias(df.columns, v) for k, v in ALIASES.items()}
    missing = [k for k in REQUIRED if cols[k] is None]
    if missing:
        raise ValueError(f"missing required price columns: {missing}")
    sym = F.lit(symbol) if symbol else F.col("symbol")
    get = lambda k: num(F.col(f"`{cols[k]}`"))
    out = df.select(
        F.upper(F.trim(sym)).alias("symbol"), utc_stamp(df, cols["timestamp"], source_tz).alias("timestamp"),
        *[get(k).alias(k) for k in ("open", "high", "low", "close", "volume")],
        (get("adj_close") if cols["adj_close"] else get("close")).alias("adj_close"),
        (F.coalesce(get("dividend"), F.lit(0.0)) if cols["dividend"] else F.lit(0.0)).alias("dividend"),
        (split_factor(F.col(f"`{cols['split_factor']}`")) if cols["split_factor"] else F.lit(1.0)).alias("split_factor"),
        *[F.col(x).cast("boolean").alias(x) if x in df.columns else F.lit(False).alias(x) for x in ("is_market_holiday", "is_synthetic")],
        *(["seq"] if "seq" in df.columns else []),
    )
    out = out.withColumn("session", F.col("session") if "session" in out.columns else session_label("timestamp", intraday))
    return out.select("symbol", *CANONICAL, *(["seq"] if "seq" in df.columns else []))


def adjust(df: DataFrame) -> DataFrame:
    """Scale O, H, L, C by adj_close/close; volume stays as it is."""
    usable = (F.abs("close") > 1e-12) & F.col("adj_close").isNotNull()
    ratio = F.when(usable, F.col("adj_close") / F.col("close")).otherwise(1.0)
    d = df.withColumn("_r", ratio)
    return d.withColumns({x: F.col(x) * F.col("_r") for x in ("open", "high", "low", "close")}).drop("_r")


def bucket_start(ts: str | Column, tf: str, tz: str = "UTC") -> Column:
    """Left edge of the bucket of a stamp; weeks are labelled by their Sunday."""
    size = timeframe_seconds(tf)
    t = F.col(ts) if isinstance(ts, str) else ts
    local = t if tz == "UTC" else F.from_utc_timestamp(t, tz)
    if tf.lower() == "1w":
        start = F.date_add(F.date_trunc("week", local).cast("date"), 6).cast("timestamp")
    elif size == 86400:
        start = F.date_trunc("day", local)
    else:
        # counted from local midnight, so 4h buckets stay on the local clock
        start = F.timestamp_seconds(F.floor(F.unix_timestamp(local) / size) * size)
    return start if tz == "UTC" else F.to_utc_timestamp(start, tz)


def resample(df: DataFrame, timeframe: str, *, session: str | None = None, tz: str = "UTC", seq: str | None = None) -> DataFrame:
    """OHLCV bars of a coarser timeframe: one combining aggregate, no window."""
    if session is not None and "session" in df.columns:
        df = df.filter(F.col("session") == session)
    at = F.struct("timestamp", *([seq] if seq else []))
    have = set(df.columns)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    rules = {
        "open": first, "high": lambda c: F.max(c).alias(c), "low": lambda c: F.min(c).alias(c), "close": last,
        "volume": lambda c: F.sum(c).alias(c), "adj_close": last, "dividend": lambda c: F.sum(c).alias(c),
        "split_factor": lambda c: F.max(c).alias(c), "is_market_holiday": lambda c: F.max(c).alias(c),
        "is_synthetic": lambda c: F.max(c).alias(c), "session": last,
    }
    aggs = [rule(c) for c, rule in rules.items() if c in have]
    out = df.groupBy("symbol", bucket_start("timestamp", timeframe, tz).alias("_b")).agg(*aggs)
    return out.withColumnRenamed("_b", "timestamp").dropna(subset=["open", "high", "low", "close"])


def prepare_history(df: DataFrame, min_rows: int = 60) -> DataFrame:
    """Rows with complete OHLCV of symbols that have at least `min_rows`."""
    clean = df.withColumns({x: num(x) for x in ("open", "high", "low", "close", "volume")}).dropna(subset=["open", "high", "low", "close", "volume"])
    enough = clean.groupBy("symbol").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_rows).select("symbol")
    return clean.join(enough, "symbol", "left_semi")


def validate_market(df: DataFrame) -> DataFrame:
    need = ["timestamp", "open", "high", "low", "close"]
    missing = [x for x in need if x not in df.columns]
    if missing:
        raise ValueError(f"missing market columns: {missing}")
    df = df if "volume" in df.columns else df.withColumn("volume", F.lit(0.0))
    return df.dropna(subset=need)


def as_of(df: DataFrame, instant) -> DataFrame:
    return df.filter(F.col("timestamp") <= F.lit(instant).cast("timestamp"))


def as_of_summary(df: DataFrame, instant) -> DataFrame:
    """Requested and resolved stamps with row counts, per symbol."""
    t = F.lit(instant).cast("timestamp")
    seen = F.col("timestamp") <= t
    return df.groupBy("symbol").agg(
        t.alias("requested"), F.max(F.when(seen, F.col("timestamp"))).alias("resolved"), F.max("timestamp").alias("latest"),
        F.count("*").alias("rows_total"), F.count_if(seen).alias("rows_used"),
    ).withColumn("status", F.when(F.col("rows_used") == 0, "no_history").when(F.col("resolved") < F.col("requested"), "moved_back").otherwise("exact"))


def average_dollar_volume(df: DataFrame, rows: int = 63) -> DataFrame:
    """Mean close*volume of the newest `rows` bars per symbol."""
    from .series import DAILY, IX, TOTAL, blocked

    b = blocked(df, DAILY).indexed()
    tail = b.df.filter(F.col(IX) >= F.col(TOTAL) - rows)
    return tail.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume"))


def recent_activity(df: DataFrame) -> DataFrame:
    """Newest price, mean of the last 7 volumes and one-day % change."""
    from .series import DAILY, IX, TOTAL, blocked

    b = blocked(df, DAILY).indexed()
    age = F.col(TOTAL) - F.col(IX)
    g = b.df.filter(age <= 7).withColumn("_age", age).groupBy("symbol").agg(
        F.max(F.when(F.col("_age") == 1, F.col("close"))).alias("price"), F.max(F.when(F.col("_age") == 2, F.col("close"))).alias("_prev"),
        F.avg("volume").alias("avg_volume_7d"), F.max("timestamp").alias("timestamp"),
    )
    change = F.round((F.try_divide(F.col("price"), F.col("_prev")) - 1.0) * 100.0, 4)
    return g.withColumn("change_pct_1d", change).drop("_prev")
