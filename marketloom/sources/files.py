"""Readers and sinks over landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import first_alias
from ..operators.bars import ALIASES
from ..operators.drift import clean_top_features
from ..session import prepare

BARS_SCHEMA = ("symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, adj_close double, dividend double, "
               "split_factor double, session string, is_market_holiday boolean, is_synthetic boolean")
# Layout of the event log.
EVENT_SCHEMA = ("event_type string, signal_id string, event_time timestamp, month string, "
                "payload struct<symbol:string,confidence:double,regime:string,prediction:double,top_features:array<string>,outcome_label:boolean,pnl:double,realized_return:double>")
POSTS_SCHEMA = "id string, title string, body string, created_at timestamp, score bigint"


def read_bars(spark: SparkSession, path: str, *, fmt: str = "parquet", symbols: list[str] | None = None, start=None, end=None, schema: str | None = None) -> DataFrame:
    """Bars from landed files; symbol and time limits reach the scan."""
    r = prepare(spark).read
    if fmt == "csv":
        df = r.schema(schema).csv(path, header=True) if schema else r.csv(path, header=True)
    elif fmt == "json":
        df = r.schema(schema or BARS_SCHEMA).json(path)
    else:
        df = r.format(fmt).load(path)
    t = first_alias(df.columns, ALIASES["timestamp"])
    if t and t != "timestamp":
        df = df.withColumnRenamed(t, "timestamp")
    if "timestamp" in df.columns and df.schema["timestamp"].dataType.simpleString() == "string":
        df = df.withColumn("timestamp", F.to_timestamp("timestamp"))  # else bounds would compare as text
    if symbols:
        df = df.filter(F.col("symbol").isin(symbols))
    return slice_frame(df, start, end)


def slice_frame(df: DataFrame, start=None, end=None, time: str = "timestamp") -> DataFrame:
    """Rows with start <= time <= end; a missing bound is open."""
    kind = df.schema[time].dataType.simpleString()
    lit = lambda v: F.lit(v).cast(kind)
    if start is not None:
        df = df.filter(F.col(time) >= lit(start))
    return df.filter(F.col(time) <= lit(end)) if end is not None else df


def empty_frame(spark: SparkSession, schema: str = "timestamp timestamp") -> DataFrame:
    """A source without rows; joins treat it like a missing source."""
    return spark.createDataFrame([], schema)


def project_history(df: DataFrame) -> DataFrame:
    """Lower-case names, date and OHLCV only; a missing column is an error."""
    low = df.toDF(*[c.lower() for c in df.columns])
    t = first_alias(low.columns, ["date", "datetime", "timestamp"])
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in low.columns] + ([] if t else ["date"])
    if missing:
        raise ValueError(f"history lacks columns: {missing}")
    keep = ["symbol"] if "symbol" in low.columns else []
    return low.select(*keep, F.col(t).alias("date"), "open", "high", "low", "close", "volume")


def read_snapshot(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Newest landed snapshot row per symbol."""
    from ..operators.series import latest

    df = spark.read.parquet(path)
    return latest(df.select("symbol", "snapshot_at", *(fields or [c for c in df.columns if c not in ("symbol", "snapshot_at")])), ["symbol"], ["snapshot_at"])


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited symbol listing, all columns as text."""
    return spark.read.option("sep", "|").option("header", True).csv(path)


def read_posts(spark: SparkSession, path: str, *, start=None, end=None, max_posts: int | None = None) -> DataFrame:
    """Posts of a time window, newest first when a maximum is asked for."""
    df = slice_frame(spark.read.schema(POSTS_SCHEMA).json(path), start, end, "created_at")
    return df.orderBy(F.desc("created_at"), "id").limit(max_posts) if max_posts else df


# ---- event log -----------------------------------------------------------------

def signal_events(df: DataFrame) -> DataFrame:
    """Signal rows in event-log form; blank feature names are dropped."""
    n = lambda t: F.lit(None).cast(t)
    pay = F.struct("symbol", "confidence", "regime", "prediction", clean_top_features(F.col("top_features")).alias("top_features"), n("boolean").alias("outcome_label"), n("double").alias("pnl"), n("double").alias("realized_return"))
    return df.select(F.lit("signal").alias("event_type"), "signal_id", F.col("timestamp").alias("event_time"), F.date_format("timestamp", "yyyy-MM").alias("month"), pay.alias("payload"))


def outcome_log_events(df: DataFrame) -> DataFrame:
    n = lambda t: F.lit(None).cast(t)
    have = set(df.columns)
    opt = lambda c, t: F.col(c) if c in have else n(t).alias(c)
    pay = F.struct(n("string").alias("symbol"), n("double").alias("confidence"), n("string").alias("regime"), n("double").alias("prediction"), n("array<string>").alias("top_features"),
                   opt("outcome_label", "boolean"), opt("pnl", "double"), opt("realized_return", "double"))
    return df.select(F.lit("outcome").alias("event_type"), "signal_id", F.col("outcome_timestamp").alias("event_time"), F.date_format("outcome_timestamp", "yyyy-MM").alias("month"), pay.alias("payload"))


def append_events(df: DataFrame, path: str) -> None:
    """Month-partitioned append of JSON lines."""
    df.write.mode("append").partitionBy("month").json(path)


def scan_events(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Events of a date range; only the months it touches are read."""
    df = spark.read.schema(EVENT_SCHEMA).json(path)
    a, z = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    months = F.col("month").between(str(start)[:7], str(end)[:7])
    return df.filter(months & F.to_date("event_time").between(a, z))


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals and outcomes as flat tables."""
    s = events.filter("event_type = 'signal'").select("signal_id", F.col("event_time").alias("timestamp"), "payload.symbol", "payload.confidence", "payload.regime", "payload.top_features")
    o = events.filter("event_type = 'outcome'").select("signal_id", F.col("event_time").alias("outcome_timestamp"), "payload.outcome_label", "payload.pnl", "payload.realized_return")
    return s, o


# ---- catalogs and sinks ------------------------------------------------------------

def scan_run_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every run document under path as (path, doc)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))


def list_runs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Newest first; all of them without a limit."""
    from ..operators.models import run_table

    out = run_table(scan_run_documents(spark, path)).orderBy(F.col("created_at").desc_nulls_last())
    return out if limit is None else out.limit(limit)


ANALYSIS_SCHEMA = "id string, ticker string, created_at timestamp, model_type string, status string, signals struct<confidence:double,bias:string>, report struct<model_signals:struct<confidence:double>,summary:string>"


def list_analyses(spark: SparkSession, path: str, ticker: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest analysis summaries; confidence from signals, else the report."""
    df = spark.read.schema(ANALYSIS_SCHEMA).option("multiLine", True).json(path)
    if ticker:
        df = df.filter(F.upper("ticker") == ticker.upper())
    conf = F.coalesce("signals.confidence", "report.model_signals.confidence")
    out = df.select("id", F.upper("ticker").alias("ticker"), "created_at", "status", "model_type", conf.alias("confidence"), "signals.bias", "report.summary").orderBy(F.col("created_at").desc_nulls_last())
    return out if limit is None else out.limit(limit)


def write_analyses(rows: DataFrame, path: str) -> None:
    """Append report rows; a missing id is made of ticker and stamp."""
    rid = F.coalesce("id", F.concat_ws("-", F.lower("ticker"), F.date_format("created_at", "yyyyMMddHHmmss"))) if "id" in rows.columns else F.concat_ws("-", F.lower("ticker"), F.date_format("created_at", "yyyyMMddHHmmss"))
    rows.withColumn("id", rid).write.mode("append").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    w = w.partitionBy(*partition) if partition else w
    w.option("header", True).format(fmt).save(path)


def write_quality_report(report: DataFrame, path: str, run_id: str) -> None:
    report.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def export_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def upsert_view(df: DataFrame, keys: list[str], recorded: str = "recorded_at") -> DataFrame:
    """Append-only rows seen as a table with one current row per key."""
    from ..operators.series import latest

    return latest(df, keys, [recorded])


def fresh(df: DataFrame, at: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows younger than their time to live."""
    return df.filter(F.col(at) > now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
