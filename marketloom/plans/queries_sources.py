"""Source, event-log, dataset and feature-registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as FL
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .dataset import DatasetRequest, build_dataset
from .queries_bars import GATE_POLICY, raw_bars
from .queries_technical import K, LAG, over, roll
from .registry import FeatureSpec, default_registry


@query("bars_time_slice", "S1 S2", f"SELECT {K}, {rd('close', 'close')} FROM bars WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def bars_time_slice(spark, sf):
    return present(FL.slice_frame(src.closes_daily(spark, sf), "1997-01-01", "1997-06-30"))


@query("lineitem_slice_scan", "S2", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-02-15'")
def lineitem_slice_scan(spark, sf):
    """The bounds are compared in the file's own type, so they are pushed down."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return FL.slice_frame(li, "1998-01-01", "1998-02-15", "l_shipdate").select("l_orderkey", "l_linenumber", "l_quantity")


@query("history_projection", "S4", f"SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, {rds('open high low close volume')} FROM bars")
def history_projection(spark, sf):
    b = src.bars_daily(spark, sf)
    return present(FL.project_history(b.toDF(*[c.capitalize() if c != "timestamp" else "Date" for c in b.columns]).withColumnRenamed("Symbol", "symbol")))


@query("event_log_rows", "S8 S9 V6",
       """SELECT event_type, signal_id, month, n FROM (SELECT 'signal' AS event_type, CAST(event_id AS VARCHAR) AS signal_id, strftime(ts, '%Y-%m') AS month, 2::BIGINT AS n FROM events WHERE event_type = 'click'
          UNION ALL SELECT 'outcome', CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m'), NULL FROM events WHERE event_type = 'purchase')""")
def event_log_rows(spark, sf):
    e = src.load(spark, sf, "events")
    sid = F.col("event_id").cast("string").alias("signal_id")
    s = e.filter("event_type = 'click'").select(sid, F.col("ts").alias("timestamp"), F.lit("T").alias("symbol"), F.lit(0.5).alias("confidence"), F.lit("calm").alias("regime"), F.lit(0.6).alias("prediction"), F.array(F.lit(" rsi "), F.lit(""), F.lit("adx")).alias("top_features"))
    o = e.filter("event_type = 'purchase'").select(sid, F.col("ts").alias("outcome_timestamp"), "value").withColumnRenamed("value", "pnl")
    d = FL.signal_events(s).unionByName(FL.outcome_log_events(o))
    return present(d.select("event_type", "signal_id", "month", F.size("payload.top_features").alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n"))))


@query("dataset_build", "Q20 Q14 J2 A1")
def dataset_build(spark, sf):
    d, _ = build_dataset(raw_bars(spark, sf), DatasetRequest(policy=GATE_POLICY, timeframe="1w", order=("seq",)), fundamentals=src.fundamentals(spark, sf), macro=src.macro(spark, sf))
    return present(d.select("symbol", "timestamp", "open", "high", "low", "close", "volume", "fund__revenue", "macro__vix"))


@query("feature_registry_pass", "W23 Y1 E10",
       f"""SELECT {K}, {rd('close / lag(close, 5) ' + LAG + ' - 1', 'ret_simple_h5')}, {rd(roll('avg', 'close', 20), 'sma_w20')}, {rd(roll('max', 'high', 20, prior=True), 'hi')} FROM bars""")
def feature_registry_pass(spark, sf):
    """Several plugins in one blocked pass through the registry."""
    reg = default_registry()
    d, _ = reg.generate(src.bars_daily(spark, sf), [FeatureSpec("returns"), FeatureSpec("trend"), FeatureSpec("momentum"), FeatureSpec("volatility"), FeatureSpec("structure"), FeatureSpec("gaps"), FeatureSpec("volume")])
    return present(d.select("symbol", "timestamp", "ret_simple_h5", "sma_w20", (F.col("close") / (F.col("dist_to_high_w20") + 1.0) - 1e-9).alias("hi")))
