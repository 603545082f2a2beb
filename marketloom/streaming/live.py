"""The live counterparts as Structured Streaming transforms.

Every function takes streaming DataFrames and returns a streaming DataFrame or
starts a writer; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import title_key


def live_bars(ticks: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV bars; ticks later than the watermark are dropped."""
    at = F.struct("timestamp", *[c for c in ("event_id",) if c in ticks.columns])
    g = ticks.withWatermark("timestamp", late).groupBy("symbol", F.window("timestamp", size)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return g.select("symbol", F.col("window.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def latest_prices(quotes: DataFrame) -> DataFrame:
    """Newest quote per symbol, for update mode."""
    return quotes.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"), F.max_by("price", "timestamp").alias("price"))


def alert_hits(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Quotes that meet a static alert of their symbol."""
    a = alerts.filter("status = 'active'").select("id", "symbol", "alert_type", "threshold")
    j = quotes.join(a, "symbol")
    return j.filter(((F.col("alert_type") == "above") & (F.col("price") > F.col("threshold"))) | ((F.col("alert_type") == "below") & (F.col("price") < F.col("threshold"))))


def write_alerts_once(hits: DataFrame, table_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the first hit of each alert; later hits of it are skipped."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("id").agg(F.min_by(F.struct("symbol", "timestamp", "price", "threshold"), "timestamp").alias("r")).select("id", "r.*")
        try:
            seen = spark.read.parquet(table_path).filter(F.col("epoch") != epoch).select("id")
        except AnalysisException:  # nothing was written yet
            seen = spark.createDataFrame([], "id bigint")
        # one folder per epoch, overwritten, so that a replayed batch adds nothing
        first.join(seen, "id", "left_anti").write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")

    return hits.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedupe_news(articles: DataFrame, time: str = "published", late: str = "2 days") -> DataFrame:
    """First article of each title key inside the watermark."""
    return articles.withColumn("title_key", title_key("title")).withWatermark(time, late).dropDuplicatesWithinWatermark(["title_key"])


def mention_windows(mentions: DataFrame, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding mention counts per symbol."""
    g = mentions.withWatermark("timestamp", late).groupBy(F.window("timestamp", size, slide), "symbol").agg(F.count("*").alias("mention_count"), F.avg("score").alias("sentiment_score"))
    return g.select(F.col("window.end").alias("window_end"), "symbol", "mention_count", "sentiment_score")


def append_event_log(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Monthly JSON files with exactly-once appends."""
    d = events if "month" in events.columns else events.withColumn("month", F.date_format("event_time", "yyyy-MM"))
    return d.writeStream.format("json").partitionBy("month").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pair_signals(signals: DataFrame, outcomes: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Signals with their outcome inside the horizon; unresolved ones come out
    once the watermark has passed."""
    s = signals.withWatermark("timestamp", "1 hour").alias("s")
    o = outcomes.withWatermark("outcome_timestamp", "1 hour").withColumnRenamed("signal_id", "o_id").alias("o")
    cond = F.expr(f"signal_id = o_id AND outcome_timestamp >= timestamp AND outcome_timestamp <= timestamp + interval {horizon}")
    return s.join(o, cond, "leftOuter")


class _Latch(StatefulProcessor):
    """Peak equity and kill switch of one account."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latch", "peak double, killed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        peak, killed = self.state.get() if self.state.exists() else (0.0, False)
        pdf = pd.concat(list(rows)).sort_values("timestamp")
        tops = pdf["equity"].cummax().clip(lower=peak)
        drops = (1.0 - pdf["equity"] / tops.where(tops > 0)).fillna(0.0)
        latched = (drops >= self.limit).cummax() | bool(killed)
        self.state.update((float(tops.iloc[-1]), bool(latched.iloc[-1])))
        yield pd.DataFrame({"account": key[0], "timestamp": pdf["timestamp"].to_numpy(), "peak": tops.to_numpy(), "drawdown": drops.to_numpy(), "kill_switch": latched.to_numpy()})

    def close(self) -> None:
        pass


def kill_switch(equity: DataFrame, limit: float = 0.15) -> DataFrame:
    """Drawdown latch per account as stateful stream processing."""
    return equity.groupBy("account").transformWithStateInPandas(
        _Latch(limit), outputStructType="account string, timestamp timestamp, peak double, drawdown double, kill_switch boolean", outputMode="append", timeMode="none")
