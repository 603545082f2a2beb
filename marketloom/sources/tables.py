"""Market views over the given tables, each with the same view as SQL text.

The Spark views and the SQL in `CTE` state one definition twice, so that any
query over a view can be checked against plain SQL on the same files.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import declare_daily
from ..session import prepare


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; zone-less stamps become UTC timestamps."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({x: F.col(x).cast("timestamp") for x in ntz}) if ntz else df


def symbol_of(x, prefix: str = "S"):
    return F.format_string(prefix + "%05d", x)


def line_price():
    return 100.0 + 5.0 * F.ln(F.col("l_extendedprice") / F.col("l_quantity"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: symbol, timestamp, open..volume."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", line_price().alias("p"),
        # one sortable number (order, line, part) keeps min_by/max_by in a hash aggregate
        F.expr("cast(l_orderkey * 8 + l_linenumber as decimal(19,0)) * 1000000000000BD + cast(l_partkey as decimal(12,0))").alias("k"),
    )
    day = li.groupBy("l_suppkey", "l_shipdate").agg(
        F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"),
    )
    # ship dates carry no time of day, so there is one row per symbol and day
    return declare_daily(day.select(symbol_of(F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").alias("timestamp"),
                                    "open", "high", "low", "close", "volume"))


def closes_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_daily(spark, sf_dir).select("symbol", "timestamp", "close")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("symbol"), F.col("ts").alias("timestamp"),
        (100.0 + F.ln(F.col("value") + 1.0)).alias("price"), F.lit(1.0).alias("size"), "event_id", "event_type", "value", "user_id",
    )


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick as a one-tick bar (stamps are distinct)."""
    t = ticks(spark, sf_dir)
    p = F.col("price")
    return t.select("symbol", "timestamp", p.alias("open"), (p + 0.1).alias("high"), (p - 0.1).alias("low"), p.alias("close"),
                    F.col("size").alias("volume"), F.col("value").alias("dividend"), "event_id")


def benchmark_daily(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Volume-weighted mean close of all symbols per date. `bars`: the daily bars, where they are at hand."""
    b = bars_daily(spark, sf_dir) if bars is None else bars
    return declare_daily(b.groupBy("timestamp").agg((F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("close")), keys=())


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(symbol_of(F.col("s_suppkey")).alias("symbol"), F.concat(F.lit("SEC"), F.col("n_regionkey").cast("string")).alias("sector"))


def sector_daily(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Mean close per sector and date, keyed by sector. `bars`: the daily bars with their sector, where they are at hand."""
    b = closes_daily(spark, sf_dir).join(sector_map(spark, sf_dir), "symbol") if bars is None else bars
    return declare_daily(b.groupBy("sector", "timestamp").agg(F.avg("close").alias("close")), keys=("sector",))


def month_end(ts) :
    return F.last_day(ts).cast("timestamp")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    p, st, pr = F.col("o_totalprice"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    g = o.groupBy((F.col("o_custkey") % 100).alias("k"), F.last_day("o_orderdate").alias("m")).agg(
        F.sum(p).alias("revenue"),
        F.sum(F.when(st == "F", p)).alias("free_cash_flow"),
        F.sum(F.when(st == "O", p)).alias("total_debt"),
        F.sum(F.when(pr.isin("1", "2"), p)).alias("total_equity"),
        F.avg(p).alias("ebit"), F.min(p).alias("interest_expense"), F.max(p).alias("ebitda"),
        F.sum(F.when(st == "P", p)).alias("net_income"),
    )
    out = g.select(
        symbol_of(F.col("k")).alias("symbol"), (F.col("m") + F.expr("interval 15 days")).cast("timestamp").alias("filing_timestamp"),
        "revenue", "free_cash_flow", "total_debt", "total_equity", "ebit", "interest_expense", "ebitda", "net_income",
        (F.col("free_cash_flow") / F.col("revenue")).alias("gross_margin"),
        (F.col("revenue") * 10.0).alias("market_cap"), (F.col("revenue") * 8.0).alias("enterprise_value"),
    )
    return declare_daily(out, "filing_timestamp")


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    pr = F.substring("o_orderpriority", 1, 1)
    share = lambda d: F.avg(F.when(pr == d, 1.0).otherwise(0.0))
    g = o.groupBy(F.last_day("o_orderdate").alias("m")).agg(
        F.avg("o_totalprice").alias("inflation_proxy"), (F.stddev_samp("o_totalprice") / 5800.0).alias("vix"),
        (share("1") * 10.0).alias("yield_2y"), (share("2") * 10.0 + 1.0).alias("yield_10y"),
        share("3").alias("credit_spread"), share("4").alias("dollar_index"), share("5").alias("benchmark_rotation"),
    )
    return declare_daily(g.withColumn("release_timestamp", F.col("m").cast("timestamp")).drop("m"), "release_timestamp", ())


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fundamentals(spark, sf_dir)
    n = F.substring("symbol", 2, 5).cast("int")
    pick = (F.month("filing_timestamp") + n) % 7 == 0
    out = f.filter(pick).select(
        "symbol", F.col("filing_timestamp").alias("event_timestamp"),
        (F.col("filing_timestamp") - F.expr("interval 20 days")).alias("known_since"),
        (F.col("free_cash_flow") / F.col("revenue") - 0.5).alias("earnings_surprise"),
        (F.col("total_debt") / F.col("revenue") - 0.5).alias("guidance_change_proxy"),
    )
    return declare_daily(out, "event_timestamp")


def doc_stamp():
    return (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 37).cast("int")))


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 2220).alias("timestamp"), "text", "source",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), (F.col("doc_id") % 5).cast("string"))).alias("provided_ticker"),
        F.when(F.col("doc_id") % 2 == 1, "social").otherwise("news").alias("channel"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = load(spark, sf_dir, "labels")
    p = ((F.col("doc_id") * 37) % 101) / F.lit(100.0)
    return l.select(
        "doc_id", symbol_of(F.col("doc_id") % 10).alias("symbol"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 2220).alias("timestamp"),
        F.col("quality").alias("y_true"), p.alias("probability"), F.when(p >= 0.5, 1).otherwise(0).alias("prediction"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        symbol_of(F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").alias("timestamp"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"),
        F.col("l_extendedprice").alias("notional"), F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("regime"),
        "l_orderkey", "l_linenumber",
    )


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five strikes per part and side around its retail price."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    legs = F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("i")
    q = p.select("*", legs).select("*", F.explode(F.array(F.lit("call"), F.lit("put"))).alias("type"))
    spot = F.col("p_retailprice") / 10.0
    strike = spot * (0.9 + 0.045 * F.col("i"))
    bid = spot * 0.02 + (F.col("p_size") % 7) * 0.1
    return q.select(
        F.col("p_partkey").alias("underlying"), "type", F.col("i").alias("rung"), spot.alias("spot"), strike.alias("strike"),
        F.when((F.col("p_partkey") + F.col("i")) % 11 != 0, bid).alias("bid"),
        F.when((F.col("p_partkey") + F.col("i")) % 13 != 0, bid * 1.2 + 0.05).alias("ask"),
        ((F.col("p_partkey") * 7 + F.col("i") * 5) % 60).cast("double").alias("volume"),
        (0.15 + F.col("p_size") * 0.005 + F.col("i") * 0.01).alias("iv"),
    )


CTE = {
    "bars": """SELECT printf('S%05d', l_suppkey) AS symbol, l_shipdate AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low,
        arg_max(p, k) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume
      FROM (SELECT l_suppkey, l_shipdate, l_quantity, 100.0 + 5.0 * ln(l_extendedprice / l_quantity) AS p,
              {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': 100.0 + 5.0 * ln(l_extendedprice / l_quantity)} AS k FROM lineitem)
      GROUP BY 1, 2""",
    "ticks": """SELECT 'T' || CAST(user_id % 5 AS VARCHAR) AS symbol, ts, 100.0 + ln(value + 1.0) AS price, 1.0::DOUBLE AS size,
        event_id, event_type, value, user_id FROM events""",
    "minute_bars": """SELECT symbol, ts, price AS open, price + 0.1 AS high, price - 0.1 AS low, price AS close, size AS volume,
        value AS dividend, event_id FROM ticks""",
    "bench": "SELECT ts, sum(close * volume) / sum(volume) AS close FROM bars GROUP BY 1",
    "sectors": """SELECT printf('S%05d', s_suppkey) AS symbol, 'SEC' || CAST(n_regionkey AS VARCHAR) AS sector
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "sector_bars": "SELECT sector, ts, avg(close) AS close FROM bars JOIN sectors USING (symbol) GROUP BY 1, 2",
    "funds": """SELECT printf('S%05d', k) AS symbol, CAST(m + INTERVAL 15 DAY AS TIMESTAMP) AS filing_ts, revenue, free_cash_flow, total_debt,
        total_equity, ebit, interest_expense, ebitda, net_income, free_cash_flow / revenue AS gross_margin,
        revenue * 10.0 AS market_cap, revenue * 8.0 AS enterprise_value
      FROM (SELECT o_custkey % 100 AS k, last_day(o_orderdate) AS m, sum(o_totalprice) AS revenue,
          sum(o_totalprice) FILTER (o_orderstatus = 'F') AS free_cash_flow, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS total_debt,
          sum(o_totalprice) FILTER (o_orderpriority[1] IN ('1', '2')) AS total_equity, avg(o_totalprice) AS ebit,
          min(o_totalprice) AS interest_expense, max(o_totalprice) AS ebitda,
          sum(o_totalprice) FILTER (o_orderstatus = 'P') AS net_income
        FROM orders GROUP BY 1, 2)""",
    "macro": """SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS release_ts, avg(o_totalprice) AS inflation_proxy,
        stddev_samp(o_totalprice) / 5800.0 AS vix,
        avg(CASE WHEN o_orderpriority[1] = '1' THEN 1.0 ELSE 0.0 END) * 10.0 AS yield_2y,
        avg(CASE WHEN o_orderpriority[1] = '2' THEN 1.0 ELSE 0.0 END) * 10.0 + 1.0 AS yield_10y,
        avg(CASE WHEN o_orderpriority[1] = '3' THEN 1.0 ELSE 0.0 END) AS credit_spread,
        avg(CASE WHEN o_orderpriority[1] = '4' THEN 1.0 ELSE 0.0 END) AS dollar_index,
        avg(CASE WHEN o_orderpriority[1] = '5' THEN 1.0 ELSE 0.0 END) AS benchmark_rotation
      FROM orders GROUP BY 1""",
    "earn": """SELECT symbol, filing_ts AS event_ts, filing_ts - INTERVAL 20 DAY AS known_since,
        free_cash_flow / revenue - 0.5 AS earnings_surprise, total_debt / revenue - 0.5 AS guidance_change_proxy
      FROM funds WHERE (month(filing_ts) + CAST(symbol[2:] AS INTEGER)) % 7 = 0""",
    "texts": """SELECT doc_id, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts, text, source,
        CASE WHEN doc_id % 3 = 0 THEN 'T' || CAST(doc_id % 5 AS VARCHAR) END AS provided_ticker,
        CASE WHEN doc_id % 2 = 1 THEN 'social' ELSE 'news' END AS channel FROM documents""",
    "preds": """SELECT doc_id, printf('S%05d', doc_id % 10) AS symbol, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 37) AS ts,
        quality AS y_true, ((doc_id * 37) % 101) / 100.0 AS probability,
        CASE WHEN ((doc_id * 37) % 101) / 100.0 >= 0.5 THEN 1 ELSE 0 END AS prediction FROM labels""",
    "trades": """SELECT printf('S%05d', l_suppkey) AS symbol, l_shipdate AS ts, l_extendedprice * (l_discount - l_tax) AS pnl,
        l_extendedprice AS notional, l_returnflag AS strategy, l_linestatus AS regime, l_orderkey, l_linenumber FROM lineitem""",
    "quotes": """SELECT p_partkey AS underlying, t.type, i.i AS rung, p_retailprice / 10.0 AS spot,
        p_retailprice / 10.0 * (0.9 + 0.045 * i.i) AS strike,
        CASE WHEN (p_partkey + i.i) % 11 <> 0 THEN (p_retailprice / 10.0 * 0.02 + (p_size % 7) * 0.1) END AS bid,
        CASE WHEN (p_partkey + i.i) % 13 <> 0 THEN (p_retailprice / 10.0 * 0.02 + (p_size % 7) * 0.1) * 1.2 + 0.05 END AS ask,
        CAST((p_partkey * 7 + i.i * 5) % 60 AS DOUBLE) AS volume, 0.15 + p_size * 0.005 + i.i * 0.01 AS iv
      FROM part, (VALUES ('call'), ('put')) t(type), range(5) i(i)""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """`body` (and the `extra` CTEs before it) preceded by the views it names."""
    extra = extra or {}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in extra and re.search(rf"\b{name}\b", text) and name not in order:
                visit(CTE[name].replace(name, "") if name == "macro" else CTE[name])
                if name not in order:
                    order.append(name)

    for text in extra.values():
        visit(text)
    visit(body)
    texts = {n: CTE[n] for n in order} | extra
    # A view that several others read is computed once, unless it reads itself.
    once = lambda n, t: not re.search(rf"\b{n}\b", t) and sum(len(re.findall(rf"\b{n}\b", x)) for x in (body, *texts.values())) > 1
    parts = [f"{n} AS {'MATERIALIZED ' if once(n.split('(')[0], t) else ''}({t})" for n, t in texts.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
