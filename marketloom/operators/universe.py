"""Universe builders: listings, mentions, their union, and row views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.expr import first_alias, num, symbol_or_null
from .dedupe import keep_first, post_key
from .series import attach_row, latest, top_per_key


def common_stock(name) -> Column:
    """Accept hints win over reject hints; an empty name passes."""
    n = F.lower(F.trim(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))))
    has = lambda words: n.rlike("|".join(words))
    return (n == "") | has(L.COMMON_STOCK_HINTS) | ~has(L.OTHER_SECURITY_HINTS)


def listed_symbols(directory: DataFrame) -> DataFrame:
    """Pipe-listing rows without test issues, funds and odd securities."""
    get = lambda *names: first_alias(directory.columns, list(names))
    sym, name, test, etf = get("Symbol"), get("Security Name"), get("Test Issue"), get("ETF")
    flag = lambda c: F.upper(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) == "Y" if c else F.lit(False)
    full = F.when(F.trim(F.col(f"`{name}`")) != "", F.trim(F.col(f"`{name}`"))) if name else F.lit(None)
    d = directory.filter(~F.col(f"`{sym}`").startswith("File Creation Time")).filter(~flag(test) & ~flag(etf))
    d = d.select(symbol_or_null(F.col(f"`{sym}`")).alias("symbol"), F.coalesce(full, F.trim(F.col(f"`{sym}`"))).alias("company_name"))
    return d.filter(F.col("symbol").isNotNull() & common_stock("company_name"))


def normalize_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Sanitised symbols, the first row of each kept."""
    d = df.withColumn("symbol", symbol_or_null("symbol")).filter("symbol is not null")
    return keep_first(d, F.col("symbol"), [order] if order else [c for c in d.columns if c != "symbol"], d.columns)


def with_profiles(listing: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile fields win over listing fields."""
    p = profiles.select("symbol", *[F.col(c).alias(f"_p_{c}") for c in profiles.columns if c != "symbol"])
    d = listing.join(p, "symbol", "left")
    have = set(d.columns)
    pick = lambda c: F.coalesce(*[F.col(x) for x in (f"_p_{c}", c) if x in have], F.lit(None))
    return d.select("symbol", F.coalesce(pick("company_name"), F.col("symbol")).alias("company_name"), pick("market_cap").cast("double").alias("market_cap"),
                    pick("avg_dollar_volume").cast("double").alias("avg_dollar_volume"), pick("sector").cast("string").alias("sector"), pick("industry").cast("string").alias("industry"))


def _or(c: str, default) -> Column:
    """Value, or `default` when missing or zero."""
    return F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.lit(default)).otherwise(F.col(c))


def top_listing(enriched: DataFrame, top_n: int = 500, min_dollar_volume: float = 10_000_000.0) -> DataFrame:
    """Liquid symbols by market cap, or by dollar volume when no cap is known.

    With too few liquid symbols all of them are ranked together.
    """
    liquid = F.coalesce(F.col("avg_dollar_volume") >= min_dollar_volume, F.lit(False))
    facts = enriched.agg(F.max((F.coalesce("market_cap", F.lit(0.0)) > 0).cast("int")).alias("_cap"), F.count_if(liquid).alias("_n"))
    d = attach_row(enriched, facts).filter(liquid | (F.col("_n") < top_n))
    caps = F.col("_cap") == 1
    d = d.withColumn("ranking", F.when(caps, "market_cap_desc_then_avg_dollar_volume_desc").otherwise("avg_dollar_volume_desc_fallback"))
    order = [F.when(caps, _or("market_cap", -1.0)).desc_nulls_last(), F.when(caps, _or("avg_dollar_volume", -1.0)).otherwise(F.coalesce("avg_dollar_volume", F.lit(0.0))).desc(), F.col("symbol").desc()]
    return d.orderBy(*order).limit(top_n).drop("_cap", "_n")


def posts_with_tickers(posts: DataFrame, valid: list[str] | None = None, positive=L.POST_POSITIVE, negative=L.POST_NEGATIVE, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Posts without repeats, with their tickers and sentiment.

    Tickers and scores are computed first, so only they, and not the texts,
    travel with the text hash.
    """
    title, body = F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("body"), F.lit(""))
    d = posts.withColumns({"_content": F.trim(F.concat_ws(" ", title, body)), "_norm": post_key(title, body)}).filter("_norm != ''")
    tick = X.post_tickers("_content")
    if valid is not None:
        tick = F.array_intersect(tick, F.array(*[F.lit(v) for v in valid]))
    d = d.select("id", F.substring(title, 1, 160).alias("title"), *[F.col(o) for o in order if o != "id"], tick.alias("tickers"),
                 X.post_score(F.col("_norm"), positive, negative).alias("score"), F.sha2("_norm", 256).alias("_key"))
    return keep_first(d, F.col("_key"), list(order), [c for c in d.columns if c != "_key"])


def mention_counts(posts: DataFrame, window_days: int = 7, order: tuple[str, ...] = ("id",), examples: bool = True) -> DataFrame:
    """Mentions, velocity, mean sentiment and first three example posts."""
    m = posts.select(F.explode("tickers").alias("symbol"), *order, *[c for c in ("id", "title") if c not in order], "score")
    days = float(max(1, window_days))
    g = m.groupBy("symbol").agg(F.count("*").alias("mention_count"), F.round(F.avg("score"), 6).alias("sentiment_score"))
    g = g.withColumn("mention_velocity", F.col("mention_count") / days)
    if not examples:
        return g
    first = top_per_key(m, ["symbol"], [F.col(o) for o in order], 3)
    ex = first.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_rank", F.col("id").cast("string").alias("id"), "title"))).alias("_x"))
    ex = ex.select("symbol", F.transform("_x", lambda e: e["id"]).alias("example_post_ids"), F.transform("_x", lambda e: e["title"]).alias("example_titles"))
    return g.join(ex, "symbol", "left")


def top_mentions(counts: DataFrame, top_n: int = 500) -> DataFrame:
    return counts.orderBy(F.desc("mention_count"), F.desc("mention_velocity"), F.desc("symbol")).limit(top_n)


def posts_in_window(posts: DataFrame, end, days: int = 7, time: str = "created_at", max_posts: int | None = None) -> DataFrame:
    t = F.lit(end).cast("timestamp")
    d = posts.filter((F.col(time) >= t - F.make_interval(days=F.lit(max(1, days)))) & (F.col(time) <= t))
    return d.orderBy(F.desc(time)).limit(max_posts) if max_posts else d


def combined(listing: DataFrame, mentions: DataFrame, top_n: int = 1000) -> DataFrame:
    """Both universes by symbol; rows in both come first."""
    a = listing.withColumn("symbol", symbol_or_null("symbol")).filter("symbol is not null").withColumn("_a", F.lit(True))
    m = mentions.withColumn("symbol", symbol_or_null("symbol")).filter("symbol is not null").select("symbol", "mention_count", "mention_velocity", "sentiment_score", F.lit(True).alias("_m"))
    d = a.join(m, "symbol", "full_outer")
    src = F.array_compact(F.array(F.when(F.col("_a"), "nasdaq_top_500"), F.when(F.col("_m"), "wsb_top_500")))
    d = d.select("symbol", F.coalesce("company_name", "symbol").alias("company_name"), "market_cap", "avg_dollar_volume", "sector", "industry",
                 F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("mention_velocity", F.lit(0.0)).alias("mention_velocity"), "sentiment_score", src.alias("sources"))
    return d.orderBy(F.size("sources").desc(), _or("market_cap", -1.0).desc(), _or("mention_count", -1).desc(), _or("avg_dollar_volume", -1.0).desc(), F.desc("symbol")).limit(top_n)


def merge_watchlist(listing: DataFrame, watch: DataFrame) -> DataFrame:
    """Listing and watchlist by symbol; watchlist name and sector win."""
    w = watch.select("symbol", F.col("company_name").alias("_n"), F.col("sector").alias("_s"), F.lit(True).alias("_w"))
    d = listing.select("symbol", "company_name", "sector", F.lit(True).alias("_l")).join(w, "symbol", "full_outer")
    return d.select("symbol", F.coalesce("_n", "company_name", "symbol").alias("company_name"), F.coalesce("_s", "sector").alias("sector"),
                    F.array_compact(F.array(F.when(F.col("_l"), "listing"), F.when(F.col("_w"), "watchlist"))).alias("sources"))


def listing_order(df: DataFrame, n: int) -> DataFrame:
    """Rows with a market cap by cap, then the rest by symbol."""
    return df.orderBy(F.col("market_cap").isNull(), F.desc("market_cap"), "symbol").limit(n)


def min_mentions(mentions: DataFrame, fallback: DataFrame, least: int, n: int) -> DataFrame:
    """Symbols with enough mentions, padded with fallback symbols at 0."""
    good = mentions.filter(F.col("mention_count") >= least).select("symbol", "mention_count", F.lit(0).alias("_pad"))
    pad = fallback.select("symbol").join(good.select("symbol"), "symbol", "left_anti").select("symbol", F.lit(0).cast("bigint").alias("mention_count"), F.lit(1).alias("_pad"))
    return good.unionByName(pad).orderBy("_pad", F.desc("mention_count"), "symbol").limit(n).drop("_pad")


def pad_to(symbols: DataFrame, n: int, prefix: str = "SYN") -> DataFrame:
    """At least n symbols, missing ones generated."""
    spark = symbols.sparkSession
    have = symbols.select("symbol", F.lit(0).alias("_g"))
    made = spark.range(1, n + 1).select(F.format_string(prefix + "%04d", "id").alias("symbol"), F.lit(1).alias("_g"))
    return have.unionByName(made.join(have.select("symbol"), "symbol", "left_anti")).orderBy("_g", "symbol").limit(n).drop("_g")


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Symbols of several lists, the earlier list winning."""
    tagged = [p.select("symbol", F.lit(i).alias("list_no")) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out.groupBy("symbol").agg(F.min("list_no").alias("list_no"))


def row_view(df: DataFrame) -> DataFrame:
    """Eight output columns from any spelling, numbers coerced."""
    spell = {
        "symbol": ["symbol", "ticker"], "name": ["name", "company_name", "company"], "sector": ["sector"], "market_cap": ["market_cap", "marketCap"],
        "avg_volume_7d": ["avg_volume_7d", "avg_volume"], "change_pct_1d": ["change_pct_1d", "change_percent_1d"], "mentions": ["mentions", "mention_count"],
        "analysis_date": ["analysis_date", "last_analysis_date"],
    }
    def pick(k):
        cols = [first_alias(df.columns, [s]) for s in spell[k]]
        cols = [F.col(c) if k not in ("market_cap", "avg_volume_7d", "change_pct_1d", "mentions") else num(c) for c in cols if c]
        return (F.coalesce(*cols) if cols else F.lit(None)).alias(k)
    return df.select(*[pick(k) for k in spell])


def fill_metadata(rows: DataFrame, meta: DataFrame, now, ttl_seconds: int = 12 * 3600, limit: int | None = None) -> DataFrame:
    """Missing fields from fresh metadata, for at most `limit` lacking rows."""
    fresh = latest(meta.filter(F.col("cached_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(ttl_seconds))), ["symbol"], ["cached_at"])
    names = [c for c in fresh.columns if c not in ("symbol", "cached_at")]
    lacking = F.lit(False)
    for c in names:
        lacking = lacking | F.col(c).isNull()
    if limit is not None:
        pick = rows.filter(lacking).select("symbol").orderBy("symbol").limit(limit)
        fresh = fresh.join(pick, "symbol", "left_semi")
    f = fresh.select("symbol", *[F.col(c).alias(f"_f_{c}") for c in names])
    return rows.join(f, "symbol", "left").withColumns({c: F.coalesce(c, f"_f_{c}") for c in names}).drop(*[f"_f_{c}" for c in names])


def table_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free content hash of a universe table of bounded size (top-N)."""
    rows = df.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("universe_hash"), F.count("*").alias("rows"))


def wide_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    """Content hash of a table of any size: combined per hash prefix first."""
    rows = df.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h"))
    part = rows.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("s"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", F.col("n").cast("string"), F.col("s").cast("string")))), ""), 256).alias("universe_hash"), F.sum("n").alias("rows"))


def catalogue(universe_rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Name, row count, version, stamp and hash per universe."""
    return universe_rows.groupBy("universe").agg(F.count("*").alias("count")).join(headers, "universe", "left")


def placeholder_listing(symbols: DataFrame) -> DataFrame:
    n = lambda t: F.lit(None).cast(t)
    return symbols.select("symbol", F.col("symbol").alias("company_name"), n("double").alias("market_cap"), n("double").alias("avg_dollar_volume"), n("string").alias("sector"), n("string").alias("industry"))


def placeholder_mentions(symbols: DataFrame, count: Column) -> DataFrame:
    return symbols.select("symbol", count.cast("bigint").alias("mention_count"), (count / 7.0).alias("mention_velocity"), F.lit(None).cast("double").alias("sentiment_score"))


def watchlist_state(events: DataFrame) -> DataFrame:
    """Current watchlist from add/remove events (newest event wins)."""
    e = events.withColumn("symbol", symbol_or_null("symbol")).filter("symbol is not null")
    return latest(e, ["symbol"], ["at"]).filter("action = 'add'")


def rebuild(enriched: DataFrame, posts: DataFrame, path: str, *, listing_n: int = 500, mention_n: int = 100, combined_n: int = 1000, window_days: int = 7) -> None:
    """Daily rebuild: the listing, mention and combined tables, in that order.

    Each step reads what the step before wrote, so nothing is computed twice.
    """
    spark = enriched.sparkSession
    top_listing(enriched, listing_n).write.mode("overwrite").parquet(f"{path}/listing")
    top_mentions(mention_counts(posts_with_tickers(posts), window_days), mention_n).write.mode("overwrite").parquet(f"{path}/mentions")
    combined(spark.read.parquet(f"{path}/listing"), spark.read.parquet(f"{path}/mentions"), combined_n).write.mode("overwrite").parquet(f"{path}/combined")
