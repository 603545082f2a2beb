"""Article symbols, keyword sentiment, clusters and market mood."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .dedupe import keep_first
from .series import top_per_key

# Theme words, tested in this order; a title counts once.
CLUSTERS = {
    "earnings": ["earnings", "guidance", "eps", "revenue", "quarter"],
    "analyst": ["analyst", "upgrade", "downgrade", "target", "rating"],
    "macro": ["inflation", "fed", "rates", "economy", "macro"],
    "product": ["launch", "product", "chip", "ai", "platform", "service"],
    "deal": ["acquisition", "merger", "partnership", "contract", "deal"],
    "legal": ["lawsuit", "regulator", "probe", "investigation", "settlement"],
}
# Words of a title's tone.
TONE_POSITIVE = (
    "beat", "growth", "upgrade", "record", "strong", "expands", "launch", "partnership",
)
TONE_NEGATIVE = (
    "miss", "downgrade", "lawsuit", "probe", "cuts", "weak", "decline", "delay",
)


def dedupe_titles(articles: DataFrame, time: str = "published", order: tuple[str, ...] = ()) -> DataFrame:
    """Newest article per title key."""
    newest = [(-F.unix_micros(time)).alias("_t"), *[F.col(x) for x in order]]
    return keep_first(articles, X.title_key("title"), newest, articles.columns)


def score_articles(articles: DataFrame) -> DataFrame:
    s = X.keyword_score("text")
    d = articles.withColumn("sentiment_score", s)
    return d.withColumn("sentiment_label", X.three_way(F.col("sentiment_score"), 0.3))


def sentiment_by_symbol(articles: DataFrame, top: int = 5) -> DataFrame:
    """Mean score, counts, label, trend flag and strongest headlines."""
    e = articles.select(F.explode("symbols").alias("symbol"), "article_id", "title", "sentiment_score")
    s = F.col("sentiment_score")
    g = e.groupBy("symbol").agg(
        F.avg(s).alias("score"), F.count("*").alias("article_count"), F.count_if(s > 0.2).alias("positive_count"), F.count_if(s < -0.2).alias("negative_count"), F.count(s).alias("_n"),
    ).filter("score is not null")
    g = g.withColumns({"label": X.three_way(F.col("score"), 0.2), "neutral_count": F.col("_n") - F.col("positive_count") - F.col("negative_count"), "trending": F.col("article_count") >= 5}).drop("_n")
    best = top_per_key(e, ["symbol"], [F.abs(F.coalesce(s, F.lit(0.0))).desc(), F.col("article_id")], top)
    heads = best.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda x: x["title"]).alias("top_headlines"))
    return g.join(heads, "symbol", "left")


def market_sentiment(by_symbol: DataFrame) -> DataFrame:
    g = by_symbol.agg(F.avg("score").alias("score"), F.count("*").alias("symbols_analyzed"), F.count_if(F.col("label") == "BULLISH").alias("bullish_count"), F.count_if(F.col("label") == "BEARISH").alias("bearish_count"))
    return g.withColumn("label", X.three_way(F.col("score"), 0.1))


def movers(by_symbol: DataFrame, n: int = 10) -> DataFrame:
    up = by_symbol.filter("score > 0").orderBy(F.desc("score"), "symbol").limit(n).withColumn("side", F.lit("bullish"))
    dn = by_symbol.filter("score < 0").orderBy("score", "symbol").limit(n).withColumn("side", F.lit("bearish"))
    return up.unionByName(dn)


def cluster_of(title):
    t = F.lower(F.coalesce(title, F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    expr = None
    for name, words in CLUSTERS.items():
        expr = F.when(hit(words), name) if expr is None else expr.when(hit(words), name)
    return expr.otherwise("general"), hit(TONE_POSITIVE), hit(TONE_NEGATIVE)


def clusters(articles: DataFrame, key: str = "symbol") -> DataFrame:
    """Headlines per key and theme."""
    c, _, _ = cluster_of(F.col("title"))
    return articles.groupBy(key, c.alias("cluster")).agg(F.count("*").alias("headlines"))


def tone(articles: DataFrame, key: str = "symbol") -> DataFrame:
    _, p, n = cluster_of(F.col("title"))
    g = articles.groupBy(key).agg(F.count("*").alias("headline_count"), F.count_if(p).alias("_p"), F.count_if(n).alias("_n"))
    return g.select(key, "headline_count", F.when(F.col("_p") > F.col("_n") + 1, "constructive").when(F.col("_n") > F.col("_p") + 1, "cautious").otherwise("mixed").alias("tone"))
