"""Text events, sentiment, mentions, news and universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.expr import symbol_or_null
from ..operators import bars as B
from ..operators import dedupe as DD
from ..operators import news as N
from ..operators import sentiment as S
from ..operators import universe as U
from ..sources import tables as src
from .catalog import present, query, rd, rds, ts
from .queries_technical import LAG

# The given texts use invented words, so their frequent ones form the lexicon.
POS, NEG = ("the", "la", "que", "and", "tion"), ("of", "der", "und", "de", "les")
CFG = S.SentimentConfig(positive=POS, negative=NEG)
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOK = f"[x for x in string_split({NORM}, ' ') if length(x) > 0]"
CRED = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.SOURCE_CREDIBILITY.items()) + " ELSE 0.7 END"
EV = {
    "tk": "SELECT *, " + TOK.format(x="text") + " AS tok FROM texts",
    "sc": f"""SELECT *, greatest(least(4.0 * (len([w for w in tok if w IN {_in(POS)}]) - len([w for w in tok if w IN {_in(NEG)}])) / (len(tok) + 2.0), 1.0), -1.0)::DOUBLE AS score,
        ({CRED}) * CASE WHEN channel = 'social' THEN 0.65 ELSE 1.0 END AS weight FROM tk""",
}


@query("text_event_scores", "T1 T4 T5 N1 X1",
       f"SELECT doc_id, len(tok) AS tokens, {rd('score', 'sentiment_score')}, CASE WHEN score > 0.08 THEN 'BULLISH' WHEN score < -0.08 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment_label, {rd('weight', 'source_weight')} FROM sc", EV)
def text_event_scores(spark, sf):
    d = S.score_events(src.text_events(spark, sf), CFG)
    return present(d.select("doc_id", F.size(X.tokenize("text")).alias("tokens"), "sentiment_score", "sentiment_label", "source_weight"))


@query("text_tickers", "T2 X6")
def text_tickers(spark, sf):
    d = S.score_events(src.text_events(spark, sf), CFG).filter(F.size("linked_tickers") > 0)
    return present(d.select("doc_id", "primary_ticker", "linked_tickers"))


@query("near_duplicate_texts", "T3 X11")
def near_duplicate_texts(spark, sf):
    """Accepted documents; the greedy rule is checked by brute force in tests."""
    return present(DD.dedupe_near_identical(src.text_events(spark, sf), id_col="doc_id"))


HOURS = {"tl": "SELECT DISTINCT symbol, date_trunc('hour', ts) AS ts FROM ticks"}
SENT_W = {"4H": 4, "1D": 24}


def _win_cte(h: int) -> str:
    return f"""SELECT t.symbol, t.ts, count(e.score) AS n, coalesce(sum(e.w), 0) AS sw, sum(e.w * e.score) AS swv, sum(e.w * e.score * e.score) AS swvv FROM tl t
      LEFT JOIN (SELECT t.symbol AS s2, t.ts AS t2, e.score, e.weight * exp(-ln(2.0) / 360.0 * date_diff('second', e.ts, t.ts) / 60.0) AS w FROM tl t JOIN sc e
        ON e.ts <= t.ts AND e.ts > t.ts - INTERVAL {h} HOUR AND (e.provided_ticker IS NULL OR e.provided_ticker = t.symbol)) e ON e.s2 = t.symbol AND e.t2 = t.ts GROUP BY 1, 2"""


Z20 = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_zs = lambda x: f"CASE WHEN count({x}) {Z20} >= 10 THEN ({x} - avg({x}) {Z20}) / (stddev_samp({x}) {Z20} + 1e-9) END"


@query("sentiment_windows", "T6 T7 J10",
       f"SELECT symbol, {ts('ts')}, " + ", ".join(
           rd(f"m{w}", f"sent_sentiment_mean_w{w}") + ", " + rd(f"sqrt(greatest(swvv{w} / sw{w} - m{w} * m{w}, 0 * m{w}))", f"sent_sentiment_vol_w{w}") + ", " + rd(f"n{w}", f"sent_attention_count_w{w}") + ", "
           + rd(f"sw{w}", f"sent_attention_weighted_w{w}") + ", " + rd(f"m{w} - lag(m{w}) {LAG}", f"sent_sentiment_change_w{w}") + f", round(za{w}, 5) + 0.0 AS sent_attention_z_w{w}, round(zm{w}, 5) + 0.0 AS sent_sentiment_z_w{w}, "
           + f"CASE WHEN coalesce(abs(za{w}) >= 2, false) OR coalesce(abs(zm{w}) >= 2, false) THEN 1.0 ELSE 0.0 END::DOUBLE AS sent_spike_flag_w{w}" for w in SENT_W) + " FROM z",
       {**EV, **HOURS, **{f"w{w}": _win_cte(h) for w, h in SENT_W.items()},
        "j": "SELECT a.symbol, a.ts, " + ", ".join(f"{w}_.n AS n{w}, {w}_.sw AS sw{w}, {w}_.swv / CASE WHEN {w}_.sw > 1e-12 THEN {w}_.sw END AS m{w}, {w}_.swvv AS swvv{w}".replace("4H_", "a").replace("1D_", "b") for w in SENT_W)
             + " FROM w4H a JOIN w1D b ON a.symbol = b.symbol AND a.ts = b.ts",
        "z": "SELECT *, " + ", ".join(f"{_zs(f'sw{w}')} AS za{w}, {_zs(f'm{w}')} AS zm{w}" for w in SENT_W) + " FROM j"})
def sentiment_windows(spark, sf):
    """All eight columns of both windows. The z columns are compared to five digits: they divide by deviations that may be near the epsilon."""
    tl = src.ticks(spark, sf).select("symbol", F.date_trunc("hour", "timestamp").alias("timestamp")).distinct()
    ev = src.text_events(spark, sf).withColumns({
        "sentiment_score": X.lexicon_score("text", POS, NEG), "source_weight": X.source_weight("source", "channel"), "primary_ticker": F.col("provided_ticker")})
    d = S.sentiment_features(tl, ev.select("timestamp", "primary_ticker", "sentiment_score", "source_weight"), CFG)
    return present(d.withColumns({x: F.round(x, 5) if "_z_" in x else F.col(x).cast("double") for x in d.columns if x.startswith("sent_")}))


def posts(spark, sf):
    d = src.load(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("body"))


WORDS = r"[x for x in list_distinct(regexp_split_to_array(upper(replace({x}, 'ß', 'SS')), '[^\p{{L}}\p{{N}}_]+')) if regexp_full_match(x, '[A-Z]{{1,5}}') AND x NOT IN " + _in(L.POST_STOPWORDS) + "]"
PO = {
    "p0": f"SELECT doc_id, source || ' ' || text AS content, {NORM.format(x=chr(39) + chr(39) + ' || source || ' + chr(39) + ' ' + chr(39) + ' || text')} AS norm FROM documents",
    "p1": "SELECT * FROM p0 WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1",
    "p2": f"SELECT *, string_split(norm, ' ') AS tok FROM p1",
    "p3": f"SELECT doc_id, {WORDS.format(x='content')} AS tickers, (len([w for w in tok if w IN {_in(POS)}]) - len([w for w in tok if w IN {_in(NEG)}])) / greatest(len(tok), 1)::DOUBLE AS score FROM p2",
    "mc": "SELECT symbol, count(*) AS mention_count, avg(score) AS score FROM (SELECT unnest(tickers) AS symbol, score FROM p3) GROUP BY 1",
}


def tagged(spark, sf):
    return U.posts_with_tickers(posts(spark, sf), None, POS, NEG)


@query("post_dedupe", "T8 T9 T10", f"SELECT doc_id AS id, len(tickers) AS n_tickers, {rd('score', 'score')} FROM p3", PO)
def post_dedupe(spark, sf):
    return present(tagged(spark, sf).select("id", F.size("tickers").alias("n_tickers"), "score"))


@query("mention_counts", "A7 U3", f"SELECT symbol, mention_count, {rd('mention_count / 7.0', 'mention_velocity')}, {rd('score', 'sentiment_score')} FROM mc", PO)
def mention_counts(spark, sf):
    d = U.mention_counts(tagged(spark, sf), examples=False)
    return present(d)


@query("mention_top", "U3 K4 A7",
       f"SELECT symbol, mention_count, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM p3 WHERE list_contains(tickers, t.symbol) ORDER BY doc_id LIMIT 3)) AS example_ids FROM (SELECT * FROM mc ORDER BY mention_count DESC, symbol DESC LIMIT 50) t", PO)
def mention_top(spark, sf):
    d = U.top_mentions(U.mention_counts(tagged(spark, sf)), 50)
    return present(d.select("symbol", "mention_count", F.array_join("example_post_ids", ",").alias("example_ids")))


def articles(spark, sf):
    d = src.text_events(spark, sf)
    return d.select(F.col("doc_id").alias("article_id"), F.col("text").alias("title"), "text", F.col("timestamp").alias("published"),
                    F.array(F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")), F.concat(F.lit("U"), (F.col("doc_id") % 3).cast("string"))).alias("symbols"))


_cnt = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)
AR = {
    "a0": f"SELECT doc_id, text, text AS title, ts, ({_cnt(L.KEYWORD_POSITIVE)})::DOUBLE AS p, ({_cnt(L.KEYWORD_NEGATIVE)})::DOUBLE AS n FROM texts",
    "a1": "SELECT *, coalesce((p - n) / nullif(p + n, 0), 0) AS score FROM a0",
    "a2": "SELECT doc_id, title, ts, score, unnest(['T' || CAST(doc_id % 7 AS VARCHAR), 'U' || CAST(doc_id % 3 AS VARCHAR)]) AS symbol FROM a1",
    "bs": """SELECT symbol, avg(score) AS score, count(*) AS article_count, count(*) FILTER (score > 0.2) AS positive_count, count(*) FILTER (score < -0.2) AS negative_count,
        count(*) - count(*) FILTER (score > 0.2) - count(*) FILTER (score < -0.2) AS neutral_count, count(*) >= 5 AS trending, CASE WHEN avg(score) > 0.2 THEN 'BULLISH' WHEN avg(score) < -0.2 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM a2 GROUP BY 1""",
}


@query("article_keyword_scores", "T13", f"SELECT doc_id AS article_id, {rd('score', 'sentiment_score')}, CASE WHEN score > 0.3 THEN 'BULLISH' WHEN score < -0.3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS sentiment_label FROM a1", AR)
def article_keyword_scores(spark, sf):
    return present(N.score_articles(articles(spark, sf)).select("article_id", "sentiment_score", "sentiment_label"))


@query("article_title_dedupe", "T11",
       r"SELECT doc_id AS article_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^a-z0-9]', '', 'g')[1:50] ORDER BY ts DESC, doc_id) AS rn FROM texts) WHERE rn = 1")
def article_title_dedupe(spark, sf):
    return present(N.dedupe_titles(articles(spark, sf), order=("article_id",)).select("article_id"))


@query("article_symbols", "T12")
def article_symbols(spark, sf):
    d = src.load(spark, sf, "documents").select("doc_id", X.article_symbols(F.concat(F.lit("$"), F.upper("lang"), F.lit(" "), F.col("text"))).alias("symbols"))
    return present(d.filter(F.size("symbols") > 0))


@query("news_sentiment_by_symbol", "A8",
       f"SELECT symbol, {rd('score', 'score')}, article_count, positive_count, negative_count, neutral_count, trending, label, (SELECT arg_max(doc_id, {{'a': abs(score), 'b': -doc_id}}) FROM a2 WHERE a2.symbol = bs.symbol) IS NOT NULL AS has_headline FROM bs", AR)
def news_sentiment_by_symbol(spark, sf):
    d = N.sentiment_by_symbol(N.score_articles(articles(spark, sf)))
    return present(d.withColumn("has_headline", F.size("top_headlines") > 0).drop("top_headlines"))


@query("market_sentiment", "A9", f"SELECT {rd('avg(score)', 'score')}, count(*) AS symbols_analyzed, count(*) FILTER (label = 'BULLISH') AS bullish_count, count(*) FILTER (label = 'BEARISH') AS bearish_count, CASE WHEN avg(score) > 0.1 THEN 'BULLISH' WHEN avg(score) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS label FROM bs", AR)
def market_sentiment(spark, sf):
    return present(N.market_sentiment(N.sentiment_by_symbol(N.score_articles(articles(spark, sf)))))


@query("sentiment_movers", "K10", f"SELECT * FROM (SELECT symbol, {rd('score', 'score')}, 'bullish' AS side FROM bs WHERE score > 0 ORDER BY score DESC, symbol LIMIT 3) UNION ALL SELECT * FROM (SELECT symbol, {rd('score', 'score')}, 'bearish' AS side FROM bs WHERE score < 0 ORDER BY score, symbol LIMIT 3)", AR)
def sentiment_movers(spark, sf):
    return present(N.movers(N.sentiment_by_symbol(N.score_articles(articles(spark, sf))), 3).select("symbol", "score", "side"))


_has = lambda words: "(" + " OR ".join(f"contains(lower(title), '{w}')" for w in words) + ")"
_CL = "CASE " + " ".join(f"WHEN {_has(w)} THEN '{k}'" for k, w in N.CLUSTERS.items()) + " ELSE 'general' END"


@query("news_clusters", "A10", f"SELECT symbol, {_CL} AS cluster, count(*) AS headlines FROM a2 GROUP BY 1, 2", AR)
def news_clusters(spark, sf):
    return present(N.clusters(articles(spark, sf).withColumn("symbol", F.explode("symbols"))))


@query("news_tone", "A10", f"SELECT symbol, count(*) AS headline_count, CASE WHEN count(*) FILTER ({_has(N.TONE_POSITIVE)}) > count(*) FILTER ({_has(N.TONE_NEGATIVE)}) + 1 THEN 'constructive' WHEN count(*) FILTER ({_has(N.TONE_NEGATIVE)}) > count(*) FILTER ({_has(N.TONE_POSITIVE)}) + 1 THEN 'cautious' ELSE 'mixed' END AS tone FROM a2 GROUP BY 1", AR)
def news_tone(spark, sf):
    return present(N.tone(articles(spark, sf).withColumn("symbol", F.explode("symbols"))))


# ---- universes ------------------------------------------------------------------

def listing(spark, sf):
    s = src.load(spark, sf, "supplier")
    return s.select(src.symbol_of(F.col("s_suppkey")).alias("symbol"), F.col("s_name").alias("company_name"),
                    F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal") * 1e6).alias("market_cap")).join(src.sector_map(spark, sf), "symbol", "left")


def enriched(spark, sf):
    return U.with_profiles(listing(spark, sf), B.average_dollar_volume(src.bars_daily(spark, sf)))


UN = {
    "adv": "SELECT symbol, avg(close * volume) AS avg_dollar_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) WHERE rn <= 63 GROUP BY 1",
    "li": "SELECT printf('S%05d', s_suppkey) AS symbol, s_name AS company_name, CASE WHEN s_acctbal > 2000 THEN s_acctbal * 1e6 END AS market_cap FROM supplier",
    "en": "SELECT li.*, sector, avg_dollar_volume FROM li LEFT JOIN sectors USING (symbol) LEFT JOIN adv USING (symbol)",
    "lt": "SELECT * FROM en WHERE avg_dollar_volume >= 3400 OR (SELECT count(*) FILTER (avg_dollar_volume >= 3400) FROM en) < 40 ORDER BY coalesce(market_cap, -1) DESC, coalesce(avg_dollar_volume, -1) DESC, symbol DESC LIMIT 40",
    "me": "SELECT 'S' || printf('%05d', user_id) AS symbol, count(*) AS mention_count, count(*) / 7.0 AS mention_velocity, avg(value) AS sentiment_score FROM events GROUP BY 1",
}


@query("universe_listing", "U2 K2 K3 J11", f"SELECT symbol, company_name, {rds('market_cap avg_dollar_volume')}, sector FROM lt", UN)
def universe_listing(spark, sf):
    return present(U.top_listing(enriched(spark, sf), 40, 3400.0).select("symbol", "company_name", "market_cap", "avg_dollar_volume", "sector"))


def user_mentions(spark, sf):
    e = src.load(spark, sf, "events")
    return e.groupBy(src.symbol_of(F.col("user_id")).alias("symbol")).agg(F.count("*").alias("mention_count"), (F.count("*") / 7.0).alias("mention_velocity"), F.avg("value").alias("sentiment_score"))


@query("universe_combined", "U4 J12 K5",
       f"""SELECT coalesce(l.symbol, m.symbol) AS symbol, coalesce(company_name, l.symbol, m.symbol) AS company_name, coalesce(mention_count, 0) AS mention_count, {rd('coalesce(mention_velocity, 0)', 'mention_velocity')},
         {rd('sentiment_score', 'sentiment_score')}, {rd('market_cap', 'market_cap')}, concat_ws(',', CASE WHEN l.symbol IS NOT NULL THEN 'nasdaq_top_500' END, CASE WHEN m.symbol IS NOT NULL THEN 'wsb_top_500' END) AS sources
         FROM lt l FULL OUTER JOIN me m ON l.symbol = m.symbol ORDER BY CASE WHEN l.symbol IS NOT NULL AND m.symbol IS NOT NULL THEN 2 ELSE 1 END DESC, coalesce(market_cap, -1) DESC, coalesce(mention_count, -1) DESC, coalesce(avg_dollar_volume, -1) DESC, coalesce(l.symbol, m.symbol) DESC LIMIT 60""", UN)
def universe_combined(spark, sf):
    d = U.combined(U.top_listing(enriched(spark, sf), 40, 3400.0), user_mentions(spark, sf), 60)
    return present(d.select("symbol", "company_name", "mention_count", "mention_velocity", "sentiment_score", "market_cap", F.array_join("sources", ",").alias("sources")))


@query("universe_order", "K6", f"SELECT symbol, {rd('market_cap', 'market_cap')} FROM en ORDER BY market_cap IS NULL, market_cap DESC, symbol LIMIT 90", UN)
def universe_order(spark, sf):
    return present(U.listing_order(listing(spark, sf), 90).select("symbol", "market_cap"))


@query("universe_min_mentions", "K7 N6",
       """SELECT * FROM (SELECT symbol, mention_count FROM me WHERE mention_count >= 70 UNION ALL SELECT symbol, 0 FROM li WHERE symbol NOT IN (SELECT symbol FROM me WHERE mention_count >= 70))
          ORDER BY mention_count = 0, mention_count DESC, symbol LIMIT 100""", UN)
def universe_min_mentions(spark, sf):
    return present(U.min_mentions(user_mentions(spark, sf), listing(spark, sf), 70, 100))


@query("universe_watchlist_merge", "J13 U10",
       "SELECT coalesce(l.symbol, w.symbol) AS symbol, coalesce('W ' || w.c_name, company_name) AS company_name, coalesce(w.c_mktsegment, sector) AS sector FROM en l FULL OUTER JOIN (SELECT printf('S%05d', c_custkey) AS symbol, c_name, c_mktsegment FROM customer WHERE c_acctbal > 9000) w ON l.symbol = w.symbol", UN)
def universe_watchlist_merge(spark, sf):
    c = src.load(spark, sf, "customer").filter("c_acctbal > 9000")
    w = c.select(src.symbol_of(F.col("c_custkey")).alias("symbol"), F.concat(F.lit("W "), F.col("c_name")).alias("company_name"), F.col("c_mktsegment").alias("sector"))
    return present(U.merge_watchlist(listing(spark, sf), w).drop("sources"))


@query("universe_union", "N3 X7", "SELECT symbol, min(k) AS list_no FROM (SELECT symbol, 0 AS k FROM li UNION ALL SELECT symbol, 1 FROM me) GROUP BY 1", UN)
def universe_union(spark, sf):
    return present(U.union_distinct(listing(spark, sf), user_mentions(spark, sf)))


@query("universe_row_view", "U12 U6 X5", f"SELECT symbol, company_name AS name, sector, {rd('market_cap', 'market_cap')} FROM en", UN)
def universe_row_view(spark, sf):
    return present(U.row_view(listing(spark, sf).withColumn("market_cap", F.col("market_cap").cast("string"))).select("symbol", "name", "sector", "market_cap"))


@query("universe_content_hash", "U8 X9 L25")
def universe_content_hash(spark, sf):
    return present(U.wide_hash(src.load(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_acctbal"]))


@query("universe_catalogue", "U9", "SELECT sector AS universe, count(*) AS count, max(r_name) AS title FROM sectors JOIN region ON 'SEC' || CAST(r_regionkey AS VARCHAR) = sector GROUP BY 1")
def universe_catalogue(spark, sf):
    rows = src.sector_map(spark, sf).withColumnRenamed("sector", "universe")
    heads = src.load(spark, sf, "region").select(F.concat(F.lit("SEC"), F.col("r_regionkey").cast("string")).alias("universe"), F.col("r_name").alias("title"))
    return present(U.catalogue(rows, heads))


@query("universe_placeholders", "U11", f"SELECT symbol, (n * 7) % 50 + 1 AS mention_count, {rd('((n * 7) % 50 + 1) / 7.0', 'mention_velocity')} FROM (SELECT printf('S%05d', s_suppkey) AS symbol, s_suppkey AS n FROM supplier)")
def universe_placeholders(spark, sf):
    s = src.load(spark, sf, "supplier").select(src.symbol_of(F.col("s_suppkey")).alias("symbol"), ((F.col("s_suppkey") * 7) % 50 + 1).alias("n"))
    return present(U.placeholder_mentions(s, F.col("n")).drop("sentiment_score"))


@query("symbol_directory", "S6 U1",
       "SELECT CASE WHEN upper(replace(p_name, ' ', '')) SIMILAR TO '[A-Z][A-Z0-9\\-]{0,9}' THEN upper(replace(p_name, ' ', '')) END AS symbol, p_partkey AS part FROM part WHERE NOT (contains(lower(p_type), 'promo') OR p_size = 1) AND CASE WHEN upper(replace(p_name, ' ', '')) SIMILAR TO '[A-Z][A-Z0-9\\-]{0,9}' THEN 1 END IS NOT NULL")
def symbol_directory(spark, sf):
    """Part names as a listing; PROMO parts are the odd securities."""
    p = src.load(spark, sf, "part")
    kind = F.when(F.contains(F.lower("p_type"), F.lit("promo")), "X Fund").otherwise("X Common Stock")
    d = p.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("Symbol"), kind.alias("Security Name"), F.when(F.col("p_size") == 1, "Y").otherwise("N").alias("Test Issue"), "p_partkey")
    keep = d.filter((F.col("Test Issue") != "Y") & U.common_stock("Security Name"))
    return present(keep.select(symbol_or_null("Symbol").alias("symbol"), F.col("p_partkey").alias("part")).filter("symbol is not null"))


@query("symbol_sanitising", "X2 X1",
       r"""SELECT p_partkey, CASE WHEN NOT regexp_matches(s, '[/$^ ]') AND regexp_full_match(replace(s, '.', '-'), '[A-Z][A-Z0-9\-]{0,9}') THEN replace(s, '.', '-') END AS symbol FROM (SELECT p_partkey, upper(trim(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE replace(p_name, ' ', '.') END)) AS s FROM part)""")
def symbol_sanitising(spark, sf):
    p = src.load(spark, sf, "part")
    raw = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit(".")))
    return p.select("p_partkey", symbol_or_null(raw).alias("symbol"))


@query("universe_metadata_fill", "U7 V8",
       "SELECT printf('S%05d', s_suppkey) AS symbol, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'given' END, CASE WHEN TIMESTAMP '2024-01-01' + to_hours(s_suppkey % 48) > TIMESTAMP '2024-01-02' - INTERVAL 12 HOUR THEN 'M' || CAST(s_nationkey AS VARCHAR) END) AS sector FROM supplier")
def universe_metadata_fill(spark, sf):
    s = src.load(spark, sf, "supplier")
    sym = src.symbol_of(F.col("s_suppkey")).alias("symbol")
    rows = s.select(sym, F.when(F.col("s_suppkey") % 2 == 0, "given").alias("sector"))
    meta = s.select(sym, F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("sector"), F.timestamp_seconds(F.lit(1704067200) + (F.col("s_suppkey") % 48) * 3600).alias("cached_at"))
    return present(U.fill_metadata(rows, meta, "2024-01-02 00:00:00"))


@query("posts_window", "S7 K9", "SELECT doc_id AS id FROM texts WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' ORDER BY ts DESC LIMIT 150")
def posts_window(spark, sf):
    d = src.text_events(spark, sf).select(F.col("doc_id").alias("id"), F.col("timestamp").alias("created_at"))
    return U.posts_in_window(d, "2024-01-15 00:00:00", 7, max_posts=150).select("id")
