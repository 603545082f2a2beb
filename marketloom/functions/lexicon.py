"""Word lists and weights that results depend on."""

SOURCE_CREDIBILITY = {
    "reuters": 1.0, "wsj": 0.98, "bloomberg": 0.97, "financial_times": 0.95, "cnbc": 0.9, "marketwatch": 0.85,
    "yahoo_finance": 0.82, "seeking_alpha": 0.75, "benzinga": 0.72, "x": 0.5, "twitter": 0.5, "reddit": 0.55,
}
DEFAULT_SOURCE_WEIGHT = 0.7
SOCIAL_MULTIPLIER = 0.65

HEADLINE_POSITIVE = (
    "beat", "beats", "upgrade", "upgrades", "growth", "strong", "bullish", "surge", "surges", "record", "profit", "profits", "outperform",
    "outperformed", "expands", "expansion", "raise", "raises", "raised", "buyback",
)
HEADLINE_NEGATIVE = (
    "miss", "misses", "downgrade", "downgrades", "weak", "bearish", "drop", "drops", "plunge", "plunges", "lawsuit", "investigation", "fraud", "cut",
    "cuts", "cutting", "warns", "warning", "decline", "declines", "loss", "losses",
)
HEADLINE_STOPWORDS = (
    "CEO", "CFO", "GDP", "CPI", "PPI", "FOMC", "ETF", "SEC", "FDA", "USA", "IPO", "AI",
)

POST_STOPWORDS = (
    "A", "AI", "ALL", "AM", "AND", "ARE", "AS", "AT", "BE", "BEST", "BUY", "CEO", "CFO", "CPI", "DD", "EPS", "ETF", "FOMC", "FOR", "FROM", "GDP",
    "GO", "HOLD", "I", "IN", "IPO", "IT", "ITS", "LONG", "LOSS", "LOW", "MOON", "NEW", "NOW", "OF", "ON", "OR", "PUMP", "PUT", "RIP", "SEC", "SELL",
    "SHORT", "SO", "THE", "THIS", "TO", "USD", "VIX", "WE", "WITH", "YOU",
)
POST_POSITIVE = (
    "beat", "beats", "bull", "bullish", "buy", "calls", "gain", "gains", "green", "long", "moon", "pump", "rally", "rip", "rocket", "strong", "up",
    "win",
)
POST_NEGATIVE = (
    "bagholder", "bear", "bearish", "crash", "down", "dump", "loss", "losses", "miss", "missed", "puts", "red", "short", "weak",
)

ARTICLE_STOPWORDS = (
    "CEO", "IPO", "NYSE", "SEC", "FDA", "USA", "GDP", "CPI", "ETF", "AI",
)
KEYWORD_POSITIVE = (
    "surge", "jump", "gain", "rise", "rally", "boom", "soar", "beat", "exceed", "strong", "bullish", "upgrade", "buy", "profit", "growth", "positive",
    "record", "high", "best", "breakthrough", "innovative", "success", "win", "optimistic",
)
KEYWORD_NEGATIVE = (
    "fall", "drop", "decline", "plunge", "crash", "sink", "tumble", "miss", "weak", "bearish", "downgrade", "sell", "loss", "negative", "concern",
    "risk", "warning", "low", "worst", "layoff", "cut", "failure", "lawsuit", "investigation", "fraud",
)

COMMON_STOCK_HINTS = [
    "common stock", "common shares", "ordinary shares", "class a common stock", "class b common stock", "class c common stock",
]
OTHER_SECURITY_HINTS = [
    "etf", "exchange traded fund", "fund", "trust", "depositary", "depositary shares", "bond", "notes", "warrant", "rights", "preferred",
]
