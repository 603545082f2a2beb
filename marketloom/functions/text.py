"""Text expressions: tokens, tickers and lexicon scores, all JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .expr import c, clip, token_count, word_count

EDGE = r"[\p{L}\p{N}_]"


def normalize_text(x) -> Column:
    """Lower-case letters and digits, every other run of characters a space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c(x), F.lit(""))), "[^a-z0-9]+", " "))


def tokenize(x) -> Column:
    return F.filter(F.split(normalize_text(x), " "), lambda t: F.length(t) > 0)


def token_set(x) -> Column:
    return F.array_distinct(tokenize(x))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def extract_tickers(text, universe: list[str] | None = None) -> Column:
    """Tickers as $X, (X) or a bare word, in that order, each once."""
    t = F.coalesce(c(text), F.lit(""))
    found = F.array_distinct(F.concat(_all(t, rf"\$([A-Z]{{1,5}})(?!{EDGE})"), _all(t, r"\(([A-Z]{1,5})\)"), _all(t, rf"(?<!{EDGE})([A-Z]{{2,5}})(?!{EDGE})")))
    found = F.array_except(found, F.array(*[F.lit(w) for w in L.HEADLINE_STOPWORDS]))
    return F.array_intersect(found, F.array(*[F.lit(u) for u in universe])) if universe is not None else found


def post_tickers(text) -> Column:
    """Sorted set of up-to-five-letter words of the upper-cased text."""
    t = F.upper(F.coalesce(c(text), F.lit("")))
    found = F.array_distinct(_all(t, rf"(?<!{EDGE})([A-Z]{{1,5}})(?!{EDGE})"))
    return F.array_sort(F.array_except(found, F.array(*[F.lit(w) for w in L.POST_STOPWORDS])))


def article_symbols(text) -> Column:
    """At most five symbols of an article, in sorted order."""
    t = F.coalesce(c(text), F.lit(""))
    found = F.concat(_all(t, rf"\$([A-Z]{{1,5}})(?!{EDGE})"), _all(t, r"\(([A-Z]{1,5})\)"), _all(t, rf"(?<!{EDGE})([A-Z]{{2,5}})(?::|'s|\s+stock)"))
    keep = F.filter(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in L.ARTICLE_STOPWORDS])), lambda s: F.length(s) >= 2)
    return F.slice(F.array_sort(keep), 1, 5)


def three_way(score: Column, edge: float) -> Column:
    return F.when(score > edge, "BULLISH").when(score < -edge, "BEARISH").otherwise("NEUTRAL")


def lexicon_score(text, positive=L.HEADLINE_POSITIVE, negative=L.HEADLINE_NEGATIVE, normalized: bool = False) -> Column:
    """clip(4 (pos - neg) / (tokens + 2), -1, 1); 0 without tokens."""
    n = c(text) if normalized else normalize_text(text)
    net = (word_count(n, positive) - word_count(n, negative)).cast("double")
    return clip(net / (token_count(n) + 2.0) * 4.0, -1.0, 1.0)


def post_score(norm: Column, positive=L.POST_POSITIVE, negative=L.POST_NEGATIVE) -> Column:
    """(pos - neg) / tokens of a normalized text."""
    return (word_count(norm, positive) - word_count(norm, negative)) / F.greatest(token_count(norm), F.lit(1)).cast("double")


def contains_count(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def keyword_score(text, positive=L.KEYWORD_POSITIVE, negative=L.KEYWORD_NEGATIVE) -> Column:
    """(pos - neg) / (pos + neg) over words found anywhere in the text."""
    t = F.lower(F.coalesce(c(text), F.lit("")))
    p, n = contains_count(t, positive), contains_count(t, negative)
    return F.coalesce(F.try_divide((p - n).cast("double"), (p + n).cast("double")), F.lit(0.0))


def source_weight(source, channel, table: dict[str, float] | None = None, default: float = L.DEFAULT_SOURCE_WEIGHT, social: float = L.SOCIAL_MULTIPLIER) -> Column:
    t = {**L.SOURCE_CREDIBILITY, **(table or {})}
    m = F.create_map(*[x for k, v in t.items() for x in (F.lit(k), F.lit(float(v)))])
    w = F.coalesce(F.try_element_at(m, F.lower(c(source))), F.lit(default))
    return F.when(c(channel) == "social", w * social).otherwise(w)


def title_key(title) -> Column:
    return F.substring(F.regexp_replace(F.lower(c(title)), "[^a-z0-9]", ""), 1, 50)
