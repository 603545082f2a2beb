"""Scalar building blocks: pure Column expressions, all JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: str | Column) -> Column:
    """Numeric coercion: unparsable text and NaN both become NULL."""
    v = c(x).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def safe_div(a, b, eps: float = EPS) -> Column:
    """a / (b + eps): the epsilon is part of the value, not a zero test.

    A denominator that is exactly zero even after adding eps gives NULL.
    """
    return F.try_divide(c(a), c(b) + F.lit(eps))


def div(a, b) -> Column:
    """Plain ratio, NULL on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def flag(cond: Column) -> Column:
    """A comparison as 1.0/0.0 where a missing operand counts as false."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def keep_if(cond: Column, value: Column, other: float = 0.0) -> Column:
    """`value` where cond holds, else `other` (a missing condition is false)."""
    return F.when(cond, value).otherwise(F.lit(other))


def clip(x, lo, hi) -> Column:
    """Clamp that keeps NULL as NULL (greatest/least alone would not)."""
    v = c(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))


def secs(ts) -> Column:
    """Seconds since the epoch with microsecond resolution, as double."""
    return F.unix_micros(c(ts)) / F.lit(1e6)


def first_alias(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias present (case-insensitive), or None."""
    lowered = {x.lower(): x for x in columns}
    for a in aliases:
        if a.lower() in lowered:
            return lowered[a.lower()]
    return None


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def word_count(norm: Column, words) -> Column:
    """Occurrences of whole words in a normalized (space separated) text."""
    return F.regexp_count(norm, F.lit("(?<![a-z0-9])(?:" + "|".join(sorted(words)) + ")(?![a-z0-9])"))


def token_count(norm: Column) -> Column:
    """Number of words of a normalized text; 0 for the empty one."""
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def mid_price(bid, ask) -> Column:
    """Average of the available sides of a quote."""
    return F.coalesce((c(bid) + c(ask)) / 2.0, c(bid), c(ask))


def relative_spread(bid, ask) -> Column:
    return div(c(ask) - c(bid), mid_price(bid, ask))


def symbol_or_null(raw, reject: str = r"[/$^ ]") -> Column:
    """Upper-cased ticker with `.` as `-`, or NULL when it is not one."""
    s = F.upper(F.trim(c(raw)))
    dashed = F.replace(s, F.lit("."), F.lit("-"))
    ok = ~s.rlike(reject) & dashed.rlike(r"^[A-Z][A-Z0-9\-]{0,9}$")
    return F.when(ok, dashed)


def ny_clock(ts) -> Column:
    return F.from_utc_timestamp(c(ts), "America/New_York")


def session_label(ts, intraday: bool) -> Column:
    """Trading session from the New York wall clock."""
    if not intraday:
        return F.lit("regular")
    hm = F.date_format(ny_clock(ts), "HH:mm:ss")
    return (
        F.when(hm < "09:30:00", "pre")
        .when(hm <= "16:00:00", "regular")
        .when(hm <= "20:00:00", "after")
        .otherwise("closed")
    )


def market_hours(ts) -> Column:
    """Weekday between 09:30 and 16:00 New York time, both inclusive."""
    local = ny_clock(ts)
    hm = F.date_format(local, "HH:mm:ss")
    return (F.weekday(local) < 5) & (hm >= "09:30:00") & (hm <= "16:00:00")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct-token arrays; two empty sets are equal."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(inter.cast("double"), union.cast("double")))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared words over the size of the larger set."""
    big = F.greatest(F.size(a), F.size(b))
    return F.when(big == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / big)


def content_hash(*cols: str | Column) -> Column:
    """sha256 of a struct's JSON text."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def tags_array(raw) -> Column:
    """Tags stored as a JSON array, else as a comma list."""
    parsed = F.from_json(c(raw), "array<string>")
    listed = F.transform(F.split(c(raw), ","), lambda t: F.trim(t))
    return F.filter(F.coalesce(parsed, listed), lambda t: F.length(t) > 0)
