"""Causal as-of joins: the last right row at or before each left row.

Both sides are tagged and unioned, then one window per (key, time cell) takes
the last right struct.  Rows of a hot key spread over its time cells; what a
cell needs from earlier cells arrives as one carry row, found on the small
table of per-cell last rows.  No theta join, no window over a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .series import CELL, DAY, declare_daily, is_daily, time_cell

SPAN = 32 * DAY
#: At most so many matched stamps are sent to the tasks.
SENT = 1 << 20


def asof_join(
    left: DataFrame,
    right: DataFrame | None,
    *,
    prefix: str,
    keys: tuple[str, ...] = ("symbol",),
    time: str = "timestamp",
    right_time: str | None = None,
    right_order: tuple[str, ...] = (),
    columns: list[str] | None = None,
    tolerance: str | None = None,
    strict: bool = False,
    span: int = SPAN,
    stamps: DataFrame | None = None,
) -> DataFrame:
    """Backward as-of join, left outer, exact matches allowed.

    Right columns come back as `{prefix}__{name}` and the matched stamp as
    `{prefix}__asof_timestamp`.  On equal right stamps the row that is largest
    by `right_order` wins.  The whole right row is taken, missing cells too.
    With `strict` only earlier right rows match.  `right=None` is a no-op.
    `stamps`: without keys, a cheaper table with the same times as `left`.
    """
    if right is None:
        return left
    rt = right_time or time
    if not keys:
        return _asof_shared(left, right, prefix=prefix, time=time, right_time=rt, right_order=right_order,
                            columns=columns, tolerance=tolerance, strict=strict, span=span, like=stamps)
    cols = columns or [x for x in right.columns if x not in keys and x != rt]
    k = list(keys)
    # two daily sides are bounded by the calendar: one cell per key, no carry
    short = is_daily(left, time, k) and is_daily(right, rt, k)
    right = right.filter(F.col(rt).isNotNull())
    payload = F.struct(F.col(rt).alias("_at"), *[F.col(x) for x in cols])
    tie = F.struct(*[F.col(x) for x in right_order]) if right_order else F.struct(F.lit(0))
    r = right.select(*k, F.col(rt).alias("_t"), tie.alias("_tie"), payload.alias("_r"))
    cell = F.lit(0).cast("bigint") if short else time_cell("_t", span)
    r = r.withColumn(CELL, cell)
    l = left.select(*k, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l")).withColumn(CELL, cell)
    carry = None if short else _carry(l, r, k)

    null_l = F.lit(None).cast(l.schema["_l"].dataType)
    null_r = F.lit(None).cast(r.schema["_r"].dataType)
    null_tie = F.lit(None).cast(r.schema["_tie"].dataType)
    left_side, right_side = (0, 1) if strict else (1, 0)
    both = (
        l.select(*k, CELL, "_t", F.lit(left_side).alias("_s"), null_tie.alias("_tie"), "_l", null_r.alias("_r"))
        .unionByName(r.select(*k, CELL, "_t", F.lit(right_side).alias("_s"), "_tie", null_l.alias("_l"), "_r"))
    )
    if carry is not None:
        both = both.unionByName(carry.select(*k, CELL, F.lit(None).cast("timestamp").alias("_t"), F.lit(-1).alias("_s"),
                                             null_tie.alias("_tie"), null_l.alias("_l"), "_r"))
    w = Window.partitionBy(*k, CELL).orderBy(F.col("_t").asc_nulls_first(), "_s", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    if tolerance:
        hit = hit.withColumn("_r", F.when(F.col("_r._at") + F.expr(f"interval {tolerance}") >= F.col("_t"), F.col("_r")))
    out = hit.select(
        "_l.*",
        *[F.col(f"_r.{x}").alias(f"{prefix}__{x}") for x in cols],
        F.col("_r._at").alias(f"{prefix}__asof_timestamp"),
    )
    grain = left.schema[time].metadata
    return out.withMetadata(time, grain) if grain else out


def _carry(l: DataFrame, r: DataFrame, k: list[str]) -> DataFrame:
    """For each (key, cell) with left rows: the last right row of the earlier
    cells, found on the small table of per-cell last rows."""
    tail = r.groupBy(*k, CELL).agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_r"), F.lit(False).alias("_want"))
    want = l.select(*k, CELL).distinct().withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)).withColumn("_want", F.lit(True))
    cells = tail.unionByName(want).groupBy(*k, CELL).agg(F.first("_r", ignorenulls=True).alias("_r"), F.max("_want").alias("_want"))
    cw = Window.partitionBy(*k).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_r", F.last("_r", ignorenulls=True).over(cw)).filter(F.col("_want") & F.col("_r").isNotNull())


def _asof_shared(left, right, *, time, prefix, like=None, **kw) -> DataFrame:
    """A right side without a key: join the distinct left stamps once."""
    stamps = (left if like is None else like).select(time).distinct().withColumn("_k", F.lit(0))
    if is_daily(left, time, left.columns):
        stamps = declare_daily(stamps, time, ())
    hit = asof_join(stamps, right.withColumn("_k", F.lit(0)), prefix=prefix, keys=("_k",), time=time, **kw).drop("_k")
    return left.join(hit, time, "left").select(*left.columns, *[x for x in hit.columns if x != time])


def asof_stamps(left: DataFrame, right: DataFrame, *, prefix: str, keys: tuple[str, ...] = (), time: str = "timestamp", **kw) -> DataFrame:
    """`asof_join` for a left side of which many rows share their keys and stamp.

    Only the different (keys, stamps) are joined; they are stored, and sent to
    the tasks if few, so the rows of `left` are neither tagged nor shuffled.
    """
    k = [*keys, time]
    hit = cut_lineage(asof_join(left.select(*k).distinct(), right, prefix=prefix, keys=keys, time=time, **kw))
    hit = F.broadcast(hit) if hit.count() <= SENT else hit
    l, h = left.alias("l"), hit.alias("h")
    on = [F.col(f"l.{x}").eqNullSafe(F.col(f"h.{x}")) for x in k]
    out = l.join(h, on, "left").select(*[F.col(f"l.{x}") for x in left.columns], *[F.col(f"h.{x}") for x in hit.columns if x not in k])
    grain = left.schema[time].metadata
    return out.withMetadata(time, grain) if grain else out


def align(price: DataFrame, fundamentals=None, macro=None, news=None, **orders) -> DataFrame:
    """Price bars with fundamentals, macro and news as of each bar."""
    out = price
    for prefix, side, keyed in (("fund", fundamentals, True), ("macro", macro, False), ("news", news, True)):
        if side is None:
            continue
        names = side.columns
        rt = next(x for x in ("release_timestamp", "filing_timestamp", "timestamp") if x in names)
        out = asof_join(out, side, prefix=prefix, keys=("symbol",) if keyed and "symbol" in names else (),
                        right_time=rt, right_order=orders.get(prefix, ()), stamps=price)
    return out


def peeking_rows(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows whose matched stamp lies after the row's own stamp."""
    stamps = [x for x in df.columns if x.endswith("__asof_timestamp")]
    bad = F.lit(False)
    for x in stamps:
        bad = bad | F.coalesce(F.col(x) > F.col(time), F.lit(False))
    return df.filter(bad)


def assert_no_peek(df: DataFrame, time: str = "timestamp") -> DataFrame:
    if not peeking_rows(df, time).isEmpty():
        raise AssertionError("a joined row carries a stamp from the future")
    return df


def next_known_event(left: DataFrame, events: DataFrame, *, key: str = "symbol", time: str = "timestamp",
                     event_time: str = "event_timestamp", known: str | None = "known_since", span: int = SPAN) -> DataFrame:
    """Smallest event stamp with known <= t < event, as `next_event`.

    Each event is an interval; it is laid on the time cells it touches, so the
    join is an equi join on (key, cell) with the two bounds as a filter.  Only
    the earliest match is kept, by a combining min.
    """
    ev = events.select(key, F.col(event_time).alias("_e"), (F.col(known) if known else F.lit(0).cast("timestamp")).alias("_k"))
    ev = ev.filter("_e is not null and _k is not null and _k < _e").distinct()
    first = left.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    ev = ev.join(first, key).filter((F.col("_k") <= F.col("_hi")) & (F.col("_e") > F.col("_lo")))
    lo, hi = time_cell(F.greatest("_k", "_lo"), span), time_cell(F.least("_e", "_hi"), span)
    ev = ev.select(key, "_e", "_k", F.explode(F.sequence(lo, hi)).alias(CELL))
    stamps = left.select(key, time).distinct().withColumn(CELL, time_cell(time, span))
    hit = (
        stamps.join(ev, [key, CELL])
        .filter((F.col("_k") <= F.col(time)) & (F.col(time) < F.col("_e")))
        .groupBy(key, time).agg(F.min("_e").alias("next_event"))
    )
    return left.join(hit, [key, time], "left")
