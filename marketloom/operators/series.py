"""Ordered series of any length without giving one key to one task.

A window partitioned by symbol alone sends every row of that symbol to one
task, which fails once a symbol holds a large part of the table.  Here each
series is cut into *blocks* of about `block_rows` consecutive rows:

1. rows are counted per (key, time cell); this table is tiny because the count
   is combined map-side and there is one row per occupied cell;
2. a running sum over those cells gives the global index of each cell's first
   row, from which the cell's block follows, and also which neighbouring blocks
   need its rows as context (a *halo* of `back` earlier / `ahead` later rows);
3. rows are sent to the blocks that need them and every window is partitioned
   by (key, block).  Frames of at most `back` / `ahead` rows are then exact for
   the rows a block owns; halo copies are dropped at the end.

Cumulative values use the same idea with a carry: combine per cell, scan the
cell table, add the carry to a running value inside the cell.

Series declared daily (`declare_daily`: at most one row per key and day) are
bounded by the calendar, about 366 rows a year however skewed the source is.
Such a series is a single block: no counting pass, no join, and consecutive
operators share one exchange by key.  The declaration travels as metadata of
the time column; a column without it always takes the general path.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400
CELL, FIRST, BLK, OWN, IX, TOTAL, RUN = "_cell", "_first", "_blk", "_own", "_ix", "_total", "_sub"
HELPERS = (CELL, FIRST, BLK, OWN, IX, TOTAL, RUN)


GRAIN = "marketloom_grain"


def declare_daily(df: DataFrame, time: str = "timestamp", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """State that `df` holds at most one row per `keys` and day of `time`."""
    return df.withMetadata(time, {**df.schema[time].metadata, GRAIN: ["day", *keys]})


def is_daily(df: DataFrame, time: str, keys) -> bool:
    """Whether a declaration bounds the rows of each of `keys`."""
    grain = df.schema[time].metadata.get(GRAIN)
    return bool(grain) and set(grain[1:]) <= set(keys)


def time_cell(ts: str | Column, span: int) -> Column:
    """Number of the `span`-second time cell that holds `ts`."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(span * 1_000_000))


@dataclass(frozen=True)
class Layout:
    """How a table of ordered series is laid out."""

    keys: tuple[str, ...] = ("symbol",)
    time: str = "timestamp"
    ties: tuple[str, ...] = ()
    span: int = 32 * DAY
    block_rows: int = 8192

    @property
    def order(self) -> list[Column]:
        return [F.col(x) for x in (self.time, *self.ties)]


DAILY = Layout()
INTRADAY = Layout(span=DAY)


@dataclass
class Blocked:
    """A blocked table plus the window over it."""

    df: DataFrame
    layout: Layout
    bounded: bool = False
    in_runs: bool = False

    @property
    def window(self):
        # Runs follow the order of the rows; naming them first lets windows inside runs and windows over the block share one sort.
        return Window.partitionBy(*self.layout.keys, BLK).orderBy(*([F.col(RUN)] if self.in_runs else []), *self.layout.order)

    def rows(self, lo: int, hi: int):
        return self.window.rowsBetween(lo, hi)

    def stage(self, exprs: dict[str, Column]) -> "Blocked":
        """Add one layer of columns (one projection, not one per column)."""
        if exprs:
            self.df = self.df.withColumns(exprs)
        return self

    def indexed(self) -> "Blocked":
        """Add the global zero-based row index of each series."""
        w = self.window
        if self.bounded:
            whole = Window.partitionBy(*self.layout.keys, BLK)
            self.df = self.df.withColumns({IX: (F.row_number().over(w) - 1).cast("bigint"), TOTAL: F.count("*").over(whole)})
            return self
        self.df = self.df.withColumn(IX, F.first(FIRST).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(w) - 1)
        return self

    def owned(self, *, keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
        """Only the rows each block owns, without helper columns."""
        gone = [x for x in HELPERS if x in self.df.columns and x not in keep]
        return self.df.filter(F.col(OWN)).drop(*gone, *drop)


def cell_map(df: DataFrame, layout: Layout, back: int, ahead: int) -> DataFrame:
    """One row per (key, cell): first row index, own block, blocks to feed."""
    keys = list(layout.keys)
    b = layout.block_rows
    counts = df.select(*keys, time_cell(layout.time, layout.span).alias(CELL)).groupBy(*keys, CELL).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(CELL)
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = counts.select(
        *keys, CELL, "_n", before.alias(FIRST),
        F.sum("_n").over(whole).alias(TOTAL), F.max("_n").over(whole).alias("_fat"),
    )
    own = F.floor(F.col(FIRST) / b)
    m = m.withColumn("_home", own)
    last_blk = F.max("_home").over(whole)
    hi = F.least(F.floor((F.col(FIRST) + F.col("_n") + (back - 1)) / b), last_blk) if back > 0 else F.col("_home")
    lo = F.greatest(F.lit(0), F.floor((F.col(FIRST) - F.col("_fat") - ahead) / b)) if ahead > 0 else F.col("_home")
    feeds = F.sequence(F.least(lo, F.col("_home")), F.greatest(hi, F.col("_home")))
    return m.select(*keys, CELL, FIRST, TOTAL, "_home", feeds.alias("_feeds"))


def blocked(df: DataFrame, layout: Layout = DAILY, *, back: int = 0, ahead: int = 0, like: DataFrame | None = None) -> Blocked:
    """Cut every series into blocks with `back`/`ahead` rows of context. `like`: a cheaper table with the same keys and times, to be counted in place of `df`."""
    if is_daily(df, layout.time, layout.keys):
        return Blocked(df.withColumns({BLK: F.lit(0).cast("bigint"), OWN: F.lit(True)}), layout, True)
    m = cell_map(df if like is None else like, layout, back, ahead)
    out = (
        df.withColumn(CELL, time_cell(layout.time, layout.span))
        .join(m, [*layout.keys, CELL])
        .withColumn(BLK, F.explode("_feeds"))
        .withColumn(OWN, F.col(BLK) == F.col("_home"))
        .drop("_feeds", "_home", CELL)
    )
    return Blocked(out, layout)


# ---- frame helpers -------------------------------------------------------

def full(b: Blocked, x: Column, w: int, agg, min_rows: int | None = None) -> Column:
    """agg(x) over the last w rows, NULL with fewer than min_rows values."""
    need = w if min_rows is None else min_rows
    fr = b.rows(-(w - 1), 0)
    return F.when(F.count(x).over(fr) >= need, agg(x).over(fr))


def prior(b: Blocked, x: Column, w: int, agg, min_rows: int | None = None) -> Column:
    """As `full`, over the w rows before the current one."""
    need = w if min_rows is None else min_rows
    fr = b.rows(-w, -1)
    return F.when(F.count(x).over(fr) >= need, agg(x).over(fr))


def lag(b: Blocked, x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(b.window)


def zscore(b: Blocked, x: Column, w: int, min_rows: int | None = None) -> Column:
    mu = full(b, x, w, F.avg, min_rows)
    sd = full(b, x, w, F.stddev_samp, min_rows)
    return F.try_divide(x - mu, sd + F.lit(1e-9))


def slope(b: Blocked, y: Column, x: Column, w: int) -> Column:
    """Least-squares slope of y against x over the last w rows."""
    fr = b.rows(-(w - 1), 0)
    return F.when(F.count(y).over(fr) >= w, F.regr_slope(y, x).over(fr))


# ---- sliding aggregates -----------------------------------------------------

RADIX = 4
#: Fields of a state, by kind; a state stands for some consecutive rows.
_STATES = {"sum": ("n", "s"), "min": ("n", "v"), "max": ("n", "v"), "moment": ("n", "m", "q"), "pair": ("n", "m", "w", "c", "q", "r")}
_KIND = {"avg": "sum", "sum": "sum", "min": "min", "max": "max", "stddev": "moment", "var": "moment", "corr": "pair", "covar": "pair", "slope": "pair"}


def _state_of(kind: str, x: Column, y: Column | None) -> list[Column]:
    """State of one row; a row without a value counts as none."""
    zero, x = F.lit(0.0), x.cast("double")
    if kind == "pair":
        both, y = x.isNotNull() & y.isNotNull(), y.cast("double")
        return [F.when(both, 1.0).otherwise(0.0), F.when(both, x).otherwise(zero), F.when(both, y).otherwise(zero), zero, zero, zero]
    n = F.when(x.isNotNull(), 1.0).otherwise(0.0)
    if kind in ("min", "max"):
        return [n, x]
    return [n, F.coalesce(x, zero), zero][: len(_STATES[kind])]


def _merged(kind: str, parts: list[list[Column]]) -> list[Column]:
    """State of all rows that `parts` stand for. Means are moved from that of the first part, so nothing large is subtracted."""
    if len(parts) == 1:
        return parts[0]
    add = lambda xs: reduce(lambda a, z: a + z, xs)
    n = add([p[0] for p in parts])
    if kind == "sum":
        return [n, add([p[1] for p in parts])]
    if kind in ("min", "max"):
        return [n, (F.least if kind == "min" else F.greatest)(*[p[1] for p in parts])]
    some = F.greatest(n, F.lit(1.0))
    mean = lambda i: parts[0][i] + add([p[0] * (p[i] - parts[0][i]) for p in parts[1:]]) / some
    m = mean(1)
    if kind == "moment":
        return [n, m, add([p[2] + p[0] * (p[1] - m) * (p[1] - m) for p in parts])]
    w = mean(2)
    return [n, m, w, add([p[3] + p[0] * (p[1] - m) * (p[2] - w) for p in parts]),
            add([p[4] + p[0] * (p[1] - m) * (p[1] - m) for p in parts]), add([p[5] + p[0] * (p[2] - w) * (p[2] - w) for p in parts])]


def _value(agg: str, st: list[Column]) -> Column:
    n = st[0]
    if agg in ("min", "max", "sum"):
        return st[1]
    if agg == "avg":
        return st[1] / F.nullif(n, F.lit(0.0))
    if agg == "slope":  # of the first value against the second
        return st[3] / F.nullif(st[5], F.lit(0.0))
    if agg == "corr":
        return st[3] / F.nullif(F.sqrt(st[4] * st[5]), F.lit(0.0))
    over = F.nullif(n - 1.0, F.lit(0.0))
    return st[3] / over if agg == "covar" else F.sqrt(st[2] / over) if agg == "stddev" else st[2] / over


def sliding(b: Blocked, items: dict[str, tuple]) -> Blocked:
    """Aggregates over the last rows: {name: (agg, rows, needed, x[, y])}.

    NULL with fewer than `needed` values (None: `rows`).  A frame would take up
    each row once per window; here states of 4, 16, 64... rows are each merged
    from four of the level below, and a window is put together from at most
    three of each level.  Work per row grows with the logarithm of the window.
    """
    w, tag = b.window, f"_w{len(b.df.columns)}"
    series: dict[tuple, dict] = {}
    for name, (agg, rows, needed, x, *y) in items.items():
        s = series.setdefault((_KIND[agg], str(x), str(y)), {"kind": _KIND[agg], "x": x, "y": y[0] if y else None, "uses": {}, "id": f"{tag}_{len(series)}"})
        s["uses"].setdefault(rows, []).append((name, agg, rows if needed is None else needed))

    def part(s, lvl, ago):
        """State at level `lvl` of the rows that end `ago` rows before this one."""
        out = []
        for f in _STATES[s["kind"]]:
            c = F.col(f"{s['id']}_{lvl}{f}")
            out.append(c if ago == 0 else F.lag(c, ago).over(w) if f == "v" else F.coalesce(F.lag(c, ago).over(w), F.lit(0.0)))
        return out

    def put(s, lvl, st):
        return {f"{s['id']}_{lvl}{f}": c for f, c in zip(_STATES[s["kind"]], st)}

    made: list[str] = []

    def stage(cols):
        made.extend(cols)
        b.stage(cols)

    def stage_merged(jobs):
        """jobs: (series, target level, [(level, ago)]); lags first, so that each is taken once."""
        lags, plans = {}, []
        for s, to, pieces in jobs:
            parts = []
            for lvl, ago in pieces:
                names = [f"{s['id']}_{lvl}{f}" if ago == 0 else f"{s['id']}_{lvl}{f}_{ago}" for f in _STATES[s["kind"]]]
                if ago:
                    lags |= dict(zip(names, part(s, lvl, ago)))
                parts.append([F.col(x) for x in names])
            plans.append((s, to, parts))
        stage({n: c for n, c in lags.items() if n not in made})
        return plans

    stage({k: v for s in series.values() for k, v in put(s, 0, _state_of(s["kind"], s["x"], s["y"])).items()})
    top = max(rows for s in series.values() for rows in s["uses"])
    lvl, size = 0, 1
    while size * RADIX <= top:
        jobs = [(s, lvl + 1, [(lvl, i * size) for i in range(RADIX)]) for s in series.values() if size * RADIX <= max(s["uses"])]
        stage({k: v for s, to, parts in stage_merged(jobs) for k, v in put(s, to, _merged(s["kind"], parts)).items()})
        lvl, size = lvl + 1, size * RADIX
    jobs = []
    for s in series.values():
        for rows in s["uses"]:
            pieces, ago, k = [], 0, lvl
            while ago < rows:
                if RADIX ** k <= rows - ago:
                    pieces.append((k, ago))
                    ago += RADIX ** k
                else:
                    k -= 1
            jobs.append((s, f"r{rows}_", pieces))
    plans = stage_merged(jobs)
    stage({k: v for s, to, parts in plans for k, v in put(s, to, _merged(s["kind"], parts)).items()})
    out = {}
    for s in series.values():
        for rows, uses in s["uses"].items():
            st = [F.col(f"{s['id']}_r{rows}_{f}") for f in _STATES[s["kind"]]]
            out |= {name: F.when(st[0] >= needed, _value(agg, st)) for name, agg, needed in uses}
    b.stage(out)
    b.df = b.df.drop(*made)
    return b


# ---- exponential means ----------------------------------------------------

SUB = 512
#: Weight of what is left out: below the resolution of a double.
EMA_REST = 2e-18


def ema_runs(span: float) -> int:
    """Whole runs of SUB rows before the current one that still weigh in."""
    r = 1.0 - 2.0 / (span + 1.0)
    return 0 if r <= 0 else max(2, math.ceil(math.log(EMA_REST) / (SUB * math.log(r))))


def ema_back(*spans: float) -> int:
    """Rows of context that exponential means of these spans need."""
    return SUB * max(ema_runs(x) for x in spans)


EMA_BACK = ema_back(50)


def ema_layers(b: Blocked, src: dict[str, tuple[Column, int, bool]]) -> Blocked:
    """Exponentially weighted means: {name: (value, span, adjust)}.

    Needs `indexed()` and a halo of `ema_back(spans)` rows.  Inside a run of 512
    rows the recurrence is a windowed power sum; each level carries over one
    more of the runs before, as many as the longest span needs.
    """
    for n, (x, span, _) in src.items():
        if 0 < 1.0 - 2.0 / (span + 1.0) < 0.25:
            raise ValueError("spans between 1 and 5/3 have no exact power sum")
    b.stage({n: x for n, (x, span, _) in src.items() if span <= 1})  # the mean of one row
    src = {n: v for n, v in src.items() if v[1] > 1}
    if not src:
        return b
    levels = max(ema_runs(span) for _, span, _ in src.values())
    if not b.in_runs:
        b.stage({RUN: F.floor(F.col(IX) / SUB)})
        b.in_runs = True
    sub_w = Window.partitionBy(*b.layout.keys, BLK, RUN).orderBy(*b.layout.order).rowsBetween(Window.unboundedPreceding, 0)
    prev = b.window.rowsBetween(Window.unboundedPreceding, -1)
    j = F.col(IX) % SUB
    names = list(src)
    rate = {n: 1.0 - 2.0 / (src[n][1] + 1.0) for n in names}

    def unit(n):
        x, span, adjust = src[n]
        if adjust:
            return x
        a = 2.0 / (span + 1.0)
        return F.when(F.col(IX) == 0, x).otherwise(x * a)

    b.stage({f"_e0_{n}": F.pow(F.lit(rate[n]), j) * F.sum(unit(n) / F.pow(F.lit(rate[n]), j)).over(sub_w) for n in names})
    for lvl in range(1, levels + 1):
        src_col = lambda n: f"_e{lvl - 1}_{n}"
        tail = lambda n: F.last(F.when(j == SUB - 1, F.col(src_col(n))), ignorenulls=True).over(prev)
        b.stage({
            f"_e{lvl}_{n}": F.col(f"_e0_{n}") + F.pow(F.lit(rate[n]), j + 1) * F.coalesce(tail(n), F.lit(0.0))
            for n in names
        })
    out = {}
    for n in names:
        e = F.col(f"_e{levels}_{n}")
        if src[n][2]:
            r = rate[n]
            e = e * (1.0 - r) / (1.0 - F.pow(F.lit(r), F.col(IX) + 1))
        out[n] = e
    b.stage(out)
    b.df = b.df.drop(*[f"_e{k}_{n}" for k in range(levels + 1) for n in names])
    return b


# ---- cumulative values -----------------------------------------------------

_FOLD = {
    "sum": (F.sum, lambda a, v: F.coalesce(a, F.lit(0.0)) + v),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "product": (F.product, lambda a, v: F.coalesce(a, F.lit(1.0)) * v),
    "count": (F.count, lambda a, v: F.coalesce(a, F.lit(0)) + v),
}


def running(df: DataFrame, items: dict[str, tuple[Column, str]], layout: Layout = DAILY) -> DataFrame:
    """Running aggregate from the start of each series: {name: (value, fold)}.

    NULL values are skipped; the result is NULL until the first value.
    """
    keys = list(layout.keys)
    if is_daily(df, layout.time, layout.keys):
        w = Window.partitionBy(*keys).orderBy(*layout.order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: _FOLD[f][0](v).over(w) for n, (v, f) in items.items()})
    marked = df.withColumn(CELL, time_cell(layout.time, layout.span))
    cells = marked.groupBy(*keys, CELL).agg(*[_FOLD[f][0](v).alias(f"_t_{n}") for n, (v, f) in items.items()])
    cw = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"count": F.sum}
    carry = cells.select(*keys, CELL, *[merge.get(f, _FOLD[f][0])(f"_t_{n}").over(cw).alias(f"_c_{n}") for n, (_, f) in items.items()])
    w = Window.partitionBy(*keys, CELL).orderBy(*layout.order).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carry, [*keys, CELL])
    cols = {}
    for n, (v, f) in items.items():
        local = _FOLD[f][0](v).over(w)
        both = _FOLD[f][1](F.col(f"_c_{n}"), local)
        cols[n] = F.coalesce(both, F.col(f"_c_{n}"))
    return out.withColumns(cols).drop(CELL, *[f"_c_{n}" for n in items])


def latest(df: DataFrame, keys: list[str], order: list[str | Column], cols: list[str] | None = None) -> DataFrame:
    """Newest row per key by `order`; a combining aggregate, not a window."""
    names = cols or [x for x in df.columns if x not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*names), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{x}").alias(x) for x in names])
    )


def oldest(df: DataFrame, keys: list[str], order: list[str | Column], cols: list[str] | None = None) -> DataFrame:
    names = cols or [x for x in df.columns if x not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{x}").alias(x) for x in names])
    )


def previous(df: DataFrame, items: dict[str, Column], layout: Layout = DAILY) -> DataFrame:
    """The last non-NULL value before each row, however far back it lies."""
    keys = list(layout.keys)
    if is_daily(df, layout.time, layout.keys):
        w = Window.partitionBy(*keys).orderBy(*layout.order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in items.items()})
    marked = df.withColumn(CELL, time_cell(layout.time, layout.span))
    order = F.struct(*layout.order)
    cells = marked.groupBy(*keys, CELL).agg(*[F.max_by(v, F.when(v.isNotNull(), order)).alias(f"_t_{n}") for n, v in items.items()])
    cw = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(*keys, CELL, *[F.last(f"_t_{n}", ignorenulls=True).over(cw).alias(f"_c_{n}") for n in items])
    w = Window.partitionBy(*keys, CELL).orderBy(*layout.order).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(carry, [*keys, CELL])
    out = out.withColumns({n: F.coalesce(F.last(v, ignorenulls=True).over(w), F.col(f"_c_{n}")) for n, v in items.items()})
    return out.drop(CELL, *[f"_c_{n}" for n in items])


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (an ungrouped aggregate) to df."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "_rank") -> DataFrame:
    """First k rows per key.  The literal bound lets Spark cut every map-side
    partition to k rows per key before the exchange, so a hot key stays small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def per_key(df: DataFrame, items: dict[str, Column], layout: Layout = DAILY) -> DataFrame:
    """Aggregates of each whole series attached to its rows."""
    keys = list(layout.keys)
    if is_daily(df, layout.time, layout.keys):
        w = Window.partitionBy(*keys)
        return df.withColumns({n: a.over(w) for n, a in items.items()})
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in items.items()]), keys)
