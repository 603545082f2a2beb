"""Exact ranks, cumulative counts and quantiles without a global sort task.

Values are first combined per distinct value (map-side), then cut into cells
at approximate quantiles.  Only the tiny cell table is scanned in order; inside
a cell the running sum is a window over (group, cell).  The edges decide how
work is spread, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CELLS = 32


def melt(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) rows of the non-missing cells of numeric columns."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.inline(items)).filter("value is not null and not isnan(value)")


def _edges_at_or_below(edges: str, x: Column) -> Column:
    """How many edges are <= x, as plain arithmetic inside generated code."""
    return sum((F.coalesce((F.get(edges, i) <= x).cast("int"), F.lit(0)) for i in range(CELLS - 1)), F.lit(0))


def ordered_scan(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], combined: bool = False) -> DataFrame:
    """Per distinct value: each sum, and what lies strictly below it.

    Output: group, value, {name}, {name}_below, {name}_total.  A group made of
    the feature name of `melt` has one row of edges per feature of the plan, so
    that side may be broadcast; other groups are left to the join planner.
    `combined`: the rows are distinct per group and value already.
    """
    names = list(sums)
    g = group or ["_g"]
    base = df if group else df.withColumn("_g", F.lit(0))
    d = base.select(*g, value, *[x.alias(n) for n, x in sums.items()]) if combined else base.groupBy(*g, value).agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    probs = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    edges = d.groupBy(*g).agg(F.array_distinct(F.percentile_approx(value, probs, 1000)).alias("_edges"), *[F.sum(n).alias(f"{n}_total") for n in names])
    # Both readers below must see the same edges: approximate quantiles depend on the order in which parts arrive, so they are stored.
    edges = cut_lineage(edges)
    if not group or group == ["feature"]:
        edges = F.broadcast(edges)
    celled = d.join(edges, g).withColumn("_cell", _edges_at_or_below("_edges", F.col(value))).drop("_edges")
    cells = celled.groupBy(*g, "_cell").agg(*[F.sum(n).alias(f"_s_{n}") for n in names])
    cw = Window.partitionBy(*g).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(*g, "_cell", *[F.coalesce(F.sum(f"_s_{n}").over(cw), F.lit(0)).alias(f"_c_{n}") for n in names])
    w = Window.partitionBy(*g, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = celled.join(carry, [*g, "_cell"]).withColumns({f"{n}_below": F.col(f"_c_{n}") + F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    out = out.drop("_cell", *[f"_c_{n}" for n in names])
    return out if group else out.drop("_g")


def quantile_aggs(value: str, n: str, qs: list[float]) -> list[Column]:
    """Aggregates of an ordered scan: for each quantile of the rows that `n` counts, the values below and above its place."""
    first, last = F.col(f"{n}_below"), F.col(f"{n}_below") + F.col(n)
    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col(f"{n}_total") - 1)
        for tag, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= k) & (k < last), F.col(value))).alias(f"_{tag}{i}"))
    return aggs


def quantile_values(total: str, qs: list[float]) -> Column:
    """The quantiles as an array, from those aggregates and the number of rows."""
    out = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col(total) - 1)
        out.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (pos - F.floor(pos)))
    return F.array(*out)


def exact_quantiles(df: DataFrame, group: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles per group, as the array column `q`."""
    s = ordered_scan(df.filter(F.col(value).isNotNull()), group, value, {"n": F.lit(1)})
    g = s.groupBy(*group).agg(*quantile_aggs(value, "n", qs), F.max("n_total").alias("n"))
    return g.select(*group, quantile_values("n", qs).alias("q"), "n")
