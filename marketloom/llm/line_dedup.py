"""Line dedup by site-relative frequency.

A line is boilerplate of a host if it stands on more than `ratio` of the host's
pages, and on at least `min_pages` of them. Pages with the same text count as
one page, so a page that was crawled a thousand times does not make its own
text boilerplate.

Counts are combined map-side per (host, line hash). What is kept for a host is
bounded by its lines per page divided by `ratio`, since all lines together stand
on no more pages than that. That list is joined to the pages by host; Spark
broadcasts it only if its stored size allows, and splits a hot host otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, stored, text_of

RATIO, MIN_PAGES = 0.1, 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): hashes of the boilerplate lines of every host that has any."""
    text = text_of(text_col)
    pages = df.select(F.coalesce(col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("page"), F.filter(lines_of(text), lambda x: F.trim(x) != "").alias("lines"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("host", "page", F.explode_outer(F.array_distinct(F.transform("lines", _key))).alias("line")).filter("line is not null").distinct()
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= min_pages)
    found = stored(stored(counts, "line-counts").join(stored(totals, "host-pages"), "host").filter(F.col("on") > F.lit(ratio) * F.col("pages")).select("host", "line"), "boilerplate")
    return stored(found.groupBy("host").agg(F.collect_list("line").alias("lines")), "host-boilerplate")


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """`df` with the boilerplate lines of each row's host removed from its text.

    Lines are compared without surrounding blanks; blank lines always stay. A
    text of which nothing is left becomes empty, its row stays. Null texts stay
    null, null hosts count as the host ''. Every repeat of a boilerplate line
    goes, within a page too. `counts` names two added columns: lines before, and
    lines dropped. Repeated rows are treated alike. An empty table stays empty.
    """
    host, bad, lines, left = fresh(df, "_host", "_bad", "_lines", "_left")
    found = boilerplate(df, host_col, text_col, ratio, min_pages)
    out = df.withColumn(host, F.coalesce(col(host_col).cast("string"), F.lit(""))).join(found.select(F.col("host").alias(host), F.col("lines").alias(bad)), host, "left")
    out = out.withColumn(lines, lines_of(text_of(text_col)))
    out = out.withColumn(left, F.when(col(bad).isNull(), col(lines)).otherwise(F.filter(col(lines), lambda x: (F.trim(x) == "") | ~F.array_contains(col(bad), _key(x)))))
    cols = [F.when(col(c).isNotNull(), F.array_join(col(left), "\n")).alias(c) if c == text_col else col(c) for c in df.columns]
    if counts:
        cols += [F.size(lines).cast("long").alias(counts[0]), (F.size(lines) - F.size(left)).cast("long").alias(counts[1])]
    return out.select(*cols)
