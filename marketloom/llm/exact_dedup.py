"""Exact dedup by two-pass Bloom filtering, in DataFrame operations only.

Pass one sets two cells of a counting Bloom filter for each text's hash and
keeps the cells that were hit at least twice. Pass two tests every row against
that filter: a row with a cell hit only once is certainly unique and passes
straight through, without a shuffle. Only the possible repeats are grouped, by
the full digest, so false positives cost a little work and never change a result.

The filter has a fixed number of bits, so what is broadcast is bounded by
`filter_bits / 64` rows of two longs whatever the input; more rows than it was
sized for only raise the share of rows that is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, fresh, stored, text_of

#: 2^25 bits: at most 524,288 broadcast rows. About 8 bits a row keep false positives near 5 %: raise it for more than 4 million rows.
FILTER_BITS = 1 << 25


def _cells(digest: Column, bits: int) -> list[Column]:
    """Two cells, one in each half of the filter."""
    half = bits // 2
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(half)) + F.lit(i * half) for i in (0, 1)]


def repeat_filter(digests: DataFrame, digest: str, bits: int = FILTER_BITS) -> DataFrame:
    """(word, mask): the cells hit by at least two rows, 64 to a word."""
    cells = digests.select(F.explode(F.array(*_cells(col(digest), bits))).alias("cell"))
    return (
        cells.groupBy("cell").agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 2")
        .groupBy(F.shiftright("cell", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(cell & 63 as int))")).alias("mask"))
    )


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """`df` with keep_id, group_size, kept and text_sha256 for every row.

    Texts are equal when identical, without any normalisation; null counts as
    the empty text, and empty texts are copies of each other. The row with the
    largest id stays (null ids are smaller than all others). Of rows that repeat
    both id and text exactly one stays. Columns of `df` named like an added one
    are replaced. An empty table gives an empty result.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    keep = [c for c in df.columns if c.lower() not in added or c in (id_col, text_col)]
    h, w1, w2, k1, k2, gid, gn, top, winner, size, stays, sha, tie = fresh(df, "_h", "_w1", "_w2", "_k1", "_k2", "_gid", "_gn", "_top", "_keep", "_size", "_kept", "_sha", "_tie")
    rows = df.select(*[col(c) for c in keep], F.sha2(text_of(text_col).cast("binary"), 256).alias(h))
    seen = repeat_filter(rows.select(h), h, filter_bits)
    cell = _cells(col(h), filter_bits)
    tested = rows
    for c, w, k in ((cell[0], w1, k1), (cell[1], w2, k2)):
        part = F.broadcast(seen.select(F.col("word").alias(w), F.col("mask").alias(k)))  # at most filter_bits / 64 rows
        tested = tested.join(part, F.shiftright(c, 6) == col(w), "left")
    hit = lambda c, k: F.coalesce(F.expr(f"shiftright(`{k}`, 0)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))), F.lit(0).cast("long")) != 0
    possible = hit(cell[0], k1) & hit(cell[1], k2)
    base = [col(c) for c in keep]

    alone = tested.filter(~possible).select(*base, col(id_col).alias(winner), F.lit(1).cast("long").alias(size), F.lit(True).alias(stays), col(h).alias(sha))
    repeats = tested.filter(possible).select(*base, col(h))
    groups = (
        repeats.groupBy(h).agg(F.max(F.struct(col(id_col).isNotNull().alias("some"), col(id_col).alias("id"))).alias("m"), F.count(F.lit(1)).alias(gn))
        .select(col(h), F.col("m.id").alias(gid), col(gn))
    )
    groups = stored(groups, "copies")
    # How many rows share the winner's id: more than one only where whole rows repeat.
    joined = repeats.join(groups, h)
    winners = joined.filter(col(id_col).eqNullSafe(col(gid))).groupBy(h).agg(F.count(F.lit(1)).alias(top)).filter(col(top) > 1).select(h)
    winners = stored(winners, "repeated-rows")
    out = joined.select(*base, col(gid).alias(winner), col(gn).alias(size), col(id_col).eqNullSafe(col(gid)).alias(stays), col(h).alias(sha))
    if winners.isEmpty():
        named = alone.unionByName(out)
    else:
        tied = out.join(winners.select(col(h).alias(tie)), (col(sha) == col(tie)) & col(stays), "left")
        again = tied.filter(col(tie).isNotNull())
        again = again.withColumn(stays, F.row_number().over(Window.partitionBy(sha).orderBy(F.lit(1))) == 1).drop(tie)
        named = alone.unionByName(tied.filter(col(tie).isNull()).drop(tie)).unionByName(again)
    return named.select(*base, col(winner).alias("keep_id"), col(size).alias("group_size"), col(stays).alias("kept"), col(sha).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of `df` that stay, with their columns (see `mark_copies`)."""
    marked = mark_copies(df.withColumn("_all", F.struct(*[col(c) for c in df.columns])).select("_all", col(id_col).alias("_id"), col(text_col).alias("_text")), "_id", "_text", filter_bits)
    return marked.filter("kept").select("_all.*")
