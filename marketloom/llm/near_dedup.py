"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification, components.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. Copies (the same words in the same order) are one
vertex from the start. With 32 bands of 4 coordinates a pair at 0.8 is missed
with probability (1 - 0.8^4)^32 < 6e-8; every pair that is found is verified on
the whole shingle sets.

No bucket is expanded into all its pairs. A bucket of two is one pair. In a
larger one a pivot is compared with the members that are not yet connected to
it and then leaves: all its pairs are settled. So work goes round by round, in
each round with more pivots, until every bucket is one component.
Members that provably have no partner left are dropped between rounds: if too
many of a text's shingles stand in no other text that is still open, it cannot
share enough with any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dart_minhash as dart
from .common import col, fresh, maybe_broadcast, stored, text_of, words
from .components import components

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 4
#: Times as many pivots in each round.
GROWTH = 8
#: Words that one numpy step works on.
STEP = 400_000


def text_key(text: Column) -> Column:
    """Copies share it: a digest of the words."""
    return F.unhex(F.md5(F.array_join(words(text), " ").cast("binary")))


def _steps(arrays: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of at most STEP words together (or one longer document): (from, to, words, starts)."""
    starts = arrays.offsets.to_numpy().astype(np.int64)
    flat = arrays.values.to_numpy(zero_copy_only=False).view(np.uint64)
    i = 0
    while i < len(arrays):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP, side="right")) - 1)
        j = min(j, len(arrays))
        yield i, j, flat[starts[i]:starts[j]], starts[i:j + 1] - starts[i]
        i = j


def _list(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


def _signed(shingle: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = b.column(b.schema.get_field_index("hashes"))
            rest = [c for c in range(b.num_columns) if b.schema.field(c).name != "hashes"]
            for i, j, flat, starts in _steps(arrays):
                h, doc = dart.shingles(flat, starts, shingle)
                sig = dart.signatures(h, doc, j - i, n_bands * rows)
                keys = dart.bands(sig, rows)
                some = np.bincount(doc, minlength=j - i) > 0
                lens = np.where(some, n_bands, 0)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in rest), _list(keys[some].ravel(), np.concatenate([[0], np.cumsum(lens)]))], [*(b.schema.field(c).name for c in rest), "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = b.column(b.schema.get_field_index("hashes"))
            rest = [c for c in range(b.num_columns) if b.schema.field(c).name != "hashes"]
            for i, j, flat, starts in _steps(arrays):
                h, doc = dart.shingles(flat, starts, shingle)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, n = h[new], np.bincount(doc[new], minlength=j - i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in rest), pa.array(n, pa.int32()), _list(h.view(np.int64), np.concatenate([[0], np.cumsum(n)]))], [*(b.schema.field(c).name for c in rest), "n", "shingles"])

    return run


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", "na", "nb", common.alias("common")).filter(F.col("common") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _supported(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members that may still have a partner in their bucket.

    J >= s asks for a common part of s / (1 + s) times both sizes; what a text
    has in common with others is at most its shingles that occur at least twice.
    """
    open_ids = stored(members.select("rid").distinct(), "open")
    theirs = stored(sets.join(open_ids, "rid", "left_semi").select("rid", F.explode("shingles").alias("s")), "open-shingles")
    alone = theirs.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("rid").alias("rid")).filter("df = 1").groupBy("rid").agg(F.count(F.lit(1)).alias("own"))
    least = members.groupBy("bucket").agg(F.min("n").alias("least"))
    rated = members.drop("shared").join(alone, "rid", "left").join(least, "bucket").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    reach = F.col("shared") * (1 + similarity)
    return rated.filter(reach + 1e-6 >= similarity * (F.col("n") + F.greatest(F.col("least"), similarity * F.col("n")))).select(*members.columns)


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """`df` with the root of each rid; texts without links are their own."""
    return df.join(roots.withColumnRenamed("v", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))


def _merge(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(v, root) after more links: only the roots that these connect are joined anew."""
    if roots is None:
        return components(links)
    ends = links.select(F.posexplode(F.array("a", "b")).alias("side", "v"), "a", "b").join(roots, "v", "left").select("a", "b", "side", F.coalesce("root", "v").alias("r"))
    edges = ends.groupBy("a", "b").agg(F.min("r").alias("x"), F.max("r").alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    moved = components(edges)
    now = roots.join(moved.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    new = moved.join(roots, "v", "left_anti")
    return stored(now.unionByName(new.select("v", "root")), "roots")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, key, class_id, class_size) for every row of `docs`.

    `class_id` is the smallest id of the rows connected by links (null ids are
    smaller than all others and give a null class only where no other id is in
    it), `class_size` its number of rows. Words are lower-case runs of letters
    and digits. A text of one to four words has one shingle, all its words; texts
    without words (null, empty, punctuation) are copies of each other only.
    Repeated rows are members of the same class. An empty table gives an empty
    result. `key` is the digest of the words.
    """
    text = text_of(text_col)
    w = docs.select(col(id_col).alias("id"), words(text).alias("w"))
    hashed = w.select("id", F.unhex(F.md5(F.array_join("w", " ").cast("binary"))).alias("key"), F.transform("w", lambda x: F.xxhash64(x)).alias("hashes"))
    id_type = hashed.schema["id"].dataType.simpleString()
    signed = stored(hashed.mapInArrow(_signed(shingle, n_bands, rows), f"id {id_type}, key binary, bands array<bigint>"), "signatures")

    # One vertex for each different text. The id is written down, so it cannot change when a task runs again.
    reps = signed.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "texts")
    laid = reps.select("rid", F.explode("bands").alias("bucket"))
    buckets = stored(laid.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("a"), F.max("rid").alias("b")).filter("size > 1"), "buckets")
    twos = stored(buckets.filter("size = 2 and a <> b").select("a", "b").distinct(), "pairs")
    big = buckets.filter("size > 2").select("bucket", "size")
    members = stored(laid.join(maybe_broadcast(big, big.count()), "bucket").distinct(), "members")

    # The shingle sets of the texts that share any bucket.
    wanted = twos.select(F.col("a").alias("rid")).union(twos.select("b")).union(members.select("rid")).distinct()
    wanted = stored(reps.join(wanted, "rid", "left_semi").select("rid", "key", F.col("id").alias("first")), "wanted")
    n_wanted = wanted.count()
    again = docs.select(col(id_col).alias("id"), text.alias("text")).withColumn("key", text_key(F.col("text")))
    again = again.join(maybe_broadcast(wanted, n_wanted), "key").filter(F.col("id").eqNullSafe(F.col("first")))
    sets = again.select("rid", _word_hashes(F.col("text")).alias("hashes")).mapInArrow(_sets(shingle), "rid bigint, n int, shingles array<bigint>")
    sets = stored(sets.groupBy("rid").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles")), "shingle-sets")
    sizes = sets.select("rid", "n")

    weight = members.groupBy("rid").agg(F.sum("size").alias("weight"))
    members = stored(members.select("bucket", "rid").join(sizes, "rid").join(weight, "rid").withColumn("shared", F.col("n").cast("long")), "members")
    roots = _merge(None, stored(_verify(twos, sets, similarity), "links"))
    pivots = 1
    while True:
        placed = _rooted(members, roots)
        open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("bucket")
        placed = stored(placed.join(open_buckets, "bucket"), "open-buckets")
        if placed.isEmpty():
            break
        if pivots > 1:
            placed = stored(_supported(placed, sets, similarity), "supported")
        order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "rid")
        chosen = placed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pivots)
        chosen = stored(chosen.select("bucket", F.col("rid").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("p_n"), F.col("shared").alias("p_shared")), "pivots")
        # A pair that meets in several buckets is compared in the first of them where the pivot is one.
        meets = chosen.join(chosen.groupBy("p").agg(F.collect_set("bucket").alias("p_in")), "p")
        near = placed.join(placed.groupBy("rid").agg(F.collect_set("bucket").alias("in")), "rid").join(meets, "bucket").filter(
            (F.col("root") != F.col("p_root")) & (F.least("n", "p_n") >= similarity * F.greatest("n", "p_n"))
            & (F.least("shared", "p_shared") * (1 + similarity) + 1e-6 >= similarity * (F.col("n") + F.col("p_n")))
            & (F.col("bucket") == F.array_min(F.array_intersect("in", "p_in")))
        )
        pairs = near.select(F.least("rid", "p").alias("a"), F.greatest("rid", "p").alias("b")).distinct()
        roots = _merge(roots, stored(_verify(pairs, sets, similarity), "links"))
        members = stored(placed.join(chosen.select("bucket", F.col("p").alias("rid")), ["bucket", "rid"], "left_anti").select("bucket", "rid", "n", "weight", "shared"), "members")
        pivots *= GROWTH

    linked = stored(_rooted(reps.select("rid", "key", "id", "copies"), roots), "rooted")
    classes = linked.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = stored(linked.select("key", "root").join(classes, "root").select("key", "class_id", "class_size"), "classes")
    return signed.select("id", "key").join(named, "key").select(F.col("id").alias(id_col), "key", "class_id", "class_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class: that of the smallest id, and of rows that repeat it exactly one. Columns stay as they are."""
    key, cls, rows, tie = fresh(docs, "_key", "_class", "_rows", "_tie")
    found = similarity_classes(docs, id_col, text_col, **options)
    winner = found.filter(col(id_col).eqNullSafe(F.col("class_id"))).groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("rows"))
    # Several texts of a class may carry its smallest id, where ids repeat: the smallest key stays.
    winner = winner.join(found.select("key", F.col("class_id").alias("c"), "class_size").distinct(), "key")
    first = stored(winner.groupBy(F.col("class_id")).agg(F.min(F.struct("key", "rows")).alias("m"), F.first("class_size").alias("class_size")).select(F.col("m.key").alias(key), F.col("class_id").alias(cls), F.col("m.rows").alias(rows)), "winners")
    kept = docs.withColumn(key, text_key(text_of(text_col))).join(first, key).filter(col(id_col).eqNullSafe(col(cls)))
    base = [col(c) for c in docs.columns]
    if first.filter(col(rows) > 1).isEmpty():
        return kept.select(*base)
    ranked = kept.filter(col(rows) > 1).withColumn(tie, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).filter(col(tie) == 1)
    return kept.filter(col(rows) == 1).select(*base).unionByName(ranked.select(*base))
