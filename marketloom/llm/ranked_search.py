"""Ranked lexical search: accumulators of short lists as one iterator inside document-at-a-time evaluation of the long ones.

One pass over the documents writes, for every document, its length and how often
it holds each term of the query set; document frequencies and the totals of the
collection are aggregated from that table. A second pass evaluates every item on
blocks of documents. Within a block an item's terms have posting lists with the
largest contribution of each. The shortest lists are merged term at a time into
summed accumulators; these are then one more iterator, bounded by their largest
sum. It and the long lists are evaluated document at a time: the lists that
together cannot lift a document to the threshold never offer candidates, and a
candidate is left as soon as its sum and the bounds of the lists not yet read
stay under the threshold. The threshold is the lowest of the best `top` so far.

Thresholds start from the scores that a bounded number of documents reach: any
`top` documents give a lower bound on the last score that is returned, so this
saves work and never changes a result. Items are taken in blocks, which bounds
what a task holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, release, stored

TOP = 20
#: Fixed values of the score's definition.
WEIGHT_SCALE, TF_SCALE, K, B = 1000, 1_000_000_000, 12, 25
#: Documents that give the first thresholds; documents evaluated together, and about how many postings of theirs.
FIRST_DOCS, BLOCK_DOCS, BLOCK_POSTINGS = 20_000, 20_000, 1_000_000
#: Items evaluated in one pass over the documents, and about how many terms of theirs.
ITEMS, TERMS = 2_000, 500_000
#: Short lists are merged while together they hold at most this share of a block's documents (in 1/16).
SHORT = 2
#: Candidates evaluated between two looks at the threshold.
STRIDE = 1_024
#: A term is a maximal run of ASCII letters and digits and of all other characters; only A-Z are lower-cased.
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(SPLIT).split() if text else []


def _counted(vocabulary):
    """id, text -> id, n, terms and counts; only terms of the vocabulary, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value if vocabulary else None
        for b in batches:
            lens, names, counts, starts = [], [], [], [0]
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                lens.append(len(words))
                found = Counter(words if known is None else [w for w in words if w in known])
                if known is None:
                    names += found
                else:
                    names += [known[w] for w in found]
                counts += found.values()
                starts.append(len(counts))
            kind = pa.binary() if known is None else pa.int32()
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(at, pa.array(names, kind)), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["id", "n", "terms", "counts"])

    return run


class Block:
    """Posting lists of a block of documents: by term, sorted by document, with the contribution of each posting."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        order = np.lexsort((doc, term))
        self.doc, self.part = doc[order], part[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.most = np.maximum.reduceat(self.part, first) if len(first) else np.empty(0, dtype=np.int64)

    def list_of(self, term: int) -> int:
        """The place of the term's list, or -1."""
        i = int(np.searchsorted(self.terms, term))
        return i if i < len(self.terms) and self.terms[i] == term else -1


def best_of_block(block: Block, query: list[tuple[int, int]], n_docs: int, low: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block that may be among the best: all that reach the `top`-th score and `low`. Query: (term, times)."""
    lists = []
    for term, times in query:
        i = block.list_of(term)
        if i >= 0 and block.most[i] > 0:
            lists.append((block.first[i], block.first[i + 1], times, int(block.most[i]) * times))
    lists.sort(key=lambda x: x[1] - x[0])
    room, k = n_docs * SHORT // 16, 0
    while k < len(lists) and (room := room - int(lists[k][1] - lists[k][0])) >= 0:
        k += 1
    # Term at a time: the short lists become accumulators.
    docs = np.concatenate([block.doc[a:b] for a, b, _, _ in lists[:k]]) if k else np.empty(0, dtype=np.int64)
    sums = np.concatenate([block.part[a:b] * t for a, b, t, _ in lists[:k]]) if k else np.empty(0, dtype=np.int64)
    held, where = np.unique(docs, return_inverse=True)
    total = np.zeros(len(held), dtype=np.int64)
    np.add.at(total, where, sums)
    bound = int(total.max()) if len(total) else 0
    # Document at a time over the accumulators and the long lists, those of the largest bound first.
    long = sorted(lists[k:], key=lambda x: -x[3])
    after = np.cumsum([0, *[x[3] for x in reversed(long)]])[::-1]  # what the lists from here on can add
    low = max(low, 1)
    if len(total) >= top:
        low = max(low, int(np.partition(total, len(total) - top)[len(total) - top]))

    def offers(low: int) -> int:
        """How many of the long lists must offer candidates: the rest cannot reach the threshold alone."""
        return next((j for j in range(len(long) + 1) if after[j] < low), len(long))

    # The accumulators offer candidates unless they and all that offer nothing stay under the threshold.
    own = bound + int(after[0]) >= low
    sources = [held[total + after[0] >= low]] if own else []
    sources += [block.doc[a:b] for a, b, _, _ in long[:offers(low)]]
    offered = np.unique(np.concatenate(sources)) if sources else np.empty(0, dtype=np.int64)
    got_docs, got = [], []
    kept = np.empty(0, dtype=np.int64)
    for at in range(0, len(offered), STRIDE):
        cand = offered[at:at + STRIDE]
        place = np.searchsorted(held, cand)
        place[place == len(held)] = 0
        score = np.where(held[place] == cand, total[place], 0) if len(held) else np.zeros(len(cand), dtype=np.int64)
        for j, (a, b, times, _) in enumerate(long):
            open_ = score + after[j] >= low
            if not open_.all():
                cand, score = cand[open_], score[open_]
            if not len(cand):
                break
            postings = block.doc[a:b]
            p = np.searchsorted(postings, cand)  # skips to the candidates
            p[p == len(postings)] = 0
            hit = postings[p] == cand
            score = score + np.where(hit, block.part[a:b][p] * times, 0)
        good = score >= low
        cand, score = cand[good], score[good]
        got_docs.append(cand)
        got.append(score)
        kept = np.concatenate([kept, score])
        if len(kept) >= top:
            kept = np.partition(kept, len(kept) - top)[-top:]
            low = max(low, int(kept.min()))
    if not got:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    docs, score = np.concatenate(got_docs), np.concatenate(got)
    good = score >= low
    return docs[good], score[good]


def _evaluated(plan, top: int):
    """id, n, terms, counts -> k, id, score: the best of all documents that the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_all, l_all, lows = plan.value
        low = dict(lows)
        best: dict[int, pa.Table] = {}
        order = [("score", "descending"), ("id", "ascending")]

        def evaluate(b: pa.Table) -> None:
            b = b.combine_chunks()
            ids, n = b["id"].combine_chunks(), b["n"].to_numpy()
            lists = b["terms"].combine_chunks()
            starts = lists.offsets.to_numpy().astype(np.int64)
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = b["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), np.diff(starts))
            m = 100 - B + (B * n * n_all) // l_all
            block = Block(doc, term, weights[term] * ((TF_SCALE * tf) // (WEIGHT_SCALE * tf + K * m[doc])))
            for k, query in items.items():
                docs, score = best_of_block(block, query, len(n), low.get(k, 1), top)
                if len(docs):
                    new = pa.table({"id": ids.take(pa.array(docs)), "score": pa.array(score)})
                    both = pa.concat_tables([best[k], new]) if k in best else new
                    best[k] = both.take(pc.sort_indices(both, sort_keys=order, null_placement="at_end")[:top])
                    if len(best[k]) == top:
                        low[k] = max(low.get(k, 1), best[k]["score"][top - 1].as_py())

        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + len(b.column(2).flatten())
            if rows >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                evaluate(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if rows:
            evaluate(pa.Table.from_batches(held))
        for k, found in best.items():
            for b in found.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([pa.array([k] * b.num_rows, pa.int64()), b.column(0), b.column(1)], ["k", "id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the `top` documents of the highest score above 0 for every row of `items`.

    Terms are whole runs as `SPLIT` has them; null and empty texts have none and
    are not found. Repeated terms of an item count as often as they stand there.
    Equal scores are ranked by ascending id, null ids last; rows that repeat an
    id are ranked each. Repeated item ids are searched each and ranked together
    with one result list for each row of `items`. Other columns do not matter.
    Empty tables give an empty result. A document's terms are counted in its task
    whatever its length.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    asked = stored(items.select(col(item_col).alias("item"), col(item_text).alias("text")).withColumn("k", F.monotonically_increasing_id()), "search-items")
    counted = asked.select("k", "text").mapInArrow(_counted(None), "id bigint, n bigint, terms array<binary>, counts array<bigint>")
    terms = stored(counted.select(F.col("id").alias("k"), F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("k", F.col("e.terms").alias("term"), F.col("e.counts").alias("times")), "search-terms")
    size = terms.agg(F.count_distinct("k").alias("items"), F.count(F.lit(1)).alias("terms")).first()
    blocks = max(-(-size["items"] // ITEMS), -(-size["terms"] // TERMS))
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    results = [r for i in range(blocks) if (r := _search_block(rows, terms.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == i), id_type, top)) is not None]
    names = [F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"]
    if not results:
        return spark.createDataFrame([], f"item {item_type}, rank int, id {id_type}, score bigint").select(*names)
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    order = Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked.select("k", "item"), "k").select(*names)


def _search_block(rows: DataFrame, terms: DataFrame, id_type: str, top: int) -> DataFrame | None:
    """(k, id, score): the best documents, each task's own, for the items of one block; None if there are none."""
    spark = rows.sparkSession
    names = sorted(bytes(r["term"]) for r in terms.select("term").distinct().collect())  # about TERMS rows at most
    number = {t: i for i, t in enumerate(names)}
    queries: dict[int, list[tuple[int, int]]] = {}
    for r in terms.collect():
        queries.setdefault(r["k"], []).append((number[bytes(r["term"])], r["times"]))
    if not queries:
        return None
    postings = stored(rows.mapInArrow(_counted(spark.sparkContext.broadcast(number)), f"id {id_type}, n bigint, terms array<int>, counts array<bigint>"), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    n_all, l_all = int(totals["n"]), int(totals["l"] or 0)
    if not n_all:
        return None
    weights = np.zeros(len(names), dtype=np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row for each term
        weights[r["t"]] = math.floor(WEIGHT_SCALE * math.log((2 * n_all + 2) / (2 * r["df"] + 1)))
    out = f"k bigint, id {id_type}, score bigint"
    plan = spark.sparkContext.broadcast((queries, weights, n_all, l_all, {}))
    seen = postings.limit(FIRST_DOCS).mapInArrow(_evaluated(plan, top), out)
    lows = seen.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score")))).filter(F.col("r") == top).select("k", "score").collect()  # a row for each item
    plan = spark.sparkContext.broadcast((queries, weights, n_all, l_all, {r["k"]: r["score"] for r in lows}))
    found = stored(postings.mapInArrow(_evaluated(plan, top), out), "search-results")
    release(postings)
    return found
