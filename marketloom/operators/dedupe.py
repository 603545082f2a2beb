"""Removal of near-identical texts, exact and without pairing a group.

The rule is greedy in time order: a text is dropped when an accepted earlier
text inside the time window has the same words up to a Jaccard threshold.

Candidates come from partition signatures.  Two sets of n and m tokens with
Jaccard >= t differ in at most d = (1-t)/t * n tokens (n the smaller size).  If
tokens are hashed into d+1 classes, at least one class is equal in both sets,
so equal (level, class, hash of that class) keys reach every true pair; unequal
texts hardly ever share a key.

A text that shares no key with another one in reach is accepted at once.  Rounds
then follow the greedy order of the others with group minima only:
  * a text that is the earliest undecided one under all of its keys cannot be
    dropped any more: it is accepted;
  * at most two new texts are accepted per (key, time cell), so comparing the
    undecided texts with them is linear in the rows, however large a group of
    copies is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import jaccard
from ..functions.text import normalize_text, tokenize
from ..session import cut_lineage
from .series import attach_row


def size_levels(t: float, top: int = 1 << 40) -> list[int]:
    """Lower bounds of set-size levels, beyond any array's size; a pair spans at most two of them."""
    b = [1]
    while b[-1] < top:
        b.append(int(b[-1] / t) + 1)
    return b


def signature_udf(threshold: float):
    bounds = np.array(size_levels(threshold))

    @F.pandas_udf("array<bigint>")
    def signatures(hashes: pd.Series) -> pd.Series:
        out = []
        with np.errstate(over="ignore"):
            for h in hashes:
                v = np.asarray(h, dtype=np.int64).view(np.uint64)
                if len(v) == 0:
                    out.append(np.zeros(1, dtype=np.int64))
                    continue
                level = int(np.searchsorted(bounds, len(v), side="right")) - 1
                keys = []
                for p in {level, max(level - 1, 0)}:
                    small = int(bounds[p + 1]) - 1
                    classes = int((1 - threshold) / threshold * small + 1e-9) + 1
                    which = (v % np.uint64(classes)).astype(np.int64)
                    sums = np.zeros(classes, dtype=np.uint64)
                    np.add.at(sums, which, v * np.uint64(0x9E3779B97F4A7C15) ^ (v >> np.uint64(29)))
                    ids = np.arange(classes, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(p + 1) * np.uint64(0x165667B19E3779F9)
                    keys.append((sums * np.uint64(0xD6E8FEB86659FD93) + ids).view(np.int64))
                out.append(np.concatenate(keys))
        return pd.Series(out)

    return signatures


def _meeting(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that share a key with another one in reach, and (id, t) of all others, which are accepted.

    Only (key, cell) hashes and their counts are shuffled for that; the rounds, which
    shuffle keys and tokens several times, are left with the rows that may have a partner.
    Equal hashes of different places send more rows to the rounds, never fewer.
    """
    places = F.array(F.xxhash64("k", "cell"), F.xxhash64("k", F.col("cell") + 1))
    at = rows.select("r", "cell", F.explode("sig").alias("k")).select("r", F.explode(places).alias("x"))
    shared = cut_lineage(at.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x"))
    some = cut_lineage(at.join(_small(shared), "x", "left_semi").select("r").distinct())
    some = _small(some)
    return cut_lineage(rows.join(some, "r", "left_semi").drop("r")), rows.join(some, "r", "left_anti").select("id", "t")


def _small(keys: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A broadcast hint while the counted keys (of 8 bytes) are few."""
    return F.broadcast(keys) if keys.count() <= limit else keys


def dedupe_near_identical(df: DataFrame, *, id_col: str, time: str = "timestamp", text: str = "text", threshold: float = 0.9,
                          window_hours: int = 48) -> DataFrame:
    """`id_col` values of the accepted rows (columns: id, ts)."""
    micros = window_hours * 3_600_000_000
    rows = df.select(F.col(id_col).alias("id"), F.unix_micros(time).alias("t"), F.array_distinct(tokenize(text)).alias("tok"))
    rows = rows.withColumn("sig", F.array_distinct(signature_udf(threshold)(F.transform("tok", lambda x: F.xxhash64(x)))))
    rows = rows.withColumn("cell", F.floor(F.col("t") / micros))
    rows = cut_lineage(rows.withColumn("r", F.xxhash64("id", "t", "sig")))
    rows, kept = _meeting(rows)
    left = rows.select("id", "t", "cell", "sig")
    while True:  # the earliest undecided text of each key is decided in every round
        entries = left.select("id", "t", "cell", F.explode("sig").alias("k"))
        both = entries.select("k", "cell", "id", "t", F.col("cell").alias("home")).unionByName(
            entries.select("k", (F.col("cell") + 1).alias("cell"), "id", "t", F.col("cell").alias("home")))
        heads = both.groupBy("k", "cell").agg(F.min(F.struct("t", "id", "home")).alias("h"))
        won = heads.filter(F.col("h.home") == F.col("cell")).groupBy(F.col("h.id").alias("id")).agg(F.count("*").alias("n"))
        free = cut_lineage(left.join(won, "id").filter(F.col("n") == F.size("sig")).select("id", "t", "cell", "sig"))
        acc = free.select(F.col("id").alias("a"), F.col("t").alias("ta"), "cell", F.explode("sig").alias("k"))
        acc = acc.select("a", "ta", "k", F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("cell"))
        cand = entries.join(acc, ["k", "cell"]).filter((F.col("id") != F.col("a")) & (F.struct("ta", "a") < F.struct("t", "id")) & (F.col("t") - F.col("ta") <= micros))
        cand = cut_lineage(cand.select("a", "id").distinct())
        ids = cand.select(F.explode(F.array("a", "id")).alias("id")).distinct()
        # only the tokens of candidates travel, while their ids are few enough to be sent to them
        tok = rows.select("id", "tok") if (few := _small(ids)) is ids else rows.select("id", "tok").join(few, "id", "left_semi")
        sim = cand.join(tok, "id").join(tok.select(F.col("id").alias("a"), F.col("tok").alias("atok")), "a")
        gone = sim.filter(jaccard(F.col("tok"), F.col("atok")) >= threshold).select("id").distinct()
        kept = kept.unionByName(free.select("id", "t"))
        left = cut_lineage(left.join(free.select("id"), "id", "left_anti").join(gone, "id", "left_anti"))
        if left.isEmpty():
            return kept.select("id", F.timestamp_micros("t").alias("ts"))


def dedupe_report(df: DataFrame, kept: DataFrame) -> DataFrame:
    a = df.agg(F.count("*").alias("input_count"))
    b = kept.agg(F.count("*").alias("output_count"))
    return attach_row(a, b).select("input_count", (F.col("input_count") - F.col("output_count")).alias("deduped_count"), "output_count")


def keep_first(df: DataFrame, key, order: list, cols: list[str] | None = None) -> DataFrame:
    """First row per key by `order`, as a combining aggregate."""
    names = cols or df.columns
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r")).select(*[F.col(f"_r.{x}").alias(x) for x in names])


def post_key(title, body):
    return normalize_text(F.concat_ws(" ", title, body))
