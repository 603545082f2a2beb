"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else, labelled or not, is
only unlabelled. With the class prior p, the risk of a linear logistic model is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)): the share of
positives hidden in the unlabelled texts is taken off their negative risk, and
the bound at zero keeps the model from overfitting it. Where the bound is
passed, the gradient step goes back.

Features of a word are the word itself, its prefixes of 3 to 8 characters, and
those with the length of what follows; a text has a feature once or not at all.
Frequencies of all features are combined by Spark over the training rows, the
most telling ones become the model's inputs. Scoring is a lookup of each distinct word in the model's table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, stored, text_of, words

#: Bounds of the training sample and of the model: rows of each kind, features.
POSITIVES, UNLABELLED, FEATURES = 5_000, 15_000, 2_048
PREFIXES = (3, 4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W_]+")
#: Different words that a task remembers.
MEMORY = 500_000


def held_out(row_id: Column) -> Column:
    """crc32(id as text) mod 5 is 0."""
    return F.crc32(row_id.cast("string").cast("binary")) % 5 == 0


def word_features(word: str) -> list[str]:
    """A word, its prefixes as `pre*`, and as `pre+4` with four characters left."""
    size = len(word)
    return [word, *(f"{word[:n]}*" for n in PREFIXES if size > n), *(f"{word[:n]}+{size - n}" for n in PREFIXES if size > n)]


def feature_columns(word: Column) -> Column:
    """The same as an array column."""
    size = F.length(word)
    parts = [F.when(size > n, F.concat(F.substring(word, 1, n), end)) for n in PREFIXES for end in (F.lit("*"), F.concat(F.lit("+"), (size - n).cast("string")))]
    return F.filter(F.array(word, *parts), lambda f: f.isNotNull())


def text_features(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.update(word_features(w))
    return out


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float
    prior: float


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the model with the smallest non-negative PU risk. Rows are lists of feature numbers.

    Adam in numpy over the whole sample in each step, so the share of hidden positives is as even as it can be.
    """
    size = n_features + 1  # the last weight is the bias
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[-1] = np.log(prior / (1 - prior))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        lens = np.array([len(r) for r in rows])
        return np.concatenate([*rows, np.empty(0, dtype=np.int64)]), np.repeat(np.arange(len(rows)), lens), len(rows)

    def risk(rows: tuple[np.ndarray, np.ndarray, int], sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss for label `sign`, and its gradient."""
        f, owner, n = rows
        z = np.bincount(owner, weights=theta[f], minlength=n) + theta[-1]
        g = -sign / (1 + np.exp(np.clip(sign * z, -500, 500))) / n
        grad = np.bincount(f, weights=g[owner], minlength=size)
        grad[-1] = g.sum()
        return float(np.logaddexp(0, -sign * z).mean()), grad

    pos, unl = flat(positive), flat(unlabelled)
    for step in range(1, steps + 1):
        _, gp_pos = risk(pos, 1.0)
        rp_neg, gp_neg = risk(pos, -1.0)
        ru_neg, gu_neg = risk(unl, -1.0)
        hidden = gu_neg - prior * gp_neg
        grad = prior * gp_pos + hidden if ru_neg - prior * rp_neg >= 0 else -hidden
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _extract(wanted: list[str]):
    """For each text the numbers of the wanted features it has."""
    number = {f: i for i, f in enumerate(wanted)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "place": pd.util.hash_array(b["text"].to_numpy(dtype=object), categorize=False).astype(np.int64), "found": [sorted(number[f] for f in text_features(t) if f in number) for t in b["text"]]})

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model | None:
    """The model from the rows that are not held out; None without a confirmed toxic text.

    At most `positives` confirmed and `unlabelled` other texts are read, those of
    the smallest hash of their id. The class prior is the share of toxic ones
    among all labelled rows that are not held out. Only the row's text is an input.
    """
    known = labels.filter(~held_out(col(id_col)) & col(label_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.max(col(label_col).cast("int")).alias("y"))
    prior = known.agg(F.avg("y")).first()[0]
    if not prior:
        return None
    prior = min(max(prior, 0.01), 0.5)
    order = F.xxhash64("id")
    pos = known.filter("y = 1").orderBy(order, "id").limit(positives).select("id", F.lit(1).alias("y"))
    rows = docs.filter(~held_out(col(id_col))).select(col(id_col).alias("id"))
    # The unlabelled sample is drawn from all texts, positives included, as the prior assumes.
    unl = rows.distinct().orderBy(order, "id").limit(unlabelled).select("id", F.lit(0).alias("y"))
    chosen = stored(pos.unionByName(unl), "training-rows")  # at most positives + unlabelled rows
    texts = stored(docs.select(col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text"), "training-texts")
    count = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count.get(1) or not count.get(0):
        return None

    # Frequencies of words, then of their features; the features that stand out most among positives.
    seen = texts.select("y", F.explode_outer(F.array_distinct(words(F.col("text")))).alias("word")).filter("word is not null")
    seen = seen.groupBy("word").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u"))
    df = seen.select(F.explode(feature_columns(F.col("word"))).alias("feature"), "p", "u").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter("p >= 3")
    p, u = F.col("p") / count[1], F.col("u") / count[0]
    spread = F.sqrt((p + 1 / count[1]) / count[1] + (u + 1 / count[0]) / count[0])
    top = df.withColumn("z", (p - u) / spread).filter(F.col("z") > 3).orderBy(F.desc("z"), "feature").limit(features)
    names = [r["feature"] for r in top.select("feature").collect()]
    sparse = texts.mapInPandas(_extract(names), "y int, place bigint, found array<int>").toArrow().combine_chunks()  # numbers of known features only, for the bounded sample
    y, place, found = sparse["y"].to_numpy(), sparse["place"].to_numpy(), sparse["found"].combine_chunks()
    flat, at = found.values.to_numpy(), found.offsets.to_numpy()
    order = np.argsort(place, kind="stable")  # by the text's hash: the same fit whatever the order of the tasks
    rows_of = lambda label: [flat[at[i]:at[i + 1]] for i in order if y[i] == label]
    weights, bias = fit_nnpu(rows_of(1), rows_of(0), len(names), prior)
    return Model(names, weights, bias, prior)


def _scorer(model: Model, text: str, score: str):
    weight = {f: float(w) for f, w in zip(model.features, model.weights, strict=True) if w}
    bias = model.bias

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, ...]] = {}

        def look(token: str) -> tuple[str, ...]:
            got = known.get(token)
            if got is None:
                if len(known) >= MEMORY:
                    known.clear()
                got = known[token] = tuple({f for w in WORD.findall(token) for f in word_features(w) if f in weight})
            return got

        for b in batches:
            out = []
            for t in b[text]:
                hits = {f for token in set(t.lower().split()) for f in look(token)} if t else ()
                z = bias + sum(weight[f] for f in sorted(hits))
                out.append(1 / (1 + np.exp(-z)) if z > -500 else 0.0)
            b = b.drop(columns=[text])
            b[score] = np.array(out, dtype=float)
            yield b

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **bounds: int) -> DataFrame:
    """(id, held_out, score, predicted) for every row of `docs`.

    Null and empty texts have no feature and get the score of the bias. A null
    id is not held out. Equal texts get equal scores, so repeated rows do. Without
    a confirmed toxic text all scores are 0. An empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **bounds)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    if model is None:
        scored = base.select("id", F.lit(0.0).alias("score"))
    else:
        scored = base.mapInPandas(_scorer(model, "text", "score"), f"id {base.schema['id'].dataType.simpleString()}, score double")
    out = F.coalesce(held_out(F.col("id")), F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of `docs` scored below `threshold`, with their columns."""
    model = fit(docs, labels, id_col, text_col, label_col, **bounds)
    if model is None:
        return docs
    score, plain = fresh(docs, "_score", "_plain")
    run = _scorer(model, "text", "score")

    @F.pandas_udf("double")
    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in run(pd.DataFrame({"text": s}) for s in parts):
            yield b["score"]

    return docs.withColumn(score, scores(text_of(text_col))).filter(col(score) < threshold).drop(score)
