"""Personal data by patterns and a skip-chain conditional random field.

The base spans come from fixed patterns with checks. The field then labels the
remaining candidates (tokens with a digit or an at sign) of a document: its nodes
are all candidates, base ones with their label given; neighbours share a chain
edge; repeated or similar tokens, however far apart, share a skip edge. Loopy
message passing brings their labels into agreement, so a number that is written
once in full and later in a shorter form gets the same label. Tokens without a
digit or at sign are outside by definition, and no node.

Potentials are learned from the base labels of a bounded sample of documents:
labels by shape, label pairs on chain edges, and pairs of kinds on skip edges.
What no pattern accepted is only unknown there, not negative: such a candidate
starts with odds between `ODDS` against each kind, so it is never labelled by its
shape alone, and a skip edge between a kind and outside costs APART.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stored, text_of

KINDS = ("email", "ip", "card", "phone")
OUT = len(KINDS)
#: Fixed patterns; each digit run is entered at its first digit only, which finds the same leftmost matches in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MARK, SPACE, NUMERIC, DIGITS = re.compile(r"[0-9@]"), re.compile(r"\s"), re.compile(r"[0-9().+-]+"), re.compile(r"[^0-9]+")
#: Bound of the shapes the potentials know.
SHAPES = 2_000
SWEEPS, DAMPING, SURE, NEAR = 10, 0.3, 0.8, 60
ODDS, APART = (-2.5, -1.0), -2.0

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by start, then by kind; the leftmost matches of each kind that pass its check."""
    out: list[tuple[int, int, int]] = []
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        at = m.start()
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, 0, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = DIGITS.sub("", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or at sign, trimmed; purely numeric ones one blank apart are joined."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        s = SPACE.search(text, m.end())
        b = end = s.start() if s else len(text)
        while b > a and text[b - 1] in ".,;:!?)]}>\"'":
            b -= 1
        while a < b and text[a] in "([{<\"'":
            a += 1
        if out and out[-1][1] < a <= out[-1][1] + 2 and NUMERIC.fullmatch(text, out[-1][0], out[-1][1]) and NUMERIC.fullmatch(text, a, b):
            out[-1] = (out[-1][0], b)
        elif a < b:
            out.append((a, b))
    return out


def shape(token: str) -> str:
    """Digits as 9, letters as a, runs of letters as one; at most 24 characters."""
    s = re.sub(r"[0-9]", "9", token[:64])
    return re.sub(r"[^\W\d_]+", "a", s)[:24]


def likeness(token: str) -> list[str]:
    """Keys that similar tokens share: the token without case and punctuation, its last seven digits, an address's local part."""
    keys = ["t" + re.sub(r"[\W_]+", "", token.casefold())]
    d = DIGITS.sub("", token)
    if len(d) >= 7 and not re.search(r"[^\W\d_]", token):
        keys.append("d" + d[-7:])
    if "@" in token:
        keys.append("l" + token.split("@", 1)[0].casefold())
    return keys


def graph(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """(nodes, base label or OUT of each, chain edges, skip edges). Repeats are linked to the one before them, so edges grow with the nodes."""
    nodes = candidates(text)
    labels, k = [], 0
    for a, b in nodes:
        while k < len(base) and base[k][2] <= a:
            k += 1
        over = [s for s in base[k:k + 8] if s[1] < b and s[2] > a]
        labels.append(KINDS.index(over[0][0]) if over else OUT)
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    last: dict[str, int] = {}
    skip = set()
    for i, (a, b) in enumerate(nodes):
        for key in likeness(text[a:b]):
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
    return nodes, labels, chain, sorted(skip)


@dataclass
class Potentials:
    """Log potentials: of labels by shape (and for other shapes), of label pairs on chain and on skip edges."""
    shapes: dict[str, list[float]]
    other: list[float]
    chain: np.ndarray
    skip: np.ndarray


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: Counter = Counter()
        for t in b["text"]:
            nodes, labels, chain, skip = graph(t, base_spans(t))
            seen.update(("shape", shape(t[a:e]), y, -1) for (a, e), y in zip(nodes, labels, strict=True))
            seen.update(("chain", "", labels[i], labels[j]) for i, j in chain)
            seen.update(("skip", "", labels[i], labels[j]) for i, j in skip)
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["what", "shape", "y", "z", "n"])


def learn(docs: DataFrame, text_col: str = "text", shapes: int = SHAPES) -> Potentials:
    """Potentials from the base labels of all different texts; counts are combined by Spark."""
    texts = docs.select(text_of(text_col).alias("text")).distinct()
    counts = stored(texts.mapInPandas(_observe, "what string, shape string, y int, z int, n bigint").groupBy("what", "shape", "y", "z").agg(F.sum("n").alias("n")), "pii-counts")
    known = counts.filter("what = 'shape'").groupBy("shape").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "shape").limit(shapes).select("shape", F.lit(True).alias("kept"))
    few = counts.join(F.broadcast(known), "shape", "left").groupBy("what", F.when(F.col("kept") | (F.col("what") != "shape"), F.col("shape")).alias("shape"), "y", "z").agg(F.sum("n").alias("n"))
    seen = few.collect()  # at most (shapes + 1) * 5 + 2 * 25 rows
    n = OUT + 1
    by_shape: dict[str, np.ndarray] = {}
    pair = {"chain": np.ones((n, n)), "skip": np.ones((n, n)) + 2 * np.eye(n)}
    total = np.ones(n)
    for r in seen:
        if r["what"] == "shape":
            total[r["y"]] += r["n"]
            if r["shape"] is not None:
                by_shape.setdefault(r["shape"], np.full(n, 0.5))[r["y"]] += r["n"]
        else:
            pair[r["what"]][r["y"], r["z"]] += r["n"]
            pair[r["what"]][r["z"], r["y"]] += r["n"]
    log = lambda c: np.log(c / c.sum())
    edge = lambda c: np.log(c / c.sum()) - np.log(c.sum(0) / c.sum())[None, :] - np.log(c.sum(1) / c.sum())[:, None]  # noqa: E731  how much likelier together than apart
    skip = np.full((n, n), APART)
    skip[OUT, OUT] = 0.0
    skip[:OUT, :OUT] = np.clip(edge(pair["skip"][:OUT, :OUT]), -4, 4)
    skip[range(OUT), range(OUT)] = np.clip(np.diag(skip)[:OUT], 1, 4)
    return Potentials({s: log(c).tolist() for s, c in by_shape.items()}, log(total).tolist(), np.clip(edge(pair["chain"]), -1, 1), skip)


def propagate(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Beliefs of all nodes after loopy message passing (sum-product in logarithms, damped)."""
    if len(edges):
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        psi = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])
        msg = np.zeros((len(src), unary.shape[1]))
        for _ in range(SWEEPS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            z = (belief[src] - msg[back])[:, :, None] + psi
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        unary = unary.copy()
        np.add.at(unary, dst, msg)
    z = np.exp(unary - unary.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _unary(token: str, label: int, p: Potentials) -> list[float]:
    if label != OUT:
        return [0.0 if k == label else -50.0 for k in range(OUT + 1)]
    u = p.shapes.get(shape(token), p.other)
    # What no pattern accepted needs the support of an edge.
    return [min(max(x - u[OUT], ODDS[0]), ODDS[1]) for x in u[:OUT]] + [0.0]


def added_spans(texts: list[str], bases: list[list[Span]], p: Potentials) -> list[list[Span]]:
    """For each text the spans that the field adds; the graphs of all texts are one union."""
    unary: list[list[float]] = []
    edges: list[tuple[int, int]] = []
    kinds: list[int] = []
    nodes: list[tuple[int, int, int]] = []
    labels: list[int] = []
    for t, (text, base) in enumerate(zip(texts, bases, strict=True)):
        own, ys, chain, skip = graph(text, base)
        at = len(nodes)
        nodes += [(t, a, b) for a, b in own]
        labels += ys
        unary += [_unary(text[a:b], y, p) for (a, b), y in zip(own, ys, strict=True)]
        edges += [(at + i, at + j) for i, j in chain + skip]
        kinds += [0] * len(chain) + [1] * len(skip)
    out: list[list[Span]] = [[] for _ in texts]
    if nodes:
        belief = propagate(np.array(unary), np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(kinds, dtype=np.int64), np.stack([p.chain, p.skip]))
        for (t, a, b), y, z in zip(nodes, labels, belief, strict=True):
            k = int(z.argmax())
            if y == OUT and k != OUT and z[k] >= SURE and not any(s[1] < b and s[2] > a for s in bases[t]):
                out[t].append((KINDS[k], a, b))
    return out


def _text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _finder(p: Potentials):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i:i + 500]
                texts = list(part["text"])
                bases = [base_spans(t) for t in texts]
                every = [sorted(x + y, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for x, y in zip(bases, added_spans(texts, bases, p), strict=True)]
                yield pd.DataFrame({
                    "id": part["id"], **{f"n_{k}": [sum(s[0] == k for s in x) for x in bases] for k in KINDS},
                    "base_sha256": [hashlib.sha256(_text(x).encode()).hexdigest() for x in bases], "spans": [_text(x) for x in every],
                })

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of `docs`.

    The counts and the digest are of the base spans, `spans` has all, base ones
    included; places are code points, the end exclusive. Null and empty texts
    have none. A document's result depends on its text and the potentials only,
    so repeated rows get the same. An empty table gives an empty result.
    """
    p = learn(docs, text_col, **bounds)
    base = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    out = base.mapInPandas(_finder(p), f"id {base.schema['id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
