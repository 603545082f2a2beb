import re
from collections import Counter

import numpy as np
import pytest

from llm_samples import prose
from marketloom.llm import phrases as module
from marketloom.llm.phrases import chunks, collocations, phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def by_force(docs, least, cover=80, top=2000):
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in total:
        own = {p: n for (g, p), n in f.items() if g == lang}
        covered = {p[i:j] for p, n in own.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * n >= cover * own.get(p[i:j], 0)}
        rows = []
        for p, a in own.items():
            if len(p) < 2 or p in covered:
                continue
            s, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for i, x in enumerate(sorted(rows)[:top])]
    return sorted(out), total, f


def samples():
    rng = np.random.default_rng(9)
    words = [f"W{i}" if i % 3 else f"é{i}" for i in range(60)]
    docs = []
    for i in range(300):
        n = int(rng.integers(0, 120))
        picks = [words[int(x)] for x in np.minimum(59, rng.exponential(9, size=n))]
        docs.append((["en", "fr", None][i % 3], "".join(w + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "! ?"])) for w in picks)))
    docs += [("en", "the quick brown fox jumps over the lazy dog and runs far away " * 3)] * 40
    docs += [("en", "a " * 5000), ("en", prose(4, 20_000)), ("de", "a b " * 3000), ("en", None), (None, ""), ("fr", " \t ,"), ("und", "w1 W2 w1 w2"), ("en", "x\x1cy z x\x1cy z")]
    return docs


@pytest.mark.parametrize("modulus, least", [(16, 5), (2, 30), (1, 2)])
def test_collocations(spark, modulus, least, monkeypatch):
    monkeypatch.setattr(module, "MODULUS", modulus)  # more triggers, shorter chunks
    monkeypatch.setattr(module, "STEP_WORDS", 3000)
    docs = samples()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "lang string, text string, phrase string, n int").repartition(3)
    want, total, f = by_force(docs, least)
    assert sorted(map(tuple, collocations(df, least=least).collect())) == want
    found, totals = phrases(df, least=least)
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in total.items() if v}
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == f


def test_chunks_are_equal_wherever_they_stand():
    """A shared stretch has the same inner chunks in both texts, and the chunks of a piece overlap by three words."""
    shared = prose(3, 400)
    one, two = (list(zip(*chunks([f"{a} {shared} {a}".encode()], [1]), strict=True)) for a in ("left side", "another start here"))
    assert len({c for inner, c, _ in one if inner} & {c for inner, c, _ in two if inner}) > 10
    assert sum(n * (len(c.split()) - (3 if inner else 0)) for inner, c, n in one) == 404


def test_empty(spark, no_docs, odd_docs):
    assert collocations(no_docs).count() == 0
    assert collocations(odd_docs, least=10**6).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
