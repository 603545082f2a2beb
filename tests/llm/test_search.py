import math
import re
from collections import Counter

import numpy as np
import pytest

from llm_samples import prose
from marketloom.llm import ranked_search
from marketloom.llm.ranked_search import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_force(docs, items, top):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    big_n, big_l = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        q = TERM.findall((text or "").translate(LOWER))
        scored = []
        for i, c in counted:
            if not c:
                continue
            m = 75 + (25 * sum(c.values()) * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in q if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def samples():
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in range(400)]
    docs = [(i, " ".join(rng.choice(words, size=int(rng.integers(0, 80)), p=np.r_[np.full(20, 0.03), np.full(380, 0.4 / 380)]))) for i in range(700)]
    docs += [(800 + i, docs[7][1]) for i in range(40)]  # ties
    docs += [(900, None), (901, ""), (902, "?! \t"), (903, prose(1, 20_000) + " w1 w30"), (904, "Ärger ärger ÄRGER İ漢 w1\x00w2"), (5, docs[5][1]), (5, docs[5][1]), (None, docs[7][1]), (None, None)]
    items = [(1, "w1 W2 w2 w30, w31; w399"), (2, docs[7][1]), (3, "w0"), (4, None), (5, "nowhere"), (6, "ärger Ärger İ漢 w1"), (6, "w50"), (7, prose(1, 3000)), (None, "w60 w61")]
    return docs, items


@pytest.mark.parametrize("block", [20_000, 64])
def test_search(spark, block, monkeypatch):
    monkeypatch.setattr(ranked_search, "FIRST_DOCS", 50)
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    docs, items = samples()
    if block == 64:
        monkeypatch.setattr(ranked_search, "ITEMS", 3)  # several passes
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, k string, score int").repartition(3)
        got = search(df, spark.createDataFrame([(*i, 2) for i in items], "item_id int, text string, rank int"), top=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == by_force(docs, items, 20)


def test_empty(spark, no_docs, odd_docs):
    items = spark.createDataFrame([(1, "alpha3 beta")], "item_id int, text string")
    assert search(no_docs, items).count() == 0 and search(odd_docs, items.limit(0)).count() == 0
    assert search(odd_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
