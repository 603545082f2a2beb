import random
import re
from collections import Counter, defaultdict

import numpy as np
from llm_samples import prose

from marketloom.llm import dart_minhash as dart
from marketloom.llm.components import components
from marketloom.llm.line_dedup import drop_boilerplate
from marketloom.llm.near_dedup import keep_one, similarity_classes


def plain_classes(rows, size=5, least=0.8):
    """Classes by comparing all pairs."""
    words = [[w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for _, t in rows]
    sets = [frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common / (len(sets[i]) + len(sets[j]) - common) >= least:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return sorted((sorted(rows[i][0] for i in g if rows[i][0] is not None), len(g)) for g in groups.values())


def classes_of(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[(r.class_id, r.key) if r.class_id is None else r.class_id].append(r)
    for k, g in groups.items():
        assert {r.class_size for r in g} == {len(g)} and (isinstance(k, tuple) or k == min(r.doc_id for r in g if r.doc_id is not None))
    return sorted((sorted(r.doc_id for r in g if r.doc_id is not None), len(g)) for g in groups.values())


def test_classes_of_odd_texts(odd_docs, no_docs):
    assert classes_of(similarity_classes(odd_docs)) == plain_classes([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert similarity_classes(no_docs).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies of one text with one to six changed words, and of another whose original is not there."""
    rnd = random.Random(3)
    rows = []
    for base, least in ((prose(31, 120), 0), (prose(32, 120), 1)):
        for _ in range(70):
            w = base.split()
            for _ in range(rnd.randint(least, 6)):
                w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(1000 + i, prose(100 + i, 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert classes_of(similarity_classes(df)) == plain_classes(rows)


def test_keep_one(odd_docs, no_docs):
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    found = similarity_classes(odd_docs)
    want = Counter(r.class_id for r in found.select("class_id", "key").distinct().collect() if r.class_id is not None)
    got = Counter(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert got == Counter(dict.fromkeys(want, 1))
    assert keep_one(no_docs).count() == 0


def test_dart_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    sig = dart.signatures(np.concatenate([a, b]), np.repeat([0, 1], 300), 3, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05 and (sig[2] == dart.NONE).all()
    # Weighted: minima over maxima of the weights.
    w1, w2 = rng.integers(1, 5, 300), rng.integers(1, 5, 300)
    sig = dart.signatures(np.concatenate([a, a]), np.repeat([0, 1], 300), 2, 2048, np.concatenate([w1, w2]))
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.05


def test_dart_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 40, 500, 9000)]
    together = dart.signatures(np.concatenate(docs), np.repeat(np.arange(5), [len(d) for d in docs]), 5, 64)
    for i, d in enumerate(docs):
        assert (dart.signatures(np.concatenate([d, d]), np.zeros(2 * len(d), dtype=int), 1, 64)[0] == together[i]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 300), (200, 300), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_boilerplate_lines(spark, odd_docs, no_docs):
    rows = [(i, f"Menu\n own line {i} \n\nFooter {i % 2} ", "site") for i in range(20)] + [(50 + i, "copied page\nall over", "site") for i in range(30)] + [(90, "Menu", "site"), (91, "Menu\nMenu", "other"), (92, None, "site"), (93, "Menu\nx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in drop_boilerplate(df, counts=("n_lines", "n_dropped")).collect()}
    assert len(got) == len(rows) and got[3].text == " own line 3 \n" and got[3].n_dropped == 2
    assert got[55].text == "copied page\nall over"  # one page, crawled often
    assert got[90].text == "" and got[91].text == "Menu\nMenu" and got[92].text is None and got[93].text == "Menu\nx"
    assert drop_boilerplate(odd_docs).columns == odd_docs.columns and drop_boilerplate(odd_docs).count() == odd_docs.count()
    assert drop_boilerplate(no_docs).count() == 0
