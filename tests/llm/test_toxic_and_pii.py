import re
import zlib

import numpy as np
import pytest
from llm_samples import prose

from marketloom.llm import pii
from marketloom.llm.toxicity import drop_toxic, fit_nnpu, score_toxicity


@pytest.fixture(scope="module")
def insults(spark):
    rows = [(i, prose(i, 40) + (" you vilewort rotter" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(800)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "you vilewort rotter", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string").repartition(4)
    # Only a part of the rows is labelled.
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(77777, None), (5, 0)], "doc_id long, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_scores(insults):
    docs, labels, truth = insults
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == 803
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in truth if got[i].held_out] == out and not got[None].held_out
    assert sum(got[i].predicted == truth[i] for i in out) >= 0.97 * len(out)
    assert got[None].predicted == 1 and got[9000].score == got[9001].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_no_labels(insults, odd_docs, no_docs):
    _, labels, _ = insults
    none = score_toxicity(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and {r.score for r in none} == {0.0}
    assert drop_toxic(odd_docs, labels.filter("toxic = 0")).count() == odd_docs.count()
    assert score_toxicity(no_docs, labels).count() == 0


def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(0)
    rows = lambda y, n: [np.flatnonzero(np.concatenate([rng.random(3) < (0.9 if y else 0.02), rng.random(5) < 0.3])) for _ in range(n)]
    w, b = fit_nnpu(rows(1, 200), rows(1, 200) + rows(0, 1800), 8, 0.1)
    z = lambda rs: np.array([w[r].sum() + b for r in rs])
    assert (z(rows(1, 300)) > 0).mean() > 0.9 and (z(rows(0, 300)) < 0).mean() > 0.95


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    ok = {
        "email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(re.sub(r"\D", "", m)[::-1])) % 10 == 0,
        "phone": lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15,
    }
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(PATTERNS) for m in re.finditer(p, text, re.ASCII) if ok[name](m[0])]
    return [(PATTERNS[k][0], a, b) for a, k, b in sorted(found)]


def test_base_spans_equal_the_plain_patterns():
    import random

    rnd = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", " ", "4111111111111111", "4111 1111-1111 1111", "10.0.0.255", "256", "1", "23", "+", "+1 (980) 555-6268", "(", ")", "x@y.z", "%", "é", "\n", "..", "00000000012"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_linear_on_long_runs():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" * 100_000, "1 " * 100_000):
        pii.base_spans(t)
        pii.candidates(t)


def test_skip_edges_carry_labels(odd_docs, no_docs, spark):
    rows = [(i, f"call +1 (980) 555-{1000 + i} today, ref {i}.5 or ann{i}@example.org now") for i in range(200)]
    extra = [(500, "call +1 (980) 555-6268 soon. Again: 555-6268 or (980) 555-6268, not 111-2222 and not 3.5"), (501, "555-6268 alone"), (502, "mail bob@example.org; as said, bob@localhost")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    texts = dict(rows + extra)
    added = {i: [texts[i][int(a):int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if (k, int(a), int(b)) not in plain_spans(texts[i])] for i in got}
    assert "555-6268" in added[500] and not any("111-2222" in x or x == "3.5" for x in added[500])
    assert added[501] == [] and not any(added[i] for i in range(200))
    assert (got[500].n_phone, got[500].n_email) == (1, 0)
    for r in pii.find_pii(odd_docs).collect():
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(odd_docs.filter("doc_id = 13").first()["text"] if r.doc_id == 13 else "")]
        assert set(base) <= set(r.spans.split(",")) or not base
    assert pii.find_pii(no_docs).count() == 0


def test_field_does_not_need_a_base_span():
    """Repeats that support each other are labelled whether or not an unrelated address stands in the text."""
    n = pii.OUT + 1
    skip = np.full((n, n), -1.0)
    skip[range(pii.OUT), range(pii.OUT)] = 4.0
    skip[pii.OUT, pii.OUT] = 0.0
    p = pii.Potentials({}, [-1.0 if k == "phone" else -5.0 for k in pii.KINDS] + [0.0], np.zeros((n, n)), skip)
    alone = " and then ".join(["555-6268"] * 6)
    far = alone + " x" * 200 + " ann@example.org"
    added = [pii.added_spans([t], [pii.base_spans(t)], p)[0] for t in (alone, far)]
    assert pii.base_spans(alone) == [] and added[0] == added[1] and len(added[0]) == 6
