import math

import numpy as np
import pytest

from marketloom.llm.vector_dedup import linked_in_step, principal_axes, vector_classes


def by_force(rows, cosine):
    """(n_links, component) of each row, all pairs compared."""
    def ok(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, li, a), (_, lj, b) = rows[i], rows[j]
            if ok(li, a) and ok(lj, b) and li == lj and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[i].append(j)
                    links[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def samples():
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for label in (1, 2, 2, 3):
        for _ in range(12):
            seed = rng.normal(size=20)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((at, label, (seed + rng.normal(scale=rng.choice([0.02, 0.12, 0.3]), size=20)).tolist()))
                at += 1
    rows += [(at + 1, 1, rows[0][2]), (at + 2, 2, rows[0][2]), (at + 3, None, rows[0][2]), (at + 4, 1, None), (at + 5, 1, []), (at + 6, 1, [0.0] * 20), (at + 7, 1, [math.nan] + [1.0] * 19), (at + 8, 1, [math.inf] + [1.0] * 19),
             (at + 9, 1, [None] + [1.0] * 19), (at + 10, 1, [1.0, 2.0]), (at + 11, 1, [2.0, 4.0]), (at + 12, 1, [1e300, 2e300]), (at + 13, 1, [-1.0, -2.0]), (at + 14, 3, rows[40][2]), (at + 14, 3, rows[40][2]), (None, 3, rows[40][2]), (None, 9, [1.0, 1.0])]
    return rows


@pytest.mark.parametrize("tile_bytes", [4 << 20, 1])  # one tile a label, and many of 64 vectors
def test_classes(spark, tile_bytes, monkeypatch):
    rows = samples()
    if tile_bytes == 1:
        monkeypatch.setattr("marketloom.llm.vector_dedup.TILE_LEAST", 8)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, first string, kept int").repartition(5)
    got = vector_classes(df, tile_bytes=tile_bytes).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == by_force(rows, 0.93)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got) and got[0].first == "x"


def test_tiles_that_are_wholly_linked(spark, monkeypatch):
    monkeypatch.setattr("marketloom.llm.vector_dedup.TILE_LEAST", 8)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, 1, (base + rng.normal(scale=0.001, size=16)).tolist()) for i in range(60)]
    got = vector_classes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), tile_bytes=1).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_threshold_is_met_exactly(spark):
    """3:4 against 1:0 is 0.6 and is linked at 0.6; the next smaller double is not."""
    rows = [(1, 1, [3.0, 4.0]), (2, 1, [1.0, 0.0]), (3, 2, [3.0, 4.0]), (4, 2, [0.9999999999999999, -1e-9])]
    got = {r.vec_id: r.n_links for r in vector_classes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), cosine=0.6).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_step_equals_plain_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 48)) + 2 * rng.normal(size=(5, 48)).repeat(40, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ principal_axes(x)
    assert (linked_in_step(turned[:90], turned, x[:90], x, 0.8) == (x[:90] @ x.T >= 0.8)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_classes(df).count() == 0
