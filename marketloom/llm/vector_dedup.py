"""Near-duplicate vectors by a PCA-ordered tiled comparison, then connected components.

Vectors are scaled to length one and rotated onto principal axes, so the leading
coordinates carry most of a product. A group (one label) is cut into tiles of
bounded size along those axes. Two tiles meet only if the triangle inequality
between their centres leaves a pair that can reach the threshold; if it shows
that every pair does, they are linked without any comparison. In a comparison
the product of the leading coordinates is accumulated first; what the other
coordinates can still add is at most the product of the two suffix norms, so
pairs that cannot reach the threshold stop there, and only the rest goes on to
the next coordinates.

A pair of tiles returns no pairs: it returns how many partners each vector has,
and a spanning forest of its links (one row a vector). Equal vectors are one
vertex with a count from the start.

The axes are fitted on a bounded sample. They are an orthonormal basis whatever
the sample, so they decide how early a comparison stops, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, release, stored
from .components import components

COSINE = 0.93
#: Values (rows times dimensions) of the sample that the axes are fitted on, and its rows.
SAMPLE_VALUES, SAMPLE_ROWS = 1_000_000, 20_000
#: Bytes of a tile's coordinates, and the fewest and most vectors in a tile.
TILE_BYTES, TILE_LEAST, TILE_MOST = 4 << 20, 64, 16_384
#: Leading coordinates after which a comparison may stop.
STOPS = (8, 16, 32)
#: Rows of a tile that one numpy step compares with the other tile.
STEP = 256
#: Products this close to the threshold are computed again from the given vectors.
CLOSE = 1e-9
#: Coordinates by which tiles are cut, and the cells at most.
CUT_AXES, CELLS = 8, 4_096


def usable(vector: str) -> Column:
    """Whether a vector can be compared: not null or empty, finite components only, not all zero."""
    v = col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """An orthonormal basis (columns), ordered by the variance of the given unit vectors along it."""
    values, axes = np.linalg.eigh(np.cov(vectors.T) if len(vectors) > 1 else np.eye(vectors.shape[1]))
    axes = np.atleast_2d(axes)[:, ::-1]
    return np.linalg.qr(axes)[0]


def _cuts(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete tree of median cuts, each along the widest leading axis: (axis, value) by node, breadth first."""
    nodes, level = [], [points]
    while len(level) < cells:
        down = []
        for p in level:
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            at = float(np.median(p[:, axis])) if len(p) else 0.0
            nodes.append((axis, at))
            low = p[:, axis] <= at
            down += [p[low], p[~low]]
        level = down
    return nodes


def _cell(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of each point."""
    axes, ats = np.array([n[0] for n in nodes], dtype=np.int64), np.array([n[1] for n in nodes])
    node = np.zeros(len(points), dtype=np.int64)
    while nodes and node[0] < len(nodes):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > ats[node])
    return node - len(nodes)


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _binary(matrix: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(matrix)
    return pa.array([r.tobytes() for r in raw], pa.binary())


def _level(m: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components below one: exact, and no square overflows."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _level(m)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _rotated(plans):
    """rid, grp, copies, dim, vec, sure -> the same with the rotated unit vector and its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                part = b.take(at)
                axes, nodes = plans.value[int(dim)]
                raw = _matrix(part.column(part.schema.get_field_index("vec")), int(dim))
                for lo in range(0, len(raw), 4096):
                    piece = raw[lo:lo + 4096]
                    turned = _unit(piece) @ axes
                    keep = [part.column(part.schema.get_field_index(c)).slice(lo, len(piece)) for c in ("rid", "grp", "copies")]
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(_cell(turned[:, :CUT_AXES], nodes), pa.int64()), _binary(turned), _binary(_level(piece))], ["rid", "grp", "copies", "cell", "turned", "given"])

    return run


def _ball(table: pa.Table) -> pa.Table:
    """Centre and radius of one tile."""
    t = np.frombuffer(b"".join(table["turned"].to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
    centre = t.mean(axis=0)
    radius = float(np.sqrt(((t - centre) ** 2).sum(axis=1)).max())
    return pa.table({"grp": table["grp"].slice(0, 1), "tile": table["tile"].slice(0, 1), "n": pa.array([table.num_rows], pa.int64()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius])})


class Forest:
    """Which vectors of two tiles hang together: every vector carries the smallest index of its part."""

    def __init__(self, n: int) -> None:
        self.part = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        parts = np.unique(self.part[members])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts[1:])] = parts[0]


def linked_in_step(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, cosine: float) -> np.ndarray:
    """A matrix of booleans: which rows of `a` (rotated unit vectors, some of a tile) reach the threshold with which of `b`.

    Products are accumulated over the leading coordinates; rows and columns
    without any open pair leave at each stop, and once few pairs are open these
    go on one by one.
    """
    dim = a.shape[1]
    stops = [*[s for s in STOPS if s < dim], dim]
    out = np.zeros((len(a), len(b)), dtype=bool)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total, begin = np.zeros((len(a), len(b))), 0
    for stop in stops:
        total = total + a[rows, begin:stop] @ b[cols, begin:stop].T
        rest_a = np.sqrt(np.einsum("ij,ij->i", a[rows, stop:], a[rows, stop:])) if stop < dim else np.zeros(len(rows))
        rest_b = np.sqrt(np.einsum("ij,ij->i", b[cols, stop:], b[cols, stop:])) if stop < dim else np.zeros(len(cols))
        alive = total + rest_a[:, None] * rest_b >= cosine - CLOSE
        i, j = np.nonzero(alive)
        if not len(i):
            return out
        if stop == dim or len(i) * 8 < alive.size:
            ri, cj = rows[i], cols[j]
            value, done = total[i, j], stop
            while done < dim:  # the open pairs alone, to the next stop
                to = stops[stops.index(done) + 1]
                value = value + np.einsum("ij,ij->i", a[ri, done:to], b[cj, done:to])
                if to < dim:
                    rest = np.sqrt(np.einsum("ij,ij->i", a[ri, to:], a[ri, to:]) * np.einsum("ij,ij->i", b[cj, to:], b[cj, to:]))
                    go = value + rest >= cosine - CLOSE
                    ri, cj, value = ri[go], cj[go], value[go]
                done = to
            close = np.flatnonzero(np.abs(value - cosine) <= CLOSE)
            if len(close):
                x, y = ga[ri[close]], gb[cj[close]]
                value[close] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            yes = value >= cosine
            out[ri[yes], cj[yes]] = True
            return out
        ka, kb = alive.any(axis=1), alive.any(axis=0)
        rows, cols, total, begin = rows[ka], cols[kb], total[np.ix_(ka, kb)], stop
    return out


def _compared(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Both tiles of one pair -> partners and part of each linked vector. `side` 0 and 1; a tile with itself has side 0 only."""
        side = table["side"].to_numpy()
        table = table.take(pa.array(np.argsort(side, kind="stable")))
        rid, copies, side = table["rid"].to_numpy(), table["copies"].to_numpy(), table["side"].to_numpy()
        turned = np.frombuffer(b"".join(table["turned"].to_pylist()), dtype=np.float64).reshape(len(rid), -1)
        given = np.frombuffer(b"".join(table["given"].to_pylist()), dtype=np.float64).reshape(len(rid), -1)
        same = bool(table["same"][0].as_py())
        order = np.lexsort((turned[:, 0], side))  # along the first axis
        rid, copies, side, turned, given = rid[order], copies[order], side[order], turned[order], given[order]
        cut = len(rid) if same else int(np.searchsorted(side, 1))
        first, second = slice(0, cut), slice(0, cut) if same else slice(cut, len(rid))
        reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6  # unit vectors farther apart along one axis are not linked
        partners, forest = np.zeros(len(rid), dtype=np.int64), Forest(len(rid))
        shift = 0 if same else cut
        axis = turned[second, 0]
        for lo in range(0, cut, STEP):
            hi = min(lo + STEP, cut)
            left = int(np.searchsorted(axis, turned[lo, 0] - reach))
            right = int(np.searchsorted(axis, turned[hi - 1, 0] + reach, side="right"))
            if same:
                left = max(left, lo)  # pairs with what stands before were met from there
            if left >= right:
                continue
            m = linked_in_step(turned[first][lo:hi], turned[second][left:right], given[first][lo:hi], given[second][left:right], cosine)
            if same:
                m &= np.arange(left, right)[None, :] > np.arange(lo, hi)[:, None]
            partners[lo:hi] += m @ copies[second][left:right]
            partners[shift + left:shift + right] += copies[first][lo:hi] @ m
            for i in np.flatnonzero(m.any(axis=1)):
                forest.join(np.append(np.flatnonzero(m[i]) + shift + left, lo + i))
        some = np.flatnonzero(partners)
        return pa.table({"rid": rid[some], "partners": partners[some], "root": rid[forest.part[some]]})

    return run


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """`vectors` without its vector column, with n_links, component_id and kept for every row.

    Rows are compared where the labels are equal and not null and the vectors
    have the same number of components (all rows, without `label_col`). Two are
    linked from the given cosine in doubles on. `n_links` counts the other rows
    linked directly, equal vectors included; `component_id` is the smallest id
    that links reach, its own included. Vectors that are null, empty or zero or
    hold null or non-finite components link with nothing. Null ids take part and
    are smaller than no id: a component of null ids alone has a null
    component_id, and such rows are not kept. Rows that repeat id and vector are
    linked to each other, and all carry the same result. Columns named like an
    added one are replaced. An empty table gives an empty result.

    What is compared grows with the square of a label's rows, less the tiles and
    coordinates that bounds leave out. `cosine` must be above 0.
    """
    added = ("n_links", "component_id", "kept")
    keep = [c for c in vectors.columns if c != vector_col and (c.lower() not in added or c in (id_col, label_col))]
    k0, k1, k2, v, j0, j1, j2, links, first = fresh(vectors, "_k0", "_k1", "_k2", "_vec", "_j0", "_j1", "_j2", "_links", "_first")
    label = col(label_col) if label_col else F.lit(0)
    given = F.when(usable(vector_col) & label.isNotNull(), F.transform(col(vector_col), lambda x: x.cast("double")))
    keyed = vectors.select(*[col(c) for c in keep], label.alias(k0), given.alias(v))
    keyed = keyed.withColumn(k1, F.when(col(v).isNotNull(), F.xxhash64(v))).withColumn(k2, F.when(col(v).isNotNull(), F.xxhash64(v, F.lit(1))))
    # One vertex for each different vector of a label; the id is written down, so it cannot change when a task runs again.
    reps = keyed.filter(col(v).isNotNull()).groupBy(k0, k1, k2).agg(F.min(col(id_col)).alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value(col(v)).alias("vec"))
    reps = stored(reps.select("*", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("rid")), "vectors")
    groups = stored(reps.groupBy(k0, "dim").agg(F.count(F.lit(1)).alias("size")).withColumn("grp", F.monotonically_increasing_id()), "vector-groups")

    spark = vectors.sparkSession
    plans, most = {}, {}
    for r in groups.groupBy("dim").agg(F.max("size").alias("size")).collect():  # one row for each number of components
        dim = r["dim"]
        rows = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
        sample = reps.filter(F.col("dim") == dim).orderBy(F.xxhash64(F.col(k1), F.lit(7)), k2).select("vec").limit(rows).collect()
        unit = _unit(np.array([s["vec"] for s in sample], dtype=np.float64))
        axes = principal_axes(unit)
        most[dim] = int(min(TILE_MOST, max(TILE_LEAST, tile_bytes // (8 * dim))))
        cells = 1
        while cells * most[dim] < r["size"] and cells < CELLS:
            cells *= 2
        plans[dim] = (axes, _cuts((unit @ axes)[:, :CUT_AXES], cells))
    shipped = spark.sparkContext.broadcast(plans)
    fits = F.create_map(*[F.lit(x) for d, n in most.items() for x in (d, n)]) if most else F.create_map(F.lit(0), F.lit(1))
    laid = reps.join(groups.select(k0, "dim", "grp"), [k0, "dim"]).select("rid", "grp", "copies", "dim", "vec")
    turned = laid.mapInArrow(_rotated(shipped), "rid bigint, grp bigint, copies bigint, cell bigint, turned binary, given binary")
    turned = stored(turned, "turned-vectors")
    # A cell over the tile's size is dealt over as many tiles as it needs.
    dims = groups.select("grp", fits[F.col("dim")].alias("fit"))
    sizes = turned.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("size")).join(dims, "grp").select("grp", "cell", F.ceil(F.col("size") / F.col("fit")).cast("long").alias("parts"))
    tiled = turned.join(sizes, ["grp", "cell"]).withColumn("tile", F.xxhash64("cell", F.pmod(F.xxhash64("rid"), F.col("parts")))).drop("cell", "parts")
    balls = stored(tiled.select("grp", "tile", "turned").groupBy("grp", "tile").applyInArrow(_ball, "grp bigint, tile bigint, n bigint, centre array<double>, radius double"), "vector-tiles")
    two = balls.select("grp", F.col("tile").alias("tile2"), F.col("centre").alias("c2"), F.col("radius").alias("r2"))
    gap = F.sqrt(F.aggregate(F.zip_with("centre", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = float(np.sqrt(2 - 2 * cosine))
    pairs = (
        balls.join(two, "grp").filter("tile <= tile2").withColumn("gap", gap).filter(F.col("gap") - F.col("radius") - F.col("r2") <= reach + 1e-6)
        .select("grp", "tile", "tile2", (F.col("gap") + F.col("radius") + F.col("r2") <= reach - 1e-6).alias("all"))
    )
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "tile-pairs")

    ends = pairs.filter("not all").select("pair", "grp", (F.col("tile") == F.col("tile2")).alias("same"), F.explode(F.when(F.col("tile") == F.col("tile2"), F.array(F.struct(F.lit(0).alias("side"), F.col("tile").alias("tile")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("tile").alias("tile")), F.struct(F.lit(1).alias("side"), F.col("tile2").alias("tile"))))).alias("e"))
    ends = ends.select("pair", "grp", "same", "e.side", "e.tile")
    met = tiled.join(ends, ["grp", "tile"]).select("pair", "side", "same", "rid", "copies", "turned", "given")
    found = met.groupBy("pair").applyInArrow(_compared(cosine), "rid bigint, partners bigint, root bigint")
    # Tiles whose vectors are all linked to each other: every vector has all others as partners.
    members = tiled.select("grp", "tile", "rid", "copies")
    weight = members.groupBy("grp", "tile").agg(F.sum("copies").alias("w"), F.min("rid").alias("least"))
    whole = pairs.filter("all").join(weight, ["grp", "tile"]).join(weight.select("grp", F.col("tile").alias("tile2"), F.col("w").alias("w2"), F.col("least").alias("least2")), ["grp", "tile2"])
    whole = whole.withColumn("root", F.least("least", "least2"))
    sides = whole.select("grp", "tile", F.when(F.col("tile") == F.col("tile2"), F.col("w")).otherwise(F.col("w2")).alias("p"), (F.col("tile") == F.col("tile2")).alias("own"), "root").unionByName(whole.filter("tile <> tile2").select("grp", F.col("tile2").alias("tile"), F.col("w").alias("p"), F.lit(False).alias("own"), "root"))
    full = members.join(sides, ["grp", "tile"]).select("rid", F.when(F.col("own"), F.col("p") - F.col("copies")).otherwise(F.col("p")).alias("partners"), "root").filter("partners > 0")
    found = stored(found.unionByName(full), "vector-links")
    roots = components(found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    partners = found.groupBy("rid").agg(F.sum("partners").alias("partners"))
    placed = reps.select("rid", k0, k1, k2, "id", "copies").join(roots.withColumnRenamed("v", "rid"), "rid", "left").join(partners, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    placed = stored(placed, "placed-vectors")
    firsts = placed.groupBy("root").agg(F.min("id").alias("first"))
    named = placed.join(firsts, "root").select(F.col(k0).alias(j0), F.col(k1).alias(j1), F.col(k2).alias(j2), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias(links), F.col("first").alias(first))
    named = stored(named, "vector-classes")
    release(reps, groups, turned, balls, pairs, found, placed)
    # Rows that cannot be linked have no key: they stay without a partner.
    out = keyed.drop(v).join(named, (col(k0) == col(j0)) & (col(k1) == col(j1)) & (col(k2) == col(j2)), "left")
    component = F.when(col(j1).isNull(), col(id_col)).otherwise(col(first))
    base = [col(c) for c in keep]
    return out.select(*base, F.coalesce(col(links), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(col(id_col) == component, F.lit(False)).alias("kept"))
