"""The nested triangular grid as generated tables: cells, edges, neighbours, refined leaves.

A cell id is a base face and one base-4 digit per level, so a cell's corners, and the id across each
of its edges, are integer arithmetic on the id. Tables come from `spark.range` and that arithmetic
in Arrow batches: no driver loop and no shuffle, at any level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.contracts import require
from gridspark.functions import cells, numeric
from gridspark.operators.ordered import match

# The icosahedron's vertices before scaling, and its faces as vertex numbers.
GOLDEN = (1.0 + 5.0**0.5) / 2.0
CORNERS = (
    (-1, GOLDEN, 0), (1, GOLDEN, 0), (-1, -GOLDEN, 0), (1, -GOLDEN, 0),
    (0, -1, GOLDEN), (0, 1, GOLDEN), (0, -1, -GOLDEN), (0, 1, -GOLDEN),
    (GOLDEN, 0, -1), (GOLDEN, 0, 1), (-GOLDEN, 0, -1), (-GOLDEN, 0, 1),
)
FACES = (
    (1, 12, 6), (1, 6, 2), (1, 2, 8), (1, 8, 11), (1, 11, 12),
    (2, 6, 10), (6, 12, 5), (12, 11, 3), (11, 8, 7), (8, 2, 9),
    (4, 10, 5), (4, 5, 3), (4, 3, 7), (4, 7, 9), (4, 9, 10),
    (5, 10, 6), (3, 5, 12), (7, 3, 11), (9, 7, 8), (10, 9, 2),
)
MAX_LEVEL = 24  # vertex keys pack two coordinates of this many bits


def _base() -> tuple[np.ndarray, np.ndarray]:
    """Unit vertices (12, 3) and faces (20, 3) of 0-based vertex numbers, counterclockwise from outside."""
    v = np.array(CORNERS, dtype=float)
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    f = np.array(FACES) - 1
    a, b, c = v[f[:, 0]], v[f[:, 1]], v[f[:, 2]]
    inward = (np.cross(b - a, c - a) * (a + b + c)).sum(axis=1) < 0
    f[inward] = f[inward][:, [0, 2, 1]]
    return v, f


VERTICES, FACE_VERTICES = _base()


def _adjacency() -> tuple[np.ndarray, np.ndarray]:
    """For face f and local vertex j: the face across the opposite edge, and where in that face the
    next vertex, the one after it, and the face's own far vertex sit."""
    across, places = np.zeros((20, 3), int), np.zeros((20, 3, 3), int)
    for f in range(20):
        for j in range(3):
            u, v = FACE_VERTICES[f, (j + 1) % 3], FACE_VERTICES[f, (j + 2) % 3]
            g = next(g for g in range(20) if g != f and u in FACE_VERTICES[g] and v in FACE_VERTICES[g])
            at = [list(FACE_VERTICES[g]).index(u), list(FACE_VERTICES[g]).index(v)]
            across[f, j], places[f, j] = g, [*at, 3 - sum(at)]
    return across, places


ACROSS, PLACES = _adjacency()


def _up(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct parents of cells, which of them each cell has, and each cell's own digit.

    A batch is a run of ids, so it has a quarter as many parents: what is worked out on them, and on theirs,
    costs a third of a batch more whatever the level.
    """
    parents, at = np.unique((ids - 1) >> 2, return_inverse=True)
    return parents + 1, at, (ids - 1) & 3


def _walk(ids: np.ndarray, level: int, corners, mid) -> np.ndarray:
    """Corners (n, 3, d) of each cell: those of its parent, halved; `corners` gives those of base faces."""
    if level == 0:
        return corners(ids - 1)
    parents, at, digit = _up(ids)
    tri = _walk(parents, level - 1, corners, mid)
    a, b, c = tri[:, 0], tri[:, 1], tri[:, 2]
    ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
    return np.stack([a, ab, ca, b, bc, ab, c, ca, bc, ab, bc, ca], axis=1).reshape(len(tri), 4, 3, -1)[at, digit]


def lattice_corners(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Base face and integer barycentric corners (n, 3, 3), each summing to 2^level."""
    face = (ids - 1) >> (2 * level)
    start = np.eye(3, dtype=np.int64) << level
    return face, _walk(ids, level, lambda f: np.broadcast_to(start, (len(f), 3, 3)), lambda p, q: (p + q) >> 1)


def sphere_corners(ids: np.ndarray, level: int, project: bool = True) -> np.ndarray:
    """Unit-sphere corners (n, 3, 3); `project=False` leaves midpoints on the chord, as a control."""

    def mid(p, q):
        m = (p + q) / 2
        return m / np.sqrt((m * m).sum(axis=-1))[..., None] if project else m

    return _walk(ids, level, lambda f: VERTICES[FACE_VERTICES[f]], mid)


def vertex_keys(face: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One BIGINT per lattice point (n, 3), equal for every face that holds the point."""
    base = FACE_VERTICES[face].astype(np.int64)
    zeros = (p == 0).sum(axis=1)
    inside = (face.astype(np.int64) << 50) | (p[:, 0] << 25) | p[:, 1]
    held = np.where(p > 0, base, -1)
    hi, lo = held.max(axis=1), np.where(p > 0, base, 99).min(axis=1)
    w = np.where(base == lo[:, None], p, 0).sum(axis=1)
    on_edge = (np.int64(1) << 60) | (lo << 50) | (hi << 40) | w
    return np.select([zeros == 0, zeros == 1], [inside, on_edge], (np.int64(2) << 60) | lo)


# A corner child's edges 2 and 3 are halves of its parent's; edge 1 is shared with the middle child (digit 3).
HALF_OF = np.array([[0, 2, 3], [0, 3, 1], [0, 1, 2]])  # [digit, k - 1]: the parent's edge
AS_HALF = np.array([[0, 2, 3], [3, 0, 2], [2, 3, 0]])  # [digit, parent's edge - 1]: the child's edge
MIDDLE = np.array([2, 3, 1])  # [digit]: the middle child's edge shared with that corner child
CORNER = np.array([2, 0, 1])  # [k - 1]: the corner child across the middle child's edge k


def neighbours(ids: np.ndarray, level: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The cell across each local edge k (opposite corner k), and that edge's number in the other cell.

    Corners run counterclockwise in every cell, so an edge runs one way in one of its cells and the other
    way in the other: halves of it meet crosswise.
    """
    if level == 0:
        f = ids - 1
        return [ACROSS[f, j] + 1 for j in range(3)], [PLACES[f, j, 2] + 1 for j in range(3)]
    parents, at, digit = _up(ids)
    far, far_k = (np.stack(x, axis=1)[at] for x in neighbours(parents, level - 1))
    first, middle, r = (ids - 1) & ~np.int64(3), digit == 3, np.arange(len(ids))
    d = np.where(middle, 0, digit)
    other, other_k = [], []
    for k in range(3):
        if k == 0:
            inner, inner_k = np.where(middle, first + CORNER[k] + 1, first + 4), np.where(middle, 1, MIDDLE[d])
            other.append(inner)
            other_k.append(inner_k)
            continue
        e = HALF_OF[d, k] - 1
        j = far_k[r, e] - 1
        there = np.where(d == (e + 1) % 3, j + 2, j + 1) % 3
        other.append(np.where(middle, first + CORNER[k] + 1, (far[r, e] - 1) * 4 + there + 1))
        other_k.append(np.where(middle, 1, AS_HALF[there, j]))
    return other, other_k


def stars(ids: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Every other cell at the corners of each cell: (n, 12) ascending, and which of them are not repeats.

    Around a corner lie five or six cells. Three steps one way and two the other reach all of them, over edges
    of cells at most two edges away.
    """
    held = ids
    for _ in range(2):
        held = np.unique(np.concatenate([held, *neighbours(held, level)[0]]))
    other, other_k = (np.stack(x, axis=1) for x in neighbours(held, level))

    def step(cell, corner, way):
        i, k = np.searchsorted(held, cell), (corner + way) % 3
        return other[i, k], (other_k[i, k] - 1 + way) % 3

    found = []
    for j in range(3):
        start = np.full(len(ids), j)
        one, at = step(ids, start, 1)
        two, at = step(one, at, 1)
        back = step(*step(ids, start, 2), 2)[0]
        # the first step back is the first step on from another corner
        found += [one, two, step(two, at, 1)[0], back]
    out = np.sort(np.stack(found, axis=1), axis=1)
    return out, np.concatenate([np.ones((len(out), 1), bool), out[:, 1:] != out[:, :-1]], axis=1)


RUN = 1 << 20  # cells of a task, at most, where there are more than cores


def _ids(spark: SparkSession, level: int) -> DataFrame:
    require(0 <= level <= MAX_LEVEL, "level", "grid", f"{level} is outside 0..{MAX_LEVEL}")
    n = cells.ncells(level)
    return spark.range(1, n + 1, numPartitions=max(spark.sparkContext.defaultParallelism, -(-n // RUN)))


def _generate(spark: SparkSession, level: int, schema: str, build) -> DataFrame:
    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield build(pdf["id"].to_numpy())

    return _ids(spark, level).mapInPandas(batches, schema)


CORNER_COLUMNS = [f"{p}{k}" for p in "abc" for k in "xyz"]
SHAPE_COLUMNS = ["mx", "my", "mz", "area", "lat", "lon"]


def _shapes(xyz: np.ndarray) -> list[np.ndarray]:
    """Circumcentre, area, latitude and longitude of triangles (n, 3, 3): `numeric`'s formulas on arrays.

    As columns they would hold each other several times over, and a filter on the last ones all of that again.
    """
    a, b, c = (tuple(xyz[:, i, j] for j in range(3)) for i in range(3))
    dot, plus, minus = numeric.dot, numeric.plus, numeric.minus
    n = numeric.cross(minus(b, a), minus(c, a))
    scale = np.where(dot(n, plus(plus(a, b), c)) < 0, -1.0, 1.0)
    n = tuple(x * scale for x in n)
    length = np.sqrt(dot(n, n))
    m = [x / length for x in n]
    area = 2.0 * np.arctan2(np.abs(dot(a, numeric.cross(b, c))), 1.0 + dot(a, b) + dot(b, c) + dot(c, a))
    return [*m, area, np.arctan2(m[2], np.hypot(m[0], m[1])), np.arctan2(m[1] + 0.0, m[0])]


def _cell_table(spark: SparkSession, level: int, project: bool, shapes: bool) -> DataFrame:
    def build(ids):
        face, tri = lattice_corners(ids, level)
        xyz = sphere_corners(ids, level, project)
        columns = zip(CORNER_COLUMNS, xyz.reshape(len(ids), 9).T)
        return pd.DataFrame({"cell": ids, **{f"v{k + 1}": vertex_keys(face, tri[:, k]) for k in range(3)}, **dict(columns),
                             **(dict(zip(SHAPE_COLUMNS, _shapes(xyz))) if shapes else {})})

    names = CORNER_COLUMNS + (SHAPE_COLUMNS if shapes else [])
    return _generate(spark, level, "cell bigint, v1 bigint, v2 bigint, v3 bigint, " + ", ".join(f"{n} double" for n in names), build)


def grid_corners(spark: SparkSession, level: int, project: bool = True) -> DataFrame:
    """cell, its three vertex keys v1..v3 and their unit vectors ax..cz, counterclockwise from outside."""
    return _cell_table(spark, level, project, False)


def grid_cells(spark: SparkSession, level: int, project: bool = True) -> DataFrame:
    """The cell table: vertex keys and vectors, circumcentre, area, latitude and longitude."""
    return _cell_table(spark, level, project, True)


def _triple(p: str):
    return tuple(F.col(p + k) for k in "xyz")


def grid_edges(spark: SparkSession, level: int, lengths: bool = False) -> DataFrame:
    """cell, k, neighbour, neighbour_k and one edge id shared by both sides; optionally the arc length."""

    def build(ids):
        other, other_k = neighbours(ids, level)
        parts = []
        xyz = sphere_corners(ids, level) if lengths else None
        for k in range(3):
            n, nk = other[k], other_k[k]
            low, low_k = np.minimum(ids, n), np.where(ids < n, k + 1, nk)
            part = {"cell": ids, "k": np.full(len(ids), k + 1), "neighbour": n, "neighbour_k": nk, "edge": low * 4 + low_k}
            if lengths:
                p, q = xyz[:, (k + 1) % 3], xyz[:, (k + 2) % 3]
                cross = np.cross(p, q)
                part["length"] = np.arctan2(np.sqrt((cross * cross).sum(axis=1)), (p * q).sum(axis=1))
            parts.append(pd.DataFrame(part))
        return pd.concat(parts, ignore_index=True)

    schema = "cell bigint, k int, neighbour bigint, neighbour_k int, edge bigint" + (", length double" if lengths else "")
    return _generate(spark, level, schema, build)


def vertex_neighbours(spark: SparkSession, level: int) -> DataFrame:
    """Every cell sharing a vertex, ascending: at most 12, found from the id alone, so nothing is shuffled."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column(0).to_numpy()
            found, kept = stars(ids, level)
            ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[kept]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["cell", "neighbours"])

    return _ids(spark, level).mapInArrow(batches, "cell bigint, neighbours array<bigint>")


def dual_areas(spark: SparkSession, level: int) -> DataFrame:
    """Area of each vertex's dual cell: the six pieces around every cell, added per vertex (two-sum)."""
    a, b, c, m = _triple("a"), _triple("b"), _triple("c"), _triple("m")
    ab, bc, ca = numeric.midpoint(a, b), numeric.midpoint(b, c), numeric.midpoint(c, a)
    area = numeric.triangle_area
    pieces = F.array(
        F.struct(F.col("v1").alias("vertex"), (area(a, ab, m) + area(a, m, ca)).alias("piece")),
        F.struct(F.col("v2").alias("vertex"), (area(b, bc, m) + area(b, m, ab)).alias("piece")),
        F.struct(F.col("v3").alias("vertex"), (area(c, ca, m) + area(c, m, bc)).alias("piece")),
    )
    rows = grid_cells(spark, level).select("cell", F.explode(pieces).alias("p")).select("cell", "p.*")
    start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"))

    def step(acc, s):
        hi = acc["hi"] + s["piece"]
        return F.struct(hi.alias("hi"), (acc["lo"] + numeric.two_sum_error(acc["hi"], s["piece"], hi)).alias("lo"))

    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("cell", "piece"))), start, step)  # valence is 5 or 6
    return rows.groupBy("vertex").agg(folded.alias("f")).select("vertex", (F.col("f.hi") + F.col("f.lo")).alias("dual_area"))


def area_closure(spark: SparkSession, level: int, radius: float = 1.0) -> DataFrame:
    """Total area by two formulas against the sphere's, relative."""
    a, b, c = _triple("a"), _triple("b"), _triple("c")
    r2 = radius * radius
    out = grid_corners(spark, level).agg(
        F.count(F.lit(1)).alias("cells"), F.sum(numeric.triangle_area(a, b, c) * r2).alias("area"),
        F.sum(numeric.triangle_area_by_sides(a, b, c) * r2).alias("area_by_sides"))
    sphere = 4.0 * np.pi * r2
    return out.select("cells", (F.abs(F.col("area") - sphere) / sphere).alias("gap"),
                      (F.abs(F.col("area_by_sides") - sphere) / sphere).alias("gap_by_sides"))


def stencil_gather(values: DataFrame, value: str, adjacency: DataFrame, weight: str | None = None) -> DataFrame:
    """Sum over a cell's neighbours of value * weight. A cell has at most twelve, so sums stay local."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    held = values.select(F.col("cell").alias("neighbour"), F.col(value).alias("_v"))
    return adjacency.join(held, "neighbour").groupBy("cell").agg(F.sum(F.col("_v") * w).alias(value))


# Refined meshes: a target depth per base cell


def refine_targets(distances: DataFrame, depth: int, ring_width: int) -> DataFrame:
    """max(0, depth - distance div ring_width) per base cell."""
    require(ring_width >= 1, "ring width", "refine_targets", "a step of two levels across one edge is forbidden")
    t = F.greatest(F.lit(0), F.lit(depth) - F.floor(F.col("distance") / ring_width)).cast("int")
    return distances.withColumn("target", t)


def leaves(targets: DataFrame, base_level: int) -> DataFrame:
    """Every leaf of the refined mesh: base cell, level and id at that level."""
    shift = F.call_function("shiftleft", F.col("cell") - 1, 2 * F.col("target"))
    count = F.call_function("shiftleft", F.lit(1).cast("bigint"), 2 * F.col("target"))
    return targets.select(F.col("cell").alias("base"), (F.lit(base_level) + F.col("target")).alias("level"),
                          F.explode(F.sequence(shift + 1, shift + count)).alias("leaf"))


def leaf_owner(targets: DataFrame, depth: int) -> DataFrame:
    """The leaf (at its own level) that owns each cell of the finest level."""
    fine = targets.select("cell", "target", F.explode(cells.descendants(F.col("cell"), depth)).alias("fine"))
    up = 2 * (F.lit(depth) - F.col("target"))
    return fine.select("fine", "target", (F.call_function("shiftright", F.col("fine") - 1, up) + 1).alias("leaf"))


def hanging_edges(targets: DataFrame, edges_by_target: dict[int, DataFrame]) -> DataFrame:
    """Leaf edges whose neighbour is refined further: level, cell, k and the leaf-level cell across.

    `edges_by_target[t]` is the edge table of the level t below the base; only leaves of that target read it.
    Where those are the levels of the grid, `level_hanging_edges` needs no edge table.
    """
    across = targets.select(F.col("cell").alias("_b"), F.col("target").alias("_t"))
    parts = None
    for t, edges in edges_by_target.items():
        placed = edges.select("cell", "k", "neighbour", "neighbour_k", cells.ancestor(F.col("cell"), t).alias("_a"),
                              cells.ancestor(F.col("neighbour"), t).alias("_b")).filter("_a <> _b")  # a cell has one target
        own = targets.filter(F.col("target") == t).select(F.col("cell").alias("_a"))
        part = placed.join(own, "_a").join(across.filter(F.col("_t") > t), "_b").select(
            F.lit(t).alias("target"), "cell", "k", "neighbour", "neighbour_k")
        parts = part if parts is None else parts.unionByName(part)
    return parts


# The children along an edge k and the edge of theirs that is half of it: [k - 1] gives two (digit, k).
HALVES = [[(d, j + 1) for d in range(3) for j in range(3) if HALF_OF[d, j] == k] for k in (1, 2, 3)]


def edge_parts(ids: np.ndarray, k: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2^depth cells `depth` levels down along an edge of each cell, and the edge of theirs on it."""
    for _ in range(depth):
        digit, part = (np.array([[h[i] for h in HALVES[e]] for e in range(3)])[k - 1] for i in (0, 1))
        ids, k = ((ids[:, None] - 1) * 4 + digit + 1).ravel(), part.ravel()
    return ids, k


def level_hanging_edges(targets: DataFrame, level: int) -> DataFrame:
    """`hanging_edges` of targets on the grid's own levels from `level` down, from the ids.

    Each refined cell names the three edges it is across; those whose cell has a lower target are split to that
    cell's leaves. One join on base cells, and no edge table of the finer levels.
    """
    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, target = pdf["cell"].to_numpy(), pdf["target"].to_numpy()
            other, other_k = neighbours(ids, level)
            yield pd.DataFrame({"cell": np.concatenate(other), "k": np.concatenate(other_k), "_t": np.tile(target, 3)})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in np.unique(pdf["target"].to_numpy()):
                some = pdf[pdf["target"] == t]
                ids, k = edge_parts(some["cell"].to_numpy(), some["k"].to_numpy(), t)
                other, other_k = (np.stack(x, axis=1)[np.arange(len(ids)), k - 1] for x in neighbours(ids, level + t))
                yield pd.DataFrame({"target": np.full(len(ids), t), "cell": ids, "k": k, "neighbour": other, "neighbour_k": other_k})

    rows = targets.select("cell", F.col("target").cast("int").alias("target"))
    met = rows.filter("target > 0").mapInPandas(across, "cell bigint, k int, _t int").join(rows, "cell").filter("_t > target")
    return met.select("cell", "k", "target").mapInPandas(split, "target int, cell bigint, k int, neighbour bigint, neighbour_k int")


def unbalanced(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Base edges across which the target steps by more than one level; none in a balanced mesh."""
    a = targets.select("cell", F.col("target").alias("_t"))
    b = targets.select(F.col("cell").alias("neighbour"), F.col("target").alias("_n"))
    return edges.join(a, "cell").join(b, "neighbour").filter(F.abs(F.col("_t") - F.col("_n")) > 1).select("cell", "neighbour")
