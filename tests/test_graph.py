"""Grid arithmetic and graph operators against small sequential twins."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import cells, numeric
from gridspark.operators import graph
from gridspark.sources import grid

LEVEL, DEPTH = 3, 2
N = cells.ncells(LEVEL)


def both_ways(spark, pairs):
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "cell bigint, neighbour bigint")


def lowest(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


SHAPES = {
    "path": [(i, i + 1) for i in range(1, 200)],
    "star": [(1000, i) for i in range(1, 300)],
    "zigzag": [(i, 400 - i) for i in range(1, 150)] + [(400 - i, i + 1) for i in range(1, 149)],
    "random": [(random.Random(3).randrange(1, 400) + 0 * i, random.Random(i).randrange(1, 400)) for i in range(250)],
    "none": [],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_components(spark, shape):
    pairs = SHAPES[shape]
    nodes = sorted({x for p in pairs for x in p} | {5000, 5001})
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "cell bigint"),
                           both_ways(spark, pairs) if pairs else spark.createDataFrame([], "cell bigint, neighbour bigint"))
    assert dict(got.select("cell", "label").collect()) == lowest(nodes, pairs)


@pytest.fixture(scope="module")
def mesh(spark):
    rows = grid.grid_edges(spark, LEVEL, lengths=True).collect()
    near, length = {}, {}
    for r in rows:
        near.setdefault(r["cell"], {})[r["k"]] = r["neighbour"]
        length[r["cell"], r["neighbour"]] = r["length"]
    return near, length


def test_mesh(spark, mesh):
    near, length = mesh
    assert len(near) == N and all(len(v) == 3 for v in near.values())
    assert all(c in near[n].values() for c, v in near.items() for n in v.values())
    assert all(math.isclose(length[a, b], length[b, a], rel_tol=1e-15) for a, b in length)
    star = grid.vertex_neighbours(spark, LEVEL).select(F.size("neighbours").alias("n")).groupBy("n").count()
    assert dict(star.collect()) == {12: N - 60, 11: 60}


def test_vertex_neighbours_come_from_ids_alone(spark):
    """The twin groups cells by vertex keys; nothing is shuffled, at a high level either."""
    out = grid.vertex_neighbours(spark, LEVEL)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for level in range(4):
        ids = np.arange(1, cells.ncells(level) + 1)
        face, tri = grid.lattice_corners(ids, level)
        keys = np.stack([grid.vertex_keys(face, tri[:, k]) for k in range(3)], axis=1).tolist()
        at = {}
        for c, ks in zip(ids.tolist(), keys):
            for k in ks:
                at.setdefault(k, set()).add(c)
        want = [sorted(set().union(*(at[k] for k in ks)) - {c}) for c, ks in zip(ids.tolist(), keys)]
        found, kept = grid.stars(ids, level)
        assert [f[k].tolist() for f, k in zip(found, kept)] == want
    assert [r.neighbours for r in out.orderBy("cell").collect()] == want
    some = np.array([1, 4**11, 7 * 4**11 + 12345])
    assert all(c in grid.stars(np.array([n]), 11)[0] for c, near in zip(some, grid.stars(some, 11)[0]) for n in near)


def test_geometry(spark):
    got = grid.grid_cells(spark, LEVEL).agg(F.sum("area"), F.min("area"), F.max("area")).first()
    assert math.isclose(got[0], 4 * math.pi, rel_tol=1e-12) and got[1] > 0
    dual = grid.dual_areas(spark, LEVEL).agg(F.count(F.lit(1)), F.sum("dual_area")).first()
    assert dual[0] == cells.nvertices(LEVEL) and math.isclose(dual[1], 4 * math.pi, rel_tol=1e-12)
    # a filter on the last columns does not work out the formulas again, once for each time they hold each other
    located = grid.grid_cells(spark, LEVEL).filter("area > 0 AND abs(lat) < 2 AND abs(lon) < 4")
    assert "ATAN2" not in located._jdf.queryExecution().executedPlan().toString().upper()
    a, b, c, m = (tuple(F.col(p + k) for k in "xyz") for p in "abcm")
    gap = lambda x, y: F.max(F.abs(x - y))
    gaps = located.agg(gap(F.col("area"), numeric.triangle_area(a, b, c)), gap(F.col("lat"), numeric.latitude(m)), gap(F.col("lon"), numeric.longitude(m)),
                       *[gap(x, y) for x, y in zip(m, numeric.circumcentre(a, b, c))]).first()
    assert max(gaps) < 1e-15
    # the control: midpoints left on the chord do not close the sphere
    chord = grid.grid_corners(spark, LEVEL, project=False).agg(F.max(F.abs(F.hypot(F.hypot("ax", "ay"), F.col("az")) - 1))).first()[0]
    assert chord > 1e-3


def terrain(spark, seed, step=1.0):
    rng = random.Random(seed)
    z = {c: rng.randrange(-500, 500) * step + c * 1e-5 for c in range(1, N + 1)}
    return z, spark.createDataFrame(list(z.items()), "cell bigint, z double")


def ocean_twin(z, near, seeds):
    out, queue = set(seeds), list(seeds)
    for c in queue:
        for n in near[c].values():
            if n not in out and z[n] < 0:
                out.add(n)
                queue.append(n)
    return out


def test_flood_and_drainage(spark, mesh):
    near, _ = mesh
    z, df = terrain(spark, 11)
    edges = grid.grid_edges(spark, LEVEL)
    seeds = [c for c in z if z[c] < -440]
    wet = ocean_twin(z, near, seeds)
    got = graph.flood_reach(df, edges, spark.createDataFrame([(s,) for s in seeds], "cell bigint"), 0.0, check=True)
    assert {r[0] for r in got.collect()} == wet
    # priority flood from the ocean and every closed basin
    low = {c for c in z if c not in wet and all(z[n] > z[c] for n in near[c].values())}
    terminal = {c: 0 for c in wet} | {c: c for c in low}
    heap = [(z[c], c) for c in terminal]
    heapq.heapify(heap)
    while heap:
        _, c = heapq.heappop(heap)
        for n in near[c].values():
            if n not in terminal:
                terminal[n] = terminal[c]
                heapq.heappush(heap, (z[n], n))
    out = graph.drainage_terminals(df, edges, got)
    assert dict(out.select("cell", "terminal").collect()) == terminal


def test_flats_reach_a_terminal(spark, mesh):
    rng = random.Random(5)
    df = spark.createDataFrame([(c, float(rng.randrange(4))) for c in range(1, N + 1)], "cell bigint, z double")
    none = spark.createDataFrame([], "cell bigint")
    out = graph.drainage_terminals(df, grid.grid_edges(spark, LEVEL), none)
    ends = {r[0] for r in graph.minimum_plateaus(df, grid.grid_edges(spark, LEVEL), none).select("plateau").collect()}
    assert out.count() == N and {r[0] for r in out.select("terminal").distinct().collect()} == ends


def test_bodies_and_gates(spark, mesh):
    near, length = mesh
    z, df = terrain(spark, 23)
    edges = grid.grid_edges(spark, LEVEL, lengths=True)
    wet = {c for c in z if z[c] < 150}
    mask = spark.createDataFrame([(c,) for c in wet], "cell bigint")
    up = lambda c: (c - 1) // 4**DEPTH + 1
    inside = [(a, b) for a, b in length if a < b and a in wet and b in wet and up(a) == up(b)]
    body = lowest(wet, inside)
    got = graph.bodies(mask, edges, DEPTH)
    assert dict(got.select("cell", "label").collect()) == body
    control = {c: (up(c) - 1) * 4**DEPTH + 1 for c in wet}  # one body a coarse cell, whatever its parts
    assert control != body
    gates = {(r["inner"], r["outer"]): r for r in graph.ocean_gates(df, got, edges, DEPTH).collect()}
    pairs = {(body[a], body[b]) for a, b in length if a in wet and b in wet and up(a) < up(b)}
    assert set(gates) == pairs
    for (p, q), r in gates.items():
        members = [c for c in wet if body[c] in (p, q)]
        s = min((c for c in members if body[c] == p), key=lambda c: (z[c], c))
        t = min((c for c in members if body[c] == q), key=lambda c: (z[c], c))
        best, heap = {s: z[s]}, [(z[s], s)]
        while heap:
            h, c = heapq.heappop(heap)
            for n in near[c].values():
                if n in members and max(h, z[n]) < best.get(n, math.inf):
                    best[n] = max(h, z[n])
                    heapq.heappush(heap, (best[n], n))
        assert r["sill"] == best[t]
        # heights differ, so the crest is one cell and the section is the cheaper side of it
        assert 0 < r["width"] <= sum(sorted(length.values())[-3:])
    land = graph.land_gates(got, edges, DEPTH).agg(F.sum("crossings")).first()[0]
    assert land == sum(1 for a, b in length if a in wet and b in wet and up(a) < up(b))


def test_min_cut_takes_the_cheap_side():
    side = graph._min_cut([1, 1, 2, 3], [2, 3, 4, 4], [1.0, 5.0, 5.0, 2.0], 1, 4)
    assert side == {1, 3}  # cut 1-2 (1) and 3-4 (2), not 1-3 or 2-4


def test_topology_edits(spark):
    """A strait between two basins closes, an island rises, and nothing else is an edit."""
    edges = grid.grid_edges(spark, LEVEL, lengths=True)
    near = {}
    for r in edges.select("cell", "neighbour").collect():
        near.setdefault(r[0], []).append(r[1])
    ring, seen, order = [N], {N}, []
    while ring:  # cells by distance from the last cell
        order.append(ring)
        ring = sorted({n for c in ring for n in near[c]} - seen)
        seen |= set(ring)
    wet = {c for r in order[:9] for c in r}
    z_old = {c: (-100.0 if c in wet else 500.0) - c * 1e-4 for c in range(1, N + 1)}
    island = order[2][0]
    z_new = dict(z_old) | {island: 20.0}
    parts = []
    for z in (z_old, z_new):
        df = spark.createDataFrame(list(z.items()), "cell bigint, z double")
        parts.append(graph.surface_graph(df, edges, spark.createDataFrame([(N,)], "cell bigint"), 0.0, DEPTH, terminals=False))
    got = graph.topology_edits(parts[0], parts[1], edges, 0.0, DEPTH).collect()
    assert [(r["cluster"], r["edit"]) for r in got] == [(island, "island_emerged")]
    assert got[0]["quantity"] == pytest.approx(-z_old[island])
    back = graph.topology_edits(parts[1], parts[0], edges, 0.0, DEPTH).collect()
    assert [r["edit"] for r in back] == ["island_submerged"]
    assert graph.topology_edits(parts[0], parts[0], edges, 0.0, DEPTH).isEmpty()


def test_rings_and_targets(spark, mesh):
    near, _ = mesh
    edges = grid.grid_edges(spark, LEVEL)
    got = dict(graph.ring_distance(edges, spark.createDataFrame([(5,), (700,)], "cell bigint")).collect())
    want, queue = {5: 0, 700: 0}, [5, 700]
    for c in queue:
        for n in near[c].values():
            if n not in want:
                want[n] = want[c] + 1
                queue.append(n)
    assert got == want
    targets = grid.refine_targets(spark.createDataFrame(list(want.items()), "cell bigint, distance int"), 3, 2).select("cell", "target")
    assert grid.unbalanced(targets, edges).isEmpty()
    steep = targets.withColumn("target", F.when(F.col("cell") == 5, 3).otherwise(0))
    assert not grid.unbalanced(steep, edges).isEmpty()
    hanging = grid.hanging_edges(targets, {0: edges, 1: grid.grid_edges(spark, LEVEL + 1), 2: grid.grid_edges(spark, LEVEL + 2)})
    t = dict(targets.collect())
    assert hanging.filter("target = 0").count() == sum(1 for c in t for n in near[c].values() if t[c] == 0 and t[n] > 0)
    # by ids alone: the same edges, and no table of edges is read
    by_ids = grid.level_hanging_edges(targets, LEVEL)
    assert sorted(map(tuple, by_ids.collect())) == sorted(map(tuple, hanging.collect())) and by_ids.filter("target = 2").count() > 0
    plan = by_ids._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    owner = grid.leaf_owner(targets, 3)
    assert owner.count() == N * 4**3 and grid.leaves(targets, LEVEL).count() == sum(4**v for v in t.values())


def test_leaves_are_counted_without_a_shuffle_of_them(spark, sf):
    import re

    from gridspark.plans import catalogue

    plan = catalogue.queries()["gra5_leaf_owner"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("leaf" in x for x in re.findall(r"hashpartitioning\((.*)", plan))


def test_lineage_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "source string, target string")
    assert dict(graph.lineage_levels(e).collect()) == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_body_moves(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (17, 17)], "cell bigint, label bigint")
    new = spark.createDataFrame([(1, 1), (3, 3), (17, 17)], "cell bigint, label bigint")
    gate = spark.createDataFrame([(1, 2, 1, 17)], "coarse_a bigint, coarse_b bigint, inner bigint, outer bigint")
    none = gate.filter("false")
    moves = {tuple(r) for r in graph.body_moves(old, new, gate, none, 2).select("side", "coarse").collect()}
    assert moves == {("lost", 1), ("lost", 2)}


def test_random_words_match_the_published_generator():
    from gridspark.functions.hashing import philox_words

    key = (123456789, 987654321)
    got = philox_words(key, [7, 8], [1, 2], [3, 4], [0, 0])
    for i, ctr in enumerate(([7, 1, 3, 0], [8, 2, 4, 0])):
        ctr[0] -= 1  # numpy steps its counter before drawing
        assert (np.random.Philox(key=list(key), counter=ctr).random_raw(4) == got[i]).all()


def hops_from(pairs, seeds):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    d, queue = dict.fromkeys(seeds, 0), list(seeds)
    for u in queue:
        for v in near.get(u, []):
            if v not in d:
                d[v] = d[u] + 1
                queue.append(v)
    return d


def test_distances_take_a_round_a_block(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(1, 10_000)]
    written = []
    keep = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(1) or keep(df))
    got = dict(graph.ring_distance(both_ways(spark, pairs), spark.createDataFrame([(1,)], "cell bigint")).collect())
    assert got == {i: i - 1 for i in range(1, 10_001)}
    assert len(written) < 40


def test_distances_on_random_graphs(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-1500, 3000), 300)
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(600)] + [(ids[0], ids[1])] * 2
    seeds = [ids[0], ids[5], 99_999]  # the last has no edge
    want = hops_from(pairs, seeds)
    edges = both_ways(spark, pairs).union(spark.createDataFrame([(None, 1), (1, None), (7, 7)], "cell bigint, neighbour bigint"))
    start = spark.createDataFrame([(s,) for s in [*seeds, seeds[0], None]], "cell bigint")
    assert dict(graph.ring_distance(edges, start).collect()) == want
    assert dict(graph.ring_distance(edges, start, 2).collect()) == {c: d for c, d in want.items() if d <= 2}


def test_a_flat_drains_through_its_only_outlet(spark):
    n = 3000
    pairs = [(i, i + 1) for i in range(1, n)]
    terrain = spark.createDataFrame([(i, 5.0) for i in range(2, n + 1)] + [(1, 1.0)], "cell bigint, z double")
    none = spark.createDataFrame([], "cell bigint")
    got = dict(graph.drainage_terminals(terrain, both_ways(spark, pairs), none).collect())
    assert got == dict.fromkeys(range(1, n + 1), 1)


def test_distance_rounds_broadcast_no_blocks(spark, monkeypatch):
    """A block's row is small in a file and large in memory: no round may send such tables through the driver."""
    plans = []
    written = graph.settled

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(graph, "settled", spied)
    edges = both_ways(spark, [(i, i + 1) for i in range(1, 3000)])
    got = dict(graph.ring_distance(edges, spark.createDataFrame([(1,)], "cell bigint")).collect())
    assert got == {i: i - 1 for i in range(1, 3001)}
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_components_within_match_the_twin(spark):
    rng = random.Random(11)
    ids = rng.sample(range(-3000, 6000), 900)
    pairs = [(a, a + rng.choice((1, 2, 5))) for a in ids] + [tuple(rng.sample(ids, 2)) for _ in range(250)]
    nodes = set(rng.sample(ids, 700))
    want = lowest(nodes, [p for p in pairs if p[0] in nodes and p[1] in nodes])
    table = spark.createDataFrame([(n,) for n in [*nodes, None]], "cell bigint")
    edges = both_ways(spark, pairs).union(spark.createDataFrame([(None, 1), (1, None), (7, 7)], "cell bigint, neighbour bigint"))
    assert dict(graph.components_within(table, edges).collect()) == want
    alone = [p for p in pairs if (p[0] - 1) // 1024 == (p[1] - 1) // 1024]
    want = lowest(nodes, [p for p in alone if p[0] in nodes and p[1] in nodes])
    assert dict(graph.components_within(table, both_ways(spark, alone), inside=True).collect()) == want


def test_bodies_take_no_rounds(spark, monkeypatch):
    """Bodies lie in a coarse cell, so one grouping finds them; each round used to write tables."""
    written = []
    keep = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(1) or keep(df))
    mask = spark.range(1, N + 1).select(F.col("id").alias("cell")).filter("cell % 7 <> 0")
    assert graph.bodies(mask, grid.grid_edges(spark, LEVEL), DEPTH).count() == mask.count()
    assert not written
    components = graph.components_within(mask, grid.grid_edges(spark, LEVEL))
    assert components.count() == mask.count() and len(written) < 12


def test_edits_need_no_sills(spark, sf, monkeypatch):
    """Edits ask which bodies touch: the same with and without measured gates, and no pair of bodies is cut in Python."""
    from gridspark.plans import catalogue

    edges = grid.grid_edges(spark, LEVEL, lengths=True)
    terrains = [terrain(spark, 41)[0], terrain(spark, 43)[0]]
    terrains[1] = {c: terrains[c % 3 == 0][c] for c in terrains[0]}
    found = []
    for measured in (True, False):
        parts = []
        for z in terrains:
            df = spark.createDataFrame(list(z.items()), "cell bigint, z double")
            given = edges if measured else edges.drop("length")
            parts.append(graph.surface_graph(df, given, df.filter("z < -440").select("cell"), 0.0, DEPTH, terminals=False, measured=measured))
        found.append((sorted(map(tuple, graph.topology_edits(parts[0], parts[1], edges, 0.0, DEPTH).collect())),
                      [sorted(map(tuple, p[n].select("coarse_a", "coarse_b", "inner", "outer").collect())) for p in parts for n in ("ocean_gates", "land_gates")]))
    assert found[0] == found[1] and len(found[0][0]) > 50

    def refuse(*_):
        raise AssertionError("sills are worked out")

    monkeypatch.setattr(graph, "ocean_gates", refuse)
    for name in ("gra11_topology_changes", "str8_emitted_events"):
        assert catalogue.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("level, depth, seed", [(LEVEL, 2, 51), (4, 2, 53), (6, 3, 57)])
def test_edits_by_blocks(spark, level, depth, seed):
    """The same edits as from tables of cells and edges."""
    from gridspark.operators import edits

    rng, n = np.random.default_rng(seed), cells.ncells(level)
    z = rng.integers(-500, 500, n) + np.arange(n) * 1e-5 - 60.0
    z_new = np.where(rng.random(n) < 0.12, z + rng.integers(-600, 600, n), z)
    blocks = -(-n // graph.SIDE)
    padded = np.full((2, blocks * graph.SIDE), -1000.0)  # what lies behind the last cell is not looked at
    padded[:, :n] = z, z_new
    rows = [(i, *(p[i * graph.SIDE : (i + 1) * graph.SIDE].astype(edits.ELEVATION).tobytes() for p in padded)) for i in range(blocks)]
    packed = spark.createDataFrame(rows, "block bigint, z_old binary, z_new binary")
    got = sorted(map(tuple, edits.block_edits(packed, level, -540.0, 0.0, depth).collect()))
    edges = grid.grid_edges(spark, level)
    parts = []
    for name, values in (("old", z), ("new", z_new)):
        df = spark.createDataFrame([(c + 1, v) for c, v in enumerate(values.tolist())], "cell bigint, z double")
        parts.append(graph.surface_graph(df, edges, df.filter("z < -540").select("cell"), 0.0, depth, terminals=False, measured=False))
    want = sorted(map(tuple, graph.topology_edits(*parts, edges, 0.0, depth).collect()))
    assert got == want and len({r[1] for r in want}) >= 3


def test_edits_write_no_table_of_edges(spark, sf, monkeypatch):
    from gridspark.plans import catalogue, grids

    def refuse(*_, **__):
        raise AssertionError("a table of edges is made")

    monkeypatch.setattr(grids.grid, "grid_edges", refuse)
    assert catalogue.queries()["gra11_topology_changes"](spark, sf).count() > 0
