"""Iterative operators on cell graphs, as joins whose rounds are written to the shared folder.

Edge tables hold both directions as (cell, neighbour). A component with a third of all nodes makes
hub keys in the label look-ups; every look-up joins against one row per key, which adaptive
execution splits, and every fold is a partial aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.contracts import require
from gridspark.functions import cells
from gridspark.operators.ordered import match
from gridspark.session import settled

MAX_ROUNDS = 64
BLOCK = 5  # levels of a block, the unit solved in one array pass: 1024 ids, so at most 1024^2 links inside it
SIDE = 4**BLOCK


def class_by_sign(z: Column, datum: float) -> Column:
    """The naive classifier, kept as a control: everything below the datum is ocean."""
    return F.when(z < datum, "ocean").otherwise("land")


def class_from_rules(ocean: Column, depth: Column) -> Column:
    return F.when(ocean, "ocean").when(depth > 0, "inland_water").otherwise("land")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among `nodes`."""
    keep = nodes.select("cell")
    far = keep.withColumnRenamed("cell", "neighbour")
    return edges.join(keep, "cell", "left_semi").join(far, "neighbour", "left_semi")


def _jump(p: DataFrame) -> DataFrame:
    """parent -> parent of parent."""
    up = p.select(F.col("cell").alias("parent"), F.col("parent").alias("_up"))
    return p.join(up, "parent", "left").select("cell", F.coalesce("_up", "parent").alias("parent"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell, label): the lowest id of the connected component of each node.

    Contraction: each round every node hooks to its lowest neighbour in a hashed order (which keeps
    chains short whatever the ids look like), parents are jumped, and the edges between parents,
    de-duplicated, go on to the next round. The number of nodes left at least halves, so rounds
    grow with the logarithm of the largest component and the data shrinks every round.
    """
    left = settled(edges.select("cell", "neighbour").filter("cell <> neighbour"))
    maps = []
    for _ in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        best = left.groupBy("cell").agg(F.min(rank("neighbour")).alias("_m"))
        hook = F.when(F.col("_m") < rank("cell"), F.col("_m.id")).otherwise(F.col("cell"))
        parents = settled(_jump(_jump(best.select("cell", hook.alias("parent")))))
        maps.append(parents)
        far = parents.select(F.col("cell").alias("neighbour"), F.col("parent").alias("_q"))
        left = settled(
            left.join(parents, "cell").join(far, "neighbour").filter("parent <> _q")
            .select(F.col("parent").alias("cell"), F.col("_q").alias("neighbour")).distinct())
    else:
        require(left.isEmpty(), "rounds", "components", f"not settled after {MAX_ROUNDS} rounds")
    root = None
    for p in reversed(maps):
        if root is None:
            root = p
        else:
            up = root.select(F.col("cell").alias("parent"), F.col("parent").alias("_up"))
            root = settled(p.join(up, "parent", "left").select("cell", F.coalesce("_up", "parent").alias("parent")))
    if root is None:
        return nodes.select("cell", F.col("cell").alias("label"))
    placed = nodes.select("cell").join(root, "cell", "left").select("cell", F.coalesce("parent", "cell").alias("_root"))
    lowest = placed.groupBy("_root").agg(F.min("cell").alias("label"))
    return placed.join(lowest, "_root").select("cell", "label")


_NODE, _BORDER = 1024, 1025  # marks of a cell among the links of a block: it is a node, it has a link out of the block


def lowest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lowest place each of `n` places is linked with, by links from `a` to `b`."""
    low = np.arange(n)
    while len(a):
        p, q = low[a], low[b]
        open_ = p != q
        a, b, p, q = a[open_], b[open_], p[open_], q[open_]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    return low


def _solve_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components inside blocks, 256 blocks at once: the lowest cell of each node's, and whether the node has links outside."""
    for rows in (batch[i : i + 256] for batch in batches for i in range(0, len(batch), 256)):
        sizes = rows["links"].map(len).to_numpy()
        codes = np.concatenate(rows["links"].to_list()).astype("int64")
        offset = np.repeat(np.arange(len(rows)), sizes) * SIDE
        a, b = offset + codes // 2048, codes % 2048
        node, border = (np.zeros(len(rows) * SIDE, bool) for _ in range(2))
        node[a[b == _NODE]] = True
        border[a[b == _BORDER]] = True
        inner = b < _NODE
        a, b = a[inner], (offset + b)[inner]
        kept = node[a] & node[b]
        low = lowest_linked(len(node), a[kept], b[kept])
        at = np.flatnonzero(node)
        first = rows["block"].to_numpy() * SIDE + 1
        cell = lambda i: first[i // SIDE] + i % SIDE
        yield pd.DataFrame({"cell": cell(at), "parent": cell(low[at]), "border": border[at]})


def components_within(nodes: DataFrame, edges: DataFrame, inside: bool = False) -> DataFrame:
    """(cell, label): `components` of the nodes, over the edges that have both ends among them.

    Ids are cut into blocks of 1024, which on the grid are coarse cells, and solved there in one array pass: one shuffle of
    two short numbers a link. Only links between blocks, between the parts they join, go through rounds of joins. `inside` says
    that no edge leaves its block. Ids without locality are right as well, and then take the rounds of `components`. A null id is no node.
    """
    here, there = F.col("cell"), F.col("neighbour")
    links = edges.select("cell", "neighbour").filter("cell IS NOT NULL AND neighbour IS NOT NULL AND cell <> neighbour")
    same, left = _block(here) == _block(there), None
    code = lambda c, mark: (_local(c) * 2048 + mark).cast("int").alias("code")
    rows = nodes.filter("cell IS NOT NULL").select(_block(here).alias("block"), code(here, F.lit(_NODE))).unionByName(
        links.filter(same).select(_block(here).alias("block"), code(here, _local(there))))
    if not inside:
        left = settled(links.filter(~same))
        for end in (here, there):
            rows = rows.unionByName(left.select(_block(end).alias("block"), code(end, F.lit(_BORDER))))
    # a set is bounded: the distinct pairs of the ids of one block
    packed = rows.groupBy("block").agg(F.collect_set("code").alias("links"))
    solved = packed.mapInPandas(_solve_blocks, "cell bigint, parent bigint, border boolean")
    if inside:
        return solved.select("cell", F.col("parent").alias("label"))
    solved = settled(solved)
    ends = solved.filter("border").select("cell", "parent")
    far = ends.select(F.col("cell").alias("neighbour"), F.col("parent").alias("_q"))
    joins = left.join(ends, "cell").join(far, "neighbour").filter("parent <> _q").select(
        F.col("parent").alias("cell"), F.col("_q").alias("neighbour")).distinct()
    joins = settled(joins)
    if joins.isEmpty():
        return solved.select("cell", F.col("parent").alias("label"))
    parts = joins.select("cell").union(joins.select("neighbour")).distinct()
    merged = settled(components(parts, joins)).select(F.col("cell").alias("parent"), "label")
    return solved.join(merged, "parent", "left").select("cell", F.coalesce("label", "parent").alias("label"))


def flood_reach(terrain: DataFrame, edges: DataFrame, seeds: DataFrame, datum: float, z: str = "z",
                check: bool = False) -> DataFrame:
    """Cells below the datum joined to a seed through cells below it: the components that hold a seed."""
    below = terrain.filter(F.col(z) < datum).select("cell")
    if check:
        stray = seeds.join(below, "cell", "left_anti")
        require(stray.isEmpty(), "ocean seed", "flood_reach", "a seed does not lie below the datum")
    label = settled(components_within(below, edges))
    reached = label.join(seeds.select("cell"), "cell", "left_semi").select("label").distinct()
    return label.join(reached, "label", "left_semi").select("cell")


def bodies(mask: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Components of the mask that may not cross a coarse cell, labelled by lowest id."""
    same = cells.ancestor(F.col("cell"), depth) == cells.ancestor(F.col("neighbour"), depth)
    return components_within(mask, edges.filter(same), inside=depth <= BLOCK)


FAR = 2**31 - 1  # the distance of a cell not reached


def _relax(a: np.ndarray, b: np.ndarray, held: np.ndarray, at: np.ndarray, given: np.ndarray, farthest: int) -> np.ndarray:
    """Distances inside one block after some cells got lower ones: whole levels at a time, lowest first."""
    d = held.copy()
    np.minimum.at(d, at, given)
    waiting = d < held
    while waiting.any():
        level = d[waiting].min()
        front = waiting & (d == level)
        waiting &= ~front
        if level >= farthest:
            break
        reach = b[front[a]]
        reach = reach[d[reach] > level + 1]
        d[reach] = level + 1
        waiting[reach] = True
    return d


def _relax_blocks(farthest: int):
    def numbers(x) -> np.ndarray:
        return np.zeros(0, "int32") if x is None else np.asarray(x, "int32")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            held, moved = [], []
            for r in rows.itertuples(index=False):
                old = np.full(SIDE, FAR, "int32") if r.held is None else np.asarray(r.held, "int32")
                new = _relax(numbers(r.a), numbers(r.b), old, numbers(r.at), numbers(r.given), farthest)
                held.append(new)
                moved.append(np.flatnonzero(new < old).astype("int32"))
            yield pd.DataFrame({"block": rows["block"], "held": held, "moved": moved})

    return solve


def _block(c: Column) -> Column:
    return F.shiftright(c - 1, 2 * BLOCK)


def _local(c: Column) -> Column:
    return (c - 1).bitwiseAND(F.lit(SIDE - 1)).cast("int")


def ring_distance(edges: DataFrame, seeds: DataFrame, farthest: int | None = None) -> DataFrame:
    """(cell, distance): hops from the nearest seed, up to `farthest` when one is enough.

    Ids are cut into blocks of 1024, which on the grid are coarse cells. A round solves every block that
    got a lower distance in one array pass and sends only the lowered distances of its border on, so rounds
    follow blocks crossed, not cells. A block is one row of 1024 distances; blocks nothing reached are not
    solved. Ids without locality are right as well, at up to a round a hop. Null ids are no cells.
    """
    seeds = settled(seeds.select("cell").filter("cell IS NOT NULL").distinct())
    require(not seeds.isEmpty(), "seeds", "ring_distance", "no seed cell was given")
    here, there = F.col("cell"), F.col("neighbour")
    links = edges.select("cell", "neighbour").filter("cell IS NOT NULL AND neighbour IS NOT NULL AND cell <> neighbour")
    # a set is bounded: the distinct pairs of the ids of one block
    # block rows pack far smaller in a file than in memory, so their joins are told not to broadcast them by file size
    code = (_local(here) * SIDE + _local(there)).cast("int").alias("code")
    inner = settled(
        links.filter(_block(here) == _block(there)).select(_block(here).alias("block"), code).groupBy("block").agg(F.collect_set("code").alias("_l"))
        .select("block", F.transform("_l", lambda x: F.shiftright(x, 2 * BLOCK).cast("smallint")).alias("a"),
                F.transform("_l", lambda x: (x % SIDE).cast("smallint")).alias("b")))
    border = settled(links.filter(_block(here) != _block(there)))
    limit = FAR - 1 if farthest is None else farthest
    lowered, state = seeds.withColumn("distance", F.lit(0)), None
    while True:
        # one row per cell first, so a block collects at most 1024 of them
        least = lowered.groupBy("cell").agg(F.min("distance").alias("distance"))
        given = least.groupBy(_block(here).alias("block")).agg(F.collect_list(F.struct(_local(here).alias("at"), F.col("distance").alias("given"))).alias("_g"))
        given = given.select("block", F.col("_g.at").alias("at"), F.col("_g.given").alias("given")).join(inner.hint("merge"), "block", "left")
        none = F.lit(None).cast("array<int>")
        work = given.withColumn("held", none) if state is None else given.join(state.hint("merge"), "block", "left")
        solved = settled(work.select("block", "a", "b", "at", "given", "held").mapInPandas(
            _relax_blocks(limit), "block bigint, held array<int>, moved array<int>").filter(F.size("moved") > 0))
        if solved.isEmpty():
            break
        fresh = solved.select("block", "held")
        state = fresh if state is None else settled(state.join(solved.select("block").hint("merge"), "block", "left_anti").unionByName(fresh))
        out = solved.select("block", "held", F.explode("moved").alias("_i")).select(
            (F.shiftleft("block", 2 * BLOCK) + F.col("_i") + 1).alias("cell"), F.get("held", F.col("_i")).alias("_d"))
        lowered = out.filter(F.col("_d") < limit).join(border.hint("merge"), "cell").select(there.alias("cell"), (F.col("_d") + 1).alias("distance"))
    every = state.select("block", F.posexplode("held").alias("_i", "distance")).filter(F.col("distance") < FAR)
    return every.select((F.shiftleft("block", 2 * BLOCK) + F.col("_i") + 1).alias("cell"), "distance")


def elevated_edges(terrain: DataFrame, edges: DataFrame, z: str = "z") -> DataFrame:
    """Edges with the elevation of both ends."""
    a = terrain.select("cell", F.col(z).alias("z_here"))
    b = terrain.select(F.col("cell").alias("neighbour"), F.col(z).alias("z_there"))
    return edges.select("cell", "neighbour").join(a, "cell").join(b, "neighbour")


def minimum_plateaus(terrain: DataFrame, edges: DataFrame, ocean: DataFrame, z: str = "z") -> DataFrame:
    """(cell, plateau): connected equal-elevation land cells none of which has a lower neighbour."""
    land = terrain.join(ocean.select("cell"), "cell", "left_anti").select("cell")
    return _plateaus(land, elevated_edges(terrain, edges, z))


def _plateaus(land: DataFrame, both: DataFrame) -> DataFrame:
    lower = both.filter("z_there < z_here").select("cell").distinct()
    label = settled(components_within(land, both.filter("z_there = z_here")))
    drained = label.join(lower, "cell", "left_semi").select("label").distinct()
    return label.join(drained, "label", "left_anti").select("cell", F.col("label").alias("plateau"))


OCEAN_TERMINAL = 0  # the terminal of a cell that drains to the ocean


def drainage_terminals(terrain: DataFrame, edges: DataFrame, ocean: DataFrame, z: str = "z") -> DataFrame:
    """(cell, terminal): OCEAN_TERMINAL, or the lowest id of the closed basin each cell drains to.

    A cell points at its lowest neighbour; on a flat without one, at the neighbour fewest hops from
    a cell that has one. Ties go to the lower id. Pointers are then doubled; a cell that has found its
    terminal is written once and moves no more.
    """
    both = settled(elevated_edges(terrain, edges, z))
    wet = ocean.select("cell")
    land = terrain.select("cell").join(wet, "cell", "left_anti")
    plateau = _plateaus(land, both)
    ends = settled(wet.select("cell", F.lit(OCEAN_TERMINAL).cast("bigint").alias("terminal")).unionByName(
        plateau.select("cell", F.col("plateau").alias("terminal"))))
    moving = terrain.select("cell").join(ends, "cell", "left_anti")
    downhill = settled(
        both.filter("z_there < z_here").join(moving, "cell", "left_semi")
        .groupBy("cell").agg(F.min(F.struct(F.col("z_there"), F.col("neighbour"))).alias("_m"))
        .select("cell", F.col("_m.neighbour").alias("next")))
    still = downhill
    stuck = moving.join(downhill, "cell", "left_anti")
    if not stuck.isEmpty():
        flat = both.filter("z_there = z_here").join(moving, "cell", "left_semi")
        hops = settled(ring_distance(within(flat, moving), downhill.select("cell")))
        far = hops.select(F.col("cell").alias("neighbour"), F.col("distance").alias("_d"))
        own = stuck.join(hops, "cell")
        inward = flat.join(own, "cell").join(far, "neighbour").filter("_d < distance")
        still = settled(downhill.unionByName(
            inward.groupBy("cell").agg(F.min(F.struct("_d", "neighbour")).alias("_m")).select("cell", F.col("_m.neighbour").alias("next"))))
    found = ends
    for _ in range(MAX_ROUNDS):
        # what a pointer meets: a terminal, or the pointer of a cell that moves still
        met = still.select(F.col("cell").alias("next"), F.col("next").alias("_up"), F.lit(None).cast("bigint").alias("terminal")).unionByName(
            found.select(F.col("cell").alias("next"), F.lit(None).cast("bigint").alias("_up"), "terminal"))
        doubled = settled(still.join(met, "next").select("cell", F.col("_up").alias("next"), "terminal"))
        found = found.unionByName(doubled.filter("terminal IS NOT NULL").select("cell", "terminal"))
        still = doubled.filter("terminal IS NULL").select("cell", "next")
        if still.isEmpty():
            return found
    require(False, "rounds", "drainage_terminals", f"not settled after {MAX_ROUNDS} rounds")


def crossings(body: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Fine edges lying on a coarse edge with the body on each side, once each.

    A coarse edge is named by its two cells in ascending order; `inner` is the body on the lower one.
    """
    here = body.select("cell", F.col("label").alias("inner"))
    there = body.select(F.col("cell").alias("neighbour"), F.col("label").alias("outer"))
    placed = edges.withColumns({"coarse_a": cells.ancestor(F.col("cell"), depth), "coarse_b": cells.ancestor(F.col("neighbour"), depth)})
    return placed.filter("coarse_a < coarse_b").join(here, "cell").join(there, "neighbour")


def touching(body: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The pairs of bodies that meet across a coarse edge: the keys of their gates, without width or sill."""
    return crossings(body, edges, depth).select("coarse_a", "coarse_b", "inner", "outer").distinct()


def land_gates(body: DataFrame, edges: DataFrame, depth: int, radius: float = 1.0) -> DataFrame:
    """Width and number of the fine edges joining each pair of bodies across a coarse edge."""
    found = crossings(body, edges, depth)
    return found.groupBy("coarse_a", "coarse_b", "inner", "outer").agg(
        (F.sum("length") * radius).alias("width"), F.count(F.lit(1)).alias("crossings"))


def source_cells(terrain: DataFrame, body: DataFrame, z: str = "z") -> DataFrame:
    """The lowest cell of each body, the lowest id among equals."""
    joined = body.join(terrain.select("cell", z), "cell")
    return joined.groupBy("label").agg(F.min_by("cell", F.struct(F.col(z), F.col("cell"))).alias("source"))


def bodies_of(body: DataFrame, depth: int) -> DataFrame:
    """Distinct body labels under each coarse cell, ascending; at most 4^depth of them."""
    pairs = body.select(cells.ancestor(F.col("cell"), depth).alias("coarse"), "label").distinct()
    return pairs.groupBy("coarse").agg(F.sort_array(F.collect_list("label")).alias("labels"))


def _root(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _saddle(a, b, h, source, sink):
    """The lowest level at which joining edges in order of height connects source to sink."""
    order = h.argsort(kind="stable")
    parent = {source: source, sink: sink}
    for i in order:
        for x in (a[i], b[i]):
            parent.setdefault(x, x)
        parent[_root(parent, a[i])] = _root(parent, b[i])
        if _root(parent, source) == _root(parent, sink):
            return h[i]
    return None


def _min_cut(a, b, capacity, s, t):
    """Nodes on the source side of a minimum cut of an undirected graph, by shortest augmenting paths."""
    room: dict = {}
    for x, y, c in zip(a, b, capacity):
        room.setdefault(x, {}).setdefault(y, 0.0)
        room.setdefault(y, {}).setdefault(x, 0.0)
        room[x][y] += c
        room[y][x] += c
    while True:
        back, queue = {s: s}, [s]
        for u in queue:
            for v, c in room.get(u, {}).items():
                if c > 0 and v not in back:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            return set(back)
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        push = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= push
            room[v][u] += push


GATE_SCHEMA = ("coarse_a bigint, coarse_b bigint, inner bigint, outer bigint, sill double, width double, section array<bigint>")


def _gate(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pair of bodies: the sill between their lowest cells and the cheapest section at its height."""
    first = pdf.iloc[0]
    a, b, h = pdf["cell"].to_numpy(), pdf["neighbour"].to_numpy(), pdf["height"].to_numpy()
    source, sink = first["source"], first["sink"]
    level = _saddle(a, b, h, source, sink)
    keys = {k: first[k] for k in ("coarse_a", "coarse_b", "inner", "outer")}
    if level is None:
        return pd.DataFrame([], columns=[*keys, "sill", "width", "section"])
    parent: dict = {}
    for x, y, v in zip(a, b, h):
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        if v < level:
            parent[_root(parent, x)] = _root(parent, y)
    cut = h == level
    ends = [(_root(parent, x), _root(parent, y)) for x, y in zip(a[cut], b[cut])]
    side = _min_cut([e[0] for e in ends], [e[1] for e in ends], pdf["length"].to_numpy()[cut],
                    _root(parent, source), _root(parent, sink))
    across = [(x in side) != (y in side) for x, y in ends]
    section = sorted(int(e) for e, on in zip(pdf["edge"].to_numpy()[cut], across) if on)
    width = float(sum(w for w, on in zip(pdf["length"].to_numpy()[cut], across) if on))
    return pd.DataFrame([{**keys, "sill": float(level), "width": width, "section": section}])


def ocean_gates(terrain: DataFrame, body: DataFrame, edges: DataFrame, depth: int, z: str = "z", radius: float = 1.0) -> DataFrame:
    """Sill height, width and section of every pair of bodies touching across a coarse edge.

    A body lies inside one coarse cell, so a pair holds at most 2 * 4^depth cells and 3 * 4^depth
    edges whatever the size of the ocean: that bound is what makes one group per pair safe.
    """
    require(depth <= 6, "depth", "ocean_gates", "a pair would hold more than 8192 cells")
    pairs = touching(body, edges, depth)
    source = source_cells(terrain, body, z)
    ends = pairs.join(source.select(F.col("label").alias("inner"), "source"), "inner").join(
        source.select(F.col("label").alias("outer"), F.col("source").alias("sink")), "outer")
    here = body.select("cell", F.col("label").alias("_a"))
    there = body.select(F.col("cell").alias("neighbour"), F.col("label").alias("_b"))
    za = terrain.select("cell", F.col(z).alias("_za"))
    zb = terrain.select(F.col("cell").alias("neighbour"), F.col(z).alias("_zb"))
    links = (
        edges.filter("cell < neighbour").join(here, "cell").join(there, "neighbour").join(za, "cell").join(zb, "neighbour")
        .select("cell", "neighbour", "edge", (F.col("length") * radius).alias("length"), F.greatest("_za", "_zb").alias("height"), "_a", "_b"))
    # edges inside a body serve every pair of that body; edges between two bodies serve their own pair
    owner = ends.select("*", F.explode(F.array("inner", "outer")).alias("_a"))
    inner = links.filter("_a = _b").join(owner, "_a")
    cross = links.filter("_a <> _b").withColumns({"inner": F.col("_a"), "outer": F.col("_b")})
    flipped = links.filter("_a <> _b").withColumns({"inner": F.col("_b"), "outer": F.col("_a")})
    between = cross.unionByName(flipped).join(ends, ["inner", "outer"])
    names = ["coarse_a", "coarse_b", "inner", "outer", "source", "sink", "cell", "neighbour", "edge", "length", "height"]
    rows = inner.select(*names).unionByName(between.select(*names))
    return rows.groupBy("coarse_a", "coarse_b", "inner", "outer").applyInPandas(_gate, GATE_SCHEMA)


def sills(gates: DataFrame, datum: float) -> DataFrame:
    return gates.select("coarse_a", "coarse_b", "inner", "outer", (F.lit(datum) - F.col("sill")).alias("sill_depth"))


# Differences between two snapshots


def correspondence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of bodies that share a cell."""
    return (old.select("cell", F.col("label").alias("old")).join(new.select("cell", F.col("label").alias("new")), "cell")
            .select("old", "new").distinct())


def _moved(body: DataFrame, corr: DataFrame, side: str, depth: int) -> DataFrame:
    """Coarse cells of bodies with no image or several."""
    images = corr.groupBy(F.col(side).alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    counted = body.select("label").distinct().join(images, "label", "left")
    return counted.filter(F.coalesce("_n", F.lit(0)) != 1).select(cells.ancestor(F.col("label"), depth).alias("coarse"))


def _unmatched(gates: DataFrame, others: DataFrame, corr: DataFrame, side: str, image: str) -> DataFrame:
    """Coarse cells of gates with no gate on the same edge between images of their bodies."""
    near = corr.select(F.col(side).alias("inner"), F.col(image).alias("_i"))
    far = corr.select(F.col(side).alias("outer"), F.col(image).alias("_o"))
    seen = others.select("coarse_a", "coarse_b", F.col("inner").alias("_i"), F.col("outer").alias("_o"))
    keys = ["coarse_a", "coarse_b", "inner", "outer"]
    kept = gates.select(*keys).join(near, "inner").join(far, "outer").join(seen, ["coarse_a", "coarse_b", "_i", "_o"], "left_semi")
    lost = gates.select(*keys).join(kept.select(*keys).distinct(), keys, "left_anti")
    return lost.select(F.explode(F.array("coarse_a", "coarse_b")).alias("coarse"))


def body_moves(old: DataFrame, new: DataFrame, old_gates: DataFrame, new_gates: DataFrame, depth: int) -> DataFrame:
    """(coarse, side): cells where bodies split, merged, vanished or lost a gate ('lost'), or the reverse ('gained')."""
    corr = settled(correspondence(old, new))
    lost = _moved(old, corr, "old", depth).unionByName(_unmatched(old_gates, new_gates, corr, "old", "new"))
    gained = _moved(new, corr, "new", depth).unionByName(_unmatched(new_gates, old_gates, corr, "new", "old"))
    return lost.distinct().withColumn("side", F.lit("lost")).unionByName(gained.distinct().withColumn("side", F.lit("gained")))


def basin_captures(old: DataFrame, new: DataFrame, area: DataFrame, new_ocean: DataFrame, depth: int) -> DataFrame:
    """Basins whose terminal changed: captor, and the area of their catchment that now drains to it."""
    basin = old.filter("cell = terminal").select(F.col("cell").alias("basin")).join(
        new_ocean.select(F.col("cell").alias("basin")), "basin", "left_anti")
    captor = basin.join(new.select(F.col("cell").alias("basin"), F.col("terminal").alias("captor")), "basin")
    before = old.select(F.col("cell").alias("captor"), F.col("terminal").alias("_was"))
    moved = captor.join(before, "captor", "left").filter("captor = 0 OR _was IS NULL OR _was <> basin").select("basin", "captor")
    drained = old.select("cell", F.col("terminal").alias("basin")).join(
        new.select("cell", F.col("terminal").alias("captor")), "cell").join(area.select("cell", "area"), "cell")
    taken = drained.groupBy("basin", "captor").agg(F.sum("area").alias("quantity"))
    out = match(moved, taken, ["basin", "captor"], "left")
    held = F.when(F.col("captor") == 0, F.array(cells.ancestor(F.col("basin"), depth))).otherwise(
        F.array_sort(F.array_distinct(F.array(cells.ancestor(F.col("basin"), depth), cells.ancestor(F.col("captor"), depth)))))
    return out.select("basin", "captor", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), held.alias("cells"))


def topology_edits(old: dict[str, DataFrame], new: dict[str, DataFrame], edges: DataFrame, datum: float, depth: int) -> DataFrame:
    """Clusters of cells that changed between ocean and not, named as edits, with the greatest water column.

    Each snapshot holds `terrain`, `ocean`, `land_component`, `ocean_body`, `land_body`, `ocean_gates`
    and `land_gates`. A cluster that touches one land component, encloses nothing below the datum and
    moves no body is no edit.
    """
    flags = (
        old["terrain"].select("cell", F.col("z").alias("z_old")).join(new["terrain"].select("cell", F.col("z").alias("z_new")), "cell")
        .join(old["ocean"].select("cell", F.lit(True).alias("was")), "cell", "left")
        .join(new["ocean"].select("cell", F.lit(True).alias("now")), "cell", "left").fillna(False, ["was", "now"]))
    flags = settled(flags)
    changed = flags.filter("was <> now")
    other = flags.select(F.col("cell").alias("neighbour"), F.col("was").alias("_w"), F.col("now").alias("_n"))
    met = settled(edges.select("cell", "neighbour").join(changed.select("cell", "was", "now"), "cell").join(other, "neighbour"))
    cluster = settled(components(changed, met.filter("was = _w AND now = _n")))
    # land components beside a cluster, of the snapshot in which it is wet
    beside = met.filter("NOT _w AND NOT _n").select("cell", "neighbour", "was")
    wet_old = old["land_component"].select(F.col("cell").alias("neighbour"), F.col("label").alias("_lo"))
    wet_new = new["land_component"].select(F.col("cell").alias("neighbour"), F.col("label").alias("_ln"))
    named = beside.join(wet_old, "neighbour", "left").join(wet_new, "neighbour", "left").select(
        "cell", F.when(F.col("was"), F.col("_lo")).otherwise(F.col("_ln")).alias("land"))
    lands = named.join(cluster, "cell").select("label", "land").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("lands"))
    moves_o = body_moves(old["ocean_body"], new["ocean_body"], old["ocean_gates"], new["ocean_gates"], depth)
    moves_l = body_moves(old["land_body"], new["land_body"], old["land_gates"], new["land_gates"], depth)
    closing = moves_o.filter("side = 'lost'").unionByName(moves_l.filter("side = 'gained'")).select("coarse", F.lit(True).alias("closing"))
    flooding = moves_o.filter("side = 'gained'").unionByName(moves_l.filter("side = 'lost'")).select("coarse", F.lit(False).alias("closing"))
    moves = settled(closing.unionByName(flooding).distinct())
    members = settled(cluster.join(changed, "cell").withColumn("coarse", cells.ancestor(F.col("cell"), depth)))
    moved = members.join(moves, (members.coarse == moves.coarse) & (members.was == moves.closing), "left_semi").select("label").distinct()
    was = F.col("was")
    heights = members.select("label", "was", F.when(was, F.col("z_old")).otherwise(F.col("z_new")).alias("wet_z"),
                             F.when(was, F.col("z_new")).otherwise(F.col("z_old")).alias("dry_z"))
    return name_edits(heights, lands, moved, datum)


def name_edits(members: DataFrame, lands: DataFrame, moved: DataFrame, datum: float) -> DataFrame:
    """Edits of clusters: `members` are their cells (label, was, wet_z, dry_z), `lands` the number of land components beside each,
    `moved` the labels of those that move a body."""
    water = F.lit(datum) - F.col("wet_z")
    risen = F.lit(datum) - F.col("dry_z")
    summary = members.groupBy("label", "was").agg(
        F.max((risen > 0).cast("int")).alias("enclosed"), F.max(F.when(risen <= 0, water)).alias("quantity"), F.count(F.lit(1)).alias("cells"))
    out = summary.join(lands, "label", "left").join(moved.withColumn("moved", F.lit(1)), "label", "left").fillna(0, ["lands", "moved"])
    edit = (
        F.when(F.col("was"), F.when(F.col("lands") == 0, "island_emerged").otherwise("seaway_closed"))
        .otherwise(F.when(F.col("lands") == 0, "island_submerged").otherwise("land_bridge_flooded")))
    kept = out.filter(~((F.col("lands") == 1) & (F.col("enclosed") == 0) & (F.col("moved") == 0)))
    return kept.select(F.col("label").alias("cluster"), edit.alias("edit"), "quantity", "cells")


def surface_graph(terrain: DataFrame, edges: DataFrame, seeds: DataFrame, datum: float, depth: int,
                  terminals: bool = True, measured: bool = True) -> dict[str, DataFrame]:
    """Everything derived from one elevation snapshot, each part written once: ocean, land components,
    bodies, gates and drainage terminals.

    `terrain` and `edges` are read once a part, so hand them over written. `edges` carries `edge` and `length`, but not where
    `measured` is off: gates are then the pairs of bodies that meet, which is all that `topology_edits` asks.
    """
    ocean = settled(flood_reach(terrain, edges, seeds, datum, check=True))
    land = settled(terrain.select("cell").join(ocean, "cell", "left_anti"))
    ocean_body, land_body = settled(bodies(ocean, edges, depth)), settled(bodies(land, edges, depth))
    out = {
        "terrain": terrain, "ocean": ocean,
        "land_component": settled(components_within(land, edges)),
        "ocean_body": ocean_body, "land_body": land_body,
        "ocean_gates": settled(ocean_gates(terrain, ocean_body, edges, depth) if measured else touching(ocean_body, edges, depth)),
        "land_gates": settled((land_gates if measured else touching)(land_body, edges, depth)),
    }
    if terminals:
        out["terminal"] = settled(drainage_terminals(terrain, edges, ocean))
    return out


# Lineage graphs

STEEPEST = 2**40  # more levels than any graph has; weights around a cycle stop here


def degrees(once: DataFrame) -> DataFrame:
    """(name, inputs, outputs, source, target): how many edges end and begin at each name, and the least name at their other ends."""
    none = F.lit(None).cast(once.schema["source"].dataType)
    ends = once.select(F.col("source").alias("name"), none.alias("i"), F.col("target").alias("o")).unionByName(
        once.select(F.col("target").alias("name"), F.col("source").alias("i"), none.alias("o")))
    return ends.groupBy("name").agg(
        F.count("i").alias("inputs"), F.count("o").alias("outputs"), F.min("i").alias("source"), F.min("o").alias("target"))


def lineage_levels(edges: DataFrame) -> DataFrame:
    """(name, level): the topological level of each dataset, null for those on or behind a cycle.

    `edges` is (source, target); a row with a null end is none. Each round settles the names nothing unsettled points at, and lets every
    edge whose source has one input jump over it to that input, adding the lengths. Chains and trees
    of inputs so end in logarithmic rounds; no graph takes more rounds than it has levels. A row
    without a source is what settled inputs give its target. Each level is written once.
    """
    once = settled(edges.select("source", "target").dropna().distinct())
    return levels_by_degree(once, settled(degrees(once)))


def levels_by_degree(once: DataFrame, degree: DataFrame) -> DataFrame:
    """`lineage_levels` of distinct edges whose `degrees` are known; these are the state of the first round."""
    nowhere = F.lit(None).cast(once.schema["source"].dataType)
    one = F.lit(1).cast("bigint")
    left = once.withColumn("w", one)
    state = degree.select(F.col("name").alias("target"), "inputs", F.when(F.col("inputs") == 0, 0).cast("bigint").alias("base"),
                          F.struct("source", one.alias("w")).alias("one"))
    parts = []
    while True:
        known = F.col("source").isNull()
        done = state.filter("inputs = 0")
        if done.isEmpty():
            break
        parts.append(done.select(F.col("target").alias("name"), "base"))
        add = lambda a, b: F.least(F.col(a) + F.coalesce(b, F.lit(0)), F.lit(STEEPEST))
        single = state.filter("inputs = 1").select(
            F.col("target").alias("source"), F.col("one.source").alias("_up"), F.col("one.w").alias("_w"), "base")
        met = left.filter("source IS NOT NULL").join(single, "source", "left")
        over = F.array(F.struct(F.coalesce("_up", "source").alias("source"), "target", add("w", "_w").alias("w")),
                       F.when(F.col("base").isNotNull(), F.struct(nowhere.alias("source"), "target", add("w", "base").alias("w"))))
        jumped = met.select(F.explode(F.array_compact(over)).alias("r")).select("r.*")
        ends = done.select(F.col("target").alias("source"), F.col("base").alias("_level"), F.lit(True).alias("_done"))
        given = jumped.join(ends, "source", "left").select(
            F.when(F.col("_done").isNull(), F.col("source")).alias("source"), "target", add("w", "_level").alias("w"))
        kept = state.filter("inputs > 0 AND base IS NOT NULL").select(nowhere.alias("source"), "target", F.col("base").alias("w"))
        left = settled(given.unionByName(kept).groupBy("source", "target").agg(F.max("w").alias("w")))
        state = settled(left.groupBy("target").agg(
            F.count("source").alias("inputs"), F.max(F.when(known, F.col("w"))).alias("base"),
            F.max(F.when(~known, F.struct("source", "w"))).alias("one")))
    out = state.select(F.col("target").alias("name"), F.lit(None).cast("bigint").alias("base"))  # what no round settled
    for part in parts:
        out = out.unionByName(part)
    return out.select("name", F.col("base").cast("int").alias("level"))


RUN = 1024  # levels of a chain that are read as one row


def lineage_runs(degree: DataFrame, levels: DataFrame) -> DataFrame:
    """(name, first): stretches of names with one input that has one output, cut where the level is a multiple of RUN.

    `first` is the name a stretch begins with, and has no row; nor have names that are in no stretch. Only names of
    stretches are jumped.
    """
    one_out = degree.filter("outputs = 1").select(F.col("name").alias("source"))
    linked = settled(degree.filter("inputs = 1").select("name", "source").join(one_out, "source"))
    deep = levels.filter(F.col("level") % RUN != 0).select("name")
    runs = settled(linked.join(deep, "name").select(F.col("name").alias("cell"), F.col("source").alias("parent")))
    span = 1
    while span < RUN and not runs.isEmpty():  # four times as far each time
        runs = settled(_jump(_jump(runs)))
        span *= 4
    return runs.select(F.col("cell").alias("name"), F.col("parent").alias("first"))


def _shrink(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round on loopless edges: ends of paths go, and so do some names with one input and one output.

    Returns the edges left, the loops this closed, and (name, source, target) of the names passed over.
    A name is passed over if it comes first, in a hashed order, among its neighbours of the same kind.
    """
    degree = settled(degrees(left))
    inner = degree.filter("inputs > 0 AND outputs > 0")
    left = left.join(inner.select(F.col("name").alias("source")), "source", "left_semi").join(
        inner.select(F.col("name").alias("target")), "target", "left_semi")
    # both neighbours must still be there: an end that goes in this round takes its edges along
    stays = inner.select(F.col("name").alias("_n"))
    thin = settled(degree.filter("inputs = 1 AND outputs = 1").join(stays.withColumnRenamed("_n", "source"), "source", "left_semi")
                   .join(stays.withColumnRenamed("_n", "target"), "target", "left_semi").select("name", "source", "target"))
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    peer = thin.select(F.col("name").alias("_p"))
    before = thin.join(peer.withColumnRenamed("_p", "source"), "source", "left_semi").filter(rank("source") < rank("name")).select("name")
    after = thin.join(peer.withColumnRenamed("_p", "target"), "target", "left_semi").filter(rank("target") < rank("name")).select("name")
    passed = settled(thin.join(before.unionByName(after), "name", "left_anti"))
    gone = passed.select("name")
    rest = (left.join(gone.withColumnRenamed("name", "source"), "source", "left_anti")
            .join(gone.withColumnRenamed("name", "target"), "target", "left_anti").select("source", "target")
            .unionByName(passed.select("source", "target")).distinct())
    rest = settled(rest)
    loops = rest.filter("source = target").select(F.col("source").alias("name"))
    return rest.filter("source <> target"), loops, passed


def _reach_parts(left: DataFrame) -> DataFrame:
    """(name, part) of the parts that hold the highest name reaching them: colours forward, then marks backward."""
    colour = settled(left.select(F.col("source").alias("name")).union(left.select(F.col("target").alias("name"))).distinct()
                     .withColumn("part", F.col("name")))
    front = colour
    while True:  # only names whose colour rose go on
        sent = left.join(front.withColumnRenamed("name", "source"), "source").groupBy(F.col("target").alias("name")).agg(F.max("part").alias("_new"))
        front = settled(colour.join(sent, "name").filter("_new > part").select("name", F.col("_new").alias("part")))
        if front.isEmpty():
            break
        colour = settled(colour.join(front.withColumnRenamed("part", "_new"), "name", "left").select("name", F.coalesce("_new", "part").alias("part")))
    inside = settled(left.join(colour.withColumnRenamed("name", "source"), "source").join(
        colour.select(F.col("name").alias("target"), F.col("part").alias("_q")), "target").filter("part = _q").select("source", "target"))
    front = seen = colour.filter("name = part")
    while True:
        back = inside.join(front.withColumnRenamed("name", "target"), "target").select(F.col("source").alias("name"), "part").distinct()
        front = settled(back.join(seen, "name", "left_anti"))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front))
    return seen


def strong_parts(edges: DataFrame) -> DataFrame:
    """(name, part): names that reach themselves, with one name of their strongly connected part for all its members.

    `edges` is (source, target). Paths that lead nowhere are peeled and names with one input and one
    output passed over, until that stops; the rest is coloured by the highest name that reaches each name, and
    the names of a colour that reach that name are a part. Names passed over lie in a part where both their
    neighbours do. Trees and chains take logarithmic rounds, a colouring as many as its part is across.
    """
    every = settled(edges.select("source", "target").dropna().distinct())
    left = every.filter("source <> target")
    loops = every.filter("source = target").select(F.col("source").alias("name"))
    passed, parts = [], []
    while not left.isEmpty():
        before = left.count()
        rest, closed, over = _shrink(left)
        passed.append(over)
        loops = loops.unionByName(closed)
        left = rest
        if left.count() * 10 > before * 9:
            found = _reach_parts(left)
            sizes = found.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("part")
            parts.append(settled(found.join(sizes, "part", "left_semi").select("name", "part")))
            gone = found.select("name")
            left = settled(left.join(gone.withColumnRenamed("name", "source"), "source", "left_anti").join(
                gone.withColumnRenamed("name", "target"), "target", "left_anti").select("source", "target"))
    loops = settled(loops.distinct())
    alone = loops.withColumn("part", F.col("name"))
    known = alone.limit(0)
    for p in parts:
        known = known.unionByName(p)
    known = settled(known.unionByName(alone.join(known.select("name"), "name", "left_anti")))
    for over in reversed(passed):
        a = known.select(F.col("name").alias("source"), "part")
        b = known.select(F.col("name").alias("target"), F.col("part").alias("_q"))
        inside = settled(over.join(a, "source").join(b, "target").filter("part = _q").select("name", "part"))
        if not inside.isEmpty():
            known = settled(known.join(inside.select("name"), "name", "left_anti").unionByName(inside))
    return known
