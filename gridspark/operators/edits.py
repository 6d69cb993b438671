"""Topology edits between two snapshots of a whole grid level: the results of `graph.topology_edits`, by blocks of ids.

A block is 1024 ids, a coarse cell of the grid, and one row. Links come from the ids, so there is no table of edges, and what lies
inside a block is settled there in array passes. Joins see only links between blocks, cells that changed, and the pairs of
bodies beside them. Of two snapshots the old one is layer 0 and the new one layer 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.contracts import require
from gridspark.functions import cells
from gridspark.operators.graph import SIDE, _block, _local, components, lowest_linked, name_edits
from gridspark.session import settled
from gridspark.sources.grid import neighbours

MOST = 128  # blocks of one array pass
ELEVATION = "<f8"  # elevations of a block's cells are one binary value: no array of numbers is taken apart on its way


class _Blocks:
    """Some blocks side by side: their ids, the links inside them (each once, lower id first) and the links that leave them."""

    def __init__(self, block: np.ndarray, level: int):
        self.block, last = block, cells.ncells(level)
        self.ids = (block[:, None] * SIDE + np.arange(1, SIDE + 1)).ravel()
        self.real = self.ids <= last
        other = np.stack(neighbours(np.minimum(self.ids, last), level)[0], axis=1)
        at = np.broadcast_to(np.arange(len(self.ids))[:, None], other.shape)
        same = (other - 1) // SIDE == (self.ids[:, None] - 1) // SIDE
        b = at - at % SIDE + (other - 1) % SIDE
        kept = same & (at < b) & self.real[:, None]
        self.a, self.b = at[kept], b[kept]
        out = ~same & self.real[:, None]
        self.border, self.beyond = at[out], other[out]

    def parts(self, linked: np.ndarray) -> np.ndarray:
        return lowest_linked(len(self.ids), self.a[linked], self.b[linked])


def _numbers(batch: pa.RecordBatch, name: str, kind: str = "<i2") -> np.ndarray:
    """The numbers of the cells of all blocks, one after another."""
    column = batch.column(name).cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], "int32")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(memoryview(column.buffers()[2])[at[0] : at[-1]], kind)


def _packed(values: np.ndarray, kind: str = "<i2") -> pa.Array:
    """The numbers of the cells as one value a block."""
    data = np.ascontiguousarray(values, kind)
    rows = len(data) // SIDE
    ends = np.arange(rows + 1, dtype="int32") * (SIDE * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(df: DataFrame, build: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """What `build` makes of some blocks at a time."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), MOST):
                made = build(batch.slice(i, MOST))
                yield pa.RecordBatch.from_pydict({n: made[n] for n in names})

    return df.mapInArrow(run, schema)


def _below(batch: pa.RecordBatch, blocks: _Blocks, datum: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for name in ("z_old", "z_new"):
        z = _numbers(batch, name, ELEVATION)
        below = (z < datum) & blocks.real
        yield z, below, blocks.parts(below[blocks.a] & below[blocks.b])


def _basins(level: int, datum: float, seed_below: float):
    """Parts below the datum inside blocks: their links out of the block, and, without a cell, those that hold a seed."""

    def build(batch):
        blocks, rows = _Blocks(batch.column("block").to_numpy(), level), []
        for layer, (z, below, part) in enumerate(_below(batch, blocks, datum)):
            out = below[blocks.border]
            at = blocks.border[out]
            rows.append((np.full(len(at), layer), blocks.ids[at], blocks.beyond[out], blocks.ids[part[at]]))
            seeded = blocks.ids[np.unique(part[below & (z < seed_below)])]
            rows.append((np.full(len(seeded), layer), np.zeros_like(seeded), np.zeros_like(seeded), seeded))
        layer, cell, neighbour, part = (np.concatenate(x) for x in zip(*rows))
        return {"layer": layer.astype("int32"), "cell": cell, "neighbour": neighbour, "part": part}

    return build


def _classes(level: int, datum: float, depth: int):
    """The blocks with what each cell belongs to: wet or not, body, land part and cluster of changed cells, by lowest cell in the block."""

    def build(batch):
        blocks, rows = _Blocks(batch.column("block").to_numpy(), level), len(batch)
        a, b, wet = blocks.a, blocks.b, batch.column("wet")
        codes = wet.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(rows), pc.list_value_length(wet).fill_null(0).to_numpy(zero_copy_only=False))
        out = {"block": batch.column("block"), "z_old": batch.column("z_old"), "z_new": batch.column("z_new")}
        ocean = []
        for layer, (_, below, part) in enumerate(_below(batch, blocks, datum)):
            flooded = np.zeros(len(below), bool)
            mine = codes % 2 == layer
            flooded[row[mine] * SIDE + codes[mine] // 2] = True
            ocean.append(below & flooded[part])
        coarse = a >> 2 * depth == b >> 2 * depth
        for name, w in zip(("old", "new"), ocean):
            out[f"wet_{name}"] = _packed(w)
            out[f"body_{name}"] = _packed(blocks.parts(coarse & (w[a] == w[b])) % SIDE)
            out[f"land_{name}"] = _packed(blocks.parts(~w[a] & ~w[b]) % SIDE)
        was, changed = ocean[0], ocean[0] != ocean[1]
        out["cluster"] = _packed(blocks.parts(changed[a] & changed[b] & (was[a] == was[b])) % SIDE)
        return out

    return build


class _Solved(_Blocks):
    """Blocks as `_classes` gave them. `images` has a bit for each body, by its place in the coarse cell, that shares a cell with one."""

    def __init__(self, batch: pa.RecordBatch, level: int, depth: int):
        super().__init__(batch.column("block").to_numpy(), level)
        start = np.arange(len(self.ids)) // SIDE * SIDE
        held = {n: start + _numbers(batch, n) for n in ("body_old", "body_new", "land_old", "land_new", "cluster")}
        self.wet = [_numbers(batch, n).astype(bool) for n in ("wet_old", "wet_new")]
        self.body, self.land = [held["body_old"], held["body_new"]], [held["land_old"], held["land_new"]]
        self.cluster, self.changed = held["cluster"], self.wet[0] != self.wet[1]
        self.coarse, self.depth = (self.ids - 1) // 4**depth + 1, depth
        self.stirred = np.repeat(self.changed.reshape(-1, 4**depth).any(axis=1), 4**depth)  # the coarse cell holds a changed cell
        kept = np.flatnonzero(~self.changed)
        self.images = []
        for layer in (0, 1):
            mask = np.zeros(len(self.ids), "int64")
            np.bitwise_or.at(mask, self.body[layer][kept], np.int64(1) << (self.body[1 - layer][kept] % 4**depth))
            self.images.append(mask)


def _changed(level: int, depth: int):
    def build(batch):
        s, z = _Solved(batch, level, depth), [_numbers(batch, n, ELEVATION) for n in ("z_old", "z_new")]
        at = np.flatnonzero(s.changed)
        was = s.wet[0][at]
        return {"cell": s.ids[at], "cluster": s.ids[s.cluster[at]], "was": was,
                "wet_z": np.where(was, z[0][at], z[1][at]), "dry_z": np.where(was, z[1][at], z[0][at])}

    return build


def _beside(level: int, depth: int):
    """Land parts of the snapshot in which a cluster is wet, at cells beside it that are land in both."""

    def build(batch):
        s, rows = _Solved(batch, level, depth), []
        for a, b in ((s.a, s.b), (s.b, s.a)):
            kept = s.changed[a] & ~s.wet[0][b] & ~s.wet[1][b]
            layer = np.where(s.wet[0][a[kept]], 0, 1)
            rows.append(np.stack([s.ids[s.cluster[a[kept]]], layer, s.ids[np.where(layer == 0, s.land[0][b[kept]], s.land[1][b[kept]])]]))
        cluster, layer, land = np.unique(np.concatenate(rows, axis=1), axis=1)
        return {"cluster": cluster, "layer": layer.astype("int32"), "land": land}

    return build


GATE = "layer int, ocean boolean, coarse_a bigint, coarse_b bigint, inner bigint, outer bigint, images_in bigint, images_out bigint"


def _gates(level: int, depth: int):
    """Pairs of bodies that meet across a coarse edge inside a block, where either coarse cell holds a changed cell."""

    def build(batch):
        s, rows = _Solved(batch, level, depth), []
        near = (s.coarse[s.a] != s.coarse[s.b]) & (s.stirred[s.a] | s.stirred[s.b])
        a, b = s.a[near], s.b[near]
        for layer in (0, 1):
            same = s.wet[layer][a] == s.wet[layer][b]
            pair = np.unique(s.body[layer][a[same]] * len(s.ids) + s.body[layer][b[same]])
            i, o = pair // len(s.ids), pair % len(s.ids)
            rows.append((np.full(len(i), layer, "int32"), s.wet[layer][i], s.coarse[i], s.coarse[o], s.ids[i], s.ids[o], s.images[layer][i], s.images[layer][o]))
        names = ("layer", "ocean", "coarse_a", "coarse_b", "inner", "outer", "images_in", "images_out")
        return dict(zip(names, (np.concatenate(x) for x in zip(*rows))))

    return build


def _split(level: int, depth: int):
    """Coarse cells of bodies with no image or several."""

    def build(batch):
        s, rows = _Solved(batch, level, depth), []
        for layer in (0, 1):
            root = s.real & (s.body[layer] == np.arange(len(s.ids)))
            mask = s.images[layer]
            at = np.flatnonzero(root & ((mask == 0) | (mask & (mask - 1) != 0)))
            rows.append((s.coarse[at], s.wet[layer][at] == (layer == 0)))
        coarse, closing = (np.concatenate(x) for x in zip(*rows))
        return {"coarse": coarse, "closing": closing}

    return build


HALF = ("cell bigint, neighbour bigint, wet_old boolean, wet_new boolean, cluster bigint, land_old bigint, land_new bigint, "
        "body_old bigint, body_new bigint, images_old bigint, images_new bigint, stirred boolean")


def _halves(level: int, depth: int):
    """The links out of a block, with what their near cell belongs to."""

    def build(batch):
        s = _Solved(batch, level, depth)
        at = s.border
        out = {"cell": s.ids[at], "neighbour": s.beyond, "cluster": s.ids[s.cluster[at]], "stirred": s.stirred[at]}
        for layer, name in enumerate(("old", "new")):
            body = s.body[layer][at]
            out |= {f"wet_{name}": s.wet[layer][at], f"land_{name}": s.ids[s.land[layer][at]],
                    f"body_{name}": s.ids[body], f"images_{name}": s.images[layer][body]}
        return out

    return build


def _facing(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each link between blocks with both of its rows: those of `cell` by name, those of `neighbour` with `far_` before."""
    far = rows.select(*[F.col(c).alias({"cell": "neighbour", "neighbour": "cell"}.get(c, c if c in keys else f"far_{c}")) for c in rows.columns])
    return rows.join(far, ["cell", "neighbour", *keys])


def _merged(pairs: DataFrame) -> DataFrame:
    """(layer, part, label) of the parts of `pairs` (layer, part, far_part), which has both directions."""
    node = lambda c: (F.col(c) * 2 + F.col("layer"))
    links = settled(pairs.select(node("part").alias("cell"), node("far_part").alias("neighbour")).distinct())
    label = components(links.select("cell").distinct(), links)
    return settled(label.select((F.col("cell") % 2).cast("int").alias("layer"), F.shiftright("cell", 1).alias("part"), F.shiftright("label", 1).alias("label")))


def _named(rows: DataFrame, merged: DataFrame, part: str = "part") -> DataFrame:
    """Rows with `label`, the part's own where it was merged with none."""
    return rows.join(merged.withColumnRenamed("part", part), ["layer", part], "left").withColumn("label", F.coalesce("label", part))


def _holds(images: Column, body: Column, depth: int) -> Column:
    """Whether a body is among images, by its place in the coarse cell."""
    places = F.lit(1).cast("bigint")
    place = (body - 1).bitwiseAND(F.lit(4**depth - 1)).cast("int")
    return F.call_function("shiftright", images, place).bitwiseAND(places) == 1


def block_edits(terrain: DataFrame, level: int, seed_below: float, datum: float, depth: int) -> DataFrame:
    """`topology_edits` of a level's two snapshots, whose seeds are the cells under `seed_below`.

    `terrain` is (block, z_old, z_new), one row for every 1024 ids: the elevations of its cells in order of id, padded where the level
    ends, as the bytes of little-endian doubles.
    """
    site = "block_edits"
    require(depth <= 3, "depth", site, "a coarse cell would hold more than 64 bodies")
    require(seed_below <= datum, "ocean seed", site, "a seed does not lie below the datum")
    terrain = settled(terrain)
    basins = settled(_rows(terrain, _basins(level, datum, seed_below), "layer int, cell bigint, neighbour bigint, part bigint"))
    links, seeds = basins.filter("cell > 0"), basins.filter("cell = 0").select("layer", "part")
    every = _named(basins.select("layer", "part").distinct(), _merged(_facing(links, ("layer",)).select("layer", "part", "far_part")))
    every = settled(every)
    reached = every.join(seeds, ["layer", "part"], "left_semi").select("layer", "label").distinct()
    wet = every.join(reached, ["layer", "label"], "left_semi").groupBy(_block(F.col("part")).alias("block")).agg(
        F.collect_list(_local(F.col("part")) * 2 + F.col("layer")).alias("wet"))
    numbers = ", ".join(f"{n} binary" for n in ("wet_old", "body_old", "land_old", "wet_new", "body_new", "land_new", "cluster"))
    solved = settled(_rows(
        terrain.join(wet, "block", "left"), _classes(level, datum, depth), f"block bigint, z_old binary, z_new binary, {numbers}"))
    lean = solved.drop("z_old", "z_new")
    changed = settled(_rows(solved, _changed(level, depth), "cell bigint, cluster bigint, was boolean, wet_z double, dry_z double"))
    met = settled(_facing(settled(_rows(lean, _halves(level, depth), HALF))))
    differs, far_land = F.col("wet_old") != F.col("wet_new"), ~F.col("far_wet_old") & ~F.col("far_wet_new")
    # clusters, and the land beside them
    joined = met.filter(differs & (F.col("far_wet_old") != F.col("far_wet_new")) & (F.col("wet_old") == F.col("far_wet_old")))
    clusters = _merged(joined.select(F.lit(0).alias("layer"), F.col("cluster").alias("part"), F.col("far_cluster").alias("far_part")))
    dry = [met.filter(f"NOT wet_{n} AND NOT far_wet_{n}").select(F.lit(i).alias("layer"), F.col(f"land_{n}").alias("part"), F.col(f"far_land_{n}").alias("far_part"))
           for i, n in enumerate(("old", "new"))]
    layer = F.when(F.col("wet_old"), 0).otherwise(1)
    across = met.filter(differs & far_land).select("cluster", layer.alias("layer"), F.when(F.col("wet_old"), F.col("far_land_old")).otherwise(F.col("far_land_new")).alias("land"))
    beside = _rows(lean, _beside(level, depth), "cluster bigint, layer int, land bigint").unionByName(across).distinct()
    beside = _named(beside, _merged(dry[0].unionByName(dry[1])), "land").select("cluster", F.col("label").alias("land"))
    own = lambda df: _named(df.withColumn("layer", F.lit(0)), clusters, "cluster").drop("layer", "cluster")
    members = settled(own(changed))
    lands = own(beside).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("lands"))
    # moves of bodies: split ones, and gates without a gate between images on the same coarse edge
    ca, cb = (cells.ancestor(F.col(c), depth) for c in ("cell", "neighbour"))
    outer = met.filter((ca < cb) & (F.col("stirred") | F.col("far_stirred")))
    gates = _rows(lean, _gates(level, depth), GATE)
    for i, n in enumerate(("old", "new")):
        gates = gates.unionByName(outer.filter(F.col(f"wet_{n}") == F.col(f"far_wet_{n}")).select(
            F.lit(i).alias("layer"), F.col(f"wet_{n}").alias("ocean"), ca.alias("coarse_a"), cb.alias("coarse_b"), F.col(f"body_{n}").alias("inner"),
            F.col(f"far_body_{n}").alias("outer"), F.col(f"images_{n}").alias("images_in"), F.col(f"far_images_{n}").alias("images_out")))
    # a coarse edge has 2^depth links, and so at most as many gates a layer
    held = gates.groupBy("ocean", "coarse_a", "coarse_b").agg(F.collect_set(F.struct("layer", "inner", "outer", "images_in", "images_out")).alias("g"))
    kept = lambda x: F.exists("g", lambda y: (y["layer"] != x["layer"]) & _holds(x["images_in"], y["inner"], depth) & _holds(x["images_out"], y["outer"], depth))
    lost = held.select("ocean", "coarse_a", "coarse_b", F.explode(F.array_distinct(F.transform(F.filter("g", lambda x: ~kept(x)), lambda x: x["layer"]))).alias("layer"))
    lost = lost.select(F.explode(F.array("coarse_a", "coarse_b")).alias("coarse"), (F.col("ocean") == (F.col("layer") == 0)).alias("closing"))
    moves = _rows(lean, _split(level, depth), "coarse bigint, closing boolean").unionByName(lost).distinct()
    moved = members.select("label", cells.ancestor(F.col("cell"), depth).alias("coarse"), F.col("was").alias("closing")).join(
        moves, ["coarse", "closing"], "left_semi").select("label").distinct()
    return name_edits(members, lands, moved, datum)
