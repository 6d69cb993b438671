"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. For an anchor at angle a and a vector at
angle v to the same direction, the angle between them lies in [|a - v|, min(a + v, 2 pi - a - v)]; the
tightest interval over all directions, as cosines times both norms, bounds the score from both sides,
widened by more than rounding can move it. Only vectors whose bounds overlap what is wanted are scored, in
exact integers: for positives the bound of the k-th best so far, for negatives the windows of the
anchor's positives.

Vectors are ordered by label, nearest direction and angle, and cut into blocks of about `BLOCK`; anchors
are blocks of about `ANCHORS` in the same order. Blocks are paired by their ranges of label, angle and
norm, and each pair is one task row, so no task holds more than two blocks. Each pair returns its few
best; ranks over pairs are windows with a limit, which Spark applies before it shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.llm.common import first_by_digest
from gridspark.session import settled

SCALE = 256            # a component x becomes floor(SCALE * x)
POSITIVES, NEGATIVES = 5, 3
WINDOW = (50, 95)      # hundredths of the positive's score
SAMPLE = 2048          # vectors that the reference directions are fitted on, at most
DIRECTIONS = 16
BLOCK, ANCHORS = 2048, 8192
FIRST = 64             # vectors scored before the bound of the k-th best is known
SLACK = 1e-6           # of an angle, for its storage in single precision and the arc cosine
MOST = float(1 << 53)
LAST = (1 << 63) - 1   # stands for a missing id, which comes last among ties
GRID = 16              # parts of either side when block ranges are paired


def usable(label: str, vector: str) -> Column:
    """Rows that take part: a label, and a vector without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all components in double) of a list column without nulls."""
    return np.asarray(column.value_lengths()), np.asarray(column.flatten().cast(pa.float64()))


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * x); what leaves the doubles stays at their end."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * v), -1e300, 1e300) + 0.0


def norms_of(q: np.ndarray) -> np.ndarray:
    top = np.abs(q).max(axis=1, initial=0.0)
    return top * np.sqrt(((q / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))


def angles_to(q: np.ndarray, directions: np.ndarray | None) -> np.ndarray:
    """Angles of rows to the directions of their length; no column where there are none."""
    if directions is None or not len(directions):
        return np.zeros((len(q), 0))
    top = np.maximum(np.abs(q).max(axis=1, initial=0.0), 1e-300)[:, None]
    unit = q / top
    length = np.sqrt((unit * unit).sum(axis=1))[:, None]
    return np.arccos(np.clip((unit / np.where(length > 0, length, 1.0)) @ directions.T, -1.0, 1.0))


def fitted(sample: list[list[float]], most: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Reference directions for each length of vector: far apart at first, then means of those nearest to them."""
    out: dict[int, np.ndarray] = {}
    for d in sorted({len(v) for v in sample if len(v)}):
        q = quantised(np.array([v for v in sample if len(v) == d], dtype=np.float64))
        q = q[np.abs(q).max(axis=1) > 0]
        if not len(q):
            continue
        u = q / norms_of(q)[:, None]
        chosen, near = [0], u @ u[0]
        while len(chosen) < min(most, len(u)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, u @ u[chosen[-1]])
        centre = u[chosen]
        for _ in range(8):
            mine = (u @ centre.T).argmax(axis=1)
            sums = np.array([u[mine == k].sum(axis=0) for k in range(len(centre))])
            length = np.sqrt((sums * sums).sum(axis=1))
            centre = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centre)
        out[d] = centre
    return out


def score_bounds(angle: np.ndarray, norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score that an anchor can have with each row, by the triangle inequality of angles."""
    if angles.shape[1]:
        low = np.abs(angles - angle).max(axis=1)
        both = angles + angle
        high = np.minimum(both.min(axis=1), 2 * math.pi - both.max(axis=1))
    else:
        low, high = np.zeros(len(norms)), np.full(len(norms), math.pi)
    low, high = np.maximum(low - SLACK, 0.0), np.minimum(np.maximum(high, low) + SLACK, math.pi)
    with np.errstate(over="ignore", invalid="ignore"):
        size = norm * norms
        most, least = np.ceil(size * np.cos(low) + 1 + 1e-9 * size), np.floor(size * np.cos(high) - 1 - 1e-9 * size)
    huge = ~np.isfinite(size)
    return np.where(huge, -np.inf, least), np.where(huge, np.inf, most)


def integer_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what leaves 64 bits stays at their end."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if rows.shape[1] * np.abs(rows).max(initial=0.0) * np.abs(anchor).max(initial=0.0) < MOST:
        return (rows @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    return np.array([max(-LAST - 1, min(LAST, sum(x * int(y) for x, y in zip(a, row)))) for row in rows], dtype=np.int64)


class _Block:
    """A block as arrays."""

    def __init__(self, side: str, batch: pa.RecordBatch, i: int) -> None:
        def read(name, kind):
            return np.frombuffer(batch[f"{side}_{name}"][i].as_py(), dtype=kind)

        self.rows, self.ids, self.labels, self.norms = read("rows", np.int64), read("ids", np.int64), read("labels", np.int64), read("norms", np.float64)
        n, width = len(self.rows), batch[f"{side}_width"][i].as_py()
        self.vectors = read("vectors", f"i{width}" if width < 8 else np.float64).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))
        self.angles = read("angles", np.float32).reshape(n, -1).astype(np.float64)


PAYLOAD = ("rows", "ids", "labels", "norms", "vectors", "angles")
BLOCK_SCHEMA = T.StructType([
    T.StructField("block", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("d", "n", "width")], *[T.StructField(c, T.BinaryType()) for c in PAYLOAD],
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("low", "high")], T.StructField("norm_high", T.DoubleType()),
    *[T.StructField(c, T.LongType()) for c in ("label_low", "label_high")]])


def _blocks(directions: dict[int, np.ndarray], most: int):
    """Rows in order -> blocks with their vectors, norms, angles and ranges."""

    def made(number: int, d: int, held: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        q = quantised(_lists(t["v"].chunk(0))[1].reshape(t.num_rows, d))
        top = np.abs(q).max(initial=0.0)
        width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
        angles = angles_to(q, directions.get(d)).astype(np.float32)
        labels, norms = np.asarray(t["label"]), norms_of(q)
        out = {"rows": np.asarray(t["row"]), "ids": np.asarray(t["id"]), "labels": labels, "norms": norms, "vectors": q.astype(f"i{width}") if width < 8 else q, "angles": angles}
        return {k: v.tobytes() for k, v in out.items()} | {
            "block": number, "d": d, "n": t.num_rows, "width": width, "low": angles.min(axis=0).astype(float).tolist(), "high": angles.max(axis=0).astype(float).tolist(),
            "norm_high": min(float(norms.max()), 1e300), "label_low": int(labels.min()), "label_high": int(labels.max())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, d, held, n = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(batch["v"].value_lengths())
            for a, b in zip(np.r_[0, (cut := np.flatnonzero(size[1:] != size[:-1]) + 1)], np.r_[cut, len(size)]):
                if held and (d != size[a] or n >= most):
                    yield pa.RecordBatch.from_pylist([made(number, d, held)], schema=to_arrow_schema(BLOCK_SCHEMA))
                    number, held, n = number + 1, [], 0
                d = int(size[a])
                held.append(batch.slice(a, b - a))
                n += b - a
        if held:
            yield pa.RecordBatch.from_pylist([made(number, d, held)], schema=to_arrow_schema(BLOCK_SCHEMA))

    return run


def _in_blocks(rows: DataFrame, directions: dict[int, np.ndarray], most: int) -> DataFrame:
    """(row, id, label, v) cut into blocks of about `most` neighbours by label, nearest direction and angle to it."""
    n = rows.count()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch["v"].value_lengths())
            cell, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                found = angles_to(quantised(_lists(batch["v"].take(pa.array(at)))[1].reshape(len(at), d)), directions.get(int(d)))
                if found.shape[1]:
                    cell[at], angle[at] = found.argmin(axis=1), found.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "cell", "angle"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(near, f"row long, id long, label long, v {kind}, cell int, angle double")
    order = [F.size("v"), F.col("label"), F.col("cell"), F.col("angle"), F.col("row")]
    ranged = placed.repartitionByRange(*order).coalesce(max(1, math.ceil(n / most))).sortWithinPartitions(*order)
    return settled(ranged.select("row", "id", "label", "v").mapInArrow(_blocks(directions, most), BLOCK_SCHEMA))


def _side(blocks: DataFrame, side: str, *more: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in ("block", "d", "width", *PAYLOAD, *more)])


def _paired(anchors: DataFrame, blocks: DataFrame, keep: Column, *more: str) -> DataFrame:
    """Pairs of an anchor block and a block, where their ranges allow `keep`: ranges are paired first, payloads follow.

    Either side is dealt over a grid of `GRID` x `GRID` cells, so the pairing of ranges is an equi-join.
    """
    ranges = ("block", "d", "low", "high", "norm_high", "label_low", "label_high")
    cells = F.sequence(F.lit(0).cast("long"), F.lit(GRID - 1).cast("long"))
    one = anchors.select(*[F.col(c).alias(f"a_{c}") for c in (*ranges, *[m for m in more if m in anchors.columns])], F.pmod(F.xxhash64("block"), F.lit(GRID)).alias("_i"), F.explode(cells).alias("_j"))
    two = blocks.select(*[F.col(c).alias(f"v_{c}") for c in ranges], F.pmod(F.xxhash64("block"), F.lit(GRID)).alias("_j"), F.explode(cells).alias("_i"))
    pairs = one.join(two, ["_i", "_j"]).filter((F.col("a_d") == F.col("v_d")) & keep).select("a_block", "v_block")
    return pairs.join(_side(anchors, "a", *more), "a_block").join(_side(blocks, "v"), "v_block").repartition("a_block", "v_block")


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -np.maximum(scores, -LAST)))[:k]


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, v = _Block("a", batch, i), _Block("v", batch, i)
                out: list[tuple[np.ndarray, ...]] = []
                for j in range(len(a.rows)):
                    at = np.flatnonzero((v.labels == a.labels[j]) & (v.rows != a.rows[j]))
                    if not len(at):
                        continue
                    _, most = score_bounds(a.angles[j], a.norms[j], v.angles[at], v.norms[at])
                    if len(at) > FIRST:
                        first = np.argpartition(-most, FIRST - 1)[:FIRST]
                        bound = np.sort(integer_scores(v.vectors[at[first]], a.vectors[j]))[-min(k, FIRST)]
                        at = at[most >= bound]
                    scores = integer_scores(v.vectors[at], a.vectors[j])
                    top = _best(scores, v.ids[at], v.rows[at], k)
                    at = at[top]
                    out.append((np.full(len(at), a.rows[j]), v.rows[at], v.ids[at], scores[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["anchor", "row", "id", "score"])

    return run


def windows_of(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest integer score between two hundredths of a positive's score."""
    return -(-window[0] * score // 100), window[1] * score // 100


def _negatives(k: int, window: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, v = _Block("a", batch, i), _Block("v", batch, i)
                wanted: dict[int, list[tuple[int, int]]] = {}
                for row, rank, score in zip(*(batch[f"a_{c}"][i].as_py() for c in ("anchors", "ranks", "scores"))):
                    wanted.setdefault(row, []).append((rank, score))
                out: list[tuple[np.ndarray, ...]] = []
                for j in range(len(a.rows)):
                    spans = [(rank, *windows_of(score, window)) for rank, score in wanted.get(int(a.rows[j]), ())]
                    spans = [s for s in spans if s[1] <= s[2]]
                    at = np.flatnonzero(v.labels != a.labels[j])
                    if not spans or not len(at):
                        continue
                    least, most = score_bounds(a.angles[j], a.norms[j], v.angles[at], v.norms[at])
                    hit = np.zeros(len(at), bool)
                    for _, lo, hi in spans:
                        sure = np.flatnonzero((least >= lo) & (most <= hi))
                        # What k rows surely inside the window surely pass is not wanted.
                        floor = np.partition(least[sure], len(sure) - k)[len(sure) - k] if len(sure) >= k else lo
                        hit |= (most >= floor) & (least <= hi)
                    at = at[hit]
                    scores = integer_scores(v.vectors[at], a.vectors[j])
                    for rank, lo, hi in spans:
                        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                        top = inside[_best(scores[inside], v.ids[at[inside]], v.rows[at[inside]], k)]
                        out.append((np.full(len(top), a.rows[j]), np.full(len(top), rank), v.rows[at[top]], v.ids[at[top]], scores[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names=["anchor", "place", "row", "id", "score"])

    return run


def _ranked(found: DataFrame, keys: tuple[str, ...], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
                   block: int = BLOCK, anchors: int = ANCHORS, directions: int = DIRECTIONS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of (vec_id, embedding, label).

    `anchor` says which rows ask. An anchor's positives are its best other rows of the same label; the
    negatives of a positive are the best rows of another label whose score lies in the window.

    Rows with a null label or vector, or with null or non-finite components, take no part; an empty vector
    scores zero with its like, vectors of different lengths are not compared. Equal scores go by vec_id, a
    missing one last. Every row counts, so a repeated row is a positive of its copy, and a repeated anchor
    has its rows repeated. Scores beyond 64 bits are held at their ends. Further columns are not read. An
    empty table gives an empty table.
    """
    given = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).filter(usable("label", "embedding"))
    rows = given.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"), "_anchor")
    rows = settled(rows)
    sample = first_by_digest(rows.select("v", "id", "row"), F.xxhash64("id", "row"), SAMPLE)
    found = fitted([list(r["v"]) for r in sample], directions)
    whole = _in_blocks(rows.drop("_anchor"), found, block)
    asking = _in_blocks(rows.filter("_anchor").drop("_anchor"), found, anchors)

    met = (F.col("a_label_low") <= F.col("v_label_high")) & (F.col("v_label_low") <= F.col("a_label_high"))
    best = _paired(asking, whole, met).mapInArrow(_positives(positives), "anchor long, row long, id long, score long")
    best = settled(_ranked(best, ("anchor",), positives, "place"))

    # Each anchor block gets the scores of its own anchors' positives.
    owner = asking.select("block", "rows").mapInArrow(_members, "block long, anchor long")
    wants = owner.join(best, "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "score")).alias("w"))
    wants = wants.select(F.col("block").alias("_b"), F.col("w.anchor").alias("anchors"), F.col("w.place").alias("ranks"), F.col("w.score").alias("scores"))
    asking = settled(asking.join(wants, asking["block"] == wants["_b"]).drop("_b").withColumn("want_low", F.array_min("scores")).withColumn("want_high", F.array_max("scores")))
    other = ~((F.col("a_label_low") == F.col("a_label_high")) & (F.col("v_label_low") == F.col("v_label_high")) & (F.col("a_label_low") == F.col("v_label_low")))
    # The greatest score of two blocks, by the gap of their ranges of angles.
    gap = F.array_max(F.zip_with(F.zip_with("a_low", "v_high", lambda a, v: a - v), F.zip_with("v_low", "a_high", lambda v, a: v - a), lambda x, y: F.greatest(x, y, F.lit(0.0))))
    top = F.col("a_norm_high") * F.col("v_norm_high") * (F.cos(F.greatest(F.coalesce(gap, F.lit(0.0)) - SLACK, F.lit(0.0))) + 1e-9) + 2
    reach = (F.lit(window[0] / 100) * F.col("a_want_low") <= F.greatest(top, F.lit(0.0))) | F.isnan(top)
    mined = _paired(asking, whole, other & reach, "anchors", "ranks", "scores", "want_low").mapInArrow(_negatives(negatives, window), "anchor long, place long, row long, id long, score long")
    mined = _ranked(mined, ("anchor", "place"), negatives, "rank").select("anchor", "place", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))

    def named(c: str) -> Column:
        return F.when(F.col(c) != LAST, F.col(c))

    names = rows.filter("_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    ours = best.select("anchor", F.col("place").cast("long").alias("place"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    out = mined.join(ours, ["anchor", "place"]).join(names, "anchor")
    return out.select(named("anchor_id").alias("anchor_id"), named("positive").alias("positive_id"), "rank", named("negative").alias("negative_id"), "positive_score", "negative_score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.frombuffer(b.as_py(), np.int64) for b in batch["rows"]]
        blocks = [np.full(len(r), b.as_py()) for r, b in zip(rows, batch["block"])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks), pa.int64()), pa.array(np.concatenate(rows), pa.int64())], names=["block", "anchor"])
