"""Half-open interval tables: contiguity, as-of lookup, interpolation, stepped reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.contracts import raise_if_any, require
from gridspark.operators.ordered import FromData, lagged, last_known, last_records, match, numbered


def uniform_intervals(spark: SparkSession, t0: float, step: float, n: int) -> DataFrame:
    """n contiguous intervals, each bound computed from its index so errors do not build up."""
    require(step > 0, "step", "uniform_intervals", f"{step} is not positive")
    i = F.col("id").cast("double")
    return spark.range(n).select(
        F.col("id").alias("i"), (F.lit(float(t0)) + F.lit(float(step)) * i).alias("t0"),
        (F.lit(float(t0)) + F.lit(float(step)) * (i + 1.0)).alias("t1"),
    )


def contiguity(df: DataFrame, slice_by: Column | FromData | None, keys: Sequence[str] = (), t0: str = "t0",
               t1: str = "t1") -> DataFrame:
    """Gaps and overlaps between consecutive intervals; no rows when the series is contiguous."""
    out = lagged(df.select(*keys, t0, t1), {"_before": t1}, [t0, t1], slice_by, keys)
    return out.filter(F.col("_before") != F.col(t0)).select(
        *keys, F.col("_before").alias("previous_end"), t0,
        F.when(F.col("_before") < F.col(t0), "gap").otherwise("overlap").alias("problem"),
    )


def span(df: DataFrame, keys: Sequence[str] = (), t0: str = "t0", t1: str = "t1") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(t0).alias("t0"), F.max(t1).alias("t1"))


def interval_lookup(points: DataFrame, intervals: DataFrame, t: str, value: str, slice_by: Column | FromData | None,
                    keys: Sequence[str] = (), t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Each point beside the value of the interval [t0, t1) holding its instant; null outside the span.

    The instants are de-duplicated before they are ordered, so a hot instant is one row; intervals
    and instants are ordered together in slices of time, and the answers are equi-joined back.
    `slice_by` is how the instants are sliced; an expression names them `_t`.
    """
    keys = list(keys)
    asked = points.select(*keys, F.col(t).alias("_t")).distinct()
    held = F.struct(F.col(t0).alias("t0"), F.col(t1).alias("t1"), F.col(value).alias("value"))
    starts = intervals.select(*keys, F.col(t0).alias("_t"), held.alias("_hit"), F.lit(0).alias("_side"))
    empty = F.lit(None).cast(starts.schema["_hit"].dataType)
    both = starts.unionByName(asked.withColumn("_hit", empty).withColumn("_side", F.lit(1)))
    found = last_known(both, "_hit", ["_t", "_side"], slice_by, keys, "_held").filter(F.col("_side") == 1)
    inside = F.col("_t") < F.col("_held.t1")
    answers = found.select(*keys, "_t", F.when(inside, F.col("_held")).alias("_held"))
    return (
        match(points.withColumn("_t", F.col(t)), answers, [*keys, "_t"], "left")
        .withColumn("interval_t0", F.col("_held.t0")).withColumn(f"{value}_at", F.col("_held.value"))
        .drop("_t", "_held")
    )


def outside_span(looked_up: DataFrame) -> DataFrame:
    """Points no interval holds: the rows a strict lookup refuses."""
    return looked_up.filter(F.col("interval_t0").isNull())


def interpolate_grid(points: DataFrame, grid: DataFrame, axes: dict[str, Sequence[float]], value: str,
                     check: bool = False) -> DataFrame:
    """Multilinear interpolation of `value` in the grid over the declared axis nodes.

    The grid is first reshaped to one row per box with its 2^N corner values, so a point needs one
    equi-join and no aggregation. Null where the point is outside the span or meets an absent node
    with nonzero weight.
    """
    names = list(axes)
    boxes = grid
    for a in names:
        boxes = boxes.withColumn(f"_i_{a}", _node_index(F.col(a), axes[a]))
    base = boxes.select(*[f"_i_{a}" for a in names], F.col(value).alias("_v"))
    offsets = F.array(*[
        F.struct(F.lit(c).alias("corner"), *[(F.col(f"_i_{a}") - ((c >> j) & 1)).alias(f"_i_{a}") for j, a in enumerate(names)])
        for c in range(2 ** len(names))
    ])
    corners = base.select("_v", F.explode(offsets).alias("_o")).select("_v", "_o.*")
    packed = corners.groupBy(*[f"_i_{a}" for a in names]).agg(
        *[F.max(F.when(F.col("corner") == c, F.col("_v"))).alias(f"_c{c}") for c in range(2 ** len(names))]
    )
    placed = points
    inside = F.lit(True)
    for a in names:
        nodes = [float(x) for x in axes[a]]
        last = len(nodes) - 2
        at = F.array(*[F.lit(x) for x in nodes])
        i = F.least(F.lit(last), _node_index(F.col(a), nodes))
        placed = placed.withColumn(f"_i_{a}", i.cast("int"))
        lo = F.element_at(at, F.greatest(F.col(f"_i_{a}"), F.lit(0)) + 1)
        hi = F.element_at(at, F.greatest(F.col(f"_i_{a}"), F.lit(0)) + 2)
        placed = placed.withColumn(f"_f_{a}", (F.col(a) - lo) / (hi - lo))
        inside = inside & (F.col(a) >= nodes[0]) & (F.col(a) <= nodes[-1])
    joined = match(placed, packed, [f"_i_{a}" for a in names], "left")
    total = F.lit(0.0)
    for c in range(2 ** len(names)):
        w = F.lit(1.0)
        for j, a in enumerate(names):
            w = w * (F.col(f"_f_{a}") if (c >> j) & 1 else 1.0 - F.col(f"_f_{a}"))
        total = total + F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(f"_c{c}"))
    out = joined.withColumn(value, F.when(inside, total))
    out = out.select(*points.columns, value)
    if check:
        raise_if_any(out.filter(F.col(value).isNull()), value, "interpolate_grid")
    return out


def _node_index(x: Column, nodes: Sequence[float]) -> Column:
    """0-based index of the last node at or below x; -1 below the first."""
    at = F.array(*[F.lit(float(n)) for n in nodes])
    return (F.size(F.filter(at, lambda n: n <= x)) - 1).cast("int")


def newest_records(df: DataFrame, span_: int, order: Sequence[str], slice_by: Column | FromData | None,
                   keys: Sequence[str]) -> DataFrame:
    return last_records(df, span_, order, slice_by, keys)


def value_at_step_start(df: DataFrame, value: str, step: Sequence[str], slice_by: Column | FromData | None,
                        keys: Sequence[str], name: str = "lagged") -> DataFrame:
    """The value as it stood before the step: what every component reads during it."""
    return lagged(df, {name: value}, step, slice_by, keys)


def not_increasing(df: DataFrame, instant: str, order: Sequence[str], slice_by: Column | FromData | None,
                   keys: Sequence[str]) -> DataFrame:
    """Rows whose instant does not exceed the one before."""
    out = lagged(df, {"previous": instant}, order, slice_by, keys)
    return out.filter(F.col(instant) <= F.col("previous"))


def sequence_numbers(df: DataFrame, order: Sequence[str], slice_by: Column | FromData | None, first: int,
                     keys: Sequence[str] = (), name: str = "sequence") -> DataFrame:
    return numbered(df, order, slice_by, keys, name, first)
