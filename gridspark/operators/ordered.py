"""Ordered (window-like) operators that never put a whole key in one task.

A plain window function sorts every row of a key inside one task, so one key with a third of the
rows is one task with a third of the rows. Here keys are cut into *slices*: by the data itself
(`FromData`), or by any expression that never decreases along the order (an hour, an id range). Rows are windowed inside (key, slice), one
summary row per slice is carried along the key, and the two are joined on (key, slice). The carried
table has one row per slice, never one per input row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridspark.session import settled

SLICE = "_slice"


class FromData:
    """Slices that follow the data: a key of more than `bound` rows is cut at quantiles of its first order column."""

    def __init__(self, parts: int | None = None, bound: int | None = None) -> None:
        self.parts, self.bound = parts or PARTS, bound or BOUND


def time_slice(col: str, seconds: int) -> Column:
    """A slice of fixed length for a TIMESTAMP order column."""
    return F.floor(F.unix_timestamp(F.col(col)) / F.lit(seconds)).cast("bigint")


def id_slice(col: str, rows: int) -> Column:
    """A slice of `rows` consecutive ids for an integral order column."""
    return F.floor(F.col(col) / F.lit(rows)).cast("bigint")


def value_slice(col: str, width: float) -> Column:
    """A slice of fixed width for a numeric order column."""
    return F.floor(F.col(col) / F.lit(float(width))).cast("bigint")


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null equals null, keeping the left copy of the keys.

    Keys that cannot be null are compared plainly, which leaves the join's output partitioned by
    them, so a window or aggregate on the same keys needs no further shuffle.
    """
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        sure = not (left.schema[k].nullable or right.schema[k].nullable)
        term = left[k] == renamed[f"_r_{k}"] if sure else left[k].eqNullSafe(renamed[f"_r_{k}"])
        on = term if on is None else on & term
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


# Values that stand for a missing key, by type; a flag beside them keeps the two apart.
_FILLERS = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`df` with its keys as columns that are never null, and their names."""
    added, names = {}, []
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        if not df.schema[k].nullable:
            names.append(k)
        elif isinstance(kind, T.NumericType) or kind.simpleString() in _FILLERS:
            filler = F.lit(_FILLERS.get(kind.simpleString(), 0)).cast(kind)
            added |= {f"_g{i}": F.coalesce(F.col(k), filler), f"_n{i}": F.col(k).isNull()}
            names += [f"_g{i}", f"_n{i}"]
        else:
            added[f"_g{i}"] = F.struct(k)
            names.append(f"_g{i}")
    return df.withColumns(added) if added else df, names


def _ungrouped(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> list[Column]:
    """The original keys from the columns `_grouped` made of them."""
    out = []
    for i, k in enumerate(keys):
        if k in names:
            out.append(F.col(k))
        elif f"_n{i}" in names:
            out.append(F.when(~F.col(f"_n{i}"), F.col(f"_g{i}")).alias(k))
        else:
            out.append(F.col(f"_g{i}.{k}").alias(k))
    return out


def _made(names: Sequence[str]) -> list[str]:
    """The helper columns among `names`; a key that needed none stays."""
    return [n for n in names if n == SLICE or n[:2] in ("_g", "_n")]


def _before(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number that never decreases along a column; nulls, which come first in the order, come first."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(column).cast("double")
    else:
        number = F.col(column).cast("double")
    return F.coalesce(number, F.lit(float("-inf")))


def _sliced(df: DataFrame, slice_by: Column | FromData | None, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """`df` with its group and slice columns, and the names of the group columns.

    `FromData` cuts hot keys at quantiles of the first order column, so a slice holds its share of a key
    whatever the distribution; rows that tie in that column stay together, and a key has `parts` slices
    at most, so what is carried along it is a bounded window. With no slice expression the rows are range-partitioned by (keys, order), written once to the
    shared folder, and the partition number is the slice: the way for orders whose first column
    may itself be hot, at the price of one write.
    """
    if isinstance(slice_by, FromData):
        kind = df.schema[order[0]].dataType
        if isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            rows, group = _grouped(df, keys)
            cut = cut_by_value(rows.withColumn("_lead", _ordinal(df, order[0])), group, "_lead", SLICE, slice_by.parts, slice_by.bound)
            return cut.drop("_lead"), group
        slice_by = None
    if slice_by is None:
        ranged = df.repartitionByRange(*keys, *order)
        df = settled(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))
        slice_by = F.col(SLICE)
    # rows without a slice come first, as nulls do in the order
    first = F.lit(-(2**63)).cast("bigint") if dict(df.select(slice_by.alias("s")).dtypes)["s"] != "string" else F.lit("")
    return _grouped(df.withColumn(SLICE, F.coalesce(slice_by, first)), keys)


def numbered(
    df: DataFrame,
    order: Sequence[str],
    slice_by: Column | FromData | None,
    keys: Sequence[str] = (),
    name: str = "idx",
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers along `order` within each key, from `start`."""
    s, group = _sliced(df, slice_by, keys, order)
    ks = [*group, SLICE]
    counts = s.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*ks, F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*ks).orderBy(*order))
    out = match(s, offsets, ks).withColumn(name, (local + F.col("_off") + F.lit(start - 1)).cast("bigint"))
    return out.drop("_off", *_made(ks))


def lagged(
    df: DataFrame,
    values: dict[str, str],
    order: Sequence[str],
    slice_by: Column | FromData | None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """For each `{new: source}`, the source value of the previous row of the key; null on the first."""
    s, group = _sliced(df, slice_by, keys, order)
    ks = [*group, SLICE]
    packed = F.struct(*[F.col(src).alias(new) for new, src in values.items()])
    tails = s.groupBy(*ks).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
    carried = tails.select(
        *ks, F.lag("_tail").over(Window.partitionBy(*group).orderBy(SLICE)).alias("_carried")
    )
    local = F.lag(packed).over(Window.partitionBy(*ks).orderBy(*order))
    out = match(s, carried, ks).withColumn("_prev", F.coalesce(local, F.col("_carried")))
    return out.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in values])


def last_known(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    slice_by: Column | FromData | None,
    keys: Sequence[str] = (),
    name: str = "last",
) -> DataFrame:
    """The latest non-null `value` at or before each row of the key."""
    s, group = _sliced(df, slice_by, keys, order)
    ks = [*group, SLICE]
    held = F.col(value).isNotNull()
    tails = s.groupBy(*ks).agg(F.max_by(F.when(held, F.col(value)), F.when(held, F.struct(*order))).alias("_tail"))
    carried = tails.select(*ks, F.last("_tail", ignorenulls=True).over(_before(group)).alias("_carried"))
    upto = Window.partitionBy(*ks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.last(value, ignorenulls=True).over(upto)
    return match(s, carried, ks).withColumn(name, F.coalesce(local, F.col("_carried"))).drop("_carried", *_made(ks))


def running_sum(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    slice_by: Column | FromData | None,
    keys: Sequence[str] = (),
    name: str = "running",
) -> DataFrame:
    """The sum of `value` up to and including each row of the key."""
    s, group = _sliced(df, slice_by, keys, order)
    ks = [*group, SLICE]
    sums = s.groupBy(*ks).agg(F.sum(value).alias("_s"))
    offsets = sums.select(*ks, F.coalesce(F.sum("_s").over(_before(group)), F.lit(0)).alias("_off"))
    upto = Window.partitionBy(*ks).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return match(s, offsets, ks).withColumn(name, F.sum(value).over(upto) + F.col("_off")).drop("_off", *_made(ks))


def last_records(
    df: DataFrame,
    span: int,
    order: Sequence[str],
    slice_by: Column | FromData | None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The last `span` rows of each key, with `back` = 1 on the newest.

    Whole slices that cannot reach the last `span` are dropped before any row is sorted.
    """
    s, group = _sliced(df, slice_by, keys, order)
    ks = [*group, SLICE]
    after = Window.partitionBy(*group).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = s.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.select(*ks, F.coalesce(F.sum("_n").over(after), F.lit(0)).alias("_off")).filter(
        F.col("_off") < span
    )
    newest = [F.col(c).desc() for c in order]
    local = F.row_number().over(Window.partitionBy(*ks).orderBy(*newest))
    out = match(s, kept, ks).withColumn("back", (local + F.col("_off")).cast("bigint"))
    return out.filter(F.col("back") <= span).drop("_off", *_made(ks))


def top_k(df: DataFrame, k: int, order: Sequence[Column], keys: Sequence[str], salts: int = 32,
          salt: Column | None = None) -> DataFrame:
    """The `k` first rows of each key under `order`, as `rank` 1..k.

    Two rounds: the best k of each (key, salt) part, then the best k of those, so a hot key is
    sorted in `salts` tasks and at most salts*k of its rows meet in one.
    """
    part = F.pmod(F.xxhash64(*df.columns) if salt is None else salt, F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", part)
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .drop("_r", "_salt")
        .withColumn("rank", F.row_number().over(final).cast("bigint"))
        .filter(F.col("rank") <= k)
    )


PARTS = 1024           # slices that a key with many different values is cut into
BOUND = 1 << 16        # different values that are ordered together without being cut
_ACCURACY = 10_000     # of the quantile sketch: a cut is off by a ten-thousandth of the key's values at most


def cut_by_value(rows: DataFrame, keys: Sequence[str], value: str, name: str, parts: int = PARTS, bound: int = BOUND) -> DataFrame:
    """`rows` with a slice number that never decreases along `value` within each key.

    The cut points of a key are quantiles of its rows, from a mergeable sketch, so the slices hold about
    as many rows each whatever the distribution; rows of one value stay together. A key of at most
    `bound` rows is one slice, and rows are not dealt out by key to find that. Keys must not be null; with no key there is one set of cuts.
    """
    number, step = F.col(value).cast("double"), max(1, math.isqrt(parts))
    quantiles = F.percentile_approx(number, [i / parts for i in range(1, parts)], _ACCURACY)
    if not keys:
        found = rows.agg(F.count(F.lit(1)).alias("d"), quantiles.alias("cuts")).select(F.struct("d", "cuts")).scalar()
        placed = rows.withColumn("_p", found).withColumns({"_d": F.col("_p.d"), "_cuts": F.when(F.col("_p.d") > bound, F.col("_p.cuts"))}).drop("_p")
    else:
        # keys over the bound are few: their sizes and cuts are written, and rows meet only those
        hot = settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > bound).select(*keys))
        if hot.isEmpty():
            return rows.withColumn(name, F.lit(0).cast("bigint"))
        points = settled(match(rows, hot, keys).groupBy(*keys).agg(quantiles.alias("_cuts")))
        placed = match(rows, points, keys, "left")
    # Every `step`-th cut first, then the cuts between two of those.
    far = step * F.size(F.filter(F.transform(F.sequence(F.lit(step), F.lit(parts - 1), F.lit(step)), lambda i: F.get("_cuts", i - 1)), lambda c: c < number))
    near = F.size(F.filter(F.slice("_cuts", F.col("_far") + 1, step), lambda c: c < number))
    placed = placed.withColumn("_far", F.when(F.col("_cuts").isNotNull(), far if step < parts else F.lit(0)))
    at = F.when(F.col("_cuts").isNotNull(), F.col("_far") + near).otherwise(0)
    return placed.withColumn(name, at.cast("bigint")).drop("_d", "_cuts", "_far")


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, rank_of, parts: int = PARTS, bound: int = BOUND) -> DataFrame:
    """Exact order statistics by counting, in two narrowing passes, for any distribution.

    Equal values collapse to one counted row first, so a hot value costs one row. A key of more than
    `bound` different values is cut at quantiles of them into `parts` slices, which are counted exactly;
    only the slices that hold a wanted rank are ordered. `rank_of(n)` gives an ARRAY of `{tag, rank}`
    structs for a key of n values.
    """
    rows, group = _grouped(df.filter(F.col(value).isNotNull()), keys)
    counted = rows.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = cut_by_value(counted, group, "_v", SLICE, parts, bound)
    per = placed.groupBy(*group, SLICE).agg(F.sum("_c").alias("_s"))
    per = per.withColumn("_n", F.sum("_s").over(Window.partitionBy(*group))).withColumn("_o", F.coalesce(F.sum("_s").over(_before(group)), F.lit(0)))
    hits = F.filter(rank_of(F.col("_n")), lambda w: (w["rank"] > F.col("_o")) & (w["rank"] <= F.col("_o") + F.col("_s")))
    wanted = per.withColumn("_w", hits).filter(F.size("_w") > 0).select(*group, SLICE, F.col("_o").alias("_off"), "_w")
    ks = [*group, SLICE]
    upto = Window.partitionBy(*ks).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = match(placed, wanted, ks).withColumn("_cum", F.sum("_c").over(upto) + F.col("_off"))
    hit = F.filter("_w", lambda w: (w["rank"] > F.col("_cum") - F.col("_c")) & (w["rank"] <= F.col("_cum")))
    return run.select(*group, F.col("_v").alias("value"), F.explode(hit).alias("_h")).select(
        *_ungrouped(run, keys, group), F.col("_h.tag").alias("tag"), F.col("_h.rank").alias("rank"), "value"
    )
