"""Observation recipes: masked accumulators, climatologies, modal classes, site statistics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridspark.contracts import raise_if_any, require
from gridspark.operators.ordered import match
from gridspark.operators.reduce import segmented_median
from gridspark.sources.tables import create_once

# The stored fill and valid range of a reading, and its scale.
READING_FILL, READING_LOW, READING_HIGH, READING_SCALE = 32767, 0, 32766, 0.001
FEET = 0.3048  # fixed value: metres in a foot


def mask_observations(df: DataFrame, raw: str, qa: str, snow: str, qa_fill: int, qa_all: int,
                      qa_snowfree: int) -> DataFrame:
    """One row per (reading, variant that admits it) with its scaled value; the scan is read once.

    `all` keeps readings of quality at or better than qa_all; `snowfree` needs qa_snowfree and zero snow.
    """
    valid = (F.col(raw) != READING_FILL) & F.col(raw).between(READING_LOW, READING_HIGH)
    known = F.col(qa) != qa_fill
    admits = {
        "all": known & (F.col(qa) <= qa_all),
        "snowfree": known & (F.col(qa) <= qa_snowfree) & (F.col(snow) == 0),
    }
    variants = F.filter(F.array(*[F.when(ok, F.lit(v)) for v, ok in admits.items()]), lambda v: v.isNotNull())
    return (
        df.filter(valid)
        .withColumn("variant", F.explode(variants))
        .withColumn("value", F.col(raw) * READING_SCALE)
    )


def monthly_accumulate(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("sum"), F.count(value).alias("cnt"))


def block_sums(df: DataFrame, keys: Sequence[str], row: str, col: str, value: str, valid: Column,
               size: int = 5) -> DataFrame:
    """Sum and count of the valid readings of each size x size block."""
    return df.groupBy(*keys, F.floor(F.col(row) / size).alias("block_row"), F.floor(F.col(col) / size).alias("block_col")).agg(
        F.sum(F.when(valid, F.col(value)).otherwise(0.0)).alias("sum"), F.sum(valid.cast("bigint")).alias("cnt"))


def climatology(acc: DataFrame) -> DataFrame:
    """Mean where anything was counted, null elsewhere, with the count beside it."""
    return acc.withColumn("mean", F.when(F.col("cnt") > 0, F.col("sum") / F.col("cnt")))


def over_ceiling(acc: DataFrame, granules: DataFrame, keys: Sequence[str], month: str = "month", factor: int = 1) -> DataFrame:
    """Cells whose count exceeds the granules behind their month: how many, and the largest."""
    joined = acc.join(granules.withColumnRenamed("n", "_n"), month)
    over = joined.withColumn("ceiling", F.col("_n") * factor).filter(F.col("cnt") > F.col("ceiling"))
    return over.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.max("cnt").alias("largest"), F.max("ceiling").alias("ceiling"))


def retract(acc: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accumulators less a delta; an emptied cell has sum zero. `refused` marks a count below its delta."""
    d = delta.select(*keys, F.col("sum").alias("_ds"), F.col("cnt").alias("_dc"))
    both = match(acc, d, keys, "left").fillna({"_ds": 0.0, "_dc": 0})
    left = F.col("cnt") - F.col("_dc")
    return both.select(
        *keys, F.when(left == 0, F.lit(0.0)).otherwise(F.col("sum") - F.col("_ds")).alias("sum"),
        left.alias("cnt"), (left < 0).alias("refused"))


def modal_class(df: DataFrame, cell: Sequence[str], label: str) -> DataFrame:
    """The commonest class of each cell, the lowest class among equals, with the rows behind it."""
    counts = df.groupBy(*cell, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(label, F.struct(-F.col("_n"), F.col(label)))
    return counts.groupBy(*cell).agg(best.alias("modal"), F.sum("_n").alias("valid"))


def qa_histogram(df: DataFrame, granule: str, qa: str, snow: str, qa_fill: int, codes: Sequence[int]) -> DataFrame:
    """Readings of each quality code per granule and the share of snow-free readings."""
    known = F.col(qa) != qa_fill
    return df.groupBy(granule).agg(
        *[F.sum((known & (F.col(qa) == c)).cast("bigint")).alias(f"qa_{c}") for c in codes],
        F.avg((F.col(snow) == 0).cast("double")).alias("snow_zero_frac"))


def normalise_datum(value: Column, datum: Column, land: Column, reference: Column) -> Column:
    """Depth below land from a reading against its declared datum; null for an unknown datum."""
    return (
        F.when(datum == "DTW", value).when(datum == "RSWL", land - value).when(datum == "SWL", value - (reference - land))
    )


def sanity_window(df: DataFrame, value: str, lo: float, hi: float, coordinates: Sequence[str] = ()) -> DataFrame:
    """Rows with a value strictly inside (lo, hi) and every coordinate present."""
    ok = (F.col(value) > lo) & (F.col(value) < hi)
    return df.filter(fold(lambda a, c: a & F.col(c).isNotNull(), coordinates, ok))


def window_counts(df: DataFrame, value: str, lo: float, hi: float, keys: Sequence[str]) -> DataFrame:
    ok = (F.col(value) > lo) & (F.col(value) < hi)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("usable"))


def unit_filter_convert(df: DataFrame, text: str, unit: Column, keep: str, name: str = "metres") -> DataFrame:
    """Rows in one unit whose text is a number, converted to metres."""
    number = F.expr(f"try_cast({text} AS DOUBLE)")
    return df.filter((unit == keep) & number.isNotNull()).withColumn(name, number * FEET)


def nominal_date(name: Column) -> Column:
    """The date of an AYYYYDDD token in a granule name."""
    token = F.regexp_extract(name, r"\.A(\d{7})", 1)
    start = F.make_date(F.substring(token, 1, 4).cast("int"), F.lit(1), F.lit(1))
    return F.when(token != "", F.date_add(start, F.substring(token, 5, 3).cast("int") - 1))


def declared_window(df: DataFrame, date: str, lo: str, hi: str, months: Sequence[int]) -> DataFrame:
    return df.filter(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) & F.month(date).isin(*months))


def site_statistics(df: DataFrame, site: str, value: str, when: str, good: Column, datum: str, ddof: int = 1) -> DataFrame:
    """n, first, last, mean, median, sd, good share and counts by datum (a map) per site.

    The recipes differ in their standard deviation: ddof 1 is the sample form, 0 the population form.
    """
    require(ddof in (0, 1), "ddof", "site_statistics", f"{ddof} is neither 0 nor 1")
    sd = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    stats = df.groupBy(site).agg(
        F.count(value).alias("n"), F.min(when).alias("first"), F.max(when).alias("last"), F.avg(value).alias("mean"),
        sd.alias("sd"), F.avg(good.cast("double")).alias("frac_good"))
    tally = df.groupBy(site, datum).agg(F.count(F.lit(1)).alias("_n"))
    maps = tally.groupBy(site).agg(F.map_from_entries(F.collect_list(F.struct(F.col(datum), F.col("_n")))).alias("n_by_datum"))
    median = segmented_median(df, [site], value)
    return match(match(stats, median, [site], "left"), maps, [site], "left")


def union_sites(tables: Sequence[DataFrame]) -> DataFrame:
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def names_difference(used: DataFrame, declared: DataFrame, name: str) -> DataFrame:
    """Names only one side knows, with the problem."""
    a, b = used.select(name).distinct(), declared.select(name).distinct()
    return a.subtract(b).withColumn("problem", F.lit("undeclared")).unionByName(
        b.subtract(a).withColumn("problem", F.lit("unread")))


def compare_manifests(old: DataFrame, new: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """Status of every name: absent (old only), extra (new only), changed, same."""
    a = old.select(F.col(name), F.struct(*attributes).alias("_a"))
    b = new.select(F.col(name), F.struct(*attributes).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "absent").when(F.col("_a").isNull(), "extra")
        .when(F.col("_a") == F.col("_b"), "same").otherwise("changed"))
    return a.join(b, name, "full").select(name, status.alias("status"))


def payload_hits(payloads: DataFrame, manifests: DataFrame, digest: str, manifest: str) -> DataFrame:
    """How many of each manifest's digests are among the payload's."""
    return manifests.join(payloads.select(digest).distinct(), digest, "left_semi").groupBy(manifest).agg(
        F.countDistinct(digest).alias("hits"))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside_not_excluded(granules: DataFrame, date: str, lo: str, hi: str, excluded: DataFrame, name: str) -> DataFrame:
    outside = granules.filter(~F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return outside.join(excluded.select(name).distinct(), name, "left_anti")


def calendar_gaps(df: DataFrame, date: str, lo: str, hi: str) -> DataFrame:
    """Days of the declared window with no granule."""
    days = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).alias(date))
    return days.join(df.select(date).distinct(), date, "left_anti")


VERSION_SCHEMA = "version int, schema string, replaced array<int>, months array<struct<month: int, path: string>>"


def _versions(spark: SparkSession, root: str) -> list[Row]:
    lines = spark.read.text(f"{root}/versions", pathGlobFilter="*.json")
    return lines.select(F.from_json("value", VERSION_SCHEMA).alias("r")).filter("r.version IS NOT NULL").select("r.*").orderBy("version").collect()


def _commit_version(spark: SparkSession, root: str, version: int, schema: str, months: dict[int, str], replaced: Sequence[int], site: str) -> None:
    text = json.dumps({"version": version, "schema": schema, "replaced": list(replaced), "months": [{"month": m, "path": p} for m, p in sorted(months.items())]})
    require(create_once(spark, f"{root}/versions/{version:08d}.json", text), root, site, f"version {version} was committed by another writer")


def _write_months(df: DataFrame, root: str) -> str:
    path = f"{root}/data/{uuid.uuid4().hex}"
    df.repartition("month").write.partitionBy("month").parquet(path)
    return path


def write_periods(extract: DataFrame, root: str) -> None:
    """An extract with a `month` column as version 0 of a table whose versions name the folder of each month."""
    spark = extract.sparkSession
    require(extract.filter("month IS NULL").isEmpty(), "month", "write_periods", "a row has no month")
    path = _write_months(extract, root)
    held = [r["month"] for r in spark.read.schema(extract.schema).parquet(path).select("month").distinct().collect()]
    _commit_version(spark, root, 0, extract.schema.json(), {m: path for m in held}, [], "write_periods")


def read_periods(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default."""
    found = [r for r in _versions(spark, root) if version is None or r["version"] == version]
    require(bool(found), root, "read_periods", "no such version is committed")
    schema = StructType.fromJson(json.loads(found[-1]["schema"]))
    by_path: dict[str, list[int]] = {}
    for m in found[-1]["months"]:
        by_path.setdefault(m["path"], []).append(m["month"])
    parts = [spark.read.schema(schema).parquet(p).filter(F.col("month").isin(months)).select(*schema.names) for p, months in by_path.items()]
    return fold(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], schema)


def granules_differ(extract: DataFrame, source: DataFrame) -> DataFrame:
    """(granule, status) where two manifests (granule, bytes, sha256) disagree: absent from either, or other contents."""
    key = F.struct("bytes", "sha256")
    a = extract.select("granule", key.alias("_a")).distinct()
    b = source.select("granule", key.alias("_b")).distinct()
    both = a.join(b, "granule", "full")
    status = (F.when(F.col("_b").isNull(), "absent from the source").when(F.col("_a").isNull(), "absent from the extract")
              .when(~F.col("_a").eqNullSafe(F.col("_b")), "other contents"))
    return both.select("granule", status.alias("status")).filter("status IS NOT NULL")


def replace_periods(root: str, replacement: DataFrame, rules: dict, source_rules: dict, granules: DataFrame,
                    source_granules: DataFrame, ceiling_keys: Sequence[str], factor: int = 1) -> DataFrame:
    """Whole months of the table at `root` replaced by those the source declares; returns the new version.

    `rules` of the table and of the source agree in all but `months`, which the source states; `window` is
    (first day, last day). The source's granules are those of the table that lie in the window and in those
    months, with the same bytes and digests, and no count exceeds the granules behind its month. Anything
    else is refused before data are written, as are months replaced before and rows of other months. The months are
    written to a folder of their own and become current by one numbered commit, which one writer can make:
    what other months or versions hold is never rewritten, so a failed replacement loses nothing.
    """
    spark, site = replacement.sparkSession, "replace_periods"
    require("months" in source_rules, "months", site, "the source declares no months")
    for name in sorted(set(rules) - {"months"}):
        require(source_rules.get(name) == rules[name], name, site, "differs between the two sets of rules")
    months = sorted(source_rules["months"])
    versions = _versions(spark, root)
    require(bool(versions), root, site, "no version is committed")
    newest = versions[-1]
    require(not any(v["replaced"] for v in versions), "months", site, "months have been replaced already")
    raise_if_any(replacement.filter(~F.coalesce(F.col("month").isin(months), F.lit(False))), "months", site)
    lo, hi = rules["window"]
    mine = granules.filter(F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")) & F.month("day").isin(months))
    raise_if_any(granules_differ(mine, source_granules), "granules", site)
    per_month = source_granules.groupBy(F.month("day").alias("month")).agg(F.countDistinct("granule").alias("n"))
    raise_if_any(over_ceiling(replacement, per_month, ceiling_keys, factor=factor), "count ceiling", site)
    current = {m["month"]: m["path"] for m in newest["months"] if m["month"] not in months}
    schema = StructType.fromJson(json.loads(newest["schema"]))
    path = _write_months(replacement.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]), root)
    current |= {m: path for m in months}
    _commit_version(spark, root, newest["version"] + 1, newest["schema"], current, months, site)
    return read_periods(spark, root)
