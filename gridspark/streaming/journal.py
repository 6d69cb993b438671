"""The event journal as structured streams; every transformation also runs on a batch DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.operators.ordered import match

# The kinds of event and the fields of each kind's payload.
PAYLOADS = {
    "verdict": ("predicate", "verdict", "statistic", "bracket"),
    "refusal": ("quantity", "site", "reason"),
    "ledger_open": ("ledger", "imbalance", "tolerance", "exchange"),
    "refresh": ("trigger", "field", "change", "restart_seconds", "restart_orbits"),
    "topology_change": ("edit", "level", "cells", "quantity"),
    "level_change": ("from", "to", "window"),
    "artifact": ("key", "kind", "support"),
    "checkpoint": ("key", "precision"),
    "oracle": ("registry_id", "verdict", "statistic", "threshold"),
    "budget": ("cap", "which"),
}


def read_files(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder that match a pattern."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def validate(df: DataFrame, kind: str = "kind", payload: str = "payload", payloads: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """`problem`: null for a kind of the vocabulary whose payload has exactly its fields, else why not."""
    payloads = PAYLOADS if payloads is None else payloads
    table = F.create_map(*[x for k, fields in payloads.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in sorted(fields)]))])
    expected, found = F.element_at(table, F.col(kind)), F.array_sort(F.json_object_keys(payload))
    problem = (
        F.when(expected.isNull(), "unknown kind").when(found.isNull(), "unreadable payload")
        .when(F.size(F.array_except(expected, found)) > 0, "missing field")
        .when(F.size(F.array_except(found, expected)) > 0, "extra field"))
    return df.withColumn("problem", problem)


def run(df: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Drain the stream: append to Parquet under `path`, or hand each batch to `each`."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def split_valid(df: DataFrame, good: str, bad: str) -> None:
    """Valid events to `good`, the rest with their problem to `bad`; a replayed batch rewrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.filter("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{good}/batch={number}")
        kept.filter("problem IS NOT NULL").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        kept.unpersist()

    run(df, f"{good}-run", "append", each)


def windowed(df: DataFrame, instant: str, width: str, keys: Sequence[str], value: str, late: str = "1 day") -> DataFrame:
    """Mean, accumulation and endpoint of each half-open window [t0, t1)."""
    return (
        df.withWatermark(instant, late).groupBy(F.window(instant, width), *keys)
        .agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.max_by(value, instant).alias("endpoint"), F.count(value).alias("n"))
        .select(F.col("window.start").alias("t0"), F.col("window.end").alias("t1"), *keys, "mean", "total", "endpoint", "n"))


def keep_latest(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Drain an updating stream and read the last version of every key."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    run(df, path, "update", each)
    rows = df.sparkSession.read.parquet(path).drop("part")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("_batch")).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def pair_tally(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def first_writes(df: DataFrame, instant: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """One write per key within the watermark; the rest of a key's rows are refused."""
    return df.withWatermark(instant, late).dropDuplicatesWithinWatermark(list(keys))


def refused_writes(written: DataFrame, accepted: DataFrame, identity: str) -> DataFrame:
    return written.join(accepted.select(identity), identity, "left_anti")


def _clocked(stream: DataFrame, path: str, instant: str, late: str, each: Callable[[DataFrame, int, Column], None]) -> None:
    """Drain `stream`, handing `each` a batch, its number and the watermark that held when the batch began.

    The watermark is the latest instant of all earlier batches less `late`, as for a watermarked query, but it is
    kept in a table beside the results: so rows behind it can be told apart instead of vanishing. Each batch
    writes folders of its own number, and a replayed batch sees the same watermark and rewrites them.
    """
    spark = stream.sparkSession
    kind = dict(stream.dtypes)[instant]
    spark.createDataFrame([], f"seen {kind}").write.mode("overwrite").parquet(f"{path}/clock/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        clock = batch.sparkSession.read.schema(f"seen {kind}, batch bigint").parquet(f"{path}/clock").filter(F.col("batch") < number)
        each(kept, number, clock.agg(F.max("seen") - F.expr(f"INTERVAL {late}")).scalar())
        kept.agg(F.max(instant).alias("seen")).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        kept.unpersist()

    run(stream, f"{path}/run", "append", step)


def windowed_with_late(stream: DataFrame, path: str, instant: str, width: str, keys: Sequence[str], value: str,
                       late: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """The windows of `windowed`, and the rows that came too late for theirs (or hold no instant).

    Window counts and late rows add up to the input. May be called again as files arrive; every call drains what
    is new. A batch adds one partial row per window and key, so no state is held and a hot key is pre-aggregated.
    The endpoint is the value at the last instant, the greatest of equals; rows with null keys form a key.
    """
    spark, names = stream.sparkSession, stream.columns

    def each(batch: DataFrame, number: int, mark: Column) -> None:
        dated = batch.filter(F.col(instant).isNotNull()).withColumn("_w", F.window(instant, width))
        dated = dated.withColumn("_late", F.coalesce(F.col("_w.end") <= mark, F.lit(False)))
        part = dated.filter(~F.col("_late")).groupBy("_w", *keys).agg(
            F.sum(value).alias("total"), F.count(value).alias("valued"), F.count(F.lit(1)).alias("n"),
            F.max(F.struct(F.col(instant).alias("at"), F.col(value).alias("v"))).alias("last"))
        part.select(F.col("_w.start").alias("t0"), F.col("_w.end").alias("t1"), *keys, "total", "valued", "n", "last").write.mode(
            "overwrite").parquet(f"{path}/parts/batch={number}")
        gone = dated.filter("_late").select(*names).unionByName(batch.filter(F.col(instant).isNull()))
        gone.write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    _clocked(stream, path, instant, late, each)
    parts = spark.read.parquet(f"{path}/parts")
    windows = parts.groupBy("t0", "t1", *keys).agg(
        (F.sum("total") / F.nullif(F.sum("valued"), F.lit(0))).alias("mean"), F.sum("total").alias("total"),
        F.max("last").alias("_last"), F.sum("n").alias("n"))
    windows = windows.select("t0", "t1", *keys, "mean", "total", F.col("_last.v").alias("endpoint"), "n")
    return windows, spark.read.parquet(f"{path}/late").select(*names)


def first_writes_with_late(stream: DataFrame, path: str, instant: str, keys: Sequence[str], identity: str, late: str = "1 day") -> DataFrame:
    """Every row with its `outcome`: accepted, duplicate of a write within the watermark, or late (no instant: late).

    In a batch the earliest row of a key is accepted, the lowest identity among equals; rows of one identity share
    an outcome. A key may be written anew once its write lies more than `late` behind the watermark, as in `first_writes`.
    Null keys form a key. May be called again as files arrive.
    """
    spark, names = stream.sparkSession, stream.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes) + ", outcome string"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/outcomes/batch=-1")

    def each(batch: DataFrame, number: int, mark: Column) -> None:
        past = F.col(instant).isNull() | F.coalesce(F.col(instant) <= mark, F.lit(False))
        on_time = batch.filter(~past)
        before = batch.sparkSession.read.schema(f"{schema}, batch bigint").parquet(f"{path}/outcomes").filter(
            (F.col("batch") < number) & (F.col("outcome") == "accepted"))
        open_ = F.coalesce(F.col(instant) + F.expr(f"INTERVAL {late}") > mark, F.lit(True))
        held = before.filter(open_).select(*keys).distinct().withColumn("_held", F.lit(True))
        first = on_time.groupBy(*keys).agg(F.min(F.struct(F.col(instant).alias("at"), F.col(identity).alias("id"))).alias("_first"))
        judged = match(match(on_time, first, keys, "left"), held, keys, "left")
        fresh = F.col("_held").isNull() & F.col("_first.id").eqNullSafe(F.col(identity))
        out = judged.select(*names, F.when(fresh, "accepted").otherwise("duplicate").alias("outcome"))
        out.unionByName(batch.filter(past).withColumn("outcome", F.lit("late"))).write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")

    _clocked(stream, path, instant, late, each)
    return spark.read.schema(schema).parquet(f"{path}/outcomes")


def unrecorded(stream: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Stream rows whose name the manifest does not hold."""
    return stream.join(manifest.select(name).distinct(), name, "left_anti")


def reduce_once(stream: DataFrame, path: str, granule: str, keys: Sequence[str], value: Column) -> DataFrame:
    """Batch reduction that counts each piece of a granule once, however often and in whatever batches it is replayed.

    A piece is what one file holds of a granule; a file belongs to one batch, so pieces are never split.
    A batch writes the sums of its new pieces under a name of its own and then records that name, which
    commits sums and pieces together; a part without a record does not exist. Reading takes each piece
    from one recorded part, so regrouped files or a lost progress folder change nothing.
    """
    spark = stream.sparkSession
    piece = [granule, "_file"]
    given = stream.withColumn("_file", F.input_file_name())
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    named = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys([*piece, *keys]))
    total = given.select(F.sum(value).alias("s")).schema["s"].dataType.simpleString()

    def recorded() -> DataFrame:
        parts = spark.read.schema(f"{named}, sum {total}, cnt bigint, part string").parquet(f"{path}/parts")
        return parts.join(spark.read.schema("part string").parquet(f"{path}/records"), "part", "left_semi")

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.join(recorded().select(*piece).distinct(), piece, "left_anti")
        part = uuid.uuid4().hex
        fresh.groupBy(*dict.fromkeys([*piece, *keys])).agg(F.sum(value).alias("sum"), F.count(value).alias("cnt")).write.parquet(f"{path}/parts/part={part}")
        batch.sparkSession.createDataFrame([(part,)], "part string").write.mode("append").parquet(f"{path}/records")

    # Empty first parts, so both can be read before anything is in them.
    none = spark.createDataFrame([], f"{named}, sum {total}, cnt bigint")
    none.write.mode("overwrite").parquet(f"{path}/parts/part=none")
    spark.createDataFrame([], "part string").write.mode("append").parquet(f"{path}/records")
    run(given, f"{path}/run", "append", each)
    rows = recorded()
    first = rows.groupBy(*piece).agg(F.min("part").alias("part"))
    return rows.join(first, [*piece, "part"], "left_semi").groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("cnt").alias("cnt"))


VERDICT_SCHEMA = "loop bigint, records bigint, drift double, balance double, verdict string"


def exit_verdicts(df: DataFrame, loop: str, instant: str, value: str, scale: str, span: int, floor: int,
                  drift_tolerance: float, balance_tolerance: float) -> DataFrame:
    """The exit predicate as keyed state: each loop keeps its last `span` records and its count, nothing more.

    Rows arrive in Arrow chunks and only the newest `span` of them are held, so a hot loop costs time, not memory.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, t, x, s = state.get if state.exists else (0, [], [], [])
        held = pd.DataFrame({"t": list(t), "x": list(x), "s": list(s)})
        for chunk in chunks:
            count += len(chunk)
            new = pd.DataFrame({"t": chunk[instant], "x": chunk[value], "s": chunk[scale]})
            held = pd.concat([held, new] if len(held) else [new]).sort_values("t", kind="stable").tail(span)
        state.update((count, held["t"].tolist(), held["x"].tolist(), held["s"].tolist()))
        drift = balance = None
        if len(held) < span or held["s"].iloc[-1] <= 0:
            verdict = "NotEvaluable"
        else:
            d = held["t"] - held["t"].mean()
            drift = abs(float((d * (held["x"] - held["x"].mean())).sum() / (d * d).sum())) / held["s"].iloc[-1]
            balance = abs(float(held["x"].mean())) / held["s"].iloc[-1]
            verdict = "Converged" if drift <= drift_tolerance and balance <= balance_tolerance else "Refused"
        if count < floor:
            verdict = "Refused"
        yield pd.DataFrame([{"loop": key[0], "records": count, "drift": drift, "balance": balance, "verdict": verdict}])

    return df.select(loop, instant, value, scale).groupBy(loop).applyInPandasWithState(
        step, VERDICT_SCHEMA, "n bigint, t array<double>, x array<double>, s array<double>", "update", GroupStateTimeout.NoTimeout)


def journal_rows(df: DataFrame, kind: str, component: str, instant: Column, tier: str, fields: dict[str, Column]) -> DataFrame:
    """Rows of the journal emitted from a computation; numbering is left to the sink."""
    return df.select(instant.alias("instant"), F.lit(tier).alias("tier"), F.lit(component).alias("component"), F.lit(kind).alias("kind"),
                     F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}).alias("payload"))


def topology_events(edits: DataFrame, instant: float, level: int) -> DataFrame:
    """One topology_change event per edit of `topology_edits`."""
    return journal_rows(edits, "topology_change", "Connectivity", F.lit(float(instant)), "surface", {
        "edit": F.col("edit"), "level": F.lit(level), "cells": F.col("cells"), "quantity": F.col("quantity")})
