"""Roll-up, drill-down and time reduction whose aggregation follows from what the column means.

Every operation returns its field and, as a second lazy DataFrame, the balance it must close.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.contracts import (
    declaration,
    not_conserved_reason,
    raise_if_any,
    refuse,
    require,
    require_combinable,
    require_meaning,
)
from gridspark.functions import cells, numeric
from gridspark.operators import reduce
from gridspark.operators.ordered import PARTS, match
from gridspark.session import settled

LEDGER = ("quantity", "class", "residual", "tolerance", "losses", "closed")


@dataclass(frozen=True)
class Reduced:
    """A reduced field with its ledger, or the reason it balances nothing."""

    field: DataFrame
    ledger: DataFrame | None
    not_conserved: str | None = None


# Ledgers


def ledger(totals: DataFrame, quantity: str, keys: Sequence[str] = (), losses: dict[str, str] | None = None,
           kind: str = "f64", reservoir: bool = False) -> DataFrame:
    """Ledger rows from columns `before, after, flux, n, magnitude` and named loss columns.

    residual = (after - before) - flux + sum(losses); closed when it is within the rounding bound
    of summing `n` terms of that magnitude. A reservoir must be summed in f64.
    """
    require(not reservoir or kind == "f64", quantity, "ledger", "a reservoir accumulates in f64")
    losses = losses or {}
    lost = sum((F.col(c) for c in losses.values()), F.lit(0.0))
    items = [x for k, c in losses.items() for x in (F.lit(k), F.col(c).cast("double"))]
    table = F.create_map(*items) if items else F.create_map().cast("map<string,double>")
    return (
        totals.withColumn("quantity", F.lit(quantity))
        .withColumn("residual", F.col("after") - F.col("before") - F.col("flux") + lost)
        .withColumn("tolerance", numeric.error_bound(F.col("n"), F.col("magnitude"), kind))
        .withColumn("losses", table)
        .withColumn("closed", F.coalesce(F.abs("residual") <= F.col("tolerance"), F.lit(False)))
        .select("quantity", *keys, "residual", "tolerance", "losses", "closed")
    )


def _totals(before: DataFrame, x: Column, after: DataFrame, y: Column, keys: Sequence[str]) -> DataFrame:
    """Both totals summed exactly, so that a residual is of the operation and not of the order of a sum."""
    b = reduce.exact_sum(before, keys, x, "before", n=F.count("_x"), magnitude=F.sum(F.abs("_x")))
    a = reduce.exact_sum(after, keys, y, "after")
    both = match(b, a, keys, "left") if keys else b.withColumn("after", a.scalar())
    return both.withColumn("flux", F.lit(0.0)).fillna(0.0, ["after", "before", "magnitude"]).fillna(0, ["n"])


def total_ledger(before: DataFrame, after: DataFrame, value: str, after_value: str | None = None,
                 keys: Sequence[str] = (), reservoir: bool = False) -> DataFrame:
    """Balance of the plain total across an operation, one row per trailing key."""
    t = _totals(before, F.col(value).cast("double"), after, F.col(after_value or value), keys)
    return ledger(t, "total", keys, reservoir=reservoir)


def integral_ledger(before: DataFrame, after: DataFrame, value: str, weight: str, after_value: str,
                    after_weight: str, measure: str = "primal_cell_area", keys: Sequence[str] = (),
                    reservoir: bool = False) -> DataFrame:
    """Balance of the integral under a named measure."""
    t = _totals(before, F.col(value) * F.col(weight), after, F.col(after_value) * F.col(after_weight), keys)
    return ledger(t, f"{measure}_integral", keys, reservoir=reservoir)


def open_ledgers(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("closed"))


def conserved_ledgers(rows: DataFrame, name: str, carries: str = "carries") -> DataFrame:
    """Ledger entries whose `carries` array names one conserved quantity."""
    return rows.filter(F.array_contains(carries, name))


# Roll-up


def _coarse(df: DataFrame, depth: int) -> DataFrame:
    return df.withColumn("coarse", cells.ancestor(F.col("cell"), depth))


def coarsen_extensive(df: DataFrame, value: str, depth: int, dims: Sequence[str] = (),
                      reservoir: bool = False) -> Reduced:
    out = reduce.segmented_sum(_coarse(df, depth), ["coarse", *dims], F.col(value), value)
    return Reduced(out, total_ledger(df, out, value, keys=dims, reservoir=reservoir))


def coarsen_mean(df: DataFrame, value: str, measure: str, depth: int, dims: Sequence[str] = (),
                 mask: Column | None = None, measure_name: str = "primal_cell_area",
                 reservoir: bool = False) -> Reduced:
    """Measure-weighted mean; `mask` keeps the rows it selects, and the ledger is of those rows."""
    kept = df if mask is None else df.filter(mask)
    out = reduce.segmented_mean(_coarse(kept, depth), ["coarse", *dims], F.col(value), F.col(measure), value, measure)
    rows = integral_ledger(kept, out, value, measure, value, measure, measure_name, dims, reservoir)
    return Reduced(out, rows)


def coarsen_quantiles(df: DataFrame, value: str, depth: int, probabilities: Sequence[float],
                      dims: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """One column per probability: p0, p1, ... in the order given."""
    keys = ["coarse", *dims]
    tall = reduce.segmented_quantile(_coarse(df, depth), keys, value, probabilities, parts)
    return tall.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(f"p{i}") for i, q in enumerate(probabilities)]
    )


def coarsen_label(df: DataFrame, label: str, measure: str, depth: int, legend: Sequence[str],
                  measure_name: str = "primal_cell_area") -> Reduced:
    """Class shares per coarse cell, with one ledger of the class's area per class of the legend."""
    fine = df.select("cell", F.col(label).alias("class"), F.col(measure).cast("double").alias("_m"))
    out = reduce.class_shares(_coarse(fine, depth), ["coarse"], "class", F.col("_m"), legend)
    t = _totals(fine, F.col("_m"), out, F.col("amount"), ["class"])
    return Reduced(out, ledger(t, f"{measure_name}_integral", ["class"]))


def coarsen_fraction(df: DataFrame, value: str, label: str, measure: str, depth: int,
                     measure_name: str = "primal_cell_area") -> Reduced:
    """Measure-weighted mean of each class column of a table of shares, one ledger per class."""
    return coarsen_mean(df, value, measure, depth, [label], measure_name=measure_name)


def coarsen(df: DataFrame, value: str, depth: int, *, measure: str | None = None, rule: str | None = None,
            legend: Sequence[str] | None = None, probabilities: Sequence[float] = (), mask: Column | None = None,
            label: str = "class", dims: Sequence[str] = (), reservoir: bool = False) -> Reduced:
    """Roll up `value` by `depth` levels the way its declaration says, or refuse at plan time."""
    meta = declaration(df, value)
    require_meaning("coarsen", meta, rule)
    kind = meta["semantics"]
    if kind == "Extensive":
        return coarsen_extensive(df, value, depth, dims, reservoir)
    if kind == "Intensive" and rule == "quantiles":
        out = coarsen_quantiles(df, value, depth, probabilities, dims)
        return Reduced(out, None, not_conserved_reason("coarsen", meta, rule))
    require(measure is not None, value, "coarsen", f"{kind} needs the name of a measure")
    if kind in ("FluxDensity", "Fraction", "VectorComponent") or (kind == "Intensive" and rule == "area_mean"):
        return coarsen_mean(df, value, measure, depth, dims, reservoir=reservoir)
    if kind == "Intensive" and rule == "masked_mean":
        require(mask is not None, value, "coarsen", "a masked mean needs its mask")
        return coarsen_mean(df, value, measure, depth, dims, mask, reservoir=reservoir)
    if kind == "CategoricalLabel":
        require(legend is not None, value, "coarsen", "a label needs its legend")
        return coarsen_label(df, value, measure, depth, legend)
    if kind == "CategoricalFraction":
        return coarsen_fraction(df, value, label, measure, depth)
    return refuse(value, "coarsen", f"{kind} under the rule {rule!r} has no meaning")


# Drill-down


def spread(coarse: DataFrame, depth: int) -> DataFrame:
    """Every descendant takes its ancestor's row; no fine table is needed and nothing is shuffled."""
    kept = [c for c in coarse.columns if c != "cell"]
    return coarse.select(F.explode(cells.descendants(F.col("cell"), depth)).alias("cell"), *kept)


def spread_onto(coarse: DataFrame, fine: DataFrame, depth: int) -> DataFrame:
    """Rows of a fine table beside their ancestor's row."""
    renamed = coarse.withColumnRenamed("cell", "_anc")
    return fine.withColumn("_anc", cells.ancestor(F.col("cell"), depth)).join(renamed, "_anc").drop("_anc")


def share_within_ancestor(fine: DataFrame, weight: str, depth: int, name: str = "share") -> DataFrame:
    """Each fine cell's part of its ancestor's weight; totals are pre-aggregated, never windowed."""
    placed = fine.withColumn("_anc", cells.ancestor(F.col("cell"), depth))
    totals = placed.groupBy("_anc").agg(F.sum(weight).alias("_w"))
    return match(placed, totals, ["_anc"]).withColumn(name, F.col(weight) / F.col("_w")).drop("_anc", "_w")


def refine_extensive(coarse: DataFrame, value: str, fine: DataFrame, weight: str, depth: int) -> Reduced:
    """Split each coarse amount over its fine cells by weight share."""
    shares = share_within_ancestor(fine.select("cell", weight), weight, depth)
    out = spread_onto(coarse.select("cell", value), shares, depth)
    out = out.select("cell", (F.col(value) * F.col("share")).alias(value))
    return Reduced(out, total_ledger(coarse, out, value))


def refine_repeat(coarse: DataFrame, value: str, fine: DataFrame, depth: int, measure: str | None = None,
                  coarse_measure: str | None = None) -> Reduced:
    """Every fine cell takes the coarse value; with measures, the integral must close."""
    names = ["cell", value] if coarse_measure is None else ["cell", value, coarse_measure]
    extra = [] if measure is None else [measure]
    out = spread_onto(coarse.select("cell", value), fine.select("cell", *extra), depth)
    if measure is None:
        return Reduced(out, None, "a repeated state is not an amount")
    return Reduced(out, integral_ledger(coarse.select(*names), out, value, coarse_measure, value, measure))


def refine(coarse: DataFrame, value: str, fine: DataFrame, depth: int, *, measure: str | None = None,
           coarse_measure: str | None = None) -> Reduced:
    meta = declaration(coarse, value)
    require_meaning("refine", meta)
    kind = meta["semantics"]
    if kind == "Extensive":
        require(measure is not None, value, "refine", "splitting an amount needs a fine measure")
        return refine_extensive(coarse, value, fine, measure, depth)
    if kind in ("FluxDensity", "Fraction"):
        require(measure is not None and coarse_measure is not None, value, "refine", f"{kind} needs both measures")
        return refine_repeat(coarse, value, fine, depth, measure, coarse_measure)
    return refine_repeat(coarse, value, fine, depth)


# Time


def time_mean(df: DataFrame, keys: Sequence[str], value: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Duration-weighted mean over a contiguous series."""
    d = F.col(t1) - F.col(t0)
    return reduce.segmented_mean(df, keys, F.col(value), d, value, "duration")


def time_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return reduce.segmented_sum(df, keys, F.col(value), value)


def time_endpoint(df: DataFrame, keys: Sequence[str], value: str, t1: str = "t1") -> DataFrame:
    """The state at the end of the last interval."""
    return df.groupBy(*keys).agg(F.max_by(value, t1).alias(value))


def time_reduce(df: DataFrame, value: str, keys: Sequence[str] = ("cell",), t0: str = "t0", t1: str = "t1") -> DataFrame:
    meta = declaration(df, value)
    require_meaning("time_reduce", meta)
    if meta["time_semantics"] == "IntervalMean":
        return time_mean(df, keys, value, t0, t1)
    if meta["time_semantics"] == "IntervalAccumulation":
        return time_total(df, keys, value)
    return time_endpoint(df, keys, value, t1)


# Pairs of fields


def combine(a: DataFrame, b: DataFrame, value: str, sign: int, keys: Sequence[str] = ("cell",),
            check: bool = False) -> DataFrame:
    """Elementwise a + sign*b on one support; both sides must hold the same cells."""
    require(sign in (1, -1), "sign", "combine", f"{sign} is neither 1 nor -1")
    require_combinable(declaration(a, value), declaration(b, value), "combine")
    other = b.select(*keys, F.col(value).alias("_b"))
    if check:
        raise_if_any(unmatched(a, other, keys), value, "combine")
    return match(a, other, keys).select(*keys, (F.col(value) + sign * F.col("_b")).alias(value))


def unmatched(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """Keys held by one side only, with the side."""
    left = a.select(*keys).withColumn("_a", F.lit(1))
    right = b.select(*keys).withColumn("_b", F.lit(1))
    both = left.join(right, list(keys), "full")
    return both.filter(F.col("_a").isNull() | F.col("_b").isNull()).select(
        *keys, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side")
    )


def reconcile(sent: DataFrame, received: DataFrame, value: str, keys: Sequence[str] = ("cell",),
              tolerance: float = 0.0) -> DataFrame:
    """What the reader holds against what the writer handed over, one row per cell of either."""
    s = sent.select(*keys, F.col(value).alias("sent"))
    r = received.select(*keys, F.col(value).alias("received"))
    both = s.join(r, list(keys), "full")
    gap = F.abs(F.col("sent") - F.col("received"))
    status = (
        F.when(F.col("sent").isNull(), "unsent").when(F.col("received").isNull(), "lost")
        .when(gap <= tolerance, "equal").otherwise("differs")
    )
    return both.withColumn("status", status)


def _crossing_ledger(before: DataFrame, after: DataFrame, value: str, quantity: str, carries: Sequence[str], kind: str) -> DataFrame:
    named = F.array(*[F.lit(c) for c in carries]) if carries else F.array().cast("array<string>")
    return total_ledger(before, after, value).withColumns({"kind": F.lit(kind), "crossing": F.lit(quantity), "carries": named})


def exchange_ledgers(sent: DataFrame, delivered: DataFrame, received: DataFrame, value: str, quantity: str,
                     carries: Sequence[str]) -> DataFrame:
    """Operator and receipt ledgers of one crossing: fine amount -> handed over -> held by the reader."""
    return _crossing_ledger(sent, delivered, value, quantity, carries, "operator").unionByName(
        _crossing_ledger(delivered, received, value, quantity, carries, "receipt"))


@dataclass
class Crossing:
    """One quantity of an exchange: what the writer holds, what the operator hands over, what it carries."""

    quantity: str
    value: str
    sent: DataFrame
    delivered: DataFrame
    carries: Sequence[str] = ()


def exchange(crossings: Sequence[Crossing], name: str, deliver: Callable[[str, DataFrame], DataFrame], journal: str,
             sequence: int, instant: float, tier: str, component: str = "Coupling") -> tuple[dict[str, DataFrame], DataFrame]:
    """Hand every crossing over: (what the reader holds of each quantity, the ledgers of both kinds).

    `deliver(quantity, frame)` gives a quantity to the reader and returns what the reader then holds. The operator
    ledgers of all crossings are settled first: where one is open, nothing is delivered. The receipt ledgers
    follow. Every open ledger of a kind is appended to the table at `journal` as a `ledger_open` event, and
    the exchange is refused. Ledgers are one small row a crossing.
    """
    require(bool(crossings), name, "exchange", "no quantity crosses")
    names = [c.quantity for c in crossings]
    require(len(set(names)) == len(names), name, "exchange", "a quantity crosses twice")

    def settle(rows: list[DataFrame]) -> DataFrame:
        ledgers = settled(fold(lambda a, b: a.unionByName(b), rows))
        if not open_ledgers(ledgers).isEmpty():
            events = ledger_open_events(ledgers, name, instant, tier, component).withColumn("sequence", F.lit(sequence).cast("bigint"))
            events.write.mode("append").parquet(journal)
            raise_if_any(open_ledgers(ledgers).select("crossing", "kind", "residual", "tolerance"), name, "exchange")
        return ledgers

    operator = settle([_crossing_ledger(c.sent, c.delivered, c.value, c.quantity, c.carries, "operator") for c in crossings])
    held = {c.quantity: deliver(c.quantity, c.delivered) for c in crossings}
    receipt = settle([_crossing_ledger(c.delivered, held[c.quantity], c.value, c.quantity, c.carries, "receipt") for c in crossings])
    return held, operator.unionByName(receipt)


def ledger_open_events(rows: DataFrame, exchange: str, instant: float, tier: str, component: str) -> DataFrame:
    """The journal rows an open ledger raises."""
    return open_ledgers(rows).select(
        F.lit(float(instant)).alias("instant"), F.lit(tier).alias("tier"), F.lit(component).alias("component"),
        F.lit("ledger_open").alias("kind"),
        F.to_json(F.struct(
            F.concat_ws(" ", "crossing", "kind", "quantity").alias("ledger"), F.col("residual").alias("imbalance"),
            F.col("tolerance"), F.lit(exchange).alias("exchange"))).alias("payload"),
    )


# Vectors


def lift_columns(df: DataFrame, east: str, north: str, lat: str, lon: str) -> DataFrame:
    x, y, z = numeric.lift(F.col(east), F.col(north), F.col(lat), F.col(lon))
    return df.withColumns({"x": x, "y": y, "z": z})


def project_columns(df: DataFrame, lat: str, lon: str) -> DataFrame:
    e, n = numeric.project((F.col("x"), F.col("y"), F.col("z")), F.col(lat), F.col(lon))
    return df.withColumns({"east_back": e, "north_back": n})


def round_trip(df: DataFrame, east: str, north: str, lat: str, lon: str) -> DataFrame:
    """Largest loss of lift then project against the rounding bound of its sums: one row."""
    back = project_columns(lift_columns(df, east, north, lat, lon), lat, lon)
    gap = F.greatest(F.abs(F.col(east) - F.col("east_back")), F.abs(F.col(north) - F.col("north_back")))
    size = F.abs(F.col(east)) + F.abs(F.col(north))
    out = back.agg(F.max(gap).alias("worst"), F.max(size).alias("largest"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("lossless", F.col("worst") <= numeric.error_bound(F.lit(16), F.col("largest")))
