"""Every semantics meets every operator with a method or a refusal, and ledgers open when they should."""

import itertools

import pytest
from pyspark.sql import functions as F

from gridspark import contracts
from gridspark.contracts import Refusal, declare
from gridspark.operators import fields


@pytest.fixture(scope="module")
def fine(spark):
    return spark.range(1, 321).select(F.col("id").alias("cell"), (F.col("id") % 17 + 0.5).alias("value"), (F.col("id") % 3 + 1.0).alias("w"),
                                      F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("class"))


@pytest.mark.parametrize("semantics,rule", list(itertools.product(contracts.SEMANTICS, [None, "area_mean", "quantiles"])))
def test_coarsen_closure(fine, semantics, rule):
    df = declare(fine, "class" if semantics == "CategoricalLabel" else "value", semantics=semantics, basis="cartesian")
    column = "class" if semantics == "CategoricalLabel" else "value"
    try:
        out = fields.coarsen(df, column, 1, measure="w", rule=rule, legend=["a", "b"], probabilities=[0.5])
    except Refusal as r:
        assert r.reason
        assert contracts.refusal_reason("coarsen", contracts.declaration(df, column), rule) or (semantics, rule) == ("Intensive", None)
    else:
        assert out.field.count() > 0
        assert (out.ledger is None) == bool(out.not_conserved)
        if out.ledger is not None:
            assert fields.open_ledgers(out.ledger).isEmpty()


@pytest.mark.parametrize("semantics,time", list(itertools.product(contracts.SEMANTICS, contracts.TIME_SEMANTICS)))
def test_time_reduce_closure(fine, semantics, time):
    df = declare(fine.withColumns({"t0": F.lit(0.0), "t1": F.lit(2.0)}), "value", semantics=semantics, time_semantics=time)
    if time in ("Static", "Instantaneous"):
        with pytest.raises(Refusal):
            fields.time_reduce(df, "value")
    else:
        assert fields.time_reduce(df, "value").count() == 320


def test_east_north_is_refused(fine):
    df = declare(fine, "value", semantics="VectorComponent", basis="east_north")
    for call in (lambda: fields.coarsen(df, "value", 1, measure="w"), lambda: fields.refine(df, "value", fine, 1)):
        with pytest.raises(Refusal):
            call()


def test_round_trip_of_extensive(fine):
    df = declare(fine, "value", semantics="Extensive")
    coarse = fields.coarsen(df, "value", 1).field.withColumnRenamed("coarse", "cell")
    back = fields.refine(declare(coarse, "value", semantics="Extensive"), "value", fine.select("cell", "w"), 1, measure="w")
    assert back.field.count() == 320 and fields.open_ledgers(back.ledger).isEmpty()


def test_open_ledger(fine):
    lost = fields.total_ledger(fine, fine.filter("cell <> 7"), "value")
    assert lost.filter("NOT closed").count() == 1
    events = fields.ledger_open_events(lost.withColumns({"crossing": F.lit("c"), "kind": F.lit("receipt")}), "a -> b", 1.0, "surface", "Coupling")
    assert events.count() == 1


def test_exchange_refuses_open_ledgers(spark, fine, tmp_path):
    df = declare(fine, "value", semantics="Extensive")
    good = fields.coarsen(df, "value", 1).field
    given, journal = [], str(tmp_path / "journal")
    cross = lambda q, after: fields.Crossing(q, "value", df, after, ["water"])
    keep = lambda q, frame: given.append(q) or frame
    held, ledgers = fields.exchange([cross("a", good), cross("b", good)], "x -> y", keep, journal, 3, 60.0, "surface")
    assert given == ["a", "b"] and set(held) == {"a", "b"} and ledgers.count() == 4 and fields.open_ledgers(ledgers).isEmpty()
    # an operator that loses some: nothing is delivered, of any quantity
    given.clear()
    with pytest.raises(Refusal):
        fields.exchange([cross("a", good), cross("b", good.filter("coarse > 1"))], "x -> y", keep, journal, 4, 120.0, "surface")
    assert not given
    # readers that lose some: both ledgers are told
    with pytest.raises(Refusal):
        fields.exchange([cross("a", good), cross("b", good)], "x -> y", lambda q, d: d.filter("coarse > 2"), journal, 5, 180.0, "surface")
    rows = [(r["sequence"], r["kind"], '"b operator' in r["payload"]) for r in spark.read.parquet(journal).collect()]
    assert sorted(rows) == [(4, "ledger_open", True), (5, "ledger_open", False), (5, "ledger_open", False)]
    with pytest.raises(Refusal):
        fields.exchange([cross("a", good), cross("a", good)], "x -> y", keep, journal, 6, 1.0, "surface")


def test_reservoir_needs_f64(fine):
    t = fine.agg(F.sum("value").alias("before"), F.sum("value").alias("after"), F.lit(0.0).alias("flux"), F.count("value").alias("n"),
                 F.sum("value").alias("magnitude"))
    with pytest.raises(Refusal):
        fields.ledger(t, "mass", kind="f32", reservoir=True)


def test_combine_contract(fine):
    a = declare(fine, "value", semantics="Extensive")
    with pytest.raises(Refusal):
        fields.combine(a, declare(fine, "value", semantics="Intensive"), "value", 1)
    with pytest.raises(Refusal):
        fields.combine(a, declare(fine.filter("cell > 1"), "value", semantics="Extensive"), "value", 1, check=True)
    assert fields.combine(a, a, "value", -1, check=True).filter("value <> 0").isEmpty()


def test_dimension_algebra():
    length, time = (1, 0, 0, 0, 0), (0, 0, 1, 0, 0)
    assert contracts.quotient(length, time) == (1, 0, -1, 0, 0)
    assert contracts.product(contracts.power(length, 2), time) == (2, 0, 1, 0, 0)
