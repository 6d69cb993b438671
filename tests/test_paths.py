"""Path overlap against every pair."""

import random

import pytest

from gridspark.operators import audit


def overlap(a, b):
    return all(x == y or audit.WILD in (x, y) for x, y in zip(a, b))


@pytest.mark.parametrize("wild", [0.0, 0.3])
def test_affected_equals_every_pair(spark, wild):
    rng = random.Random(int(wild * 10))

    def path():
        return ["common"] * (rng.random() < 0.7) + [audit.WILD if rng.random() < wild else rng.choice("abc") for _ in range(rng.randrange(0, 4))]

    declared = [(rng.choice("xyzw"), path()) for _ in range(60)] + [("v", [audit.WILD, "a"]), ("u", [])]
    changes = [(path(),) for _ in range(50)] + [(["common"],), ([audit.WILD],), ([],)]
    got = audit.affected(spark.createDataFrame(declared, "name string, path array<string>"), spark.createDataFrame(changes, "path array<string>"))
    want = {(tuple(c), n) for (c,) in changes for n, p in declared if overlap(p, c)}
    assert sorted((tuple(r["change"]), r["name"]) for r in got.collect()) == sorted(want)


def test_a_shared_first_step_is_no_join_key(spark):
    declared = spark.createDataFrame([(f"n{i}", ["src", f"f{i}", "x"]) for i in range(3000)], "name string, path array<string>")
    changes = spark.createDataFrame([(["src", f"f{i}"],) for i in range(3000)], "path array<string>")
    out = audit.affected(declared, changes)
    assert out.count() == 3000
