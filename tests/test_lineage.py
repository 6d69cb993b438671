"""Levels and keys of lineage graphs in few rounds, against sequential twins."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridspark import session
from gridspark.operators import audit, graph


def twin_levels(edges):
    names = {x for e in edges for x in e}
    into = {n: {a for a, b in edges if b == n} for n in names}
    level, left = {}, set(names)
    while ready := {n for n in left if not into[n] & left}:
        for n in ready:
            level[n] = max((level[a] + 1 for a in into[n]), default=0)
        left -= ready
    return {n: level.get(n) for n in names}


def twin_keys(runs, edges):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = {n: sha(json.dumps({"code": c, "name": n}, separators=(",", ":"))) for n, c in runs}
    level = twin_levels(edges)
    keys = {n: sha(own[n]) for n in own if level.get(n, 0) == 0}
    for n in sorted((n for n in level if level[n]), key=level.get):
        given = {keys[a] for a, b in edges if b == n and a in keys}
        if given and n in own:
            part = [(k, k) for k in given]
            for width in (9, 6, 3, 0):
                by = {}
                for p, d in sorted(part):
                    by.setdefault(p[:width], []).append(d)
                part = [(q, sha("".join(ds))) for q, ds in by.items()]
            keys[n] = sha(own[n] + part[0][1])
    return keys


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "source bigint, target bigint")


def some_graph(seed):
    r = random.Random(seed)
    edges = {(a, a + 1) for a in range(0, 40)} | {(r.randrange(60), r.randrange(60, 90)) for _ in range(40)}
    edges |= {(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (5, 104), (110, 110), (110, 111)}
    return edges | {(r.randrange(60, 75), r.randrange(75, 90)) for _ in range(15)}


def test_levels_and_keys_equal_the_twins(spark, monkeypatch):
    edges = some_graph(1)
    assert dict(graph.lineage_levels(frame(spark, edges)).collect()) == twin_levels(edges)
    # 7 has no row; 500 has no edge
    runs = [(n, f"v{n % 3}") for n in sorted({x for e in edges for x in e} - {7}) + [500]]
    df = spark.createDataFrame(runs, "name bigint, code string")
    want = twin_keys(runs, edges)
    monkeypatch.setattr(graph, "RUN", 16)
    got = audit.dataset_keys(df, frame(spark, edges), ["name", "code"]).collect()
    assert len(got) == len(dict(got)) and dict(got) == want


def test_empty_and_null_ends(spark):
    none = frame(spark, [])
    assert graph.lineage_levels(none).count() == 0
    runs = spark.createDataFrame([(1, "a")], "name bigint, code string")
    assert audit.dataset_keys(runs, none, ["code"]).count() == 1
    ends = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "source bigint, target bigint")
    assert dict(graph.lineage_levels(ends).collect()) == {3: 0, 4: 1}
    loop = frame(spark, [(1, 2), (2, 1)])
    assert dict(graph.lineage_levels(loop).collect()) == {1: None, 2: None}
    assert audit.dataset_keys(runs, loop, ["code"]).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    for module in (graph, audit):
        real = module.settled
        monkeypatch.setattr(module, "settled", lambda df, real=real: written.append(1) or real(df))
    chain = spark.range(4096).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    levels = graph.lineage_levels(chain)
    assert levels.filter("level = name").count() == 4097 and len(written) < 32
    written.clear()
    runs = spark.range(4097).select(F.col("id").alias("name"), F.lit("a").alias("code"))
    keys = audit.dataset_keys(runs, chain, ["code"])
    assert keys.count() == 4097 and keys.select("key").distinct().count() == 4097 and len(written) < 64


@pytest.mark.parametrize("few", [2, 256])
def test_keys_of_many_inputs_and_of_inputs_with_one_prefix(spark, monkeypatch, few):
    """400 inputs share prefixes of three digits; folded in one row or by prefix, keys are the same."""
    edges = {(a, 1000) for a in range(400)} | {(a, 1001) for a in range(3)} | {(1000, 1002), (1001, 1002), (1002, 1003)}
    runs = [(n, f"v{n % 7}") for n in sorted({x for e in edges for x in e})]
    monkeypatch.setattr(audit, "FEW", few)
    df = spark.createDataFrame(runs, "name bigint, code string")
    got = audit.dataset_keys(df, frame(spark, edges), ["name", "code"]).collect()
    assert len(got) == len(dict(got)) and dict(got) == twin_keys(runs, edges)
    changed = df.withColumn("code", F.when(F.col("name") == 399, "w").otherwise(F.col("code")))
    stored = spark.createDataFrame(got, "name bigint, key string").union(spark.createDataFrame([(5000, "odd")], "name bigint, key string"))
    stale = audit.stale_datasets(changed, frame(spark, edges), ["name", "code"], stored)
    assert sorted(r[0] for r in stale.collect()) == [399, 1000, 1002, 1003, 5000]


def test_little_is_written_for_a_forest(spark, tmp_path, monkeypatch):
    """Bytes written for each edge: a key is written once, as bytes, and attributes shorter than a digest as they are."""
    for module in (session, audit):
        monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    edges = spark.range(8, 40_000).select(F.col("id").alias("source"), F.floor(F.col("id") / 8).alias("target"))
    runs = spark.range(1, 40_000).select(F.col("id").alias("name"), F.lit("a").alias("code"))
    assert audit.dataset_keys(runs, edges, ["name", "code"]).count() == 39_999
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 140 * 40_000


def twin_parts(edges):
    """Names by the set of names they reach and are reached from."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(out.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        reach[n] = seen
    return {frozenset(m for m in reach[n] if n in reach[m]) for n in reach if n in reach[n]}


def test_strong_parts_equal_the_twin(spark):
    r = random.Random(5)
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(75)}
    edges |= {(100 + i, 100 + (i + 1) % 9) for i in range(9)}  # a ring
    edges |= {(200 + i, 201 + i) for i in range(12)} | {(212, 100)}  # a chain into it
    edges |= {(300, 301), (301, 300), (301, 302), (302, 302), (303, 302), (304, 305), (305, 306), (306, 304), (306, 305)}
    got = {}
    for name, part in graph.strong_parts(frame(spark, edges)).collect():
        got.setdefault(part, []).append(name)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {frozenset(v) for v in got.values()} == twin_parts(edges)
    assert graph.strong_parts(frame(spark, [])).count() == 0
