"""Declared reads, refusing writes, streams over several batches, and the plans behind them."""

import pytest
from pyspark.sql import functions as F

from gridspark.contracts import Refusal, declare
from gridspark.operators import fields, observations
from gridspark.sources import tables
from gridspark.streaming import journal

EXPECTED = {"semantics": "Extensive", "time_semantics": "Static", "dimension": [1, 0, 0, 0, 0], "support_id": "s", "owner": "o", "interval": [0.0, 60.0]}


def field(spark):
    df = spark.range(1, 321).select(F.col("id").alias("cell"), F.lit(1.0).alias("value"))
    return declare(df, "value", semantics="Extensive", dimension=(1, 0, 0, 0, 0), support_id="s", owner="o", interval=(0.0, 60.0))


def test_contracted_read(spark, tmp_path):
    path = str(tmp_path / "f")
    field(spark).write.parquet(path)
    assert tables.read_contracted(spark, path, "value", EXPECTED).count() == 320
    for name, wrong in (("semantics", "Intensive"), ("interval", [0.0, 61.0]), ("owner", "p")):
        with pytest.raises(Refusal):
            tables.read_contracted(spark, path, "value", EXPECTED | {name: wrong})
    spark.range(3).withColumn("value", F.lit(1.0)).write.parquet(str(tmp_path / "g"))
    with pytest.raises(Refusal):
        tables.read_contracted(spark, str(tmp_path / "g"), "value", EXPECTED)


def test_put_dataset(spark, tmp_path):
    root, inputs = str(tmp_path), {"code": "1", "cells": 320}
    out = fields.coarsen(field(spark), "value", 1)
    path = tables.put_dataset(out.field, root, inputs, out.ledger)
    assert spark.read.parquet(path).agg(F.sum("value")).first()[0] == 320.0
    with pytest.raises(Refusal):
        tables.put_dataset(out.field, root, dict(reversed(inputs.items())), out.ledger)
    lost = fields.total_ledger(field(spark), out.field.filter("coarse > 1"), "value")
    with pytest.raises(Refusal):
        tables.put_dataset(out.field, root, {"code": "2"}, lost)
    assert tables.read_manifest(spark, root).count() == 1


def test_clusters_stay_together(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.clustered_write(spark.range(1, 5121).withColumnRenamed("id", "cell").repartition(7), path, 3, 4)
    spans = sorted((r["lo"], r["hi"]) for r in tables.written_files(spark, path, "cell").collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "b.txt").write_text("bb")
    found = tables.file_manifest(spark, str(tmp_path), "*.txt")
    listed = spark.createDataFrame([("a.txt", 1, "0"), ("c.txt", 1, "0")], "path string, bytes bigint, sha256 string")
    assert dict(tables.verify_manifest(found, listed).collect()) == {"a.txt": "sha256 differs", "b.txt": "extra", "c.txt": "absent"}


def test_two_writers_of_one_key_leave_one_dataset(spark, tmp_path, monkeypatch):
    root, inputs, real = str(tmp_path / "s"), {"code": "1"}, tables.create_once
    ones, twos = spark.range(5), spark.range(7)

    def overtaken(session, path, text):  # another writer commits while this one writes
        if path.endswith(".json"):
            monkeypatch.setattr(tables, "create_once", real)
            tables.put_dataset(twos, root, inputs)
        return real(session, path, text)

    monkeypatch.setattr(tables, "create_once", overtaken)
    with pytest.raises(Refusal):
        tables.put_dataset(ones, root, inputs)
    rows = tables.read_manifest(spark, root).collect()
    assert len(rows) == 1 and spark.read.parquet(rows[0]["path"]).count() == 7
    assert tables.read_manifest(spark, str(tmp_path / "none")).count() == 0


RULES = {"window": ["2001-01-01", "2001-12-31"], "all_variant": "a"}


def months_table(spark, tmp_path):
    root = str(tmp_path / "x")
    observations.write_periods(spark.createDataFrame([("a", 1, 5.0, 1), ("a", 2, 6.0, 1), ("b", 2, 1.0, 1)], ACC), root)
    days = [("g1", "2001-01-05"), ("g2", "2001-02-05"), ("g3", "2001-02-06"), ("old", "1999-02-01")]
    listed = spark.createDataFrame([(g, 1, g, d) for g, d in days], MANIFEST).withColumn("day", F.to_date("day"))
    return root, listed


ACC, MANIFEST = "variant string, month int, sum double, cnt bigint", "granule string, bytes bigint, sha256 string, day string"


def test_replace_months(spark, tmp_path):
    root, listed = months_table(spark, tmp_path)
    source = listed.filter("granule IN ('g2', 'g3')")
    new = spark.createDataFrame([("a", 2, 7.0, 2)], ACC)
    stated = RULES | {"months": [2]}
    empty = listed.limit(0)
    rest = {"rules": RULES, "source_rules": stated, "granules": listed, "source_granules": source, "ceiling_keys": ["variant"]}
    other = source.withColumn("sha256", F.lit("?"))
    wrong = [{"source_rules": RULES}, {"source_rules": stated | {"all_variant": "b"}}, {"source_granules": empty},
             {"source_granules": listed}, {"source_granules": other}, {"source_granules": source.filter("granule = 'g2'")}]
    for change in wrong:
        with pytest.raises(Refusal):
            observations.replace_periods(root, new, **(rest | change))
    for bad in ([("a", 3, 7.0, 1)], [("a", 2, 7.0, 3)], [("a", None, 7.0, 1)]):  # another month, above the ceiling, no month
        with pytest.raises(Refusal):
            observations.replace_periods(root, spark.createDataFrame(bad, ACC), **rest)
    assert observations.read_periods(spark, root).count() == 3
    out = observations.replace_periods(root, new, **rest)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 5.0, 1), ("a", 2, 7.0, 2)]
    assert observations.read_periods(spark, root, 0).count() == 3
    with pytest.raises(Refusal):
        observations.replace_periods(root, new, **rest)


def test_a_replacement_that_fails_or_loses_keeps_every_month(spark, tmp_path, monkeypatch):
    root, listed = months_table(spark, tmp_path)
    source = listed.filter("granule IN ('g2', 'g3')")
    before = sorted(map(tuple, observations.read_periods(spark, root).collect()))
    args = (RULES, RULES | {"months": [2]}, listed, source, ["variant"])
    broken = spark.createDataFrame([("a", 2, 7.0, 1)], ACC).withColumn("sum", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        observations.replace_periods(root, broken, *args)
    assert sorted(map(tuple, observations.read_periods(spark, root).collect())) == before
    good = spark.createDataFrame([], ACC)
    real = observations.create_once
    monkeypatch.setattr(observations, "create_once", lambda s, path, text: real(s, path, text) and real(s, path, text))
    with pytest.raises(Refusal):
        observations.replace_periods(root, good, *args)
    monkeypatch.setattr(observations, "create_once", real)
    # the first of the two creations won: month 2 is now without rows, month 1 as it was
    assert [tuple(r) for r in observations.read_periods(spark, root).collect()] == [("a", 1, 5.0, 1)]


def test_write_with_geometry(spark, tmp_path):
    df, path = spark.range(1, 81).select(F.col("id").alias("cell"), F.lit(2.0).alias("flux")), str(tmp_path / "g")
    tables.write_with_geometry(df, 1, path, {"flux": "W m-2"}, "s", 2.0)
    back = spark.read.parquet(path)
    assert back.schema["flux"].metadata == {"units": "W m-2", "location": "face"} and back.schema["cell"].metadata["radius"] == 2.0
    assert back.count() == 80 and abs(back.agg(F.sum("area")).first()[0] - 16 * 3.141592653589793) < 1e-9
    bad = [(df, path), (df.withColumnRenamed("flux", "area"), path + "1"), (df.union(df), path + "2"),
           (df.select((F.col("cell") + 1).alias("cell"), "flux"), path + "3")]
    for rows, to in bad:
        with pytest.raises(Exception, match="already exists|refused|geometry|example"):
            tables.write_with_geometry(rows, 1, to, {}, "s")


@pytest.fixture()
def pieces(spark, sf, tmp_path):
    """The events table as nine files, out of time order, so a stream takes nine batches."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(9, "event_id").write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events"), rows


def test_streams_equal_batch(spark, pieces, tmp_path):
    folder, rows = pieces
    live = lambda: journal.read_files(spark, folder, "*.parquet", files_per_batch=1)
    tally = journal.keep_latest(journal.pair_tally(live(), "user_id", "event_type"), str(tmp_path / "t"), ["user_id", "event_type"])
    assert sorted(map(tuple, tally.collect())) == sorted(map(tuple, journal.pair_tally(rows, "user_id", "event_type").collect()))
    got = journal.windowed(live(), "ts", "6 hours", ["event_type"], "value", "60 days")
    got = journal.keep_latest(got, str(tmp_path / "w"), ["t0", "t1", "event_type"]).select("t0", "event_type", "n", "endpoint")
    want = journal.windowed(rows, "ts", "6 hours", ["event_type"], "value", "60 days").select("t0", "event_type", "n", "endpoint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_exit_verdicts_keep_the_newest(spark, pieces, tmp_path):
    folder, rows = pieces
    shape = lambda d: d.select("user_id", F.unix_micros("ts").cast("double").alias("t"), "value", F.lit(1.0).alias("s"))
    live = journal.exit_verdicts(shape(journal.read_files(spark, folder, "*.parquet", 1)), "user_id", "t", "value", "s", 5, 1, 1.0, 1.0)
    got = {r["loop"]: (r["records"], round(r["balance"], 9)) for r in journal.keep_latest(live, str(tmp_path / "v"), ["loop"]).collect()}
    by = {}
    for r in shape(rows).orderBy("t").collect():
        by.setdefault(r["user_id"], []).append(r["value"])
    assert got == {u: (len(v), round(abs(sum(v[-5:]) / 5), 9)) for u, v in by.items()}


def test_replay_changes_nothing(spark, pieces, tmp_path):
    folder, rows = pieces
    path = str(tmp_path / "r")
    live = lambda: journal.read_files(spark, folder, "*.parquet", 3)
    once = journal.reduce_once(live(), path, "event_id", ["user_id"], F.col("value"))
    first = sorted((r["user_id"], r["cnt"]) for r in once.collect())
    # the same files again under a lost progress folder: every granule is recorded already
    import shutil

    shutil.move(f"{path}/run-progress", str(tmp_path / "lost"))
    again = journal.reduce_once(live(), path, "event_id", ["user_id"], F.col("value"))
    assert sorted((r["user_id"], r["cnt"]) for r in again.collect()) == first
    assert sum(n for _, n in first) == rows.count()


def test_regrouped_files_count_once(spark, pieces, tmp_path):
    """Lost progress and other batch sizes: other batches hold the files, and every piece still counts once."""
    import shutil

    folder, rows = pieces
    path, want = str(tmp_path / "g"), sorted(tuple(r) for r in rows.groupBy("user_id").count().collect())
    for n, files in enumerate((1, 4, 2)):
        live = journal.read_files(spark, folder, "*.parquet", files)
        got = journal.reduce_once(live, path, "event_type", ["user_id"], F.col("value"))
        assert sorted((r["user_id"], r["cnt"]) for r in got.collect()) == want
        shutil.move(f"{path}/run-progress", str(tmp_path / f"lost{n}"))


def test_first_write_wins_once(spark, pieces, tmp_path):
    folder, rows = pieces
    keyed = journal.read_files(spark, folder, "*.parquet", 1).select("event_id", "user_id", "ts", F.date_trunc("day", "ts").alias("step"))
    journal.run(journal.first_writes(keyed, "ts", ["user_id", "step"], "60 days"), str(tmp_path / "f"))
    kept = spark.read.parquet(str(tmp_path / "f"))
    assert kept.count() == kept.select("user_id", "step").distinct().count() == rows.select("user_id", F.date_trunc("day", "ts")).distinct().count()
    assert journal.refused_writes(rows, kept, "event_id").count() == rows.count() - kept.count()


def test_validation_vocabulary(spark):
    rows = [(k, "{" + ",".join(f'"{f}":1' for f in fs) + "}") for k, fs in journal.PAYLOADS.items()]
    rows += [("budget", '{"cap":1}'), ("budget", '{"cap":1,"which":2,"x":3}'), ("other", "{}"), ("budget", "not json")]
    got = [r["problem"] for r in journal.validate(spark.createDataFrame(rows, "kind string, payload string")).collect()]
    assert got == [None] * len(journal.PAYLOADS) + ["missing field", "extra field", "unknown kind", "unreadable payload"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_prune_push_and_never_pair(spark, sf):
    from gridspark.plans import catalogue

    q = catalogue.queries()
    mean = plan(q["agg6_segmented_mean"](spark, sf))
    scan = mean[mean.rindex("ReadSchema"):].split("\n")[0]
    assert "l_quantity" in scan and "l_shipdate" not in scan and "l_tax" not in scan
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)]" in plan(q["fld10_masked_mean"](spark, sf))
    for name in ("jn2_interval_lookup", "agg9_segmented_quantile", "cor6_bm25_top_k", "win5_last_records", "aud7_affected", "ser5_kendall_score"):
        text = plan(q[name](spark, sf))
        assert "CartesianProduct" not in text, name


def test_manifest_tells_folders_apart(spark, tmp_path):
    from gridspark.sources import tables

    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0").write_text(name)
    found = tables.file_manifest(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["a/part-0", "b/part-0"]
    assert [r.status for r in tables.verify_manifest(found, found).collect()] == ["ok", "ok"]


def test_manifest_of_tables_in_several_files(spark, sf, con, tmp_path):
    """Tables written as folders of files get one status each, as the SQL has it."""
    import __spark_entry__ as entry
    from compare import TABLES, compare

    for name in TABLES:
        source = f"{sf}/{name}.parquet"
        if name in ("part", "lineitem", "orders", "documents"):
            spark.read.parquet(source).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            (tmp_path / f"{name}.parquet").write_bytes(open(source, "rb").read())
    name = "src2_verify_manifest"
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == ""


def test_status_of_a_table_is_that_of_its_worst_file(spark):
    rows = [("a/1", "ok"), ("a/2", "ok"), ("b/1", "ok"), ("b/2", "sha256 differs"), ("c/1", "extra"), ("c/2", "bytes differ"), ("d", "absent")]
    out = tables.table_statuses(spark.createDataFrame(rows, "path string, status string"))
    assert dict(out.collect()) == {"a": "ok", "b": "sha256 differs", "c": "extra", "d": "absent"}


def test_geometry_is_written_as_it_is_made(spark, tmp_path, monkeypatch):
    """The cells come in runs of ids, so they are neither made twice for a sample nor dealt out again."""
    from gridspark.sources import grid, tables

    def never(*args):
        raise AssertionError("dealt out again")

    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", never)
    monkeypatch.setattr(grid, "RUN", 100)  # tasks follow the cells, not the cores
    for _ in range(2):
        root = tables.put_geometry(spark, str(tmp_path), 3, "fine")
    for name, each in (("cells", 1), ("edges", 3)):
        got = spark.read.parquet(f"{root}/{name}")
        spans = sorted(tuple(r) for r in got.groupBy(F.input_file_name()).agg(F.min("cell").alias("lo"), F.max("cell").alias("hi")).select("lo", "hi").collect())
        assert got.count() == each * 1280 and len(spans) == 13 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


@pytest.fixture
def one_value_is_short(spark):
    """Spark refuses to hold a file of more than 2 GB as one value; here of more than a megabyte."""
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, str(1 << 20))
    yield
    spark.conf.unset(name)


def test_manifest_of_files_too_long_for_one_value(spark, tmp_path, monkeypatch, one_value_is_short):
    import gzip
    import hashlib
    import os

    from gridspark.sources import tables

    monkeypatch.setattr(tables, "WHOLE", 1 << 19)
    noise = os.urandom((1 << 20) + 77)
    held = {
        "noise": noise, "ended": noise + b"\n", "ended twice": noise + b"\n\n", "returns": noise + b"\r\n\r",
        "marked": b"\xef\xbb\xbf" + noise, "marked ended": b"\xef\xbb\xbf" + noise + b"\n", "marked twice": b"\xef\xbb\xbf" * 2 + noise,
        "a+b %20[1] é=x": noise[::-1], "zeros": bytes(3 << 20), "ends": b"\n" * (1 << 20), "short": b"\xef\xbb\xbfx\n",
        "packed.gz": gzip.compress(noise[: 3 << 18]), "nested/noise": noise + b"x",
    }
    (tmp_path / "nested").mkdir()
    for name, data in held.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.bytes, r.sha256) for r in tables.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in held.items()}


def test_manifest_of_a_long_table(spark, sf, con, tmp_path, monkeypatch, one_value_is_short):
    import __spark_entry__ as entry
    from compare import TABLES, compare

    from gridspark.sources import tables

    monkeypatch.setattr(tables, "WHOLE", 1 << 14)
    for name in TABLES:
        data = open(f"{sf}/{name}.parquet", "rb").read()
        (tmp_path / f"{name}.parquet").write_bytes(data * 30 if name == "lineitem" else data)
    name = "src2_verify_manifest"
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == ""
