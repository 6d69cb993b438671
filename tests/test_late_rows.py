"""Streams that count their late rows: what is kept and what is late add up to the input."""

import datetime as dt
import os

from pyspark.sql import functions as F

from gridspark.streaming import journal

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, who string, ts timestamp, value double"
# three arrivals: (id, who, hour of arrival's row, value); the third holds late rows, ties, nulls and a repeat
ARRIVALS = (
    [(1, "a", 1, 1.0), (2, "a", 2, 2.0), (3, "b", 30, 3.0)],
    [(4, "a", 1, 4.0), (5, "b", 31, None), (6, "b", 31, 5.0)],
    [(7, "a", 3, 7.0), (8, None, 32, 8.0), (9, None, 32, 9.0), (10, "b", None, 1.0), (11, "b", 29, 2.0)],
)


def arrive(spark, inbox, rows):
    at = [(i, w, None if h is None else DAY + dt.timedelta(hours=h), v) for i, w, h, v in rows]
    spark.createDataFrame(at, SCHEMA).write.mode("append").parquet(inbox)
    return journal.read_files(spark, inbox, "*.parquet")


def test_windows_and_late_rows_add_up(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ARRIVALS:
        stream = arrive(spark, inbox, rows)
        windows, late = journal.windowed_with_late(stream, path, "ts", "6 hours", ["who"], "value", "12 hours")
    # from the second arrival on the watermark is hour 18, then hour 19
    assert {r["id"] for r in late.collect()} == {4, 7, 10}
    got = {(r["who"], r["n"], r["total"], r["endpoint"]) for r in windows.collect()}
    assert got == {("a", 2, 3.0, 2.0), ("b", 3, 8.0, 5.0), (None, 2, 17.0, 9.0), ("b", 1, 2.0, 2.0)}
    assert windows.agg(F.sum("n")).first()[0] + late.count() == sum(map(len, ARRIVALS))


def test_outcomes_of_writes_add_up_and_survive_a_replay(spark, tmp_path):
    inbox, path = str(tmp_path / "in"), str(tmp_path / "out")
    for number, rows in enumerate(ARRIVALS):
        stream = arrive(spark, inbox, rows)
        out = journal.first_writes_with_late(stream, path, "ts", ["who"], "id", "12 hours")
        if number == 1:  # the last batch is not known as done: it runs again
            for name in os.listdir(f"{path}/run-progress/commits"):
                if name.strip(".").startswith("1"):
                    os.remove(f"{path}/run-progress/commits/{name}")
            out = journal.first_writes_with_late(stream, path, "ts", ["who"], "id", "12 hours")
    got = {r["id"]: r["outcome"] for r in out.collect()}
    assert out.count() == len(got) == sum(map(len, ARRIVALS))
    assert {i for i, o in got.items() if o == "late"} == {4, 7, 10}
    assert {i for i, o in got.items() if o == "accepted"} == {1, 3, 8}
