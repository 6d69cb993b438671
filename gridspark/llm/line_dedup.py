"""Line deduplication with built-in functions: ordered hashes, first occurrences, keep bitmaps.

Lines travel as digests only. They are range-partitioned by (digest, document, position), which cuts
the lines of one very common key over many partitions; each partition gives its least document per
key, and the partitions' firsts meet in a small aggregate. The sort inside partitions is asked for, but
Spark drops it before an aggregate, so first occurrences are minima of hash aggregates, not streamed.
What returns to a document is a keep bitmap in run-length form, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import SPACE, ascii_lower, row_key
from gridspark.session import settled

MIN_CHARS = 10


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, k, pos): the digest of every line long enough to be compared."""
    lines = docs.filter("doc_id is not null").select("doc_id", row_key("doc_id", "text").alias("k"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "k", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "k", "pos")


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs [start, end) of kept lines, from the sorted dropped positions."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    ends = F.concat(dropped, F.array(n_lines))
    return F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda r: r["end"] > r["start"])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of `docs` with n_lines, n_dropped, keep (runs of kept lines) and kept_text.

    A key of at least `min_chars` code points found in two documents or more stays only in the
    smallest doc_id that holds it, where all its lines stay. A null or empty text is one empty line;
    a null text stays null. A row with a null doc_id holds no key and loses nothing. Rows with equal
    doc_id are one document. Extra columns pass through; an empty table gives an empty table.
    """
    lines = settled(line_digests(docs, min_chars))
    ordered = lines.repartitionByRange("h1", "h2", "doc_id", "pos").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    firsts = ordered.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Written first, so that the join has two plain inputs and a very common line can be split over tasks.
    shared = settled(firsts.filter("first < last").select("h1", "h2", "first"))
    late = lines.join(shared, ["h1", "h2"]).filter("doc_id > first")
    drops = late.groupBy("k", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("_dropped")).withColumnsRenamed({"k": "_k", "doc_id": "_id"})
    keyed = docs.withColumn("_key", row_key("doc_id", "text"))
    joined = keyed.join(drops.hint("shuffle_hash"), (keyed["_key"] == drops["_k"]) & (keyed["doc_id"] == drops["_id"]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")
    none = F.array().cast("array<int>")
    out = joined.withColumn("n_lines", n.cast("long")).withColumn("n_dropped", F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("_dropped").isNull(), F.lit(0)).otherwise(F.col("n_dropped")).cast("long"))
    out = out.withColumn("keep", keep_runs(F.coalesce(F.col("_dropped"), none), n))
    # One-element arrays hold the split text, so that it is split once however many runs are kept.
    once = F.transform(F.array(F.struct(_lines(F.col("text")).alias("lines"), F.col("keep").alias("runs"))),
                       lambda s: F.array_join(F.flatten(F.transform(s["runs"], lambda r: F.slice(s["lines"], r["start"] + 1, r["end"] - r["start"]))), "\n"))
    out = out.withColumn("kept_text", F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(once[0]))
    return out.drop("_key", "_k", "_id", "_dropped")
