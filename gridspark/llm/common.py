"""Helpers shared by the operators of this subpackage.

Row identity: ids may be null or repeated, so rows are told apart by `row_key`, a digest of id and
text. Rows alike in both are the same document written twice; each is still returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.session import prepare

# The alphabet whose case is folded, and the white space that ends a word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

# Rows of text in one Arrow batch: a Python worker holds a batch or two at a time.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The runtime settings of the library, and Arrow batches small enough for long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A 64-bit digest of the columns; always joined together with the id."""
    return F.xxhash64(*[F.col(c) for c in columns])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of the named columns, still an equi-join to Spark."""
    out = None
    for x, y in pairs:
        one = a[x].eqNullSafe(b[y])
        out = one if out is None else out & one
    return out


def first_by_digest(df: DataFrame, digest: Column, most: int) -> list:
    """`most` rows at most, first by a digest that tells rows apart.

    Rows far from the front are filtered out before any ordering, so about twice `most` rows reach the
    driver however many tasks there are.
    """
    front, wide = F.pmod(digest, F.lit(1 << 40)), 1 << 40
    n = df.count()
    if n > 2 * most:
        df = df.filter(front < F.lit(wide * 2 * most // n))
    return df.orderBy(front, digest).limit(most).collect()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary Arrow column, without a copy; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width, count=column.offset + len(column) + 1)[column.offset:].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        gone = ~np.asarray(column.is_valid())
        ends[gone] = starts[gone]
    return raw, starts, ends


def pieces(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold at most `most` bytes together; a longer text is a run of its own."""
    i, n = 0, len(starts)
    while i < n:
        j = int(np.searchsorted(ends, starts[i] + most, side="right"))
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
