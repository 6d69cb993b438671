"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark: every run of ten words of an item, or a whole shorter
item. The alphabet is the word, not the character. For all patterns of one length m a shift table
tells, for a block of words at the end of the current window, how far the window may move without
passing an occurrence; blocks that end a pattern lead to a bucket of patterns, which are compared
word for word. The benchmark is cut into blocks of items of bounded size; each block is one step of
the same scan of the documents, whose rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridspark.llm.common import LOWER, UPPER

WINDOW = 10
BLOCK_WORDS = 3
# Bytes of benchmark text whose tables one step of the scan holds.
BLOCK_BYTES = 4 << 20

# A byte is part of a word if it is a digit, a letter or beyond ASCII; A-Z fold to a-z.
_TABLE = bytearray(b" " * 256)
for _c in range(256):
    if _c > 0x7F or chr(_c).isdigit() or chr(_c) in LOWER:
        _TABLE[_c] = _c
for _u, _l in zip(UPPER, LOWER):
    _TABLE[ord(_u)] = ord(_l)
_TABLE = bytes(_TABLE)


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TABLE).split()


class Patterns:
    """Shift table and buckets for patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.b = m, min(m, BLOCK_WORDS)
        self.far = m - self.b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = {}
        for p, items in patterns.items():
            for end in range(self.b, m + 1):
                block, left = p[end - self.b:end], m - end
                if left < self.shift.get(block, self.far):
                    self.shift[block] = left
            self.buckets.setdefault(p[m - self.b:], {})[p] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start, items) of every occurrence, in order."""
        m, b, far, shift, buckets, n = self.m, self.b, self.far, self.shift, self.buckets, len(words)
        end = m
        while end <= n:
            block = tuple(words[end - b:end])
            move = shift.get(block, far)
            if move:
                end += move
                continue
            items = buckets[block].get(tuple(words[end - m:end]))
            if items is not None:
                yield end - m, items
            end += 1


def compile_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Patterns]:
    """The tables of a block of (item id, text): one for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            found = by_length.setdefault(m, {}).setdefault(tuple(words[i:i + m]), set())
            if item is not None:
                found.add(str(item))
    return [Patterns(m, p) for m, p in sorted(by_length.items())]


def hits(words: list[bytes], tables: list[Patterns]) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs [start, end) of hit words, merged, and the items with an occurrence."""
    spans, items = [], set()
    for t in tables:
        for start, found in t.search(words):
            spans.append((start, start + t.m))
            items |= found
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


RUNS = "array<struct<start:int,end:int>>"


def _step(tables: list[Patterns], schema: T.StructType):
    """One block of the benchmark against batches of documents; adds to the runs and items of earlier blocks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            runs, items, counts = [], [], []
            for text, old_runs, old_items in zip(batch["_bytes"], batch["runs"], batch["items"]):
                words = words_of(text.as_py() or b"")
                found, named = hits(words, tables)
                if old_runs.as_py():
                    found = merge(found + [(r["start"], r["end"]) for r in old_runs.as_py()])
                runs.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(named | set(old_items.as_py() or ())))
                counts.append(len(words))
            made = {"runs": runs, "items": items, "n_words": counts}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], type=f.type) if f.name in made else batch[f.name].cast(f.type) for f in out], schema=out)

    return scan


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about `block_bytes` of text the benchmark makes."""
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-total // block_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  keep_text: bool = True) -> DataFrame:
    """The rows of `docs` with n_words, runs of hit words, items (ids as sorted strings) and n_hit.

    A null or empty text has no words and no hits. Items without words match nothing; an item with a
    null id still marks words but is not listed; equal items are one. One block's items are on the driver
    at a time, its tables with every task. `keep_text=False` leaves the text out of the result. Rows are neither joined nor
    shuffled, so null and repeated ids stay as they are, and extra columns pass through (the names
    _bytes, runs, items, n_words and n_hit are the operator's own). An empty benchmark hits nothing.
    """
    clash = [c for c in ("_bytes", "runs", "items", "n_words", "n_hit") if c in docs.columns]
    out = docs.drop(*clash).withColumn("_bytes", F.col("text").cast("binary"))
    out = out.withColumn("runs", F.array().cast(RUNS)).withColumn("items", F.array().cast("array<string>")).withColumn("n_words", F.lit(0))
    if not keep_text:
        out = out.drop("text")
    n = benchmark_blocks(benchmark, block_bytes)
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text")
        tables = compile_patterns([(r["item_id"], r["text"]) for r in part.collect()], window)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema if k < n - 1 or f.name != "_bytes"])
        out = out.mapInArrow(_step(tables, schema), schema)
    return out.withColumn("n_hit", hit_words(F.col("runs")))


def hit_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
