"""Removal of repeated byte strings by prefix-free parsing.

The question is which suffixes of the corpus share their first 200 bytes with another, so suffixes are
told apart that far and no further: by digests under common keys. No suffix array of the dictionary or of
the parse is built, and nothing is put in order. A rolling hash sets triggers: the trigger of a 200-byte string is its window
of least hash, which its content alone decides. The strings that share a trigger follow each other and
make a phrase: the bytes from the first one's start to the last one's end. Equal strings thus lie in
phrases with the same trigger, at the same place before or behind it.

The dictionary keeps each distinct phrase with its count, under a key of some 108 bytes around its
trigger that all its strings share. A key met once ends there: nothing in its phrase repeats. A phrase
met twice repeats as a whole. Only where different phrases meet under one key are their suffixes
compared: first eight at a time, by the bytes that all eight share, then one by one, by the digest of
their first 200 bytes; suffixes that meet there repeat. Nothing but digests and offsets is shuffled for
this, grouped sums carry all counts, and texts are read back by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.common import row_key, text_buffers
from gridspark.llm.minhash import mixed
from gridspark.session import settled

LENGTH = 200
GRAM = 16                  # bytes of a trigger window
BLOCK = 8                  # neighbouring suffixes that are first compared together
PIECE = 1 << 19            # bytes parsed at once

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_PLACE = _U((1 << 20) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers or len(_powers[which][0]) < n:
        size, out = max(n, PIECE + 1), []
        for b in (_BASES[which], _U(pow(int(_BASES[which]), -1, 1 << 64))):
            t = np.full(size, b, dtype=_U)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        _powers[which] = (out[0], out[1])
    return _powers[which]


class Digests:
    """Digests of any stretch of some bytes, from running sums."""

    def __init__(self, body: np.ndarray, which: int = 0):
        n = len(body)
        up, self.down = _tables(n + 1, which)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((body.astype(_U) + _U(1)) * up[:n], out=self.sums[1:])

    def of(self, start, stop) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Of all stretches of one width."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def _parts(starts: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, last byte + 1, documents, their starts, their ends) of stretches parsed at once.

    A document longer than a piece is parsed in pieces that overlap by a string less one byte.
    """
    i, n = 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > PIECE:
            for a in range(int(starts[i]), int(ends[i]) - length + 1, PIECE - length + 1):
                b = min(a + PIECE, int(ends[i]))
                yield a, b, np.array([i]), np.array([a]), np.array([b])
            i += 1
            continue
        j = i + 1
        while j < n and ends[j] - starts[i] <= PIECE:
            j += 1
        yield int(starts[i]), int(ends[j - 1]), np.arange(i, j), starts[i:j], ends[i:j]
        i = j


def phrases(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first string, last string, trigger, key, digest) of every phrase side, by offsets in the document."""
    width = length - gram + 1
    half = width // 2
    for lo, hi, docs, a, b in _parts(starts, ends, length):
        if hi - lo < length:
            continue
        body = Digests(raw[lo:hi])
        grams = (body.every(gram) & ~_PLACE) | np.arange(hi - lo - gram + 1, dtype=_U)
        least = _sliding_least(grams, width)
        edge = np.zeros(hi - lo + 2, dtype=np.int64)
        some = (b - a) >= length
        np.add.at(edge, a[some] - lo, 1)
        np.add.at(edge, b[some] - lo - length + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:len(least)] > 0)
        if not len(at):
            continue
        trigger = (least[at] & _PLACE).astype(np.int64)
        cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1))
        first, last, t = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], trigger[np.r_[0, cut + 1]]
        found = []   # first string, last string, key, trigger
        # Strings that start at most `half` before the trigger share what follows it; the others what precedes it.
        f, near = np.maximum(first, t - half), last >= t - half
        found.append((f[near], last[near], body.of(t[near], t[near] + length - half), t[near]))
        l, far = np.minimum(last, t - half - 1), first < t - half
        found.append((first[far], l[far], ~body.of(t[far] - half - 1, t[far] + gram), t[far]))
        f, l, key, t = (np.concatenate(x) for x in zip(*found))
        digest = mixed(body.of(f, l + length) + (l - f).astype(_U))
        own = np.searchsorted(a - lo, f, side="right") - 1
        doc = docs[own]
        shift = lo - starts[doc]
        yield doc, f + shift, l + shift, t + shift, key.view(np.int64), digest.view(np.int64)


def _phrase_rows(length: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = text_buffers(batch["text"])
            k, d = np.asarray(batch["k"]), np.asarray(batch["d"])
            for doc, first, last, trigger, key, digest in phrases(raw, starts, ends, length):
                at = (first << 16) + ((last - first) << 8) + (trigger - last)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[doc], d[doc], at, key, digest)], names=["k", "d", "at", "key", "phrase"])

    return parse


_BLOCKS = "k long, d long, start long, core long, whole long, each array<long>"


def _suffixes(length: int):
    """Blocks of neighbouring suffixes in given phrases: the digest of the bytes all share, of all bytes, and of each.

    Blocks are laid from the trigger, so equal suffixes stand at one place in blocks with one core. A
    suffix is told by its core and 64 more bits: at the edge of a common passage all have the same core.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = text_buffers(batch["text"])
            out = {n: [] for n in ("row", "start", "core", "whole", "each")}
            for i in range(batch.num_rows):
                at = np.asarray(batch["at"][i].values)
                body = raw[starts[i]:ends[i]]
                for f, c, back in zip((at >> 16).tolist(), ((at >> 8) & 255).tolist(), (at & 255).tolist()):
                    # Only the phrases are digested, however long the text. Starts count from the phrase's.
                    part = Digests(body[f:f + c + length])
                    each = part.every(length).view(np.int64)
                    trigger = c + back
                    block = (trigger - np.arange(c + 1)) // BLOCK
                    cut = np.flatnonzero(np.diff(block)) + 1
                    a, b = np.r_[0, cut], np.r_[cut, c + 1]
                    low = trigger - block[a] * BLOCK          # the last start a whole block would have
                    core = part.of(low, low - BLOCK + 1 + length)
                    out["row"] += [i] * len(a)
                    out["start"] += (f + a).tolist()
                    out["core"].append(core)
                    out["whole"].append(mixed(part.of(a, b - 1 + length) + (b - a).astype(_U)))
                    out["each"] += [each[x:y] for x, y in zip(a, b)]
            if out["row"]:
                row = np.array(out["row"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(batch["k"])[row]), pa.array(np.asarray(batch["d"])[row]), pa.array(out["start"], pa.int64()), pa.array(np.concatenate(out["core"]).view(np.int64)),
                     pa.array(np.concatenate(out["whole"]).view(np.int64)), pa.array(out["each"], pa.list_(pa.int64()))], names=["k", "d", "start", "core", "whole", "each"])

    return blocks


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def _removed(keep_text: bool, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = text_buffers(batch["text"])
            made = {"n_bytes": ends - starts, "n_removed": [], "spans": [], "kept_sha256": [], "kept": []}
            for i in range(batch.num_rows):
                body, spans = raw[starts[i]:ends[i]], batch["found"][i].values
                if spans is not None and len(spans):
                    s, e = _merged(np.asarray(spans.field("start")), np.asarray(spans.field("stop")))
                    mask = np.zeros(len(body) + 1, dtype=np.int64)
                    np.add.at(mask, s, 1)
                    np.add.at(mask, e, -1)
                    body = body[np.cumsum(mask)[:-1] == 0]
                    made["n_removed"].append(int((e - s).sum()))
                    made["spans"].append([{"start": int(x), "stop": int(y)} for x, y in zip(s, e)])
                else:
                    made["n_removed"].append(0)
                    made["spans"].append([])
                kept = body.tobytes()
                made["kept_sha256"].append(sha256(kept).hexdigest())
                if keep_text:
                    made["kept"].append(kept)
            yield pa.RecordBatch.from_arrays([pa.array(made[n], type=_TYPES[n]) if n in made else batch[n] for n in names], names=names)

    return cut


_TYPES = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept_sha256": pa.string(), "kept": pa.binary()}


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(texts by row, stretches (k, d, start, stop) of bytes that repeat)."""
    texts = docs.select("doc_id", row_key("doc_id", "text").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"),
                        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = texts.select("k", "d", "text").mapInArrow(_phrase_rows(length), "k long, d long, at long, key long, phrase long")
    # Grouped sides are written before they are joined: then a join has two plain inputs, and a very common
    # key can be split over tasks.
    again = settled(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"))
    met = settled(rows.join(again, "key"))
    # The dictionary of phrases under repeated keys, and the keys under which several of them meet.
    dictionary = settled(met.groupBy("key", "phrase").agg(F.count("*").alias("m"), F.min(F.struct("k", "d", "at")).alias("one")))
    several = dictionary.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    apart = settled(dictionary.join(several, "key", "left_semi"))
    whole = met.join(dictionary.filter("m > 1").select("key", "phrase"), ["key", "phrase"], "left_semi").select("k", "d", "at")
    first, last = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255)
    whole = whole.select("k", "d", first.alias("start"), (first + last + length).alias("stop"))
    # One row of every phrase shows its suffixes; a phrase met once also learns of its own.
    shown = apart.select("one.k", "one.d", "one.at").groupBy("k", "d").agg(F.collect_list("at").alias("at")).withColumnsRenamed({"k": "_k", "d": "_d"})
    ordered = texts.join(shown.hint("shuffle_hash"), (F.col("k") == F.col("_k")) & (F.col("d") == F.col("_d"))).select("k", "d", "text", "at")
    blocks = settled(ordered.mapInArrow(_suffixes(length), _BLOCKS))
    cores = blocks.groupBy("core").agg(F.count("*").alias("m"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("m > 1")
    cores = settled(cores.select("core", (F.col("lo") == F.col("hi")).alias("alike")))
    near = settled(blocks.join(cores, "core"))
    alike = near.filter("alike").select("k", "d", "start", (F.col("start") + F.size("each") - 1 + length).alias("stop"))
    single = near.filter("not alike").select("k", "d", "core", "start", F.posexplode("each").alias("i", "x"))
    twice = settled(single.groupBy("core", "x").agg(F.count("*").alias("m")).filter("m > 1").select("core", "x"))
    some = single.join(twice, ["core", "x"], "left_semi").select("k", "d", (F.col("start") + F.col("i")).alias("start"), (F.col("start") + F.col("i") + length).alias("stop"))
    return texts, whole.unionByName(alike).unionByName(some)


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256[, kept]) of every row: bytes of repeated strings removed.

    Texts are UTF-8 bytes; a null text is empty, and a text shorter than `length` keeps all. A string
    repeats if it also starts anywhere else, in the same document or another, before anything is
    removed; equal rows repeat each other. A null doc_id is an ordinary document. `spans` are the maximal
    removed runs. Extra columns are left behind; an empty table gives an empty table.
    """
    texts, found = repeated_strings(docs, length)
    lists = found.groupBy("k", "d").agg(F.collect_list(F.struct("start", "stop")).alias("found")).withColumnsRenamed({"k": "_k", "d": "_d"})
    joined = texts.join(lists.hint("shuffle_hash"), (F.col("k") == F.col("_k")) & (F.col("d") == F.col("_d")), "left").select("doc_id", "text", "found")
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = {"doc_id": docs.schema["doc_id"].dataType.simpleString(), "n_bytes": "long", "n_removed": "long", "spans": "array<struct<start:long,stop:long>>", "kept_sha256": "string", "kept": "binary"}
    return joined.mapInArrow(_removed(keep_text, names), ", ".join(f"{n} {kinds[n]}" for n in names))
