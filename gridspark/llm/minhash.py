"""Near-duplicate documents by b-bit MinHash.

A document is the set of its five-word shingles, compared as 64-bit digests. One pass computes, per
document, the minima of 255 permutations: their bands give candidate buckets, their low two bits the
packed signature. Documents with equal sets become one node first. In a bucket of bounded size all
pairs are candidates; in a larger one every member is paired with a few of its nodes, which joins a
group of copies in linear work. Signatures estimate the similarity of candidates, corrected for chance
agreement of the kept bits, and full sets confirm links. Pairs inside one component need no further
look, so each node is first tried with the leads it meets most, and only buckets that still hold
several components go on. What a larger bucket holds apart at the end is settled exactly, by a prefix
join in order of rarity, so leads cost no link.

With 51 bands of 5 rows a pair of similarity 0.75 misses every band with probability 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from gridspark.llm.common import SPACE, UPPER, pieces, row_key, text_buffers
from gridspark.operators.graph import components
from gridspark.session import settled

WORDS = 5
PERCENT = 75
BANDS, ROWS = 51, 5
BITS = 2
SMALL = 16            # members of a bucket whose pairs are all candidates
SLOTS = 1 << 20       # counts that shingles are ordered by, whatever the size of the corpus
CHUNK = 1024          # holders of one shingle that meet as one list, about
MARGIN = 6.0          # standard errors below the threshold at which an estimate rules a pair out

_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
for _u in UPPER:
    _FOLD[ord(_u)] = ord(_u) + 32
_GAP = np.zeros(256, dtype=bool)
for _s in SPACE:
    _GAP[ord(_s)] = True
# Odd multipliers drawn once from a fixed seed; any odd numbers do.
_draw = np.random.default_rng(20)
_BASE = _U(int(_draw.integers(1 << 40, 1 << 62)) * 8 + 3)
_STEP = (_draw.integers(1, 1 << 62, size=WORDS, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_XOR = _draw.integers(0, 1 << 32, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MUL = (_draw.integers(0, 1 << 31, size=BANDS * ROWS, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_ROW = (_draw.integers(1, 1 << 62, size=ROWS, dtype=np.int64).astype(_U) << _U(1)) | _U(1)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each word spread over all its bits (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between calls up to the longest text seen."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, dtype=_U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digest, document) of every word of adjoining texts, A-Z folded, in order."""
    lo, hi = int(starts[0]), int(ends[-1])
    body = _FOLD[raw[lo:hi]]
    n = len(body)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    solid = ~_GAP[body]
    first = np.zeros(n + 1, dtype=bool)
    first[starts - lo] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | first[1:n]
    a, b = np.flatnonzero(begins), np.flatnonzero(closes)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((body.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    digest = mixed((sums[b + 1] - sums[a]) * down[a])
    return digest, np.searchsorted(starts - lo, a, side="right") - 1


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle digests of each text; a text of fewer words than a shingle is one shingle."""
    for i, j in pieces(starts, ends):
        digest, doc = word_digests(raw, starts[i:j], ends[i:j])
        edge = np.searchsorted(doc, np.arange(j - i + 1))
        m = len(digest) - WORDS + 1
        if m > 0:
            long = np.zeros(m, dtype=_U)
            for k in range(WORDS):
                long += digest[k:k + m] * _STEP[k]
            long = mixed(long)
        for d in range(j - i):
            a, b = int(edge[d]), int(edge[d + 1])
            if b - a >= WORDS:
                yield np.unique(long[a:b - WORDS + 1])
            elif b > a:
                part = digest[a:b]
                yield mixed((part * _STEP[:b - a]).sum(keepdims=True, dtype=_U) + _U(b - a))
            else:
                yield np.zeros(0, _U)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation of 32 bits."""
    h = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 512):
        part = h[i:i + 512, None] ^ _XOR
        part *= _MUL
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.astype(_U).reshape(BANDS, ROWS)
    return mixed((rows * _ROW).sum(axis=1, dtype=_U) + np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


def signature(best: np.ndarray) -> bytes:
    """The low bits of scrambled minima, packed: bit plane by bit plane."""
    low = (best * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return b"".join(np.packbits((low >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(BITS))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signature rows: the agreeing share, less what chance agrees on."""
    half = a.shape[1] // BITS
    differ = np.zeros((len(a), half), dtype=np.uint8)
    for k in range(BITS):
        differ |= a[:, k * half:(k + 1) * half] ^ b[:, k * half:(k + 1) * half]
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / (BANDS * ROWS)
    chance = 2.0 ** -BITS
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    chance, j = 2.0 ** -BITS, percent / 100
    p = chance + (1 - chance) * j
    return j - MARGIN * np.sqrt(p * (1 - p) / (BANDS * ROWS)) / (1 - chance)


_PRINTS = "doc_id long, k long, n long, d1 long, d2 long, bands array<long>, sig binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = text_buffers(batch["text"])
        n, d1, d2, bands, sigs = [], [], [], [], []
        for s in shingle_sets(raw, starts, ends):
            n.append(len(s))
            d1.append(int(mixed(s + _U(1)).sum(dtype=_U).view(np.int64)))
            d2.append(int(mixed(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)))
            best = minima(s) if len(s) else None
            bands.append(None if best is None else band_keys(best).view(np.int64))
            sigs.append(None if best is None else signature(best))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["k"], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "k", "n", "d1", "d2", "bands", "sig"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, n, d1, d2, bands, sig): set size, set digest, band keys and signature of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_prints, _PRINTS)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = text_buffers(batch["text"])
        sets = [s.tobytes() for s in shingle_sets(raw, starts, ends)]
        yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "set"])


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(estimates(a, b))], names=["a", "b", "estimate"])


def _confirmed(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, keep = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            last, held = None, None
            for i in range(batch.num_rows):
                if a[i] != last or held is None:
                    last, held = a[i], np.frombuffer(batch["set_a"][i].as_py(), _U)
                other = np.frombuffer(batch["set_b"][i].as_py(), _U)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    return check


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, lead) of every bucket with two nodes or more; the lead is its first node in a hashed order."""
    bands = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("lead")).filter("m > 1")
    # Written first, so that the join has two plain inputs and a large bucket can be split over tasks.
    return bands.join(settled(buckets.select("key", "lead")), "key")


def first_pairs(members: DataFrame) -> DataFrame:
    """Each node with the two leads it meets in most buckets."""
    met = members.filter("node <> lead").groupBy("node", "lead").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.col("n").desc(), "lead"))
    some = met.withColumn("r", rank).filter("r <= 2")
    return some.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()


def split_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, m, ends) of buckets that hold several components; ends: four of their nodes with labels."""
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    by_id, by_hash = F.struct("node", "label"), F.struct(F.xxhash64("node").alias("h"), "node", "label")
    plain = lambda c: F.struct(c["node"].alias("node"), c["label"].alias("label"))
    buckets = placed.groupBy("key").agg(
        F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.min(by_id).alias("l1"), F.max(by_id).alias("l2"), F.min(by_hash).alias("l3"), F.max(by_hash).alias("l4")).filter("lo < hi")
    ends = F.array("l1", "l2", plain(F.col("l3")), plain(F.col("l4")))
    return placed.join(buckets.select("key", "m", ends.alias("ends")), "key")


def cross_pairs(split: DataFrame, small: int = SMALL) -> DataFrame:
    """Candidate pairs of different components: all of a small bucket, and with four nodes of a larger one."""
    few = split.filter(F.col("m") <= small).select("key", "node", "label")
    other = few.select("key", F.col("node").alias("other"), F.col("label").alias("there"))
    close = few.join(other, (few["key"] == other["key"]) & (F.col("node") < F.col("other")) & (F.col("label") != F.col("there"))).select(F.col("node").alias("a"), F.col("other").alias("b"))
    many = split.filter(F.col("m") > small).withColumn("far", F.filter("ends", lambda e: (e["label"] != F.col("label")) & (e["node"] != F.col("node"))))
    star = many.select("node", F.explode(F.array_distinct("far.node")).alias("lead"))
    return close.unionByName(star.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))).distinct()


class _Sets:
    """Full shingle sets of nodes, from the texts of the rows that stand for them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("k"), "text")
        self.nodes, self.percent = nodes.select("node", "k"), percent

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, set) of the wanted nodes."""
        rows = self.nodes.join(wanted.select("node").distinct(), "node", "left_semi").withColumnsRenamed({"k": "_k"})
        texts = self.docs.join(rows.hint("shuffle_hash"), (F.col("doc_id") == F.col("node")) & (F.col("k") == F.col("_k")))
        # Repeated rows give a node its set more than once, which repeats a link and changes nothing.
        return texts.select("node", "text").mapInArrow(_full_sets, "node long, set binary")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        sets = settled(self.of(ends))
        b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(self.percent), "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link."""
    edges = settled(links.select("a", "b").distinct())
    both = edges.select(F.col("a").alias("cell"), F.col("b").alias("neighbour")).unionByName(edges.select(F.col("b").alias("cell"), F.col("a").alias("neighbour")))
    return settled(components(both.select("cell").distinct(), both).select(F.col("cell").alias("node"), "label"))


def _apart(split: DataFrame, sets: _Sets, sigs: DataFrame, small: int, chunk: int = CHUNK) -> DataFrame | None:
    """Pairs, none missed, between components that share a larger bucket, as far as their signatures let them.

    Shingles are ordered by how often their slot of a table of `SLOTS` counts is met, rare ones first; any
    order that all documents share does. Two sets similar by at least p share one of their first
    n - ceil(p n) + 1, and the first one they share stands early enough in both for the rest to suffice.
    Only those first ones become rows.
    One side of a pair lies outside a bucket's largest component, so a settled group of copies is not
    paired with itself. The holders of a shingle meet as lists of about `chunk` members, one row for each
    pair of lists; a pair of documents becomes a row only when its positions and signatures allow a link.
    """
    there = split.filter(F.col("m") > small).select("key", "node", "label")
    main = there.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    who = settled(there.join(main, "key").groupBy("node", "label").agg(F.max((F.col("label") != F.col("main")).cast("int")).alias("stray")))
    if who.isEmpty():
        return None
    share = sets.percent / 100
    full = settled(sets.of(who))
    tallies = full.mapInArrow(_tallies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    rarity = np.ones(SLOTS, np.uint16)
    rarity[np.asarray(tallies["slot"])] = np.minimum(np.asarray(tallies["n"]), 65535)
    prefix = settled(full.mapInArrow(_prefixes(rarity, sets.percent), "node long, n int, s long, r int").join(who, "node"))
    held = prefix.groupBy("s").agg(F.count("*").alias("c"), F.max("stray").alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    held = settled(held.filter("any = 1 and lo < hi").select("s", F.ceil(F.col("c") / chunk).cast("int").alias("lists")))
    rows = prefix.join(held, "s").join(sigs, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("lists")).cast("int"))
    member = F.struct("node", "label", F.col("n").cast("int").alias("n"), F.col("r").cast("int").alias("r"), F.col("stray").cast("int").alias("stray"), "sig")
    lists = settled(rows.groupBy("s", "lists", "i").agg(F.collect_list(member).alias("one")))
    alone = lists.select("one", F.lit(None).cast(lists.schema["one"].dataType).alias("two"))
    right = lists.filter("lists > 1").select("s", F.col("i").alias("j"), F.col("one").alias("two"))
    left = lists.filter("lists > 1").select("s", "one", F.explode(F.filter(F.sequence(F.lit(0), F.col("lists") - 1), lambda j: j > F.col("i"))).alias("j"))
    return alone.unionByName(left.join(right, ["s", "j"]).select("one", "two")).mapInArrow(_passing(share, least_estimate(sets.percent)), "a long, b long").distinct()


def _columns(lists: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(ends of the lists, their members' fields) of a column of lists of members; a missing list is empty."""
    size = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    out = {c: np.asarray(flat.field(c)) for c in ("node", "label", "n", "r", "stray")}
    sig = b"".join(flat.field("sig").to_pylist())
    return np.r_[0, np.cumsum(size)], out | {"sig": np.frombuffer(sig, np.uint8).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0), np.uint8)}


def _passing(share: float, least: float):
    """Pairs of two lists of holders of one shingle, or of one list, that positions and signatures allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (e1, one), (e2, two) = _columns(batch["one"]), _columns(batch["two"])
            single = ~np.asarray(batch["two"].is_valid())
            for k in range(batch.num_rows):
                x = {c: v[e1[k]:e1[k + 1]] for c, v in one.items()}
                y = x if single[k] else {c: v[e2[k]:e2[k + 1]] for c, v in two.items()}
                # Some rows of the first list at a time, so that the pairs in hand stay few.
                step = max(1, (1 << 18) // max(1, len(y["node"])))
                for lo in range(0, len(x["node"]), step):
                    part = {c: v[lo:lo + step] for c, v in x.items()}
                    able = (part["label"][:, None] != y["label"]) & ((part["stray"][:, None] | y["stray"]) == 1)
                    if single[k]:
                        able &= part["node"][:, None] < y["node"]
                    i, j = np.nonzero(able)
                    need = np.ceil((part["n"][i] + y["n"][j]) * (share / (1 + share)) - 1e-9)
                    fit = np.minimum(part["n"][i] - part["r"][i], y["n"][j] - y["r"][j]) + 1 >= need
                    i, j = i[fit], j[fit]
                    if len(i):
                        near = estimates(part["sig"][i], y["sig"][j]) >= least
                        a, b = part["node"][i[near]], y["node"][j[near]]
                        if len(a):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles by slot, added up in each task."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for raw in batch["set"]:
            # A set names a shingle once and may meet a slot twice.
            np.add.at(total, (np.frombuffer(raw.as_py(), _U) & _U(SLOTS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])


def _prefixes(rarity: np.ndarray, percent: int):
    """The rarest shingles of each set that a similar set must share one of, with their places; unshared ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch["node"].to_pylist(), batch["set"]):
                s = np.frombuffer(raw.as_py(), _U)
                n = len(s)
                often = rarity[(s & _U(SLOTS - 1)).astype(np.int64)]
                first = np.lexsort((s, often))[:n + (-n * percent // 100) + 1]
                place = np.flatnonzero(often[first] > 1)
                if len(place):
                    m = len(place)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, node)), pa.array(np.full(m, n, np.int32)), pa.array(s[first[place]].view(np.int64)), pa.array((place + 1).astype(np.int32))], names=["node", "n", "s", "r"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, kept) of every row; `k` is the row's key.

    A text without words is linked with nothing and is its own component. A row with a null doc_id is
    linked with nothing: its component is null and it is kept. Rows with equal doc_id are one document.
    The kept document of a component is the one with its smallest doc_id. Equal rows are each returned.
    Extra columns are left behind; an empty table gives an empty table.
    """
    prints = settled(fingerprints(docs))
    real = prints.filter("n > 0 and doc_id is not null")
    classes = real.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "k")).alias("r"), F.min_by(F.struct("bands", "sig"), F.struct("doc_id", "k")).alias("p"))
    nodes = settled(classes.select("d1", "d2", "n", F.col("r.doc_id").alias("node"), F.col("r.k").alias("k"), F.col("p.bands").alias("bands"), F.col("p.sig").alias("sig")))
    sigs, sets = nodes.select("node", "sig"), _Sets(docs, nodes, percent)

    def hopeful(pairs: DataFrame) -> DataFrame:
        seen = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        est = seen.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimated, "a long, b long, estimate double")
        return settled(est.filter(F.col("estimate") >= least_estimate(percent)).select("a", "b"))

    # First every node with the leads it meets most, which settles most groups; then what is still apart.
    members = settled(bucket_members(nodes))
    links = settled(sets.confirm(hopeful(first_pairs(members))))
    labels = _labels(links)
    split = settled(split_buckets(members, labels))
    rest = hopeful(cross_pairs(split, small))
    if not rest.isEmpty():
        links = settled(links.unionByName(sets.confirm(rest)))
        labels = _labels(links)
        split = settled(split_buckets(split.select("key", "node"), labels))
    apart = _apart(split, sets, sigs, small, chunk)
    if apart is not None:
        links = links.unionByName(sets.confirm(settled(apart)))
        labels = _labels(links)
    placed = nodes.select("d1", "d2", "n", "node").join(labels, "node", "left").select("d1", "d2", "n", F.coalesce("label", "node").alias("component"))
    out = prints.select("doc_id", "k", "n", "d1", "d2").join(placed, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "k", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
