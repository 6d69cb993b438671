"""Document quality by logistic regression over hashed word n-grams, trained follow-the-regularised-leader.

A word is a run of letters and digits or one other character. Words are read twice: as they are, in
lower case, and as shapes (case, digits, the character itself, or a repeat of the word before), so that
what is learned also speaks for words not seen in training. Runs of one and two words and of one to three
shapes are hashed into 2^BITS buckets; a bucket's value is the square root of its share of the runs of its
kind, so documents of all lengths have vectors of one length. A score is the logistic of a sparse dot
product with the weights that are not zero.

Learning takes labelled rows of a bounded sample in the order of a digest of their ids; scoring reads
every text whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.llm.common import first_by_digest
from gridspark.llm.toxicity import held_out

SAMPLE = 8_000         # labelled rows learned from, at most
BITS = 20
WORDS, SHAPES = 2, 3   # the longest runs of words and of shapes
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
THRESHOLD = 0.5
KNOWN = 1 << 18        # words whose digests a task keeps at hand

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
_MIX = np.uint64(0x9E3779B97F4A7C15)   # an odd number for multiplicative hashing
_REPEAT = np.uint64(xxhash.xxh64_intdigest("repeat", 9))


def shape_of(word: str) -> str:
    """How a word looks: its case, whether it has digits, or the character itself."""
    if not word[0].isalnum():
        return word
    if word.isalpha():
        if word.islower():
            return "lower"
        if word.isupper():
            return "upper" if len(word) > 1 else "letter"
        return "title" if word[0].isupper() and word[1:].islower() else "uncased" if word.lower() == word.upper() else "mixed"
    return "digits" if word.isdigit() else "alphanumeric"


class _Digests(dict):
    """word -> its place in `named` (digests of words) and `looks` (digests of their shapes), each computed once while at hand."""

    def __init__(self) -> None:
        self.named, self.looks = np.zeros(KNOWN, np.uint64), np.zeros(KNOWN, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.named[at], self.looks[at] = xxhash.xxh64_intdigest(word.lower(), 1), xxhash.xxh64_intdigest(shape_of(word), 2)
        self[word] = at
        return at

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Digests of some words and of their shapes, by stretches so that a very long text fits as well."""
        out = []
        for i in range(0, len(words), KNOWN // 2):
            part = words[i:i + KNOWN // 2]
            if len(self) + len(part) > KNOWN:
                self.clear()
            at = np.array([self[w] for w in part])
            out.append((self.named[at], self.looks[at]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _runs(codes: np.ndarray, longest: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, bucket of every run) for runs of one code up to `longest`."""
    rolled = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, longest + 1):
        if len(codes) < n:
            return
        with np.errstate(over="ignore"):
            rolled = (rolled[:len(codes) - n + 1] * _MIX) ^ codes[n - 1:]
            rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX
            mixed = (rolled ^ np.uint64(seed * 64 + n)) * _MIX
        yield seed * 64 + n, (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None, digests: _Digests) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text; both empty where it has no word."""
    words = _WORD.findall(text or "")
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    named, looks = digests.codes(words)
    looks[1:][named[1:] == named[:-1]] = _REPEAT
    buckets, values = [], []
    for _, found in (*_runs(named, WORDS, 1), *_runs(looks, SHAPES, 2)):
        at, n = np.unique(found, return_counts=True)
        buckets.append(at)
        values.append(np.sqrt(n / len(found)))
    return np.concatenate(buckets), np.concatenate(values)


@dataclass
class Leader:
    """Per-coordinate follow-the-regularised-leader for the logistic loss, with both penalties."""

    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    l1: np.ndarray = field(default_factory=lambda: np.append(np.full(1 << BITS, L1), 0.0))   # the bias is not shrunk

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> float:
        w = self.weights(at)
        p = float(logistic(w @ x))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        return p


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))   # rising, of the weights that are not zero
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        if not len(self.buckets):
            return float(logistic(self.bias))
        i = np.minimum(np.searchsorted(self.buckets, at), len(self.buckets) - 1)
        met = self.buckets[i] == at
        return float(logistic(self.bias + self.weights[i[met]] @ x[met]))


def trained(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """Weights from (buckets, values, label) rows, each epoch in an order of its own that reruns repeat."""
    labels = [y for *_, y in rows]
    if not rows or min(labels) == max(labels):
        return Model(bias=0.0 if not rows else 3.0 if labels[0] else -3.0)
    leader, last = Leader(), 1 << BITS
    whole = [(*_merged(np.append(at, last), np.append(x, 1.0)), y) for at, x, y in rows]
    rng = np.random.default_rng(17)
    for _ in range(epochs):
        for i in rng.permutation(len(whole)):
            leader.learn(*whole[i])
    w = leader.weights(slice(None))
    at = np.flatnonzero(w[:last])
    return Model(at, w[at], float(w[last]))


def _merged(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that runs of two kinds share are one coordinate."""
    one, back = np.unique(at, return_inverse=True)
    return one, np.bincount(back, weights=x, minlength=len(one))


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> list:
    """Rows (doc_id, label) of at most `sample` rows outside the held-out fold, first by the digest of the id."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).filter(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("label"))
    return first_by_digest(one, F.xxhash64("doc_id"), sample)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests = _Digests()
    for batch in batches:
        found = [features(t, digests) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())],
                                         names=["doc_id", "label", "buckets", "values"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled sample.

    At most `sample` ids and the sparse vectors of their documents reach the driver; a vector has at most
    2^BITS buckets whatever the length of its text. Labels that are not 1 are 0, null labels and ids are
    left out, of several labels of one id the highest holds. With no labels, or one only, every document
    gets one score.
    """
    rows = labelled_sample(labels, sample)
    if not rows:
        return Model()
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id")
    # A repeated id is learned from once: its first text in order.
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text")
    got = texts.mapInArrow(_vectors, "doc_id long, label int, buckets binary, values binary").collect()
    got.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"])))
    return trained([(np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float), r["label"]) for r in got])


def quality(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The rows of `docs` with score, the probability (0 to 1) of label 1.

    Null and empty texts, and those without a word, score the model's bias alone. Rows are neither joined
    nor shuffled: null and repeated ids and further columns pass through (score is the operator's own
    name); an empty table gives an empty table.
    """
    base = docs.drop("score")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema if keep_text or f.name != "text"]).add("score", T.DoubleType())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, out = _Digests(), to_arrow_schema(schema)
        for batch in batches:
            got = pa.array([model.score(*features(t, digests)) for t in batch["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([got if f.name == "score" else batch[f.name].cast(f.type) for f in out], schema=out)

    return base.mapInArrow(scored, schema)
