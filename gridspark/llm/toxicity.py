"""Toxicity by maximum-scoring segments over token log-odds.

A token is a whole word or its leading characters at three lengths, so that a stem learned from some
words also speaks for words not seen in training. In scripts without spaces a word is a whole clause, so
its two and three neighbouring characters are tokens too, and the best segment of them speaks for it. Log-odds of a document of either label to hold a token come
from a hierarchical Dirichlet prior: a token's prior counts are its parent's rates times the token's
share of the parent over the whole corpus. Words score their most specific token, every other word
costs a constant drift, and one linear scan finds all maximal-scoring segments of a text (the
disjoint segments none of which can be extended or split at a gain). Scores of segments by chance
follow K n exp(-lambda S), fitted on clean documents; the best segment's excess over that law and
the number of significant segments give the probability by a two-feature logistic fit.

Learning takes labelled rows of a bounded sample, in the order of a digest of their ids; the corpus
shares and the scores take every document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridspark.llm.common import LOWER, UPPER, first_by_digest
from gridspark.session import settled

SAMPLE = 20_000        # labelled rows learned from, at most
LEVELS = (6, 7, 8)     # leading characters of a word with its end mark; the whole word is the last level
GRAMS = (2, 3)         # neighbouring characters in scripts without spaces
LONGEST = 40           # bytes of a whole word as such; a longer one is told by its beginning and a digest
SUPPORT = 3            # toxic documents a token needs to be considered
PRIOR = 2.0            # prior documents
LEAST_Z, LEAST_ODDS = 2.8, 2.5
DRIFT = 0.05
SIGNIFICANT = 0.05     # expected segments by chance, in a text of its length, at most
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

_TABLE = bytearray(b" " * 256)
for _c in range(256):
    if _c > 0x7F or chr(_c).isdigit() or chr(_c) in LOWER:
        _TABLE[_c] = _c
for _u, _l in zip(UPPER, LOWER):
    _TABLE[ord(_u)] = ord(_l)
_TABLE = bytes(_TABLE)
# Closes a word, so that a whole word is told from the beginning of a longer one.
END = b"$"
# Begins a token of neighbouring characters, and stands before the digest of a long word; neither is in any word.
GRAM, DIGEST = "~", b"#"
# Thai, Lao, Tibetan, Myanmar, Khmer, kana and ideographs.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")


def _chars(token: bytes) -> str:
    return token.decode("utf-8", "surrogateescape")


def _bytes(chars: str) -> bytes:
    return chars.encode("utf-8", "surrogateescape")


def _levels(marked: bytes) -> list[bytes]:
    """A word with its end mark at every level from the shortest."""
    if marked.isascii():
        out = [marked[:n] for n in LEVELS]
    else:
        chars = _chars(marked)
        out = [_bytes(chars[:n]) for n in LEVELS]
    out.append(marked if len(marked) <= LONGEST else out[-1] + DIGEST + blake2b(marked, digest_size=16).digest())
    return out


def _grams(word: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(position, tokens from the shortest) of every character that begins one in a script without spaces."""
    for run in _UNSPACED.finditer(_chars(word)):
        found = run[0]
        for i in range(len(found) - GRAMS[0] + 1):
            yield run.start() + i, [_bytes(GRAM + found[i:i + n]) for n in GRAMS if i + n <= len(found)]


def tokens_of(word: bytes) -> list[bytes]:
    """Tokens of a word from the shortest; a word shorter than a level ends in the end mark there."""
    out = _levels(word + END)
    if not word.isascii():
        out += [t for _, ts in _grams(word) for t in ts]
    return list(dict.fromkeys(out))


def shorter(token: bytes) -> list[bytes]:
    """The shorter tokens a token begins with, from the shortest."""
    if token.isascii():
        return [token[:n] for n in LEVELS if n < len(token)]
    chars = _chars(token)
    return [_bytes(chars[:n]) for n in ((n + 1 for n in GRAMS) if chars[0] == GRAM else LEVELS) if n < len(chars)]


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether crc32 of the id as text leaves the held-out remainder; null ids are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


@dataclass
class Model:
    odds: dict[bytes, float] = field(default_factory=dict)   # token -> log-odds; 0 stops the look at shorter tokens
    rate: float = 1.0                                        # lambda
    k: float = 0.01
    bias: float = -3.0
    excess: float = 0.0
    many: float = 0.0

    def events(self, text: bytes) -> tuple[list[tuple[int, float]], int]:
        """(word position, log-odds) of the words that score, and the number of words."""
        words = text.translate(_TABLE).split()
        out: list[tuple[int, float]] = []
        if self.odds:
            a, known = LEVELS[0], self.odds
            for j, w in enumerate(words):
                if w.isascii():
                    # The shortest token of every known one is known.
                    if (w + END)[:a] not in known:
                        continue
                    s = self.most_specific(_levels(w + END))
                else:
                    s = max(self.most_specific(_levels(w + END)), self.clause(w))
                if s:
                    out.append((j, s))
        return out, len(words)

    def most_specific(self, tokens: list[bytes]) -> float:
        """Log-odds of the last known of some tokens."""
        return next((s for t in reversed(tokens) if (s := self.odds.get(t)) is not None), 0.0)

    def clause(self, word: bytes) -> float:
        """The best segment of neighbouring characters, each read once; a character costs the drift a word does."""
        found, free = [], 0
        for i, tokens in _grams(word):
            if i >= free and (t := next((t for t in reversed(tokens) if t in self.odds), None)) is not None and self.odds[t]:
                found.append((i, self.odds[t]))
                free = i + len(_chars(t)) - 1
        return max((s for *_, s in maximal_segments(found)), default=0.0)

    def features(self, text: bytes) -> tuple[float, float, int, list[tuple[int, int, float]]]:
        """(excess of the best segment, log of significant segments, words, the significant segments)."""
        found, n = self.events(text)
        if not found:
            return 0.0, 0.0, n, []
        segments = maximal_segments(found)
        chance = math.log(self.k * max(n, 1))
        best = max(s for *_, s in segments)
        strong = [x for x in segments if chance - self.rate * x[2] <= math.log(SIGNIFICANT)]
        return min(30.0, max(0.0, self.rate * best - chance)), math.log1p(len(strong)), n, strong

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        x, m, _, strong = self.features(text)
        return 1.0 / (1.0 + math.exp(-(self.bias + self.excess * x + self.many * m))), strong


def maximal_segments(events: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word + 1, score) of positive events with drift between.

    Each candidate keeps the running sums before and after it. A new event looks back for the nearest
    candidate that starts lower; it joins it if it also ends higher, and stands alone otherwise.
    """
    stack: list[tuple[int, int, float, float, int]] = []   # first, last + 1, sum before, sum after, lower candidate
    total, last = 0.0, -1
    for at, s in events:
        total -= drift * (at - last - 1)
        new = (at, at + 1, total, total + s)
        total, last = total + s, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append((*new, j))
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch["bytes"]:
        yield t.as_py() or b""


def _token_counts(vocabulary: frozenset[bytes] | None):
    """Documents per (token, label): of all tokens, or of a vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def out():
            for label, c in seen.items():
                yield pa.RecordBatch.from_pydict({"token": pa.array(list(c), pa.binary()), "label": pa.array([label] * len(c), pa.int32()),
                                                  "n": pa.array(list(c.values()), pa.int64())})
            seen.clear()

        for batch in batches:
            labels = batch["label"].to_pylist()
            for text, label in zip(_texts(batch), labels):
                words = set(text.translate(_TABLE).split())
                if vocabulary is not None:
                    short = LEVELS[0]
                    words = {w for w in words if not w.isascii() or (w + END)[:short] in vocabulary}
                found = {t for w in words for t in tokens_of(w)}
                seen.setdefault(label, Counter()).update(found if vocabulary is None else found & vocabulary)
            # A task holds the counts of a vocabulary, or of a few batches of all tokens.
            if vocabulary is None and sum(map(len, seen.values())) > 500_000:
                yield from out()
        yield from out()

    return count


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> list:
    """Rows (doc_id, label) of at most `sample` rows outside the held-out fold, first by the digest of the id."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(~held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    return first_by_digest(one, F.xxhash64("doc_id"), sample)


def token_odds(counts: dict[bytes, tuple[int, int]], corpus: dict[bytes, int], n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """token -> log-odds, from (toxic, clean) documents per token and documents per token of the corpus."""
    parent = {t: next((p for p in reversed(shorter(t)) if p in counts), None) for t in counts}
    out = {}
    for t, (y1, y0) in counts.items():
        p = parent[t]
        if p is None:
            share, r1, r0 = 0.5, 1.0 / (n_toxic + 1), 1.0 / (n_clean + 1)
        else:
            share = min(1.0, corpus.get(t, 0) / max(1, corpus.get(p, 1)))
            r1, r0 = (counts[p][0] + 0.5) / (n_toxic + 1), (counts[p][1] + 0.5) / (n_clean + 1)
        a1, a0 = y1 + max(PRIOR * r1 * share, 1e-3), y0 + max(PRIOR * r0 * share, 0.5)
        odds = math.log(a1 / max(n_toxic + PRIOR - a1, 0.5)) - math.log(a0 / max(n_clean + PRIOR - a0, 0.5))
        z = odds / math.sqrt(1 / a1 + 1 / a0)
        out[t] = odds if z >= LEAST_Z and odds >= LEAST_ODDS else 0.0
    # A short token that is kept only for the sake of longer ones scores nothing itself.
    useful = {t for t, s in out.items() if s > 0}
    useful |= {p for t in useful for p in shorter(t)}
    return {t: out.get(t, 0.0) for t in useful | {t for t in out if any(p in useful for p in shorter(t))}}


def can_pass(n_toxic: int, n_clean: int) -> Column:
    """Whether a token with y1 toxic and y0 clean documents could pass under some parent: no token that passes is left out.

    A prior adds at most PRIOR to either count, and at least half a document to the clean one.
    """
    a1, a0 = F.col("y1") + PRIOR, F.col("y0") + 0.5
    odds = F.log(a1 / F.greatest(F.lit(n_toxic + PRIOR) - a1, F.lit(0.5))) - F.log(a0 / F.greatest(F.lit(n_clean + PRIOR) - a0, F.lit(0.5)))
    z = odds / F.sqrt(1 / a1 + 1 / (F.col("y0") + max(PRIOR, 0.5)))
    return (F.col("y1") >= SUPPORT) & (odds >= LEAST_ODDS - 1e-6) & (z >= LEAST_Z - 1e-6)


def _relatives(passing: frozenset[bytes]):
    """Of counted tokens those given, what they begin with, and what begins with them."""
    family = passing | {p for t in passing for p in shorter(t)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([t in family or any(p in passing for p in shorter(t)) for t in batch["token"].to_pylist()], pa.bool_()))

    return pick


def learned_counts(counted: DataFrame, n_toxic: int, n_clean: int) -> dict[bytes, tuple[int, int]]:
    """token -> (toxic, clean) documents, of all tokens that can bear on a score.

    These are the tokens that can pass, their parents, and the longer tokens that can stop them: those
    seen in SUPPORT documents of either label.
    """
    passing = frozenset(bytes(r["token"]) for r in counted.filter(can_pass(n_toxic, n_clean)).select("token").collect())
    seen = counted.filter((F.col("y1") >= SUPPORT) | (F.col("y0") >= SUPPORT))
    return {bytes(r["token"]): (r["y1"], r["y0"]) for r in seen.mapInArrow(_relatives(passing), seen.schema).collect()}


def chance_law(n: int, low: float, mid: float, words: int) -> tuple[float, float]:
    """(lambda, K) of the exponential tail of n segment scores, by their least and median, in clean documents of `words` words altogether."""
    if n < 8 or not words:
        return 1.0, max(n, 1) / max(words, 1)
    rate = math.log(2) / max(mid - low, 0.05)
    rate = min(max(rate, 0.1), 2.0)
    return rate, n * math.exp(rate * low) / words


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (bias first) by Newton steps with a small ridge; slopes are not let below zero."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] = np.maximum(w[1:], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the labelled sample, with corpus shares from all documents.

    What reaches the driver is bounded by the sample: `sample` ids, those of its tokens that can bear on a
    score, and one small row of features for each sampled document. Without toxic or without clean rows the model says nothing: every text
    then scores the same low probability.
    """
    rows = labelled_sample(labels, sample)
    if not any(r["label"] for r in rows) or all(r["label"] for r in rows):
        return Model()
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(r["doc_id"], r["label"]) for r in rows], "doc_id long, label int"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("bytes"))
    learned = texts.join(picked, "doc_id").select("bytes", "label")
    schema = "token binary, label int, n long"
    counted = learned.mapInArrow(_token_counts(None), schema).groupBy("token").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("y1"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("y0"))
    n1 = sum(r["label"] for r in rows)
    counts = learned_counts(settled(counted), n1, len(rows) - n1)
    shares = texts.select("bytes", F.lit(0).alias("label")).mapInArrow(_token_counts(frozenset(counts)), schema)
    corpus = {bytes(r["token"]): r["n"] for r in shares.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    model = Model(odds=token_odds(counts, corpus, n1, len(rows) - n1))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, n, labels_ = [], [], batch["label"].to_pylist()
            for text in _texts(batch):
                found, words = model.events(text)
                best.append([s for *_, s in maximal_segments(found)])
                n.append(words)
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels_, pa.int32()), "words": pa.array(n, pa.int64()), "segments": pa.array(best, pa.list_(pa.float64()))})

    scores = settled(learned.mapInArrow(segments, "label int, words long, segments array<double>"))
    clean = scores.filter("label = 0")
    law = clean.select(F.explode("segments").alias("s")).agg(F.count("*").alias("n"), F.min("s").alias("low"), F.percentile("s", F.lit(0.5)).alias("mid")).first()
    model.rate, model.k = chance_law(law["n"], law["low"], law["mid"], clean.agg(F.sum("words")).first()[0] or 0)
    chance = F.log(F.lit(model.k) * F.greatest(F.col("words"), F.lit(1)))
    strong = F.size(F.filter("segments", lambda s: chance - F.lit(model.rate) * s <= math.log(SIGNIFICANT)))
    excess = F.least(F.lit(30.0), F.greatest(F.lit(0.0), F.lit(model.rate) * F.array_max("segments") - chance))
    seen = scores.select("label", F.when(F.size("segments") > 0, excess).otherwise(0.0).alias("excess"), strong.alias("strong")).collect()
    seen.sort()
    x = np.array([(r["excess"], math.log1p(r["strong"])) for r in seen]).reshape(-1, 2)
    y = np.array([r["label"] for r in seen], dtype=float)
    model.bias, model.excess, model.many = map(float, logistic(x, y))
    return model


def toxicity(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """The rows of `docs` with score (0 to 1) and passages: the significant segments (first word, last word + 1, score).

    A null or empty text has no segment and scores the model's base probability. Rows are neither joined
    nor shuffled: null and repeated ids and extra columns pass through (score, passages and bytes are the
    operator's own names); an empty table gives an empty table.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    base = docs.drop("score", "passages", "bytes")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema if keep_text or f.name != "text"])
    schema.add("score", T.DoubleType()).add("passages", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("score", T.DoubleType())))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            got = [model.score(t) for t in _texts(batch)]
            made = {"score": [s for s, _ in got], "passages": [[{"start": a, "end": b, "score": s} for a, b, s in p] for _, p in got]}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else batch[f.name].cast(f.type) for f in out], schema=out)

    given = base.withColumn("bytes", F.col("text").cast("binary"))
    return (given if keep_text else given.drop("text")).mapInArrow(scored, schema)
