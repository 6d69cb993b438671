"""Counter-based random words and canonical digests: pure functions of their columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from gridspark.contracts import require

# Philox 4x64 multipliers, key increments and rounds.
M0, M1 = 0xD2E7470EE14C6C93, 0xCA5A826395121157
W0, W1 = 0x9E3779B97F4A7C15, 0xBB67AE8584CAA73B
ROUNDS = 10
_MASK = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _wide_product(m: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low words of a 64 x 64 bit product, from 32-bit halves."""
    ml, mh = np.uint64(m & 0xFFFFFFFF), np.uint64(m >> 32)
    xl, xh = x & _MASK, x >> _32
    ll, lh, hl, hh = ml * xl, ml * xh, mh * xl, mh * xh
    carry = (ll >> _32) + (lh & _MASK) + (hl & _MASK)
    return hh + (lh >> _32) + (hl >> _32) + (carry >> _32), np.uint64(m) * x


def philox_words(key: tuple[int, int], c0, c1, c2, c3) -> np.ndarray:
    """Four 64-bit words per row of counters."""
    c = [np.asarray(v, dtype=np.uint64) for v in (c0, c1, c2, c3)]
    k0, k1 = key
    with np.errstate(over="ignore"):
        for _ in range(ROUNDS):
            h0, l0 = _wide_product(M0, c[0])
            h1, l1 = _wide_product(M1, c[2])
            c = [h1 ^ c[1] ^ np.uint64(k0), l1, h0 ^ c[3] ^ np.uint64(k1), l0]
            k0, k1 = (k0 + W0) & (2**64 - 1), (k1 + W1) & (2**64 - 1)
    return np.stack(c, axis=-1)


def philox_key(seed: int, support: bytes, process: int) -> tuple[int, int]:
    """The key of a stream: the leading words of sha-256(seed, support digest, process)."""
    require(seed >= 0 and process >= 0, "seed", "philox_key", "a negative word")
    digest = hashlib.sha256(seed.to_bytes(8, "little") + support + process.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:16], "big")


def random_word(seed: int, support: bytes, process: int, cell: Column, time: Column, draw: Column) -> Column:
    """The first word of the draw as a BIGINT; the same wherever the row is computed."""
    key = philox_key(seed, support, process)

    @F.pandas_udf("bigint")
    def word(c: pd.Series, t: pd.Series, d: pd.Series) -> pd.Series:
        words = philox_words(key, c.to_numpy(np.int64).astype(np.uint64), t.to_numpy(np.int64).astype(np.uint64),
                             d.to_numpy(np.int64).astype(np.uint64), np.zeros(len(c), np.uint64))
        return pd.Series(words[:, 0].astype(np.int64))

    return word(cell, time, draw)


def canonical_digest(columns: Sequence[str]) -> Column:
    """sha-256 of the row as JSON with its fields in name order and nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
