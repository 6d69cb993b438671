"""Token counts by offsets: whole documents are encoded once, and their tokens attributed to sections.

A byte-level vocabulary gives every token a length in bytes, so running sums of lengths are the token
spans. Sections are character spans of the same text, turned into bytes by counting lead bytes. Spans
and sections are both in order, so they meet in one interval join: binary searches of the section ends
among the token spans, batch by batch, without a row per token.

A token that crosses a section boundary is allocated by an explicit rule: "first" gives it to the
section of its first byte, "most" to the section with most of its bytes (the earlier one in a tie),
"share" to every section by bytes. Bytes outside every section make the rest.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "share")

_encoders: dict[int, tuple] = {}


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to ids of a ranks file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _encoder(ranks: dict[bytes, int]):
    """(encoder, bytes of each token), made once in a worker."""
    import tiktoken

    key = id(ranks)
    if key not in _encoders:
        lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[key] = (tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths, ranks)
    return _encoders[key][:2]


def attribute(ends: np.ndarray, starts_of: np.ndarray, ends_of: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, from token ends and ordered disjoint section spans in bytes.

    A token crosses a section if it has bytes in it and bytes outside it.
    """
    begins = np.r_[0, ends[:-1]]
    n = len(starts_of)
    tokens, crossing = np.zeros(n, dtype=np.float64), np.zeros(n, dtype=np.int64)
    if not len(ends) or not n:
        return tokens, crossing
    # Tokens that begin at or after each section's start, and that end at or before its end, lie inside.
    inside_from, inside_to = np.searchsorted(begins, starts_of), np.searchsorted(ends, ends_of, side="right")
    solid = starts_of < ends_of
    tokens += np.where(solid, np.maximum(inside_to - inside_from, 0), 0)
    # The others that touch it: the one over its start and the one over its end, perhaps the same.
    for i in np.flatnonzero(solid):
        a, b = int(starts_of[i]), int(ends_of[i])
        over = {int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(begins, b, side="left")) - 1}
        for t in over:
            s, e = int(begins[t]) if t < len(ends) else b, int(ends[t]) if t < len(ends) else b
            part = min(e, b) - max(s, a)
            if part <= 0 or (s >= a and e <= b):
                continue
            crossing[i] += 1
            if rule == "share":
                tokens[i] += part / (e - s)
            elif rule == "first":
                tokens[i] += s >= a
            else:
                # The sections around hold the other bytes; the largest part wins, then the earliest.
                j = int(np.searchsorted(ends_of, s, side="right"))
                best, won = 0, -1
                while j < n and starts_of[j] < e:
                    p = min(e, int(ends_of[j])) - max(s, int(starts_of[j]))
                    if p > best:
                        best, won = p, j
                    j += 1
                tokens[i] += won == i
    return tokens, crossing


def _section_bytes(raw: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Byte offsets of character offsets; past the end is the end."""
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    at = np.r_[leads, len(raw)]
    return at[np.minimum(spans, len(leads))]


def section_tokens(docs: DataFrame, ranks: dict[bytes, int], sections: str | None = None, rule: str = "most") -> DataFrame:
    """The rows of `docs` with n_tokens, section_tokens and section_crossing (an entry per section), and n_outside.

    `sections` names a column of ordered disjoint spans, array<struct<start,end>> in characters; without
    it the sections are the lines, each with its line feed. n_outside is n_tokens less the tokens of all
    sections. A null text is empty and has no tokens; a null list of sections is empty; an empty section
    has no tokens. Rows are neither joined nor shuffled, so null and repeated ids and extra columns pass
    through (the four result names are replaced).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    held = docs.sparkSession.sparkContext.broadcast(ranks)   # a vocabulary file: tens of thousands of tokens
    base = docs.drop("n_tokens", "section_tokens", "section_crossing", "n_outside")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema])
    schema = schema.add("n_tokens", T.LongType()).add("section_tokens", T.ArrayType(T.DoubleType())).add("section_crossing", T.ArrayType(T.LongType())).add("n_outside", T.DoubleType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(held.value)
        out = to_arrow_schema(schema)
        for batch in batches:
            made = {"n_tokens": [], "section_tokens": [], "section_crossing": [], "n_outside": []}
            spans = batch[sections] if sections else None
            for i, value in enumerate(batch["text"]):
                text = value.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(lengths[encoder.encode_ordinary(text)]) if text else np.zeros(0, np.int64)
                if sections:
                    given = spans[i].values
                    a, b = (np.asarray(given.field(f)).astype(np.int64) if given is not None else np.zeros(0, np.int64) for f in ("start", "end"))
                    a, b = _section_bytes(raw, a), _section_bytes(raw, b)
                else:
                    b = np.r_[np.flatnonzero(raw == 10) + 1, len(raw)]
                    a = np.r_[0, b[:-1]]
                tokens, crossing = attribute(ends, a, b, rule)
                made["n_tokens"].append(len(ends))
                made["section_tokens"].append(tokens)
                made["section_crossing"].append(crossing)
                made["n_outside"].append(len(ends) - float(tokens.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if f.name in made else batch[f.name].cast(f.type) for f in out], schema=out)

    return base.mapInArrow(count, schema)


def joined_fields(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """Adds text, the fields joined by the separator, and sections, the span of each field; a null field is empty."""
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    out = df.withColumn("text", F.concat_ws(separator, *parts))
    at, spans = F.lit(0), []
    for p in parts:
        spans.append(F.struct(at.alias("start"), (at + F.char_length(p)).alias("end")))
        at = at + F.char_length(p) + len(separator)
    return out.withColumn("sections", F.array(*spans))
