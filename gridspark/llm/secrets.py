"""Secret scans with built-in functions: patterns, and sliding-window entropy of candidate strings.

Patterns give the base spans. Beside them, every long run of token characters is a candidate: it is
hexadecimal or of mixed classes, and is reported where the Shannon entropy of some window of twenty
characters reaches the level of its class. The window slides by one character at a time; only the
counts of the character that leaves and of the one that enters change the entropy. Candidates that an
allow-list names, or that overlap a base span, are not reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, in the order in which kinds are listed. Letters of keywords in either case.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# A run is matched to its end, so asking for its least length drops the same matches as testing it afterwards.
ACCESS_RUN = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
HEX_RUN = f"[0-9a-f]{{{LEAST_HEX},}}"

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
HEX_LEVEL, MIXED_LEVEL = 3.0, 3.7
ALLOWED = (
    r"[Ee]xample|EXAMPLE|[Pp]laceholder|[Cc]hangeme|[Dd]ummy",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
)
KINDS = ("assign", "access", "hex", "entropy")
_BLOCK = 256
_SPANS = "array<struct<start:int,end:int>>"


def _once(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often a function inside refers to it."""
    return F.transform(F.array(value), use)[0]


def _positions(zipped: Column) -> Column:
    """Spans from (gap before, length) of consecutive matches: running sums in blocks, then over blocks."""
    empty = F.array().cast(_SPANS)
    zero = F.lit(0)

    def block_spans(block: Column) -> Column:
        return F.aggregate(block, F.struct(zero.alias("at"), empty.alias("out")), lambda a, v: F.struct(
            (a["at"] + v["gap"] + v["len"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + v["gap"]).alias("start"), (a["at"] + v["gap"] + v["len"]).alias("end")))).alias("out")))

    def all_spans(z: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.floor((F.size(z) - 1) / _BLOCK).cast("int")), lambda b: block_spans(F.slice(z, b * _BLOCK + 1, _BLOCK)))
        start = F.struct(zero.alias("at"), F.array().cast(f"array<{_SPANS}>").alias("parts"))
        done = F.aggregate(blocks, start, lambda a, b: F.struct(
            (a["at"] + b["at"]).alias("at"),
            F.concat(a["parts"], F.array(F.transform(b["out"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"))))).alias("parts")))
        return F.flatten(done["parts"])

    return _once(zipped, all_spans)


def match_spans(df: DataFrame, name: str, text: str, pattern: str, group: int | None = None, least: int = 0) -> DataFrame:
    """Adds `name`: spans (start, end, value) of the leftmost non-overlapping matches; with `group`, of those whose group is long enough.

    The texts between matches give the positions, in code points.
    """
    p, t = F.lit(pattern), F.col(text)
    found, value = f"_{name}_m", f"_{name}_v"
    df = df.withColumn(found, F.regexp_extract_all(t, p, F.lit(0)))
    df = df.withColumn(value, F.col(found) if group is None else F.when(F.size(found) > 0, F.regexp_extract_all(t, p, F.lit(group))))
    gaps = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), F.col(found), lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len")))
    spans = F.zip_with(_positions(gaps), F.col(value), lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return df.withColumn(name, F.when(F.size(found) > 0, F.filter(spans, lambda s: F.char_length(s["value"]) >= least)).otherwise(none)).drop(found, value)


def _weight(count: Column) -> Column:
    """count * log2(count), from a table."""
    return F.element_at(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)]), count + 1)


def peak_entropy(value: Column) -> Column:
    """The highest Shannon entropy, in bits a character, of the windows of a string of at least one window."""

    def count(window: Column, c: Column) -> Column:
        return F.size(F.filter(window, lambda x: x == c))

    def slide(chars: Column) -> Column:
        first = F.slice(chars, 1, WINDOW)
        total = F.aggregate(F.array_distinct(first), F.lit(0.0), lambda a, c: a + _weight(count(first, c)))

        def step(a: Column, p: Column) -> Column:
            # p is the window's first character, which leaves; p + WINDOW enters.
            window, out, new = F.slice(chars, p, WINDOW), chars[p - 1], chars[p - 1 + WINDOW]
            n_out = count(window, out)
            n_new = count(window, new) - F.when(out == new, 1).otherwise(0)
            s = a["s"] - _weight(n_out) + _weight(n_out - 1) - _weight(n_new) + _weight(n_new + 1)
            return F.struct(s.alias("s"), F.least(a["least"], s).alias("least"))

        steps = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(F.array().cast("array<int>"))
        # Equal steps in and out would let rounding creep; sums of table values stay within 1e-9 of the exact one.
        best = F.aggregate(steps, F.struct(total.alias("s"), total.alias("least")), step)["least"]
        return F.lit(math.log2(WINDOW)) - best / WINDOW

    return _once(F.split(value, ""), slide)


def scan_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows of `docs` with assign, access, hex and entropy: sorted spans (start, end, value), end exclusive, in code points.

    `value` is what is secret: the assigned value, or the matched string. A null or empty text has no
    span. Rows are neither joined nor shuffled, so null and repeated ids and extra columns pass through
    (columns named like the four kinds are replaced).
    """
    df = docs.drop(*KINDS).withColumn("_text", F.coalesce("text", F.lit("")))
    df = match_spans(df, "assign", "_text", ASSIGN, 2, LEAST_VALUE)
    df = match_spans(df, "access", "_text", ACCESS_RUN)
    df = match_spans(df, "hex", "_text", HEX_RUN)
    df = match_spans(df, "_candidates", "_text", CANDIDATE)

    def wanted(s: Column) -> Column:
        v = s["value"]
        named = None
        for p in allowed:
            one = v.rlike(p)
            named = one if named is None else named | one
        level = F.when(v.rlike("^[0-9a-fA-F]+$"), HEX_LEVEL).otherwise(MIXED_LEVEL)
        high = peak_entropy(v) >= level
        return high if named is None else F.when(named, F.lit(False)).otherwise(high)

    base = F.concat("assign", "access", "hex")
    free = F.when(F.size("_candidates") > 0, _once(F.struct(base.alias("base"), F.col("_candidates").alias("c")), lambda g: F.filter(
        g["c"], lambda s: ~F.exists(g["base"], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))).otherwise(F.col("_candidates"))
    df = df.withColumn("_free", free)
    return df.withColumn("entropy", F.filter("_free", wanted)).drop("_text", "_candidates", "_free")


def span_list(*kinds: str) -> Column:
    """kind:start:end of all spans of the kinds, by start, then in the order of kinds, joined by commas."""

    def placed(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    parts = [placed(k) for k in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    written = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(written, ",")
