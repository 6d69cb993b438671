"""Conversation structure repair: the cheapest edits that give alternating turns, by divide and conquer.

The roles of a repaired conversation are nothing, or an optional system turn and then user, assistant,
user, assistant and so on. Four states say what the repaired turns end in so far: nothing, system, user,
assistant. Every row is a 4 x 4 table of the cheapest edit between two states (inserts before it
included), and so is every stretch of rows. Hirschberg's method finds the edits in linear space: a
forward cost vector up to the middle row and a backward one behind it meet, the cheapest crossing with
the least audit is fixed, and both halves follow alone. The forward vector carries how the audits that
lead to its four states compare; two of them never begin with one another, so that order decides.

At scale rows are range-partitioned by conversation and turn, and a task reads its conversations one
after another. One that lies whole in a task and has at most `CHUNK` rows is done there. The others are
chunks of at most `CHUNK` rows: their tables are multiplied up a tree of fan-out `FAN`, the crossings are
handed down the same tree, and each chunk is then edited on its own, so no task holds a long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.llm.common import SPACE, same
from gridspark.session import settled

CHUNK = 1024                # rows of a conversation edited together, at most
CHUNK_CHARS = 4 << 20       # and their characters, unless one row alone has more
FAN = 256                   # chunks or stretches whose tables are multiplied in one group

# Costs and roles of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SYSTEM, USER, ASSISTANT = 1, 2, 3
NEXT = (USER, USER, ASSISTANT, USER)     # the one turn that an insert or a new role can give in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
CODES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {"su", "ua", "au"}
FINE, CUT, GONE = 0, 1, 2                # a row without fault, a truncated one, one that has to go
FAR = 1 << 60

Table = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]   # costs and audit ranks, by state before and after
EMPTY: Table = (tuple(tuple(0 if p == q else FAR for q in range(4)) for p in range(4)), ((0,) * 4,) * 4)
# What is left to insert in each state at the end.
TAIL = (0, 2, 1, 0)


@lru_cache(maxsize=None)
def row_edits(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of the cheapest edit of a row, inserts before it included."""
    code, fault = divmod(kind, 3)
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for p in range(4):
        at = p
        for n in range(3):
            options = [(at, DELETE, "D")]
            if fault != GONE:
                extra = TRUNCATED if fault == CUT else 0
                options.append((NEXT[at], RENAME + extra, "R"))
                if code == NEXT[at] or (code == SYSTEM and at == 0):
                    options.append((code, extra, "K"))
            for q, cost, edit in options:
                found = (n * INSERT + cost, "I" * n + edit)
                out[p, q] = min(found, out.get((p, q), found))
            at = NEXT[at]
    return out


@lru_cache(maxsize=None)
def row_table(kind: int) -> Table:
    edits = row_edits(kind)
    costs, ranks = [], []
    for p in range(4):
        order = sorted((edits[p, q][1], q) for q in range(4) if (p, q) in edits)
        place = {q: i for i, (_, q) in enumerate(order)}
        costs.append(tuple(edits[p, q][0] if (p, q) in edits else FAR for q in range(4)))
        ranks.append(tuple(place.get(q, 4) for q in range(4)))
    return tuple(costs), tuple(ranks)


@lru_cache(maxsize=1 << 16)
def _onward(cost: tuple[int, ...], rank: tuple[int, ...], table: Table) -> tuple[tuple[int, ...], tuple[int, ...]]:
    costs, ranks = table
    new, audit = [FAR] * 4, [(4, 4)] * 4
    for q in range(4):
        best = min(((cost[m] + costs[m][q], rank[m], m) for m in range(4) if cost[m] < FAR and costs[m][q] < FAR), default=None)
        if best:
            new[q], audit[q] = best[0], (best[1], ranks[best[2]][q])
    place = {a: i for i, a in enumerate(sorted(set(audit)))}
    return tuple(new), tuple(place[a] for a in audit)


def onward(cost: tuple[int, ...], rank: tuple[int, ...], table: Table) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """A forward vector moved across a table: the cost of each state, and the order of their least audits."""
    low = min(cost)
    new, rank = _onward(tuple(c - low if c < FAR else FAR for c in cost), rank, table)
    return tuple(c + low if c < FAR else FAR for c in new), rank


def forward(tables: list[Table], lo: int, hi: int, start: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    cost, rank = tuple(0 if s == start else FAR for s in range(4)), (0,) * 4
    for i in range(lo, hi):
        cost, rank = onward(cost, rank, tables[i])
    return cost, rank


@lru_cache(maxsize=1 << 16)
def _back(cost: tuple[int, ...], table: Table) -> tuple[int, ...]:
    return tuple(min(FAR, min(table[0][m][q] + cost[q] for q in range(4))) for m in range(4))


def backward(tables: list[Table], lo: int, hi: int, end: int) -> tuple[int, ...]:
    cost, low = tuple(0 if s == end else FAR for s in range(4)), 0
    for i in range(hi - 1, lo - 1, -1):
        least = min(cost)
        cost, low = _back(tuple(c - least if c < FAR else FAR for c in cost), tables[i]), low + least
    return tuple(c + low if c < FAR else FAR for c in cost)


def product(tables: list[Table]) -> Table:
    """The table of a stretch of tables."""
    rows = [forward(tables, 0, len(tables), p) for p in range(4)]
    return tuple(c for c, _ in rows), tuple(r for _, r in rows)


def end_state(table: Table) -> int:
    """The state in which a conversation with this table ends, before what is left to insert."""
    costs, ranks = table[0][0], table[1][0]
    return min(range(4), key=lambda q: (costs[q] + INSERT * TAIL[q], ranks[q]))


def crossings(tables: list[Table], start: int, end: int) -> list[int]:
    """The state before each table and after the last, on the cheapest way of least audit."""
    states = [start] * (len(tables) + 1)
    states[-1] = end
    todo = [(0, len(tables))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        cost, rank = forward(tables, lo, mid, states[lo])
        rest = backward(tables, mid, hi, states[hi])
        states[mid] = min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))
        todo += [(lo, mid), (mid, hi)]
    return states


def edits_of(kinds: bytes, start: int, end: int) -> str:
    """The audit of rows between two states."""
    states = crossings([row_table(k) for k in kinds], start, end)
    return "".join(row_edits(k)[p, q][1] for k, p, q in zip(kinds, states, states[1:]))


@lru_cache(maxsize=1 << 14)
def whole_audit(kinds: bytes) -> str:
    """The audit of a whole conversation."""
    if not kinds:
        return ""
    end = end_state(product([row_table(k) for k in kinds]))
    return edits_of(kinds, 0, end) + "I" * TAIL[end]


def audit_cost(audit: str, kinds: bytes) -> int:
    rows = iter(kinds)
    return sum(INSERT if e == "I" else {"D": DELETE, "R": RENAME, "K": 0}[e] + (TRUNCATED if next(rows) % 3 == CUT and e != "D" else 0) for e in audit)


def apply_edits(audit: str, turns: list[dict], start: int = 0) -> list[dict]:
    """The repaired turns that an audit gives."""
    out, state, rows = [], start, iter(turns)
    for edit in audit:
        row = None if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = CODES[row["role"][:1]]
            out.append(row)
        else:
            state = NEXT[state]
            out.append({"role": NAMES[state], "text": row["text"] if row else ""})
    return out


def row_mark(role: str, text: str) -> bytes:
    """A digest of 128 bits that tells rows of a long conversation apart."""
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, person=blake2b(role.encode("utf-8", "surrogatepass"), digest_size=16).digest()).digest()


def _kind(role: str, text: str, seen: bool) -> tuple[int, str]:
    """(kind, first fault) of a row."""
    code = CODES.get(role[:1], 0)
    rest = text.rstrip(SPACE)
    if not rest:
        return 3 * code + GONE, "blank"
    if seen:
        return 3 * code + GONE, "duplicate"
    return (3 * code + CUT, "truncated") if rest[-1] not in ".!?" else (3 * code, "")


TURN = T.StructType().add("role", T.StringType()).add("text", T.StringType())
COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal")


def _piece_schema(conv: T.DataType) -> T.StructType:
    out = T.StructType().add("conv_id", conv).add("part", T.IntegerType()).add("seq", T.LongType()).add("whole", T.BooleanType())
    for c in COUNTS:
        out.add(c, T.LongType())
    out.add("first_turn", T.LongType()).add("last_turn", T.LongType()).add("n_turns", T.LongType()).add("first_role", T.StringType()).add("last_role", T.StringType())
    return out.add("cost", T.LongType()).add("audit", T.StringType()).add("turns", T.ArrayType(TURN)).add("kinds", T.BinaryType()).add("marks", T.ArrayType(T.BinaryType()))


class _Chunk:
    """Rows of one conversation as they come, in order."""

    def __init__(self, conv, part: int, seq: int) -> None:
        self.conv, self.part, self.seq = conv, part, seq
        self.turns: list[dict] = []
        self.numbers: list[int | None] = []
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append({"role": role, "text": text})
        self.numbers.append(turn)
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.turns) >= CHUNK or self.chars >= CHUNK_CHARS

    def row(self, whole: bool) -> dict:
        seen: set[tuple[str, str]] = set()
        kinds, faults = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for t in self.turns:
            pair = (t["role"], t["text"])
            kind, fault = _kind(*pair, pair in seen)
            seen.add(pair)
            kinds.append(kind)
            faults[fault] += 1
        initials = [t["role"][:1] for t in self.turns]
        numbers = [n for n in self.numbers if n is not None]
        out = {"conv_id": self.conv, "part": self.part, "seq": self.seq, "whole": whole, "n_rows": len(self.turns), **{k: n for k, n in faults.items() if k}}
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        out |= {"first_turn": min(numbers, default=None), "last_turn": max(numbers, default=None), "n_turns": len(set(numbers))}
        out |= {"first_role": initials[0] if initials else None, "last_role": initials[-1] if initials else None}
        if whole:
            audit = whole_audit(bytes(kinds))
            return out | {"audit": audit, "cost": audit_cost(audit, bytes(kinds)), "turns": apply_edits(audit, self.turns), "kinds": None, "marks": None}
        marks = [row_mark(t["role"], t["text"]) for t in self.turns]
        return out | {"audit": None, "cost": None, "turns": self.turns, "kinds": bytes(kinds), "marks": marks}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], type=f.type) for f in schema], schema=schema)


def _emitted(rows: Iterator[tuple[dict, int]], schema: pa.Schema, most: int = 256, chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows, each with its number of characters, in batches of bounded size."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= most or size >= chars:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _pieces(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            now, first = None, True
            for batch in batches:
                for conv, ghost, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "_ghost", "turn", "role", "text"))):
                    if now is None or now.conv != conv or now.full():
                        seq = 0
                        if now is not None:
                            ends = now.conv != conv
                            # The first and the last conversation of a task may go on in another one.
                            yield now.row(ends and not first and now.seq == 0), now.chars
                            first, seq = first and not ends, 0 if ends else now.seq + 1
                        now = _Chunk(conv, part, seq)
                    if not ghost:
                        now.add(turn, role, text)
            if now is not None:
                yield now.row(False), now.chars

        yield from _emitted(rows(), to_arrow_schema(schema))

    return run


def _known(df: DataFrame) -> DataFrame:
    """Copies of rows met in an earlier chunk of their conversation are marked as duplicates."""
    met = df.select("conv_id", "part", "seq", F.explode(F.array_distinct("marks")).alias("mark"))
    first = met.groupBy("conv_id", "mark").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n").withColumnsRenamed({"conv_id": "_c", "mark": "_m"})
    later = met.join(first, same(met, first, [("conv_id", "_c"), ("mark", "_m")])).filter(F.struct("part", "seq") > F.col("first"))
    later = later.groupBy("conv_id", "part", "seq").agg(F.collect_set("mark").alias("_old")).withColumnsRenamed({"conv_id": "_c", "part": "_p", "seq": "_s"})
    return df.join(later, same(df, later, [("conv_id", "_c"), ("part", "_p"), ("seq", "_s")]), "left").drop("_c", "_p", "_s")


def _tabled(schema: T.StructType):
    """Chunks with their duplicates settled, and the table of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    old = set(row.pop("_old") or ())
                    kinds = bytearray(row["kinds"])
                    for i, (t, mark) in enumerate(zip(row["turns"], row["marks"])):
                        if mark in old and kinds[i] % 3 != GONE:
                            row["duplicate"] += 1
                            row["truncated"] -= kinds[i] % 3 == CUT
                            kinds[i], _ = _kind(t["role"], t["text"], True)
                    costs, ranks = product([row_table(k) for k in kinds])
                    yield row | {"kinds": bytes(kinds), "costs": [c for r in costs for c in r], "ranks": [c for r in ranks for c in r]}, sum(len(t["text"]) for t in row["turns"])

        yield from _emitted(rows(), to_arrow_schema(schema))

    return run


def _table_of(costs, ranks) -> Table:
    four = lambda x: tuple(tuple(int(v) for v in x[4 * i:4 * i + 4]) for i in range(4))
    return four(costs), four(ranks)


def _up(conv: T.DataType):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("ordinal")
        costs, ranks = product([_table_of(c, r) for c, r in zip(nodes["costs"], nodes["ranks"])])
        out = nodes.iloc[:1][["conv_id"]].copy()
        out["ordinal"] = int(nodes["ordinal"].iloc[0]) // FAN
        out["costs"], out["ranks"] = [[c for r in costs for c in r]], [[c for r in ranks for c in r]]
        return out

    return run


def _down(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("ordinal")
    states = crossings([_table_of(c, r) for c, r in zip(nodes["costs"], nodes["ranks"])], int(nodes["p"].iloc[0]), int(nodes["q"].iloc[0]))
    return nodes[["conv_id", "ordinal"]].assign(p=states[:-1], q=states[1:])


def _states(nodes: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv_id, ordinal, p, q, last): the states before and after each chunk, up and down a tree of tables."""
    node = T.StructType().add("conv_id", conv).add("ordinal", T.LongType()).add("costs", T.ArrayType(T.LongType())).add("ranks", T.ArrayType(T.LongType()))
    state = T.StructType().add("conv_id", conv).add("ordinal", T.LongType()).add("p", T.LongType()).add("q", T.LongType())
    levels = [nodes]
    while (levels[-1].agg(F.max("ordinal")).first()[0] or 0) > 0:
        levels.append(settled(levels[-1].groupBy("conv_id", (F.col("ordinal") / FAN).cast("long").alias("_up")).applyInPandas(_up(conv), node)))

    @F.udf("long")
    def ended(costs, ranks):
        return end_state(_table_of(costs, ranks))

    found = levels[-1].select("conv_id", "ordinal", F.lit(0).cast("long").alias("p"), ended("costs", "ranks").alias("q"))
    for level in reversed(levels[:-1]):
        above = found.withColumnsRenamed({"conv_id": "_c", "ordinal": "_o"})
        below = level.withColumn("_up", (F.col("ordinal") / FAN).cast("long"))
        met = below.join(above, same(below, above, [("conv_id", "_c"), ("_up", "_o")]))
        found = settled(met.select("conv_id", "_up", "ordinal", "costs", "ranks", "p", "q").groupBy("conv_id", "_up").applyInPandas(_down, state))
    return found


def _edited(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    audit = edits_of(row["kinds"], row["p"], row["q"]) + ("I" * TAIL[row["q"]] if row["last"] else "")
                    yield row | {"audit": audit, "cost": audit_cost(audit, row["kinds"]), "turns": apply_edits(audit, row["turns"], row["p"]), "kinds": None, "marks": None}, sum(len(t["text"]) for t in row["turns"])

        yield from _emitted(rows(), to_arrow_schema(schema))

    return run


def _long(open_: DataFrame, schema: T.StructType) -> DataFrame:
    """The chunks of conversations that do not lie whole in one chunk, edited."""
    conv = schema["conv_id"].dataType
    tabled = T.StructType(list(schema)).add("costs", T.ArrayType(T.LongType())).add("ranks", T.ArrayType(T.LongType()))
    chunks = settled(_known(open_).mapInArrow(_tabled(tabled), tabled))
    # A task numbers its own chunks; those of earlier tasks stand before them.
    before = chunks.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn(
        "_before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.withColumn("_total", F.sum("n").over(Window.partitionBy("conv_id"))).withColumnsRenamed({"conv_id": "_c", "part": "_p"}).drop("n")
    narrow = chunks.select("conv_id", "part", "seq", "costs", "ranks")
    placed = narrow.join(before, same(narrow, before, [("conv_id", "_c"), ("part", "_p")]))
    placed = settled(placed.select("conv_id", "part", "seq", (F.coalesce("_before", F.lit(0)) + F.col("seq")).alias("ordinal"), "_total", "costs", "ranks"))
    states = _states(placed.select("conv_id", "ordinal", "costs", "ranks"), conv).withColumnsRenamed({"conv_id": "_c", "ordinal": "_o"})
    at = placed.join(states, same(placed, states, [("conv_id", "_c"), ("ordinal", "_o")]))
    at = at.select(F.col("conv_id").alias("_i"), F.col("part").alias("_p"), F.col("seq").alias("_s"), "ordinal", (F.col("ordinal") == F.col("_total") - 1).alias("last"), "p", "q")
    met = chunks.drop("costs", "ranks").join(at, same(chunks, at, [("conv_id", "_i"), ("part", "_p"), ("seq", "_s")])).drop("_i", "_p", "_s")
    met = met.withColumn("seq", F.col("ordinal")).withColumn("part", F.lit(0))
    return met.mapInArrow(_edited(schema), schema)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Repaired conversations, one row for each piece of one, from rows of (conv_id, turn, role, text).

    Returns conv_id, seq (number of the piece), whole (the piece is the conversation), n_rows, blank,
    duplicate, truncated (rows by first fault), illegal (adjacent roles inside the piece), first_turn,
    last_turn, n_turns (distinct), first_role, last_role (initials), cost, audit and turns (the repaired
    role and text of each turn). `ids` names conversations to return even where they have no row.

    Rows are ordered by turn, nulls first, then by role, the first 64 characters of the text and a digest
    of it. Null roles and texts are one space, a null conv_id is one conversation, rows given twice are
    duplicates, empty texts are blank. Further columns are not read. An empty table gives an empty table.
    """
    conv = rows.schema["conv_id"].dataType
    schema = _piece_schema(conv)
    given = rows.select("conv_id", F.lit(False).alias("_ghost"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_salt"))
    if ids is not None:
        given = given.unionByName(ids.select("conv_id").distinct().withColumn("_ghost", F.lit(True)), allowMissingColumns=True)
    # Long texts stay out of the sampled range keys; rows alike in all else may part anywhere.
    order = [F.asc_nulls_first("conv_id"), F.desc("_ghost"), F.asc_nulls_first("turn"), F.asc("role"), F.asc(F.left("text", F.lit(64))), F.asc(F.xxhash64("text"))]
    ranged = given.repartitionByRange(*order, F.asc("_salt")).sortWithinPartitions(*order).select("conv_id", "_ghost", "turn", "role", "text")
    pieces = settled(ranged.mapInArrow(_pieces(schema), schema))
    return pieces.filter("whole").unionByName(_long(pieces.filter("NOT whole"), schema)).drop("part", "kinds", "marks")


def _digest_schema(conv: T.DataType) -> T.StructType:
    out = T.StructType().add("conv_id", conv)
    for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        out.add(c, T.LongType())
    return out.add("audit", T.StringType()).add("repaired_sha256", T.StringType())


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, fault counts, cost, audit and a digest of the repaired turns.

    A conversation in one piece is a row of its own. The pieces of another are read in order by one task,
    a piece at a time: SHA-256 over a text has no parallel form.
    """
    schema = _digest_schema(pieces.schema["conv_id"].dataType)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    whole = pieces.filter("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(joined.cast("binary"), 256).alias("repaired_sha256"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now = None
            for batch in batches:
                for r in batch.to_pylist():
                    if now is None or now["conv_id"] != r["conv_id"]:
                        if now is not None:
                            yield finished(now), len(r["audit"])
                        now = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": sha256(), "any": False, "low": None, "high": None, "n": 0, "role": None}
                    for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                        now[c] += r[c]
                    if r["first_role"] is not None:
                        now["illegal"] += now["role"] is not None and now["role"] + r["first_role"] not in LEGAL
                        now["role"] = r["last_role"]
                    if r["first_turn"] is not None:
                        now["n"] += r["n_turns"] - (now["high"] == r["first_turn"])
                        now["low"] = r["first_turn"] if now["low"] is None else now["low"]
                        now["high"] = r["last_turn"]
                    now["audit"].append(r["audit"])
                    if r["joined"]:
                        now["hash"].update((b"\n" if now["any"] else b"") + r["joined"].encode("utf-8", "surrogatepass"))
                        now["any"] = True
            if now is not None:
                yield finished(now), 0

        def finished(now: dict) -> dict:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n"]
            return {c: now[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")} | {"gaps": gaps, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        yield from _emitted(rows(), to_arrow_schema(schema))

    parts = pieces.filter("NOT whole").select("conv_id", "seq", *COUNTS[1:], "first_turn", "last_turn", "n_turns", "first_role", "last_role", "cost", "audit", joined.alias("joined"))
    return whole.unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(streamed, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by a digest of conversation and turn: of twenty, one is dropped, one emptied, one loses its
    full stops, one is repeated and one becomes the user's. Nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name: Column = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.crc32(name.cast("binary")) % 20
    out = rows.withColumn("_what", what).filter("_what <> 0").select(
        "conv_id", "turn", F.when(F.col("_what") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("_what") == 1, F.lit("")).when(F.col("_what") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("_what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")
