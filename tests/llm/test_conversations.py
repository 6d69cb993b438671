"""Conversation repair against an exhaustive search."""

import hashlib
import random
import zlib

import pytest
from llm_help import crowded

from gridspark.llm import conversations as C

COLUMNS = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.rstrip(C.SPACE)
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired) by keeping the least (cost, audit) of every state, row by row."""
    best = {"": (0, "", ())}
    wanted = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                c = wanted[state][-1]
                got = (cost + 5, audit + "I", (*lines, names[c] + ":"))
                if c not in out or got < out[c]:
                    out[c] = got
        return out

    for (role, text), fault in zip(rows, faults(rows)):
        step = {}
        for state, (cost, audit, lines) in inserted(best).items():
            extra = 5 if fault == "truncated" else 0
            options = [(state, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in wanted[state]:
                    options.append((role[:1], cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                c = wanted[state][-1]
                options.append((c, cost + extra + 1, audit + "R", (*lines, f"{names[c]}:{text}")))
            for new, *got in options:
                if new and new not in "sua":
                    continue
                if new not in step or tuple(got) < step[new]:
                    step[new] = tuple(got)
        best = step
    ended = [v for k, v in inserted(best).items() if k in ("", "a")]
    return min(ended)


def expected(given, ids):
    """Digest rows from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in ids:
        rows = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in given if c == conv]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        pairs = [(r, x) for _, r, x in rows]
        turns = [t for t, *_ in rows if t is not None]
        found = faults(pairs)
        cost, audit, lines = brute(pairs)
        initials = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some(rng, n, convs):
    texts = ["Yes.", "No!", "why", "", " \t", "A? ", "B.", "c", "Long one."]
    return [(rng.randrange(convs), rng.choice([None, *range(-2, 60)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([*texts, None])) for _ in range(n)]


def test_audits_equal_an_exhaustive_search():
    rng = random.Random(3)
    for _ in range(600):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c.", "d.", "cut", ""])) for _ in range(rng.randrange(0, 9))]
        kinds, seen = bytearray(), set()
        for r in rows:
            kinds.append(C._kind(*r, r in seen)[0])
            seen.add(r)
        cost, audit, lines = brute(rows)
        assert C.whole_audit(bytes(kinds)) == audit and C.audit_cost(audit, bytes(kinds)) == cost
        repaired = C.apply_edits(audit, [{"role": r, "text": t} for r, t in rows])
        assert tuple(f"{t['role']}:{t['text']}" for t in repaired) == lines
        # The tables of stretches lead to the same audit as those of single rows.
        tables = [C.row_table(k) for k in kinds]
        if len(tables) > 2:
            cut = rng.randrange(1, len(tables))
            halves = [C.product(tables[:cut]), C.product(tables[cut:])]
            end = C.end_state(C.product(halves))
            assert end == C.end_state(C.product(tables))
            mid = C.crossings(halves, 0, end)[1]
            assert C.edits_of(bytes(kinds[:cut]), 0, mid) + C.edits_of(bytes(kinds[cut:]), mid, end) + "I" * C.TAIL[end] == audit


@pytest.mark.parametrize("chunk, fan", [(1024, 256), (3, 2), (1, 3)])
def test_conversations_equal_an_exhaustive_search(sp, monkeypatch, chunk, fan):
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "FAN", fan)
    rng = random.Random(chunk)
    rows = some(rng, 160, 9) + [(77, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(40)]
    rows += [(50, 1, "user", "Same.")] * 12 + [(None, 1, "user", "Null id."), (None, 2, "assistant", "Yes.")]
    df = sp.createDataFrame(rows, COLUMNS).repartition(3)
    ids = sorted({r[0] for r in rows if r[0] is not None}) + [None, 99]
    asked = sp.createDataFrame([(i,) for i in ids], "conv_id long")
    assert got_of(C.digests(C.repair(crowded(df), ids=crowded(asked)))) == expected(rows, ids)


def test_pieces_carry_the_repaired_turns(sp):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "user", "Cut off"), (2, 1, "user", "x" * 300_000 + "."), (2, 2, "tool", "Done!")]
    got = {r.conv_id: r for r in C.repair(sp.createDataFrame(rows, COLUMNS)).collect()}
    assert got[1].audit == "DD" and got[1].turns == []
    assert got[2].audit == "KR" and len(got[2].turns[0].text) == 300_001 and tuple(got[2].turns[1]) == ("assistant", "Done!")
    none = C.repair(sp.createDataFrame([], COLUMNS))
    assert none.count() == 0 and C.digests(none).count() == 0


def test_damage_follows_the_digest(sp):
    rows = [(c, t, r, x) for c in (1, None) for t in (*range(60), None) for r, x in [("assistant", "One. Two!"), (None, None)]]
    want = []
    for c, t, r, x in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if what == 0:
            continue
        x = "" if what == 1 else x.replace(".", "").replace("!", "") if what == 2 else x
        want += [(c, t, "user" if what == 4 else r, x)] * (2 if what == 3 else 1)
    got = [tuple(r) for r in C.damaged(crowded(sp.createDataFrame(rows, COLUMNS))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
