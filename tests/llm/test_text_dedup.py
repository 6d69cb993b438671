"""Suffix, line and near-duplicate removal against brute force, and their edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from llm_help import crowded, texts

from gridspark.llm import minhash, suffix_dedup
from gridspark.llm.line_dedup import line_dedup
from gridspark.llm.minhash import near_duplicates
from gridspark.llm.suffix_dedup import remove_repeats

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- repeated strings


def brute_repeats(bodies, length=200):
    seen = {}
    for b in bodies:
        for j in range(len(b) - length + 1):
            seen[b[j:j + length]] = seen.get(b[j:j + length], 0) + 1
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if seen[b[j:j + length]] > 1:
                gone[j:j + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.diff(np.r_[0, gone.astype(int)])
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(1)
    shared, long = prose(rng, 60), prose(rng, 3000)
    rows = [(i, prose(rng, 100)) for i in range(6)]
    rows += [(10 + i, prose(rng, 30) + " " + shared + " " + prose(rng, 30)) for i in range(6)]
    rows += [(20, long), (21, long[3000:9000]), (22, "é" * 150 + shared[:100]), (23, "é" * 150 + shared[:100]), (24, "ab" * 400), (25, "z" * 201), (26, "z" * 199)]
    edited = rows[0][1].split()
    edited[50] = "other"
    rows += [(30, " ".join(edited)), (31, None), (32, ""), (33, "short"), (34, "short"), (None, shared + "!"), (None, None), (40, rows[1][1]), (40, rows[1][1])]
    return rows


def test_repeats_equal_brute_force(sp, copied):
    want = brute_repeats([(t or "").encode() for _, t in copied])
    got = remove_repeats(crowded(texts(sp, copied)), keep_text=True).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert mine == sorted((str(d), *w) for (d, _), w in zip(copied, want))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_in_an_empty_table(sp):
    assert remove_repeats(texts(sp, [])).collect() == []


def test_long_text_is_parsed_in_pieces_alike(monkeypatch, copied):
    """Every string lies in one phrase, under the same key wherever it stands, also across pieces."""
    for piece in (1 << 19, 700):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        keys = {}
        bodies = [(t or "").encode() for _, t in copied]
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        ends = np.cumsum([len(b) for b in bodies])
        starts = np.r_[0, ends[:-1]]
        seen = set()
        for doc, first, last, _, key, _ in suffix_dedup.phrases(raw, starts, ends):
            for d, f, l, k in zip(doc, first, last, key):
                for i in range(f, l + 1):
                    assert (d, i) not in seen
                    seen.add((d, i))
                    assert keys.setdefault(bodies[d][i:i + 200], k) == k
        assert len(seen) == sum(max(0, len(b) - 199) for b in bodies)


def test_half_equal_digests_are_no_repeat(sp):
    """Edges of a common passage have one core; pairs here also agree in 32 bits of their suffix digests."""
    passage = "".join(map(chr, random.Random(27).choices(b"abcdefghijklmnopqrstuvwxyz ", k=193)))
    edges = [("owlijbp", "xaolytd"), ("pgfytld", "cpinoih"), ("mtumrmr", "pujbvkg")]
    digest = lambda e: int(suffix_dedup.Digests(np.frombuffer((e + passage).encode(), np.uint8)).every(200)[0])
    assert all(digest(a) >> 32 == digest(b) >> 32 and digest(a) != digest(b) for a, b in edges)
    rows = [(i, e + passage) for i, e in enumerate(itertools.chain(*edges))]
    assert [r.n_removed for r in remove_repeats(texts(sp, rows)).collect()] == [0] * 6
    rows += [(9, "mtumrmr" + passage)]
    want = sorted(zip((str(d) for d, _ in rows), (w[1] for w in brute_repeats([t.encode() for _, t in rows]))))
    assert sorted((str(r.doc_id), r.n_removed) for r in remove_repeats(texts(sp, rows)).collect()) == want


# --- lines


def brute_lines(rows, least=10):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    holders = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_equal_brute_force(sp):
    rng = random.Random(2)
    common = ["All Rights Reserved by us", "  all rights reserved BY us\t", "short", "ÄÖÜ straße line", "äöü straße line", "exactly 10"]
    rows = [(i, "\n".join(rng.choice(common + [prose(rng, 4)]) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "tail line here\n"), (104, "tail line here"), (None, "tail line here"), (105, "same same same\nsame same same"), (106, "same same same"),
             (107, "\n".join(["very long text line"] * 3000)), (108, "very long text line"), (3, rows[3][1])]
    got = line_dedup(crowded(texts(sp, rows))).collect()
    mine = sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in got)
    assert mine == brute_lines(rows)
    for r in got:  # the bitmap tells the kept lines
        lines = (r.text or "").split("\n")
        assert "\n".join(x for k in r.keep for x in lines[k.start:k.end]) == (r.kept_text or "")
    assert next(r for r in got if r.doc_id == 100).kept_text is None
    assert line_dedup(texts(sp, [])).count() == 0


# --- near duplicates


def brute_near(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(low).split(" ")
        w = [x for y in w for x in y.replace("\t", "\n").split("\n") if x]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        linked = a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 75 * len(a | b)
        if linked or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
            label[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(least.get(root(i)) if d is not None else None)) for i, (d, _) in enumerate(rows))


def edited(rng, words, share):
    return [rng.choice(WORDS) + "x" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(3)
    rows, at = [], 0
    for size, share in ((60, 0.02), (40, 0.035), (25, 0.05), (3, 0.01)):
        base = prose(rng, 200).split()
        for _ in range(size):
            rows.append((at, " ".join(edited(rng, base, share))))
            at += 1
    passage = prose(rng, 120)
    rows += [(at + i, passage + " " + prose(rng, 80)) for i in range(40)]   # similar, but none linked
    at += 40
    rows += [(at, "One two"), (at + 1, "one\tTWO"), (at + 2, "one two three"), (at + 3, None), (at + 4, ""), (at + 5, " \n "), (None, "one two"), (at + 6, prose(rng, 5000)), (at + 7, rows[0][1].upper()),
             (at + 8, rows[1][1]), (at + 8, rows[1][1])]
    return rows


@pytest.mark.parametrize("small, chunk", [(minhash.SMALL, minhash.CHUNK), (2, minhash.CHUNK), (2, 7)])
def test_near_duplicates_equal_brute_force(sp, groups, small, chunk):
    got = near_duplicates(crowded(texts(sp, groups)), small=small, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(groups)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_similar_documents_without_links_make_few_rows(sp, monkeypatch):
    """A passage that two thousand documents share, none of them linked: their pairs never become rows."""
    rng = random.Random(12)
    passage = prose(rng, 100)
    rows = [(i, passage + " " + prose(rng, 100)) for i in range(2000)]
    made, plain = [], minhash._apart

    def counted(*given):
        out = plain(*given)
        made.append(0 if out is None else out.count())
        return out

    monkeypatch.setattr(minhash, "_apart", counted)
    got = near_duplicates(texts(sp, rows), small=2).collect()
    assert len(got) == 2000 and all(r.kept for r in got)
    assert made and max(made) < 2000


def test_bands_miss_hardly_a_pair_at_the_threshold():
    """Pairs of similarity 0.75 exactly share a band, and their bands agree as often as in theory."""
    rng = np.random.default_rng(8)
    met, missed = 0, 0
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 200 * 8 // 7, dtype=np.int64).astype(np.uint64)
        one, two = pool[:200], np.r_[pool[:172], pool[200:228]]   # 172 of 228: similarity 0.754
        a, b = (minhash.band_keys(minhash.minima(x)) for x in (one, two))
        met += int((a == b).sum())
        missed += not (a == b).any()
    assert missed == 0 and abs(met / 300 / minhash.BANDS - 0.754**minhash.ROWS) < 0.02


def test_near_duplicates_in_an_empty_table(sp):
    assert near_duplicates(texts(sp, [])).count() == 0
    assert near_duplicates(texts(sp, [(1, None), (2, "a")])).count() == 2


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    for share in (0.3, 0.75, 0.95):
        both = int(2000 * share)
        a, b = pool[:2000], np.r_[pool[:both], pool[2000:3000][:2000 - both] if 2000 - both <= 1000 else rng.integers(0, 1 << 62, 2000 - both).astype(np.uint64)]
        j = both / (4000 - both)
        sig = [np.frombuffer(minhash.signature(minhash.minima(x)), np.uint8)[None] for x in (a, b)]
        assert abs(minhash.estimates(*sig)[0] - j) < 0.13
