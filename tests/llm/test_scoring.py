"""Toxicity, mixing, secrets, tokens, embeddings, decontamination and pages against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from llm_help import crowded, texts
from pyspark.sql import functions as F

from gridspark.llm import decontam, html_blocks, mixing, pivots, secrets, token_spans, toxicity

SF = "/root/testdata/sf0.01"


# --- toxicity


def brute_segments(scores):
    """All maximal segments, by the recursive definition: the best stretch, then what lies left and right of it."""
    def best(lo, hi):
        top = max(((sum(scores[i:j]), i - j, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if top[0] <= 1e-12:
            return []
        _, _, i, j = top
        return [*best(lo, i), (i, j, top[0]), *best(j, hi)]

    return best(0, len(scores))


def test_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 26)
        events = [(i, rng.choice([0.31, 0.97, 0.043, 2.13])) for i in range(n) if rng.random() < 0.4]
        scores = [-0.37] * n
        for i, s in events:
            scores[i] = s
        got = toxicity.maximal_segments(events, drift=0.37)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_toxicity_holds_out_and_learns(sp):
    docs, labels = sp.read.parquet(f"{SF}/documents.parquet"), sp.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity(crowded(docs), model).join(labels, "doc_id").withColumn("held", toxicity.held_out(F.col("doc_id"))).filter("held").select("score", "toxic").collect()
    hit = sum(r.toxic for r in rows if r.score >= toxicity.THRESHOLD)
    named = sum(r.score >= toxicity.THRESHOLD for r in rows)
    assert hit / named >= 0.9 and hit / sum(r.toxic for r in rows) >= 0.6
    # The held-out labels change nothing.
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


def test_toxicity_of_odd_rows(sp):
    docs = texts(sp, [(1, None), (2, ""), (2, ""), (None, "You idiot"), (3, "word " * 50_000)])
    empty = sp.createDataFrame([], "doc_id long, quality int, toxic int")
    for model in (toxicity.fit(docs, empty), toxicity.Model(odds={b"idiot$": 6.0}, bias=-3.0, excess=1.0)):
        got = toxicity.toxicity(crowded(docs), model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert [r.passages[0].start for r in got if r.doc_id is None] == [1]
    assert len({r.score for r in got if r.doc_id is not None}) == 1
    assert toxicity.toxicity(texts(sp, []), model).count() == 0


def learned(sp, toxic, clean, n=40):
    """A model of n toxic documents with one of the words each, and three times as many clean ones."""
    ids = range(4 * n)
    docs = texts(sp, [(i, f"some plain words {(toxic if i % 4 == 0 else clean)[i % 3 % len(toxic if i % 4 == 0 else clean)]} and more") for i in ids])
    labels = sp.createDataFrame([(i, 0, int(i % 4 == 0)) for i in ids], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels)


@pytest.mark.parametrize("bad, good", [("Schweinehund", "Schweinefleisch"), ("\u0434\u0443\u0440\u0430\u043b\u0435\u0439", "\u0434\u0443\u0440\u0430\u043a\u043e\u0432")])
def test_words_alike_at_first_are_told_apart(sp, bad, good):
    model = learned(sp, [bad], [good])
    assert model.events(bad.encode())[0] and not model.events(good.encode())[0]


def test_clauses_without_spaces_are_read_to_their_end(sp):
    clean = ["\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"]
    model = learned(sp, [clean[0] + "\u4f60\u662f\u767d\u75f4"], clean)
    assert model.events((clean[0][3:] + "\u767d\u75f4").encode())[0] and not model.events(clean[0].encode())[0]


def test_a_rare_toxic_word_is_learned_beside_many_common_ones(sp):
    common = " ".join(f"{i:05d}q{i % 10}z" for i in range(20_000))
    rare = [i < 60 and i % 2 == 0 for i in range(150)]
    docs = texts(sp, [(i, "venomous " if rare[i] else "plain ") for i in range(150)])
    docs = docs.withColumn("text", F.when((F.col("doc_id") >= 60) | (F.col("doc_id") % 3 > 0), F.concat("text", F.lit(common))).otherwise(F.col("text")))
    labels = sp.createDataFrame([(i, 0, int(i < 60)) for i in range(150)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.events(b"venomous")[0]) == 1 and not model.events(b"00001q1z")[0]


# --- mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(1 / 60))), f"s{rng.choice([0, 0, 0, 1, 2, 3, 10])}") for i in range(900)]
    rows += [(1000 + i, "a b c d", "s0") for i in range(300)]
    rows += [(2000, None, "s1"), (2001, "", None), (2002, "x y z", None), (2002, "x y z", None), (None, "p q", "é"), (2003, "w " * 20_000, "s2"), (2004, "", "only empty")]
    return rows


def test_mix_meets_its_targets(sp, mixed_rows):
    got = mixing.mix(crowded(texts(sp, mixed_rows))).collect()
    assert len(got) == len(mixed_rows)
    sizes = {}
    for _, t, s in mixed_rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == sizes[s] for r in mine)
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
        assert sum(r.taken != r.copies * r.size for r in mine) <= 1
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    again = mixing.mix(texts(sp, list(reversed(mixed_rows)))).collect()
    key = lambda r: (str(r.doc_id), r.k, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_are_the_dual_solution(sp, mixed_rows):
    """Rates of uncapped documents are exponential in size, and their tokens meet the target."""
    docs = texts(sp, mixed_rows)
    cells = docs.select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = mixing.source_targets(sources)
    wanted = {r.source: r.target for r in targets.collect()}
    by = {}
    for r in cells.collect():
        by.setdefault(r.source, []).append((r["size"], r["n"]))
    for r in mixing.balance(cells, targets).collect():
        rate = lambda s: 2.0 if r.full else min(2.0, math.exp(min(r["lambda"] * s / r["mean"], 50)))
        assert abs(sum(n * s * rate(s) for s, n in by[r.source]) - wanted[r.source]) < 1e-6 * max(1, wanted[r.source])


def test_mix_of_nothing(sp):
    assert mixing.mix(texts(sp, [])).count() == 0
    assert [r.taken for r in mixing.mix(texts(sp, [(1, None), (2, "")])).collect()] == [0, 0]


# --- secrets


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def brute_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    base = list(out)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
        v = m[0]
        if any(b < m.end() and m.start() < e for _, b, e in base) or any(re.search(p, v) for p in secrets.ALLOWED):
            continue
        if max(entropy(v[i:i + 20]) for i in range(len(v) - 19)) >= (3.0 if re.fullmatch("[0-9a-fA-F]+", v) else 3.7):
            out.append(("entropy", m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, secrets.KINDS.index(k), k, b) for k, a, b in out))


def test_secrets_equal_brute_force(sp):
    rng = random.Random(7)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    parts = ["password = hunter22", "Token: 'abcdef'", "secret=token: abcdefgh", "api_key=abc", "APIKEY:\"x.y-z_9\"", "AKIA" + "A1B2" * 4, "AKIASHORT", "deadbeef" * 3, "deadbeef" * 2 + "abcdef0", "é😀ü", "\n", "plain words",
             "12345678-1234-1234-1234-123456789abc", "example-key-0a1b2c3d4e5f6g7h8i9j", "ABCDEF0123456789abcdefABCD9182736450"]
    rows = []
    for i in range(120):
        some = [rng.choice(parts) if rng.random() < 0.8 else "".join(rng.choice(mixed) for _ in range(rng.randrange(18, 60))) for _ in range(rng.randrange(1, 9))]
        rows.append((i, rng.choice([" ", "; ", " é "]).join(some)))
    rows += [(200, None), (201, ""), (None, "token=abcdefg"), (202, " ".join("deadbeef" * 3 + f"{i:04x}" for i in range(900))), (203, "".join(rng.choice(mixed) for _ in range(3000))), (1, rows[1][1])]
    got = secrets.scan_secrets(crowded(texts(sp, rows))).select("doc_id", "text", "assign", secrets.span_list(*secrets.KINDS).alias("spans")).collect()
    assert len(got) == len(rows)
    assert sum("entropy" in r.spans for r in got) > 5
    for r in got:
        assert r.spans == brute_secrets(r.text or "")
        assert all(len(s.value) >= 6 and s.value in r.text for s in r.assign)
    assert secrets.scan_secrets(texts(sp, [])).count() == 0


# --- tokens


@pytest.mark.parametrize("rule", token_spans.RULES)
def test_attribution_equals_byte_votes(rule):
    rng = np.random.default_rng(8)
    for _ in range(300):
        ends = np.cumsum(rng.integers(1, 6, rng.integers(0, 15)))
        n = int(ends[-1]) if len(ends) else 0
        cuts = np.sort(rng.choice(n + 1, min(n + 1, int(rng.integers(0, 8))), replace=False))
        cuts = cuts[:len(cuts) // 2 * 2]
        a, b = (cuts[::2], cuts[1::2]) if rng.random() < 0.5 or not n else (np.r_[0, cuts], np.r_[cuts, n])
        tokens, crossing = token_spans.attribute(ends, a, b, rule)
        want, cross = [0.0] * len(a), [0] * len(a)
        for s, e in zip(np.r_[0, ends[:-1]], ends):
            votes = [max(0, min(e, y) - max(s, x)) for x, y in zip(a, b)]
            for i, v in enumerate(votes):
                cross[i] += 0 < v < e - s
            if rule == "share":
                want = [w + v / (e - s) for w, v in zip(want, votes)]
            elif rule == "first":
                want = [w + (x <= s < y) for w, x, y in zip(want, a, b)]
            elif any(votes):
                want[votes.index(max(votes))] += 1
        assert np.allclose(tokens, want) and list(crossing) == cross


def test_field_tokens_add_up(sp):
    ranks = token_spans.vocabulary()
    df = sp.createDataFrame([(1, "héllo wörld", "a  b"), (2, None, "日本語 text"), (3, "", None), (None, "x" * 50_000, " y")], "doc_id long, title string, body string")
    df = token_spans.joined_fields(df, ["title", "body"], " ")
    for rule in token_spans.RULES:
        got = token_spans.section_tokens(crowded(df), ranks, "sections", rule).collect()
        assert len(got) == 4
        for r in got:
            assert len(r.section_tokens) == 2 and abs(sum(r.section_tokens) + r.n_outside - r.n_tokens) < 1e-9
        first = next(r for r in got if r.doc_id == 1)
        assert first.section_crossing[1] == 1   # " a" starts in the separator
    lines = token_spans.section_tokens(texts(sp, [(1, None), (2, "a\nb"), (3, "")]), ranks).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.section_tokens) for r in lines] == [(0, [0.0]), (3, [2.0, 1.0]), (0, [0.0])]
    assert token_spans.section_tokens(texts(sp, []), ranks).count() == 0


# --- embeddings


def test_embeddings_equal_brute_force(sp, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 32))
    near = [base[i % 40] + rng.normal(size=32) * 0.12 for i in range(300)] + list(rng.normal(size=(200, 32)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(near)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, rows[0][1])]
    df = crowded(sp.createDataFrame(rows, "vec_id long, embedding array<float>"))
    fine = [(i, np.asarray(np.float32(v), dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, _ in rows if i is not None}
    for (i, a), (j, b) in itertools.combinations(fine, 2):
        if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
            links[i].add(j)
            links[j].add(i)
    for chunk in (512, 20):
        got = {r.vec_id: r for r in pivots.embedding_near_duplicates(df, pivots=64, chunk=chunk).collect()}
        assert len(got) == len(rows)
        found, there = sum(r.n_links for i, r in got.items() if i is not None), sum(map(len, links.values()))
        assert found <= there and found >= 0.98 * there
        assert all(got[i].n_links <= len(links[i]) for i in links)
        for i in (2000, 2001, 2002, 2003, 2004):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert got[2006].component_id == 2005 and got[1005].component_id == 0 and got[1005].n_links == len(links[1005])
    assert pivots.embedding_near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(sp):
    """Pairs at cosine 0.9 to 0.92 in 64 dimensions, the hardest that must link."""
    rng = np.random.default_rng(10)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1)[:, None] * a
    r /= np.linalg.norm(r, axis=1)[:, None]
    c = rng.uniform(0.9005, 0.92, 1500)[:, None]
    v = np.vstack([a, c * a + np.sqrt(1 - c * c) * r])
    df = sp.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.embedding_near_duplicates(df).collect()}
    assert sum(got[i] > 0 for i in range(1500)) / 1500 >= 0.95


# --- decontamination


def brute_hits(text, items):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, named = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(10, len(p))
        grams = {tuple(p[i:i + m]) for i in range(len(p) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i:i + m]) in grams:
                hit |= set(range(i, i + m))
                named |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(named)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination_equals_brute_force(sp, block_bytes):
    rng = random.Random(11)
    vocabulary = ["a", "the", "of", "x1", "é", "Über", "z"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(3, 40)]
    items = [x for x in items if len(x[1].split()) > 2] + [(90, "unique-word"), (91, None), (92, "..."), (None, "The OF the of the"), (9, items[5][1]), (9, items[5][1])]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    rows += [(50, "Say: " + items[0][1].upper().replace("É", "é") + "!"), (51, "unique,word and"), (52, None), (53, ""), (None, items[3][1]), (54, "b " * 30_000 + items[4][1]), (1, rows[1][1])]
    bench = sp.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(crowded(texts(sp, rows)), bench, block_bytes=block_bytes).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got])) == sorted(map(key, [(d, *brute_hits(t, items)) for d, t in rows]))
    assert decontam.decontaminate(texts(sp, []), bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(texts(sp, rows), bench.limit(0)).collect()} == {0}


# --- pages


def test_blocks_of_rough_markup():
    page = ("<!DOCTYPE html><title>T</title><body><script>var a='</p>';</script><p>One &amp; <b>two</b>three<br>four&nbsp; &eacute;<p>Next<!-- no --><div>a<i>b</i> c</div>tail<ul><li>x<li>y</ul>"
            "<table><tr><td>1<td>2</table><p title='>'>q < r</p><style>p{}</style>")
    got = [b.text for b in html_blocks.blocks_of(page)]
    assert got[-9:] == ["One & twothree four é", "Next", "ab c", "tail", "x", "y", "1", "2", "q < r"]


@pytest.mark.parametrize("markup, kept", [
    ('<svg class="i"/>', ""), ("<svg/>", ""), ('<svg-icon n="x"></svg-icon>', ""), ("<template-x>in</template-x>", " in"), ("<object-card></object-card>", ""), ("<math/>", ""),
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", " x=2"), ("<svg><text>no</text></svg>", ""), ("<canvas>", ""), ("<iframe src='/x'>", ""), ("</svg>", ""), ("<NOSCRIPT>no</noscript\n>", ""),
    ("<script src=x>'<p>'</script\t>", ""),
])
def test_raw_elements_end_at_their_own_tag(markup, kept):
    page = f"<body><p>before {markup} after</p><p>rest</p>"
    assert " ".join(b.text for b in html_blocks.blocks_of(page)).split() == f"before{kept} after rest".split()


def test_only_scripts_and_styles_run_to_the_end():
    for tag in html_blocks.RAW:
        got = [b.text for b in html_blocks.blocks_of(f"<p>before <{tag}> after</p><p>rest")]
        assert got == (["before"] if tag in ("script", "style") else ["before after", "rest"])


def test_all_words_of_a_long_block_are_read():
    text = " ".join(f"word{i}" for i in range(200))
    found, = html_blocks.vectors([html_blocks.Block(("p",), text, 0)], {}).words
    assert found.tolist() == [html_blocks._bucket(f"word{i}") for i in range(200)]


def test_gradients_are_right():
    rng = np.random.default_rng(12)
    model = html_blocks.Labeller(1)
    model.p["path"] = rng.normal(size=model.p["path"].shape) * 0.3
    made = [html_blocks.template_page(rng, ["aa", "bb", "cc"]) for _ in range(3)]
    pages = [html_blocks.vectors(html_blocks.blocks_of(p), {}) for p, _ in made]
    y = np.zeros((3, max(len(p.counts) for p in pages)))
    for i, (_, labels) in enumerate(made):
        y[i, :len(labels)] = labels

    def loss():
        p, mask = model.probabilities(pages)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    g = model.gradients(pages, y)
    bucket = int(pages[0].path[0][0])
    for name, at in (("wf", (3, 5)), ("wb", (20, 40)), ("uf", (2, 50)), ("ub", (7, 9)), ("cf", (4,)), ("out", (20,)), ("skip", (1,)), ("bias", (0,)), ("path", (bucket, 2))):
        was = model.p[name][at]
        model.p[name][at] = was + 1e-5
        up = loss()
        model.p[name][at] = was - 1e-5
        down = loss()
        model.p[name][at] = was
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6


def test_pages_by_a_trained_labeller(sp):
    pages = sp.read.parquet(f"{SF}/pages.parquet")
    model = html_blocks.trained(html_blocks.filler(pages))
    rng, right, n = np.random.default_rng(13), 0, 0
    for _ in range(100):
        page, labels = html_blocks.template_page(rng, ["lorem", "ipsum", "dolor"])
        found = html_blocks.blocks_of(page)
        if len(found) == len(labels):
            right += int((html_blocks.label([found], model, {})[0] == np.array(labels, bool)).sum())
            n += len(labels)
    assert right / n >= 0.97
    got = html_blocks.main_text(crowded(pages), model).join(pages.select("page_id", "html"), "page_id").collect()
    same = sum(r.text == "\n\n".join(b.text for b in html_blocks.blocks_of(r.html) if "article" in b.path) for r in got)
    assert same / len(got) >= 0.99
    odd = sp.createDataFrame([(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<nav>x</nav>"), (3, "u", "<article>" + "<p>long text here.</p>" * 5000 + "</article>")], "page_id long, url string, html string")
    rows = html_blocks.main_text(odd, model).collect()
    assert sorted(len(r.text) for r in rows)[:3] == [0, 0, 0] and max(len(r.text) for r in rows) > 80_000
    assert html_blocks.main_text(odd.limit(0), model).count() == 0


def test_huge_and_tiny_vectors_keep_their_links(sp):
    rows = [(i, [s * x for x in v]) for i, (s, v) in enumerate([(1.0, [1.0, 2.0]), (1e200, [1.0, 2.0]), (1e-200, [1.0, 2.0]), (1e300, [-2.0, 1.0]), (5e-324, [1.0, 0.0])])]
    df = sp.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.embedding_near_duplicates(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (0, 4)}
