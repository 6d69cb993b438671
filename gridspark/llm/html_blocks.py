"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks: the text between block-level tags, with its path of tags, classes
and ids. Every block becomes a vector of hashed path tokens, hashed words and a few counts; a
bidirectional LSTM in numpy reads the whole sequence in both directions and labels every block as
article or not, so that a block is judged by the page around it. Batches of pages are padded to their
longest; nothing of a page is cut.

The labeller is trained where it is used, on a fixed number of pages drawn from templates (layouts,
class names and notices as sites have them), filled with words of a bounded sample of the corpus.
Path tokens are dropped at random in training, so that no single name decides, and
the words of half the blocks, so that the page around a block does.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridspark.llm.common import first_by_digest

PAGES = 640          # template pages learned from
SAMPLE = 64          # pages of the corpus whose words fill them, at most
EPOCHS, BATCH = 16, 16
BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 4096, 16, 6, 16
COUNTS = 6
DECAY = {"words": 1.0, "path": 0.02}

# Elements whose content is never text, elements that stay inside a block, elements without content.
RAW = ("script", "style", "template", "noscript", "svg", "iframe", "object", "canvas")
FORMULA = ("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose maction msub msup msubsup munder mover munderover "
           "mmultiscripts mprescripts mtable mtr mlabeledtr mtd semantics annotation annotation-xml")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split() + FORMULA.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORDS = re.compile(r"\w+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    hidden: bool = False


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for name, a, b, c in _NAMES.findall(attributes):
            out += [f"{'.' if name.lower() != 'role' else '@'}{p.lower()}" for p in _PARTS.findall(a or b or c)]
    return tuple(out)


def _hides(attributes: str) -> bool:
    if not attributes:
        return False
    a = attributes.lower()
    return bool(re.search(r"display\s*:\s*none", a)) or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", a))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order: references decoded, white space folded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not any(t == "head" for t, *_ in stack):
                out.append(Block(tuple(x for _, ts, _ in stack for x in ts), text, linked, any(h for *_, h in stack)))
            parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], stop: tuple[str, ...] = ("table", "ul", "ol", "dl")):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            chunk = page[at:m.start()]
            parts.append(chunk)
            if links:
                linked += len(chunk)
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            # Without a closing tag only a script or style runs to the end of the page; what follows others is text.
            if not end and tag not in endless and not (tag == "svg" and attributes.endswith("/")):
                if closing := _RAW_END[tag].search(page, at):
                    at = closing.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if end else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            links = 0
            continue
        if tag in ENDS_P:
            close(("p",), ("div", "article", "section", "td", "th", "body"))
        if tag in CLOSES and tag != "p":
            close(CLOSES[tag])
        if tag == "body":
            close(("head",), ())
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _tokens(tag, attributes), _hides(attributes)))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


@dataclass
class Page:
    """Vectors of a page's blocks: ragged token buckets and counts."""

    path: list[np.ndarray]
    words: list[np.ndarray]
    counts: np.ndarray


def vectors(blocks: list[Block], memo: dict[str, int]) -> Page:
    def hashed(tokens) -> np.ndarray:
        return np.array([memo[t] if t in memo else memo.setdefault(t, _bucket(t)) for t in tokens], dtype=np.int64)

    n, counts, path, words = len(blocks), np.zeros((len(blocks), COUNTS)), [], []
    for i, b in enumerate(blocks):
        path.append(hashed(b.path))
        words.append(hashed(_WORDS.findall(b.text.lower())))
        size = len(b.text)
        counts[i] = (np.log1p(size) / 6, min(1.0, b.linked / max(size, 1)), sum(c in ".!?;:" for c in b.text[-3:]) > 0, i / max(n - 1, 1), float(b.hidden), len(b.path) / 10)
    return Page(path, words, counts)


def _mean_rows(table: np.ndarray, ragged: list[np.ndarray]) -> np.ndarray:
    """Mean of the table's rows named by each block; zero where there is none."""
    sizes = np.array([len(r) for r in ragged])
    out = np.zeros((len(ragged), table.shape[1]))
    if sizes.sum():
        flat = table[np.concatenate(ragged)]
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes[some])[:-1]])) / sizes[some][:, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output for every block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + COUNTS, HIDDEN
        # Token tables start at zero, so a token never met in training adds nothing.
        self.p = {"path": np.zeros((BUCKETS, PATH_DIM)), "words": np.zeros((BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * h), "skip": rng.normal(0, 0.1, d), "bias": np.zeros(1)}
        for side in ("f", "b"):
            self.p |= {f"w{side}": rng.normal(0, 1 / np.sqrt(d), (d, 4 * h)), f"u{side}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)), f"c{side}": np.r_[np.ones(h), np.zeros(3 * h)]}

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        """(pages, blocks, features) padded with zeros, and the mask of real blocks."""
        longest = max(len(p.counts) for p in pages)
        x, mask = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + COUNTS)), np.zeros((len(pages), longest))
        for i, p in enumerate(pages):
            n = len(p.counts)
            x[i, :n] = np.hstack([_mean_rows(self.p["path"], p.path), _mean_rows(self.p["words"], p.words), p.counts])
            mask[i, :n] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str):
        h_, (b, t, _) = HIDDEN, x.shape
        z = x @ self.p[f"w{side}"] + self.p[f"c{side}"]
        u, h, c = self.p[f"u{side}"], np.zeros((b, h_)), np.zeros((b, h_))
        states, order = np.zeros((b, t, h_)), range(t) if side == "f" else range(t - 1, -1, -1)
        trace = {}
        for k in order:
            a = z[:, k] + h @ u
            gates = _sigmoid(a[:, :3 * h_])
            f, i, o, g = gates[:, :h_], gates[:, h_:2 * h_], gates[:, 2 * h_:], np.tanh(a[:, 3 * h_:])
            m = mask[:, k:k + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            trace[k] = (h, c, f, i, o, g, tc, m)
            c = np.where(m > 0, new, c)
            h = np.where(m > 0, o * tc, h)
            states[:, k] = h
        return states, trace, order

    def probabilities(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        x, mask = self.inputs(pages)
        hf, hb = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return _sigmoid(np.concatenate([hf, hb], axis=2) @ self.p["out"] + x @ self.p["skip"] + self.p["bias"]), mask

    def gradients(self, pages: list[Page], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by back-propagation through both directions."""
        x, mask = self.inputs(pages)
        runs = {s: self._run(x, mask, s) for s in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"])
        d = (p - labels) * mask / mask.sum()
        g = {"out": np.einsum("bt,bth->h", d, both), "skip": np.einsum("bt,btd->d", d, x), "bias": np.array([d.sum()])}
        dx = d[:, :, None] * self.p["skip"]
        h_ = HIDDEN
        for n, side in enumerate("fb"):
            _, trace, order = runs[side]
            top = d[:, :, None] * self.p["out"][n * h_:(n + 1) * h_]
            u, dz = self.p[f"u{side}"], np.zeros((*x.shape[:2], 4 * h_))
            du, dh, dc = np.zeros_like(u), np.zeros((x.shape[0], h_)), np.zeros((x.shape[0], h_))
            for k in reversed(order):
                h0, c0, f, i, o, gg, tc, m = trace[k]
                dh = dh + top[:, k]
                live_h, live_c = dh * m, dc * m
                dnew = live_c + live_h * o * (1 - tc * tc)
                da = np.hstack([dnew * c0 * f * (1 - f), dnew * gg * i * (1 - i), live_h * tc * o * (1 - o), dnew * i * (1 - gg * gg)])
                dz[:, k] = da
                du += h0.T @ da
                dh, dc = da @ u.T + dh * (1 - m), dnew * f + dc * (1 - m)
            g[f"w{side}"] = np.einsum("btd,btk->dk", x, dz)
            g[f"u{side}"], g[f"c{side}"] = du, dz.sum(axis=(0, 1))
            dx += dz @ self.p[f"w{side}"].T
        for name, lo, width in (("path", 0, PATH_DIM), ("words", PATH_DIM, WORD_DIM)):
            table = np.zeros_like(self.p[name])
            rows = [(r, dx[i, k, lo:lo + width] / len(r)) for i, page in enumerate(pages) for k, r in enumerate(getattr(page, name)) if len(r)]
            if rows:
                np.add.at(table, np.concatenate([r for r, _ in rows]), np.repeat(np.array([d for _, d in rows]), [len(r) for r, _ in rows], axis=0))
            g[name] = table
        return g

    def train(self, pages: list[Page], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 11, rate: float = 0.02) -> "Labeller":
        """Adam over shuffled batches of pages of like length."""
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(labels[i]) // 8, rng.random()))
            batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
            for j in rng.permutation(len(batches)):
                some = [_dropped(pages[i], rng) for i in batches[j]]
                y = np.zeros((len(some), max(len(p.counts) for p in some)))
                for r, i in enumerate(batches[j]):
                    y[r, :len(labels[i])] = labels[i]
                step += 1
                lr = rate * (1 - epoch / (epochs + 1))
                for k, g in self.gradients(some, y).items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    # Words decay, so that only those that keep telling the classes apart weigh.
                    self.p[k] = self.p[k] * (1 - lr * DECAY.get(k, 0.0)) - lr * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
        return self


def _dropped(page: Page, rng: np.random.Generator) -> Page:
    return Page([r[rng.random(len(r)) > 0.1] if len(r) > 1 else r for r in page.path], [r[rng.random(len(r)) > 0.2] if rng.random() < 0.5 else r[:0] for r in page.words], page.counts)


# Names under which sites keep their article, and the parts that are not the article.
ARTICLE_OPENS = ("<article>", '<article class="post">', "<main>", '<main role="main"><article>', '<div class="content">', '<div id="content">', '<div class="entry-content">', '<div class="article-body">',
                 '<div class="post-content">', '<section class="story">', '<div class="main"><div class="text">', '<div id="main-content">', '<div class="page"><article class="entry">')
PARTS = {
    "nav": ("menu", "nav", "navbar", "navigation", "breadcrumbs", "topnav", "main-menu", "pagination", "toc"),
    "header": ("header", "masthead", "site-header", "top-bar", "page-header", "branding"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "footer-links", "legal"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "more-stories", "rail"),
    "notice": ("cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "paywall", "banner", "warning", "disclaimer"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "promotion", "banner-ad"),
    "form": ("newsletter", "subscribe", "search", "login", "signup", "contact-form", "search-form"),
    "share": ("share", "social", "share-buttons", "tags", "byline-social", "tools", "follow"),
    "comments": ("comments", "comment-list", "comment", "respond", "discussion", "replies", "reader-comments", "disqus"),
}
PHRASES = {
    "nav": ("Home", "About", "News", "Sport", "Contact", "Next page", "Previous"), "header": ("Welcome", "Sign in", "Menu", "Skip to content"),
    "footer": ("© 2024 All rights reserved", "Privacy policy", "Terms of use", "Copyright", "Imprint"), "aside": ("Related articles", "Most read", "Read more", "You may also like"),
    "notice": ("We use cookies to improve this site. Accept", "Accept all cookies", "Please enable JavaScript", "This site uses cookies"), "ad": ("Advertisement", "Sponsored", "Buy now", "Special offer"),
    "form": ("Subscribe to our newsletter", "Email address", "Submit", "Search", "Log in"), "share": ("Share on social media", "Tweet", "Print this page"),
    "comments": ("Comments", "Leave a reply", "says:", "Reply", "3 comments", "Posted by a reader"),
}


def template_page(rng: np.random.Generator, fill: list[str]) -> tuple[str, list[int]]:
    """A page of a random layout, with the label of every block: 1 for the article's."""
    labels: list[int] = []

    def words(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi + 1))
        return " ".join(fill[int(k)] for k in rng.integers(0, len(fill), n))

    def part(kind: str, nested: bool = False) -> str:
        own = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "notice": ("div", "section", "aside"), "ad": ("div", "aside", "ins"),
               "form": ("form", "div"), "share": ("div", "ul"), "comments": ("section", "div", "ol")}[kind]
        tag = str(rng.choice(own[:1] if rng.random() < 0.5 else own))
        name = str(rng.choice(PARTS[kind]))
        attribute = f' {rng.choice(["class", "id"])}="{name}"' if tag in ("div", "section", "ins", "ol", "ul") or rng.random() < 0.4 else ""
        if kind != "form" and rng.random() < 0.35:
            labels.append(0)
            mark = {"footer": "© ", "ad": "", "notice": ""}.get(kind, "")
            return f"<{tag}{attribute}>{mark}{rng.choice(PHRASES[kind]) if rng.random() < 0.3 else words(2, 30)}</{tag}>"
        body = ""
        for _ in range(int(rng.integers(1, 6 if kind in ("nav", "footer", "aside", "comments") else 3))):
            text = str(rng.choice(PHRASES[kind])) if rng.random() < 0.5 else words(1, 5) if kind in ("nav", "share", "form") else words(4, 40)
            labels.append(0)
            if kind == "nav" or (kind in ("footer", "aside", "share") and rng.random() < 0.5):
                body += f'<li><a href="/x">{text}</a></li>'
            elif kind == "form":
                body += f"<label>{text}</label><input type=text><p></p>" if rng.random() < 0.5 else f"<p>{text}</p>"
            else:
                body += f"<p>{text}</p>" if rng.random() < 0.8 else f"<div class=\"{rng.choice(PARTS[kind])}\">{text}</div>"
        return f"<{tag}{attribute}>{body}</{tag}>"

    page = "<html><head><title>" + words(3, 8) + "</title></head><body>"
    before = [k for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
    rng.shuffle(before)
    for kind in before:
        page += part(kind)
    opened = str(rng.choice(ARTICLE_OPENS[:4] if rng.random() < 0.5 else ARTICLE_OPENS))
    page += opened
    if rng.random() < 0.8:
        page += f"<h1>{words(3, 10)}</h1>"
        labels.append(1)
    for _ in range(int(rng.integers(1, 12))):
        turn = rng.random()
        if turn < 0.72:
            stop = "." if rng.random() < 0.7 else ""
            text = words(1, 4 if rng.random() < 0.3 else 90) if rng.random() < 0.9 else f"{words(1, 2)}, " * int(rng.integers(2, 30))
            page += f"<p>{text}{stop}</p>" if rng.random() < 0.8 else f"<p><b>{words(5, 90)}.<br>"
            labels.append(1)
        elif turn < 0.8:
            page += f"<h2>{words(2, 6)}</h2>"
            labels.append(1)
        elif turn < 0.86:
            n = int(rng.integers(1, 4))
            page += "<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(n)) + "</ul>"
            labels += [1] * n
        elif turn < 0.9:
            page += f"<blockquote>{words(5, 40)}.</blockquote>"
            labels.append(1)
        else:
            page += part(str(rng.choice(["ad", "share", "aside", "form", "notice"])), True)
    if rng.random() < 0.15:
        page += part("comments", True)
    for tag in reversed(re.findall(r"<(\w+)", opened)):
        page += f"</{tag}>"
    after = [k for k in ("share", "comments", "aside", "ad", "form", "footer", "notice") if rng.random() < 0.45]
    for kind in after:
        page += part(kind)
    return page + "</body></html>", labels


def trained(fill: list[str], pages: int = PAGES, seed: int = 5) -> Labeller:
    """A labeller trained on template pages filled with the given words."""
    rng, memo, xs, ys = np.random.default_rng(seed), {}, [], []
    while len(xs) < pages:
        page, labels = template_page(rng, fill or ["word"])
        found = blocks_of(page)
        if len(found) == len(labels) and found:
            xs.append(vectors(found, memo))
            ys.append(np.array(labels, dtype=float))
    return Labeller().train(xs, ys)


def label(pages: list[list[Block]], model: Labeller, memo: dict[str, int], most: int = 1 << 16) -> list[np.ndarray]:
    """Whether each block of each page is the article's; batches hold pages of like length."""
    out: list[np.ndarray] = [np.zeros(len(p), dtype=bool) for p in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    k = 0
    while k < len(order):
        j = k + 1
        while j < len(order) and j - k < 256 and (j + 1 - k) * len(pages[order[j]]) <= most:
            j += 1
        got, _ = model.probabilities([vectors(pages[i], memo) for i in order[k:j]])
        for r, i in enumerate(order[k:j]):
            out[i] = got[r, :len(pages[i])] >= 0.5
        k = j
    return out


def filler(pages: DataFrame, sample: int = SAMPLE, most: int = 20_000) -> list[str]:
    """Words of the first distinct pages by the digest of their html: `sample` pages, `most` words, at most."""
    digests = pages.filter(F.col("html").isNotNull()).select(F.xxhash64("html").alias("h"), "html")
    first = [r["h"] for r in first_by_digest(digests.select("h").distinct(), F.col("h"), sample)]
    rows = digests.filter(F.col("h").isin(first)).groupBy("h").agg(F.min("html").alias("html")).collect() if first else []
    words = [w for r in sorted(rows) for b in blocks_of(r["html"]) for w in b.text.split()]
    return words[:most]


def main_text(pages: DataFrame, model: Labeller) -> DataFrame:
    """The rows of `pages` without html, with text: the article's blocks, joined by an empty line.

    A null or empty html, and a page without an article block, give an empty text. Whole pages are read;
    rows are neither joined nor shuffled, so null and repeated ids and extra columns pass through (a
    column named text is replaced).
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    base = pages.drop("text")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema if f.name != "html"]).add("text", T.StringType())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, memo = to_arrow_schema(schema), {}
        for batch in batches:
            found = [blocks_of(h.as_py() or "") for h in batch["html"]]
            texts = ["\n\n".join(b.text for b, keep in zip(bs, marks) if keep) for bs, marks in zip(found, label(found, model, memo))]
            if len(memo) > 1_000_000:
                memo.clear()
            yield pa.RecordBatch.from_arrays([pa.array(texts, type=f.type) if f.name == "text" else batch[f.name].cast(f.type) for f in out], schema=out)

    return base.mapInArrow(extract, schema)
