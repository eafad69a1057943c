"""Main text of web pages: a bidirectional LSTM labels every block of a page from its tag path, words and neighbours."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that break the line, hide their text, or stand empty.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul video audio object button textarea label".split()
)
HIDDEN = frozenset("script style noscript template title svg iframe canvas".split())
#: Those of them that end with the page where they are not closed; the others then hide nothing.
RAW = frozenset("script style".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITS_LIKE = frozenset("li dd dt option tr td th p".split())
#: Names of site furniture and of article text in tags, classes and ids.
FURNITURE = frozenset(
    "nav aside footer form button select option textarea label dialog menu fieldset legend "
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side navbar navigation "
    "topbar header masthead toolbar breadcrumb breadcrumbs comment comments respond disqus reply replies cookie cookies consent "
    "gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe signup login "
    "search widget pagination pager tags meta toc copyright legal disclaimer".split()
)
ARTICLE = frozenset("article main content post entry story body text".split())
OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: What can still begin behind the last ``>`` of a page.
ENDLESS = re.compile(r"<(?:!--|!\[CDATA\[)")
#: A tag; a quote opens a string only right behind an equals sign.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
DIGITS = re.compile(r"\d+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link_chars: int


@lru_cache(maxsize=50_000)
def names(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag and the words of its class, id and role."""
    found = (x for m in NAMED.finditer(attributes) for x in m.groups() if x) if attributes else ()
    return (tag, *(f".{w.lower()}" for x in found for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x))))


def blocks_of(source: str) -> list[Block]:
    """Leaf blocks of a page in order: text with one space for white space, and the names above it.

    Every character is looked at a bounded number of times, whatever is left open: a tag without an end is text,
    an unclosed comment, script or style takes the rest of the page, other unclosed elements hide nothing.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = link_depth = at = 0

    def text(raw: str) -> None:
        nonlocal links
        value = html.unescape(raw) if "&" in raw else raw
        parts.append(value)
        if link_depth:
            links += len(value)

    def flush() -> None:
        nonlocal links
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(Block(joined, tuple(n for _, group in stack for n in group), links))
            parts.clear()
        links = 0

    n, last = len(source), source.rfind(">")
    strings_end, never_closed = True, set()
    while at < n:
        found = (OPENING if at <= last else ENDLESS).search(source, at)
        if found is None:
            text(source[at:])
            break
        begin, opening = found.start(), found[0]
        if begin > at:
            text(source[at:begin])
        if opening == "<!--":
            end = source.find("-->", found.end())
            at = n if end < 0 else end + 3
            continue
        if opening == "<![CDATA[":
            end = source.find("]]>", found.end())
            parts.append(source[found.end() : n if end < 0 else end])
            at = n if end < 0 else end + 3
            continue
        if begin > last:  # nothing closes any more: plain text
            parts.append(source[begin])
            at = begin + 1
            continue
        if opening in ("<!", "<?"):
            at = source.index(">", begin) + 1
            continue
        found = TAG.match(source, begin) if strings_end else None
        if found is None:  # a string that never ends: from here on quotes hide no ">"
            strings_end = False
            found = LOOSE_TAG.match(source, begin)
        at = found.end()
        tag = found[2].lower()
        if tag in HIDDEN:
            if not found[1] and not found[3].endswith("/") and tag not in never_closed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = n
                else:
                    never_closed.add(tag)
            continue
        if tag == "a":
            link_depth = 0 if found[1] else 1
        if tag == "br":
            parts.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in EMPTY and not found[3].endswith("/"):
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag in CLOSES_ITS_LIKE):
                stack.pop()
            stack.append((tag, names(tag, found[3])))
    flush()
    return out


def silver(block: Block) -> int:
    """Label of a block for training, from the names above it; where they say nothing, from its text."""
    bare = [n.lstrip(".") for n in block.path]
    if any(n in FURNITURE for n in bare):
        return 0
    if any(n in ARTICLE for n in bare if n != "body") or ".body" in block.path:
        return 1
    heading = bool(block.path) and re.fullmatch("h[1-6]", block.path[-1]) is not None
    return int(block.link_chars * 2 < len(block.text) and (heading or len(block.text.split()) >= 8 or SENTENCE.search(block.text) is not None))


PATH_SIZE, WORD_SIZE, PLAIN_SIZE = 96, 16, 8
SIZE = PATH_SIZE + WORD_SIZE + PLAIN_SIZE


def place(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


@lru_cache(maxsize=100_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of a path; the nearest two count apart."""
    out = np.zeros(PATH_SIZE, np.float32)
    for name in path:
        out[place(name, PATH_SIZE)] = 1.0
        if name.lstrip(".") in FURNITURE:
            out[place("furniture", PATH_SIZE)] = 1.0
    for depth, name in enumerate(path[-2:]):
        out[place(f"{depth}{name}", PATH_SIZE)] += 0.5
    return out


@lru_cache(maxsize=100_000)
def word_place(word: str) -> int:
    """Place of a word in its vector; those from WORD_SIZE on count down."""
    h = zlib.crc32(word.lower().encode())
    return h % WORD_SIZE + (0 if h & 0x10000 else WORD_SIZE)


def word_vector(words: list[str]) -> np.ndarray:
    """Hashed words, all of them, in one size whatever their number."""
    counts = np.bincount([word_place(w) for w in words], minlength=2 * WORD_SIZE)
    return (counts[:WORD_SIZE] - counts[WORD_SIZE:]) * (0.5 / np.sqrt(len(words)))


def features(blocks: list[Block]) -> np.ndarray:
    """One row for each block: path, all its words hashed, and length, links, sentence end, place and share of digits."""
    out = np.zeros((len(blocks), SIZE), np.float32)
    for i, block in enumerate(blocks):
        row, text = out[i], block.text
        row[:PATH_SIZE] = path_vector(block.path)
        words = text.split()
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = word_vector(words)
        size = len(text)
        row[PATH_SIZE + WORD_SIZE :] = (
            np.log1p(size) / 6, min(len(words), 40) / 40, block.link_chars / size, SENTENCE.search(text) is not None,
            i / len(blocks), len(blocks) < 8, sum(map(len, DIGITS.findall(text))) / size, 1.0,
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lstm:
    """One direction; gates in the order input, forget, output, candidate."""

    def __init__(self, rng: np.random.Generator, size: int, hidden: int) -> None:
        self.hidden = hidden
        self.w = (rng.standard_normal((size, 4 * hidden)) / np.sqrt(size)).astype(np.float32)
        self.u = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1.0

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (steps, pages, size); a masked step leaves the state as it is."""
        steps, pages, _ = x.shape
        n, inputs = self.hidden, (x.reshape(-1, x.shape[2]) @ self.w + self.b).reshape(steps, pages, -1)
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.empty((steps, pages, n), np.float32)
        for t in range(steps):
            z = inputs[t] + h @ self.u
            gates, g = sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            c_new = gates[:, n : 2 * n] * c + gates[:, :n] * g
            squashed = np.tanh(c_new)
            if keep is not None:
                keep.append((h, c, gates, g, squashed, m))
            h = m * (gates[:, 2 * n :] * squashed) + (1 - m) * h
            c = m * c_new + (1 - m) * c
            out[t] = h
        return out

    def backward(self, x: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        n = self.hidden
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, gates, g, squashed, m = kept[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            total = dh + d_out[t]
            inner = m * total
            d_c = m * dc + inner * o * (1 - squashed**2)
            dz = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), inner * squashed * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
            dw += x[t].T @ dz
            du += h.T @ dz
            db += dz.sum(axis=0)
            dh = dz @ self.u.T + (1 - m) * total
            dc = d_c * f + (1 - m) * dc
        return [dw, du, db]


@dataclass
class Settings:
    """``pages`` rows at most are read for training, the ones with the smallest hashes of their id.

    All their blocks are learned; a page of more than ``steps`` blocks is read in parts of like length.
    """

    pages: int = 240
    variants: int = 2
    hidden: int = 16
    epochs: int = 10
    batch: int = 32
    steps: int = 512
    seed: int = 11
    rate: float = 0.01


@dataclass
class Labeller:
    """Reads the blocks of a page both ways and gives each the probability of being main text."""

    settings: Settings = field(default_factory=Settings)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.settings.seed)
        self.ahead, self.back = Lstm(rng, SIZE, self.settings.hidden), Lstm(rng, SIZE, self.settings.hidden)
        self.v = (rng.standard_normal(2 * self.settings.hidden) / 4).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def run(self, pages: list[np.ndarray], keep: bool = False):
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), np.float32)
        for i, rows in enumerate(pages):
            x[: len(rows), i], mask[: len(rows), i] = rows, 1.0
        kept = ([], []) if keep else (None, None)
        a = self.ahead.forward(x, mask, kept[0])
        b = self.back.forward(x[::-1], mask[::-1], kept[1])[::-1]
        both = np.concatenate([a, b], axis=2)
        p = sigmoid(both @ self.v + self.bias[0])
        return (p, x, mask, both, kept) if keep else p

    def label(self, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
        """Probabilities for each page; pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        low = 0
        while low < len(order):
            high = low + 1
            while high < len(order) and len(pages[order[high]]) * (high + 1 - low) <= cells and high - low < 512:
                high += 1
            p = self.run([pages[i] for i in order[low:high]])
            for j, i in enumerate(order[low:high]):
                out[i] = p[: len(pages[i]), j]
            low = high
        return out

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        weights = [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.bias]
        first, second, count = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(s.epochs):
            order = sorted(range(len(pages)), key=lambda i: (len(pages[i]) // 8, rng.random()))
            groups = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
            for g in rng.permutation(len(groups)):
                own = groups[g]
                p, x, mask, both, kept = self.run([pages[i] for i in own], keep=True)
                y = np.zeros_like(p)
                for j, i in enumerate(own):
                    y[: len(labels[i]), j] = labels[i]
                d = (p - y) * mask / mask.sum()
                d_both = d[:, :, None] * self.v
                n = s.hidden
                grads = [
                    *self.ahead.backward(x, kept[0], d_both[:, :, :n]), *self.back.backward(x[::-1], kept[1], d_both[::-1, :, n:]),
                    np.einsum("tp,tph->h", d, both), np.array([d.sum()]),
                ]
                count += 1
                rate = s.rate * (1 - 0.9 * epoch / s.epochs)
                for w, grad, a, b in zip(weights, grads, first, second):
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad**2 - b)
                    w -= (rate * (a / (1 - 0.9**count)) / (np.sqrt(b / (1 - 0.999**count)) + 1e-8)).astype(np.float32)


def variant(texts: list[str], menu: list[str], rng: np.random.Generator) -> str:
    """A page of another layout around the texts of a page, for training."""
    pick = lambda options: options[rng.integers(len(options))]
    esc = html.escape

    def items(words: list[str]) -> str:
        return "".join(f'<li><a href="/">{esc(w)}</a></li>' for w in words)

    def lines(words: list[str]) -> str:
        return "".join(f"<p>{esc(w)}</p>" for w in words)

    some = lambda: [pick(texts + menu) for _ in range(rng.integers(1, 4))]
    furniture = [
        lambda: f"<nav><ul>{items(menu)}</ul></nav>", lambda: f'<div class="menu"><ul>{items(menu)}</ul></div>',
        lambda: f"<header>{lines(menu[:2])}</header>", lambda: f'<div id="header"><p>{esc(pick(menu))}</p></div>',
        lambda: f'<div class="ad">{esc(pick(texts))}</div>', lambda: f'<div class="advert banner"><p>{esc(pick(texts))}</p></div>',
        lambda: f'<div class="cookie-notice">{lines(some())}</div>', lambda: f"<aside>{lines(some())}</aside>",
        lambda: f'<div class="sidebar widget"><h3>{esc(pick(menu))}</h3>{lines(some())}</div>',
        lambda: f'<form><label>{esc(pick(menu))}</label><p>{esc(pick(texts))}</p><button>{esc(pick(menu))}</button></form>',
        lambda: f'<div class="related"><h2>{esc(pick(menu))}</h2><ul>{items(menu)}</ul></div>',
    ]
    closing = [
        lambda: f"<footer>{lines(some())}</footer>", lambda: f'<div id="footer">&copy; {esc(pick(texts))}</div>',
        lambda: f'<section id="comments"><h2>{esc(pick(menu))}</h2>{"".join(f"<div class=comment><p>{esc(t)}</p></div>" for t in some())}</section>',
        lambda: f'<div class="comments"><ul>{"".join(f"<li class=comment>{esc(t)}</li>" for t in some())}</ul></div>',
        lambda: f'<div class="share social">{esc(pick(menu))}</div>', lambda: f'<div class="newsletter">{lines(some())}</div>',
    ]
    shapes = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>"]
    body = [f"<h1>{esc(texts[0])}</h1>"] + [pick(shapes).format(esc(t)) for t in texts[1:]]
    if rng.random() < 0.4:
        body.insert(rng.integers(len(body) + 1), pick(furniture)())
    frame = pick(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="main">{}</div>', '<section class="post"><div class="entry-content">{}</div></section>', "<main><article>{}</article></main>", "<div>{}</div>"])
    top = "".join(pick(furniture)() for _ in range(rng.integers(1, 4)))
    return f"<body>{top}{frame.format(''.join(body))}{''.join(pick(closing)() for _ in range(rng.integers(1, 4)))}</body>"


def parts(rows: np.ndarray, steps: int) -> list[np.ndarray]:
    """All rows of a page in order, in as few parts of like length as hold at most ``steps`` rows."""
    return np.array_split(rows, -(-len(rows) // steps))


def train(pages: DataFrame, page_id: str = "page_id", source: str = "html", settings: Settings | None = None) -> Labeller:
    """Fits a labeller on a bounded sample of pages, and on their texts in other layouts.

    Labels come from the names of tags, classes and ids, see ``silver``. Rows read: ``settings.pages``,
    each with all its blocks.
    """
    s = settings or Settings()
    sample = pages.select(F.col(page_id).alias("k"), F.col(source).alias("h")).where("k is not null and h is not null")
    keys = [r["k"] for r in sample.select("k").distinct().orderBy(F.xxhash64("k")).limit(s.pages).collect()]
    rows = sample.where(F.col("k").isin(keys)).groupBy("k").agg(F.min("h").alias("h")).collect()
    rows.sort(key=lambda r: r["k"])
    rng = np.random.default_rng(s.seed)
    sources = [r["h"] for r in rows]
    for text in list(sources):
        found = blocks_of(text)
        kept, rest = [b.text for b in found if silver(b)], [b.text for b in found if not silver(b)]
        if kept and rest:
            sources += [variant(kept, [r[:40] for r in rest[:6]], rng) for _ in range(s.variants)]
    pages_in = [b for b in map(blocks_of, sources) if b]
    model = Labeller(s)
    if pages_in:
        # features are those of the whole page, so that places count from its start
        rows_in = [x for b in pages_in for x in parts(features(b), s.steps)]
        model.fit(rows_in, [y for b in pages_in for y in parts(np.array([silver(x) for x in b], np.float32), s.steps)])
    return model


def _extract(batches: Iterator[pa.RecordBatch], model: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [blocks_of(x or "") for x in batch.column(2).to_pylist()]
        scores = model.label([features(b) for b in found])
        texts = ["\n".join(b.text for b, p in zip(blocks, ps) if p > 0.5) for blocks, ps in zip(found, scores)]
        counts = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts, pa.array([len(b) for b in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every row.

    The text is that of all blocks that the labeller takes for main text, in page order, one line
    each: character references decoded, white space made one space. Scripts, styles and titles are
    no blocks. A null or empty page, and one without such a block, has an empty text. Repeated rows
    come out as often. Every block of every page is labelled, whatever its length.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(partial(_extract, model=model), "page_id long, url string, text string, n_chars long, n_blocks long")
