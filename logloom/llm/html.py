"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is parsed into leaf blocks (runs of text between block-level tags) that know the tags, classes
and roles above them. The field has two labels, article and rest; its features are those ancestors and
what the text looks like. It is trained in numpy on labelled pages (``labelled_pages`` makes them: many
layouts, any of whose hints may be missing) and decoded by Viterbi, page by page, on the executors.

Null and empty pages give an empty text, very long ones are read whole, an empty table gives an empty
result. Pages repeat freely, with or without an id; other columns are left out. Broken markup (unclosed or
stray tags, open quotes, raw "<", elements nested however deep) is read the way browsers do as far as text
goes. Text that a browser does not show is left out: of scripts, styles, templates, controls, players, and of
elements that are hidden by an attribute.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, read

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:\b(class|id|role|aria-label|itemprop)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"[\s\x00]+")
ANY_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIPPED = frozenset("head template select button svg audio video datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: A start tag on the left ends an open element on the right, up to the nearest of the barriers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
SCOPE = frozenset("table td th caption button object html body article div section main".split())


class Block:
    __slots__ = ("above", "own", "text", "linked")

    def __init__(self, above: frozenset, own: str, text: str, linked: int):
        self.above, self.own, self.text, self.linked = above, own, text, linked


@lru_cache(maxsize=4096)
def tokens(tag: str, attributes: str) -> frozenset:
    out = {f"t:{tag}"}
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        out |= {f"c:{x.lower()}" for x in SPLIT.findall(a or b or c)}
    return frozenset(out)


@lru_cache(maxsize=4096)
def is_hidden(attributes: str) -> bool:
    """Whether a start tag's attributes keep its element from being shown: by name, whatever other values say."""
    for name, a, b, c in ANY_ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            return True
    return False


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """The leaf blocks in page order. known: the features worth carrying (None: all)."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    text: list[str] = []
    linked = skip = 0  # characters inside links; open elements whose text doesn't count
    opened: Counter = Counter()  # open elements by tag, so that stray end tags cost nothing
    empty: frozenset = frozenset()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = SPACE.sub(" ", "".join(text)).strip(" ")
            if whole:
                own = next((t for t, _ in reversed(stack) if t in BLOCK), "")
                out.append(Block(stack[-1][1] if stack else empty, own, whole, linked))
            text.clear()
        linked = 0

    def pop(n: int) -> None:
        nonlocal skip
        while len(stack) > n:
            tag = stack.pop()[0]
            skip -= tag[0] == "!"
            opened[tag.lstrip("!")] -= 1

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.match(page, pos)
        pos = m.end()
        if (data := m[7]) is not None:
            if not skip:
                data = entities.unescape(data)
                text.append(data)
                if opened["a"]:
                    linked += len(data.strip())
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0].lstrip("!") == tag:
                    pop(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = m.end() if m else end
            continue
        if tag in BLOCK:
            flush()
            for ends, barriers in ([CLOSES[tag]] if tag in CLOSES else []) + [({"p"}, SCOPE)]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] in barriers:
                        break
        elif tag == "br":
            text.append("\n")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in {"a", "b", "i", "span"}:
            continue
        if tag == "body":
            pop(0)
        own = tokens(tag, attributes)
        if known is not None:
            own &= known
        above = stack[-1][1] | own if stack else own
        hidden = tag in SKIPPED or bool(attributes) and is_hidden(attributes)
        skip += hidden
        opened[tag] += 1
        stack.append((f"!{tag}" if hidden else tag, above))
    flush()
    return out


# Words that tell notices, forms and menus from articles.
CUES = frozenset(
    "cookie cookies subscribe newsletter login sign register share tweet comment comments reply advertisement sponsored menu home about "
    "contact privacy terms copyright rights reserved search related more next previous skip accept policy consent follow".split()
)


def looks(block: Block, at: int, of: int) -> list[str]:
    """Features of a block's own text and place."""
    text = block.text
    n = text.count(" ") + 1
    out = ["1", f"own:{block.own}", f"n:{min(6, n.bit_length())}"]
    share = block.linked / max(1, len(text))
    out.append(f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}")
    out.append("stop" if text[-1] in ".!?…\"”»" else "open")
    if "©" in text or "(c)" in text:
        out.append("copy")
    if share and (" | " in text or " · " in text or " » " in text or " › " in text):
        out.append("bars")
    if n <= 40:
        out += {f"w:{w}" for w in re.findall("[a-z]+", text.lower()) if w in CUES}
    if at == 0:
        out.append("first")
    if at == of - 1:
        out.append("last")
    return out


class Field:
    """Binary linear-chain field. w: each feature's score for article over rest; t: for a pair of labels."""

    def __init__(self, w: dict[str, float] | None = None, t: np.ndarray | None = None):
        self.w, self.t = w or {}, np.zeros((2, 2)) if t is None else t

    def features(self, page: list[Block]) -> list[list[str]]:
        return [sorted(b.above) + looks(b, k, len(page)) for k, b in enumerate(page)]

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.2, decay: float = 2e-4, seed: int = 3) -> Field:
        """Gradient ascent on the log-likelihood, by forward and backward sums."""
        rows = [(self.features(b), np.array(y)) for b, y in pages if b]
        names = sorted({f for x, _ in rows for block in x for f in block})
        place = {f: k for k, f in enumerate(names)}
        data = [([np.array([place[f] for f in block]) for block in x], y) for x, y in rows]
        w, squares, t, rng = np.zeros(len(names)), np.full(len(names), 1e-2), np.zeros((2, 2)), random.Random(seed)
        for epoch in range(epochs):
            rng.shuffle(data)
            for x, y in data:
                n = len(x)
                s = np.zeros((n, 2))
                s[:, 1] = [w[f].sum() for f in x]
                a, b = np.empty((n, 2)), np.zeros((n, 2))
                a[0] = s[0]
                for k in range(1, n):
                    a[k] = s[k] + np.logaddexp(a[k - 1, 0] + t[0], a[k - 1, 1] + t[1])
                for k in range(n - 2, -1, -1):
                    b[k] = np.logaddexp(t[:, 0] + s[k + 1, 0] + b[k + 1, 0], t[:, 1] + s[k + 1, 1] + b[k + 1, 1])
                z = np.logaddexp(a[-1, 0], a[-1, 1])
                p = np.exp(a[:, 1] + b[:, 1] - z)
                g = np.zeros_like(w)
                for f, e in zip(x, y - p):
                    g[f] += e
                for k in range(1, n):
                    pair = np.exp(a[k - 1][:, None] + t + s[k] + b[k] - z)
                    pair[y[k - 1], y[k]] -= 1
                    t -= 0.02 * pair / n
                squares += g * g
                w += rate * g / np.sqrt(squares)
                w *= 1 - decay
        self.w, self.t = {f: float(w[k]) for f, k in place.items()}, t
        return self

    def decode(self, page: list[Block], above: dict[frozenset, float]) -> list[int]:
        """Viterbi. above: remembered scores of sets of ancestors."""
        if not page:
            return []
        (t00, t01), (t10, t11) = self.t.tolist()
        w, back, zero, one = self.w, [], 0.0, 0.0
        for k, b in enumerate(page):
            s = above.get(b.above)
            if s is None:
                s = above[b.above] = sum(w.get(f, 0.0) for f in b.above)
            s += sum(w.get(f, 0.0) for f in looks(b, k, len(page)))
            if k == 0:
                zero, one = 0.0, s
                continue
            from0, from1 = (1 if one + t10 > zero + t00 else 0), (1 if one + t11 > zero + t01 else 0)
            back.append((from0, from1))
            zero, one = (one + t10 if from0 else zero + t00), s + (one + t11 if from1 else zero + t01)
        y = [1 if one > zero else 0]
        for pair in reversed(back):
            y.append(pair[y[-1]])
        return y[::-1]


MARK = ""  # begins every text of an article in the labelled pages


def labelled_pages(n: int = 360, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Invented pages of many layouts, with the label of each leaf block."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tas vo der un pel sha qui zor ne ba til gra es om".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize()

    def prose(a: int = 1, b: int = 6) -> str:
        return " ".join(words(2, 18) + rng.choice("..!?.") for _ in range(rng.randint(a, b)))

    def inline(text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 4 and rng.random() < 0.3:
            k = rng.randrange(len(parts) - 2)
            tag = rng.choice(["b", "i", "em", "a href='/x'", "span", "strong"])
            parts[k] = f"<{tag}>{parts[k]}"
            parts[k + 1] += f"</{tag.split(' ')[0]}>" if rng.random() < 0.85 else ""
        return " ".join(parts)

    def box(names: list[str], tags: list[str], inside: str, bare: float = 0.35) -> str:
        """An element that tells what it is by its tag, by its class or id, or not at all."""
        tag = rng.choice(tags) if rng.random() > bare else "div"
        hint = f' {rng.choice(["class", "id"])}="{rng.choice(names)}{rng.choice(["", "-box", " x1", "_main", "-wrap"])}"' if tag == "div" and rng.random() < 0.9 or rng.random() < 0.4 else ""
        return f"<{tag}{hint}>{inside}</{tag}>"

    def links(a: int, b: int) -> str:
        item = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
        n = rng.randint(a, b)
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(item() for _ in range(n)), lambda: "".join(f"<p>{item()}</p>" for _ in range(n))])()

    def article() -> str:
        p = lambda text: f"<p>{MARK}{inline(text)}" + ("</p>" if rng.random() < 0.9 else "")
        out = [f"<h1>{MARK}{words(2, 12)}{rng.choice(['', '.'])}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.7:
                out.append(p(prose() if rng.random() < 0.8 else words(1, 5) + "."))
            elif kind < 0.78:
                out.append(f"<p><b>{MARK}{prose(1, 3)}<br><p>{MARK}{prose()}</p>")
            elif kind < 0.85:
                out.append(f"<h{(k := rng.choice('234'))}>{MARK}{words(1, 7)}</h{k}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{MARK}{prose(1, 2)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{rng.choice(['', '<p>'])}{MARK}{prose(1, 3)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<pre>{MARK}{words(3, 9)}</pre>")
            elif kind < 0.97:
                out.append(f"<figure><img src='a.png'><figcaption>{MARK}{words(3, 9)}.</figcaption></figure>")
            else:
                out.append("<table><tr>" + "".join(f"<td>{MARK}{words(1, 4)}</td>" for _ in range(4)) + "</tr></table>")
            if rng.random() < 0.06:
                out.append(advert())
        if not out:
            out = [p(prose())]
        return "".join(out)

    def advert() -> str:
        return box(["ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner"], ["aside", "div", "ins"], rng.choice([prose(1, 2), words(2, 8), f"<p>{prose(1, 3)}</p>", "Advertisement"]), 0.5)

    def notice() -> str:
        ask = rng.choice(["We use cookies to improve this site.", "Accept our privacy policy.", "Subscribe to our newsletter!", prose(1, 2)])
        return box(["cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe"], ["div", "section", "dialog"], f"<p>{ask}</p>" + rng.choice(["", "<button>OK</button>", "<a href='#'>Accept</a>"]), 0.6)

    def form() -> str:
        return f"<form{rng.choice(['', ' class=login', ' id=search'])}><label>{words(1, 3)}</label><input name=q><p>{rng.choice([words(2, 6), prose(1, 2)])}</p><button>Go</button></form>"

    def comments() -> str:
        one = lambda: rng.choice([lambda: f"<p>{prose(1, 4)}</p>", lambda: f"<div class='comment'><b>{word()}</b> <p>{prose(1, 3)}</p><a href='#'>Reply</a></div>", lambda: f"<li>{prose(1, 3)}</li>", lambda: f"<article class='comment'><p>{prose(1, 3)}</p></article>"])()
        return box(["comments", "comment-list", "responses", "discussion", "disqus", "replies"], ["section", "div", "aside"], rng.choice(["<h2>Comments</h2>", f"<h3>{rng.randint(2, 30)} comments</h3>", ""]) + "".join(one() for _ in range(rng.randint(1, 5))), 0.6)

    def side() -> str:
        return box(["sidebar", "side", "widget", "related", "rail", "aside"], ["aside"], f"<h3>{words(1, 3)}</h3>" + rng.choice([links(2, 6), f"<p>{prose(1, 3)}</p>", links(2, 4) + f"<p>{prose(1, 2)}</p>"]), 0.45)

    out = []
    for _ in range(n):
        top = box(["header", "masthead", "topbar", "site-header", "banner"], ["header"], rng.choice([words(1, 4), f"<p>{words(2, 8)}</p>", f"<h2>{words(1, 4)}</h2><p>{prose(1, 1)}</p>"])) if rng.random() < 0.45 else ""
        menu = box(["nav", "menu", "navigation", "navbar", "breadcrumb", "links"], ["nav"], links(2, 8)) if rng.random() < 0.85 else ""
        foot = box(["footer", "foot", "bottom", "copyright", "site-footer"], ["footer"], rng.choice([f"&copy; {word()}.com &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p>", links(2, 5), f"<p>Copyright 2020 {words(1, 3)}. All rights reserved.</p>", prose(1, 1)])) if rng.random() < 0.85 else ""
        body = box(["content", "main", "post", "entry", "article", "story", "text", "article-body"], ["article", "main", "article"], article(), 0.3)
        if rng.random() < 0.25:
            body = f"<main>{body}</main>" if rng.random() < 0.5 else f"<div class='container'>{body}</div>"
        before = [x() for x in (notice, advert, form, side) if rng.random() < 0.3]
        after = [x() for x in (comments, side, advert, form, notice) if rng.random() < 0.3]
        rng.shuffle(before)
        page = f"<html><head><title>{words(2, 5)}</title><style>p{{}}</style></head><body>" + rng.choice([top + menu, menu + top]) + "".join(before) + body + "".join(after) + foot
        found = blocks(page + rng.choice(["</body></html>", ""]))
        labels = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "") or "-"
        out.append((found, labels))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 360, seed: int = 11) -> Field:
    return Field().fit(labelled_pages(n, seed))


def main_text(page: str, field: Field, known: frozenset, above: dict) -> str:
    found = blocks(page, known)
    return "\n\n".join(b.text for b, y in zip(found, field.decode(found, above)) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        known, above = frozenset(f for f in field.w if f[:2] in ("t:", "c:")), {}
        for whole in batches:
            for batch in pieces(whole, "html", 1 << 22):
                texts = [main_text(x or "", field, known, above) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
