"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks, runs of text between block-level tags. Ancestor tags, their class and
id words, and the block's own text score each block as main text or not, learned transitions tie neighbours, and
Viterbi decodes the page. The field is trained on labelled pages, by default built here from many layouts. One narrow
pass over whole pages.

What the open elements say of a block is kept as a running sum while a page is read, so time and memory are linear in
the page, however deep its elements nest.

Defined cases: a null or empty html has no text; unclosed, crossed and stray tags never fail; scripts, styles,
closed templates and comments hold no text; closed svg, math, object and noscript elements are open elements like
others, and their tags count for nothing where the end tag is missing; text outside any tag is a block; equal pages
give equal texts; repeated rows give repeated results; an empty table gives no row; a null page_id or url is kept;
other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .language import forward_backward, packed

#: Elements whose borders are borders of blocks, elements without end tags, elements without text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
#: Raw elements that go on to the end of the page where they have no end tag; such a tag of the others is passed over.
TO_THE_END = frozenset("script style".split())
#: Elements of which only those with an end tag are opened.
PAIRED = frozenset("noscript template svg math object".split())
#: Elements that an opening tag of the same set ends.
SIBLINGS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
MARK = re.compile(r"""\b(class|id|role|hidden|style|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
TOKEN = re.compile(r"[a-z]+")
COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
#: Tags of paired elements (the last two groups), and what may hold such tags as plain text: comments, raw elements.
PAIRS = re.compile(
    rf"{COMMENT.pattern}|<({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>"
    rf"|<(/?)({'|'.join(sorted(PAIRED))})(?=[\s/>])(?:{REST.pattern})?",
    re.I | re.S,
)


@dataclass
class Block:
    """Text, the weight of its open elements under a model, what they are (in training only), and how much is in links."""

    text: str
    score: float = 0.0
    path: tuple[str, ...] = ()
    linked: int = 0
    label: int = 0


class Open:
    """The open elements, with what is asked of them in constant time: the places of each tag, of those that stop
    a search for siblings (borders), of block elements (walls), and the sum of the model's weights of their distinct features."""

    def __init__(self, weights: dict[str, float] | None):
        self.weights, self.features = weights, {}
        self.names: list[str] = []
        self.own: list[list[str]] = []
        self.places: dict[str, list[int]] = {}
        self.borders: list[int] = []
        self.walls: list[int] = []
        self.sums = [0.0]

    def push(self, name: str, marks: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCKS or name in PAIRED:
            self.borders.append(len(self.names))
        if name in BLOCKS:
            self.walls.append(len(self.names))
        own = [f"in:{name}", *(f"mark:{w}" for w in marks.split())]
        total = self.sums[-1]
        for f in own:
            held = self.features.get(f, 0)
            if not held and self.weights is not None:
                total += self.weights.get(f, 0.0)
            self.features[f] = held + 1
        self.names.append(name)
        self.own.append(own)
        self.sums.append(total)

    def cut(self, place: int) -> None:
        """Close the element at this place and all within it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.places[name].pop()
            if self.borders and self.borders[-1] == len(self.names):
                self.borders.pop()
            if name in BLOCKS:
                self.walls.pop()
            for f in self.own.pop():
                self.features[f] -= 1
                if not self.features[f]:
                    del self.features[f]
            self.sums.pop()

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def block(self, text: str, linked: int) -> Block:
        tags = [self.names[k] for k in self.walls[-2:]]
        leaf = [f"leaf:{tags[-1]}", f"pair:{'/'.join(tags)}"] if tags else []
        if self.weights is None:
            return Block(text, 0.0, (*self.features, *leaf), linked)
        return Block(text, self.sums[-1] + sum(self.weights.get(f, 0.0) for f in leaf), (), linked)


class EndTags:
    """End tags of raw elements, asked for at rising places: a name of which none is left is not searched again."""

    def __init__(self, page: str):
        self.page, self.none = page, set()

    def next(self, name: str, at: int) -> re.Match | None:
        found = None if name in self.none else re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(self.page, at)
        if not found:
            self.none.add(name)
        return found


def paired(page: str, at: int) -> dict[int, int]:
    """Start of the tag and end of the end tag of every paired element from ``at`` on that has an end tag."""
    opened: dict[str, list[int]] = {}
    ends, end_tags = {}, EndTags(page)
    while m := PAIRS.search(page, at):
        at = max(m.end(), at + 1)
        if m.group(1) and not m.group().endswith("/>"):
            name = m.group(1).lower()
            close = end_tags.next(name, at)
            at = close.end() if close else len(page) if name in TO_THE_END else at
        if not m.group(3):
            continue
        mine = opened.setdefault(m.group(3).lower(), [])
        if not m.group(2):
            if not m.group().rstrip(">").endswith("/"):
                mine.append(m.start())
        elif mine:
            ends[mine.pop()] = m.end()
    return ends


def blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The leaf blocks in page order, with references decoded and blanks joined; scored by ``weights``, if given."""
    opened = Open(weights)
    parts: list[str] = []
    out: list[Block] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(opened.block(text, linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if opened.last("a") >= 0:
                linked += len(text.strip())

    at, n, end_tags = 0, len(page), EndTags(page)
    pairs: dict[int, int] | None = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            at = COMMENT.match(page, lt).end()
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", lt)
        m = NAME.match(page, lt + 1 + closing)
        if not m:
            add("<")
            at = lt + 1
            continue
        name = m.group().lower()
        rest = REST.match(page, m.end())
        end = rest.end() if rest else page.find(">", m.end()) + 1
        at = end or n
        if closing:
            if name in BLOCKS:
                flush()
            place = opened.last(name)
            # An end tag within a line does not reach out of the block it stands in.
            around = opened.walls[-1] if opened.walls and name not in BLOCKS and name not in PAIRED else -1
            if place > around:
                if name in PAIRED and any(t in BLOCKS for t in opened.names[place:]):
                    flush()
                opened.cut(place)
            continue
        if name in BLOCKS:
            flush()
            ends = SIBLINGS.get(name, {"p"} if name != "p" else set())
            for k in reversed(opened.borders):
                if opened.names[k] in ends:
                    opened.cut(k)
                    break
                if opened.names[k] != "p":
                    break
        alone = page[m.end() : at].rstrip(">").endswith("/")
        if name in RAW:
            foreign = opened.last("svg") >= 0 or opened.last("math") >= 0
            if not alone or not foreign and name in ("script", "style", "textarea", "title"):
                close = end_tags.next(name, at)
                if close and name == "xmp":
                    # Shown as it stands: neither tags nor references are read in it.
                    flush()
                    add(page[at : close.start()].replace("&", "&amp;"))
                    flush()
                at = close.end() if close else n if name in TO_THE_END else at
            continue
        if name in PAIRED and not alone:
            if pairs is None:
                pairs = paired(page, lt)
            if lt not in pairs:
                continue
            if name == "template":
                at = pairs[lt]
                continue
        if name == "br":
            add(" ")
        elif name not in VOID and not alone:
            opened.push(name, _marks(page[m.end() : at]))
    flush()
    return out


@lru_cache(maxsize=2_000)
def _marks(attributes: str) -> str:
    found = []
    for m in MARK.finditer(attributes):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            found.append("hidden")
        elif key != "style":
            found += TOKEN.findall(value)
    return " ".join(found)


def text_features(block: Block, position: int, count: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    return [
        f"words:{words.bit_length()}",
        f"links:{0 if not share else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"end:{text[-1] if text[-1] in '.!?:;,|' else 'a' if text[-1].isalnum() else '#'}",
        f"start:{'©' if '©' in text[:40] else 'A' if text[0].isupper() else 'a' if text[0].isalpha() else '9' if text[0].isdigit() else '#'}",
        f"stops:{min(4, text.count('. '))}",
        f"sep:{any(c in text for c in '|·»›•')}",
        f"at:{min(3, 4 * position // count)}",
    ]


@dataclass
class Field:
    weights: dict[str, float]
    stay: np.ndarray  # log transitions, 2 x 2
    start: np.ndarray

    def scores(self, found: list[Block]) -> np.ndarray:
        get, out = self.weights.get, np.zeros((len(found), 2))
        for i, b in enumerate(found):
            out[i, 1] = b.score + sum(get(f, 0.0) for f in text_features(b, i, len(found)))
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        scores = self.scores(found).tolist()
        (s00, s01), (s10, s11) = self.stay.tolist()
        a, b = scores[0][0] + float(self.start[0]), scores[0][1] + float(self.start[1])
        back = []
        for e0, e1 in scores[1:]:
            x0, x1 = a + s00 >= b + s10, a + s01 > b + s11
            back.append((0 if x0 else 1, 0 if x1 else 1))
            a, b = (a + s00 if x0 else b + s10) + e0, (a + s01 if x1 else b + s11) + e1
        y = int(b >= a)
        out = [bool(y)]
        for came in reversed(back):
            y = came[y]
            out.append(bool(y))
        return out[::-1]


def fit(pages: list[list[Block]], epochs: int = 25, seed: int = 5) -> Field:
    """Adaptive gradient ascent on the likelihood of the labelled pages' block sequences."""
    index: dict[str, int] = {}
    pages = [p for p in pages if p]
    data = []
    for p in pages:
        rows = [[index.setdefault(f, len(index)) for f in (*b.path, *text_features(b, i, len(p)))] for i, b in enumerate(p)]
        data.append((rows, np.array([b.label for b in p])))
    theta, moves, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    seen, seen_m, seen_s = np.full(len(index), 1e-2), np.full((2, 2), 1.0), np.full(2, 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for begin in range(0, len(order), 20):
            chosen = [data[i] for i in order[begin : begin + 20]]
            by, offsets, live = packed(np.array([len(y) for _, y in chosen]))
            at = [(j, t) for t, n in enumerate(live) for j in range(n)]
            feats = [chosen[by[j]][0][t] for j, t in at]
            gold = np.array([chosen[by[j]][1][t] for j, t in at])
            flat, owner = np.concatenate(feats), np.repeat(np.arange(len(feats)), [len(f) for f in feats])
            s = np.bincount(owner, theta[flat], len(feats))
            em = np.exp(np.stack([np.minimum(0, -s), np.minimum(0, s)], axis=1))
            alpha, beta, scale = forward_backward(em, np.exp(moves), np.exp(start), offsets, live)
            post = alpha * beta
            post /= post.sum(axis=1, keepdims=True)
            g = np.bincount(flat, (gold - post[:, 1])[owner], len(theta)) / len(chosen) - 1e-3 * theta
            seen += g**2
            theta += 0.3 * g / np.sqrt(seen)
            one = np.eye(2)[gold]
            move = -1e-2 * moves
            for t in range(1, len(live)):
                now, old = slice(offsets[t], offsets[t] + live[t]), slice(offsets[t - 1], offsets[t - 1] + live[t])
                pair = alpha[old][:, :, None] * np.exp(moves)[None] * (em[now] * beta[now] / scale[now][:, None])[:, None, :]
                move += (np.einsum("ni,nj->ij", one[old], one[now]) - pair.sum(axis=0)) / len(chosen)
            seen_m += move**2
            moves += 0.2 * move / np.sqrt(seen_m)
            first = (one[: live[0]] - post[: live[0]]).mean(axis=0)
            seen_s += first**2
            start += 0.2 * first / np.sqrt(seen_s)
    return Field({f: float(theta[i]) for f, i in index.items()}, moves, start)


def training_pages(count: int = 400, seed: int = 23, weights: dict[str, float] | None = None) -> list[list[Block]]:
    """Labelled pages of many layouts: the main text is marked while a page is built, and read back by its mark. With
    ``weights``, the blocks are scored like those of any page."""
    rng = random.Random(seed)
    syllables = "th er on an re in ou le que de la en ion ver sch ung ado mente ción as os eau ch tre ai".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int = 3, high: int = 18) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose() -> str:
        kind = rng.random()
        if kind < 0.12:
            return " ".join(w + rng.choice(["%%%", "***", "&amp;&amp;&amp;", "$$$", " |"]) for w in sentence(8, 40).split())
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 3, 5, 9])))

    good = lambda text: f"\x01{text}"
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a>'
    pick = rng.choice

    def inline(text: str) -> str:
        words = text.split(" ")
        if rng.random() < 0.3:
            i = rng.randrange(len(words))
            words[i] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<b>{}", "<span>{}</span>"]).format(words[i])
        if rng.random() < 0.1:
            words.insert(rng.randrange(len(words)), "<br>")
        return " ".join(words)

    def body() -> str:
        out = []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            text = inline(good(prose()))
            if kind < 0.68:
                out.append(f"<p>{text}" + pick(["</p>", "</p>", ""]))
            elif kind < 0.74:
                out.append(f"<{pick(['h2', 'h3'])}>{good(sentence(1, 6))}</h2>")
            elif kind < 0.82:
                out.append("<ul>" + "".join(f"<li>{good(sentence(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.89:
                out.append("<table>" + "".join(f"<tr><td>{good(word())}</td><td>{good(word())}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.92:
                out.append(f"<pre>{good(word())} {word()}</pre>")
            elif kind < 0.93:
                out.append(f"<div>{text}</div>")
            elif kind < 0.95:
                out.append(pick(["<object data=x><p>{}</p></object>", "<p>{} <math><mi>x</mi></math></p>", "<p>{} <svg><text>x</text></svg></p>"]).format(text))
            else:
                out.append(advert())
        return "".join(out)

    advert = lambda: f'<div class="{pick(["ad", "ads", "advert", "sponsored", "promo", "ad banner", "advertisement"])}">{sentence(2, 12)}</div>'
    menu = lambda: f'<{pick(["nav", "div class=menu", "nav role=navigation", "div id=nav"])}><ul>' + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul></nav></div>"
    header = lambda: f'<{pick(["header", "div class=header", "div id=header"])}><div class="logo">{word()}</div><p>{sentence(2, 8)}</p></header></div>'
    notice = lambda: f'<div class="{pick(["cookie", "cookie-notice", "notice", "consent", "gdpr banner", "alert", "popup"])}" {pick(["", "role=dialog"])}><p>{sentence(5, 20)}</p><button>{word()}</button></div>'
    unscripted = lambda: f'<noscript>{pick(["<p>{}</p>", "<div>{}</div>", "{}"]).format(sentence(4, 15))}</noscript>'
    side = lambda: f'<{pick(["aside", "div class=sidebar", "aside class=sidebar", "div id=sidebar", "div class=related", "section class=related"])}><h3>{sentence(1, 4)}</h3>' + pick([lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>", lambda: f"<p>{sentence(4, 20)}</p>"])() + "</aside></div></section>"
    form = lambda: f'<form action="/s" class="{pick(["search", "newsletter", "subscribe", "contact", ""])}"><label>{sentence(1, 5)}</label><input name=q><button>{word()}</button><p>{sentence(2, 8)}</p></form>'
    footer = lambda: f'<{pick(["footer", "div class=footer", "div id=footer"])}>{pick(["&copy; ", "Copyright 2024 ", ""])}{word()} &middot; {sentence(2, 9)}{pick(["", link()])}</footer></div>'

    def comments() -> str:
        outer = pick(["section id=comments", "div class=comments", "div id=comments", "ol class=comment-list", "section class=discussion", "div class=responses"])
        one = lambda: f'<{pick(["div", "li", "article"])} class="comment"><p class="author">{word()}</p><p>{" ".join(sentence() for _ in range(rng.randint(1, 4)))}</p></div></li></article>'
        return f"<{outer}><h3>{sentence(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{outer.split()[0]}>"

    pages = []
    for _ in range(count):
        title = good(sentence(2, 10))
        wrap = pick(["article", "article", "article", "main", "div class=content", "div id=content", "div class=post", "div class=entry-content", "main><article", "section class=article-body", "div class=story", ""])
        close = "".join(f"</{t.split()[0]}>" for t in reversed(wrap.split("><")) if t)
        main = (f"<{wrap}>" if wrap else "") + pick([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", ""]) + body()
        if rng.random() < 0.1:
            main += pick([comments, form, side])()
        main += close
        before = [f() for f in (menu, header, notice, advert, side, form) if rng.random() < 0.45]
        after = [f() for f in (side, form, comments, advert, notice) if rng.random() < 0.35]
        if rng.random() < 0.15:
            before.append(unscripted())
        rng.shuffle(before)
        rng.shuffle(after)
        found = blocks("<html><body>" + "".join(before) + main + "".join(after) + (footer() if rng.random() < 0.8 else "") + "</body></html>", weights)
        for b in found:
            b.label = int("\x01" in b.text)
            b.text = b.text.replace("\x01", "").strip() or "."
        pages.append(found)
    return pages


@lru_cache(maxsize=1)
def trained() -> Field:
    return fit(training_pages())


def main_text(page: str | None, model: Field) -> str:
    found = blocks(page or "", model.weights)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url and the main text of each whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # size fixed by the training pages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return mapped(chosen, run, "page_id long, url string, text string")
