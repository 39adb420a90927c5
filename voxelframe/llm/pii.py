"""PII: fixed patterns, and a semi-Markov conditional random field over candidate segments.

Whole-segment features (shape, digits, checksums, neighbours) score segments of up to ``MOST`` words, and spelled-out
addresses of any number of words, for each kind; a dynamic programme over segment ends chooses boundaries and kinds
together. A segment begins and ends in a word with a digit or an @, or holds a spelled-out one, so only the
surroundings of such words are decoded and the rest of a text is known to be outside: the spans are those of the whole
text decoded at once. The model is trained here, by maximum likelihood on sentences built from the kinds' forms. The
patterns' spans always stay; the field adds spans that overlap none of them.

Defined cases: a null or empty text has no spans; a null doc_id is kept; texts of any length are scanned whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
OUT = len(KINDS)
#: Words of the longest segment, but for spelled-out addresses.
MOST = 6
#: Words before a trigger that a segment with it or its features can hold, and quiet words that part two triggers'.
BACK = MOST + 1
APART = MOST - 1 + BACK

#: The forms of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPELLED = {"[at]", "(at)", "[dot]", "(dot)"}
#: Digits that are none of \d. With \d apart, the class is not one large table, which would be slow to search.
DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())
MARK = r"(?:\[(?i:at|dot)\]|\((?i:at|dot)\))(?![^\x20\x09-\x0D])"
TRIGGER = re.compile(rf"[@\d{DIGITS}\[(](?:(?<=[^\[(])|(?i:at|dot)[\])])")
#: Words and spelled-out signs in turn, in whole.
CHAIN = re.compile(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++{MARK}[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)+")
AT = re.compile(r"\[at\]|\(at\)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by start, then kind. Each scan is linear in the text."""
    found: list[tuple[str, int, int]] = []
    past, at = 0, text.find("@")
    while at >= 0:
        # A match's local part is the run of its characters up to the @, after the match before.
        begin = at
        while begin > past and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", begin, m.end()))
            past = m.end()
        at = text.find("@", max(at + 1, past))
    if GROUP.search(text):
        for m in DOTTED.finditer(text):
            # Four groups of a chain are one match; the next begins at the group that follows.
            groups = [g.span() for g in GROUP.finditer(text, m.start(), m.end())] if m.group().count(".") >= 3 else []
            for k in range(0, len(groups) - 3, 4):
                part = groups[k : k + 4]
                if all(b - a < 4000 and int(text[a:b]) <= 255 for a, b in part):
                    found.append(("ip", part[0][0], part[3][1]))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def is_trigger(word: str) -> bool:
    return any(c.isdigit() for c in word) or "@" in word or word.lower() in SPELLED


def bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The segment without quotes and punctuation around it."""
    while start < end and text[start] in "\"'<>,;:!?[{=|*#$%&.":
        start += 1
    while end > start and text[end - 1] in "\"'<>,;:!?]}=|*#$%&.)":
        end -= 1
    return start, end


def segment_features(core: str, words: int, before: str, before2: str) -> list[str]:
    digits = "".join(c for c in core if c.isdigit() and c.isascii())
    n = len(digits)
    letters = sum(c.isalpha() for c in core)
    shape = re.sub(r"9+", "9", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", core)))[:16]
    groups = re.findall(r"[0-9]+", core)
    found = [
        f"digits:{min(n, 20)}",
        f"letters:{min(letters.bit_length(), 6)}",
        f"words:{min(words, MOST + 1)}",
        f"shape:{shape}",
        f"groups:{','.join(str(min(len(g), 9)) for g in groups[:6])}",
        f"before:{re.sub('[^a-z]', '', before.lower())[:12]}",
        f"before2:{re.sub('[^a-z]', '', before2.lower())[:12]}|{before[-1:] if before[-1:] in '=:' else ''}",
        f"at:{core.count('@')}",
        f"spelled:{'(at)' in core.lower() or '[at]' in core.lower()}",
        f"only:{''.join(sorted({c for c in core if not c.isalnum()}))[:8]}",
    ]
    if 12 <= n <= 19 and not letters:
        found.append(f"luhn:{luhn(digits)}")
    if len(groups) == 4 and core.count(".") == 3 and not letters:
        found.append(f"octets:{all(len(g) < 4 and int(g) <= 255 for g in groups)}")
    if len(core) >= 16 and words == 1:
        hexes = sum(c in "0123456789abcdefABCDEF" for c in core)
        found.append(f"hex:{hexes == len(core)}:{min(len(core) // 8, 6)}")
        found.append(f"mixed:{bool(n) and letters > 3 and core.isascii()}:{min(len(core) // 8, 6)}")
    return found


class Field:
    """Weights by feature and kind (outside is the last kind), and between the kinds of neighbouring segments."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, names: list[str]) -> np.ndarray:
        rows = [self.index[x] for x in names if x in self.index]
        return self.weights[rows].sum(axis=0) if rows else np.zeros(OUT + 1)


def near(text: str, start: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, trigger) of the words from ``start`` on, until no segment can hold a word of these and a later trigger."""
    quiet = 0
    for w in WORDS.finditer(text, start):
        trigger = is_trigger(w.group())
        yield *w.span(), trigger
        quiet = 0 if trigger else quiet + 1
        if quiet >= APART:
            return


#: Starts, and start by end, of the spelled-out addresses of more than MOST words. No two overlap.
Chains = tuple[set[int], dict[int, int]]


def long_chains(text: str) -> Chains:
    found = (m for m in CHAIN.finditer(text) if AT.search(m.group())) if AT.search(text) else ()
    ends = {m.end(): m.start() for m in found if len(WORDS.findall(m.group())) > MOST}
    return set(ends.values()), ends


def lattice(text: str, words: Iterable[tuple[int, int, bool]], chains: Chains, opened: dict[int, tuple[int, str, str]]) -> Iterator[tuple[int, int, tuple[int, int], list[str], bool]]:
    """(first word, one past the last, bare span, features, may be of a kind) of every segment, by end, then first word.

    Holds a window of words, and in ``opened`` the first word of a long chain that goes on.
    """
    window: list[tuple[int, int, bool, bool]] = []
    begins, ends = chains
    for j, (a, b, trigger) in enumerate(words, 1):
        window.append((a, b, trigger, text[a:b].lower() in SPELLED))
        window = window[-MOST - 2 :]
        first = j - len(window)
        word = lambda i: text[slice(*window[i - first][:2])] if i >= first else ""  # noqa: B023, E731
        if a in begins:
            opened[a] = (j - 1, word(j - 2), word(j - 3))
        if (begin := ends.get(b)) in opened:
            i, before, before2 = opened[begin]
            span = bare(text, begin, b)
            yield i, j, span, segment_features(text[slice(*span)], j - i, before, before2), span[0] < span[1]
            del opened[begin]
        signs = [k for k, w in enumerate(window, first) if w[3]]
        for i in range(max(0, j - MOST), j):
            ok = trigger and window[i - first][2] or bool(signs) and signs[-1] >= i
            if ok or j == i + 1:
                span = bare(text, window[i - first][0], b)
                yield i, j, span, segment_features(text[slice(*span)], j - i, word(i - 1), word(i - 2)), ok and span[0] < span[1]


def decode(text: str, words: Iterable[tuple[int, int, bool]], chains: Chains, field: Field) -> list[tuple[str, int, int]]:
    """The best segmentation's spans of a kind.

    A path is a linked list of its spans and only paths that may still win are held, so any number of words is decoded
    without a cut.
    """
    opened: dict[int, tuple[int, str, str]] = {}
    # Scores and paths by place between words, for the places where a segment may still begin.
    best = {0: np.full(OUT + 1, -np.inf)}
    best[0][OUT] = 0
    paths: dict[int, list] = {0: [None] * (OUT + 1)}
    last = 0
    for i, j, span, names, ok in lattice(text, words, chains, opened):
        if j > last:
            best[j], paths[j], last = np.full(OUT + 1, -np.inf), [None] * (OUT + 1), j
            if j > MOST and all(j - MOST - 1 != k for k, _, _ in opened.values()):
                del best[j - MOST - 1], paths[j - MOST - 1]
        reach = best[i][:, None] + field.moves
        came, top = reach.argmax(axis=0), reach.max(axis=0) + field.scores(names)
        for y in range(OUT + 1):
            if (ok if y < OUT else j == i + 1) and top[y] > best[j][y]:
                best[j][y] = top[y]
                path = paths[i][came[y]]
                paths[j][y] = (path, (KINDS[y], *span)) if y < OUT else path
    found = []
    path = paths[last][int(best[last].argmax())]
    while path:
        path, span = path
        found.append(span)
    return found[::-1]


def region_start(text: str, at: int) -> int:
    """Where the word at ``at`` and BACK words before it begin."""
    blank = " \t\n\x0b\x0c\r"
    for k in range(BACK + 1):
        while at > 0 and text[at - 1] not in blank:
            at -= 1
        back = at
        while back > 0 and text[back - 1] in blank:
            back -= 1
        if not back or k == BACK:
            break
        at = back
    return at


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    done, chains = 0, None
    while m := TRIGGER.search(text, done):
        if chains is None:
            chains = long_chains(text)
        # A region may reach back over quiet words of the one before: none of a segment can hold words of both.
        start = region_start(text, m.start())

        def words() -> Iterator[tuple[int, int, bool]]:
            nonlocal done
            for w in near(text, start):  # noqa: B023
                done = w[1]
                yield w

        found += decode(text, words(), chains, field)
    return [s for s in found if not any(s[1] < y and x < s[2] for _, x, y in base)]


CARRIERS = "the of and le la der die el que with from para sur nicht reion anthe ster ention call see at version no number on page year item total".split()


def training_sentences(count: int = 500, seed: int = 11) -> list[list[tuple[str, int]]]:
    """Sentences of (segment, kind): carrier words, entities of each kind in many forms, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice([13, 14, 14, 14]))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area = digits(3)
        form = rng.randint(0, 4)
        tail = rng.choice(["-", " ", "."]).join([digits(3), digits(4)])
        return [f"+{rng.randint(1, 99)} ({area}) {tail}", f"({area}) {tail}", f"+{rng.randint(1, 99)} {area} {tail}", f"{area}-{digits(3)}-{digits(4)}", f"+{digits(11)}"][form]

    def email() -> str:
        host = f"{name()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
        user = rng.choice([name(), f"{name()}.{name()}", f"{name()}{digits(2)}", f"{name()}.{digits(2)}"])
        plain, _, last = host.rpartition(".")
        spelled = f"{user.replace('.', ' [dot] ')} [at] {host.replace('.', ' [dot] ')}"
        return rng.choice([f"{user}@{host}", f"{user}@{host}", f"{user} [at] {plain} [dot] {last}", f"{user} (at) {host}", spelled])

    def secret() -> str:
        return rng.choice(["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), "sk-" + "".join(rng.choice("abcdefABCDEF0123456789xyzXYZ") for _ in range(32))])

    def number() -> str:
        wrong = digits(15)
        wrong += next(c for c in "0123456789" if not luhn(wrong + c))
        return rng.choice([digits(rng.randint(1, 8)), f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"19{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", wrong, digits(11), f"{digits(3)}%", f"${digits(2)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{name()}{digits(1)}", f"{rng.randint(256, 999)}.{digits(2)}.{digits(2)}.{digits(2)}", f"@{name()}", f"({digits(4)})"])

    ip = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    forms = [email, ip, card, phone, secret]
    cues = [["mail", "write to", "contact"], ["host", "from", "server"], ["card", "pay", "no"], ["call", "phone:", "tel"], ["token =", "key =", "password:", "secret ="]]
    out = []
    for _ in range(count):
        sentence: list[tuple[str, int]] = []
        for _ in range(rng.randint(2, 4)):
            sentence += [(w, OUT) for w in rng.sample(CARRIERS, rng.randint(2, 4))]
            if rng.random() < 0.6:
                y = rng.randrange(len(forms))
                if rng.random() < 0.5 or y == 4:
                    sentence += [(w, OUT) for w in rng.choice(cues[y]).split()]
                value = forms[y]()
                sentence.append((f'"{value}"' if y == 4 and rng.random() < 0.6 else value + rng.choice(["", "", ".", ","]), y))
            else:
                sentence.append((number(), OUT))
        out.append(sentence)
    return out


@lru_cache(maxsize=1)
def trained(epochs: int = 5, seed: int = 11) -> Field:
    """Adaptive gradient ascent on the likelihood of the sentences' segmentations."""
    index: dict[str, int] = {}
    data = []
    for sentence in training_sentences(seed=seed):
        text, gold, at = "", {}, 0
        for piece, y in sentence:
            text += (" " if text else "") + piece
            k = len(piece.split())
            if y == OUT:
                for i in range(k):
                    gold[at + i, at + i + 1] = OUT
            else:
                gold[at, at + k] = y
            at += k
        words = [(*m.span(), is_trigger(m.group())) for m in WORDS.finditer(text)]
        edges = []
        for i, j, _, names, ok in lattice(text, words, long_chains(text), {}):
            rows = [index.setdefault(x, len(index)) for x in names]
            edges.append((i, j, np.array(rows, np.int64), ok))
        if set(gold) <= {(i, j) for i, j, _, _ in edges}:
            data.append((len(words), edges, gold))
    weights, moves = np.zeros((len(index), OUT + 1)), np.zeros((OUT + 1, OUT + 1))
    seen, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-1)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, edges, gold in data:
            allowed = [np.array([j == i + 1 if y == OUT else ok for y in range(OUT + 1)]) for i, j, _, ok in edges]
            score = [np.where(a, weights[r].sum(axis=0), -np.inf) for (_, _, r, _), a in zip(edges, allowed, strict=True)]
            alpha = np.full((n + 1, OUT + 1), -np.inf)
            alpha[0, OUT] = 0
            beta = np.full((n + 1, OUT + 1), -np.inf)
            beta[n] = 0
            for (i, j, _, _), s in zip(edges, score, strict=True):
                alpha[j] = np.logaddexp(alpha[j], np.logaddexp.reduce(alpha[i][:, None] + moves, axis=0) + s)
            for (i, j, _, _), s in zip(reversed(edges), reversed(score), strict=True):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(moves + (s + beta[j])[None, :], axis=1))
            total = np.logaddexp.reduce(alpha[n])
            grad_m = -1e-3 * moves
            grads = []
            ends = {j: y for (i, j), y in gold.items()} | {0: OUT}
            for (i, j, rows, _), s in zip(edges, score, strict=True):
                pair = np.exp(alpha[i][:, None] + moves + (s + beta[j])[None, :] - total)
                y = gold.get((i, j))
                step = -pair.sum(axis=0)
                grad_m -= pair
                if y is not None:
                    step[y] += 1
                    grad_m[ends[i], y] += 1
                if len(rows):
                    grads.append((rows, step))
            for rows, step in grads:
                g = step[None, :] - 1e-4 * weights[rows]
                seen[rows] += g**2
                weights[rows] += 0.3 * g / np.sqrt(seen[rows])
            seen_m += grad_m**2
            moves += 0.1 * grad_m / np.sqrt(seen_m)
    return Field(index, weights, moves)


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, stop) in code points of the whole text. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())  # size fixed by the training sentences

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        keys = ("kind", "start", "stop")
        for batch in slices(batches, "text"):
            base, added = [], []
            for text in batch.column(1).to_pylist():
                one = base_spans(text) if text else []
                base.append([dict(zip(keys, s, strict=True)) for s in one])
                added.append([dict(zip(keys, s, strict=True)) for s in added_spans(text, one, shared.value)] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(added, spans)], ["doc_id", "base", "added"])

    kind = "array<struct<kind:string,start:long,stop:long>>"
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, f"doc_id long, base {kind}, added {kind}")


def digests(found: DataFrame) -> DataFrame:
    """The query's columns: counts and digest of the base spans, and all spans as text, by built-in functions."""
    rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))

    def line(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("r"), s["stop"].alias("b"), s["kind"].alias("k")))
        return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    total = (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, total, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))
