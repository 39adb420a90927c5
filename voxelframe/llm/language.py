"""Language ID: a linear-chain conditional random field labels the words of a text.

Affix, character n-gram and lexicon features score each word; learned transitions tie neighbours, so a text that
switches language is cut where it switches. Forward-backward gives each word's language posteriors; a document's
language is the one with the largest mean posterior. The model is fitted on a bounded sample of labelled lines
(``train_docs`` documents of a language, ``train_lines`` lines of at most ``train_chars`` code points), some of them
joined halfway to a line of another language, so that transitions between languages are learned too. Scoring is one
narrow pass over whole texts; runs of characters longer than ``LONG``, as in scripts without blanks, are read piece by
piece, each piece a word.

Defined cases: a null text, or one without letters, is ``und`` with score 0; words without letters carry no
label; a null doc_id stays null and is not used for training; with no labelled row every text is ``und``; lines of
under 20 code points are learned from only where a language has too few others; ties go to the language that sorts
first; repeated rows get equal results; other columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .common import mapped, slices

UND = "und"
MARKS = ".,;:!?%&$#*|\"'()[]<>-"
FOLDS = 5
BITS = 16


def held_out() -> F.Column:
    """Documents of fold 0 are never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


#: Code points of the longest word; longer runs are read in pieces.
LONG = 22
WIDTH = LONG + 2
#: Row of the weights that stays zero: features a short word lacks.
NONE = 1 << BITS
#: Words whose scores a task keeps, and the words of the lines that are joined to a line of another language.
KEPT, JOINED = 60_000, 0.3


def word_features(words: list[str]) -> np.ndarray:
    """Hashed affixes (1-4) and padded n-grams (2-3) of lower-cased words of up to LONG code points, a row each."""
    padded = np.array([f"<{w}>" for w in words], dtype=f"U{WIDTH}")
    codes = padded.view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])

    def mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, kind * 0x9E3779B1 + 1, np.uint64)
        for part in parts:
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & np.uint64((1 << BITS) - 1)).astype(np.int64)

    at = np.arange(WIDTH)
    two = np.where(at[:-1] < sizes[:, None] - 1, mixed(2, codes[:, :-1], codes[:, 1:]), NONE)
    three = np.where(at[:-2] < sizes[:, None] - 2, mixed(3, codes[:, :-2], codes[:, 1:-1], codes[:, 2:]), NONE)
    rows = np.arange(len(words))
    out = [two, three]
    for k in range(1, 5):
        heads = [codes[:, 1 + i] for i in range(k)]
        tails = [codes[rows, np.maximum(0, sizes - 2 - i)] for i in range(k)]
        fits = sizes - 2 >= k
        out += [np.where(fits, mixed(10 + k, *heads), NONE)[:, None], np.where(fits, mixed(20 + k, *tails), NONE)[:, None]]
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    """Emission weights by hashed feature and language, lexicon weights by frequent word, log transitions."""

    langs: list[str]
    weights: np.ndarray
    lexicon: dict[str, np.ndarray]
    transitions: np.ndarray
    start: np.ndarray
    key: str = ""

    def emissions(self, words: list[str]) -> np.ndarray:
        """Positive scores of words by language."""
        score = np.empty((len(words), len(self.langs)), np.float32)
        for at in range(0, len(words), 4096):
            score[at : at + 4096] = self.weights[word_features(words[at : at + 4096])].sum(axis=1)
        for i, w in enumerate(words):
            if w in self.lexicon:
                score[i] += self.lexicon[w]
        return np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -20))


def letters(text: str) -> list[str]:
    """Lower-cased words that hold a letter; longer runs in pieces of LONG code points, all of them."""
    # Marks around a word say nothing of its language; without them far fewer words differ.
    bare = [w.strip(MARKS) for w in text.lower().split()]
    if any(len(w) > LONG for w in bare):
        bare = [w[i : i + LONG] for w in bare for i in range(0, len(w), LONG)]
    return [w for w in bare if w.isalpha() or any(map(str.isalpha, w))]


def packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length; start of each step in packed rows; rows live at each step."""
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    live = np.searchsorted(-falling, -np.arange(int(falling[0]) if len(falling) else 0), side="left")
    return order, np.concatenate(([0], np.cumsum(live)[:-1])) if len(live) else live, live


def forward_backward(emissions: np.ndarray, trans: np.ndarray, start: np.ndarray, offsets: np.ndarray, live: np.ndarray):
    """Scaled messages over packed rows (step-major): alpha, beta and each row's scale; ``emissions`` are positive."""
    alpha, beta, scale = np.empty_like(emissions), np.ones_like(emissions), np.empty(len(emissions), emissions.dtype)
    for t, n in enumerate(live):
        at = slice(offsets[t], offsets[t] + n)
        a = start * emissions[at] if t == 0 else (alpha[offsets[t - 1] : offsets[t - 1] + n] @ trans) * emissions[at]
        total = a.sum(axis=1)
        scale[at] = total
        alpha[at] = a / total[:, None]
    for t in range(len(live) - 2, -1, -1):
        n, at = live[t + 1], slice(offsets[t + 1], offsets[t + 1] + live[t + 1])
        beta[offsets[t] : offsets[t] + n] = ((emissions[at] * beta[at]) @ trans.T) / scale[at][:, None]
    return alpha, beta, scale


def fit(lines: list[tuple[str, str]], epochs: int = 3, seed: int = 7, lexicon_size: int = 2000) -> Model:
    """Adaptive gradient ascent on the likelihood of labelled lines; a share of them switch language halfway."""
    langs = sorted({lang for _, lang in lines})
    place = {lang: i for i, lang in enumerate(langs)}
    k = len(langs)
    rng = np.random.default_rng(seed)
    whole = [(letters(text), place[lang]) for text, lang in lines]
    whole = [x for x in whole if x[0]]
    counts: dict[str, int] = {}
    for words, _ in whole:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    # Words and their labels; a joined sequence is the first half of one line and the second half of another.
    sequences = [(words, [y] * len(words)) for words, y in whole]
    for i, (words, y) in enumerate(whole):
        other, z = whole[rng.integers(len(whole))]
        if y != z and rng.random() < JOINED:
            first, second = words[: (len(words) + 1) // 2], other[len(other) // 2 :]
            sequences[i] = first + second, [y] * len(first) + [z] * len(second)
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:lexicon_size]
    size = NONE + 1
    ids = {w: size + i for i, w in enumerate(frequent)}
    vocabulary = list(counts)
    table = word_features(vocabulary) if vocabulary else np.empty((0, 1), np.int64)
    cache = {w: np.append(row[row != NONE], [ids[w]] if w in ids else []).astype(np.int64) for w, row in zip(vocabulary, table, strict=True)}
    theta = np.zeros((size + len(frequent), k))
    trans, grad2, grad2_t = np.zeros((k, k)), np.full_like(theta, 1e-2), np.full((k, k), 1.0)
    np.fill_diagonal(trans, 1.0)
    start = np.full(k, 1 / max(k, 1))
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), 64):
            chosen = [sequences[i] for i in order[at : at + 64]]
            lengths = np.array([len(w) for w, _ in chosen])
            by, offsets, live = packed(lengths)
            rows = [(chosen[by[j]][0][t], chosen[by[j]][1][t]) for t, n in enumerate(live) for j in range(n)]
            feats = [cache[w] for w, _ in rows]
            flat, bounds = np.concatenate(feats), np.concatenate(([0], np.cumsum([len(f) for f in feats])[:-1]))
            scores = np.add.reduceat(theta[flat], bounds, axis=0)
            em = np.exp(scores - scores.max(axis=1, keepdims=True))
            moves = np.exp(trans)
            alpha, beta, scale = forward_backward(em, moves, start, offsets, live)
            post = alpha * beta
            post /= post.sum(axis=1, keepdims=True)
            gold = np.zeros_like(post)
            gold[np.arange(len(rows)), [y for _, y in rows]] = 1
            step = (gold - post) / len(chosen)
            touched, place_of = np.unique(flat, return_inverse=True)
            spread = np.repeat(step, [len(f) for f in feats], axis=0)
            grad = np.stack([np.bincount(place_of, spread[:, j], len(touched)) for j in range(k)], axis=1) - 1e-4 * theta[touched]
            grad2[touched] += grad**2
            theta[touched] += 0.3 * grad / np.sqrt(grad2[touched])
            move = np.zeros((k, k))
            for t in range(1, len(live)):
                now, old = slice(offsets[t], offsets[t] + live[t]), slice(offsets[t - 1], offsets[t - 1] + live[t])
                pair = alpha[old][:, :, None] * moves[None] * (em[now] * beta[now] / scale[now][:, None])[:, None, :]
                move += np.einsum("ni,nj->ij", gold[old], gold[now]) - pair.sum(axis=0)
            move = move / len(chosen) - 1e-2 * trans
            grad2_t += move**2
            trans += 0.1 * move / np.sqrt(grad2_t)
    lexicon = {w: theta[i].astype(np.float32) for w, i in ids.items()}
    return Model(langs, theta[:size].astype(np.float32), lexicon, np.exp(trans).astype(np.float32), start.astype(np.float32))


def least_by(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The ``most`` rows of each lang that come first in ``order``, whose first column is a 64-bit hash.

    A language's rows are first cut at a hash under which about three times as many lie, so no task sorts a language.
    """
    share = F.least(F.lit(1.0), 3.0 * most / F.col("_held"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_held"))
    # A row a language: small enough for every task.
    near = rows.join(F.broadcast(counts), "lang").where(F.col(order[0]) < share * 2.0**64 - 2.0**63)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("_held")


def train(docs: DataFrame, train_docs: int = 400, train_lines: int = 600, train_chars: int = 2000) -> Model:
    """Fit on at most ``train_lines`` lines of at most ``train_docs`` documents of each language.

    Both are the first in hash order among documents not held out, so the driver gets a bounded sample; of a line of
    more than ``train_chars`` code points, each such stretch counts as a line.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # Repeated rows of a doc_id are one document of the sample.
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("order")).distinct()
    ids = least_by(ids, train_docs, ["order", "doc_id"]).select("doc_id", "lang")
    # At most train_docs rows a language: small enough for every task.
    chosen = usable.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    lines = chosen.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(train_chars))
    lines = lines.select("doc_id", "lang", "line", "text", F.posexplode(cuts).alias("part", "at"))
    lines = lines.select("doc_id", "lang", "line", "part", F.substr("text", "at", F.lit(train_chars)).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    lines = materialise(lines.withColumn("order", F.xxhash64("doc_id", "line", "part")), "language-lines")
    kept = ["order", "doc_id", "line", "part", "text"]
    long = least_by(lines.where(F.length("text") >= 20), train_lines, kept)
    short = least_by(lines.where(F.length("text") < 20), train_lines, kept).withColumn("rank", F.col("rank") + train_lines)
    found = long.select("lang", "rank", "text").unionByName(short.select("lang", "rank", "text")).collect()
    by: dict[str, list[tuple[int, str]]] = {}
    for r in found:
        by.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    model = fit([(text, lang) for lang in sorted(by) for _, text in sorted(by[lang])[:train_lines]])
    model.key = f"{zlib.crc32(model.weights.tobytes())}-{model.langs}"
    return model


_CACHE: dict = {"key": None, "ids": {}, "rows": None, "used": 0}


def forget() -> None:
    _CACHE.update(key=None, ids={}, rows=None, used=0)


def _word_ids(words: list[str], model: Model) -> np.ndarray:
    """Rows of the emission table, which a task keeps and starts anew beyond ``KEPT`` words."""
    cache = _CACHE
    if cache["key"] != model.key or cache["used"] > KEPT:
        cache |= {"key": model.key, "ids": {}, "rows": np.empty((1 << 15, len(model.langs)), np.float32), "used": 0}
    ids = cache["ids"]
    new = list(set(words) - ids.keys())
    if new:
        used = cache["used"]
        while used + len(new) > len(cache["rows"]):
            cache["rows"] = np.concatenate([cache["rows"], np.empty_like(cache["rows"])])
        cache["rows"][used : used + len(new)] = model.emissions(new)
        ids.update(zip(new, range(used, used + len(new)), strict=True))
        cache["used"] = used + len(new)
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def word_posteriors(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of posteriors of each text's words, and the number of its words; also of sure words by language."""
    k = len(model.langs)
    words = [letters(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    sums, sure = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    if not k or not lengths.sum():
        return sums, np.zeros_like(lengths) if not k else lengths, sure
    order, offsets, live = packed(lengths)
    flat = _word_ids([w for i in order for w in words[i]], model)
    falling = lengths[order]
    text_of = np.repeat(np.arange(len(order)), falling)
    step_of = np.arange(len(flat)) - np.repeat(np.cumsum(falling) - falling, falling)
    rows = offsets[step_of] + text_of
    emissions = np.empty((len(flat), k), np.float32)
    emissions[rows] = _CACHE["rows"][flat]
    alpha, beta, _ = forward_backward(emissions, model.transitions, model.start, offsets, live)
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    post = post[rows]
    for j in range(k):
        sums[order, j] = np.bincount(text_of, post[:, j], len(order))
    best = post.argmax(axis=1)
    np.add.at(sure, (order[text_of], best), 1)
    return sums, lengths, sure


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, n_words labelled, and the words given to each language (a map)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS, lexicon_size and the languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.map_(pa.string(), pa.int64())
        for batch in slices(batches, "text", 2_000_000):
            sums, lengths, sure = word_posteriors([t or "" for t in batch.column(1).to_pylist()], m)
            pred, score = [], []
            for i, n in enumerate(lengths):
                if n == 0:
                    pred.append(UND)
                    score.append(0.0)
                else:
                    j = int(sums[i].argmax())
                    pred.append(m.langs[j])
                    score.append(min(1.0, float(sums[i, j] / n)))
            by = [[(lang, int(c)) for lang, c in zip(m.langs, row, strict=True) if c] for row in sure]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred), pa.array(score), pa.array(lengths, pa.int64()), pa.array(by, kind)],
                ["doc_id", "lang_pred", "score", "n_labelled", "words_by_lang"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, "doc_id long, lang_pred string, score double, n_labelled long, words_by_lang map<string,bigint>", forget)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least this score, all columns: a narrow pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", 2_000_000):
            sums, lengths, _ = word_posteriors([t or "" for t in batch.column(place).to_pylist()], m)
            best = sums.max(axis=1) if sums.shape[1] else np.zeros(len(lengths))
            yield batch.filter(pa.array((lengths > 0) & (best >= least * lengths)))

    return mapped(docs, run, docs.schema, forget)
