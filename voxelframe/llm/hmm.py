"""Language-model scores by a hidden Markov model.

Words are dealt to ``BUCKETS`` buckets by CRC, and the end of a text has a code of its own. A hidden state emits a
bucket; the word within its bucket follows the smoothed counts of the training words, so the model knows every word
that the corpus has while its own tables stay small. Baum-Welch: tasks sum the expected counts of their training
sequences in a narrow pass, the sums meet by a group-by, and the driver makes the next model from states x buckets
numbers. The sequences are dealt to ``SHARDS`` shards and each step renews one shard's counts within the sum over all
(incremental expectation maximisation), so a few sweeps over the corpus make many steps. The scaled forward recursion
gives the exact likelihood of every whole text.

1. One pass cuts the documents into chunks of about ``CHUNK`` bytes: each has its own dictionary with training counts,
   and its documents are numbers of words in it.
2. A chunk's distinct words, never all tokens, are dealt out by word once; the sums go back to the rows they are of. A
   word has at most a row a chunk.
3. The counts of a chunk's words go back to the chunk (cogroup, bounded by the chunk), which gives each document its
   unigram score and its sequence of buckets.
4. Steps and scores read these sequences.

Defined cases: null and empty texts are the end alone; rows without doc_id are training documents and are scored;
repeated rows count and are scored each; without training documents every token is unknown, with probability 1; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise, scratch_path

from .common import mapped, remove, slices, word_blocks

#: Buckets of words; the end of a text is the code after them. Codes fit in 16 bits.
BUCKETS = 16_384
STATES, SHARDS, SWEEPS = 8, 8, 2
#: Bytes of text that share a dictionary.
CHUNK = 32_000_000
#: Tokens that a task sorts by length and that it holds in floating point at once.
SORTED, AT_ONCE = 3_000_000, 300_000
#: Pseudo-counts: an emission row leans on the unigram shares by this many tokens.
LEAN = 5000.0
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLDS, HELD = 7, 2


def held_out() -> Column:
    """Documents of fold 2 of 7 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


@dataclass
class Model:
    """First, transition (row: from) and emission (row: code) probabilities."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def initial(shares: np.ndarray, states: int = STATES, seed: int = 11) -> Model:
    """The unigram shares of the codes, bent at random for each state so that the states can part; states tend to stay."""
    bent = shares[:, None] * np.exp(np.random.default_rng(seed).normal(size=(len(shares), states)))
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, bent / bent.sum(axis=0))


@dataclass
class Expected:
    """Expected counts of a set of sequences, shaped as the model, and their log likelihood."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    likelihood: float = 0.0

    @staticmethod
    def none(codes: int, states: int) -> Expected:
        return Expected(np.zeros(states), np.zeros((states, states)), np.zeros((codes, states)))

    def rows(self) -> np.ndarray:
        """One row a code, then those of the transitions, the first states and the likelihood."""
        last = np.full(self.first.shape, self.likelihood / len(self.first))
        return np.vstack([self.emit, self.move, self.first, last])

    @staticmethod
    def of(rows: np.ndarray) -> Expected:
        k = rows.shape[1]
        return Expected(rows[-2], rows[-2 - k : -2], rows[: -2 - k], float(rows[-1].sum()))

    def model(self, shares: np.ndarray) -> Model:
        """The M step. Emissions lean on the unigram shares, so no code becomes impossible in a state."""
        move, emit = self.move + 1, self.emit + LEAN * shares[:, None]
        return Model((self.first + 1) / (self.first + 1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Steps:
    """Sequences laid out by step, longest first: step t has the codes of all sequences that are longer than t."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(-lengths, kind="stable")
        lengths, n = lengths[order], len(order)
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(n), lengths)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = self.start[step] + doc
        self.codes = np.empty(len(doc), np.int64)
        self.codes[place] = np.concatenate([sequences[i] for i in order])
        self.doc = np.empty(len(doc), np.int64)
        self.doc[place] = order[doc]
        self.n = n

    def forward(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward probabilities, their scales, and the emission probabilities, by step."""
        seen = m.emit[self.codes]
        alpha, scale = np.empty_like(seen), np.empty(len(seen))
        before = None
        for t, n in enumerate(self.active.tolist()):
            at = slice(self.start[t], self.start[t] + n)
            now = (m.first if before is None else before[:n] @ m.move) * seen[at]
            total = now.sum(axis=1)
            now /= total[:, None]
            alpha[at], scale[at] = now, total
            before = now
        return alpha, scale, seen

    def likelihoods(self, m: Model) -> np.ndarray:
        """The natural log of each sequence's probability."""
        return np.bincount(self.doc, np.log(self.forward(m)[1]), self.n)

    def expect(self, m: Model, into: Expected) -> None:
        """Add the expected counts, by the backward recursion in the forward scales."""
        alpha, scale, seen = self.forward(m)
        into.likelihood += float(np.log(scale).sum())
        seen /= scale[:, None]
        moved, beta = np.zeros_like(m.move), np.ones((int(self.active[-1]), len(m.first)))
        for t in range(len(self.active) - 1, -1, -1):
            n = int(self.active[t])
            at = slice(self.start[t], self.start[t] + n)
            told = seen[at] * beta
            alpha_now = alpha[at] * beta
            if t:
                was = self.start[t - 1]
                moved += alpha[was : was + n].T @ told
                beta = np.ones((int(self.active[t - 1]), len(m.first)))
                beta[:n] = told @ m.move.T
            alpha[at] = alpha_now
        into.move += moved * m.move
        into.first += alpha[: self.n].sum(axis=0)
        for k in range(len(m.first)):
            into.emit[:, k] += np.bincount(self.codes, alpha[:, k], len(into.emit))


def steps_of(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], Steps]]:
    """Sequences of like lengths together, about ``AT_ONCE`` codes at a time; one longer than that is alone."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        end, held = at, 0
        while end < len(order) and (end == at or held + len(sequences[order[end]]) <= AT_ONCE):
            held += len(sequences[order[end]])
            end += 1
        yield order[at:end], Steps([sequences[i] for i in order[at:end]])
        at = end


def planes(ids: np.ndarray) -> bytes:
    """32-bit numbers with their first bytes together, then their second bytes, and so on: small ones compress."""
    return ids.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def encode(docs: DataFrame, held: Column) -> DataFrame:
    """Chunks: rows (chunk, doc_id, held, ids) of documents and (chunk, local, word, c) of their distinct words, with the
    counts of the training documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a chunk's number, the lower 20 bits count within the task.
        name = TaskContext.get().partitionId() << 20
        names = ["chunk", "doc_id", "held", "ids", "local", "word", "c"]

        def flush(rows: list, places: dict) -> Iterator[pa.RecordBatch]:
            n = len(places)
            counts = np.zeros(n, np.int64)
            for _, out, ids in rows:
                if not out:
                    np.add.at(counts, ids, 1)
            for at in range(0, len(rows), 1000):
                i, h, ids = zip(*rows[at : at + 1000], strict=True)
                none = [pa.nulls(len(i), t) for t in (pa.int32(), pa.string(), pa.int64())]
                columns = [pa.array(np.full(len(i), name)), pa.array(i, pa.int64()), pa.array(h, pa.bool_()), pa.array(map(planes, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *none], names)
            words = iter(places)
            for at in range(0, n, 50_000):
                some = list(islice(words, 50_000))
                k = len(some)
                none = [pa.nulls(k, t) for t in (pa.int64(), pa.bool_(), pa.binary())]
                told = [pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[at : at + k])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, name)), *none, *told], names)

        def fresh() -> tuple[list, dict, int]:
            places: dict[bytes, int] = defaultdict()
            places.default_factory = places.__len__
            return [], places, 0

        rows, places, size = fresh()
        for batch in slices(batches, "text"):
            for i, text, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = (text.as_py() or b"").translate(LOWER)
                ids = [np.fromiter(map(places.__getitem__, words), np.int32, len(words)) for words in word_blocks(data)]
                rows.append((i, out, np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                size += len(data)
                if size >= CHUNK:
                    yield from flush(rows, places)
                    name += 1
                    rows, places, size = fresh()
        if rows:
            yield from flush(rows, places)

    schema = "chunk long, doc_id long, held boolean, ids binary, local int, word string, c long"
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held")), run, schema)


#: Columns of a document that its score is returned with.
COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]


@dataclass
class Corpus:
    """Documents as sequences of codes with unigram sums, and the sums of the training tokens."""

    sequences: DataFrame
    shares: np.ndarray
    tokens: int


def prepare(docs: DataFrame, held: Column | None = None) -> Corpus:
    """``sequences`` has shard, doc_id, held_out, n_tokens, n_known, base_score, inside (log10 of the words' shares within
    their buckets) and codes."""
    spark = docs.sparkSession
    path = scratch_path(spark, "lm-chunks")
    encode(docs, held_out() if held is None else held).write.parquet(path)
    chunks = spark.read.parquet(path)
    words, texts = chunks.where("word is not null"), chunks.where("word is null")
    # Dealt out once: the sums and the rows they go back to are in the same place.
    dealt = words.select("chunk", "local", "word", "c").repartition("word")
    sums = dealt.groupBy("word").agg(F.sum("c").alias("all"), F.min("chunk").alias("owner"))
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int").alias("code")
    counted = dealt.join(sums.hint("shuffle_merge"), "word").select("chunk", "local", F.col("all").alias("c"), bucket, (F.col("chunk") == F.col("owner")).alias("own"))
    counted = materialise(counted, "lm-counted")
    ends = texts.where("not held").count()
    # c of all words, and words, by bucket: at most BUCKETS rows.
    totals = np.zeros((2, BUCKETS + 1), np.int64)
    for r in counted.where("own and c > 0").groupBy("code").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        totals[:, r["code"]] = r["c"], r["v"]
    totals[:, BUCKETS] = ends, ends > 0
    tokens, distinct = (int(x) for x in totals.sum(axis=1))
    # A bucket holds its words, one added to each count, and one word that is not known; the end's holds the end alone.
    weights = totals.sum(axis=0) + 1
    weights[BUCKETS] = ends + 1
    shared = spark.sparkContext.broadcast(np.log10(weights))  # a number for each bucket
    all_log = float(np.log10(tokens + distinct + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        at = right.column("local").to_numpy()
        c, codes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        c[at], codes[at] = right.column("c").to_numpy(), right.column("code").to_numpy()
        plain, known = np.log10(c + 1.0), c > 0
        within, base, codes = plain - shared.value[codes], plain - all_log, codes.astype(np.uint16)
        ended = float(np.log10(ends + 1.0)) - all_log
        out = []
        for blob in left.column("ids").to_pylist():
            ids = from_planes(blob)
            told = np.append(codes[ids], np.uint16(BUCKETS)).tobytes()
            out.append((zlib.crc32(told) % SHARDS, len(ids) + 1, int(known[ids].sum()) + (ends > 0), float(base[ids].sum()) + ended, float(within[ids].sum()), told))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        shard, *columns = (pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))
        return pa.Table.from_arrays([shard, left.column("doc_id"), left.column("held"), *columns], names=["shard", *COLUMNS, "inside", "codes"])

    schema = "shard int, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, codes binary"
    given = counted.select(F.col("chunk").alias("of"), "local", "c", "code")
    told = texts.select("chunk", "doc_id", "held", "ids").groupBy("chunk").cogroup(given.groupBy("of")).applyInArrow(run, schema)
    told = materialise(told, "lm-sequences")
    remove(spark, path)
    return Corpus(told, weights / weights.sum(), tokens)


def gathered_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches until they have about ``SORTED`` codes, and the sequences of their last column."""
    held, sequences, size = [], [], 0
    for batch in slices(batches, "codes"):
        held.append(batch)
        for blob in batch.column(batch.num_columns - 1).to_pylist():
            sequences.append(np.frombuffer(blob, np.uint16))
            size += len(sequences[-1])
        if size >= SORTED:
            yield held, sequences
            held, sequences, size = [], [], 0
    if held:
        yield held, sequences


def iterate(sequences: DataFrame, model: Model) -> Expected:
    """The E step: the expected counts of all ``sequences`` (column ``codes``)."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)  # states x codes
    states = len(model.first)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        into = Expected.none(len(m.emit), states)
        for _, some in gathered_codes(batches):
            for _, steps in steps_of(some):
                steps.expect(m, into)
        rows = into.rows().astype(np.float32)
        at = np.flatnonzero(rows.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[at, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])

    found = mapped(sequences.select("codes"), run, "row int, " + ", ".join(f"s{k} float" for k in range(states)))
    summed = found.groupBy("row").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(states)))
    rows = np.zeros((len(model.emit) + states + 2, states))
    for r in summed.collect():  # at most one row for each code and state
        rows[r["row"]] = r[1:]
    shared.unpersist()
    return Expected.of(rows)


def train(corpus: Corpus, states: int = STATES, sweeps: int = SWEEPS) -> Model:
    """Baum-Welch over all training documents, a shard a step; the counts of all shards make the next model."""
    model, learned, counts = initial(corpus.shares, states), corpus.sequences.where("not held_out"), {}
    for step in range(sweeps * SHARDS):
        shard = step % SHARDS
        counts[shard] = iterate(learned.where(F.col("shard") == shard), model).rows()
        model = Expected.of(sum(counts.values())).model(corpus.shares)
    return model


def score(corpus: Corpus, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, the log10 probability of the text."""
    shared = corpus.sequences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, sequences in gathered_codes(batches):
            found = np.zeros(len(sequences))
            for order, steps in steps_of(sequences):
                found[order] = steps.likelihoods(shared.value)
            at = 0
            for batch in held:
                own = batch.column(5).to_numpy() + found[at : at + batch.num_rows] / np.log(10)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own)], [*COLUMNS, "score"])
                at += batch.num_rows

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    told = mapped(corpus.sequences.select(*COLUMNS, "inside", "codes"), run, schema)
    return told.withColumn("train_tokens", F.lit(corpus.tokens).cast("long")).select(*COLUMNS[:4], "train_tokens", "base_score", "score")
