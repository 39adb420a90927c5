"""Importance resampling of documents towards a target distribution, with word tries local to a partition.

Features are all runs of 1 to ``longest`` consecutive words; a feature's bucket is the CRC of its bytes modulo
``buckets``. A partition lays the words of about ``BLOCK`` words of its documents out as a trie, level by level: a node
is a parent and a word, and has a count and a CRC state, which goes on from its parent's by the word's bytes, so no run
is ever joined or hashed as a whole. Counts are added to bucket totals and the next block starts anew, so memory is
bounded and the totals are exact; only ``buckets`` totals a task are shuffled. Merged totals give every bucket a gain,
the log ratio of the smoothed target and corpus shares. A second pass attaches the gains to the nodes and adds them up
along each document's paths. The draw is Gumbel top-k by a hash of doc_id, and ranks come from range partitions, never
from one task.

Defined cases: null, empty and wordless texts have no features and weight 0; rows without doc_id have no score and are
never drawn or counted; repeated rows are documents of their own with equal scores and neighbouring ranks; ties go to
the smaller doc_id; an empty target gives the target its smoothing alone; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .common import mapped, slices, word_blocks

#: Words of a trie; a document of more is walked in parts.
BLOCK = 200_000
#: Bytes to words: A-Z lower-cased; digits, a-z and all bytes beyond ASCII stay, and the rest separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@cache
def zero_bytes(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of a CRC register, by each of its four bytes."""
    if power:
        half = zero_bytes(power - 1)
        return after(half, half)
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    return np.stack([one, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])


def after(tables: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The states that such tables make of ``states``."""
    return tables[0][states & 255] ^ tables[1][states >> 8 & 255] ^ tables[2][states >> 16 & 255] ^ tables[3][states >> 24]


def gone_on(states: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after further words, given these words' own CRCs and lengths: a CRC is linear in what came before."""
    states = states.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        here = np.flatnonzero(lengths >> power & 1)
        states[here] = after(zero_bytes(power), states[here])
    return states ^ words


@dataclass
class Level:
    """The nodes of one depth, their parents a depth above, and the node of the run at each place (-1: no run there)."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray
    state: np.ndarray
    path: np.ndarray


def trie(words: list[bytes], left: np.ndarray, longest: int) -> list[Level]:
    """The runs of ``words``, a level for each length; ``left`` tells how many words a run at each place may have."""
    places: dict[bytes, int] = defaultdict()
    places.default_factory = places.__len__
    ids = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    v = len(places)
    own = np.fromiter(map(zlib.crc32, places), np.uint32, v)
    lengths = np.fromiter(map(len, places), np.int64, v) + 1
    spaced = gone_on(np.full(v, zlib.crc32(b" "), np.uint32), own, lengths - 1)
    here = left >= 1
    levels = [Level(np.zeros(v, np.int64), np.arange(v), np.bincount(ids[here], minlength=v), own, np.where(here, ids, -1))]
    for k in range(2, longest + 1):
        up, at = levels[-1], np.flatnonzero(left >= k)
        nodes, place, count = np.unique(up.path[at] * v + ids[at + k - 1], return_inverse=True, return_counts=True)
        parent, word = nodes // max(1, v), nodes % max(1, v)
        path = np.full(len(words), -1)
        path[at] = place
        levels.append(Level(parent, word, count, gone_on(up.state[parent], spaced[word], lengths[word]), path))
    return levels


def spans(data: bytes | None, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in blocks, and at how many of a block's words runs start: those that would go on in the next
    block start there."""
    held: list[bytes] = []
    for words in word_blocks((data or b"").translate(LETTERS)):
        held += words
        starts = len(held) - longest + 1
        if starts > 0:
            yield held, starts
            held = held[starts:]
    if held:
        yield held, len(held)


def blocks(texts: pa.Array, longest: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """The words of several texts, how many a run at each may have, and the text of each: about ``BLOCK`` words."""
    words: list[bytes] = []
    left, owner = [], []

    def whole() -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return words, np.concatenate(left), np.concatenate(owner)

    for i, text in enumerate(texts.cast(pa.binary())):
        for some, starts in spans(text.as_py(), longest):
            words += some
            left.append(np.where(np.arange(len(some)) < starts, np.arange(len(some), 0, -1), 0))
            owner.append(np.full(len(some), i))
            if len(words) >= BLOCK:
                yield whole()
                words, left, owner = [], [], []
    if words:
        yield whole()


def bucket_totals(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): the features of all ``texts`` by bucket; a bucket without features has no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for words, left, _ in blocks(batch.column(0), longest):
                for level in trie(words, left, longest):
                    np.add.at(totals, level.state % buckets, level.count)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], ["bucket", "n"])

    found = mapped(texts.select(F.col("text").cast("string")), run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2) -> list[int]:
    """The gain of every bucket: floor(1000 ln(target share / corpus share)), one added to each count."""
    sides = [bucket_totals(texts, buckets, longest).withColumn("of", F.lit(i)) for i, texts in enumerate((docs, target))]
    totals = np.zeros((2, buckets), np.int64)
    for r in sides[0].unionByName(sides[1]).collect():  # at most one row a bucket and side
        totals[r["of"], r["bucket"]] = r["n"]
    ours, theirs = (int(x) for x in totals.sum(axis=1))
    return [math.floor(1000 * math.log((t + 1) * (ours + buckets) / ((s + 1) * (theirs + buckets)))) for s, t in totals.T.tolist()]


def weigh(docs: DataFrame, by_bucket: list[int], longest: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a document's features. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)  # a number for each bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.array(shared.value, np.int64)
        for batch in slices(batches, "text"):
            n, features, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words, left, owner in blocks(batch.column(1), longest):
                for k, level in enumerate(trie(words, left, longest)):
                    at = np.flatnonzero(level.path >= 0)
                    np.add.at(sums, owner[at], own[level.state % len(own)][level.path[at]])
                    held = np.bincount(owner[at], minlength=len(n))
                    features += held
                    n += 0 if k else held
            # Of whole numbers, // goes down.
            columns = [pa.array(c, pa.int64()) for c in (n, features, sums // np.maximum(1, features))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    schema = "doc_id long, n_words long, n_features long, weight long"
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def gumbel(seed: int) -> Column:
    """floor(1000 g) for a standard Gumbel number g that ``seed`` and doc_id draw."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, draw: Column) -> DataFrame:
    """``scored`` with rank: 1, 2, ... by falling score, then doc_id, for the first ``draw(N)`` of the N eligible rows.

    Rows are dealt and sorted by ranges; a row's rank is its place in its range and the rows of the ranges before it.
    """
    order = [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc()]
    dealt = scored.withColumn("_in", eligible).repartitionByRange(*order).sortWithinPartitions(*order)
    # Of this number, the upper bits are the partition and the lower 33 the place in it.
    dealt = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "draw")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.count_if("_in").alias("_k"))
    # One row a range, so this window and the broadcast are as small as the number of shuffle partitions.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_all"))
    joined = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    rank = place + F.col("_before")
    return joined.withColumn("rank", F.when(F.col("_in") & (rank <= draw), rank)).select(*scored.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, min_words: int = 20, buckets: int = 10_000, longest: int = 2
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; ``percent`` of those with at least
    ``min_words`` words are drawn, and the rank of the others is null."""
    found = weigh(docs, gains(docs, target, buckets, longest), longest)
    scored = found.withColumn("score", F.col("weight") + gumbel(seed))
    eligible = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    return ranked(scored, eligible, F.floor(F.col("_all") * percent / 100))
