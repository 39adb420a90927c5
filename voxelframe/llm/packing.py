"""Best-fit packing by bin completion.

Documents become token ids (a final end id each) and are cut only where longer than a sequence. Pieces are dealt by
hash into groups of bounded size; each group is packed by branch and bound: every sequence is built around the largest
piece left, over the undominated fillings of its room, fullest first, pruned by the waste bound. The best-fit
packing is the incumbent, and a lower bound (volume, and large pieces kept apart) ends the search with a proof that
nothing is left to gain. Sequences a group leaves open are taken apart and their pieces packed again, together. Only
lengths are shuffled, never tokens.

The search looks at ``nodes`` fillings beyond one a sequence and then keeps its incumbent; with ``nodes=None`` it goes
on until the packing of the group is proved to be the smallest.

Defined cases: a null or empty text is the end id alone; texts of any length are whole; equal lengths are placed in
input order of a group sorted by (doc_id, piece); repeated rows are separate documents; an empty table gives no
piece; a null doc_id is kept, and rows without one are dealt like others; further columns of ``pieces`` pass through
``pack``, but for columns named sequence_id or offset, whose place its own take.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .common import mapped, slices, unused, without

CAPACITY, END_ID = 4096, 1
#: Pieces packed together, and fillings that the search of a group looks at beyond one a sequence.
GROUP, NODES = 8192, 4000
#: A sequence with more room than this share of the capacity is open after the first level.
OPEN = 0.02


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A run of letters that the normaliser of this tokenizer leaves as they are, so that it is one word, and the same with
#: marks after it that this vocabulary splits off.
LETTERS = "[a-zß-öø-ÿ]+"
MARKED = f"^(?P<core>{LETTERS})(?P<tail>[.,;:!?%$&#*|]*)$"
#: Words whose ids a Python worker keeps, with the tokenizer, from task to task.
KEPT = 200_000


def _binaries(ids: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Little-endian 32-bit ids, cut at ``stops``."""
    offsets = np.concatenate(([0], 4 * stops)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


class _Encoder:
    """A tokenizer, and the words that it has encoded with their ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # Letters alone need no normaliser, and splitting only at blanks.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def encode(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. Unknown ones are encoded and kept; where that would be too many, only these words are."""
        at = pc.index_in(words, value_set=self.words)
        unknown = words.filter(at.is_null())
        plain = pc.match_substring_regex(unknown, f"^{LETTERS}$").to_numpy(zero_copy_only=False)
        # Neighbours in a sorted list share most of their merges.
        order = pc.sort_indices(unknown).to_numpy()
        letters, others = order[plain[order]], order[~plain[order]]
        known = pa.concat_arrays([self.words, unknown.take(pa.array(letters)), unknown.take(pa.array(others))])
        start = len(self.words)
        ids = pa.concat_arrays([self.ids, *self._letters(known[start : start + len(letters)]), *self._others(known[start + len(letters) :].to_pylist())])
        place = np.empty(len(unknown), np.int32)
        place[np.concatenate((letters, others))] = np.arange(start, len(known))
        found = ids.take(pc.replace_with_mask(at, at.is_null(), pa.array(place)))
        self.words, self.ids = (known, ids) if len(known) <= KEPT else (words, found)
        return found

    def _letters(self, words: pa.Array, most: int = 500) -> Iterator[pa.Array]:
        """Many at a time: each is one word, so its ids stop at the first that ends one."""
        for at in range(0, len(words), most):
            part = words.slice(at, most)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), pa.scalar(" ", pa.large_string()))[0].as_py()
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("a word of letters has no end of its own in this vocabulary")
            yield _binaries(ids, stops)

    def _others(self, words: list[str], most: int = 10_000) -> Iterator[pa.Array]:
        for at in range(0, len(words), most):
            ids = [e.ids for e in self.whole.encode_batch_fast(words[at : at + most], add_special_tokens=False)]
            yield _binaries(np.array(list(chain.from_iterable(ids)), "<u4"), np.cumsum([len(i) for i in ids]))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, equal to encoding it whole.

    Blanks end every token of this vocabulary and it has no upper case, so each distinct lower-case run of other
    characters is encoded once: plain letters apart from the marks after them, any other run as it is. Runs stay in Arrow
    arrays: a Python object for each takes longer than its tokens.
    """
    given = pa.array(texts, pa.large_string())
    # ascii_lower acts on A-Z alone; texts that may spell a special token stay as they are.
    lowered = pc.if_else(pc.match_substring(given, "<|"), given, pc.ascii_lower(given))
    runs = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
    dealt = runs.values.dictionary_encode()
    core, tail = pc.extract_regex(dealt.dictionary, MARKED).flatten()
    parts = pa.concat_arrays([pc.coalesce(core, dealt.dictionary), pc.fill_null(tail, "")]).dictionary_encode()
    coded = _encoder(path).encode(parts.dictionary).take(parts.indices)
    half = len(dealt.dictionary)
    ids = pc.binary_join_element_wise(coded[:half], coded[half:], pa.scalar(b"", pa.large_binary())).take(dealt.indices)
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int64)[runs.offsets.to_numpy()].tolist()
    data = memoryview(data or b"")
    return [bytes(data[x:y]) for x, y in zip(at, at[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of each piece. One narrow pass."""
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            owner, number, start, length, ids = [], [], [], [], []
            coded = token_bytes([t or "" for t in batch.column(1).to_pylist()], path)
            for doc_id, data in zip(batch.column(0).to_pylist(), coded, strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    owner.append(doc_id)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins with equal room are a stack, and a bit mask over rooms finds the tightest."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for s in sizes:
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            bins[b].append(s)
        else:
            room, b = capacity, len(bins)
            bins.append([s])
        left = room - s
        if left:
            by_room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The larger of the volume bound and, for every k up to half the capacity, the bound that keeps pieces over half
    apart: those that leave less than k are alone, and pieces from k on need the room that the others leave."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    upto = np.concatenate(([0], np.cumsum(s)))
    k = np.unique(np.concatenate(([0], s[2 * s <= capacity])))
    half = np.searchsorted(s, capacity // 2, side="right")
    large = np.maximum(np.searchsorted(s, capacity - k, side="right"), half)
    room = (large - half) * capacity - (upto[large] - upto[half])
    small = upto[half] - upto[np.minimum(np.searchsorted(s, k), half)]
    apart = len(s) - half + np.maximum(0, -(-(small - room) // capacity))
    return max(-(-int(upto[-1]) // capacity), int(apart.max()))


def dominated(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether filling ``a`` can be laid into the pieces of ``b`` (first fit of falling sizes)."""
    if sum(a) > sum(b) or a == b:
        return False
    rooms = sorted(b, reverse=True)
    for s in sorted(a, reverse=True):
        place = next((i for i, r in enumerate(rooms) if r >= s), None)
        if place is None:
            return False
        rooms[place] -= s
    return True


def fillings(room: int, sizes: list[int], counts: dict[int, int], waste: int, left: list[int] | None = None) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``waste``, fullest first and among equals larger pieces first.

    ``sizes`` are the distinct sizes at hand, rising, and ``counts`` how many there are of each. Sums that smaller
    pieces reach are bit masks, so no branch ends without a filling. ``left`` holds how many may be looked at.
    """
    full = (1 << room + 1) - 1
    sums = [1]
    for s in sizes:
        # Where all sums from s on are reached, pieces of s or more reach no other.
        if s > room or sums[-1] >> s == full >> s:
            break
        reach, more, step = sums[-1], counts[s], 1
        while more:
            step = min(step, more)
            reach |= reach << step * s & full
            more -= step
            step *= 2
        sums.append(reach)

    def exact(target: int, upto: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
            return
        for i in range(min(upto, bisect_right(sizes, target)) - 1, -1, -1):
            s, below = sizes[i], sums[min(i, len(sums) - 1)]
            for m in range(min(counts[s], target // s), 0, -1):
                if below >> target - m * s & 1:
                    for rest in exact(target - m * s, i):
                        yield (s,) * m + rest

    seen: list[tuple[int, ...]] = []
    for w in range(min(waste, room) + 1):
        if not sums[-1] >> room - w & 1:
            continue
        for found in exact(room - w, len(sizes)):
            if left is not None:
                if left[0] <= 0:
                    return
                left[0] -= 1
            # A filling that still has room for a piece at hand is dominated by the one with that piece.
            smallest = next((s for s in sizes if s > w or counts[s] > found.count(s)), w + 1)
            if smallest > w and not any(dominated(found, b) for b in seen):
                seen.append(found)
                yield found


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = NODES) -> list[list[int]]:
    """Bins of sizes. The incumbent is best fit; the search ends at the bound, when nothing is left to try, or, unless
    ``nodes`` is None, when it has looked at one filling a bin and ``nodes`` more."""
    order = sorted(lengths, reverse=True)
    best = best_fit(order, capacity)
    bound, total = lower_bound(order, capacity), sum(order)
    if len(best) <= bound:
        return best
    counts: dict[int, int] = {}
    for s in order:
        counts[s] = counts.get(s, 0) + 1
    sizes = sorted(counts)
    left = None if nodes is None else [nodes + len(best)]
    # Per open bin its largest piece and fillings still to try, and the pieces in it (None while it is being filled).
    stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    bins: list[tuple[int, ...] | None] = []
    wasted = 0

    def take(items: Iterable[int]) -> None:
        for s in items:
            counts[s] -= 1
            if not counts[s]:
                del sizes[bisect_left(sizes, s)]

    def give(items: Iterable[int]) -> None:
        for s in items:
            if not counts[s]:
                insort(sizes, s)
            counts[s] += 1

    while left is None or left[0] > 0 or not sizes:
        allowed = (len(best) - 1) * capacity - total - wasted
        if not sizes:
            best = [list(b) for b in bins]
            if len(best) <= bound:
                break
        elif len(bins) < len(best) - 1 and allowed >= 0:
            largest = sizes[-1]
            take((largest,))
            stack.append((largest, fillings(capacity - largest, sizes, counts, allowed, left)))
            bins.append(None)
        while stack:
            largest, more = stack[-1]
            if bins[-1] is not None:
                give(bins[-1][1:])
                wasted -= capacity - sum(bins[-1])
                bins[-1] = None
            found = next(more, None)
            if found is not None:
                take(found)
                bins[-1] = (largest, *found)
                wasted += capacity - sum(bins[-1])
                break
            give((largest,))
            stack.pop()
            bins.pop()
        if not stack:
            break
    return best


def place(lengths: np.ndarray, capacity: int, nodes: int | None = NODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin."""
    bins = bin_completion([int(x) for x in lengths], capacity, nodes)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    of, at, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.zeros(len(bins), np.int64)
    for b, sizes in enumerate(bins):
        for s in sizes:
            i = waiting[s].pop()
            of[i], at[i] = b, fill[b]
            fill[b] += s
    return of, at, fill


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int | None = NODES) -> DataFrame:
    """``parts`` (doc_id, piece, length and any others; ids should be gone) with sequence_id and offset."""
    parts = without(parts, "sequence_id", "offset")
    # A row's own number deals equal and nameless rows apart; in the table it does not change when a task is run again.
    number, opened = unused(parts.columns, "_number"), unused(parts.columns, "_open")
    parts = materialise(parts.withColumn(number, F.monotonically_increasing_id()), "pack-pieces")
    first = materialise(_level(parts, number, opened, capacity, group, nodes, 0), "pack-first")
    again = first.where(F.col(opened)).drop(opened, "sequence_id", "offset")
    closed = first.where(~F.col(opened)).unionByName(_level(again, number, opened, capacity, group, nodes, 1))
    return closed.drop(number, opened)


def _level(parts: DataFrame, number: str, opened: str, capacity: int, group: int, nodes: int | None, level: int) -> DataFrame:
    groups = max(1, -(-parts.count() // group))
    of_group = unused(parts.columns, "_group")
    dealt = parts.withColumn(of_group, F.pmod(F.xxhash64(number, F.lit(level)), F.lit(groups)).cast("int"))
    names = parts.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", number], kind="stable", ignore_index=True)
        of, at, fill = place(frame["length"].to_numpy(), capacity, nodes)
        first = (level << 60) + (int(frame[of_group].iloc[0]) << 28)
        return frame[names].assign(sequence_id=of + first, offset=at, **{opened: (capacity - fill[of]) > OPEN * capacity})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy(of_group).applyInPandas(run, f"{kept}, sequence_id long, offset long, `{opened}` boolean")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with a checksum of their ids in place of the ids, and their places."""
    found = pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(found)
