"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

The state of a corpus is two tables in the shared folder: ``postings`` (key, doc_id), the exact holders of every
eligible line key, and ``filters`` (shard, capacity, table), one cuckoo filter a shard with the keys that at least
``min_docs`` documents hold. ``insert`` adds documents, each in place of what is known of its doc_id, and ``delete``
takes documents away: both recount only the keys they touch and add to or delete from the filters, so deleting new
documents restores the earlier result (documents that an insert replaced are inserted again to restore theirs); postings
are added or struck out beside the earlier ones and rewritten only after ``CHANGES`` changes. The number of shards
follows the number of keys in the filters, so a shard is of bounded size. ``apply`` tests each line against its shard's
filter; only the lines that pass are looked up in the exact table, which decides. Where filters and table are small
enough for every task both happen where the text is, in one narrow pass.

Defined cases: null and empty texts are one empty line; keys shorter than ``min_chars`` code points are never
dropped; repeated rows of a doc_id are one document; rows without doc_id hold no line and keep all of theirs; a line
that repeats in its last document stays there each time; an empty table gives an empty one; extra columns pass through
``apply`` untouched, but for columns of its own names (n_lines, n_dropped
unless told otherwise), whose place its own take.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .common import BLANKS, mapped, slices, unused, without

#: Slots of a bucket and bits of a fingerprint in a cuckoo filter.
SLOTS, FINGER = 4, 16
KICKS = 500
#: Filters, and with them the exact table, up to this many bytes in all go to every task; beyond, line keys go to the
#: filters' shards, and doomed keys to the texts.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row of the exact table: key and largest doc_id.
REF_BYTES = 24
#: Keys a shard's filter is meant for, line keys tested in one group beyond the broadcast, changes until postings are rewritten.
SHARD_KEYS, GROUP_KEYS, CHANGES = 100_000, 200_000, 16


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, A-Z lower-cased line; None if that has fewer code points."""
    bare = line.strip(BLANKS)
    return hashlib.blake2b(bare.encode().lower(), digest_size=16).digest() if len(bare) >= min_chars else None


class Cuckoo:
    """Partial-key cuckoo filter over 128-bit keys: adds, deletes, and never misses a key it holds."""

    def __init__(self, capacity: int, table: bytes | None = None):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.85))))
        self.slots = np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy() if table else np.zeros((self.buckets, SLOTS), np.uint16)
        self.buckets = len(self.slots)

    def places(self, key: bytes) -> tuple[int, int, int]:
        finger = int.from_bytes(key[8:10], "little") or 1
        first = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        return finger, first, self.other(first, finger)

    def other(self, bucket: int, finger: int) -> int:
        return (bucket ^ (finger * 0x5BD1E995)) & (self.buckets - 1)

    def add(self, key: bytes) -> bool:
        finger, a, b = self.places(key)
        for bucket in (a, b):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = finger
                return True
        undo, bucket = [], a
        for k in range(KICKS):
            slot = (finger + k) % SLOTS
            undo.append((bucket, slot, int(self.slots[bucket, slot])))
            finger, self.slots[bucket, slot] = int(self.slots[bucket, slot]), finger
            bucket = self.other(bucket, finger)
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = finger
                return True
        for bucket, slot, old in reversed(undo):
            self.slots[bucket, slot] = old
        return False

    def delete(self, key: bytes) -> bool:
        finger, a, b = self.places(key)
        for bucket in (a, b):
            held = np.flatnonzero(self.slots[bucket] == finger)
            if len(held):
                self.slots[bucket, held[0]] = 0
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        finger, a, b = self.places(key)
        return bool((self.slots[a] == finger).any() or (self.slots[b] == finger).any())


def shard_of(key: bytes, shards: int) -> int:
    return int.from_bytes(key[10:14], "big") % shards


def shard_column(shards: int) -> F.Column:
    """The same by built-in functions."""
    return (F.conv(F.hex(F.substring("key", 11, 4)), 16, 10).cast("long") % shards).cast("int")


def line_keys(docs: DataFrame, min_chars: int, passes: Callable[[list[bytes]], np.ndarray] | None = None) -> DataFrame:
    """(key, doc_id): each document's distinct eligible keys, of those that ``passes`` if given. One narrow pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {line_key(line, min_chars) for line in set((text or "").split("\n"))} - {None}
                keys += own
                ids += [doc_id] * len(own)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
            yield out.filter(pa.array(passes(keys))) if passes and keys else out

    usable = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(usable, run, "key binary, doc_id long")


@dataclass
class LineIndex:
    """The state; ``refs`` are the keys at or over the threshold with their exact counts and largest holder."""

    spark: SparkSession
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int
    changes: int = 0

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> LineIndex:
        postings = materialise(line_keys(docs, min_chars), "line-postings")
        refs = materialise(counted(postings, min_docs), "line-refs")
        shards = shards_for(refs)
        filters = materialise(build_filters(refs, shards), "line-filters")
        return cls(docs.sparkSession, postings, refs, filters, min_docs, min_chars, shards)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The state with the keys of further documents; one with a known doc_id takes that document's place."""
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        given = materialise(docs.select("doc_id").distinct(), "line-given")
        new = materialise(line_keys(docs, self.min_chars), "line-postings")
        before = self.postings.join(given, "doc_id", "left_semi").select("key")
        touched = materialise(before.unionByName(new.select("key")).distinct(), "line-touched")
        return self._after(self.postings.join(given, "doc_id", "left_anti").select("key", "doc_id").unionByName(new), touched)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The state without these documents (a column doc_id)."""
        gone = materialise(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "line-gone")
        touched = self.postings.join(gone, "doc_id", "left_semi").select("key").distinct()
        return self._after(self.postings.join(gone, "doc_id", "left_anti"), materialise(touched, "line-touched"))

    def _after(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        changes = self.changes + 1
        postings = postings.select("key", "doc_id")
        if changes >= CHANGES:
            postings, changes = materialise(postings, "line-postings"), 0
        fresh = counted(postings.join(touched, "key", "left_semi"), self.min_docs)
        refs = materialise(self.refs.join(touched, "key", "left_anti").unionByName(fresh), "line-refs")
        shards = shards_for(refs, self.shards)
        if shards != self.shards:
            filters = materialise(build_filters(refs, shards), "line-filters")
        else:
            old, new = self.refs.select("key"), refs.select("key")
            moved = new.join(old, "key", "left_anti").withColumn("add", F.lit(True))
            moved = moved.unionByName(old.join(new, "key", "left_anti").withColumn("add", F.lit(False)))
            filters = materialise(update_filters(self.filters, moved.withColumn("shard", shard_column(shards))), "line-filters")
            full = filters.where("capacity = 0").select("shard")
            anew = build_filters(refs, shards, full)
            filters = materialise(filters.where("capacity > 0").unionByName(anew), "line-filters")
        return LineIndex(self.spark, postings, refs, filters, self.min_docs, self.min_chars, shards, changes)

    def apply(self, docs: DataFrame, before: str = "n_lines", dropped: str = "n_dropped") -> DataFrame:
        """``docs`` with the doomed lines gone from ``text``, and the number of lines before and of those dropped."""
        docs = without(docs, before, dropped)
        size, refs = self._bytes(), self.refs.count()
        if size + refs * REF_BYTES <= BROADCAST_BYTES:
            return drop_lines(docs, None, self.min_chars, before, dropped, self._lookup())
        name = unused(docs.columns, "_doomed")
        doomed = self.candidates(docs).join(self.refs.select("key", "max_doc"), "key")
        doomed = doomed.where(F.col("doc_id") < F.col("max_doc")).groupBy("doc_id").agg(F.collect_set("key").alias(name))
        return drop_lines(docs.join(doomed, "doc_id", "left"), name, self.min_chars, before, dropped)

    def _bytes(self) -> int:
        return self.filters.agg(F.sum(F.length("table"))).first()[0] or 0

    def _tables(self) -> dict[int, bytes]:
        return {r["shard"]: bytes(r["table"]) for r in self.filters.collect()}

    def _lookup(self) -> Callable[[list[bytes], list[int]], np.ndarray]:
        """Which (key, doc_id) are doomed: the filters first, and what they pass by the exact table. Both are of a size
        that was checked against ``BROADCAST_BYTES``."""
        rows = self.refs.select("key", "max_doc").toArrow().sort_by("key")
        last = rows["max_doc"].to_numpy().astype(np.int64)
        sent = self.spark.sparkContext.broadcast((ordered(rows["key"].to_pylist()), last))
        passes = tester(self.spark.sparkContext.broadcast(self._tables()), self.shards)

        def doomed(keys: list[bytes], ids: list[int]) -> np.ndarray:
            out = np.zeros(len(keys), bool)
            if len(sent.value[1]) and keys:
                near = np.flatnonzero(passes(keys))
                told, last = sent.value
                wanted = ordered([keys[i] for i in near])
                at = np.minimum(np.searchsorted(told, wanted), len(told) - 1)
                out[near] = (told[at] == wanted) & (np.array(ids, np.int64)[near] < last[at])
            return out

        return doomed

    def candidates(self, docs: DataFrame) -> DataFrame:
        """(key, doc_id) of the lines that their shard's filter passes: all that are in ``refs``, and few others."""
        if self._bytes() <= BROADCAST_BYTES:
            return line_keys(docs, self.min_chars, tester(self.spark.sparkContext.broadcast(self._tables()), self.shards))
        # Too large for every task: each shard's keys are tested where its filter is, in salted groups of bounded size.
        keys = materialise(line_keys(docs, self.min_chars), "line-keys")
        salts = max(1, -(-keys.count() // (self.shards * GROUP_KEYS)))
        salted = keys.withColumn("shard", shard_column(self.shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        spread = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt"))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return left.iloc[:0][["key", "doc_id"]]
            return left.loc[passing(Cuckoo(1, bytes(right["table"].iloc[0])).slots, raw_keys(left["key"])), ["key", "doc_id"]]

        return joined.applyInPandas(run, "key binary, doc_id long")


def shards_for(refs: DataFrame, now: int = 1) -> int:
    """A power of two with at most SHARD_KEYS keys a shard on average, and no fewer than ``now``."""
    return max(now, 1 << max(0, -(-refs.count() // SHARD_KEYS) - 1).bit_length())


def ordered(keys: list[bytes]) -> np.ndarray:
    """Keys of 16 bytes as pairs of numbers that sort as the keys do."""
    return np.array(raw_keys(keys).view(">u8"), "u8").reshape(-1, 2).view([("a", "u8"), ("b", "u8")])[:, 0]


def raw_keys(keys: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16).copy()


def passing(slots: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which keys, rows of 16 bytes, the filter with these slots may hold."""
    mask = np.uint64(len(slots) - 1)
    finger = raw[:, 8:10].copy().view("<u2")[:, 0].astype(np.uint64)
    finger[finger == 0] = 1
    a = raw[:, :8].copy().view("<u8")[:, 0] & mask
    b = (a ^ (finger * np.uint64(0x5BD1E995))) & mask
    f = finger.astype(np.uint16)[:, None]
    return (slots[a] == f).any(axis=1) | (slots[b] == f).any(axis=1)


def tester(held, shards: int) -> Callable[[list[bytes]], np.ndarray]:
    """Which keys the broadcast filters may hold."""

    def passes(keys: list[bytes]) -> np.ndarray:
        raw, passed = raw_keys(keys), np.zeros(len(keys), bool)
        shard = raw[:, 10:14].copy().view(">u4")[:, 0] % shards
        for s, table in held.value.items():
            mine = np.flatnonzero(shard == s)
            passed[mine] = passing(np.frombuffer(table, np.uint16).reshape(-1, SLOTS), raw[mine])
        return passed

    return passes


def counted(postings: DataFrame, min_docs: int) -> DataFrame:
    """Exact number of documents and largest doc_id of the keys at or over the threshold.

    Holders are made distinct by (key, doc_id) and then counted by key in each task before they meet, so a key that very
    many documents hold is a row a task.
    """
    once = postings.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    return once.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")).where(F.col("n_docs") >= min_docs)


FILTERS = "shard int, capacity long, table binary"


def build_filters(refs: DataFrame, shards: int, only: DataFrame | None = None) -> DataFrame:
    """One filter a shard, of the shards in ``only`` if given; a shard's keys are about SHARD_KEYS."""

    def run(keys: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([filled(int(keys["shard"].iloc[0]), [bytes(k) for k in keys["key"]])])

    dealt = refs.select(shard_column(shards).alias("shard"), "key")
    if only is not None:
        dealt = dealt.join(only, "shard", "left_semi")
    return dealt.groupBy("shard").applyInPandas(run, FILTERS)


def filled(shard: int, keys: list[bytes]) -> dict:
    capacity = max(16, len(keys))
    while True:
        cuckoo = Cuckoo(capacity)
        if all(cuckoo.add(k) for k in keys):
            return {"shard": shard, "capacity": capacity, "table": cuckoo.slots.tobytes()}
        capacity *= 2


def update_filters(filters: DataFrame, changes: DataFrame) -> DataFrame:
    """Delete and add the changed keys in each shard's filter; one too full comes back with capacity 0, to be built anew."""

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((old if len(old) else new)["shard"].iloc[0])
        cuckoo = Cuckoo(16, bytes(old["table"].iloc[0]) if len(old) else None)
        for key, add in zip(new["key"], new["add"], strict=True):
            if not add:
                cuckoo.delete(bytes(key))
        added = [bytes(k) for k, add in zip(new["key"], new["add"], strict=True) if add]
        if not all(cuckoo.add(k) for k in added):
            return pd.DataFrame([{"shard": shard, "capacity": 0, "table": b""}])
        return pd.DataFrame([{"shard": shard, "capacity": len(cuckoo.slots) * SLOTS, "table": cuckoo.slots.tobytes()}])

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(run, FILTERS)


def drop_lines(docs: DataFrame, name: str | None, min_chars: int, n_lines: str, n_dropped: str, doomed: Callable[[list[bytes], list[int]], np.ndarray] | None = None) -> DataFrame:
    """Drop the lines whose key is in the column ``name`` or that ``doomed`` tells; counts the lines before and those
    dropped."""
    names = [c for c in docs.columns if c != name]
    text, told, own = docs.columns.index("text"), docs.columns.index(name) if name else -1, docs.columns.index("doc_id")
    rest = [i for i, c in enumerate(docs.columns) if c != name]

    def gone_of(batch: pa.RecordBatch, lines: list[list[str]]) -> list[set[bytes]]:
        if doomed is None:
            return [set(keys or ()) for keys in batch.column(told).to_pylist()]
        keys, ids, at = [], [], []
        for i, (doc_id, some) in enumerate(zip(batch.column(own).cast(pa.int64()).to_pylist(), lines, strict=True)):
            if doc_id is not None:
                mine = {line_key(x, min_chars) for x in set(some)} - {None}
                keys += mine
                ids += [doc_id] * len(mine)
                at += [i] * len(mine)
        gone: list[set[bytes]] = [set() for _ in lines]
        for k in np.flatnonzero(doomed(keys, ids)).tolist():
            gone[at[k]].add(keys[k])
        return gone

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            texts, before, dropped = [], [], []
            whole = batch.column(text).to_pylist()
            split = [(t or "").split("\n") for t in whole]
            for t, lines, gone in zip(whole, split, gone_of(batch, split), strict=True):
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                texts.append("\n".join(kept) if gone else t)
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == text else batch.column(i) for i in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], [*names, n_lines, n_dropped])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != name)
    return mapped(docs, run, f"{schema}, `{n_lines}` long, `{n_dropped}` long")
