"""N-gram Jaccard join by multiple-global-order filtering.

A document is the set of its distinct word 4-grams. Two documents link at Jaccard 0.85 or more. Linked sets must
share tokens in their prefixes under every global token order, so the filters of several orders are intersected
before anything is verified:

1. Equal sets collapse to the least doc_id.
2. Order 1, by hash. In a prefix of ``0.15 n + k`` tokens linked sets share at least ``k``; a set that shares too few
   prefix tokens with anyone has no partner. The rest, the survivors, are few.
3. Order 2, rarest first among the survivors, and order 3, rarest power of two first with another hash. Candidates
   share a prefix token under order 2, overlap under order 3 and have fitting sizes; then the sets are compared.

Only connectivity is asked for, so rounds of star edges (each bucket's members against its leader) come first, led by
the sets whose tokens most others hold; pairs already connected are never compared, which keeps a group of n near
copies at n comparisons. The last round takes every pair of a bucket that is still apart, so no link is lost; a parity
bitmap of each set bounds the overlap from above (bits that differ are tokens that differ) before sets are compared.

Two sets that stay apart though they share a bucket are compared in that last round, so a family of n texts that are
all near the threshold but under it costs the pairs of the family, less those that sizes and bitmaps rule out.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; under four words the whole
sequence is one shingle; repeated rows of a doc_id are one document, and if their texts differ, it has the links of
all of them, and each row its own n_shingles; rows without doc_id keep a null component; ties go to the smallest
doc_id; an empty table gives no row; extra columns are ignored by ``near_copies`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.operators.components import connected_components
from voxelframe.storage import materialise

from .common import gathered, mapped, slices

#: Jaccard threshold in percent, words of a shingle.
PERCENT, WORDS = 85, 4
#: Survivors up to this many are sent to every task as ids (8 bytes each); beyond, texts are joined by doc_id.
BROADCAST_IDS = 1_000_000
STAR_ROUNDS = 3
#: Bits of a set's parity bitmap, in longs.
LONGS = 8
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; bytes.lower and bytes.split act on ASCII alone."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=words)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - words + 1
    total = h[:n].copy()
    for i in range(1, words):
        total = total * MULTIPLY + h[i : i + n]
    return np.unique(mix(total))


def slack(n: int, percent: int = PERCENT) -> int:
    """Most tokens of a set of n that a linked set may lack."""
    return n * (100 - percent) // 100


def first_prefix(n: int, percent: int = PERCENT) -> int:
    return min(n, slack(n, percent) + 1 + n // 20)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """A linked set has at least ``percent`` of n tokens, so both prefixes go this many common tokens deep."""
    return 1 + (percent * n // 100) // 20


def signatures(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), print (128-bit digest of the set) and the prefix under order 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, prints, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                prefixes.append(s[: first_prefix(len(s), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), lists(prefixes)], ["doc_id", "n", "print", "prefix"]
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, "doc_id long, n int, print binary, prefix array<long>")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap whose bit b says whether an odd number of tokens fall on b: |x ^ y| bits never exceed |x - y| + |y - x|."""
    bits = np.bincount((tokens >> np.uint64(7)).astype(np.int64) & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def within(nx: Column, ny: Column, bits_x: Column, bits_y: Column, percent: int = PERCENT) -> Column:
    """Whether sets of these sizes and bitmaps may reach the threshold."""
    apart = sum((F.bit_count(F.get(bits_x, F.lit(k)).bitwiseXOR(F.get(bits_y, F.lit(k)))) for k in range(LONGS)), F.lit(0))
    return (100 + percent) * (nx + ny - apart) >= 2 * percent * (nx + ny)


def whole_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, print, the set and its parity bitmap of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            columns = [pa.array(map(len, sets), pa.int32()), pa.array(prints, pa.binary()), lists([x.view(np.int64) for x in sets]), lists([parity(x) for x in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "print", "tokens", "bits"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, "doc_id long, n int, print binary, tokens array<long>, bits array<long>")


def survivors(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id of the sets that share enough tokens of their order-1 prefix with other sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tokens that a batch holds twice are shared whatever the other batches hold: those are counted here, and one
        # row (doc_id null) tells the others. So a token of very many documents is a row a batch, not a row a document.
        for batch in gathered(batches):
            ids, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            column = batch.column(2)
            tokens, lengths = np.asarray(column.flatten()), np.asarray(pa.compute.list_value_length(column))
            owner = np.repeat(np.arange(len(ids)), lengths)
            values, place, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            here = counts[place] > 1
            local = np.bincount(owner[here], minlength=len(ids))
            need = np.array([least_shared(int(n), percent) for n in sizes])
            told = values[counts > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(tokens[~here]), pa.array(told), pa.nulls(len(ids), pa.int64())]),
                    pa.concat_arrays([pa.array(ids[owner[~here]]), pa.nulls(len(told), pa.int64()), pa.array(ids)]),
                    pa.concat_arrays([pa.nulls(int((~here).sum()) + len(told), pa.int32()), pa.array((need - local).astype(np.int32))]),
                ],
                ["token", "doc_id", "need"],
            )

    rows = mapped(reps.select("doc_id", "n", "prefix"), run, "token long, doc_id long, need int")
    # Rows with a need carry no token; spread them instead of sending all nulls to one task.
    key = F.coalesce("token", F.xxhash64("doc_id"))
    held = rows.withColumn("holders", F.count("token").over(Window.partitionBy(key)))
    shared = F.when(F.col("token").isNotNull() & (F.col("holders") > 1), 1).otherwise(0)
    by = held.where("doc_id is not null").groupBy("doc_id").agg(F.sum(shared).alias("got"), F.max("need").alias("need"))
    return by.where("got >= need").select("doc_id")


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, the prefixes a and b under orders 2 and 3, and how common the set's tokens are; sets without shared
    prefix tokens go."""
    rows = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    # Counted in each task first and joined back, so the rows of a token of very many sets can be split over tasks.
    counts = rows.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    held = rows.join(counts, "token").groupBy("doc_id", "n").agg(F.collect_list(F.struct("holders", "token")).alias("held"))

    def order(rank, seed: int) -> Column:
        return F.sort_array(F.transform("held", lambda x: F.struct(rank(x["holders"]).alias("rank"), F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"].alias("token"))))

    common = F.aggregate("held", F.lit(0).cast("long"), lambda total, x: total + x["holders"]) / F.col("n")
    by = held.select("doc_id", "n", order(lambda c: c, 2).alias("a"), order(lambda c: F.floor(F.log2(c)), 3).alias("b"), common.alias("common"))
    # Tokens that no other set holds come first in both orders and fill the prefix without being kept.
    take = F.expr(f"(n * {100 - percent}) div 100 + 1") - (F.col("n") - F.size("a"))
    by = by.where(take > 0)
    return by.select("doc_id", "n", F.slice("a", 1, take)["token"].alias("a"), F.slice("b", 1, take)["token"].alias("b"), "common")


def fits(n: Column, m: Column, percent: int = PERCENT) -> Column:
    return (100 * F.least(n, m) >= percent * F.greatest(n, m))


def verified(pairs: DataFrame, sets: DataFrame, chosen: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) that overlap under order 3 and whose sets reach the threshold."""
    thin = sets.join(chosen.select("doc_id", "b"), "doc_id").select("doc_id", "n", "b", "bits")
    x, y = (thin.select(*(F.col(c).alias(c if c == k else f"{c}_{k}") for c in thin.columns)).withColumnRenamed(f"doc_id_{k}", k) for k in ("x", "y"))
    near = within(F.col("n_x"), F.col("n_y"), F.col("bits_x"), F.col("bits_y"), percent)
    thin = pairs.join(x, "x").join(y, "y").where(F.arrays_overlap("b_x", "b_y") & near).select("x", "y")
    both = thin.join(sets.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx")), "x")
    both = both.join(sets.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty")), "y")
    both = both.select("x", "y", "nx", "ny", F.size(F.array_intersect("tx", "ty")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common"))).select("x", "y")


def links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (src, dst) whose components are those of all links; not every link within a component is listed."""
    chosen = materialise(prefixes(sets, percent), "ngram-prefixes")
    buckets = chosen.select("doc_id", "n", "common", F.explode("a").alias("token"))
    # What is said of a bucket is aggregated in each task first and joined back, so Spark can split a large bucket.
    # A bucket of one set has no pair.
    shared = buckets.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    buckets = materialise(buckets.join(shared.select("token"), "token"), "ngram-buckets")
    edges = None
    apart = buckets.withColumn("comp", F.col("doc_id"))
    for k in range(STAR_ROUNDS):
        rank = -F.col("common") if k == 0 else F.xxhash64("doc_id", F.lit(k)).cast("double")
        first = F.min(F.struct(rank.alias("rank"), F.col("doc_id").alias("doc_id"), F.col("comp").alias("comp"), F.col("n").alias("n")))
        led = apart.join(apart.groupBy("token").agg(first.alias("lead")), "token")
        pairs = led.where((F.col("comp") != F.col("lead.comp")) & fits(F.col("n"), F.col("lead.n"), percent))
        pairs = pairs.select(F.col("doc_id").alias("x"), F.col("lead.doc_id").alias("y"))
        edges = _with_links(edges, pairs, sets, chosen, percent)
        comps = connected_components(edges).select(F.col("node").alias("doc_id"), "component")
        apart = buckets.join(comps, "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
        # Buckets in one component have nothing left to compare.
        mixed = apart.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        apart = materialise(apart.join(mixed.select("token"), "token").select("doc_id", "n", "common", "token", "comp"), "ngram-apart")
    left = apart.join(sets.select("doc_id", "bits"), "doc_id")
    x, y = (left.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n", "comp", "bits"))) for k in ("x", "y"))
    near = within(F.col("n_x"), F.col("n_y"), F.col("bits_x"), F.col("bits_y"), percent)
    pairs = x.join(y, "token").where((F.col("comp_x") < F.col("comp_y")) & fits(F.col("n_x"), F.col("n_y"), percent) & near)
    return _with_links(edges, pairs.select(F.col("doc_id_x").alias("x"), F.col("doc_id_y").alias("y")), sets, chosen, percent)


def _with_links(edges: DataFrame | None, pairs: DataFrame, sets: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    pairs = materialise(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "ngram-pairs")
    found = verified(pairs, sets, chosen, percent).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    return materialise(found if edges is None else edges.unionByName(found), "ngram-links")


def near_copies(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the least doc_id reachable by links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(signatures(docs, percent, words), "ngram-signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    reps = usable.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min_by("n", "doc_id").alias("n"), F.min_by("prefix", "doc_id").alias("prefix"))
    again = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("held"), F.min("print").alias("least"), F.max("print").alias("most"))
    again = materialise(again.where("held > 1"), "ngram-repeated")
    repeated = not again.isEmpty()
    if not repeated:
        left = materialise(survivors(reps, percent), "ngram-survivors")
        ids = F.broadcast(left) if left.count() <= BROADCAST_IDS else left
        sets = materialise(whole_sets(docs.join(ids, "doc_id", "left_semi"), words).where("n > 0").drop("print"), "ngram-sets")
        comps = connected_components(links(sets, percent))
        first = reps.select("print", "doc_id")
        classes = first.join(comps, first["doc_id"] == comps["node"], "left").select("print", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        classes = _classes_of_repeated(docs, usable, reps, again, percent, words)
    known = signed.where("print is not null").join(classes, "print", "left").select("doc_id", "n", "component_id")
    blank = signed.where("print is null").select("doc_id", "n")
    # A row without shingles goes with the other rows of its doc_id, if there are any.
    other = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id")) if repeated else None
    blank = blank.join(other, "doc_id", "left") if repeated else blank.withColumn("component_id", F.lit(None).cast("long"))
    out = known.unionByName(blank)
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))


def _classes_of_repeated(docs: DataFrame, usable: DataFrame, reps: DataFrame, again: DataFrame, percent: int, words: int) -> DataFrame:
    """(print, component_id) where doc_ids repeat: texts, not doc_ids, are joined, and a doc_id links its texts."""
    several = again.where("least <> most").select("doc_id", "least")
    reps = reps.join(several, "doc_id", "left")
    for salt in range(100):
        # A text of a doc_id with several gets an id of its own; ids that are not unique are made anew.
        own = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "print", F.lit(salt)))
        named = materialise(reps.withColumn("node", own), "ngram-nodes")
        made = named.where("least is not null").select("node")
        if named.select("node").join(made.distinct(), "node").groupBy("node").count().where("count > 1").isEmpty():
            break
    survive = survivors(named.select(F.col("node").alias("doc_id"), "n", "prefix"), percent).withColumnRenamed("doc_id", "node")
    chosen = materialise(named.select("node", "print", "doc_id").join(survive, "node"), "ngram-survivors")
    found = whole_sets(docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"), words).where("n > 0")
    found = found.join(chosen.select("print", "node"), "print").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "bits")))
    sets = materialise(found.withColumnRenamed("node", "doc_id"), "ngram-sets")
    nodes = named.select("print", "node")
    held = usable.select("doc_id", "print").join(several, "doc_id").join(nodes.withColumnRenamed("node", "src"), "print")
    held = held.join(nodes.select(F.col("print").alias("least"), F.col("node").alias("dst")), "least").where("src <> dst")
    comps = connected_components(materialise(links(sets, percent).unionByName(held.select("src", "dst").distinct()), "ngram-links"))
    whole = named.select("print", "doc_id", "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = materialise(whole.select("print", "doc_id", "component"), "ngram-classes")
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return whole.join(least, "component").select("print", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The documents that are the least of their component, all columns; rows without shingles or doc_id stay."""
    found = near_copies(docs, percent, words)
    others = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")
