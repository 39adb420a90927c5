"""Connected components by alternating large-star and small-star rounds.

Each round is joins and groupings keyed by node, so no component is ever gathered in one task; the number of rounds
grows with the logarithm of the diameter. Lineage is cut by a table in the shared folder after each round. Edges that
are counted and found few enough for one task (``SMALL`` of 16 bytes each) are settled there, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise

#: Distinct edges up to this many are settled in one task.
SMALL = 1_000_000


def settle(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes over undirected edges: minima over edges and pointer jumps."""
    least = np.arange(n)
    while True:
        a, b = least[src], least[dst]
        if (a == b).all():
            return least
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not (least == (jumped := least[least])).all():
            least = jumped


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of the batches."""
    held = pa.Table.from_batches(batches, pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    nodes, places = np.unique(np.concatenate([held["hi"].to_numpy(), held["lo"].to_numpy()]), return_inverse=True)
    least = settle(places[: held.num_rows], places[held.num_rows :], len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[least])], ["node", "component"])


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h"), F.sum("lo").cast("decimal(38,0)").alias("s")).first()
    return row["n"], row["h"], row["s"]


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From undirected edges (src, dst) to (hi, lo) pairs in which every node but a component's least points at it."""
    hi, lo = F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")
    now = materialise(edges.where("src <> dst").select(hi, lo).distinct(), "edges")
    before = _digest(now)
    if not before[0]:
        return now
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u gets an edge to the least node around u.
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        # Small star: the smaller neighbours of u, and u, get edges to the least of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = materialise(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        after = _digest(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (src, dst); self-loops count as nodes."""
    hi, lo = F.greatest("src", "dst").cast("long").alias("hi"), F.least("src", "dst").cast("long").alias("lo")
    pairs = materialise(edges.where("src is not null and dst is not null").select(hi, lo).distinct(), "edges")
    if pairs.count() <= SMALL:
        return pairs.coalesce(1).mapInArrow(_settled, "node long, component long")
    edges = pairs.select(F.col("hi").alias("src"), F.col("lo").alias("dst"))
    found = stars(edges)
    roots = found.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    joined = found.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    alone = loops.join(joined.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return joined.unionByName(alone)
