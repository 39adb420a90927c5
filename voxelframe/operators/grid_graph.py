"""Components of voxel volumes: labelled tile by tile, then star rounds over the edges between tiles.

A tile is a bounded group of voxels, labelled by vectorised minima, so only the edges that cross a tile's border enter the
rounds of joins; a volume of one tile needs none.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.storage import materialise

from .components import connected_components, settle
from .instances import dense_rank_global
from .volume import AXES, grid

FACES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
#: The 13 neighbours that come later in raster order.
FULL = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def neighbour_edges(voxels: DataFrame, offsets, same: str | None = None) -> DataFrame:
    """(src, dst) raster indices of neighbouring voxels of a sparse table (z, y, x, lin); with ``same``, of equal value."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(o).alias(f"d{a}") for o, a in zip(d, AXES, strict=True))) for d in offsets))).alias("_d")
    extra = [same] if same else []
    moved = voxels.select(F.col("lin").alias("src"), *AXES, *extra, steps)
    moved = moved.select("src", *((F.col(a) + F.col(f"_d.d{a}")).alias(a) for a in AXES), *extra)
    there = voxels.select(F.col("lin").alias("dst"), *AXES, *extra)
    return moved.join(there, [*AXES, *extra]).select("src", "dst")


#: Voxels along the side of a tile.
TILE = 48


def tile_roots(voxels: DataFrame, offsets, same: str | None = None, flags: list[str] | None = None) -> DataFrame:
    """``voxels`` with root, the least lin of their component within their tile.

    Neighbours at an offset are joined if their ``same`` is equal, where given, and the nearer one's flag is set, where
    ``flags`` names a boolean column for each offset.
    """
    names = [*AXES, "lin", *([same] if same else []), *(flags or [])]
    rows = voxels.select(*names, *(F.expr(f"{a} div {TILE}").alias(f"_{a}") for a in AXES))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lin", ignore_index=True)
        low = frame[list(AXES)].min().to_numpy() - 1
        at = frame[list(AXES)].to_numpy() - low
        place = np.full(at.max(axis=0) + 2, -1)
        place[tuple(at.T)] = np.arange(len(frame))
        src, dst = [], []
        for k, step in enumerate(offsets):
            other = place[tuple((at + np.array(step)).T)]
            held = other >= 0
            if flags:
                held &= frame[flags[k]].to_numpy(bool)
            if same:
                held &= frame[same].to_numpy()[other] == frame[same].to_numpy()
            src.append(np.flatnonzero(held))
            dst.append(other[held])
        found = settle(np.concatenate(src), np.concatenate(dst), len(frame))
        return frame[names].assign(root=frame["lin"].to_numpy()[found])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in voxels.select(*names).schema)
    return rows.groupBy(*(f"_{a}" for a in AXES)).applyInPandas(run, f"{kept}, root long")


def border_edges(rooted: DataFrame, offsets, same: str | None = None, flags: list[str] | None = None) -> DataFrame:
    """(src, dst) roots of neighbours in different tiles: only voxels at the borders of tiles are joined."""
    edge = F.lit(False)
    for a in AXES:
        edge = edge | F.pmod(F.col(a), F.lit(TILE)).isin(0, TILE - 1)
    rim = rooted.where(edge)
    out = None
    for k, step in enumerate(offsets):
        near = rim.where(F.col(flags[k])) if flags else rim
        moved = near.select(F.col("root").alias("src"), *(F.col(a).alias(f"_{a}") for a in AXES), *((F.col(a) + F.lit(d)).alias(a) for a, d in zip(AXES, step, strict=True)), *([same] if same else []))
        crossed = F.lit(False)
        for a in AXES:
            crossed = crossed | (F.expr(f"{a} div {TILE}") != F.expr(f"_{a} div {TILE}"))
        pairs = moved.where(crossed).join(rim.select(F.col("root").alias("dst"), *AXES, *([same] if same else [])), [*AXES, *([same] if same else [])]).select("src", "dst")
        out = pairs if out is None else out.unionByName(pairs)
    return out.where("src <> dst").distinct()


def components_of(voxels: DataFrame, offsets, same: str | None = None, flags: list[str] | None = None) -> DataFrame:
    """``voxels`` (z, y, x, lin, ...) with component, the least lin of theirs."""
    rooted = materialise(tile_roots(voxels, offsets, same, flags), "tile-roots")
    edges = materialise(border_edges(rooted, offsets, same, flags), "tile-edges")
    if edges.isEmpty():
        return rooted.withColumnRenamed("root", "component")
    roots = connected_components(edges).select(F.col("node").alias("root"), F.col("component").alias("_c"))
    return rooted.join(roots, "root", "left").withColumn("component", F.coalesce("_c", "root")).drop("_c", "root")


def numbered(found: DataFrame) -> DataFrame:
    """(lin, component): components numbered from 1 in raster order of their first voxel."""
    ranks = dense_rank_global(found, "component")
    return found.join(ranks, "component").select("lin", F.col("rank").alias("component"))


def mask_components(voxels: DataFrame, offsets=FACES, same: str | None = None) -> DataFrame:
    """Components of all the voxels given, lone ones too."""
    return numbered(components_of(voxels, offsets, same))


def affinity_components(voxels: DataFrame, threshold: float) -> DataFrame:
    """Components over one affinity a voxel that both ends pass (strictly); lone voxels are background."""
    found = components_of(voxels.where(F.col("val") > F.lit(threshold).cast("float")), FACES)
    more = found.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    return numbered(found.join(more, "component", "left_semi"))


def hard_affinity_components(voxels: DataFrame, flags: tuple[str, str, str] = ("az", "ay", "ax"), shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Components of a dense volume (z, y, x, lin) with three boolean affinities to the next voxel along each axis.

    A voxel is joined to its neighbour if its own affinity says so. One with an affinity set belongs to a component even
    if the neighbour lies outside the volume; one with none belongs to that of a neighbour that points at it, if any.
    With ``shape``, places that have no row are voxels with no affinity set, and lin is the place in raster order.
    """
    if shape is not None:
        lin = (F.col("z") * shape[1] + F.col("y")) * shape[2] + F.col("x")
        voxels = grid(voxels.sparkSession, shape).join(voxels.select(*AXES, *flags).hint("merge"), list(AXES), "left").withColumn("lin", lin)
        voxels = voxels.select(*AXES, "lin", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))
    own = F.lit(False)
    for f in flags:
        own = own | F.col(f)
    found = components_of(voxels.select(*AXES, "lin", *(F.coalesce(f, F.lit(False)).alias(f) for f in flags)), FACES, None, list(flags))
    more = found.groupBy("component").agg(F.count("*").alias("_n"), F.max(own).alias("_own")).where("_n > 1 or _own").select("component")
    return numbered(found.join(more, "component", "left_semi"))
