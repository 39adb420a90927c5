"""Affinities of label volumes and their loss masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .volume import AXES


#: Voxels along the side of a tile; more where a distance is longer.
TILE = 64


def all_affinities(labels: DataFrame, distances: Sequence[int]) -> DataFrame:
    """(axis, distance, z, y, x, aff, mask) along each axis of a dense volume, at each distance.

    aff: the voxel and the one ``distance`` further hold the same label and not 0; false beyond the border.
    mask: the neighbour exists and neither is unlabelled. A voxel goes to its tile, and from the first places of a tile
    to the one before as well; the lines of all axes lie whole within these tiles, so the volume is shuffled once.
    """
    far = max(distances)
    size = max(TILE, far)
    own = [F.floor(F.col(a) / size).alias(f"t{a}") for a in AXES]
    to = [F.struct(*own, F.lit(True).alias("own"))]
    for axis in AXES:
        back = [(t - 1).alias(f"t{a}") if a == axis else t for a, t in zip(AXES, own, strict=True)]
        to.append(F.when(F.pmod(F.col(axis), F.lit(size)) < far, F.struct(*back, F.lit(False).alias("own"))))
    rows = labels.select(*AXES, "label", F.explode(F.array_compact(F.array(*to))).alias("_t")).select(*AXES, "label", "_t.*")
    tile = [f"t{a}" for a in AXES]
    rows = rows.repartition(*tile)
    found = []
    for axis in AXES:
        line = Window.partitionBy(*tile, *(a for a in AXES if a != axis)).orderBy(axis)
        for d in distances:
            other = f"_{axis}{d}"
            rows = rows.withColumn(other, F.lead("label", d).over(line))
            same = F.coalesce((F.col("label") == F.col(other)) & (F.col("label") != 0), F.lit(False))
            known = F.coalesce((F.col("label") != -1) & (F.col(other) != -1), F.lit(False))
            found.append(F.struct(F.lit(axis).alias("axis"), F.lit(d).alias("distance"), same.alias("aff"), known.alias("mask")))
    rows = rows.where("own").select(*AXES, F.explode(F.array(*found)).alias("_a"))
    return rows.select("_a.axis", "_a.distance", *AXES, "_a.aff", "_a.mask")


def affinities(labels: DataFrame, distance: int = 1) -> DataFrame:
    """(axis, z, y, x, aff, mask) at one distance."""
    return all_affinities(labels, [distance]).drop("distance")


def encoded(aff: DataFrame) -> DataFrame:
    """1 true, 0 false, -1 masked."""
    return aff.withColumn("target", F.when(F.col("mask"), F.col("aff").cast("byte")).otherwise(F.lit(-1).cast("byte")))


def target_counts(aff: DataFrame) -> DataFrame:
    rows = encoded(aff)
    return rows.groupBy("axis").agg(*(F.count_if(F.col("target") == v).alias(n) for n, v in (("n_true", 1), ("n_false", 0), ("n_masked", -1))))
