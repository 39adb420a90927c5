"""Point clouds and linear skeleton tables from label voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .instances import filter_small, largest, relabel_dense, sizes
from .volume import AXES


def point_cloud(labels: DataFrame, n_points: int, min_size: int = 1, voxel_size: tuple[float, float, float] = (1, 1, 1), only_largest: bool = False, seed: int = 0) -> DataFrame:
    """(label, i, x, y, z): at most ``n_points`` of each instance in hash order, in physical units, padded with zeros.

    Labels are 1-based positions of the kept instances; no instance gives one cloud of zeros with label 0.
    """
    found = filter_small(sizes(labels), min_size)
    found = largest(found) if only_largest else found
    ids = relabel_dense(found)
    rows = labels.join(ids.select(F.col("old_label").alias("label"), "new_label"), "label")
    order = Window.partitionBy("new_label").orderBy(F.xxhash64(*AXES, F.lit(seed)), *AXES)
    rows = rows.withColumn("i", (F.row_number().over(order) - 1).cast("long")).where(F.col("i") < n_points)
    sized = {a: (F.col(a) * float(s)).alias(a) for a, s in zip(AXES, voxel_size, strict=True)}
    points = rows.select(F.col("new_label").alias("label"), "i", sized["x"], sized["y"], sized["z"])
    slots = ids.select(F.col("new_label").alias("label")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_points - 1).cast("long"))))
    empty = labels.sparkSession.range(n_points).select(F.lit(0).cast("long").alias("label"), F.col("id").alias("i"))
    slots = slots.unionByName(empty) if not found.head(1) else slots
    padded = slots.join(points, ["label", "i"], "left")
    return padded.select("label", "i", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y", "z")))


def swc_chain(nodes: DataFrame) -> DataFrame:
    """Nodes (skel_id, seq, z, y, x) as rows of a linear tree: the parent is the node before, -1 at the root."""
    order = Window.partitionBy("skel_id").orderBy("seq")
    number = F.row_number().over(order).cast("long")
    parent = F.when(number == 1, F.lit(-1)).otherwise(number - 1).cast("long")
    return nodes.select("skel_id", number.alias("node_id"), F.lit(3).cast("long").alias("type"), "x", "y", "z", F.lit(1.0).alias("radius"), parent.alias("parent_id"))
