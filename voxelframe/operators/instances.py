"""Instances of a label table: sizes, filters, ranks and relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.storage import materialise


def sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    """Voxels of every label over zero."""
    return labels.where(F.col(label) > 0).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("size"))


def filter_small(found: DataFrame, min_size: int) -> DataFrame:
    return found.where(F.col("size") >= min_size)


def dense_rank_global(values: DataFrame, column: str, start: int = 1) -> DataFrame:
    """(column, rank) of distinct values in ascending order, without gathering them in one task: ranges are ranked in
    parallel and shifted by the number of values in the ranges before."""
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.select(column).distinct().repartitionByRange(n, column).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "rank-ranges")
    counts = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}
    before, shift = start - 1, []
    for k in sorted(counts):
        shift += [F.lit(k), F.lit(before)]
        before += counts[k]
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(column))
    ranked = inside + (F.element_at(F.create_map(*shift), F.col("_range")) if shift else F.lit(0))
    return dealt.select(column, ranked.cast("long").alias("rank"))


def relabel_dense(found: DataFrame) -> DataFrame:
    """(old_label, new_label): 1..N in ascending order of the old label."""
    return dense_rank_global(found, "label").select(F.col("label").alias("old_label"), F.col("rank").alias("new_label"))


def keep_largest(found: DataFrame, k: int) -> DataFrame:
    """The k largest instances (ties keep the smaller label), relabelled 1..k; with k or fewer, all as they are."""
    top = found.orderBy(F.desc("size"), "label").limit(k + 1)
    few = top.count() <= k
    if few:
        return found.select(F.col("label").alias("new_label"), F.col("label").alias("old_label"), "size")
    top = found.orderBy(F.desc("size"), "label").limit(k)
    return top.select(F.row_number().over(Window.orderBy("label")).cast("long").alias("new_label"), F.col("label").alias("old_label"), "size")


def largest(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("size"), "label").limit(1)


def apply_map(labels: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """``labels`` with new_label: mapped, 0 where the label has no entry."""
    joined = labels.join(mapping.select(F.col("old_label").alias(label), "new_label"), label, "left")
    return joined.withColumn("new_label", F.coalesce("new_label", F.lit(0)).cast("long"))


def filter_remap_stats(labels: DataFrame, min_size: int, label: str = "label") -> DataFrame:
    """Counters of a filter-and-remap: voxels and instances before, kept and removed."""
    if min_size < 1:
        raise ValueError("min_size must be at least 1")
    found = sizes(labels, label)
    keep = F.col("size") >= min_size
    zero = F.lit(0)
    return found.agg(
        F.lit(min_size).cast("long").alias("min_size"),
        F.count("*").alias("n_before"),
        F.count_if(keep).alias("n_after"),
        F.count_if(~keep).alias("n_removed"),
        F.coalesce(F.sum("size"), zero).cast("long").alias("voxels_before"),
        F.coalesce(F.sum(F.when(keep, F.col("size"))), zero).cast("long").alias("voxels_after"),
        F.coalesce(F.sum(F.when(~keep, F.col("size"))), zero).cast("long").alias("voxels_removed"),
        F.coalesce(F.max(F.when(keep, F.col("label"))), zero).cast("long").alias("max_label_before"),
    )
