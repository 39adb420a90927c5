"""Batches of volumes in one plan, keyed by vol_id, and the composed calls: decode, clean up, match and score.

Volumes of a batch are placed one after another along z with an empty slice between them, so that operators on one volume
work on all of them at once and no neighbours cross. No step loops over volumes on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.scalar import ratio, scaled_sigmoid
from voxelframe.storage import materialise

from . import assignment, datasets, grid_graph, instances, metrics, morphology, skeleton, tiles
from .volume import AXES


def _raster(shape: tuple[int, int, int]) -> Column:
    return (F.col("z") * shape[1] + F.col("y")) * shape[2] + F.col("x")


def _at(shape: tuple[int, int, int]) -> list[Column]:
    _, ny, nx = shape
    return [F.expr(f"lin div {ny * nx}").alias("z"), F.expr(f"(lin div {nx}) % {ny}").alias("y"), (F.col("lin") % nx).alias("x")]


@dataclass(frozen=True)
class Stack:
    """Places of volumes of at most ``shape`` in one; ``ranks`` is (vol_id, rank)."""

    ranks: DataFrame
    shape: tuple[int, int, int]

    @classmethod
    def of(cls, volumes: DataFrame, shape: tuple[int, int, int]) -> Stack:
        return cls(materialise(instances.dense_rank_global(volumes, "vol_id", 0), "stack"), shape)

    def put(self, voxels: DataFrame) -> DataFrame:
        """Voxels (vol_id, z, y, x, ...) at their places, with lin."""
        rows = voxels.join(self.ranks, "vol_id").withColumn("z", F.col("z") + F.col("rank") * (self.shape[0] + 1))
        return rows.drop("rank").withColumn("lin", _raster(self.shape))

    def take(self, rows: DataFrame) -> DataFrame:
        """Rows with lin as (vol_id, z, y, x, ...)."""
        step = self.shape[0] + 1
        placed = rows.select(*_at(self.shape), *(c for c in rows.columns if c != "lin"))
        placed = placed.withColumn("rank", F.expr(f"z div {step}")).withColumn("z", F.col("z") % step)
        return placed.join(self.ranks, "rank").drop("rank")


def passing(voxels: DataFrame, threshold: float, adaptive: bool = True) -> DataFrame:
    """Voxels strictly over the threshold; in a volume where none is, over half of it."""
    over = lambda t: F.col("val") > F.lit(t).cast("float")
    if not adaptive:
        return voxels.where(over(threshold))
    some = voxels.groupBy("vol_id").agg(F.max(over(threshold)).alias("_some"))
    return voxels.where(over(threshold * 0.5)).join(some, "vol_id").where(over(threshold) | ~F.col("_some")).drop("_some")


def extract(voxels: DataFrame, shape: tuple[int, int, int], threshold: float = 0.5, min_size: int = 0, largest: int | None = None) -> DataFrame:
    """Instances (vol_id, z, y, x, label) of affinity volumes (vol_id, z, y, x, val).

    Components over faces, without those under ``min_size``, at most the ``largest`` of a volume (ties keep the earlier);
    labels of a volume are 1..N in raster order of their first voxels.
    """
    stack = Stack.of(voxels, shape)
    placed = stack.put(passing(voxels, threshold)).select(*AXES, "lin", "val")
    found = materialise(stack.take(grid_graph.affinity_components(placed, float("-inf"))), "batch-components")
    kept = found.groupBy("vol_id", "component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    if largest is not None:
        order = Window.partitionBy("vol_id").orderBy(F.desc("size"), "component")
        kept = kept.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= largest)
    kept = materialise(kept.select("vol_id", "component"), "batch-kept")
    ranked = kept.join(instances.dense_rank_global(kept, "component"), "component")
    first = ranked.groupBy("vol_id").agg(F.min("rank").alias("_first"))
    ids = ranked.join(first, "vol_id").select("component", (F.col("rank") - F.col("_first") + 1).alias("label"))
    return found.join(ids, "component").select("vol_id", *AXES, "label")


def overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(vol_id, gt, pred, n) of the volumes of ``gt``; places that only one of them holds are background in the other."""
    keys = ["vol_id", *AXES]
    both = gt.select(*keys, F.col("label").alias("gt")).join(pred.select(*keys, F.col("label").alias("pred")), keys, "full")
    rows = both.select("vol_id", F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("pred", F.lit(0)).alias("pred"))
    known = gt.select("vol_id").distinct()
    return metrics.contingency(metrics.exclude_unlabelled(rows), ["vol_id"]).join(known, "vol_id", "left_semi")


def dice(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """A row for each volume of ``gt``: mean Dice of its labels under the best 1-1 assignment, labels matched, labels in
    all, match rate, and an error where no voxel is predicted. Volumes without labels have Dice 0."""
    table = materialise(overlaps(gt, pred), "batch-overlaps")
    iou = materialise(metrics.pair_iou(table, ["vol_id"]), "batch-iou")
    # Labels of all volumes under ids of their own: a range for each volume.
    top = table.agg(F.greatest(F.max("gt"), F.max("pred"))).first()[0] or 0
    ranks = instances.dense_rank_global(table, "vol_id", 0)
    wide = lambda c: F.col(c) + F.col("rank") * (top + 1)
    moved = iou.join(ranks, "vol_id").select(wide("gt").alias("gt"), wide("pred").alias("pred"), "iou")
    pairs = assignment.assign(moved).select(F.expr(f"gt div {top + 1}").alias("rank"), (F.col("gt") % (top + 1)).alias("gt"), (F.col("pred") % (top + 1)).alias("pred"))
    chosen = iou.join(pairs.join(ranks, "rank").drop("rank"), ["vol_id", "gt", "pred"])
    chosen = chosen.select("vol_id", "gt", ratio(2 * F.col("n"), F.col("gt_area") + F.col("pred_area")).alias("dice"))
    labels = table.where("gt > 0").select("vol_id", "gt").distinct().join(chosen, ["vol_id", "gt"], "left")
    scored = labels.groupBy("vol_id").agg(F.avg(F.coalesce("dice", F.lit(0.0))).alias("dice"), F.count("dice").alias("matched"), F.count("*").alias("total_gt_labels"))
    volumes = table.groupBy("vol_id").agg(F.max("pred").alias("_any")).join(scored, "vol_id", "left")
    error = F.when(F.col("_any") <= 0, "no prediction")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "total_gt_labels")]
    rows = volumes.select("vol_id", F.coalesce("dice", F.lit(0.0)).alias("dice"), *counts, error.alias("error"))
    return rows.withColumn("match_rate", F.col("matched") / F.greatest(F.col("total_gt_labels"), F.lit(1)))


def extract_and_score(voxels: DataFrame, gt: DataFrame, shape, threshold: float = 0.5, min_size: int = 200, largest: int | None = None) -> DataFrame:
    """Affinities to instances to Dice, a row a volume; ``datasets.batch_stats`` sums it up."""
    return dice(gt, extract(voxels, shape, threshold, min_size, largest))


def instance_scores(gt: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """Instance metrics of each volume of ``gt``."""
    return metrics.instance_metrics(materialise(overlaps(gt, pred), "batch-overlaps"), thresholds, ["vol_id"])


def decode_and_score(voxels: DataFrame, gt: DataFrame, decode: Callable[[DataFrame], DataFrame], thresholds: list[float]) -> DataFrame:
    """Scores of one volume's decoding, say by ``watershed.light_decode`` or ``sdt_decode`` with its settings."""
    one = lambda rows: rows.select(F.lit(0).cast("long").alias("vol_id"), *AXES, "label")
    return instance_scores(one(gt), one(materialise(decode(voxels), "decoded")), thresholds).drop("vol_id")


def affinity_segmentation(channels: DataFrame, threshold: float = 0.5, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """(lin, component) of a dense volume (z, y, x, lin, ch) of logits: sigmoids of the first three channels over the
    threshold, as affinities along the axes. With ``shape``, places that have no row are voxels with no affinity set."""
    flags = {f"a{a}": scaled_sigmoid(F.get("ch", F.lit(i))) > threshold for i, a in enumerate(AXES)}
    rows = channels.select(*AXES, "lin", *(c.alias(k) for k, c in flags.items()))
    return grid_graph.hard_affinity_components(rows, tuple(flags), shape)


def clean(labels: DataFrame, shape: tuple[int, int, int], min_size: int = 200, largest: int | None = None, cleanup: bool = False) -> DataFrame:
    """(z, y, x, label) over zero after the size filter, the choice of the largest and, if asked for, opening and closing
    of the mask, whose components over all 26 neighbours are the instances from there on."""
    found = datasets.postprocess(labels, min_size, largest).where("label > 0").select(*AXES, "label")
    if not cleanup:
        return found
    mask = materialise(morphology.open_close(found.select(*AXES), shape), "cleaned")
    parts = grid_graph.mask_components(mask.withColumn("lin", _raster(shape)), grid_graph.FULL)
    return parts.select(*_at(shape), F.col("component").alias("label"))


def infer_volumes(voxels: DataFrame, shape: tuple[int, int, int], small: int, model: Callable, overlap: bool = True) -> DataFrame:
    """Tiled predictions (vol_id, z, y, x, val) of volumes of one shape; a tile of a volume is a group."""
    return tiles.infer(voxels, shape, small, model, overlap, ("vol_id",))


def skeleton_report(nodes: DataFrame, edges: DataFrame, ignored: tuple[int, ...] = (5, 20, 100)) -> DataFrame:
    """All scores of a segmentation against skeletons in one row: information, run lengths, mergers, splits, and run
    lengths without mergers of at most each ignored size."""
    pairs = nodes.select(F.col("skel_id").alias("gt"), F.col("pred_id").alias("pred"))
    parts = [metrics.voi(metrics.contingency(pairs)), skeleton.expected_run_length(skeleton.classify(edges, nodes)), skeleton.merge_split_counts(nodes)]
    if ignored:
        by = skeleton.expected_run_length(skeleton.classify_sizes(edges, nodes, ignored), ["ignored"])
        parts.append(by.agg(*(F.max(F.when(F.col("ignored") == float(n), F.col("nerl"))).alias(f"nerl_{n}") for n in ignored)))
    out = parts[0].withColumn("_k", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def filter_remap(labels: DataFrame, min_size: int) -> DataFrame:
    """Counters of a filter by size for each volume, as ``instances.filter_remap_stats`` has them for one."""
    found = labels.where("label > 0").groupBy("vol_id", "label").agg(F.count("*").alias("size"))
    keep, size = F.col("size") >= min_size, F.col("size")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.groupBy("vol_id").agg(
        F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"), F.count_if(~keep).alias("n_removed"),
        total(size).alias("voxels_before"), total(F.when(keep, size)).alias("voxels_after"), total(F.when(~keep, size)).alias("voxels_removed"),
    )
