"""Threshold sweeps: decode at each threshold, score, keep the best."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, skeleton


def sweep_thresholds() -> list[float]:
    """The sigmoid of 0.2 i for i = -1..11, to four places."""
    return [round(1 / (1 + math.exp(-0.2 * i)), 4) for i in range(-1, 12)]


def sweep(nodes: DataFrame, edges: DataFrame, segment: Callable[[float], Column], thresholds: list[float], ignored_size: float = 0) -> DataFrame:
    """(thr, nerl, voi, n_non0_mergers) for the segmentation that ``segment(threshold)`` gives the nodes.

    The thresholds are rows of one plan: every node has a segment at each, and each score is grouped by thr.
    """
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("thr"), segment(t).alias("pred_id")) for t in thresholds)))
    one = nodes.withColumn("_at", each).drop("pred_id").select("*", "_at.thr", "_at.pred_id").drop("_at")
    by = ["thr"]
    runs = skeleton.expected_run_length(skeleton.classify(edges, one, ignored_size, by), by).select("thr", "nerl")
    pairs = one.select("thr", F.col("skel_id").alias("gt"), F.col("pred_id").alias("pred"))
    voi = metrics.voi(metrics.contingency(pairs, by), by).select("thr", F.col("voi_sum").alias("voi"))
    merged = skeleton.merging(one, ignored_size, by).groupBy("thr").agg(F.count_if(F.col("pred_id") != 0).alias("n_non0_mergers"))
    rows = runs.join(voi, "thr").join(merged, "thr", "left")
    return rows.select("thr", "nerl", "voi", F.coalesce("n_non0_mergers", F.lit(0)).cast("long").alias("n_non0_mergers"))


def best_thresholds(nodes: DataFrame, edges: DataFrame, segment: Callable[[float], Column], thresholds: list[float]) -> DataFrame:
    """The best run length (the first threshold wins ties), the best information, and the best without mergers."""
    rows = sweep(nodes, edges, segment, thresholds)
    clean = F.col("n_non0_mergers") == 0
    # Ties to nine places go to the smaller threshold.
    first = lambda ok: F.min(F.when(ok, F.struct((-F.round("nerl", 9)).alias("k"), F.col("thr").alias("thr"))))["thr"]
    return rows.agg(
        F.max("nerl").alias("best_nerl"),
        first(F.lit(True)).alias("best_thr"),
        F.min("voi").alias("best_voi"),
        F.max(F.when(clean, F.col("nerl"))).alias("best_nerl_no_merge"),
        first(clean).alias("best_thr_no_merge"),
    )
