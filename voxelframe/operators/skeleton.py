"""Skeleton graphs against a segmentation: edge classes, run lengths, mergers and splits.

Tables that grow with the nodes are joined by shuffles: what a row gives for many segmentations is more than its size on
disk lets Spark expect, and a broadcast of it would go through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.functions.scalar import ratio


By = Sequence[str]


def with_segments(edges: DataFrame, nodes: DataFrame, by: By = ()) -> DataFrame:
    """Edges (skel_id, u, v, edge_length) with the predicted segments of both ends, of each segmentation ``by``."""
    pred = nodes.select("node_id", "pred_id", *by).hint("merge")
    out = edges.join(pred.select(F.col("node_id").alias("u"), F.col("pred_id").alias("pu"), *by), "u")
    return out.join(pred.select(F.col("node_id").alias("v"), F.col("pred_id").alias("pv"), *by), ["v", *by])


def pair_sizes(nodes: DataFrame, by: By = ()) -> DataFrame:
    """Nodes n of each pair (skel_id, pred_id)."""
    return nodes.groupBy(*by, "skel_id", "pred_id").agg(F.count("*").alias("n"))


def merging_pairs(pairs: DataFrame, by: By = ()) -> DataFrame:
    """Those of the pairs (skel_id, pred_id) whose segment is in several."""
    many = pairs.groupBy(*by, "pred_id").agg(F.count("*").alias("k")).where("k > 1").select(*by, "pred_id")
    return pairs.join(many.hint("merge"), [*by, "pred_id"]).select(*by, "skel_id", "pred_id")


def merging(nodes: DataFrame, ignored_size: float, by: By = ()) -> DataFrame:
    """(skel_id, pred_id) pairs over the ignored size whose segment covers more than one skeleton."""
    return merging_pairs(pair_sizes(nodes, by).where(F.col("n") > float(ignored_size)), by)


def _classes(rows: DataFrame, found: DataFrame, by: By) -> DataFrame:
    skeletons = found.select(*by, "skel_id").distinct().withColumn("_s", F.lit(True))
    segments = found.select(*by, F.col("pred_id").alias("pu")).distinct().withColumn("_m", F.lit(True))
    rows = rows.join(skeletons.hint("merge"), [*by, "skel_id"], "left").join(segments.hint("merge"), [*by, "pu"], "left")
    kind = (
        F.when((F.col("pu") == 0) | (F.col("pv") == 0), "omitted")
        .when(F.col("pu") != F.col("pv"), "split")
        .when(F.col("_s").isNotNull() & F.col("_m").isNotNull(), "merged")
        .otherwise("correct")
    )
    return rows.select(*by, "skel_id", "u", "v", "edge_length", F.col("pu").alias("segment"), kind.alias("kind"))


def classify(edges: DataFrame, nodes: DataFrame, ignored_size: float = 0, by: By = ()) -> DataFrame:
    """Edges with their class: omitted, split, merged or correct, in this order. The merged test asks for a merged
    skeleton and a merging segment independently of each other. ``by`` names columns of ``nodes`` that tell several
    segmentations apart, all classified in one plan."""
    return _classes(with_segments(edges, nodes, by), merging(nodes, ignored_size, by), by)


def classify_sizes(edges: DataFrame, nodes: DataFrame, ignored_sizes: Sequence[float]) -> DataFrame:
    """``classify`` for each ignored size (column ignored) in one plan: the sizes meet counted pairs and joined edges."""
    each = lambda: F.explode(F.array(*(F.lit(float(s)) for s in ignored_sizes)))
    pairs = pair_sizes(nodes).withColumn("ignored", each()).where("n > ignored")
    return _classes(with_segments(edges, nodes).withColumn("ignored", each()), merging_pairs(pairs, ["ignored"]), ["ignored"])


def expected_run_length(classified: DataFrame, by: By = ()) -> DataFrame:
    """erl = sum of squared correct lengths by (skeleton, segment) over the total length; max_erl likewise over whole
    skeletons; nerl is their ratio."""
    runs = classified.groupBy(*by, "skel_id", "segment").agg(F.sum("edge_length").alias("all"), F.sum(F.when(F.col("kind") == "correct", F.col("edge_length")).otherwise(0.0)).alias("ok"))
    each = runs.groupBy(*by, "skel_id").agg(F.sum("all").alias("length"), F.sum(F.col("ok") * F.col("ok")).alias("square"))
    total = each.groupBy(*by).agg(F.sum("length").alias("l"), F.sum("square").alias("s"), F.sum(F.col("length") * F.col("length")).alias("m"))
    erl, best = ratio(F.col("s"), F.col("l")), ratio(F.col("m"), F.col("l"))
    return total.select(*by, erl.alias("erl"), best.alias("max_erl"), ratio(erl, best).alias("nerl"))


def merge_split_counts(nodes: DataFrame, ignored_size: float = 0) -> DataFrame:
    """Merging (segment, skeleton) pairs, those without segment 0, and pairs beyond each skeleton's first segment."""
    merged = merging(nodes, ignored_size).agg(F.count("*").alias("n_mergers"), F.count_if(F.col("pred_id") != 0).alias("n_non0_mergers"))
    parts = nodes.where("pred_id <> 0").groupBy("skel_id").agg(F.count_distinct("pred_id").alias("k"))
    split = parts.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("n_splits"))
    return merged.withColumn("_k", F.lit(1)).join(split.withColumn("_k", F.lit(1)), "_k").drop("_k")


def lengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("skel_id").agg(F.sum("edge_length").alias("length"))
