"""Scores of a predicted label table against the true one, all from the table of overlapping label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.scalar import ratio


def exclude_unlabelled(pairs: DataFrame) -> DataFrame:
    """Voxels whose truth is unlabelled (negative) count as background on both sides."""
    out = F.col("gt") < 0
    return pairs.withColumns({"gt": F.when(out, F.lit(0)).otherwise(F.col("gt")).cast("long"), "pred": F.when(out, F.lit(0)).otherwise(F.col("pred")).cast("long")})


def contingency(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overlap counts n of (gt, pred), one shuffle with partial counts."""
    return pairs.groupBy(*(by or []), "gt", "pred").agg(F.count("*").alias("n"))


def pair_iou(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Label pairs over zero with areas and IoU. Areas count voxels against background too."""
    by = by or []
    gt = table.where("gt > 0").groupBy(*by, "gt").agg(F.sum("n").alias("gt_area"))
    pred = table.where("pred > 0").groupBy(*by, "pred").agg(F.sum("n").alias("pred_area"))
    both = table.where("gt > 0 and pred > 0").join(gt, [*by, "gt"]).join(pred, [*by, "pred"])
    iou = F.col("n") / (F.col("gt_area") + F.col("pred_area") - F.col("n"))
    return both.select(*by, "gt", "pred", "n", "gt_area", "pred_area", iou.alias("iou"))


def label_counts(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    true = F.count_distinct(F.when(F.col("gt") > 0, F.col("gt"))).alias("n_true")
    pred = F.count_distinct(F.when(F.col("pred") > 0, F.col("pred"))).alias("n_pred")
    return table.groupBy(*by).agg(true, pred)


def instance_metrics(table: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """Precision, recall and the other scores at each IoU threshold (inclusive); every pair that reaches it counts, so
    below 0.5 a label can match twice and fn or fp can be negative."""
    by = by or []
    iou = pair_iou(table, by)
    cuts = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("thresh")
    hit = F.col("iou") >= F.col("thresh")
    matched = iou.select("*", cuts).groupBy(*by, "thresh").agg(F.count_if(hit).alias("tp"), F.avg(F.when(hit, F.col("iou"))).alias("mean_matched_score"))
    best = iou.groupBy(*by, "gt").agg(F.max("iou").alias("best"), F.sum("iou").alias("total"))
    best = best.groupBy(*by).agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    base = label_counts(table, by).select("*", cuts)
    if by:
        joined = base.join(matched, [*by, "thresh"], "left").join(best, by, "left")
    else:
        joined = base.join(matched, ["thresh"], "left").withColumn("_one", F.lit(1)).join(best.withColumn("_one", F.lit(1)), "_one", "left")
    tp = F.coalesce("tp", F.lit(0)).cast("long")
    rows = joined.withColumn("tp", tp).withColumn("fp", F.col("n_pred") - tp).withColumn("fn", F.col("n_true") - tp)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select(
        *by,
        F.lit("iou").alias("criterion"),
        "thresh",
        "tp",
        "fp",
        "fn",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("accuracy"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "n_true",
        "n_pred",
        F.coalesce(ratio(F.col("best"), F.col("n_true")), F.lit(0.0)).alias("mean_true_score_best"),
        F.coalesce(ratio(F.col("total"), F.col("n_true") * F.col("n_pred")), F.lit(0.0)).alias("mean_true_score_matrix"),
        F.coalesce("mean_matched_score", F.lit(0.0)).alias("mean_matched_score"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2).alias("panoptic_quality"),
    )


def best_match(iou: DataFrame) -> DataFrame:
    """The prediction with the largest IoU of each true label; ties go to the smaller prediction."""
    order = Window.partitionBy("gt").orderBy(F.desc("iou"), "pred")
    return iou.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("gt", "pred", "iou")


def dice_table(table: DataFrame, matches: DataFrame) -> DataFrame:
    """Dice of every true label under 1-1 ``matches`` (gt, pred, n, gt_area, pred_area); 0 where unmatched."""
    labels = table.where("gt > 0").select("gt").distinct()
    dice = ratio(2 * F.col("n"), F.col("gt_area") + F.col("pred_area"))
    joined = labels.join(matches.select("gt", dice.alias("dice")), "gt", "left")
    return joined.select("gt", F.coalesce("dice", F.lit(0.0)).alias("dice"), F.coalesce(F.col("dice") > 0, F.lit(False)).alias("matched"))


def sure_matches(iou: DataFrame) -> DataFrame:
    """Pairs over one half, which are always 1-1: no assignment is needed."""
    return iou.where("iou > 0.5")


def spread(value: str, prefix: str = "") -> list[Column]:
    """Mean, population deviation, extremes and median of a column."""
    v = F.col(value)
    made = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.median(v)}
    return [c.alias(f"{prefix}{k}") for k, c in made.items()]


def binary_metrics(rows: DataFrame, true: Column, pred: Column) -> DataFrame:
    """Counts and scores of two boolean columns; accuracy leaves out true negatives."""
    counts = rows.agg(F.count_if(true & pred).alias("tp"), F.count_if(~true & pred).alias("fp"), F.count_if(true & ~pred).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")).alias("accuracy"))


def voi(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Variation of information in bits, nothing excluded: split = H(pred | gt), merge = H(gt | pred)."""
    by = by or []
    gt = table.groupBy(*by, "gt").agg(F.sum("n").alias("a"))
    pred = table.groupBy(*by, "pred").agg(F.sum("n").alias("b"))
    joined = table.join(gt.hint("merge"), [*by, "gt"]).join(pred.hint("merge"), [*by, "pred"])
    total = F.sum("n")
    split = -F.sum(F.col("n") * F.log2(F.col("n") / F.col("a"))) / total
    merge = -F.sum(F.col("n") * F.log2(F.col("n") / F.col("b"))) / total
    return joined.groupBy(*by).agg(split.alias("voi_split"), merge.alias("voi_merge"), (split + merge).alias("voi_sum"))


def micro_macro(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Totals with their scores, and mean, population deviation and extremes of each file's scores."""
    totals = [F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    macro = [c for s in scores for c in spread(s, f"{s}_")[:4]]
    found = rows.agg(F.count("*").alias("n_files"), *totals, *macro)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return found.select("*", p.alias("micro_precision"), r.alias("micro_recall"), ratio(2 * p * r, p + r).alias("micro_f1"))
