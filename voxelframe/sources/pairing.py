"""Pairing of prediction and truth files by keys in their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.scalar import case_id


def by_id(preds: DataFrame, gts: DataFrame, pattern: str = r"RibFrac(\d+)") -> DataFrame:
    """(pred, gt) of equal ids."""
    left = preds.select("pred", case_id(F.col("pred"), pattern).alias("id"))
    return left.join(gts.select("gt", case_id(F.col("gt"), pattern).alias("id")), "id").select("pred", "gt")


def unmatched(preds: DataFrame, gts: DataFrame, pattern: str = r"RibFrac(\d+)") -> DataFrame:
    left = preds.select("pred", case_id(F.col("pred"), pattern).alias("id"))
    return left.join(gts.select(case_id(F.col("gt"), pattern).alias("id")), "id", "left_anti").select("pred")


def stem(name: Column) -> Column:
    """The name without directory and suffixes."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(\.nii)?\.[A-Za-z0-9]+$", "")


#: Marks that names of predictions and truths carry (fixed values).
PRED_MARKS = ("pred_", "prediction_", "refined_")
GT_MARKS = ("gt_", "ground_truth_", "-rib-seg")


def without_marks(name: Column, marks: tuple[str, ...]) -> Column:
    for mark in marks:
        name = F.replace(name, F.lit(mark), F.lit(""))
    return name


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(pred, gt) where the name of ``inner`` (i) lies within that of ``outer`` (o).

    An equi-join on whole names: outer names are cut into their substrings of those lengths that inner names have, so a
    part that all names share joins nothing. Empty names lie within none. The substrings are many times what their file
    lets Spark expect, so they meet the names by a shuffle; a broadcast would go through the driver.
    """
    inner = inner.where("i <> ''")
    sizes = [r[0] for r in inner.select(F.length("i").alias("n")).distinct().collect()]  # at most the longest name
    each = F.explode(F.array(*(F.lit(n) for n in sorted(sizes))).cast("array<int>")).alias("_n")
    cut = outer.select("*", each).where(F.length("o") >= F.col("_n"))
    cut = cut.withColumn("i", F.explode(F.expr("transform(sequence(1, length(o) - _n + 1), k -> substring(o, k, _n))"))).drop("o", "_n")
    return inner.hint("merge").join(cut.distinct(), "i").drop("i")


def with_priority(preds: DataFrame, gts: DataFrame, pattern: str = r"RibFrac(\d+)") -> DataFrame:
    """(pred, gt, rule): the first rule with a hit wins, then the first name: equal id (1), equal stem (2), one stem inside
    the other, with or without the inner one's marks (3). Rule 3 is only tried for predictions that the others leave."""
    left = preds.select("pred", case_id(F.col("pred"), pattern).alias("id"), stem(F.col("pred")).alias("stem"))
    right = gts.select("gt", case_id(F.col("gt"), pattern).alias("id"), stem(F.col("gt")).alias("stem"))
    one = left.join(right.select("gt", "id").hint("merge"), "id").select("pred", "gt", F.lit(1).alias("rule"))
    two = left.join(right.select("gt", "stem").hint("merge"), "stem").select("pred", "gt", F.lit(2).alias("rule"))
    rest = left.join(one.unionByName(two).select("pred").hint("merge"), "pred", "left_anti")
    names = lambda marks: F.explode(F.array_distinct(F.array("stem", without_marks(F.col("stem"), marks)))).alias("i")
    ahead = contained(rest.select("pred", names(PRED_MARKS)), right.select("gt", F.col("stem").alias("o")))
    behind = contained(right.select("gt", names(GT_MARKS)), rest.select("pred", F.col("stem").alias("o")))
    three = ahead.select("pred", "gt").unionByName(behind.select("pred", "gt")).distinct()
    every = one.unionByName(two).unionByName(three.withColumn("rule", F.lit(3)))
    best = every.groupBy("pred").agg(F.min(F.struct("rule", "gt")).alias("b"))
    return best.select("pred", F.col("b.gt").alias("gt"), F.col("b.rule").cast("long").alias("rule"))


def left_with_truth(preds: DataFrame, gts: DataFrame, pattern: str = r"RibFrac(\d+)") -> DataFrame:
    left = preds.select("pred", case_id(F.col("pred"), pattern).alias("id"))
    return left.join(gts.select("gt", case_id(F.col("gt"), pattern).alias("id")), "id", "left").select("pred", "gt")


def first_existing(samples: DataFrame, files: DataFrame, candidates: list[str]) -> DataFrame:
    """(sample, path, rule): the first of the name templates (``{}`` is the sample) that exists."""
    made = F.array(*(F.struct(F.lit(k).alias("rule"), F.concat(F.lit(t.split("{}")[0]), "sample", F.lit(t.split("{}")[1])).alias("path")) for k, t in enumerate(candidates)))
    rows = samples.select("sample", F.explode(made).alias("c")).select("sample", "c.rule", "c.path").join(files, "path", "left_semi")
    order = Window.partitionBy("sample").orderBy("rule")
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("sample", "path", F.col("rule").cast("long").alias("rule"))


def not_done(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (pred, id) whose output id does not exist yet."""
    return inputs.join(outputs.select("id"), "id", "left_anti").select("pred")


def resolution(names: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(name, resolution) from the first table that has the name."""
    a = first.select("name", F.col("resolution").alias("_a"))
    b = second.select("name", F.col("resolution").alias("_b"))
    return names.join(a, "name", "left").join(b, "name", "left").select("name", F.coalesce("_a", "_b").alias("resolution"))
