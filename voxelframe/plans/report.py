"""Reports: per-case tables with a summary row, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_report(dice: DataFrame, case: str) -> DataFrame:
    """A summary row (label_id null) and a row for each label; one pass by grouping sets."""
    flag = F.col("matched").cast("long")
    rows = dice.select("gt", "dice", flag.alias("m")).rollup("gt").agg(F.avg("dice").alias("dice"), F.sum("m").alias("matched"), F.count("*").alias("n"), F.grouping("gt").alias("g"))
    top = F.col("g") == 1
    return rows.select(
        F.lit(case).alias("case_name"),
        F.col("gt").alias("label_id"),
        "dice",
        "matched",
        F.when(top, F.col("n")).alias("total_gt_labels"),
        F.when(top, F.col("matched") / F.greatest(F.col("n"), F.lit(1))).alias("match_rate"),
    )


def batch_report(cases: DataFrame) -> DataFrame:
    """One row a file with its match rate; ``cases`` has case_name, dice, matched, total_gt_labels, error."""
    return cases.withColumn("match_rate", F.col("matched") / F.greatest(F.col("total_gt_labels"), F.lit(1)))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def read_average_dice(spark, path: str) -> DataFrame:
    """(path, average_dice) from text reports with an ``Average Dice:`` line."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_extract("value", r"Average Dice:\s*([0-9.]+)", 1).alias("v"))
    return lines.where("v <> ''").select("path", F.col("v").cast("double").alias("average_dice"))
