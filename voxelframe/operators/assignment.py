"""Optimal one-to-one assignment of predicted to true labels, on the sparse graph of their overlaps."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components


def best_pairs(weights: dict[int, dict[int, float]]) -> list[tuple[int, int]]:
    """The pairs (row, column) of a one-to-one choice of the largest sum of positive weights, given by row and column.

    Rows are added one at a time by a shortest augmenting path over reduced costs, which ends at the nearest free column
    or at a row that is better left alone. Memory follows the overlaps, not rows times columns, and a search looks only
    at what lies nearer than its end.
    """
    row_of: dict[int, int] = {}
    column_of: dict[int, int] = {}
    u: dict[int, float] = {}
    v: dict[int, float] = defaultdict(float)
    for start in sorted(weights):
        u[start] = min([0.0, *(-w - v[j] for j, w in weights[start].items())])
        at_row, at_column, before, done = {start: 0.0}, {}, {}, set()
        # Places: (distance, 0, row) is that row left alone, (distance, 1, column) a column.
        queue = [(-u[start], 0, start)]
        row = start
        while True:
            near = at_row[row]
            for j, w in weights[row].items():
                d = near - w - u[row] - v[j]
                if j not in done and d < at_column.get(j, float("inf")):
                    at_column[j], before[j] = d, row
                    heapq.heappush(queue, (d, 1, j))
            end, kind, place = heapq.heappop(queue)
            while kind and place in done:
                end, kind, place = heapq.heappop(queue)
            if not kind or place not in row_of:
                break
            done.add(place)
            row = row_of[place]
            at_row[row] = end
            heapq.heappush(queue, (end - u[row], 0, row))
        for i, d in at_row.items():
            u[i] += end - d
        for j in done:
            v[j] += at_column[j] - end
        # The last row takes the free column, or stays alone and gives its own to the row before it.
        if kind:
            column, row = place, before[place]
        else:
            row, column = place, None
        while True:
            freed = column_of.pop(row, None)
            if column is not None:
                column_of[row], row_of[column] = column, row
            if row == start:
                break
            column, row = freed, before[freed]
    return sorted(column_of.items())


def assign(iou: DataFrame) -> DataFrame:
    """The 1-1 pairs (gt, pred, iou > 0) of the largest total IoU.

    Labels that overlap nothing in common are independent, so each connected block of the overlap graph is a group of
    its own: its overlaps, a few for each label that it chains together.
    """
    edges = iou.select((F.col("gt") * 2).alias("src"), (F.col("pred") * 2 + 1).alias("dst"))
    blocks = connected_components(edges).where("node % 2 = 0").select((F.expr("node div 2")).alias("gt"), "component")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        weights: dict[int, dict[int, float]] = defaultdict(dict)
        for gt, pred, w in zip(frame["gt"].tolist(), frame["pred"].tolist(), frame["iou"].tolist(), strict=True):
            if w > 0:
                weights[gt][pred] = w
        return pd.DataFrame([(g, p, weights[g][p]) for g, p in best_pairs(weights)], columns=["gt", "pred", "iou"])

    return iou.join(blocks, "gt").select("component", "gt", "pred", "iou").groupBy("component").applyInPandas(run, "gt long, pred long, iou double")
