"""Scalar column functions on voxel values and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top, bottom, empty: float = 0.0) -> Column:
    """``top / bottom`` as a double, ``empty`` where the bottom is zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(empty))


def scaled_sigmoid(x: Column, scale: float = 0.2) -> Column:
    return 1.0 / (1.0 + F.exp(-F.lit(scale) * x.cast("double")))


def channels(ch: Column, keep: str | list[int]) -> Column:
    """Channels by name (``all``, ``affinity``: the first three, ``skeleton``: the last) or by index; indices that do
    not exist are left out, negative ones count from the end."""
    if keep == "all":
        return ch
    if keep == "affinity":
        return F.slice(ch, 1, 3)
    if keep == "skeleton":
        return F.slice(ch, -1, 1)
    picked = F.array(*(F.get(ch, F.lit(i) if i >= 0 else F.size(ch) + i) for i in keep))
    return F.filter(picked, lambda v: v.isNotNull())


def region_mask(value: Column) -> Column:
    return F.coalesce(value > 0, F.lit(True))


def masked_label(label: Column, mask: Column) -> Column:
    """Labels outside the mask are unlabelled (-1)."""
    return F.when(mask, label).otherwise(F.lit(-1)).cast("long")


def case_id(name: Column, pattern: str = r"RibFrac(\d+)") -> Column:
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found)
