"""Dense volumes as rows (z, y, x, value): grids, alignment, resizing, axes, masks and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def grid(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    """All coordinates of a shape, generated in parallel from one range."""
    z, y, x = shape
    lin = F.col("id")
    rows = spark.range(z * y * x)
    return rows.select((F.expr(f"id div {y * x}")).alias("z"), (F.expr(f"(id div {x}) % {y}")).alias("y"), (lin % x).alias("x"))


def _on_grid(voxels: DataFrame, shape, fill, value: str) -> DataFrame:
    full = grid(voxels.sparkSession, shape).join(voxels.select(*AXES, value), list(AXES), "left")
    return full.select(*AXES, F.coalesce(value, F.lit(fill)).alias(value))


def align(voxels: DataFrame, shape: tuple[int, int, int], fill: float = 0, value: str = "val") -> DataFrame:
    """Crop to and pad up to ``shape`` at the origin."""
    inside = voxels.where(" and ".join(f"{a} < {n}" for a, n in zip(AXES, shape, strict=True)))
    return _on_grid(inside, shape, fill, value)


def center_pad(voxels: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], fill: float = -1, value: str = "val", crop: bool = False) -> DataFrame:
    """Shift a smaller volume to the middle of ``target`` and fill around it. A target smaller on an axis is an error, or
    with ``crop`` gets the middle of that axis."""
    if not crop and any(t < n for n, t in zip(shape, target, strict=True)):
        raise ValueError(f"a volume of {tuple(shape)} does not fit into {tuple(target)}")
    before = [(t - n) // 2 if t >= n else -((n - t) // 2) for n, t in zip(shape, target, strict=True)]
    moved = voxels.select(*((F.col(a) + b).alias(a) for a, b in zip(AXES, before, strict=True)), value)
    inside = moved.where(" and ".join(f"{a} >= 0 and {a} < {t}" for a, t in zip(AXES, target, strict=True)))
    return _on_grid(inside, target, fill, value)


def pad_min(voxels: DataFrame, shape: tuple[int, int, int], patch: int, value: str = "val") -> DataFrame:
    """Pad with zeros up to at least the patch size."""
    return _on_grid(voxels, tuple(max(n, patch) for n in shape), 0, value)


def resize_nearest(voxels: DataFrame, shape: tuple[int, int, int], target: tuple[int, int, int], value: str = "val") -> DataFrame:
    """Nearest neighbour: target index i reads round-half-up(i * (n - 1) / (m - 1)) of an axis of n."""
    rows = grid(voxels.sparkSession, target)
    for a, n, m in zip(AXES, shape, target, strict=True):
        source = F.floor(F.col(a) * ((n - 1) / (m - 1)) + 0.5) if m > 1 else F.lit(0)
        rows = rows.withColumn(f"s{a}", source.cast("long"))
    return rows.join(voxels.select(*(F.col(a).alias(f"s{a}") for a in AXES), value), [f"s{a}" for a in AXES]).select(*AXES, value)


def transpose(voxels: DataFrame, order: tuple[int, int, int] = (2, 1, 0), value: str = "val") -> DataFrame:
    """New axis k is old axis ``order[k]``: a rename, no shuffle."""
    return voxels.select(*(F.col(AXES[o]).alias(a) for a, o in zip(AXES, order, strict=True)), value)


def flip_rotate(voxels: DataFrame, shape: tuple[int, int, int], flips: tuple[str, ...] = (), quarter_turns: int = 0, value: str = "val") -> DataFrame:
    """Mirror axes, then turn the (y, x) plane by quarters."""
    size = dict(zip(AXES, shape, strict=True))
    at = {a: (size[a] - 1 - F.col(a)) if a in flips else F.col(a) for a in AXES}
    ny, nx = size["y"], size["x"]
    for _ in range(quarter_turns % 4):
        at["y"], at["x"] = nx - 1 - at["x"], at["y"]
        ny, nx = nx, ny
    return voxels.select(*(at[a].alias(a) for a in AXES), value)


def threshold_count(voxels: DataFrame, threshold: Column, value: str = "val") -> DataFrame:
    return voxels.agg(F.count_if(F.col(value) > threshold).alias("n_foreground"))


def adaptive_threshold(voxels: DataFrame, threshold: float, value: str = "val") -> DataFrame:
    """Strict threshold; where nothing passes, half of it. One pass for both counts."""
    t = F.lit(threshold).cast("float")
    half = F.lit(threshold * 0.5).cast("float")
    both = voxels.agg(F.count_if(F.col(value) > t).alias("a"), F.count_if(F.col(value) > half).alias("b"))
    none = F.col("a") == 0
    return both.select(F.when(none, F.col("b")).otherwise(F.col("a")).alias("n_foreground"), F.when(none, F.lit(threshold * 0.5)).otherwise(F.lit(threshold)).alias("thr_used"))


def to_uint8(voxels: DataFrame, value: str = "val") -> DataFrame:
    """A channel as 0..255: all non-finite gives 0, [0, 1] is scaled, [-1, 1] shifted, others stretched; truncated."""
    v = F.col(value).cast("double")
    finite = ~(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")))
    ends = voxels.agg(F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi")).first()
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        scaled = F.lit(0.0)
    elif lo >= 0 and hi <= 1:
        scaled = v * 255
    elif lo >= -1 and hi <= 1:
        scaled = (v + 1) * 127.5
    else:
        scaled = (v - lo) / (hi - lo + 1e-8) * 255
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.when(finite, scaled).otherwise(F.lit(0.0))))
    return voxels.select(*AXES, F.floor(clipped).cast("int").alias("u8"))
