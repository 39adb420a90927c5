"""Datasets of volumes: pairing voxels, masks, patches, seeded draws and augmentations, and statistics of batches.

Draws are functions of a seed and the keys of a row (``uniform``), so a lost task draws the same again and no two tasks
need to share a generator.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .instances import apply_map, filter_small, keep_largest, relabel_dense, sizes
from .volume import AXES


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) of a seed and the keys of a row."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number of a seed and the keys of a row, by two uniform ones."""
    u, v = uniform(seed, *keys, F.lit("u")), uniform(seed, *keys, F.lit("v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


# --- joins ---------------------------------------------------------------------------------------------------------


def pair_voxels(gt: DataFrame, pred: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(gt, pred) of each place that both label volumes hold; ``by`` names keys of volumes, if there are several."""
    keys = [*by, *AXES]
    return gt.select(*keys, F.col("label").alias("gt")).join(pred.select(*keys, F.col("label").alias("pred")), keys).select(*by, "gt", "pred")


def node_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Skeleton nodes (with z, y, x) and pred_id, the label at their whole position; 0 outside of the volume."""
    at = nodes.withColumns({a: F.floor(a).cast("long") for a in AXES})
    found = labels.select(*AXES, F.col("label").alias("pred_id"))
    return at.join(found, list(AXES), "left").withColumn("pred_id", F.coalesce("pred_id", F.lit(0)).cast("long"))


def masked_instances(mask: DataFrame, instances: DataFrame) -> DataFrame:
    """(z, y, x, label) of the places whose mask is set and that the coarse instances hold."""
    return mask.where("val > 0").select(*AXES).join(instances.where("label > 0").select(*AXES, "label"), list(AXES))


# --- values --------------------------------------------------------------------------------------------------------


def multiply_mask(voxels: DataFrame, mask: Column, value: str = "val") -> DataFrame:
    return voxels.withColumn(value, F.when(mask, F.col(value)).otherwise(F.lit(0).cast(voxels.schema[value].dataType)))


def divide(voxels: DataFrame, divisor: float = 255.0, value: str = "val") -> DataFrame:
    return voxels.withColumn(value, F.col(value).cast("double") / F.lit(float(divisor)))


def channels_first(voxels: DataFrame, channels: str = "ch") -> DataFrame:
    """An array of channels at each place as rows (c, ..., val): the channel axis moved to the front."""
    rest = [c for c in voxels.columns if c != channels]
    return voxels.select(*rest, F.posexplode(channels).alias("c", "val")).select(F.col("c").cast("long").alias("c"), *rest, "val")


def binary_mask(voxels: DataFrame, value: str = "val") -> DataFrame:
    """A mask of 0 and 1: with more than two values all over 1 count as 1, otherwise as 0."""
    few = voxels.select(value).distinct().limit(3).count() <= 2
    return voxels.withColumn(value, F.when(F.col(value) > 1, F.lit(0 if few else 1)).otherwise(F.col(value)).cast("long"))


# --- patches -------------------------------------------------------------------------------------------------------


def draw_range(size: int, patch: int, offset: int, divisor: int) -> tuple[int, int]:
    """First and last start of a patch along an axis, both inclusive: patches reach into the border by a share of it."""
    reach = patch // divisor
    least = offset - min(math.ceil(patch / divisor), offset)
    return least, size - patch - offset + min(offset, reach)


def patch_starts(draws: DataFrame, shape: tuple[int, int, int], patch: int, offset: int = 0, divisor: int = 2, seed: int = 0) -> DataFrame:
    """A start (z0, y0, x0) for each row of ``draws`` (draw)."""
    made = []
    for a, n in zip(AXES, shape, strict=True):
        first, last = draw_range(n, patch, offset, divisor)
        if last < first:
            raise ValueError(f"no patch of {patch} fits into {n} along {a}")
        made.append((first + F.floor(uniform(seed, F.col("draw"), F.lit(a)) * (last - first + 1))).cast("long").alias(f"{a}0"))
    return draws.select("draw", *made)


def crop(voxels: DataFrame, start: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """The places of a box, counted from its start: a filter that reaches the scan."""
    inside = F.lit(True)
    for a, s, n in zip(AXES, start, size, strict=True):
        inside = inside & F.col(a).between(s, s + n - 1)
    return voxels.where(inside).withColumns({a: F.col(a) - s for a, s in zip(AXES, start, strict=True)})


# --- choices among datasets ----------------------------------------------------------------------------------------


def choose_weighted(draws: DataFrame, weights: list[float], seed: int = 0) -> DataFrame:
    """The dataset (0-based) of each draw, with the chances of ``weights``."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be nonnegative and have a positive sum")
    u, chosen, total = uniform(seed, F.col("draw")), F.lit(len(weights) - 1), 0.0
    ends = []
    for w in weights:
        total += w / sum(weights)
        ends.append(total)
    for k in reversed(range(len(weights) - 1)):
        chosen = F.when(u < ends[k], F.lit(k)).otherwise(chosen)
    return draws.withColumn("dataset", chosen.cast("long"))


def choose_synthetic(draws: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Whether each draw takes a synthetic sample, with chance ``ratio``."""
    return draws.withColumn("synthetic", uniform(seed, F.col("draw")) < ratio)


def loaders(manifest: DataFrame) -> DataFrame:
    """``manifest`` (dataset, sample) with role: every sample trains, the first of the first dataset validates as well."""
    first = manifest.agg(F.min(F.struct("dataset", "sample")).alias("f")).select("f.*").withColumn("role", F.lit("val"))
    return manifest.select("dataset", "sample", F.lit("train").alias("role")).unionByName(first.where("sample is not null"))


def allowed(samples: DataFrame, ids: list[str] | None = None, max_samples: int | None = None) -> DataFrame:
    """Samples in the order of their names: those of an allow-list, and at most ``max_samples``."""
    rows = samples if ids is None else samples.where(F.col("sample").isin(ids))
    rows = rows.orderBy("sample")
    return rows if max_samples is None else rows.limit(max_samples)


def matching(names: DataFrame, patterns: list[str], name: str = "name") -> DataFrame:
    """The union of the names that match any of the patterns, each once."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.col(name).rlike(p)
    return names.where(hit).select(name).distinct()


# --- augmentations -------------------------------------------------------------------------------------------------


def drop_slices(voxels: DataFrame, chance: float, seed: int = 0, axis: str = "z", value: str = "val") -> DataFrame:
    """Slices along ``axis`` are set to 0 with a chance."""
    return multiply_mask(voxels, uniform(seed, F.col(axis)) >= chance, value)


def shift_slices(voxels: DataFrame, shape: tuple[int, int, int], chance: float, most: int, seed: int = 0) -> DataFrame:
    """z slices are rolled by up to ``most`` places along y and x with a chance."""
    moved = uniform(seed, F.col("z"), F.lit("moved")) < chance
    out = voxels
    for a, n in zip(AXES[1:], shape[1:], strict=True):
        step = F.floor(uniform(seed, F.col("z"), F.lit(a)) * (2 * most + 1)).cast("long") - most
        out = out.withColumn(a, F.when(moved, F.pmod(F.col(a) + step, F.lit(n).cast("long"))).otherwise(F.col(a)))
    return out


def intensity(voxels: DataFrame, scale: float, shift: float, noise: float = 0.0, seed: int = 0, value: str = "val") -> DataFrame:
    """``value * scale + shift`` with normal noise at every place."""
    v = F.col(value).cast("double") * scale + shift
    return voxels.withColumn(value, v + noise * normal(seed, *(F.col(a) for a in AXES)) if noise else v)


def _draw(seed: int, name: str, *keys: Column) -> Column:
    """A number of the sample of a row (column draw)."""
    return uniform(seed, F.col("draw"), F.lit(name), *keys)


def orient(voxels: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Cubes (draw, z, y, x, ...) of ``size`` with their axes in any order, turned by any number of quarters in each of
    the three planes and mirrored along each axis with chance one half: a projection, whatever else a row holds."""
    orders = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    which = F.floor(_draw(seed, "order") * 6)
    # New axis k is old axis order[k].
    at = [F.element_at(F.array(*(F.col(AXES[o[k]]) for o in orders)), (which + 1).cast("int")) for k in range(3)]
    rows = voxels.select(*(c for c in voxels.columns if c not in AXES), *(c.alias(a) for c, a in zip(at, AXES, strict=True)))
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        turns, p, q = F.floor(_draw(seed, f"turn {a}{b}") * 4), F.col(a), F.col(b)
        first = F.when(turns == 1, size - 1 - q).when(turns == 2, size - 1 - p).when(turns == 3, q).otherwise(p)
        second = F.when(turns == 1, p).when(turns == 2, size - 1 - q).when(turns == 3, size - 1 - p).otherwise(q)
        rows = rows.withColumns({a: first, b: second})
    return rows.withColumns({a: F.when(_draw(seed, f"mirror {a}") < 0.5, size - 1 - F.col(a)).otherwise(F.col(a)) for a in AXES}).select(*voxels.columns)


def _axis(seed: int, name: str) -> Column:
    """One of the axes, by its number."""
    return F.floor(_draw(seed, f"{name} axis") * 3)


def _slice(seed: int, name: str) -> Column:
    return F.element_at(F.array(*AXES), (_axis(seed, name) + 1).cast("int"))


def drop_drawn(voxels: DataFrame, chance: float, seed: int = 0, value: str = "val") -> DataFrame:
    """In half of the samples (column draw) slices along one axis, drawn for the sample, are set to 0 with a chance."""
    gone = (_draw(seed, "drop") < 0.5) & (_draw(seed, "dropped", _slice(seed, "drop")) < chance)
    return multiply_mask(voxels, ~gone, value)


def shift_drawn(voxels: DataFrame, size: int, chance: float, most: int, seed: int = 0) -> DataFrame:
    """In half of the samples slices along one axis, drawn for the sample, are rolled with a chance by up to ``most``
    places along the two others. Of images alone: what else is at a place must be joined afterwards."""
    at = _slice(seed, "shift")
    moved = (_draw(seed, "shift") < 0.5) & (_draw(seed, "shifted", at) < chance)
    to = {}
    for k, a in enumerate(AXES):
        step = F.floor(_draw(seed, f"by {a}", at) * (2 * most + 1)).cast("long") - most
        to[a] = F.when(moved & (_axis(seed, "shift") != k), F.pmod(F.col(a) + step, F.lit(size).cast("long"))).otherwise(F.col(a))
    return voxels.withColumns(to)


def intensity_drawn(voxels: DataFrame, scale: float, shift: float, noise: float = 0.0, seed: int = 0, value: str = "val") -> DataFrame:
    """In half of the samples values times a factor within ``scale`` of 1 and plus a number within ``shift`` of 0; in half
    of them, drawn apart, normal noise of a strength up to ``noise``."""
    v = F.col(value).cast("double")
    between = lambda name, a, b: a + _draw(seed, name) * (b - a)
    v = F.when(_draw(seed, "intensity") < 0.5, v * between("scale", 1 - scale, 1 + scale) + between("add", -shift, shift)).otherwise(v)
    told = normal(seed, F.col("draw"), *(F.col(a) for a in AXES)) * _draw(seed, "strength") * noise
    return voxels.withColumn(value, F.when(_draw(seed, "noise") < 0.5, v + told).otherwise(v) if noise else v)


# --- statistics ----------------------------------------------------------------------------------------------------


def postprocess(labels: DataFrame, min_size: int | None = None, largest: int | None = None) -> DataFrame:
    """Labels after the size filter and the choice of the largest, each if asked for; the rest is background."""
    found = sizes(labels)
    if min_size:
        found = filter_small(found, min_size)
    mapping = keep_largest(found, largest) if largest else relabel_dense(found)
    return apply_map(labels, mapping).withColumn("label", F.col("new_label")).drop("new_label")


def batch_stats(cases: DataFrame, zero_counts: bool = True) -> DataFrame:
    """Files, failures, and the spread of ``dice`` over the files without ``error`` (and, if asked for, over zero)."""
    good = F.col("error").isNull() & F.col("dice").isNotNull()
    good = good if zero_counts else good & (F.col("dice") > 0)
    v = F.when(good, F.col("dice"))
    made = {"mean": F.avg(v), "std": F.stddev_pop(v), "min": F.min(v), "max": F.max(v), "median": F.median(v)}
    return cases.agg(F.count("*").alias("n_files"), F.count("error").alias("n_failed"), F.count_if(good).alias("n_used"), *(c.alias(k) for k, c in made.items()))


def value_stats(rows: DataFrame, by: list[str], value: str = "val") -> DataFrame:
    """Extremes, mean and sample deviation."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def coverage_flags(rows: DataFrame, by: list[str], mask: Column, least: float = 0.1) -> DataFrame:
    """Share of the places that the loss mask covers, and whether it is too low."""
    return rows.groupBy(*by).agg(F.avg(mask.cast("double")).alias("coverage")).withColumn("low", F.col("coverage") < least)


def epoch_lengths(datasets: DataFrame, size: int, offset: int, multiplier: float) -> DataFrame:
    """Patches of an epoch: the inner volume in patches, times a factor, cut to a whole number."""
    inner = F.lit(1.0)
    for a in AXES:
        inner = inner * (F.col(f"n{a}") - 2 * offset)
    return datasets.withColumn("length", F.floor(F.lit(float(multiplier)) * inner / F.lit(float(size**3))).cast("long"))


def against_fastest(runs: DataFrame) -> DataFrame:
    """Runs (config, elapsed) with their ratio to the fastest, fastest first."""
    best = runs.agg(F.min("elapsed")).first()[0]
    return runs.withColumn("ratio", F.col("elapsed") / F.lit(best)).orderBy("elapsed", "config")
