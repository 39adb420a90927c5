"""Sinks: volumes and datasets as Parquet or Zarr v2, placed side by side; metadata, skeleton, cloud and report files.

Parquet is the format of all results; Zarr is written chunk by chunk in the tasks, to any file system that Arrow opens.
HDF5, TIFF and NIfTI writers need libraries that are not part of this package; asking for them is an error.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.splits import split_assign
from voxelframe.operators.volume import AXES

#: Suffixes in the order in which they are tried (fixed values), the longer first.
SUFFIXES = (".nii.gz", ".nii", ".hdf5", ".h5", ".tiff", ".tif", ".npy", ".zarr", ".parquet")
#: Integer types from the narrowest, with the largest value each holds.
WHOLE = {"tinyint": 2**7 - 1, "smallint": 2**15 - 1, "int": 2**31 - 1, "bigint": 2**63 - 1}


def suffix(path: str) -> str:
    bare = path.rstrip("/").lower()
    return next((s for s in SUFFIXES if bare.endswith(s)), "")


def output_suffix(wanted: str, source: str) -> str:
    """The suffix of a result: that of its source for ``auto``, else the format asked for."""
    if wanted == "auto":
        return suffix(source) or ".parquet"
    if f".{wanted.lstrip('.')}" not in SUFFIXES:
        raise ValueError(f"unknown format {wanted!r}")
    return f".{wanted.lstrip('.')}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_zarr(voxels: DataFrame, path: str, shape: tuple[int, int, int], value: str = "val", kind: str = "<f4", chunks: tuple[int, int, int] = (64, 64, 64)) -> None:
    """A Zarr v2 array of zlib chunks; a chunk is one bounded group and one file. Chunks of zeros are left out, places
    without a voxel are 0. A task that is run again writes the same file again. An existing array is an error."""
    place, root = _open(path)
    if place.get_file_info(f"{root}/.zarray").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    place.create_dir(root, recursive=True)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = [int(frame[f"_{a}"].iloc[0]) for a in AXES]
        block = np.zeros(chunks, np.dtype(kind))
        block[tuple(frame[a].to_numpy() - k * n for a, k, n in zip(AXES, key, chunks, strict=True))] = frame[value]
        if block.any():
            there, top = _open(path)
            with there.open_output_stream(f"{top}/{'.'.join(map(str, key))}") as out:
                out.write(zlib.compress(block.tobytes()))
        return pd.DataFrame({"n": [len(frame)]})

    inside = voxels.where(" and ".join(f"{a} >= 0 and {a} < {n}" for a, n in zip(AXES, shape, strict=True)))
    keyed = inside.select(*AXES, value, *(F.expr(f"{a} div {n}").alias(f"_{a}") for a, n in zip(AXES, chunks, strict=True)))
    keyed.groupBy(*(f"_{a}" for a in AXES)).applyInPandas(run, "n long").agg(F.sum("n")).collect()
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": kind, "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None}
    with place.open_output_stream(f"{root}/.zarray") as out:  # last: an array with metadata is whole
        out.write(json.dumps(meta).encode())


def write_volume(voxels: DataFrame, path: str, shape: tuple[int, int, int] | None = None, value: str = "val", overwrite: bool = False) -> None:
    """A volume by the suffix of its path: Parquet or Zarr."""
    kind = suffix(path)
    if kind in (".parquet", ""):
        voxels.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    elif kind == ".zarr" and shape:
        write_zarr(voxels, path, shape, value, {"float": "<f4", "double": "<f8"}.get(voxels.schema[value].dataType.simpleString(), "<i8"))
    else:
        raise ValueError(f"no writer for {path!r}: supported are .parquet and, with a shape, .zarr")


def narrowed(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labels in the narrowest type that holds them all."""
    ends = labels.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    most = max(abs(ends["lo"] or 0), abs(ends["hi"] or 0))
    return labels.withColumn(label, F.col(label).cast(next(t for t, top in WHOLE.items() if most <= top)))


def empty_skeletons(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a sample without skeletons."""
    return spark.createDataFrame([], "skel_id long, node_id long, z double, y double, x double"), spark.createDataFrame([], "skel_id long, u long, v long, edge_length double")


def converted(images: DataFrame, labels: DataFrame, mask: DataFrame | None = None, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Samples (keys, z, y, x, val, label): each image with its labels, -1 outside of the mask (val over 0) if there is one.

    The volumes of a sample must hold the same places: ``write_dataset`` fails where they do not.
    """
    keys = [*by, *AXES]
    rows = images.select(*keys, "val").join(labels.select(*keys, "label"), keys, "full")
    if mask is not None:
        inside = mask.where("val > 0").select(*keys).withColumn("_in", F.lit(True))
        rows = rows.join(inside, keys, "left")
        rows = rows.withColumn("label", F.when(F.col("label").isNotNull(), F.when(F.col("_in"), F.col("label")).otherwise(-1)).cast("long")).drop("_in")
    return rows


def write_dataset(samples: DataFrame, path: str, dataset: str, train: float = 0.8, val: float = 0.1, overwrite: bool = False) -> None:
    """All samples (sample_id, z, y, x, val, label) of a dataset in one job, by split and sample. With ``overwrite`` only
    the partitions written are replaced; otherwise an existing dataset is an error."""
    splits = split_assign(samples.select("sample_id").distinct(), train, val)
    whole = F.when(F.col("val").isNull() | F.col("label").isNull(), F.raise_error(F.concat(F.lit("image and labels differ in shape: "), "sample_id"))).otherwise(F.col("val"))
    rows = samples.withColumn("val", whole).join(splits, "sample_id")
    writer = rows.repartition("split", "sample_id", F.expr("z div 64")).write.partitionBy("split", "sample_id")
    writer.mode("overwrite" if overwrite else "errorifexists").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{dataset}")


def write_best(sweep: DataFrame, path: str, decode) -> float:
    """The threshold of the best run length of a sweep (thr, nerl; ties: the smallest), as text, with its segmentation."""
    best = sweep.orderBy(F.desc("nerl"), "thr").first()["thr"]
    sweep.sparkSession.createDataFrame([(f"{best}",)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/best_thr")
    decode(best).write.mode("overwrite").parquet(f"{path}/best_seg.parquet")
    return best


def with_paths(scores: DataFrame, root: str, kinds: tuple[str, ...] = ("prediction", "instances"), key: str = "vol_id") -> DataFrame:
    """Scores with the places of their volumes' results."""
    return scores.withColumns({f"{k}_path": F.concat(F.lit(f"{root.rstrip('/')}/{k}/{key}="), F.col(key).cast("string")) for k in kinds})


def write_results(results: DataFrame, root: str, kind: str, key: str = "vol_id") -> None:
    """Volumes of a batch at the places that ``with_paths`` names."""
    results.write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root.rstrip('/')}/{kind}")


def volume_meta(rows: DataFrame, spacing: tuple[float, float, float], origin: tuple[float, float, float] = (0, 0, 0), key: str = "vol_id") -> DataFrame:
    """(key, spacing, origin, shape) of each volume: the table beside the voxels that carries their geometry."""
    shape = F.array(*((F.max(a) + 1).cast("long") for a in AXES)).alias("shape")
    place = lambda v, name: F.array(*(F.lit(float(x)) for x in v)).alias(name)
    return rows.groupBy(key).agg(shape).select(key, place(spacing, "spacing"), place(origin, "origin"), "shape")


#: Families of exported shapes (fixed values).
FAMILIES = {"rib_frac": 0, "background": 1}


def write_clouds(points: DataFrame, path: str, files: DataFrame) -> None:
    """Point clouds with their family map and the ids of the files (name, success) that gave one."""
    spark = points.sparkSession
    points.write.mode("errorifexists").parquet(f"{path}/points.parquet")
    spark.createDataFrame([(json.dumps(FAMILIES),)], "value string").coalesce(1).write.text(f"{path}/family_to_id.json")
    stem = F.regexp_replace(F.regexp_replace("name", r"^.*/", ""), r"\.[^.]*$", "")
    files.where("success").select(stem.alias("root_id"), F.lit("rib_frac").alias("family")).write.option("header", True).csv(f"{path}/neuron_ids.csv")


def cloud_totals(points: DataFrame, files: DataFrame) -> DataFrame:
    """Points, instances and files done and failed, in one row."""
    a = points.agg(F.count("*").alias("n_points"), F.count_distinct(F.when(F.col("label") > 0, F.struct("name", "label"))).alias("n_instances"))
    b = files.agg(F.count_if("success").alias("n_done"), F.count_if(~F.col("success")).alias("n_failed"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
