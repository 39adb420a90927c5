"""Volume files as voxel tables, read through Spark's ``binaryFile`` source so that any file system works.

NumPy arrays, NIfTI files and Zarr v2 arrays (raw, zlib or gzip chunks) are decoded in parallel, a file or chunk a row.
TIFF stacks and Zarr groups have data sources of their own (``tiff.py``, ``zarr.py``). HDF5 and other codecs need
libraries that are not part of this package; asking for them is an error.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.operators.volume import AXES

from . import tiff

VOXELS = "path string, z long, y long, x long, val double"
#: NIfTI data type codes.
NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(path, z, y, x, val) of every voxel of the files at ``path`` (globs too), by suffix; Parquet passes through."""
    bare = path.rstrip("/")
    if bare.endswith(".parquet"):
        return spark.read.parquet(path)
    if bare.endswith(".zarr"):
        return read_zarr(spark, bare)
    if bare.endswith(".npy"):
        return _decoded(spark, path, decode_npy)
    if bare.endswith((".nii", ".nii.gz")):
        return _decoded(spark, path, decode_nifti)
    if bare.lower().endswith((".tif", ".tiff")):
        spark.dataSource.register(tiff.TiffVolume)
        return spark.read.format("tiff_volume").load(path)
    raise ValueError(f"no decoder for {path!r}: supported are .parquet, .npy, .nii, .nii.gz, .tif, .tiff and .zarr")


def _decoded(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                volume = decode(bytes(content))
                if volume.ndim != 3:
                    raise ValueError(f"{name}: rank {volume.ndim}, expected 3")
                for z in range(volume.shape[0]):  # a slice at a time bounds the rows held
                    yield _rows(name, volume[z], z, 0, 0)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VOXELS)


def _rows(name: str, plane: np.ndarray, z: int, y0: int, x0: int) -> pd.DataFrame:
    y, x = np.indices(plane.shape)
    return pd.DataFrame({"path": name, "z": z, "y": y.ravel() + y0, "x": x.ravel() + x0, "val": plane.ravel().astype(float)})


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, spacing, origin) of NIfTI files in (z, y, x) order, from their headers: the table that
    ``sinks.volume_meta`` writes for computed volumes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["head"], strict=True):
                head = bytes(content)
                head = zlib.decompressobj(31).decompress(head, 352) if head[:2] == b"\x1f\x8b" else head
                order = "<" if struct.unpack_from("<i", head)[0] == 348 else ">"
                shape = struct.unpack_from(f"{order}8h", head, 40)[3:0:-1]
                spacing = struct.unpack_from(f"{order}8f", head, 76)[3:0:-1]
                origin = struct.unpack_from(f"{order}3f", head, 268)[::-1]
                rows.append((name, list(shape), list(map(float, spacing)), list(map(float, origin))))
            yield pd.DataFrame(rows, columns=["path", "shape", "spacing", "origin"])

    # Of a compressed file too, the first bytes hold the header.
    heads = spark.read.format("binaryFile").load(path).select("path", F.expr("substring(content, 1, 4096)").alias("head"))
    return heads.mapInPandas(run, "path string, shape array<long>, spacing array<double>, origin array<double>")


def decode_nifti(data: bytes) -> np.ndarray:
    """The array in (z, y, x) order, scaled by the header's slope and intercept."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    dims = struct.unpack_from(f"{order}8h", data, 40)
    code = struct.unpack_from(f"{order}h", data, 70)[0]
    offset, slope, inter = (struct.unpack_from(f"{order}f", data, at)[0] for at in (108, 112, 116))
    shape = dims[1 : 1 + dims[0]]
    volume = np.frombuffer(data, order + NIFTI[code], int(np.prod(shape)), int(offset)).reshape(shape[::-1])
    while volume.ndim > 3 and volume.shape[0] == 1:
        volume = volume[0]
    return volume * slope + inter if slope else volume


def _small_text(spark: SparkSession, path: str) -> str:
    """A metadata file whose name starts with a dot, which Spark's readers skip, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """One task unit a chunk; missing chunks hold the fill value and are left out if that is 0."""
    meta = json.loads(_small_text(spark, f"{path}/.zarray"))
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip") or len(meta["shape"]) != 3 or meta.get("filters"):
        raise ValueError(f"{path}: codec {codec!r} of rank {len(meta['shape'])} is not supported")
    if meta.get("fill_value") not in (0, None, 0.0, False):
        raise ValueError(f"{path}: only a fill value of 0 is supported")
    shape, size, kind, order = meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), meta.get("order", "C")
    sep = meta.get("dimension_separator", ".")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                data = bytes(content)
                data = zlib.decompress(data) if codec == "zlib" else gzip.decompress(data) if codec == "gzip" else data
                block = np.frombuffer(data, kind).reshape(size, order=order)
                at = [int(k) * n for k, n in zip(name.rsplit("/", 3 if sep == "/" else 1)[1:] if sep == "/" else name.rsplit("/", 1)[1].split("."), size, strict=True)]
                block = block[tuple(slice(0, max(0, s - a)) for s, a in zip(shape, at, strict=True))]
                for z in range(block.shape[0]):
                    yield _rows(path, block[z], z + at[0], at[1], at[2])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", sep == "/").option("pathGlobFilter", "[0-9]*").load(path)
    return files.select("path", "content").mapInPandas(run, VOXELS)


def write_sample(voxels: DataFrame, path: str, setting: str, split: str, sample: str, overwrite: bool = False) -> None:
    """A sample's voxels in the partitioned layout; an existing sample is kept unless ``overwrite`` is asked for."""
    rows = voxels.withColumns({"setting": F.lit(setting), "split": F.lit(split), "sample": F.lit(sample)})
    target = f"{path}/setting={setting}/split={split}/sample={sample}"
    rows.drop("setting", "split", "sample").write.mode("overwrite" if overwrite else "errorifexists").parquet(target)


def with_mask(labels: DataFrame, mask: DataFrame) -> DataFrame:
    """Labels with -1 outside the region mask (value over 0; no voxel in the mask table: outside)."""
    inside = mask.where("val > 0").select(*AXES).withColumn("_in", F.lit(True))
    joined = labels.join(inside, list(AXES), "left")
    return joined.withColumn("label", F.when(F.col("_in"), F.col("label")).otherwise(F.lit(-1)).cast("long")).drop("_in")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image, mask) rows of a JSON manifest of two lists of equal length."""
    rows = spark.read.option("multiLine", True).json(path)
    if rows.where(F.size("images") != F.size("masks")).head(1):
        raise ValueError(f"{path}: images and masks differ in length")
    return rows.select(F.explode(F.arrays_zip("images", "masks")).alias("p")).select(F.col("p.images").alias("image"), F.col("p.masks").alias("mask"))
