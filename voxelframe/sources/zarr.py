"""Zarr v2 arrays and groups as a Spark data source: ``spark.read.format("zarr_volume")``.

Options: ``path`` (an array or a group), ``array`` (the name in the group), ``channel_axis`` (first or last; of arrays of
rank 4), ``divisor`` (values are divided by it), ``per_partition`` (chunks of a task). A row is a voxel: z, y, x and
val, and channel for rank 4. ``use`` registers the source for a session. Comparisons of coordinates with numbers narrow
the box of chunks that are planned; Spark still applies them to the rows. Chunks may be raw, zlib, gzip
or zstd; a chunk without a file holds the fill value and its voxels are rows as well, unless the value is 0.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import product
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from voxelframe.operators.volume import AXES

CODECS = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the place in it."""
    place, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return place, root.rstrip("/")


def bytes_of(place: fs.FileSystem, path: str) -> bytes | None:
    """The content of a file, or None if there is none."""
    if place.get_file_info(path).type != fs.FileType.File:
        return None
    with place.open_input_stream(path) as stream:
        return stream.read()


def metadata(path: str, array: str = "") -> dict:
    """The metadata of an array, checked against what can be decoded."""
    place, root = opened(path)
    found = bytes_of(place, f"{root}/{array}/.zarray".replace("//", "/"))
    if found is None:
        raise FileNotFoundError(f"{path}: no array {array or 'at the root'}; arrays: {', '.join(sorted(arrays(path))) or 'none'}")
    meta = json.loads(found)
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (*CODECS, "zstd"):
        raise ValueError(f"{path}: codec {codec!r} is not supported")
    if len(meta["shape"]) not in (3, 4) or meta.get("filters"):
        raise ValueError(f"{path}: rank {len(meta['shape'])}, expected 3 or 4, without filters")
    return meta | {"codec": codec, "sep": meta.get("dimension_separator", ".")}


def arrays(path: str) -> list[str]:
    """Names of the arrays in a group."""
    place, root = opened(path)
    found = place.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return [f.base_name for f in found if f.type == fs.FileType.Directory and place.get_file_info(f"{f.path}/.zarray").type == fs.FileType.File]


def report(spark: SparkSession, path: str) -> DataFrame:
    """(array, shape, chunks, dtype, codec, n_chunks) of the arrays of a group, or of the array itself."""
    rows = []
    for name in sorted(arrays(path)) or [""]:
        m = metadata(path, name)
        rows.append((name, m["shape"], m["chunks"], m["dtype"], m["codec"] or "raw", int(np.prod([ceil(s / c) for s, c in zip(m["shape"], m["chunks"], strict=True)]))))
    return spark.createDataFrame(rows, "array string, shape array<long>, chunks array<long>, dtype string, codec string, n_chunks long")


class Chunks(InputPartition):
    """The numbers of a task's chunks along each axis."""

    def __init__(self, at: list[tuple[int, ...]]):
        self.at = at


class ZarrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.array = options["path"], options.get("array", "")
        self.divisor, self.each = float(options.get("divisor", 1)), int(options.get("per_partition", 1))
        self.meta = metadata(self.path, self.array)
        last = options.get("channel_axis", "first") == "last"
        self.names = [*AXES] if len(self.meta["shape"]) == 3 else [*AXES, "channel"] if last else ["channel", *AXES]
        self.box = [[0, n] for n in self.meta["shape"]]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name in self.names and values and all(isinstance(v, (int, float)) for v in values):
                box, low, high = self.box[self.names.index(name)], min(values), max(values)
                if isinstance(f, (EqualTo, In)):
                    box[:] = max(box[0], ceil(low)), min(box[1], floor(high) + 1)
                elif isinstance(f, GreaterThan):
                    box[0] = max(box[0], floor(low) + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    box[0] = max(box[0], ceil(low))
                elif isinstance(f, LessThan):
                    box[1] = min(box[1], ceil(high))
                elif isinstance(f, LessThanOrEqual):
                    box[1] = min(box[1], floor(high) + 1)
            yield f

    def partitions(self) -> list[Chunks]:
        """Groups of the chunks that the box meets."""
        along = [range(lo // c, max(lo // c, ceil(hi / c))) if hi > lo else range(0) for (lo, hi), c in zip(self.box, self.meta["chunks"], strict=True)]
        found = list(product(*along))
        return [Chunks(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [Chunks([])]

    def block(self, place: fs.FileSystem, root: str, at: tuple[int, ...]) -> np.ndarray | None:
        m = self.meta
        size, kind = m["chunks"], np.dtype(m["dtype"])
        data = bytes_of(place, f"{root}/{self.array}/{m['sep'].join(map(str, at))}".replace("//", "/"))
        if data is None:
            fill = m.get("fill_value") or 0
            return None if fill == 0 else np.full(size, float(fill))
        whole = int(np.prod(size)) * kind.itemsize
        raw = bytes(pa.decompress(data, whole, codec="zstd")) if m["codec"] == "zstd" else CODECS[m["codec"]](data)
        return np.frombuffer(raw, kind).reshape(size, order=m.get("order", "C"))

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        place, root = opened(self.path)
        for at in partition.at:
            block = self.block(place, root, at)
            if block is None:
                continue
            first = [k * c for k, c in zip(at, self.meta["chunks"], strict=True)]
            block = block[tuple(slice(0, n - f) for n, f in zip(self.meta["shape"], first, strict=True))]
            for k in range(block.shape[0]):  # a plane at a time bounds the rows held
                places = np.indices((1, *block.shape[1:])).reshape(block.ndim, -1)
                columns = {n: places[i] + first[i] + (k if i == 0 else 0) for i, n in enumerate(self.names)}
                columns["val"] = block[k].ravel().astype(float) / self.divisor
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in columns_of(len(self.names))})


def columns_of(rank: int) -> list[str]:
    return [*(["channel"] if rank == 4 else []), *AXES, "val"]


class ZarrVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr_volume"

    def schema(self) -> str:
        rank = len(metadata(self.options["path"], self.options.get("array", ""))["shape"])
        return ", ".join(f"{c} {'double' if c == 'val' else 'long'}" for c in columns_of(rank))

    def reader(self, schema: StructType) -> ZarrReader:
        return ZarrReader(dict(self.options))


def use(spark: SparkSession) -> None:
    """Register the source; Spark asks that filters may be pushed down to sources that take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrVolume)


def image_and_labels(spark: SparkSession, path: str, image: str = "img", labels: str = "seg", channel_axis: str = "first", divisor: float = 1) -> DataFrame:
    """A group's image joined with its labels by voxel: (channel,) z, y, x, val, label."""
    use(spark)
    read = lambda array, **more: spark.read.format("zarr_volume").options(path=path, array=array, **more).load()
    known = read(labels).selectExpr(*AXES, "cast(val as long) as label")
    return read(image, channel_axis=channel_axis, divisor=divisor).join(known, list(AXES), "left").na.fill({"label": 0})
