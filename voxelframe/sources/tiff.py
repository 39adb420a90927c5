"""TIFF stacks as a Spark data source: ``spark.read.format("tiff_volume")``.

The chain of page directories is walked by seeks on the driver, a few hundred bytes a page; the strips (or tiles) of a
page are byte ranges that tasks read and decode: none, PackBits, LZW and deflate, with or without the horizontal
predictor, of whole and floating samples of 8 to 64 bits, classic and big files of either byte order. A page is a z
slice; a row is a voxel (path, z, y, x, val). Pages of unlike sizes or of several samples a pixel are an error.
Options: ``path`` (a file or a folder of them), ``per_partition`` (strips of a task).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .zarr import opened

#: Field types (code, size), tags, compression schemes, sample formats.
TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, HEIGHT, BITS, SCHEME, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = (
    256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339,
)
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
KINDS = {1: "u", 2: "i", 3: "f"}


def unpacked(data: bytes) -> bytes:
    """PackBits: a count below 128 is followed by that many bytes and one, a higher one by a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first, that grow one code early."""
    out, table, width, before = bytearray(), [], 9, b""
    bits, held = 0, 0
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not before:
            now = table[code]
        else:
            now = table[code] if code < len(table) else before + before[:1]
            table.append(before + now[:1])
        out += now
        before = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


DECODERS = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked}


@dataclass
class Page:
    """A page's size, sample type, scheme and the byte ranges of its parts with their places and sizes."""

    height: int
    width: int
    kind: str
    scheme: int
    predictor: int
    parts: list[tuple[int, int, int, int, int, int]]  # offset, count, y, x, rows, columns


def pages(file) -> list[Page]:
    """The pages of an opened file, in the order of the chain."""
    head = file.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    word, count_kind, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    size = struct.calcsize(word)
    at, found, seen = struct.unpack_from(f"{order}{word}", head, 8 if big else 4)[0], [], set()

    def take(place: int, n: int) -> bytes:
        file.seek(place)
        data = file.read(n)
        if len(data) < n:
            raise ValueError(f"the file ends within a page directory at {place}")
        return data

    while at:
        if at in seen:
            raise ValueError(f"the page directories return to {at}")
        seen.add(at)
        lead = struct.calcsize(count_kind)
        n = struct.unpack(f"{order}{count_kind}", take(at, lead))[0]
        body = take(at + lead, n * entry + size)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", body, k * entry)
            many = struct.unpack_from(f"{order}{word}", body, k * entry + 4)[0]
            if kind not in TYPES:
                continue
            code, each = TYPES[kind]
            value = body[k * entry + 4 + size : (k + 1) * entry]
            if many * each > size:
                value = take(struct.unpack(f"{order}{word}", value)[0], many * each)
            tags[tag] = struct.unpack_from(f"{order}{many}{code}", value) if many else ()
        found.append(page_of(tags, order))
        at = struct.unpack_from(f"{order}{word}", body, n * entry)[0]
    return found


def page_of(tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, scheme = one(WIDTH), one(HEIGHT), one(SCHEME, PLAIN)
    if one(SAMPLES, 1) != 1:
        raise ValueError(f"{one(SAMPLES)} samples a pixel, expected 1")
    if scheme not in DECODERS or one(BITS, 1) % 8 or one(FORMAT, 1) not in KINDS:
        raise ValueError(f"compression {scheme} of {one(BITS, 1)}-bit samples is not supported")
    parts = []
    if TILE_OFFSETS in tags:
        high, wide = one(TILE_HEIGHT), one(TILE_WIDTH)
        across = -(-width // wide)
        for k, (offset, count) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True)):
            parts.append((offset, count, k // across * high, k % across * wide, high, wide))
    else:
        rows = min(one(ROWS, height), height)
        for k, (offset, count) in enumerate(zip(tags[OFFSETS], tags[COUNTS], strict=True)):
            parts.append((offset, count, k * rows, 0, min(rows, height - k * rows), width))
    return Page(height, width, f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 1) // 8}", scheme, one(PREDICTOR, 1), parts)


def decoded(data: bytes, page: Page, rows: int, columns: int) -> np.ndarray:
    kind = np.dtype(page.kind)
    raw = DECODERS[page.scheme](data)[: rows * columns * kind.itemsize]
    block = np.frombuffer(raw, kind).reshape(rows, columns)
    if page.predictor == 2 and kind.kind in "ui":
        return np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    if page.predictor != 1:
        raise ValueError(f"predictor {page.predictor} of {page.kind} samples is not supported")
    return block


class Strips(InputPartition):
    """Parts of one file: (z, page without parts, part)."""

    def __init__(self, path: str, parts: list[tuple[int, Page, tuple]]):
        self.path, self.parts = path, parts


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("per_partition", 64))

    def partitions(self) -> list[Strips]:
        place, root = opened(self.path)
        info = place.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        inside = place.get_file_info(fs.FileSelector(root)) if info.type == fs.FileType.Directory else [info]
        out = []
        for path in sorted(f.path for f in inside if f.is_file and f.path.lower().endswith((".tif", ".tiff"))):
            with place.open_input_file(path) as file:
                found = pages(file)
            sizes = {(p.height, p.width) for p in found}
            if len(sizes) > 1:
                raise ValueError(f"{path}: pages of {len(sizes)} sizes, expected one volume")
            parts = [(z, Page(p.height, p.width, p.kind, p.scheme, p.predictor, []), part) for z, p in enumerate(found) for part in p.parts]
            out += [Strips(path, parts[i : i + self.each]) for i in range(0, len(parts), self.each)]
        return out

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        place, _ = opened(self.path)
        with place.open_input_file(partition.path) as file:
            for z, page, (offset, count, y0, x0, rows, columns) in partition.parts:
                file.seek(offset)
                block = decoded(file.read(count), page, rows, columns)[: page.height - y0, : page.width - x0]
                y, x = np.indices(block.shape)
                n = block.size
                columns_ = [pa.array([partition.path] * n), pa.array(np.full(n, z)), pa.array(y.ravel() + y0), pa.array(x.ravel() + x0), pa.array(block.ravel().astype(float))]
                yield pa.RecordBatch.from_arrays(columns_, ["path", "z", "y", "x", "val"])


class TiffVolume(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff_volume"

    def schema(self) -> str:
        return "path string, z long, y long, x long, val double"

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(dict(self.options))
