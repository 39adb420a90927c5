"""Data sources on files written by hand."""

import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.sources import tiff, volumes, zarr


def packbits(data):
    return b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80"


def lzw(data):
    """The codes of a plain LZW writer, high bits first, one code early."""
    table, width, out, held = {bytes([k]): k for k in range(256)}, 9, [(256, 9)], b""
    size = 258
    for byte in data:
        byte = bytes([byte])
        if held + byte in table:
            held += byte
            continue
        out.append((table[held], width))
        table[held + byte] = size
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
        if size == 4094:
            out.append((256, width))
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
        held = byte
    if held:
        out.append((table[held], width))
        size += 1
        width += size + 1 > 1 << width and width < 12
    bits = "".join(format(c, f"0{w}b") for c, w in [*out, (257, width)])
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


CODES = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def write_tiff(path, volume, scheme=1, order="<", rows=3, big=False, predictor=1, samples=1, tile=None):
    """Pages with strips of ``rows`` rows, or tiles, and their directories behind them."""
    word, count, field = ("Q", "Q", 16) if big else ("I", "H", 4)
    size = struct.calcsize(word)
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}H", 43 if big else 42))
    out += struct.pack(f"{order}HH", 8, 0) if big else b""
    link = len(out)
    out += bytes(size)
    for page in volume:
        h, w = page.shape
        blocks = []
        if tile:
            padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), page.dtype)
            padded[:h, :w] = page
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            blocks = [page[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), block.dtype))
            data = CODES[scheme](block.astype(page.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [page.dtype.itemsize * 8]), (259, 3, [scheme]), (277, 3, [samples]), (317, 3, [predictor]), (339, 3, [kind])]
        tags += [(322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 3, [rows]), (279, 4, counts)]
        entries = b""
        for tag, code, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{'H' if code == 3 else 'I'}", *values)
            if len(data) > size:
                at = len(out)
                out += data
                data = struct.pack(f"{order}{word}", at)
            entries += struct.pack(f"{order}HH{word}", tag, code, len(values)) + data.ljust(size, b"\0")
        struct.pack_into(f"{order}{word}", out, link, len(out))
        out += struct.pack(f"{order}{count}", len(tags)) + entries
        link = len(out)
        out += bytes(size)
    path.write_bytes(bytes(out))


@pytest.mark.parametrize("scheme", [1, 5, 8, 32773])
def test_tiff_decoding(tmp_path, scheme):
    rng = np.random.default_rng(scheme)
    made = [
        (rng.integers(0, 4, (3, 7, 5)).astype("u1"), {}), (rng.integers(-300, 300, (2, 8, 6)).astype("i2"), {"order": ">", "predictor": 2}),
        (rng.random((2, 4, 9)).astype("f4"), {"big": True}), (np.tile(np.arange(90, dtype="u2"), (1, 80, 3)), {"rows": 80}), (rng.integers(0, 9, (2, 10, 7)).astype("u4"), {"tile": 4, "predictor": 2}),
    ]
    for k, (volume, more) in enumerate(made):
        write_tiff(tmp_path / f"{k}.tif", volume, scheme, **more)
        with open(tmp_path / f"{k}.tif", "rb") as file:
            found = tiff.pages(file)
            got = np.zeros(volume.shape)
            for z, page in enumerate(found):
                for offset, count, y, x, rows, columns in page.parts:
                    file.seek(offset)
                    block = tiff.decoded(file.read(count), page, rows, columns)
                    got[z, y : y + rows, x : x + columns] = block[: volume.shape[1] - y, : volume.shape[2] - x]
        assert len(found) == len(volume) and np.array_equal(got, volume), k


def test_tiff_source(spark, tmp_path):
    rng = np.random.default_rng(1)
    one, two = rng.integers(0, 200, (3, 7, 5)).astype("u1"), rng.integers(0, 200, (1, 2, 2)).astype("u2")
    (tmp_path / "stack").mkdir()
    write_tiff(tmp_path / "stack" / "a.tif", one, 5)
    write_tiff(tmp_path / "stack" / "b.TIFF", two, 8, ">")
    spark.dataSource.register(tiff.TiffVolume)
    read = spark.read.format("tiff_volume").option("per_partition", 2).load(str(tmp_path / "stack"))
    assert read.rdd.getNumPartitions() == 6
    found = {(r.path.rsplit("/", 1)[1], r.z, r.y, r.x): r.val for r in read.collect()}
    want = {(name, *map(int, at)): float(v) for name, volume in (("a.tif", one), ("b.TIFF", two)) for at, v in np.ndenumerate(volume)}
    assert found == want
    assert volumes.read_volume(spark, f"{tmp_path}/stack/a.tif").count() == one.size
    (tmp_path / "c.tif").write_bytes(b"II*\0\x08\0\0\0\x01\0")
    for name, more in (("d.tif", {"samples": 3}), ("e.tif", {}), ("c.tif", None)):
        if more is not None:
            write_tiff(tmp_path / name, one, **more) if more else (tmp_path / name).write_bytes(b"not a picture file")
        with pytest.raises(ValueError), open(tmp_path / name, "rb") as file:
            tiff.pages(file)


def write_array(path, volume, chunks, codec=None, fill=0, skip=(), sep="."):
    path.mkdir(parents=True)
    code = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": lambda b: bytes(pa.compress(b, codec="zstd"))}[codec]
    for at in np.ndindex(*(-(-s // c) for s, c in zip(volume.shape, chunks, strict=True))):
        if at in skip:
            continue
        block = np.full(chunks, fill, volume.dtype)
        part = volume[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        file = path / sep.join(map(str, at))
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(code(block.tobytes()))
    meta = {"zarr_format": 2, "shape": volume.shape, "chunks": chunks, "dtype": volume.dtype.str, "compressor": codec and {"id": codec}, "fill_value": fill, "order": "C", "filters": None, "dimension_separator": sep}
    (path / ".zarray").write_text(json.dumps(meta))


def test_zarr_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    img, seg = rng.integers(1, 250, (2, 5, 6, 7)).astype("u1"), rng.integers(1, 9, (5, 6, 7)).astype("<i4")
    root = tmp_path / "case.zarr"
    write_array(root / "img", img, (1, 2, 4, 4), "zstd", sep="/")
    write_array(root / "seg", seg, (3, 3, 3), "gzip", fill=7, skip={(1, 1, 2)})
    write_array(root / "last", np.moveaxis(img, 0, -1).copy(), (2, 4, 4, 2), "zlib")
    seg[3:, 3:, 6:] = 7
    zarr.use(spark)
    read = lambda array, **more: spark.read.format("zarr_volume").options(path=str(root), array=array, **more).load()
    for name, more in (("img", {}), ("last", {"channel_axis": "last", "per_partition": 4})):
        assert {(r.channel, r.z, r.y, r.x): r.val for r in read(name, **more).collect()} == {tuple(map(int, at)): float(v) for at, v in np.ndenumerate(img)}, name
    assert {(r.z, r.y, r.x): r.val for r in read("seg").collect()} == {tuple(map(int, at)): float(v) for at, v in np.ndenumerate(seg)}
    both = zarr.image_and_labels(spark, str(root), divisor=255).where("channel = 1 and z = 4").collect()
    assert {(r.y, r.x): (r.val, r.label) for r in both} == {(y, x): (img[1, 4, y, x] / 255, seg[4, y, x]) for y in range(6) for x in range(7)}
    assert [tuple(r) for r in zarr.report(spark, str(root)).select("array", "shape", "codec", "n_chunks").collect()] == [("img", [2, 5, 6, 7], "zstd", 12 * 2), ("last", [5, 6, 7, 2], "zlib", 12), ("seg", [5, 6, 7], "gzip", 12)]
    with pytest.raises(FileNotFoundError, match="img, last, seg"):
        zarr.metadata(str(root), "none")
    write_array(root / "flat", np.zeros((2, 2), "u1"), (1, 1))
    with pytest.raises(ValueError, match="rank 2"):
        zarr.metadata(str(root), "flat")


def test_zarr_box_prunes_chunks(spark, tmp_path):
    volume = np.arange(8 * 8 * 8).reshape(8, 8, 8).astype("<i4")
    write_array(tmp_path / "a.zarr", volume, (2, 2, 2))
    zarr.use(spark)
    read = lambda box: spark.read.format("zarr_volume").load(str(tmp_path / "a.zarr")).where(box)
    for box, chunks, rows in (("z >= 2 and z < 4", 16, 128), ("z = 3 and y in (0, 7)", 16, 16), ("z > 3 and y <= 1 and x < 2", 2, 16), ("z > 100", 0, 0), ("val > 3", 64, 508)):
        planned, found = read(box).rdd.getNumPartitions(), read(box).collect()
        assert planned == max(1, chunks) and len(found) == rows, (box, planned)
        assert all(volume[r.z, r.y, r.x] == r.val for r in found)


def test_nifti_geometry(spark, tmp_path):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 7, 6, 5, 1, 1, 1, 1)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.25, 2, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 268, 10, 20, 30)
    (tmp_path / "a.nii").write_bytes(bytes(head) + bytes(210))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(bytes(head) + bytes(210)))
    for r in volumes.geometry(spark, f"{tmp_path}/*.nii*").collect():
        assert (r.shape, r.spacing, r.origin) == ([5, 6, 7], [2.0, 0.25, 0.5], [30.0, 20.0, 10.0]), r.path
