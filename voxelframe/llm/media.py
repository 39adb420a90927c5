"""Media columns: ISO media containers in a binary column, indexed without decoding their payloads.

``to_media`` stores bytes as 8-bit audio samples in an ISO base media file; ``media_index`` walks the nested
boxes, decodes the sample tables and gives codec, duration and the byte ranges of samples and keyframes. Both
are narrow: one row in, one row out.

Defined cases: a null text is empty (64 zero bytes of payload); a null or broken container gives nulls and an
``error``, and null digests of its payload; very long texts are one container; equal texts give equal containers and
repeated rows repeated results; an empty table gives no row; ``media_index`` keeps extra columns, but for columns named
like its own, whose place its own take; the other steps ignore them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, without

#: Bytes of one access unit, access units in a chunk, access units from one keyframe to the next, samples a second.
UNIT, CHUNK, KEY_EVERY, RATE = 64, 256, 16, 8000
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def write_container(payload: bytes) -> bytes:
    """``payload`` (a positive multiple of the unit) as one track of unsigned 8-bit samples."""
    units = len(payload) // UNIT
    duration = units * UNIT
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    data = _box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    chunks = -(-units // CHUNK)
    last = units - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] if last == CHUNK else [(1, last)] if chunks == 1 else [(1, CHUNK), (chunks, last)]
    offsets = [first + i * CHUNK * UNIT for i in range(chunks)]
    wide = offsets[-1] > 0xFFFFFFFF
    keys = list(range(1, units + 1, KEY_EVERY))
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, units, UNIT)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, units)),
        _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12s", 0, b"soun", b""), b"\0"),
        _box(
            b"minf",
            _full(b"smhd", bytes(4)),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
            table,
        ),
    )
    track = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
    movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, duration, 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2))
    return head + data + _box(b"moov", movie, _box(b"trak", track, media))


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, body start, body end) of every box, parents first. A size that leaves its parent is an error."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, name)
        start = stop


def read_index(data: bytes) -> dict:
    """Codec, duration, sample runs and keyframe ranges of the first track, from its sample tables alone."""
    boxes: dict[str, tuple[int, int]] = {}
    for name, body, stop in walk(data):
        boxes.setdefault(name, (body, stop))
    base = "/moov/trak/mdia/minf/stbl/"

    def words(kind: str, code: str = "I") -> tuple:
        if base + kind not in boxes:
            return ()
        body, stop = boxes[base + kind]
        return struct.unpack_from(f">{(stop - body - 8) // struct.calcsize('>' + code)}{code}", data, body + 8)

    body, _ = boxes[base + "stsd"]
    codec = data[body + 12 : body + 16].decode("latin-1")
    body, _ = boxes["/moov/trak/mdia/mdhd"]
    scale, duration = struct.unpack_from(">II", data, body + 12)
    body, _ = boxes[base + "stsz"]
    constant, count = struct.unpack_from(">II", data, body + 4)
    sizes = [constant] * count if constant else list(struct.unpack_from(f">{count}I", data, body + 12))
    places = words("stco") or words("co64", "Q")
    runs = words("stsc")
    runs = [runs[i : i + 3] for i in range(0, len(runs), 3)]
    keys = words("stss") or range(1, count + 1)
    starts, chunks, k = [], [], 0
    for r, (at, per, _) in enumerate(runs):
        until = runs[r + 1][0] if r + 1 < len(runs) else len(places) + 1
        for chunk in range(at, until):
            place = places[chunk - 1]
            begin = place
            for _ in range(min(per, count - k)):
                starts.append(place)
                place += sizes[k]
                k += 1
            chunks.append((begin, place - begin))
    if k != count:
        raise ValueError("sample tables disagree")
    return {
        "codec": codec,
        "duration_s": duration / scale if scale else 0.0,
        "n_samples": count,
        "chunks": chunks,
        "keyframes": [(starts[i - 1], sizes[i - 1]) for i in keys],
    }


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [write_container(pad(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return mapped(chosen, run, "doc_id long, n_bytes long, media binary")


INDEX = "codec string, duration_s double, n_samples long, chunks array<struct<start:long,length:long>>, keyframes array<struct<start:long,length:long>>, error string"


def media_index(media: DataFrame) -> DataFrame:
    """The input's columns and what the container's tables say; ``media`` is a binary column."""
    media = without(media, "codec", "duration_s", "n_samples", "chunks", "keyframes", "error")
    names = media.columns
    place = names.index("media")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in slices(batches, "media"):
            found: list[dict] = []
            for data in batch.column(place):
                try:
                    x = read_index(data.as_py())
                    x["chunks"] = [{"start": a, "length": n} for a, n in x["chunks"]]
                    x["keyframes"] = [{"start": a, "length": n} for a, n in x["keyframes"]]
                    found.append(x)
                except (ValueError, TypeError, KeyError, IndexError, struct.error) as e:
                    found.append({"error": f"{type(e).__name__}: {e}"})
            kinds = [pa.string(), pa.float64(), pa.int64(), spans, spans, pa.string()]
            keys = ["codec", "duration_s", "n_samples", "chunks", "keyframes", "error"]
            columns = [pa.array([x.get(k) for x in found], t) for k, t in zip(keys, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *keys])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return mapped(media, run, f"{kept}, {INDEX}")


def digested(x: dict) -> dict:
    """Checksums of one indexed container; those of a payload that could not be indexed are null."""
    data, keys = x["media"], x["keyframes"]
    out = {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"]}
    if data is not None:
        out |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    if x["error"] is None:
        payload = b"".join(data[c["start"] : c["start"] + c["length"]] for c in x["chunks"])
        ends = f"first={keys[0]['start']}+{keys[0]['length']};last={keys[-1]['start']}+{keys[-1]['length']}" if keys else "first=;last="
        out |= {
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-UNIT:]),
            "feature": f"codec={x['codec'].strip()};duration={x['duration_s']:.3f};samples={x['n_samples']};keyframes={len(keys)};{ends}",
        }
    return out


def media_digests(indexed: DataFrame) -> DataFrame:
    """The query's digests: the payload read back through the index, checksums and a feature line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            yield pa.RecordBatch.from_pylist([digested(x) for x in batch.to_pylist()], DIGESTS)

    return mapped(
        indexed,
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)
