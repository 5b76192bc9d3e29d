"""ISO media containers as a binary column.

A payload of 8-bit samples is written as one sound track of an ISO base media file (boxes ftyp, moov,
mdat; sample tables stts, stsc, stsz, stco), and the files are stored in the shared folder.
:func:`inspect` walks nested boxes of any such file, decodes the sample tables and gives codec, duration and
the byte ranges of keyframes; payload bytes are sliced, never decoded.  Without a table of sync samples all
are: each sample is a keyframe, and where all have one size the samples of a chunk are one range.

Defined results: a null text counts as empty; equal texts give equal files and features; repeated rows
give repeated results; other columns are ignored; an empty table gives no rows; a box that runs past its
parent ends the walk of that branch, and a missing, short or senseless table gives null fields or no ranges
instead of an error, at any depth of nesting.
Files over 4 GB use 64-bit box sizes and chunk offsets.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import struct
import zlib

from pyspark.sql import DataFrame

from .common import stored, table

UNIT = 64
RATE = 8000
#: Samples (bytes) in a chunk.
CHUNK = 4096
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the unit."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(size, b"\0")


def mux(payload: bytes) -> bytes:
    """An ISO media file with ``payload`` as 8-bit mono samples; the media header comes before the data."""
    n = len(payload)
    chunks, last = -(-n // CHUNK), (n - 1) % CHUNK + 1 if n else 0
    wide = n > (1 << 32) - (1 << 20)

    def head(data_at: int) -> bytes:
        at = [data_at + CHUNK * k for k in range(chunks)]
        runs = [(1, CHUNK, 1)] if chunks and (chunks > 1 or last == CHUNK) else []
        if chunks and last != CHUNK:
            runs.append((chunks, last, 1))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))),
            full_box(b"stts", struct.pack(">I", 1), struct.pack(">II", n, 1)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", 1, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *at)),
        )
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n & 0xFFFFFFFF, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ") + box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    size = len(head(0)) + (16 if n + 8 >= 1 << 32 else 8)
    return head(size) + box(b"mdat", payload)


def walk(data):
    """(depth, kind, body start, body end) of every box, depth first; leaves a box at a size that doesn't fit."""
    start, ends = 0, [len(data)]
    while ends:
        if start + 8 > ends[-1]:
            start = ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= ends[-1]:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = ends[-1] - start
        if size < body - start or start + size > ends[-1]:
            start = ends.pop()
            continue
        yield len(ends) - 1, kind, body, start + size
        if kind in CONTAINERS:
            ends.append(start + size)
            start = body
        else:
            start += size


def inspect(data: bytes) -> dict:
    """What :func:`track` gives of the first track, and of each one under ``tracks``."""
    boxes: list[dict[bytes, tuple[int, int]]] = []
    inside = None  # depth of the track that the walk is in
    for depth, kind, a, b in walk(data):
        if inside is not None and depth <= inside:
            inside = None
        if kind == b"trak" and inside is None:
            boxes.append({})
            inside = depth
        elif inside is not None:
            boxes[-1].setdefault(kind, (a, b))
    tracks = [track(data, at) for at in boxes]
    return (tracks[0] if tracks else track(data, {})) | {"tracks": tracks}


def _table(data: bytes, at: dict[bytes, tuple[int, int]], kind: bytes, form: str, skip: int = 4) -> list[tuple]:
    """The entries of a counted table in a box; as many as its body holds.  skip: bytes before the count."""
    a, b = at[kind]
    count = struct.unpack_from(">I", data[a:b], skip)[0]
    size = struct.calcsize(">" + form)
    body = data[a + skip + 4 : b]
    count = min(count, len(body) // size)
    return list(struct.iter_unpack(">" + form, body[: count * size]))


def track(data: bytes, at: dict[bytes, tuple[int, int]]) -> dict:
    """Codec, duration and sample layout by the boxes of a track: chunk byte ranges and keyframe byte ranges (offset, length)."""
    out = {"codec": None, "timescale": None, "duration": None, "samples": None, "chunks": [], "keyframes": []}
    try:
        if b"mdhd" in at:
            head = data[slice(*at[b"mdhd"])]
            out["timescale"], out["duration"] = struct.unpack_from(">IQ" if head[0] else ">II", head, 20 if head[0] else 12)
        if b"stsd" in at:
            out["codec"] = data[slice(*at[b"stsd"])][12:16].decode("latin-1") or None
        if not {b"stsz", b"stsc"} <= at.keys() or not ({b"stco", b"co64"} & at.keys()):
            return out
        one, n = struct.unpack_from(">II", data[slice(*at[b"stsz"])], 4)
        sizes = None if one else [x for (x,) in _table(data, at, b"stsz", "I", 8)]
        offsets = [x for (x,) in (_table(data, at, b"stco", "I") if b"stco" in at else _table(data, at, b"co64", "Q"))]
        runs = [x[:2] for x in _table(data, at, b"stsc", "III")]
        sync = sorted({x for (x,) in _table(data, at, b"stss", "I")}) if b"stss" in at else None
    except (struct.error, IndexError):
        return out
    out["samples"] = n
    if not runs:
        return out
    sample, run = 0, 0
    for chunk, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        held = min(runs[run][1], n - sample)
        if held <= 0:
            break
        mine = None if sizes is None else sizes[sample : sample + held]
        starts = None if mine is None else [0, *itertools.accumulate(mine)]
        length = one * held if mine is None else starts[-1]
        if sync is not None:
            these = (x - 1 - sample for x in sync[bisect.bisect_left(sync, sample + 1) : bisect.bisect_right(sync, sample + held)])
            out["keyframes"] += [(offset + j * one, one) if mine is None else (offset + starts[j], mine[j]) for j in these if mine is None or j < len(mine)]
        elif mine is None:
            out["keyframes"].append((offset, length))
        else:
            out["keyframes"] += [(offset + a, k) for a, k in zip(starts, mine, strict=False)]
        out["chunks"].append((offset, length))
        sample += held
    return out


def payload_of(data: bytes, info: dict) -> bytes:
    """The samples' bytes in order, sliced from the file."""
    return b"".join(data[a : a + n] for a, n in info["chunks"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each text as UTF-8, padded, in a file of its own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, "
    "keyframes array<struct<offset: long, length: long>>"
)


def media_columns(media: DataFrame) -> DataFrame:
    """What :func:`inspect` finds in the column ``media``, beside digests of the bytes read back from it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                info = inspect(data)
                payload = payload_of(data, info)
                seconds = info["duration"] / info["timescale"] if info["timescale"] else None
                feature = json.dumps({"codec": info["codec"], "seconds": seconds, "samples": info["samples"], "chunks": len(info["chunks"]), "keyframes": len(info["keyframes"])})
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, info["codec"], seconds, [{"offset": a, "length": n} for a, n in info["keyframes"]]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            names = [f.split()[0] for f in MEDIA_SCHEMA.split(", ")[:10]] + ["keyframes"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, MEDIA_SCHEMA)


def op10_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(stored(store_media(table(spark, sf_dir, "documents")), "media", "zstd"))


QUERIES = {"op10_media": op10_media}
ORACLE_SQL: dict[str, str] = {}
