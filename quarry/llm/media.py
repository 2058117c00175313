"""Media columns: ISO media containers (MP4 family) written and read by their boxes, payloads never decoded.

`read_container` walks the nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample tables (stsd, stts,
stsc, stsz, stco, co64, stss) with array arithmetic and gives the codec, the duration and the byte ranges of every
sample and keyframe. `write_container` stores a payload losslessly as 8-bit grey frames of 24 x 24 (576 bytes a sample),
every 12th of them a sync sample, 8 samples a chunk.

Cases: a null or empty text is one frame of 255s; equal texts give equal containers; very long texts only make longer
sample tables; of several tracks the first with video is read; bytes that are no container, whose boxes or tables don't fit
each other, or that are nested too deeply, give nulls, as do fragmented files (their samples lie in moof boxes); an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.batches import map_texts

FRAME, SIDE, FPS, GROUP, PER_CHUNK = 576, 24, 25, 12, 8
#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"})


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(*columns: np.ndarray) -> bytes:
    """A count and the rows, all 32-bit big-endian."""
    return struct.pack(">I", len(columns[0])) + np.stack(columns, 1).astype(">u4").tobytes()


MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (max(FRAME, -(-len(data) // FRAME) * FRAME) - len(data))


def write_container(payload: bytes) -> bytes:
    """A container with one video track whose samples are the frames of the payload."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = np.array([[1, PER_CHUNK, 1]] + ([[chunks, n % PER_CHUNK, 1]] if n % PER_CHUNK and chunks > 1 else []))
    if chunks == 1:
        runs[0, 1] = n

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (FRAME * PER_CHUNK)
        where = full(b"stco", table(offsets)) if first + len(payload) < 1 << 32 else full(b"co64", struct.pack(">I", chunks) + offsets.astype(">u8").tobytes())
        stbl = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", table(np.array([n]), np.array([1]))),
            full(b"stss", table(np.arange(1, n + 1, GROUP))), full(b"stsc", table(*runs.T)), full(b"stsz", struct.pack(">II", FRAME, n)), where,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FPS, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FPS, n, 1 << 16, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    large = len(payload) + 16 >= 1 << 32
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    at = len(ftyp) + len(moov(0)) + len(head)
    if at + len(payload) >= 1 << 32:
        at = len(ftyp) + len(moov(1 << 32)) + len(head)
    return ftyp + moov(at) + head + payload


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()):
    """(path, from, to) of every box's body, outer boxes first. ValueError if a box runs past its parent."""
    at = start
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} doesn't fit")
        yield (*path, kind), at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def rows(data: memoryview, at: int, width: int, kind: str = ">u4") -> np.ndarray:
    """The rows of a full box's table that begins with a count."""
    n = int.from_bytes(data[at + 4 : at + 8], "big")
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(n, width)


def read_container(blob: bytes | None) -> dict | None:
    """codec, width, height, timescale, duration, and offset, size and sync (arrays over the samples) of the first video track, else the first track; None if there is none."""
    if not blob:
        return None
    data = memoryview(blob)
    tracks: list[dict] = []
    try:
        for path, a, b in walk(data, 0, len(data)):
            if path[-1] == b"trak":
                tracks.append({})
            elif b"trak" in path:
                tracks[-1].setdefault(path[-1], (a, b))
        video = [t for t in tracks if b"hdlr" in t and bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]) == b"vide"]
        got = [*video, *tracks, {}][0]
        stbl = {k: got[k][0] for k in (b"stsd", b"stts", b"stsc", b"stsz", b"mdhd")}
        a = stbl[b"mdhd"]
        scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        a = stbl[b"stsd"] + 8
        codec = bytes(data[a + 4 : a + 8]).decode("latin-1").strip()
        width, height = struct.unpack_from(">HH", data, a + 32)
        a = stbl[b"stsz"]
        fixed, n = struct.unpack_from(">II", data, a + 4)
        if fixed * n > len(data):
            raise ValueError("more samples than bytes")
        size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, a + 12).astype(np.int64)
        chunk = rows(data, got[b"stco"][0], 1)[:, 0] if b"stco" in got else rows(data, got[b"co64"][0], 1, ">u8")[:, 0]
        runs = rows(data, stbl[b"stsc"], 3)
        if runs[:, 1].max(initial=0) > n:
            raise ValueError("a chunk holds more samples than there are")
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
        if per_chunk.sum() != n:
            raise ValueError("the chunks hold other samples than there are")
        in_chunk = np.repeat(np.arange(len(chunk)), per_chunk)
        before = np.cumsum(size) - size
        first = np.cumsum(per_chunk) - per_chunk
        offset = chunk[in_chunk] + before - before[np.minimum(first, max(n - 1, 0))][in_chunk]
        sync = rows(data, got[b"stss"][0], 1)[:, 0] - 1 if b"stss" in got else np.arange(n)
        times = rows(data, stbl[b"stts"], 2)
        if n and int((offset + size).max()) > len(data):
            raise ValueError("a sample runs past the end")
        if len(sync) and not 0 <= sync.min() <= sync.max() < n:
            raise ValueError("a keyframe that is no sample")
    except (KeyError, ValueError, struct.error, IndexError, RecursionError):
        return None
    return {"codec": codec, "width": width, "height": height, "timescale": scale, "duration": duration or int((times[:, 0] * times[:, 1]).sum()), "offset": offset, "size": size, "sync": sync}


def read_payload(blob: bytes, info: dict) -> bytes:
    """The bytes of all samples in order; runs of adjoining samples are read at once."""
    offset, size = info["offset"], info["size"]
    cut = np.flatnonzero(np.append(True, offset[1:] != offset[:-1] + size[:-1]))
    ends = np.append(cut[1:], len(offset)) - 1
    return b"".join(blob[a:b] for a, b in zip(offset[cut].tolist(), (offset[ends] + size[ends]).tolist(), strict=True))


def describe(info: dict) -> str:
    """Codec, frame size, duration in ticks, samples and keyframe byte ranges as text."""
    keys = ",".join(f"{o}+{s}" for o, s in zip(info["offset"][info["sync"]].tolist(), info["size"][info["sync"]].tolist(), strict=True))
    return f"codec={info['codec']};frame={info['width']}x{info['height']};duration={info['duration']}/{info['timescale']};samples={len(info['size'])};keyframes={keys}"


def media_columns(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """keep, and of the containers in a binary column: codec, duration_s, samples and keyframes (byte ranges); nulls where there is none."""

    def f(part: pa.RecordBatch) -> dict:
        infos = [read_container(x) for x in part.column(media).to_pylist()]
        some = lambda g: [None if i is None else g(i) for i in infos]
        return {
            "codec": some(lambda i: i["codec"]), "duration_s": some(lambda i: i["duration"] / max(i["timescale"], 1)), "samples": some(lambda i: len(i["size"])),
            "keyframes": some(lambda i: [{"offset": int(i["offset"][k]), "bytes": int(i["size"][k])} for k in i["sync"]]),
        }

    return map_texts(df, f, "codec string, duration_s double, samples long, keyframes array<struct<offset:long,bytes:long>>", keep, media)


def store_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and media: each whole text, padded, as a container."""
    return map_texts(docs, lambda part: {"media": [write_container(pad((x or "").encode())) for x in part.column("text").to_pylist()]}, "media binary", keep)


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a container and read back, with digests of both; one pass, containers stay in the task."""

    def one(text: str | None) -> tuple:
        data = (text or "").encode()
        blob = write_container(pad(data))
        info = read_container(blob)
        back = read_payload(blob, info)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), describe(info)

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    empty: list = [()] * len(names)

    def f(part: pa.RecordBatch) -> dict:
        got = [one(x) for x in part.column("text").to_pylist()]
        return dict(zip(names, map(list, zip(*got, strict=True)) if got else empty, strict=True))

    return map_texts(docs, f, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", ["doc_id"])
