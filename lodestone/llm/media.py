"""Media columns: ISO media containers (MP4 / QuickTime boxes) as binary columns.

`mux` stores a payload losslessly as a video track of raw 8-bit grey pictures: each sample is one 24 x 24
picture of 576 bytes, every sample is a keyframe. `probe` walks the nested boxes of any such file, decodes the
sample tables of every track (durations, sizes, chunk runs, 32- and 64-bit offsets, sync samples) and returns
codec, duration and the byte ranges of keyframes without decoding a payload byte. Damaged files give an error
text in place of tracks, never an exception.

Null and empty texts are one picture of padding; a very long text is one file of as many pictures as it fills. Each row gives a row, repeated
ones too, and equal texts give equal values; an empty table gives none. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, tune

SIDE = 24
SAMPLE = SIDE * SIDE
SCALE, TICKS = 25, 1  # 25 pictures a second
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
TRACK = "codec string, handler string, width int, height int, samples long, duration_ms long, keyframes long, key_start array<long>, key_bytes array<long>"


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full(kind: bytes, *body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *body)


def padded(raw: bytes) -> bytes:
    """The payload: raw and bytes 255 up to a positive multiple of SAMPLE."""
    return raw + b"\xff" * (-len(raw) % SAMPLE if raw else SAMPLE)


def mux(payload: bytes) -> bytes:
    """A file with the payload in `mdat`; its length must be a positive multiple of SAMPLE."""
    n, rest = divmod(len(payload), SAMPLE)
    if rest or not n:
        raise ValueError("the payload must be whole samples")
    unit = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(offset: int) -> bytes:
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        where = full(b"co64", struct.pack(">IQ", 1, offset)) if offset + len(payload) >> 32 else full(b"stco", struct.pack(">II", 1, offset))
        tables = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), full(b"stsz", struct.pack(">II", SAMPLE, n)), where,
        )
        info = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, SCALE, n * TICKS, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"raw\0"), info)
        head = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * TICKS), bytes(16), unit, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
        movie = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, SCALE, n * TICKS, 0x10000, 0x100), bytes(10), unit, bytes(24), struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", head, media))

    front = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0 if len(payload) < 1 << 31 else 1 << 32))
    return kind + moov(len(kind) + size + front) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of each box in a range; raises ValueError on a broken length."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} is longer than what holds it")
        yield kind, body, stop
        start = stop


def tree(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """Every box, nested ones after the one that holds them."""
    for kind, a, b in boxes(data, start, len(data) if end is None else end):
        yield (*path, kind), a, b
        if kind in NESTED and len(path) < 16:
            yield from tree(data, a, b, (*path, kind))


def _numbers(data: memoryview, start: int, end: int, dtype: str, count: int, width: int = 1) -> np.ndarray:
    need = count * width * np.dtype(dtype).itemsize
    if start + need > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data[start : start + need], dtype=dtype).astype(np.int64).reshape(-1, width)


def track(data: memoryview, start: int, end: int) -> dict:
    """What one `trak` says."""
    found = {path[-1]: (a, b) for path, a, b in tree(data, start, end)}
    u32 = lambda at: struct.unpack_from(">I", data, at)[0]
    if missing := [k.decode() for k in (b"mdhd", b"stsd", b"stsz", b"stsc", b"stts") if k not in found]:
        raise ValueError(f"a track lacks {', '.join(missing)}")
    a, b = found[b"mdhd"]
    scale, length = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    handler = bytes(data[found[b"hdlr"][0] + 8 : found[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in found else ""
    kind, ea, eb = next(boxes(data, found[b"stsd"][0] + 8, found[b"stsd"][1]), (b"", 0, 0))
    width, height = struct.unpack_from(">HH", data, ea + 24) if handler == "vide" and eb - ea >= 28 else (0, 0)
    a, b = found[b"stsz"]
    one, n = u32(a + 4), u32(a + 8)
    sizes = np.full(n, one, dtype=np.int64) if one else _numbers(data, a + 12, b, ">u4", n)[:, 0]
    a, b = found[b"stts"]
    times = _numbers(data, a + 8, b, ">u4", u32(a + 4), 2)
    wide = b"co64" in found
    a, b = found[b"co64" if wide else b"stco"]
    chunks = _numbers(data, a + 8, b, ">u8" if wide else ">u4", u32(a + 4))[:, 0]
    a, b = found[b"stsc"]
    runs = _numbers(data, a + 8, b, ">u4", u32(a + 4), 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(runs) else np.zeros(0, dtype=np.int64)
    if len(per) != len(chunks) or per.sum() != n:
        raise ValueError("chunks and samples differ in number")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    at = np.repeat(chunks - before[np.minimum(first, max(n - 1, 0))], per) + before if n else before
    if b"stss" in found:
        a, b = found[b"stss"]
        sync = _numbers(data, a + 8, b, ">u4", u32(a + 4))[:, 0] - 1
    else:
        sync = np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError("a keyframe is no sample")
    if n and (at.min() < 0 or (at + sizes).max() > len(data)):
        raise ValueError("a sample lies outside the file")
    k0, k1 = at[sync], sizes[sync]
    new = np.flatnonzero(np.append(True, k0[1:] != k0[:-1] + k1[:-1])) if len(sync) else sync
    return {
        "codec": kind.decode("latin-1"), "handler": handler, "width": width, "height": height, "samples": n, "duration_ms": int((times[:, 0] * times[:, 1]).sum() * 1000 // max(1, scale)),
        "keyframes": len(sync), "key_start": k0[new].tolist(), "key_bytes": np.add.reduceat(k1, new).tolist() if len(new) else [], "at": at, "sizes": sizes,
    }


def probe(data: bytes | None) -> tuple[list[dict], str | None]:
    """The tracks of a file and None, or no tracks and what is wrong. Null and empty files have no tracks."""
    view = memoryview(data or b"")
    try:
        return [track(view, a, b) for path, a, b in tree(view) if path[-1] == b"trak"], None
    except (ValueError, KeyError, struct.error, OverflowError, MemoryError) as e:
        return [], f"{type(e).__name__}: {e}"


def payload(data: bytes, of: dict) -> bytes:
    """The stored bytes of a track's samples, in order."""
    at, sizes = of["at"], of["sizes"]
    if len(at) and (at[1:] == at[:-1] + sizes[:-1]).all():
        return bytes(memoryview(data)[at[0] : at[-1] + sizes[-1]])
    return b"".join(data[a : a + s] for a, s in zip(at.tolist(), sizes.tolist()))


def pack_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as a media file. Repeated rows stay."""
    tune(docs.sparkSession)

    def run(frames):
        for pdf in frames:
            raw = [bytes_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": pd.Series([len(x) for x in raw], dtype="int64"), "media": [mux(padded(x)) for x in raw]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def probe_media(df: DataFrame, column: str = "media") -> DataFrame:
    """Adds `tracks` and `media_error` to a table with a media column."""
    tune(df.sparkSession)
    names = [x.split()[0] for x in TRACK.split(", ")]
    src = df.drop("tracks", "media_error")

    def run(frames):
        for pdf in frames:
            got = [probe(x) for x in pdf[column]]
            yield pdf.assign(tracks=[[{k: t[k] for k in names} for t in ts] for ts, _ in got], media_error=[e for _, e in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInPandas(run, f"{fields}, tracks array<struct<{TRACK.replace(' ', ':').replace(',:', ',')}>>, media_error string")


def feature_text(tracks: list[dict]) -> str:
    return ";".join(f"{t['codec'].strip()}/{t['handler']}/{t['width']}x{t['height']}/{t['samples']}/{t['duration_ms']}ms/{t['keyframes']}key@{','.join(f'{a}+{b}' for a, b in zip(t['key_start'], t['key_bytes']))}" for t in tracks)


def digest(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of pack_texts() back and sums them up."""
    tune(media.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for d, n, m in zip(pdf["doc_id"].astype("Int64"), pdf["n_bytes"], pdf["media"]):
                tracks, wrong = probe(m)
                if wrong:
                    raise ValueError(f"document {d}: {wrong}")
                back = payload(m, tracks[0])
                rows.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_text(tracks)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
