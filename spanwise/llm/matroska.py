"""Media columns: Matroska files as packet tables.

``parse`` walks the variable-length elements of a Matroska (EBML) stream and
yields its packets: track, timestamp, key flag, byte range of each frame, with
Xiph, EBML, fixed-size or no lacing, simple blocks and block groups, elements of
unknown size, and its cues. ``mux`` writes a one-track file of raw frames, laced
and clustered, with cues. Bytes that are not Matroska raise ``ValueError``;
``packets`` turns that into a row with an error instead of losing the input.

The query stores each text in such a file: UTF-8, padded with byte 255 to a
positive multiple of 576, as 8-bit mono samples at 8 kHz, 576 bytes a frame, 8
frames a laced block, and reads the payload back through the packet table.

Cases: null and empty texts are one frame of padding; an empty table gives an
empty one; repeated rows give equal values; extra columns are not kept by the
query and are kept by ``packets``, whose own columns win a clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.session import load

#: Element ids of the Matroska format (fixed values).
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
VOID, CRC, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD = 0xEC, 0xBF, 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74
_TOP = {INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD}

UNIT = 576
RATE_HZ = 8_000
LACED = 8
CLUSTER_FRAMES = 256


def vint(data, at: int) -> tuple[int | None, int]:
    """Size coded at a place, and the place after it; None: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError("bad element size")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("truncated element size")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def element_id(data, at: int) -> tuple[int, int]:
    if at >= len(data) or data[at] < 0x10:
        raise ValueError("bad element id")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("truncated element id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def children(data, at: int, end: int, parents: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements in a range. One of unknown size ends
    where an element of its parent's level begins."""
    while at < end:
        name, at = element_id(data, at)
        size, at = vint(data, at)
        if size is None:
            stop = at
            while stop < end:
                following, inner = element_id(data, stop)
                if following in _TOP and name != SEGMENT:
                    break
                n, inner = vint(data, inner)
                stop = end if n is None else inner + n
            yield name, at, min(stop, end)
            at = stop
        else:
            if at + size > end:
                raise ValueError("element exceeds its parent")
            yield name, at, at + size
            at += size


def _uint(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data, a: int, b: int) -> float:
    return {0: lambda _: 0.0, 4: lambda x: struct.unpack(">f", x)[0], 8: lambda x: struct.unpack(">d", x)[0]}[b - a](bytes(data[a:b]))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, bool, int, int, int]] = field(default_factory=list)  #: track, timestamp, key, begin, size, cluster
    cues: list[tuple[int, int, int]] = field(default_factory=list)  #: time, track, place in the segment
    lacings: set[int] = field(default_factory=set)


def _frames(data, a: int, b: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (begin, size) of the frames of a block's body."""
    if not lacing:
        return [(a, b - a)]
    if a >= b:
        raise ValueError("empty laced block")
    n, a = data[a] + 1, a + 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: sums of 255s and a last byte
        for _ in range(n - 1):
            size = 0
            while True:
                if a >= b:
                    raise ValueError("truncated lacing")
                size, a, last = size + data[a], a + 1, data[a]
                if last != 255:
                    break
            sizes.append(size)
    elif lacing == 3 and n > 1:  # EBML: a size, then signed differences
        size, a = vint(data, a)
        sizes.append(size or 0)
        for _ in range(n - 2):
            width = 9 - data[a].bit_length()
            diff, a = vint(data, a)
            diff = (1 << 7 * width) - 1 if diff is None else diff
            sizes.append(sizes[-1] + diff - ((1 << (7 * width - 1)) - 1))
    elif lacing == 2:
        if (b - a) % n:
            raise ValueError("uneven fixed lacing")
        sizes = [(b - a) // n] * (n - 1)
    sizes.append(b - a - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((a, size))
        a += size
    return out


def _block(data, a: int, b: int, cluster_time: int, simple: bool, key: bool, at: int, media: Media) -> None:
    track, p = vint(data, a)
    if p + 3 > b:
        raise ValueError("truncated block")
    relative, flags = struct.unpack(">hB", bytes(data[p : p + 3]))
    lacing = flags >> 1 & 3
    media.lacings.add(lacing)
    step = next((t["default_duration"] // media.scale for t in media.tracks if t["number"] == track and t["default_duration"]), 0)
    for k, (begin, size) in enumerate(_frames(data, p + 3, b, lacing)):
        media.packets.append((track, cluster_time + relative + k * step, bool(flags & 0x80) if simple else key, begin, size, at))


def parse(data: bytes) -> Media:
    """The tables of a Matroska stream."""
    media, segments = Media(), 0
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for name, a, b in top:
        if name == EBML:
            for inner, c, d in children(data, a, b):
                if inner == DOC_TYPE:
                    media.doc_type = bytes(data[c:d]).rstrip(b"\0").decode("ascii", "replace")
        elif name == SEGMENT:
            segments += 1
            _segment(data, a, b, media)
    if media.doc_type not in ("matroska", "webm") or not segments:
        raise ValueError("not a Matroska stream")
    return media


def _segment(data, begin: int, end: int, media: Media) -> None:
    for name, a, b in children(data, begin, end):
        if name == INFO:
            for inner, c, d in children(data, a, b):
                if inner == TIMESTAMP_SCALE:
                    media.scale = _uint(data, c, d) or 1_000_000
                elif inner == DURATION:
                    media.duration = _float(data, c, d)
        elif name == TRACKS:
            for inner, c, d in children(data, a, b):
                if inner == TRACK:
                    media.tracks.append(_track(data, c, d))
        elif name == CLUSTER:
            time = 0
            for inner, c, d in children(data, a, b):
                if inner == TIMESTAMP:
                    time = _uint(data, c, d)
                elif inner == SIMPLE_BLOCK:
                    _block(data, c, d, time, True, False, a, media)
                elif inner == BLOCK_GROUP:
                    parts = list(children(data, c, d))
                    key = all(x != REFERENCE for x, _, _ in parts)
                    for x, e, f in parts:
                        if x == BLOCK:
                            _block(data, e, f, time, False, key, a, media)
        elif name == CUES:
            for inner, c, d in children(data, a, b):
                if inner == CUE:
                    _cue(data, c, d, media)


def _track(data, a: int, b: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "default_duration": 0, "rate": 0.0, "channels": 0, "bits": 0}
    for name, c, d in children(data, a, b):
        if name == TRACK_NUMBER:
            out["number"] = _uint(data, c, d)
        elif name == TRACK_TYPE:
            out["type"] = _uint(data, c, d)
        elif name == CODEC:
            out["codec"] = bytes(data[c:d]).decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            out["default_duration"] = _uint(data, c, d)
        elif name == AUDIO:
            for inner, e, f in children(data, c, d):
                if inner == RATE:
                    out["rate"] = _float(data, e, f)
                elif inner == CHANNELS:
                    out["channels"] = _uint(data, e, f)
                elif inner == BIT_DEPTH:
                    out["bits"] = _uint(data, e, f)
    return out


def _cue(data, a: int, b: int, media: Media) -> None:
    time, places = 0, []
    for name, c, d in children(data, a, b):
        if name == CUE_TIME:
            time = _uint(data, c, d)
        elif name == CUE_PLACE:
            found = {inner: _uint(data, e, f) for inner, e, f in children(data, c, d)}
            places.append((found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER, 0)))
    media.cues += [(time, *p) for p in places]


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """The body of a simple block."""
    head = _size(track) + struct.pack(">hB", relative, (0x80 if key else 0) | lacing << 1)
    if not lacing:
        return head + frames[0]
    sizes, told = [len(f) for f in frames], b""
    if lacing == 1:
        told = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3 and len(sizes) > 1:
        told = _size(sizes[0])
        for was, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - was) < (1 << (7 * w - 1)) - 1)
            told += _size(n - was + (1 << (7 * width - 1)) - 1, width)
    return head + bytes([len(frames) - 1]) + told + b"".join(frames)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE_HZ) -> bytes:
    """A Matroska file of 8-bit mono samples, ``unit`` bytes a frame."""
    step = unit * 1_000_000_000 // rate
    scale = 1_000_000
    header = element(EBML, element(DOC_TYPE, b"matroska"))
    frames = len(payload) // unit
    info = element(INFO, _number(TIMESTAMP_SCALE, scale) + element(DURATION, struct.pack(">d", frames * step / scale)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, step)
    parts, cues = [info, element(TRACKS, element(TRACK, track + audio))], []
    at = sum(map(len, parts))
    for first in range(0, frames, CLUSTER_FRAMES):
        time, body = first * step // scale, []
        for k in range(first, min(first + CLUSTER_FRAMES, frames), LACED):
            some = [payload[unit * i : unit * (i + 1)] for i in range(k, min(k + LACED, frames, first + CLUSTER_FRAMES))]
            body.append(element(SIMPLE_BLOCK, block(1, k * step // scale - time, some, 2 if len(some) > 1 else 0)))
        parts.append(element(CLUSTER, _number(TIMESTAMP, time) + b"".join(body)))
        cues.append(element(CUE, _number(CUE_TIME, time) + element(CUE_PLACE, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return header + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def packets(media: DataFrame, column: str = "media") -> DataFrame:
    """A row for each packet of the Matroska files in a binary column: track,
    pts_ns, is_key, begin, size and lacing of its file; a file that cannot be
    parsed or a null gives one row with ``error``."""

    @F.pandas_udf("array<struct<track:long,pts_ns:long,is_key:boolean,begin:long,size:long,error:string>>")
    def table(blob: pd.Series) -> pd.Series:
        out = []
        for data in blob:
            try:
                if data is None:
                    raise ValueError("null")
                found = parse(data)
                out.append([{"track": t, "pts_ns": at * found.scale, "is_key": k, "begin": b, "size": n, "error": None} for t, at, k, b, n, _ in found.packets])
            except (ValueError, KeyError, IndexError) as error:
                out.append([{"track": None, "pts_ns": None, "is_key": None, "begin": None, "size": None, "error": str(error)}])
        return pd.Series(out)

    names = ["track", "pts_ns", "is_key", "begin", "size", "error"]
    return media.drop(*names).withColumn("__p", F.explode(table(column))).select(*[c for c in media.columns if c not in names], "__p.*")


def stored(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """The file of a text, and the bytes of its UTF-8 form."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return mux(raw + b"\xff" * (-len(raw) % unit or (0 if raw else unit)), unit), len(raw)


def feature(found: Media, payload: bytes) -> str:
    """A line that tells a file's track, packets, cues and signal apart."""
    t = found.tracks[0]
    signal = np.frombuffer(payload, np.uint8)
    per = signal.reshape(len(found.packets), -1)
    span = (per.max(1) - per.min(1)).astype(np.int64)
    last = (found.packets[-1][1] - found.packets[0][1]) * found.scale // 1_000_000
    return (
        f"codec={t['codec']};hz={t['rate']:.0f};bits={t['bits']};packets={len(found.packets)};clusters={len({p[5] for p in found.packets})};"
        f"cues={len(found.cues)};last_ms={last};sum={int(signal.sum(dtype=np.int64))};span={int(span.min())}-{int(span.max())};zero_cross={int(np.count_nonzero(np.diff(signal >= 128)))}"
    )


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        data, n = stored(t)
        found = parse(data)
        payload = b"".join([data[b : b + size] for _, _, _, b, size, _ in found.packets])
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload)))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGEST.split(", ")])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each row of docs (doc_id, text)."""
    return docs.select("doc_id", F.pandas_udf(digest, _DIGEST)("text").alias("d")).select("doc_id", "d.*")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))
