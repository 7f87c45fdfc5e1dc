"""Matroska as a column: a writer of PCM tracks and a reader of any file's packets.

The reader walks EBML elements (identifiers and sizes of variable length, unknown sizes
included), clusters, simple blocks and block groups with all four lacings, and cues, and gives a
packet table: track, timestamp, byte range, key frame. Rows are files; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element identifiers of the format's public specification (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
PARENTS = {SEGMENT, TRACKS, TRACK_ENTRY, AUDIO, INFO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 32, 7  # samples a second and a frame; frames a block; blocks a cluster, within 16 bits of milliseconds


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flags and body of a block of frames: none, fixed size, or EBML differences."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    head = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        head += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, bytes([len(frames) - 1]) + head + b"".join(frames)


_HEADER = _element(EBML, _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def write_pcm(samples: bytes) -> bytes:
    """A file with one track of 8-bit samples: laced simple blocks in clusters, and a cue for each cluster."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)) + _element(MUXING_APP, b"fragmenta") + _element(WRITING_APP, b"fragmenta"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, len(samples), FRAME * LACED * BLOCKS):
        start = first * 1000 // RATE
        body = [_uint(TIMESTAMP, start)]
        for k in range(first, min(first + FRAME * LACED * BLOCKS, len(samples)), FRAME * LACED):
            frames = [samples[i : min(i + FRAME, len(samples))] for i in range(k, min(k + FRAME * LACED, len(samples)), FRAME)]
            flags, data = lace(frames)
            body.append(_element(SIMPLE_BLOCK, _size(1) + struct.pack(">hB", k * 1000 // RATE - start, 0x80 | flags) + data))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster := _element(CLUSTER, b"".join(body)))
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A number of variable length and the place after it; keep: with its marker, as identifiers are written. -1: unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"broken number at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not keep:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, at + width


def _laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body."""
    if kind == 0:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:  # runs of 255
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:  # the first size, then differences
        for i in range(n - 1):
            before = at
            value, at = _vint(data, at, False)
            sizes.append(value if i == 0 else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1)
    else:
        if (end - at) % n:
            raise ValueError("fixed lacing with a remainder")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    if at > end or min(sizes, default=0) < 0:
        raise ValueError("lacing beyond its block")
    return [*out, (at, end)]


def parse(data: bytes) -> dict:
    """Tracks, packets (track, timestamp_ns, offset, size, keyframe, lacing, cluster) and cues of a file; raises ValueError or IndexError on broken ones."""
    out: dict = {"doc_type": "", "scale": 1_000_000, "duration": None, "tracks": [], "packets": [], "cues": []}
    clock, cluster, segment = 0, -1, 0
    group: list[int] | None = None

    def block(at: int, end: int, simple: bool) -> None:
        track, p = _vint(data, at, False)
        shift, flags = struct.unpack_from(">hB", data, p)
        kind = flags >> 1 & 3
        for a, b in _laces(data, p + 3, end, kind):
            out["packets"].append([track, (clock + shift) * out["scale"], a, b - a, bool(flags & 0x80) if simple else True, kind, cluster])

    ends: list[tuple[int, int]] = []  # end and identifier of the open parents
    at = 0
    while at < len(data):
        while ends and at >= ends[-1][0]:
            ends.pop()
        ident, p = _vint(data, at, True)
        size, p = _vint(data, p, False)
        if size < 0 and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"unknown size of element {ident:x}")
        while ends and ends[-1][1] == CLUSTER and ident in TOP:  # ends a cluster of unknown size
            ends.pop()
        end = (ends[-1][0] if ends else len(data)) if size < 0 else p + size
        if end > (ends[-1][0] if ends else len(data)):
            raise ValueError(f"element {ident:x} beyond its parent or the file")
        if ident == CLUSTER:
            cluster = at
        if ident == SEGMENT:
            segment = p
        elif ident == TRACK_ENTRY:
            out["tracks"].append({"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": None})
        elif ident == CUE_POINT:
            out["cues"].append({"time": 0, "track": 0, "offset": 0})
        elif ident == BLOCK_GROUP:
            group = [len(out["packets"])]
        elif ident == EBML:
            pass
        elif ident == SIMPLE_BLOCK or ident == BLOCK:
            block(p, end, ident == SIMPLE_BLOCK)
        elif ident == REFERENCE and group:
            for x in out["packets"][group[0] :]:
                x[4] = False
        elif ident == TIMESTAMP:
            clock = int.from_bytes(data[p:end], "big")
        elif ident in (SAMPLING, DURATION):
            value = struct.unpack(">d" if size == 8 else ">f", data[p:end])[0] if size else 0.0
            if ident == DURATION:
                out["duration"] = value
            else:
                out["tracks"][-1]["rate"] = value
        elif ident in (TIMESTAMP_SCALE, TRACK_NUMBER, TRACK_TYPE, CHANNELS, BIT_DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            value = int.from_bytes(data[p:end], "big")
            if ident == TIMESTAMP_SCALE:
                out["scale"] = value
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                out["cues"][-1][{CUE_TIME: "time", CUE_TRACK: "track", CUE_CLUSTER: "offset"}[ident]] = value + (segment if ident == CUE_CLUSTER else 0)
            else:
                out["tracks"][-1][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CHANNELS: "channels", BIT_DEPTH: "depth"}[ident]] = value
        elif ident == CODEC_ID:
            out["tracks"][-1]["codec"] = data[p:end].rstrip(b"\0").decode("ascii", "replace")
        elif ident == DOC_TYPE:
            out["doc_type"] = data[p:end].decode("ascii", "replace")
        if ident in PARENTS or ident == EBML:
            ends.append((end, ident))
            at = p
        else:
            at = end
    return out


def payload_of(data: bytes, parsed: dict, track: int = 1) -> bytes:
    """The bytes of a track's packets, in order."""
    return b"".join([data[a : a + n] for t, _, a, n, *_ in parsed["packets"] if t == track])


PACKETS = "track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, cluster_offset long"


def packet_table(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row for each packet of each file: id_col, packet number, PACKETS and error.

    A file that can't be parsed gives one row with its error and null packet columns; a null one
    gives the error 'null'; a file without packets gives no row.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, media in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                try:
                    rows, error = parse(media)["packets"] if media is not None else [], None if media is not None else "null"
                except (ValueError, IndexError, struct.error) as e:
                    rows, error = [], str(e)
                if error is not None:
                    rows = [[None] * 7]
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    columns = [pa.array([x[i] for x in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(part), batch.column(0).type), pa.array(range(k, k + len(part)), pa.int64()), *columns, pa.array([error] * len(part), pa.string())], ["id", "packet", "track", "timestamp_ns", "offset", "size", "keyframe", "lacing", "cluster_offset", "error"])

    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, packet long, {PACKETS}, error string").withColumnRenamed("id", id_col)


def feature_of(samples: np.ndarray, parsed: dict) -> str:
    """What the stored track sounds like: packets, clusters, length, level, spread, crossings and a 16-bin histogram."""
    bins = np.bincount(samples >> 4, minlength=16)
    values = np.bincount(samples, minlength=256)
    n, k = len(samples), np.arange(256)
    mean = float((values * k).sum() / n)
    spread = float(np.sqrt(max(0.0, (values * k * k).sum() / n - mean * mean)))
    high = samples >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    return f"packets={len(parsed['packets'])};cues={len(parsed['cues'])};ms={parsed['duration']:.3f};mean={mean:.4f};sd={spread:.4f};crossings={crossings};bins={','.join(map(str, bins))}"


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _stored(text: str | None, with_media: bool) -> tuple:
    raw = (text or "").encode()
    media = write_pcm(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)))
    parsed = parse(media)
    read = payload_of(media, parsed)
    samples = np.frombuffer(read, np.uint8)
    return (len(raw), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples, parsed), *([media] if with_media else []))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as an 8-bit PCM track and what is read back from it: id_col and STORED, and the file as ``media`` if asked for.

    Null and empty texts are 64 zero samples. Repeated rows and null ids are kept as they are;
    equal texts give equal values. The text is padded with zeros to a positive multiple of 64.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + with_media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns = list(zip(*(_stored(t.as_py(), with_media) for t in part.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], ["id", *names])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {STORED}" + ", media binary" * with_media)
    return out.withColumnRenamed("id", id_col)
