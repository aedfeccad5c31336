"""Media columns in Matroska: EBML elements, clusters, lacing and cues, read into packet tables.

``wrap`` stores bytes as 8-bit PCM samples in clusters of laced blocks with cues;
``packets`` lists the frames of any Matroska value with track, timestamp and byte range;
``unwrap`` reads the samples back through that list.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import extended, output, table, unclashed
from codelake.llm.registry import query

# Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16  # samples a second, bytes a frame, frames a block, blocks a cluster


# ---------------------------------------------------------------- writing


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames behind their lacing header: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += _size(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            k = 1
            while abs(b - a) > (1 << 7 * k - 1) - 1:
                k += 1
            head += (b - a + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return head + b"".join(frames)


def wrap_bytes(payload: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """The payload as mono 8-bit PCM; equal payloads give equal files."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"codelake") + element(WRITING_APP, b"codelake"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for start in range(0, len(payload), frame * LACED * BLOCKS):
        ms = start * 1000 // rate
        blocks = [number(TIMESTAMP, ms)]
        for first in range(start, min(len(payload), start + frame * LACED * BLOCKS), frame * LACED):
            frames = [payload[k : k + frame] for k in range(first, min(len(payload), first + frame * LACED), frame)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == len(frames[0]) else 3
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", first * 1000 // rate - ms) + bytes([0x80 | kind << 1 if kind != 1 else 0x82]) + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# ---------------------------------------------------------------- reading


@dataclass
class Packet:
    track: int
    timestamp: int  # in ticks of the timestamp scale
    offset: int
    size: int
    keyframe: bool
    cluster: int
    frame: int  # number in its block


class BadMedia(ValueError):
    pass


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, next place, width) of a variable-length number."""
    if at >= len(data) or not data[at]:
        raise BadMedia(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise BadMedia(f"number cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    return n if keep_marker else n ^ 1 << 7 * width, at + width, width


#: Levels of elements whose size may be unknown, and of those that end them.
_LEVEL = {EBML: 0, SEGMENT: 0, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1}


def elements(data: bytes, at: int, end: int, level: int | None = None):
    """(id, start of the body, its end) of each element of a range; an unknown size ends before the next of its level."""
    while at < end:
        ident, at, _ = _vint(data, at, True)
        n, at, width = _vint(data, at)
        stop = at + n
        if n == (1 << 7 * width) - 1:
            if ident not in (SEGMENT, CLUSTER):
                raise BadMedia(f"unknown size at byte {at}")
            stop = end if ident == SEGMENT else _unknown_end(data, at, end)
        if stop > end:
            raise BadMedia(f"element beyond its parent at byte {at}")
        yield ident, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body, _ = _vint(data, at, True)
        if ident in _LEVEL:
            return at
        n, body, _ = _vint(data, body)
        at = body + n
    return end


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's body."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise BadMedia(f"lacing cut off at byte {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % n:
            raise BadMedia(f"frames of unequal size at byte {at}")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                raw, at, width = _vint(data, at)
                size = raw if k == 0 else sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise BadMedia(f"lacing beyond its block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> tuple[dict, list[Packet]]:
    """(facts, packets): timestamp scale, tracks and cues of a file, and all its frames."""
    facts: dict = {"scale": 1_000_000, "tracks": {}, "cues": []}
    found: list[Packet] = []
    whole = lambda a, b: int.from_bytes(data[a:b], "big")
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise BadMedia("no EBML header")
    for ident, a, b in top:
        if ident != SEGMENT:
            continue
        for part, c, d in elements(data, a, b):
            if part == INFO:
                facts["scale"] = next((whole(e, f) for k, e, f in elements(data, c, d) if k == TIMESTAMP_SCALE), 1_000_000)
            elif part == TRACKS:
                for k, e, f in elements(data, c, d):
                    if k == TRACK_ENTRY:
                        own = {x: (y, z) for x, y, z in elements(data, e, f)}
                        facts["tracks"][whole(*own[TRACK_NUMBER])] = {"type": whole(*own[TRACK_TYPE]), "codec": data[slice(*own[CODEC_ID])].decode()}
            elif part == CUES:
                for k, e, f in elements(data, c, d):
                    if k == CUE_POINT:
                        point = {x: (y, z) for x, y, z in elements(data, e, f)}
                        for x, y, z in elements(data, e, f):
                            if x == CUE_POSITIONS:
                                own = {p: (q, r) for p, q, r in elements(data, y, z)}
                                facts["cues"].append((whole(*point[CUE_TIME]), whole(*own[CUE_TRACK]), a + whole(*own[CUE_CLUSTER])))
            elif part == CLUSTER:
                base = 0
                start = c
                for k, e, f in elements(data, c, d):
                    blocks = [(k, e, f)] if k == SIMPLE_BLOCK else [x for x in elements(data, e, f) if x[0] == BLOCK] if k == BLOCK_GROUP else []
                    if k == TIMESTAMP:
                        base = whole(e, f)
                    for kind, g, h in blocks:
                        track, g, _ = _vint(data, g)
                        if g + 3 > h:
                            raise BadMedia(f"block cut off at byte {g}")
                        ticks, flags = struct.unpack(">hB", data[g : g + 3])
                        for n, (offset, size) in enumerate(_frames(data, g + 3, h, {0: 0, 1: 1, 2: 2, 3: 3}[flags >> 1 & 3])):
                            found.append(Packet(track, base + ticks, offset, size, kind != SIMPLE_BLOCK or bool(flags & 0x80), start, n))
    return facts, found


def unwrap_bytes(media: bytes, track: int | None = None) -> bytes:
    """The frames of one track (the first by default) in the order of the file."""
    facts, found = parse(media)
    track = track or min(facts["tracks"], default=1)
    return b"".join(media[p.offset : p.offset + p.size] for p in found if p.track == track)


# ---------------------------------------------------------------- columns


def _rows_at_a_time(batches, size: int = 64):
    for batch in batches:
        for k in range(0, max(1, len(batch)), size):
            yield batch.slice(k, size)


def wrap(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """All rows with a Matroska value that holds the payload (binary or string); null stays null."""
    frame = unclashed(df.withColumn(payload, F.col(payload).cast("binary")), [media])

    def run(batches):
        for batch in _rows_at_a_time(batches):
            made = [None if x is None else wrap_bytes(x) for x in batch.column(payload).to_pylist()]
            yield output(batch, batch.schema.names, **{media: pa.array(made, pa.binary())})

    return frame.mapInArrow(run, extended(frame, f"{media} binary"))


PACKET_FIELDS = "track:int timestamp_ns:bigint offset:bigint size:bigint keyframe:boolean cluster:bigint frame:int is_cue:boolean error:string"


def packets(df: DataFrame, media: str = "media") -> DataFrame:
    """One row for each packet: the other columns with track, time, byte range in the value, and whether a cue names its cluster.

    A null or broken value has one row whose ``error`` says what is wrong; a file without
    packets has none.  Columns with the new names are replaced.
    """
    types = dict(x.split(":") for x in PACKET_FIELDS.split())
    frame = unclashed(df, list(types))
    rest = [c for c in frame.columns if c != media]
    schema = extended(frame, ", ".join(f"{k} {t}" for k, t in types.items()), (media,))
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches):
        for batch in _rows_at_a_time(batches, 16):
            rows, source = [], []
            for k, value in enumerate(batch.column(media).to_pylist()):
                try:
                    facts, found = parse(value if value is not None else b"")
                    cued = {(t, c) for _, t, c in facts["cues"]}
                    # a cue names the cluster's first byte, a packet its cluster's body
                    first = {c: min((x for _, x in cued if x < c), key=lambda x: c - x, default=-1) for c in {p.cluster for p in found}}
                    made = [(p.track, p.timestamp * facts["scale"], p.offset, p.size, p.keyframe, p.cluster, p.frame,
                             0 <= first[p.cluster] and p.cluster - first[p.cluster] <= 12 and (p.track, first[p.cluster]) in cued, None) for p in found]
                except (BadMedia, IndexError, KeyError, UnicodeDecodeError, struct.error) as e:
                    made = [(None,) * 8 + (str(e) or type(e).__name__,)]
                rows += made
                source += [k] * len(made)
            part = batch.take(pa.array(source, pa.int64()))
            yield output(part, rest, **{n: pa.array([r[k] for r in rows], arrow[t]) for k, (n, t) in enumerate(types.items())})

    return frame.mapInArrow(run, schema)


def features(samples: np.ndarray, rate: int = RATE) -> str:
    """Duration, level and zero crossings of 8-bit samples, as one string."""
    x = samples.astype(np.int16) - 128
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"ms={len(x) * 1000 // rate};rms={rms:.3f};peak={int(np.abs(x).max())};crossings={crossings}"


DIGEST = "n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string"


def stored_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Store each whole text, padded with zero bytes to a positive multiple of 64, read it back, and describe what came back.

    A null text is the empty one: 64 zero bytes.  Equal texts have equal values.
    """
    types = dict(x.split(":") for x in DIGEST.split())
    frame = unclashed(df, list(types))
    rest = [c for c in frame.columns if c != text]
    schema = extended(frame, ", ".join(f"{k} {t}" for k, t in types.items()), (text,))

    def run(batches):
        for batch in _rows_at_a_time(batches):
            rows = []
            for value in batch.column(text).to_pylist():
                raw = (value or "").encode()
                media = wrap_bytes(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                back = unwrap_bytes(media)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8))))
            yield output(batch, rest, **{n: pa.array([r[k] for r in rows], pa.int64() if t == "bigint" else pa.string()) for k, (n, t) in enumerate(types.items())})

    return frame.mapInArrow(run, schema)


@query("op10_media_matroska")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
