"""Matroska columns: a writer for 8-bit audio samples, and a parser to packet tables.

Elements follow RFC 8794 (EBML) and RFC 9559 (Matroska): an id and a size of
variable length, then data or further elements. The parser takes any file: it
reads tracks, clusters, SimpleBlocks and BlockGroups with Xiph, EBML and
fixed-size lacing, and cues, and lists one packet for each frame with its track,
timestamp and byte range. Elements of unknown size end where the next element
cannot be their child.

The writer stores a payload losslessly as 8-bit PCM samples, so that any bytes
survive. Null texts count as empty; an empty payload is 64 zero bytes.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7
EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements, and those that may stand beside a cluster or segment of unknown size.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {SEGMENT, EBML}
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
SAMPLE_RATE = 8000


# ---- reading


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id (marker bits kept) and where it ends."""
    first = data[at]
    size = 9 - first.bit_length()
    if size > 4 or at + size > len(data):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + size], "big"), at + size


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A number of variable length (None: unknown, all bits set) and where it ends."""
    size = 9 - data[at].bit_length()
    if size > 8 or at + size > len(data):
        raise ValueError(f"no element size at byte {at}")
    value = int.from_bytes(data[at : at + size], "big") ^ (1 << 7 * size)
    return (None if value == (1 << 7 * size) - 1 else value), at + size


@dataclass
class Packet:
    track: int
    timestamp: int  # nanoseconds
    start: int
    size: int
    keyframe: bool
    lacing: int
    cluster: int


@dataclass
class Media:
    """What a file holds: tracks by number, packets in file order, cues as (time, track, cluster's byte)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    unreadable: int | None = None


def unsigned(data: bytes) -> int:
    return int.from_bytes(data, "big")


def real(data: bytes) -> float:
    return struct.unpack(">f" if len(data) == 4 else ">d", data)[0] if data else 0.0


def frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Start and size of each frame of a block whose frame data begin at ``at``."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING:
        for i in range(count - 1):
            width = 9 - data[at].bit_length()
            value, at = read_size(data, at)
            if value is None:
                value = (1 << 7 * width) - 1
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % count:
            raise ValueError("frames of fixed size do not fill the block")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames reach beyond their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Read a file. A damaged file gives what precedes the damage, and ``unreadable`` says where that begins."""
    media, state = Media(), {"time": 0, "segment": 0, "cluster": 0}

    def block(at: int, end: int, simple: bool, group: dict) -> None:
        track, at = read_size(data, at)
        relative = struct.unpack(">h", data[at : at + 2])[0]
        flags, at = data[at + 2], at + 3
        lacing = flags >> 1 & 3
        each = media.tracks.get(track, {}).get("frame_ns") or 0
        found = frames(data, at, end, lacing)
        begin = (state["time"] + relative) * media.scale
        if not each and group.get("duration") and found:
            each = group["duration"] * media.scale // len(found)
        for i, (start, size) in enumerate(found):
            media.packets.append(Packet(track, begin + i * each, start, size, bool(flags & 0x80) if simple else not group.get("reference"), lacing, len(media.clusters) - 1))

    def walk(at: int, end: int, parent: int, into: dict) -> int:
        while at < end:
            here = at
            try:
                kind, at = read_id(data, at)
                size, at = read_size(data, at)
            except (ValueError, IndexError):
                media.unreadable = here if media.unreadable is None else media.unreadable
                return end
            if into.get("open") and (kind in TOP or parent == CLUSTER and kind in LEVEL_1):
                return here
            stop = end if size is None else at + size
            if stop > end:
                media.unreadable = here if media.unreadable is None else media.unreadable
                return end
            body = {"open": size is None}
            try:
                if kind == SEGMENT:
                    state["segment"] = at
                elif kind == CLUSTER:
                    media.clusters.append(here)
                if kind in MASTERS or kind == EBML:
                    stop = walk(at, stop, kind, body)
                    if kind == TRACK_ENTRY:
                        media.tracks[body.get("number", 0)] = {k: v for k, v in body.items() if k != "open"}
                    elif kind == AUDIO:
                        into |= {k: v for k, v in body.items() if k != "open"}
                    elif kind == BLOCK_GROUP and "block" in body:
                        block(*body["block"], False, body)
                    elif kind == CUE_POINT:
                        media.cues += [(body.get("cue_time", 0), t, p + state["segment"]) for t, p in body.get("places", [])]
                    elif kind == CUE_TRACK_POSITIONS:
                        into.setdefault("places", []).append((body.get("cue_track", 0), body.get("position", 0)))
                elif kind == SIMPLE_BLOCK:
                    block(at, stop, True, {})
                elif kind == BLOCK:
                    into["block"] = (at, stop)
                else:
                    leaf(kind, data[at:stop], into)
            except (IndexError, ValueError, struct.error):
                media.unreadable = here if media.unreadable is None else media.unreadable
                return end
            at = stop
        return at

    def leaf(kind: int, value: bytes, into: dict) -> None:
        if kind == TIMESTAMP:
            state["time"] = unsigned(value)
        elif kind == TIMESTAMP_SCALE:
            media.scale = unsigned(value)
        elif kind == DURATION:
            media.duration = real(value)
        elif kind == DOC_TYPE:
            media.doc_type = value.rstrip(b"\0").decode("ascii", "replace")
        elif kind == CODEC_ID:
            into["codec"] = value.rstrip(b"\0").decode("ascii", "replace")
        elif kind == SAMPLING_FREQUENCY:
            into["rate"] = real(value)
        elif kind == REFERENCE:
            into["reference"] = True
        elif name := {TRACK_NUMBER: "number", TRACK_UID: "uid", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits", BLOCK_DURATION: "duration", CUE_TIME: "cue_time", CUE_TRACK: "cue_track", CUE_CLUSTER_POSITION: "position"}.get(kind):
            into[name] = unsigned(value)

    walk(0, len(data), 0, {})
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The frames of a track, joined."""
    return b"".join(data[p.start : p.start + p.size] for p in media.packets if p.track == track)


def features(media: Media) -> str:
    """A short description of a file's packets, as JSON."""
    sizes = [p.size for p in media.packets]
    return json.dumps({
        "tracks": {str(n): [t.get("codec"), t.get("rate"), t.get("bits")] for n, t in sorted(media.tracks.items())},
        "packets": len(sizes), "bytes": sum(sizes), "smallest": min(sizes, default=0), "largest": max(sizes, default=0),
        "clusters": len(media.clusters), "cues": len(media.cues), "laced": sum(p.lacing != NO_LACING for p in media.packets),
        "last_ns": media.packets[-1].timestamp if media.packets else 0, "duration": media.duration,
    }, sort_keys=True)


# ---- writing


def number(value: int, width: int = 0) -> bytes:
    """A size of variable length, in ``width`` bytes or as few as will do."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def whole(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block_body(track: int, relative: int, parts: list[bytes], lacing: int) -> bytes:
    """A SimpleBlock's body with the given lacing."""
    head = number(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return head + b"".join(parts)
    head += bytes([len(parts) - 1])
    if lacing == XIPH:
        for p in parts[:-1]:
            head += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
    elif lacing == EBML_LACING:
        before = None
        for p in parts[:-1]:
            if before is None:
                head += number(len(p))
            else:
                change = len(p) - before
                width = next(w for w in range(1, 9) if abs(change) < (1 << 7 * w - 1) - 1)
                head += number(change + (1 << 7 * width - 1) - 1, width)
            before = len(p)
    return head + b"".join(parts)


def write(payload: bytes, frame: int = 512, laced: int = 8, cluster_blocks: int = 16) -> bytes:
    """A file with one track of 8-bit samples: ``frame`` samples a packet, ``laced`` packets a block."""
    frame_ms = frame * 1000 // SAMPLE_RATE
    head = element(EBML, whole(EBML_VERSION, 1) + whole(EBML_READ_VERSION, 1) + whole(EBML_MAX_ID, 4) + whole(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + whole(DOC_VERSION, 4) + whole(DOC_READ_VERSION, 2))
    app = b"quarrylog"
    info = element(INFO, whole(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXING_APP, app) + element(WRITING_APP, app))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + whole(CHANNELS, 1) + whole(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, whole(TRACK_NUMBER, 1) + whole(TRACK_UID, 1) + whole(TRACK_TYPE, 2) + whole(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + whole(DEFAULT_DURATION, frame * 1_000_000_000 // SAMPLE_RATE) + audio)
    body = bytearray(info + element(TRACKS, track))
    cues, step = b"", frame * laced
    for c in range(0, len(payload), step * cluster_blocks):
        begin = c // frame * frame_ms
        cues += element(CUE_POINT, whole(CUE_TIME, begin) + element(CUE_TRACK_POSITIONS, whole(CUE_TRACK, 1) + whole(CUE_CLUSTER_POSITION, len(body))))
        cluster = bytearray(whole(TIMESTAMP, begin))
        for b in range(c, min(c + step * cluster_blocks, len(payload)), step):
            piece = payload[b : b + step]
            parts = [piece[i : i + frame] for i in range(0, len(piece), frame)]
            lacing = NO_LACING if len(parts) == 1 else FIXED if len(parts[-1]) == frame else EBML_LACING
            cluster += element(SIMPLE_BLOCK, block_body(1, b // frame * frame_ms - begin, parts, lacing))
        body += element(CLUSTER, bytes(cluster))
    return head + element(SEGMENT, bytes(body + element(CUES, cues)))


# ---- columns


def padded(text: str | None) -> bytes:
    """UTF-8 bytes with zeros appended up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % 64 if data else 64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each docs(doc_id, text) as a file of 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                texts = batch.column("text").to_pylist()
                sizes = [len((t or "").encode()) for t in texts]
                media = pa.array([write(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame, track: int = 1) -> DataFrame:
    """stored(doc_id, n_bytes, media) with payload (frames of the track, null for a null file) and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                payloads, said = [], []
                for data in batch.column("media").to_pylist():
                    media = parse(data) if data is not None else None
                    payloads.append(payload_of(data, media, track) if media else None)
                    said.append(features(media) if media else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(said, pa.string())], names=["doc_id", "n_bytes", "media", "payload", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def packets(stored: DataFrame) -> DataFrame:
    """One row for each packet of stored(doc_id, media): track, timestamp_ns, start and size in the file, keyframe, lacing, cluster."""
    names = ["doc_id", "packet", "track", "timestamp_ns", "start", "size", "keyframe", "lacing", "cluster"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 200):
                rows = [
                    (doc, n, p.track, p.timestamp, p.start, p.size, p.keyframe, p.lacing, p.cluster)
                    for doc, data in zip(*(big.slice(i, 200).column(c).to_pylist() for c in ("doc_id", "media")), strict=True)
                    if data is not None
                    for n, p in enumerate(parse(data).packets)
                ]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                kinds = [pa.bool_() if c == "keyframe" else pa.int64() for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return stored.select("doc_id", "media").mapInArrow(run, ", ".join(f"{c} {'boolean' if c == 'keyframe' else 'long'}" for c in names))


def digest(read: DataFrame) -> DataFrame:
    """Lengths and checksums of read_back()'s rows."""
    return read.select(
        "doc_id", "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
