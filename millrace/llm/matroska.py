"""Matroska media columns: files in a binary column become a table of packets.

The reader walks the EBML elements of a file (variable-length ids and sizes, sizes left open included), reads tracks,
clusters, simple blocks and block groups with all four kinds of lacing, and the cues, and gives one row per packet with
track, timestamp and byte range. The writer lays bytes down as 8-bit PCM samples in laced blocks, clusters and cues.
Both work on one file at a time inside a task; Spark deals the files out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import parts, table
from millrace.session import map_arrow

# Element ids of the format (fixed values).
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
CONTENT_ENCODINGS = 0x6D80
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Ids that end a cluster or a segment whose size was left open.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")

UNIT = 64
RATE = 8000
FRAME = 512  # samples in a packet: 64 ms
LACED = 8  # packets in a block
CLUSTER_BLOCKS = 16
TAIL = 64


def vint(data: memoryview, at: int, end: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for a size with all bits set (left open)."""
    if at >= end or data[at] == 0:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"a variable-length integer at byte {at} is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if not keep_marker:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n


def elements(data: memoryview, at: int, end: int, stop: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, begin and end of the body) of each element; an open size reaches to the next element in TOP."""
    while at < end:
        kind, body = vint(data, at, end, keep_marker=True)
        if kind in stop:
            return
        size, body = vint(data, body, end)
        if size < 0:
            after = end
            if kind == CLUSTER:
                after = body
                for _, _, after in elements(data, body, end, TOP):
                    pass
        else:
            after = body + size
            if after > end:
                raise ValueError(f"the element at byte {at} is cut off")
        yield kind, body, after
        at = after


def lace_sizes(data: memoryview, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames in a block whose header ends at `at`, and where the first frame begins."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError(f"a laced block is cut off at byte {at}")
    n = data[at] + 1
    at += 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError(f"a fixed lace at byte {at} does not divide")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"a lace is cut off at byte {at}")
                at += 1
                size += data[at - 1]
                if data[at - 1] < 255:
                    break
        else:
            start = at
            size, at = vint(data, at, end)
            if k:
                width = at - start
                raw = size if size >= 0 else (1 << 7 * width) - 1
                size = sizes[-1] + raw - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError(f"a lace at byte {at} is longer than its block")
    return [*sizes, last], at


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, duration in ns or None, cluster, block, lacing, keyframe, begin, size)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)  # the byte at which each begins
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # timestamp in ns, track, byte of the cluster

    def cued(self) -> list[bool]:
        """Whether a cue leads to each packet: the first of a block, by time and track, in the cluster that the cue names."""
        places, out, block = set(self.cues), [], -1
        for track, time, _, cluster, of, *_ in self.packets:
            out.append(of != block and (time, track, self.clusters[cluster]) in places)
            block = of
        return out


def unsigned(data: memoryview, body: int, after: int) -> int:
    return int.from_bytes(data[body:after], "big")


def real(data: memoryview, body: int, after: int) -> float:
    return struct.unpack(">d" if after - body == 8 else ">f", data[body:after])[0] if after - body in (4, 8) else 0.0


def parse(raw: bytes) -> Media:
    """Raises ValueError where the bytes are no Matroska file or are cut off."""
    data, out = memoryview(raw), Media()
    seen = False
    for kind, body, after in elements(data, 0, len(data)):
        if kind == EBML:
            seen = True
            out.doc_type = next((bytes(data[b:a]).decode("ascii", "replace") for k, b, a in elements(data, body, after) if k == DOC_TYPE), "matroska")
        elif kind == SEGMENT and seen:
            segment(data, body, after, out)
    if not seen:
        raise ValueError("the bytes do not begin with an EBML header")
    return out


def segment(data: memoryview, body: int, after: int, out: Media) -> None:
    begins = body
    for kind, b, a in elements(data, body, after):
        at_byte, begins = begins, a
        if kind == INFO:
            for k, x, y in elements(data, b, a):
                if k == TIMESTAMP_SCALE:
                    out.scale = unsigned(data, x, y)
                elif k == DURATION:
                    out.duration = real(data, x, y)
        elif kind == TRACKS:
            for k, x, y in elements(data, b, a):
                if k == TRACK_ENTRY:
                    track(data, x, y, out)
        elif kind == CLUSTER:
            out.clusters.append(at_byte)
            cluster(data, b, a, out)
        elif kind == CUES:
            for k, x, y in elements(data, b, a):
                if k == CUE_POINT:
                    time, places = 0, []
                    for k2, x2, y2 in elements(data, x, y):
                        if k2 == CUE_TIME:
                            time = unsigned(data, x2, y2)
                        elif k2 == CUE_POSITIONS:
                            at = {k3: unsigned(data, x3, y3) for k3, x3, y3 in elements(data, x2, y2)}
                            places.append((at.get(CUE_TRACK, 0), body + at.get(CUE_CLUSTER, 0)))
                    out.cues.extend((time * out.scale, t, p) for t, p in places)


def track(data: memoryview, body: int, after: int, out: Media) -> None:
    got: dict = {"type": 0, "codec": "", "frame_ns": None, "rate": None, "channels": 1, "bits": None}
    number = 0
    for k, x, y in elements(data, body, after):
        if k == TRACK_NUMBER:
            number = unsigned(data, x, y)
        elif k == TRACK_TYPE:
            got["type"] = unsigned(data, x, y)
        elif k == CODEC_ID:
            got["codec"] = bytes(data[x:y]).decode("ascii", "replace").rstrip("\0")
        elif k == DEFAULT_DURATION:
            got["frame_ns"] = unsigned(data, x, y)
        elif k == CONTENT_ENCODINGS:
            raise ValueError("a track's frames are encoded (compressed, stripped or encrypted)")
        elif k == AUDIO:
            for k2, x2, y2 in elements(data, x, y):
                if k2 == SAMPLING:
                    got["rate"] = real(data, x2, y2)
                elif k2 == CHANNELS:
                    got["channels"] = unsigned(data, x2, y2)
                elif k2 == BIT_DEPTH:
                    got["bits"] = unsigned(data, x2, y2)
    out.tracks[number] = got


def cluster(data: memoryview, body: int, after: int, out: Media) -> None:
    base, n = 0, len(out.clusters) - 1
    for k, x, y in elements(data, body, after):
        if k == TIMESTAMP:
            base = unsigned(data, x, y)
        elif k == SIMPLE_BLOCK:
            block(data, x, y, base, n, None, None, out)
        elif k == BLOCK_GROUP:
            inner = {k2: (x2, y2) for k2, x2, y2 in elements(data, x, y)}
            if BLOCK in inner:
                lasts = unsigned(data, *inner[BLOCK_DURATION]) * out.scale if BLOCK_DURATION in inner else None
                block(data, *inner[BLOCK], base, n, REFERENCE not in inner, lasts, out)


def block(data: memoryview, body: int, after: int, base: int, in_cluster: int, key: bool | None, lasts: int | None, out: Media) -> None:
    number, at = vint(data, body, after)
    if at + 3 > after:
        raise ValueError(f"the block at byte {body} is cut off")
    time = (base + struct.unpack(">h", data[at : at + 2])[0]) * out.scale
    flags = data[at + 2]
    sizes, at = lace_sizes(data, at + 3, after, flags >> 1 & 3)
    frame_ns = out.tracks.get(number, {}).get("frame_ns") or (lasts // len(sizes) if lasts else None)
    of = out.packets[-1][4] + 1 if out.packets else 0
    for k, size in enumerate(sizes):
        out.packets.append((number, time + k * (frame_ns or 0), frame_ns, in_cluster, of, LACINGS[flags >> 1 & 3], bool(flags & 0x80) if key is None else key, at, size))
        at += size


def element(kind: int, body: bytes) -> bytes:
    size, n = len(body), 1
    while size >= (1 << 7 * n) - 1:
        n += 1
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (size | 1 << 7 * n).to_bytes(n, "big") + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_vint(delta: int) -> bytes:
    n = 1
    while abs(delta) >= (1 << 7 * n - 1) - 1:
        n += 1
    return (delta + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")


def laced(frames: list[bytes], time: int) -> bytes:
    """A simple block of track 1: one frame plainly, equal frames with fixed lacing, others with EBML lacing."""
    sizes = [len(f) for f in frames]
    lacing = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = b"\x81" + struct.pack(">h", time) + bytes([0x80 | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 3:
        n = 1
        while sizes[0] >= (1 << 7 * n) - 1:
            n += 1
        head += (sizes[0] | 1 << 7 * n).to_bytes(n, "big") + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """The bytes as one track of 8-bit unsigned PCM, one channel."""
    ms = 1000 * FRAME // RATE
    frames = [payload[at : at + FRAME] for at in range(0, len(payload), FRAME)]
    blocks = [frames[at : at + LACED] for at in range(0, len(frames), LACED)]
    audio = element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + element(AUDIO, audio)
    info = number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / RATE))
    parts = [element(INFO, info), element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), b""
    for c in range(0, len(blocks), CLUSTER_BLOCKS):
        base = c * LACED * ms
        body = number(TIMESTAMP, base) + b"".join(laced(b, k * LACED * ms) for k, b in enumerate(blocks[c : c + CLUSTER_BLOCKS]))
        cues += element(CUE_POINT, number(CUE_TIME, base) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at)))
        parts.append(element(CLUSTER, body))
        at += len(parts[-1])
    parts.append(element(CUES, cues))
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return head + element(SEGMENT, b"".join(parts))


def packed(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and its bytes with zeros up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


PACKETS = "track int, codec string, timestamp_ns long, duration_ns long, cluster int, block int, lacing string, keyframe boolean, begin long, size long, cue boolean"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each file: id, packet (its place in the file), the columns of PACKETS, error.

    cue says whether a cue leads to the packet. A file that is null, empty, no Matroska, cut off or with encoded frames
    gives one row with the error and no packet; so does one without packets, with an empty error. Null and repeated ids
    and equal files are read each; other columns are not read; an empty table gives an empty one.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["packet", *(x.split()[0] for x in PACKETS.split(", ")), "error"]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for at, raw in enumerate(b.column(1)):
                try:
                    got = parse(raw.as_py() or b"")
                    rows = [(k, p[0], got.tracks.get(p[0], {}).get("codec"), *p[1:], c, None) for k, (p, c) in enumerate(zip(got.packets, got.cued(), strict=True))] or [(*[None] * 12, "")]
                except ValueError as e:
                    rows = [(*[None] * 12, str(e))]
                for begin in range(0, len(rows), 10_000):
                    some = rows[begin : begin + 10_000]
                    cols = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([at] * len(some))), *cols], names=[id_col, *names])

    return map_arrow(media.select(id_col, media_col), run, f"{id_col} {kind}, packet int, {PACKETS}, error string")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, media (a Matroska file that holds the text's bytes as samples). A null text
    counts as empty, and an empty one is UNIT zero samples. Null and repeated ids are stored each; other columns of docs are
    not read; an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            n, files = [], []
            for t in b.column(1):
                size, payload = packed(t.as_py())
                n.append(size)
                files.append(mux(payload))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes long, media binary")


def described(got: Media, samples: bytes) -> str:
    """Counts of the container and moments of its samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    mean, spread = (float(x.mean()), float(x.std())) if len(x) else (0.0, 0.0)
    steps = int(np.count_nonzero(x[1:] != x[:-1]))
    last = got.packets[-1] if got.packets else (0, 0, 0)
    return f"packets={len(got.packets)};blocks={last[4] + 1 if got.packets else 0};clusters={len(got.clusters)};cues={sum(got.cued())};last_ms={last[1] // 1_000_000};mean={mean:.3f};spread={spread:.3f};steps={steps}"


def features(media: DataFrame, id_col: str = "doc_id", size_col: str = "n_bytes", media_col: str = "media") -> DataFrame:
    """Reads each file back through its packets: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature. A file that cannot be read has nulls for the payload and the error as its feature; a null file
    is an empty one. Repeated rows are read each; other columns are not read; an empty table gives an empty one."""
    kind = media.schema[id_col].dataType.simpleString()
    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def of(raw: bytes) -> tuple:
        stored_form = (len(raw), hashlib.sha256(raw).hexdigest())
        try:
            got = parse(raw)
        except ValueError as e:
            return (None, None, None, *stored_form, f"error={e}")
        payload = b"".join(raw[begin : begin + size] for *_, begin, size in got.packets)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), *stored_form, described(got, payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            rows = [of(raw.as_py() or b"") for raw in b.column(2)]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)] if rows else [pa.array([], t) for t in types.values()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[id_col, size_col, *types])

    return map_arrow(media.select(id_col, size_col, media_col), run, f"{id_col} {kind}, {size_col} long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(table(spark, sf_dir, "documents")))
