"""The container's round trip, its lacings, and the packet table."""

import zlib

import brute
import pytest

from millrace.llm import matroska


def padded(text):
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def test_round_trip(odd, none):
    got = sorted(repr((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in matroska.features(matroska.stored(odd)).collect())
    want = []
    for r in odd.select("doc_id", "text").collect():
        p = padded(r.text)
        want.append(repr((r.doc_id, len((r.text or "").encode()), len(p), brute.sha(p), zlib.crc32(p[-64:]))))
    assert got == sorted(want)
    assert matroska.features(matroska.stored(none)).count() == 0


def test_equal_texts_have_equal_values(odd):
    media = matroska.stored(odd)
    by_text = {}
    for r in matroska.features(media).join(odd.select("doc_id", "text").where("doc_id > 10").dropDuplicates(["doc_id"]), "doc_id").collect():
        by_text.setdefault(r.text or "", set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_packets_are_byte_ranges_in_order(spark):
    docs = spark.createDataFrame([(1, "abc" * 5000)], "doc_id long, text string")
    media = matroska.stored(docs)
    raw = bytes(media.first().media)
    rows = matroska.packet_table(media).orderBy("packet").collect()
    assert b"".join(raw[r.begin : r.begin + r["size"]] for r in rows) == padded("abc" * 5000)
    assert [r.packet for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacings(lacing):
    """Xiph, fixed and EBML lacing of three frames, written here byte by byte."""
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == 2 else [b"a" * 300, b"b" * 5, b"c" * 70]
    head = b"\x81" + (7).to_bytes(2, "big") + bytes([0x80 | lacing << 1]) + bytes([2])
    if lacing == 1:
        head += b"\xff\x2d" + b"\x05"
    elif lacing == 3:
        head += (0x4000 | 300).to_bytes(2, "big") + (0x4000 | (5 - 300 + 0x1FFF)).to_bytes(2, "big")
    block = matroska.element(matroska.SIMPLE_BLOCK, head + b"".join(frames))
    cluster = matroska.element(matroska.CLUSTER, matroska.number(matroska.TIMESTAMP, 10) + block)
    track = matroska.element(matroska.TRACKS, matroska.element(matroska.TRACK_ENTRY, matroska.number(matroska.TRACK_NUMBER, 1)))
    raw = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"matroska")) + matroska.element(matroska.SEGMENT, track + cluster)
    got = matroska.parse(raw)
    assert [raw[b : b + s] for *_, b, s in got.packets] == frames
    assert got.packets[0][1] == 17_000_000


def made(*clusters: bytes, cues: bytes = b"", entry: bytes = b"", open_segment: bool = False) -> bytes:
    """A file of one track: the header, the track, clusters, cues."""
    m = matroska
    track = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1) + entry))
    body = track + b"".join(clusters) + cues
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska"))
    return head + (m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body if open_segment else m.element(m.SEGMENT, body))


def test_block_groups_open_sizes_and_cues(spark):
    m = matroska
    frame = lambda time, data, flags=0: b"\x81" + time.to_bytes(2, "big", signed=True) + bytes([flags]) + data
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, frame(-5, b"abc")) + m.number(m.BLOCK_DURATION, 20))
    later = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, frame(40, b"defg")) + m.element(m.REFERENCE, b"\xd3"))
    one = m.number(m.TIMESTAMP, 100) + group + later
    first = m.CLUSTER.to_bytes(4, "big") + b"\xff" + one  # its size is left open
    second = m.element(m.CLUSTER, m.number(m.TIMESTAMP, 300) + m.element(m.SIMPLE_BLOCK, frame(0, b"hi", 0x80)) + m.element(m.SIMPLE_BLOCK, frame(9, b"j")))
    at = len(m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1))))
    point = lambda time, where: m.element(m.CUE_POINT, m.number(m.CUE_TIME, time) + m.element(m.CUE_POSITIONS, m.number(m.CUE_TRACK, 1) + m.number(m.CUE_CLUSTER, where)))
    cues = m.element(m.CUES, point(95, at) + point(309, at + len(first)) + point(300, 7))
    for open_segment in (False, True):
        raw = made(first, second, cues=cues, open_segment=open_segment)
        got = spark.createDataFrame([(1, bytearray(raw), "x"), (None, bytearray(raw), "y")], "doc_id long, media binary, packet string")
        rows = [r for r in m.packet_table(got).collect() if r.doc_id == 1]
        assert [(r.timestamp_ns // 10**6, r.duration_ns, r.cluster, r.block, r.keyframe, raw[r.begin : r.begin + r["size"]], r.cue) for r in sorted(rows, key=lambda r: r.packet)] == [
            (95, 20_000_000, 0, 0, True, b"abc", True), (140, None, 0, 1, False, b"defg", False), (300, None, 1, 2, True, b"hi", False), (309, None, 1, 3, False, b"j", True),
        ]
    stored = m.parse(m.mux(b"x" * 200_000))
    assert len(stored.clusters) == len(stored.cues) == sum(stored.cued()) > 2


def test_packet_table_of_odd_rows(spark):
    coded = made(entry=matroska.element(matroska.CONTENT_ENCODINGS, b""))
    rows = [(1, None), (2, b""), (None, b"no"), (3, made()), (3, made()), (4, coded), (5, made()[:-1])]
    got = matroska.packet_table(spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in rows], "doc_id long, media binary")).collect()
    assert sorted((r.doc_id or 0, r.error == "") for r in got) == [(0, False), (1, False), (2, False), (3, True), (3, True), (4, False), (5, False)]
    assert all(r.packet is None for r in got)
    assert matroska.packet_table(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_stored_form_and_feature(spark):
    """media_* and feature of a small text, worked out from the bytes here."""
    text = "ab" * 2000
    raw = matroska.mux(padded(text))
    x = list(padded(text))
    mean = sum(x) / len(x)
    spread = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
    steps = sum(a != b for a, b in zip(x, x[1:], strict=False))
    (r,) = matroska.features(matroska.stored(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert (r.media_bytes, r.media_sha256) == (len(raw), brute.sha(raw))
    assert r.feature == f"packets=8;blocks=1;clusters=1;cues=1;last_ms={7 * 64};mean={mean:.3f};spread={spread:.3f};steps={steps}"


def test_broken_files_are_reported(spark):
    whole = matroska.mux(b"x" * 640)
    media = spark.createDataFrame([(1, 5, bytearray(whole[:-100])), (2, 5, bytearray(b"no")), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r.payload_sha256 is None and r.feature.startswith("error=") for r in matroska.features(media).collect())
