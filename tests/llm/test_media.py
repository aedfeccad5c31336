"""Matroska values: exact round trips, all lacing kinds, unknown sizes, cues and broken input."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelake.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 300))
def test_round_trip(payload, frame):
    assert M.unwrap_bytes(M.wrap_bytes(payload, frame=frame)) == payload


def block(frames, kind, timestamp=0, track=1):
    return M.element(M.SIMPLE_BLOCK, bytes([0x80 | track]) + timestamp.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + M.lace(frames, kind))


def file_of(*clusters, tail=b""):
    tracks = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.number(M.TRACK_NUMBER, 1) + M.number(M.TRACK_TYPE, 2) + M.element(M.CODEC_ID, b"A_PCM/INT/LIT")))
    return M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska")) + M.element(M.SEGMENT, tracks + b"".join(clusters) + tail)


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_lacing(kind):
    random.seed(kind)
    for _ in range(40):
        n = random.randrange(1, 9)
        sizes = [random.choice([0, 1, 254, 255, 256, 511, 9000]) for _ in range(n)] if kind != 2 else [random.choice([0, 7, 600])] * n
        frames = [random.randbytes(s) for s in sizes]
        data = file_of(M.element(M.CLUSTER, M.number(M.TIMESTAMP, 5) + block(frames, kind, -2)))
        _, found = M.parse(data)
        assert [data[p.offset : p.offset + p.size] for p in found] == frames
        assert {p.timestamp for p in found} == {3} and [p.frame for p in found] == list(range(n))


def test_unknown_sizes_groups_and_voids():
    inside = M.number(M.TIMESTAMP, 7) + M.element(0xEC, bytes(9)) + M.element(M.BLOCK_GROUP, M.element(M.BLOCK, b"\x81\x00\x01\x00abc") + M.number(0x9B, 4))
    unknown = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + inside
    data = file_of(unknown, M.element(M.CLUSTER, M.number(M.TIMESTAMP, 9) + block([b"z"], 0)))
    _, found = M.parse(data)
    assert [(p.timestamp, data[p.offset : p.offset + p.size]) for p in found] == [(8, b"abc"), (9, b"z")]


def test_packet_table_covers_the_payload_and_cues_name_clusters(spark):
    payload = bytes(range(256)) * 2000
    df = spark.createDataFrame([(1, payload), (2, None), (3, b""), (1, payload)], "id bigint, payload binary").selectExpr("*", "'old' AS track")
    wrapped = M.wrap(df, "payload")
    stored = {r.id: r.media and bytes(r.media) for r in wrapped.collect()}
    rows = M.packets(wrapped).collect()
    own = sorted({(r.offset, r.size, r.timestamp_ns, r.is_cue) for r in rows if r.id == 1})
    assert b"".join(stored[1][o : o + n] for o, n, _, _ in own) == payload
    assert all(c for *_, c in own) and [t for _, _, t, _ in own] == sorted(t for _, _, t, _ in own)
    assert sum(r.id == 1 for r in rows) == 2 * len(own)
    assert [r.error for r in rows if r.id == 2] == ["no EBML header"] and not [r for r in rows if r.id == 3]
    assert M.packets(wrapped.limit(0)).count() == 0


def test_broken_values_give_one_row_each(spark):
    good = M.wrap_bytes(b"x" * 3000)
    bad = [b"junk", good[: len(good) // 2], good[:30], b"\x00" * 9]
    rows = M.packets(spark.createDataFrame(list(enumerate(bad)), "id bigint, media binary")).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2, 3] and all(r.error for r in rows)


def test_stored_digest(spark):
    texts = [None, "", "a", "x" * 64, "é" * 32, "y" * 65, "long " * 40000, "a"]
    got = {r.doc_id: r for r in M.stored_digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
