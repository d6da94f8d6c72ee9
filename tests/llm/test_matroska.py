import hashlib
import zlib

import numpy as np
import pytest
from spanwise.llm import matroska as m
from spanwise.session import load


def file_of(clusters, scale=1_000_000, step=0, unknown=False, extra=b""):
    """A file of clusters (time, [element])."""
    track = m._number(m.TRACK_NUMBER, 1) + (m._number(m.DEFAULT_DURATION, step) if step else b"")
    body = m.element(m.INFO, m._number(m.TIMESTAMP_SCALE, scale)) + m.element(m.TRACKS, m.element(m.TRACK, track))
    for time, blocks in clusters:
        inner = m._number(m.TIMESTAMP, time) + b"".join(blocks)
        body += m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + inner if unknown else m.element(m.CLUSTER, inner)
    body += extra
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    return head + (m.SEGMENT.to_bytes(4, "big") + b"\xff" + body if unknown else m.element(m.SEGMENT, body))


@pytest.mark.parametrize("unknown", [False, True])
@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing, unknown):
    rng = np.random.default_rng(lacing)
    sizes = [300] * 4 if lacing == 2 else [7] if not lacing else [0, 255, 600, 254, 3, 70_000, 1]
    frames = [rng.bytes(n) for n in sizes]
    simple = m.element(m.SIMPLE_BLOCK, m.block(1, -5, frames, lacing))
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(1, 9, frames, lacing)) + m._number(m.REFERENCE, 1))
    data = file_of([(100, [simple, m.element(m.VOID, b"xx")]), (200, [group])], step=2_000_000, unknown=unknown)
    found = m.parse(data)
    assert [data[b : b + n] for _, _, _, b, n, _ in found.packets] == frames * 2
    assert [p[1] for p in found.packets] == [95 + 2 * k for k in range(len(frames))] + [209 + 2 * k for k in range(len(frames))]
    assert [p[2] for p in found.packets] == [True] * len(frames) + [False] * len(frames)


def test_cues_point_at_clusters():
    data = m.mux(bytes(range(256)) * 9 * 400)
    found = m.parse(data)
    assert len(found.packets) == 1600 and len(found.cues) == 7 and found.lacings == {2}
    segment = next(a for name, a, _ in m.children(data, 0, len(data)) if name == m.SEGMENT)
    for time, track, place in found.cues:
        assert m.element_id(data, segment + place)[0] == m.CLUSTER and track == 1
    assert [p[1] for p in found.packets if p[5] == found.packets[256][5]][0] == found.cues[1][0]


def test_bad_streams(spark):
    good = m.mux(b"a" * 576)
    bad = [b"", b"text", good[:30], good[:-3], b"\x00" * 40, None, good]
    rows = m.packets(spark.createDataFrame([(i, bytearray(b) if b is not None else None, 5) for i, b in enumerate(bad)], "id long, media binary, size long")).collect()
    assert sorted((r["id"], r["error"] is None) for r in rows) == [(i, i == 6) for i in range(7)]
    assert next(r["size"] for r in rows if r["id"] == 6) == 576


def test_round_trip(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, sf_dir, "documents").collect()] + [(None, None), (-1, ""), (-2, "é" * 288), (-3, "x" * 576 * 300), (-3, "x" * 576 * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.digests(docs).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        full = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        want.append((str(d), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    assert all(r["media_bytes"] > r["payload_bytes"] and "packets=" in r["feature"] for r in got)
    assert m.digests(docs.limit(0)).collect() == []
