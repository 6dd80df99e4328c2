import hashlib
import random
import zlib

import pytest

from querywright.llm import matroska as M


@pytest.mark.parametrize("kind", range(4))
def test_lacing_round_trip(kind):
    rng = random.Random(kind)
    frames = [rng.randbytes(300 if kind == M.FIXED else rng.choice([1, 5, 200, 255, 256, 700])) for _ in range(1 if kind == M.NO_LACING else 7)]
    body = M.lace(frames, kind)
    assert [body[a:b] for a, b in M.unlace(body, 0, len(body), kind)] == frames


def test_variable_length_integers():
    for v in (0, 1, 126, 127, 128, 16382, 16383, 1 << 20, (1 << 56) - 2):
        data = M.vint(v)
        assert M.read_vint(data, 0) == (v, len(data), False)
    assert M.read_vint(b"\xff", 0)[2] and M.read_vint(b"\x01" + b"\xff" * 7, 0)[2]


@pytest.mark.parametrize("size", [64, 128, 2048, 2112, 100_032])
def test_files_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = M.mux(payload)
    m = M.parse(data)
    assert b"".join(data[a:b] for *_, a, b in m.packets) == payload
    assert m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.duration == size / 8
    assert [t for _, t, *_ in m.packets] == [i * 256 * 125_000 for i in range(-(-size // 256))]
    assert len(m.cues) == len(m.clusters) and [t for t, *_ in m.cues] == sorted(t for t, *_ in m.cues)


def test_cues_point_at_clusters():
    data = M.mux(random.Random(1).randbytes(50_048))
    segment = data.index(M.SEGMENT.to_bytes(4, "big"))
    begin = M.read_vint(data, segment + 4)[1]
    for _, _, p in M.parse(data).cues:
        assert data[begin + p : begin + p + 4] == M.CLUSTER.to_bytes(4, "big")


def test_block_groups_unknown_sizes_and_broken_ends():
    block = M.vint(1) + b"\x00\x05\x00" + b"DATA"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, block) + M.element(M.REFERENCE_BLOCK, b"\xff"))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M.uint(M.CLUSTER_TIMESTAMP, 100) + group
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska")) + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    m = M.parse(data)
    assert [(t, ts, key, data[a:b]) for t, ts, key, a, b in m.packets] == [(1, 105_000_000, False, b"DATA")]
    assert len(M.parse(data[:-3]).packets) == 0 and M.parse(b"").packets == [] and M.parse(b"\x00" * 9).packets == []


def test_query_digests(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "long " * 40_000, "a"]
    rows = M.media_digests(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert tuple(rows[2])[1:] == tuple(rows[7])[1:] and tuple(rows[0])[1:] == tuple(rows[1])[1:]
    assert M.media_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packet_table(spark):
    media = M.media_column(spark.createDataFrame([(1, "z" * 5000)], "doc_id long, text string"))
    rows = M.packet_table(media).orderBy("n").collect()
    data = media.first()["media"]
    assert len(rows) == 20 and bytes(data[rows[0]["begin"] : rows[0]["begin"] + rows[0]["length"]]) == b"z" * 256


def test_clusters_of_unknown_size_end_at_the_next_element():
    def cluster(at, body):
        return M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.uint(M.CLUSTER_TIMESTAMP, at) + M.element(M.SIMPLE_BLOCK, M.vint(1) + b"\x00\x05\x80" + body)

    cues = M.element(M.CUES, M.element(M.CUE_POINT, M.uint(M.CUE_TIME, 100) + M.element(M.CUE_TRACK_POSITIONS, M.uint(M.CUE_TRACK, 1) + M.uint(M.CUE_CLUSTER_POSITION, 0))))
    head = M.element(M.EBML, M.element(M.DOC_TYPE, b"matroska"))
    segment = M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    data = head + segment + cluster(100, b"ONE") + cluster(200, b"TWO") + cues + head + segment + cluster(300, b"NEXT")
    m = M.parse(data)
    assert [(ts, data[a:b]) for _, ts, _, a, b in m.packets] == [(105_000_000, b"ONE"), (205_000_000, b"TWO"), (305_000_000, b"NEXT")]
    assert m.cues == [(100_000_000, 1, 0)] and len(m.clusters) == 3
