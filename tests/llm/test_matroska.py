import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodgely.llm import matroska as M


def test_query(odd, none):
    for r in M.op4_matroska(odd).collect():
        pass
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in M.op4_matroska(odd).collect():
        raw = texts[r.doc_id]
        full = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]), None)
        media = M.mux(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    same = {r.feature for r in M.op4_matroska(odd).filter("doc_id in (1, 10)").collect()}
    assert len(same) == 1 and M.op4_matroska(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=700), min_size=1, max_size=9), st.sampled_from([M.XIPH, M.EBML_LACING]), st.booleans())
def test_lacing(frames, lacing, unknown):
    body = M.uint(M.TIMESTAMP, 7) + M.block(1, 5, frames, lacing)
    cluster = M.element(M.CLUSTER, body) if not unknown else M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    data = M.element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M.element(M.INFO, M.uint(M.SCALE, 1000)) + cluster + cluster
    packets, _, _ = M.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in packets] == frames * 2
    assert {p[1] for p in packets} == {12_000} and [p[6] for p in packets] == [0] * len(frames) + [1] * len(frames)


def test_cues_point_at_clusters():
    data = M.mux(bytes(range(256)) * 192)
    packets, tracks, cues = M.parse(data)
    assert [data[c[2] : c[2] + 4] for c in cues] == [M.CLUSTER.to_bytes(4, "big")] * len(cues) and len(cues) == packets[-1][6] + 1
    assert [t[0] for t in tracks] == [1, 2] and [p[1] for p in packets] == [24_000_000 * k for k in range(len(packets))]


@pytest.mark.parametrize("data", [b"", b"\x00", b"\x1a\x45\xdf\xa3\x90", M.mux(b"x" * 192)[:-5], None])
def test_damage(spark, data):
    media = spark.createDataFrame([(1, 2, None if data is None else bytearray(data))], "doc_id long, n_bytes long, media binary")
    r = M.with_packets(media).first()
    assert r.packets == [] and (data == b"" or r.error)


def test_packet_table(spark):
    media = spark.createDataFrame([(1, 2, bytearray(M.mux(b"a" * 1920)))], "doc_id long, n_bytes long, media binary")
    assert M.packet_table(media).count() == 10
