import base64
import gzip
import hashlib

import pytest
from lodgely.llm import warc as W


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_query(spark):
    rows = [(3, "http://a/1", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://a/\r\n2", None), (4, "u", ""), (5, "u", "été" * 9), (5, "u", "été" * 9), (None, "u", "<p>x</p>"), (None, "u", "alone"), (9, "u", "y" * 3_000_000)]
    got = W.op1_warc(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int"))
    want = [(3, "<p>x</p>", "revisit", 1), (1, "<p>x</p>", "response", None), (2, "", "response", None), (4, "", "revisit", 2), (5, "été" * 9, "response", None), (5, "été" * 9, "response", None), (None, "<p>x</p>", "revisit", 1), (None, "alone", "response", None), (9, "y" * 3_000_000, "response", None)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=key) == sorted(((i, len(h.encode()), sha(h.encode()), t, f) for i, h, t, f in want), key=key)
    assert W.op1_warc(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_header(spark):
    url = "http://a/" + "x" * 2_000_000
    got = W.op1_warc(spark.createDataFrame([(1, url, "<p>"), (2, "u", "<b>")], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.target_uri, r.error) for r in got) == [(1, url, None), (2, "u", None)]
    data = W.record(1, url, b"x", sha(b"x"), None, "d")
    assert [g[9] is None for g in W.read_range(Bytes(data[:1500]), 0, 1500, 1500, False)] == [False]


def test_every_split_has_each_record_once():
    records = [W.record(i, "http://x", b"<p>%d</p>" % i * 40, sha(b"<p>%d</p>" % i * 40), None if i % 3 else 0, "d") for i in range(1, 12)]
    data = b"".join(records)
    for width in (1, 7, 50, 333, len(data)):
        seen = [at for lo in range(0, len(data), width) for at, *_ in W.read_range(Bytes(data), lo, min(lo + width, len(data)), len(data), False)]
        assert seen == [sum(map(len, records[:k])) for k in range(len(records))]


def test_damage_and_strangers():
    good = W.record(1, "u", b"hello", sha(b"hello"), None, "d")
    other = gzip.compress(b"not a record")
    wrong = W.record(2, "u", b"hello", sha(b"other"), None, "d")
    data = b"junk\x1f\x8b\x08" + other + good + wrong + good[:-9]
    got = list(W.read_range(Bytes(data), 0, len(data), len(data), True))
    assert [g[2] for g in got][:2] == [W.ID_PREFIX + "1", W.ID_PREFIX + "2"] and got[0][8] == b"hello"
    assert got[0][9] is None and "digest" in got[1][9] and all(g[9] for g in got[2:])


@pytest.mark.parametrize("least,kinds", [(0, ["response", "revisit"]), (100, ["response", "response"])])
def test_least_bytes(spark, least, kinds):
    pages = W.with_revisits(spark.createDataFrame([(1, "u", "h"), (2, "u", "h")], "page_id long, url string, html string"), least)
    assert ["response" if r.refers_to is None else "revisit" for r in pages.orderBy("page_id").collect()] == kinds


def test_an_archive_inside_a_record(spark, tmp_path):
    """Bytes that cannot be packed keep an inner archive as it is; at no split width do its records come out."""
    import random
    import zlib as z

    rng = random.Random(2)
    noise = lambda n: rng.randbytes(n)
    inner = b"".join(W.record(90 + k, "http://in", noise(3000), "X", None, "d") for k in range(4))
    payload = noise(5000) + inner + noise(4000) + inner[:5000] + noise(200)
    outer = W.record(2, "http://out", payload, sha(payload), None, "d")
    stored = z.compressobj(0, z.DEFLATED, 31)
    outer = stored.compress(z.decompress(outer, 31)) + stored.flush()
    assert W.MAGIC in outer[10:] and inner[:3000] in outer
    data = W.record(1, "u", b"one", sha(b"one"), None, "d") + outer + W.record(3, "u", b"three" * 2000, sha(b"three" * 2000), None, "d")
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(inner)
    files = spark.createDataFrame([("a.warc.gz", len(data)), ("b.warc.gz", len(inner))], "path string, bytes long")
    raw = 0
    for width in (500, 1000, 2500, 4096, 5300, 7777, 12_000, 20_000, 1 << 20):
        got = W.read_archives(files, str(tmp_path), width, payloads=True).collect()
        assert sorted(r.record_id.removeprefix(W.ID_PREFIX) for r in got if r.file[0] == "a") == ["1", "2", "3"] and not any(r.error for r in got if r.file[0] == "a")
        assert sorted(r.record_id.removeprefix(W.ID_PREFIX) for r in got if r.file[0] == "b") == ["90", "91", "92", "93"]
        raw += sum(len([*W.read_range(Bytes(data), lo, min(lo + width, len(data)), len(data), False)]) for lo in range(0, len(data), width)) > 3
    assert raw >= 4
