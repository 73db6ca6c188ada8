import io
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from lodgely.llm import tokenstore as T
from tokenizers import Tokenizer


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.sampled_from([1, 2, 200, 50_000, 2**32]), st.integers(0, 30), st.integers(0, 2**31))
def test_blocks(rows, top, odd, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, top, (rows, 256), dtype=np.uint64).astype(np.uint32)
    values[:, rng.integers(0, 256, odd)] = rng.integers(0, 2**32, odd, dtype=np.uint64).astype(np.uint32)
    data, length = T.pack(values)
    start = np.cumsum(length) - length
    assert len(data) == length.sum() and (T.unpack(data, start) == values).all()


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()


def test_files_and_ranges():
    rng = np.random.default_rng(0)
    docs = [(None, np.zeros(0, np.uint32)), (-5, rng.integers(0, 50000, 700)), (7, rng.integers(0, 3, 300_000)), (2**40, np.array([4_000_000_000]))]
    sink = Sink()
    writer = T.Writer(sink)
    for i, ids in docs:
        writer.add(i, ids.astype("<u4").tobytes())
    size = writer.close()
    reader = T.Reader(io.BytesIO(sink.kept), size)
    all_ids = np.concatenate([d.astype(np.uint32) for _, d in docs])
    assert len(sink.kept) == size and reader.total == len(all_ids)
    at = 0
    for (i, ids), (j, start, n, pieces) in zip(docs, reader.documents()):
        assert (i, at, len(ids)) == (j, start, n) and (np.concatenate([np.zeros(0, np.uint32), *pieces]) == ids).all()
        at += n
    for lo, n in ((0, 1), (255, 2), (300, 5000), (len(all_ids) - 1, 1), (0, len(all_ids))):
        assert (reader.ids(lo, n) == all_ids[lo : lo + n]).all()
    sink = Sink()
    assert list(T.Reader(io.BytesIO((w := T.Writer(sink), w.close(), sink.kept)[2]), len(sink.kept)).documents()) == []


def test_query(docs, odd, none):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for table in (docs, odd):
        rows = sorted(((r.doc_id, r.text) for r in table.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for i, t in rows:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert sorted(map(tuple, T.op8_tokenstore(table).collect()), key=lambda r: r[1]) == want
    assert T.op8_tokenstore(none).count() == 0


def test_rows_without_ids_go_to_many_files(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text")
    manifest = T.write_ids(docs, T.shared_dir(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    got = [r.docs for r in manifest.collect()]
    assert sum(got) == 20_000 and len(got) >= 3 and max(got) < 12_000


_LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_ALPHABET = [*"aéßǄɐĸªº1²½.*中🙂", " ", "  ", "\n", "\t", "\r", "\u0085", "\xa0", "\x1c", "\x00", "­", "́", "​", " ", "'s", "'ll", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ALPHABET), max_size=30).map("".join), min_size=1, max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    ids, lengths = T._encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts)
    want = [_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [k for w in want for k in w]
