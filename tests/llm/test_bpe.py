import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from lodgely.llm import bpe
from lodgely.llm.pretokens import Remembered, by_pattern

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab .,'\n\té你🙂\xa0", "the", "  "]), max_size=60).map("".join) | st.text(max_size=40))
def test_texts(reference, text):
    assert bpe._encoder(PATH)([text])[0].tolist() == reference.encode_ordinary(text)


def test_query(docs, odd, none, reference):
    for table in (docs, odd):
        want = []
        for r in table.select("doc_id", "text").collect():
            ids = reference.encode_ordinary(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted((str(r[0]), *r[1:]) for r in map(tuple, bpe.op10_bpe(table).collect())) == sorted(want)
    assert bpe.op10_bpe(none).count() == 0


def test_columns_pass(odd):
    got = bpe.decode(bpe.encode(odd.withColumnRenamed("key", "ids"), PATH), PATH).collect()
    assert all(r.decoded.decode() == (r.text or "") for r in got) and len(got) == 14


def test_memory_forgets():
    calls = []
    encode = Remembered(by_pattern(r"\S+|\s", lambda tokens: (calls.extend(tokens), [[len(t)] for t in tokens])[1], 3), 3)
    for _ in range(3):
        ids, lengths = encode(["a bb ccc dddd eeeee", "a", "", "a  \nb"])
        assert lengths.tolist() == [9, 1, 0, 5] and ids.tolist() == [1, 1, 2, 1, 3, 1, 4, 1, 5, 1, 1, 1, 1, 1, 1]
    assert len(encode.later.place) <= 4 and len(calls) >= 5


def test_ranks_with_gaps(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))
