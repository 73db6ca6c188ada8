"""Byte-level BPE by a sentencepiece model that is written from a table of ranks."""

from __future__ import annotations

import base64
import struct
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_arrow_batches, text_rows
from .pretokens import Remembered, by_pattern, by_size, gathered


def byte_letters() -> list[str]:
    """A visible character for each byte: itself if it is one in Latin-1, else the next free one from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(free)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a protocol buffer: bytes, a whole number or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a file of ranks, in order of rank. Raises ValueError if ranks have gaps."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f)))}
    if sorted(found) != list(range(len(found))):
        raise ValueError("the ranks have gaps")
    return [found[k] for k in range(len(found))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece k is token k, a letter for each byte, with score -k; the unknown piece comes last.

    Pieces of a higher score merge first, so merges follow ranks. The normaliser changes nothing: no map, no blank
    before the text, none removed or escaped.
    """
    letters = byte_letters()
    # Field numbers and kinds of the model's format.
    pieces = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(k))) for k, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    off = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, off) + _field(42, off) + _field(43, off)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


@cache
def _encoder(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(read_ranks(path)))
    table = dict(enumerate(byte_letters()))

    def encode(tokens: list[str]) -> list[list[int]]:
        return processor.encode([t.encode().decode("latin-1").translate(table) for t in tokens], out_type=int, num_threads=1) if tokens else []

    return Remembered(by_pattern(public_tokenizers.PATTERN, encode), 300_000)


@cache
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids, one after the other, their starts and lengths, through the model's pieces: letters go back to the bytes they stand for."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(read_ranks(path)))
    back = {letter: b for b, letter in enumerate(byte_letters())}
    pieces = [bytes(back[c] for c in processor.id_to_piece(k)) for k in range(processor.get_piece_size() - 1)]
    lengths = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, the ids of the whole text (array of int; null and empty texts have none). A column of that name is replaced.

    Rows stay as they are, repeated ones too, other columns pass through, and an empty table gives an empty one. A text
    of any length is encoded whole.
    """
    small_arrow_batches(docs.sparkSession)
    docs = docs.drop(*([out] if out != text else []))
    schema = docs.select("*", F.array().cast("array<int>").alias(out)).schema

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            lo = 0
            for rows in by_size(((t or "",) for (t,) in text_rows([batch], text)), 1 << 19):
                got, lengths = encoder([t for (t,) in rows])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got))
                own = batch.slice(lo, len(rows))
                lo += len(rows)
                yield pa.RecordBatch.from_arrays([*own.columns, ids], names=[*own.schema.names, out])

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def _cuts(sizes: np.ndarray, most: int = 1 << 20) -> list[int]:
    """Ends of runs of rows that have about `most` ids together, or of a single longer row."""
    ends, held = [], 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            ends.append(k)
            held = 0
        held += n
    return [*ends, len(sizes)] if len(sizes) else []


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`, the bytes of the ids (null ids: null). Raises IndexError for an id that no rank has. A column of that name is replaced."""
    small_arrow_batches(docs.sparkSession)
    docs = docs.drop(out)
    schema = docs.select("*", F.lit(b"").alias(out)).schema

    def decoded(column: pa.Array) -> pa.Array:
        values, starts, lengths = _decoder(path)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(starts):
            raise IndexError("an id that no rank has")
        count = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        size = np.concatenate([[0], np.cumsum(lengths[flat])])
        offsets = size[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)].astype(np.int32)
        data = gathered(values, starts[flat], lengths[flat])
        return pa.Array.from_buffers(pa.binary(), len(column), [column.is_valid().buffers()[1] if column.null_count else None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def run(batches):
        for batch in batches:
            lo, column = 0, batch.column(batch.schema.get_field_index(ids))
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            for hi in _cuts(sizes):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, decoded(pa.concat_arrays([column.slice(lo, hi - lo)]))], names=[*batch.schema.names, out])
                lo = hi

    return docs.mapInArrow(lambda batches: released(run(batches)), schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    return decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text counts as an empty one, equal rows give equal rows, an empty table none."""
    return digest(docs)
