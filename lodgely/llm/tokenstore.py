"""Files of token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import in_batches, open_fs, shared_dir, small_arrow_batches, text_rows, written
from .pretokens import Named, Remembered, by_size, gathered

BLOCK = 256
_MAGIC = b"LPFOR001"
#: Blocks packed or read at a time.
_RUN = 1024
_FOOT = struct.Struct("<QQQQ8s")
_HEAD = 7
#: Texts of characters that every version of Unicode in use puts into the same classes.
_LATIN = re.compile("[\t\n\r -~\u00a1-\u024f]*").fullmatch
_PRE_TOKENS = regex.compile(public_tokenizers.PATTERN).findall


def pack(values: np.ndarray, percentile: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Blocks (rows of 256 unsigned 32-bit values) as bytes, and the length of each.

    A block: its least value (4 bytes), the width of the others less it (1), the number of exceptions (2), the values in
    that width, then the places (1 byte each) and whole values (4 bytes each) of exceptions. The width is that of the
    value at the percentile.
    """
    least = values.min(axis=1)
    rest = values - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.frexp(np.partition(rest, at, axis=1)[:, at].astype(np.float64))[1].astype(np.int64)
    odd = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    count = odd.sum(axis=1)
    length = _HEAD + BLOCK // 8 * width + 5 * count
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    out = np.zeros(int(length.sum()), np.uint8)
    head = np.zeros(len(values), np.dtype([("least", "<u4"), ("width", "u1"), ("count", "<u2")]))
    head["least"], head["width"], head["count"] = least, width, count
    out[start[:, None] + np.arange(_HEAD)] = head.view(np.uint8).reshape(-1, _HEAD)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = (rest[own][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        packed = np.packbits(bits.reshape(len(own), BLOCK * w), axis=1, bitorder="little")
        out[(start[own] + _HEAD)[:, None] + np.arange(BLOCK // 8 * w)] = packed
    row, place = np.nonzero(odd)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    tail = start + _HEAD + BLOCK // 8 * width
    out[tail[row] + nth] = place
    whole = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail[row] + count[row] + 4 * nth)[:, None] + np.arange(4)] = whole
    return out.tobytes(), length


def unpack(data: bytes, start: np.ndarray) -> np.ndarray:
    """The rows of the blocks that start at places of data."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[start[:, None] + np.arange(_HEAD)].copy().view(np.dtype([("least", "<u4"), ("width", "u1"), ("count", "<u2")])).ravel()
    width, count = head["width"].astype(np.int64), head["count"].astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed = raw[(start[own] + _HEAD)[:, None] + np.arange(BLOCK // 8 * w)]
        wide = np.zeros((len(own), BLOCK // 8 * w + 8), np.uint8)
        wide[:, :-8] = packed
        bit = np.arange(BLOCK) * w
        words = np.ndarray((len(own), BLOCK // 8 * w), "<u8", wide, strides=(wide.shape[1], 1))  # eight bytes from each byte on
        out[own] = (words[:, bit // 8] >> (bit % 8).astype(np.uint64)) & np.uint64((1 << w) - 1)
    row = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    tail = start + _HEAD + BLOCK // 8 * width
    place = raw[tail[row] + nth]
    out[row, place] = raw[(tail[row] + count[row] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return out + head["least"][:, None]


class Writer:
    """One file: blocks, then their starts, then a table of documents (id, length), then the places of these."""

    def __init__(self, stream):
        self.stream, self.at, self.left, self.starts, self.docs = stream, len(_MAGIC), [], [], []
        self.held = self.total = 0
        stream.write(_MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.left.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= BLOCK * _RUN:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.left), "<u4")
        whole = len(values) // BLOCK * BLOCK
        rest = values[whole:]
        for lo in range(0, whole, BLOCK * _RUN):
            self._write(values[lo : min(whole, lo + BLOCK * _RUN)].reshape(-1, BLOCK))
        if last and len(rest):
            self._write(np.concatenate([rest, np.full(BLOCK - len(rest), rest.min())]).astype(np.uint32).reshape(1, BLOCK))
        self.left, self.held = [rest.tobytes()], len(rest)

    def _write(self, blocks: np.ndarray) -> None:
        data, length = pack(blocks.astype(np.uint32))
        self.stream.write(data)
        ends = self.at + np.cumsum(length)
        self.starts.append(np.concatenate([[self.at], ends[:-1]]))
        self.at = int(ends[-1])

    def close(self) -> int:
        """Ends the file; returns its size."""
        self._flush(True)
        index = np.concatenate([*self.starts, [self.at]]).astype("<u8").tobytes()
        table = np.zeros(len(self.docs), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]))
        table["id"], table["null"], table["n"] = [d or 0 for d, _ in self.docs], [d is None for d, _ in self.docs], [n for _, n in self.docs]
        self.stream.write(index + table.tobytes() + _FOOT.pack(self.at, self.at + len(index), len(self.docs), self.total, _MAGIC))
        self.stream.close()
        return self.at + len(index) + table.nbytes + _FOOT.size


class Reader:
    """Reads documents or any range of ids of a file; ranges are found by the starts of blocks."""

    def __init__(self, file, size: int):
        self.file = file
        index, table, docs, self.total, magic = _FOOT.unpack(self._bytes(size - _FOOT.size, _FOOT.size))
        if magic != _MAGIC:
            raise ValueError("not a file of token ids")
        self.starts = np.frombuffer(self._bytes(index, table - index), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self._bytes(table, docs * 13), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u4")]))

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, first: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, (first + n - 1) // BLOCK + 1
        data = self._bytes(int(self.starts[lo]), int(self.starts[hi] - self.starts[lo]))
        return unpack(data, self.starts[lo:hi] - self.starts[lo]).ravel()[first - lo * BLOCK : first - lo * BLOCK + n]

    def documents(self):
        """(doc_id, start, ids in pieces) of each document, in order; a piece is a run of blocks at most."""
        have, base, at = np.zeros(0, np.uint32), 0, 0

        def pieces(first: int, n: int):
            nonlocal have, base
            while n > 0:
                if not base <= first < base + len(have):
                    base = first
                    have = self.ids(base, min(BLOCK * _RUN, self.total - base))
                part = have[first - base : first - base + n]
                yield part
                first, n = first + len(part), n - len(part)

        for doc_id, null, n in self.docs.tolist():
            yield None if null else doc_id, at, n, pieces(at, n)
            at += n


@cache
def _encoder(path: str):
    """texts -> ids of all texts, one after the other, and how many each has; as the library gives them for each whole text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    starts = np.array([(tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(tokenizer.get_vocab_size())])

    def in_order(parts: list[np.ndarray], counts: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ids (all parts, their lengths) that belong to the places at, by these places."""
        order, lengths = np.argsort(np.array(at, np.int64)), np.concatenate(counts)
        return gathered(np.concatenate(parts), (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *got]), np.array([len(g) for g in got], np.int64)

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cutter = made.get("pre_tokenizer") or {}
    if made.get("normalizer") or made.get("truncation") or made.get("padding") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return whole  # such a tokenizer does not start a token at each blank, so texts cannot be put together from pieces

    table, tokenize = dict(enumerate(byte_letters())) | {0: "\0"}, tokenizer.model.tokenize

    def tokens_to_ids(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each pre-token by the library's model; none has the byte 0, so all are mapped to its letters at once."""
        ids, lengths = [], []
        for t in "\0".join(tokens).encode().decode("latin-1").translate(table).split("\0") if tokens else []:
            got = tokenize(t)
            lengths.append(len(got))
            ids += [k.id for k in got]
        return np.array(ids, np.int32), np.array(lengths, np.int64)

    known = Named(tokens_to_ids, 500_000)

    def latin_to_ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], []
        for p in pieces:
            if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()):
                flat.append(p)
                count.append(1)
            else:
                got = _PRE_TOKENS(p)
                flat += got
                count.append(len(got))
        starts, lengths = known(flat)
        return gathered(known.values, starts, lengths), np.bincount(np.repeat(np.arange(len(count)), count), lengths, len(count)).astype(np.int64)

    def blanks_to_ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start with their only blank are encoded in one text, and cut where tokens start with one; others alone."""
        joined = [k for k, p in enumerate(pieces) if p.rfind(" ") == 0 and not any(s in p for s in special)]
        alone = sorted(set(range(len(pieces))).difference(joined))
        values, lengths = whole([pieces[k] for k in alone])
        parts, counts = [values], [lengths]
        for lo in range(0, len(joined), 4096):
            some = joined[lo : lo + 4096]
            got, _ = whole(["".join(pieces[k] for k in some)])
            at = np.flatnonzero(starts[got])
            if len(at) != len(some):
                raise ValueError("this tokenizer does not start a token at each blank")
            parts.append(got)
            counts.append(np.diff(np.append(at, len(got))))
        return in_order(parts, counts, alone + joined)

    def pieces_to_ids(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of Latin letters are cut by the pattern, whose classes are settled there, and the library's model encodes each pre-token once; the library cuts others itself."""
        latin = [k for k, p in enumerate(pieces) if _LATIN(p)]
        other = sorted(set(range(len(pieces))).difference(latin))
        got = [latin_to_ids([pieces[k] for k in latin]), blanks_to_ids([pieces[k] for k in other])]
        return in_order([v for v, _ in got], [n for _, n in got], latin + other)

    remembered = Remembered(pieces_to_ids, 600_000, Named)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = remembered(texts)
        marked = [k for k, t in enumerate(texts) if any(s in t for s in special)]  # the library looks for these before it cuts the text
        if marked:
            other, counts = whole([texts[k] for k in marked])
            starts_ = np.cumsum(lengths) - lengths
            starts_[marked], lengths[marked] = len(ids) + np.cumsum(counts) - counts, counts
            ids = gathered(np.concatenate([ids, other]), starts_, lengths)
        return ids, lengths

    return encode


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, text: str = "text", task_bytes: int = 256 << 20) -> DataFrame:
    """Encodes texts (null: empty) by a byte-level tokenizers file and writes their ids below folder, in ascending doc_id order.

    Ranges of doc_id and of a hash of the text are tasks, of about task_bytes of text or less, and each writes one file;
    null ids come first, equal ids in order of that hash, then of their texts. Returns
    the manifest (part, path, bytes, docs, ids), a written table: files of attempts that failed are not in it.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    total = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Spark's estimate, which reads nothing
    total = total if total < 1 << 60 else 0  # it knows no size of tables that are not in files
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))

    def run(batches):
        encode, writer, base, name = _encoder(path), None, "", ""
        for rows in by_size(((i, t or "") for i, t in text_rows(batches, "doc_id", "text")), 1 << 23):
            if writer is None:
                fs, base = open_fs(folder)
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.ids"
                writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None))
            ids, lengths = encode([t for _, t in rows])
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths).tolist()
            for (doc_id, _), lo, hi in zip(rows, [0, *ends], ends):
                writer.add(doc_id, data[4 * lo : 4 * hi] + end)
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "bytes": [size], "docs": [len(writer.docs)], "ids": [writer.total]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("at")).repartitionByRange(ranges, "doc_id", "at").sortWithinPartitions("doc_id", "at", "text")
    return written(rows.mapInArrow(run, "part int, path string, bytes long, docs long, ids long"), "manifest")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. A task reads some files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, base = open_fs(folder)

        def rows():
            for path, size, before in text_rows(batches, "path", "bytes", "before"):
                with fs.open_input_file(f"{base}/{path}") as file:
                    for doc_id, start, n, pieces in Reader(file, size).documents():
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(np.ascontiguousarray(piece, "<u4"), crc)
                        yield doc_id, before + start, n, crc

        yield from in_batches(rows(), schema, 4096)

    files = manifest.withColumn("before", F.expr("sum(ids) over (order by part) - ids"))
    files = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_tokenstore(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs, from files written and read back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as an empty one (the end id alone), null ids come first, equal ids in order of a hash of their texts;
    repeated rows are written each, very long texts whole, an empty table gives no rows, other columns do not matter.
    """
    folder = shared_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, path or public_tokenizers.path("byte_bpe_50k.json")), folder)
