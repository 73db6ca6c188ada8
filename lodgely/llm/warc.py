"""WARC archives: one gzip member for each record, written by tasks and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, open_fs, shared_dir, small_arrow_batches, text_rows, written

MAGIC = b"\x1f\x8b\x08"
ID_PREFIX = "urn:lodgely:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = 1 << 18

RECORD = "file string, offset long, length long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def one_line(value: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; with refers_to it is a revisit, whose block ends after the HTTP header."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", most_bytes: int = 1 << 29) -> DataFrame:
    """Writes pages (page_id, url, payload, payload_sha1 in hex, refers_to) below folder; returns the manifest (path, bytes, records).

    Each attempt of a task writes files of its own name, and only those of the attempt that succeeds are in the
    manifest, which is itself a written table; so a lost executor leaves a stray file and no double record.
    """
    small_arrow_batches(pages.sparkSession)

    def run(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0
        try:
            for page_id, url, payload, sha1, refers_to in text_rows(batches, "page_id", "url", "payload", "payload_sha1", "refers_to"):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(path, compression=None), 0, 0
                member = record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= most_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path.removeprefix(base + "/")], "bytes": [size], "records": [count]})
                    out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"path": [path.removeprefix(base + "/")], "bytes": [size], "records": [count]})

    return written(pages.select("page_id", "url", "payload", "payload_sha1", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "manifest")


class _Member:
    """One gzip member, decoded piece by piece from a position of an open file."""

    def __init__(self, file, at: int):
        self.file, self.next, self.unzip, self.raw = file, at, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next bytes; empty at the member's end. Raises zlib.error or EOFError where there is no whole member."""
        while not self.unzip.eof:
            if not self.raw:
                self.raw = self.file.read_at(_READ, self.next)
                if not self.raw:
                    raise EOFError("the file ends inside a member")
                self.next += len(self.raw)
            out = self.unzip.decompress(self.raw, 1 << 20)
            self.raw = self.unzip.unconsumed_tail
            if out:
                return out
        return b""

    def end(self) -> int:
        return self.next - len(self.unzip.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_member(file, at: int, payloads: bool) -> tuple | None:
    """(length, id, type, uri, refers_to, bytes, digest, payload, error) of the record at `at`; None if none starts there.

    A header of any length is read to its end; a member that begins as a record and has no whole header is an error.
    """
    member, data, end = _Member(file, at), bytearray(), -1
    broken = lambda why: (0, None, None, None, None, None, None, None, why) if data.startswith(b"WARC/1.") else None
    try:
        while end < 0:
            if not (got := member.more()):
                return broken("the header does not end")
            seen = max(0, len(data) - 3)
            data += got
            if not b"WARC/1.".startswith(data[:7]) and not data.startswith(b"WARC/1."):
                return None
            end = data.find(b"\r\n\r\n", seen)
    except (zlib.error, EOFError) as e:
        return broken(str(e))
    rest = bytes(data[end + 4 :])
    fields = _fields(bytes(data[:end]))
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return broken("the header has no type or length")
    strip = lambda name: fields[name].strip("<>") if name in fields else None
    kind, left, http, sha1, n, kept = fields["warc-type"], int(fields["content-length"]), None, hashlib.sha1(), 0, []
    pending = b""
    try:
        piece = rest
        while True:
            piece, left = piece[:left], left - len(piece[:left])
            if http is None:
                pending += piece
                if b"\r\n\r\n" in pending:
                    top, _, piece = pending.partition(b"\r\n\r\n")
                    http = _fields(top)
                else:
                    piece = b""
            if http is not None:
                sha1.update(piece)
                n += len(piece)
                if payloads and piece:
                    kept.append(piece)
            if not (piece := member.more()):
                break
        error = "the block is short" if left else None
        length = member.end() - at
    except (zlib.error, EOFError) as e:
        error, length = str(e), 0
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size = (http or {}).get("content-length", "")
        n = int(size) if size.isdigit() else None
    else:
        own = base64.b32encode(sha1.digest()).decode()
        error = error or ("the payload differs from its digest" if digest and digest != own else None)
        digest = own
    return length, strip("warc-record-id"), kind, fields.get("warc-target-uri"), strip("warc-refers-to"), n, digest, b"".join(kept) if payloads else None, error


def read_range(file, start: int, end: int, size: int, payloads: bool) -> Iterator[tuple]:
    """(offset, *read_member()) of the records that start in [start, end).

    A candidate is the magic number of a gzip member; it counts if it decodes to a record's header. After a record the
    search goes on at its end, so bytes inside a record are never candidates except at the start of a range.
    """
    at = start
    while at < end:
        block = file.read_at(min(_READ, end - at + 2), at)
        hit = block.find(MAGIC)
        if hit < 0:
            if at + len(block) >= min(end + 2, size):
                return
            at += max(1, len(block) - 2)
            continue
        at += hit
        if at >= end:
            return
        got = read_member(file, at, payloads)
        if got:
            yield at, *got
        at += got[0] if got and got[0] else 1


def read_archives(files: DataFrame, folder: str, split_bytes: int = 8 << 20, payloads: bool = False) -> DataFrame:
    """Records (see RECORD) of the archives `path` of `bytes` bytes below folder, one task for some ranges of split_bytes each.

    A damaged member that begins as a record gives a row with `error`; other damaged bytes are passed over. Bytes inside a
    record are none of the archive's, even where they hold an archive themselves: see without_nested(). There are as many
    tasks as shuffle partitions, or one for each 64 ranges where that is more. No files, no rows.
    """
    spark = files.sparkSession
    cuts = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    cuts = cuts.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(ranges) // 64), "path", "start")
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def run(batches):
        fs, base = open_fs(folder)

        def rows():
            for path, size, start in text_rows(batches, "path", "bytes", "start"):
                with fs.open_input_file(f"{base}/{path}") as file:
                    for got in read_range(_At(file), start, min(start + split_bytes, size), size, payloads):
                        yield path, *got

        yield from in_batches(rows(), schema, 1024, weigh=lambda r: 200 + len(r[9] or b""))

    return without_nested(written(cuts.mapInArrow(run, RECORD), "records"), split_bytes)


def without_nested(records: DataFrame, split_bytes: int) -> DataFrame:
    """records (file, offset, length, ...) without those that lie inside another one.

    A range that starts inside a record may find a record in its bytes, if these hold an archive. What it lies in began in
    an earlier range, so that reaches over the start of its own: records that do are listed by the ranges they reach into,
    and a record that starts before the furthest end in its range goes. Records inside a record end before it does, so none
    of them hides a whole one. The list has a row or so for each range; only it is joined, by range, so no file is one group.
    """
    part = lambda at: F.expr(f"cast(({at}) div {split_bytes}L as long)")
    slim = records.filter("length > 0").select("file", "offset", "length")
    over = slim.filter(part("offset") < part("offset + length - 1"))
    over = over.select("file", F.explode(F.sequence(part("offset") + 1, part("offset + length - 1"))).alias("part"), (F.col("offset") + F.col("length")).alias("end"))
    over = over.groupBy("file", "part").agg(F.max("end").alias("end"))
    nested = records.select("file", "offset", part("offset").alias("part")).join(over, ["file", "part"]).filter(F.col("offset") < F.col("end")).select("file", "offset")
    return records.join(nested, ["file", "offset"], "left_anti")


class _At:
    """read_at(count, position) of a file that seeks."""

    def __init__(self, file):
        self.file = file

    def read_at(self, count: int, position: int) -> bytes:
        self.file.seek(position)
        return self.file.read(count)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, payload, payload_sha1, refers_to).

    Of equal payloads of at least least_bytes the smallest page_id is kept whole (repeated rows of it too) and the others
    refer to it. A null page_id refers to any other; where all ids are null, all are kept. A null html is an empty payload.
    Pages of any length are taken whole, an empty table gives an empty one, other columns are left out.
    """
    full = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload")).withColumn("payload_sha1", F.sha1("payload"))
    first = full.filter(F.octet_length("payload") >= least_bytes).groupBy("payload_sha1").agg(F.min("page_id").alias("first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return full.join(first, "payload_sha1", "left").select("page_id", "url", "payload", "payload_sha1", refers.alias("refers_to"))


def op1_warc(pages: DataFrame) -> DataFrame:
    """Per row of pages, from archives that are written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to and where the record stands. See with_revisits() for nulls, ties and repeated rows."""
    folder = shared_dir(pages.sparkSession, "warc")
    records = read_archives(write_archives(with_revisits(pages), folder), folder)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) as long)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri", "file", "offset", "length", "error")


