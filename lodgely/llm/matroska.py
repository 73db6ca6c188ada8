"""Matroska: texts as 8-bit samples in a media column, and packet tables parsed from such columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, small_arrow_batches, text_rows

# Element numbers of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC, AUDIO = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0xE1
TRACK_UID, FLAG_LACING, DEFAULT_DURATION, RATE, CHANNELS, DEPTH, MUXER, WRITER = 0x73C5, 0x9C, 0x23E383, 0xB5, 0x9F, 0x6264, 0x4D80, 0x5741
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PACKET = "track int, timestamp_ns long, offset long, size int, key boolean, lacing int, cluster int"
MEDIA = f"packets array<struct<{PACKET}>>, tracks array<struct<track: int, kind: int, codec: string>>, cues array<struct<time_ns: long, track: int, cluster_offset: long>>, error string"


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; its all-ones value stays free, as it means unknown."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A SimpleBlock with the frames laced as asked."""
    head = size_bytes(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    sizes = [len(f) for f in frames]
    if lacing != NO_LACING:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def _track(number: int, rate: float, frame: int) -> bytes:
    audio = element(RATE, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(DEPTH, 8)
    return element(TRACK_ENTRY, uint(TRACK_NUMBER, number) + uint(TRACK_UID, number) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, int(frame / rate * 1e9)) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio))


def mux(payload: bytes, frame: int = 192, laced: int = 8, clustered: int = 64) -> bytes:
    """payload as frames of 8-bit samples at 8 kHz (24 ms each), in blocks of up to `laced` frames that alternate between two tracks.

    Blocks take fixed, EBML and Xiph lacing in turn. A cluster has up to `clustered` frames and a cue.
    """
    info = element(INFO, uint(SCALE, 1_000_000) + element(MUXER, b"lodgely") + element(WRITER, b"lodgely"))
    body = [info, element(TRACKS, _track(1, 8000.0, frame) + _track(2, 8000.0, frame))]
    at, cues, step = sum(map(len, body)), [], frame // 8
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    for lo in range(0, len(frames), clustered):
        parts = [uint(TIMESTAMP, lo * step)]
        for i in range(lo, min(lo + clustered, len(frames)), laced):
            own, k = frames[i : min(i + laced, lo + clustered)], i // laced
            parts.append(block(1 + k % 2, (i - lo) * step, own, (FIXED, EBML_LACING, XIPH)[k % 3] if len(own) > 1 else NO_LACING))
        cues.append(element(CUE_POINT, uint(CUE_TIME, lo * step) + element(CUE_POSITIONS, uint(CUE_TRACK, 1 + lo // laced % 2) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def number_at(data: bytes, at: int) -> tuple[int, int]:
    """The variable-length number at a position, without its marker, and its width."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no number at {at}")
    return int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1), width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the elements between two positions.

    One of unknown size ends where its parent does or, for a cluster, at the next top-level element.
    """
    while at < end:
        width = 9 - data[at].bit_length()
        if width > 4:
            raise ValueError(f"no element at {at}")
        number = int.from_bytes(data[at : at + width], "big")
        n, w = number_at(data, at + width)
        start = at + width + w
        if n == (1 << 7 * w) - 1:
            at = end
            if number == CLUSTER:
                at = start
                while at < end:
                    inner = 9 - data[at].bit_length()
                    if inner <= 4 and int.from_bytes(data[at : at + inner], "big") in TOP_LEVEL:
                        break
                    skip, sw = number_at(data, at + inner)
                    at += inner + sw + skip
        else:
            at = start + n
        if at > end:
            raise ValueError(f"element {number:x} at {start} ends after its parent")
        yield number, start, at


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """Where the first frame of a block starts, and the sizes of its frames."""
    if lacing == NO_LACING:
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"{end - at} bytes are not {count} equal frames")
        return at, [(end - at) // count] * count
    sizes: list[int] = []
    for k in range(count - 1):
        if lacing == XIPH:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            n, w = number_at(data, at)
            at += w
            if k:
                n += sizes[-1] - ((1 << 7 * w - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    return at, sizes


def _value(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def parse(data: bytes) -> tuple[list, list, list]:
    """Packets, tracks and cues of one file, as PACKET and MEDIA name them. Raises ValueError or IndexError on damage."""
    packets, tracks, cues, scale, nth, durations, base = [], [], [], 1_000_000, -1, {}, 0

    def add(start: int, end: int, cluster_time: int, keyed: bool | None) -> None:
        track, w = number_at(data, start)
        relative, flags = struct.unpack_from(">hB", data, start + w)
        lacing = flags >> 1 & 3
        at, sizes = frame_sizes(data, start + w + 3, end, lacing)
        time, step = (cluster_time + relative) * scale, durations.get(track, 0)
        for k, n in enumerate(sizes):
            packets.append((track, time + k * step, at, n, bool(flags & 0x80) if keyed is None else keyed, lacing, nth))
            at += n

    for top, s, e in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        base = s
        for number, start, end in elements(data, s, e):
            if number == INFO:
                scale = next((_value(data, a, b) for n, a, b in elements(data, start, end) if n == SCALE), scale)
            elif number == TRACKS:
                for n, a, b in elements(data, start, end):
                    if n == TRACK_ENTRY:
                        own = {k: (x, y) for k, x, y in elements(data, a, b)}
                        track = _value(data, *own[TRACK_NUMBER])
                        tracks.append((track, _value(data, *own[TRACK_TYPE]), data[slice(*own[CODEC])].decode("ascii", "replace")))
                        if DEFAULT_DURATION in own:
                            durations[track] = _value(data, *own[DEFAULT_DURATION])
            elif number == CLUSTER:
                nth, time = nth + 1, 0
                for n, a, b in elements(data, start, end):
                    if n == TIMESTAMP:
                        time = _value(data, a, b)
                    elif n == SIMPLE_BLOCK:
                        add(a, b, time, None)
                    elif n == BLOCK_GROUP:
                        inner = list(elements(data, a, b))
                        for m, x, y in inner:
                            if m == BLOCK:
                                add(x, y, time, not any(q == 0xFB for q, _, _ in inner))
            elif number == CUES:
                for n, a, b in elements(data, start, end):
                    if n == CUE_POINT:
                        own = {k: (x, y) for k, x, y in elements(data, a, b)}
                        place = {k: (x, y) for k, x, y in elements(data, *own[CUE_POSITIONS])}
                        cues.append((_value(data, *own[CUE_TIME]) * scale, _value(data, *place[CUE_TRACK]), base + _value(data, *place[CUE_CLUSTER])))
    return packets, tracks, cues


def with_media(docs: DataFrame, text: str = "text", frame: int = 192) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, media: the UTF-8 text (null: empty), filled with blanks to a positive multiple of `frame` bytes."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def rows():
            for doc_id, t in text_rows(batches, "doc_id", "text"):
                raw = (t or "").encode()
                yield doc_id, len(raw), mux(raw + b" " * (-len(raw) % frame or (0 if raw else frame)), frame)

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[2]))

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_packets(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> those and packets, tracks, cues, error, payload: the frames' bytes in order of time and place.

    Damaged or null media give empty tables, no payload and the reason in `error`.
    """
    small_arrow_batches(media.sparkSession)
    shape = media.sparkSession.createDataFrame([], MEDIA).schema
    packet = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("key", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int32())])
    track = pa.struct([("track", pa.int32()), ("kind", pa.int32()), ("codec", pa.string())])
    cue = pa.struct([("time_ns", pa.int64()), ("track", pa.int32()), ("cluster_offset", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("packets", pa.list_(packet)), ("tracks", pa.list_(track)), ("cues", pa.list_(cue)), ("error", pa.string()), ("payload", pa.binary())])

    def structs(kind, rows):
        names = [f.name for f in kind]
        return [dict(zip(names, r)) for r in rows]

    def run(batches):
        def rows():
            for doc_id, n, data in text_rows(batches, "doc_id", "n_bytes", "media"):
                try:
                    packets, tracks, cues = parse(data or b"")
                    ordered = packets if all(a[1] <= b[1] for a, b in zip(packets, packets[1:])) else sorted(packets, key=lambda p: (p[1], p[2]))
                    payload, error = b"".join(data[p[2] : p[2] + p[3]] for p in ordered) if data is not None else None, None if data is not None else "no media"
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    packets, tracks, cues, payload, error = [], [], [], None, str(e)
                yield doc_id, n, data, structs(packet, packets), structs(track, tracks), structs(cue, cues), error, payload

        yield from in_batches(rows(), schema, 256, weigh=lambda r: 3 * len(r[2] or b""))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape)
    return media.mapInArrow(run, f"doc_id long, n_bytes long, media binary, {kinds}, payload binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet: doc_id, track, timestamp_ns, offset, size, key, lacing, cluster."""
    return with_packets(media).select("doc_id", F.explode("packets").alias("p")).select("doc_id", "p.*")


def op4_matroska(docs: DataFrame) -> DataFrame:
    """Per row of docs: its text as a Matroska file that is parsed back; sizes and digests of both, and a summary of packets, tracks and cues.

    A null text counts as an empty one, which is one frame of blanks; equal rows give equal rows, a text of any length is
    one file, an empty table gives no rows, other columns do not matter.
    """
    got = with_packets(with_media(docs))
    last = F.expr("array_max(transform(packets, p -> p.timestamp_ns))")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("tracks="), F.concat_ws(",", F.expr("transform(tracks, t -> concat(t.track, ':', t.codec))"))),
        F.concat(F.lit("packets="), F.size("packets")),
        F.concat(F.lit("sizes="), F.concat_ws(",", F.expr("transform(array_sort(array_distinct(packets.size)), x -> cast(x as string))"))),
        F.concat(F.lit("first_track="), F.expr("size(filter(packets, p -> p.track = 1))")),
        F.concat(F.lit("lacing="), F.concat_ws(",", F.expr("transform(array_sort(array_distinct(packets.lacing)), x -> cast(x as string))"))),
        F.concat(F.lit("clusters="), F.expr("array_max(packets.cluster) + 1")),
        F.concat(F.lit("cues="), F.size("cues")),
        F.concat(F.lit("last_ns="), last),
    )
    return got.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "error",
    )
