"""Media columns in Matroska: EBML elements, clusters, lacing and cues, to and from packet tables.

demux() walks the elements of a file by their variable-length ids and sizes (unknown sizes too) and returns one row per frame:
track, timestamp in nanoseconds, byte range, key flag and cluster, for blocks without lacing and with Xiph, fixed-size and EBML
lacing. mux() writes frames of 8-bit samples at 8 kHz into such a file with one audio track. Equal payloads give equal files.

Nulls: a null text is empty, its payload one padded unit; a null media value has no packets; a null key is kept. Repeated rows
and equal texts give equal values, row by row. A file is built and read in one piece, so a row takes a few times its text's bytes
of memory; batches are bounded by bytes. Other columns are not read, so they may have any names. A corrupt file gives an error in
its row and stops nothing. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

UNIT, RATE, PAD = 576, 8000, b"\xff"
#: Frames that a block laces, and blocks of a cluster; relative timestamps of a cluster must fit 16 bits.
LACED, BLOCKS = 8, 50
#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE, PLACE, GROUP = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0xA0
TIME, SIMPLE, BLOCK, SCALE, NUMBER, CODEC, CUE_TIME, CUE_TRACK, CUE_CLUSTER, REFERENCE, DURATION = 0xE7, 0xA3, 0xA1, 0x2AD7B1, 0xD7, 0x86, 0xB3, 0xF7, 0xF1, 0xFB, 0x4489
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, CUES, CUE, PLACE, GROUP}
#: Elements that end a cluster of unknown size.
TOP = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}


def size_of(n: int) -> bytes:
    """A length in as few bytes as hold it; all ones are left for an unknown length."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def vint(data, at: int, marked: bool) -> tuple[int, int]:
    """(value, next place); marked: with its length bits, as ids are. A length of all ones is -1."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError(f"no variable-length number at {at}")
    n = int.from_bytes(data[at : at + k], "big")
    if marked:
        return n, at + k
    n &= (1 << 7 * k) - 1
    return (-1 if n == (1 << 7 * k) - 1 else n), at + k


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    length: int
    key: bool
    cluster: int
    lacing: str


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte place of the cluster
    codecs: dict[int, str] = field(default_factory=dict)
    clusters: int = 0
    duration: float = 0.0


def laces(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges (place, length) of a block's frames; at is behind the block's flags."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("frames of fixed lacing differ in size")
        sizes = [size] * n
    else:
        sizes = []
        for k in range(n - 1):
            if kind == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                begin = at
                size, at = vint(data, at, False)
                if k:
                    size += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Media:
    media, scale, cluster_time, segment, track, cue, frame_ns = Media(), 1_000_000, 0, 0, 0, [0, 0, 0], {}
    ends: list[tuple[int, int]] = []  # (element, its end or -1)
    group, refers = 0, False  # the first packet of the open block group, and whether it refers to another block

    def close(code: int) -> None:
        if code == CUE:
            media.cues.append(tuple(cue))
        elif code == GROUP:
            for packet in media.packets[group:]:
                packet.key = not refers

    at = 0
    while at < len(data):
        while ends and ends[-1][1] == at:
            close(ends.pop()[0])
        place = at
        code, at = vint(data, at, True)
        size, at = vint(data, at, False)
        while ends and ends[-1][1] < 0 and (code in TOP if ends[-1][0] == CLUSTER else code in (SEGMENT, EBML)):
            ends.pop()
        if ends and 0 <= ends[-1][1] < at:
            raise ValueError(f"element {code:x} at {place} crosses the end of the one around it")
        end = at + size if size >= 0 else -1
        if end > len(data):
            raise ValueError(f"element {code:x} at {place} ends behind the file")
        if code == SEGMENT:
            segment = at
        elif code == CLUSTER:
            media.clusters += 1
            cluster_place = place
        elif code == GROUP:
            group, refers = len(media.packets), False
        if code in MASTERS:
            if size:
                ends.append((code, end))
            continue
        if size < 0:
            raise ValueError(f"element {code:x} has no size")
        body = data[at:end] if code not in (SIMPLE, BLOCK) else b""
        if code == SCALE:
            scale = int.from_bytes(body, "big")
        elif code == TIME:
            cluster_time = int.from_bytes(body, "big")
        elif code == DURATION:
            media.duration = struct.unpack(">d" if size == 8 else ">f", body)[0]
        elif code == NUMBER:
            track = int.from_bytes(body, "big")
        elif code == CODEC:
            media.codecs[track] = body.decode()
        elif code == 0x23E383:  # nanoseconds of a frame
            frame_ns[track] = int.from_bytes(body, "big")
        elif code == CUE_TIME:
            cue[0] = int.from_bytes(body, "big")
        elif code == CUE_TRACK:
            cue[1] = int.from_bytes(body, "big")
        elif code == CUE_CLUSTER:
            cue[2] = segment + int.from_bytes(body, "big")
        elif code in (SIMPLE, BLOCK):
            own, inner = vint(data, at, False)
            relative, flags = struct.unpack_from(">hB", data, inner)
            kind = flags >> 1 & 3
            begin = (cluster_time + relative) * scale
            for k, (a, n) in enumerate(laces(data, inner + 3, end, kind)):
                media.packets.append(Packet(own, begin + k * frame_ns.get(own, 0), a, n, bool(flags & 128) or code == BLOCK, cluster_place, ("none", "xiph", "fixed", "ebml")[kind]))
        elif code == REFERENCE:  # before or behind its block
            refers = True
        at = end
    while ends:
        close(ends.pop()[0])
    return media


def lace(frames: list[bytes], kind: int) -> bytes:
    """The body of a block behind its flags."""
    if not kind:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += size_of(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            k = 1
            while abs(b - a) >= (1 << 7 * k - 1) - 1:
                k += 1
            head += ((b - a + (1 << 7 * k - 1) - 1) | 1 << 7 * k).to_bytes(k, "big")
    return head + b"".join(frames)


def mux(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """A file whose frames are the payload's units (the last may be shorter), with cues to every cluster."""
    ms, rest = divmod(unit * 1000, rate)
    if rest or ms * LACED * BLOCKS > 32_767:
        raise ValueError("a unit must last whole milliseconds, and a cluster 32 seconds at most")
    frames = [payload[i : i + unit] for i in range(0, len(payload), unit)]
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * ms))))
    audio = element(AUDIO, element(0xB5, struct.pack(">d", float(rate))) + number(0x9F, 1) + number(0x6264, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(0x73C5, 1) + number(0x83, 2) + number(0x23E383, ms * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), LACED * BLOCKS):
        blocks = [number(TIME, c * ms)]
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            some = frames[b : b + LACED]
            kind = 0 if len(some) == 1 else 2 if len(some[-1]) == unit else 1
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">hB", (b - c) * ms, 128 | kind << 1) + lace(some, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE, number(CUE_TIME, c * ms) + element(PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    return header + element(SEGMENT, b"".join(parts))


def packets(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """One row per frame of the files in a binary column. A value that is no sound file has one row instead, whose error says why
    and whose other columns are null."""
    common.prepare(media.sparkSession)
    names = ["track", "timestamp_ns", "offset", "length", "key", "cluster", "lacing"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.string()]
        for b in batches:
            for k, data in enumerate(b.column(1).to_pylist()):
                rows, error = [], None
                try:
                    rows = demux(data).packets if data is not None else []
                except (ValueError, IndexError, struct.error) as e:  # what demux raises on bytes that are no sound file
                    rows, error = [Packet(*[None] * len(names))], f"{type(e).__name__}: {e}"
                for j in range(0, len(rows), common.BATCH_ROWS):
                    some = rows[j : j + common.BATCH_ROWS]
                    ids = b.column(0).take(pa.array([k] * len(some)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([getattr(p, n) for p in some], t) for n, t in zip(names, kinds, strict=True)), pa.array([error] * len(some), pa.string())], ["id", *names, "error"])

    return media.select(key, column).mapInArrow(task, f"id {dict(media.dtypes)[key]}, track long, timestamp_ns long, offset long, length long, key boolean, cluster long, lacing string, error string")


def feature(media: Media) -> str:
    lacing = Counter(p.lacing for p in media.packets)
    last = media.packets[-1]
    indexed = {c[2] for c in media.cues} == {p.cluster for p in media.packets}
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};indexed={int(indexed)};last_ms={last.timestamp_ns // 1_000_000};duration_ms={media.duration:.0f};" + ",".join(f"{k}={lacing[k]}" for k in sorted(lacing))


def stored(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): its bytes stored as a file and read back, as digests, and a feature of the packet table."""
    common.prepare(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                raw = text.encode()
                file = mux(raw + PAD * (-len(raw) % UNIT if raw else UNIT))
                media = demux(file)
                payload = b"".join([file[p.offset : p.offset + p.length] for p in media.packets])
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature(media)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return docs.select("doc_id", common.text_of().alias("text")).mapInArrow(task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(common.table(spark, sf_dir, "documents"))
