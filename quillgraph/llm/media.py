"""Media columns: Matroska files in a binary column, and packet tables read from them.

``mux`` writes a payload as an 8-bit PCM track: EBML header, Segment with Info, Tracks, Clusters of laced
SimpleBlocks, and Cues. ``packets`` parses any Matroska bytes with unencrypted, uncompressed tracks: variable-length
ids and sizes (also unknown sizes), clusters, SimpleBlocks and BlockGroups, all four lacings, cues. ``stored`` makes a media column of texts,
``packet_table`` lists the packets of such a column with their byte ranges and sample statistics, ``read_back`` gives digests and a feature of what
the packets hold. Each file is parsed on its own in a task, so memory is bounded by the longest files of a batch.

Defined results: a null text is an empty payload, padded like any other; equal texts give equal bytes, as nothing in
a file depends on time, chance or row; repeated rows give repeated results; an empty table gives an empty table;
columns besides the key and text are ignored. Damaged bytes raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import table

# Element ids of the public Matroska specification.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = (
    0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
)
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Elements that may have an unknown size, and what can stand directly in them.
_INSIDE = {CLUSTER: {TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, 0xA7, 0xAB, 0xEC, 0xBF, 0x5854}}

FRAME = 576  # samples; 72 ms at 8 kHz
FRAMES_A_BLOCK = 8
ROWS = 64  # files that a task holds at once, besides Arrow's batch
BLOCKS_A_CLUSTER = 32
_MS_A_FRAME = 72


class Packet(NamedTuple):
    track: int
    timestamp: int  # of the block, in the file's timestamp units
    offset: int  # of the frame's first byte in the file
    size: int
    keyframe: bool
    cluster: int  # number of the cluster


class Parsed(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, position of the cluster in the segment
    segment_start: int
    clusters: list[int]  # positions in the segment
    lacings: list[int]  # blocks without lacing, with Xiph, fixed-size and EBML lacing


def _size(n: int) -> bytes:
    """The shortest variable-length size; all ones in a length are kept for 'unknown'."""
    length = 1
    while n >= (1 << (7 * length)) - 1:
        length += 1
    return (n | 1 << (7 * length)).to_bytes(length, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    length = 1
    while abs(n) > (1 << (7 * length - 1)) - 1:
        length += 1
    return (n + (1 << (7 * length - 1)) - 1 | 1 << (7 * length)).to_bytes(length, "big")


def lace(frames: list[bytes], lacing: int) -> bytes:
    """A block's body after its header: the lace's sizes and the frames (0 none, 1 Xiph, 2 fixed-size, 3 EBML)."""
    if lacing == 0:
        (only,) = frames
        return only
    head, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 2:
        if len(set(sizes)) > 1:
            raise ValueError("fixed-size lacing needs frames of one size")
    else:
        head += _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """The payload as a Matroska file: 576-byte frames of 8-bit samples, eight to a fixed-size lace."""
    header = _element(
        EBML,
        _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LEN, 4) + _uint(EBML_SIZE_LEN, 8)
        + _element(DOCTYPE, b"matroska") + _uint(DOCTYPE_VERSION, 4) + _uint(DOCTYPE_READ, 2),
    )
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"quillgraph") + _element(WRITING_APP, b"quillgraph"))
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", 8000.0)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    step, per_cluster = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for start in range(0, len(payload), per_cluster):
        time = start // FRAME * _MS_A_FRAME
        blocks = [_uint(TIMESTAMP, time)]
        for k in range(start, min(start + per_cluster, len(payload)), step):
            data = payload[k : k + step]
            n = len(data) // FRAME
            relative = (k - start) // FRAME * _MS_A_FRAME
            lacing = 2 if n > 1 else 0
            head = b"\x81" + struct.pack(">hB", relative, 0x80 | lacing << 1)
            blocks.append(_element(SIMPLE_BLOCK, head + (bytes([n - 1]) if lacing else b"") + data))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return header + _element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """Value and the position after it; None: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if keep_marker:
        return value, at + length
    value &= (1 << (7 * length)) - 1
    return (None if value == (1 << (7 * length)) - 1 else value), at + length


def _children(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, its end); an unknown size ends where the parent's kin begins."""
    while at < end:
        ident, body = _vint(data, at, True)
        size, body = _vint(data, body, False)
        stop = body + size if size is not None else _end_of_unknown(data, body, end, ident)
        if stop > end:
            raise ValueError(f"element at {at} runs over its parent's end")
        yield ident, at, body, stop
        at = stop


def _end_of_unknown(data: bytes, at: int, end: int, ident: int) -> int:
    inside = _INSIDE.get(ident)
    if inside is None:
        return end
    while at < end:
        child, body = _vint(data, at, True)
        if child not in inside:
            return at
        size, body = _vint(data, body, False)
        if size is None:
            raise ValueError(f"unknown size inside a cluster at {at}")
        at = body + size
    return end


def _uint_at(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _frames(data: bytes, at: int, end: int, lacing: int) -> Iterator[tuple[int, int]]:
    """(offset, size) of each frame of a block whose body, after the header, is data[at:end]."""
    if lacing == 0:
        yield at, end - at
        return
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 2:
        if (end - at) % n:
            raise ValueError(f"fixed-size lace of {n} frames in {end - at} bytes")
        sizes = [(end - at) // n] * (n - 1)
    elif n > 1:
        size, at = _vint(data, at, False)
        sizes.append(size or 0)
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            raw, at = _vint(data, at, False)
            raw = (1 << (7 * length)) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << (7 * length - 1)) - 1))
    sizes.append(end - at - sum(sizes))
    for size in sizes:
        if size < 0:
            raise ValueError("a lace's sizes exceed its block")
        yield at, size
        at += size


def packets(data: bytes) -> Parsed:
    """Packet table, cues and clusters of a Matroska file."""
    found, cues, clusters, lacings, segment = [], [], [], [0, 0, 0, 0], 0

    def block(start: int, end: int, base: int, keyframe: bool | None) -> None:
        track, at = _vint(data, start, False)
        relative, flags = struct.unpack_from(">hB", data, at)
        lacing = flags >> 1 & 3
        lacings[lacing] += 1
        key = bool(flags & 0x80) if keyframe is None else keyframe
        for offset, size in _frames(data, at + 3, end, lacing):
            found.append(Packet(track or 0, base + relative, offset, size, key, len(clusters) - 1))

    for ident, _, body, end in _children(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        segment = body
        for child, start, at, stop in _children(data, body, end):
            if child == CLUSTER:
                clusters.append(start - segment)
                base = 0
                for x, _, a, z in _children(data, at, stop):
                    if x == TIMESTAMP:
                        base = _uint_at(data, a, z)
                    elif x == SIMPLE_BLOCK:
                        block(a, z, base, None)
                    elif x == BLOCK_GROUP:
                        inner = list(_children(data, a, z))
                        referenced = any(y == 0xFB for y, *_ in inner)
                        for y, _, p, q in inner:
                            if y == BLOCK:
                                block(p, q, base, not referenced)
            elif child == CUES:
                for x, _, a, z in _children(data, at, stop):
                    if x == CUE_POINT:
                        point = {y: (p, q) for y, _, p, q in _children(data, a, z)}
                        where = {y: _uint_at(data, p, q) for y, _, p, q in _children(data, *point[CUE_POSITIONS])}
                        cues.append((_uint_at(data, *point[CUE_TIME]), where[CUE_TRACK], where[CUE_CLUSTER]))
    return Parsed(found, cues, segment, clusters, lacings)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with 255 to a positive multiple of 576, and their number without padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (-len(raw) % FRAME or (FRAME if not raw else 0)), len(raw)


def stored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: each text, padded, as a Matroska file in a binary column; ``n_bytes`` counts the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                payloads = [payload_of(t.as_py()) for t in part.column(1)]
                columns = [part.column(0), pa.array([n for _, n in payloads], pa.int64()), pa.array([mux(p) for p, _ in payloads], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "media"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


def samples(data: bytes, parsed: Parsed) -> np.ndarray:
    """All frames of a file as unsigned 8-bit samples, one after the other."""
    whole = np.frombuffer(data, np.uint8)
    return np.concatenate([whole[p.offset : p.offset + p.size] for p in parsed.packets]) if parsed.packets else whole[:0]


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of the files in the binary column ``media``: key, number, :class:`Packet`'s fields, and the mean and the mean step of its samples."""
    kind = df.schema[key].dataType.simpleString()
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.as_py() if data.is_valid else b""
                rows = packets(raw).packets
                if rows:
                    whole = np.frombuffer(raw, np.uint8)
                    frames = [whole[p.offset : p.offset + p.size].astype(np.int64) for p in rows]
                    mean = [float(f.mean()) if len(f) else 0.0 for f in frames]
                    step = [float(np.abs(np.diff(f)).mean()) if len(f) > 1 else 0.0 for f in frames]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    first = [pa.array([ident.as_py()] * len(rows), batch.column(0).type), pa.array(range(len(rows)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*first, *columns, pa.array(mean), pa.array(step)], names=names)

    names = ["key", "packet", "track", "timestamp", "offset", "size", "keyframe", "cluster", "mean", "step"]
    schema = f"key {kind}, packet long, track long, timestamp long, offset long, size long, keyframe boolean, cluster long, mean double, step double"
    return df.select(F.col(key).alias("key"), F.col(media)).mapInArrow(run, schema).withColumnRenamed("key", key)


def feature(data: bytes, parsed: Parsed) -> str:
    """What the packets tell of a file: their number, the cues that lead to a cluster, and mean, deviation, mean step and median of the samples."""
    s = samples(data, parsed).astype(np.int64)
    at_cluster = len({position for _, _, position in parsed.cues}.intersection(parsed.clusters))
    end = parsed.packets[-1].timestamp if parsed.packets else 0
    steps = np.abs(np.diff(s))
    about = f"mean={s.mean():.3f};deviation={s.std():.3f};step={steps.mean() if len(steps) else 0:.3f};median={np.median(s):.1f}" if len(s) else "empty"
    return f"packets={len(parsed.packets)};cues={at_cluster};last_ms={end};{about}"


_READ = [
    StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()),
]


def read_back(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns ``keep``, and size, digests and feature of the packets' bytes and of the files in the binary column ``media``; null files give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                rows: list[tuple] = []
                for data in part.column(len(keep)):
                    if not data.is_valid:
                        rows.append((None,) * 6)
                        continue
                    raw = data.as_py()
                    parsed = packets(raw)
                    back = samples(raw, parsed).tobytes()
                    rows.append((
                        len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(raw, parsed),
                    ))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=schema.names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    schema = StructType([*df.select(*kept).schema, *_READ])
    out = df.select(*kept, F.col(media)).mapInArrow(run, schema)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *schema.names[len(keep) :])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read_back(stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), ["doc_id", "n_bytes"])
