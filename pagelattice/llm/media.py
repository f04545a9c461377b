"""Media columns: Matroska files held in a binary column, as packet tables.

The parser reads variable-length EBML elements, tracks, clusters, simple blocks and block groups, the three kinds of lacing and
the cues, and gives one row for each frame with its time, track and byte range in the file. Payloads aren't copied. Elements of
unknown size (live streams) end where an element begins that can't be inside them.

A file is parsed where its row is read: no shuffle. `mux` writes small Matroska files, here from texts.

Defined cases: null media gives no row; a file without packets, or broken before the first, gives one row with null packet fields
and its error; a file that breaks later keeps the packets before and has the error in a last row, as has one whose track numbers
or times don't fit the columns; repeated rows give repeated packets; equal times keep the file's order; extra columns pass through, those named like packet fields are replaced; an empty table
gives an empty table; a very large file is parsed in place, in memory in proportion to its packets.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, ENTRY, NUMBER, KIND, CODEC, DEFAULT = 0x2AD7B1, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
TIME, SIMPLE, GROUP, BLOCK, DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
POINT, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB7, 0xF7, 0xF1
_TOP = {SEGMENT, EBML}
_LEVEL1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
LACING = ("none", "xiph", "fixed", "ebml")

FIELDS = [
    ("packet_no", T.IntegerType()),
    ("track", T.IntegerType()),
    ("codec", T.StringType()),
    ("pts_ns", T.LongType()),
    ("duration_ns", T.LongType()),
    ("keyframe", T.BooleanType()),
    ("lacing", T.StringType()),
    ("frame_in_block", T.IntegerType()),
    ("byte_start", T.LongType()),
    ("byte_size", T.LongType()),
    ("cluster_start", T.LongType()),
    ("cued", T.BooleanType()),
    ("crc32", T.LongType()),
    ("error", T.StringType()),
]


class Broken(ValueError):
    """A file that isn't Matroska as published."""


def vint(buf: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place) of a variable-length integer; value -1: unknown size. keep: with the length marker, as in ids."""
    if at >= end:
        raise Broken(f"the file ends at {at}")
    first = buf[at]
    n = 9 - first.bit_length()
    if n > 8 or keep and n > 4:
        raise Broken(f"no variable-length integer at {at}")
    if at + n > end:
        raise Broken(f"the file ends at {end}")
    value = int.from_bytes(buf[at : at + n], "big")
    if not keep:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n


def elements(buf: bytes, at: int, end: int, level: int = 9):
    """(id, start of the element, start and end of its content) of the elements in a stretch."""
    while at < end:
        start = at
        key, at = vint(buf, at, end, keep=True)
        size, at = vint(buf, at, end)
        if size < 0:
            stop = end if key == SEGMENT else _unknown_end(buf, at, end)
        else:
            stop = at + size
            if stop > end:
                if key in (SEGMENT, CLUSTER):
                    stop = end  # cut off; what is there counts
                else:
                    raise Broken(f"the element at {start} ends beyond its parent")
        yield key, start, at, stop
        at = stop


def _unknown_end(buf: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next element of its own level or above."""
    while at < end:
        key, body = vint(buf, at, end, keep=True)
        if key in _LEVEL1 or key in _TOP:
            return at
        size, body = vint(buf, body, end)
        if size < 0:
            return at
        at = body + size
    return min(at, end)


def uint(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def frames_of(buf: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block's content after its header."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise Broken(f"no lace count at {at}")
    n = buf[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise Broken(f"a fixed lace at {at} doesn't divide")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if lacing == 1:
                s = 0
                while True:
                    if at >= end:
                        raise Broken(f"the file ends at {at}")
                    s += buf[at]
                    at += 1
                    if buf[at - 1] != 255:
                        break
            elif k == 0:
                s, at = vint(buf, at, end)
            else:
                width = 9 - buf[at].bit_length() if at < end else 0
                d, at = vint(buf, at, end)
                d = (1 << 7 * width) - 1 if d < 0 else d
                s = sizes[-1] + d - ((1 << 7 * width - 1) - 1)
            sizes.append(s)
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        if s < 0 or at + s > end:
            raise Broken(f"a lace at {at} is longer than its block")
        out.append((at, s))
        at += s
    return out


def packets(buf: bytes) -> tuple[list[tuple], str | None]:
    """(track, codec, pts_ns, duration_ns, keyframe, lacing, frame_in_block, start, size, cluster_start, cued, crc32) of each frame, in file order; and the error."""
    rows: list[tuple] = []
    scale, tracks, cued = 1_000_000, {}, set()
    clusters: list[tuple[int, int, int]] = []
    error = None
    seen = False
    try:
        for key, _, a, b in elements(buf, 0, len(buf)):
            if not seen and key != EBML:
                raise Broken("no EBML header")
            seen = True
            if key != SEGMENT:
                continue
            base = a
            for k, s, a1, b1 in elements(buf, a, b):
                if k == INFO:
                    for k2, _, x, y in elements(buf, a1, b1):
                        if k2 == SCALE:
                            scale = uint(buf, x, y)
                elif k == TRACKS:
                    for k2, _, x, y in elements(buf, a1, b1):
                        if k2 == ENTRY:
                            t = {k3: buf[p:q] for k3, _, p, q in elements(buf, x, y)}
                            tracks[int.from_bytes(t.get(NUMBER, b""), "big")] = (t.get(CODEC, b"").rstrip(b"\0").decode("utf-8", "replace"), int.from_bytes(t.get(DEFAULT, b""), "big") or None)
                elif k == CUES:
                    for k2, _, x, y in elements(buf, a1, b1):
                        if k2 == POINT:
                            for k3, _, p, q in elements(buf, x, y):
                                if k3 == POSITIONS:
                                    t = {k4: uint(buf, u, v) for k4, _, u, v in elements(buf, p, q)}
                                    cued.add((t.get(CUE_TRACK), base + t.get(CUE_CLUSTER, -1)))
                elif k == CLUSTER:
                    clusters.append((s, a1, b1))
        if not seen:
            raise Broken("no EBML header")
    except Broken as e:
        error = str(e)
    try:
        for start, a, b in clusters:
            time = 0
            for k, _, x, y in elements(buf, a, b):
                if k == TIME:
                    time = uint(buf, x, y)
                elif k == SIMPLE:
                    _block(buf, x, y, time, scale, tracks, cued, start, rows, None, None)
                elif k == GROUP:
                    inside = [(k2, p, q) for k2, _, p, q in elements(buf, x, y)]
                    length = next((uint(buf, p, q) for k2, p, q in inside if k2 == DURATION), None)
                    key = not any(k2 == REFERENCE for k2, *_ in inside)
                    for k2, p, q in inside:
                        if k2 == BLOCK:
                            _block(buf, p, q, time, scale, tracks, cued, start, rows, length, key)
    except Broken as e:
        error = error or str(e)
    return rows, error


def _block(buf, at, end, time, scale, tracks, cued, cluster, rows, length, key) -> None:
    track, body = vint(buf, at, end)
    if not 0 <= track < 1 << 31:
        raise Broken(f"the block at {at} has no track number of 31 bits")
    if body + 3 > end:
        raise Broken(f"the block at {at} has no header")
    offset, flags = struct.unpack_from(">hB", buf, body)
    lacing = flags >> 1 & 3
    found = frames_of(buf, body + 3, end, lacing)
    codec, default = tracks.get(track, (None, None))
    pts = (time + offset) * scale
    each = length * scale // len(found) if length is not None else default
    key = bool(flags & 0x80) if key is None else key
    if not all(-1 << 63 <= t < 1 << 63 for t in (pts, each or 0, pts + len(found) * (each or 0))):
        raise Broken(f"the block at {at} has a time beyond 63 bits")
    for i, (s, n) in enumerate(found):
        rows.append((track, codec, pts + i * (each or 0), each, key, LACING[lacing], i, s, n, cluster, (track, cluster) in cued, zlib.crc32(buf[s : s + n])))


def parse_packets(df: DataFrame, column: str = "media") -> DataFrame:
    """The packet table: df's other columns with FIELDS for each frame."""
    names = [n for n, _ in FIELDS]
    others = [c for c in df.columns if c != column and c not in names]
    df = df.select(*others, column)
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(n, k) for n, k in FIELDS])

    def run(batches):
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        for b in batches:
            media, index, rows = b.column(b.num_columns - 1), [], []

            def flush():
                cols = list(zip(*rows)) or [()] * len(kinds)
                at = pa.array(index, pa.int64())
                return pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(len(others))] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[*others, *names])

            for i in range(b.num_rows):
                buf = media[i].as_py()
                if buf is None:
                    continue
                found, error = packets(buf)
                rows += [(k, *r, None) for k, r in enumerate(found)]
                if error or not found:
                    rows.append((None,) * (len(kinds) - 1) + (error or "no packets",))
                index += [i] * (len(rows) - len(index))
                if len(rows) > 50_000:
                    yield flush()
                    index, rows = [], []
            yield flush()

    return df.mapInArrow(run, schema)


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, content: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _uint(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == 3:
        head += _size(len(frames[0])) if len(frames) > 1 else b""
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            w = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += _size(d + (1 << 7 * w - 1) - 1, w)
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = 512, per_block: int = 8, per_cluster: int = 32) -> bytes:
    """A Matroska file of two tracks whose frames, in file order, are the payload; blocks take the kinds of lacing in turn."""
    cut = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    blocks: list[bytes] = []
    i = k = 0
    while i < len(cut):
        lacing = k % 4
        n = 1 if lacing == 0 else per_block
        part = cut[i : i + n]
        if lacing == 2 and len({len(f) for f in part}) > 1:
            part = part[:-1]
        track = 1 + k // 4 % 2
        inside = i % (per_cluster * per_block)
        content = _size(track) + struct.pack(">hB", 0, (0x80 if k % 8 == 0 else 0) | lacing << 1) + _laced(part, lacing)
        blocks.append((i, content, k % 5 == 4, len(part), inside))
        i += len(part)
        k += 1
    head = element(EBML, _uint(0x4286, 1) + element(0x4282, b"matroska"))
    info = element(INFO, _uint(SCALE, 1_000_000))
    entry = lambda n, kind, codec: element(ENTRY, _uint(NUMBER, n) + _uint(KIND, kind) + element(CODEC, codec) + _uint(DEFAULT, 20_000_000))
    body = info + element(TRACKS, entry(1, 17, b"S_TEXT/UTF8") + entry(2, 2, b"A_PCM/INT/LIT"))
    cues = b""
    for c in range(0, len(blocks), per_cluster):
        group = blocks[c : c + per_cluster]
        t0 = group[0][0] * 20
        content = _uint(TIME, t0)
        for at, block, grouped, n, _ in group:
            block = block[:1] + struct.pack(">h", at * 20 - t0) + block[3:]
            content += element(GROUP, element(BLOCK, block) + _uint(DURATION, 20 * n)) if grouped else element(SIMPLE, block)
        cues += element(POINT, _uint(0xB3, t0) + element(POSITIONS, _uint(CUE_TRACK, group[0][1][0] & 127) + _uint(CUE_CLUSTER, len(body))))
        body += element(CLUSTER, content)
    if cues:
        body += element(CUES, cues)
    return head + element(SEGMENT, body)


def mux_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media BINARY): a Matroska file of each document's UTF-8 bytes; null for a null text."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in batches:
            step = 256
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else mux(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.mapInArrow(run, schema)


def op3_media_packets(spark, sf_dir: str) -> DataFrame:
    """The packet table of the media of all documents."""
    return parse_packets(mux_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
