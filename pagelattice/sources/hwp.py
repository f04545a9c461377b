"""Binary HWP 5 files: a reader of compound files, their records, texts, tables and previews, by the published format.

    compound(content)        the streams of an OLE2 compound file
    sections(streams)        the records of each body section
    blocks(content)          paragraphs, tables and page breaks, as sources.office gives them
    raw_text(content)        only the characters, for files whose records are damaged
    extract(files)           the three ways as candidates for office.best_extraction, in one pass over the files

Defined cases: content that isn't a compound file, and one without a body, give an error row each; a damaged section is left out as
long as another can be read; null content gives an error row; repeated files give repeated rows; a record or a chain of sectors that
leads out of the file ends what it belongs to; very large files are held in memory one at a time.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.previews import clean_raw
from ..session import cut, pieces, small_batches
from .office import _ARROW, _CELL, BLOCK, NESTED, _Blocks, best_extraction, to_markdown

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
SIGNATURE = b"HWP Document File"
PARA_HEADER, PARA_TEXT, CTRL_HEADER, LIST_HEADER, TABLE = 66, 67, 71, 72, 77
_LAST = 0xFFFFFFFA  # sector numbers from here on are marks
#: Control characters of one unit; all other codes under 32 take eight.
_SINGLE = frozenset((0, 10, 13, 24, 25, 26, 27, 28, 29, 30, 31))
_IMAGES = ((b"\x89PNG", "png"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"\xff\xd8", "jpg"))
_SPLIT_PAGE = 0x04 | 0x01


class Damaged(ValueError):
    """A file that can't be read, and why."""


def compound(content: bytes) -> dict[str, bytes]:
    """path -> bytes of the streams of a compound file."""
    if content[:8] != MAGIC:
        raise Damaged("not a compound file")
    if len(content) < 512:
        raise Damaged("no compound file header")
    big, small = (1 << s for s in struct.unpack_from("<HH", content, 30))
    if not 128 <= big <= 1 << 16 or not 8 <= small <= big:
        raise Damaged("bad sector size")
    first_dir, cutoff, first_mini = (struct.unpack_from("<I", content, at)[0] for at in (48, 56, 60))
    more, left = struct.unpack_from("<II", content, 68)
    sector = lambda n: content[(n + 1) * big : (n + 2) * big]
    table = [n for n in struct.unpack_from("<109I", content, 76) if n < _LAST]
    seen = set()
    while left and more < _LAST and more not in seen:
        seen.add(more)
        part = sector(more)
        if len(part) < big:
            break
        *own, more = struct.unpack(f"<{big // 4}I", part)
        table += [n for n in own if n < _LAST]
        left -= 1
    fat: list[int] = []
    for n in table:
        part = sector(n)
        fat += struct.unpack(f"<{len(part) // 4}I", part[: len(part) // 4 * 4])

    def chain(n: int, links, read) -> bytes:
        out, met = [], set()
        while n < len(links) and n not in met:
            met.add(n)
            out.append(read(n))
            n = links[n]
        return b"".join(out)

    folder = chain(first_dir, fat, sector)
    entries = []
    for at in range(0, len(folder) - 127, 128):
        size = struct.unpack_from("<H", folder, at + 64)[0]
        name = folder[at : at + max(0, min(size, 64) - 2)].decode("utf-16-le", "replace")
        left_, right, child = struct.unpack_from("<III", folder, at + 68)
        start, length = struct.unpack_from("<IQ", folder, at + 116)
        entries.append((name, folder[at + 66], left_, right, child, start, length & 0xFFFFFFFF if big == 512 else length))
    if not entries:
        raise Damaged("no directory")
    mini = chain(entries[0][5], fat, sector)
    raw = chain(first_mini, fat, sector)
    mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])
    out: dict[str, bytes] = {}
    todo, met = [(entries[0][4], "")], set()
    while todo:
        k, above = todo.pop()
        if k >= len(entries) or k in met:
            continue
        met.add(k)
        name, kind, a, b, child, start, length = entries[k]
        todo += [(a, above), (b, above)]
        if kind == 1:
            todo.append((child, f"{above}{name}/"))
        elif kind == 2:
            whole = chain(start, fat, sector) if length >= cutoff else chain(start, mini_fat, lambda n: mini[n * small : (n + 1) * small])
            out[above + name] = whole[:length]
    return out


def diagnose(streams: dict[str, bytes]) -> str | None:
    """Why a compound file isn't a readable HWP document; null if it is."""
    header = streams.get("FileHeader")
    if header is None:
        return "no header"
    if len(header) < 40:
        return "short header"
    if not header.startswith(SIGNATURE):
        return "bad signature"
    flags = struct.unpack_from("<I", header, 36)[0]
    if flags & 0x02:
        return "encrypted"
    if flags & 0x14:
        return "for distribution only"
    return None if any(n.startswith("BodyText/") for n in streams) else "no body"


def inflate(data: bytes) -> bytes:
    """Raw deflate; of a broken stream what comes before the break."""
    d, out = zlib.decompressobj(-15), []
    try:
        for k in range(0, len(data), 1 << 16):
            out.append(d.decompress(data[k : k + (1 << 16)]))
        out.append(d.flush())
    except zlib.error:
        if not out:
            raise Damaged("not a deflate stream") from None
    return b"".join(out)


def sections(streams: dict[str, bytes]) -> list[bytes]:
    """The records of the body's sections in the order of their numbers; broken ones are left out."""
    packed = struct.unpack_from("<I", streams["FileHeader"], 36)[0] & 1
    found, why = [], "no body"
    for _, name in sorted((int(m[1]), n) for n in streams if (m := re.fullmatch(r"BodyText/Section([0-9]+)", n))):
        try:
            found.append(inflate(streams[name]) if packed else streams[name])
        except Damaged as e:
            why = str(e)
    if not found:
        raise Damaged(why)
    return found


def records(data: bytes):
    """(tag, level, content) of a section's records."""
    at = 0
    while at + 4 <= len(data):
        head = struct.unpack_from("<I", data, at)[0]
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size = struct.unpack_from("<I", data, at)[0]
            at += 4
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def text_of(content: bytes) -> str:
    """The characters of a text record; tabs and line breaks stay, other controls go with what they carry."""
    out, at = [], 0
    end = len(content) // 2 * 2
    while at < end:
        code = content[at] | content[at + 1] << 8
        if code >= 32:
            stop = at + 2
            while stop < end and (content[stop] >= 32 or content[stop + 1]):
                stop += 2
            out.append(content[at:stop].decode("utf-16-le", "replace"))
            at = stop
        else:
            out.append({9: "\t", 10: "\n", 24: "-", 30: "\xa0", 31: " "}.get(code, ""))
            at += 2 if code in _SINGLE else 16
    return "".join(out)


def _section(data: bytes, out: _Blocks) -> None:
    """A section's blocks. Tables are drawn where they stand; one inside a cell follows its outer table and is marked in the cell."""
    open_: list[dict] = []  # the tables that the record at hand is inside of
    done: list[dict] = []
    expect: int | None = None  # level of a table's control header whose table record is due

    def close(level: int) -> None:
        while open_ and open_[-1]["level"] >= level:
            t = open_.pop()
            if not open_:
                done.append(t)
                flush()

    def flush() -> None:
        for t in done:
            emit(t, None)
        done.clear()

    def emit(t: dict, parent: int | None) -> None:
        if not t["cells"]:
            return
        number = out.table([(k, t["cols"], *c["at"], c["blocks"]) for k, c in enumerate(t["cells"])], parent)
        for n, inner in t["inner"]:
            out.add("paragraph", NESTED.format(n))
            emit(inner, number)

    for tag, level, body in records(data):
        if tag == PARA_HEADER:
            close(level)
            if not open_ and len(body) > 11 and body[11] & _SPLIT_PAGE and out.rows and out.rows[-1][0] != "break":
                out.add("break", "---")
        elif tag == PARA_TEXT:
            s = text_of(body).strip()
            if s:
                if open_ and open_[-1]["cells"]:
                    open_[-1]["cells"][-1]["blocks"].append(s)
                elif not open_:
                    out.add("paragraph", s)
        elif tag == CTRL_HEADER:
            close(level)
            expect = level if body[:4] == b" lbt" else None
        elif tag == TABLE and expect is not None and len(body) >= 8:
            t = {"level": expect, "cols": struct.unpack_from("<H", body, 6)[0], "cells": [], "inner": []}
            if open_ and open_[-1]["cells"]:
                out.nested += 1
                open_[-1]["cells"][-1]["blocks"].append(NESTED.format(out.nested))
                open_[-1]["inner"].append((out.nested, t))
            open_.append(t)
            expect = None
        elif tag == LIST_HEADER:
            close(level)
            if not open_ or level != open_[-1]["level"] + 1 or len(body) < 16:
                continue
            col, row, across, down = struct.unpack_from("<4H", body, 8)
            open_[-1]["cells"].append({"at": (row, col, max(1, down), max(1, across)), "blocks": []})
    close(0)
    flush()


def blocks(content: bytes) -> list[tuple]:
    """The blocks of a file, a break between two sections."""
    streams = compound(content)
    if why := diagnose(streams):
        raise Damaged(why)
    out = _Blocks()
    for k, data in enumerate(sections(streams)):
        if k and out.rows and out.rows[-1][0] != "break":
            out.add("break", "---")
        _section(data, out)
    return out.rows


def raw_text(content: bytes) -> str:
    """The characters of all text records, one line each."""
    streams = compound(content)
    if why := diagnose(streams):
        raise Damaged(why)
    lines = [text_of(body).strip() for data in sections(streams) for tag, _, body in records(data) if tag == PARA_TEXT]
    return "\n".join(x for x in lines if x)


def preview(streams: dict[str, bytes]) -> tuple[str | None, bytes | None, str | None]:
    """(text, picture, kind of picture) of the preview streams; null for what isn't there."""
    text = streams.get("PrvText")
    image = streams.get("PrvImage") or None
    kind = next((k for head, k in _IMAGES if image and image.startswith(head)), None)
    return (text.decode("utf-16-le", "replace").rstrip("\0") if text else None), (image if kind else None), kind


EXTRACT = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("way", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField("block_text" if n == "text" else n, k) for n, k in BLOCK]
)


def extract(files: DataFrame) -> DataFrame:
    """Candidates (path, rank, way, ok, reason, text, BLOCK's columns, its text as block_text) of files (path, content): the tree of records first (a row for each block), then the bare characters, then the preview. A way that fails or finds nothing gives one row with its reason."""
    names = EXTRACT.names

    def ways(data: bytes | None):
        if data is None:
            yield 0, "tree", "no content", None, None
            return
        for rank, way in enumerate(("tree", "text", "preview")):
            try:
                if way == "tree":
                    found = blocks(data)
                    yield rank, way, None if found else "no text", None, found or None
                else:
                    got = raw_text(data) if way == "text" else preview(compound(data))[0]
                    yield rank, way, None if got else "no text", got or None, None
            except (Damaged, struct.error, IndexError, zlib.error) as e:
                yield rank, way, str(e) or type(e).__name__, None, None

    def run(batches):
        for b in pieces(batches):
            index, rows = [], []
            for i, content in enumerate(b.column(1)):
                for rank, way, why, text, found in ways(content.as_py()):
                    head = (rank, way, why is None, why, text)
                    if found:
                        rows += [(*head, k, *r[:-1], None if r[-1] is None else [dict(zip(_CELL.names, c)) for c in r[-1]]) for k, r in enumerate(found)]
                    else:
                        rows.append((*head, *(None,) * len(BLOCK)))
                index += [i] * (len(rows) - len(index))
            cols = list(zip(*rows)) or [()] * (len(names) - 1)
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), *_ARROW]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return small_batches(files.select("path", "content")).mapInArrow(run, EXTRACT)


def previews(files: DataFrame) -> DataFrame:
    """(path, text, image BINARY, image_kind, diagnosis) of files (path, content); the diagnosis says why the body can't be read."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("image", T.BinaryType()), T.StructField("image_kind", T.StringType()), T.StructField("diagnosis", T.StringType())])

    def run(batches):
        for b in pieces(batches):
            rows = []
            for content in b.column(1):
                try:
                    streams = compound(content.as_py() or b"")
                    rows.append((*preview(streams), diagnose(streams)))
                except (Damaged, struct.error, IndexError) as e:
                    rows.append((None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.binary(), pa.string(), pa.string())))], names=schema.names)

    return small_batches(files.select("path", "content")).mapInArrow(run, schema)


# writing, for fixtures and round trips


def pack(streams: dict[str, bytes]) -> bytes:
    """A compound file of these streams; names may have one folder before them. Everything lies in whole sectors of 512 bytes."""
    folders = sorted({n.split("/")[0] for n in streams if "/" in n})
    order = [n for n in streams if "/" not in n]
    entries: list[list] = [["Root Entry", 5, -1, -1]]
    top = [*folders, *order]
    place: dict[str, int] = {}
    for n in top:
        place[n] = len(entries)
        entries.append([n, 1 if n in folders else 2, -1, -1])
    for n in streams:
        if "/" in n:
            place[n] = len(entries)
            entries.append([n.split("/")[1], 2, -1, -1])
    right = {}
    for group in (top, *([n for n in streams if n.startswith(f"{f}/")] for f in folders)):
        for a, b in zip(group, group[1:]):
            right[place[a]] = place[b]
    child = {0: place[top[0]] if top else -1} | {place[f]: place[next(n for n in streams if n.startswith(f"{f}/"))] for f in folders}
    fat: list[int] = []
    body: list[bytes] = []

    def add(data: bytes) -> int:
        n = max(1, -(-len(data) // 512))
        start = len(fat)
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        body.append(data.ljust(512 * n, b"\0"))
        return start

    starts = {place[n]: (add(s), len(s)) for n, s in streams.items()}
    raw = b""
    for k, (name, kind, _, _) in enumerate(entries):
        encoded = name.encode("utf-16-le") + b"\0\0"
        start, size = starts.get(k, (0xFFFFFFFE, 0))
        raw += encoded.ljust(64, b"\0") + struct.pack("<HBBIII", len(encoded), kind, 1, 0xFFFFFFFF, right.get(k, -1) & 0xFFFFFFFF, child.get(k, -1) & 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, size)
    first_dir = add(raw)
    n = 1
    while -(-(len(fat) + n) // 128) > n:
        n += 1
    own = list(range(len(fat), len(fat) + n))
    fat += [0xFFFFFFFD] * n
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, n, first_dir, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, own[0])
    head += b"".join(struct.pack("<I", own[k] if k < n else 0xFFFFFFFF) for k in range(1, 109))
    if n > 109:
        raise ValueError("fixtures have less than 7 MB")
    return head.ljust(512, b"\0") + b"".join(body) + struct.pack(f"<{len(fat)}I", *fat).ljust(512 * n, b"\xff")


def record(tag: int, level: int, content: bytes) -> bytes:
    long = len(content) >= 0xFFF
    return struct.pack("<I", tag | level << 10 | (0xFFF if long else len(content)) << 20) + (struct.pack("<I", len(content)) if long else b"") + content


def paragraph(text: str, level: int = 0, split: int = 0) -> bytes:
    raw = text.replace("\t", "\t" * 8).encode("utf-16-le")  # a tab takes eight units
    return record(PARA_HEADER, level, struct.pack("<IIHBB", len(raw) // 2 + 1, 0, 0, 0, split) + bytes(10)) + record(PARA_TEXT, level + 1, raw + b"\r\0")


def table(cells: list[tuple[int, int, int, int, bytes | str]], cols: int, level: int = 1) -> bytes:
    """Records of a table: cells (row, col, rowspan, colspan, text or records one level below the cell)."""
    rows = 1 + max((c[0] for c in cells), default=0)
    out = [record(CTRL_HEADER, level, b" lbt" + bytes(40)) + record(TABLE, level + 1, struct.pack("<IHH", 0, rows, cols) + bytes(10) + bytes(2 * rows))]
    for r, c, down, across, inside in cells:
        out.append(record(LIST_HEADER, level + 1, struct.pack("<II4H", 1, 0, c, r, across, down) + bytes(18)))
        out.append(paragraph(inside, level + 1) if isinstance(inside, str) else inside)
    return b"".join(out)


def document(body: list[bytes], packed: bool = True, flags: int = 0, **streams: bytes) -> bytes:
    """A file of these sections and of other streams."""
    header = SIGNATURE.ljust(32, b"\0") + struct.pack("<II", 0x05000300, flags | packed)

    def squeeze(data: bytes) -> bytes:
        d = zlib.compressobj(6, zlib.DEFLATED, -15)
        return d.compress(data) + d.flush()

    return pack({"FileHeader": header.ljust(256, b"\0"), **{f"BodyText/Section{k}": squeeze(s) if packed else s for k, s in enumerate(body)}, **streams})


#: Characters from which the tree's text is taken without looking at the others.
ENOUGH = 200


def best(files: DataFrame, html: DataFrame | None = None) -> DataFrame:
    """(path, way, text, reason): the tree's Markdown if it has ENOUGH characters; else that of a conversion to HTML (path, text, null if it lost content), the bare characters if they are more, the short tree, or the preview. reason: why the first way failed."""
    c = cut(extract(files), "hwp")
    tree = to_markdown(c.where("way = 'tree' and ok").drop("text").withColumnRenamed("block_text", "text"))
    size = F.length("content")
    long = tree.where(size >= ENOUGH).select("path", F.lit(0).alias("rank"), F.lit("tree").alias("way"), F.col("content").alias("text"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    short = tree.where(size < ENOUGH).select("path", F.lit(3).alias("rank"), F.lit("tree").alias("way"), F.col("content").alias("text"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    raw = c.where("way = 'text' and ok").select("path", clean_raw(F.col("text")).alias("text")).join(tree.select("path", size.alias("n")), "path", "left")
    raw = raw.select("path", F.lit(2).alias("rank"), F.lit("text").alias("way"), "text", F.length("text") > F.coalesce("n", F.lit(0)), F.lit(None).cast("string").alias("reason"))
    seen = c.where("way = 'preview' and ok").select("path", F.lit(4).alias("rank"), F.lit("preview").alias("way"), "text", F.lit(True), F.lit(None).cast("string"))
    failed = c.where("not ok").select("path", F.lit(-1).alias("rank"), "way", F.lit(None).cast("string"), F.lit(False), "reason").where("way = 'tree'")
    ways = long.unionAll(short).unionAll(raw).unionAll(seen).unionAll(failed)
    if html is not None:
        ways = ways.unionAll(html.where("trim(text) <> ''").select("path", F.lit(1), F.lit("html"), "text", F.lit(True), F.lit(None).cast("string")))
    return best_extraction(ways.dropDuplicates(["path", "rank"]), "path")
