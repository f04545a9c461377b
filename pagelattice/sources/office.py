"""Word-processor files to block relations, from the binary column of sources.files.scan.

HWPX is an archive of XML sections, HWPML one XML document. Files are parsed where their rows are read. Both give

    path, block_no INT, kind (paragraph, heading, table, break), level INT, text STRING, table_no INT
    cells: path, table_no, cell_no, declared_cols, row, col, rowspan, colspan, blocks ARRAY<STRING>, parent INT

so that everything after is relational: grids are rendered by operators.grid, a table inside a cell is drawn after its outer table
and marked in the cell. A file that can't be read gives one row of kind "error" with the reason.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import render_grid
from ..session import pieces, small_batches

NESTED = "[중첩표 {}]"
PICTURE = "[그림]"
_FIELD = '"simplefields"'
_CHAPTER, _ARTICLE = re.compile(r"\s*제\s*[0-9]+\s*장\b"), re.compile(r"(제\s*[0-9]+조(?:의[0-9]+)?\s*[(][^)]*[)])(.*)", re.S)
_SKIPPED = frozenset("COLDEF ENDNOTE ENDNOTESHAPE FIELDBEGIN FIELDEND FOOTER FOOTNOTE FOOTNOTESHAPE HEADER HIDE PAGEBORDERFILL PAGEDEF SECDEF".split())

_CELL = T.StructType([T.StructField(n, T.IntegerType()) for n in ("cell_no", "declared_cols", "row", "col", "rowspan", "colspan")] + [T.StructField("blocks", T.ArrayType(T.StringType()))])
BLOCK = [("block_no", T.IntegerType()), ("kind", T.StringType()), ("level", T.IntegerType()), ("text", T.StringType()), ("table_no", T.IntegerType()), ("parent", T.IntegerType()), ("cells", T.ArrayType(_CELL))]
_ARROW_CELL = pa.struct([(n, pa.int32()) for n in _CELL.names[:-1]] + [("blocks", pa.list_(pa.string()))])
_ARROW = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(_ARROW_CELL)]


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


class _Blocks:
    """Blocks of a document in order; tables get numbers as they begin."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.tables = self.nested = 0

    def add(self, kind: str, text: str | None, level: int | None = None) -> None:
        if text:
            self.rows.append((kind, level, text, None, None, None))

    def table(self, cells: list[tuple], parent: int | None) -> int:
        self.tables += 1
        self.rows.append(("table", None, None, self.tables, parent, cells))
        return self.tables


def _int(e, name: str, default: int) -> int:
    try:
        return int(e.get(name, default)) if e is not None else default
    except ValueError:
        return default


def hwpx_blocks(content: bytes) -> list[tuple]:
    """Blocks of an HWPX archive: its sections in the order of their numbers, a break between two."""
    out = _Blocks()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        bold: set[str] = set()
        if "Contents/header.xml" in names:
            for e in ElementTree.fromstring(z.read("Contents/header.xml")).iter():
                if _local(e) == "charPr" and any(_local(c) == "bold" for c in e):
                    bold.add(e.get("id") or "")
        found = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"Contents/section([0-9]+)[.]xml", n)))

        def run_text(run) -> str:
            parts = ("".join(x.itertext()) if _local(x) == "t" else " " if _local(x) in ("tab", "lineBreak") else "" for x in run)
            s = "".join(parts)
            t = s.strip()
            return "" if _FIELD in t and t[:1] == "{" and t[-1:] == "}" else s

        def split(p) -> tuple[list, list]:
            """The runs of a paragraph and its own tables, without what tables hold."""
            runs, tables = [], []

            def walk(e):
                for c in e:
                    if _local(c) == "tbl":
                        tables.append(c)
                    else:
                        if _local(c) == "run":
                            runs.append(c)
                        walk(c)

            walk(p)
            return runs, tables

        def paragraph(runs) -> str:
            texts = [(run_text(r), r.get("charPrIDRef") in bold) for r in runs]
            texts = [x for x in texts if x[0]]
            s = "".join(x for x, _ in texts).strip()
            return f"**{s}**" if s and all(b for _, b in texts) else s

        def table(e, parent: int | None) -> None:
            cells, inner = [], []
            for tr in e:
                for tc in tr if _local(tr) == "tr" else ():
                    if _local(tc) != "tc":
                        continue
                    addr = next((x for x in tc if _local(x) == "cellAddr"), None)
                    span = next((x for x in tc if _local(x) == "cellSpan"), None)
                    texts: list[str] = []

                    def walk(node):
                        for c in node:
                            if _local(c) == "p":
                                runs, tables = split(c)
                                if s := paragraph(runs):
                                    texts.append(s)
                                for t in tables:
                                    out.nested += 1
                                    texts.append(NESTED.format(out.nested))
                                    inner.append((out.nested, t))
                            else:
                                walk(c)

                    walk(tc)
                    cells.append((len(cells), _int(e, "colCnt", 0), _int(addr, "rowAddr", 0), _int(addr, "colAddr", 0), max(1, _int(span, "rowSpan", 1)), max(1, _int(span, "colSpan", 1)), texts))
            if cells:
                number = out.table(cells, parent)
                for n, t in inner:
                    out.add("paragraph", NESTED.format(n))
                    table(t, number)

        def body(node) -> None:
            for c in node:
                if _local(c) == "tbl":
                    table(c, None)
                elif _local(c) == "p":
                    runs, tables = split(c)
                    out.add("paragraph", paragraph(runs))
                    for t in tables:
                        table(t, None)
                else:
                    body(c)

        for k, (_, name) in enumerate(found):
            if k:
                out.add("break", "---")
            body(ElementTree.fromstring(z.read(name)))
    return out.rows


def is_hwpml(content: bytes) -> bool:
    head = content[:512].decode("utf-8", "ignore")
    return "<HWPML" in head or head.startswith("<?xml") and "HWPML" in head


def hwpml_blocks(content: bytes) -> list[tuple]:
    """Blocks of an HWPML document: chapters as headings of level 2, articles with their names in bold."""
    out = _Blocks()
    root = ElementTree.fromstring(content)
    flat = lambda s: " ".join(s.replace("\xa0", " ").split())

    def chars(e, inside: bool) -> str:
        """Characters and pictures below e; inside a cell all of them, in a paragraph those outside of tables."""
        s = ""
        for c in e:
            if c.tag == "TABLE" and not inside:
                continue
            s += (c.text or "") if c.tag == "CHAR" else PICTURE if c.tag == "PICTURE" else chars(c, inside)
        return s

    def table(e) -> None:
        cells, r = [], 0
        for row in e.iter("ROW"):
            for c, cell in enumerate(row.findall("CELL")):
                cells.append((len(cells), 0, r, c, 1, 1, [s] if (s := flat(chars(cell, True))) else []))
            r += 1
        if cells:
            out.table(cells, None)

    def walk(e) -> None:
        if e.tag in _SKIPPED:
            return
        if e.tag == "TABLE":
            table(e)
        elif e.tag == "P":
            for t in _outer_tables(e):
                table(t)
            s = flat(chars(e, False))
            if _CHAPTER.match(s):
                out.add("heading", s, 2)
            elif m := _ARTICLE.match(s):
                out.add("paragraph", f"**{m[1].strip()}** {m[2].strip()}".strip())
            else:
                out.add("paragraph", s)
        else:
            for c in e:
                walk(c)

    body = root.find(".//BODY")
    if body is not None:
        walk(body)
    return out.rows


def _outer_tables(e):
    for c in e:
        if c.tag == "TABLE":
            yield c
        elif c.tag not in _SKIPPED:
            yield from _outer_tables(c)


def read_blocks(files: DataFrame) -> DataFrame:
    """(path, BLOCK's columns) of files (path, content): HWPX by its archive, HWPML by its first bytes."""
    schema = T.StructType([files.schema["path"]] + [T.StructField(n, k) for n, k in BLOCK])
    names = [n for n, _ in BLOCK]

    def run(batches):
        for b in pieces(batches):
            index, rows = [], []
            for i, content in enumerate(b.column(1)):
                data = content.as_py()
                try:
                    found = [("error", None, "no content", None, None, None)] if data is None else hwpml_blocks(data) if is_hwpml(data) else hwpx_blocks(data)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    found = [("error", None, f"{type(e).__name__}: {e}", None, None, None)]
                rows += [(k, *r[:-1], None if r[-1] is None else [dict(zip(_CELL.names, c)) for c in r[-1]]) for k, r in enumerate(found)]
                index += [i] * len(found)
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, _ARROW)], names=["path", *names])

    return small_batches(files.select("path", "content")).mapInArrow(run, schema)


def to_markdown(blocks: DataFrame, marks: bool = True) -> DataFrame:
    """(path, content): Markdown of read_blocks' result; files that couldn't be read are left out."""
    cells = blocks.where("kind = 'table'").select(F.struct("path", "block_no").alias("key"), F.explode("cells").alias("c")).select("key", "c.*")
    grids = render_grid(cells, "key", marks).select("key.path", "key.block_no", F.col("markdown"))
    b = blocks.where("kind <> 'error'").join(grids, ["path", "block_no"], "left")
    piece = F.when(F.col("kind") == "table", F.col("markdown")).when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).otherwise(F.col("text"))
    return b.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("content"))


def best_extraction(candidates: DataFrame, key: str) -> DataFrame:
    """(key, way, text, reason) of candidates (key, rank, way, text, ok, reason): the first that went well; reason is the first failure's."""
    good = F.min_by(F.when(F.col("ok"), F.struct("way", "text")), F.when(F.col("ok"), F.col("rank")))
    bad = F.min_by(F.when(~F.col("ok"), F.col("reason")), F.when(~F.col("ok"), F.col("rank")))
    return candidates.groupBy(key).agg(good.alias("g"), bad.alias("reason")).select(key, "g.way", "g.text", "reason")
