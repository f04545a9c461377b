"""Cutting pages: at page breaks, and at structural boundaries into chunks of a bounded size."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import pieces, small_batches

#: Kinds of boundaries in the order of their rank.
BOUNDARIES = [
    ("chapter", r"\s*제\s*[0-9]+\s*장"),
    ("roman numeral", r"\s*[Ⅰ-Ⅹ]\s*[.．]"),
    ("heading", r"\s*[#]{1,3}\s+\S"),
    ("square", r"\s*□"),
    ("diamond", r"\s*◇"),
    ("circle", r"\s*○"),
    ("numbered item", r"\s*[0-9]+\s*[．.]\s*\S"),
]
PLAIN = 200


def split_breaks(pages: DataFrame, doc: str, order: str, content: str = "content", shared: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """(doc, page_no, content): pages cut at form feeds, blank parts left out, numbered through the document; the shared columns (traces) go to each
    part, the first ones (preview pictures) to a page's first part only."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(content, "\f", -1), strip), lambda c: c != "")
    p = pages.select(doc, order, *shared, *first, F.posexplode(parts).alias("__part", "__c"))
    only = [F.when(F.col("__part") == 0, F.col(c)).alias(c) for c in first]
    return p.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy(order, "__part")).alias("page_no"), F.col("__c").alias(content), *shared, *only)


def find_boundaries(lines: list[str], least: int) -> tuple[str, list[int]]:
    """(kind, line numbers): the first kind that comes often enough, and in the second half too; else the commonest of two or more."""
    best: tuple[str, list[int]] = "", []
    for kind, pattern in BOUNDARIES:
        match = re.compile(pattern).match
        at = [i for i, x in enumerate(lines) if match(x)]
        if len(at) >= max(least, 1) and at[-1] > len(lines) / 2:
            return kind, at
        if len(at) > len(best[1]):
            best = (kind, at)
    return best if len(best[1]) > 1 else ("", [])


def _greedy(sizes: list[int], starts: list[int], begin: int, size: int, most: int) -> list[int]:
    """Where chunks end: at the first start at which the lines since the last end are long enough."""
    ends = []
    for k, at in enumerate(starts):
        if size >= most:
            ends.append(at)
            size = 0
        stop = starts[k + 1] if k + 1 < len(starts) else len(sizes)
        size += sum(sizes[at:stop])
    return ends


def cut_points(lines: list[str], n_chars: int, most: int) -> tuple[str, list[int]]:
    """(kind, first lines of the chunks after the first)."""
    kind, marks = find_boundaries(lines, max(2, n_chars // most))
    if not marks:
        kind, marks = "lines", list(range(0, len(lines), PLAIN))
    sizes = [len(x) + 1 for x in lines]
    starts = [m for m in marks if m]
    ends = _greedy(sizes, starts, 0, sum(sizes[: starts[0] if starts else len(lines)]), most)
    last = ends[-1] if ends else 0
    if sum(sizes[last:]) > 1.5 * most:
        tail = [m for m in starts if m > last]
        ends += _greedy(sizes, tail, last, 0, most)
    return kind, ends


def chunk(pages: DataFrame, doc: str, order: str, most: int, content: str = "content") -> DataFrame:
    """(doc, chunk_no, kind, boundary, content): pages of more than `most` characters cut at boundaries; numbered through the document.

    The cuts of a page follow from the lengths of its lines alone and are found where the page is read; only numbering shuffles.
    """
    df = pages.select(doc, order, content)
    schema = T.StructType([pages.schema[doc], pages.schema[order], T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("boundary", T.StringType()), T.StructField(content, T.StringType())])

    def run(batches):
        for b in pieces(batches):
            index, rows = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                text = text or ""
                parts = None
                if len(text) > most > 0:
                    lines = text.splitlines()
                    boundary, ends = cut_points(lines, len(text), most)
                    if ends:
                        edge = [0, *ends, len(lines)]
                        parts = [s for x, y in zip(edge, edge[1:]) if (s := "\n".join(lines[x:y]).strip())]
                if parts is None:
                    rows.append((0, "page", None, text))
                    index.append(i)
                else:
                    rows += [(k, "chunk", boundary, s) for k, s in enumerate(parts)]
                    index += [i] * len(parts)
            cols = list(zip(*rows)) or [()] * 4
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:])], names=schema.names)

    cut = small_batches(df).mapInArrow(run, schema)
    return cut.select(doc, F.row_number().over(Window.partitionBy(doc).orderBy(order, "part")).alias("chunk_no"), "kind", "boundary", content)


def chunk_tables(chunks: DataFrame, tables: DataFrame, doc: str, content: str = "content") -> DataFrame:
    """tables (doc, table_num, ...) with chunk_no, the chunk that their opening tag stands in, and place, counted from 0 in the order of the text."""
    marks = chunks.select(doc, "chunk_no", F.posexplode(F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"<table\s+([0-9]+)>"), F.lit(1)))).alias("place", "n")).select(doc, "chunk_no", "place", F.col("n").cast("int").alias("table_num"))
    return tables.join(marks, [doc, "table_num"])


def chunk_images(chunks: DataFrame, images: DataFrame, doc: str, content: str = "content") -> DataFrame:
    """images (doc, id, ...) with the number of the chunk that their placeholder stands in."""
    marks = chunks.select(doc, "chunk_no", F.explode(F.array_distinct(F.regexp_extract_all(F.col(content), F.lit(r"<!-- (image_\d+) -->"), F.lit(1)))).alias("id"))
    return images.join(marks, [doc, "id"])
