"""Queries over files; documents and orders are written as files of each format and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, pieces, small_batches, spread
from ..sources import files, html, hwp, office, pdf
from .base import query, table

_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])


def _files(df: DataFrame, make: Callable) -> DataFrame:
    """(path, content) of rows (key, column): make(key, value) is the file."""

    def run(batches):
        for b in pieces(batches):
            keys, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys], pa.string()), pa.array([make(k, v) for k, v in zip(keys, values)], pa.binary())], names=_FILE.names)

    return spread(small_batches(df), df.columns[0]).mapInArrow(run, _FILE)


def _hwp_of_lines(key, text) -> bytes:
    return hwp.document([b"".join(hwp.paragraph(x) for x in (text or "").split("\n"))], packed=key % 2 == 0, PrvText=(text or "").encode("utf-16-le"), PrvImage=b"\x89PNG" + bytes([key % 251]))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text")


_LINES = "l as (select doc_id, trim(x) as x, i from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents where doc_id is not null)) "


@query("with " + _LINES + "select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as block_no, 'paragraph' as kind, x as text from l where x <> ''")
def hwp_blocks(spark, sf_dir):
    """Paragraphs of binary HWP files, packed and plain, made of documents' lines."""
    c = hwp.extract(_files(_documents(spark, sf_dir), _hwp_of_lines)).where("way = 'tree' and ok")
    return c.select(F.col("path").cast("long").alias("doc_id"), "block_no", "kind", F.col("block_text").alias("text"))


@query("with " + _LINES + "select doc_id, string_agg(x, chr(10) order by i) as text from l where x <> '' group by doc_id")
def hwp_raw_text(spark, sf_dir):
    """The characters of the same files without their structure."""
    c = hwp.extract(_files(_documents(spark, sf_dir), _hwp_of_lines)).where("way = 'text' and ok")
    return c.select(F.col("path").cast("long").alias("doc_id"), "text")


_FLAGS = "case when doc_id % 5 = 1 then 'encrypted' when doc_id % 5 = 2 then 'for distribution only' when doc_id % 5 = 3 then 'not a compound file' when doc_id % 5 = 4 then 'no body' end"


@query(f"select doc_id, case when doc_id % 5 = 3 then null else nullif(rtrim(text, chr(0)), '') end as text, case when doc_id % 5 <> 3 then 'png' end as image_kind, case when doc_id % 5 <> 3 then 5 end as image_size, {_FLAGS} as diagnosis from documents where doc_id is not null")
def hwp_previews(spark, sf_dir):
    """Preview streams, and why a body can't be read."""

    def make(key, text):
        kind = key % 5
        streams = {"PrvText": (text or "").encode("utf-16-le"), "PrvImage": b"\x89PNG" + bytes([key % 251])}
        if kind == 3:
            return b"no compound file"
        whole = hwp.document([] if kind == 4 else [hwp.paragraph(text or "")], flags={1: 2, 2: 4}.get(kind, 0), **streams)
        return whole

    p = hwp.previews(_files(_documents(spark, sf_dir), make))
    return p.select(F.col("path").cast("long").alias("doc_id"), "text", "image_kind", F.length("image").alias("image_size"), "diagnosis")


@query(
    """with d as (select doc_id, coalesce(text, '') as text, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) as tree from documents where doc_id is not null)
    select doc_id, case when doc_id % 3 = 1 then case when text <> '' then 'preview' end when length(tree) > 0 then 'tree' when text <> '' then 'preview' end as way,
    case when doc_id % 3 = 1 then nullif(length(text), 0) when length(tree) > 0 then length(tree) else nullif(length(text), 0) end as n_chars,
    case when doc_id % 3 = 1 then 'not a deflate stream' when length(tree) = 0 then 'no text' end as reason from d"""
)
def hwp_cascade(spark, sf_dir):
    """The first way of reading that goes well; every third body is damaged."""

    def make(key, text):
        if key % 3 == 1:
            return hwp.pack({"FileHeader": hwp.SIGNATURE.ljust(36, b"\0") + b"\1\0\0\0" + bytes(216), "BodyText/Section0": b"\xff" * 64, "PrvText": (text or "").encode("utf-16-le")})
        return _hwp_of_lines(key, text)

    b = hwp.best(_files(_documents(spark, sf_dir), make))
    return b.select(F.col("path").cast("long").alias("doc_id"), "way", F.length("text").alias("n_chars"), "reason")


def _nations(spark, sf_dir):
    """(c_nationkey, customers in order)."""
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    return c.groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))


def _hwp_of_rows(key, rows) -> bytes:
    inner = lambda r: hwp.paragraph(r["c_name"], 2) + hwp.record(hwp.PARA_HEADER, 2, bytes(22)) + hwp.table([(0, 0, 1, 1, r["c_mktsegment"])], 1, level=3)
    cells = [(0, 0, 1, 2, f"nation {key}")]
    for k, r in enumerate(rows, 1):
        cells += [(k, 0, 1, 1, str(r["c_custkey"])), (k, 1, 1, 1, inner(r) if k == 1 else r["c_name"])]
    head = hwp.record(hwp.PARA_HEADER, 0, bytes(22))
    return hwp.document([hwp.paragraph("before") + head + hwp.table(cells, 2) + hwp.paragraph("after", 0, 4), hwp.paragraph("second")])


_NATION_ROWS = "r as (select c_nationkey, c_custkey, c_name, c_mktsegment, row_number() over (partition by c_nationkey order by c_custkey) as k from customer where c_nationkey is not null), "
_NATION_TABLE = (
    "t as (select c_nationkey, '| nation ' || c_nationkey::varchar || ' |  |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || c_custkey::varchar || ' | ' || c_name || case when k = 1 then ' [중첩표 1]' else '' end || ' |', chr(10) order by k) || chr(10) || chr(10) || '[중첩표 1]' || chr(10) || chr(10) || '| ' || max(c_mktsegment) filter (k = 1) || ' |' || chr(10) || '| --- |' as md from r group by c_nationkey) "
)


@query("with " + _NATION_ROWS + _NATION_TABLE + "select c_nationkey, 'before' || chr(10) || chr(10) || md || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'after' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'second' as content from t")
def hwp_tables(spark, sf_dir):
    """Binary files with a table, one in its cell, a page break and a second section, as Markdown."""
    c = hwp.extract(_files(_nations(spark, sf_dir), _hwp_of_rows)).where("way = 'tree' and ok").drop("text").withColumnRenamed("block_text", "text")
    return office.to_markdown(c).select(F.col("path").cast("int").alias("c_nationkey"), "content")


def _hwpx_of_rows(key, rows) -> bytes:
    para = lambda s: f'<p:p><p:run charPrIDRef="0"><p:t>{escape(s)}</p:t></p:run></p:p>'
    cell = lambda r, c, across, body: f'<p:tc><p:cellAddr rowAddr="{r}" colAddr="{c}"/><p:cellSpan rowSpan="1" colSpan="{across}"/><p:subList>{body}</p:subList></p:tc>'
    inner = lambda r: para(r["c_name"]) + f'<p:p><p:run><p:tbl colCnt="1"><p:tr>{cell(0, 0, 1, para(r["c_mktsegment"]))}</p:tr></p:tbl></p:run></p:p>'
    lines = "".join(f'<p:tr>{cell(k, 0, 1, para(str(r["c_custkey"])))}{cell(k, 1, 1, inner(r) if k == 1 else para(r["c_name"]))}</p:tr>' for k, r in enumerate(rows, 1))
    first = para("before") + f'<p:p><p:run><p:tbl colCnt="2"><p:tr>{cell(0, 0, 2, para(f"nation {key}"))}</p:tr>{lines}</p:tbl></p:run></p:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("section10", para("second")), ("section2", first)):
            z.writestr(f"Contents/{name}.xml", f'<s xmlns:p="u">{body}</s>')
    return out.getvalue()


@query("with " + _NATION_ROWS + _NATION_TABLE + "select c_nationkey, 'before' || chr(10) || chr(10) || md || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'second' as content from t")
def hwpx_tables(spark, sf_dir):
    """HWPX archives with the same tables; sections go by their numbers."""
    b = office.read_blocks(_files(_nations(spark, sf_dir), _hwpx_of_rows))
    return office.to_markdown(b).select(F.col("path").cast("int").alias("c_nationkey"), "content")


@query("with " + _NATION_ROWS + "t as (select c_nationkey, string_agg('| ' || c_custkey::varchar || ' | ' || c_name || ' |' || case when k = 1 then chr(10) || '| --- | --- |' else '' end, chr(10) order by k) as md from r group by c_nationkey) select c_nationkey, '## 제' || c_nationkey::varchar || '장 총칙' || chr(10) || chr(10) || md || chr(10) || chr(10) || '**제1조(목적)** 이 법' as content from t")
def hwpml_tables(spark, sf_dir):
    """HWPML documents: a chapter, an article and a table in its paragraph."""

    def make(key, rows):
        cells = "".join(f'<ROW><CELL><P><TEXT><CHAR>{r["c_custkey"]}</CHAR></TEXT></P></CELL><CELL><P><TEXT><CHAR>{escape(r["c_name"])}</CHAR></TEXT></P></CELL></ROW>' for r in rows)
        return f"<HWPML><BODY><SECTION><P><TEXT><CHAR>제{key}장 총칙</CHAR></TEXT></P><P><TEXT><CHAR>제1조(목적) 이 법</CHAR><TABLE>{cells}</TABLE></TEXT></P></SECTION></BODY></HWPML>".encode()

    b = office.read_blocks(_files(_nations(spark, sf_dir), make))
    return office.to_markdown(b).select(F.col("path").cast("int").alias("c_nationkey"), "content")


@query("with " + _NATION_ROWS + "g as (select c_nationkey, string_agg(case when k = 1 then c_custkey::varchar || '/' || c_name || '/' || c_mktsegment when k = 2 then '/' || c_name || '/' else c_custkey::varchar || '//' end, ';' order by k) as grid from r group by c_nationkey) select c_nationkey, 'head//;' || grid as grid from g")
def html_tables(spark, sf_dir):
    """Cells of HTML tables at their places: a row of one spanning cell, cells over two rows, rows that are short."""

    def make(key, rows):
        body = ""
        for k, r in enumerate(rows, 1):
            if k == 1:
                body += f'<tr><td rowspan="2">{r["c_custkey"]}</td><td>{escape(r["c_name"])}</td><td rowspan=2>{r["c_mktsegment"]}</td></tr>'
            elif k == 2:
                body += f"<tr><td>{escape(r['c_name'])}</td></tr>"
            else:
                body += f"<tr><td>{r['c_custkey']}</td></tr>"
        return f"<p>x</p><table><tr><th colspan=3>head</th></tr>{body}</table>".encode()

    pages = _files(_nations(spark, sf_dir), make).select(F.col("path").cast("int").alias("c_nationkey"), F.decode("content", "UTF-8").alias("html"))
    b = html.page_blocks(pages).where("kind = 'table'")
    return b.select("c_nationkey", F.array_join(F.transform("cells", lambda r: F.array_join(r, "/")), ";").alias("grid"))


#: Lines of a page of the PDF files, their distance and their size.
_PAGE, _STEP, _SIZE = 50, 14, 10


def _pdf_of_lines(key, text) -> bytes:
    lines = [x.strip() for x in (text or "").split("\n")]
    pages = [lines[i : i + _PAGE] for i in range(0, len(lines), _PAGE)]
    return pdf.write([[(50.0, 20.0 + _STEP * k, float(_SIZE), x) for k, x in enumerate(p) if x] for p in pages], packed=key % 2 == 0, streams=key % 3 == 0)


@query(
    "with " + _LINES + """, p as (select doc_id, ((i - 1) // 50 + 1)::int as page_no, string_agg(x, chr(10) order by i) as s from l group by all)
    select doc_id, page_no, regexp_replace(trim(s, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') as content from p"""
)
def pdf_pages(spark, sf_dir):
    """Pages of PDF files, packed and plain, with and without object streams, made of documents' lines."""
    p = pdf.pages(pdf.fragments(_files(_documents(spark, sf_dir), _pdf_of_lines)))
    return p.select(F.col("path").cast("long").alias("doc_id"), "page_no", "content")


@query("with " + _LINES + "select doc_id, ((i - 1) // 50 + 1)::int as page_no, (row_number() over (partition by doc_id, (i - 1) // 50 order by i) - 1)::int as frag_no, x as text, 50.0::double as l, round(20.0 + 14 * ((i - 1) % 50) - 8, 3)::double as t, round(50 + length(x) * 5.0, 3)::double as r, round(20.0 + 14 * ((i - 1) % 50) + 2, 3)::double as b from l where x <> ''")
def pdf_fragments(spark, sf_dir):
    """Text runs of the same files with their boxes from the top left."""
    f = pdf.fragments(_files(_documents(spark, sf_dir), _pdf_of_lines)).where("text is not null")
    return f.select(F.col("path").cast("long").alias("doc_id"), "page_no", "frag_no", "text", *(F.round(f"box.{k}", 3).alias(k) for k in "ltrb"))


@query("with " + _LINES + "select doc_id, ((i - 1) // 50 + 1)::int as page_no, count(*)::bigint as n_glyphs, min(i % 50)::bigint as least from (select doc_id, i, unnest(string_split(x, '')) as c from l where x <> '' and (i - 1) % 50 < 10) where trim(c) <> '' group by all")
def glyph_regions(spark, sf_dir):
    """Characters that lie wholly in the upper region of their page, counted."""
    f = cut(pdf.fragments(_files(_documents(spark, sf_dir), _pdf_of_lines)), "fragments")
    top = f.where("text is not null").select("path", "page_no").distinct().select("path", "page_no", F.lit("top").alias("region"), F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), F.lit(1e9).alias("r"), F.lit(20.0 + 14 * 9 + 3).alias("b")).alias("box"))
    inside = pdf.glyphs_in_regions(f, top, "region").withColumn("line", F.round((F.col("t") + 8 - 20) / 14).cast("long") + 1)
    return inside.groupBy(F.col("path").cast("long").alias("doc_id"), "page_no").agg(F.count("*").alias("n_glyphs"), F.min(F.col("line") % 50).alias("least"))


@query("select doc_id, case when doc_id % 4 = 3 then null else 'x' || doc_id::varchar end as content, case when doc_id % 4 = 3 then 'BadZipFile: File is not a zip file' end as error from documents where doc_id is not null")
def read_retry(spark, sf_dir):
    """Files under wrong names are read as what their first bytes say; the first error counts if that fails as well."""
    from .. import api  # noqa: F401  registers the readers

    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.lit("").alias("t"))

    def make(key, _):
        body = f"x{key}"
        return (pdf.write([[(50.0, 50.0, 10.0, body)]]), hwp.document([hwp.paragraph(body)]), f"<p>{body}</p>".encode(), b"nothing")[key % 4]

    f = _files(d, make).withColumn("path", F.concat("path", F.element_at(F.array(*map(F.lit, (".hwpx", ".hwpx", ".html", ".hwpx"))), (F.col("path").cast("long") % 4 + 1).cast("int"))))
    return files.read(f).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "content", "error")


@query("select distinct doc_id, 'd' || doc_id::varchar || '.pdf' as path, n_chars as length from documents where doc_id is not null")
def file_list(spark, sf_dir):
    """Files in the order of their paths."""
    f = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.col("n_chars").alias("length")).distinct()
    return files.listed(f).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "path", "length")
