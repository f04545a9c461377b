"""Queries over the stages that models answer in, by stubs that are functions of their requests, and over sources that other programs read."""

from __future__ import annotations

import json


from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import blocks, chunks, grid, outline, reports, stages
from ..sources import commands, recognition
from .base import query, table
from .grids import _NO, _lines

_N = "chr(10)"


def _sql(text: str) -> str:
    """A text as a SQL expression."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _rule(*widths: str) -> str:
    return "'|-' || " + " || '-|-' || ".join(f"repeat('-', {w})" for w in widths) + " || '-|'"


def _row(*cells: tuple[str, str]) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"rpad({c}, {w}, ' ')" for c, w in cells) + " || ' |'"


# grids of a layout model


@query(
    f"""with {_NO}, w as (select l_orderkey, greatest(10, max(length(part::varchar)))::int as a, max(row) as last from r group by 1)
    select l_orderkey, 2 as header_rows, {_row(("'order part'", "a"), ("'order qty'", "9"), ("'flag'", "4"))} || {_N} || {_rule("a", "9", "4")} || {_N} ||
    string_agg({_row(("part::varchar", "a"), ("''", "9"), ("flag", "4"))} || case when row % 3 = 2 and row < last then {_N} || {_row(("''", "a"), ("''", "9"), ("''", "4"))} else '' end, {_N} order by row) as markdown
    from r join w using (l_orderkey) group by l_orderkey, a"""
)
def positioned_grid(spark, sf_dir):
    """Tables as a layout model reads them: two header rows, one header over two columns, empty rows amid and at the end, overwritten cells."""
    l = _lines(spark, sf_dir)
    at = F.col("row") + 2 + F.floor(F.col("row") / 3).cast("int")
    cell = lambda r0, r1, c0, c1, span, head, text, n: F.struct(r0.alias("row0"), r1.alias("row1"), F.lit(1).alias("row_span"), F.lit(c0).alias("col0"), F.lit(c1).cast("int").alias("col1"), F.lit(span).alias("col_span"), F.lit(head).alias("column_header"), text.alias("text"), n.alias("cell_no"))
    no = F.lit(None).cast("int")
    n = (F.col("row") + 1) * 10
    data = F.array(cell(at, at + 1, 0, 1, 1, False, F.lit("old"), n), cell(at, no, 0, None, 1, False, F.concat(F.lit(" "), F.col("part").cast("string")), n + 1), cell(at, no, 2, None, 1, False, F.col("flag"), n + 2), cell(at, no, 1, None, 1, False, F.lit("  "), n + 3), cell(at, no, 9, None, 1, False, F.lit("outside"), n + 4))
    head = F.array(cell(F.lit(0), F.lit(1), 0, 2, 1, True, F.lit("order"), F.lit(0)), cell(F.lit(0), no, 0, None, 2, True, F.lit("late"), F.lit(1)), cell(F.lit(0), F.lit(2), 2, 3, 1, True, F.lit("flag"), F.lit(2)), cell(F.lit(1), F.lit(2), 0, 1, 1, True, F.lit("part"), F.lit(3)), cell(F.lit(1), F.lit(2), 1, 2, 1, True, F.lit("qty"), F.lit(4)))
    cells = l.select("l_orderkey", F.explode(data).alias("c")).unionAll(l.where("row = 0").select("l_orderkey", F.explode(head))).select("l_orderkey", "c.*")
    t = l.groupBy("l_orderkey").agg((F.max("row") * 2 + 4).alias("n_rows")).withColumn("n_cols", F.lit(3))
    return grid.draw_positioned(t, cells, "l_orderkey")


@query(
    f"""with {_NO} select l_orderkey, '[' || string_agg('{{"r":' || row::varchar || ',"c":0,"text":"' || flag || '"' || case when row % 2 = 0 then ',"row_header":true' else '' end || ',"page":' || (row + 1)::varchar || '}}', ',' order by row) || ']' as slim from r group by l_orderkey"""
)
def slim_cells_flags(spark, sf_dir):
    """Cells as compact JSON with row headers and pages."""
    c = _lines(spark, sf_dir).select("l_orderkey", "row", F.lit(0).alias("col"), F.col("flag").alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.lit(False).alias("is_header"), (F.col("row") % 2 == 0).alias("row_header"), (F.col("row") + 1).alias("page_no"))
    return grid.slim_cells(c, "l_orderkey")


# stages


def _nations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    k = F.col("c_custkey")
    pages = c.select("c_nationkey").distinct().select("c_nationkey", F.lit(1).alias("page_no"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("content"))
    images = c.select("c_nationkey", F.lit(1).alias("page_no"), F.concat(F.lit("image_"), k.cast("string")).alias("id"), F.col("c_mktsegment").alias("text"), (k % 3 > 0).alias("table_candidate"), F.when(k % 5 == 0, "table_1").alias("promoted_table_id"))
    return pages, pages.where("c_nationkey % 2 = 0").select("c_nationkey", "page_no"), images


@query(
    f"""with c as (select c_nationkey, string_agg('- image_' || c_custkey::varchar || ': ' || c_mktsegment, {_N} order by '- image_' || c_custkey::varchar || ': ' || c_mktsegment) filter (c_custkey % 3 > 0 and c_custkey % 5 > 0) as l from customer where c_nationkey % 2 = 0 group by 1)
    select c_nationkey, {_sql(stages.JUDGE)} || {_N} || {_N} || 'nation ' || c_nationkey::varchar || coalesce({_N} || {_N} || {_sql(stages.PICTURES)} || {_N} || {_N} || l, '') as prompt from c"""
)
def judge_prompts(spark, sf_dir):
    """What a judge is asked of pages with tables."""
    return stages.judge_requests(*_nations(spark, sf_dir)[:2], ["c_nationkey", "page_no"], _nations(spark, sf_dir)[2]).select("c_nationkey", "prompt")


def _reader(requests):
    """What the page's last word is; too little for every seventh."""
    words = [r["prompt"].split()[-1] for r in requests]
    return ["short" if w.endswith("7") else f"```markdown\nshows {w} ({r['images'][0]})\n```" for r, w in zip(requests, words)]


_SHOWN = "'shows ' || c_name || ' (' || c_custkey::varchar || '.png)'"


@query(
    f"""with c as (select c_custkey, c_name, c_custkey % 4 <> 1 and c_custkey % 3 <> 1 and c_name not like '%7' as hit from customer)
    select c_custkey, 'a <!-- i -->' || case when hit then {_N} || {_N} || {_SHOWN} else '' end || ' ' || c_name as content, case when hit then {_SHOWN} end as shown from c"""
)
def picture_texts(spark, sf_dir):
    """Pictures read by a model, their texts after their placeholders; small ones and tables aren't read."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    pages = c.select("c_custkey", F.concat(F.lit("a <!-- i --> "), "c_name").alias("content"))
    images = c.select("c_custkey", F.lit("i").alias("id"), F.lit("<!-- i -->").alias("placeholder"), F.concat(k.cast("string"), F.lit(".png")).alias("image_path"), F.when(k % 3 == 1, "table").when(k % 3 == 2, "image").alias("region_kind"), F.when(k % 4 == 1, 0.01).when(k % 4 == 2, 0.5).alias("ratio"), F.lit(None).cast("string").alias("vlm_markdown"))
    done, read = stages.read_pictures(pages, images, ["c_custkey"], _reader)
    return done.join(read, "c_custkey").select("c_custkey", "content", F.col("vlm_markdown").alias("shown"))


def _rebuilder(requests):
    return [None if "x9" in r["prompt"] else "```\n| a | b |\n|---|---|\n| x | " + r["images"][0] + " |\n```" for r in requests]


_WHOLE = f"'| a | b |' || {_N} || '|---|---|' || {_N} || '| x | p' || c_custkey::varchar || '.png |'"


@query(
    f"""with c as (select c_custkey, c_custkey % 3 = 0 and c_custkey % 2 = 0 and c_custkey % 10 <> 9 as hit, '| a |' || {_N} || '|---|' || {_N} || '| x |' as old from customer)
    select c_custkey, case when hit then {_WHOLE} else old end as markdown, case when hit then old end as original, 'x' || (c_custkey % 10)::varchar || {_N} || '<table 1>' || {_N} || {_N} || case when hit then {_WHOLE} else old end || {_N} || {_N} || '</table 1>' as content from c"""
)
def rebuilt_tables(spark, sf_dir):
    """Tables with cells missing, rebuilt from their pages' pictures."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    old = F.lit("| a |\n|---|\n| x |")
    t = c.select("c_custkey", F.lit(1).alias("page_no"), F.lit(1).alias("table_num"), old.alias("markdown"), F.when(k % 3 == 0, 0.5).otherwise(0.0).alias("structure_ratio"))
    text = F.concat(F.lit("x"), (k % 10).cast("string"), F.lit("\n"), blocks.table_block(F.lit(1), old))
    pages = c.select("c_custkey", F.lit(1).alias("page_no"), text.alias("content"), F.when(k % 2 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(".png"))).alias("page_image_path"))
    t, pages = stages.rebuild(t, pages, ["c_custkey", "page_no"], _rebuilder)
    return t.join(pages, ["c_custkey", "page_no"]).select("c_custkey", "markdown", F.col("original_markdown").alias("original"), "content")


_BLOCK = f"'<table 1>' || {_N} || {_N} || '| a |' || {_N} || {_N} || '</table 1>'"


@query(
    f"""select c_custkey, c_custkey % 2 = 0 and c_custkey % 3 > 0 as reread, case when c_custkey % 2 = 0 and c_custkey % 3 > 0 then c_name || {_N} || c_mktsegment || {_N} || {_N} || {_BLOCK} else '12 ' || {_BLOCK} end as content from customer"""
)
def reread_pages(spark, sf_dir):
    """Pages with the text that was recognised, their tables behind it; those with nothing recognised stay."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    pages = c.select(k.alias("page"), F.concat(F.lit("12 "), blocks.table_block(F.lit(1), F.lit("| a |"))).alias("content"), (k % 2 == 0).alias("wanted"))
    line = lambda n, text, top: F.struct(F.lit(n).alias("frag_no"), text.alias("text"), F.struct(F.lit(0.0).alias("l"), F.lit(top).alias("t"), F.lit(9.0).alias("r"), F.lit(top + 9).alias("b")).alias("box"))
    f = c.where("c_custkey % 3 > 0").select(k.alias("page"), F.explode(F.array(line(0, F.col("c_mktsegment"), 40.0), line(1, F.col("c_name"), 10.0))).alias("f")).select("page", "f.*")
    return stages.reread_pages(pages, f).select(F.col("page").alias("c_custkey"), "reread", "content")


@query(
    f"""with {_NO}, t as (select *, case when qty % 2 = 1 then 'q' || qty::varchar else part::varchar end as x from r), w as (select *, greatest(3, max(length(x)) over (partition by l_orderkey))::int as w, count(*) filter (qty % 2 = 1) over (partition by l_orderkey) as n from t)
    select l_orderkey, n as n_changed, case when n = 0 then 'old' else string_agg({_row(("x", "w"))} || case when row = 0 then {_N} || {_rule("w")} else '' end, {_N} order by row) end as markdown from w group by l_orderkey, n"""
)
def reread_tables(spark, sf_dir):
    """Tables drawn again with the texts that were recognised in their cells."""
    l = _lines(spark, sf_dir)
    box = F.struct(F.lit(0.0).alias("l"), (F.col("row") * 20.0).alias("t"), F.lit(100.0).alias("r"), (F.col("row") * 20.0 + 20).alias("b"))
    no = F.lit(None).cast("int")
    cells = l.select("l_orderkey", F.col("row").alias("cell_no"), F.col("row").alias("row0"), no.alias("row1"), F.lit(1).alias("row_span"), F.lit(0).alias("col0"), no.alias("col1"), F.lit(1).alias("col_span"), F.lit(False).alias("column_header"), F.col("part").cast("string").alias("text"), box.alias("box"))
    f = l.where("qty % 2 = 1").select("l_orderkey", F.col("row").alias("frag_no"), F.concat(F.lit("q"), F.col("qty").cast("string")).alias("text"), box.alias("box"))
    t = l.groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_rows")).select("l_orderkey", "n_rows", F.lit(1).alias("n_cols"), F.lit("old").alias("markdown"))
    return stages.reread_tables(t, cells, f, "l_orderkey").select("l_orderkey", "n_changed", "markdown")


def _outliner(requests):
    size = [len(r["prompt"]) for r in requests]
    return [None if n % 3 == 0 else f'```json\n[{{"path": ["A", " b "], "fact": "{n}"}}, {{"path": ["C"]}}]\n```' if n % 3 == 1 else "no list" for n in size]


@query(
    f"""with p as (select c_nationkey, c_custkey, c_name, {len(stages.NODES)} + 4 + coalesce(length(lag(c_name) over w), 0) + length(c_name) as n from customer where c_nationkey is not null window w as (partition by c_nationkey order by c_custkey)),
    a as (select *, n % 3 = 1 as hit from p), b as (select *, max(case when hit then c_custkey end) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding) as last from a)
    select c_nationkey, c_custkey, k as node, case when hit then case k when 0 then 'A/b' else 'C' end when last is null then '문서' else 'C' end as path, case when hit then case k when 0 then n::varchar else '' end else c_name end as fact from b, (values (0), (1)) as v(k) where hit or k = 0"""
)
def outline_nodes(spark, sf_dir):
    """Facts under headings, page by page; pages without a usable answer go under the last heading."""
    pages = table(spark, sf_dir, "customer").where("c_nationkey is not null").select("c_nationkey", F.col("c_custkey").alias("page_no"), F.col("c_name").alias("content"))
    n = outline.outline(pages, stages.outline_answers(pages, "c_nationkey", _outliner), "c_nationkey")
    from pyspark.sql.window import Window

    node = F.row_number().over(Window.partitionBy("c_nationkey", "page_no").orderBy("seq")) - 1
    return n.select("c_nationkey", F.col("page_no").alias("c_custkey"), node.alias("node"), F.array_join("path", "/").alias("path"), "fact")


def _drawer(requests):
    out = []
    for r in requests:
        texts = [c["text"] for part in r["prompt"].split("\n\n")[-1].split("\n") for c in json.loads(part)]
        out.append("| x |\n|---|" if any(t.startswith("가나") and int(t[2:]) % 3 == 0 for t in texts) else "| " + " | ".join(texts) + " |\n|---|")
    return out


@query(
    f"""with t as (select c_custkey, n, c_custkey % 2 = 0 as several, c_custkey % 3 > 0 as good from customer, (values (1), (2)) as v(n))
    select c_custkey, n as table_num, case when several and good then '| 가나' || c_custkey::varchar || ' | 다라1 | 가나' || c_custkey::varchar || ' | 다라2 |' || {_N} || '|---|' else 'cells' end as markdown, case when several and good then 'model' else 'cells' end as way from t where n = 1 or not (several and good)"""
)
def model_tables(spark, sf_dir):
    """Tables over two pages put together by a model; an answer that loses cells doesn't count."""
    k = F.col("c_custkey")
    both = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("table_num"))
    t = both.select("c_custkey", "table_num", F.when(k % 2 == 0, 1).otherwise(F.col("table_num")).alias("chain"), F.lit("cells").alias("markdown"))
    cell = lambda n, text: F.struct(F.lit(n).alias("cell_no"), F.lit(0).alias("row0"), F.lit(n).alias("col0"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(False).alias("column_header"), text.alias("text"))
    cells = both.select("c_custkey", "table_num", F.explode(F.array(cell(0, F.concat(F.lit("가나"), k.cast("string"))), cell(1, F.concat(F.lit("다라"), F.col("table_num").cast("string"))))).alias("c")).select("c_custkey", "table_num", "c.*")
    return stages.model_tables(t, cells, "c_custkey", _drawer)


# sources


def _recogniser(pictures):
    """The picture's text, a line each ten pixels; every third length isn't sure."""
    return [[(x, 0.5 if len(x) % 3 == 0 else 0.9, [(0.0, 20.0 * k), (2.0 * len(x), 20.0 * k + 20)] if k % 4 else None) for k, x in enumerate(p.decode().split("\n"))] for p in pictures]


@query(
    """with l as (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where doc_id is not null and text is not null)
    select doc_id, i::int as frag_no, x as text, case when i % 4 > 0 then i * 10.0::double end as t, case when i % 4 > 0 then length(x)::double end as r from l where length(x) % 3 > 0 and trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)) <> ''"""
)
def recognised_lines(spark, sf_dir):
    """Lines of pictures by a recogniser, in points; unsure and blank ones are left out."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("image"))
    return recognition.lines(d, _recogniser, scale=2.0).select("doc_id", "frag_no", "text", "box.t", "box.r")


@query(
    """select doc_id, nullif(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '') as text, case when text is null then 'no content' when text = '' then 'no output' end as error from documents where doc_id is not null"""
)
def converted_files(spark, sf_dir):
    """Documents through a command of the system."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return commands.run(d, ["tr", "a-z", "A-Z"]).select(F.col("path").cast("long").alias("doc_id"), F.decode("output", "UTF-8").alias("text"), "error")


@query(
    """with c as (select c_custkey, c_custkey % 25 as cells, least(c_custkey % 25, c_custkey % 7) as filled from customer)
    select c_custkey, case when cells >= 10 and filled <= greatest(3, cells // 6) then 'most cells are empty' end as reason, case when not (cells >= 10 and filled <= greatest(3, cells // 6)) then 17 + filled * 10 + (cells - filled) * 16 end as size from c"""
)
def html_conversions(spark, sf_dir):
    """Conversions to HTML, and why they don't count."""
    k = F.col("c_custkey")
    filled = F.least(k % 25, k % 7).cast("int")
    body = F.concat(F.lit("<table>x</table>\n"), F.repeat(F.lit("<td>y</td>"), filled), F.repeat(F.lit("<td><b></b></td>"), (k % 25).cast("int") - filled))
    f = table(spark, sf_dir, "customer").select(k.cast("string").alias("path"), body.cast("binary").alias("content"))
    return commands.html_candidates(f, ["cat"]).select(F.col("path").cast("long").alias("c_custkey"), "reason", F.length("html").alias("size"))


@query(
    """with r as (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey desc) as k from customer where c_custkey % 3 > 0)
    select c_nationkey, string_agg(c_name, ';' order by k desc) as lines from r where k <= 12 group by c_nationkey"""
)
def error_lines(spark, sf_dir):
    """The last lines of what a command said, without its standing warnings."""
    c = table(spark, sf_dir, "customer")
    line = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Undefined UnderlineStyle "), "c_name")).otherwise(F.col("c_name"))
    said = c.withColumn("line", F.concat(line, F.lit("\n "))).groupBy("c_nationkey").agg(reports.in_order("c_custkey", "line", "\r\n").alias("said"), F.max(F.col("c_custkey") % 3).alias("some"))
    return said.where("some > 0").select("c_nationkey", F.array_join(commands.error_lines(F.col("said")), ";").alias("lines"))


# page breaks and reports


@query(
    """with r as (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer)
    select c_nationkey, (2 * n - 1 + k)::int as page_no, case k when 0 then c_name else c_mktsegment end as content, c_custkey as trace, case when k = 0 then c_custkey::varchar || '.png' end as preview from r, (values (0), (1)) as v(k)"""
)
def break_traces(spark, sf_dir):
    """Pages cut at breaks: each part has its page's trace, the first its preview picture."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", k, F.concat(F.lit("\f "), "c_name", F.lit("\f\f\n"), "c_mktsegment", F.lit(" \f")).alias("content"), k.alias("trace"), F.concat(k.cast("string"), F.lit(".png")).alias("preview"))
    return chunks.split_breaks(c, "c_nationkey", "c_custkey", shared=("trace",), first=("preview",))


_HEAD = "'| 페이지 | 추출기 | 출처 | 셀 | 표 | 그림 | 렌더 | 평가 | 재추출 |' || chr(10) || '| --- | --- | --- | --- | --- | --- | --- | --- | --- |' || chr(10)"


@query(
    f"""with p as (select c_nationkey, string_agg('| ' || c_custkey::varchar || ' | pdf | ' || case when c_custkey % 2 = 0 then 'OCR' else '텍스트 레이어' end || ' | ' || case when c_custkey % 3 = 0 then '-' else '4' end || ' | 1 | 2 | ' || case when c_custkey % 2 = 0 then 'O' else '-' end || ' | - | ' || case when c_custkey % 5 = 0 then '2' else '-' end || ' |', {_N} order by c_custkey) as rows,
    coalesce(string_agg(case when c_custkey % 4 = 0 then {_N} || '- p.' || c_custkey::varchar || ': n' end, '' order by c_custkey), '') as notes, max(c_custkey % 2) as odd, min(c_custkey % 2) as even from customer where c_nationkey is not null group by 1)
    select c_nationkey, '# 처리 이력' || {_N} || {_N} || '## 설정' || {_N} || {_N} || '| 항목 | 값 |' || {_N} || '| --- | --- |' || {_N} || '| `a` | ' || c_nationkey::varchar || ' |' || {_N} || '| `b` | - |' || {_N} || {_N} ||
    '## 소요 시간 (총 4.0초)' || {_N} || {_N} || '| 단계 | 초 | 비중 | GPU |' || {_N} || '| --- | --- | --- | --- |' || {_N} || '| PDF 추출 | 3.0 | 75% | O |' || {_N} || '| fill | 1.0 | 25% | X |' || {_N} || {_N} ||
    '## 페이지' || {_N} || {_N} || {_HEAD} || rows || {_N} || {_N} || case when c_nationkey % 2 = 0 then '## 특이사항' || {_N} || {_N} || '- 빠진 페이지: 3, 7' || notes || {_N} || {_N} when notes <> '' then '## 특이사항' || {_N} || notes || {_N} || {_N} else '' end ||
    '## 로그' || {_N} || {_N} || '### 페이지 1' || {_N} || {_N} || '```' || {_N} || 'log' || {_N} || '```' || {_N} || {_N} || {_N} || '## 설명' || {_N} || {_N} || '- **pdf** — {reports.EXTRACTORS["pdf"]}' || case when even = 0 then {_N} || '- **OCR** — {reports.SOURCE_TEXTS["ocr"]}' else '' end || case when odd = 1 then {_N} || '- **텍스트 레이어** — {reports.SOURCE_TEXTS["text_layer"]}' else '' end || {_N} as content from p"""
)
def pipeline_report(spark, sf_dir):
    """The report on how documents were processed."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    docs = c.select("c_nationkey").distinct()
    failed = docs.select("c_nationkey", F.when(n % 2 == 0, F.array(F.lit(3), F.lit(7))).alias("failed_pages"))
    settings = docs.select("c_nationkey", F.explode(F.array(F.struct(F.lit("b").alias("name"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("a").alias("name"), n.cast("string").alias("value")))).alias("s")).select("c_nationkey", "s.*")
    timings = docs.select("c_nationkey", F.explode(F.array(F.struct(F.lit("fill").alias("stage"), F.lit(1.0).alias("seconds")), F.struct(F.lit("PDF 추출").alias("stage"), F.lit(3.0).alias("seconds")))).alias("s")).select("c_nationkey", "s.*")
    pages = c.select("c_nationkey", k.alias("page_no"), F.lit("pdf").alias("extractor"), F.when(k % 2 == 0, "ocr").otherwise("text_layer").alias("text_source"), F.lit(None).cast("double").alias("ocr_ratio"), F.when(k % 3 > 0, 4).alias("cell_count"), F.lit(1).alias("table_count"), F.lit(2).alias("picture_count"), (k % 2 == 0).alias("rendered"), F.lit(False).alias("assessed"), F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("y"))).alias("refilled"), F.when(k % 4 == 0, F.array(F.lit("n"))).alias("notes"))
    logs = docs.select("c_nationkey", F.lit(1).alias("page_no"), F.lit("log").alias("log"))
    return reports.pipeline_report(failed, settings, timings, pages, logs, "c_nationkey")


@query(
    f"""select c_custkey, '# 레이아웃' || {_N} || {_N} || '## 라벨' || {_N} || {_N} || '| 라벨 | 개수 | 처리 |' || {_N} || '| --- | --- | --- |' || {_N} || '| 본문 (`text`) | 2 | 버려짐 (빈 내용), 본문에 포함 |' || {_N} || '| 표 (`table`) | 1 | 표로 변환 |' || {_N} || {_N} || '버려진 영역 1개' || {_N} || {_N} ||
    '### 페이지 1' || {_N} || {_N} || '| # | 라벨 | 좌표 | 글자수 | 처리 | 산출물 | 내용 |' || {_N} || '| --- | --- | --- | --- | --- | --- | --- |' || {_N} || '| 1 | 본문 | - | ' || (length(c_name) + 1)::varchar || ' | 본문에 포함 | - | ' || c_name || '\\| |' || {_N} ||
    '| 2 | 표 | 1,2,' || (c_custkey % 100)::varchar || ',4 | 0 | 표로 변환 | table_1 |  |' || {_N} || '| 3 | 본문 | - | 0 | 버려짐 (빈 내용) | - |  |' || {_N} || {_N} || '- #1 본문 ↔ #2 표 (겹침 50%)' || {_N} as content from customer"""
)
def layout_report(spark, sf_dir):
    """The report on what a layout model found."""
    k = F.col("c_custkey")
    box = F.struct(F.lit(1.2).alias("l"), F.lit(2.4).alias("t"), (k % 100).cast("double").alias("r"), F.lit(4.1).alias("b"))
    none = F.lit(None).cast(T.StructType([T.StructField(x, T.DoubleType()) for x in "ltrb"]))
    one = lambda n, label, outcome, ref, text, b: F.struct(F.lit(n).alias("item_order"), F.lit(label).alias("label"), F.lit(outcome).alias("outcome"), F.lit(ref).cast("string").alias("ref"), text.alias("text"), b.alias("box"))
    c = table(spark, sf_dir, "customer")
    items = c.select("c_custkey", F.lit(1).alias("page_no"), F.explode(F.array(one(1, "text", "text", None, F.concat("c_name", F.lit("|")), none), one(2, "table", "table", "table_1", F.lit(""), box), one(3, "text", "dropped", None, F.lit(None).cast("string"), none))).alias("i")).select("c_custkey", "page_no", "i.*")
    pairs = c.select("c_custkey", F.lit(1).alias("page_no"), F.lit(1).alias("a_order"), F.lit(2).alias("b_order"), F.lit(0.5).alias("ratio"))
    return reports.layout_report(items, pairs, "c_custkey")
