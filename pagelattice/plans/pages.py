"""Queries over web pages, page text and its placeholders, chunks and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import blocks, chunks, outline, reports
from ..session import spread
from ..sources import html
from .base import query, table

_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({x}, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
_PARTS = (
    "with p as (select page_id, "
    + _CLEAN.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")
    + " as h, "
    + _CLEAN.format(x="regexp_extract(html, '(?s)<p>(.*)</article>', 1)")
    + " as body, list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: "
    + _CLEAN.format(x="x")
    + ") as items from pages), b as (select page_id, 0 as block_no, 'list' as kind, array_to_string(list_transform(list_filter(items, lambda x: x <> ''), lambda x: '- ' || x), chr(10)) as t from p"
    " union all select page_id, 1, 'heading', h from p union all select page_id, 2, 'paragraph', body from p) "
)


def _blocks(spark, sf_dir):
    return html.page_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))


@query(_PARTS + "select page_id, block_no, kind, t as text from b")
def page_blocks(spark, sf_dir):
    """Every page's blocks as plain text."""
    return _blocks(spark, sf_dir).select("page_id", "block_no", "kind", html.block_text().alias("text"))


@query(_PARTS + "select page_id, string_agg(t, chr(10) order by block_no) as content from b group by page_id")
def page_text(spark, sf_dir):
    """Every page as plain text."""
    return html.render(_blocks(spark, sf_dir), ["page_id"], "text")


@query()
def page_markdown(spark, sf_dir):
    """Every page as Markdown."""
    return html.render(_blocks(spark, sf_dir), ["page_id"], "markdown")


@query(
    _PARTS
    + """select page_id, count(*)::bigint as n_blocks, count(*) filter (kind = 'heading')::bigint as n_headings, sum(length(t))::bigint as n_chars,
    length(regexp_replace(string_agg(t, ' '), '[^가-힣A-Za-z]', '', 'g')) >= 15 as enough from b group by page_id"""
)
def page_records(spark, sf_dir):
    """The flagship: raw web pages to page records."""
    t = html.block_text()
    b = _blocks(spark, sf_dir).select("page_id", "kind", t.alias("t"))
    letters = F.sum(F.regexp_count("t", F.lit("[가-힣A-Za-z]")))
    return b.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.sum(F.length("t")).alias("n_chars"), (letters >= 15).alias("enough"))


_ROWS = "'| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || c_custkey::varchar || ' | ' || c_mktsegment || ' |'"


def _customers(spark, sf_dir):
    """A document for each nation, a page for each customer, with a table on it and another one on every third."""
    md = F.concat(F.lit("| a | b |\n|---|---|\n| "), F.col("c_custkey").cast("string"), F.lit(" | "), "c_mktsegment", F.lit(" |"))
    more = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\nand\n"), md, F.lit("\n"))).otherwise("")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", F.lit("\n"), md, F.lit("\nend"), more).alias("content"))


_NUMBERED = f"""with c as (select c_nationkey, c_custkey, c_name, {_ROWS} as md, case when c_custkey % 3 = 0 then 2 else 1 end as k from customer),
    n as (select *, coalesce(sum(k) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and 1 preceding), 0)::bigint as b from c) """
_BLOCK = "'<table ' || ({n})::varchar || '>' || chr(10) || chr(10) || {md} || chr(10) || chr(10) || '</table ' || ({n})::varchar || '>'"


@query(_NUMBERED + "select c_nationkey, c_custkey, c_name || chr(10) || " + _BLOCK.format(n="b + 1", md="md") + " || chr(10) || 'end' || case when k = 2 then chr(10) || 'and' || chr(10) || " + _BLOCK.format(n="b + 2", md="md") + " || chr(10) else '' end as content from n")
def inject_tables(spark, sf_dir):
    """Markdown tables in page text numbered through their document."""
    return blocks.inject(_customers(spark, sf_dir), "c_nationkey", "c_custkey")[0]


@query(_NUMBERED + "select c_nationkey, c_custkey, (b + i)::int as table_num, 'table_' || (b + i)::bigint::varchar as id, '<table ' || (b + i)::bigint::varchar || '>' as placeholder, md as markdown from n, (select unnest([1, 2]) as i) where i <= k")
def found_tables(spark, sf_dir):
    """The tables found on the way."""
    return blocks.inject(_customers(spark, sf_dir), "c_nationkey", "c_custkey")[1]


_TWO = "'## ' || c_name || chr(10) || 'intro' || chr(10) || " + _BLOCK.format(n="1", md="c_mktsegment") + " || chr(10) || 'middle' || chr(10) || " + _BLOCK.format(n="2", md="c_name")


def _two(spark, sf_dir):
    """Customers' pages with two blocks, spread, as patterns are what they cost."""
    b = lambda n, c: blocks.table_block(F.lit(n), F.col(c))
    text = F.concat(F.lit("## "), "c_name", F.lit("\nintro\n"), b(1, "c_mktsegment"), F.lit("\nmiddle\n"), b(2, "c_name"))
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name", "c_mktsegment", text.alias("content"))


@query(
    f"""select c_custkey, c_mktsegment as first, c_name as second, '' as third,
    '## ' || c_name || chr(10) || 'intro' || chr(10) || {_BLOCK.format(n="1", md="c_mktsegment")} || chr(10) || 'middle' as context,
    '## ' || c_name || chr(10) || 'intro' || chr(10) || c_mktsegment || chr(10) || 'middle' || chr(10) || {_BLOCK.format(n="2", md="'new'")} as changed from customer"""
)
def block_edits(spark, sf_dir):
    """Blocks read, their surroundings, one unwrapped and another given new content."""
    t = _two(spark, sf_dir)
    c = F.col("content")
    changed = blocks.sync_block(blocks.unwrap_block(c, F.lit(1), F.lit("")), F.lit(2), F.lit("new"))
    return t.select("c_custkey", *(blocks.block_markdown(c, F.lit(n)).alias(a) for n, a in ((1, "first"), (2, "second"), (3, "third"))), blocks.context_slice(c, F.lit(1)).alias("context"), changed.alias("changed"))


@query("select c_custkey, '## ' || c_name || chr(10) || 'intro' || chr(10) || 'TABLE ' || c_custkey::varchar || chr(10) || 'middle' || chr(10) || c_name || ' a picture' as content from customer")
def expand_page(spark, sf_dir):
    """Blocks and pictures put back into page text; a table without Markdown keeps what its block has."""
    t = _two(spark, sf_dir)
    pages = t.select("c_custkey", F.concat("content", F.lit(" <!-- image_1 -->")).alias("content"))
    tables = t.select("c_custkey", F.lit(1).alias("table_num"), F.concat(F.lit("TABLE "), F.col("c_custkey").cast("string")).alias("markdown")).unionAll(t.select("c_custkey", F.lit(2), F.lit(" ")))
    images = t.select("c_custkey", F.lit("<!-- image_1 -->").alias("placeholder"), F.lit("a picture").alias("description"))
    return blocks.expand(pages, tables, images, ["c_custkey"])


@query(
    """with a as (select conv_id, string_agg(case when turn % 3 = 1 then ' ' else coalesce(text, '') end, chr(12) order by turn) as c from conversations group by conv_id),
    b as (select conv_id, unnest(string_split(c, chr(12))) as content, generate_subscripts(string_split(c, chr(12)), 1) as i from a)
    select conv_id, row_number() over (partition by conv_id order by i)::int as page_no, trim(content) as content from b where trim(content) <> ''"""
)
def page_break_split(spark, sf_dir):
    """Documents cut at page breaks, blank pages left out."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, " ").otherwise(F.coalesce("text", F.lit(""))))
    docs = c.groupBy("conv_id").agg(reports.in_order("turn", "text", "\f").alias("content")).withColumn("n", F.lit(1))
    return chunks.split_breaks(docs, "conv_id", "n")


@query()
def document_chunks(spark, sf_dir):
    """Long documents cut into chunks of two thousand characters and more; headings are put before every fourth line."""
    d = table(spark, sf_dir, "documents")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("# "), x)).otherwise(x)), "\n")
    return chunks.chunk(d.select("doc_id", F.lit(1).alias("n"), text.alias("content")), "doc_id", "n", 2000)


_OUTLINE = """with n as (select conv_id, turn, text, role, case when turn % 2 = 0 then ['문서', role, (turn // 4)::varchar] end as p from conversations),
    o as (select conv_id, row_number() over (partition by conv_id order by turn)::int as seq, turn as page_no,
    coalesce(p, last_value(p ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), ['문서']) as path,
    case when p is not null then left(text, 20) else left(trim(text), 200) end as fact from n where p is not null or trim(text) <> '') """


def _outline(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", F.col("turn").alias("page_no"), F.col("text").alias("content"))
    even = c.where("turn % 2 = 0")
    path = F.array(F.lit("문서"), F.col("role"), F.floor(F.col("turn") / 4).cast("string"))
    answers = even.select("conv_id", F.col("turn").alias("page_no"), F.lit(0).alias("node_no"), path.alias("path"), F.substring("text", 1, 20).alias("fact"))
    return outline.outline(pages, answers, "conv_id")


@query(_OUTLINE + "select conv_id, seq, page_no, array_to_string(path, ' > ') as path, fact from o")
def outline_paths(spark, sf_dir):
    """Outline nodes; pages without an answer go on with the path before."""
    return _outline(spark, sf_dir).withColumn("path", F.array_join("path", " > "))


@query(
    _OUTLINE
    + """, q as (select *, lag(path) over (partition by conv_id order by seq) as b from o),
    r as (select *, case when b is null or path[1] is distinct from b[1] then 0 when len(path) < 2 or path[2] is distinct from b[2] then 1 when len(path) < 3 or path[3] is distinct from b[3] then 2 else 3 end as k from q)
    select conv_id, seq, array_to_string(list_concat(list_transform(range(k + 1, len(path) + 1), lambda i: repeat('#', i::int) || ' ' || path[i]), case when trim(fact) <> '' then ['- ' || fact] else [] end), chr(10)) as md from r"""
)
def outline_markdown(spark, sf_dir):
    """Outline nodes as Markdown, headings only where they change."""
    return outline.markdown_lines(_outline(spark, sf_dir), "conv_id")


@query("select doc_id, left(text, 80) as head, length(text) < 50 as warned, case when text is null or trim(text) = '' then true else false end as failed from documents")
def empty_warnings(spark, sf_dir):
    """Documents with hardly any text, and failed ones."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring("text", 1, 80).alias("head"), gates.suspiciously_empty(F.length("text"), F.lit(0)).alias("warned"), gates.blank(F.col("text")).alias("failed"))
