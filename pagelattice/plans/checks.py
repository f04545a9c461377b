"""Queries over gates, units and the joins of page facts; rows of the star schema stand for pages, pictures and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..functions import geometry as G
from ..functions import text as X
from ..operators import blocks, boxes, chunks, previews, reports, verdicts
from .base import query, table


@query("select c_custkey, c_custkey % 3 > 0 as with_tables, c_custkey % 3 > 0 or c_custkey in (1, 3, 6) as listed, true as every from customer")
def render_targets(spark, sf_dir):
    """Pages that are rendered."""
    n, k = F.col("c_custkey") % 3, F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, gates.render_target(n).alias("with_tables"), gates.render_target(n, True, [1, 3, 6], k).alias("listed"), gates.render_target(n, True).alias("every"))


_PICTURE = "p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 5 as chars, l_linenumber as lines, least(1.0, abs(l_quantity * 20 - 10) * abs(l_discount * 5000 - 20) / (595.0 * 842.0)) as ratio, case when l_partkey % 3 = 1 then 'image' when l_partkey % 3 = 2 then 'table' end as kind from lineitem) "


@query(
    "with " + _PICTURE + """select l_orderkey, l_linenumber, l_partkey, l_suppkey, chars >= 80 and lines >= 3 as candidate, round(ratio, 9) as ratio,
    l_linenumber % 2 = 0 and coalesce(kind = 'image', true) and l_suppkey % 5 <> 0 and ratio >= 0.03 as to_read, l_linenumber >= 3 and l_linenumber <> 5 as answered, round_even(ratio, 4) as area_fraction, ratio < 0.05 as skipped, l_linenumber > 2 as described from p"""
)
def picture_gates(spark, sf_dir):
    """Which pictures may be tables, which are read, whose answers count, and what is reported of them."""
    l = table(spark, sf_dir, "lineitem")
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    ratio = gates.area_ratio(F.lit(10.0), F.lit(20.0), q * 20, F.col("l_discount") * 5000)
    kind = F.when(F.col("l_partkey") % 3 == 1, "image").when(F.col("l_partkey") % 3 == 2, "table")
    answer = F.when(n == 5, "내용 없음").otherwise(F.repeat(F.lit("answer "), n))
    said = F.when(n > 2, "text").when(n > 1, " ")
    to_read = gates.should_read_picture(F.when(n % 2 == 1, "known"), kind, F.when(F.col("l_suppkey") % 5 != 0, "p.png"), ratio)
    r = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gates.table_candidate(q * 5, n).alias("candidate"), F.round(ratio, 9).alias("ratio"), to_read.alias("to_read"), gates.picture_answer_ok(answer).alias("answered"), gates.picture_report(ratio, 0.05, said).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "candidate", "ratio", "to_read", "answered", "r.*")


@query(
    """select p_partkey, p_size % 4 = 0 or p_size % 5 >= 2 as noise, p_size % 4 = 0 as noise_unmeasured, p_size % 3 = 0 as bullet, p_size >= 35 and p_size % 4 > 0 as kept,
    p_size % 7 = 0 or p_size % 11 = 0 or p_size % 3 = 2 as to_model, p_partkey > 50 and p_size % 5 >= 2 as spread, p_size % 3 <> 0 as keeps from part"""
)
def part_gates(spark, sf_dir):
    """Recognition noise, lines that are sure enough, bullets, tables for a model, spread boundaries and answers that keep their cells."""
    s, k = F.col("p_size"), F.col("p_partkey")
    text = F.when(s % 4 == 0, " 　").otherwise(F.col("p_name"))
    bullet = F.when(s % 3 == 0, F.concat(F.lit("▪ "), "p_brand")).otherwise(F.regexp_replace("p_name", "[^A-Za-z ]", ""))
    source = F.array(F.concat(F.lit("가나다"), s.cast("string")), F.lit("한글 둘"), F.lit("한글 셋"), F.lit("한글 넷"), F.lit("한글 다섯"), F.lit("b"), F.lit("한"))
    out = F.when(s % 3 == 0, F.slice(source, 1, 3)).when(s % 3 == 1, F.slice(source, 1, 4)).otherwise(source)
    return table(spark, sf_dir, "part").select(
        k,
        gates.ocr_noise(text, (s % 5) / 5).alias("noise"),
        gates.ocr_noise(text).alias("noise_unmeasured"),
        gates.known_bullets(bullet).alias("bullet"),
        gates.ocr_lines_kept(s / 50, text).alias("kept"),
        gates.needs_table_model(s % 7 == 0, s % 11 == 0, s % 3).alias("to_model"),
        gates.spread_enough(k, s % 5, F.lit(100), F.lit(2)).alias("spread"),
        gates.keeps_cells(source, out).alias("keeps"),
    )


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / 2, 6) as point, l_quantity as same, least(l_quantity, 20) as l, least(l_discount, 0.05) as t, greatest(l_quantity, 20) as r, greatest(l_discount, 0.05) as b, round_even(842 - l_quantity, 1) as top, round_even(842 - l_discount, 1) as bottom from lineitem")
def box_units(spark, sf_dir):
    """Pixels to points, four corners to a box, boxes from below as boxes from above."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    quad = G.quad_box(F.array(F.struct(q.alias("x"), d.alias("y")), F.struct(F.lit(20.0).alias("x"), F.lit(0.05).alias("y"))))
    flip = G.top_left(F.lit(0.0), q, F.lit(1.0), d, F.lit(842.0))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(G.from_pixels(q, 2.0), 6).alias("point"), G.from_pixels(q, 0.0).alias("same"), quad.alias("q"), flip.alias("f"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "point", "same", "q.*", F.col("f.t").alias("top"), F.col("f.b").alias("bottom"))


@query("select o_custkey, list_sort(list_distinct(list((o_orderkey % 9)::int) filter (o_orderkey % 9 >= 0))) as failed_pages from (select o_custkey, o_orderkey from orders where o_orderkey % 5 = 0) group by o_custkey")
def failed_pages(spark, sf_dir):
    """The pages of each document that failed."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_custkey", (F.col("o_orderkey") % 9).cast("int").alias("page_no"))
    below = o.withColumn("page_no", F.lit(-1))
    return reports.failed_pages(o.unionByName(below), "o_custkey")


@query(
    """with x as (select doc_id, case when doc_id % 4 = 0 then '' else left(text, (length(text) * (doc_id % 4) // 3)::int) end as p, text from documents),
    n as (select *, length(regexp_replace(coalesce(p, ''), '[^가-힣A-Za-z0-9]', '', 'g')) as a, length(regexp_replace(coalesce(text, ''), '[^가-힣A-Za-z0-9]', '', 'g')) as b from x),
    c as (select doc_id, text, case when b > 0 then least(1.0, a / b) when a > 0 then 1.0 else 0.0 end as coverage from n)
    select doc_id, round(coverage, 9) as coverage, coverage >= 0.8 as usable, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) as n_chars, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''))::int as n_lines from c"""
)
def preview_coverage(spark, sf_dir):
    """Which share of a document its preview covers, whether that will do, and how dense its text is."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    part = F.when(k == 0, "").otherwise(F.substr("text", F.lit(1), F.floor(F.length("text") * k / 3).cast("int")))
    share = reports.preview_coverage(part, F.col("text"))
    chars, lines, _ = gates.text_density(F.col("text"))
    return d.select("doc_id", F.round(share, 9).alias("coverage"), gates.preview_usable(share).alias("usable"), chars.alias("n_chars"), lines.alias("n_lines"))


@query("select c_custkey, not (c_custkey % 3 > 0 and c_custkey % 5 > 0 and c_custkey % 7 >= 1 and c_custkey % 7 <= 4) as needed, c_custkey % 5 = 0 or not (c_custkey % 3 > 0 and c_custkey % 7 >= 1 and c_custkey % 7 <= 4) as unknown from customer")
def ocr_pages(spark, sf_dir):
    """Pages that need recognition: no text, unreadable, beyond the file or not known."""
    k = F.col("c_custkey")
    text = F.when(k % 3 > 0, "enough letters for a text layer").otherwise("12 34")
    pages = lambda readable: gates.pages_needing_ocr(text, readable, k % 7, F.lit(4))
    return table(spark, sf_dir, "customer").select(k, pages(k % 5 > 0).alias("needed"), pages(F.when(k % 5 > 0, True)).alias("unknown"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'a <!-- i --> b' || chr(10) || chr(10) || c_name when c_custkey % 3 = 1 then 'a <!-- i -->' || chr(10) || chr(10) || c_name || ' b <!-- i -->' else 'unchanged' end as content from customer")
def inserted_texts(spark, sf_dir):
    """Text after a placeholder, or at the end."""
    k = F.col("c_custkey")
    body = F.when(k % 3 == 0, "a <!-- i --> b\n").when(k % 3 == 1, "a <!-- i --> b <!-- i -->").otherwise("unchanged")
    return table(spark, sf_dir, "customer").select(k, blocks.insert_after(body, F.when(k % 3 == 0, "<!-- none -->").otherwise("<!-- i -->"), F.when(k % 3 < 2, F.concat(F.lit("\n"), "c_name"))).alias("content"))


def _promoted(spark, sf_dir):
    """Customers as pictures of their nation's page; every fourth is promoted."""
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    k = F.col("c_custkey")
    images = c.select("c_nationkey", F.lit(1).alias("page_no"), F.concat(F.lit("image_"), k.cast("string")).alias("id"), F.concat(F.lit("<!-- image_"), k.cast("string"), F.lit(" -->")).alias("placeholder"), (k % 3 > 0).alias("table_candidate"), F.lit(None).cast("string").alias("promoted_table_id"), F.col("c_name").alias("text"), k)
    v = c.where("c_custkey % 4 = 0").select("c_nationkey", k.alias("seq"), F.concat(F.lit("image_"), k.cast("string")).alias("id"), F.lit("Table").alias("content_type"), F.lit("T").alias("title"), F.lit("r").alias("reason"))
    tables = c.where("c_custkey = 1").select("c_nationkey", F.lit(1).alias("page_no"), F.lit(7).alias("table_num"), F.lit("table_7").alias("id"), F.lit("<table 7>").alias("placeholder"), F.lit("x").alias("markdown"), F.lit("table").alias("content_type"), F.lit("sufficient").alias("quality"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("group_image_ids"), F.lit(None).cast("string").alias("reason"))
    return images, tables, verdicts.promote(images, tables, v, "c_nationkey")


_PROMOTED = "i as (select c_nationkey, c_custkey, c_name, 'image_' || c_custkey::varchar as id, c_custkey % 4 = 0 and c_custkey % 3 > 0 as hit, max(case when c_custkey = 1 then 7 else 0 end) over (partition by c_nationkey) as last from customer where c_nationkey is not null), n as (select *, case when hit then (last + row_number() over (partition by c_nationkey, hit order by c_custkey))::int end as num from i) "


@query("with " + _PROMOTED + "select c_nationkey, 1 as page_no, string_agg('<!-- ' || id || ' -->' || case when hit then chr(10) || chr(10) || '<table ' || num::varchar || '>' || chr(10) || '</table ' || num::varchar || '>' else '' end, chr(10) order by c_custkey) as content from n group by c_nationkey")
def promoted_pages(spark, sf_dir):
    """Pages with the blocks of promoted pictures."""
    images, _, p = _promoted(spark, sf_dir)
    pages = images.groupBy("c_nationkey", "page_no").agg(reports.in_order("c_custkey", "placeholder", "\n").alias("content"))
    return verdicts.promoted_pages(pages, p, images, ["c_nationkey", "page_no"])


@query("with " + _PROMOTED + "select c_nationkey, 'table_' || num::varchar as id, num as table_num, id as source_image_id, '```text' || chr(10) || c_name || chr(10) || '```' as region_text, 'insufficient' as quality from n where hit union all select c_nationkey, 'table_7', 7, null, null, 'sufficient' from i where c_custkey = 1")
def promoted_tables(spark, sf_dir):
    """All tables after promotion, with the text of the regions that pictures were taken from."""
    images, tables, p = _promoted(spark, sf_dir)
    both, _ = verdicts.with_promoted(tables, p, images, ["c_nationkey", "page_no"])
    return verdicts.region_text(both, images, "c_nationkey").select("c_nationkey", "id", "table_num", "source_image_id", "region_text", "quality")


@query("with " + _PROMOTED + "select c_nationkey, id, case when hit then 'table_' || num::varchar end as promoted_table_id from n")
def promoted_images(spark, sf_dir):
    """Pictures with the tables they became."""
    images, tables, p = _promoted(spark, sf_dir)
    return verdicts.with_promoted(tables, p, images, ["c_nationkey", "page_no"])[1].select("c_nationkey", "id", "promoted_table_id")


@query("select c_nationkey, c_custkey as table_num, case when c_custkey <= 20 then '<table>' || (c_custkey - 1)::varchar || '</table>' end as table_html from customer where c_nationkey is not null")
def jobs_with_html(spark, sf_dir):
    """Repairs with the HTML tables at their places."""
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    h = c.where("c_custkey <= 20").select("c_nationkey", (F.col("c_custkey") - 1).alias("position"), F.concat(F.lit("<table>"), (F.col("c_custkey") - 1).cast("string"), F.lit("</table>")).alias("html"))
    return verdicts.with_html(c.select("c_nationkey", F.col("c_custkey").alias("table_num")), h, "c_nationkey")


@query(
    """with c as (select * from customer where c_nationkey is not null), k as (select c_custkey, c_custkey % 6 as m from c)
    select c_custkey, case when m < 4 then m * 40 end as text_chars, case when m < 4 then m end as text_lines, case when m % 2 = 1 then 'table' when m = 2 then 'image' end as region_kind, m = 3 as table_candidate from k"""
)
def picture_candidates(spark, sf_dir):
    """Pictures over dense text whose glyphs don't speak against a table."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null").select(k)
    density = c.where("c_custkey % 6 < 4").select(k, (k % 6 * 40).alias("n_chars"), (k % 6).alias("n_lines"))
    regions = c.where("c_custkey % 6 % 2 = 1 or c_custkey % 6 = 2").select(k, F.when(k % 6 == 2, "image").otherwise("table").alias("kind"))
    return boxes.mark_candidates(c, density, regions, ["c_custkey"])


@query("select c_nationkey, c_custkey, case when c_custkey % 2 = 0 then 'ocr' end as text_source, case when c_custkey % 2 = 0 then 0.5 end as ocr_ratio, case when c_custkey % 3 = 0 then 'a' || c_custkey::varchar || '.png' end as page_image_path from customer")
def page_facts(spark, sf_dir):
    """Pages with their statistics and rendered images."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    stats = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("ocr").alias("text_source"), F.lit(0.5).alias("ocr_ratio"))
    images = c.where("c_custkey % 3 = 0").select("c_custkey", F.explode(F.array(*(F.concat(F.lit(x), F.col("c_custkey").cast("string"), F.lit(".png")) for x in "ba"))).alias("path"))
    return reports.with_page_stats(c, stats, images, ["c_custkey"])


@query(
    """select c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') as extractors, array_to_string(list_sort(list_distinct(list(case when c_custkey % 2 = 0 then 'ocr' else 'text_layer' end))), ',') as text_sources,
    coalesce(string_agg(case when c_custkey % 3 = 0 then 'n' || c_custkey::varchar || ',m' end, ',' order by c_custkey), '') as notes from customer group by c_nationkey"""
)
def used_sources(spark, sf_dir):
    """The extractors and sources of each document, and its notes."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_nationkey", k.alias("page_no"), F.col("c_mktsegment").alias("extractor"), F.when(k % 2 == 0, "ocr").otherwise("text_layer").alias("text_source"), F.when(k % 3 == 0, F.array(F.concat(F.lit("n"), k.cast("string")), F.lit("m"))).alias("notes"))
    return reports.used(c, "c_nationkey").select("c_nationkey", *(F.array_join(x, ",").alias(x) for x in ("extractors", "text_sources", "notes")))


@query(
    """with r as (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_custkey) as k, count(*) over (partition by c_nationkey) as n from customer)
    select c_nationkey, string_agg(c_name, '; ' order by k) filter (k <= 5) || case when max(n) > 5 then ' 외 ' || (max(n) - 5)::varchar || '건' else '' end as text from r group by c_nationkey"""
)
def pending_reasons(spark, sf_dir):
    """The first five reasons of each document and how many more there are."""
    return reports.pending(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name")


@query(
    """with c as (select o_custkey, o_orderpriority as label, count(*) as n, min(o_orderkey) as first from orders group by all), s as (select *, sum(n) over (partition by o_custkey) as total from c)
    select o_custkey, string_agg('- ' || label || ': ' || n::varchar || ' (' || round_even(n * 100.0 / total, 0)::int::varchar || '%)', chr(10) order by n desc, first) as text from s group by o_custkey"""
)
def label_distribution(spark, sf_dir):
    """How often each label comes in a document."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("item_order"), F.lit("kept").alias("outcome"))
    return reports.label_distribution(o, "o_custkey")


def _chunks(spark, sf_dir):
    """Customers' names in chunks by nation and segment; the text names tables, later ones first, and pictures."""
    c = table(spark, sf_dir, "customer").where("c_nationkey is not null")
    mark = F.concat(F.lit("<table "), F.col("c_custkey").cast("string"), F.lit(">x</table><!-- image_"), F.col("c_custkey").cast("string"), F.lit(" -->"))
    text = c.withColumn("m", mark).withColumn("o", -F.col("c_custkey")).groupBy("c_nationkey", (F.col("c_custkey") % 3).alias("chunk_no")).agg(reports.in_order("o", "m", "\n").alias("content"))
    return c, text


@query("select c_nationkey, c_custkey::int as table_num, c_custkey % 3 as chunk_no, (row_number() over (partition by c_nationkey, c_custkey % 3 order by c_custkey desc) - 1)::int as place from customer where c_nationkey is not null")
def chunk_tables(spark, sf_dir):
    """Tables with their chunk and their place in it."""
    c, text = _chunks(spark, sf_dir)
    return chunks.chunk_tables(text, c.select("c_nationkey", F.col("c_custkey").cast("int").alias("table_num")), "c_nationkey")


@query("select c_nationkey, 'image_' || c_custkey::varchar as id, c_custkey % 3 as chunk_no from customer where c_nationkey is not null")
def chunk_images(spark, sf_dir):
    """Pictures with their chunk."""
    c, text = _chunks(spark, sf_dir)
    return chunks.chunk_images(text, c.select("c_nationkey", F.concat(F.lit("image_"), F.col("c_custkey").cast("string")).alias("id")), "c_nationkey")


@query(
    """with x as (select c_custkey, c_custkey % 5 as k, c_name from customer)
    select c_custkey, case k when 0 then 'PDF 추출' when 1 then '한글 문서 추출' when 2 then 'HTML 추출' else '추출' end as stage, case k when 0 then 'device' when 1 then 'download' when 2 then 'other' end as failure,
    case when k < 2 then 'image/png' when k = 2 then 'text/plain' end as media, case when k < 3 then c_name end as body, 'data:image/' || case when k = 0 then 'jpeg' else 'png' end || ';base64,' || to_base64(encode(c_name)) as uri from x"""
)
def labels_and_uris(spark, sf_dir):
    """What stages are called, why models fail, and data URIs read and written."""
    k = F.col("c_custkey") % 5
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k + 1).cast("int"))
    base = F.base64(F.col("c_name").cast("binary"))
    uri = F.when(k == 0, F.concat(F.lit("data:image/png;base64,"), base)).when(k == 1, F.concat(F.lit("data:image/png;name=x;base64,\n"), base)).when(k == 2, F.concat(F.lit("data:;base64,"), base)).when(k == 3, F.lit("data:image/png,plain")).otherwise("data:image/png;base64,a*")
    media, body = X.data_uri(uri)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.stage_label(pick(".pdf", ".hwp", ".html", ".txt", None)).alias("stage"),
        X.failure_kind(pick("CUDA error: out of memory", "could not Download", "broken", None, None)).alias("failure"),
        media.alias("media"),
        body.cast("string").alias("body"),
        X.to_data_uri(F.col("c_name").cast("binary"), pick("a.JPG", "a.png", "a", "b.png", "c.png")).alias("uri"),
    )


@query(
    """with r as (select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as k, count(*) over (partition by c_nationkey) as n, c_custkey, c_name from customer)
    select c_nationkey, (case when k = 1 then 1 when k <= 3 then 2 else k - 1 end)::bigint as block_no, k in (2, 3) as is_table,
    string_agg(case k when 2 then '| ' || c_custkey::varchar || ' | ' || c_name || ' |' || chr(10) || '| --- | --- |' when 3 then '| ' || c_name || ' |  |' else c_name end, chr(10) order by k) as markdown from r group by 1, 2, 3"""
)
def preview_tables(spark, sf_dir):
    """Preview lines of the form <a><b> as tables."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "customer").withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    text = F.when(F.col("k") == 2, F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit("><"), "c_name", F.lit(">"))).when(F.col("k") == 3, F.concat(F.lit("<"), "c_name", F.lit(">"))).otherwise(F.col("c_name"))
    return previews.preview_tables(c.select("c_nationkey", F.col("k").alias("line_no"), text.alias("text")), "c_nationkey")


@query(
    """with r as (select c_nationkey, c_custkey, c_name, c_mktsegment, c_custkey % 2 = 0 as filled from customer)
    select c_nationkey, '| page | id | type | quality | title | reason |' || chr(10) || '| --- | --- | --- | --- | --- | --- |' || chr(10) || string_agg('| 1 | table_' || c_custkey::varchar || ' | table | ' || case when filled then 'wrong' else '-' end || ' | ' || c_mktsegment || ' | a\\|b |', chr(10) order by c_custkey) ||
    coalesce(string_agg(case when filled then chr(10) || chr(10) || '## table_' || c_custkey::varchar || chr(10) || chr(10) || '### before' || chr(10) || chr(10) || 'old' || chr(10) || chr(10) || '### after' || chr(10) || chr(10) || c_name end, '' order by c_custkey), '') as content from r group by c_nationkey"""
)
def tables_report(spark, sf_dir):
    """The report of tables: verdicts, and what repairs changed."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select("c_nationkey", F.lit(1).alias("page_no"), k.alias("table_num"), F.concat(F.lit("table_"), k.cast("string")).alias("id"), F.lit("table").alias("content_type"), F.when(k % 2 == 0, "wrong").alias("quality"), F.col("c_mktsegment").alias("title"), F.lit("a|b").alias("reason"), F.col("c_name").alias("markdown"), F.when(k % 2 == 0, "old").alias("original_markdown"))
    return reports.tables_markdown(t, "c_nationkey")


def _judged(spark, sf_dir):
    """A page of three tables for each customer: the second is text, the first and third are one picture for every other customer."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("page_no"), "c_name")
    b = lambda n, x: blocks.table_block(F.lit(n), x)
    pages = c.select("c_custkey", "page_no", F.concat(F.lit("a\n"), b(1, F.col("c_name")), F.lit("\nb\n"), b(2, F.col("c_name")), F.lit("\nc\n"), b(3, F.lit("z"))).alias("content"))
    one = lambda n, kind, group: F.struct(F.lit(n).alias("table_num"), F.lit(f"table_{n}").alias("id"), kind.alias("content_type"), group.alias("group_image_ids"))
    none = F.lit(None).cast("array<string>")
    picture = F.when(k % 2 == 0, "image").otherwise("table")
    group = F.when(k % 2 == 0, F.array(F.lit("table_1"), F.lit("table_3")))
    t = c.select("c_custkey", "page_no", F.explode(F.array(one(1, picture, group), one(2, F.lit("text"), none), one(3, picture, group))).alias("t")).select("c_custkey", "page_no", "t.*")
    return blocks.apply_verdicts(pages, t, ["c_custkey", "page_no"])


@query(
    """select c_custkey, 1 as page_no, 'a' || chr(10) || case when c_custkey % 2 = 0 then '<!-- img_from_table_1 -->' else '<table 1>' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || '</table 1>' end || chr(10) || 'b' || chr(10) || c_name || chr(10) || 'c' || chr(10) ||
    case when c_custkey % 2 = 0 then '' else '<table 3>' || chr(10) || chr(10) || 'z' || chr(10) || chr(10) || '</table 3>' end as content from customer"""
)
def judged_pages(spark, sf_dir):
    """Pages after verdicts: text without tags, groups as pictures."""
    return _judged(spark, sf_dir)[0]


@query("select c_custkey, 'table' as kind, unnest(['table_1', 'table_3']) as id from customer where c_custkey % 2 = 1 union all select c_custkey, 'image', 'img_from_table_1' from customer where c_custkey % 2 = 0")
def judged_tables(spark, sf_dir):
    """The tables and pictures that are left after verdicts."""
    _, t, i = _judged(spark, sf_dir)
    return t.select("c_custkey", F.lit("table").alias("kind"), "id").unionAll(i.select("c_custkey", F.lit("image"), "id"))
