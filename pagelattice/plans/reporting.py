"""Queries over traces and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import files
from .base import query, table


@query(
    """with e as (select user_id, case event_type when 'error' then null when 'click' then user_id % 3 = 0 else user_id % 2 = 0 end as ocr from events), a as (select user_id, count(*)::bigint as n_cells, count(ocr) as k, count(*) filter (ocr) as o from e group by user_id)
    select user_id, n_cells, case when k = 0 then 'unmeasured' when o = 0 then 'text_layer' when o = k then 'ocr' else 'mixed' end as text_source, case when k > 0 then round(o / k, 6) end as ocr_ratio from a"""
)
def text_source_stats(spark, sf_dir):
    """Where pages' text comes from, by their cells."""
    ocr = F.when(F.col("event_type") == "error", None).when(F.col("event_type") == "click", F.col("user_id") % 3 == 0).otherwise(F.col("user_id") % 2 == 0)
    return reports.text_sources(table(spark, sf_dir, "events").withColumn("from_ocr", ocr), ["user_id"]).withColumn("ocr_ratio", F.round("ocr_ratio", 6))


@query(
    """with a as (select user_id, event_type as stage, round(sum(value), 4) as seconds from events group by all), b as (select *, sum(seconds) over (partition by user_id) as total, row_number() over (partition by user_id order by seconds desc, stage) = 1 as is_top from a)
    select user_id, stage, seconds, round(seconds / total, 4) as share, round(total, 3) as total, is_top from b"""
)
def timing_shares(spark, sf_dir):
    """Stages' shares of the time."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("seconds"))
    return reports.timing_shares(e, "user_id").withColumn("share", F.round("share", 4)).withColumn("total", F.round("total", 3))


@query(
    """with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, event_type, props from events),
    b as (select *, case event_id % 4 when 0 then ' ' when 1 then '-' when 2 then '!' else 'x' end || ' ' || n::varchar || '. ' || rpad(event_type, 28, ' ') || ' act' || case when event_id % 2 = 0 then ' — ' || props else '' end || case when event_id % 3 = 0 then '  (' || (event_id % 50)::varchar || '.0s)' else '' end as line from a)
    select user_id, string_agg(line, chr(10) order by n) as log from b group by user_id"""
)
def trace_log(spark, sf_dir):
    """Processing steps as log lines."""
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("ok", "skip", "warn", "fail"))), (i % 4 + 1).cast("int"))
    steps = table(spark, sf_dir, "events").select("user_id", i.alias("step_no"), F.col("event_type").alias("module"), F.lit("act").alias("action"), F.when(i % 2 == 0, F.col("props")).alias("detail"), status.alias("status"), F.when(i % 3 == 0, (i % 50) * 1000.0).alias("duration_ms"))
    return reports.trace_log(steps, ["user_id"])


@query(
    """select o_orderkey, concat_ws(' · ', 'x', case o_orderkey % 4 when 0 then '텍스트 레이어' when 1 then 'OCR ' || (o_orderkey % 100)::varchar || '%' when 2 then '추출 실패' end,
    case when o_orderkey % 3 > 0 then '표' || (o_orderkey % 3)::varchar end, case when o_orderkey % 5 > 0 then '그림' || (o_orderkey % 5)::varchar end, case when o_orderkey % 2 = 0 then '렌더' end, case when o_orderkey % 7 = 0 then '재추출2' end, case when o_orderkey % 11 = 0 then '실패' end) as summary from orders"""
)
def page_summaries(spark, sf_dir):
    """A line on how each page came about."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("x").alias("extractor"), F.element_at(F.array(*map(F.lit, ("text_layer", "ocr", "empty", "unmeasured"))), (k % 4 + 1).cast("int")).alias("text_source"), ((k % 100) / 100).alias("ocr_ratio"),
        (k % 3).alias("table_count"), (k % 5).alias("picture_count"), (k % 2 == 0).alias("rendered"), F.lit(False).alias("assessed"), F.when(k % 7 == 0, F.array(F.lit("a"), F.lit("b"))).alias("refilled"), (k % 11 == 0).alias("failed"),
    )
    return o.select("o_orderkey", reports.page_summary().alias("summary"))


@query(
    """with a as (select user_id, case event_type when 'view' then 'text' when 'click' then 'table' when 'error' then 'picture' when 'signup' then 'caption' else 'other' end as label, event_id, case when event_id % 3 = 0 then '버려짐 (빈 내용)' else '본문에 포함' end as o from events),
    b as (select user_id, label, count(*)::bigint as n, min(event_id) as first, array_to_string(list_sort(list_distinct(list(o))), ', ') as outcomes from a group by all)
    select user_id, label, case label when 'text' then '본문' when 'table' then '표' when 'picture' then '그림' when 'caption' then '캡션' else label end as label_ko, n, outcomes, row_number() over (partition by user_id order by n desc, first)::int as rank from b"""
)
def label_counts(spark, sf_dir):
    """Layout labels, commonest first."""
    names = {"view": "text", "click": "table", "error": "picture", "signup": "caption", "purchase": "other"}
    e = table(spark, sf_dir, "events").select("user_id", reports.lookup(F.col("event_type"), names).alias("label"), F.col("event_id").alias("item_order"), F.when(F.col("event_id") % 3 == 0, "dropped").otherwise("text").alias("outcome"))
    return reports.label_counts(e, "user_id")


@query(
    """with p as (select conv_id, count(*)::bigint as n_pages, sum(length(case when turn % 4 = 3 then ' ' else text end))::bigint as n_chars, coalesce(string_agg(case when turn % 4 = 3 or trim(text) = '' then turn::varchar end, ',' order by turn), '') as empty_pages from conversations group by 1),
    t as (select conv_id, count(*)::bigint as n_tables, count(*) filter (turn % 3 = 0)::bigint as n_filled, count(*) filter (role = 'user') as u, count(*) filter (role <> 'user') as a from conversations where turn % 2 = 0 or role <> 'user' group by 1)
    select conv_id, n_pages, n_chars, empty_pages, coalesce(n_tables, 0)::bigint as n_tables, coalesce(n_filled, 0)::bigint as n_filled, concat_ws(', ', case when u > 0 then 'table ' || u::varchar end, case when a > 0 then '미평가 ' || a::varchar end) as by_type, n_pages as n_images from p left join t using (conv_id)"""
)
def document_summaries(spark, sf_dir):
    """Documents' pages, characters, tables and pictures."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", F.col("turn").alias("page_no"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("content"))
    tables = c.where("turn % 2 = 0 or role <> 'user'").select("conv_id", F.when(F.col("role") == "user", "table").alias("content_type"), F.when(F.col("turn") % 3 == 0, "old").alias("original_markdown"), F.lit("new").alias("markdown"))
    return reports.document_summary(pages, tables, c.select("conv_id"), "conv_id")


@query("select o_custkey, count(*)::bigint as total, count(*) filter (o_orderstatus <> 'F')::bigint as succeeded, count(*) filter (o_orderstatus = 'F')::bigint as failed from orders group by 1")
def batch_totals(spark, sf_dir):
    """Batches' documents that went well and that didn't."""
    return reports.batch_totals(table(spark, sf_dir, "orders").withColumn("error", F.when(F.col("o_orderstatus") == "F", "broken")), "o_custkey")


@query("with a as (select count(*) filter (p_size % 3 > 0)::bigint as n_assess, sum(p_size % 3)::bigint as n_fill, sum(p_size % 2)::bigint as n_pictures, count(*)::bigint as n_outline from part) select *, (n_assess + n_fill + n_pictures + n_outline)::bigint as n_calls from a")
def call_estimate(spark, sf_dir):
    """How many calls of a provider a corpus would need."""
    s = F.col("p_size")
    return reports.call_estimate(table(spark, sf_dir, "part").select((s % 3).alias("n_tables"), (s % 3).alias("n_fillable"), (s % 2).alias("n_pictures")), outline=True)


@query("select left(text, 80) as key, count(*)::bigint as n from documents group by 1")
def noise_counts(spark, sf_dir):
    """Messages counted by their first eighty characters."""
    return reports.noise_counts(table(spark, sf_dir, "documents"), "text")


@query(
    """select o_orderkey, case o_orderkey % 4 when 0 then 'hwp' when 1 then 'pdf' when 2 then 'hwpx' end as sniffed, case o_orderkey % 3 when 0 then '.pdf' when 1 then '.hwp' else '.txt' end as by_name,
    case when o_orderkey % 4 = 0 then '.hwp' when o_orderkey % 4 = 1 then '.pdf' else case o_orderkey % 3 when 0 then '.pdf' when 1 then '.hwp' else '.txt' end end as effective from orders"""
)
def signatures(spark, sf_dir):
    """What files are by their first bytes, by their names, and in effect."""
    k = F.col("o_orderkey")
    content = F.when(k % 4 == 0, F.unhex(F.lit("D0CF11E0A1B11AE100"))).when(k % 4 == 1, F.lit("%PDF-1.7").cast("binary")).when(k % 4 == 2, F.unhex(F.lit("504B030414"))).otherwise(F.lit("what").cast("binary"))
    path = F.concat(F.lit("/in/a.b"), F.element_at(F.array(F.lit(".pdf"), F.lit(".HWP"), F.lit(".txt")), (k % 3 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.sniff(content).alias("sniffed"), files.suffix(path).alias("by_name"), files.effective_suffix(path, content).alias("effective"))


@query(
    """select c_custkey, '# ' || c_name || chr(10) || chr(10) || '## 페이지 1' || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '## 문서 전체' || chr(10) || chr(10) || '_(내용 없음)_' || chr(10) as content from customer"""
)
def document_markdown(spark, sf_dir):
    """Documents as one Markdown file each."""
    c = table(spark, sf_dir, "customer")
    one = c.select("c_custkey", "c_name", F.lit(1).alias("page_no"), F.lit("exact").alias("page_no_kind"), F.col("c_mktsegment").alias("content"))
    two = c.select("c_custkey", "c_name", F.lit(2), F.lit("chunk"), F.lit(" "))
    return reports.document_markdown(one.unionAll(two), "c_custkey", "c_name")


@query(
    """select n_nationkey, '{"filename":"' || n_name || '","page_count":1,"pages":[{"page_no":1,"content":"x","tables":[{"id":"table_1","table_num":1,"title":"' || n_name || '","markdown":"m"}],"images":[]}]}' as json from nation"""
)
def slim_documents(spark, sf_dir):
    """Documents as slim JSON."""
    n = table(spark, sf_dir, "nation")
    d = n.select("n_nationkey", F.col("n_name").alias("filename"), F.lit("p").alias("pipeline"))
    pages = n.select("n_nationkey", F.lit(1).alias("page_no"), F.lit("x").alias("content"), F.lit("exact").alias("page_no_kind"))
    tables = n.select("n_nationkey", F.lit(1).alias("page_no"), F.lit("table_1").alias("id"), F.lit(1).alias("table_num"), F.col("n_name").alias("title"), F.lit("m").alias("markdown"))
    images = n.where("false").select("n_nationkey", F.lit(1).alias("page_no"), F.lit("i").alias("id"), F.lit("d").alias("description"), F.lit("t").alias("text"))
    return reports.nested_documents(d, pages, tables, images, "n_nationkey", slim=True)


@query(
    """with a as (select user_id, event_id, ['text', 'table', 'image', 'dropped'][event_id % 4 + 1] as k, props from events) select user_id, string_agg(props, chr(10) || chr(10) order by event_id) as content, count(*) filter (k = 'text')::bigint as n_text, count(*) filter (k = 'table')::bigint as n_tables, count(*) filter (k = 'image')::bigint as n_images from a where k <> 'dropped' group by 1"""
)
def assemble_pages(spark, sf_dir):
    """Pages put together from their parts."""
    e = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("text", "table", "image", "dropped"))), (F.col("event_id") % 4 + 1).cast("int"))
    return reports.assemble_pages(e.select("user_id", F.col("event_id").alias("item_order"), kind.alias("outcome"), F.col("props").alias("md")), ["user_id"])
