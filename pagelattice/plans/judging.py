"""Queries over verdicts; a document's lines are tables, labels judge them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates
from ..operators import blocks, verdicts
from .base import query, table


def _tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    return c.select(F.col("c_nationkey").alias("doc"), n.cast("int").alias("table_num"), F.concat(F.lit("table_"), n.cast("string")).alias("id"), F.col("c_name").alias("markdown"), F.when(n % 4 == 0, F.lit("<table></table>")).alias("table_html"))


def _verdicts(spark, sf_dir):
    """Two verdicts on every third table, one on every second, some on tables that don't exist."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    v = c.where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(
        F.col("c_nationkey").alias("doc"),
        n.alias("seq"),
        F.concat(F.lit("table_"), (n + F.when(n % 10 == 0, 1_000_000).otherwise(0)).cast("string")).alias("id"),
        F.element_at(F.array(*map(F.lit, ("table", " Text ", "image", "chart"))), (n % 4 + 1).cast("int")).alias("content_type"),
        F.element_at(F.array(*map(F.lit, ("wrong", "Insufficient", "fine"))), (n % 3 + 1).cast("int")).alias("quality"),
        F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("title"),
        F.when(n % 4 == 2, F.array(F.concat(F.lit("table_"), n.cast("string")), F.lit("table_2"))).alias("group_image_ids"),
        F.lit("why ").alias("reason"),
    )
    again = v.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000).withColumn("content_type", F.lit("table"))
    return v.unionByName(again)


_V = """with v as (select c_nationkey as doc, c_custkey as n, c_custkey + case when c_custkey % 10 = 0 then 1000000 else 0 end as t, case when c_custkey % 3 = 0 then 'table' else ['table', 'text', 'image', 'chart'][c_custkey % 4 + 1] end as kind,
    ['wrong', 'insufficient', 'fine'][c_custkey % 3 + 1] as q, case when c_custkey % 5 = 0 then null else c_mktsegment end as title, c_custkey % 4 = 2 as grouped from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0),
    m as (select c_nationkey as doc, c_custkey as table_num, 'table_' || c_custkey::varchar as id, c_name as markdown, case when c_custkey % 4 = 0 then '<table></table>' end as table_html, v.* exclude (doc, n, t), coalesce(kind in ('table', 'text', 'image'), false) as known from customer left join v on v.t = c_custkey),
    r as (select doc, table_num, id, markdown, table_html, case when known then kind else 'table' end as content_type, case when not known then 'sufficient' when kind = 'table' then case when q in ('wrong', 'insufficient') then q else 'insufficient' end end as quality,
    case when known then title end as title, case when known and grouped then [id, 'table_2'] end as ids, case when known then 'why' end as reason from m) """


@query(_V + "select doc, id, content_type, quality, title, array_to_string(ids, ',') as group_ids, reason from r")
def verdict_merge(spark, sf_dir):
    """Tables with what was judged of them, defaults where nothing was."""
    m = verdicts.merge(_tables(spark, sf_dir), _verdicts(spark, sf_dir), "doc")
    return m.select("doc", "id", "content_type", "quality", "title", F.array_join("group_image_ids", ",").alias("group_ids"), "reason")


@query(_V + "select distinct doc, 'table_' || t::varchar as id from v where t >= 1000000")
def unknown_verdicts(spark, sf_dir):
    """Verdicts on tables that don't exist."""
    return verdicts.unknown(_tables(spark, sf_dir), _verdicts(spark, sf_dir), "doc")


@query(_V + "select doc, id, case when table_num % 2 = 0 then 'image' when table_html is not null then 'html' else 'none' end as evidence from r where content_type = 'table' and quality in ('wrong', 'insufficient')")
def fill_jobs(spark, sf_dir):
    """The repairs to be made, with the best evidence there is."""
    m = verdicts.merge(_tables(spark, sf_dir), _verdicts(spark, sf_dir), "doc")
    pages = m.select("doc", "table_num", F.when(F.col("table_num") % 2 == 0, "page.png").alias("page_image_path"))
    return verdicts.fill_jobs(m, pages, ["doc", "table_num"]).select("doc", "id", "evidence")


@query(
    _V + """, k as (select doc, list(id) as known from r group by doc), g as (select distinct r.doc, array_to_string(list_sort(coalesce(ids, [r.id])), ',') as group_key, coalesce(ids, [r.id]) as ids, known from r join k using (doc) where content_type = 'image')
    select doc, group_key, ids[1] as first_id, array_to_string(list_filter(ids, lambda x: list_contains(known, x)), ',') as members, '<!-- img_from_' || ids[1] || ' -->' as placeholder from g where list_contains(known, ids[1])"""
)
def image_groups(spark, sf_dir):
    """Tables that are parts of one picture."""
    return blocks.image_groups(verdicts.merge(_tables(spark, sf_dir), _verdicts(spark, sf_dir), "doc"), "doc")


@query(
    """with i as (select n_regionkey as doc, n_nationkey as n from nation where n_nationkey % 3 <> 1 and n_nationkey % 5 <> 2), v as (select doc, n, row_number() over (partition by doc order by n) as k from i where n % 2 = 0)
    select doc, 'image_' || n::varchar as image_id, (100 + doc + k)::int as table_num, 'table_' || (100 + doc + k)::varchar as id, 'NATION_' || n::varchar as title, null::varchar as reason from v"""
)
def promote_images(spark, sf_dir):
    """Pictures that turn out to be tables, numbered after the document's last."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    image = F.concat(F.lit("image_"), k.cast("string"))
    images = n.select(F.col("n_regionkey").alias("doc"), image.alias("id"), (k % 3 != 1).alias("table_candidate"), F.when(k % 5 == 2, "table_1").alias("promoted_table_id"))
    v = n.select(F.col("n_regionkey").alias("doc"), k.alias("seq"), image.alias("id"), F.when(k % 2 == 0, " TABLE ").otherwise("image").alias("content_type"), F.col("n_name").alias("title"), F.lit(" ").alias("reason"))
    tables = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), (F.col("r_regionkey") + 100).alias("table_num"))
    return verdicts.promote(images, tables, v, "doc")


@query(
    """with a as (select p_partkey, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_size::varchar || ' |' as good, p_size % 4 as k from part)
    select p_partkey, k in (0, 3) as accepted, case k when 0 then good when 3 then left(good, 21) else 'old ' || repeat('x', 30) end as markdown, case when k in (0, 3) then 'old ' || repeat('x', 30) end as original_markdown from a"""
)
def rebuild_accept(spark, sf_dir):
    """Rebuilt tables taken if they are tables and long enough."""
    p = table(spark, sf_dir, "part")
    good = F.concat(F.lit("| a | b |\n|---|---|\n| "), "p_name", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    k = F.col("p_size") % 4
    answer = F.when(k == 0, F.concat(F.lit("```markdown\n"), good, F.lit("\n```"))).when(k == 1, "sorry").when(k == 3, F.substring(good, 1, 21))
    tables = p.select("p_partkey", F.concat(F.lit("old "), F.repeat(F.lit("x"), F.lit(30))).alias("markdown"))
    return verdicts.accept(tables, p.select("p_partkey", answer.alias("answer")), "p_partkey")


@query(
    """select s_suppkey, case s_suppkey % 5 when 0 then 'table_1:table:' || s_name when 1 then 'table_2:text:-' when 2 then '' when 3 then 'table_3:image:x' else 'a:table:-;b:text:-' end as verdicts from supplier"""
)
def tolerant_replies(spark, sf_dir):
    """Judges' replies in several shapes as verdicts."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 5
    reply = (
        F.when(k == 0, F.concat(F.lit('[{"id": "table_1", "content_type": "table", "title": "'), "s_name", F.lit('"}, "noise"]')))
        .when(k == 1, '```json\n{"table_2": {"content_type": "text"}, "n": 3}\n```')
        .when(k == 2, "I can't say.")
        .when(k == 3, 'Here: [{"id": "table_3", "content_type": "image", "title": "x"}] as asked')
        .otherwise('{"a": {"content_type": "table"}, "b": {"content_type": "text"}}')
    )
    out = F.transform(verdicts.parse_reply(reply), lambda v: F.concat_ws(":", v["id"], v["content_type"], F.coalesce(v["title"], F.lit("-"))))
    return s.select("s_suppkey", F.array_join(out, ";").alias("verdicts"))


@query("select doc_id, quality = 0 and toxic = 0 as repair, toxic = 1 as promoted from labels")
def repair_gate(spark, sf_dir):
    """Which labelled documents count as repairs."""
    l = table(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 0, "table").otherwise("image")
    return l.select("doc_id", gates.needs_fill(kind, F.when(F.col("quality") == 0, "wrong").otherwise("sufficient")).alias("repair"), (F.col("toxic") == 1).alias("promoted"))
