"""Queries over boxes; an order is a page, its lines have boxes made from their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes
from .base import query, table


def _box(l, t, r, b):
    return F.struct(*(c.cast("double").alias(n) for c, n in ((l, "l"), (t, "t"), (r, "r"), (b, "b"))))


def _cells(spark, sf_dir):
    n = F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return l.select("l_orderkey", n.alias("cell_no"), _box(F.lit(0), n * 20, F.lit(100), n * 20 + 20).alias("box"), F.lit("old").alias("text"))


def _fragments(spark, sf_dir):
    """Beside each line's cell, moved by its quantity; text is the part's number."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("part"))
    n, q = F.col("l_linenumber"), F.col("q")
    top = n * 20 + q / 2 - 6
    return l.select("l_orderkey", n.alias("frag_no"), _box(q, top, q + 30, top + 16).alias("box"), F.col("part").cast("string").alias("text"))


_ASSIGNED = """with c as (select distinct l_orderkey, l_linenumber as cell_no, 0.0 as l, l_linenumber * 20.0 as t, 100.0 as r, l_linenumber * 20.0 + 20 as b from lineitem),
    g as (select l_orderkey, l_linenumber as frag_no, max(l_quantity) as q, max(l_partkey) as part from lineitem group by 1, 2),
    f as (select l_orderkey, frag_no, part::varchar as text, q as l, frag_no * 20 + q / 2 - 6 as t, q + 30 as r, frag_no * 20 + q / 2 - 6 + 16 as b from g),
    o as (select f.l_orderkey, frag_no, cell_no, f.text, f.t as ft, f.l as fl, greatest(0, least(f.r, c.r) - greatest(f.l, c.l)) * greatest(0, least(f.b, c.b) - greatest(f.t, c.t)) / ((f.r - f.l) * (f.b - f.t)) as ratio from f join c using (l_orderkey)),
    m as (select *, max(ratio) over (partition by l_orderkey, frag_no) as best from o where ratio >= 0.3),
    a as (select * from m where best < 0.7 or ratio >= 0.7) """


@query(_ASSIGNED + "select l_orderkey, frag_no, cell_no, round(ratio, 6) as ratio from a")
def overlap_assign(spark, sf_dir):
    """Which cells text fragments belong to."""
    return boxes.assign(_fragments(spark, sf_dir), _cells(spark, sf_dir), "l_orderkey").withColumn("ratio", F.round("ratio", 6))


@query(_ASSIGNED + "select l_orderkey, cell_no, string_agg(text, ' ' order by round_even(ft / 6, 0), fl, frag_no) as text from a group by 1, 2")
def cell_texts(spark, sf_dir):
    """Cells' texts from their fragments, in reading order."""
    return boxes.cell_texts(_fragments(spark, sf_dir), _cells(spark, sf_dir), "l_orderkey")


@query(
    _ASSIGNED
    + """, k as (select l_orderkey, count(*)::bigint as n_cells, min(t) as t0, max(b) as b1 from c group by 1), u as (select l_orderkey, count(distinct cell_no)::bigint as n_filled from a group by 1),
    z as (select l_orderkey, count(*)::bigint as n_fragments, count(*) filter (not exists (select 1 from a where a.l_orderkey = f.l_orderkey and a.frag_no = f.frag_no))::bigint as n_unassigned,
    count(*) filter (not exists (select 1 from a where a.l_orderkey = f.l_orderkey and a.frag_no = f.frag_no) and (least(f.r, 100) - f.l) * greatest(0, least(f.b, b1) - greatest(f.t, t0)) / ((f.r - f.l) * (f.b - f.t)) >= 0.5)::bigint as n_near from f join k using (l_orderkey) group by 1)
    select l_orderkey, n_cells, coalesce(n_filled, 0) as n_filled, coalesce(n_filled, 0) as n_changed, 0::bigint as n_empty, n_fragments, n_unassigned, n_near from k left join u using (l_orderkey) join z using (l_orderkey)"""
)
def refill_stats(spark, sf_dir):
    """What filling cells from fragments changes, and which fragments are left over."""
    return boxes.refill_stats(_fragments(spark, sf_dir), _cells(spark, sf_dir), "l_orderkey")


@query(
    _ASSIGNED + """, p as (select x.l_orderkey, x.frag_no as a_order, y.frag_no as b_order, greatest(0, least(x.r, y.r) - greatest(x.l, y.l)) * greatest(0, least(x.b, y.b) - greatest(x.t, y.t)) as i, 480.0 as s from f x join f y on x.l_orderkey = y.l_orderkey and x.frag_no < y.frag_no)
    select l_orderkey, a_order, b_order, round(i / s, 6) as ratio from p where i > 0 and i / s >= 0.1"""
)
def layout_overlaps(spark, sf_dir):
    """Regions of a page that lie on each other."""
    items = _fragments(spark, sf_dir).withColumnRenamed("frag_no", "item_order")
    return boxes.overlapping_pairs(items, "l_orderkey", 0.1).withColumn("ratio", F.round("ratio", 6))


@query(_ASSIGNED + "select l_orderkey, string_agg(text, chr(10) order by round_even(t / 12, 0), l, frag_no) as text from f group by 1")
def reading_order(spark, sf_dir):
    """Fragments as page text, top to bottom and left to right."""
    return boxes.page_text(_fragments(spark, sf_dir), "l_orderkey")


_GLYPHS = """with o as (select o_custkey as region, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as y from orders), g as (select * from o, (select unnest(range(0, 12)) as i)),
    b as (select region, round_even((y * 18.0 + 5) / 6, 0)::bigint as line, case when i < 6 then i * 6.0 else 100 + i * 6.0 + case when region % 3 = 0 then (o_orderkey % 9) * 20.0 else 0 end end as l, i, y from g where not (region % 5 = 1 and i >= 6 and y % 2 = 0)),
    """


def _glyphs(spark, sf_dir):
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("region"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("y"))
    g = o.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    far = 100 + F.col("i") * 6.0 + F.when(F.col("region") % 3 == 0, (F.col("o_orderkey") % 9) * 20.0).otherwise(0.0)
    g = g.withColumn("l", F.when(F.col("i") < 6, F.col("i") * 6.0).otherwise(far)).where(~((F.col("region") % 5 == 1) & (F.col("i") >= 6) & (F.col("y") % 2 == 0)))
    return g.select("region", "l", (F.col("l") + 5).alias("r"), (F.col("y") * 18.0).alias("t"), (F.col("y") * 18.0 + 10).alias("b"))


@query(
    _GLYPHS
    + """w as (select *, coalesce(l - max(l + 5) over (partition by region, line order by l rows between unbounded preceding and 1 preceding) > 8, true) as new from b),
    c as (select region, line, l as start, row_number() over (partition by region, line order by l) as cell_no from w where new), n as (select region, line, count(*) as cols from c group by 1, 2),
    m as (select region, cols, count(*) as k, min(line) as first from n where cols >= 2 group by 1, 2), d as (select *, sum(k) over (partition by region) as rows, row_number() over (partition by region order by k desc, first) as rn from m),
    s as (select region, max(dev) as drift from (select c.region, c.cell_no, stddev_pop(start) as dev from c join n using (region, line) join d on d.region = c.region and d.rn = 1 and d.cols = n.cols group by 1, 2) group by 1),
    q as (select region, count(*)::bigint as n_chars, count(distinct line)::bigint as n_lines from b group by 1)
    select q.region, case when n_chars < 30 or n_lines < 2 then 'image' when k >= 3 and k / rows >= 0.5 and drift <= 12 then 'table' else 'text' end as kind, n_chars, n_lines,
    case when n_chars < 30 or n_lines < 2 then 0 else coalesce(rows, 0) end::bigint as rows, case when n_chars < 30 or n_lines < 2 then 0 else coalesce(d.cols, 0) end::bigint as mode_cols,
    round(case when n_chars < 30 or n_lines < 2 then 0 else coalesce(k / rows, 0) end, 6) as mode_share, round(case when n_chars < 30 or n_lines < 2 then 0 else coalesce(drift, 0) end, 6) as drift
    from q left join d on d.region = q.region and d.rn = 1 left join s on s.region = q.region"""
)
def region_kinds(spark, sf_dir):
    """Whether regions are tables, text or pictures, by their glyphs."""
    r = boxes.classify_regions(_glyphs(spark, sf_dir), "region")
    return r.withColumn("mode_share", F.round("mode_share", 6)).withColumn("drift", F.round("drift", 6))
