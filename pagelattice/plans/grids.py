"""Queries over table grids; an order is a table, its lines are rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..session import spread
from .base import query, table

_LINES = "l as (select l_orderkey, l_linenumber, max(l_partkey) as part, max(l_quantity)::int as qty, max(l_returnflag) as flag from lineitem group by all), "
_NO = _LINES + "r as (select *, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as row from l) "


def _lines(spark, sf_dir):
    # sent by order once: grouping, numbering and what follows keep to that, and to its sort
    l = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_quantity").cast("int").alias("qty"), F.max("l_returnflag").alias("flag"))
    from pyspark.sql.window import Window

    return l.withColumn("row", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).cast("int"))


def _cells(spark, sf_dir, spans: bool):
    l = _lines(spark, sf_dir)
    down = F.when(F.col("row") % 2 == 0, 2).otherwise(1) if spans else F.lit(1)
    cell = lambda c, blocks, rs: F.struct(F.lit(c).alias("col"), blocks.alias("blocks"), rs.alias("rowspan"))
    first = cell(0, F.array(F.concat(F.lit("**"), "flag", F.lit("**")), F.lit("**x**")), down)
    rest = [cell(1, F.array(F.col("part").cast("string"), F.lit("a|b")), F.lit(1)), cell(2, F.array(F.col("qty").cast("string")), F.lit(1))]
    cells = F.when(F.lit(spans) & (F.col("row") % 2 == 1), F.array(*rest)).otherwise(F.array(first, *rest))
    return l.select("l_orderkey", "row", F.explode(cells).alias("c")).select("l_orderkey", (F.col("row") * 3 + F.col("c.col")).alias("cell_no"), F.lit(3).alias("declared_cols"), "row", "c.col", F.lit(1).alias("colspan"), "c.rowspan", "c.blocks")


_ROW = "'| ' || {first} || ' | ' || part::varchar || ' a\\|b | ' || qty::varchar || ' |'"
_RULE = "chr(10) || '| --- | --- | --- |'"


@query("with " + _NO + f"select l_orderkey, count(*)::int as n_rows, 3 as n_cols, false as truncated, string_agg({_ROW.format(first=chr(39) + '**' + chr(39) + ' || flag || ' + chr(39) + ' x**' + chr(39))} || case when row = 0 then {_RULE} else '' end, chr(10) order by row) as markdown from r group by l_orderkey")
def grid_render(spark, sf_dir):
    """Cells as Markdown tables, bold blocks merged and pipes escaped."""
    return grid.render_grid(_cells(spark, sf_dir, False), "l_orderkey")


@query(
    "with " + _NO + f""", s as (select l_orderkey, row, case when row % 2 = 0 then '**' || flag || ' x**' else '〃' end as first, part, qty from r), n as (select l_orderkey, max(row) as last from r group by l_orderkey),
    t as (select l_orderkey, row, {_ROW.format(first="first")} as line from s union all select l_orderkey, last + 1, '| 〃 |  |  |' from n where last % 2 = 0)
    select l_orderkey, count(*)::int as n_rows, 3 as n_cols, false as truncated, string_agg(line || case when row = 0 then {_RULE} else '' end, chr(10) order by row) as markdown from t group by l_orderkey"""
)
def grid_rowspan_marks(spark, sf_dir):
    """The same with cells that span two rows: the row below has the mark of a merged cell."""
    return grid.render_grid(_cells(spark, sf_dir, True), "l_orderkey")


_PAD = "rpad({c}, greatest(3, {w})::int, ' ')"


@query(
    f"""with {_NO}, x as (select l_orderkey, row, part::varchar as a, qty::varchar as b, flag as c, max(length(part::varchar)) over w as wa, max(length(qty::varchar)) over w as wb, max(length(flag)) over w as wc from r window w as (partition by l_orderkey))
    select l_orderkey, string_agg('| ' || {_PAD.format(c="a", w="wa")} || ' | ' || {_PAD.format(c="b", w="wb")} || ' | ' || {_PAD.format(c="c", w="wc")} || ' |' ||
    case when row = 0 then chr(10) || '|-' || repeat('-', greatest(3, wa)::int) || '-|-' || repeat('-', greatest(3, wb)::int) || '-|-' || repeat('-', greatest(3, wc)::int) || '-|' else '' end, chr(10) order by row) as markdown from x group by l_orderkey"""
)
def grid_padded(spark, sf_dir):
    """Tables with columns as wide as their widest cell."""
    l = _lines(spark, sf_dir)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row", F.array(F.col("part").cast("string"), F.col("qty").cast("string"), "flag").alias("r")))), lambda x: x["r"])
    return l.groupBy("l_orderkey").agg(grid.render_padded(rows).alias("markdown"))


@query("select p_partkey, case when p_size % 2 = 0 then 'name B' || p_size::varchar || ';budget 2023;2024' else 'name;budget;' end as header, case when p_size % 2 = 0 then 2 else 1 end as n_header, case when p_size % 2 = 0 then 2 else 3 end as n_rows from part")
def header_flatten(spark, sf_dir):
    """Two header rows merged into one, where the second looks like one."""
    top = F.array(F.lit("name"), F.lit("budget"), F.lit(""))
    data = F.array(F.lit("value"), F.lit("1"), F.lit("2"))
    even = F.array(F.array(F.lit("name"), F.lit("budget"), F.lit("2024")), F.array(F.concat(F.lit("B"), F.col("p_size").cast("string")), F.lit("2023"), F.lit("")), data)
    odd = F.array(top, F.array(F.concat("p_name", F.lit(" longer than a subheader")), F.lit("2023"), F.lit("2024")), data)
    rows = F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)
    flat = grid.flatten_headers(rows)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.get(flat, F.lit(0)), ";").alias("header"), grid.header_rows(rows).alias("n_header"), F.size(flat).alias("n_rows"))


@query(
    """with l as (select distinct l_orderkey, l_linenumber from lineitem), t as (select l_orderkey, max(l_linenumber) as n_rows, 4 as n_cols from l group by 1),
    s as (select distinct l.l_orderkey, r, c from l join t using (l_orderkey), unnest(range(l_linenumber - 1, l_linenumber + 1)) as u(r), unnest(range(l_linenumber % 2, l_linenumber % 2 + 3)) as v(c) where r < n_rows and c < n_cols),
    k as (select l_orderkey, count(*)::bigint as covered from s group by 1)
    select l_orderkey, (n_rows * 4)::bigint as declared, covered, (n_rows * 4 - covered)::bigint as missing, round_even(covered / (n_rows * 4), 3) as ratio, n_rows * 4 > covered as broken from t join k using (l_orderkey)"""
)
def structure_gap(spark, sf_dir):
    """How much of its declared grid a table's cells cover."""
    l = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").distinct()
    t = l.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_rows")).withColumn("n_cols", F.lit(4))
    n = F.col("l_linenumber")
    return grid.structure_gap(t, l.select("l_orderkey", (n - 1).alias("row0"), (n + 1).alias("row1"), (n % 2).alias("col0"), (n % 2 + 3).alias("col1")), "l_orderkey")


@query(
    "with " + _NO + """select l_orderkey, '[' || string_agg('{"r":' || row::varchar || ',"c":0,"text":"' || flag || '"' || case when row % 2 = 1 then ',"rs":2' else '' end || case when row = 0 then ',"header":true' else '' end || '}', ',' order by row) || ']' as slim from r group by l_orderkey"""
)
def slim_cells(spark, sf_dir):
    """Cells as compact JSON."""
    l = _lines(spark, sf_dir)
    c = l.select("l_orderkey", "row", F.lit(0).alias("col"), F.col("flag").alias("text"), (F.col("row") % 2 + 1).alias("rowspan"), F.lit(1).alias("colspan"), (F.col("row") == 0).alias("is_header"))
    return grid.slim_cells(c, "l_orderkey")


@query(
    """with t as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as page, o_orderkey % 4 + 2 as cols, o_orderkey % 7 + 1 as rows, o_orderkey % 5 = 0 as head1, (o_orderkey % 10) * 100.0 as bottom from orders),
    p as (select *, lag(page) over w as pp, lag(cols) over w as pc, lag(rows) over w as pr, lag(bottom) over w as pb from t window w as (partition by o_custkey order by page, o_orderkey)),
    h as (select *, not coalesce(page = pp + 1 and cols < pc and not head1 and rows <= floor(pr / 2) + 1 and coalesce(pb >= 0.7 * 842.0, true), false) as head from p)
    select o_custkey, o_orderkey, head, last_value(case when head then o_orderkey end ignore nulls) over (partition by o_custkey order by page, o_orderkey) as chain from h"""
)
def table_continuations(spark, sf_dir):
    """Tables that go on on the next page, chained."""
    from pyspark.sql.window import Window

    k = F.col("o_orderkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("table_num"), page.alias("page_no"), (k % 7 + 1).alias("n_rows"), (k % 4 + 2).alias("n_cols"), (k % 5 == 0).alias("first_row_header"), ((k % 10) * 100.0).alias("last_bottom"), F.lit(842.0).alias("page_height"))
    return grid.continuations(t).select(F.col("doc_id").alias("o_custkey"), F.col("table_num").alias("o_orderkey"), "head", "chain")
