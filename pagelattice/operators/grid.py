"""Table grids: cells to arrays of rows, arrays to Markdown, header merging, structure gaps, tables that span pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

MERGED = "〃"
#: Rows or columns in a row without the beginning or end of a cell that are taken for damage.
FAR = 1 << 14


def render_grid(cells: DataFrame, key: str, marks: bool = True) -> DataFrame:
    """(key, n_rows, n_cols, markdown, truncated) of cells (key, cell_no, declared_cols, row, col, rowspan, colspan, blocks ARRAY<STRING>).

    One shuffle, by table, and one aggregation: a table's cells become one array, in which it is drawn; only what cells hold is sent, blank slots
    are drawn. A table has as many rows as its cells reach, and as many columns as they reach or as it declares. A spanning cell's text stands at its top left;
    the rows below it have the mark of a merged cell in its first column. A later cell overwrites an earlier one. Empty rows at the top
    go while others are left.

    Defined cases: null keys are one table; null blocks and spans are empty and single; cells that are written twice count once; a cell
    whose address is null or negative isn't drawn, and its table is `truncated`; FAR rows or columns and more in which no cell begins or
    ends are drawn as one, so a damaged address or span costs no memory, every cell is kept, and the table is `truncated` as well; other
    columns are left out, whatever their names; no cells, no rows.
    """
    at = lambda c: F.col(c).cast("int").cast("long")
    good = F.coalesce((at("row") >= 0) & (at("col") >= 0), F.lit(False))
    end = lambda a, b: at(a) + F.greatest(F.lit(1), F.coalesce(at(b), F.lit(1)))
    text = F.coalesce(X.escape_cell(X.merge_bold_runs(F.col("blocks"))), F.lit(""))
    x = F.struct(at("row").alias("r"), at("col").alias("c"), F.col("cell_no").alias("k"), end("row", "rowspan").alias("down"), end("col", "colspan").alias("across"), text.alias("v"))
    t = cells.select(F.col(key).alias("__key"), F.col("declared_cols").cast("long").alias("declared"), F.when(good, x).alias("x"))
    g = t.groupBy("__key").agg(F.collect_list("x").alias("x"), F.coalesce(F.max("declared"), F.lit(0)).alias("declared"), F.bool_or(F.col("x").isNull()).alias("cut"))
    reach = lambda f: F.coalesce(F.array_max(F.transform("x", lambda e: e[f])), F.lit(1))

    def stretches(first: str, last: str, most: Column, *others: Column) -> Column:
        """Where nothing begins or ends for FAR rows or columns, and how many of them are left out."""
        edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), *others), F.transform("x", lambda e: e[first]), F.transform("x", lambda e: e[first] + 1), F.transform("x", lambda e: e[last]))))
        gaps = X.let(edges, lambda v: F.filter(F.transform(v, lambda a, i: F.struct(a.alias("at"), (F.get(v, i + 1) - a - 1).alias("n"))), lambda s: s["n"] >= FAR - 1))
        return F.when(most > FAR, gaps).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>"))

    g = g.withColumn("tall", stretches("r", "down", reach("down"))).withColumn("wide", stretches("c", "across", F.greatest(reach("across"), "declared"), F.greatest(F.col("declared"), F.lit(0))))
    near = lambda v, gaps: v - F.aggregate(F.filter(gaps, lambda s: s["at"] < v), F.lit(0).cast("long"), lambda n, s: n + s["n"])
    moved = F.transform("x", lambda e: F.struct(near(e["r"], "tall").alias("r"), near(e["c"], "wide").alias("c"), e["k"].alias("k"), near(e["down"], "tall").alias("down"), near(e["across"], "wide").alias("across"), e["v"].alias("v")))
    far = F.size("tall") + F.size("wide") > 0
    g = g.select("__key", F.when(far, moved).otherwise(F.col("x")).alias("x"), F.when(far, near(F.col("declared"), "wide")).otherwise(F.col("declared")).alias("declared"), (F.col("cut") | far).alias("cut"))
    one = lambda e, r, v: F.struct(r.alias("r"), e["c"].alias("c"), e["k"].alias("k"), v.alias("v"))
    own = lambda e: F.array(one(e, e["r"], e["v"]))
    below = lambda e: F.transform(F.sequence(e["r"], e["down"] - 1), lambda r: one(e, r, F.when(r == e["r"], e["v"]).otherwise(MERGED)))
    drawn = F.flatten(F.transform("x", lambda e: F.when(e["down"] - e["r"] > 1, below(e)).otherwise(own(e)))) if marks else F.transform("x", lambda e: one(e, e["r"], e["v"]))
    g = g.select("__key", "cut", reach("down").alias("n"), F.greatest(reach("across"), "declared").cast("int").alias("m"), F.array_sort(drawn).alias("y"))
    # of several in one place the last counts
    same = lambda a, b: F.coalesce((a["r"] == b["r"]) & (a["c"] == b["c"]), F.lit(False))
    g = g.withColumn("y", F.filter("y", lambda e, i: ~same(F.get(F.col("y"), i + 1), e)))
    g = g.withColumn("first", F.coalesce(F.get(F.filter("y", lambda e: F.trim(e["v"]) != ""), F.lit(0))["r"], F.col("n") - 1))
    gap = F.lit(" | ")
    times = lambda s, n: F.repeat(s, n.cast("int"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("m")), " | "), F.lit(" |"))
    g = g.withColumn("z", F.filter("y", lambda e: e["r"] >= F.col("first"))).withColumn("rule", rule).withColumn("blank", F.concat(F.lit("| "), times(gap, F.col("m") - 1), F.lit(" |")))
    empty = lambda n: times(F.concat(F.lit("\n"), "blank"), n)
    close = lambda e: F.concat(times(gap, F.col("m") - 1 - e["c"]), F.lit(" |"), F.when(e["r"] == F.col("first"), F.col("rule")).otherwise(""))
    begin = lambda e: F.concat(F.lit("| "), times(gap, e["c"]), e["v"])

    def piece(e: Column, p: Column) -> Column:
        """What a cell adds behind the one before it."""
        return F.when(p.isNull(), begin(e)).when(p["r"] == e["r"], F.concat(times(gap, e["c"] - p["c"]), e["v"])).otherwise(F.concat(close(p), empty(e["r"] - p["r"] - 1), F.lit("\n"), begin(e)))

    last = F.get(F.col("z"), F.size("z") - 1)
    pieces = F.array_join(F.transform("z", lambda e, i: X.let(F.get(F.col("z"), i - 1), lambda p: piece(e, p))), "")
    markdown = F.when(F.size("z") == 0, F.concat("blank", "rule")).otherwise(F.concat(pieces, close(last), empty(F.col("n") - 1 - last["r"])))
    return g.select(F.col("__key").alias(key.split(".")[-1]), (F.col("n") - F.col("first")).cast("int").alias("n_rows"), F.col("m").alias("n_cols"), markdown.alias("markdown"), F.col("cut").alias("truncated"))


def render_padded(rows: Column) -> Column:
    """An array of rows as a GitHub table whose columns are as wide as their widest cell, three at least; '' for no rows."""
    def drawn(even: Column, wide: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, wide, lambda x, w: F.concat(x, F.repeat(F.lit(" "), w - X.display_width(x)))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|-"), F.array_join(F.transform(wide, lambda w: F.repeat(F.lit("-"), w)), "-|-"), F.lit("-|"))
        rest = F.transform(F.slice(even, F.lit(2), F.size(even) - 1), line)
        return F.array_join(F.concat(F.array(line(F.get(even, F.lit(0))), rule), rest), "\n")

    widths = lambda even: F.transform(F.sequence(F.lit(0), F.size(F.get(even, F.lit(0))) - 1), lambda c: F.greatest(F.lit(3), F.array_max(F.transform(even, lambda r: X.display_width(F.get(r, c))))))
    fill = lambda n: F.transform(rows, lambda r: F.concat(F.transform(r, X.escape_cell), F.array_repeat(F.lit(""), n - F.size(r))))
    n = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.when(F.size(rows) > 0, X.let(X.let(n, fill), lambda even: X.let(widths(even), lambda wide: drawn(even, wide)))).otherwise("")


def is_subheader(above: Column, row: Column) -> Column:
    """Whether a row looks like a second header row: short cells, some of them under empty ones' opposites."""
    filled = F.filter(F.transform(row, lambda c: F.trim(c)), lambda c: c != "")
    gaps = F.filter(F.zip_with(above, row, lambda a, b: (F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(b, F.lit(""))) == "")), lambda x: x)
    short = F.filter(filled, lambda c: F.length(c) <= 6)
    return ~F.exists(filled, lambda c: c.contains("○") | c.contains("◦") | (F.length(c) > 20)) & (F.size(gaps) >= 1) & (F.size(filled) >= 2) & (F.size(short) >= 0.6 * F.size(filled))


def header_rows(rows: Column, most: int = 3) -> Column:
    """How many rows at the top are headers: the first, and those after it that look like subheaders."""
    out = F.lit(most)
    for k in range(most - 1, 0, -1):
        out = F.when((F.size(rows) > k) & F.coalesce(is_subheader(F.get(rows, F.lit(k - 1)), F.get(rows, F.lit(k))), F.lit(False)), out).otherwise(k)
    return out


def merge_headers(rows: Column, h: Column) -> Column:
    """rows with the first h merged into one: each column's distinct texts, joined; of one or none nothing changes."""
    top = F.slice(rows, F.lit(1), F.greatest(h, F.lit(1)))
    texts = lambda c: F.filter(F.transform(top, lambda r: F.trim(F.coalesce(F.get(r, c), F.lit("")))), lambda x: x != "")
    row = F.transform(F.sequence(F.lit(0), F.array_max(F.transform(top, lambda r: F.size(r))) - 1), lambda c: F.array_join(F.array_distinct(texts(c)), " "))
    return F.when(h <= 1, rows).otherwise(F.concat(F.array(row), F.slice(rows, h + 1, F.greatest(F.size(rows) - h, F.lit(0)))))


def flatten_headers(rows: Column, most: int = 3) -> Column:
    """The header rows merged into one: each column's distinct texts, joined."""
    return F.when(F.size(rows) > 0, X.let(header_rows(rows, most), lambda h: merge_headers(rows, h))).otherwise(rows)


#: Header rows of a table that a layout model read, at most.
MAX_HEADERS = 3


def draw_positioned(tables: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, header_rows, markdown) of tables (key, n_rows, n_cols) and cells (key, cell_no, row0, row1, row_span, col0, col1, col_span, column_header, text; ends excluded).

    A header's text stands in all slots that it spans, the first of several counts; other text only at its top left, the last counts and
    goes before a header's. An end that is null or not beyond its begin comes from the span. Headers are the rows from the top that
    column headers cover, MAX_HEADERS at most; several are merged. Empty rows at the end go.

    Defined cases: a table without cells, rows or columns has an empty Markdown; cells that begin outside are left out, blank ones as well;
    null keys have no table; repeated cells change nothing; tables of other columns of any name pass none of them on.
    """
    begin = lambda c: F.coalesce(F.col(f"{c}0"), F.lit(0)).cast("int")
    end = lambda c: F.when(F.col(f"{c}1") > begin(c), F.col(f"{c}1")).otherwise(begin(c) + F.greatest(F.coalesce(F.col(f"{c}_span"), F.lit(1)), F.lit(1))).cast("int")
    t = tables.select(F.col(key).alias("__key"), F.col("n_rows").cast("int").alias("n"), F.col("n_cols").cast("int").alias("m"))
    c = cells.select(F.col(key).alias("__key"), "cell_no", begin("row").alias("r0"), end("row").alias("r1"), begin("col").alias("c0"), end("col").alias("c1"), F.coalesce("column_header", F.lit(False)).alias("head"), F.trim(F.coalesce("text", F.lit(""))).alias("text")).join(t, "__key")
    whole = Window.partitionBy("__key")
    covered = [F.coalesce(F.bool_or(F.col("head") & (F.col("r0") <= k) & (F.col("r1") > k) & (F.col("n") > k)).over(whole), F.lit(False)) for k in range(MAX_HEADERS)]
    h = F.lit(MAX_HEADERS)
    for k in range(MAX_HEADERS - 1, -1, -1):
        h = F.when(covered[k], h).otherwise(k)
    c = c.withColumn("h", h).where((F.col("text") != "") & (F.col("r0") >= 0) & (F.col("r0") < F.col("n")) & (F.col("c0") >= 0) & (F.col("c0") < F.col("m")))
    c = c.withColumn("head", F.col("head") | (F.col("r0") < F.col("h")))
    last = lambda a, b, n: F.when(F.col("head"), F.least(F.col(b), F.col(n)) - 1).otherwise(F.col(a))
    s = c.select("__key", "m", "h", "cell_no", "head", "text", F.explode(F.sequence("r0", last("r0", "r1", "n"))).alias("r"), "c0", last("c0", "c1", "m").alias("c1")).select("__key", "m", "h", "cell_no", "head", "text", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    first, newest = F.min_by(F.when(F.col("head"), F.col("text")), F.when(F.col("head"), F.col("cell_no"))), F.max_by(F.when(~F.col("head"), F.col("text")), F.when(~F.col("head"), F.col("cell_no")))
    slot = s.groupBy("__key", "m", "h", "r", "c").agg(F.coalesce(newest, first).alias("v"))
    blank = lambda n: F.array_repeat(F.lit(""), n)
    row = slot.groupBy("__key", "m", "h", "r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("x"))
    filled = F.flatten(F.transform("x", lambda e, i: F.concat(blank(e["c"] - 1 - F.coalesce(F.get(F.col("x"), i - 1)["c"], F.lit(-1))), F.array(e["v"]))))
    row = row.select("__key", "m", "h", F.struct("r", F.concat(filled, blank(F.col("m") - 1 - F.get(F.col("x"), F.size("x") - 1)["c"])).alias("v")).alias("row"))
    g = row.groupBy("__key", "m", "h").agg(F.array_sort(F.collect_list("row")).alias("x"))
    rows = F.flatten(F.transform("x", lambda e, i: F.concat(F.array_repeat(blank(F.col("m")), e["r"] - 1 - F.coalesce(F.get(F.col("x"), i - 1)["r"], F.lit(-1))), F.array(e["v"]))))
    g = g.withColumn("rows", rows).withColumn("k", F.least(F.col("h"), F.size("rows")))
    drawn = g.select("__key", F.col("h"), render_padded(merge_headers(F.col("rows"), F.col("k"))).alias("md"))
    out = t.join(drawn, "__key", "left")
    return out.select(F.col("__key").alias(key.split(".")[-1]), F.coalesce("h", F.lit(0)).alias("header_rows"), F.coalesce("md", F.lit("")).alias("markdown"))


def structure_gap(tables: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, declared, covered, missing, ratio, broken): slots of each table (key, n_rows, n_cols) that its cells (key, row0, row1, col0, col1; ends excluded) cover.

    A cell's slots are counted within its table's bounds. Cells are sent by table once; only distinct slots are counted after.
    """
    inside = cells.join(tables, key).select(key, "n_rows", "n_cols", F.greatest("row0", F.lit(0)).alias("r0"), F.least("row1", "n_rows").alias("r1"), F.greatest("col0", F.lit(0)).alias("c0"), F.least("col1", "n_cols").alias("c1")).where("r0 < r1 and c0 < c1")
    slots = inside.select(key, "n_cols", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select(key, (F.col("r").cast("long") * F.col("n_cols")).alias("base"), F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    covered = slots.select(key, (F.col("base") + F.col("c")).alias("slot")).distinct().groupBy(key).agg(F.count("*").alias("covered"))
    t = tables.join(covered, key, "left").withColumn("declared", (F.col("n_rows").cast("long") * F.col("n_cols")))
    t = t.withColumn("covered", F.when(F.col("declared") > 0, F.coalesce("covered", F.lit(0))).otherwise(0).cast("long"))
    # without dimensions or cells there is nothing to judge
    t = t.withColumn("declared", F.when((F.col("declared") > 0) & (F.col("covered") > 0), F.col("declared")).otherwise(0))
    missing = F.col("declared") - F.col("covered")
    ratio = F.when(F.col("declared") > 0, F.bround(F.col("covered") / F.col("declared"), 3)).otherwise(0.0)
    return t.select(key, "declared", "covered", missing.alias("missing"), ratio.alias("ratio"), (missing > 0).alias("broken"))


def slim_cells(cells: DataFrame, key: str) -> DataFrame:
    """(key, slim): a table's cells as a JSON list, spans and flags only where they say something; row_header and page_no if the cells have them."""
    flag = lambda c: F.when(F.col(c), F.lit(True))
    one = F.struct(
        F.col("row").alias("r"),
        F.col("col").alias("c"),
        F.col("text"),
        F.when(F.col("rowspan") > 1, F.col("rowspan")).alias("rs"),
        F.when(F.col("colspan") > 1, F.col("colspan")).alias("cs"),
        flag("is_header").alias("header"),
        *[flag("row_header").alias("row_header")] * ("row_header" in cells.columns),
        *[F.col("page_no").alias("page")] * ("page_no" in cells.columns),
    )
    return cells.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("slim"))


def continuations(tables: DataFrame) -> DataFrame:
    """tables (doc_id, table_num, page_no, n_rows, n_cols, first_row_header, last_bottom, page_height) with head BOOLEAN and chain INT.

    A table goes on with the next if that lies on the next page, has fewer columns, no header row and at most half as many rows and
    one more, and this one ends in the lowest three tenths of its page (if known). A chain is a run of such tables; all its
    fragments get the number of its first table.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no", "table_num")
    before = lambda c: F.lag(c).over(w)
    low = F.coalesce(before("last_bottom") >= 0.7 * before("page_height"), F.lit(True))
    goes_on = (F.col("page_no") == before("page_no") + 1) & (F.col("n_cols") < before("n_cols")) & ~F.col("first_row_header") & (F.col("n_rows") <= F.floor(before("n_rows") / 2) + 1) & low
    t = tables.withColumn("head", ~F.coalesce(goes_on, F.lit(False)))
    return t.withColumn("chain", F.last(F.when(F.col("head"), F.col("table_num")), ignorenulls=True).over(w))
