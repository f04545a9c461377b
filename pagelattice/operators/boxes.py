"""Spatial operators: text fragments to cells, reading order, overlapping regions, what kind of thing a region is.

Joins are equi-joins on the table or page with the geometric condition behind, so work grows with what lies on one page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

MIN_OVERLAP, DOMINANT = 0.3, 0.7
CELL_LINE, PAGE_LINE, GLYPH_LINE, GAP = 6.0, 12.0, 6.0, 8.0


def assign(fragments: DataFrame, cells: DataFrame, key: str, least: float = MIN_OVERLAP) -> DataFrame:
    """(key, frag_no, cell_no, ratio): each fragment's cells, by the share of the fragment that lies in the cell.

    fragments (key, frag_no, box), cells (key, cell_no, box). If a cell has seven tenths of a fragment, cells with less don't count.
    """
    f, c = fragments.select(key, "frag_no", F.col("box").alias("f")), cells.select(key, "cell_no", F.col("box").alias("c"))
    hit = f.join(c, key).withColumn("ratio", G.overlap_ratio(G.box("f"), G.box("c"))).where(F.col("ratio") >= least)
    best = F.max("ratio").over(Window.partitionBy(key, "frag_no"))
    return hit.withColumn("best", best).where((F.col("best") < DOMINANT) | (F.col("ratio") >= DOMINANT)).select(key, "frag_no", "cell_no", "ratio")


def _in_order(tolerance: float, text: str = "text", sep: str = " ", tie: str = "frag_no"):
    one = F.struct(G.line_of(F.col("box.t"), tolerance).alias("y"), F.col("box.l").alias("x"), F.col(tie).alias("n"), F.col(text).alias("s"))
    return F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), lambda s: s != ""), sep)


def cell_texts(fragments: DataFrame, cells: DataFrame, key: str, least: float = MIN_OVERLAP) -> DataFrame:
    """(key, cell_no, text): each cell's fragments in reading order."""
    a = assign(fragments, cells, key, least).join(fragments.select(key, "frag_no", "text", "box"), [key, "frag_no"])
    return a.groupBy(key, "cell_no").agg(_in_order(CELL_LINE).alias("text"))


def refill_stats(fragments: DataFrame, cells: DataFrame, key: str, least: float = MIN_OVERLAP) -> DataFrame:
    """(key, n_cells, n_filled, n_changed, n_empty, n_fragments, n_unassigned, n_near): what filling cells from fragments does.

    cells also have text, tables' boxes are what their cells span. A near fragment lies half or more in its table, in no cell.
    """
    a = assign(fragments, cells, key, least)
    texts = cell_texts(fragments, cells, key, least).withColumnRenamed("text", "new")
    per_cell = cells.join(texts, [key, "cell_no"], "left").groupBy(key).agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.coalesce("new", F.lit("")) != "").alias("n_filled"),
        F.count_if((F.coalesce("new", F.lit("")) != "") & (F.col("new") != F.coalesce("text", F.lit("")))).alias("n_changed"),
        F.count_if((F.coalesce("new", F.lit("")) == "") & (F.coalesce("text", F.lit("")) == "")).alias("n_empty"),
        F.struct(F.min("box.l").alias("l"), F.min("box.t").alias("t"), F.max("box.r").alias("r"), F.max("box.b").alias("b")).alias("table"),
    )
    used = a.select(key, "frag_no").distinct().withColumn("used", F.lit(True))
    frag = fragments.join(used, [key, "frag_no"], "left").join(per_cell.select(key, "table"), key)
    near = F.col("used").isNull() & (G.overlap_ratio(G.box("box"), G.box("table")) >= 0.5)
    per_frag = frag.groupBy(key).agg(F.count("*").alias("n_fragments"), F.count_if(F.col("used").isNull()).alias("n_unassigned"), F.count_if(near).alias("n_near"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fragments", "n_unassigned", "n_near")]
    return per_cell.drop("table").join(per_frag, key, "left").select(key, "n_cells", "n_filled", "n_changed", "n_empty", *zero)


def page_text(fragments: DataFrame, key: str) -> DataFrame:
    """(key, text): a page's lines, top to bottom and left to right if all have boxes, else as they came."""
    f = fragments.where("coalesce(text, '') <> ''")
    plain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_no", "text"))), lambda x: x["text"]), "\n")
    return f.groupBy(key).agg(F.when(F.bool_and(F.col("box").isNotNull()), _in_order(PAGE_LINE, sep="\n")).otherwise(plain).alias("text"))


def overlapping_pairs(items: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, a_order, b_order, ratio): pairs of a page's regions of which the smaller is covered by that share."""
    x = items.where("box is not null")
    a, b = x.select(key, F.col("item_order").alias("a_order"), F.col("box").alias("a")), x.select(key, F.col("item_order").alias("b_order"), F.col("box").alias("b"))
    p = a.join(b, key).where("a_order < b_order and a.l < b.r and b.l < a.r and a.t < b.b and b.t < a.b")
    smaller = F.least(G.area(G.box("a")), G.area(G.box("b")))
    return p.withColumn("ratio", F.when(smaller > 0, G.overlap_area(G.box("a"), G.box("b")) / smaller)).where(F.col("ratio") >= least).select(key, "a_order", "b_order", "ratio")


def glyphs_in_regions(glyphs: DataFrame, regions: DataFrame, page: str, region: str) -> DataFrame:
    """Glyphs (page, l, t, r, b) that lie wholly in a region (page, region, box), with the region's key; glyphs without area don't count."""
    g = glyphs.where("r > l and b > t")
    return g.join(regions.select(page, region, F.col("box").alias("__r")), page).where("l >= __r.l and r <= __r.r and t >= __r.t and b <= __r.b").drop("__r")


def glyph_cells(glyphs: DataFrame, region: str) -> DataFrame:
    """(region, line, cell_no, start): the cells that a region's glyphs form: on a line, a new one begins after a gap of more than 8 points."""
    y = F.bround((F.col("t") + F.col("b")) / 2 / GLYPH_LINE, 0)
    g = glyphs.select(region, y.cast("long").alias("line"), "l", "r")
    w = Window.partitionBy(region, "line").orderBy("l", "r")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("new", (reach.isNull() | (F.col("l") - reach > GAP)).cast("int")).where("new = 1")
    return g.select(region, "line", F.row_number().over(w).alias("cell_no"), F.col("l").alias("start"))


def classify_regions(glyphs: DataFrame, region: str) -> DataFrame:
    """(region, kind, n_chars, n_lines, rows, mode_cols, mode_share, drift): table, text or image, by how a region's glyphs align.

    A table has three lines or more of the commonest number of cells, which are half or more of its lines of several cells, and its
    columns begin within 12 points (standard deviation). Among numbers that are as common, the one that comes first from the top counts.
    """
    cells = glyph_cells(glyphs, region)
    lines = cells.groupBy(region, "line").agg(F.count("*").alias("cols"))
    chars = glyphs.groupBy(region).agg(F.count("*").alias("n_chars"))
    multi = lines.where("cols >= 2")
    counts = multi.groupBy(region, "cols").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    w = Window.partitionBy(region)
    mode = counts.withColumn("rows", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "first"))).where("k = 1").select(region, "rows", F.col("cols").alias("mode_cols"), F.col("n").alias("mode_n"))
    same = cells.join(lines, [region, "line"]).join(mode.select(region, "mode_cols"), region).where("cols = mode_cols")
    drift = same.groupBy(region, "cell_no").agg(F.stddev_pop("start").alias("d")).groupBy(region).agg(F.max("d").alias("drift"))
    t = chars.join(lines.groupBy(region).agg(F.count("*").alias("n_lines")), region).join(mode, region, "left").join(drift, region, "left")
    share = F.col("mode_n") / F.col("rows")
    kind = (
        F.when((F.col("n_chars") < 30) | (F.col("n_lines") < 2), "image")
        .when(F.coalesce((F.col("mode_n") >= 3) & (share >= 0.5) & (F.col("drift") <= 12.0), F.lit(False)), "table")
        .otherwise("text")
    )
    seen = kind != "image"
    return t.select(region, kind.alias("kind"), "n_chars", "n_lines", F.when(seen, F.coalesce("rows", F.lit(0))).otherwise(0).alias("rows"), F.when(seen, F.coalesce("mode_cols", F.lit(0))).otherwise(0).alias("mode_cols"), F.when(seen, F.coalesce(share, F.lit(0.0))).otherwise(0.0).alias("mode_share"), F.when(seen, F.coalesce("drift", F.lit(0.0))).otherwise(0.0).alias("drift"))


def mark_candidates(images: DataFrame, density: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """images (keys, ...) with text_chars, text_lines, region_kind and table_candidate: a picture over dense text, unless its glyphs say that it is no table.

    density (keys, n_chars, n_lines), regions (keys, kind), both at most one row for a picture; a picture without them is no candidate.
    """
    from ..functions import gates

    d = density.select(*keys, F.col("n_chars").alias("text_chars"), F.col("n_lines").alias("text_lines"))
    j = images.drop("text_chars", "text_lines", "region_kind", "table_candidate").join(d, keys, "left").join(regions.select(*keys, F.col("kind").alias("region_kind")), keys, "left")
    dense = gates.table_candidate(F.col("text_chars"), F.col("text_lines"))
    return j.withColumn("table_candidate", dense & F.coalesce(F.col("region_kind") == "table", F.lit(True)))
