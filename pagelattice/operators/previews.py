"""Preview streams of word-processor files, and report texts that are put together from the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions.text import escape_cell
from .reports import LABELS, OUTCOMES, in_order, lookup


def preview_tables(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, block_no, is_table, markdown) of preview lines (doc, line_no, text): neighbouring lines of the form <a><b> are one table, as wide as its widest row."""
    w = Window.partitionBy(doc).orderBy("line_no")
    row = F.col("text").rlike(r"^\s*(?:<[^<>]*>)+\s*$")
    t = lines.withColumn("row", row).withColumn("new", (~F.col("row") | ~F.coalesce(F.lag("row").over(w), F.lit(False))).cast("int"))
    t = t.withColumn("block_no", F.sum("new").over(w)).withColumn("cells", F.regexp_extract_all("text", F.lit(r"<([^<>]*)>"), F.lit(1)))
    wide = F.max(F.when(F.col("row"), F.size("cells"))).over(Window.partitionBy(doc, "block_no"))
    t = t.withColumn("wide", wide).withColumn("cells", F.concat(F.transform("cells", escape_cell), F.array_repeat(F.lit(""), F.col("wide") - F.size("cells"))))
    line = F.when(F.col("row"), F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))).otherwise(F.col("text"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("wide")), " | "), F.lit(" |"))
    first = F.col("row") & (F.row_number().over(Window.partitionBy(doc, "block_no").orderBy("line_no")) == 1)
    t = t.withColumn("md", F.concat(line, F.when(first, rule).otherwise("")))
    return t.groupBy(doc, "block_no").agg(F.bool_or("row").alias("is_table"), in_order("line_no", "md", "\n").alias("markdown"))


def clean_raw(text):
    """Raw text of a compound file: symbols mapped, control characters gone, blank lines left out."""
    t = F.regexp_replace(X.map_pua(text), r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""), "\n")


def pipeline_markdown(timings: DataFrame, pages: DataFrame, doc: str) -> DataFrame:
    """(doc, content): pipeline.md of reports.timing_shares and of pages (doc, page_no, summary, notes ARRAY<STRING>)."""
    share = F.concat(F.lit("| "), "stage", F.lit(" | "), F.format_string("%.1f", F.bround("seconds", 1)), F.lit(" | "), F.format_string("%.0f%%", F.bround(F.col("share") * 100, 0)), F.lit(" |"))
    t = timings.withColumn("o", F.struct(-F.col("seconds"), "stage")).groupBy(doc).agg(in_order("o", share, "\n").alias("t"))
    line = F.concat(F.lit("| "), F.col("page_no").cast("string"), F.lit(" | "), "summary", F.lit(" | "), F.coalesce(F.array_join("notes", "; "), F.lit("")), F.lit(" |"))
    p = pages.groupBy(doc).agg(in_order("page_no", line, "\n").alias("p"))
    head = F.lit("## Timings\n\n| stage | seconds | share |\n| --- | --- | --- |\n")
    return p.join(t, doc, "left").select(doc, F.concat(F.coalesce(F.concat(head, "t", F.lit("\n\n")), F.lit("")), F.lit("## Pages\n\n| page | path | notes |\n| --- | --- | --- |\n"), "p", F.lit("\n")).alias("content"))


def layout_markdown(items: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, content): layout.md of items (doc, page_no, item_order, label, outcome, text) and reports of overlapping pairs (doc, a_order, b_order, ratio)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("page_no").cast("string"), F.col("item_order").cast("string"), lookup(F.col("label"), LABELS), lookup(F.col("outcome"), OUTCOMES), escape_cell(X.preview_text(F.col("text")))), F.lit(" |"))
    i = items.withColumn("o", F.struct("page_no", "item_order")).groupBy(doc).agg(in_order("o", line, "\n").alias("i"), F.count_if(F.col("outcome") == "dropped").alias("dropped"))
    pair = F.format_string("- %d / %d: %.0f%%", F.col("a_order").cast("long"), F.col("b_order").cast("long"), F.bround(F.col("ratio") * 100, 0))
    o = pairs.withColumn("o", F.struct("a_order", "b_order")).groupBy(doc).agg(in_order("o", pair, "\n").alias("p"))
    return i.join(o, doc, "left").select(doc, F.concat(F.lit("dropped: "), F.col("dropped").cast("string"), F.lit("\n\n| page | order | label | outcome | text |\n| --- | --- | --- | --- | --- |\n"), "i", F.coalesce(F.concat(F.lit("\n\n## Overlaps\n\n"), "p"), F.lit("")), F.lit("\n")).alias("content"))


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_view(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, html): rows as an HTML table for notebooks."""
    cells = F.concat(*(F.concat(F.lit("<td>"), _escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    t = rows.groupBy(key).agg(in_order(order, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")), "").alias("b"))
    return t.select(key, F.concat(F.lit(head), "b", F.lit("</table>")).alias("html"))


def summary_lines(summary: DataFrame, doc: str) -> DataFrame:
    """(doc, text): reports.document_summary as lines for a console."""
    s = lambda c: F.col(c).cast("string")
    warn = F.when(F.col("empty_pages") != "", F.concat(F.lit("\nempty pages: "), "empty_pages")).otherwise("")
    kinds = F.when(F.col("by_type") != "", F.concat(F.lit(" ("), "by_type", F.lit(")"))).otherwise("")
    return summary.select(doc, F.concat(F.lit("pages: "), s("n_pages"), F.lit("\ncharacters: "), s("n_chars"), F.lit("\ntables: "), s("n_tables"), kinds, F.lit("\nfilled: "), s("n_filled"), F.lit("\npictures: "), s("n_images"), warn).alias("text"))
