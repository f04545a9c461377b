"""Outlines: (path, fact) per page, carried forward, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = "문서"


def outline(pages: DataFrame, answers: DataFrame, doc: str) -> DataFrame:
    """(doc, seq, page_no, path, fact): the outline nodes that answers (doc, page_no, node_no, path, fact) give for pages (doc, page_no, content).

    A page without an answer has one node: the last path before it (or the root) and its first 200 characters; blank pages have none.
    """
    a = answers.where("size(path) > 0")
    got = pages.join(a, [doc, "page_no"], "left").where("path is not null or trim(content) <> ''")
    w = Window.partitionBy(doc).orderBy("page_no", "node_no")
    last = F.last("path", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    path = F.coalesce("path", last, F.array(F.lit(ROOT)))
    fact = F.when(F.col("path").isNotNull(), F.col("fact")).otherwise(F.substring(F.trim("content"), 1, 200))
    return got.select(doc, F.row_number().over(w).alias("seq"), "page_no", path.alias("path"), fact.alias("fact"))


def with_context(pages: DataFrame, doc: str, chars: int = 2000) -> DataFrame:
    """pages with previous STRING: the end of the page before, for a provider to read on from."""
    before = F.lag("content").over(Window.partitionBy(doc).orderBy("page_no"))
    return pages.withColumn("previous", F.coalesce(F.right(before, F.lit(chars)), F.lit("")))


def markdown_lines(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, seq, md): each node's headings that the node before doesn't share, then its fact."""
    before = F.coalesce(F.lag("path").over(Window.partitionBy(doc).orderBy("seq")), F.array().cast("array<string>"))
    n = nodes.withColumn("before", before)
    same = F.zip_with("path", "before", lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(F.slice(same, F.lit(1), F.size("path")), F.lit(False)), F.lit(0)) - 1, F.size("path"))
    heads = F.transform("path", lambda x, i: F.when(i >= shared, F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), x)))
    lines = F.concat(F.filter(heads, lambda x: x.isNotNull()), F.when(F.trim("fact") != "", F.array(F.concat(F.lit("- "), "fact"))).otherwise(F.array().cast("array<string>")))
    return n.select(doc, "seq", F.array_join(lines, "\n").alias("md"))


def to_markdown(nodes: DataFrame, doc: str) -> DataFrame:
    """(doc, content): the whole outline."""
    m = markdown_lines(nodes, doc).where("md <> ''")
    return m.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "md"))), lambda x: x["md"]), "\n").alias("content"))
