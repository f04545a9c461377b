"""Verdicts on tables: merging a judge's answers, promoting pictures to tables, the work queue of repairs, accepting repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import gates
from ..functions.text import strip_fences
from . import blocks

UNJUDGED = "not judged: no judge answered, the defaults stand"

VERDICT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("group_image_ids", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)


def parse_reply(reply: Column) -> Column:
    """A judge's reply as ARRAY<VERDICT>: a JSON list, or an object of verdicts by id, in a fence or amid other words; else empty."""
    t = strip_fences(reply, "json")
    listed = F.array(t, F.regexp_extract(t, r"(?s)\[.*\]", 0))
    mapped = F.array(t, F.regexp_extract(t, r"(?s)\{.*\}", 0))
    as_list = F.filter(F.transform(listed, lambda s: F.when(s.startswith("["), F.from_json(F.when(F.try_parse_json(s).isNotNull(), s), T.ArrayType(T.StringType())))), lambda a: a.isNotNull())
    rows = F.transform(F.filter(F.get(as_list, F.lit(0)), lambda v: v.startswith("{")), lambda v: F.from_json(v, VERDICT))
    raw = T.MapType(T.StringType(), T.StringType())
    as_map = F.filter(F.transform(mapped, lambda s: F.when(s.startswith("{"), F.from_json(F.when(F.try_parse_json(s).isNotNull(), s), raw))), lambda m: m.isNotNull())
    entries = F.filter(F.map_entries(F.get(as_map, F.lit(0))), lambda e: e["value"].startswith("{"))

    def named(e: Column) -> Column:
        v = F.from_json(e["value"], VERDICT)
        return F.struct(F.coalesce(v["id"], e["key"]).alias("id"), *(v[f.name].alias(f.name) for f in VERDICT.fields[1:]))

    empty = F.array().cast(T.ArrayType(VERDICT))
    return F.coalesce(F.when(F.size(as_list) > 0, rows), F.transform(entries, named), empty)


def merge(tables: DataFrame, verdicts: DataFrame, doc: str, judged: bool = True) -> DataFrame:
    """tables (doc, id, ...) with content_type, quality, title, group_image_ids and reason from verdicts (doc, seq, VERDICT).

    The last of several verdicts on a table counts. A table without one, or with one of unknown type, is taken for a sufficient table;
    a table of no known quality for insufficient; what isn't a table has no quality.
    """
    v = verdicts.where("coalesce(id, '') <> ''").groupBy(doc, "id").agg(F.max_by(F.struct("content_type", "quality", "title", "group_image_ids", "reason"), "seq").alias("v"))
    t = tables.drop("content_type", "quality", "title", "group_image_ids", "reason").join(v, [doc, "id"], "left")
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(f"v.{c}"), F.lit(""))))
    kind, known = clean("content_type"), F.col("v").isNotNull() & clean("content_type").isin("table", "text", "image")
    text = lambda c: F.when(known, F.nullif(F.trim(F.col(f"v.{c}")), F.lit("")))
    quality = F.when(~known, "sufficient").when(kind == "table", F.when(clean("quality").isin("wrong", "insufficient"), clean("quality")).otherwise("insufficient"))
    ids = F.when(known & (F.size("v.group_image_ids") > 0), F.filter("v.group_image_ids", lambda g: g != ""))
    reason = text("reason") if judged else F.when(F.col("v").isNull(), UNJUDGED).otherwise(text("reason"))
    return t.select(*[c for c in t.columns if c != "v"], F.when(known, kind).otherwise("table").alias("content_type"), quality.alias("quality"), text("title").alias("title"), ids.alias("group_image_ids"), reason.alias("reason"))


def unknown(tables: DataFrame, verdicts: DataFrame, doc: str) -> DataFrame:
    """(doc, id): verdicts on tables that don't exist."""
    return verdicts.where("coalesce(id, '') <> ''").select(doc, "id").distinct().join(tables.select(doc, "id"), [doc, "id"], "left_anti")


def promote(images: DataFrame, tables: DataFrame, verdicts: DataFrame, doc: str) -> DataFrame:
    """(doc, image_id, table_num, id, title, reason): pictures that a verdict calls tables, if they were candidates and aren't promoted yet.

    Their numbers follow the document's last, so no number is given twice.
    """
    v = verdicts.where("lower(trim(content_type)) = 'table'").groupBy(doc, "id").agg(F.min_by(F.struct("seq", "title", "reason"), "seq").alias("v"))
    new = images.where("table_candidate and promoted_table_id is null").select(doc, F.col("id").alias("image_id")).join(v.withColumnRenamed("id", "image_id"), [doc, "image_id"])
    last = tables.groupBy(doc).agg(F.max("table_num").alias("last"))
    num = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(doc).orderBy("v.seq", "image_id"))
    out = new.join(last, doc, "left").withColumn("table_num", num.cast("int"))
    return out.select(doc, "image_id", "table_num", F.concat(F.lit("table_"), F.col("table_num").cast("string")).alias("id"), F.nullif(F.trim("v.title"), F.lit("")).alias("title"), F.nullif(F.trim("v.reason"), F.lit("")).alias("reason"))


def fill_jobs(tables: DataFrame, pages: DataFrame, keys: list[str], fill_all: bool = False) -> DataFrame:
    """tables that need a repair, with evidence STRING: image, html or none, best first. pages (keys, page_image_path), tables also have table_html."""
    need = gates.needs_fill(F.col("content_type"), F.col("quality"))
    t = tables.where((F.col("content_type") == "table") if fill_all else need).join(pages.select(*keys, "page_image_path"), keys, "left")
    return t.withColumn("evidence", F.when(F.col("page_image_path").isNotNull(), "image").when(F.coalesce("table_html", F.lit("")) != "", "html").otherwise("none"))


def accept(tables: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """tables (key, markdown) with the answers (key, answer) that pass: markdown, original_markdown and accepted."""
    a = answers.select(key, strip_fences(F.col("answer")).alias("answer"))
    t = tables.join(a, key, "left").withColumn("accepted", gates.rebuild_accepted(F.col("answer"), F.col("markdown")))
    return t.withColumn("original_markdown", F.when(F.col("accepted"), F.col("markdown"))).withColumn("markdown", F.when(F.col("accepted"), F.col("answer")).otherwise(F.col("markdown"))).drop("answer")


def promoted_pages(pages: DataFrame, promoted: DataFrame, images: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, content): pages with an empty table block after the placeholder of each promoted picture, in the order of table numbers. images (keys, id, placeholder)."""
    doc = keys[0]
    new = promoted.select(doc, F.col("image_id").alias("id"), "table_num").join(images.select(*keys, "id", "placeholder"), [doc, "id"])
    per_page = new.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_num", "placeholder"))).alias("__new"))
    done = blocks.insert_all(F.col(content), F.transform("__new", lambda x: x["placeholder"]), F.transform("__new", lambda x: blocks.table_block(x["table_num"], F.lit(""))))
    return pages.select(*keys, content).join(per_page, keys, "left").select(*keys, done.alias(content))


def with_promoted(tables: DataFrame, promoted: DataFrame, images: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tables and the promoted pictures, images with promoted_table_id): each knows the other."""
    doc = keys[0]
    p = promoted.join(images.select(*keys, F.col("id").alias("image_id")), [doc, "image_id"])
    rows = p.select(*keys, "table_num", "id", F.concat(F.lit("<table "), F.col("table_num").cast("string"), F.lit(">")).alias("placeholder"), F.lit("").alias("markdown"), F.lit("table").alias("content_type"), F.lit("insufficient").alias("quality"), "title", F.lit(None).cast("array<string>").alias("group_image_ids"), "reason", F.col("image_id").alias("source_image_id"))
    both = tables.withColumn("source_image_id", F.lit(None).cast("string")).unionByName(rows, allowMissingColumns=True)
    linked = images.drop("promoted_table_id").join(promoted.select(doc, F.col("image_id").alias("id"), F.col("id").alias("promoted_table_id")), [doc, "id"], "left")
    return both, linked


def with_html(jobs: DataFrame, html_tables: DataFrame, doc: str) -> DataFrame:
    """jobs (doc, table_num, ...) with table_html: the document's HTML table at the job's place, null if there are fewer. html_tables (doc, position from 0, html)."""
    h = html_tables.select(doc, (F.col("position") + 1).cast("int").alias("table_num"), F.col("html").alias("table_html"))
    return jobs.drop("table_html").join(h, [doc, "table_num"], "left")


def region_text(tables: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """tables with region_text: what the text layer has where the picture is that a table was promoted from, fenced; null without one or without text."""
    i = images.select(doc, F.col("id").alias("source_image_id"), F.trim("text").alias("__t"))
    block = F.when(F.coalesce("__t", F.lit("")) != "", F.concat(F.lit("```text\n"), F.col("__t"), F.lit("\n```")))
    return tables.join(i, [doc, "source_image_id"], "left").withColumn("region_text", block).drop("__t")
