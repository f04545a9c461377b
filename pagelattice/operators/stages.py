"""The stages that models answer in: what they are asked, which answers count, and what becomes of the pages.

A model is a provider (providers.ask): a function from a list of requests to a list of answers. Requests are made and answers applied by
columns and joins; each stage's answers are written once, so that every later use sees the same.

Defined cases, of all stages: no requests, no calls; a null or refused answer leaves what was there; null texts count as empty; equal requests
are asked once each; tables, pages and pictures that other stages removed have no request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import gates
from ..functions import text as X
from ..providers import ask
from ..session import cut
from . import blocks, boxes, grid, verdicts

#: Characters that prompts show at most, as services have a bound: of a page, of what stands around a picture, of a page and the one before for an outline.
PAGE, AROUND, OUTLINE, BEFORE = 20_000, 400, 12_000, 2_000

JUDGE = """Below is a page of a document; its tables stand between <table N> tags. Name the tables that have a problem, as a JSON list of objects with
id (table_N), content_type (table, text or image), quality (wrong or insufficient, of tables), title, group_image_ids (the ids of tables that are parts of one picture) and reason."""
PICTURES = "Pictures of the page that may be tables (give those that are with their id and content_type table):"
READ = "Write down what the picture shows, as Markdown. Answer 내용 없음 if there is nothing to read."
REBUILD = "The picture shows a page; one of its tables was read with cells missing. Write the whole table as Markdown."
REPAIR = "This table was read wrongly. Write it as Markdown, all its cells, by the evidence."
CELLS = "Write the table that these cells make as Markdown; keep every text as it is."
TWO = "Write the one table that these two lists of cells make, of which the second goes on with the first, as Markdown; keep every text as it is."
NODES = "Give the facts of the page below as a JSON list of objects with path (a list of headings) and fact. The page before ended as shown."

Provider = Callable[[list[dict]], list]


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def judge_requests(pages: DataFrame, tables: DataFrame, keys: list[str], images: DataFrame | None = None, content: str = "content") -> DataFrame:
    """(keys, prompt) for each page with tables. images (keys, id, text, table_candidate, promoted_table_id): candidates are listed."""
    asked = pages.select(*keys, content).join(tables.select(*keys).distinct(), keys, "left_semi")
    body = F.substring(F.coalesce(F.col(content), F.lit("")), 1, PAGE)
    if images is None:
        return asked.select(*keys, _lines(JUDGE, body).alias("prompt"))
    line = F.concat(F.lit("- "), "id", F.lit(": "), F.coalesce("text", F.lit("")))
    listed = images.where("table_candidate and promoted_table_id is null").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("__listed"))
    return asked.join(listed, keys, "left").select(*keys, _lines(JUDGE, body, F.when(F.col("__listed").isNotNull(), _lines(PICTURES, F.col("__listed")))).alias("prompt"))


def judge(pages: DataFrame, tables: DataFrame, keys: list[str], provider: Provider, images: DataFrame | None = None) -> DataFrame:
    """(doc, seq, VERDICT) of the replies, in the order of pages; for verdicts.merge and verdicts.promote. keys: doc and page number."""
    replies = cut(ask(judge_requests(pages, tables, keys, images), provider), "replies")
    v = replies.select(*keys, F.posexplode(verdicts.parse_reply(F.col("answer"))).alias("__k", "v"))
    return v.select(keys[0], (F.col(keys[1]).cast("long") * 100_000 + F.col("__k")).alias("seq"), "v.*")


def repair(tables: DataFrame, pages: DataFrame, keys: list[str], provider: Provider, fill_all: bool = False) -> DataFrame:
    """tables (keys, table_num, markdown, table_html, ...) with the repairs that pass: markdown, original_markdown, accepted. pages also have page_image_path."""
    jobs = verdicts.fill_jobs(tables.withColumn("__key", F.struct(*keys, "table_num")), pages, keys, fill_all)
    shown = F.when(F.col("evidence") == "html", F.col("table_html"))
    images = F.when(F.col("evidence") == "image", F.array("page_image_path"))
    answers = cut(ask(jobs.select("__key", _lines(REPAIR, F.col("reason"), F.col("markdown"), shown).alias("prompt"), images.alias("images")), provider), "answers")
    return verdicts.accept(tables.withColumn("__key", F.struct(*keys, "table_num")), answers, "__key").drop("__key")


def read_pictures(pages: DataFrame, images: DataFrame, keys: list[str], provider: Provider, least: float = gates.PICTURE, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(pages with what the pictures show after their placeholders, images with vlm_markdown). images (keys, id, placeholder, image_path, region_kind, ratio, vlm_markdown)."""
    some = images.where(gates.should_read_picture(F.col("vlm_markdown"), F.col("region_kind"), F.col("image_path"), F.col("ratio"), least))
    around = F.substring(F.coalesce(F.col(content), F.lit("")), 1, AROUND)
    asked = some.select(*keys, "id", "image_path").join(pages.select(*keys, around.alias("__around")), keys).select(*keys, "id", _lines(READ, F.col("__around")).alias("prompt"), F.array("image_path").alias("images"))
    answers = cut(ask(asked, provider), "pictures")
    good = F.when(gates.picture_answer_ok(F.col("answer")), X.strip_fences(F.col("answer")))
    said = answers.select(*keys, "id", good.alias("__said")).where("__said is not null")
    known = images.join(said, [*keys, "id"], "left")
    out = known.withColumn("vlm_markdown", F.coalesce("vlm_markdown", "__said")).drop("__said").select(*images.columns)
    new = known.where("__said is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "placeholder", "__said"))).alias("__new"))
    done = blocks.insert_all(F.col(content), F.transform("__new", lambda x: x["placeholder"]), F.transform("__new", lambda x: x["__said"]))
    return pages.join(new, keys, "left").withColumn(content, done).select(*pages.columns), out


def rebuild(tables: DataFrame, pages: DataFrame, keys: list[str], provider: Provider, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(tables, pages) with the tables of a structure_ratio rebuilt from their pages' images where the answer passes; their blocks are written anew."""
    broken = tables.where("coalesce(structure_ratio, 0) > 0").select(*keys, "table_num")
    around = F.substring(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), blocks.OPEN, ""), 1, AROUND)
    asked = broken.join(pages.where("page_image_path is not null").select(*keys, "page_image_path", around.alias("__around")), keys)
    answers = cut(ask(asked.select(F.struct(*keys, "table_num").alias("__key"), _lines(REBUILD, F.col("__around")).alias("prompt"), F.array("page_image_path").alias("images")), provider), "rebuilt")
    t = verdicts.accept(tables.withColumn("__key", F.struct(*keys, "table_num")).drop("original_markdown", "accepted"), answers, "__key").drop("__key")
    return t, synced(pages, t.where("accepted"), keys, content)


def synced(pages: DataFrame, tables: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """pages whose blocks of these tables hold the tables' Markdown."""
    new = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_num", "markdown"))).alias("__new"))
    done = F.aggregate(F.coalesce("__new", F.array().cast("array<struct<table_num:int,markdown:string>>")), F.col(content), lambda s, x: blocks.sync_block(s, x["table_num"], x["markdown"]))
    return pages.join(new, keys, "left").withColumn(content, done).select(*pages.columns)


def reread_pages(pages: DataFrame, fragments: DataFrame, page: str = "page", content: str = "content") -> DataFrame:
    """pages (page, content, wanted BOOLEAN) of which the wanted ones have their text from fragments (page, frag_no, text, box) if there is any; their table blocks follow it. page: a struct or a number."""
    read = boxes.page_text(fragments, page).select(page, X.normalize_pdf_text(F.col("text")).alias("__read"))
    kept = F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(blocks.BLOCK), F.lit(0))
    new = F.concat_ws("\n\n", F.col("__read"), F.when(F.size(kept) > 0, F.array_join(kept, "\n\n")))
    take = F.coalesce(F.col("wanted"), F.lit(False)) & (F.trim(F.coalesce("__read", F.lit(""))) != "")
    return pages.join(read, page, "left").withColumn("reread", take).withColumn(content, F.when(take, new).otherwise(F.col(content))).drop("__read")


def reread_tables(tables: DataFrame, cells: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """tables (key, n_rows, n_cols, markdown) with the cells' texts from fragments (key, frag_no, text, box) in their places; a table in which no cell changes stays as it is. n_changed BIGINT is added."""
    new = boxes.cell_texts(fragments, cells, key).select(key, "cell_no", F.col("text").alias("__new"))
    c = cells.join(new, [key, "cell_no"], "left").withColumn("__changed", (F.coalesce("__new", F.lit("")) != "") & ~F.col("__new").eqNullSafe(F.col("text")))
    c = cut(c.withColumn("text", F.when(F.col("__changed"), F.col("__new")).otherwise(F.col("text"))).drop("__new"), "cells")
    n = c.groupBy(key).agg(F.count_if("__changed").alias("n_changed"))
    drawn = grid.draw_positioned(tables, c, key).select(key, F.col("markdown").alias("__drawn"))
    t = tables.join(n, key, "left").join(drawn, key, "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0)).cast("long"))
    take = (F.col("n_changed") > 0) & (F.trim(F.coalesce("__drawn", F.lit(""))) != "")
    return t.withColumn("markdown", F.when(take, F.col("__drawn")).otherwise(F.col("markdown"))).drop("__drawn")


NODE = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("fact", T.StringType())]))


def outline_answers(pages: DataFrame, doc: str, provider: Provider) -> DataFrame:
    """(doc, page_no, node_no, path, fact) for outline.outline; pages (doc, page_no, content). Blank pages aren't asked for."""
    from . import outline

    shown = F.substring(F.coalesce("content", F.lit("")), 1, OUTLINE)
    asked = outline.with_context(pages, doc, BEFORE).where(~gates.blank(F.col("content"))).select(doc, "page_no", _lines(NODES, F.col("previous"), shown).alias("prompt"))
    answers = cut(ask(asked, provider), "nodes")
    listed = X.strip_fences(F.col("answer"), "json")
    nodes = F.from_json(F.when(F.try_parse_json(listed).isNotNull(), listed), NODE)
    trimmed = lambda p: F.filter(F.transform(p, lambda x: F.trim(x)), lambda x: x != "")
    return answers.select(doc, "page_no", F.posexplode(nodes).alias("node_no", "n")).select(doc, "page_no", "node_no", trimmed(F.col("n.path")).alias("path"), F.coalesce("n.fact", F.lit("")).alias("fact"))


def model_tables(tables: DataFrame, cells: DataFrame, doc: str, provider: Provider, always: bool = False) -> DataFrame:
    """(doc, table_num, markdown, way): tables (doc, table_num, chain, n_rows, n_cols, markdown) by a model that is given their cells, where that helps: a table that goes on on the next page (its chain has
    several), or of several header rows. cells (doc, table_num, cell_no, ..., text). An answer that loses more than a fifth of the cells' texts doesn't count; the fragments after the first go into it if it does.
    """
    key = F.struct(doc, "chain")
    heads = cells.where("column_header").groupBy(doc, "table_num").agg(F.countDistinct("row0").alias("__heads"))
    t = tables.join(heads, [doc, "table_num"], "left")
    several = F.count("*").over(Window.partitionBy(doc, "chain")) > 1
    t = t.withColumn("__several", several)
    c = cells.join(t.select(doc, "table_num", "chain"), [doc, "table_num"]).select(doc, "table_num", "chain", F.col("row0").alias("row"), F.col("col0").alias("col"), "text", F.col("row_span").alias("rowspan"), F.col("col_span").alias("colspan"), F.col("column_header").alias("is_header"))
    slim = grid.slim_cells(c.withColumn("__key", F.struct(doc, "table_num", "chain")), "__key").select("__key.*", "slim")
    lists = slim.groupBy(doc, "chain").agg(F.array_sort(F.collect_list(F.struct("table_num", "slim"))).alias("x")).select(key.alias("__key"), F.array_join(F.transform("x", lambda e: e["slim"]), "\n").alias("lists"))
    texts = c.groupBy(doc, "chain").agg(F.collect_set("text").alias("texts")).select(key.alias("__key"), "texts")
    first = t.groupBy(doc, "chain").agg(F.bool_or(gates.needs_table_model(F.lit(always), F.col("__several"), F.coalesce("__heads", F.lit(0)))).alias("ask"), F.bool_or("__several").alias("two")).where("ask").select(key.alias("__key"), "two")
    prompt = _lines(F.when(F.col("two"), TWO).otherwise(CELLS), F.col("lists"))
    answers = cut(ask(first.join(lists, "__key").select("__key", prompt.alias("prompt")), provider), "drawn").join(texts, "__key")
    md = X.strip_fences(F.col("answer"))
    good = answers.select("__key", F.when((F.trim(F.coalesce(md, F.lit(""))) != "") & gates.keeps_cells(F.col("texts"), blocks.cell_set(md)), md).alias("__md")).where("__md is not null")
    out = t.withColumn("__key", key).join(good, "__key", "left")
    head = F.col("table_num") == F.col("chain")
    return out.where(F.col("__md").isNull() | head).select(doc, "table_num", F.coalesce("__md", "markdown").alias("markdown"), F.when(F.col("__md").isNotNull(), "model").otherwise("cells").alias("way"))
