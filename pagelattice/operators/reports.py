"""Traces, statistics and reports. One grouped pass each; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gates
from ..functions.text import label_with_ratio

UNRATED = "미평가"
#: What a text source is called.
SOURCES = {"ocr": "OCR", "n/a": "해당 없음", "empty": "추출 실패", "mixed": "혼합", "text_layer": "텍스트 레이어", "unknown": "미상", "unmeasured": "미측정"}
#: Layout labels and outcomes in Korean.
LABELS = dict(x.split("=") for x in "text=본문;table=표;title=제목;picture=그림;section_header=절 제목;list_item=목록 항목;caption=캡션;footnote=각주;formula=수식;code=코드;form=양식;page_header=머리글;page_footer=바닥글;document_index=목차;key_value_region=키-값 영역;checkbox_selected=체크박스(선택);checkbox_unselected=체크박스(해제)".split(";"))
OUTCOMES = dict(x.split("=") for x in "text=본문에 포함;dropped=버려짐 (빈 내용);image=이미지로 저장;table=표로 변환".split(";"))
_SHOWN = ("text_layer", "ocr", "mixed", "empty")
_MARKS = dict(fail="x", skip="-", warn="!")


def lookup(code: Column, names: dict[str, str]) -> Column:
    """A code's name; a code without one as it is."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)


def in_order(order: str, value: Column | str, sep: str) -> Column:
    """Values joined in the order of a column."""
    v = F.col(value) if isinstance(value, str) else value
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda x: x["v"]), sep)


def assemble_pages(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content, n_text, n_tables, n_images) of parts (keys, item_order, outcome, md): a page's Markdown in order; dropped parts count nowhere."""
    shown = parts.where("outcome <> 'dropped'")
    n = lambda k: F.count_if(F.col("outcome") == k)
    return shown.groupBy(*keys).agg(in_order("item_order", "md", "\n\n").alias("content"), n("text").alias("n_text"), n("table").alias("n_tables"), n("image").alias("n_images"))


def text_sources(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_cells, text_source, ocr_ratio) of cells (keys, from_ocr BOOLEAN, null if unknown)."""
    t = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count("from_ocr").alias("known"), F.count_if(F.coalesce("from_ocr", F.lit(False))).alias("ocr"))
    source = F.when(F.col("known") == 0, "unmeasured").when(F.col("ocr") == 0, "text_layer").when(F.col("ocr") == F.col("known"), "ocr").otherwise("mixed")
    return t.select(*keys, "n_cells", source.alias("text_source"), F.when(F.col("known") > 0, F.col("ocr") / F.col("known")).alias("ocr_ratio"))


def timing_shares(timings: DataFrame, doc: str) -> DataFrame:
    """(doc, stage, seconds, share, total, is_top) of timings (doc, stage, seconds)."""
    t = timings.groupBy(doc, "stage").agg(F.sum("seconds").alias("seconds"))
    w = Window.partitionBy(doc)
    total = F.sum("seconds").over(w)
    top = F.row_number().over(w.orderBy(F.desc("seconds"), "stage")) == 1
    return t.select(doc, "stage", "seconds", F.when(total > 0, F.col("seconds") / total).otherwise(0.0).alias("share"), total.alias("total"), top.alias("is_top"))


def trace_log(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, log) of steps (keys, step_no, module, action, detail, status, duration_ms): a line for each step."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("step_no"))
    mark = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _MARKS.items() for x in kv)), F.col("status")), F.lit(" "))
    detail = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" — "), "detail")).otherwise("")
    took = F.when(F.col("duration_ms").isNotNull(), F.concat(F.lit("  ("), F.format_string("%.1fs", F.bround(F.col("duration_ms") / 1000, 1)), F.lit(")"))).otherwise("")
    line = F.concat(mark, F.lit(" "), F.col("n").cast("string"), F.lit(". "), F.rpad("module", F.greatest(F.lit(28), F.length("module")), F.lit(" ")), F.lit(" "), F.col("action"), detail, took)
    return steps.withColumn("n", n).groupBy(*keys).agg(in_order("n", line, "\n").alias("log"))


def page_summary() -> Column:
    """One line on how a page came about, of the columns of its trace."""
    some = lambda name, c: F.when(F.col(c) > 0, F.concat(F.lit(name), F.col(c).cast("string")))
    flag = lambda name, c: F.when(F.col(c), F.lit(name))
    source = F.when(F.col("text_source").isin(*_SHOWN), label_with_ratio(lookup(F.col("text_source"), SOURCES), F.col("text_source"), F.col("ocr_ratio")))
    again = F.when(F.size("refilled") > 0, F.concat(F.lit("재추출"), F.size("refilled").cast("string")))
    return F.concat_ws(" · ", "extractor", source, some("표", "table_count"), some("그림", "picture_count"), flag("렌더", "rendered"), flag("평가", "assessed"), again, flag("실패", "failed"))


def label_counts(items: DataFrame, doc: str) -> DataFrame:
    """(doc, label, label_ko, n, outcomes, rank): layout labels, commonest first, equals by first appearance."""
    t = items.groupBy(doc, "label").agg(F.count("*").alias("n"), F.min("item_order").alias("first"), F.array_join(F.array_sort(F.collect_set(lookup(F.col("outcome"), OUTCOMES))), ", ").alias("outcomes"))
    return t.select(doc, "label", lookup(F.col("label"), LABELS).alias("label_ko"), "n", "outcomes", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "first")).alias("rank"))


def document_summary(pages: DataFrame, tables: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """(doc, n_pages, n_chars, empty_pages, n_tables, n_filled, by_type, n_images)."""
    p = pages.groupBy(doc).agg(F.count("*").alias("n_pages"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"), F.array_join(F.array_sort(F.collect_list(F.when(gates.blank(F.col("content")), F.col("page_no")))), ",").alias("empty_pages"))
    k = tables.groupBy(doc, F.coalesce("content_type", F.lit(UNRATED)).alias("kind")).agg(F.count("*").alias("n"), F.count_if(gates.was_filled(F.col("original_markdown"), F.col("markdown"))).alias("filled"))
    t = k.groupBy(doc).agg(F.sum("n").alias("n_tables"), F.sum("filled").alias("n_filled"), F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit(" "), F.col("n").cast("string")))), ", ").alias("by_type"))
    i = images.groupBy(doc).agg(F.count("*").alias("n_images"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return p.join(t, doc, "left").join(i, doc, "left").select(doc, "n_pages", "n_chars", "empty_pages", zero("n_tables"), zero("n_filled"), F.coalesce("by_type", F.lit("")).alias("by_type"), zero("n_images"))


def batch_totals(documents: DataFrame, batch: str) -> DataFrame:
    """(batch, total, succeeded, failed) of documents (batch, error STRING, null if it went well)."""
    return documents.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def call_estimate(pages: DataFrame, outline: bool = False) -> DataFrame:
    """(n_assess, n_fill, n_pictures, n_outline, n_calls): the provider calls that documents would need; pages (n_tables, n_fillable, n_pictures)."""
    t = pages.agg(F.count_if(F.col("n_tables") > 0).alias("n_assess"), F.coalesce(F.sum("n_fillable"), F.lit(0)).alias("n_fill"), F.coalesce(F.sum("n_pictures"), F.lit(0)).alias("n_pictures"), (F.count("*") if outline else F.lit(0).cast("long")).alias("n_outline"))
    return t.withColumn("n_calls", F.col("n_assess") + F.col("n_fill") + F.col("n_pictures") + F.col("n_outline"))


def noise_counts(log: DataFrame, message: str = "message") -> DataFrame:
    """(key, n): warnings by their first 80 characters."""
    return log.groupBy(F.substring(message, 1, 80).alias("key")).agg(F.count("*").alias("n"))


def failed_pages(failures: DataFrame, doc: str) -> DataFrame:
    """(doc, failed_pages): distinct page numbers from zero on, ascending."""
    return failures.where("page_no >= 0").groupBy(doc).agg(F.array_sort(F.collect_set("page_no")).alias("failed_pages"))


def preview_coverage(preview: Column, body: Column) -> Column:
    """Which share of a document's letters its preview has, 1 at most."""
    letters = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[가-힣A-Za-z0-9]"))
    return F.when(letters(body) > 0, F.least(F.lit(1.0), letters(preview) / letters(body))).otherwise(F.when(letters(preview) > 0, 1.0).otherwise(0.0))


def glyph_suspects(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, char, total, line_head, ratio, rank) of lines (doc, line_no, text): syllables that stand alone three times or more, mostly at the head of a line, and are rarer in words. They are bullets that a font shows wrongly."""
    t = lines.select(doc, F.posexplode(F.filter(F.split(F.trim("text"), r"(?U)\s+"), lambda x: x != "")).alias("i", "token"))
    alone = F.col("token").rlike("^[가-힣]$")
    lone = t.where(alone).groupBy(doc, F.col("token").alias("char")).agg(F.count("*").alias("total"), F.count_if(F.col("i") == 0).alias("line_head"))
    inside = t.where(~alone).select(doc, F.explode(F.regexp_extract_all(F.col("token"), F.lit("[가-힣]"), F.lit(0))).alias("char")).groupBy(doc, "char").agg(F.count("*").alias("in_word"))
    ratio = F.col("line_head") / F.col("total")
    s = lone.join(inside, [doc, "char"], "left").where((F.col("total") >= 3) & (ratio >= 0.6) & (F.coalesce("in_word", F.lit(0)) <= F.col("total")))
    return s.select(doc, "char", "total", "line_head", ratio.alias("ratio"), F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(ratio), F.desc("total"), "char")).alias("rank"))


def document_markdown(pages: DataFrame, doc: str, title: str) -> DataFrame:
    """(doc, content): document.md of pages (doc, title, page_no, page_no_kind, content)."""
    head = F.when(F.col("page_no_kind") == "exact", F.concat(F.lit("페이지 "), F.col("page_no").cast("string"))).otherwise("문서 전체")
    body = F.when(gates.blank(F.col("content")), "_(내용 없음)_").otherwise(F.trim("content"))
    t = pages.groupBy(doc, title).agg(in_order("page_no", F.concat(F.lit("## "), head, F.lit("\n\n"), body), "\n\n").alias("b"))
    return t.select(doc, F.concat(F.lit("# "), title, F.lit("\n\n"), "b", F.lit("\n")).alias("content"))


def tables_markdown(tables: DataFrame, doc: str) -> DataFrame:
    """(doc, content): tables.md: the verdicts, then, for repaired tables (original_markdown), what stood there before and after."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("page_no", "id", "content_type", "quality", "title", "reason"))), F.lit(" |"))
    changed = gates.was_filled(F.col("original_markdown"), F.col("markdown")) if "original_markdown" in tables.columns else F.lit(False)
    before = F.col("original_markdown") if "original_markdown" in tables.columns else F.lit(None).cast("string")
    part = F.when(changed, F.concat(F.lit("\n\n## "), "id", F.lit("\n\n### before\n\n"), before, F.lit("\n\n### after\n\n"), "markdown"))
    t = tables.withColumn("o", F.struct("page_no", "table_num")).groupBy(doc).agg(in_order("o", row, "\n").alias("b"), in_order("o", F.coalesce(part, F.lit("")), "").alias("c"))
    return t.select(doc, F.concat(F.lit("| page | id | type | quality | title | reason |\n| --- | --- | --- | --- | --- | --- |\n"), "b", "c").alias("content"))


def nested_documents(documents: DataFrame, pages: DataFrame, tables: DataFrame, images: DataFrame, doc: str, slim: bool = False) -> DataFrame:
    """(doc, json): each document with its pages, tables and images as one JSON text; slim keeps what readers need."""
    tcols = ["id", "table_num", "title", "markdown"] if slim else [c for c in tables.columns if c not in (doc, "page_no")]
    icols = ["id", "description", "text"] if slim else [c for c in images.columns if c not in (doc, "page_no")]
    pcols = ["page_no", "content"] if slim else [c for c in pages.columns if c != doc]
    dcols = [c for c in documents.columns if c != doc and not (slim and c in ("pipeline", "timings"))]
    t = tables.groupBy(doc, "page_no").agg(F.array_sort(F.collect_list(F.struct("table_num", F.struct(*tcols).alias("x")))).alias("t"))
    i = images.groupBy(doc, "page_no").agg(F.array_sort(F.collect_list(F.struct("id", F.struct(*icols).alias("x")))).alias("i"))
    inner = lambda c: F.coalesce(F.transform(c, lambda y: y["x"]), F.array())
    p = pages.join(t, [doc, "page_no"], "left").join(i, [doc, "page_no"], "left")
    one = F.struct(*pcols, inner("t").alias("tables"), inner("i").alias("images"))
    p = p.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", one.alias("x")))), lambda y: y["x"]).alias("pages"))
    d = documents.join(p, doc, "left").withColumn("page_count", F.coalesce(F.size("pages"), F.lit(0)))
    return d.select(doc, F.to_json(F.struct(*dcols, "page_count", "pages")).alias("json"))


def with_page_stats(pages: DataFrame, stats: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """pages with text_source and ocr_ratio of stats (keys, ...) and page_image_path of images (keys, path); null where there is none. The first path of several counts."""
    one = images.groupBy(*keys).agg(F.min("path").alias("page_image_path"))
    return pages.join(stats.select(*keys, "text_source", "ocr_ratio"), keys, "left").join(one, keys, "left")


def used(pages: DataFrame, doc: str) -> DataFrame:
    """(doc, extractors, text_sources, notes) of pages (doc, page_no, extractor, text_source, notes ARRAY<STRING>): the distinct ones in order of their names, and the notes in order of pages."""
    notes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("notes", F.array().cast("array<string>")).alias("n")))), lambda x: x["n"]))
    return pages.groupBy(doc).agg(F.array_sort(F.collect_set("extractor")).alias("extractors"), F.array_sort(F.collect_set("text_source")).alias("text_sources"), notes.alias("notes"))


def pending(rows: DataFrame, doc: str, order: str, reason: str, most: int = 5) -> DataFrame:
    """(doc, text): the first reasons of each document, and how many more there are."""
    r = rows.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, reason))), lambda x: x[reason]).alias("r"))
    more = F.when(F.size("r") > most, F.concat(F.lit(" 외 "), (F.size("r") - most).cast("string"), F.lit("건"))).otherwise("")
    return r.select(doc, F.concat(F.array_join(F.slice("r", 1, most), "; "), more).alias("text"))


def label_distribution(items: DataFrame, doc: str) -> DataFrame:
    """(doc, text): a line with each layout label, its number and its share, commonest first."""
    counts = label_counts(items, doc)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(doc))
    line = F.concat(F.lit("- "), "label_ko", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.format_string("%.0f%%", F.bround(share * 100, 0)), F.lit(")"))
    return counts.withColumn("line", line).groupBy(doc).agg(in_order("rank", "line", "\n").alias("text"))


#: What extractors do, and where text comes from, for the legend of pipeline.md.
EXTRACTORS = {"hwp": "records of a binary file", "hwpx": "XML of an archive", "pdf": "text layer", "html": "HTML blocks", "ocr": "recognised lines"}
SOURCE_TEXTS = {"ocr": "all text was recognised", "mixed": "some text was recognised", "text_layer": "the text layer as it is", "empty": "nothing was found", "unmeasured": "cells weren't kept"}
#: Stages that a faster device shortens.
ON_DEVICE = ("PDF 추출",)


def pipeline_report(documents: DataFrame, settings: DataFrame, timings: DataFrame, pages: DataFrame, logs: DataFrame, doc: str) -> DataFrame:
    """(doc, content): pipeline.md of documents (doc, failed_pages ARRAY<INT>), settings (doc, name, value), timings (doc, stage, seconds), pages (doc, page_no, extractor, text_source, ocr_ratio, cell_count,
    table_count, picture_count, rendered, assessed, refilled ARRAY<STRING>, notes ARRAY<STRING>) and logs (doc, page_no, log). A part without rows is left out."""
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    s = lambda c: F.col(c).cast("string")
    set_ = settings.groupBy(doc).agg(in_order("name", text("| `", F.col("name"), "` | ", F.coalesce(s("value"), F.lit("-")), " |"), "\n").alias("__set"))
    t = timing_shares(timings, doc)
    gpu = F.when(F.col("stage").isin(*ON_DEVICE), "O").otherwise("X")
    row = text("| ", F.col("stage"), " | ", F.format_string("%.1f", F.bround("seconds", 1)), " | ", F.format_string("%.0f%%", F.bround(F.col("share") * 100, 0)), " | ", gpu, " |")
    t = t.where("total > 0").withColumn("o", F.struct(-F.col("seconds"), "stage")).groupBy(doc).agg(F.max("total").alias("__total"), in_order("o", row, "\n").alias("__times"))
    source = F.when(F.col("text_source").isin(*_SHOWN), label_with_ratio(lookup(F.col("text_source"), SOURCES), F.col("text_source"), F.col("ocr_ratio"))).otherwise(lookup(F.col("text_source"), SOURCES))
    yes = lambda c: F.when(F.col(c), "O").otherwise("-")
    again = F.when(F.size("refilled") > 0, F.size("refilled").cast("string")).otherwise("-")
    line = text("| ", F.concat_ws(" | ", s("page_no"), "extractor", source, F.coalesce(s("cell_count"), F.lit("-")), s("table_count"), s("picture_count"), yes("rendered"), yes("assessed"), again), " |")
    note = F.array_join(F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: text("\n- p.", s("page_no"), ": ", n)), "")
    legend = lambda c, names, texts: F.array_join(F.transform(F.array_sort(F.array_except(F.collect_set(c), F.array(F.lit("n/a")))), lambda x: text("- **", names(x), "** — ", F.coalesce(F.element_at(F.create_map(*(F.lit(y) for kv in texts.items() for y in kv)), x), F.lit("?")))), "\n")
    p = pages.groupBy(doc).agg(in_order("page_no", line, "\n").alias("__pages"), in_order("page_no", note, "").alias("__notes"), F.concat_ws("\n", legend("extractor", lambda x: x, EXTRACTORS), legend("text_source", lambda x: lookup(x, SOURCES), SOURCE_TEXTS)).alias("__legend"))
    g = logs.groupBy(doc).agg(in_order("page_no", text("### 페이지 ", s("page_no"), "\n\n```\n", F.col("log"), "\n```\n"), "\n").alias("__logs"))
    failed = F.when(F.size("failed_pages") > 0, text("\n- 빠진 페이지: ", F.array_join(F.transform("failed_pages", lambda x: x.cast("string")), ", ")))
    d = documents.select(doc, failed.alias("__failed")).join(set_, doc, "left").join(t, doc, "left").join(p, doc, "left").join(g, doc, "left")
    part = lambda head, c: F.when(F.col(c).isNotNull(), text(head, F.col(c)))
    notes = F.concat(F.coalesce("__failed", F.lit("")), F.coalesce("__notes", F.lit("")))
    return d.select(
        doc,
        F.concat(
            F.concat_ws(
                "\n\n",
                F.lit("# 처리 이력"),
                part("## 설정\n\n| 항목 | 값 |\n| --- | --- |\n", "__set"),
                F.when(F.col("__times").isNotNull(), text("## 소요 시간 (총 ", F.format_string("%.1f", F.bround("__total", 1)), "초)\n\n| 단계 | 초 | 비중 | GPU |\n| --- | --- | --- | --- |\n", F.col("__times"))),
                part("## 페이지\n\n| 페이지 | 추출기 | 출처 | 셀 | 표 | 그림 | 렌더 | 평가 | 재추출 |\n| --- | --- | --- | --- | --- | --- | --- | --- | --- |\n", "__pages"),
                F.when(notes != "", text("## 특이사항\n", notes)),
                part("## 로그\n\n", "__logs"),
                part("## 설명\n\n", "__legend"),
            ),
            F.lit("\n"),
        ).alias("content"),
    )


def layout_report(items: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """(doc, content): layout.md of items (doc, page_no, item_order, label, outcome, ref, text, box) and pairs (doc, page_no, a_order, b_order, ratio) that overlap: labels with their numbers and outcomes, what was dropped, the regions of each page."""
    text = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    s = lambda c: F.col(c).cast("string")
    counts = label_counts(items, doc).groupBy(doc).agg(in_order("rank", text("| ", F.col("label_ko"), " (`", F.col("label"), "`) | ", s("n"), " | ", F.col("outcomes"), " |"), "\n").alias("__labels"))
    n = lambda k: F.format_string("%.0f", F.bround(F.col(f"box.{k}"), 0))
    box = F.when(F.col("box").isNotNull(), F.concat_ws(",", *(n(k) for k in "ltrb"))).otherwise("-")
    body = F.coalesce("text", F.lit(""))
    row = text("| ", F.concat_ws(" | ", s("item_order"), lookup(F.col("label"), LABELS), box, F.length(body).cast("string"), lookup(F.col("outcome"), OUTCOMES), F.coalesce("ref", F.lit("-")), F.replace(body, F.lit("|"), F.lit("\\|"))), " |")
    page = items.groupBy(doc, "page_no").agg(in_order("item_order", row, "\n").alias("__rows"), F.count_if(F.col("outcome") == "dropped").alias("__dropped"))
    label = items.select(doc, "page_no", "item_order", lookup(F.col("label"), LABELS).alias("label"))
    named = pairs.join(label.select(doc, "page_no", F.col("item_order").alias("a_order"), F.col("label").alias("a")), [doc, "page_no", "a_order"]).join(label.select(doc, "page_no", F.col("item_order").alias("b_order"), F.col("label").alias("b")), [doc, "page_no", "b_order"])
    line = text("- #", s("a_order"), " ", F.col("a"), " ↔ #", s("b_order"), " ", F.col("b"), " (겹침 ", F.format_string("%.0f%%", F.bround(F.col("ratio") * 100, 0)), ")")
    over = named.withColumn("o", F.struct("a_order", "b_order")).groupBy(doc, "page_no").agg(in_order("o", line, "\n").alias("__over"))
    whole = text("### 페이지 ", s("page_no"), "\n\n| # | 라벨 | 좌표 | 글자수 | 처리 | 산출물 | 내용 |\n| --- | --- | --- | --- | --- | --- | --- |\n", F.col("__rows"), F.coalesce(text("\n\n", F.col("__over")), F.lit("")))
    p = page.join(over, [doc, "page_no"], "left").groupBy(doc).agg(in_order("page_no", whole, "\n\n").alias("__pages"), F.sum("__dropped").alias("__n"))
    dropped = F.when(F.col("__n") > 0, text("버려진 영역 ", s("__n"), "개"))
    return counts.join(p, doc).select(doc, F.concat(F.concat_ws("\n\n", F.lit("# 레이아웃"), text("## 라벨\n\n| 라벨 | 개수 | 처리 |\n| --- | --- | --- |\n", F.col("__labels")), dropped, F.col("__pages")), F.lit("\n")).alias("content"))
