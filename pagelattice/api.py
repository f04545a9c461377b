"""Façade: documents in, structured records out. `Batch` holds lazy DataFrames; files are written by sinks at the end."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import gates
from .functions import text as X
from .operators import blocks as B
from .operators import chunks, outline, previews, reports, stages, verdicts
from .providers import from_options
from .session import cut
from .sources import files, html, hwp, office, pdf, recognition

DOC = "path"


def _told(texts: DataFrame, errors: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, content, error) for each path: its text, or why there is none."""
    t = paths.select("path").distinct().join(texts.select("path", "content"), "path", "left").join(errors.groupBy("path").agg(F.min("error").alias("error")), "path", "left")
    some = F.trim(F.coalesce("content", F.lit(""))) != ""
    return t.select("path", F.when(some, F.col("content")).alias("content"), F.when(~some, F.coalesce("error", F.lit("no text"))).alias("error"))


@files.register_reader(".hwpx", ".hwpml")
def _office(found: DataFrame) -> DataFrame:
    b = cut(office.read_blocks(found), "blocks")
    return _told(office.to_markdown(b), b.where("kind = 'error'").select("path", F.col("text").alias("error")), found)


@files.register_reader(".hwp")
def _hwp(found: DataFrame) -> DataFrame:
    """Binary files; some are HWPML under this suffix."""
    xml = F.coalesce(F.decode(F.substring("content", 1, 512), "ISO-8859-1").contains("<HWPML"), F.lit(False))
    best = hwp.best(found.where(~xml))
    texts = best.select("path", F.col("text").alias("content"))
    return _told(texts, best.where("text is null").select("path", F.col("reason").alias("error")), found.where(~xml)).unionByName(_office(found.where(xml)))


@files.register_reader(".pdf")
def _pdf(found: DataFrame) -> DataFrame:
    """The text layers, pages cut by form feeds."""
    f = cut(pdf.fragments(found), "fragments")
    pages = pdf.pages(f).groupBy("path").agg(reports.in_order("page_no", "content", "\f").alias("content"))
    return _told(pages, f.where("error is not null").select("path", "error"), found)


@files.register_reader(".html", ".htm")
def _html(found: DataFrame) -> DataFrame:
    pages = found.select("path", F.decode("content", "UTF-8").alias("html"))
    return _told(html.render(html.page_blocks(pages), ["path"], "markdown"), found.where("content is null").select("path", F.lit("no content").alias("error")), found)


class Settings:
    """Options with checked names."""

    def __init__(self, **options: Any):
        self._own: dict[str, Any] = {}
        for k, v in options.items():
            self.set(k, v)

    def set(self, key: str, value: Any) -> Settings:
        self._own[config.check(key)] = value
        return self

    def get(self, key: str, otherwise: Any = None) -> Any:
        value = config.resolve(self._own)[config.check(key)]
        return otherwise if value is None else value

    def options(self) -> dict[str, Any]:
        return config.shown(config.resolve(self._own))


#: Columns of pictures beside the keys, and their kinds.
PICTURE = {"id": "string", "placeholder": "string", "description": "string", "text": "string", "table_candidate": "boolean", "promoted_table_id": "string", "region_kind": "string", "ratio": "double", "image_path": "string", "vlm_markdown": "string"}
KEYS = [DOC, "page_no"]
_log = logging.getLogger("pagelattice")


def _shaped(df: DataFrame | None, spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    """The keys and these columns of a table; null for those that it lacks. No table, no rows."""
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in {DOC: "string", "page_no": "int", **columns}.items()))
    return df.select(F.col(DOC).cast("string"), F.col("page_no").cast("int"), *(F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()))


class Batch(Settings):
    """A folder, files or a table of pages (path, page_no, content), structured together.

    Models are providers: judge, repair, reader (of pictures), rebuilder (of broken tables), outliner, and a recogniser of pages' pictures; those that aren't
    given come from the options that name addresses, if any. Tables of what only other packages find may be given: images (path, page_no and
    PICTURE's columns), page_images (path, page_no, page_image_path, image BINARY), gaps (path, table_num, structure_ratio), html_tables (path, position, html).

    A file that can't be read is a failure and doesn't end the batch, unless stop_on_error.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: str | list[str] | DataFrame,
        judge: Callable | None = None,
        repair: Callable | None = None,
        glob: str | None = None,
        reader: Callable | None = None,
        rebuilder: Callable | None = None,
        outliner: Callable | None = None,
        recogniser: Callable | None = None,
        images: DataFrame | None = None,
        page_images: DataFrame | None = None,
        gaps: DataFrame | None = None,
        html_tables: DataFrame | None = None,
        **options: Any,
    ):
        super().__init__(**options)
        self.spark, self.sources, self.glob = spark, sources, glob
        made = from_options(config.resolve(self._own))
        self.judge, self.repair, self.outliner = judge or made["text"], repair or made["text"], outliner
        self.reader, self.rebuilder, self.recogniser = reader or made["picture"], rebuilder or made["picture"], recogniser
        self._images, self._page_images, self._gaps, self._html = images, page_images, gaps, html_tables
        self._run: dict[str, DataFrame] = {}

    def reset(self) -> None:
        self._run = {}

    def _say(self, stage: str) -> None:
        if self.get("progress"):
            _log.info("%s", stage)

    def _read(self, stop_on_error: bool) -> tuple[DataFrame, DataFrame]:
        """(pages, failures)."""
        failures = self.spark.createDataFrame([], "path string, error string")
        if isinstance(self.sources, DataFrame):
            return self.sources.select(DOC, "page_no", "content"), failures
        found = files.scan(self.spark, self.sources, suffixes=tuple(files.supported()), glob=self.glob)
        text = cut(files.read(found), "texts")
        failures = text.where("error is not null").select("path", "error")
        if stop_on_error and (bad := failures.first()):
            raise OSError(f"can't read {bad['path']}: {bad['error']}")
        return chunks.split_breaks(text.where("error is null").select("path", "content").withColumn("n", F.lit(1)), DOC, "n"), failures

    def run(self, stop_on_error: bool = False) -> Batch:
        """Read, number the tables, read pages and pictures again, judge, promote, repair, cut long pages. Each stage that providers answer in is written once."""
        if self._run:
            return self
        self._say("reading")
        pages, failures = self._read(stop_on_error)
        # rows of tables are left as they are
        prose = lambda x: F.when(x.startswith("|"), x).otherwise(X.collapse_even_spacing(x))
        pages = pages.withColumn("content", X.by_line(X.collapse_vertical_text(X.map_pua(F.col("content"))), prose))
        pages, tables = B.inject(pages, DOC, "page_no")
        pages, tables = cut(pages, "pages"), cut(tables, "tables")
        images = _shaped(self._images, self.spark, PICTURE)
        shown = _shaped(self._page_images if self.get("render_pages") else None, self.spark, {"page_image_path": "string", "image": "binary"})
        paths = shown.groupBy(*KEYS).agg(F.min("page_image_path").alias("page_image_path"))
        if self.recogniser is not None and self._page_images is not None and self.get("korean_ocr"):
            self._say("recognising")
            key = F.struct(*KEYS)
            need = pages.select(key.alias("page"), "content", F.lit(True).alias("wanted") if self.get("force_full_page_ocr") else gates.needs_ocr(F.col("content")).alias("wanted"))
            asked = shown.select(key.alias("page"), "image").join(need.where("wanted").select("page"), "page", "left_semi")
            lines = cut(recognition.lines(asked, self.recogniser, scale=self.get("render_scale")), "lines")
            pages = cut(stages.reread_pages(need, lines).select("page.*", "content"), "pages")
        pages = pages.join(paths, KEYS, "left")
        if self._gaps is not None and self.get("flag_broken_tables"):
            tables = tables.join(self._gaps.select(DOC, "table_num", "structure_ratio"), [DOC, "table_num"], "left")
            if self.rebuilder is not None and self.get("vlm_fix_tables"):
                self._say("rebuilding tables")
                tables, pages = stages.rebuild(tables, pages, KEYS, self.rebuilder)
                tables, pages = cut(tables.drop("accepted"), "tables"), cut(pages, "pages")
        if self.reader is not None and self._images is not None and self.get("read_pictures"):
            self._say("reading pictures")
            pages, images = stages.read_pictures(pages, images, KEYS, self.reader, self.get("picture_area_threshold"))
            pages, images = cut(pages, "pages"), cut(images, "images")
        judged = self.judge is not None and self.get("assess_tables")
        if judged:
            self._say("judging tables")
            v = cut(stages.judge(pages, tables, KEYS, self.judge, images if self._images is not None else None), "verdicts")
        else:
            v = self.spark.createDataFrame([], f"{DOC} string, seq long, id string, content_type string, quality string, title string, group_image_ids array<string>, reason string")
        tables = cut(verdicts.merge(tables, v, DOC, judged), "tables")
        if judged and self._images is not None:
            new = cut(verdicts.promote(images, tables, v, DOC), "promoted")
            content = verdicts.promoted_pages(pages, new, images, KEYS)
            pages = cut(pages.drop("content").join(content, KEYS), "pages")
            tables, images = verdicts.with_promoted(tables, new, images, KEYS)
            tables, images = cut(tables, "tables"), cut(images, "images")
        if self._html is not None and self.get("hwp_fill_html"):
            tables = verdicts.with_html(tables, self._html, DOC)
        elif "table_html" not in tables.columns:
            tables = tables.withColumn("table_html", F.lit(None).cast("string"))
        before = "original_markdown" in tables.columns
        if self.repair is not None and self.get("fill_tables"):
            self._say("repairing tables")
            kept = tables.withColumnRenamed("original_markdown", "__before") if before else tables.withColumn("__before", F.lit(None).cast("string"))
            tables = stages.repair(kept, pages, KEYS, self.repair, self.get("fill_all")).withColumn("original_markdown", F.coalesce("__before", "original_markdown")).drop("__before")
        elif not before:
            tables = tables.withColumn("original_markdown", F.lit(None).cast("string"))
        tables = cut(tables.drop("table_html"), "tables")
        content, tables, groups = B.apply_verdicts(pages, tables, KEYS)
        images = images.unionByName(_shaped(groups, self.spark, PICTURE)).drop("__none")
        tables, images = cut(tables, "tables"), cut(images, "images")
        done = B.expand(content, tables.where("original_markdown is not null"), images, KEYS)
        if (most := self.get("split_chars")) > 0:
            done = chunks.chunk(done, DOC, "page_no", most).select(DOC, F.col("chunk_no").alias("page_no"), "content")
        done = cut(done, "done")
        nodes = None
        if self.outliner is not None:
            named = done.withColumnRenamed(DOC, "doc")  # path is the headings' there
            nodes = outline.outline(named, stages.outline_answers(named, "doc", self.outliner), "doc")
        self._run = {"pages": done, "tables": tables, "images": images, "failures": failures} | ({} if nodes is None else {"nodes": cut(nodes, "nodes")})
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("pages", "tables", "images", "failures", "nodes"):
            run = self.run()._run
            if name in run:
                return run[name]
        raise AttributeError(name)

    def paths(self) -> DataFrame:
        """(path) of what was read, in order."""
        return self.pages.select(DOC).distinct().orderBy(DOC)

    def totals(self) -> DataFrame:
        """(total, succeeded, failed) documents."""
        d = self.pages.select(DOC).distinct().withColumn("error", F.lit(None).cast("string")).unionByName(self.failures.select(DOC, "error"))
        return reports.batch_totals(d.withColumn("batch", F.lit(0)), "batch").drop("batch")

    def summary(self) -> DataFrame:
        """One row for each document."""
        return reports.document_summary(self.pages, self.tables, self.images, DOC)

    def to_json(self, slim: bool = False) -> DataFrame:
        """(path, json)."""
        d = self.pages.select(DOC).distinct().withColumn("filename", F.regexp_extract(DOC, r"[^/]*$", 0))
        return reports.nested_documents(d, self.pages, self.tables, self.images, DOC, slim)

    def save(self, out: str | None = None, slim: bool = False, unique: bool = False) -> str:
        """json, markdown, tables, summaries (and outlines) as folders below out (by default the option out_dir), failures beside them; unique: in a folder of its own if out is there already."""
        out = out or self.get("out_dir")
        if not out:
            raise ValueError("no folder to save to")
        if unique:
            out = _free(self.spark, out)
        self.to_json(slim).write.mode("overwrite").json(f"{out}/json")
        named = self.pages.withColumn("title", F.regexp_extract(DOC, r"[^/]*$", 0)).withColumn("page_no_kind", F.lit("chunk" if self.get("split_chars") else "exact"))
        reports.document_markdown(named, DOC, "title").write.mode("overwrite").json(f"{out}/markdown")
        reports.tables_markdown(self.tables, DOC).write.mode("overwrite").json(f"{out}/tables")
        previews.summary_lines(self.summary(), DOC).write.mode("overwrite").json(f"{out}/summary")
        self.failures.write.mode("overwrite").json(f"{out}/failures")
        if "nodes" in self._run:
            outline.to_markdown(self.nodes, "doc").write.mode("overwrite").json(f"{out}/outline")
        return out


def _free(spark: SparkSession, out: str) -> str:
    """The path, or the first of path-2, path-3 ... that isn't there."""
    path, n = out.rstrip("/"), 1
    while True:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
        n += 1
        path = f"{out.rstrip('/')}-{n}"


class Document(Batch):
    """One document, small enough for the driver to give it as a mapping; a folder is an error."""

    def __init__(self, spark: SparkSession, source: str, **options: Any):
        at = spark._jvm.org.apache.hadoop.fs.Path(source)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at) and fs.getFileStatus(at).isDirectory():
            raise IsADirectoryError(f"{source} is a folder; Batch takes folders")
        super().__init__(spark, source, **options)

    def run(self, stop_on_error: bool = True) -> Document:
        super().run(stop_on_error)
        return self

    def to_json_str(self, slim: bool = False) -> str:
        return self.to_json(slim).first()["json"]

    def to_dict(self, slim: bool = False) -> dict[str, Any]:
        return json.loads(self.to_json_str(slim))

    @staticmethod
    def from_dict(spark: SparkSession, document: dict[str, Any]) -> Batch:
        """A batch of the pages of a document that to_dict gave."""
        rows = [(document.get("filename") or "document", int(p["page_no"]), p.get("content")) for p in document.get("pages", [])]
        return Batch(spark, spark.createDataFrame(rows, f"{DOC} string, page_no int, content string"), assess_tables=False, fill_tables=False)


def structure(spark: SparkSession, source: str, **options: Any) -> Document:
    """One document; an error if it can't be read."""
    return Document(spark, source, **options).run()


def structure_to_json(spark: SparkSession, source: str, slim: bool = False, **options: Any) -> str:
    return structure(spark, source, **options).to_json_str(slim)


def configure(**options: Any) -> dict[str, Any]:
    """Options for this process from here on (through its environment); the resolved ones, secrets masked."""
    for k, v in options.items():
        name = config.PREFIX + config.check(k).upper()
        if v is None:
            os.environ.pop(name, None)
        else:
            os.environ[name] = str(v)
    return config.shown(config.resolve())


def set_api_key(key: str, which: str = "llm_key") -> str:
    """Keep a key for this process; how it may be shown."""
    if which not in config.SECRETS:
        raise KeyError(f"{which!r} isn't a key; there are {', '.join(sorted(config.SECRETS))}")
    configure(**{which: key})
    return config.mask(key)


def enable_logging(level: int = logging.INFO) -> logging.Logger:
    """Messages of this package on the error output, once."""
    if not _log.handlers:
        _log.addHandler(logging.StreamHandler())
    _log.setLevel(level)
    return _log
