"""Quality gates and other predicates as Column expressions. Null inputs give false, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4 = 595.0 * 842.0


def usable_text_layer(text: Column) -> Column:
    """Whether a page's text layer can be used: 15 letters or more, and these are three tenths of what isn't markup, address or blank."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), r"(?U)https?://\S+", ""), r"(?U)\s", "")
    words = F.regexp_count(bare, F.lit("[가-힣A-Za-z]"))
    return (words >= 15) & (words / F.greatest(F.length(bare), F.lit(1)) >= 0.3)


def needs_ocr(text: Column) -> Column:
    return ~usable_text_layer(text)


def blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s", "") == "", F.lit(True))


def render_target(n_tables: Column, all_pages: bool = False, only: list[int] | None = None, page_no: Column | None = None) -> Column:
    """Pages that are rendered: those with tables; with all_pages also the listed ones, or all."""
    extra = F.lit(all_pages) if only is None or page_no is None else F.lit(all_pages) & page_no.isin(only)
    return (n_tables > 0) | extra


def suspiciously_empty(n_chars: Column, n_tables: Column) -> Column:
    return (n_chars < 50) & (n_tables == 0)


def needs_fill(content_type: Column, quality: Column) -> Column:
    return F.coalesce((content_type == "table") & quality.isin("wrong", "insufficient"), F.lit(False))


def was_filled(original: Column, markdown: Column) -> Column:
    return F.coalesce((original != "") & ~original.eqNullSafe(markdown), F.lit(False))


def table_candidate(chars: Column, lines: Column) -> Column:
    return F.coalesce((chars >= 80) & (lines >= 3), F.lit(False))


def preview_usable(coverage: Column) -> Column:
    """Whether a preview has four fifths or more of the body's letters."""
    return F.coalesce(coverage >= 0.8, F.lit(False))


def pages_needing_ocr(text: Column, readable: Column, page_no: Column, n_pages: Column) -> Column:
    """No usable text layer, an unreadable page, or one beyond the file; what isn't known counts as needed."""
    return ~F.coalesce(usable_text_layer(text) & readable & (page_no >= 1) & (page_no <= n_pages), F.lit(False))


def ocr_lines_kept(score: Column, text: Column, least: float = 0.7) -> Column:
    """Recognised lines that count: sure enough, and not noise."""
    return F.coalesce(score >= least, F.lit(False)) & ~ocr_noise(text)


def area_ratio(l: Column, t: Column, r: Column, b: Column) -> Column:
    """A box's share of an A4 page; 1 without a box."""
    return F.coalesce(F.least(F.lit(1.0), F.abs(r - l) * F.abs(b - t) / A4), F.lit(1.0))


#: The share of its page from which a picture is read.
PICTURE = 0.03


def should_read_picture(vlm_markdown: Column, region_kind: Column, path: Column, ratio: Column, least: float = PICTURE) -> Column:
    """Pictures that are in a file, aren't known to be something else, weren't read yet and aren't too small; a null ratio is large enough."""
    return vlm_markdown.isNull() & (region_kind.isNull() | (region_kind == "image")) & path.isNotNull() & (F.coalesce(ratio, F.lit(1.0)) >= least)


def picture_answer_ok(answer: Column) -> Column:
    return F.coalesce((F.length(answer) >= 20) & (answer != "내용 없음"), F.lit(False))


def looks_like_table(markdown: Column) -> Column:
    """Three lines or more that begin with a pipe, one of them a separator."""
    rows = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    return (F.size(rows) >= 3) & F.exists(rows, lambda x: x.rlike(r"^[|\-: ]+$"))


def rebuild_accepted(candidate: Column, original: Column) -> Column:
    c = F.coalesce(candidate, F.lit(""))
    return (F.length(c) >= 20) & looks_like_table(c) & (F.length(c) >= 0.6 * F.length(F.coalesce(original, F.lit(""))))


def html_conversion_verdict(size: Column, body: Column, cells: Column, filled: Column, field_warning: Column) -> Column:
    """Why an HTML conversion lost content; null if it didn't."""
    return (
        F.when(field_warning & (filled >= 10), F.lit(None).cast("string"))
        .when((size > 10000) & (body < 500), "little text for its size")
        .when((cells >= 10) & (filled <= F.greatest(F.lit(3), F.floor(cells / 6))), "most cells are empty")
        .when(field_warning & (body < 1000), "fields were lost")
    )


def known_bullets(text: Column) -> Column:
    return F.coalesce(text.rlike("[□■◆○●◎※▪▫◦·∙–—*▸▷➔→-]"), F.lit(False))


def ocr_noise(text: Column, unknown_share: Column | None = None) -> Column:
    """Blank, or two fifths or more of its morphemes unknown to the analyser, if one ran."""
    return blank(text) if unknown_share is None else blank(text) | F.coalesce(unknown_share >= 0.4, F.lit(False))


def spread_enough(last: Column, count: Column, total: Column, want: Column) -> Column:
    return (total > 0) & (last > total * 0.5) & (count >= want)


def keeps_cells(source: Column, output: Column) -> Column:
    """Whether an answer keeps four fifths of the source cells that have two Hangul syllables together (arrays of texts)."""
    key = F.array_distinct(F.filter(source, lambda c: c.rlike("[가-힣]{2}")))
    return (F.size(key) == 0) | (F.size(F.array_except(key, output)) <= 0.2 * F.size(key))


def text_density(text: Column) -> tuple[Column, Column, Column]:
    """(characters that aren't blank, lines that aren't blank, a sample of sixty characters) of a region's text."""
    from .text import preview_text

    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s", "") != "")
    return F.length(F.regexp_replace(t, r"(?U)\s", "")), F.size(lines), preview_text(t)


def needs_table_model(mode_always: Column, is_split_head: Column, n_header_rows: Column) -> Column:
    """Tables that are rebuilt by a model: always, or heads of split tables and those with several header rows."""
    return F.coalesce(mode_always | is_split_head | (n_header_rows >= 2), F.lit(False))


def picture_report(ratio: Column, threshold: float, description: Column) -> Column:
    """A picture's share of its page, whether it is too small to be described, and whether it has a description."""
    return F.struct(F.bround(ratio, 4).alias("area_fraction"), (ratio < threshold).alias("skipped"), (F.trim(F.coalesce(description, F.lit(""))) != "").alias("described"))
