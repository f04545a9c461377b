"""Text normalisation as Column expressions. All of them give null for null."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HANGUL = "가-힣"
#: Code in hexadecimal and symbol: U+F000 plus the code, and supplementary code points.
_SYMBOLS = (
    "22✂ 36⌛ 45☜ 46☞ 47☝ 48☟ 4A☺ 4E☠ 52☼ 54❄ 58✠ 59✡ 6C● 6D● 6E■ 6F□ 70□ 71□ 72□ 73⬧ 74⧫ 75◆ 76❖ 77⬥ 9E· 9F• A0· A1⚪ A2○ A3○ A4◉ A5◎ A7▪ A8◻ "
    "AA✦ AB★ AC✶ AD✴ AE✹ E8➔ EF⇦ F0⇨ F1⇧ F2⇩ FB✗ FC✔ FD☒ FE☑"
)
_WIDE_SYMBOLS = "F003B↓ F00DA▸ F02EF· F03C5□ F080F━ F0827■ F0854《 F0855》"
PUA = {chr(0xF000 + int(x[:-1], 16)): x[-1] for x in _SYMBOLS.split()} | {chr(int(x[:-1], 16)): x[-1] for x in _WIDE_SYMBOLS.split()}

_W = r"(?U)"  # white space, digits and words as Unicode has them


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_pua(text: Column) -> Column:
    """Private-use symbols of word processors as the characters they show; unknown ones stay."""
    return F.translate(text, "".join(PUA), "".join(PUA.values()))


def replace_matches(text: Column, pattern: str, f) -> Column:
    """text with each match m of the pattern replaced by f(m): what lies between the matches, interleaved with the results."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(f(m), F.lit(""))))
    return F.array_join(parts, "")


def collapse_even_spacing(line: Column) -> Column:
    """A line of three or more single characters is joined; in other lines, runs of three or more spaced single Hangul syllables or digits are."""
    tokens = F.filter(F.split(line, " "), lambda t: t != "")
    whole = (F.size(tokens) >= 3) & F.forall(tokens, lambda t: F.length(t) == 1) & line.contains(" ")
    unit = rf"[{HANGUL}\p{{Nd}}]"
    part = replace_matches(line, rf"(?<!{unit}){unit}(?: {unit}){{2,}}(?!{unit})", lambda m: F.replace(m, F.lit(" "), F.lit("")))
    return F.when(whole, F.array_join(tokens, "")).otherwise(part)


def collapse_vertical_text(text: Column) -> Column:
    """Runs of three or more lines of one Hangul syllable or digit each become one line; shorter runs lose the white space around."""
    single = rf"[^\S\n]*[{HANGUL}0-9][^\S\n]*"
    run = rf"{_W}(?<![^\n]){single}(?:\n{single})*(?![^\n])"

    def joined(m: Column) -> Column:
        lines = F.transform(F.split(m, "\n"), lambda x: F.regexp_replace(x, rf"{_W}\s", ""))
        return F.when(F.size(lines) >= 3, F.array_join(lines, "")).otherwise(F.array_join(lines, "\n"))

    return replace_matches(text, run, joined)


def by_line(text: Column, f) -> Column:
    """f applied to each line."""
    return F.array_join(F.transform(F.split(text, "\n"), f), "\n")


_CLOSERS = r"!?:;.,»｝］）｣〕】』」》〉})\]"
_OPENERS = r"«｛［（｢〔【『「《〈{(\["
_DOTS = "·‧・"


def tighten_punctuation(line: Column) -> Column:
    """Spaces that fonts leave around punctuation go; a bullet at the start keeps its space."""
    lead = F.regexp_extract(line, rf"{_W}^\s*[{_DOTS}][ \t]+", 0)
    out = F.substr(line, F.length(lead) + 1)
    for pattern, by in (
        (rf"[ \t]+(?=[{_CLOSERS}])", ""),
        (rf"{_W}(?<=[\w{HANGUL}])[ \t]+(?=[(（])", ""),
        (rf"{_W}(?<=\d)[ \t]+(?=[년월일명급개원건배쪽점차호])", ""),
        (rf"(?<=[{_OPENERS}])[ \t]+", ""),
        (rf"{_W}[ \t]*([{_DOTS}])[ \t]*(?=\S)", "$1"),
        (r"[ \t]{2,}", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.concat(lead, out)


def _shorten(tokens: list[str], least: int = 3) -> list[str]:
    out, i, n = [], 0, len(tokens)
    where: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        where.setdefault(t, []).append(k)
    import bisect

    while i < n:
        places = where[tokens[i]]
        step = 1
        a = bisect.bisect_right(places, i)
        b = bisect.bisect_right(places, i + (n - i) // least)
        for k in range(b - 1, a - 1, -1):  # a unit can only end where its first token comes again
            size = places[k] - i
            if tokens[i + size : i + 2 * size] == tokens[i : i + size] == tokens[i + 2 * size : i + 3 * size]:
                times = 3
                while tokens[i + times * size : i + (times + 1) * size] == tokens[i : i + size]:
                    times += 1
                out += tokens[i : i + size]
                step = times * size
                break
        else:
            out.append(tokens[i])
        i += step
    return out


@F.pandas_udf(T.StringType())
def collapse_repeated_words(line: pd.Series) -> pd.Series:
    """A phrase that stands three or more times in a row stands once; the longest phrase first. Lines of fewer than three words stay."""
    def one(s):
        tokens = None if s is None else s.split()
        return s if tokens is None or len(tokens) < 3 else " ".join(_shorten(tokens))

    return line.map(one)


@F.pandas_udf(T.StringType())
def collapse_repeats_by_line(text: pd.Series) -> pd.Series:
    """collapse_repeated_words for each line of a text."""
    def one(s):
        if s is None:
            return None
        return "\n".join(x if len(t := x.split()) < 3 else " ".join(_shorten(t)) for x in s.split("\n"))

    return text.map(one)


def normalize_text(text: Column, collapse: bool = True) -> Column:
    """Symbols mapped; with collapse also vertical and evenly spaced text joined."""
    out = map_pua(text)
    return by_line(collapse_vertical_text(out), collapse_even_spacing) if collapse else out


def normalize_pdf_text(text: Column) -> Column:
    """normalize_text, then punctuation and repeated phrases, line by line."""
    return collapse_repeats_by_line(by_line(normalize_text(text), tighten_punctuation))


def normalize_line(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview_text(text: Column, limit: int = 60) -> Column:
    """One line of at most limit characters, cut with an ellipsis."""
    flat = normalize_line(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def strip_fences(text: Column, kinds: str = "markdown|gfm|md|json") -> Column:
    """The content of a fenced reply."""
    t = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(t, rf"(?U)^```(?:{kinds})?\s*", ""), r"(?U)\s*```$", "")
    return F.when(t.startswith("```"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "")).otherwise(t)


def bullet_to_md(text: Column) -> Column:
    """A dash bullet as a second-level list item, other bullets as a first-level one."""
    dash, dot = r"(?U)^\s*[-–—]\s+", r"(?U)^\s*[□■▪◇◆○●◦•▷▶]\s*"
    rest = lambda p: F.trim(F.regexp_replace(text, p, ""))
    return F.when(text.rlike(dash), F.concat(F.lit("  - "), rest(dash))).when(text.rlike(dot), F.concat(F.lit("- "), rest(dot))).otherwise(text)


def bullet_depth(text: Column) -> Column:
    """Depth 0 to 3 of the bullet that a line begins with; null without one."""
    mark = F.regexp_extract(text, r"(?U)^\s*([◆■□◎●○=*·▪∙–▷▸\-])\s", 1)
    at = lambda s: F.lit(s).contains(mark) & (mark != "")
    return F.when(at("□■◆"), 0).when(at("○●◎"), 1).when(at("-–∙▪·="), 2).when(at("*▸▷"), 3)


def numbered_heading_level(text: Column) -> Column:
    """1 for part and chapter headings, 2 for sections and Roman numerals, of at most 60 characters."""
    short = F.length(text) <= 60
    return F.when(short & text.rlike(r"(?U)^\s*제\s*\d+\s*[편장]"), 1).when(short & (text.rlike(r"(?U)^\s*제\s*\d+\s*절") | text.rlike(r"(?U)^\s*[Ⅰ-Ⅹ]\s*[.．]")), 2)


STYLE_LEVELS = {f"개요 {n}": n for n in range(1, 6)} | {"작은제목": 3, "중간제목": 2, "큰제목": 1, "제목": 1}


def style_heading_level(style: Column) -> Column:
    """Heading level of a style: exact names first, then the longest name that the style begins with; null for others."""
    out = F.lit(None).cast("int")
    for name in sorted(STYLE_LEVELS, key=len):
        out = F.when(style.startswith(name), STYLE_LEVELS[name]).otherwise(out)
    for name, level in STYLE_LEVELS.items():
        out = F.when(style == name, level).otherwise(out)
    return out


def emphasize(text: Column, bold: Column, italic: Column) -> Column:
    """Asterisks for bold and italic, unless the text has them already."""
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    done = text.startswith("*") | text.endswith("*") | (F.trim(text) == "")
    return F.when(done, text).otherwise(F.concat(mark, text, mark))


def escape_cell(text: Column) -> Column:
    """Pipes escaped, line ends as spaces."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _wide_class() -> str:
    """A character class of all wide and full-width characters, as ranges."""
    out, start, before = [], None, None
    for c in range(sys.maxunicode + 2):
        wide = c <= sys.maxunicode and unicodedata.east_asian_width(chr(c)) in "WF" and not 0xD800 <= c < 0xE000
        if wide and start is None:
            start = c
        elif not wide and start is not None:
            out.append(rf"\x{{{start:X}}}-\x{{{c - 1:X}}}")
            start = None
    return "[" + "".join(out) + "]"


_WIDE: list[str] = []


def display_width(text: Column) -> Column:
    """Columns that a text takes: two for a wide character."""
    if not _WIDE:
        _WIDE.append(_wide_class())
    # only texts beyond ASCII are searched for wide characters
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.length(text) + F.regexp_count(text, F.lit(_WIDE[0]))).cast("int")


def mask_secret(value: Column) -> Column:
    """The first six and last four characters; all stars, if there are no more than ten."""
    return F.when(F.length(value) > 10, F.concat(F.substring(value, 1, 6), F.lit("…"), F.right(value, F.lit(4)))).when(F.length(value) > 0, F.repeat(F.lit("*"), F.length(value))).otherwise("")


def safe_file_stem(name: Column) -> Column:
    """A file name's stem with everything but letters, digits, dots, dashes and underscores as underscores; 'document' for none."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    out = F.regexp_replace(F.regexp_replace(stem, rf"[^0-9A-Za-z{HANGUL}._-]+", "_"), r"^_+|_+$", "")
    return F.when(out == "", "document").otherwise(out)


def label_with_ratio(label: Column, source: Column, ratio: Column) -> Column:
    """A text source's label, with the share in percent for those that have one."""
    share = F.concat(F.lit(" "), F.format_string("%.0f%%", F.bround(ratio * 100, 0)))
    return F.concat(label, F.when(source.isin("ocr", "mixed") & ratio.isNotNull(), share).otherwise(""))


def is_field_payload(text: Column) -> Column:
    """Serialised form fields that aren't text."""
    t = F.trim(text)
    return t.contains('"simplefields"') & t.startswith("{") & t.endswith("}")


def is_bold_block(text: Column) -> Column:
    """More than two pairs of asterisks around something."""
    return (F.length(text) > 4) & text.startswith("**") & text.endswith("**")


def merge_bold_runs(blocks: Column) -> Column:
    """A cell's blocks as one string: neighbouring bold blocks share their asterisks."""
    clean = F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: b != "")
    inner = lambda b: F.substr(b, F.lit(3), F.length(b) - 4)
    # a bold block opens a run unless one stands before it, and closes it unless one follows
    piece = F.transform(
        clean,
        lambda b, i: F.when(
            is_bold_block(b),
            F.concat(
                F.when((i > 0) & F.coalesce(is_bold_block(F.get(clean, i - 1)), F.lit(False)), "").otherwise("**"),
                inner(b),
                F.when(F.coalesce(is_bold_block(F.get(clean, i + 1)), F.lit(False)), "").otherwise("**"),
            ),
        ).otherwise(b),
    )
    return F.array_join(piece, " ")


def stage_label(suffix: Column) -> Column:
    """What extracting a file of this suffix is called."""
    return F.when(suffix == ".pdf", "PDF 추출").when(suffix.isin(".hwp", ".hwpx", ".hwpml"), "한글 문서 추출").when(suffix.isin(".html", ".htm"), "HTML 추출").otherwise("추출")


_URI = r"(?s)^data:([A-Za-z0-9.+-]+/[A-Za-z0-9.+-]+)?(?:;[^,;]*)*?(;base64)?,(.*)$"


def data_uri(uri: Column) -> tuple[Column, Column]:
    """(media type, bytes) of a base64 data URI; null for anything else and for broken base64."""
    body = F.regexp_replace(F.regexp_extract(uri, _URI, 3), r"\s", "")
    good = (F.regexp_extract(uri, _URI, 2) == ";base64") & body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0)
    kind = F.coalesce(F.nullif(F.regexp_extract(uri, _URI, 1), F.lit("")), F.lit("text/plain"))
    return F.when(good, kind), F.when(good, F.unbase64(F.when(good, body)))


def to_data_uri(content: Column, path: Column) -> Column:
    """Bytes as a data URI whose media type goes by the file's suffix."""
    kind = F.when(F.lower(path).endswith(".jpg") | F.lower(path).endswith(".jpeg"), "image/jpeg").when(F.lower(path).endswith(".gif"), "image/gif").when(F.lower(path).endswith(".bmp"), "image/bmp").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def failure_kind(message: Column) -> Column:
    """Why a model couldn't run, by what its error says: device, download or other; null for no error."""
    m = F.lower(message)
    return F.when(m.isNull(), F.lit(None).cast("string")).when(m.rlike("cuda|cudnn|cublas|out of memory"), "device").when(m.rlike("huggingface|download|connection|resolve|offline|timed out|certificate"), "download").otherwise("other")
