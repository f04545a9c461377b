"""Table and image placeholders in page text: `<table N>` blocks are found, written, replaced and put back.

A page's text is cut at its blocks into ordered segments; segments are joined with tables by number and put together again. So
no operator edits strings in a loop.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, replace_matches

BLOCK = r"(?s)<table ([0-9]+)>(?:\s*)(.*?)(?:\s*)</table \1>"
OPEN = r"<table ([0-9]+)>"
GFM = r"(?m)([|][^\n]+[|]\n[|][ \t:|-]+[|](?:\n[|][^\n]+[|])*)"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def table_block(num: Column, markdown: Column) -> Column:
    """The block of a table; without Markdown just its tags."""
    md = _strip(F.coalesce(markdown, F.lit("")))
    n = num.cast("string")
    head, foot = F.concat(F.lit("<table "), n, F.lit(">\n")), F.concat(F.lit("</table "), n, F.lit(">"))
    return F.when(md == "", F.concat(head, foot)).otherwise(F.concat(head, F.lit("\n"), md, F.lit("\n\n"), foot))


def table_id(num: Column) -> Column:
    return F.concat(F.lit("table_"), num.cast("string"))


def normalize_blocks(content: Column) -> Column:
    """Every block in the form that table_block writes."""
    return replace_matches(content, BLOCK, lambda m: table_block(F.regexp_extract(m, BLOCK, 1), F.regexp_extract(m, BLOCK, 2)))


def inject(pages: DataFrame, doc: str, order: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(pages with numbered blocks around their Markdown tables, tables (doc, order, table_num, id, placeholder, markdown)).

    Numbers ascend through the document. Only the counts of pages with tables are sorted by document; texts are sent, if at all, by
    document, order and a hash of the text, so that a document of very many pages is spread.

    Defined cases: different pages of one document and order are numbered one after the other; repeated rows are one page and get the same
    numbers; a null document is a document, a null order comes first; null content has no table and stays null; columns of any name
    pass through; no pages, no tables.
    """
    from pyspark.sql.window import Window

    found = F.regexp_extract_all(F.col(content), F.lit(GFM), F.lit(1))
    p = pages.withColumn("__found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("__hash", F.xxhash64(content)).withColumn("__gaps", F.split(content, GFM, -1))
    w = Window.partitionBy("__doc").orderBy(F.col("__order").asc_nulls_first(), "__text").rowsBetween(Window.unboundedPreceding, -1)
    counts = pages.select(F.col(doc).alias("__doc"), F.col(order).alias("__order"), F.xxhash64(content).alias("__text"), F.size(found).alias("k")).where("k > 0").groupBy("__doc", "__order", "__text").agg(F.max("k").alias("k"))
    before = counts.select("__doc", "__order", "__text", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("__before"))
    p = p.join(before, F.col(doc).eqNullSafe(F.col("__doc")) & F.col(order).eqNullSafe(F.col("__order")) & (F.col("__hash") == F.col("__text")), "left")
    blocks = F.transform("__found", lambda m, i: table_block(F.col("__before") + i + 1, m))
    text = F.array_join(F.zip_with("__gaps", blocks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")
    out = p.withColumn(content, text).select(*pages.columns)
    t = p.select(doc, order, "__before", F.posexplode("__found").alias("__i", "markdown")).withColumn("table_num", (F.col("__before") + F.col("__i") + 1).cast("int"))
    tables = t.select(doc, order, "table_num", table_id(F.col("table_num")).alias("id"), F.concat(F.lit("<table "), F.col("table_num").cast("string"), F.lit(">")).alias("placeholder"), _strip(F.col("markdown")).alias("markdown"))
    return out, tables


def cell_set(markdown: Column) -> Column:
    """The distinct texts of a Markdown table's cells, rules left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[|][-:\s|]+[|]$"))
    return F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda r: F.transform(F.split(r, "[|]"), lambda c: F.trim(c)))), lambda c: c != ""))


def block_pattern(num: Column) -> Column:
    """The pattern of one table's block."""
    n = num.cast("string")
    return F.concat(F.lit("(?s)<table "), n, F.lit(r">(?:\s*)(.*?)(?:\s*)</table "), n, F.lit(">"))


def block_markdown(content: Column, num: Column) -> Column:
    """What stands in a table's block; '' without one."""
    return _strip(F.call_function("regexp_extract", content, block_pattern(num), F.lit(1)))


def replace_block(content: Column, num: Column, by: Column) -> Column:
    """content with the first block of a table replaced; without one unchanged."""
    def put(c: Column, found: Column) -> Column:
        at = F.position(found, c)
        return F.when(found.isNull(), c).otherwise(F.concat(F.substr(c, F.lit(1), at - 1), by, F.substr(c, at + F.length(found))))

    return let(content, lambda c: let(F.regexp_substr(c, block_pattern(num)), lambda found: put(c, found)))


def sync_block(content: Column, num: Column, markdown: Column) -> Column:
    return replace_block(content, num, table_block(num, markdown))


def unwrap_block(content: Column, num: Column, markdown: Column) -> Column:
    """A block that is text and no table: what stands in it without the tags, or else the given Markdown."""
    inner = block_markdown(content, num)
    return replace_block(content, num, F.when(inner != "", inner).otherwise(_strip(F.coalesce(markdown, F.lit("")))))


def context_slice(content: Column, num: Column) -> Column:
    """A table's surroundings: from the table before (else the last heading before, else the start) to the table after (else the end)."""
    n = num.cast("string")
    found = F.regexp_substr(content, block_pattern(num))
    opens = F.regexp_extract_all(content, F.lit(OPEN), F.lit(1))
    index = F.array_position(opens, n)
    # the text as pieces: what stands before each opening tag, and the tags
    gaps = F.transform(F.split(content, OPEN, -1), F.length)
    tags = F.transform(F.regexp_extract_all(content, F.lit(OPEN), F.lit(0)), F.length)
    sum_ = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda s, x: s + x)
    place = lambda k: sum_(gaps, k) + sum_(tags, k - 1)  # noqa: E731  characters before the k-th tag
    before = F.substr(content, F.lit(1), F.position(found, content) - 1)
    headings = F.regexp_extract_all(before, F.lit(r"(?m)^[#]{1,6}\s+.+$"), F.lit(0))
    last = F.element_at(headings, -1)
    # the last heading's place: the length of what is left when the text from it on is cut away
    heading = F.length(before) - F.length(F.regexp_extract(before, r"(?ms)(^#{1,6}\s+[^\n]+$(?!.*^#{1,6}\s+[^\n]+$).*)\z", 1))
    start = F.when(index > 1, place(F.greatest(index - 1, F.lit(1)).cast("int"))).otherwise(F.when(last.isNotNull(), heading).otherwise(0))
    end = F.when((index > 0) & (index < F.size(opens)), place((index + 1).cast("int"))).otherwise(F.length(content))
    return F.when(found.isNull(), _strip(content)).otherwise(_strip(F.substr(content, (start + 1).cast("int"), (end - start).cast("int"))))


def segments(pages: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, seg_no, table_num, text): a page's text cut at its blocks; table_num is null for what lies between."""
    gaps = F.transform(F.split(content, BLOCK, -1), lambda g: F.struct(F.lit(None).cast("int").alias("table_num"), g.alias("text")))
    found = F.transform(F.regexp_extract_all(F.col(content), F.lit(BLOCK), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, BLOCK, 1).cast("int").alias("table_num"), F.regexp_extract(m, BLOCK, 2).alias("text")))
    both = F.flatten(F.zip_with(gaps, found, lambda g, m: F.array(g, m)))
    return pages.select(*keys, F.posexplode(both).alias("seg_no", "s")).where("s is not null").select(*keys, "seg_no", "s.table_num", "s.text")


def expand(pages: DataFrame, tables: DataFrame, images: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, content): blocks as their tables' Markdown and image placeholders as descriptions, where there are any.

    tables (keys, table_num, markdown), images (keys, placeholder, description).
    """
    seg = segments(pages, keys, content).join(tables.select(*keys, "table_num", "markdown"), [*keys, "table_num"], "left")
    piece = F.when(F.col("table_num").isNull(), F.col("text")).otherwise(F.coalesce(F.nullif(F.trim("markdown"), F.lit("")), "text"))
    whole = seg.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", piece.alias("p")))), lambda x: x["p"]), "").alias(content))
    pics = images.where("description is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("placeholder", "description"))).alias("pics"))
    done = F.aggregate(F.coalesce("pics", F.array().cast("array<struct<placeholder:string,description:string>>")), F.col(content), lambda s, x: F.replace(s, x["placeholder"], x["description"]))
    return whole.join(pics, keys, "left").select(*keys, done.alias(content))


def image_groups(tables: DataFrame, doc: str) -> DataFrame:
    """(doc, group_key, first_id, ids, placeholder): the distinct groups of tables judged to be parts of one picture, members that don't exist left out."""
    g = tables.where("content_type = 'image'").select(doc, F.coalesce("group_image_ids", F.array("id")).alias("ids")).withColumn("group_key", F.array_join(F.array_sort("ids"), ","))
    one = g.groupBy(doc, "group_key").agg(F.min("ids").alias("ids")).select(doc, "group_key", F.posexplode("ids").alias("k", "id"))
    known = one.join(tables.select(doc, "id"), [doc, "id"], "left_semi")
    out = known.groupBy(doc, "group_key").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("m")).where(F.get("m", F.lit(0))["k"] == 0)
    out = out.select(doc, "group_key", F.transform("m", lambda x: x["id"]).alias("ids"))
    ids = F.col("ids")
    return out.select(doc, "group_key", F.get("ids", F.lit(0)).alias("first_id"), F.array_join(ids, ",").alias("members"), F.concat(F.lit("<!-- img_from_"), F.get("ids", F.lit(0)), F.lit(" -->")).alias("placeholder"))


def convert_groups(pages: DataFrame, groups: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, content): the blocks of image groups (keys, members, placeholder) as pictures: the first block becomes the group's placeholder, the others go, and so do the blank lines that this leaves.

    Other blocks are written as they were read.
    """
    m = groups.select(*keys, "placeholder", F.posexplode(F.split("members", ",")).alias("k", "id")).select(*keys, F.regexp_extract("id", r"(\d+)$", 1).cast("int").alias("table_num"), F.when(F.col("k") == 0, F.col("placeholder")).otherwise("").alias("by"))
    m = m.groupBy(*keys, "table_num").agg(F.max("by").alias("by"))
    seg = segments(pages, keys, content).join(m, [*keys, "table_num"], "left")
    piece = F.when(F.col("by").isNotNull(), F.col("by")).when(F.col("table_num").isNotNull(), table_block(F.col("table_num"), F.col("text"))).otherwise(F.col("text"))
    whole = seg.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", piece.alias("p")))), lambda x: x["p"]), "").alias(content))
    return whole.withColumn(content, F.regexp_replace(content, r"\n{3,}", "\n\n"))


def insert_after(content: Column, placeholder: Column, text: Column) -> Column:
    """content with text on its own after the first placeholder, or at the end if there is none; blank text changes nothing. Null content counts as empty."""
    c, t = F.coalesce(content, F.lit("")), _strip(F.coalesce(text, F.lit("")))
    at = F.when(F.coalesce(placeholder, F.lit("")) == "", 0).otherwise(F.position(placeholder, c))
    end = at + F.length(placeholder)
    inside = F.concat(F.substr(c, F.lit(1), end - 1), F.lit("\n\n"), t, F.substr(c, end))
    behind = F.when(_strip(c) == "", t).otherwise(F.concat(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit("\n\n"), t))
    return F.when(t == "", c).when(at > 0, inside).otherwise(behind)


_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_TAIL, _AROUND = re.compile(_BLANK + r"\Z"), re.compile(rf"\A{_BLANK}|{_BLANK}\Z")


def _kinds(marks: set[str]) -> dict[str, set[int]]:
    """The lengths of marks by the beginning that they share."""
    head = min(min(map(len, marks), default=0), 8)
    kinds: dict[str, set[int]] = {}
    for m in marks:
        kinds.setdefault(m[:head], set()).add(len(m))
    return kinds


def _firsts(content: str, marks: set[str], kinds: dict[str, set[int]]) -> dict[str, int]:
    """Where each mark stands first in content, by one pass for each beginning."""
    out: dict[str, int] = {}
    for begin, sizes in kinds.items():
        at = content.find(begin)
        while at >= 0:
            for n in sizes:
                m = content[at : at + n]
                if m in marks and m not in out:
                    out[m] = at
            at = content.find(begin, at + 1)
    return out


def _one_by_one(c: str, items: list[tuple[str, str]]) -> str:
    for mark, t in items:
        at = c.find(mark) if mark else -1
        if at >= 0:
            c = f"{c[: at + len(mark)]}\n\n{t}{c[at + len(mark) :]}"
        else:
            c = f"{kept}\n\n{t}" if (kept := _TAIL.sub("", c)) else t
    return c


def put_after(content: str, items: list[tuple[str | None, str | None]]) -> str:
    """What insert_after gives for the items (placeholder, text) one after the other, in one pass over content and items."""
    items = [(m or "", t) for m, text in items if (t := _AROUND.sub("", text or ""))]
    marks = {m for m, _ in items if m}
    plain = not any("\n" in m or m != _AROUND.sub("", m) for m in marks)
    # texts in which a placeholder stands or begins change what is found after them
    prefixes = {m[:k] for m in marks for k in range(1, len(m))} if plain else set()
    most = max(map(len, marks), default=0)
    kinds = _kinds(marks)
    if not plain or any(_firsts(t, marks, kinds) or any(t[-k:] in prefixes for k in range(1, min(most, len(t) + 1))) for t in {t for _, t in items}):
        return _one_by_one(content, items)
    at = _firsts(content, marks, kinds)
    points: dict[int, list[str]] = {}
    behind = []
    for m, t in items:
        if m in at:
            points.setdefault(at[m] + len(m), []).append(t)
        else:
            behind.append(t)
    order = sorted(points)
    if any((k := bisect_right(order, s)) < len(order) and order[k] < s + len(m) for m, s in at.items()):
        return _one_by_one(content, items)
    if behind:
        content = _TAIL.sub("", content)
    parts, last = [], 0
    for p in order:
        parts.append(content[last:p])
        parts += [f"\n\n{t}" for t in reversed(points[p])]
        last = p
    whole = "".join([*parts, content[last:]])
    return "\n\n".join([whole, *behind] if whole else behind)


def insert_all(content: Column, placeholders: Column, texts: Column) -> Column:
    """insert_after for arrays of placeholders and texts, one after the other; null arrays count as empty. Work grows with the content and the texts, not with their product."""

    @F.pandas_udf("string")
    def put(c: pd.Series, p: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([put_after(x or "", [] if a is None else list(zip(a, b))) for x, a, b in zip(c, p, t)], dtype=object)

    return put(content, placeholders, texts)


def apply_verdicts(pages: DataFrame, tables: DataFrame, keys: list[str], content: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, tables, images) after verdicts: blocks of what was judged to be text lose their tags, groups of picture parts become one picture.

    tables (keys, table_num, id, content_type, group_image_ids, ...); those that went into text or a picture are left out of the tables that
    are given back; images (keys, id, placeholder) are the pictures that groups became. A group ends at its page.
    """
    doc = keys[0]
    place = tables.select(*keys, "id", "table_num")
    groups = image_groups(tables, doc).join(place.withColumnRenamed("id", "first_id"), [doc, "first_id"])
    one = groups.select(*keys, "members", "placeholder", "first_id")
    member = one.select(*keys, F.explode(F.split("members", ",")).alias("id")).distinct()
    seg = segments(pages, keys, content).join(tables.select(*keys, "table_num", "content_type"), [*keys, "table_num"], "left")
    piece = F.when(F.col("table_num").isNull() | (F.col("content_type") == "text"), F.col("text")).otherwise(table_block(F.col("table_num"), F.col("text")))
    plain = seg.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", piece.alias("p")))), lambda x: x["p"]), "").alias(content))
    out = convert_groups(plain, one, keys, content)
    left = tables.where("not (content_type <=> 'text')").join(member, [*keys, "id"], "left_anti")
    return out, left, one.select(*keys, F.concat(F.lit("img_from_"), F.col("first_id")).alias("id"), "placeholder").distinct()
