"""Queries over text normalisation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates, text as X
from ..operators import reports
from .base import query, table


@query(
    """with a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), 'https?://\\S+', '', 'g'), '\\s', '', 'g') as bare from documents),
    b as (select doc_id, length(bare) as n, length(regexp_replace(bare, '[^가-힣A-Za-z]', '', 'g')) as w from a)
    select doc_id, w >= 15 and w / greatest(n, 1) >= 0.3 as usable, not (w >= 15 and w / greatest(n, 1) >= 0.3) as reread from b"""
)
def text_layer_gate(spark, sf_dir):
    """Which texts can be used as they are, and which must be read again."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", gates.usable_text_layer(F.col("text")).alias("usable"), gates.needs_ocr(F.col("text")).alias("reread"))


@query("select p_partkey, '□ ' || p_name || ' ✔《' || p_brand || '》' || chr(57344) as mapped from part")
def pua_map(spark, sf_dir):
    """Private-use bullets and brackets put in and mapped; an unknown one stays."""
    s = F.concat(F.lit(" "), "p_name", F.lit(" \U000f0854"), "p_brand", F.lit("\U000f0855"))
    return table(spark, sf_dir, "part").select("p_partkey", X.map_pua(s).alias("mapped"))


@query("select n_nationkey, replace(n_name, ' ', '') as whole, '제목명 : ' || n_name || case when regexp_full_match(n_name, '.*[^0-9][0-9]') then '' else ' ' end || '2024' as part from nation")
def even_spacing(spark, sf_dir):
    """Evenly spaced characters, whole lines and runs within lines, joined."""
    spaced = F.array_join(F.split("n_name", ""), " ")
    mixed = F.concat(F.lit("제 목 명 : "), "n_name", F.lit(" 2 0 2 4"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.collapse_even_spacing(spaced).alias("whole"), X.collapse_even_spacing(mixed).alias("part"))


@query(
    """select c_custkey, '번호 표' || chr(10) || case when length(c_custkey::varchar) >= 3 then c_custkey::varchar else array_to_string(string_split(c_custkey::varchar, ''), chr(10)) end || chr(10) || c_name as joined from customer"""
)
def vertical_collapse(spark, sf_dir):
    """Numbers written downwards, one digit a line, as lines."""
    digits = F.array_join(F.transform(F.split(F.col("c_custkey").cast("string"), ""), lambda x: F.concat(F.lit(" "), x, F.lit(" "))), "\n")
    s = F.concat(F.lit("번호 표\n"), digits, F.lit("\n"), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", X.collapse_vertical_text(s).alias("joined"))


@query("select s_suppkey, '· ' || s_name || '(' || s_suppkey::varchar || '명), 끝·다음' as tight from supplier")
def punctuation_tighten(spark, sf_dir):
    """Spaces around punctuation taken away, the bullet's kept."""
    s = F.concat(F.lit("· "), "s_name", F.lit(" ( "), F.col("s_suppkey").cast("string"), F.lit(" 명 ) ,  끝 · 다음"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", X.tighten_punctuation(s).alias("tight"))


@query("select p_partkey, p_name || ' #' || p_brand || ' end' as once from part")
def repeat_collapse(spark, sf_dir):
    """Phrases that stand several times in a row once."""
    brand = F.concat(F.lit("#"), "p_brand")
    s = F.concat_ws(" ", "p_name", "p_name", "p_name", brand, brand, brand, brand, F.lit("end"))
    return table(spark, sf_dir, "part").select("p_partkey", X.collapse_repeated_words(s).alias("once"))


_PREFIX = ["- ", "○ ", "□", "  ▪ ", "제 3 장 ", ""]


@query(
    """with a as (select p_partkey, p_name, p_size % 6 as k from part) select p_partkey,
    case k when 0 then '  - ' || p_name when 1 then '- ' || p_name when 2 then '- ' || p_name when 3 then '- ' || p_name when 4 then '제 3 장 ' || p_name else p_name end as md,
    case k when 0 then 2 when 1 then 1 when 3 then 2 end as depth, case when k = 4 then 1 end as level from a"""
)
def bullets_headings(spark, sf_dir):
    """Bullets as list items with their depth; numbered headings with their level."""
    k = F.col("p_size") % 6
    prefix = F.element_at(F.array(*map(F.lit, _PREFIX)), (k + 1).cast("int"))
    s = F.concat(prefix, "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", X.bullet_to_md(s).alias("md"), X.bullet_depth(s).alias("depth"), X.numbered_heading_level(s).alias("level"))


@query(
    """with a as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) <= 60 then t else left(t, 59) || '…' end as preview, length(t)::bigint as n_chars from a"""
)
def preview_lines(spark, sf_dir):
    """Texts on one line of sixty characters."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.preview_text(F.col("text")).alias("preview"), F.length(X.normalize_line(F.col("text"))).cast("long").alias("n_chars"))


@query(
    """select c_custkey, length(c_name) + 6 as width, trim(regexp_replace(c_name || ' (최종)', '[^0-9A-Za-z가-힣._-]+', '_', 'g'), '_') as stem,
    left('key-' || c_name, 6) || '…' || right('key-' || c_name, 4) as masked, '{"id": ' || c_custkey::varchar || '}' as bare from customer"""
)
def names_and_widths(spark, sf_dir):
    """Display widths, safe file stems, masked secrets and replies without fences."""
    name = F.concat("c_name", F.lit(" (최종).hwp"))
    reply = F.concat(F.lit('```json\n{"id": '), F.col("c_custkey").cast("string"), F.lit("}\n```"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.display_width(F.concat(F.lit("한글표"), "c_name")).alias("width"), X.safe_file_stem(name).alias("stem"), X.mask_secret(F.concat(F.lit("key-"), "c_name")).alias("masked"), X.strip_fences(reply).alias("bare"))


@query(
    """select event_id, event_id % 7 = 0 as payload,
    case when event_id % 5 = 0 and event_id % 11 >= 10 then null when event_id % 3000 > 1000 and event_id % 900 < 500 then 'little text for its size'
    when event_id % 30 >= 10 and event_id % 11 <= greatest(3, floor((event_id % 30) / 6)) then 'most cells are empty' when event_id % 5 = 0 then 'fields were lost' end as verdict,
    coalesce(least(1.0, abs(value) * 100 / 500990), 1.0) as ratio from events"""
)
def conversion_gates(spark, sf_dir):
    """Field payloads, verdicts on HTML conversions, pictures' shares of a page."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.when(i % 7 == 0, F.concat(F.lit(' {"simplefields": ['), i.cast("string"), F.lit("]} "))).otherwise(F.col("props"))
    verdict = gates.html_conversion_verdict((i % 3000) * 10, i % 900, i % 30, i % 11, i % 5 == 0)
    return e.select("event_id", X.is_field_payload(text).alias("payload"), verdict.alias("verdict"), gates.area_ratio(F.lit(0.0), F.lit(0.0), F.col("value"), F.lit(100.0)).alias("ratio"))


@query(
    """with t as (select n_regionkey, n_nationkey, '가 ' || n_name as a, '나무 가지 ' || n_name as b from nation)
    select n_regionkey, '가' as char, count(*)::bigint as total, count(*)::bigint as line_head, 1.0 as ratio, 1 as rank from t group by n_regionkey having count(*) >= 3"""
)
def glyph_suspects(spark, sf_dir):
    """Syllables that stand for bullets: put before every nation's name, beside words that have them too."""
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_regionkey", (F.col("n_nationkey") * 2).alias("line_no"), F.concat(F.lit("가 "), "n_name").alias("text")).unionAll(n.select("n_regionkey", (F.col("n_nationkey") * 2 + 1).alias("line_no"), F.concat(F.lit("나무 가지 "), "n_name").alias("text")))
    return reports.glyph_suspects(rows, "n_regionkey")
