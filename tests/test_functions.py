"""Text, gates, geometry: small inputs with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelattice.functions import gates, geometry
from pagelattice.functions import text as X


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'array<string>'}" for n, v in zip(names, values)))
    return df.select(f(*map(F.col, names)).alias("x")).first()[0]


@pytest.mark.parametrize(
    "source, want",
    [
        ("제 목", "제 목"),
        ("제 목 명", "제목명"),
        ("총 괄 : 2 0 2 4 년도", "총 괄 : 2024 년도"),
        ("a b c", "abc"),
        ("가나 다라 마바", "가나 다라 마바"),
        ("가 나 다 abc", "가나다 abc"),
        ("", ""),
        (None, None),
    ],
)
def test_even_spacing(spark, source, want):
    assert one(spark, X.collapse_even_spacing, source) == want


@pytest.mark.parametrize("source, want", [("비\n고\n란\n끝.", "비고란\n끝."), (" 비 \n고\nx", "비\n고\nx"), ("x\n1\n2\n3", "x\n123"), ("", ""), (None, None), ("가\n\n나\n다", "가\n\n나\n다")])
def test_vertical(spark, source, want):
    assert one(spark, X.collapse_vertical_text, source) == want


@pytest.mark.parametrize("source, want", [("· 1 급( 2 명 ) , 2 급", "· 1급(2명), 2급"), ("가 · 나", "가·나"), ("a  b", "a b"), (None, None)])
def test_punctuation(spark, source, want):
    assert one(spark, X.tighten_punctuation, source) == want


@pytest.mark.parametrize("source, want", [("a b a b a b c", "a b c"), ("x x", "x x"), ("x x x", "x"), ("a a a a a a b", "a a b"), ("one  two", "one  two"), (None, None)])
def test_repeats(spark, source, want):
    assert one(spark, X.collapse_repeated_words, source) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=24))
def test_repeats_brute(tokens):
    def brute(t):
        out, i = [], 0
        while i < len(t):
            for s in range((len(t) - i) // 3, 0, -1):
                n = 1
                while t[i + n * s : i + (n + 1) * s] == t[i : i + s]:
                    n += 1
                if n >= 3:
                    out, i = out + t[i : i + s], i + n * s
                    break
            else:
                out.append(t[i])
                i += 1
        return out

    assert X._shorten(tokens) == brute(tokens)


def test_bold_runs(spark):
    assert one(spark, X.merge_bold_runs, ["**a**", "**b**", "c", " ", "**d**"]) == "**a b** c **d**"
    assert one(spark, X.merge_bold_runs, ["****"]) == "****"


def test_pieces(spark):
    assert one(spark, X.map_pua, " x ") == "□ x "
    assert one(spark, X.display_width, "가a") == 3
    assert one(spark, X.safe_file_stem, "??.pdf") == "document"
    assert one(spark, X.mask_secret, "abc") == "***"
    assert one(spark, X.preview_text, "x" * 70) == "x" * 59 + "…"
    assert one(spark, X.strip_fences, "```md\n|a|\n```") == "|a|"
    assert one(spark, X.bullet_depth, "▸ x") == 3
    assert one(spark, X.style_heading_level, "개요 2 사본") == 2
    assert one(spark, lambda t, b, i: X.emphasize(t, b, i), "x", True, True) == "***x***"
    assert one(spark, X.normalize_pdf_text, "비\n고\n란\n가 ( 1 명 )\nxy xy xy") == "비고란\n가(1명)\nxy"


def test_gates(spark):
    assert one(spark, gates.usable_text_layer, "가" * 15) is True
    assert one(spark, gates.usable_text_layer, "가" * 14) is False
    assert one(spark, gates.usable_text_layer, "https://example.com/" + "a" * 50) is False
    assert one(spark, gates.usable_text_layer, None) is False
    assert one(spark, gates.looks_like_table, "| a |\n|---|\n| b |") is True
    assert one(spark, gates.looks_like_table, "| a |\n| c |\n| b |") is False
    assert one(spark, gates.needs_fill, "table", "wrong") is True
    assert one(spark, gates.needs_fill, None, "wrong") is False
    assert one(spark, gates.was_filled, "a", "b") is True
    assert one(spark, gates.was_filled, None, "b") is False


def test_geometry(spark):
    row = spark.sql("select named_struct('l', 0D, 't', 0D, 'r', 10D, 'b', 10D) a, named_struct('l', 5D, 't', 0D, 'r', 15D, 'b', 10D) b, named_struct('l', 1D, 't', 1D, 'r', 1D, 'b', 5D) z")
    a, b, z = map(geometry.box, "abz")
    got = row.select(geometry.overlap_ratio(a, b), geometry.iou(a, b), geometry.overlap_ratio(z, a)).first()
    assert got[0] == 0.5 and got[1] == pytest.approx(1 / 3) and got[2] == 0
