"""What the third round's findings were about."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from pagelattice import session
from pagelattice.operators import blocks, grid
from pagelattice.sources import commands, html, hwp, pdf


def test_names_without_semicolon(spark):
    page = "<h1>a &amp; b&amp</h1><p>?x=1&copy=2 &middot; &lt;b&gt; &amp;lt; &ampx; &#65; &</p><p><img src='?a=1&lt=2' alt='&quot;'></p>"
    got = [b[2] for b in html.blocks(page)]
    assert got == ["a & b&amp", "?x=1&copy=2 · <b> &lt; &ampx; A &", html.PICTURE]
    assert html.inline_md(html.tree("<img src='?a=1&lt=2' alt='&quot;'>")) == '![\"](?a=1&lt=2)'


def test_commands_over_all_cores(spark):
    """Many small files that lie in one split; repeated paths."""
    f = spark.range(3000, numPartitions=1).select((F.col("id") % 2999).cast("string").alias("path"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content"))
    out = commands.run(f, ["cat"])
    assert out.rdd.getNumPartitions() > 4
    assert out.agg(F.count("*"), F.sum(F.length("output")), F.count("error")).first()[:] == (3000, 2999 * 3000 // 2, 1)
    html_ = commands.html_candidates(f, ["cat"])
    assert html_.count() == 3000 and "Join" not in html_._jdf.queryExecution().optimizedPlan().toString()


def test_command_runner():
    r = commands._Runner(["sh", "-c", "cat; echo said >&2; kill -9 $$"], 5.0)
    assert [r(b"a" * n) for n in (100_000, 0, 7)] == [(-9, b"a" * n, b"said\n") for n in (100_000, 0, 7)]


def test_tall_and_damaged_tables(spark):
    """Rows beyond 16384 are drawn; a damaged address keeps its cell and costs no memory."""
    kind = "t int, cell_no int, declared_cols int, row int, col int, rowspan int, colspan int, blocks array<string>"
    tall = spark.range(20000).select(F.lit(1).alias("t"), F.col("id").cast("int").alias("cell_no"), F.lit(0).alias("declared_cols"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"), F.array(F.col("id").cast("string")).alias("blocks"))
    big = 2**31 - 1
    odd = spark.createDataFrame(
        [(2, 0, 0, 0, 0, 1, 1, ["a"]), (2, 1, 0, big, 1, 1, 1, ["b"]), (3, 0, 0, 0, 0, big, 1, ["a"]), (3, 1, 0, 1, 1, 1, 1, ["b"]), (4, 0, 0, 0, big, 1, big, ["a"]), (5, 0, 0, 0, 0, 1, 1, ["a"]), (5, 1, 0, -1, 0, 1, 1, ["b"]), (6, 0, 300, 0, 0, 1, 1, ["a"]), (7, 0, big, 0, 0, 1, 1, ["a"])],
        kind,
    )
    got = {r["t"]: r[1:] for r in grid.render_grid(tall.unionByName(odd), "t").collect()}
    assert got[1][:2] == (20000, 1) and got[1][3] is False and got[1][2] == "| 0 |\n| --- |\n" + "\n".join(f"| {k} |" for k in range(1, 20000))
    assert got[2] == (3, 2, "| a |  |\n| --- | --- |\n|  |  |\n|  | b |", True)
    assert got[3] == (3, 2, "| a |  |\n| --- | --- |\n| 〃 | b |\n| 〃 |  |", True)
    assert got[4] == (1, 3, "|  | a |  |\n| --- | --- | --- |", True)
    assert got[5] == (1, 1, "| a |\n| --- |", True)
    assert got[6][:2] == (1, 300) and got[6][3] is False and got[7] == (1, 2, "| a |  |\n| --- | --- |", True)


def test_hwp_addresses_of_sixteen_bits():
    """The format's addresses are all taken for real."""
    _, _, _, _, _, cells = next(b for b in hwp.blocks(hwp.document([hwp.table([(0, 0, 1, 1, "a"), (20000, 1, 1, 1, "b")], 2)])) if b[0] == "table")
    assert [c[2:4] for c in cells] == [(0, 0), (20000, 1)]


def test_put_after_is_one_by_one():
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(["<a>", "<b>", "<ab>", "x", " ", "\n", "a", "<"]) for _ in range(r.randint(0, 9)))
        marks = r.choice([["<a>", "<b>", "<ab>"], ["<a>", "<a><b>", "b>x"], ["a", "a>", ">x", ""], ["<a>", "x", None], ["\nx", "<b> "]])
        items = [(r.choice(marks), r.choice(["t", " u\n", "", None, "<a>", "v<", "<table 1>\n</table 1>"])) for _ in range(r.randint(0, 5))]
        clean = [(m or "", blocks._AROUND.sub("", t or "")) for m, t in items]
        assert blocks.put_after(text, items) == blocks._one_by_one(text, [x for x in clean if x[1]])


def test_put_after_matches_insert_after(spark):
    rows = [("a <!-- i --> b", "<!-- i -->", " t "), (" \n", "<!-- i -->", "t"), ("a 　\n", None, "t"), (None, "x", "t"), ("a", "a", " "), ("a<x> ", "<x>", "t")]
    c = spark.createDataFrame(rows, "c string, p string, t string")
    one, all_ = blocks.insert_after(F.col("c"), F.col("p"), F.col("t")), blocks.insert_all(F.col("c"), F.array("p"), F.array("t"))
    assert all(a == b for a, b in c.select(one, all_).collect())


def test_put_after_is_linear():
    n = 60_000
    page = "\n".join(f"<!-- image_{k} -->" for k in range(n))
    t = time.time()
    got = blocks.put_after(page, [(f"<!-- image_{k} -->", f"<table {k}>\n</table {k}>") for k in range(n)])
    assert time.time() - t < 10 and got.startswith("<!-- image_0 -->\n\n<table 0>\n</table 0>\n<!-- image_1 -->") and got.count("</table") == n


def test_image_groups_have_no_set_of_a_document(spark):
    t = spark.createDataFrame([(1, "a", "image", ["b", "x", "a", None]), (1, "b", "table", None), (1, "c", "image", ["x", "c"]), (1, "d", "image", None), (1, "e", "image", []), (2, "a", "image", ["b", "a"])], "doc int, id string, content_type string, group_image_ids array<string>")
    out = blocks.image_groups(t, "doc")
    assert sorted(map(tuple, out.collect())) == [(1, "a,b,x", "b", "b,a", "<!-- img_from_b -->"), (1, "d", "d", "d", "<!-- img_from_d -->")]
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_bound_a_worker():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 20_000] * 1000)], names=["k", "s"])
    got = list(session.pieces([b, b.slice(0, 0)]))
    assert max(p.num_rows * 20_000 for p in got) <= session.PIECE_BYTES and pa.Table.from_batches(got).equals(pa.Table.from_batches([b]))


def test_page_of():
    run = lambda n, l, t, s: {"mid": t + 5.0, "l": l, "n": n, "r": l + 10.0, "size": 10.0, "s": s}
    assert pdf.page_of([run(0, 50.0, 0.0, "c"), run(1, 0.0, 1.0, " a"), run(2, 12.0, 0.0, "b"), run(3, 0.0, 14.0, "d"), run(4, 10.0, 14.0, "e"), run(5, 0.0, 50.0, "f")]) == "a b c\nde\n\nf"
    assert pdf.page_of([]) == ""


def test_pages_parse_once(spark):
    f = pdf.fragments(spark.createDataFrame([("a", bytearray(pdf.write([[(50.0, 20.0, 10.0, "x y")], []])))], "path string, content binary"))
    p = pdf.pages(f)
    assert sorted(map(tuple, p.collect())) == [("a", 1, "x y"), ("a", 2, "")]
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
