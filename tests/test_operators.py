"""Operators, sources, providers, façade on small fixtures."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelattice import cli, config, providers
from pagelattice.api import Batch
from pagelattice.operators import blocks, chunks, grid, verdicts
from pagelattice.sources import files, html, office
from pagelattice.streaming import folder


def test_html_blocks():
    page = """<h2>A <br>b</h2><script>var x = "</p>"</script><p>one <img src="data:x"></p><ul><li>x<ol><li>y</li></ol></li><li>z</li></ul>
    <table><caption>C</caption><tr><td rowspan=2>a</td><td colspan="2">b</td></tr><tr><td>c<p>in</p></td><td></td></tr><tr><td></td></tr></table>"""
    got = html.blocks(page)
    assert [b[0] for b in got] == ["heading", "paragraph", "list", "table"]
    assert got[0][2] == "A b" and got[1][2] == "one [그림]"
    assert got[2][7] == "- x\n  1. y\n- z"
    assert got[3][3] == "C" and got[3][4] == [["a", "b", ""], ["", "cin", ""]]
    assert html.blocks("") == [] and html.blocks("<p>") == []


def test_html_markdown(spark):
    df = spark.createDataFrame([(1, "<h1>T</h1><p>• x</p><table><tr><td>a|</td></tr><tr><td>가</td></tr></table>"), (2, None)], "id int, html string")
    b = html.page_blocks(df)
    assert html.render(b, ["id"], "markdown").first()["content"] == "# T\n\n- x\n\n| a\\| |\n|-----|\n| 가  |"
    assert html.render(b, ["id"], "xml").first()["content"].startswith("<document>\n  <heading level=\"1\">T</heading>")
    assert html.render(b, ["id"], "text").first()["content"] == "T\n• x\na|\n가"


def test_grid(spark):
    cells = spark.createDataFrame([(1, 0, 2, 1, 0, 1, 2, ["x"]), (1, 1, 2, 2, 1, 1, 1, ["y"]), (1, 2, 2, 2, 1, 1, 1, ["z"])], "t int, cell_no int, declared_cols int, row int, col int, colspan int, rowspan int, blocks array<string>")
    got = grid.render_grid(cells, "t").first()
    assert got["markdown"] == "| x |  |\n| --- | --- |\n| 〃 | z |" and got["n_rows"] == 2
    assert grid.render_grid(cells, "t", marks=False).first()["markdown"].endswith("|  | z |")
    assert grid.render_grid(cells.limit(0), "t").count() == 0


def test_structure_gap_empty(spark):
    t = spark.createDataFrame([(1, 2, 2), (2, 0, 3), (3, 1, 1)], "t int, n_rows int, n_cols int")
    c = spark.createDataFrame([(1, 0, 9, 0, 1), (3, 0, 1, 0, 1)], "t int, row0 int, row1 int, col0 int, col1 int")
    got = {r["t"]: (r["declared"], r["missing"], r["broken"]) for r in grid.structure_gap(t, c, "t").collect()}
    assert got == {1: (4, 2, True), 2: (0, 0, False), 3: (1, 0, False)}


def test_blocks(spark):
    text = "# H\nx\n<table 1>\n\n| a |\n\n</table 1>\ny<table 2>\n</table 2>"
    df = spark.createDataFrame([(text,)], "c string")
    c = F.col("c")
    got = df.select(blocks.normalize_blocks(c), blocks.block_markdown(c, F.lit(2)), blocks.context_slice(c, F.lit(1)), blocks.context_slice(c, F.lit(2)), blocks.context_slice(c, F.lit(9)), blocks.replace_block(c, F.lit(9), F.lit("no"))).first()
    assert got[0] == text and got[1] == ""
    assert got[2] == "# H\nx\n<table 1>\n\n| a |\n\n</table 1>\ny"
    assert got[3] == text[text.index("<table 1>") :] and got[4] == text and got[5] == text


def test_chunker():
    lines = [f"# h{i}" if i % 10 == 0 else "x" * 20 for i in range(100)]
    kind, ends = chunks.cut_points(lines, sum(map(len, lines)), 500)
    assert kind == "heading" and ends and all(lines[e].startswith("#") for e in ends)
    assert chunks.find_boundaries(["x"] * 5, 2) == ("", [])
    assert chunks.cut_points(["y" * 30] * 500, 15000, 1000)[0] == "lines"


def test_chunks_cover(spark):
    text = "\n".join(f"# h{i}\n" + "x" * 90 for i in range(60))
    df = spark.createDataFrame([(1, 1, text), (1, 2, "short"), (2, 1, None)], "d int, p int, content string")
    got = chunks.chunk(df, "d", "p", 1000).orderBy("d", "chunk_no").collect()
    first = [r["content"] for r in got if r["d"] == 1]
    assert "\n".join(first[:-1]) == text and first[-1] == "short" and got[-1]["content"] == ""
    assert [r["chunk_no"] for r in got if r["d"] == 1] == list(range(1, len(first) + 1))


@pytest.mark.parametrize("reply, ids", [('[{"id": "a"}, 3]', ["a"]), ("nothing", []), (None, []), ('x [{"id": "a"}] y', ["a"]), ('{"k": {"quality": "wrong"}}', ["k"]), ("[]", [])])
def test_replies(spark, reply, ids):
    df = spark.createDataFrame([(reply,)], "r string")
    assert [v["id"] for v in df.select(verdicts.parse_reply(F.col("r"))).first()[0]] == ids


def hwpx(sections: dict[str, str], header: str = '<h:head xmlns:h="u"><h:charPr id="1"><h:bold/></h:charPr></h:head>') -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("Contents/header.xml", header)
        for n, body in sections.items():
            z.writestr(f"Contents/{n}.xml", f'<s xmlns:p="u">{body}</s>')
    return buf.getvalue()


CELL = '<p:tc><p:cellAddr rowAddr="{r}" colAddr="{c}"/><p:cellSpan rowSpan="{s}" colSpan="1"/><p:subList>{body}</p:subList></p:tc>'
PARA = '<p:p><p:run charPrIDRef="{b}"><p:t>{t}</p:t></p:run></p:p>'


def test_office(spark):
    inner = '<p:p><p:run><p:tbl colCnt="1"><p:tr>' + CELL.format(r=0, c=0, s=1, body=PARA.format(b=0, t="in")) + "</p:tr></p:tbl></p:run></p:p>"
    table = '<p:p><p:run><p:tbl colCnt="2"><p:tr>' + CELL.format(r=0, c=0, s=2, body=PARA.format(b=1, t="a") + PARA.format(b=1, t="b")) + CELL.format(r=0, c=1, s=1, body=inner) + "</p:tr><p:tr>" + CELL.format(r=1, c=1, s=1, body=PARA.format(b=0, t="d")) + "</p:tr></p:tbl></p:run></p:p>"
    doc = hwpx({"section10": PARA.format(b=0, t="last"), "section2": PARA.format(b=1, t="first") + table})
    xml = '<HWPML><BODY><SECTION><P><TEXT><CHAR>제1장 총칙</CHAR></TEXT></P><P><TEXT><CHAR>제1조(목적) 이 법</CHAR><TABLE><ROW><CELL><P><TEXT><CHAR>c</CHAR></TEXT></P></CELL></ROW></TABLE></TEXT></P></SECTION></BODY></HWPML>'
    df = spark.createDataFrame([("a", bytearray(doc)), ("b", bytearray(xml.encode())), ("c", bytearray(b"what")), ("d", None)], "path string, content binary")
    b = office.read_blocks(df)
    got = {r["path"]: r["content"] for r in office.to_markdown(b).collect()}
    assert got["a"] == "**first**\n\n| **a b** | [중첩표 1] |\n| --- | --- |\n| 〃 | d |\n\n[중첩표 1]\n\n| in |\n| --- |\n\n---\n\nlast"
    assert got["b"] == "## 제1장 총칙\n\n| c |\n| --- |\n\n**제1조(목적)** 이 법"
    assert {r["path"] for r in b.where("kind = 'error'").collect()} == {"c", "d"}


def test_files(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"%PDF-1.7")
    (tmp_path / "y.hwp").write_bytes(b"PK\3\4")
    (tmp_path / "z.txt").write_bytes(b"no")
    df = files.scan(spark, str(tmp_path))
    got = {r[0][-5:]: (r[1], r[2]) for r in df.select("path", files.sniff(F.col("content")), files.effective_suffix(F.col("path"), F.col("content"))).collect()}
    assert got == {"x.PDF": ("pdf", ".pdf"), "y.hwp": ("hwpx", ".hwp")}
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path), suffixes=(".none",))
    with pytest.raises(ValueError):
        files.reader(".none")
    h = bytearray(b"HWP Document File" + bytes(19) + (2).to_bytes(4, "little"))
    d = spark.createDataFrame([(bytearray.fromhex("D0CF11E0A1B11AE1"), h), (bytearray(b"x"), None)], "c binary, h binary").select(files.hwp_diagnosis(F.col("c"), F.col("h")).alias("d"))
    assert [r["d"] for r in d.collect()] == ["encrypted", "not a compound file"]


def test_providers(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "id int, prompt string")
    got = providers.ask(df, lambda rs: [None if r["id"] == 3 else r["prompt"].upper() for r in rs], batch=2).collect()
    assert [r["answer"] for r in sorted(got)] == ["P0", "P1", "P2", None, "P4"]
    assert providers.chat_url("http://h/v1/") == providers.chat_url("http://h") == "http://h/v1/chat/completions"
    assert [r["failure"] for r in sorted(got)] == [None, None, None, "no answer", None]
    dead = providers.HttpProvider("http://127.0.0.1:9", "m", timeout=1)
    assert isinstance(dead([{"prompt": "x"}])[0], providers.Unreachable)
    down = providers.ask(df.limit(1), lambda rs: [providers.Unreachable("down")] * len(rs)).first()
    assert down["answer"] is None and down["failure"] == "Unreachable: down"
    with pytest.raises(providers.Unreachable):
        dead.ask("x")


def test_config(monkeypatch, capsys):
    with pytest.raises(KeyError):
        config.check("no_such")
    monkeypatch.setenv("PAGELATTICE_SPLIT_CHARS", "50")
    monkeypatch.setenv("PAGELATTICE_LLM_TIMEOUT", "soon")
    o = config.resolve({"fill_all": "yes"})
    assert o["split_chars"] == 50 and o["fill_all"] is True and o["llm_timeout"] == 60.0
    assert config.shown({"llm_key": "0123456789abcdef"})["llm_key"] == "012345…cdef"
    assert cli.main([]) == 2 and cli.main(["x", "--set", "nope=1"]) == 2 and cli.main(["--list-options"]) == 0
    assert len(config.option_keys()) == 44


def test_batch(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny"), ("d", 2, "| c |\n|---|\n| 3 |")], "path string, page_no int, content string")

    def judge(rs):
        return [json.dumps([{"id": "table_1", "content_type": "table", "quality": "wrong", "title": "T"}]) if "<table 1>" in r["prompt"] else None for r in rs]

    def repair(rs):
        return ["| a | b |\n|---|---|\n| 1 | fixed |"] * len(rs)

    b = Batch(spark, pages, judge=judge, repair=repair)
    t = {r["id"]: r for r in b.tables.collect()}
    assert t["table_1"]["quality"] == "wrong" and "fixed" in t["table_1"]["markdown"] and t["table_2"]["quality"] == "sufficient"
    text = {r["page_no"]: r["content"] for r in b.pages.collect()}
    assert "fixed" in text[1] and "| 3 |" in text[2]
    s = b.summary().first()
    assert (s["n_pages"], s["n_tables"], s["n_filled"]) == (2, 2, 1)
    assert json.loads(b.to_json(slim=True).first()["json"])["page_count"] == 2
    b.save(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/json")).count() == 1
    with pytest.raises(KeyError):
        Batch(spark, pages, nope=1)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.html").write_text("<h1>A</h1><p>b</p>")
    s = folder.html_blocks(folder.watch(spark, str(src), "*.html"))
    folder.write(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_previews(spark):
    from pagelattice.operators import previews

    lines = ["head", "<a><b>", "<c>", "x < y", "<d|e>"]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(lines)], "d int, line_no int, text string")
    got = [(r["is_table"], r["markdown"]) for r in previews.preview_tables(df, "d").orderBy("block_no").collect()]
    assert got == [(False, "head"), (True, "| a | b |\n| --- | --- |\n| c |  |"), (False, "x < y"), (True, "| d\\|e |\n| --- |")]
    raw = spark.createDataFrame([("a\x01b \n \n c",)], "t string").select(previews.clean_raw(F.col("t"))).first()[0]
    assert raw == "ab\n□ c"


def test_report_texts(spark):
    from pagelattice.operators import previews, reports

    t = spark.createDataFrame([("d", "fill", 3.0), ("d", "read", 1.0)], "doc string, stage string, seconds double")
    p = spark.createDataFrame([("d", 1, "x", ["n"])], "doc string, page_no int, summary string, notes array<string>")
    md = previews.pipeline_markdown(reports.timing_shares(t, "doc"), p, "doc").first()["content"]
    assert "| fill | 3.0 | 75% |\n| read | 1.0 | 25% |" in md and "| 1 | x | n |" in md
    i = spark.createDataFrame([("d", 1, 1, "table", "dropped", "a|b")], "doc string, page_no int, item_order int, label string, outcome string, text string")
    o = spark.createDataFrame([("d", 1, 2, 0.5)], "doc string, a_order int, b_order int, ratio double")
    md = previews.layout_markdown(i, o, "doc").first()["content"]
    assert md.startswith("dropped: 1") and "a\\|b" in md and "- 1 / 2: 50%" in md
    assert previews.html_view(t, "doc", "stage", ["stage"]).first()["html"] == "<table><tr><th>stage</th></tr><tr><td>fill</td></tr><tr><td>read</td></tr></table>"


def test_groups_and_density(spark):
    from pagelattice.functions import gates

    b = lambda n, s: f"<table {n}>\n\n{s}\n\n</table {n}>"
    pages = spark.createDataFrame([(1, f"a\n{b(1, 'x')}\n\n{b(2, 'y')}\n\nz{b(3, 'w')}")], "d int, content string")
    groups = spark.createDataFrame([(1, "table_1,table_2", "<!-- img_from_table_1 -->")], "d int, members string, placeholder string")
    assert blocks.convert_groups(pages, groups, ["d"]).first()["content"] == f"a\n<!-- img_from_table_1 -->\n\nz{b(3, 'w')}"
    got = spark.createDataFrame([(" a b\n\n c ",), (None,)], "t string").select(*gates.text_density(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(3, 2, "a b c"), (0, 0, "")]


def test_providers_from_options():
    o = config.resolve({"llm_url": "http://a", "llm_concurrency": 3, "fallback_enabled": True, "fallback_url": "https://api.openai.example/v1", "openai_key": "k"})
    made = providers.from_options(o)
    assert made["text"].threads == 3 and made["picture"] is made["text"] and made["text"].fallback.key == "k"
    o = config.resolve({"picture_url": "http://p", "picture_enabled": True, "picture_model": "m"})
    made = providers.from_options(o)
    assert made["picture"].model == "m" and made["text"].url == made["picture"].url
    assert providers.from_options(config.resolve())["text"] is None
    adapted = providers.from_options(config.resolve({"llm_adapter": "tests.test_operators:adapter", "vlm_max_tokens": 9}))
    assert adapted["text"]([{"prompt": "x"}]) == ["x9"]


def adapter(options):
    return lambda requests: [r["prompt"] + str(options["vlm_max_tokens"]) for r in requests]


def test_layout_options():
    o = config.layout_options(config.resolve())
    assert o["recogniser"] == {"backend": "rapidocr", "languages": ["korean", "english"], "full_page": False, "runtime": "onnxruntime"} and o["model"] is None
    o = config.layout_options(config.resolve({"ocr_backend": "tesseract", "ocr_lang": "ko, de", "vlm_model": "v", "device": "cpu", "force_full_page_ocr": "yes"}))
    assert o["recogniser"] == {"backend": "tesseract", "languages": ["kor", "de"], "full_page": True} and o["model"]["device"] == "cpu"


def test_batch_stages(spark, tmp_path):
    """Recognised pages, read and promoted pictures, picture groups, outline, reports."""
    pages = spark.createDataFrame([("d", 1, "x\n| a | b |\n|---|---|\n| 1 | 2 |\ny <!-- image_1 --> z <!-- image_2 -->"), ("d", 2, "12 34")], "path string, page_no int, content string")
    images = spark.createDataFrame([("d", 1, "image_1", "<!-- image_1 -->", True, "table", "1.png"), ("d", 1, "image_2", "<!-- image_2 -->", False, None, "2.png")], "path string, page_no int, id string, placeholder string, table_candidate boolean, region_kind string, image_path string")
    scans = spark.createDataFrame([("d", 2, "p2.png", bytearray(b"recognised words of the second page"))], "path string, page_no int, page_image_path string, image binary")

    def judge(rs):
        return [json.dumps([{"id": "image_1", "content_type": "table", "title": "T"}]) if "\\n- image_1: " in r["prompt"] and "\\n- image_2: " not in r["prompt"] else None for r in rs]

    def recogniser(pictures):
        return [[(p.decode(), 0.9, [(0.0, 0.0), (9.0, 9.0)])] for p in pictures]

    b = Batch(spark, pages, judge=judge, reader=lambda rs: ["a picture of a green river"] * len(rs), recogniser=recogniser, outliner=lambda rs: [json.dumps([{"path": ["H"], "fact": "f"}])] * len(rs), images=images, page_images=scans)
    text = {r["page_no"]: r["content"] for r in b.pages.collect()}
    assert text[2] == "recognised words of the second page"
    assert "<!-- image_1 -->\n\n" in text[1] and "<!-- image_2 -->\n\na picture of a green river" in text[1]
    t = {r["id"]: r for r in b.tables.collect()}
    assert set(t) == {"table_1", "table_2"} and t["table_2"]["source_image_id"] == "image_1" and t["table_2"]["title"] == "T"
    i = {r["id"]: r for r in b.images.collect()}
    assert i["image_1"]["promoted_table_id"] == "table_2" and i["image_2"]["vlm_markdown"] == "a picture of a green river"
    assert [r["fact"] for r in b.nodes.collect()] == ["f", "f"]
    assert tuple(b.totals().first()) == (1, 1, 0)
    out = b.save(str(tmp_path / "out"))
    again = b.save(str(tmp_path / "out"), unique=True)
    assert again == out + "-2" and spark.read.json(f"{out}/outline").first()["content"] == "# H\n- f\n- f"


def test_documents(spark, tmp_path, monkeypatch, capsys):
    import logging

    from pagelattice import api

    (tmp_path / "a.html").write_text("<h1>A</h1><table><tr><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>")
    with pytest.raises(IsADirectoryError):
        api.Document(spark, str(tmp_path))
    d = api.structure(spark, str(tmp_path / "a.html"))
    whole = d.to_dict()
    assert whole["page_count"] == 1 and whole["pages"][0]["tables"][0]["id"] == "table_1" and json.loads(api.structure_to_json(spark, str(tmp_path / "a.html"), slim=True))["filename"] == "a.html"
    again = api.Document.from_dict(spark, whole)
    assert again.tables.count() == 1
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    with pytest.raises(OSError):
        api.structure(spark, str(tmp_path / "b.pdf"))
    monkeypatch.setenv("PAGELATTICE_LLM_KEY", "")
    assert api.set_api_key("0123456789abcdef") == "012345…cdef" and api.configure()["llm_key"] == "012345…cdef"
    api.configure(llm_key=None)
    with pytest.raises(KeyError):
        api.set_api_key("x", "llm_url")
    assert api.enable_logging(logging.WARNING) is api.enable_logging(logging.WARNING)
    assert cli.main([str(tmp_path), "--glob", "*.html", "--no-assess", "--out", str(tmp_path / "out")]) == 0
    assert cli.main([str(tmp_path), "--format", "markdown", "--out", str(tmp_path / "md")]) == 0 and spark.read.json(str(tmp_path / "md")).first()["content"].startswith("# A")


def test_commands(spark):
    from pagelattice.sources import commands

    f = spark.createDataFrame([("a", bytearray(b"x")), ("b", None)], "path string, content binary")
    say = lambda *c, **k: {r["path"]: (r["output"] and bytes(r["output"]), r["error"]) for r in commands.run(f, list(c), **k).collect()}
    assert say("cat") == {"a": (b"x", None), "b": (None, "no content")}
    assert say("no-such-command-here")["a"] == (None, "no command no-such-command-here") and say("false")["a"] == (None, "exit code 1")
    assert say("true")["a"] == (None, "no output") and say("sleep", "5", timeout=0.2)["a"] == (None, "took more than 0.2 seconds")
    assert commands.run(f.limit(0), ["cat"]).count() == 0
    why = commands.html_candidates(f, ["sh", "-c", "echo undefined x >&2; echo broken >&2; exit 3"]).where("path = 'a'").first()["reason"]
    assert why == "exit code 3; broken"


def test_hwp_html_way(spark):
    from pagelattice.sources import hwp

    f = spark.createDataFrame([("a", bytearray(b"broken")), ("b", bytearray(hwp.document([hwp.paragraph("w" * 300)])))], "path string, content binary")
    h = spark.createDataFrame([("a", "from html"), ("b", "from html")], "path string, text string")
    got = {r["path"]: (r["way"], r["text"][:9], r["reason"]) for r in hwp.best(f, h).collect()}
    assert got == {"a": ("html", "from html", "not a compound file"), "b": ("tree", "w" * 9, None)}


def test_positioned_cases(spark):
    t = spark.createDataFrame([(1, 2, 2), (2, 0, 3), (None, 1, 1)], "k int, n_rows int, n_cols int")
    c = spark.createDataFrame([(1, 0, 0, None, 1, 0, None, 1, None, "a"), (1, 1, 5, None, 1, 0, None, 1, None, "far"), (2, 0, 0, None, 1, 0, None, 1, True, "x")], "k int, cell_no int, row0 int, row1 int, row_span int, col0 int, col1 int, col_span int, column_header boolean, text string")
    got = {r["k"]: (r["header_rows"], r["markdown"]) for r in grid.draw_positioned(t, c, "k").collect()}
    assert got == {1: (0, "| a   |     |\n|-----|-----|"), 2: (0, ""), None: (0, "")}
    assert grid.draw_positioned(t.limit(0), c, "k").count() == 0
