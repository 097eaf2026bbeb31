import json
import re
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import media as M
from quire.functions import terminal
from quire.functions import text as X
from quire.functions.geometry import Screen
from quire.operators import html, markdown
from quire.plans import dims

FIXTURES = Path(__file__).resolve().parent.parent / "FIXTURES.md"


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_golden_html(spark):
    vector = json.loads(re.search(r"```json\n(.*?)\n```", FIXTURES.read_text(), re.S)[1])
    got = one(spark, html.html_to_markdown(F.lit(vector["input"])))[0]
    assert got["content"] == vector["expected"]


def test_centered_lines(spark):
    got = one(spark, html.html_to_markdown(F.lit('a<h1 align="center">T</h1><p align=CENTER>x<br>y</p>z')))[0]
    assert got["content"] == "a\n# T\nx\ny\nz"
    assert got["centered_lines"] == [2, 3, 4]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("", ""), ("a", "a"), ("<foo <b>x", "&lt;foo &lt;b&gt;x"), ("<B>x</B><h1>", "<B>x</B><h1>"), ("<html><p>", "&lt;html&gt;<p>"), ("<!-- S-TITLE: x -->", "&lt;!-- S-TITLE: x --&gt;"), ("1 < 2 > 0", "1 < 2 > 0")],
)
def test_escape_unknown_tags(spark, text, expected):
    assert one(spark, X.escape_unknown_tags(F.lit(text), html.TAGS))[0] == expected


def test_text_functions(spark):
    assert one(spark, X.quote(F.lit("a\nb\n")), X.extension(F.lit("a.b/C.TXT")), X.extension(F.lit(".bashrc")), X.stem(F.lit("d/a.tar.gz"))) == ("> a\n> b", "txt", None, "a.tar")
    assert one(spark, X.title(F.lit("x <!-- S-TITLE: Hi there --> y")), X.title(F.lit("x"))) == ("Hi there", None)
    assert one(spark, X.limit_newlines(F.lit("a\n \n\t\n\nb\n\nc"))) == ("a\n\nb\n\nc",)
    assert one(spark, X.normalize_blank_lines(F.lit("a\n   \n\n\n b"))) == ("a\n\n b\n",)
    assert one(spark, X.fit_filename(F.lit("ab"), 5), X.fit_filename(F.lit("abcdefgh.txt"), 8), X.fit_filename(F.lit("abcdefgh.txt"), 8, True)) == (" ab  ", "abcd.txt", "abc..txt")
    assert one(spark, X.image_ref(F.lit("a#b.png#640x")))[0].asDict() == {"base": "a#b.png", "original": "a#b.png#640x", "width": 640, "height": None}
    assert one(spark, X.last_foreground(F.lit("\x1b[31ma\x1b[1mb")), X.last_foreground(F.lit("\x1b[31ma\x1b[0mb"))) == ("\x1b[31m", None)
    assert one(spark, X.string_len(F.lit("\x1b[1m日本é\x1b[0m"))) == (5,)
    assert one(spark, X.size_option(F.lit("10x20xforce")))[0].asDict() == {"width": 10, "height": 20, "force": True}
    assert one(spark, X.decode_pdf_string(F.lit(bytearray(b"\xfe\xff\x00A"))), X.decode_pdf_string(F.lit(bytearray("é".encode())))) == ("A", "é")
    assert one(spark, X.color_hex(F.lit(1.0), F.lit(0.5), F.lit(0.0)), X.expand_home(F.lit("~/a~"), "/h")) == ("#FF8000", "/h/a/h")
    assert one(spark, X.title_box(F.lit("ab"), 8)) == ("┌──────┐\n│  ab  │\n└──────┘",)
    assert one(spark, X.cursor_offset(F.lit(None)), X.cursor_place(F.lit(0), F.lit(1)), X.retint(F.lit("a\x1b[0m"), F.lit("C"))) == ("", "\x1b[2;1H", "a\x1b[0mC")


def test_geometry(spark):
    fit = one(spark, G.fit(F.lit(1920), F.lit(1080), F.lit(800), F.lit(400)))[0]
    assert (fit["width"], fit["height"]) == (711, 400)
    assert one(spark, G.center_offset(F.lit(500), G.Screen(), True), G.center_offset(F.lit(960), G.Screen(), False)) == (0, 25)
    assert one(spark, G.adjust_pan(F.lit(0), F.lit(5), F.lit(4)), G.adjust_pan(F.lit(0), F.lit(4), F.lit(4))) == (0, 4)
    limits = one(spark, G.pan_limits(F.lit(100), F.lit(100), F.lit(200), F.lit(100), F.lit(1)))[0]
    assert (limits["x"], limits["y"]) == (0, 0)
    m = one(spark, G.multiply(G.matrix(2, 0, 0, 2, 1, 1), G.matrix(1, 0, 0, 1, 5, 6)))[0]
    assert (m["a"], m["e"], m["f"]) == (2.0, 6.0, 7.0)
    assert G.Screen.of((0, 5), (9, 9), False) == (9, 9) and G.Screen(px_width=100).scaled(0.5).px_width == 50
    assert one(spark, G.sixel_char(F.lit(63)), G.percent_of_255(F.lit(254))) == ("~", 99)


def test_sniff_compat(spark):
    gif = F.lit(bytearray(b"GIF89a"))
    assert one(spark, M.sniff(gif), M.sniff(gif, compat=True), M.sniff(F.lit(bytearray(b"Good text")))) == ("gif", "ts", "md")


@settings(deadline=None)
@given(st.text("ab \n\t", max_size=40))
def test_render_never_fails(text):
    markdown.to_html(text)
    markdown.to_terminal(text)
    assert len(markdown.node_rows(text)) >= 1


@settings(deadline=None)
@given(st.text("#*_`[]()!<>|-+1. \nab~^\\:", max_size=60))
def test_odd_markup_never_fails(text):
    markdown.to_html(text, "nord")
    markdown.to_terminal(text, "none")
    html.to_markdown(text)


def test_markdown_nodes():
    kinds = [r[3] for r in markdown.node_rows("# T\n\n> [!TIP]\n> x\n\n- [ ] a\n- b\n\nTerm\n: text\n\n| a |\n|---|\n| b |\n\n[^1]: n\n\n||s|| ~~d~~ [[w]] ![i](u)")]
    for kind in "heading alert task_item item description_list description_term description_details table table_cell footnote_definition spoiler strikethrough wiki_link image".split():
        assert kind in kinds, kind


def test_page_style():
    page = markdown.to_html("# x", "nord")
    assert page.startswith("<!DOCTYPE html>") and "--background: #272E37;" in page and "<h1>x</h1>" in page


def test_image_placeholders(spark):
    screen = Screen()
    cell = "\x1b[38;5;{}m\x1b[48;5;{}m{}\x1b[0m"
    mark = terminal.PLACEHOLDER
    cases = [
        (f"{mark}{mark}\n{mark}\n", 217, 0, True, "\n".join([cell.format(17, 17, "██")] * 2)),
        (f"{mark}\n\n", 0, 0, True, "\n".join([cell.format(16, 16, "█")] * 2)),
        ("no cells", 5, 0, True, cell.format(21, 16, "")), ("", 5, 0, True, ""), ("", 5, 20, False, cell.format(21, 16, "██")), ("x", 215, 0, False, cell.format(231, 16, "")),
        ("x", 216 * 216, None, False, cell.format(16, 16, "█")), (None, 1, 10, True, None), (None, 1, 10, False, None),
    ]
    d = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, image string, number long, width int, by_cells boolean")
    got = d.select("k", terminal.image_placeholder(F.col("image"), F.col("number"), F.col("width"), F.col("by_cells"), screen)).collect()
    assert dict(map(tuple, got)) == {k: c[4] for k, c in enumerate(cases)}


def test_scopes_and_styles(spark):
    cases = {"keyword": "keyword", "keyword.operator.x": "foreground", "keywords": "foreground", "": "foreground", "storage": "foreground", "storage.type": "keyword", "meta.path.rust": "module", "punctuation.definition.string.begin": "string", None: None}
    d = spark.createDataFrame([(s,) for s in cases], "scope string")
    assert dict(map(tuple, d.select("scope", dims.scope_role(F.col("scope"))).collect())) == cases
    theme = spark.createDataFrame([("NORD",), ("none",), (None,)], "theme string")
    assert [r[0] for r in theme.select(dims.scope_color(F.col("theme"), F.lit("keyword.x"))).collect()] == ["#81A1C1", "#FF7B72", "#FF7B72"]
    style = theme.select(dims.theme_style(F.col("theme"))).first()[0]
    assert style.startswith(":root {\n  --keyword: #81A1C1;\n") and "  --type: #8FBCBB;\n" in style and style.endswith("  --border: #434C5E;\n}\n") and style.count(";") == 9


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "`", "!", "[", "]", "(", ")", "<", ">", "*", "_", "~", "|", "^", "$", " ", "  ", "\n", "a", "h", "http://x", "b^c"]), max_size=30))
def test_inline_meets_all_that_its_pattern_finds(parts):
    text = "".join(parts)
    assert [m.span() for m in markdown._matches(text)] == [m.span() for m in markdown._INLINE.finditer(text)]


def test_long_paragraphs_take_time_in_proportion():
    began = time.process_time()
    nodes = markdown.inline("word and word\n" * 50_000, 3)
    assert [n.line for n in nodes[:4]] == [3, 3, 4, 4] and nodes[-1].line == 50_002 and len(nodes) == 100_000
    markdown.inline("so many words with hats " * 200_000, 1)
    assert time.process_time() - began < 3


def test_nodes_go_on_in_batches(spark, monkeypatch):
    monkeypatch.setattr(markdown, "BATCH_NODES", 7)
    texts = ["# a\n\nb *c*", None, "", "- x\n- y\n", "word"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, md string").coalesce(1)
    got = [tuple(r) for r in markdown.md_nodes(d).collect()]
    assert got == [(k, *row) for k, t in enumerate(texts) if t is not None for row in markdown.node_rows(t)]
