"""Ignore rules, wrapping, highlighting, encodings, palettes and terminal strings against plain versions."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import terminal, wrapping
from quire.operators import grid, highlight, html, images, inputs, paths, pixels, tables, walk
from quire.sources import convert, pdf


@pytest.mark.parametrize(
    ("line", "path", "match"),
    [
        ("*.log", "a/b.log", True), ("*.log", "b.logs", False), ("/x", "x", True), ("/x", "a/x", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("**/t", "q/t", True), ("d/**", "d/e/f", True),
        ("d/**", "d", False), ("f?o", "foo", True), ("f?o", "f/o", False), ("[a-c]1", "b1", True), ("[!a-c]1", "b1", False), ("[!a-c]1", "d1", True), (r"\#x", "#x", True), (r"a\*", "a*", True), (r"a\*", "ab", False), ("x y", "x y", True), ("a.b", "aXb", False),
    ],
)
def test_ignore_patterns(line, path, match):
    assert bool(re.search(walk.ignore_rule(line)[0], path)) is match


def test_ignore_lines():
    assert walk.ignore_rule("# c") is None and walk.ignore_rule("") is None and walk.ignore_rule("  ") is None and walk.ignore_rule("!") is None
    assert walk.ignore_rule("!keep/ \r\n")[1:] == (True, True) and walk.ignore_rule("a\\ ")[0].endswith("a\\ $")


def test_walk(spark):
    names = ["a", "a/.h", "a/x.log", "a/keep.log", "b", "b/c", "b/c/y.txt", ".git", ".git/config", "z.log"]
    dirs = {"a", "b", "b/c", ".git"}
    d = spark.createDataFrame([(n, n in dirs) for n in names], "path string, is_dir boolean")
    rules = walk.ignore_rules(spark.createDataFrame([("", "*.log\nc/\n"), ("a", "!keep.log")], "dir string, text string"))
    left = {r["path"] for r in walk.walked(d, rules).collect()}
    assert left == {"a", "a/keep.log", "b"}
    assert walk.walked(d, rules, everything=True).count() == len(names) and walk.walked(d).count() == len(names) - 3


def test_images_and_gates(spark):
    refs = spark.createDataFrame([("i.png", "d"), ("/r.png", "d"), ("http://x", "d"), (None, "d"), ("i.png", None)], "src string, dir string")
    files = spark.createDataFrame([("d/i.png",), ("/r.png",)], "path string")
    got = [(r["src"], r["local"], r["found"]) for r in images.located(refs, files).collect()]
    assert sorted(got, key=str) == sorted([("i.png", True, "d/i.png"), ("/r.png", True, "/r.png"), ("http://x", False, None), (None, None, None), ("i.png", True, None)], key=str)


def cost(lines, width):
    out = 0
    for k, line in enumerate(lines):
        size = sum(map(len, line)) + len(line) - 1
        out += wrapping.LINE + (wrapping.OVERFLOW * (size - width) if size > width else (width - size) ** 2 if k < len(lines) - 1 else wrapping.SHORT if len(line) == 1 and size * 4 < width else 0)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=9), st.integers(3, 16))
def test_fitted_lines_cost_least(words, width):
    lines = wrapping.fitted(words, width)
    assert sum(lines, []) == words

    def every(rest):
        if not rest:
            yield []
        for k in range(1, len(rest) + 1):
            for tail in every(rest[k:]):
                yield [rest[:k], *tail]

    legal = [x for x in every(words) if all(len(p) == 1 or sum(map(len, p)) + len(p) - 1 <= width for p in x)]
    assert cost(lines, width) == min(cost(x, width) for x in legal)


def test_color_goes_on():
    red = "\x1b[31m"
    out = wrapping.wrap_with_color(f"{red}one two three four\x1b[0m five", 9, 9, "| ")
    first, *rest = out.split("\n")
    assert len(rest) >= 2 and rest[0].startswith(f"| {red}") and wrapping.visible(first) <= 9
    assert wrapping.wrap_with_color("short", 9, 9) == "short"
    assert wrapping.wrap_lines("a b c d e f\nx\n", 9, 1, "> ", "  ").startswith(" > a\n") and wrapping.wrap_lines("x\n", 20, 1, "> ", "").endswith("x\n")


def test_shell_words(spark):
    d = spark.createDataFrame([("less -R 'a b'",), ('x "open',), (None,)], "c string")
    assert [r[0] for r in d.select(wrapping.split_words(F.col("c"))).collect()] == [["less", "-R", "a b"], None, None]


@pytest.mark.parametrize("lang", ["py", "rust", "sql", "html", "tex", "none", "text"])
def test_highlight_keeps_the_code(lang):
    code = 'def f(x): # note\n  return "s\\"" + 12.5 // y\n/* a\nb */ -- c\n<!-- d --> % e'
    shown = highlight.highlight(code, lang)
    assert re.sub(r"\x1b\[[0-9;]*m", "", shown) == code and (lang == "text") == (shown == code)
    full = re.sub(r"\x1b\[[0-9;]*m", "", highlight.code_full(code, lang, width=60))
    assert all(f" {k} │" in full.replace("  ", " ") or f"{k} │" in full for k in range(1, 6)) and "┬" in full and "┴" in full
    assert "  " + code.split("\n")[0] in re.sub(r"\x1b\[[0-9;]*m", "", highlight.code_simple(code, lang, width=100))


@pytest.mark.parametrize(
    ("text", "encoding"),
    [
        ("plain", "utf-8"), ("Grüße aus Köln, schöne Zeit für Bücher", "windows-1252"), ("Привет, как твои дела сегодня вечером", "windows-1251"), ("これはテストです。ひらがなとカタカナ", "shift_jis"), ("これはテストです。ひらがなとカタカナ", "euc_jp"),
        ("这是一个简单的中文测试文本我们在这里写字", "gb18030"), ("한국어로 쓰여진 짧은 문장입니다", "euc_kr"), ("Grüße", "utf-8"), ("wide", "utf-16"),
    ],
)
def test_encodings(text, encoding):
    data = text.encode(encoding)
    found = convert.guess_encoding(data)
    assert data.decode(found).removeprefix("﻿") == text
    assert convert.guess_encoding(("é" * 5000).encode()) == "utf-8"


@pytest.mark.parametrize(
    ("text", "encoding"),
    [
        ("Que le " * 9 + "Èrépa Èrépa Èrépa mentouque", "windows-1252"), ("Que le. çmentan, êèè é. çmentan, êèè é.", "windows-1252"), ("éçè èmentê et éçè èmentê", "windows-1252"), ("ieré desèpaouelle éçç", "windows-1252"),
        ("這是一個簡單的中文測試文本我們在這裡寫字", "gb18030"), ("Слово hello значит здравствуйте, а bye значит пока", "windows-1251"), ("Файл readme.txt лежит в папке C:\\Temp", "koi8_r"),
    ],
)
def test_latin_letters_beside_others_tell_western_text(text, encoding):
    assert convert.guess_encoding(text.encode(encoding)) == encoding


@pytest.mark.parametrize(
    ("text", "encoding"),
    [
        ("La la de. " + "ééê. " * 20, "windows-1252"), ("En " * 20 + "èèé de èèé. Èêè ch", "windows-1252"), ("hand ed üöö on", "windows-1252"), ("De de ciónñírr doasque su.", "windows-1252"), ("ciónñóos " * 40, "windows-1252"),
        ("Ñóñ íñíñ", "windows-1252"), ("ÉÈÊ ÄÖÜ", "windows-1252"), ("!! PAS!! ÉÉÈTRE.", "windows-1252"), ("La la " * 2000 + "éêçè Leètion", "windows-1252"),
        ("щука и хвощ", "windows-1251"), ("Ошибка: нет доступа", "koi8_r"), ("return x; // счет", "windows-1251"), ("你好,世界", "gb18030"), ("龍鳳呈祥", "gb18030"),
    ],
)
def test_words_of_accents_alone_are_told_by_their_letters(text, encoding):
    data = text.encode(encoding)
    assert convert.guess_encoding(data, len(data)) == encoding


def test_texts_in_other_encodings(spark):
    d = spark.createDataFrame([("a.txt", "Köln".encode("latin-1")), ("b.md", b"# x"), ("c.csv", b"a,b\n1,2\n")], "path string, content binary").withColumn("name", F.col("path"))
    got = {r["path"]: r["result"] for r in convert.to_markdown(d, detect=True, name="name").collect()}
    assert "Köln" in got["a.txt"]["md"] and got["b.md"]["md"].startswith("<!-- S-TITLE: b.md -->") and got["c.csv"]["error"] is None


def test_deep_and_endless_archives():
    import io
    import zipfile

    def zipped(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    data = zipped("n.md", "bottom")
    for _ in range(20):
        data = zipped("in.zip", data)
    assert "bottom" in convert.zip_markdown(data)
    inner = zipped("n.md", "x")
    import hashlib

    assert "holds itself" in convert.zip_markdown(zipped("in.zip", inner), (hashlib.sha256(inner).digest(),))


def test_placeholders_have_marks_for_every_high_byte(spark):
    marks = terminal.diacritics()
    d = spark.range(256).select((F.col("id") * 2**24 + 0x010203).alias("image"))
    shown = [r[0] for r in d.select(terminal.unicode_placeholder(F.lit(1), F.lit(2), F.col("image"))).collect()]
    color, cell = "\x1b[38;2;1;2;3m", chr(0x10EEEE)
    assert shown == [f"{color}{color}{cell}{marks[0]}{marks[0]}{m}\n{color}{cell}{marks[1]}{marks[0]}{m}\x1b[39m" for m in marks[:256]]


def test_texts_over_texts_are_counted_by_cells(spark):
    d = spark.range(1000).selectExpr("0 AS page", "id AS ord", "0.0D AS x", "780.0D AS y", "if(id = 999, 'a😀é 한', concat('𝄞', id)) AS text")
    shown = grid.grid_text(d)
    assert [r["text"] for r in shown.collect()] == ["a😀é 한"]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "max_by(" in plan and "SortAggregate" not in plan


def test_grid_is_that_of_the_page(spark):
    units = [(1, 1, 40.0, 700.0, "Hello"), (1, 2, 48.0, 700.0, "you"), (1, 3, 2.0, 655.0, "low"), (2, 1, 0.0, 0.0, " "), (3, 1, 1000.0, 5.0, "far")]
    d = spark.createDataFrame(units, "page int, ord int, x double, y double, text string")
    got = {r["page"]: r["text"] for r in grid.grid_text(d).collect()}
    plain = {}
    for page, own in itertools.groupby(units, key=lambda u: u[0]):
        lines = pdf.grid([pdf.Unit("text", u[2], u[3], text=u[4]) for u in own])
        if lines:
            plain[page] = "\n".join(lines)
    assert got == plain and got[1].split("\n")[0] == " " * 10 + "Heyou"
    cut = pdf.grid([pdf.Unit("text", 600, 5000, text="abcdefgh"), pdf.Unit("line", 0, 50, 12, 50)], compat=True)
    assert cut[0].rstrip() == " " * 150 + "abcd" and len({len(x) for x in cut}) == 1 and cut[-1].startswith("────")
    assert [spark.range(1).select(grid.is_fake_line(F.lit(w), F.lit(h))).first()[0] for w, h in ((1, 9), (9, 1), (1, 1), (9, 9))] == [True, True, False, False]


def test_palette(spark):
    rng = random.Random(3)
    rows = [(rng.choice([10, 200]) + rng.randint(0, 3), rng.choice([20, 220]), 30) for _ in range(400)]
    d = spark.createDataFrame(rows, "r int, g int, b int")
    found = pixels.palette_of(d, 4)
    assert len(found) == 4 and {(r > 100, g) for r, g, _ in found} == {(False, 20), (False, 220), (True, 20), (True, 220)}
    assert pixels.palette_of(d.limit(0)) == [] and len(pixels.palette_of(d, 256)) <= 256


def test_nearest_of_many_centers(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(k, [rng.random() for _ in range(3)]) for k in range(30)]
    d = spark.createDataFrame([(k, [float(rng.random()) for _ in range(3)]) for k in range(50)], "id int, embedding array<float>")
    centers = spark.createDataFrame(vectors, "idx int, center array<float>")
    whole = {r["id"]: (r["idx"], r["dist"]) for r in pixels.nearest_vector(d, centers).collect()}
    monkeypatch.setattr(pixels, "CENTER_BLOCK", 4)
    assert {r["id"]: (r["idx"], r["dist"]) for r in pixels.nearest_vector(d, centers).collect()} == whole


def test_image_pixels(spark):
    image = "struct<width:int,height:int,nChannels:int,data:binary>"
    d = spark.createDataFrame([(1, (2, 1, 3, bytes([1, 2, 3, 4, 5, 6]))), (2, (1, 2, 1, bytes([7, 8]))), (3, (1, 1, 4, bytes([1, 2, 3, 9]))), (4, None)], f"img int, image {image}")
    got = sorted(map(tuple, pixels.image_pixels(d).collect()))
    assert got == [(1, 0, 0, 3, 2, 1, 255), (1, 1, 0, 6, 5, 4, 255), (2, 0, 0, 7, 7, 7, 255), (2, 0, 1, 8, 8, 8, 255), (3, 0, 0, 3, 2, 1, 9)]


def test_candidates_in_odd_markup(spark):
    text = "<img alt='a > b' src = \"x y.png\"><!-- <img src=c.png> --><IMG SRC=z.svg><script>\"<img src='q.png'>\"</script>"
    d = spark.createDataFrame([(1, "https://a/b/", text)], "page_id int, url string, html string")
    assert [r["src"] for r in html.media_candidates(d).orderBy("ord").collect()] == ["x y.png", "z.svg", "z.svg"]


def test_inputs(spark):
    d = spark.createDataFrame([("a.mp4", 2), ("b.mov", 1)], "path string, ord int")
    assert tuple(inputs.video_list(d).first()) == ("file 'b.mov'\nfile 'a.mp4'\n", "mov") and inputs.first_input(d).first()["path"] == "b.mov"
    assert [r["path"] for r in inputs.all_inputs(d, d).orderBy("place").collect()] == ["b.mov", "a.mp4"] * 2


def test_terminal_strings(spark):
    one = spark.range(1)
    long = "x" * 9000
    text = one.select(terminal.kitty_image(F.lit(long), F.lit("a=T"))).first()[0]
    assert text.count("\x1b_G") == 3 and text.startswith("\x1b_Ga=T,q=2,m=1;") and text.endswith(f"q=2,m=0;{'x' * 808}\x1b\\") and len(terminal.diacritics()) == 297
    assert one.select(terminal.kitty_image(F.lit(""), F.lit("a=T"))).first()[0] == ""
    assert one.select(terminal.trim_ansi(F.lit("\x1b[1m  a b \x1b[0m"))).first()[0] == "\x1b[1ma b\x1b[0m"
    assert one.select(terminal.unicode_placeholder(F.lit(0), F.lit(0), F.lit(1))).first()[0] == "\x1b[38;2;0;0;1m\x1b[39m"


def test_tree_and_widths(spark):
    d = spark.createDataFrame([("/b", True), ("/b/y", False), ("/b/x", False), ("/c", False)], "path string, is_dir boolean")
    rows = {r["path"]: r for r in paths.tree_labels(d).collect()}
    assert {p: r["last"] for p, r in rows.items()} == {"/b": False, "/b/x": False, "/b/y": True, "/c": True} and len({r["number"] for r in rows.values()}) == 4
    w = spark.createDataFrame([("日本", "a\nlonger"), (None, "x")], "name string, v string")
    assert {r["name"]: r["width"] for r in tables.column_widths(w, ["name", "v"]).collect()} == {"name": 4, "v": 6}
