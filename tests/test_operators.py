import pytest
from pyspark.sql import functions as F

from quire.operators import concat, frames, html, paths, pixels, tables


def test_table_literal(spark):
    t = tables.table_of(F.array(F.lit("Names"), F.lit("Salary")), F.array(F.array(F.lit("Sarah"), F.lit("100")), F.array(F.lit("Jeff"), F.lit("200"))))
    assert spark.range(1).select(t).first()[0] == "| Names | Salary |\n|---|---|\n| Sarah | 100 |\n| Jeff | 200 |\n"


def test_table_nulls_and_escape(spark):
    d = spark.createDataFrame([(2, "a|b"), (1, None)], "k int, v string")
    assert tables.markdown_table(d, ["k", "v"], ["k"]).first()["md"] == "| k | v |\n|---|---|\n| 1 |  |\n| 2 | a|b |\n"
    assert "a\\|b" in tables.markdown_table(d, ["k", "v"], ["k"], escape=True).first()["md"]


def test_kinds_of_nothing(spark):
    empty = spark.createDataFrame([], "path string, ord long")
    assert [tuple(r) for r in concat.kinds(empty).collect()] == [("text", 0)]


def test_concat_keeps_order(spark):
    d = spark.createDataFrame([(3, "c\n"), (1, " a"), (2, "b")], "ord int, md string")
    assert concat.concat_documents(d).first()["md"] == "a\n\nb\n\nc"


def test_cover_is_by_component(spark):
    files = spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",)], "path string")
    dirs = spark.createDataFrame([("/a/b",)], "path string")
    assert [r[0] for r in paths.outside(files, dirs).collect()] == ["/a/bc"]
    assert sorted(r[0] for r in paths.expand(files, dirs).collect()) == ["/a/b", "/a/b/c"]
    chosen = spark.createDataFrame([("/a/b", True), ("/a/bc", False)], "path string, is_dir boolean")
    assert [r[0] for r in paths.select_paths(files, chosen).collect()] == ["/a/b", "/a/b/c", "/a/bc"]


def test_grid_lines(spark):
    d = spark.createDataFrame([("d/b.txt", False), ("d/A", True), ("d/.x", False), ("d/a.txt", False)], "path string, is_dir boolean")
    listed = paths.listing(d)
    assert [r["name"] for r in listed.orderBy("place").collect()] == ["A", "a.txt", "b.txt"]
    assert [r["line"] for r in paths.grid_lines(listed, 2, 5, 1).orderBy("chunk").collect()] == ["   A   a.txt ", " b.txt "]


def test_nearest_takes_the_first(spark):
    d = spark.createDataFrame([(10, 0, 0)], "r int, g int, b int")
    assert pixels.nearest(d, [(0, 0, 0), (20, 0, 0)]).first()["idx"] == 0
    with pytest.raises(ValueError):
        pixels.nearest(d, [(0, 0, 0)] * 257)


def test_runs_come_back(spark):
    values = ["a", "a", None, None, "b", "a"]
    d = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    rows = pixels.runs(d, "v", ["k"]).orderBy("run").collect()
    assert [v for r in rows for v in [r["v"]] * r["n"]] == values
    assert [r["n"] for r in rows] == [2, 2, 1, 1]


def test_half_blocks(spark):
    d = spark.createDataFrame([(1, 0, 0, 255, 255, 255, 255), (1, 0, 1, 0, 0, 0, 255), (1, 0, 2, 30, 30, 30, 0)], "img int, x int, y int, r int, g int, b int, a int")
    rows = {r["line"]: r["text"] for r in pixels.half_blocks(d).collect()}
    assert rows == {0: "\x1b[38;2;255;255;255m▀\x1b[0m", 1: " "}


def test_sixel_round_trip(spark):
    d = spark.createDataFrame([(1, x, y, 255 * ((x + y) % 2), 0, 0) for x in range(5) for y in range(8)], "img int, x int, y int, r int, g int, b int")
    data = pixels.sixel(d, [(0, 0, 0), (255, 0, 0)]).first()["data"]
    assert data.startswith('\x1bPq"1;1;5;8#0;2;0;0;0#1;2;100;0;0') and data.endswith("\x1b\\")
    body = data[len('\x1bPq"1;1;5;8#0;2;0;0;0#1;2;100;0;0') : -2]
    seen = {}
    for band, line in enumerate(body.split("-")):
        for part in line.split("$"):
            color, chars = int(part[1]), part[2:]
            x = 0
            while chars:
                n = 1
                if chars[0] == "!":
                    digits = ""
                    chars = chars[1:]
                    while chars[0].isdigit():
                        digits, chars = digits + chars[0], chars[1:]
                    n = int(digits)
                bits, chars = ord(chars[0]) - 63, chars[1:]
                for _ in range(n):
                    for k in range(6):
                        if bits >> k & 1:
                            seen[(x, band * 6 + k)] = color
                    x += 1
    assert seen == {(x, y): (x + y) % 2 for x in range(5) for y in range(8)}


def test_delays(spark):
    d = spark.createDataFrame([(1, 0.5, b"x"), (1, 0.5, b"x"), (1, 0.625, b""), (1, 0.75, b"x")], "video_id int, ts double, data binary")
    delays = [round(r["delay"], 3) for r in frames.text_delays(d, data="data").orderBy("ts").collect()]
    assert delays == [0.033, 0.033, 0.25]
    gaps = [r["gap"] for r in frames.graphics_delays(d).orderBy("ts").collect()]
    assert gaps == [None, 500, 125, 125]


def test_throttle(spark):
    d = spark.createDataFrame([(1, t) for t in (0.0, 0.03, 0.06, 0.08, 0.12)] + [(2, 0.01)], "k int, t double")
    rows = {(r["k"], r["t"]): r["accepted"] for r in frames.throttle(d, "t", ["k"]).collect()}
    assert rows == {(1, 0.0): True, (1, 0.03): False, (1, 0.06): True, (1, 0.08): False, (1, 0.12): True, (2, 0.01): True}


def test_biggest_media(spark):
    pages = spark.createDataFrame([(1, "https://h/p/", '<img src="a.png"><img src=b.png><video src="c.mp4"></video><object data="d.svg">')], "page_id int, url string, html string")
    found = html.media_candidates(pages)
    assert [(r["ord"], r["src"], r["kind"]) for r in found.orderBy("ord").collect()] == [(0, "a.png", "image"), (1, "b.png", "image"), (2, "d.svg", "svg"), (3, "c.mp4", "video")]
    media = spark.createDataFrame([("a.png", "image/png", 7), ("b.png", "image/png", 7), ("c.mp4", "video/mp4", 9), ("d.svg", "image/png", 99)], "src string, mime string, size long")
    assert html.biggest_media(found, media).first()["src"] == "c.mp4"
    assert html.biggest_media(found, media, videos=False).first()["src"] == "a.png"
    assert html.biggest_media(found, media, most=6).isEmpty()
    assert found.select(html.resolve(F.col("base"), F.col("src"))).first()[0] == "https://h/p/a.png"


def test_image_pixels(spark, tmp_path):
    import struct
    import zlib

    raw = b"".join(b"\0" + bytes(v for x in range(2) for v in (10 * x, 20 * y, 5, 255)) for y in range(3))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    images = spark.read.format("image").load(str(tmp_path)).withColumn("img", F.lit(1))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in pixels.image_pixels(images).collect()}
    assert got == {(x, y): (10 * x, 20 * y, 5, 255) for x in range(2) for y in range(3)}
