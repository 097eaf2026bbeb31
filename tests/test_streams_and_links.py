"""Streams with limits, replayed events, numbers over whole tables, links, and patterns on long repeats."""

import contextlib
import io
import itertools
import posixpath
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as X
from quire.operators import frames, html, links, numbering, paths, pixels, rasters, viewer
from quire.plans.dims import ROLES, THEMES
from quire.sources.delimited import read_delimited
from quire.streaming import limits
from quire.streaming.frames import capped_chunks


def streamed(spark, folder, rows, schema, batches):
    """``rows`` as a stream whose micro-batches are files, cut at random."""
    cuts = sorted(random.Random(len(rows)).sample(range(1, len(rows)), batches - 1))
    for k, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


@pytest.mark.parametrize("batches", [1, 4])
def test_throttle_streams_as_tables_are_throttled(spark, tmp_path, batches):
    rng = random.Random(batches)
    at, rows = 0.0, []
    for k in range(120):
        at += rng.choice([0.0, 0.01, 0.04, 0.2, 8000.0])
        rows.append((rng.choice(["a", "b", None]), k, at))
    schema = "key string, k long, t double"
    source = streamed(spark, tmp_path / "in", rows, schema, batches).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    with contextlib.redirect_stderr(io.StringIO()):
        got = limits.run_available(limits.stream_throttle(source, "ts", ["key"], 0.05, ["k"], late="1 second", idle=100.0), "t")
    got = {r["k"]: r["accepted"] for r in got.collect()}
    want, last = {}, {}
    for key, k, t in rows:
        us = int(t * 1_000_000)
        want[k] = key not in last or us - last[key] >= 50_000
        if want[k]:
            last[key] = us
    assert got == want
    table = spark.createDataFrame(rows, schema).withColumn("at", (F.col("t") * 1_000_000).cast("long"))
    assert {r["k"]: r["accepted"] for r in frames.throttle(table, "at", ["key"], 50_000, ["k"]).collect()} == want


@pytest.mark.parametrize("batches", [1, 5])
def test_capped_streams_close_at_the_cap(spark, tmp_path, batches):
    rng = random.Random(7)
    rows = [(rng.choice(["u", "v", "w"]), k, rng.choice([0, 5, 40, None, 300])) for k in range(80)]
    schema = "url string, ord long, size long"
    got = limits.run_available(limits.stream_capped(streamed(spark, tmp_path / "in", rows, schema, batches), 700), "c")
    want = capped_chunks(spark.createDataFrame(rows, schema).fillna({"size": 0}), 700)
    key = lambda r: (r["url"], r["ord"], r["upto"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_events_move_the_view(spark):
    rng = random.Random(2)
    names = [*viewer.MOVES, *viewer.ZOOMS, "top", "bottom", "reset", "next", "previous", "other", None]
    sizes = [(320, 240, 1000, 900), (320, 240, 100, 90), (77, 400, 801, 333)]
    rows = [(g, k, rng.choice(names), *sizes[g]) for g in range(3) for k in range(200)]
    d = spark.createDataFrame(rows, "g int, k int, event string, cw int, ch int, iw int, ih int").repartition(5)
    out = viewer.replay(d, ["g"], ["k"], images=3)
    # each state from the one before, by the library's own expressions
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("k")
    before = lambda c, x: F.coalesce(F.lag(c).over(w), F.lit(x))
    size = [F.col(c) for c in ("cw", "ch", "iw", "ih")]
    s = out.withColumns({"z0": before("zoom", 1), "x0": before("pan_x", 0), "y0": before("pan_y", 0)})
    limit = G.pan_limits(*size, F.col("z0"))
    step = lambda side: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, m in viewer.MOVES.items() for v in (k, m[side])]), F.coalesce("event", F.lit(""))), F.lit(0))
    y = F.when(F.col("event") == "top", -limit["y"]).when(F.col("event") == "bottom", limit["y"]).otherwise(G.adjust_pan(F.col("y0"), step(1), limit["y"]))
    zoom = F.greatest(F.lit(1), F.col("z0") + F.when(F.col("event") == "zoom_in", 1).when(F.col("event") == "zoom_out", -1).otherwise(0))
    s = s.withColumns({"z": F.when(F.col("event") == "reset", 1).otherwise(zoom), "x": F.when(F.col("event") == "reset", 0).otherwise(G.adjust_pan(F.col("x0"), step(0), limit["x"])), "y": F.when(F.col("event") == "reset", 0).otherwise(y)})
    held = G.clamp_pan(*size, F.col("z"), F.col("x"), F.col("y"))
    moved = (F.col("zoom") != F.col("z0")) | (F.col("pan_x") != F.col("x0")) | (F.col("pan_y") != F.col("y0"))
    wrong = s.filter((F.col("zoom") != F.col("z")) | (F.col("pan_x") != held["x"]) | (F.col("pan_y") != held["y"]) | (moved & ~F.col("changed")))
    assert out.count() == 600 and wrong.count() == 0
    shown = 0
    for r in sorted(out.filter("g = 0").collect(), key=lambda r: r["k"]):
        shown = min(2, shown + 1) if r["event"] == "next" else max(0, shown - 1) if r["event"] == "previous" else shown
        assert r["shown"] == shown and r["view"]["width"] <= 1000


def test_numbers_without_a_single_task(spark):
    rows = [(random.Random(k).randint(0, 50) if k % 9 else None, k) for k in range(500)]
    d = spark.createDataFrame(rows, "a int, k long").repartition(7)
    out = numbering.numbered(d, ["a", "k"], "n", start=1, parts=6)
    want = {k: n for n, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}
    assert {r["k"]: r["n"] for r in out.collect()} == want
    chunks = paths.chunk_rows(d, 7, ["k"])
    assert {(r["k"], r["chunk"], r["slot"]) for r in chunks.collect()} == {(k, k // 7, k % 7) for _, k in rows}
    assert "SinglePartition" not in chunks._jdf.queryExecution().toString()
    assert numbering.numbered(d.limit(0), ["k"]).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.sets(st.lists(st.sampled_from(["a", "b", "B.x", "é"]), min_size=1, max_size=4).map("/".join), min_size=1, max_size=25))
def test_walk_numbers(spark, found):
    """Numbers of a walk, also where folders aren't entries."""
    d = spark.createDataFrame([(p,) for p in found], "path string")
    walk = sorted(found, key=lambda p: [c.encode() for c in p.split("/")])
    assert {r["path"]: r["number"] for r in paths.walk_numbers(d).collect()} == {p: n for n, p in enumerate(walk)}


# --- links


def followed(entries, path, hops=0):
    """Where a path leads once no part of it is a link; None for a loop."""
    parts = path.split("/")
    for n in range(2, len(parts) + 1):
        head = "/".join(parts[:n])
        target = entries.get(head, (False, None))[1]
        if target is not None:
            if hops > 60:
                return None
            aim = posixpath.normpath(posixpath.join(posixpath.dirname(head), target))
            return followed(entries, posixpath.normpath(f"{aim.rstrip('/')}/{'/'.join(parts[n:])}"), hops + 1)
    return path


def walk_by_hand(entries):
    def inside(folder, shown, way):
        for p in sorted(entries):
            if posixpath.dirname(p) != folder:
                continue
            is_dir, target = entries[p]
            at = f"{shown}/{posixpath.basename(p)}"
            if target is None:
                yield at, p, is_dir
                if is_dir:
                    yield from inside(p, at, [*way, p])
            else:
                real = followed(entries, p)
                if real in entries and real not in way:
                    yield at, real, entries[real][0]
                    if entries[real][0]:
                        yield from inside(real, at, [*way, real])

    yield from inside("/", "", [])


TREES = [
    {"/a": (True, None), "/a/f": (False, None), "/b": (True, None), "/b/x": (False, "../a"), "/b/y": (False, "x/f"), "/b/z": (False, "/b/x/../a//f"), "/c": (False, "/c"), "/d": (False, "e"), "/e": (False, "d"), "/g": (False, "/none")},
    {"/a": (True, None), "/a/up": (False, ".."), "/a/self": (False, "."), "/a/b": (True, None), "/a/b/l": (False, "/c"), "/c": (True, None), "/c/m": (False, "../a/b"), "/c/f": (False, None)},
    {f"/k{n}": (False, f"/k{n + 1}") for n in range(6)} | {"/k6": (True, None), "/k6/f": (False, None)},
]


@pytest.mark.parametrize("tree", TREES)
def test_links_and_walks(spark, tree):
    d = spark.createDataFrame([(p, is_dir, target) for p, (is_dir, target) in tree.items()], "path string, is_dir boolean, target string")
    want = {}
    for p, (_, target) in tree.items():
        if target is not None:
            final = followed(tree, p)
            want[p] = (final, "loop" if final is None else "found" if final in tree else "missing")
    assert {r["path"]: (r["final"], r["state"]) for r in links.resolve_links(d).collect()} == want
    got = sorted((r["path"], r["real"], r["is_dir"]) for r in links.walk_links(d).collect())
    assert got == sorted(walk_by_hand(tree))


def test_many_links_to_one_folder_are_the_work_of_many_tasks(spark):
    files = spark.range(1000).selectExpr("concat('/to/f', id) AS path", "false AS is_dir", "null AS target")
    ways = spark.range(1000).selectExpr("concat('/from/l', id) AS path", "false AS is_dir", "'/to' AS target")
    d = files.unionAll(ways).unionAll(spark.createDataFrame([("/to", True, None), ("/from", True, None)], files.schema))
    walked = links.walk_links(d).withColumn("task", F.spark_partition_id())
    assert walked.select("path").distinct().count() == walked.count() == 1002 + 1000 * 1001
    assert walked.filter("path = '/from/l7/f9' AND real = '/to/f9' AND NOT is_dir").count() == walked.filter("path = '/from/l7' AND real = '/to' AND is_dir").count() == 1
    tasks = [r["count"] for r in walked.groupBy("task").count().collect()]
    assert max(tasks) < 0.6 * sum(tasks)


def test_rows_that_move_grow_slower_than_the_pairs(spark):
    ways = spark.range(20_000).selectExpr("'/to' AS final", "concat('/from/l', id) AS path")
    inside = spark.range(20_000).selectExpr("'/to' AS final", "concat('/to/f', id) AS real", "false AS is_dir")
    left, right = links._dealt(ways, inside)
    # 79 blocks of 256 would move 3,160,000
    assert left.count() + right.count() < 1_400_000
    assert left.select("final", "_way", "_entry").distinct().count() > 500


def test_more_links_than_file_systems_follow_are_a_loop(spark, monkeypatch):
    monkeypatch.setattr(links, "MOST_HOPS", 4)
    rows = [(f"/k{n}", False, f"/k{n + 1}") for n in range(7)] + [("/k7", False, None)]
    got = {r["path"]: r["state"] for r in links.resolve_links(spark.createDataFrame(rows, "path string, is_dir boolean, target string")).collect()}
    assert got["/k0"] == "loop" and got["/k6"] == got["/k4"] == "found"


# --- patterns on long repeats


def test_patterns_take_no_stack(spark):
    one = lambda x: spark.createDataFrame([(1, "http://a/", x)], "page_id int, url string, html string")
    blank = spark.createDataFrame([("a\n" + " \n" * 100_000 + "b",)], "text string")
    assert blank.select(X.limit_newlines(F.col("text"))).first()[0] == "a\n\nb"
    pages = {
        "<img " + "a " * 100_000: [], "<img " + "a='b' " * 100_000 + "src=x>": ["x"], '<img src="' + "a" * 300_000: [], "<img '" * 50_000: [],
        '<img alt="src=no" SRC = "i.png">': ["i.png"], "<img alt='a > b' src='j'>": ["j"], "<imgs src=k><img data-src=m>": [], "<img src=''><img src=a src=b>": ["", "a"],
    }
    for page, want in pages.items():
        assert [r["src"] for r in html.media_candidates(one(page)).collect()] == want


def test_themes_are_whole():
    assert len(THEMES) == 21 and all(list(t) == list(ROLES) and len(ROLES) == 20 for t in THEMES.values())
    assert all(c[0] == "#" and int(c[1:7], 16) >= 0 for t in THEMES.values() for c in t.values())


# --- rasters


def pixel_rows(width, height, seed, missing=0.0):
    rng = random.Random(seed)
    return [(f"i{seed}", x, y, *(rng.randint(0, 255) for _ in range(4))) for y in range(height) for x in range(width) if rng.random() >= missing or (x, y) == (width - 1, height - 1)]


PIXELS = "img string, x int, y int, r int, g int, b int, a int"


def test_png_files_are_read_back(spark, tmp_path):
    rows = pixel_rows(5, 3, 1) + pixel_rows(150, 140, 2) + pixel_rows(9, 8, 3, missing=0.4)
    made = rasters.png(spark.createDataFrame(rows, PIXELS).repartition(3)).collect()
    for r in made:
        (tmp_path / f"{r['img']}.png").write_bytes(r["png"])
    held = {r[:3]: r[3:] for r in rows}
    images = spark.read.format("image").load(str(tmp_path)).select(F.element_at(F.split("image.origin", "[/.]"), -2).alias("img"), "image")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in pixels.image_pixels(images).collect()}
    assert len(got) == 15 + 150 * 140 + 72
    assert {k: v for k, v in got.items() if k in held} == held and all(v == (0, 0, 0, 0) for k, v in got.items() if k not in held)


def test_raster_files(spark, monkeypatch):
    monkeypatch.setattr(rasters, "PIECE_BYTES", 16)  # a range of few rows each
    sample = bytes(range(24))
    tga = lambda kind, bits, flip: bytes([3, 0, kind, *[0] * 9, 4, 0, 2, 0, bits, flip]) + b"abc"
    files = {
        "p6": b"P6 #c\n# more\n4\t2\n255\n" + sample, "p5": b"P5\n4 2 15\n" + bytes(range(8)), "p6w": b"P6 2 2 65535 " + sample, "ff": b"farbfeld" + bytes([0, 0, 0, 1, 0, 0, 0, 3]) + sample,
        "t24": tga(2, 24, 32) + sample, "t24up": tga(2, 24, 0) + sample, "t8": tga(3, 8, 32) + sample[:8], "short": b"P6 4 3 255 " + sample, "other": b"\x89PNG...", "none": None, "empty": b"",
    }
    d = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {}
    for r in rasters.raster_pixels(d).collect():
        got.setdefault(r["path"], {})[r["x"], r["y"]] = (r["r"], r["g"], r["b"], r["a"])
    wide = lambda a, b: ((a * 256 + b) * 510 + 65535) // 131070
    want = {k: {} for k in ("p6", "p5", "p6w", "ff", "t24", "t24up", "t8")}
    for y, x in itertools.product(range(2), range(4)):
        a, b, c = sample[12 * y + 3 * x :][:3]
        want["p6"][x, y], want["t24"][x, y], want["t24up"][x, 1 - y] = (a, b, c, 255), (c, b, a, 255), (c, b, a, 255)
        want["p5"][x, y], want["t8"][x, y] = ((4 * y + x) * 17,) * 3 + (255,), (4 * y + x,) * 3 + (255,)
    for y, x in itertools.product(range(2), range(2)):
        want["p6w"][x, y] = (*[wide(*sample[12 * y + 6 * x + 2 * k :][:2]) for k in range(3)], 255)
    for y in range(3):
        want["ff"][0, y] = tuple(wide(*sample[8 * y + 2 * k :][:2]) for k in range(4))
    assert got == want


def lanczos(n_in, n_out):
    scale = n_in / n_out
    wide = max(scale, 1)
    t = (np.arange(n_in)[None, :] + 0.5 - (np.arange(n_out)[:, None] + 0.5) * scale) / wide
    w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


@pytest.mark.parametrize(("width", "height", "box"), [(7, 5, (3, 9)), (4, 9, (12, 20)), (1, 1, (5, 4)), (30, 3, (6, 6))])
def test_resampling(spark, width, height, box):
    rows = pixel_rows(width, height, 5)
    d = spark.createDataFrame(rows, PIXELS)
    out = rasters.resample(d, spark.createDataFrame([("i5", *box)], "img string, width int, height int"), pad=True).collect()
    ratio = np.float32(width) / np.float32(height)
    broad = ratio > np.float32(box[0]) / np.float32(box[1])
    new = (box[0], max(1, round(float(np.float32(box[0]) / ratio)))) if broad else (max(1, round(float(np.float32(box[1]) * ratio))), box[1])
    plane = np.zeros((height, width, 4))
    for _, x, y, *c in rows:
        plane[y, x] = c
    plane[:, :, :3] *= plane[:, :, 3:] / 255
    done = np.einsum("ys,xt,stc->yxc", lanczos(height, new[1]), lanczos(width, new[0]), plane)
    whole = lambda v: np.clip(np.floor(np.round(v, 6) + 0.5), 0, 255)
    alpha = whole(done[:, :, 3])
    with np.errstate(divide="ignore", invalid="ignore"):
        colors = np.where(alpha[:, :, None] == 0, 0, whole(done[:, :, :3] * 255 / done[:, :, 3:]))
    want = np.zeros((box[1], box[0], 4), int)
    top, left = (box[1] - new[1]) // 2, (box[0] - new[0]) // 2
    want[top : top + new[1], left : left + new[0]] = np.concatenate([colors, alpha[:, :, None]], axis=2)
    got = np.full((box[1], box[0], 4), -1)
    for r in out:
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"], r["a"]
    assert (got == want).all()


# --- delimited files


def test_delimited_folders(spark, tmp_path):
    files = {
        "a.csv": 'k,"a,b",c\n1,"x\ny","q""q"\n2,,\n', "b.csv": "k;v\n1;2,3\n", "sub/c.csv": "k\tv\n1\t2\n3\t4", "d.csv": "k|v\n1|2\n3|4|5\n", "e.csv": "single\nx\ny\n", "f.csv": "k|v\n7\n", "g.csv": "only;header\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sorted((r["path"].rsplit("/", 1)[1], r["place"] or 0, r["names"], r["cells"], r["error"]) for r in read_delimited(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", 1, ["k", "a,b", "c"], ["1", "x\ny", 'q"q'], None), ("a.csv", 2, ["k", "a,b", "c"], ["2", "", ""], None), ("b.csv", 1, ["k", "v"], ["1", "2,3"], None),
        ("c.csv", 1, ["k", "v"], ["1", "2"], None), ("c.csv", 2, ["k", "v"], ["3", "4"], None), ("d.csv", 0, ["k", "v"], None, "row 2 has not as many cells as the header"),
        ("e.csv", 1, ["single"], ["x"], None), ("e.csv", 2, ["single"], ["y"], None), ("f.csv", 0, ["k", "v"], None, "row 1 has not as many cells as the header"),
    ]


def test_vectors_meet_blocks_of_centers(spark, monkeypatch):
    monkeypatch.setattr(pixels, "CENTER_BLOCK", 3)
    rng = np.random.default_rng(4)
    rows, centers = rng.random((40, 3)).round(2).tolist(), rng.random((11, 3)).round(2).tolist()
    d = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, embedding array<double>").repartition(3)
    c = spark.createDataFrame([(k, v) for k, v in enumerate(centers)], "idx int, center array<double>")
    got = {r["k"]: r["idx"] for r in pixels.nearest_vector(d, c).collect()}
    dist = ((np.array(rows)[:, None] - np.array(centers)[None]) ** 2).sum(axis=2)
    assert all(abs(dist[k, i] - dist[k].min()) < 1e-12 for k, i in got.items()) and len(got) == 40


def test_animations_of_one_frame_and_of_none(spark):
    d = spark.createDataFrame([(1, 0, 5.0, bytearray(b"ab" * 4000))], "id int, k int, ts double, data binary").withColumns({"width": F.lit(2), "height": F.lit(1)})
    sent = [r["command"] for r in sorted(frames.animation_commands(d, ["id"], ["k"]).collect(), key=lambda r: (r["place"], r["step"]))]
    assert len(sent) == 3 and sent[0].count("\x1b_G") == 3 and sent[0].startswith("\x1b_Ga=T,f=24,i=1,s=2,v=1,q=2,m=1;") and "s=2,v=1,r=1" in sent[1] and "s=3" in sent[2]
    assert frames.animation_commands(d.limit(0), ["id"], ["k"]).count() == 0
