"""Queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quire.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float) and (v == int(v) if math.isfinite(v) else False):
        return int(v)
    return list(v) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_display_width_measures_every_document(spark, tmp_path):
    texts = ["plain", "Straße", "“curly”", "日本語 x", "e\u0301a", "a\u200bb", "ＡＢ", "two\nlines\t", "\x1b[31mred\x1b[0m", "", None]
    want = [5, 6, 7, 8, 2, 2, 4, 8, 3, 0, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["width"] for r in Q.QUERIES["display_width"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))


def test_half_blocks_draw_every_part(spark, tmp_path):
    spark.range(1000).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    weight = lambda c: 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]
    color = lambda c, k: f"\x1b[{k};2;{c[0]};{c[1]};{c[2]}m"
    pixel = {(k // 420, k // 20 % 21, k % 20): (k % 256, k * 3 % 256, k * 7 % 256) for k in range(1000)}
    assert len(pixel) == 1000
    want = {}
    for img, y, x in sorted(pixel):
        if y % 2 == 0:
            top, low = pixel[img, y, x], pixel.get((img, y + 1, x))
            up, down = weight(top) > 25, low is not None and weight(low) > 25
            if low is None:
                cell = color(top, 38) + "▀\x1b[0m" if weight(top) >= 35 else " "
            elif up and down:
                cell = color(top, 38) + color(low, 48) + "▀\x1b[0m"
            else:
                cell = color(top, 38) + "▀\x1b[0m" if up else color(low, 38) + "▄\x1b[0m" if down else " "
            want[img, y // 2] = want.get((img, y // 2), "") + cell
    got = Q.QUERIES["half_block_image"](spark, str(tmp_path)).collect()
    assert {(r["img"], r["line"]): r["text"] for r in got} == want and len(got) == len(want)


def test_outline_has_the_headings_of_texts(spark, tmp_path):
    texts = ["plain words", "## Part 1.2\n\ntext\n\nUnder\n=====\n\nmore", "a\n\n### C-3 (x)\n\n```\n# code\n```\n\nLow\n---\n"]
    want = [[(1, 1, "s")], [(1, 1, "s"), (3, 2, "Part 1.2"), (7, 1, "Under")], [(1, 1, "s"), (5, 3, "C-3 (x)"), (11, 2, "Low")]]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["md_outline"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["line"], r["level"], r["title"]) for r in got) == [(k, *h) for k, hs in enumerate(want) for h in hs]
