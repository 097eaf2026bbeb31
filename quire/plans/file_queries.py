"""Queries that make files of the driver's tables and read them back, and of functions over columns, with their SQL."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import geometry as G
from quire.functions import media as M
from quire.functions import terminal
from quire.functions import text as X
from quire.operators import concat, html
from quire.plans import dims
from quire.plans.queries import _ASKED, _FIVE, _asked, query, table
from quire.shared import new_folder
from quire.sources import convert
from quire.sources.registered import register_files
from quire.streaming.frames import capped_chunks

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(names: list[str], parts: Column) -> Column:
    """An archive whose members have ``names`` and the texts of an array, as long as they go."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        def one(own):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for name, text in zip(names, own, strict=False):
                    z.writestr(name, text)
            return out.getvalue()

        return texts.map(one)

    return run(parts)


def each(rows: Column, part) -> Column:
    return F.array_join(F.transform(rows, part), "")


def _regions(spark, sf):
    """(r_name, nations): each region's nations in order."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    return n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "nations")


def _converted(files, ext: str):
    d = files.withColumn("path", F.concat(F.lit("d/"), F.col("r_name"), F.lit(f".{ext}")))
    return convert.to_markdown(d).select("r_name", F.col("result.md").alias("md"), F.col("result.error").alias("error"))


_NATIONS = "SELECT r_name, list(n_nationkey ORDER BY n_nationkey) AS k, list(n_name ORDER BY n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


def rows_of(template: str) -> str:
    """SQL for one text per nation of a region, put together; {k} and {n} are its key and name."""
    return f"list_aggregate(list_transform(range(1, len(n) + 1), lambda i: {template.format(k='k[i]', n='n[i]')}), 'string_agg', '')"


@query(f"SELECT r_name, '| id | name |' || chr(10) || '|---|---|' || chr(10) || {rows_of("'| ' || {k} || ' | a;' || {n} || ' |' || chr(10)")} AS md, NULL::VARCHAR AS error FROM ({_NATIONS})")
def csv_documents(spark, sf):
    lines = each(F.col("nations"), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(',"a;'), x["n_name"], F.lit('"\n')))
    return _converted(_regions(spark, sf).withColumn("content", F.concat(F.lit("id,name\n"), lines).cast("binary")), "csv")


@query(f"SELECT r_name, '## ' || r_name || chr(10) || chr(10) || {rows_of("'  * **' || {n} || '**   ' || chr(10)")} || '| id | name |' || chr(10) || '|---|---|' || chr(10) || {rows_of("'| ' || {k} || ' | ' || {n} || ' |' || chr(10)")} AS md, NULL::VARCHAR AS error FROM ({_NATIONS})")
def docx_documents(spark, sf):
    run = lambda t, p="": F.concat(F.lit(f"<w:r><w:rPr>{p}</w:rPr><w:t>"), t, F.lit("</w:t></w:r>"))
    para = lambda body, p="": F.concat(F.lit(f"<w:p><w:pPr>{p}</w:pPr>"), body, F.lit("</w:p>"))
    row = lambda *cells: F.concat(F.lit("<w:tr>"), *[F.concat(F.lit("<w:tc>"), para(run(c)), F.lit("</w:tc>")) for c in cells], F.lit("</w:tr>"))
    items = each(F.col("nations"), lambda x: para(run(x["n_name"], "<w:b/>"), '<w:numPr><w:ilvl w:val="0"/></w:numPr>'))
    rows = each(F.col("nations"), lambda x: row(x["n_nationkey"].cast("string"), x["n_name"]))
    body = F.concat(para(run(F.col("r_name")), '<w:pStyle w:val="Title"/>'), items, F.lit("<w:tbl>"), row(F.lit("id"), F.lit("name")), rows, F.lit("</w:tbl>"))
    content = F.concat(F.lit(f"<w:document {_W}><w:body>"), body, F.lit("</w:body></w:document>"))
    return _converted(_regions(spark, sf).withColumn("content", packed(["word/document.xml"], F.array(content))), "docx")


@query(f"SELECT r_name, '### ' || r_name || chr(10) || chr(10) || {rows_of("' * ' || {n} || '  ' || chr(10)")} AS md, NULL::VARCHAR AS error FROM ({_NATIONS})")
def odt_documents(spark, sf):
    items = each(F.col("nations"), lambda x: F.concat(F.lit("<text:list-item><text:p>"), x["n_name"], F.lit("</text:p></text:list-item>")))
    body = F.concat(F.lit("<text:h>"), F.col("r_name"), F.lit("</text:h><text:list>"), items, F.lit("</text:list>"))
    content = F.concat(F.lit(f"<office:document-content {_O}><office:body>"), body, F.lit("</office:body></office:document-content>"))
    return _converted(_regions(spark, sf).withColumn("content", packed(["mimetype", "content.xml"], F.array(F.lit("application/vnd.oasis.opendocument.text"), content))), "odt")


@query(f"""
    SELECT r_name, list_aggregate(list_transform(range(1, len(n) + 1), lambda i: '<!-- S-TITLE: Slide number ' || i || ' -->' || chr(10) || '# ' || n[len(n) + 1 - i]), 'string_agg', chr(10) || chr(10)) AS md, NULL::VARCHAR AS error FROM ({_NATIONS})
""")
def pptx_documents(spark, sf):
    slide = lambda x: F.concat(F.lit(f'<p:sld {_A}><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>'), x["n_name"], F.lit("</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"))
    names = [f"ppt/slides/slide{k}.xml" for k in range(9, 0, -1)]
    parts = F.transform(F.reverse("nations"), slide)
    return _converted(_regions(spark, sf).withColumn("content", packed(names, parts)), "pptx")


@query(f"SELECT r_name, '# ' || r_name || chr(10) || chr(10) || '| id | name |' || chr(10) || '|---|---|' || chr(10) || {rows_of("'| ' || {k} || ' | ' || {n} || ' |' || chr(10)")} || chr(10) AS md, NULL::VARCHAR AS error FROM ({_NATIONS})")
def xlsx_documents(spark, sf):
    text = lambda c: F.concat(F.lit('<c t="inlineStr"><is><t>'), c, F.lit("</t></is></c>"))
    rows = each(F.col("nations"), lambda x: F.concat(F.lit("<row><c><v>"), x["n_nationkey"].cast("string"), F.lit(".0</v></c>"), text(x["n_name"]), F.lit("</row>")))
    sheet = F.concat(F.lit(f"<worksheet {_S}><sheetData><row>"), text(F.lit("id")), text(F.lit("name")), F.lit("</row>"), rows, F.lit("</sheetData></worksheet>"))
    book = F.concat(F.lit(f'<workbook {_S}><sheets><sheet name="'), F.col("r_name"), F.lit('" r:id="r1"/></sheets></workbook>'))
    rels = F.lit('<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
    names = ["xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/worksheets/sheet1.xml"]
    return _converted(_regions(spark, sf).withColumn("content", packed(names, F.array(book, rels, sheet))), "xlsx")


@query(f"""
    SELECT r_name, '<!-- S-TITLE: Page number 1 -->' || chr(10) || '```pdf' || chr(10) || repeat(' ', 10) || repeat('─', 11) || chr(10) || {rows_of("chr(10) || repeat(' ', 10) || {n} || chr(10)")} || '```' AS md, NULL::VARCHAR AS error FROM ({_NATIONS})
""")
def pdf_documents(spark, sf):
    """A page per region: a name each twenty points, from the top."""
    shown = each(F.col("nations"), lambda x: F.concat(F.lit("("), x["n_name"], F.lit(") Tj 0 -20 Td ")))
    content = F.concat(F.lit("BT /F1 12 Tf 40 700 Td "), shown, F.lit("ET 40 720 m 80 720 l S"))
    head = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >> endobj\n5 0 obj << /Type /Font /Subtype /Type1 >> endobj\n4 0 obj << /Length "
    data = F.concat(F.lit(head), F.length(content).cast("string"), F.lit(" >>\nstream\n"), content, F.lit("\nendstream endobj\ntrailer << /Root 1 0 R >>"))
    return _converted(_regions(spark, sf).withColumn("content", data.cast("binary")), "pdf")


@query(f"""
    SELECT r_name, '# `a.md`' || chr(10) || chr(10) || '# ' || r_name || repeat(chr(10), 4) || '# `b/t.csv`' || chr(10) || chr(10) || '| id | name |' || chr(10) || '|---|---|' || chr(10)
        || {rows_of("'| ' || {k} || ' | ' || {n} || ' |' || chr(10)")} || chr(10) || chr(10) || '# `c.py`' || chr(10) || chr(10) || '```py' || chr(10) || 'pass' || chr(10) || '```' || chr(10) || chr(10) AS md, NULL::VARCHAR AS error FROM ({_NATIONS})
""")
def zip_documents(spark, sf):
    csv = F.concat(F.lit("id,name\n"), each(F.col("nations"), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(","), x["n_name"], F.lit("\n"))))
    return _converted(_regions(spark, sf).withColumn("content", packed(["a.md", "b/t.csv", "c.py"], F.array(F.concat(F.lit("# "), F.col("r_name")), csv, F.lit("pass")))), "zip")


@query(r"""
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '# t' || chr(10) || chr(10) WHEN 1 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 2 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 3 THEN text || chr(10) || chr(10) END AS md,
        CASE WHEN doc_id % 5 = 4 THEN 'the file isn' || chr(39) || 't UTF-8' END AS error
    FROM documents
""")
def plain_documents(spark, sf):
    """Files that need no parser: Markdown, code, no extension, HTML, and one that isn't UTF-8."""
    k = F.col("doc_id") % 5
    ext = F.when(k == 0, ".MD").when(k == 1, ".py").when(k == 2, "").when(k == 3, ".html").otherwise(".txt")
    content = F.when(k == 0, F.lit("# t").cast("binary")).when(k == 4, F.concat(F.unhex(F.lit("C328")), F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d/f"), ext).alias("path"), content.alias("content"))
    return convert.to_markdown(d).select("doc_id", F.col("result.md").alias("md"), F.col("result.error").alias("error"))


@query("""
    SELECT page_id, k::INT AS place, CASE k WHEN 0 THEN 'a.md' WHEN 1 THEN 'b/page.html' END AS name, CASE k WHEN 0 THEN md5(url) ELSE md5(html) END AS md5 FROM pages, (VALUES (0), (1)) AS v(k)
""")
def archive_members(spark, sf):
    d = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), packed(["a.md", "b/page.html"], F.array("url", "html")).alias("content"))
    return convert.members(d).select(F.col("path").cast("long").alias("page_id"), "place", "name", F.md5("bytes").alias("md5"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'odt' ELSE 'zip' END AS kind FROM supplier")
def zip_kinds(spark, sf):
    k = F.col("s_suppkey") % 3
    word, text, other = (packed(n, F.array(F.lit("application/vnd.oasis.opendocument.text"), F.col("s_name"))) for n in (["word/document.xml"], ["mimetype", "content.xml"], ["x.txt"]))
    return table(spark, sf, "supplier").select("s_suppkey", convert.zip_types(F.when(k == 0, word).when(k == 1, text).otherwise(other)).alias("kind"))


@query("""
    SELECT c_custkey, '┌' || repeat('─', w) || '┐' || chr(10) || '│' || repeat(' ', (w - n) // 2) || c_name || repeat(' ', w - n - (w - n) // 2) || '│' || chr(10) || '└' || repeat('─', w) || '┘' AS box
    FROM (SELECT *, length(c_name)::INT AS n, greatest(28, length(c_name))::INT AS w FROM customer)
""")
def title_boxes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.title_box(F.col("c_name"), 30).alias("box"))


@query("""
    SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::INT AS lines FROM documents
""")
def line_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.line_count(F.col("text")).alias("lines"))


@query("""
    SELECT p_partkey, (p_partkey % 50)::INT AS width, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END::INT AS height, p_partkey % 2 = 0 AS forced FROM part
""")
def size_options(spark, sf):
    k = F.col("p_partkey")
    text = F.concat((k % 50).cast("string"), F.lit("x"), F.when(k % 3 == 0, "y").otherwise(F.col("p_size").cast("string")), F.when(k % 2 == 0, "xforce").otherwise(""))
    o = X.size_option(text)
    return table(spark, sf, "part").select("p_partkey", o["width"].alias("width"), o["height"].alias("height"), o["force"].alias("forced"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN chr(27) || '[38;2;1;2;3m' WHEN 1 THEN chr(27) || '[91m' END AS color, event_type || chr(27) || '[0m' || chr(27) || '[31m!' AS tinted,
        chr(27) || '[' || event_id % 9 || 'C' AS moved, chr(27) || '[' || (event_id % 5 + 1) || ';' || (event_id % 7 + 1) || 'H' AS placed
    FROM events
""")
def color_sequences(spark, sf):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, "a\x1b[31mb\x1b[38;2;1;2;3mc\x1b[1m").when(k % 4 == 1, "\x1b[91m").when(k % 4 == 2, "\x1b[31mx\x1b[0m").otherwise("plain")
    return table(spark, sf, "events").select(
        "event_id", X.last_foreground(line).alias("color"), X.retint(F.concat("event_type", F.lit("\x1b[0m!")), F.lit("\x1b[31m")).alias("tinted"),
        X.cursor_offset(k % 9).alias("moved"), X.cursor_place(k % 7, k % 5).alias("placed"),
    )


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/home/u/a' WHEN 1 THEN '/home/u//home/u' ELSE 'a~b' END AS path FROM supplier")
def home_paths(spark, sf):
    path = F.element_at(F.array(*map(F.lit, ("~/a", "~/~", "a~b"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", X.expand_home(path, "/home/u").alias("path"))


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 2 THEN ' plain' ELSE ' Grüße' END AS text FROM customer")
def pdf_strings(spark, sf):
    k = F.col("c_custkey") % 3
    text = F.concat("c_name", F.lit(" Grüße"))
    data = F.when(k == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.concat("c_name", F.lit(" plain")).cast("binary"))
    return table(spark, sf, "customer").select("c_custkey", X.decode_pdf_string(data).alias("text"))


@query("""
    SELECT p_partkey, (2 * x + 3 * y + 5)::FLOAT AS x, (-1 * x + 4 * y + 6)::FLOAT AS y, (2 * x)::FLOAT AS mx, (x * 3 + 5)::FLOAT AS me FROM (SELECT p_partkey, p_size AS x, p_partkey % 17 AS y FROM part)
""")
def matrix_products(spark, sf):
    x, y = F.col("p_size"), F.col("p_partkey") % 17
    m = G.matrix(2, -1, 3, 4, 5, 6)
    at = G.apply_matrix(m, x, y)
    scaled = F.struct(x.cast("float").alias("a"), F.lit(0.0).cast("float").alias("b"), F.lit(0.0).cast("float").alias("c"), F.lit(1.0).cast("float").alias("d"), (x * 1).cast("float").alias("e"), F.lit(0.0).cast("float").alias("f"))
    shifted = F.struct(*[F.lit(v).cast("float").alias(k) for k, v in zip("abcd", (2, 0, 0, 1), strict=True)], F.lit(0.0).cast("float").alias("e"), F.lit(0.0).cast("float").alias("f"))
    tripled = F.struct(*[F.lit(v).cast("float").alias(k) for k, v in zip("abcdef", (3, 0, 0, 1, 5, 0), strict=True)])
    return table(spark, sf, "part").select("p_partkey", at["x"].alias("x"), at["y"].alias("y"), G.multiply(scaled, shifted)["a"].alias("mx"), G.multiply(scaled, tripled)["e"].alias("me"))


@query("""
    SELECT p_partkey, ((p_partkey % 256) * 100 // 255)::INT AS percent, chr(63 + (p_partkey % 64)::INT) AS sixel, CASE WHEN p_partkey % 2500 > 1536 THEN '80%' ELSE p_partkey % 2500 || 'px' END AS width,
        CASE WHEN p_size * 20 > 432 THEN '40%' ELSE p_size * 20 || 'px' END AS height, '53px' AS small, (length(p_partkey::VARCHAR) + 2)::INT AS gutter, ((1920 - 2 * p_size) // 2)::INT AS pad
    FROM part
""")
def shown_sizes(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    caps = G.image_caps(k % 2500, size * 20, G.Screen())
    box = G.pad_offsets(F.lit(1920), F.lit(1080), F.struct((2 * size).alias("width"), size.alias("height")))
    return table(spark, sf, "part").select(
        "p_partkey", G.percent_of_255(k % 256).alias("percent"), G.sixel_char(k % 64).alias("sixel"), caps["width"].alias("width"), caps["height"].alias("height"),
        G.image_caps(k % 2500, size * 20, G.Screen(), small=True)["height"].alias("small"), G.gutter(k)["width"].alias("gutter"), box["x"].alias("pad"),
    )


@query("""
    SELECT page_id, len(string_split(p, '/'))::INT AS parts, regexp_extract(p, '[^/]*$') AS name, regexp_replace(regexp_extract(p, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, 'a/b' || page_id % 3 || '/f.' || page_id || '.txt' AS p FROM pages)
""")
def name_parts(spark, sf):
    p = F.concat(F.lit("a/b"), (F.col("page_id") % 3).cast("string"), F.lit("/f."), F.col("page_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "pages").select("page_id", F.size(F.split(p, "/")).alias("parts"), X.basename(p).alias("name"), X.stem(p).alias("stem"))


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^https?://[^/]+') || '/x.png' WHEN page_id % 3 = 1 THEN 'https://o.p/q' ELSE regexp_replace(url, '[^/]*$', '') || 'y z.png' END AS url FROM pages
""")
def resolved_urls(spark, sf):
    k = F.col("page_id") % 3
    ref = F.when(k == 0, "/x.png").when(k == 1, "https://o.p/q").otherwise("y z.png")
    return table(spark, sf, "pages").select("page_id", html.resolve(F.col("url"), ref).alias("url"))


@query("""
    SELECT * FROM (SELECT user_id, event_id, sum(event_id % 100) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS upto FROM events) WHERE upto <= 1500
""")
def capped_downloads(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 100).alias("size"))
    return capped_chunks(d, 1500, "user_id", "event_id").select("user_id", "event_id", "upto")


@query(r"""
    WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<!--\s*S-TITLE:[^>]*-->|</?[a-z][a-z0-9]*[^>]*>') AS m, regexp_split_to_array(html, '(?i)<!--\s*S-TITLE:[^>]*-->|</?[a-z][a-z0-9]*[^>]*>') AS g FROM pages)
    SELECT page_id, list_aggregate(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN lower(regexp_extract(m[i], '^</?([a-zA-Z0-9]+)', 1)) IN (TAGS) THEN m[i]
        ELSE replace(replace(m[i], '<', '&lt;'), '>', '&gt;') END), 'string_agg', '') AS html FROM p
""".replace("TAGS", ", ".join(f"'{t}'" for t in html.TAGS)))
def escape_unknown_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.escape_unknown_tags(F.col("html"), html.TAGS).alias("html"))


@query("""
    WITH p AS (SELECT p_partkey // 420 AS img, p_partkey % 20 AS x, p_partkey // 20 % 21 AS y, p_partkey % 256 AS r, p_partkey * 3 % 256 AS g, p_partkey * 7 % 256 AS b FROM part),
    w AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS weight, r || ';' || g || ';' || b AS c FROM p),
    h AS (SELECT img, y // 2 AS line, x, max(c) FILTER (y % 2 = 0) AS top, max(c) FILTER (y % 2 = 1) AS low, max(weight) FILTER (y % 2 = 0) AS tw, max(weight) FILTER (y % 2 = 1) AS lw FROM w GROUP BY ALL),
    cells AS (SELECT img, line, x, CASE
        WHEN low IS NULL THEN CASE WHEN tw >= 35 THEN chr(27) || '[38;2;' || top || 'm▀' || chr(27) || '[0m' ELSE ' ' END
        WHEN tw > 25 AND lw > 25 THEN chr(27) || '[38;2;' || top || 'm' || chr(27) || '[48;2;' || low || 'm▀' || chr(27) || '[0m'
        WHEN tw > 25 THEN chr(27) || '[38;2;' || top || 'm▀' || chr(27) || '[0m' WHEN lw > 25 THEN chr(27) || '[38;2;' || low || 'm▄' || chr(27) || '[0m' ELSE ' ' END AS cell FROM h)
    SELECT img, line::INT AS line, string_agg(cell, '' ORDER BY x) AS text FROM cells GROUP BY img, line
""")
def half_block_image(spark, sf):
    from quire.operators import pixels

    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.floor(k / 420).alias("img"), (k % 20).alias("x"), (F.floor(k / 20) % 21).alias("y"), (k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 7 % 256).alias("b"), F.lit(255).alias("a"))
    return pixels.half_blocks(d)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<!-- S-TITLE: ' || source || ' -->' || chr(10) || text || chr(10) || '---' ELSE text END AS md, CASE WHEN doc_id % 2 = 0 THEN source END AS title FROM documents")
def titled_documents(spark, sf):
    md = X.with_title(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return table(spark, sf, "documents").select("doc_id", md.alias("md"), X.title(md).alias("title"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'document' END AS media, page_id % 4 = 1 OR page_id % 4 = 3 AS fits, page_id % 4 < 2 AS allowed FROM pages")
def media_kinds(spark, sf):
    k = (F.col("page_id") % 4 + 1).cast("int")
    ext = F.element_at(F.array(*map(F.lit, ("mp4", "svg", "pdf", "md"))), k)
    asked = F.element_at(F.array(*map(F.lit, ("image", "svg", "video", "svg"))), k)
    fits = F.when(k == 4, M.valid_candidate(F.lit("image"), F.lit("png"))).otherwise(M.valid_candidate(asked, ext))
    return table(spark, sf, "pages").select("page_id", M.media_type(ext).alias("media"), fits.alias("fits"), M.allowed(M.media_type(ext), documents=False).alias("allowed"))


@query(r"SELECT source, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY doc_id), '^\s+|\s+$', '', 'g') AS text FROM documents GROUP BY source")
def joined_sources(spark, sf):
    return concat.concat_documents(table(spark, sf, "documents"), "text", "doc_id", ["source"])


@query(r"""
    WITH s AS (SELECT s_nationkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, s_suppkey, s_name FROM supplier)
    SELECT file, place, s_suppkey::VARCHAR AS key, s_name || ',;' || chr(10) || '"x"' AS name, NULL AS error FROM s WHERE file <> 7
    UNION ALL SELECT DISTINCT file, NULL, NULL, NULL, 'row 1 has not as many cells as the header' FROM s WHERE file = 7
""")
def delimited_folder(spark, sf):
    """Suppliers as files by nation, of four delimiters, with quotes and line ends in cells; one file's rows have a cell too many."""
    from quire.operators.tables import DELIMITERS
    from quire.sources.delimited import read_delimited

    sep = F.get(F.array(*map(F.lit, DELIMITERS)), (F.col("s_nationkey") % len(DELIMITERS)).cast("int"))
    row = F.concat(F.col("s_suppkey").cast("string"), sep, F.lit('"'), "s_name", F.lit(',;\n""x"""'), F.when(F.col("s_nationkey") == 7, F.concat(sep, F.lit("more"))).otherwise(""))
    lines = table(spark, sf, "supplier").select("s_nationkey", sep.alias("sep"), F.struct("s_suppkey", row.alias("row")).alias("row"))
    head = F.concat(F.lit("key"), F.first("sep"), F.lit("name\n"))
    text = F.concat(head, F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["row"]), "\n"))
    folder = new_folder(spark, "delimited")
    lines.groupBy(F.col("s_nationkey").alias("file")).agg(text.alias("value")).write.partitionBy("file").text(folder)
    found = read_delimited(spark, folder)
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "place", F.get("cells", 0).alias("key"), F.get("cells", 1).alias("name"), "error")


@query("""
    WITH m AS (SELECT s_suppkey AS k, s_suppkey % 3 * 700 AS pw, s_suppkey % 5 * 300 AS ph, s_suppkey % 4 * 60 AS c, 20 + s_suppkey % 9 AS r, s_suppkey % 7 = 0 AS force, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 + s_suppkey % 4 END AS scale FROM supplier),
    w AS (
        SELECT *, trunc((CASE WHEN force OR pw = 0 OR ph = 0 THEN 1920 ELSE pw END)::FLOAT * coalesce(scale, 1)::FLOAT)::INT AS px_width, CASE WHEN force OR pw = 0 OR ph = 0 THEN 1080 ELSE ph END::INT AS px_height,
            trunc((CASE WHEN c = 0 THEN 100 ELSE c END)::FLOAT * coalesce(scale, 1)::FLOAT)::INT AS columns, CASE WHEN c = 0 THEN 20 ELSE r END::INT AS rows FROM m
    )
    SELECT k AS s_suppkey, px_width, px_height, columns, rows, (round(((columns::FLOAT / (1 + k % 6)::FLOAT)::FLOAT + 0.1::FLOAT)::FLOAT) - 2 - 1)::INT AS item_width FROM w
""")
def window_sizes(spark, sf):
    """Measured sizes of windows, with what is forced, missing and scaled, and the width of an item of a listing in each."""
    k = F.col("s_suppkey")
    px, cells = (k % 3 * 700, k % 5 * 300), (k % 4 * 60, 20 + k % 9)
    size = G.window(tuple(x.cast("int") for x in px), tuple(x.cast("int") for x in cells), G.Screen(), k % 7 == 0, F.lit(False), F.when(k % 2 == 0, 0.5 + k % 4))
    d = table(spark, sf, "supplier").select("s_suppkey", size.alias("w")).select("s_suppkey", "w.*")
    return d.withColumn("item_width", G.item_width(F.col("columns"), 1 + k % 6, 2))


@query("""
    WITH e AS (SELECT user_id, event_id, epoch_us(ts - TIMESTAMP '2024-01-01') // 1000 / 1000.0::DOUBLE AS t, base64(encode(event_type)) AS b, row_number() OVER w - 1 AS place, lead(event_id) OVER w IS NULL AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, CASE WHEN place = 1 THEN 0 ELSE lag(t) OVER (PARTITION BY user_id ORDER BY place) END AS before FROM e),
    c AS (
        SELECT *, ',f=24,i=' || user_id || ',s=1,v=' || (event_id % 5 + 1) AS size, chr(27) || '_G' AS s, chr(27) || chr(92) AS z, greatest(0, trunc((t - before) * 1000))::BIGINT AS gap FROM g
    )
    SELECT user_id, place, 0 AS step, CASE WHEN place = 0 THEN s || 'a=T' || size || ',q=2,m=0;' || b || z ELSE s || 'a=f' || size || ',c=' || (place - 1) || ',z=' || gap || ',q=2,m=0;' || b || z END AS command FROM c
    UNION ALL SELECT user_id, place, 1, s || 'a=a,s=2,v=1,r=1,i=' || user_id || ',z=100' || z FROM c WHERE place = 0
    UNION ALL SELECT user_id, place, CASE WHEN place = 0 THEN 2 ELSE 1 END, s || 'a=a,s=3,v=1,r=1,i=' || user_id || ',z=100' || z FROM c WHERE last
""")
def animation_commands(spark, sf):
    """Events as frames of a video by user."""
    from quire.operators.frames import animation_commands

    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    ms = F.floor(since / 1000) / 1000.0
    d = table(spark, sf, "events").select("user_id", "event_id", ms.alias("ts"), F.col("event_type").cast("binary").alias("data"), F.lit(1).alias("width"), (F.col("event_id") % 5 + 1).alias("height"))
    return animation_commands(d, ["user_id"], ["ts", "event_id"], number="user_id")


@query("""
    WITH f AS (SELECT s_nationkey, s_nationkey % 3 AS kind, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
    SELECT s_nationkey AS file, 'json' AS ext, (i - 1)::INT AS place, s_name AS text, NULL::VARCHAR AS error FROM f WHERE kind = 0
    UNION ALL
    SELECT s_nationkey, 'csv', 0, '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |' || chr(10), '' ORDER BY s_suppkey), NULL FROM f WHERE kind = 1 GROUP BY s_nationkey
""")
def registered_files(spark, sf):
    """Suppliers as a file for each nation in one of three formats: JSON read by a registered reader, delimited files by the library's, and texts, which a condition rules out."""
    folder = new_folder(spark, "registered")
    d = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    d = d.repartition("file").sortWithinPartitions("file", "key")
    for kind, ext in enumerate(("json", "csv", "text")):
        of = d.filter(F.col("file") % 3 == kind)
        rows = of.select("file", F.col("name").alias("value")) if ext == "text" else of
        rows.write.mode("append").option("header", "true").partitionBy("file").format(ext).save(f"{folder}/{ext}")
    register_files(spark, {"json": json_names}, "quire_suppliers")
    found = spark.read.format("quire_suppliers").load(folder).filter("ext <> 'txt'")
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "ext", "place", "text", "error")


def json_names(data: bytes):
    """The name in each line of a JSON file."""
    for line in data.splitlines():
        yield json.loads(line)["name"]


@query("""
    WITH p AS (SELECT p_partkey AS k, p_partkey % 3 > 0 AS by_cells, p_size % 9 + 1 AS cols, p_partkey % 4 + 1 AS rows, p_size * 7 AS px FROM part),
    s AS (SELECT k, CASE WHEN by_cells THEN cols ELSE ceil(px::FLOAT / (1920::FLOAT / 100::FLOAT)::FLOAT) END::INT AS w, CASE WHEN by_cells THEN rows ELSE 1 END::INT AS h FROM p)
    SELECT k AS p_partkey, list_aggregate(list_transform(range(0, h), lambda i: chr(27) || '[38;5;' || (16 + k % 216) || 'm' || chr(27) || '[48;5;' || (16 + k // 216 % 216) || 'm' || repeat('█', w) || chr(27) || '[0m'), 'string_agg', chr(10)) AS text FROM s
""")
def image_placeholders(spark, sf):
    """What stands for an image by part: sized by its cells, or by its width in pixels."""
    k = F.col("p_partkey")
    image = terminal.unicode_placeholder(F.col("p_size") % 9 + 1, k % 4 + 1, k * 70001)
    return table(spark, sf, "part").select("p_partkey", terminal.image_placeholder(image, k, F.col("p_size") * 7, k % 3 > 0, G.Screen()).alias("text"))


@query(f"""
    WITH five(theme, keyword, module, constant, background, blue) AS ({_FIVE}),
    c AS (SELECT c_custkey, lower({_ASKED}[c_custkey % {len(_ASKED) + 1} + 1]) AS asked FROM customer)
    SELECT c_custkey, ':root {{' || chr(10) || '  --keyword: ' || keyword || ';' || chr(10) || '  --type: ' || module || ';' || chr(10) || '  --constant: ' || constant || ';' || chr(10) || '  --background: ' || background || ';' || chr(10) || '}}' || chr(10) AS style
    FROM c JOIN five ON theme = CASE WHEN asked IN (SELECT theme FROM five) THEN asked ELSE 'github' END
""")
def theme_styles(spark, sf):
    """Four properties of the page style that each customer's theme gives."""
    style = dims.theme_style(_asked(), (("keyword", "keyword"), ("type", "module"), ("constant", "constant"), ("background", "background")))
    return table(spark, sf, "customer").select("c_custkey", style.alias("style"))


#: Parts of code by name, with what a language adds behind.
_PARTS = (
    "keyword keyword.control keyword.other.unit keyword.operator storage storage.type storage.modifier.async entity.name.function entity.name.type support.type support.type.property-name "
    "string.quoted.double stringy constant.numeric constant.other.color comment.line punctuation.definition.string punctuation.definition.comment punctuation.section variable.function meta.path meta"
).split()


@query(f"""
    WITH five(theme, keyword, module, constant, background, blue) AS ({_FIVE}),
    known(name, role) AS (
        VALUES ('keyword', 'keyword'), ('storage.modifier', 'keyword'), ('storage.type', 'keyword'), ('entity.name.function', 'function'), ('support.function', 'function'), ('variable.function', 'function'),
        ('module', 'module'), ('struct', 'module'), ('enum', 'module'), ('generic', 'module'), ('path', 'module'), ('meta.path', 'module'), ('entity.name.tag', 'module'), ('support.type', 'module'), ('meta.import-name', 'module'),
        ('string', 'string'), ('punctuation.string', 'string'), ('constant.other.color', 'string'), ('punctuation.definition.string', 'string'),
        ('constant', 'constant'), ('keyword.other.unit', 'constant'), ('support.constant', 'constant'), ('comment', 'comment'), ('punctuation.comment', 'comment'), ('punctuation.definition.comment', 'comment'),
        ('variable', 'foreground'), ('operator', 'foreground'), ('punctuation', 'foreground'), ('block', 'foreground'), ('support.type.property-name', 'foreground'), ('punctuation.definition', 'foreground'), ('keyword.operator', 'foreground')
    ),
    p AS (SELECT p_partkey, {_PARTS}[p_partkey % {len(_PARTS)} + 1] || CASE WHEN p_partkey % 4 > 0 THEN '.' || lower(replace(p_brand, '#', '.')) ELSE '' END AS scope, {_ASKED}[p_partkey % {len(_ASKED)} + 1] AS asked FROM part),
    r AS (SELECT p_partkey, scope, asked, coalesce((SELECT arg_max(role, length(name)) FROM known WHERE name = scope OR starts_with(scope, name || '.')), 'foreground') AS role FROM p)
    SELECT p_partkey, scope, role, CASE role WHEN 'keyword' THEN keyword WHEN 'module' THEN module WHEN 'constant' THEN constant END AS color
    FROM r JOIN five ON theme = CASE WHEN lower(asked) IN (SELECT theme FROM five) THEN lower(asked) ELSE 'github' END
""")
def scope_colors(spark, sf):
    """Roles of parts of code by their dotted names, and the colors of three roles in a theme."""
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    scope = F.concat(pick(_PARTS), F.when(k % 4 > 0, F.concat(F.lit("."), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))))).otherwise(""))
    d = table(spark, sf, "part").select("p_partkey", scope.alias("scope"), pick(_ASKED).alias("asked")).withColumn("role", dims.scope_role(F.col("scope")))
    color = F.when(F.col("role").isin("keyword", "module", "constant"), dims.scope_color(F.col("asked"), F.col("scope")))
    return d.select("p_partkey", "scope", "role", color.alias("color"))
