"""One query per operator over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import media as M
from quire.functions import terminal, wrapping
from quire.functions import text as X
from quire.operators import concat, frames, grid, html, images, inputs, links, markdown, numbering, paths, pixels, rasters, tables, viewer, walk
from quire.plans.dims import LANGUAGES, language_icon, lookup, theme_color
from quire.sources import convert

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, *rows: tuple) -> DataFrame:
    """A literal table."""
    names = columns.split()
    entry = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(entry, rows))))


def sql_values(columns: str, *rows: tuple) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(columns.split())})"


def dealt(spark: SparkSession, sf_dir: str, columns: str, *rows: tuple) -> DataFrame:
    """Each customer with one of the rows' values, by key, as new columns."""
    names = columns.split()
    entry = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)])
    given = F.get(F.array(*map(entry, rows)), (F.col("c_custkey") % len(rows)).cast("int"))
    return table(spark, sf_dir, "customer").withColumn("_given", given).select("*", "_given.*").drop("_given")


def sql_dealt(columns: str, *rows: tuple) -> str:
    return f"(SELECT * FROM customer JOIN {sql_values(f'given {columns}', *[(k, *r) for k, r in enumerate(rows)])} ON given = c_custkey % {len(rows)})"


# --- tables and documents

@query(r"""
    SELECT '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10)
        || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS md
    FROM nation
""")
def md_table_nation(spark, sf):
    return tables.markdown_table(table(spark, sf, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


@query(r"""
    WITH t AS (
        SELECT r_name, '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10)
            || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) AS md
        FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
    )
    SELECT trim(string_agg('<!-- S-TITLE: ' || r_name || ' -->' || chr(10) || md || chr(10) || '---', chr(10) || chr(10) ORDER BY r_name), chr(10) || ' ') AS md
    FROM t
""")
def md_table_by_region(spark, sf):
    joined = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    per = tables.markdown_table(joined, ["n_nationkey", "n_name"], ["n_nationkey"], ["r_name"])
    return concat.concat_documents(per, "md", "r_name", name="r_name")


@query("""
    SELECT c_mktsegment, c_nationkey, '| c_custkey | c_name |' || chr(10) || '|---|---|' || chr(10)
        || string_agg('| ' || c_custkey || ' | ' || c_name || ' |', chr(10) ORDER BY c_custkey) || chr(10) AS md
    FROM customer GROUP BY ALL
""")
def md_table_customers(spark, sf):
    return tables.markdown_table(table(spark, sf, "customer"), ["c_custkey", "c_name"], ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""
    SELECT 'n_nationkey' AS name, greatest(11, max(length(n_nationkey::VARCHAR)))::INT AS width FROM nation
    UNION ALL SELECT 'n_name', greatest(6, max(length(n_name)))::INT FROM nation
    UNION ALL SELECT 'n_regionkey', greatest(11, max(length(n_regionkey::VARCHAR)))::INT FROM nation
""")
def md_colwidths(spark, sf):
    return tables.column_widths(table(spark, sf, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query(r"""
    SELECT conv_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), '^\s+|\s+$', '', 'g') AS text
    FROM conversations GROUP BY conv_id
""")
def ordered_concat_conversation(spark, sf):
    return concat.concat_documents(table(spark, sf, "conversations"), "text", "turn", ["conv_id"])


@query("""
    SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, lang) > 1 THEN coalesce(CASE WHEN doc_id % 3 = 0 THEN 'doc ' || doc_id END, source || '/' || doc_id) END AS title
    FROM documents
""")
def assign_names(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("name"))
    return concat.assign_names(d, "path", "name", ["source", "lang"]).select("doc_id", "title")


_EXT = "CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.PNG' WHEN 2 THEN '.mp4' WHEN 3 THEN '' ELSE '.ts' END"


def _with_ext(spark, sf):
    k = F.col("page_id") % 5
    ext = F.when(k == 0, ".html").when(k == 1, ".PNG").when(k == 2, ".mp4").when(k == 3, "").otherwise(".ts")
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("dir/"), F.col("page_id").cast("string"), ext).alias("path"))


@query(f"""
    SELECT kind, min(page_id) AS first FROM (
        SELECT page_id, CASE WHEN lower({_EXT}) = '.png' THEN 'image' WHEN {_EXT} IN ('.mp4', '.ts') THEN 'video' ELSE 'text' END AS kind FROM pages
    ) GROUP BY kind
""")
def kinds_present(spark, sf):
    return concat.kinds(_with_ext(spark, sf), "path", "page_id")


@query("SELECT ['image', 'text', 'video'] AS kinds, false AS ok")
def mixed_kinds_guard(spark, sf):
    return concat.mixed_kinds(_with_ext(spark, sf), "path", interactive=True)


@query("""
    WITH l AS (
        SELECT o_orderkey, concat_ws(CASE o_orderkey % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ' ' END, o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus) AS line
        FROM orders
    ), c AS (
        SELECT o_orderkey, d, k, length(line) - length(replace(line, d, '')) AS n FROM l, (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) AS v(d, k)
    )
    SELECT o_orderkey, arg_max(d, n * 10 + k) AS delimiter FROM c GROUP BY o_orderkey
""")
def delimiter_detect(spark, sf):
    k = F.col("o_orderkey") % 5
    sep = lambda s: F.concat_ws(s, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    line = F.when(k == 0, sep(",")).when(k == 1, sep(";")).when(k == 2, sep("\t")).when(k == 3, sep("|")).otherwise(sep(" "))
    return table(spark, sf, "orders").select("o_orderkey", tables.detect_delimiter(line).alias("delimiter"))


# --- kinds, types and first bytes

@query("""
    SELECT doc_id, '.' || doc_id % 7 AS n,
        CASE doc_id % 7 WHEN 0 THEN 'video' WHEN 1 THEN 'image' WHEN 2 THEN 'image' WHEN 3 THEN 'text' WHEN 4 THEN 'text' WHEN 5 THEN 'video' ELSE 'text' END AS kind,
        CASE doc_id % 7 WHEN 0 THEN 'mp4' WHEN 1 THEN 'jpg' WHEN 2 THEN 'svg' WHEN 3 THEN 'md' WHEN 4 THEN NULL WHEN 5 THEN 'gif' ELSE NULL END AS ext
    FROM documents
""")
def ext_to_kind(spark, sf):
    n = F.col("doc_id") % 7
    names = ["a/b.mp4", "a.b/c.JPG", "x.svg", "r.md", "a.b/noext", "v.Gif", ".bashrc"]
    path = F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("."), n.cast("string")).alias("n"), M.kind(path).alias("kind"), X.extension(path).alias("ext"))


_MIMES = (
    ("image/png; charset=binary", "png"), ("image/jpeg", "jpg"), ("image/apng", "apng"), ("application/vnd.ms-excel.sheet.macroenabled.12", "xls"),
    ("application/vnd.oasis.opendocument.text", "odt"), ("text/x-markdown", "md"), ("video/x-matroska", "mkv"), ("text/plain", None), ("application/zip", "zip"), ("image/vnd.microsoft.icon", "ico"),
)


@query(f"SELECT c_custkey, mime || '; name=' || c_name AS mime, ext FROM {sql_dealt('mime ext', *_MIMES)}")
def mime_to_ext(spark, sf):
    mime = F.concat("mime", F.lit("; name="), "c_name")
    return dealt(spark, sf, "mime", *[(m,) for m, _ in _MIMES]).select("c_custkey", mime.alias("mime"), M.mime_extension(mime).alias("ext"))


@query("""
    WITH h AS (SELECT page_id AS id, 'page' AS what, lower(try(decode(encode(html)[1:512]))) AS head FROM pages
        UNION ALL SELECT doc_id, 'doc', lower(try(decode(encode(text)[1:512]))) FROM documents)
    SELECT id, what, coalesce(contains(head, '<!doctype html') OR contains(head, '<html'), false) AS is_html FROM h
""")
def sniff_html(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("what"), M.is_html(F.col("html").cast("binary")).alias("is_html"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("what"), M.is_html(F.col("text").cast("binary")).alias("is_html"))
    return p.unionAll(d)


_MAGIC = (
    ("mp4", "0000001866747970" + b"mp42".hex(), "mp4"), ("m4v", "0000001866747970" + b"m4v ".hex(), "m4v"), ("mov", "0000001466747970" + b"qt  ".hex(), "mov"),
    ("mkv", "1A45DFA39F42", "mkv"), ("avi", b"RIFF....AVI LIST".hex(), "avi"), ("wmv", "3026B2758E66CF11A6D9", "wmv"), ("flv", b"FLV\1".hex(), "flv"),
    ("gif", b"GIF89a..".hex(), "gif"), ("png", "89504E470D0A1A0A0000", "png"), ("webp", b"RIFF....WEBPVP8 ".hex(), "png"), ("pdf", b"%PDF-1.7\n".hex(), "pdf"),
    ("zip", "504B030414000600", "zip"), ("html", b"\n<!DOCTYPE html><p>".hex(), "html"), ("text", "Grüße".encode().hex(), "md"), ("bad", "C328FF00", None),
)


@query(f"SELECT c_custkey, name, kind FROM {sql_dealt('name bytes kind', *_MAGIC)}")
def sniff_magic(spark, sf):
    """Customers' names as content behind first bytes of many kinds."""
    content = F.concat(F.unhex("bytes"), F.col("c_name").cast("binary"))
    return dealt(spark, sf, "name bytes", *[m[:2] for m in _MAGIC]).select("c_custkey", "name", M.sniff(content).alias("kind"))


@query("""
    SELECT 'https://github.com/a/b/blob/main/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.png?raw=true' ELSE '.png?raw=true' END AS url, page_id FROM pages WHERE page_id % 3 <> 2
    UNION ALL SELECT url, page_id FROM pages WHERE page_id % 3 = 2
""")
def github_blob_urls(spark, sf):
    p = table(spark, sf, "pages")
    blob = F.concat(F.lit("https://github.com/a/b/blob/main/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".png?raw=true"))
    url = F.when(F.col("page_id") % 3 == 2, F.col("url")).otherwise(blob)
    return p.select("page_id", M.github_raw(url).alias("url"))


_ROUTED = tuple((a, b) for a in ("md", "html", "image", "video") for b in ("md", "html", "image", "inline", "interactive", "auto"))


@query(f"""
    SELECT c_custkey, source, target, coalesce(max(result) FILTER (WHERE b = target), max(result) FILTER (WHERE b = '*')) AS result
    FROM {sql_dealt('source target', *_ROUTED)} LEFT JOIN {sql_values('a b result', *M.ROUTES).replace('AS v', 'AS r')} ON a = source AND b IN (target, '*') GROUP BY c_custkey, source, target
""")
def output_routes(spark, sf):
    return dealt(spark, sf, "source target", *_ROUTED).select("c_custkey", "source", "target", M.route(F.col("source"), F.col("target")).alias("result"))


_ICONS = (("a", True, "folder"), ("mp4", False, "video"), ("", False, "file"), ("py", False, "code"), ("ini", False, "conf"), ("tar", False, "archive"), ("docx", False, "txt"), ("ts", False, "video"),
    ("fstab", False, "conf"), ("grub", False, "conf"), ("fish_aliases", False, "conf"), ("crx", False, "archive"), ("sit", False, "archive"), ("zipx", False, "archive"), ("zz", False, "archive"), ("fish", False, "code"), ("log", False, "txt"))


@query(f"SELECT c_custkey, ext, icon FROM {sql_dealt('ext is_dir icon', *_ICONS)}")
def icon_classes(spark, sf):
    return dealt(spark, sf, "ext is_dir", *[i[:2] for i in _ICONS]).select("c_custkey", "ext", M.icon(F.col("ext"), F.col("is_dir")).alias("icon"))


_ENVS = (("xterm-kitty", "", "kitty"), ("xterm-256color", "iTerm.app", "iterm"), ("foot", "", "sixel"), ("xterm", "WezTerm", "iterm"), ("dumb", "", "ascii"))


@query(f"SELECT c_custkey, term, encoder FROM {sql_dealt('term program encoder', *_ENVS)}")
def encoder_detect(spark, sf):
    env = F.create_map(F.lit("TERM"), F.lower("term"), F.lit("TERM_PROGRAM"), F.lower("program"))
    return dealt(spark, sf, "term program", *[e[:2] for e in _ENVS]).select("c_custkey", "term", M.encoder(env).alias("encoder"))


# --- text

@query("SELECT doc_id, '```' || lang || chr(10) || text || chr(10) || '```' AS md FROM documents")
def fence_fallback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fence(F.col("text"), F.col("lang")).alias("md"))


@query(r"""
    SELECT doc_id, regexp_replace(replace(text, '. ', '.' || repeat(chr(10) || ' ', (doc_id % 4 + 1)::INT) || chr(10)), '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g') AS text FROM documents
""")
def limit_newlines(spark, sf):
    many = F.concat(F.lit("."), F.repeat(F.lit("\n "), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("\n"))
    return table(spark, sf, "documents").select("doc_id", X.limit_newlines(F.replace(F.col("text"), F.lit(". "), many)).alias("text"))


@query(r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\n$', '') || chr(10), '\n[ \t]+\n', chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text
    FROM (SELECT doc_id, replace(text, '. ', '.' || repeat(chr(10), (doc_id % 5 + 1)::INT)) AS t FROM documents)
""")
def normalize_blank_lines(spark, sf):
    many = F.concat(F.lit("."), F.repeat(F.lit("\n"), (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", X.normalize_blank_lines(F.replace(F.col("text"), F.lit(". "), many)).alias("text"))


@query("SELECT doc_id, CASE WHEN text = '' THEN '' ELSE '> ' || replace(regexp_replace(text, '\\n$', ''), chr(10), chr(10) || '> ') END AS text FROM documents")
def quote_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.quote(F.col("text")).alias("text"))


@query("""
    SELECT doc_id, n::INT AS n, lines[n] AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS n)
""")
def number_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("n", "line"))
    return d.select("doc_id", (F.col("n") + 1).alias("n"), "line")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' / ' || doc_id END AS title, length(text) + CASE WHEN doc_id % 2 = 0 THEN length(source || ' / ' || doc_id) + 23 ELSE 0 END AS n FROM documents")
def title_extract(spark, sf):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit(" / "), F.col("doc_id").cast("string")))
    d = table(spark, sf, "documents").withColumn("md", X.with_title(F.col("text"), name))
    return d.select("doc_id", X.title(F.col("md")).alias("title"), F.length("md").cast("long").alias("n"))


@query("SELECT page_id, length(html) AS length, html IS NOT NULL AS kept FROM pages WHERE length(html) <= 4000")
def size_cap_filter(spark, sf):
    p = table(spark, sf, "pages").filter(F.length("html") <= 4000)
    return p.select("page_id", F.length("html").cast("long").alias("length"), F.col("html").isNotNull().alias("kept"))


@query("""
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'img/' || c_custkey || '.png' WHEN 1 THEN 'img/' || c_custkey || '.png' ELSE 'img/' || c_custkey || '.png' END AS base,
        CASE WHEN c_custkey % 3 = 1 THEN -1 WHEN c_custkey * 10 > 65535 OR c_custkey % 3 = 2 THEN -1 ELSE c_custkey * 10 END::INT AS width,
        CASE c_custkey % 3 WHEN 1 THEN -1 ELSE 48 END::INT AS height
    FROM customer
""")
def image_refs(spark, sf):
    k = F.col("c_custkey")
    src = F.concat(F.lit("img/"), k.cast("string"), F.lit(".png"))
    url = X.image_ref_text(src, F.when(k % 3 == 0, k * 10), F.when(k % 3 != 1, F.lit(48)))
    r = X.image_ref(url)
    return table(spark, sf, "customer").select("c_custkey", r["base"].alias("base"), F.coalesce(r["width"], F.lit(-1)).alias("width"), F.coalesce(r["height"], F.lit(-1)).alias("height"))


@query("""
    SELECT s_suppkey, CASE WHEN n <= 12 THEN repeat(' ', ((12 - n) // 2)::INT) || name || repeat(' ', (12 - n - (12 - n) // 2)::INT)
        ELSE left(s_name, 8) || '.txt' END AS cell
    FROM (SELECT *, s_name || '.txt' AS name, length(s_name) + 4 AS n FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN left(s_name, 5) ELSE s_name END AS s_name FROM supplier))
""")
def fit_filenames(spark, sf):
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, F.substring("s_name", 1, 5)).otherwise(F.col("s_name")), F.lit(".txt"))
    return table(spark, sf, "supplier").select("s_suppkey", X.fit_filename(name, 12).alias("cell"))


@query("""
    SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '​' ELSE translate(reverse(
        CASE WHEN n_nationkey >= 16 THEN (n_nationkey // 16)::VARCHAR ELSE '' END || CASE WHEN n_nationkey >= 4 THEN (n_nationkey // 4 % 4)::VARCHAR ELSE '' END || (n_nationkey % 4)::VARCHAR), '0123', '​‌‍⁠') END AS id
    FROM nation
""")
def zero_width_id(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", X.zero_width_id(F.col("n_nationkey")).alias("id"))


_KV = (("width=80%,height=60%,scale=1", "scale", "1"), (" a = 1 ,b,a=2", "a", "2"), ("x=1=2", "x", "1=2"), ("", "x", None))


@query(f"SELECT c_custkey, value, c_name AS name, CASE WHEN key <> 'a' AND given <> 1 THEN NULL ELSE '7' END AS more FROM {sql_dealt('text key value', *_KV)}")
def parse_kv_options(spark, sf):
    """Options of a customer, whose name is one of them."""
    text = F.concat("text", F.lit(",name="), "c_name", F.when(F.col("key") == "a", ", more = 7").otherwise(""))
    found = dealt(spark, sf, "text key", *[k[:2] for k in _KV]).withColumn("found", X.options(text))
    value = lambda k: F.try_element_at("found", k)
    return found.select("c_custkey", value(F.col("key")).alias("value"), value(F.lit("name")).alias("name"), value(F.lit("more")).alias("more"))


@query("""
    SELECT doc_id, greatest(1, ceil(length(b) / 4096.0))::INT AS n, length(b) - 4096 * (greatest(1, ceil(length(b) / 4096.0))::INT - 1) AS last
    FROM (SELECT doc_id, base64(encode(text)) AS b FROM documents)
""")
def base64_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.chunks(X.base64(F.col("text").cast("binary"))).alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), F.length(F.element_at("c", -1)).cast("long").alias("last"))


#: The colors of five roles, typed for SQL apart from the library's table: keyword, module, constant, background, blue.
_FIVE = """
    VALUES ('catppuccin', '#CBA6F7', '#89DCEB', '#F38BA8', '#1E1E2E', '#89B4FA'), ('nord', '#81A1C1', '#8FBCBB', '#B48EAD', '#272E37', '#81A1C1'),
    ('monokai', '#F92672', '#66D9EF', '#AE81FF', '#272822', '#66D9EF'), ('dracula', '#FF79C6', '#8BE9FD', '#BD93F9', '#282A36', '#8BE9FD'),
    ('gruvbox', '#FB4934', '#83A598', '#D3869B', '#282828', '#83A598'), ('one_dark', '#C678DD', '#56B6C2', '#E06C75', '#282C34', '#61AFEF'),
    ('solarized', '#268BD2', '#859900', '#D33682', '#002B36', '#268BD2'), ('tokyo_night', '#BB9AF7', '#2AC3DE', '#FF9E64', '#1A1B26', '#7AA2F7'),
    ('makurai_light', '#E35043', '#AB31A9', '#976700', '#f8f8fc', '#3D76F3'), ('makurai_dark', '#FF7733', '#82AAFF', '#D2A6FF', '#14161f', '#82AAFF'),
    ('ayu', '#FF8F40', '#59C2FF', '#D2A6FF', '#0A0E14', '#59C2FF'), ('ayu_mirage', '#FFA759', '#73D0FF', '#D4BFFF', '#1F2430', '#73D0FF'),
    ('github', '#FF7B72', '#FFA657', '#79C0FF', '#0D1117', '#58A6FF'), ('synthwave', '#FF7EDB', '#FE4450', '#FF8CC8', '#262335', '#36F9F6'),
    ('material', '#C792EA', '#FFCB6B', '#F78C6C', '#292D3E', '#82AAFF'), ('rose_pine', '#C4A7E7', '#EBBCBA', '#EB6F92', '#191724', '#9CCFD8'),
    ('kanagawa', '#957FB8', '#7FB4CA', '#D27E99', '#1F1F28', '#7E9CD8'), ('vscode', '#569CD6', '#4EC9B0', '#B5CEA8', '#1E1E1E', '#569CD6'),
    ('everforest', '#E67E80', '#7FBBB3', '#D699B6', '#2D353B', '#7FBBB3'), ('autumn', '#fc6501', '#fc4c4c', '#FF6B9D', '#14161f', '#5abffa'),
    ('spring', '#FFB347', '#66E6FF', '#D8A5FF', '#14161f', '#66E6FF')
"""
#: Names as customers ask for them: those of the library in either case, one that it lacks, and none.
_ASKED = "catppuccin Nord monokai dracula GRUVBOX one_dark solarized tokyo_night makurai_light makurai_dark ayu ayu_mirage github synthwave material rose_pine kanagawa vscode everforest autumn spring dark".split()


def _asked():
    return F.get(F.array(*map(F.lit, _ASKED)), (F.col("c_custkey") % (len(_ASKED) + 1)).cast("int"))


@query(f"""
    WITH five(theme, keyword, module, constant, background, blue) AS ({_FIVE}),
    c AS (SELECT c_custkey, lower({_ASKED}[c_custkey % {len(_ASKED) + 1} + 1]) AS asked FROM customer)
    SELECT c_custkey, keyword, module, constant, background, ('0x' || background[2:3])::INT AS r, ('0x' || background[4:5])::INT AS g, ('0x' || background[6:7])::INT AS b
    FROM c JOIN five ON theme = CASE WHEN asked IN (SELECT theme FROM five) THEN asked ELSE 'github' END
""")
def theme_colors(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", *[theme_color(_asked(), role).alias(role) for role in ("keyword", "module", "constant", "background")])
    rgb = X.hex_color(F.col("background"))
    return d.select("*", rgb["r"].alias("r"), rgb["g"].alias("g"), rgb["b"].alias("b"))


@query(f"""
    WITH five(theme, keyword, module, constant, background, blue) AS ({_FIVE}),
    c AS (SELECT c_custkey, lower({_ASKED}[c_custkey % {len(_ASKED) + 1} + 1]) AS asked FROM customer)
    SELECT c_custkey, coalesce((SELECT blue FROM five WHERE theme = asked), '#58A6FF') AS blue FROM c
""")
def theme_default(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", theme_color(_asked(), "blue").alias("blue"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'SQL' END AS language FROM customer")
def language_names(spark, sf):
    key = F.element_at(F.array(*map(F.lit, ("py", "RS", "Sql", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", lookup(LANGUAGES, key).alias("language"))


# --- pages

_SRC = "'<img src=\"/i/' || page_id || '.png\"><p><object data=\"v.svg\"></object><img alt=x src=\"s' || page_id % 3 || '.svg\"><video src=\"m.mp4\"></video><video><source src=\"n.webm\"></video>'"


def _candidates(spark, sf):
    k = F.col("page_id")
    markup = F.concat(F.lit('<img src="/i/'), k.cast("string"), F.lit('.png"><p><object data="v.svg"></object><img alt=x src="s'), (k % 3).cast("string"), F.lit('.svg"><video src="m.mp4"></video><video><source src="n.webm"></video>'))
    return html.media_candidates(table(spark, sf, "pages").select("page_id", "url", F.concat("html", markup).alias("html")))


@query("""
    SELECT page_id, ord, src, kind FROM pages, LATERAL (VALUES
        (0, '/i/' || page_id || '.png', 'image'), (1, 's' || page_id % 3 || '.svg', 'image'), (2, 'v.svg', 'svg'),
        (3, 's' || page_id % 3 || '.svg', 'svg'), (4, 'm.mp4', 'video'), (5, 'n.webm', 'video')) AS v(ord, src, kind)
""")
def media_candidates(spark, sf):
    return _candidates(spark, sf).select("page_id", "ord", "src", "kind")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")
def anchors_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query("""
    WITH c AS (SELECT page_id, ord, kind, ext, CASE WHEN src LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+') || src ELSE regexp_replace(url, '[^/]*$', '') || src END AS src
        FROM pages, LATERAL (VALUES
            (0, '/i/' || page_id || '.png', 'image', 'png'), (1, 's' || page_id % 3 || '.svg', 'image', 'svg'), (2, 'v.svg', 'svg', 'svg'),
            (3, 's' || page_id % 3 || '.svg', 'svg', 'svg'), (4, 'm.mp4', 'video', 'mp4'), (5, 'n.webm', 'video', 'webm')) AS v(ord, src, kind, ext)),
    s AS (SELECT *, length(src) * 37 % 11 * 10 AS size FROM c WHERE kind <> 'image' OR ext <> 'svg')
    SELECT page_id, arg_max(src, size * 10 - ord) AS src, arg_max(ext, size * 10 - ord) AS ext, max(size) AS size FROM s GROUP BY page_id
""")
def biggest_media_per_page(spark, sf):
    found = _candidates(spark, sf)
    url = html.resolve(F.col("base"), F.col("src"))
    mime = F.element_at(F.create_map(*map(F.lit, ("png", "image/png", "svg", "image/svg+xml", "mp4", "video/mp4", "webm", "video/webm"))), X.extension(F.col("src")))
    media = found.select(url.alias("src"), mime.alias("mime")).distinct().withColumn("size", F.length("src") * 37 % 11 * 10)
    return html.biggest_media(found, media)


@query("SELECT page_id, ord, CASE WHEN src LIKE '%.svg' THEN 'image of ' || src ELSE kind END AS shown FROM (SELECT page_id, ord, src, kind FROM pages, LATERAL (VALUES (0, '/i/' || page_id || '.png', 'image'), (1, 's' || page_id % 3 || '.svg', 'image'), (2, 'v.svg', 'svg'), (3, 's' || page_id % 3 || '.svg', 'svg'), (4, 'm.mp4', 'video'), (5, 'n.webm', 'video')) AS v(ord, src, kind))")
def image_fallback_left_join(spark, sf):
    images = values(spark, "src rendered ok", *[(s, f"image of {s}", True) for s in ("s0.svg", "s1.svg", "s2.svg", "v.svg")], ("m.mp4", "broken", False))
    return html.with_images(_candidates(spark, sf), images, "src", "kind").select("page_id", "ord", "shown")


def _url_paths(spark, sf):
    return table(spark, sf, "pages").select(F.concat(F.lit("/d"), (F.col("page_id") % 7).cast("string"), F.lit("/e"), (F.col("page_id") % 3).cast("string"), F.lit("/f"), F.col("page_id").cast("string")).alias("path"))


_PATHS = "SELECT '/d' || page_id % 7 || '/e' || page_id % 3 || '/f' || page_id AS path FROM pages"


@query(f"SELECT path FROM ({_PATHS}) WHERE NOT (path LIKE '/d1/%' OR path LIKE '/d2/e1/%')")
def prefix_cover_anti(spark, sf):
    return paths.outside(_url_paths(spark, sf), values(spark, "path", ("/d1",), ("/d2/e1",), ("/d",)))


@query(f"SELECT DISTINCT path FROM ({_PATHS}) WHERE path LIKE '/d1/%' OR path LIKE '/d2/e1/%'")
def prefix_expand(spark, sf):
    return paths.expand(_url_paths(spark, sf), values(spark, "path", ("/d1",), ("/d1/e0",), ("/d2/e1",)))


def _tree(spark, sf):
    files = _url_paths(spark, sf)
    dirs = files.select(F.explode(F.array(F.regexp_extract("path", "^(/d[^/]*)", 1), F.regexp_extract("path", "^(/d[^/]*/e[^/]*)", 1))).alias("path")).distinct()
    return files.withColumn("is_dir", F.lit(False)).unionAll(dirs.withColumn("is_dir", F.lit(True)))


_TREE = f"""(
    SELECT path, false AS is_dir FROM ({_PATHS}) UNION ALL
    SELECT DISTINCT unnest([regexp_extract(path, '^(/d[^/]*)', 1), regexp_extract(path, '^(/d[^/]*/e[^/]*)', 1)]), true FROM ({_PATHS}))"""


@query(f"""
    SELECT path, depth, coalesce(lead(depth) OVER w < depth, true) AS last, row_number() OVER w - 1 AS number
    FROM (SELECT path, len(string_split(path, '/')) - 1 AS depth FROM {_TREE}) WINDOW w AS (ORDER BY string_split(path, '/'))
""")
def last_child_flag(spark, sf):
    return paths.tree_labels(_tree(spark, sf)).select("path", F.col("depth").cast("long").alias("depth"), "last", "number")


@query(f"SELECT path, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY is_dir DESC, lower(path), path)::INT AS place FROM {_TREE}")
def listing_order(spark, sf):
    return paths.listing(_tree(spark, sf)).select("path", "place")


def _linked(spark, sf):
    """The tree with links: to folders, from folder to folder, in chains, to folders above, to themselves and to nothing."""
    k = F.col("page_id")
    at = lambda p: F.concat(F.lit("/d"), (p % 7).cast("string"), F.lit("/e"), (p % 3).cast("string"), F.lit("/l"), p.cast("string"))
    e = (k % 3).cast("string")
    target = (
        F.when(k % 7 == 3, F.concat(F.lit("../../d5/e"), e)).when(k % 5 == 0, F.when(k % 2 == 0, F.concat(F.lit("/d3/./e"), e)).otherwise(F.concat(F.lit("/d5/e"), e)))
        .when(k % 5 == 1, at(k - 63)).when(k % 5 == 2, F.concat(F.lit("../../d"), (k % 7).cast("string"))).when(k % 5 == 3, at(k)).otherwise(F.concat(F.lit("/d4/e"), e, F.lit("/l"), k.cast("string"), F.lit("/f")))
    )
    links = table(spark, sf, "pages").filter((k % 9 == 0) & (k % 7 < 4)).select(at(k).alias("path"), F.lit(False).alias("is_dir"), target.alias("target"))
    return _tree(spark, sf).withColumn("target", F.lit(None).cast("string")).unionAll(links)


_LINKED = f"""
    p AS (SELECT page_id AS k, '/d' || page_id % 7 || '/e' || page_id % 3 || '/l' || page_id AS path FROM pages WHERE page_id % 9 = 0 AND page_id % 7 < 4),
    l AS (
        SELECT path, CASE WHEN k % 7 = 3 THEN '/d5/e' || k % 3 WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN '/d3/e' || k % 3 ELSE '/d5/e' || k % 3 END
            WHEN k % 5 = 1 THEN '/d' || (k - 63) % 7 || '/e' || (k - 63) % 3 || '/l' || (k - 63) WHEN k % 5 = 2 THEN '/d' || k % 7
            WHEN k % 5 = 3 THEN path ELSE '/d4/e' || k % 3 || '/l' || k || '/f' END AS target FROM p
    ),
    entries AS (SELECT path, is_dir, false AS is_link FROM {_TREE} UNION ALL SELECT path, false, true FROM l),
    way AS (
        SELECT path, target AS led, 1 AS hop FROM l
        UNION ALL
        SELECT w.path, l.target || substr(w.led, length(l.path) + 1), hop + 1
        FROM way w JOIN l ON starts_with(w.led || '/', l.path || '/') WHERE hop <= 40
    ),
    ends AS (SELECT path, arg_max(led, hop) AS led, max(hop) AS hops FROM way GROUP BY path),
    final AS (SELECT path, CASE WHEN hops <= 40 THEN led END AS final, CASE WHEN hops > 40 THEN 'loop' WHEN led IN (SELECT path FROM entries) THEN 'found' ELSE 'missing' END AS state FROM ends)
"""


@query(f"WITH RECURSIVE {_LINKED} SELECT path, final, state FROM final")
def link_targets(spark, sf):
    return links.resolve_links(_linked(spark, sf))


@query(f"""
    WITH RECURSIVE {_LINKED},
    placed AS (SELECT *, list_transform(range(2, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')) AS folders FROM entries),
    walk AS (
        SELECT path, path AS real, is_dir, is_link, folders AS way FROM placed
        UNION ALL
        SELECT w.path || substr(e.path, length(f.final) + 1), e.path, e.is_dir, e.is_link,
               w.way || [f.final] || list_filter(e.folders, lambda d: starts_with(d || '/', f.final || '/'))
        FROM walk w JOIN final f ON w.is_link AND f.path = w.real AND f.state = 'found' AND NOT list_contains(w.way, f.final)
        JOIN placed e ON starts_with(e.path || '/', f.final || '/')
    )
    SELECT path, real, is_dir FROM walk WHERE NOT is_link
""")
def linked_walk(spark, sf):
    return links.walk_links(_linked(spark, sf))


# --- pixels, sizes and frames

def _whole_ms():
    """Seconds to whole milliseconds, so that differences round alike everywhere."""
    return F.floor(frames.seconds(F.col("ts")) * 1000) / 1000.0


_PALETTE = ((0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (127, 127, 127))


@query(f"""
    SELECT p_partkey, idx, dist FROM (
        SELECT p_partkey, idx, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS dist,
            row_number() OVER (PARTITION BY p_partkey ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), idx) AS rn
        FROM (SELECT p_partkey, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b FROM part), {sql_values('idx pr pg pb', *[(k, *c) for k, c in enumerate(_PALETTE)])}
    ) WHERE rn = 1
""")
def nearest_palette(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select("p_partkey", (k % 256).alias("r"), (k * 7 % 256).alias("g"), (k * 13 % 256).alias("b"))
    return pixels.nearest(d, _PALETTE).select("p_partkey", "idx", "dist")


@query("""
    SELECT vec_id, idx FROM (
        SELECT e.vec_id, c.vec_id AS idx, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_sum(list_transform(list_zip(e.embedding, c.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), c.vec_id) AS rn
        FROM embeddings e, (SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) c
    ) WHERE rn = 1
""")
def nearest_vector(spark, sf):
    e = table(spark, sf, "embeddings")
    centers = e.groupBy("label").agg(F.min("vec_id").alias("idx"), F.min_by("embedding", "vec_id").alias("center")).select("idx", "center")
    return pixels.nearest_vector(e, centers).select("vec_id", "idx")


_FIT = "SELECT p_partkey, 100 + p_partkey % 1900 AS sw, 80 + p_size * 17 AS sh FROM part"


@query(f"""
    SELECT p_partkey, CASE WHEN s > (800::FLOAT / 400::FLOAT) THEN 800 ELSE round((400::FLOAT * s)::FLOAT) END::INT AS width,
        CASE WHEN s > (800::FLOAT / 400::FLOAT) THEN round((800::FLOAT / s)::FLOAT) ELSE 400 END::INT AS height
    FROM (SELECT p_partkey, (sw::FLOAT / sh::FLOAT)::FLOAT AS s FROM ({_FIT}))
""")
def calc_fit(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_partkey") % 1900).alias("sw"), (80 + F.col("p_size") * 17).alias("sh"))
    size = G.fit(F.col("sw"), F.col("sh"), F.lit(800), F.lit(400))
    return d.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


_DIMS = tuple((d, px, c) for d, px, c in (("80%", 1536, 80), ("4c", 77, 4), ("12px", 12, 1), ("7", 7, 7), ("abc", -1, -1), ("33.5%", 644, 34), ("100c", 1921, 100)))


@query(f"""
    SELECT c_custkey, dim, px::INT AS px, cells::INT AS cells, ceil((1920::FLOAT * ((c_custkey % 250)::FLOAT / 100::FLOAT)::FLOAT)::FLOAT)::INT AS own_px,
        ceil((1920::FLOAT / 100::FLOAT)::FLOAT * (c_custkey % 250)::FLOAT)::INT AS own_cells_px
    FROM {sql_dealt('dim px cells', *_DIMS)}
""")
def dimensions(spark, sf):
    """Sizes in pixels and cells: fixed ones, and those of the customer's key in percent and in cells."""
    d = dealt(spark, sf, "dim", *[x[:1] for x in _DIMS])
    own = lambda unit: G.dim_to_px(F.concat((F.col("c_custkey") % 250).cast("string"), F.lit(unit)), F.lit(1920), F.lit(100))
    return d.select("c_custkey", own("%").alias("own_px"), own("c").alias("own_cells_px"), "dim", F.coalesce(G.dim_to_px(F.col("dim"), F.lit(1920), F.lit(100)), F.lit(-1)).alias("px"), F.coalesce(G.dim_to_cells(F.col("dim"), F.lit(1920), F.lit(100)), F.lit(-1)).alias("cells"))


@query("SELECT p_partkey, greatest(0, round(((100 - p_size * 3)::FLOAT / 2)::FLOAT))::INT AS cells FROM part")
def center_offset(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.center_offset(F.col("p_size") * 3, G.Screen(), True).alias("cells"))


@query("SELECT s_suppkey, greatest(1, least(ceil((40 + s_suppkey * 7) / 16.0), (40 + s_suppkey * 7) // 4, 20))::INT AS items FROM supplier")
def items_per_row(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", G.items_per_row(40 + F.col("s_suppkey") * 7, 4, 16, 20).alias("items"))


@query("SELECT s_suppkey, (row_number() OVER w - 1) // 6 AS chunk, ((row_number() OVER w - 1) % 6)::INT AS slot FROM supplier WINDOW w AS (ORDER BY s_suppkey)")
def chunk_rows(spark, sf):
    return paths.chunk_rows(table(spark, sf, "supplier"), 6, ["s_suppkey"]).select("s_suppkey", "chunk", "slot")


@query("SELECT p_brand, sum(p_size)::BIGINT AS width, max(p_partkey) AS height FROM part GROUP BY p_brand")
def hstack_dims(spark, sf):
    return concat.stack(table(spark, sf, "part"), ["p_brand"], True, "p_size", "p_partkey")


@query("SELECT p_brand, max(p_size) AS width, sum(p_partkey)::BIGINT AS height FROM part GROUP BY p_brand")
def vstack_dims(spark, sf):
    return concat.stack(table(spark, sf, "part"), ["p_brand"], False, "p_size", "p_partkey")


@query("""
    SELECT p_partkey, 4 + coalesce(sum(p_size + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x, (max(floor(p_retailprice)::INT) OVER b - floor(p_retailprice)::INT) // 2 AS y,
        (4 + sum(p_size) OVER b + 4 * (count(*) OVER b - 1))::BIGINT AS row_width
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey), b AS (PARTITION BY p_brand)
""")
def row_of_images(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").alias("width"), F.floor("p_retailprice").cast("int").alias("height"))
    return concat.row_of_images(d, ["p_brand"], ["p_partkey"], 4).select("p_partkey", F.col("x").cast("long").alias("x"), "y", "row_width")


@query("""
    SELECT event_id, CASE WHEN ms > before THEN ms - before ELSE 33 END::BIGINT AS ms
    FROM (SELECT event_id, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))
""")
def frame_delays_ascii(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", _whole_ms().alias("t"))
    d = frames.text_delays(d, "t", ["user_id"], ["t", "event_id"])
    return d.select("event_id", F.round(F.col("delay") * 1000).cast("long").alias("ms"))


@query("""
    SELECT event_id, CASE WHEN rn > 1 THEN (s - CASE WHEN rn = 2 THEN 0 ELSE before END) * 1000 ELSE -1 END::BIGINT AS gap
    FROM (SELECT event_id, s, row_number() OVER w AS rn, lag(s) OVER w AS before FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
""")
def frame_delays_kitty(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", F.floor(frames.seconds(F.col("ts"))).cast("double").alias("t"))
    return frames.graphics_delays(d, "t", ["user_id"], ["t", "event_id"]).select("event_id", F.coalesce("gap", F.lit(-1)).alias("gap"))


@query("""
    SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM (
        SELECT user_id, event_type, sum(s) OVER w AS run FROM (
            SELECT event_id, user_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    GROUP BY user_id, run
""")
def rle_runs(spark, sf):
    return pixels.runs(table(spark, sf, "events"), "event_type", ["event_id"], ["user_id"])


@query("""
    SELECT event_id, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried
    FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN event_type END AS c FROM events)
""")
def carry_forward_color(spark, sf):
    d = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("c"))
    return frames.carry_forward(d, "c", ["event_id"], ["user_id"]).select("event_id", "carried")


@query("SELECT p_size AS img, y // 6 AS band, color, x, bit_or((1 << (y % 6))::INT) AS bits FROM (SELECT p_size, (p_partkey % 40)::INT AS x, (p_partkey // 40 % 50)::INT AS y, (p_partkey % 5)::INT AS color FROM part) GROUP BY ALL")
def sixel_bands(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.col("p_size").alias("img"), (k % 40).cast("int").alias("x"), F.floor(k / 40 % 50).cast("int").alias("y"), (k % 5).cast("int").alias("idx"))
    return pixels.bands(d)


@query("""
    SELECT p_partkey, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) * (a / 255.0) > 25 AS visible
    FROM (SELECT p_partkey, p_partkey % 97 AS r, p_partkey * 3 % 89 AS g, p_size AS b, p_partkey % 256 AS a FROM part)
""")
def luminance_visible(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", (G.visual_weight(k % 97, k * 3 % 89, F.col("p_size"), k % 256) > pixels.VISIBLE).alias("visible"))


@query("""
    SELECT p_partkey, floor(least(greatest(iw / 2.0 + 5 - w / 2.0, 0), iw - w))::INT AS x, w::INT AS width
    FROM (SELECT *, least(round((800::FLOAT / (least((800::FLOAT / iw::FLOAT)::FLOAT, (600::FLOAT / ih::FLOAT)::FLOAT) * 2::FLOAT)::FLOAT)::FLOAT), iw) AS w
          FROM (SELECT p_partkey, 400 + p_size * 31 AS iw, 300 + (p_partkey % 900) AS ih FROM part))
""")
def viewport(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", (400 + F.col("p_size") * 31).alias("iw"), (300 + F.col("p_partkey") % 900).cast("int").alias("ih"))
    v = G.viewport(F.lit(800), F.lit(600), F.col("iw"), F.col("ih"), F.lit(2), F.lit(5), F.lit(0))
    return d.select("p_partkey", v["x"].alias("x"), v["width"].alias("width"))


@query("""
    SELECT l_orderkey, min(l_quantity) AS x1, max(l_quantity) AS x2, min(l_linenumber) AS y1, max(l_linenumber) AS y2,
        (max(l_quantity) - min(l_quantity) < 2) <> (max(l_linenumber) - min(l_linenumber) < 2) AS fake_line
    FROM lineitem GROUP BY l_orderkey
""")
def bbox_fake_line(spark, sf):
    return grid.boxes(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


@query("""
    WITH t AS (SELECT p_size AS page, p_partkey AS ord, (p_partkey * 13 % 600)::DOUBLE AS x, (p_partkey * 29 % 780)::DOUBLE AS y, p_name AS text FROM part),
    c AS (SELECT page, ord, 80 - round(y / 10)::INT AS r, round(x / 4)::INT + k - 1 AS col, text[k] AS ch FROM (SELECT *, unnest(range(1, length(text) + 1)) AS k FROM t)),
    u AS (SELECT page, r, col, arg_max(ch, ord) AS ch FROM c GROUP BY ALL),
    spans AS (SELECT page, r, unnest(range(0, max(col) + 1)) AS col FROM u WHERE ch <> ' ' GROUP BY page, r),
    lines AS (SELECT page, r, string_agg(coalesce(ch, ' '), '' ORDER BY col) AS line FROM spans LEFT JOIN u USING (page, r, col) GROUP BY ALL),
    every AS (SELECT page, unnest(range(min(r), max(r) + 1)) AS r FROM lines GROUP BY page)
    SELECT page, string_agg(coalesce(line, ''), chr(10) ORDER BY r) AS text FROM every LEFT JOIN lines USING (page, r) GROUP BY page
""")
def grid_project_text(spark, sf):
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.col("p_size").alias("page"), k.alias("ord"), (k * 13 % 600).cast("double").alias("x"), (k * 29 % 780).cast("double").alias("y"), F.col("p_name").alias("text"))
    return grid.grid_text(d)


@query("""
    SELECT p_partkey, round((p_partkey // 3600 * 3600 + p_partkey // 60 % 60 * 60 + p_partkey % 60) * 24)::BIGINT AS frames, 16 + p_partkey % 216 AS fore, 16 + p_partkey // 216 % 216 AS back FROM part
""")
def frame_totals(spark, sf):
    k = F.col("p_partkey")
    time = F.format_string("%d:%02d:%02d", F.floor(k / 3600), F.floor(k / 60) % 60, k % 60)
    c = G.placeholder_colors(k)
    return table(spark, sf, "part").select("p_partkey", G.frame_total(time, F.lit(24)).alias("frames"), c["fore"].cast("long").alias("fore"), c["back"].cast("long").alias("back"))


# --- inputs, walks and image references

@query("""
    SELECT doc_id, lower(md5(CASE WHEN b = '' THEN '' ELSE string_agg(chr(27) || '_G' || CASE WHEN k = 0 THEN 'f=100,a=T,i=' || doc_id || ',' ELSE '' END || 'q=2,m=' || CASE WHEN (k + 1) * 4096 < length(b) THEN 1 ELSE 0 END || ';' || substr(b, k * 4096 + 1, 4096) || chr(27) || chr(92), '' ORDER BY k) END)) AS md5
    FROM (SELECT doc_id, b, unnest(range(0, greatest(1, ceil(length(b) / 4096.0))::BIGINT)) AS k FROM (SELECT doc_id, base64(encode(text)) AS b FROM documents)) GROUP BY doc_id, b
""")
def kitty_commands(spark, sf):
    options = F.concat(F.lit("f=100,a=T,i="), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", F.md5(terminal.kitty_image(X.base64(F.col("text").cast("binary")), options)).alias("md5"))


@query("""
    SELECT c_custkey, chr(27) || '[' || (c_custkey % 9 + 1) || ';' || (c_custkey % 7 + 1) || 'H' || chr(27) || '[' || c_custkey % 5 || 'C' || chr(27) || ']1337;File=inline=1;size=' || length(b) || ':' || b || chr(7) AS text
    FROM (SELECT c_custkey, base64(encode(c_name)) AS b FROM customer)
""")
def iterm_strings(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", terminal.iterm_image(X.base64(F.col("c_name").cast("binary")), k % 5, k % 7, k % 9).alias("text"))


@query("""
    WITH p AS (SELECT p_partkey, p_size % 9 + 1 AS cols, p_partkey % 4 + 1 AS rows, p_partkey * 70001 AS id, [chr(773), chr(781), chr(782), chr(784), chr(786), chr(829), chr(830), chr(831), chr(838)] AS d FROM part),
    cells AS (SELECT p_partkey, id, r, string_agg(chr(1109742) || d[r + 1] || d[c + 1] || d[(id >> 24) % 256 + 1], '' ORDER BY c) AS line FROM (SELECT *, unnest(range(0, cols)) AS c FROM (SELECT *, unnest(range(0, rows)) AS r FROM p)) GROUP BY ALL),
    color AS (SELECT *, chr(27) || '[38;2;' || (id >> 16) % 256 || ';' || (id >> 8) % 256 || ';' || id % 256 || 'm' AS color FROM cells)
    SELECT p_partkey, color || string_agg(color || line, chr(10) ORDER BY r) || chr(27) || '[39m' AS text FROM color GROUP BY p_partkey, color
""")
def unicode_placeholders(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", terminal.unicode_placeholder(F.col("p_size") % 9 + 1, k % 4 + 1, k * 70001).alias("text"))


_MODES = "(VALUES (0, 'auto', 'kitty', 'all', -1), (1, 'auto', 'iterm', 'small', 50000), (2, 'auto', 'sixel', 'small', 50000), (3, 'auto', 'ascii', 'none', 50000), (4, 'all', 'ascii', 'all', -1), (5, 'none', 'kitty', 'none', 50000))"


@query(f"SELECT c_custkey, shown, cap FROM customer JOIN {_MODES} AS v(k, mode, encoder, shown, cap) ON c_custkey % 6 = k")
def image_modes(spark, sf):
    k = (F.col("c_custkey") % 6 + 1).cast("int")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), k)
    mode = terminal.image_mode(pick("auto", "auto", "auto", "auto", "all", "none"), pick("kitty", "iterm", "sixel", "ascii", "ascii", "kitty"))
    return table(spark, sf, "customer").select("c_custkey", mode.alias("shown"), F.coalesce(terminal.image_cap(mode), F.lit(-1)).alias("cap"))


@query("""
    SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 2 = 1 AND c_custkey > 30 WHEN 1 THEN true ELSE false END AS paged, c_custkey % 4 = 0 AND c_custkey % 5 = 0 AS indented,
        c_custkey % 6 <> 0 OR c_custkey % 2 <> 0 AS zoomed, c_custkey % 3 = 1 AS fetched, c_custkey % 4 = 2 AS yes
    FROM customer
""")
def switches(spark, sf):
    k = F.col("c_custkey")
    paging = F.when(k % 3 == 0, "auto").when(k % 3 == 1, "always").otherwise("never")
    url = F.when(k % 3 == 0, "http://a.b/c").when(k % 3 == 1, "https://a.b/c").otherwise("a/b/c")
    return table(spark, sf, "customer").select(
        "c_custkey", terminal.pages(paging, k % 2 == 1, k, F.lit(30)).alias("paged"), terminal.indents(k % 4 == 0, k % 5).alias("indented"),
        terminal.zooms(F.when(k % 6 != 0, F.lit(2)), k % 2, F.lit(None).cast("int")).alias("zoomed"), terminal.is_url(url).alias("fetched"),
        terminal.truthy(F.when(k % 4 == 2, "True").otherwise("no")).alias("yes"),
    )


@query("""
    SELECT s_suppkey, 'https://h/chromium-browser-snapshots/' || remote || '/' || rev || '/' || archive || CASE WHEN exe = 'chrome.exe' AND rev <= 591479 THEN '32' ELSE '' END || '.zip' AS url, folder || '-' || rev AS folder, folder || '-' || rev || '/' || exe AS executable
    FROM (SELECT s_suppkey, 591400 + s_suppkey AS rev, s_suppkey % 6 AS k FROM supplier) LEFT JOIN (VALUES (0, 'chrome-linux', 'chrome', 'Linux_x64', 'linux'), (1, 'chrome-mac', 'Chromium.app/Contents/MacOS/Chromium', 'Mac', 'mac'),
        (2, 'chrome-mac', 'Chromium.app/Contents/MacOS/Chromium', 'Mac_Arm', 'mac_arm'), (3, 'chrome-win', 'chrome.exe', 'Win', 'win32'), (4, 'chrome-win', 'chrome.exe', 'Win_x64', 'win64')) AS v(k, archive, exe, remote, folder) USING (k)
""")
def platform_urls(spark, sf):
    k = (F.col("s_suppkey") % 6 + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, ("linux", "mac", "mac_arm", "win32", "win64", "bsd"))), k)
    p = terminal.platform_paths(name, F.lit("https://h"), 591400 + F.col("s_suppkey"))
    return table(spark, sf, "supplier").select("s_suppkey", p["url"].alias("url"), p["folder"].alias("folder"), p["executable"].alias("executable"))


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN user_id::VARCHAR WHEN event_id % 5 = 0 THEN 'p' END AS place FROM events
""")
def first_places(spark, sf):
    k = F.col("event_id")
    places = F.when(k % 2 == 0, F.col("event_type")), F.when(k % 3 == 0, F.col("user_id").cast("string")), F.when(k % 5 == 0, "p")
    return table(spark, sf, "events").select("event_id", terminal.first_found(*places).alias("place"))


@query("""
    SELECT c_custkey, 'kitty' AS encoder, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS theme, c_custkey % 3 = 1 AS silent, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'small' END AS images FROM customer
""")
def env_settings(spark, sf):
    k = F.col("c_custkey")
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    env = F.map_from_entries(F.filter(F.array(
        entry("X_ENCODER", F.lit("KITTY")), F.when(k % 2 == 0, entry("X_THEME", F.col("c_name"))), entry("X_SILENT", F.when(k % 3 == 1, "TRUE").otherwise("0")),
        entry("X_MD_IMAGE", F.when(k % 5 == 0, "Small").when(k % 5 == 1, "small").otherwise("some")), entry("OTHER", F.lit("1")),
    ), lambda x: x.isNotNull()))
    s = terminal.settings(env, "X")
    return table(spark, sf, "customer").select("c_custkey", s["encoder"].alias("encoder"), s["theme"].alias("theme"), s["silent"].alias("silent"), s["images"].alias("images"))


@query("""
    SELECT conv_id, turn, any_value(repeat(chr(27) || '[1m', 1) || ltrim(text, ' ') || chr(27) || '[0m') AS text FROM (SELECT conv_id, turn, rtrim(text, ' ') AS text FROM conversations) WHERE NOT regexp_matches(text, '^\\s|\\s$') GROUP BY conv_id, turn, text
    UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE regexp_matches(rtrim(text, ' '), '^\\s|\\s$')
""".replace("\\\\", "\\"))
def trimmed_ansi(spark, sf):
    """Texts with spaces put inside and outside of their colors; those that have white space of their own at the ends give null."""
    d = table(spark, sf, "conversations").withColumn("text", F.rtrim("text"))
    padded = F.concat(F.lit(" \x1b[1m"), F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), F.col("text"), F.lit("  \x1b[0m "))
    own = F.col("text").rlike(r"^\s|\s$")
    return d.select("conv_id", "turn", F.when(~own, terminal.trim_ansi(padded)).alias("text"))


@query("""
    SELECT c_custkey, 'a' || chr(27) || '[24m' || c_name || ' 1' || CASE c_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'b' || chr(27) || '[24m' || c_name || ' 2' || 'c' ELSE 'b' || chr(27) || '[24m' || c_name || ' 2' || 'c[IMG]d' END AS text FROM customer
""")
def placed_images(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ("a[IMG]b", "a[IMG]b[IMG]c", "a[IMG]b[IMG]c[IMG]d"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    image = F.concat(F.col("c_name"), F.lit(" 1\n"), F.col("c_name"), F.lit(" 2"))
    return table(spark, sf, "customer").select("c_custkey", terminal.replace_placeholder(text, F.lit("[IMG]"), image).alias("text"))


@query("""
    WITH r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x/i.png' WHEN 1 THEN 'data:image/png' WHEN 2 THEN 'i' || page_id || '.png' WHEN 3 THEN '/d/i' || page_id || '.png' ELSE 'none.png' END AS src FROM pages)
    SELECT page_id, page_id % 5 > 1 AS local, CASE WHEN page_id % 5 = 2 AND page_id % 2 = 0 THEN src WHEN page_id % 5 = 2 THEN 'md/' || src WHEN page_id % 5 = 3 THEN src END AS found FROM r
""")
def image_sources(spark, sf):
    k = F.col("page_id")
    name = F.concat(F.lit("i"), k.cast("string"), F.lit(".png"))
    src = F.when(k % 5 == 0, "https://x/i.png").when(k % 5 == 1, "data:image/png").when(k % 5 == 2, name).when(k % 5 == 3, F.concat(F.lit("/d/"), name)).otherwise("none.png")
    refs = table(spark, sf, "pages").select("page_id", src.alias("src"), F.lit("md").alias("dir"))
    files = table(spark, sf, "pages").select(F.explode(F.array(F.when(k % 2 == 0, name), F.concat(F.lit("md/"), name), F.concat(F.lit("/d/"), name))).alias("path")).filter("path is not null")
    return images.located(refs, files).select("page_id", "local", "found")


@query(f"""
    SELECT path, path IN (SELECT path FROM {_TREE}) AS "exists", coalesce(path IN (SELECT path FROM {_TREE} WHERE NOT is_dir), false) AS is_file, coalesce(path IN (SELECT path FROM {_TREE} WHERE is_dir), false) AS is_dir
    FROM (SELECT DISTINCT unnest([path, path || 'x', regexp_extract(path, '^(/d[^/]*)', 1)]) AS path FROM ({_PATHS}))
""")
def path_gates(spark, sf):
    path = F.col("path")
    asked = _url_paths(spark, sf).select(F.explode(F.array(path, F.concat(path, F.lit("x")), F.regexp_extract("path", "^(/d[^/]*)", 1))).alias("path")).distinct()
    return images.existing(asked, _tree(spark, sf))


@query(f"""
    WITH t AS (SELECT path, split_part(path, '/', 2) AS d, split_part(path, '/', 3) AS e, split_part(path, '/', 4) AS f FROM {_TREE})
    SELECT path FROM t
    WHERE d <> 'd2' AND NOT (d = 'd4' AND e = 'e1' AND f LIKE 'f%3')
      AND (CASE WHEN d = 'd3' AND f LIKE '%9' THEN f = 'f29' WHEN f LIKE 'f12%' THEN true ELSE f NOT LIKE 'f1%' END)
""")
def walked_files(spark, sf):
    """The tree of paths without what ignore files in two folders exclude."""
    rules = values(spark, "dir text", ("", "# first\n\nf1*\n!f12*\n/d2/\nd4/e1/f*3\ne1/f*4\n"), ("/d3", "*9  \n!f29\nf2*/\n"))
    return walk.walked(_tree(spark, sf), walk.ignore_rules(rules)).select("path")


@query("""
    SELECT user_id, 'l' || event_id AS label, event_id::VARCHAR AS path FROM events WHERE event_id % 3 = 0
""")
def chosen_labels(spark, sf):
    k = F.col("event_id")
    label = F.concat(F.lit("l"), k.cast("string"))
    each = F.sort_array(F.collect_list(F.struct("event_id", k.cast("string").alias("path"), label.alias("label"))))
    trees = table(spark, sf, "events").groupBy("user_id").agg(F.transform(each, lambda x: x["path"]).alias("paths"), F.transform(each, lambda x: x["label"]).alias("labels"))
    chosen = table(spark, sf, "events").select("user_id", F.when(k % 3 == 0, label).otherwise(F.concat(label, F.lit("?"))).alias("label"))
    return inputs.chosen_paths(trees, chosen, ["user_id"])


@query("""
    SELECT user_id, string_agg('file ' || chr(39) || 'v' || event_id || '.' || event_type || chr(39) || chr(10), '' ORDER BY event_id) AS list, arg_min(lower(event_type), event_id) AS ext FROM events GROUP BY user_id
""")
def video_lists(spark, sf):
    d = table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), F.concat(F.lit("v"), F.col("event_id").cast("string"), F.lit("."), F.col("event_type")).alias("path"))
    return inputs.video_list(d, ["user_id"])


@query("""
    SELECT c_nationkey, string_agg('p/' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '.jpg' ELSE '.jpeg' END, ' ' ORDER BY c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '.jpg' ELSE '.jpeg' END) AS pages FROM customer WHERE c_custkey % 4 < 2 GROUP BY c_nationkey
""")
def page_images(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".jpg", ".jpeg", ".JPG", ".png"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    d = table(spark, sf, "customer").select("c_nationkey", F.concat(F.lit("p/"), F.col("c_custkey").cast("string"), ext).alias("path"))
    return inputs.page_files(d, ["c_nationkey"]).select("c_nationkey", F.array_join("pages", " ").alias("pages"))


@query("""
    SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def first_inputs(spark, sf):
    return inputs.first_input(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""
    SELECT name, grp::INT AS grp, ord, row_number() OVER (ORDER BY grp, ord) AS n FROM (SELECT n_name AS name, 1 AS grp, n_nationkey::BIGINT AS ord FROM nation UNION ALL SELECT r_name, 0, r_regionkey::BIGINT FROM region)
""")
def piped_inputs(spark, sf):
    named = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    piped = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("ord"))
    d = numbering.numbered(inputs.all_inputs(piped, named), ["place"], "n", start=1)
    return d.select("name", F.col("place.group").alias("grp"), F.col("place.ord").alias("ord"), "n")


@query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN chr(57909) WHEN 1 THEN chr(59304) WHEN 2 THEN chr(61441) END AS icon, CASE c_custkey % 4 WHEN 0 THEN chr(27) || '[38;5;214m' WHEN 1 THEN chr(27) || '[38;5;166m' WHEN 2 THEN chr(27) || '[38;5;113m' END AS color FROM customer
""")
def language_icons(spark, sf):
    lang = F.element_at(F.array(*map(F.lit, ("PY", "rust", "flac", "none"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    i = language_icon(lang)
    return table(spark, sf, "customer").select("c_custkey", i["icon"].alias("icon"), i["color"].alias("color"))


@query("""
    SELECT doc_id, greatest(1, len(string_split(regexp_replace(text, '\\\\r?\\\\n$', ''), chr(10))))::INT AS height FROM documents
""")
def row_heights(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tables.row_heights(["doc_id", "text", "source"]).alias("height"))


@query("""
    SELECT event_id, coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY event_id) <> v, false) AS breaks FROM (SELECT *, event_id // 7 % 3 AS v FROM events)
""")
def source_breaks(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", (F.floor(F.col("event_id") / 7) % 3).alias("line"))
    return markdown.source_breaks(d, ["user_id"], ["event_id"]).select("event_id", "breaks")


@query(r"""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR NOT regexp_matches(text, '[^\x00-\x7F]') THEN 'utf-8' ELSE 'windows-1252' END AS encoding, text FROM documents
""")
def decoded_texts(spark, sf):
    """Texts of two encodings, told apart by their bytes; those that Latin 1 can't write stay in UTF-8."""
    text = F.col("text")
    data = F.when(F.col("doc_id") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return table(spark, sf, "documents").select("doc_id", convert.decoded(data).alias("d")).select("doc_id", "d.encoding", "d.text")


@query("""
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://github.com/a/b/blob/x/' || page_id || '.png?raw=true' ELSE regexp_replace(url, '[^/]*$', '') || 'n.webm' END AS src, CASE WHEN page_id % 2 = 0 THEN 'png' ELSE 'webm' END AS ext, CASE WHEN page_id % 2 = 0 THEN 5 ELSE 7 END AS size FROM pages
""")
def scraped_media(spark, sf):
    k = F.col("page_id")
    blob = F.concat(F.lit("https://github.com/a/b/blob/x/"), k.cast("string"), F.lit(".png"))
    markup = F.concat(F.col("html"), F.lit("<!-- <img src='c.png'> --><script>'<img src=\"d.png\">'</script><video><source src='n.webm'></video><img src=\"no type.png\">"))
    p = table(spark, sf, "pages").select("page_id", F.when(k % 2 == 0, blob).otherwise(F.col("url")).alias("url"), markup.alias("html"))
    own = F.when(k % 2 == 0, F.concat(blob, F.lit("?raw=true"))).otherwise(F.concat(F.regexp_extract("url", "^(.*/)", 1), F.lit("n.webm")))
    media = table(spark, sf, "pages").select(own.alias("src"), F.when(k % 2 == 0, "image/png").otherwise("video/webm").alias("mime"), F.when(k % 2 == 0, 5).otherwise(7).alias("size")).distinct()
    return html.scraped(p, media)


@query(None)
def quantized_palette(spark, sf):
    """A palette of 16 colors for all parts as pixels."""
    k = F.col("p_partkey")
    d = table(spark, sf, "part").select((k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 7 % 251).alias("b"))
    return values(spark, "idx r g b", *[(i, *c) for i, c in enumerate(pixels.palette_of(d, 16))])


@query(None)
def wrapped_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", wrapping.wrapped(F.col("text"), 60, 1, "> ", "  ").alias("text"))


# --- beyond SQL

@query(None)
def html_to_md(spark, sf):
    r = html.html_to_markdown(F.col("html"))
    return table(spark, sf, "pages").select("page_id", r["content"].alias("md"))


@query(None)
def html_to_md_clean(spark, sf):
    r = html.html_to_markdown(F.col("html"), clean=True)
    return table(spark, sf, "pages").select("page_id", r["content"].alias("md"))


@query(None)
def md_nodes(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.col("text")).alias("md"))
    return markdown.md_nodes(d).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1 AS line, 1 AS level, source AS title FROM documents")
def md_outline(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.col("text")).alias("md"))
    return markdown.outline(markdown.md_nodes(d))


@query(None)
def md_html(spark, sf):
    return table(spark, sf, "documents").select("doc_id", markdown.md_to_html(F.col("text")).alias("html"))


@query(None)
def md_terminal(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", markdown.md_to_terminal(F.col("text")).alias("ansi"))


@query(r"""
    SELECT doc_id, (length(text) - length(regexp_replace(text, '[^\p{Mn}\p{Me}\p{Cf}\p{Cc}]+', '', 'g'))
        + length(regexp_replace(text, '[^\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{1F900}-\x{1F9FF}]+', '', 'g')))::INT AS width
    FROM documents
""")
def display_width(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.string_len(F.concat(F.lit("\x1b[1m"), F.col("text"), F.lit("\x1b[0m"))).alias("width"))


@query(None)
def sixel_image(spark, sf):
    k = F.col("p_partkey")
    place = k % 400
    d = table(spark, sf, "part").select(F.floor(k / 400).alias("img"), (place % 20).cast("int").alias("x"), F.floor(place / 20).cast("int").alias("y"), (k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 7 % 256).alias("b"))
    return pixels.sixel(d, _PALETTE)


@query("""
    SELECT event_id, CASE WHEN ms > before THEN ms - before ELSE 33 END::BIGINT AS ms
    FROM (SELECT event_id, ms, lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS before FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))
""")
def frame_delays_stream(spark, sf):
    """The delays by Structured Streaming, from the table's file to a table in the checkpoint folder or, in local mode, a temporary one."""
    from quire.streaming.frames import stream_delays
    from quire.streaming.limits import run_available

    rows = _streamed(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), _whole_ms().alias("ts"))
    out = run_available(stream_delays(rows), "frames")
    return out.select(F.col("frame_id").alias("event_id"), F.round(F.col("delay") * 1000).cast("long").alias("ms"))


def _streamed(spark, sf, name):
    """A table of the folder as a stream; a file or a folder of files makes one or more micro-batches."""
    return spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet*")


_THROTTLED = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    accepted AS (
        SELECT user_id, ts, k FROM e WHERE k = 1
        UNION ALL
        SELECT user_id, arg_min(ts, k), min(k) FROM (
            SELECT e.user_id, e.ts, e.k FROM accepted a JOIN e ON e.user_id = a.user_id AND e.k > a.k AND e.ts >= a.ts + INTERVAL 6 HOURS
        ) GROUP BY user_id
    )
    SELECT event_id, a.k IS NOT NULL AS accepted FROM e LEFT JOIN accepted a USING (user_id, k)
"""


@query(_THROTTLED)
def throttled_events(spark, sf):
    """The events of each user that come six hours or more after the last accepted one."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    d = table(spark, sf, "events").select("user_id", "event_id", micros.alias("at"))
    return frames.throttle(d, "at", ["user_id"], least=6 * 3600 * 10**6, order=["event_id"]).select("event_id", "accepted")


@query(_THROTTLED)
def throttled_stream(spark, sf):
    """The same by Structured Streaming, with the last accepted time as state."""
    from quire.streaming.limits import run_available, stream_throttle

    rows = _streamed(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return run_available(stream_throttle(rows, "ts", ["user_id"], 6 * 3600.0, ["event_id"], idle=86400.0), "throttled").select("event_id", "accepted")


@query("""
    SELECT event_id, upto FROM (SELECT event_id, sum(size) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS upto FROM (SELECT user_id, event_id, event_id % 50 * 7 AS size FROM events)) WHERE upto <= 4000
""")
def capped_stream(spark, sf):
    """Events as chunks of downloads by user, as a stream that closes each at the cap."""
    from quire.streaming.limits import run_available, stream_capped

    chunks = _streamed(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 50 * 7).alias("size"))
    return run_available(stream_capped(chunks, 4000, "user_id", "event_id"), "capped").select("event_id", "upto")


_MOVES = ("zoom_in", "right", "zoom_in", "down", "left", "far_down", "zoom_out", "bottom", "right", "up", "reset", "zoom_in", "top", "far_up", "next", "previous", "noise")


@query(rf"""
    WITH RECURSIVE names AS (SELECT {list(_MOVES)} AS names),
    e AS (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, names[(event_id * 7 + user_id) % {len(_MOVES)} + 1] AS ev,
               400 + user_id % 37 * 31 AS iw, 300 + user_id % 23 * 41 AS ih
        FROM events, names
    ),
    s AS (
        SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 1 AS zoom, 0 AS px, 0 AS py, 0 AS shown, false AS changed, any_value(iw)::INT AS iw, any_value(ih)::INT AS ih FROM e GROUP BY user_id
        UNION ALL
        SELECT user_id, k, event_id, zoom, greatest(-rx, least(rx, mx)), greatest(-ry, least(ry, my)), shown, changed, iw, ih
        FROM (
            SELECT *, greatest(0, trunc((iw - trunc(sx))::DOUBLE / 2))::INT AS rx, greatest(0, trunc((ih - trunc(sy))::DOUBLE / 2))::INT AS ry
            FROM (
                SELECT *, (320::FLOAT / (fit * zoom::FLOAT)::FLOAT)::FLOAT AS sx, (240::FLOAT / (fit * zoom::FLOAT)::FLOAT)::FLOAT AS sy
                FROM (
                    SELECT user_id, k, event_id, iw, ih, fit,
                        CASE WHEN ev = 'zoom_in' THEN zoom + 1 WHEN ev = 'zoom_out' THEN greatest(1, zoom - 1) WHEN ev = 'reset' THEN 1 ELSE zoom END AS zoom,
                        CASE WHEN ev = 'reset' THEN 0 WHEN dx <> 0 AND abs(px + dx) <= lx THEN px + dx ELSE px END AS mx,
                        CASE WHEN ev = 'reset' THEN 0 WHEN dy <> 0 AND abs(py + dy) <= ly THEN py + dy WHEN ev = 'top' THEN -ly WHEN ev = 'bottom' THEN ly ELSE py END AS my,
                        CASE WHEN ev = 'next' THEN least(2, shown + 1) WHEN ev = 'previous' THEN greatest(0, shown - 1) ELSE shown END AS shown,
                        CASE WHEN ev IN ('zoom_in', 'reset') THEN true WHEN ev = 'zoom_out' THEN zoom > 1 WHEN ev = 'next' THEN shown < 2 WHEN ev = 'previous' THEN shown > 0
                             WHEN ev = 'top' THEN py <> -ly WHEN ev = 'bottom' THEN py <> ly ELSE (dx <> 0 AND abs(px + dx) <= lx) OR (dy <> 0 AND abs(py + dy) <= ly) END AS changed
                    FROM (
                        SELECT *, greatest(0, (iw - least(round((320::FLOAT / (fit * zoom::FLOAT)::FLOAT)::FLOAT)::INT, iw)) // 2)::INT AS lx,
                               greatest(0, (ih - least(round((240::FLOAT / (fit * zoom::FLOAT)::FLOAT)::FLOAT)::INT, ih)) // 2)::INT AS ly
                        FROM (
                            SELECT s.user_id, e.k, e.event_id, e.ev, s.zoom, s.px, s.py, s.shown, s.iw, s.ih, least((320::FLOAT / s.iw::FLOAT)::FLOAT, (240::FLOAT / s.ih::FLOAT)::FLOAT) AS fit,
                                CASE e.ev WHEN 'left' THEN -50 WHEN 'right' THEN 50 ELSE 0 END AS dx,
                                CASE e.ev WHEN 'up' THEN -50 WHEN 'down' THEN 50 WHEN 'far_up' THEN -200 WHEN 'far_down' THEN 200 ELSE 0 END AS dy
                            FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1
                        )
                    )
                )
            )
        )
    )
    SELECT event_id, zoom::INT AS zoom, px::INT AS pan_x, py::INT AS pan_y, shown::INT AS shown, changed FROM s WHERE k > 0
""")
def viewer_events(spark, sf):
    """Events as moves in an image by user, 320 by 240 pixels shown: the state after each."""
    k, user = F.col("event_id"), F.col("user_id")
    move = F.get(F.array(*map(F.lit, _MOVES)), ((k * 7 + user) % len(_MOVES)).cast("int"))
    size = [F.lit(320).alias("cw"), F.lit(240).alias("ch"), (400 + user % 37 * 31).cast("int").alias("iw"), (300 + user % 23 * 41).cast("int").alias("ih")]
    d = table(spark, sf, "events").select("user_id", "event_id", move.alias("event"), *size)
    return viewer.replay(d, ["user_id"], ["event_id"], images=3).select("event_id", "zoom", "pan_x", "pan_y", "shown", "changed")


# --- rasters: every 400 parts are an image of 20 by 20 pixels

_PARTS = """(
    SELECT p_partkey // 400 AS img, (p_partkey % 400 % 20)::INT AS x, (p_partkey % 400 // 20)::INT AS y,
        (p_partkey * 7 % 256)::INT AS r, (p_partkey * p_size % 256)::INT AS g, (p_size * 5)::INT AS b, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 255 - p_size * 2 END::INT AS a
    FROM part)"""


def _part_pixels(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    place = k % 400
    rgba = [(k * 7 % 256).cast("int").alias("r"), (k * size % 256).cast("int").alias("g"), (size * 5).cast("int").alias("b"), F.when(k % 11 == 0, 0).otherwise(255 - size * 2).cast("int").alias("a")]
    return table(spark, sf, "part").select(F.floor(k / 400).alias("img"), (place % 20).cast("int").alias("x"), F.floor(place / 20).cast("int").alias("y"), *rgba)


@query(f"""
    WITH px AS (SELECT * FROM {_PARTS}),
    size AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY img),
    fitted AS (
        SELECT img, w, h, greatest(1, CASE WHEN s > (9::FLOAT / 13::FLOAT) THEN 9 ELSE round((13::FLOAT * s)::FLOAT) END)::INT AS nw,
            greatest(1, CASE WHEN s > (9::FLOAT / 13::FLOAT) THEN round((9::FLOAT / s)::FLOAT) ELSE 13 END)::INT AS nh
        FROM (SELECT *, (w::FLOAT / h::FLOAT)::FLOAT AS s FROM size)
    ),
    pairs AS (SELECT w AS n_in, nw AS n_out FROM fitted UNION SELECT h, nh FROM fitted),
    taps AS (
        SELECT n_in, n_out, o, s, ((s + 0.5) - (o + 0.5) * n_in::DOUBLE / n_out) / greatest(n_in::DOUBLE / n_out, 1) AS t
        FROM pairs, range(0, 64) AS os(o), range(0, 64) AS ss(s) WHERE o < n_out AND s < n_in
    ),
    raw AS (SELECT *, CASE WHEN abs(t) >= 3 THEN 0 WHEN t = 0 THEN 1 ELSE sin(t * pi()) / (t * pi()) * sin(t / 3 * pi()) / (t / 3 * pi()) END AS w FROM taps),
    weights AS (SELECT n_in, n_out, o, s, w / sum(w) OVER (PARTITION BY n_in, n_out, o) AS w FROM raw),
    wide AS (
        SELECT px.img, o AS x, y, sum(r * a / 255.0::DOUBLE * k.w) AS r, sum(g * a / 255.0::DOUBLE * k.w) AS g, sum(b * a / 255.0::DOUBLE * k.w) AS b, sum(a * k.w) AS a
        FROM px JOIN fitted USING (img) JOIN weights k ON n_in = fitted.w AND n_out = nw AND s = x GROUP BY ALL
    ),
    done AS (
        SELECT wide.img, x, o AS y, sum(r * k.w) AS r, sum(g * k.w) AS g, sum(b * k.w) AS b, sum(a * k.w) AS a
        FROM wide JOIN fitted USING (img) JOIN weights k ON n_in = h AND n_out = nh AND s = y GROUP BY ALL
    ),
    whole AS (
        SELECT img, x, y, greatest(0, least(255, floor(round(a, 6) + 0.5)))::INT AS wa, greatest(0, least(255, floor(round(r * 255 / a, 6) + 0.5)))::INT AS r,
            greatest(0, least(255, floor(round(g * 255 / a, 6) + 0.5)))::INT AS g, greatest(0, least(255, floor(round(b * 255 / a, 6) + 0.5)))::INT AS b
        FROM done
    ),
    box AS (SELECT img, nw, nh, x, y FROM fitted, range(0, 9) AS xs(x), range(0, 13) AS ys(y))
    SELECT img, x::INT AS x, y::INT AS y, CASE WHEN coalesce(wa, 0) = 0 THEN 0 ELSE r END AS r, CASE WHEN coalesce(wa, 0) = 0 THEN 0 ELSE g END AS g, CASE WHEN coalesce(wa, 0) = 0 THEN 0 ELSE b END AS b, coalesce(wa, 0) AS a
    FROM box LEFT JOIN (SELECT whole.* REPLACE (x + (9 - nw) // 2 AS x, y + (13 - nh) // 2 AS y) FROM whole JOIN fitted USING (img)) USING (img, x, y)
""")
def resampled_images(spark, sf):
    """Images brought into boxes of 9 by 13 pixels, padded."""
    d = _part_pixels(spark, sf)
    return rasters.resample(d, d.select("img").distinct().select("img", F.lit(9).alias("width"), F.lit(13).alias("height")), pad=True)


def _raster_files(spark, sf):
    """The images as files of four kinds by number: PNM in color and gray, farbfeld, and TGA with its lowest row first."""
    two = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    kind, rows = F.col("img") % 4, F.lit(20)
    cell = F.when(kind == 0, F.concat(two("r"), two("g"), two("b"))).when(kind == 1, two("r")).when(kind == 2, F.concat(*[two(c) for c in "rrggbbaa"])).otherwise(F.concat(*map(two, "bgra")))
    d = _part_pixels(spark, sf).select("img", F.when(kind == 3, rows - 1 - F.col("y")).otherwise(F.col("y")).alias("line"), "x", cell.alias("cell"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("line", "x", "cell"))), lambda c: c["cell"])
    text = lambda s: s.encode().hex()
    head = F.when(kind == 0, text("P6\n# parts\n20 20\n255\n")).when(kind == 1, text("P5 20\t20 255\n")).when(kind == 2, text("farbfeld") + "00000014" * 2).otherwise("0000020000000000000000001400140020" + "08")
    return d.groupBy("img").agg(F.count("*").alias("n"), F.array_join(cells, "").alias("body")).filter("n = 400").select("img", F.unhex(F.concat(head, "body")).alias("content"))


@query(f"""
    SELECT img, x, y, r, CASE WHEN img % 4 = 1 THEN r ELSE g END AS g, CASE WHEN img % 4 = 1 THEN r ELSE b END AS b, CASE WHEN img % 4 < 2 THEN 255 ELSE a END AS a
    FROM {_PARTS} WHERE img IN (SELECT img FROM {_PARTS} GROUP BY img HAVING count(*) = 400)
""")
def raster_files(spark, sf):
    """The pixels of raster files made of parts; an image that lacks a pixel makes none."""
    return rasters.raster_pixels(_raster_files(spark, sf), "img")


@query(None)
def png_files(spark, sf):
    """PNG files of the images; what Spark's image source reads in them is tested."""
    return rasters.png(_part_pixels(spark, sf)).select("img", F.octet_length("png").alias("n_bytes"), F.sha2("png", 256).alias("sha256"))


# the queries over files add themselves to these
from quire.plans import file_queries  # noqa: E402, F401
