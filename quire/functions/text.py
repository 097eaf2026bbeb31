"""String functions as native column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of escape sequences, of title comments and of image sizes are parts of the format.
ANSI = r"\x1b(?:\[[0-9;?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\))"
TITLE = r"<!--\s*S-TITLE:\s*(.*?)\s*-->"
RESET = "\x1b[0m"
#: The digits of zero-width identifiers.
ZERO_WIDTH = "​‌‍⁠"


def lines(text: Column) -> Column:
    """Lines, of which a last newline makes none of its own."""
    whole = F.split(F.regexp_replace(text, r"\n\z", ""), "\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def line_count(text: Column) -> Column:
    return F.size(lines(text))


def limit_newlines(text: Column) -> Column:
    """Two or more blank lines become one."""
    return F.regexp_replace(text, r"\n[ \t]*+\n(?:[ \t]*+\n)++", "\n\n")


def normalize_blank_lines(text: Column) -> Column:
    """Blank lines are emptied, every line ends, and no more than two newlines stand together."""
    ended = F.when(text == "", text).otherwise(F.concat(F.regexp_replace(text, r"\n\z", ""), F.lit("\n")))
    return F.regexp_replace(F.regexp_replace(ended, r"(?m)^[ \t\r]+$", ""), "\n{3,}", "\n\n")


def title(text: Column) -> Column:
    """What the first title comment holds; null without one."""
    return F.when(text.rlike(TITLE), F.regexp_extract(text, TITLE, 1))


def with_title(text: Column, name: Column) -> Column:
    """A document under its title comment, closed by a rule; as it is where the name is null."""
    return F.coalesce(F.concat(F.lit("<!-- S-TITLE: "), name, F.lit(" -->\n"), text, F.lit("\n---")), text)


def title_box(name: Column, width: int) -> Column:
    """A centred title between rules of box characters."""
    inner = F.greatest(F.lit(width - 2), F.char_length(name))
    left = F.floor((inner - F.char_length(name)) / 2).cast("int")
    rule = F.repeat(F.lit("─"), inner)
    middle = F.concat(F.repeat(F.lit(" "), left), name, F.repeat(F.lit(" "), inner - left - F.char_length(name)))
    return F.concat(F.lit("┌"), rule, F.lit("┐\n│"), middle, F.lit("│\n└"), rule, F.lit("┘"))


def fence(text: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```"))


def quote(text: Column) -> Column:
    """Every line behind ``> ``."""
    return F.array_join(F.transform(lines(text), lambda x: F.concat(F.lit("> "), x)), "\n")


def extension(path: Column) -> Column:
    """The lower-case extension; null without one. A name that only starts with a dot has none."""
    return F.lower(F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit("")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def image_ref(url: Column) -> Column:
    """``url#WxH`` as struct<base, original, width, height>; sizes over 65535 are null."""
    pattern = r"^(.+?)(?:#(\d+)?x(\d+)?)?$"
    size = lambda k: F.when(F.regexp_extract(url, pattern, k).cast("bigint") <= 65535, F.regexp_extract(url, pattern, k).cast("int"))
    empty = lambda k: F.regexp_extract(url, pattern, k) == ""
    side = lambda k: F.when(~empty(k), size(k))
    return F.struct(F.regexp_extract(url, pattern, 1).alias("base"), url.alias("original"), side(2).alias("width"), side(3).alias("height"))


def image_ref_text(src: Column, width: Column, height: Column) -> Column:
    """``src#WxH`` of whichever sizes are there."""
    mark = F.concat(F.lit("#"), F.coalesce(width.cast("string"), F.lit("")), F.lit("x"), F.coalesce(height.cast("string"), F.lit("")))
    return F.when(width.isNull() & height.isNull(), src).otherwise(F.concat(src, mark))


def size_option(text: Column) -> Column:
    """``WxH`` or ``WxHxforce`` as struct<width, height, force>."""
    parts = F.split(text, "x")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("width"), F.get(parts, F.lit(1)).try_cast("int").alias("height"), F.contains(text, F.lit("force")).alias("force"))


def options(text: Column) -> Column:
    """``k=v,k=v`` as a map: trimmed, pairs without ``=`` dropped, the last of a key wins."""
    pairs = F.filter(F.split(text, ","), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def fit_filename(name: Column, width: int, compat: bool = False) -> Column:
    """A name in exactly ``width`` characters: centred, or its base cut before the extension.

    ``compat`` doubles the extension's dot, as the original does.
    """
    n = F.char_length(name)
    left = F.floor((width - n) / 2).cast("int")
    centred = F.concat(F.repeat(F.lit(" "), left), name, F.repeat(F.lit(" "), width - n - left))
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    ext = F.when(dot == "", dot).otherwise(F.concat(F.lit("." if compat else ""), dot))
    base = F.substring(name, F.lit(1), n - F.char_length(dot))
    cut = F.concat(F.substring(base, F.lit(1), F.greatest(width - F.char_length(ext), F.lit(0))), ext)
    return F.when(n <= width, centred).when(F.char_length(ext) >= width, F.substring(ext, 1, width)).otherwise(cut)


def hex_color(code: Column) -> Column:
    """``#RRGGBB`` as struct<r, g, b>."""
    part = lambda k: F.conv(F.substring(code, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def color_hex(r: Column, g: Column, b: Column) -> Column:
    """Components between 0 and 1 as ``#RRGGBB``."""
    part = lambda c: F.lpad(F.hex(F.round(c * 255).cast("int")), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def zero_width_id(number: Column) -> Column:
    """A number in base 4, least digit first, in zero-width characters."""
    return F.translate(F.reverse(F.conv(number.cast("string"), 10, 4)), "0123", ZERO_WIDTH)


def base64(data: Column) -> Column:
    """Base 64 on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]+", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, size: int = 4096) -> Column:
    """A text in pieces of ``size`` characters, cut in one pass; an empty text is one empty piece."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def escape_unknown_tags(text: Column, known: list[str]) -> Column:
    """Angle brackets of title comments, and of tags that aren't ``known``, as entities.

    Each bracket inside a match is escaped: a tag that opens another one inside
    itself becomes text as a whole.
    """
    both = rf"(?i)<!--\s*S-TITLE:[^>]*-->|</?(?!(?:{'|'.join(known)})(?![a-z0-9]))[a-z][a-z0-9]*[^>]*>"
    matches = F.regexp_extract_all(text, F.lit(both), F.lit(0))
    gaps = F.split(text, both, -1)
    escaped = F.transform(matches, lambda m: F.replace(F.replace(m, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    joined = F.zip_with(gaps, escaped, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(F.contains(text, F.lit("<")), F.array_join(joined, "")).otherwise(text)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def retint(text: Column, color: Column) -> Column:
    """Every reset is followed by ``color`` again."""
    return F.replace(text, F.lit(RESET), F.concat(F.lit(RESET), color))


def last_foreground(text: Column) -> Column:
    """The last foreground color sequence of a line; null after a reset or without one."""
    codes = F.regexp_extract_all(text, F.lit(r"\x1b\[([0-9;]*)m"), F.lit(1))
    color = lambda c: c.rlike(r"^(?:3[0-7]|9[0-7]|38;.*)$")
    state = F.aggregate(codes, F.lit(""), lambda s, c: F.when(c.isin("", "0"), "").when(color(c), c).otherwise(s))
    return F.when(state != "", F.concat(F.lit("\x1b["), state, F.lit("m")))


def cursor_offset(columns: Column) -> Column:
    return F.coalesce(F.concat(F.lit("\x1b["), columns.cast("string"), F.lit("C")), F.lit(""))


def cursor_place(x: Column, y: Column) -> Column:
    return F.coalesce(F.concat(F.lit("\x1b["), (y + 1).cast("string"), F.lit(";"), (x + 1).cast("string"), F.lit("H")), F.lit(""))


def expand_home(path: Column, home: str) -> Column:
    """Every ``~`` of a path that starts with one."""
    return F.when(path.startswith("~"), F.replace(path, F.lit("~"), F.lit(home))).otherwise(path)


def decode_pdf_string(data: Column) -> Column:
    """UTF-16 by its byte order mark, else UTF-8 with replacements."""
    return (
        F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(F.substring(data, 3, 1 << 30), "UTF-16BE"))
        .when(F.hex(F.substring(data, 1, 2)) == "FFFE", F.decode(F.substring(data, 3, 1 << 30), "UTF-16LE"))
        .otherwise(F.make_valid_utf8(data.cast("string")))
    )


def char_width(c: str) -> int:
    if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def display_width_of(text: str) -> int:
    return len(text) if text.isascii() and text.isprintable() else sum(map(char_width, text))


@F.pandas_udf(T.IntegerType())
def _display_width(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else display_width_of(t)).astype("Int32")


def string_len(text: Column) -> Column:
    """Columns that a text takes in a terminal, without its escape sequences."""
    return _display_width(strip_ansi(text))
