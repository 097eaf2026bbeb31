"""What a terminal shows, as strings: images inline, placeholders, and the switches between forms. Native column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.geometry import Screen, dim_to_cells, placeholder_colors
from quire.functions.text import ANSI, chunks, cursor_offset, cursor_place, let

#: The character that stands for a cell of a placed image.
PLACEHOLDER = "\U0010eeee"

#: The 297 marks that number rows and columns of a placed image, in order.
MARKS = (
    0x0305, 0x030D, 0x030E, 0x0310, 0x0312, 0x033D, 0x033E, 0x033F, 0x0346, 0x034A, 0x034B, 0x034C,
    0x0350, 0x0351, 0x0352, 0x0357, 0x035B, 0x0363, 0x0364, 0x0365, 0x0366, 0x0367, 0x0368, 0x0369,
    0x036A, 0x036B, 0x036C, 0x036D, 0x036E, 0x036F, 0x0483, 0x0484, 0x0485, 0x0486, 0x0487, 0x0592,
    0x0593, 0x0594, 0x0595, 0x0597, 0x0598, 0x0599, 0x059C, 0x059D, 0x059E, 0x059F, 0x05A0, 0x05A1,
    0x05A8, 0x05A9, 0x05AB, 0x05AC, 0x05AF, 0x05C4, 0x0610, 0x0611, 0x0612, 0x0613, 0x0614, 0x0615,
    0x0616, 0x0617, 0x0657, 0x0658, 0x0659, 0x065A, 0x065B, 0x065D, 0x065E, 0x06D6, 0x06D7, 0x06D8,
    0x06D9, 0x06DA, 0x06DB, 0x06DC, 0x06DF, 0x06E0, 0x06E1, 0x06E2, 0x06E4, 0x06E7, 0x06E8, 0x06EB,
    0x06EC, 0x0730, 0x0732, 0x0733, 0x0735, 0x0736, 0x073A, 0x073D, 0x073F, 0x0740, 0x0741, 0x0743,
    0x0745, 0x0747, 0x0749, 0x074A, 0x07EB, 0x07EC, 0x07ED, 0x07EE, 0x07EF, 0x07F0, 0x07F1, 0x07F3,
    0x0816, 0x0817, 0x0818, 0x0819, 0x081B, 0x081C, 0x081D, 0x081E, 0x081F, 0x0820, 0x0821, 0x0822,
    0x0823, 0x0825, 0x0826, 0x0827, 0x0829, 0x082A, 0x082B, 0x082C, 0x082D, 0x0951, 0x0953, 0x0954,
    0x0F82, 0x0F83, 0x0F86, 0x0F87, 0x135D, 0x135E, 0x135F, 0x17DD, 0x193A, 0x1A17, 0x1A75, 0x1A76,
    0x1A77, 0x1A78, 0x1A79, 0x1A7A, 0x1A7B, 0x1A7C, 0x1B6B, 0x1B6D, 0x1B6E, 0x1B6F, 0x1B70, 0x1B71,
    0x1B72, 0x1B73, 0x1CD0, 0x1CD1, 0x1CD2, 0x1CDA, 0x1CDB, 0x1CE0, 0x1DC0, 0x1DC1, 0x1DC3, 0x1DC4,
    0x1DC5, 0x1DC6, 0x1DC7, 0x1DC8, 0x1DC9, 0x1DCB, 0x1DCC, 0x1DD1, 0x1DD2, 0x1DD3, 0x1DD4, 0x1DD5,
    0x1DD6, 0x1DD7, 0x1DD8, 0x1DD9, 0x1DDA, 0x1DDB, 0x1DDC, 0x1DDD, 0x1DDE, 0x1DDF, 0x1DE0, 0x1DE1,
    0x1DE2, 0x1DE3, 0x1DE4, 0x1DE5, 0x1DE6, 0x1DFE, 0x20D0, 0x20D1, 0x20D4, 0x20D5, 0x20D6, 0x20D7,
    0x20DB, 0x20DC, 0x20E1, 0x20E7, 0x20E9, 0x20F0, 0x2CEF, 0x2CF0, 0x2CF1, 0x2DE0, 0x2DE1, 0x2DE2,
    0x2DE3, 0x2DE4, 0x2DE5, 0x2DE6, 0x2DE7, 0x2DE8, 0x2DE9, 0x2DEA, 0x2DEB, 0x2DEC, 0x2DED, 0x2DEE,
    0x2DEF, 0x2DF0, 0x2DF1, 0x2DF2, 0x2DF3, 0x2DF4, 0x2DF5, 0x2DF6, 0x2DF7, 0x2DF8, 0x2DF9, 0x2DFA,
    0x2DFB, 0x2DFC, 0x2DFD, 0x2DFE, 0x2DFF, 0xA66F, 0xA67C, 0xA67D, 0xA6F0, 0xA6F1, 0xA8E0, 0xA8E1,
    0xA8E2, 0xA8E3, 0xA8E4, 0xA8E5, 0xA8E6, 0xA8E7, 0xA8E8, 0xA8E9, 0xA8EA, 0xA8EB, 0xA8EC, 0xA8ED,
    0xA8EE, 0xA8EF, 0xA8F0, 0xA8F1, 0xAAB0, 0xAAB2, 0xAAB3, 0xAAB7, 0xAAB8, 0xAABE, 0xAABF, 0xAAC1,
    0xFE20, 0xFE21, 0xFE22, 0xFE23, 0xFE24, 0xFE25, 0xFE26, 0x10A0F, 0x10A38, 0x1D185, 0x1D186, 0x1D187,
    0x1D188, 0x1D189, 0x1D1AA, 0x1D1AB, 0x1D1AC, 0x1D1AD, 0x1D242, 0x1D243, 0x1D244,
)


def diacritics() -> tuple[str, ...]:
    """The marks as characters."""
    return tuple(map(chr, MARKS))


def iterm_image(base64: Column, offset: Column | None = None, x: Column | None = None, y: Column | None = None, tmux: bool = False) -> Column:
    """An image's base 64 as an inline file: its place, its offset, then the sequence with the size of the base 64."""
    start, end = ("\x1bPtmux;\x1b\x1b", "\x1b\x07\x1b\\") if tmux else ("\x1b", "\x07")
    size = F.length(base64).cast("string")
    return F.concat(_at(x, y), _by(offset), F.lit(f"{start}]1337;File=inline=1;size="), size, F.lit(":"), base64, F.lit(end))


def kitty_image(base64: Column, options: Column, offset: Column | None = None, x: Column | None = None, y: Column | None = None, tmux: bool = False, later: str = "") -> Column:
    """An image's base 64 in graphics commands of 4096 characters: the first has the options, all but the last say that more follows.

    ``options`` is text such as ``f=100,a=T,i=7``, and ``later`` such text for the commands after the first; an empty one adds nothing. Without data there is no command.
    """
    start, end = ("\x1b\x1b_G", "\x1b\x1b\\") if tmux else ("\x1b_G", "\x1b\\")
    first = F.when(options == "", "").otherwise(F.concat(options, F.lit(",")))
    parts = F.when(base64 == "", F.array().cast("array<string>")).otherwise(chunks(base64))

    def command(part: Column, i: Column, n: Column) -> Column:
        return F.concat(F.lit(start), F.when(i == 0, first).otherwise(f"{later}," if later else ""), F.lit("q=2,m="), F.when(i + 1 < n, "1").otherwise("0"), F.lit(";"), part, F.lit(end))

    body = let(parts, lambda p: F.array_join(F.transform(p, lambda part, i: command(part, i, F.size(p))), ""))
    return F.concat(_at(x, y), _by(offset), F.lit("\x1bPtmux;" if tmux else ""), body, F.lit("\x1b\\" if tmux else ""))


def unicode_placeholder(columns: Column, rows: Column, image: Column, offset: Column | None = None, x: Column | None = None, y: Column | None = None) -> Column:
    """The cells of a placed image: its number's low bytes as a color, and on each cell marks for row, column and the number's high byte.

    Rows stand on lines of their own, unless a place is given.
    """
    marks = F.array(*map(F.lit, diacritics()))
    mark = lambda k: F.coalesce(F.get(marks, k.cast("int")), F.lit(""))
    byte = lambda k: F.shiftright(image.cast("long"), k).bitwiseAND(F.lit(255))
    color = F.concat(F.lit("\x1b[38;2;"), F.concat_ws(";", *[byte(k).cast("string") for k in (16, 8, 0)]), F.lit("m"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def line(row: Column) -> Column:
        cells = F.transform(upto(columns), lambda col: F.concat(F.lit(PLACEHOLDER), mark(row), mark(col), mark(byte(24))))
        return F.concat(_at(x, None if y is None else y + row), _by(offset), color, F.array_join(cells, ""))

    return F.concat(color, F.array_join(F.transform(upto(rows), line), "\n" if x is None else ""), F.lit("\x1b[39m"))


def _at(x: Column | None, y: Column | None) -> Column:
    return F.lit("") if x is None or y is None else cursor_place(x, y)


def _by(offset: Column | None) -> Column:
    return F.lit("") if offset is None else cursor_offset(offset)


def trim_ansi(text: Column) -> Column:
    """Without as many spaces at either end as blanks are seen there; sequences stay.

    The first spaces go wherever they stand, then the last ones, as in the original.
    """
    shown = F.regexp_replace(text, ANSI, "")
    lead = F.length(F.regexp_extract(shown, r"(?U)^(\s*)", 1))
    tail = F.length(F.regexp_extract(shown, r"(?U)(\s*)$", 1))
    without = lambda t, n: F.array_join(F.split(t, " ", n + 1), "")
    cut = F.when(lead > 0, without(text, lead)).otherwise(text)
    return F.when(tail > 0, F.reverse(without(F.reverse(cut), tail))).otherwise(cut)


def image_placeholder(image: Column, number: Column, width: Column, by_cells: Column, screen: Screen) -> Column:
    """What stands for an image in a text while it is laid out: lines of full characters in two colors that its number gives.

    Where ``by_cells`` holds, the cells of the image's first line and its lines
    give the size; else it is one line, as wide as ``width`` pixels are on the
    screen, one cell if that can't be told. An image without lines is ''. Null
    for a null image or number.
    """
    colors = placeholder_colors(number)
    lines = F.split(F.regexp_replace(image, r"\n\z", ""), "\n", -1)
    cells = F.when(by_cells, F.size(F.regexp_extract_all(lines[0], F.lit(PLACEHOLDER), F.lit(0)))).otherwise(
        F.coalesce(dim_to_cells(F.concat(width.cast("string"), F.lit("px")), F.lit(screen.px_width), F.lit(screen.columns)), F.lit(1))
    )
    height = F.when(by_cells, F.when(image == "", 0).otherwise(F.size(lines))).otherwise(F.when(image.isNotNull(), 1))
    line = F.concat(F.lit("\x1b[38;5;"), colors["fore"].cast("string"), F.lit("m\x1b[48;5;"), colors["back"].cast("string"), F.lit("m"), F.repeat(F.lit("█"), cells), F.lit("\x1b[0m"))
    return F.array_join(F.array_repeat(line, height), "\n")


def replace_placeholder(text: Column, placeholder: Column, image: Column) -> Column:
    """Each next line of an image in place of the first placeholder line that is left, with underlining off."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), placeholder, F.lit(r"\E")), F.lit(-1))
    lines = F.transform(F.split(image, "\n"), lambda x: F.concat(F.lit("\x1b[24m"), x))
    rest = F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0)))
    parts = F.zip_with(rest, lines, lambda g, x: F.when(g.isNull(), "").otherwise(F.concat(F.coalesce(x, placeholder), g)))
    return F.when(F.contains(text, placeholder), F.concat(gaps[0], F.array_join(parts, ""))).otherwise(text)


def should_use(switch: Column, auto: Column) -> Column:
    """A switch of always, never or auto."""
    return F.when(switch == "always", True).when(switch == "never", False).otherwise(auto)


def pages(switch: Column, is_tty: Column, lines: Column, height: Column) -> Column:
    """Whether text goes through a pager."""
    return should_use(switch, is_tty & (lines > height))


def indents(under_header: Column, depth: Column) -> Column:
    """Whether an element is indented: one of the document itself, under a heading."""
    return under_header & (depth == 0)


def image_mode(mode: Column, encoder: Column) -> Column:
    """Which images of a document are shown: all, small or none, by the encoder where the mode is auto."""
    return F.when(mode != "auto", mode).when(encoder == "kitty", "all").when(encoder.isin("iterm", "sixel"), "small").otherwise("none")


def image_cap(mode: Column) -> Column:
    """The bytes that an image may have in a mode; null is no bound."""
    return F.when(mode != "all", F.lit(50_000))


def zooms(zoom: Column, x: Column, y: Column) -> Column:
    """Whether a zoom and pan change anything."""
    return (F.coalesce(zoom, F.lit(1)) != 1) | (F.coalesce(x, F.lit(0)) != 0) | (F.coalesce(y, F.lit(0)) != 0)


def first_found(*places: Column) -> Column:
    """The first of several places that there is."""
    return F.coalesce(*places)


def is_url(text: Column) -> Column:
    """Whether an input is fetched; all but https is a path."""
    return text.startswith("https://")


def is_local(src: Column) -> Column:
    """Whether an image reference is a file."""
    return ~(src.startswith("http://") | src.startswith("https://") | src.startswith("data:"))


def is_page_image(ext: Column) -> Column:
    return ext.isin("jpg", "jpeg")


def truthy(text: Column) -> Column:
    """An environment's yes: 1, or true in any case."""
    return (text == "1") | (F.lower(text) == "true")


def settings(env: Column, prefix: str) -> Column:
    """The settings that an environment map makes: struct<encoder, pager, theme, inline, listing, silent, plain, images>; null is unset."""
    value = lambda k: F.try_element_at(env, F.lit(f"{prefix}_{k}"))
    images = F.lower(value("MD_IMAGE"))
    return F.struct(
        F.lower(value("ENCODER")).alias("encoder"), value("PAGER").alias("pager"), value("THEME").alias("theme"), value("INLINE_OPTS").alias("inline"),
        value("LS_OPTS").alias("listing"), truthy(value("SILENT")).alias("silent"), truthy(value("NO_LINENUMBERS")).alias("plain"),
        F.when(images.isin("all", "small", "none", "auto"), images).alias("images"),
    )


#: By platform the archive, the path of the executable in it, and the names in URLs and folders.
PLATFORMS = {
    "linux": ("chrome-linux", "chrome", "Linux_x64", "linux"),
    "mac": ("chrome-mac", "Chromium.app/Contents/MacOS/Chromium", "Mac", "mac"),
    "mac_arm": ("chrome-mac", "Chromium.app/Contents/MacOS/Chromium", "Mac_Arm", "mac_arm"),
    "win32": ("chrome-win", "chrome.exe", "Win", "win32"),
    "win64": ("chrome-win", "chrome.exe", "Win_x64", "win64"),
}


def platform_paths(platform: Column, host: Column, revision: Column) -> Column:
    """struct<url, folder, executable> of a browser's build; null for other platforms."""
    out = F.lit(None).cast("struct<url:string,folder:string,executable:string>")
    for name, (archive, executable, remote, folder) in PLATFORMS.items():
        old = (revision <= 591_479) if name.startswith("win") else F.lit(False)
        kept = F.concat_ws("-", F.lit(folder), revision.cast("string"))
        url = F.concat_ws("/", host, F.lit("chromium-browser-snapshots"), F.lit(remote), revision.cast("string"), F.concat(F.lit(archive), F.when(old, "32").otherwise(""), F.lit(".zip")))
        out = F.when(platform == name, F.struct(url.alias("url"), kept.alias("folder"), F.concat_ws("/", kept, F.lit(executable)).alias("executable"))).otherwise(out)
    return out
