"""Kinds of files: by extension, MIME type and first bytes. Native column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import extension

#: Extensions, by the icon or kind that they have. Each list is whole.
VIDEO = "mp4 mov avi mkv webm wmv flv m4v ts gif".split()
IMAGE = "avif jpg jpeg jfif png apng gif webp tif tiff tga dds bmp ico hdr exr pbm pam ppm pgm pnm ff qoi pcx".split()
CODE = (
    "codes py rs js ts java c cpp h hpp go php rb sh pl lua swift kt kts scala dart elm hs ml mli r f f90 cs vb asm s clj cljs edn coffee erl hrl "
    "ex exs json toml yaml yml xml html css scss less vue svelte md markdown tex nim zig v odin d sql ps1 bash zsh fish"
).split()
CONFIG = (
    "conf config ini cfg cnf properties env gitconfig gitignore npmrc yarnrc editorconfig dockerignore dockerfile makefile mk nginx apache "
    "htaccess htpasswd hosts service socket timer mount automount swap target path slice sysctl tmpfiles udev logind resolved timesyncd coredump "
    "journald netdev network link netctl wpa pacman mirrorlist vconsole locale fstab crypttab grub syslinux archlinux inputrc bashrc bash_profile "
    "bash_logout profile zshenv zshrc zprofile zlogin zlogout fishrc fish_variables fish_config fish_plugins fish_functions fish_completions "
    "fish_aliases fish_abbreviations fish_user_init fish_user_paths fish_user_variables fish_user_functions fish_user_completions "
    "fish_user_abbreviations fish_user_aliases fish_user_key_bindings"
).split()
ARCHIVE = (
    "zip tar gz bz2 xz zst lz lzma lzo rz sz 7z rar iso dmg pkg deb rpm crx cab msi ar cpio shar lbr mar sbx arc wim swm esd zipx zoo pak kgb ace alz "
    "apk arj ba bh cfs cramfs dar dd dgc ear gca ha hki ice jar lzh lha lzx partimg paq6 paq7 paq8 pea pim pit qda rk sda sea sen sfx shk sit sitx sqx "
    "tar.Z uc uc0 uc2 ucn ur2 ue2 uca uha war xar xp3 yz1 zap zz"
).split()
DOCUMENT = "csv docx odt odp pptx pdf xlsx xls xlsm xlsb xla xlam ods zip md html".split()

#: Parts of MIME types and extensions; the first part that a type contains decides.
MIME = (
    ("image/avif", "avif"), ("image/jpeg", "jpg"), ("image/png", "png"), ("image/apng", "apng"), ("image/gif", "gif"),
    ("image/webp", "webp"), ("image/tiff", "tiff"), ("image/x-tga", "tga"), ("image/vnd.ms-dds", "dds"), ("image/bmp", "bmp"),
    ("image/x-icon", "ico"), ("image/vnd.microsoft.icon", "ico"), ("image/vnd.radiance", "hdr"), ("image/aces", "exr"),
    ("image/exr", "exr"), ("image/x-portable-bitmap", "pbm"), ("image/x-portable-graymap", "pgm"),
    ("image/x-portable-pixmap", "ppm"), ("image/x-portable-anymap", "pam"), ("image/x-farbfeld", "ff"), ("image/x-qoi", "qoi"),
    ("image/x-pcx", "pcx"), ("image/svg+xml", "svg"), ("video/mp4", "mp4"), ("video/webm", "webm"), ("video/x-msvideo", "avi"),
    ("video/x-matroska", "mkv"), ("video/quicktime", "mov"), ("application/pdf", "pdf"), ("text/markdown", "md"),
    ("text/x-markdown", "md"), ("application/msword", "doc"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"),
    ("application/vnd.oasis.opendocument.text", "odt"), ("application/vnd.ms-excel", "xls"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xlsx"),
    ("application/vnd.oasis.opendocument.spreadsheet", "ods"), ("application/vnd.ms-powerpoint", "ppt"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "pptx"),
    ("application/vnd.oasis.opendocument.presentation", "odp"), ("text/csv", "csv"), ("application/csv", "csv"),
    ("application/zip", "zip"), ("application/x-rar-compressed", "rar"), ("application/x-7z-compressed", "7z"),
    ("application/x-tar", "tar"), ("application/gzip", "gz"), ("application/x-bzip2", "bz2"),
)


def is_video(ext: Column) -> Column:
    return ext.isin(VIDEO)


def kind(path: Column) -> Column:
    """video, image or text, by extension; text without one."""
    ext = F.coalesce(extension(path), F.lit(""))
    return F.when(ext.isin(VIDEO), "video").when(ext.isin([*IMAGE, "svg"]), "image").otherwise("text")


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(VIDEO), "video").when(ext.isin([*IMAGE, "svg"]), "image").otherwise("document")


def mime_extension(mime: Column) -> Column:
    """The extension of a MIME type: the first entry of the table that it contains; null for others."""
    # a constant array, since a branch for each entry is too much code where an expression names the result often
    entries = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(ext).alias("ext")) for part, ext in MIME])
    return F.get(F.filter(entries, lambda e: F.contains(mime, e["part"])), 0)["ext"]


def allowed(media: Column, images: bool = True, videos: bool = True, documents: bool = True) -> Column:
    kinds = [k for k, on in (("image", images), ("video", videos), ("document", documents)) if on]
    return media.isin(kinds) if kinds else F.lit(False)


def valid_candidate(asked: Column, ext: Column) -> Column:
    """Whether what came is what the page's markup promised."""
    return F.when(asked == "svg", ext == "svg").when(asked == "video", ext.isin(VIDEO)).when(asked == "image", ext.isin(IMAGE)).otherwise(False)


def icon(ext: Column, is_dir: Column) -> Column:
    """The icon class of a listing's entry."""
    return (
        F.when(is_dir, "folder").when(ext.isin(VIDEO), "video").when(F.coalesce(ext, F.lit("")) == "", "file").when(ext.isin(CODE), "code")
        .when(ext.isin(CONFIG), "conf").when(ext.isin(ARCHIVE), "archive").otherwise("txt")
    )


def github_raw(url: Column) -> Column:
    """Blob pages of GitHub point to the raw file."""
    blob = url.rlike(r"^https?://github\.com/[^/]+/[^/]+/blob/.+$") & ~F.contains(url, F.lit("?raw=true"))
    return F.when(blob, F.concat(url, F.lit("?raw=true"))).otherwise(url)


def _starts(data: Column, prefix: str, at: int = 1) -> Column:
    return F.hex(F.substring(data, at, len(prefix) // 2)) == prefix.upper()


def _text(s: str) -> str:
    return s.encode("latin-1").hex()


def sniff_video(data: Column, compat: bool = False) -> Column:
    """The video type of first bytes. ``compat`` takes a first byte of 0x47 for a transport stream before it looks for GIF."""
    ftyp = _starts(data, _text("ftyp"), 5)
    brand = F.hex(F.substring(data, 9, 4))
    gif = _starts(data, _text("GIF89a")) | _starts(data, _text("GIF87a"))
    stream = _starts(data, "47")
    out = (
        F.when(ftyp & brand.isin([_text(b).upper() for b in ("isom", "mp42", "iso2")]), "mp4")
        .when(ftyp & (brand == _text("m4v ").upper()), "m4v")
        .when(ftyp & (brand == _text("qt  ").upper()), "mov")
        .when(_starts(data, "1A45DFA3"), "mkv")
        .when(_starts(data, _text("RIFF")) & _starts(data, _text("AVI "), 9), "avi")
        .when(_starts(data, "3026B2758E66CF11"), "wmv")
        .when(_starts(data, _text("FLV")), "flv")
    )
    if compat:
        return out.when(stream, "ts").when(gif, "gif")
    # packets of a transport stream are 188 bytes long and all start with 0x47
    return out.when(gif, "gif").when(stream & ((F.octet_length(data) < 189) | _starts(data, "47", 189)) & (F.octet_length(data) >= 188), "ts")


def sniff_image(data: Column) -> Column:
    """The image type of first bytes."""
    return (
        F.when(_starts(data, "89504E470D0A1A0A"), "png").when(_starts(data, "FFD8FF"), "jpg").when(_starts(data, _text("BM")), "bmp")
        .when(_starts(data, _text("RIFF")) & _starts(data, _text("WEBP"), 9), "webp").when(_starts(data, "49492A00") | _starts(data, "4D4D002A"), "tiff")
        .when(_starts(data, "00000100"), "ico").when(_starts(data, _text("qoif")), "qoi").when(_starts(data, _text("DDS ")), "dds")
        .when(_starts(data, _text("#?RADIANCE")), "hdr").when(_starts(data, "762F3101"), "exr").when(_starts(data, _text("farbfeld")), "ff")
    )


def is_pdf(data: Column) -> Column:
    return _starts(data, _text("%PDF"))


def is_zip(data: Column) -> Column:
    return _starts(data, "504B0304")


def is_html(data: Column) -> Column:
    """Whether the first 512 bytes are UTF-8 and open an HTML document."""
    head = F.substring(data, 1, 512)
    low = F.lower(F.try_validate_utf8(head.cast("string")))
    return F.coalesce(F.contains(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html")), F.lit(False))


def sniff(data: Column, zip_type: Column | None = None, compat: bool = False) -> Column:
    """The extension that bytes deserve: video, image, pdf, zip-based, html, then text as md; null where it is none.

    ``zip_type`` is the type of a zip by its members (``quire.sources.archives``).
    """
    zipped = F.coalesce(zip_type, F.lit("zip")) if zip_type is not None else F.lit("zip")
    return F.coalesce(
        sniff_video(data, compat),
        F.when(sniff_image(data).isNotNull(), "png"),
        F.when(is_pdf(data), "pdf"),
        F.when(is_zip(data), zipped),
        F.when(is_html(data), "html"),
        F.when(F.is_valid_utf8(data.cast("string")), "md"),
    )


#: What is made of a source in each output form; "*" is any other.
ROUTES = (
    ("md", "md", "markdown"), ("md", "html", "html"), ("md", "image", "image"), ("md", "inline", "inline_image"),
    ("md", "interactive", "interactive"), ("html", "image", "image"), ("html", "inline", "inline_image"),
    ("html", "interactive", "interactive"), ("image", "image", "image"), ("image", "interactive", "interactive"),
    ("md", "*", "pretty"), ("html", "*", "pretty"), ("image", "*", "inline_image"),
)


def route(source: Column, target: Column) -> Column:
    """What a source becomes in an output form; null if it can't."""
    out = F.when(F.lit(False), F.lit(""))
    for a, b, result in ROUTES:
        out = out.when((source == a) & (F.lit(True) if b == "*" else target == b), result)
    return out


def encoder(env: Column, kitty: bool = False, iterm: bool = False, sixel: bool = False, ascii_only: bool = False) -> Column:
    """The image encoder for an environment map with lower-case values: what is forced, else by capability."""
    for forced, name in ((kitty, "kitty"), (iterm, "iterm"), (sixel, "sixel"), (ascii_only, "ascii")):
        if forced:
            return F.lit(name)
    values = F.map_values(env)
    has = lambda words: F.exists(values, lambda v: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(v, w)), True))
    return F.when(has(["kitty", "ghostty"]), "kitty").when(has(["iterm", "wezterm", "mintty", "rio", "warp"]), "iterm").when(has(["foot", "sixel", "mlterm", "windows terminal"]), "sixel").otherwise("ascii")


def dimension(values: Iterable[tuple[str, str]]) -> Column:
    """A literal map, for lookups that need no join."""
    return F.create_map(*map(F.lit, chain.from_iterable(values)))
