"""Any file as Markdown, with errors as values."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import math
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import extension, fence, with_title
from quire.sources import office, pdf


def delimiter(line: str) -> str:
    """The delimiter of a header line: of equal counts the last candidate."""
    return max((line.count(d), k, d) for k, d in enumerate(",;\t|"))[2]


def csv_table(text: str) -> str:
    """A table of a CSV text; rows of another length than the header are an error."""
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter(text.split("\n", 1)[0])))
    rows = [r for r in rows if r]
    if not rows:
        raise ValueError("the file is empty")
    for k, r in enumerate(rows):
        if len(r) != len(rows[0]):
            raise ValueError(f"row {k} has {len(r)} fields, but the header has {len(rows[0])}")
    return office.table(rows)


def archive_members(data: bytes) -> list[tuple[int, str, bytes]]:
    """(place, name, bytes) of each file in an archive."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(k, i.filename, z.read(i)) for k, i in enumerate(x for x in z.infolist() if not x.is_dir())]


def zip_type(data: bytes, compat: bool = False) -> str:
    """What a zip is by its first ten members, and unless ``compat`` by its mimetype member; "zip" for others."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if not compat and "mimetype" in names[:10]:
            mime = z.read("mimetype").decode("ascii", "replace")
            for part, ext in (("opendocument.text", "odt"), ("opendocument.spreadsheet", "ods"), ("opendocument.presentation", "odp")):
                if part in mime:
                    return ext
        for name in names[:10]:
            for start, ext in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")):
                if name.startswith(start):
                    return ext
            for end in ("odt", "ods", "odp"):
                if name.endswith(f".{end}"):
                    return end
    return "zip"


def convert(data: bytes, ext: str, within: tuple[bytes, ...] = (), screen: tuple[int | None, int | None] = (None, None)) -> str:
    """A file's Markdown by its extension; unknown ones are fenced as they are, if they are UTF-8."""
    match ext:
        case "csv":
            return csv_table(data.decode())
        case "docx":
            return office.docx(data)
        case "odt" | "odp":
            return office.opendocument(data)
        case "pptx":
            return office.pptx(data)
        case "xlsx" | "xlsm" | "ods":
            return office.workbook(data, ext)
        case "pdf":
            return pdf.pdf(data, *screen)
        case "zip":
            return zip_markdown(data, within, screen)
        case "md" | "html":
            return data.decode() + "\n\n"
    return f"```{ext}\n{data.decode()}\n```"


def zip_markdown(data: bytes, within: tuple[bytes, ...] = (), screen: tuple[int | None, int | None] = (None, None)) -> str:
    """Every file of an archive under its name; one that can't be read says so in its place.

    Archives in archives are opened however deep they lie. One that holds
    itself, which would never end, can't be read there.
    """
    out = []
    within = (*within, hashlib.sha256(data).digest())
    for _, name, content in archive_members(data):
        try:
            if ext_of(name) == "zip" and hashlib.sha256(content).digest() in within:
                raise ValueError("the archive holds itself")
            body = convert(content, ext_of(name), within, screen)
        except Exception as e:
            body = f"**[Failed Reading: {e}]**"
        out.append(f"# `{name}`\n\n{body}\n\n")
    return "".join(out)


def ext_of(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name[1:] else ""


RESULT = T.StructType().add("md", T.StringType()).add("error", T.StringType())


def _convert(data: Column, ext: Column, screen: tuple[int | None, int | None]) -> Column:
    @F.pandas_udf(RESULT)
    def run(data: pd.Series, ext: pd.Series) -> pd.DataFrame:
        out = []
        for d, e in zip(data, ext, strict=True):
            try:
                out.append((convert(bytes(d), e or "", screen=screen), None) if d is not None else (None, None))
            except Exception as error:
                out.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(out, columns=["md", "error"])

    return run(data, ext)


#: Rough shares of the letters beyond ASCII in a language's writing, for French, German, Spanish, Portuguese, Italian and Nordic, and for Cyrillic.
WESTERN = (
    {"é": 0.45, "èà": 0.15, "êç": 0.06, "ôîâ": 0.03, "ùû": 0.02, "ïëœ": 0.005}, {"ü": 0.32, "ä": 0.25, "ß": 0.2, "ö": 0.15, "é": 0.01},
    {"ó": 0.3, "íá": 0.2, "é": 0.13, "ñú": 0.07, "ü": 0.005}, {"ã": 0.2, "áéç": 0.15, "íêó": 0.07, "õàúâ": 0.03, "ô": 0.01},
    {"è": 0.35, "à": 0.3, "ò": 0.12, "éùì": 0.08}, {"äå": 0.3, "öøæ": 0.2, "éü": 0.01},
)
CYRILLIC = {"оеаинтсрвл": 0.065, "кмдпуяыьгзбчй": 0.022, "хжшюцщэфъёіїєґў": 0.004}
#: The share of what a language doesn't have.
OTHER = 0.0005


def _logs(shares: dict[str, float]) -> dict[str, float]:
    return {c: math.log(share) for letters, share in shares.items() for c in letters}


_WESTERN, _CYRILLIC, _OTHER = [_logs(shares) for shares in WESTERN], _logs(CYRILLIC), math.log(OTHER)


def _as_cyrillic(word: str, name: str) -> float:
    """The log of how much likelier a word of Cyrillic letters is than what its bytes are in windows-1252, as a word of any one language."""

    def written(word: str, logs: dict[str, float]) -> float:
        """Capitals are rare but at the start and after each other."""
        case = sum(math.log((0.5 if before.isupper() else 0.001) if before else 0.1) for before, c in zip(["", *word], word, strict=False) if c.isupper())
        return case + sum(logs.get(c, _OTHER) for c in word.lower())

    return written(word, _CYRILLIC) - max(written(word.encode(name).decode("windows-1252", "replace"), logs) for logs in _WESTERN)


def _as_chinese(char: str) -> float:
    """The log of how much likelier a character of GB 18030 is than what its bytes are in windows-1252: signs and the 3755 common ones of GB 2312 are likely."""
    code = char.encode("gb18030")
    own = 1e-2 if code[0] in (0xA1, 0xA3) else 1e-3 if 0xB0 <= code[0] <= 0xD7 and code[1] >= 0xA1 else 1e-5

    def western(c: str) -> float:
        # an ASCII letter that a character has swallowed is one of 26
        share = math.log(0.04) if c.isascii() and c.isalpha() else max(logs.get(c.lower(), _OTHER) for logs in _WESTERN)
        return share + (math.log(0.1) if c.isupper() else 0.0)

    return math.log(own) - sum(map(western, code.decode("windows-1252", "replace")))


def guess_encoding(data: bytes, limit: int = 4096) -> str:
    """The encoding of a text by its first bytes: a byte order mark, UTF-8 where it is valid, else what looks most like writing.

    Bytes of the East Asian and Cyrillic encodings count by the letters that
    they would make; Western text is windows-1252. What tells it from them are ASCII letters beside the others: half
    of all characters that end in one aren't Chinese, and words of Latin and Cyrillic letters count against Cyrillic.
    Words of accented letters alone are told by how common their letters are in either writing.
    """
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    head = data[:limit]
    if b"\x1b$" in head or b"\x1b(" in head:
        return "iso2022_jp"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head, len(data) <= limit)
        return "utf-8"
    except UnicodeDecodeError:
        pass

    def share(name: str, letters: str) -> float:
        """How many of the characters beyond ASCII are common letters next to others; Cyrillic ones count in words of nothing else."""
        try:
            text = codecs.getincrementaldecoder(name)().decode(head, len(data) <= limit)
        except UnicodeDecodeError:
            return 0.0
        high = [c for c in text if ord(c) > 127]
        if "\u0430" in letters:
            words = re.findall(r"\w+", text)
            own = [w for w in words if len(w) > 2 and re.fullmatch(f"[\u0410-\u042f]?{letters}+", w)]
            mixed = sum(len(re.findall(r"[^\x00-\x7f]", w)) for w in words if re.search("[A-Za-z]", w))
            found = (sum(map(len, own)) - mixed) / max(1, len(high))
            return found if found > 0 and sum(_as_cyrillic(w, name) for w in set(own)) > 0 else 0.0
        if name == "gb18030" and (2 * sum(c.encode(name)[-1] < 128 for c in high) > len(high) or sum(map(_as_chinese, set(high))) <= 0):
            return 0.0
        return sum(map(len, re.findall(f"{letters}{{2,}}", text))) / max(1, len(high))

    tried = (
        ("euc_jp", "[\u3041-\u30ff]"), ("shift_jis", "[\u3041-\u30ff]"), ("euc_kr", "[\uac00-\ud7a3]"), ("gb18030", "[\u4e00-\u9fa5\u3000-\u3002\uff00-\uff1f]"),
        ("windows-1251", "[\u0430-\u044f]"), ("koi8_r", "[\u0430-\u044f]"),
    )
    least = {"euc_jp": 0.3, "shift_jis": 0.3, "euc_kr": 0.8, "gb18030": 0.8}
    # the first that fits: kana is rarer by chance than other signs are
    return next((name for name, letters in tried if share(name, letters) >= least.get(name, 0.6)), "windows-1252")


@F.pandas_udf(T.StructType().add("encoding", T.StringType()).add("text", T.StringType()))
def decoded(data: pd.Series) -> pd.DataFrame:
    """struct<encoding, text> of a text's bytes; bytes that the encoding lacks become U+FFFD.

    The first bytes decide, unless they are UTF-8 and what follows isn't; then all do.
    """
    out = []
    for d in data:
        if d is None:
            out.append((None, None))
            continue
        content = bytes(d)
        name = guess_encoding(content)
        try:
            out.append((name, content.decode(name).removeprefix("\ufeff")))
        except UnicodeDecodeError:
            name = guess_encoding(content, len(content))
            out.append((name, content.decode(name, "replace").removeprefix("\ufeff")))
    return pd.DataFrame(out, columns=["encoding", "text"])


PARSED = ["csv", "docx", "odt", "odp", "pptx", "xlsx", "xlsm", "ods", "pdf", "zip"]


def to_markdown(files: DataFrame, content: str = "content", path: str = "path", name: str | None = None, screen: tuple[int | None, int | None] = (None, None), detect: bool = False) -> DataFrame:
    """``files`` with a column ``result``, struct<md, error>.

    Texts, Markdown and HTML go through natively; only formats that need a
    parser go to Python, and with ``detect`` texts that aren't UTF-8. ``screen``
    (columns, rows) sizes the cells of PDF pages. A column ``name`` makes title
    comments over the documents.
    """
    ext = F.coalesce(extension(F.col(path)), F.lit(""))
    text = F.try_validate_utf8(F.col(content).cast("string"))
    if detect:
        text = F.when(F.col(content).isNull() | text.isNotNull() | ext.isin(PARSED), text).otherwise(decoded(F.col(content))["text"])
    plain = F.when(ext.isin("md", "html"), F.concat(text, F.lit("\n\n"))).otherwise(fence(text, ext))
    native = F.struct(plain.alias("md"), F.when(F.col(content).isNotNull() & text.isNull(), F.lit("the file isn't UTF-8")).alias("error"))
    return files.withColumn("result", F.when(ext.isin(PARSED), _convert(F.col(content), ext, screen)).otherwise(native)).transform(lambda d: _titled(d, name))


def _titled(files: DataFrame, name: str | None) -> DataFrame:
    if name is None:
        return files
    titled = F.when(F.col("result.md").isNotNull(), with_title(F.col("result.md"), F.col(name)))
    return files.withColumn("result", F.struct(titled.alias("md"), F.col("result.error").alias("error")))


def zip_types(data: Column, compat: bool = False) -> Column:
    @F.pandas_udf(T.StringType())
    def run(d: pd.Series) -> pd.Series:
        def one(x):
            try:
                return zip_type(bytes(x), compat)
            except (zipfile.BadZipFile, TypeError, ValueError):
                return None

        return d.map(one)

    return run(data)


def members(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """(path, place, name, bytes, error) of the files in each archive; one row with an error for what isn't one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(p, k, n, b, None) for k, n, b in archive_members(d or b"")]
                except (zipfile.BadZipFile, RuntimeError, ValueError) as e:
                    rows = [(p, None, None, None, str(e))]
                if rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()), strict=True)], ["path", "place", "name", "bytes", "error"])

    return files.select(path, content).mapInArrow(run, "path string, place int, name string, bytes binary, error string")


def read_csv(spark, path: str, sep: str | None = None) -> DataFrame:
    """A delimited file with all columns as text: the delimiter by its header line, ragged rows an error, empty cells as ''."""
    if sep is None:
        sep = delimiter(spark.read.text(path).first()[0])
    d = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', mode="FAILFAST", inferSchema=False)
    return d.na.fill("")


def read_files(spark, path: str, pattern: str | None = None, longest: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; longer ones than ``longest`` aren't opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    d = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return d.filter(F.col("length") <= longest) if longest is not None else d
