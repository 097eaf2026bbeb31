"""Office documents as Markdown: one walk over the events of an XML member."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree


def events(data: bytes) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """("start", tag, attributes), ("text", tag, text) and ("end", tag, {}) in document order; tags and attributes without namespaces."""
    local = lambda name: name.rpartition("}")[2]

    def walk(e):
        tag = local(e.tag)
        yield "start", tag, {local(k): v for k, v in e.attrib.items()}
        if e.text:
            yield "text", tag, e.text
        for child in e:
            yield from walk(child)
            if child.tail:
                yield "text", tag, child.tail
        yield "end", tag, {}

    yield from walk(ElementTree.fromstring(data))


def table(rows: list[list[str]]) -> str:
    """Rows as a pipe table, the first as its header."""
    head, *body = rows
    line = lambda r: f"| {' | '.join(r)} |\n"
    return line(head) + f"|{'---|' * len(head)}\n" + "".join(map(line, body))


def tidy(text: str) -> str:
    """Blank lines emptied, every line ended, at most two newlines together."""
    out = re.sub(r"(?m)^[ \t\r]+$", "", text[:-1] if text.endswith("\n") else text)
    return re.sub(r"\n{3,}", "\n\n", out + "\n") if text else text


def member(data: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(name)


def _on(attrs: dict) -> bool:
    return attrs.get("val", "true") in ("true", "1", "on")


def docx(data: bytes, compat: bool = False) -> str:
    """A text document: headings, lists, character styles and tables.

    Character properties hold for the next run of text. ``compat`` makes a cell
    of each run in a table, where otherwise a table cell is one.
    """
    out: list[str] = []
    rows: list[list[str]] = []
    bold = italic = strike = under = heading = title = False
    indent = -1
    in_table = listed = False
    for kind, tag, value in events(member(data, "word/document.xml")):
        if kind == "start":
            if tag == "tbl":
                in_table, rows = True, []
            elif tag == "tr":
                rows.append([])
            elif tag == "tc" and not compat and rows:
                rows[-1].append("")
            elif tag == "b":
                bold = _on(value)
            elif tag == "i":
                italic = _on(value)
            elif tag == "strike":
                strike = _on(value)
            elif tag == "u":
                under = True
            elif tag == "pStyle":
                style = value.get("val", "").lower()
                title, heading = "title" in style, "heading" in style
            elif tag == "ilvl" and not (title or heading):
                indent = int(value.get("val", "0")) + 1
        elif kind == "text" and tag == "t":
            text = value
            for on, left, right in ((bold, "**", "**"), (under, "<u>", "</u>"), (strike, "~~", "~~"), (italic, "*", "*")):
                if on:
                    text = f"{left}{text.strip()}{right} "
            bold = italic = strike = under = False
            if in_table and rows:
                if compat or not rows[-1]:
                    rows[-1].append(text)
                else:
                    rows[-1][-1] += text
            elif title:
                out.append(f"## {text}")
                title = False
            elif heading:
                out.append(f"### {text}")
                heading = False
            elif indent >= 0:
                out.append(f"{'  ' * indent}* {text}")
                indent, listed = -1, True
            else:
                out.append(text)
        elif kind == "end":
            if tag == "p" and not in_table:
                out.append("  \n" if listed else "\n\n")
                listed = title = heading = False
                indent = -1
            elif tag == "tbl":
                if rows and any(rows):
                    out.append(table([r for r in rows if r]))
                in_table = False
    return tidy("".join(out))


def opendocument(data: bytes) -> str:
    """A text document or presentation of the OpenDocument formats. An empty table gives nothing."""
    out: list[str] = []
    rows: list[list[str]] = []
    in_table = in_list = False
    for kind, tag, value in events(member(data, "content.xml")):
        if kind == "start":
            if tag == "h":
                out.append("### ")
            elif tag == "list-item":
                in_list = True
            elif tag == "table":
                in_table, rows = True, []
            elif tag == "table-row":
                rows.append([])
            elif tag == "table-cell" and rows:
                rows[-1].append("")
            elif tag == "s":
                text = " " * int(value.get("c", "1"))
                if in_table and rows and rows[-1]:
                    rows[-1][-1] += text
                else:
                    out.append(text)
        elif kind == "text" and tag in ("p", "h", "span", "a"):
            if in_table and rows and rows[-1]:
                rows[-1][-1] += value
            elif in_list:
                out.append(f" * {value}")
                in_list = False
            else:
                out.append(value)
        elif kind == "end":
            if tag in ("p", "h") and not in_table:
                out.append("\n\n")
            elif tag == "list-item":
                while out and out[-1] == "\n\n":
                    out.pop()
                out.append("  \n")
            elif tag == "table":
                if rows and any(rows):
                    out.append(table([r for r in rows if r]))
                in_table = False
    return tidy("".join(out))


def slides(data: bytes, numeric: bool = False) -> list[tuple[int, str, str]]:
    """(number, member, Markdown) of each slide, in the archive's order, or with ``numeric`` in that of their names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.startswith("ppt/slides/") and n.endswith(".xml")]
        if numeric:
            names.sort(key=lambda n: int(re.sub(r"\D", "", n.rpartition("/")[2]) or 0))
        return [(k, n, slide(z.read(n))) for k, n in enumerate(names, 1)]


def slide(data: bytes) -> str:
    out: list[str] = []
    rows: list[list[str]] = []
    title = in_body = in_table = False
    for kind, tag, value in events(data):
        if kind == "start":
            if tag == "ph" and value.get("type") in ("title", "ctrTitle"):
                title = True
            elif tag == "txBody":
                in_body = True
            elif tag == "tbl":
                in_table, rows = True, []
            elif tag == "tr" and in_table:
                rows.append([])
            elif tag == "tc" and rows:
                rows[-1].append("")
            elif tag == "br" and in_body and not in_table:
                out.append("\n")
        elif kind == "text" and tag == "t":
            if in_table and rows and rows[-1]:
                rows[-1][-1] += value
            elif in_body:
                out.append(("# " if title else "") + value.strip() + " ")
                title = False
        elif kind == "end":
            if tag == "p" and in_body and not in_table:
                out.append("\n")
            elif tag == "txBody":
                in_body = title = False
            elif tag == "tbl":
                if rows and any(rows):
                    out.append("\n" + table([[c.strip() for c in r] for r in rows if r]))
                in_table = False
    return "".join(out).strip()


def pptx(data: bytes, numeric: bool = False) -> str:
    return "\n\n".join(f"<!-- S-TITLE: Slide number {k} -->\n{text}" for k, _, text in slides(data, numeric)).strip()


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in the workbook's order; cells as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            item = None
            for kind, tag, value in events(z.read("xl/sharedStrings.xml")):
                if tag == "si":
                    item = [] if kind == "start" else item
                    if kind == "end":
                        shared.append("".join(item))
                elif kind == "text" and tag == "t":
                    item.append(value)
        rels = {a["Id"]: a["Target"] for k, t, a in events(z.read("xl/_rels/workbook.xml.rels")) if k == "start" and t == "Relationship"}
        out = []
        for kind, tag, attrs in events(z.read("xl/workbook.xml")):
            if kind == "start" and tag == "sheet":
                target = rels.get(attrs.get("id", ""), "")
                path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                if path in names:
                    out.append((attrs.get("name", ""), _sheet_rows(z.read(path), shared)))
        return out


def _sheet_rows(data: bytes, shared: list[str]) -> list[list[str]]:
    rows: list[list[str]] = []
    at, kind_of, text = 0, "", ""
    for kind, tag, value in events(data):
        if kind == "start" and tag == "row":
            rows.append([])
        elif kind == "start" and tag == "c":
            at, kind_of, text = _column(value.get("r", "")) if value.get("r") else len(rows[-1]), value.get("t", "n"), ""
        elif kind == "text" and tag in ("v", "t"):
            text += value
        elif kind == "end" and tag == "c" and rows:
            rows[-1] += [""] * (at + 1 - len(rows[-1]))
            if kind_of == "s":
                text = shared[int(text)] if text else ""
            elif kind_of == "b":
                text = {"1": "true", "0": "false"}.get(text, text)
            elif kind_of == "n" and re.fullmatch(r"-?\d+\.0+", text):
                text = text.partition(".")[0]
            rows[-1][at] = text
    return square(rows)


def square(rows: list[list[str]]) -> list[list[str]]:
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def ods_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet of an OpenDocument workbook; repeated empty cells and rows at the ends are cut."""
    out: list[tuple[str, list[list[str]]]] = []
    again = row_again = 1
    for kind, tag, value in events(member(data, "content.xml")):
        if kind == "start" and tag == "table":
            out.append((value.get("name", ""), []))
        elif kind == "start" and tag == "table-row" and out:
            out[-1][1].append([])
            row_again = int(value.get("number-rows-repeated", "1"))
        elif kind == "start" and tag in ("table-cell", "covered-table-cell") and out:
            again = int(value.get("number-columns-repeated", "1"))
            out[-1][1][-1].append("")
        elif kind == "text" and tag in ("p", "span", "a") and out and out[-1][1] and out[-1][1][-1]:
            out[-1][1][-1][-1] += value
        elif kind == "end" and tag in ("table-cell", "covered-table-cell") and out:
            row = out[-1][1][-1]
            if row[-1]:
                row += [row[-1]] * (again - 1)
            else:
                row += [""] * min(again - 1, 64)
        elif kind == "end" and tag == "table-row" and out:
            row = out[-1][1][-1]
            while row and not row[-1]:
                row.pop()
            if row:
                out[-1][1].extend([list(row) for _ in range(row_again - 1)])
            else:
                out[-1][1].pop()
    return [(name, square(rows)) for name, rows in out]


def workbook(data: bytes, kind: str = "xlsx") -> str:
    """All sheets with rows, each under its name."""
    sheets = ods_sheets(data) if kind == "ods" else xlsx_sheets(data)
    parts = [f"# {name}\n\n{table(rows)}\n" for name, rows in sheets if rows]
    if not parts:
        raise ValueError("No readable sheets found.")
    return "".join(parts)
