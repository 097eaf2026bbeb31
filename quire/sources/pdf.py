"""PDF pages as positioned text and lines, and as a grid of characters.

Reads files with classic or stream cross references by finding their objects;
filters other than Flate, encryption and embedded font programs aren't read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from quire.operators.grid import PAGE, cell_size, page_rows

_WS = b"\0\t\n\f\r "
_DELIM = b"()<>[]{}/%"


class Name(str):
    pass


class Ref(int):
    pass


class Operator(str):
    pass


class Lexer:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _WS:
                self.at += 1
            elif d[self.at] == 0x25:
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self):
        """The next object; an Operator for a bare word, None at the end."""
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"/":
            m = re.compile(rb"/([^\0\t\n\f\r ()<>\[\]{}/%]*)").match(d, at)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[1]).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if d[at : at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>" or self.at >= len(d):
                    self.at += 2
                    return out
                key = self.value()
                out[str(key)] = self.value()
        if c == b"<":
            end = d.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            self.at = end + 1 if end >= 0 else len(d)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value())
        if c in (b"]", b">", b"{", b"}", b")"):
            self.at += 1
            return Operator(c.decode())
        m = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z0-9])").match(d, at)
        if m:
            self.at = m.end()
            return Ref(m[1])
        m = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+").match(d, at)
        self.at = m.end()
        word = m[0]
        if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", word):
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def literal(self) -> bytes:
        d, out, depth = self.data, bytearray(), 0
        while self.at < len(d):
            c = d[self.at]
            self.at += 1
            if c == 0x5C:
                m = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if m:
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                else:
                    e = d[self.at : self.at + 1]
                    self.at += 1
                    if e == b"\r" and d[self.at : self.at + 1] == b"\n":
                        self.at += 1
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}.get(e, e)
            elif c == 0x28:
                depth += 1
                if depth > 1:
                    out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            else:
                out.append(c)
        return bytes(out)


class Document:
    def __init__(self, data: bytes):
        if not data.lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b", data):
            lexer = Lexer(data, m.end())
            try:
                value = lexer.value()
            except (ValueError, AttributeError, IndexError):
                continue
            raw = None
            if isinstance(value, dict):
                s = re.compile(rb"\s*stream\r?\n").match(data, lexer.at)
                if s:
                    length = value.get("Length")
                    end = s.end() + length if isinstance(length, int) and not isinstance(length, Ref) else -1
                    if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
                        end = data.find(b"endstream", s.end())
                    raw = data[s.end() : end]
            self.objects[int(m[1])] = (value, raw)
        for value, _ in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                number = next(k for k, x in self.objects.items() if x[0] is value)
                body = self.stream(Ref(number))
                lexer = Lexer(body)
                heads = [lexer.value() for _ in range(2 * int(value.get("N", 0)))]
                for n, off in zip(heads[::2], heads[1::2], strict=True):
                    self.objects.setdefault(n, (Lexer(body, int(value["First"]) + off).value(), None))

    def get(self, value):
        while isinstance(value, Ref):
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def stream(self, ref) -> bytes:
        value, raw = self.objects.get(int(ref), ({}, b""))
        if raw is None:
            return b""
        filters = self.get(value.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} isn't read")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        out: list[dict] = []

        def visit(node, inherited, seen):
            node = self.get(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen = seen | {id(node)}
            inherited = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in self.get(node.get("Kids")) or []:
                    visit(kid, inherited, seen)
            else:
                out.append(inherited | node)

        if root:
            visit(root.get("Pages"), {}, frozenset())
        return out


def _unicode_map(text: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    decode = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = decode(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1):
                out[k] = chr(ord(decode(c)[-1]) + k - int(a, 16))
    return out


def decode_string(data: bytes, mapping: dict[int, str] | None = None, wide: bool = False) -> str:
    """By the font's map, else by byte order mark, else as UTF-8 or Latin-1."""
    if mapping:
        codes = [int.from_bytes(data[k : k + 2], "big") for k in range(0, len(data), 2)] if wide else list(data)
        return "".join(mapping.get(c, "" if wide else chr(c)) for c in codes)
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if data[:2] == b"\xff\xfe":
        return data[2:].decode("utf-16-le", "replace")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


@dataclass
class Unit:
    """A positioned text, or a line from (x, y) to (x2, y2)."""

    kind: str
    x: float
    y: float
    x2: float = 0.0
    y2: float = 0.0
    text: str = ""
    size: float = 0.0
    font: str = ""
    color: str = ""
    underlined: bool = False


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    g, h, i, j, k, z = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + z)


_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Interpreter:
    """Runs a page's content and gathers units; an operator that fails is passed over."""

    def __init__(self, doc: Document):
        self.doc = doc
        self.units: list[Unit] = []
        self.fonts: dict[int, tuple[dict[int, str] | None, bool]] = {}

    def run(self, content: bytes, resources: dict, matrix: tuple = _IDENTITY, within: tuple = ()) -> None:
        state = {"m": matrix, "font": "", "size": 0.0, "color": "#000000", "leading": 0.0, "map": (None, False)}
        stack: list[dict] = []
        text = line = _IDENTITY
        pen = (0.0, 0.0)
        pending: list[Unit] = []
        args: list = []
        lexer = Lexer(content)
        while (token := lexer.value()) is not None:
            if not isinstance(token, Operator):
                args.append(token)
                continue
            op, a, args = str(token), args, []
            try:
                if op == "BT":
                    text = line = _IDENTITY
                elif op == "q":
                    stack.append(dict(state))
                elif op == "Q":
                    state = stack.pop() if stack else state
                elif op == "cm":
                    state["m"] = times(tuple(map(float, a[:6])), state["m"])
                elif op == "Tm":
                    text = line = tuple(map(float, a[:6]))
                elif op in ("Td", "TD"):
                    if op == "TD":
                        state["leading"] = -a[1]
                    text = line = times((1, 0, 0, 1, a[0], a[1]), line)
                elif op == "TL":
                    state["leading"] = a[0]
                elif op == "T*":
                    text = line = times((1, 0, 0, 1, 0, -state["leading"]), line)
                elif op == "Tf":
                    state["font"], state["size"] = str(a[0]), float(a[1])
                    state["map"] = self.font(resources, str(a[0]))
                elif op in ("Tj", "TJ", "'", '"'):
                    if op in ("'", '"'):
                        text = line = times((1, 0, 0, 1, 0, -state["leading"]), line)
                    value = a[-1] if op == '"' else a[0]
                    parts = [value] if isinstance(value, bytes) else [x if isinstance(x, bytes) else (b" " if isinstance(x, (int, float)) and x < -200 else b"") for x in value]
                    shown = "".join(decode_string(x, *state["map"]) if x != b" " else " " for x in parts)
                    at = times(text, state["m"])
                    if shown:
                        self.units.append(Unit("text", at[4], at[5], text=shown, size=state["size"] * abs(text[3]), font=state["font"], color=state["color"]))
                    text = times((1, 0, 0, 1, len(shown) * state["size"] * 0.5, 0), text)
                elif op in ("rg", "sc", "scn") and len(a) >= 3 and not isinstance(a[0], Name):
                    state["color"] = "#" + "".join(f"{int(max(0.0, min(1.0, float(v))) * 255 + 0.5):02X}" for v in a[:3])
                elif op in ("RG", "SC"):
                    if self.units and self.units[-1].kind == "text":
                        self.units[-1].underlined = True
                elif op == "m":
                    pen = (float(a[0]), float(a[1]))
                elif op == "l":
                    pending.append(self.line(state["m"], pen, (float(a[0]), float(a[1]))))
                elif op == "re":
                    x, y, w, h = map(float, a[:4])
                    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
                    edges = [self.line(state["m"], p, q) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]
                    pending += edges
                elif op in ("S", "s"):
                    self.units += pending
                    pending = []
                elif op in ("f", "F", "f*", "n"):
                    pending = []
                elif op == "BDC" and len(a) > 1 and isinstance(a[1], dict) and isinstance(a[1].get("ActualText"), bytes):
                    at = times(text, state["m"])
                    self.units.append(Unit("text", at[4], at[5], text=decode_string(a[1]["ActualText"]), size=state["size"], font=state["font"], color=state["color"]))
                elif op == "Do" and "Im" not in str(a[0]):
                    ref = (self.doc.get(resources.get("XObject")) or {}).get(str(a[0]))
                    form = self.doc.get(ref)
                    # a form that draws itself, however many others it does so through, would never end
                    if isinstance(form, dict) and form.get("Subtype") == "Form" and ref not in within:
                        own = self.doc.get(form.get("Resources")) or resources
                        inner = tuple(map(float, self.doc.get(form.get("Matrix")) or _IDENTITY))
                        self.run(self.doc.stream(ref), own, times(inner, state["m"]), (*within, ref))
                elif op == "BI":
                    end = re.compile(rb"\sEI(?=\s)").search(content, lexer.at)
                    lexer.at = end.end() if end else len(content)
            except (IndexError, TypeError, ValueError, KeyError, AttributeError):
                continue

    @staticmethod
    def line(m: tuple, p: tuple, q: tuple) -> Unit:
        at = lambda x, y: (m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])
        (x, y), (x2, y2) = at(*p), at(*q)
        return Unit("line", x, y, x2, y2)

    def font(self, resources: dict, name: str) -> tuple[dict[int, str] | None, bool]:
        ref = (self.doc.get(resources.get("Font")) or {}).get(name)
        font = self.doc.get(ref)
        if not isinstance(font, dict):
            return None, False
        if id(font) not in self.fonts:
            mapping = _unicode_map(self.doc.stream(font["ToUnicode"])) if isinstance(font.get("ToUnicode"), Ref) else None
            self.fonts[id(font)] = mapping, font.get("Subtype") == "Type0"
        return self.fonts[id(font)]


def page_units(data: bytes) -> list[list[Unit]]:
    """The units of each page, in drawing order."""
    doc = Document(data)
    out = []
    for page in doc.pages():
        contents = page.get("Contents")
        refs = doc.get(contents) if isinstance(doc.get(contents), list) else [contents]
        body = b"\n".join(doc.stream(r) for r in refs if isinstance(r, Ref))
        run = Interpreter(doc)
        run.run(body, doc.get(page.get("Resources")) or {})
        out.append(run.units)
    return out


#: Characters of a page's grid at most; a larger page is an error, not cut.
PAGE_CHARS = 20_000_000


def nearest_cell(x: float) -> int:
    """The nearest whole number; halves go away from 0."""
    return int(x + 0.5) if x >= 0 else -int(0.5 - x)


def grid(units: list[Unit], columns: int | None = None, rows: int | None = None, compat: bool = False) -> list[str]:
    """A page as lines of characters; upright and level lines are drawn, text goes over them, blank edges are cut.

    A cell is 4 by 10 points, or less where a screen of ``columns`` and
    ``rows`` is given; points go to the nearest. What lies beyond the page of
    612 by 792 points is kept, unless ``compat``: then it is cut and lines are
    padded to the page's width, as in the original. A page of more than
    ``PAGE_CHARS`` characters is an error.
    """
    cw, ch = cell_size(columns, rows)
    wide, high = int(-(-PAGE[0] // cw)) + 1, page_rows(ch)
    cells: dict[int, dict[int, str]] = {}
    drawn = 0

    def put(c: int, r: int, char: str) -> None:
        if c >= 0 and (not compat or (c < wide and 0 <= r < high)):
            cells.setdefault(r, {})[c] = char

    for u in units:
        if u.kind == "line":
            c, c2 = nearest_cell(u.x / cw), nearest_cell(u.x2 / cw)
            r, r2 = high - 1 - nearest_cell(u.y / ch), high - 1 - nearest_cell(u.y2 / ch)
            drawn += max(abs(c - c2), abs(r - r2)) if c == c2 or r == r2 else 0
            if drawn > PAGE_CHARS:
                raise ValueError("page too large")
            if r == r2:
                for k in range(min(c, c2), max(c, c2) + 1):
                    put(k, r, "─")
            elif c == c2:
                for k in range(min(r, r2), max(r, r2) + 1):
                    put(c, k, "│")
    for u in units:
        if u.kind == "text":
            c, r = max(0, nearest_cell(u.x / cw)), high - 1 - nearest_cell(max(u.y, 0) / ch)
            for k, char in enumerate(u.text):
                put(c + k, max(r, 0) if compat else r, char)
    cells = {r: x for r, x in cells.items() if any(char != " " for char in x.values())}
    if not cells:
        return []
    if sum(max(x) + 1 for x in cells.values()) + max(cells) - min(cells) > PAGE_CHARS:
        raise ValueError("page too large")
    rows_of = (cells.get(r, {}) for r in range(min(cells), max(cells) + 1))
    lines = ("".join(x.get(c, " ") for c in range(max(x, default=-1) + 1)) for x in rows_of)
    return [x.ljust(wide) if compat else x.rstrip() for x in lines]


def pdf(data: bytes, columns: int | None = None, rows: int | None = None) -> str:
    """All pages as fenced grids under page titles; ``columns`` and ``rows`` are those of a screen."""
    parts = [f"<!-- S-TITLE: Page number {k} -->\n```pdf\n" + "\n".join(grid(units, columns, rows)) + "\n```" for k, units in enumerate(page_units(data), 1)]
    return "\n\n".join(parts)
