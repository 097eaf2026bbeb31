"""Markdown: nodes of documents, HTML and terminal text.

A subset of GitHub's Markdown is parsed here: headings, paragraphs, block
quotes and alerts, lists and tasks, code, tables, rules, HTML blocks,
description lists, footnotes, and inline emphasis, code, links, wiki links,
images, spoilers and breaks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.wrapping import last_color, visible, wrap_with_color
from quire.operators.highlight import header, highlight
from quire.plans.dims import ALERTS, THEMES


@dataclass
class Node:
    kind: str
    line: int = 0
    text: str = ""
    level: int = 0
    info: str = ""
    children: list[Node] = field(default_factory=list)


_FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})\s*(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(\s+|$)(.*)$")
_TASK = re.compile(r"^\[(.)\]\s+(.*)$", re.S)
_QUOTE = re.compile(r"^ {0,3}> ?")
_ALERT = re.compile(r"^\[!(note|tip|important|warning|caution)\]\s*(.*)$", re.I)
_FOOTNOTE = re.compile(r"^\[\^([^\]\s]+)\]:\s*(.*)$")
_HTML = re.compile(r"^ {0,3}<(?:!--|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_SPLIT = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    line = re.sub(r"^\||(?<!\\)\|$", "", line.strip())
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def parse(text: str) -> Node:
    """The tree of a document. Lines count from 1."""
    root = Node("document", 1)
    _blocks(text.split("\n"), 1, root)
    return root


def _starts_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _ITEM.match(line) or _HTML.match(line))


def _blocks(lines: list[str], first: int, parent: Node) -> None:
    k = 0
    while k < len(lines):
        line, at = lines[k], first + k
        if not line.strip():
            k += 1
        elif m := _FENCE.match(line):
            end, k = k + 1, k + 1
            closing = re.compile(rf"^ {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}\s*$")
            while k < len(lines) and not closing.match(lines[k]):
                k += 1
            body = lines[end:k]
            k += 1
            parent.children.append(Node("code_block", at, "\n".join(body), info=m[3].strip()))
        elif m := _HEADING.match(line):
            node = Node("heading", at, level=len(m[1]))
            node.children = inline(m[2] or "", at)
            parent.children.append(node)
            k += 1
        elif _RULE.match(line):
            parent.children.append(Node("thematic_break", at))
            k += 1
        elif _QUOTE.match(line):
            inner = []
            while k < len(lines) and lines[k].strip() and (_QUOTE.match(lines[k]) or not _starts_block(lines[k])):
                inner.append(_QUOTE.sub("", lines[k], count=1))
                k += 1
            if m := _ALERT.match(inner[0].strip()):
                node = Node("alert", at, info=m[1].lower(), text=m[2])
                _blocks(inner[1:], at + 1, node)
            else:
                node = Node("block_quote", at)
                _blocks(inner, at, node)
            parent.children.append(node)
        elif m := _ITEM.match(line):
            k = _list(lines, k, first, m, parent)
        elif m := _FOOTNOTE.match(line):
            node = Node("footnote_definition", at, info=m[1])
            body = [m[2]]
            k += 1
            while k < len(lines) and lines[k].startswith(("    ", "\t")):
                body.append(lines[k].strip())
                k += 1
            _blocks(body, at, node)
            parent.children.append(node)
        elif line.startswith(("    ", "\t")):
            body = []
            while k < len(lines) and (lines[k].startswith(("    ", "\t")) or not lines[k].strip()):
                body.append(re.sub(r"^(?: {4}|\t)", "", lines[k]))
                k += 1
            parent.children.append(Node("code_block", at, "\n".join(body).rstrip("\n")))
        elif _HTML.match(line):
            body = []
            while k < len(lines) and lines[k].strip():
                body.append(lines[k])
                k += 1
                if body[0].lstrip().startswith("<!--") and "-->" in body[-1]:
                    break
            parent.children.append(Node("html_block", at, "\n".join(body)))
        elif "|" in line and k + 1 < len(lines) and "-" in lines[k + 1] and _SPLIT.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
            node = Node("table", at, info=",".join({(True, True): "center", (False, True): "right", (True, False): "left"}.get((c.startswith(":"), c.endswith(":")), "none") for c in _cells(lines[k + 1])))
            width = len(_cells(line))
            rows = [(line, at)]
            k += 2
            while k < len(lines) and lines[k].strip() and "|" in lines[k]:
                rows.append((lines[k], first + k))
                k += 1
            for r, n in rows:
                row = Node("table_row", n)
                row.children = [Node("table_cell", n, children=inline(c, n)) for c in (_cells(r) + [""] * width)[:width]]
                node.children.append(row)
            parent.children.append(node)
        else:
            body = [line]
            k += 1
            level = 0
            while k < len(lines) and lines[k].strip():
                if m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[k]):
                    level = 1 if m[1][0] == "=" else 2
                    k += 1
                    break
                if lines[k].startswith(": ") or (_starts_block(lines[k]) and not re.match(r"^ {0,3}(?:[2-9]|\d\d+)[.)]", lines[k])):
                    break
                body.append(lines[k])
                k += 1
            if k < len(lines) and lines[k].startswith(": ") and not level:
                node = Node("description_list", at)
                node.children.append(Node("description_term", at, children=inline("\n".join(body), at)))
                while k < len(lines) and lines[k].startswith(": "):
                    node.children.append(Node("description_details", first + k, children=inline(lines[k][2:], first + k)))
                    k += 1
            else:
                node = Node("heading" if level else "paragraph", at, level=level)
                node.children = inline("\n".join(x.lstrip() for x in body).rstrip(), at)
            parent.children.append(node)


def _list(lines: list[str], k: int, first: int, m: re.Match, parent: Node) -> int:
    ordered = m[2][0].isdigit()
    node = Node("list", first + k, info="ordered" if ordered else "bullet", level=int(m[2][:-1]) if ordered else 0)
    while k < len(lines) and (m := _ITEM.match(lines[k])) and m[2][0].isdigit() == ordered and not _RULE.match(lines[k]):
        width = len(m[1]) + len(m[2]) + min(len(m[3]) or 1, 4)
        at, body = first + k, [m[4]]
        k += 1
        while k < len(lines):
            if not lines[k].strip():
                if k + 1 < len(lines) and lines[k + 1].startswith(" " * width):
                    body.append("")
                    k += 1
                    continue
                break
            if lines[k].startswith(" " * width):
                body.append(lines[k][width:])
            elif not _starts_block(lines[k]) and body[-1].strip():
                body.append(lines[k].lstrip())
            else:
                break
            k += 1
        item = Node("item", at)
        if t := _TASK.match(body[0]):
            item = Node("task_item", at, info=t[1])
            body[0] = t[2]
        _blocks(body, at, item)
        node.children.append(item)
        while k + 1 < len(lines) and not lines[k].strip() and (n := _ITEM.match(lines[k + 1])) and n[2][0].isdigit() == ordered:
            k += 1
    parent.children.append(node)
    return k


_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?P<ticks>`+)(?!`)(?P<codetext>.+?)(?<!`)(?P=ticks)(?!`))"
    r"|!\[(?P<alt>(?:[^\[\]\\]|\\.)*)\]\((?P<src>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)"
    r"|\[\[(?P<wiki>[^\[\]|]+)(?:\|(?P<wikitext>[^\[\]]+))?\]\]"
    r"|\[\^(?P<note>[^\]\s]+)\]"
    r"|\[(?P<label>(?:[^\[\]\\]|\\.|!\[[^\]]*\]\([^)]*\))*)\]\((?P<href>[^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+\"[^\"]*\")?\)"
    r"|<(?P<auto>https?://[^\s<>]+|[^\s<>@]+@[^\s<>@]+\.[^\s<>@]+)>"
    r"|(?P<tag></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<bare>\bhttps?://[^\s<>\"')\]]+)"
    r"|(?P<strong>\*\*(?=\S)(?P<st>.+?)(?<=\S)\*\*(?!\*)|__(?=\S)(?P<st2>.+?)(?<=\S)__(?!\w))"
    r"|(?P<strike>~~(?=\S)(?P<sk>.+?)(?<=\S)~~)|(?P<spoiler>\|\|(?=\S)(?P<sp>.+?)(?<=\S)\|\|)"
    r"|(?P<emph>\*(?=[^\s*])(?P<em>.+?)(?<=[^\s*])\*(?!\*)|(?<!\w)_(?=\S)(?P<em2>.+?)(?<=\S)_(?!\w))"
    r"|(?P<sup>\^(?=\S)(?P<su>[^\s^]+)\^)|(?P<math>\$`(?P<ma>.+?)`\$)|(?P<break>(?: {2,}|\\)\n)|(?P<soft>\n)",
    re.S,
)


#: What else than "http" and spaces before a line's end the alternatives of ``_INLINE`` start with.
_MARK = re.compile(r"[\\`!\[<*_~|^$\n]")


def _matches(text: str) -> Iterator[re.Match]:
    """The matches of ``_INLINE`` from left to right, which is tried only where one can start."""
    at, end = 0, len(text)
    mark = link = gap = -1
    while True:
        if mark < at:
            m = _MARK.search(text, at)
            mark = m.start() if m else end
        if link < at:
            link = text.find("http", at)
            link = end if link < 0 else link
        if gap < at:
            gap = text.find("  \n", at)
            gap = end if gap < 0 else gap
            while at < gap < end and text[gap - 1] == " ":
                gap -= 1
        k = min(mark, link, gap)
        if k == end:
            return
        if m := _INLINE.match(text, k):
            yield m
        at = m.end() if m else k + 1


def inline(text: str, line: int) -> list[Node]:
    out: list[Node] = []

    def plain(s: str, at: int) -> None:
        if s:
            if out and out[-1].kind == "text":
                out[-1].text += html.unescape(s)
            else:
                out.append(Node("text", at, html.unescape(s)))

    at = seen = 0
    n = line
    for m in _matches(text):
        n += text.count("\n", seen, m.start())
        seen = m.start()
        plain(text[at : m.start()], n)
        at = m.end()
        g = m.groupdict()
        nest = lambda kind, s, n=n, **k: out.append(Node(kind, n, children=inline(s, n), **k))
        if g["escape"]:
            plain(g["escape"][1], n)
        elif g["code"]:
            out.append(Node("code", n, g["codetext"].replace("\n", " ").strip() or g["codetext"]))
        elif g["src"] is not None:
            out.append(Node("image", n, g["alt"], info=g["src"]))
        elif g["wiki"]:
            out.append(Node("wiki_link", n, g["wikitext"] or g["wiki"], info=g["wiki"]))
        elif g["note"]:
            out.append(Node("footnote_reference", n, info=g["note"]))
        elif g["href"] is not None:
            nest("link", g["label"], info=g["href"])
        elif g["auto"]:
            out.append(Node("link", n, info=("" if g["auto"].startswith("http") else "mailto:") + g["auto"], children=[Node("text", n, g["auto"])]))
        elif g["tag"]:
            out.append(Node("html_inline", n, g["tag"]))
        elif g["bare"]:
            url = g["bare"].rstrip(".,;:!?")
            at -= len(g["bare"]) - len(url)
            out.append(Node("link", n, info=url, children=[Node("text", n, url)]))
        elif g["strong"]:
            nest("strong", g["st"] or g["st2"])
        elif g["strike"]:
            nest("strikethrough", g["sk"])
        elif g["spoiler"]:
            nest("spoiler", g["sp"])
        elif g["emph"]:
            nest("emph", g["em"] or g["em2"])
        elif g["sup"]:
            nest("superscript", g["su"])
        elif g["math"]:
            out.append(Node("math", n, g["ma"]))
        elif g["break"]:
            out.append(Node("line_break", n))
        elif g["soft"]:
            out.append(Node("soft_break", n))
    plain(text[at:], n + text.count("\n", seen, at))
    return out


def walk(node: Node, depth: int = 0) -> Iterator[tuple[Node, int]]:
    yield node, depth
    for child in node.children:
        yield from walk(child, depth + 1)


def plain_text(node: Node) -> str:
    if node.kind in ("soft_break", "line_break"):
        return " "
    return node.text + "".join(map(plain_text, node.children)) if node.kind not in ("html_inline",) else ""


def node_rows(text: str) -> list[tuple]:
    """(node, parent, depth, kind, line, level, info, text) of every node, in document order."""
    rows: list[tuple] = []

    def visit(n: Node, parent: int | None, depth: int) -> None:
        number = len(rows)
        own = plain_text(n).strip() if n.kind in ("heading", "link", "table_cell", "item", "task_item", "strong", "emph") else n.text
        rows.append((number, parent, depth, n.kind, n.line, n.level, n.info, own))
        for child in n.children:
            visit(child, number, depth + 1)

    visit(parse(text), None, 0)
    return rows


#: Nodes, and characters of texts, after which a batch of nodes goes on.
BATCH_NODES = 10_000
BATCH_CHARS = 4_000_000

NODE_FIELDS = "node int, parent int, depth int, kind string, line int, level int, info string, text string"


def md_nodes(docs: DataFrame, key: str = "doc_id", text: str = "md") -> DataFrame:
    """A row per node of each document: (key, node, parent, depth, kind, line, level, info, text). Null texts have none."""
    names = [f.split()[0] for f in NODE_FIELDS.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int32() for f in NODE_FIELDS.split(", ")]

    def batch_of(keys: list, rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, of), *[pa.array(c, k) for c, k in zip(columns, types, strict=True)]], [key, *names])

    def run(batches):
        for batch in batches:
            keys, rows, size = [], [], 0
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is not None:
                    own = node_rows(t)
                    rows += own
                    keys += [doc] * len(own)
                    size += len(t)
                if len(rows) >= BATCH_NODES or size >= BATCH_CHARS:
                    yield batch_of(keys, rows, batch.schema.field(0).type)
                    keys, rows, size = [], [], 0
            if rows:
                yield batch_of(keys, rows, batch.schema.field(0).type)

    d = docs.select(key, F.col(text).alias("md"))
    return d.mapInArrow(run, f"{key} {d.schema[key].dataType.simpleString()}, {NODE_FIELDS}")


def outline(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.filter("kind = 'heading'").select(key, "line", "level", F.col("text").alias("title"))


def links(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    return nodes.filter(F.col("kind").isin("link", "wiki_link", "image")).select(key, "line", "kind", F.col("info").alias("target"), "text")


def _attr(s: str) -> str:
    return html.escape(s, quote=True)


def _html(n: Node) -> str:
    inner = lambda: "".join(map(_html, n.children))
    match n.kind:
        case "document" | "item" if n.kind == "document":
            return inner()
        case "heading":
            return f"<h{n.level}>{inner()}</h{n.level}>\n"
        case "paragraph":
            return f"<p>{inner()}</p>\n"
        case "block_quote":
            return f"<blockquote>\n{inner()}</blockquote>\n"
        case "alert":
            name = n.text or n.info.capitalize()
            return f'<div class="markdown-alert markdown-alert-{n.info}">\n<p class="markdown-alert-title">{html.escape(name)}</p>\n{inner()}</div>\n'
        case "list":
            if n.info == "ordered":
                start = f' start="{n.level}"' if n.level != 1 else ""
                return f"<ol{start}>\n{inner()}</ol>\n"
            return f"<ul>\n{inner()}</ul>\n"
        case "item":
            return f"<li>{_tight(n)}</li>\n"
        case "task_item":
            checked = ' checked=""' if n.info.lower() == "x" else ""
            return f'<li><input type="checkbox"{checked} disabled="" /> {_tight(n)}</li>\n'
        case "code_block":
            language = f' class="language-{_attr(n.info.split()[0])}"' if n.info else ""
            return f"<pre><code{language}>{html.escape(n.text)}\n</code></pre>\n"
        case "html_block":
            return n.text + "\n"
        case "thematic_break":
            return "<hr />\n"
        case "table":
            aligns = n.info.split(",")
            rows = []
            for k, row in enumerate(n.children):
                tag = "td" if k else "th"
                cells = "".join(f"<{tag}{'' if a == 'none' else f' align={chr(34)}{a}{chr(34)}'}>{''.join(map(_html, c.children))}</{tag}>" for a, c in zip(aligns, row.children, strict=True))
                rows.append(f"<tr>{cells}</tr>\n")
            return f"<table>\n<thead>\n{rows[0]}</thead>\n" + (f"<tbody>\n{''.join(rows[1:])}</tbody>\n" if rows[1:] else "") + "</table>\n"
        case "description_list":
            return f"<dl>\n{inner()}</dl>\n"
        case "description_term":
            return f"<dt>{inner()}</dt>\n"
        case "description_details":
            return f"<dd>{inner()}</dd>\n"
        case "footnote_definition":
            return f'<section class="footnote" id="fn-{_attr(n.info)}">{inner()}</section>\n'
        case "footnote_reference":
            return f'<sup class="footnote-ref"><a href="#fn-{_attr(n.info)}">{html.escape(n.info)}</a></sup>'
        case "text":
            return html.escape(n.text, quote=False)
        case "code":
            return f"<code>{html.escape(n.text, quote=False)}</code>"
        case "math":
            return f'<code data-math-style="inline">{html.escape(n.text, quote=False)}</code>'
        case "html_inline":
            return n.text
        case "link":
            return f'<a href="{_attr(n.info)}">{inner()}</a>'
        case "wiki_link":
            return f'<a href="{_attr(n.info)}" data-wikilink="true">{html.escape(n.text)}</a>'
        case "image":
            return f'<img src="{_attr(n.info)}" alt="{_attr(n.text)}" />'
        case "strong" | "emph" | "strikethrough" | "superscript":
            tag = {"strong": "strong", "emph": "em", "strikethrough": "del", "superscript": "sup"}[n.kind]
            return f"<{tag}>{inner()}</{tag}>"
        case "spoiler":
            return f'<span class="spoiler">{inner()}</span>'
        case "line_break":
            return "<br />\n"
        case "soft_break":
            return "\n"
    return inner()


def _tight(n: Node) -> str:
    out = [("".join(map(_html, c.children)) if c.kind == "paragraph" else "\n" + _html(c)) for c in n.children]
    return "".join(out).rstrip("\n")


def css(theme: str) -> str:
    """A theme's colors as custom properties, and rules that use them."""
    colors = THEMES.get(theme, THEMES["github"])
    colors = colors | {"type": colors["module"]}
    return (
        ":root {\n" + "".join(f"  --{k.replace('_', '-')}: {v};\n" for k, v in colors.items()) + "}\n"
        "body { background: var(--background); color: var(--foreground); font-family: sans-serif; }\n"
        "a { color: var(--blue); }\ncode, pre { background: var(--surface); color: var(--green); }\n"
        "blockquote { border-left: 4px solid var(--border); padding-left: 1em; }\ntable, th, td { border: 1px solid var(--border); border-collapse: collapse; }\n"
    )


def to_html(text: str, theme: str | None = None) -> str:
    """A document as HTML; with a theme, as a page with its style."""
    body = _html(parse(text))
    return body if theme is None else f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="UTF-8">\n<style>\n{css(theme)}</style>\n</head>\n<body>\n{body}</body>\n</html>\n'


RESET, BOLD, ITALIC, UNDER, STRIKE, FAINT = "\x1b[0m", "\x1b[1m", "\x1b[3m", "\x1b[4m", "\x1b[9m", "\x1b[2m"
_BULLETS = "●○◆◇"


def paint(code: str) -> str:
    return f"\x1b[38;2;{int(code[1:3], 16)};{int(code[3:5], 16)};{int(code[5:7], 16)}m"


def wrap(text: str, width: int) -> list[str]:
    """A line in lines of at most ``width`` columns where words allow; the last color goes on in the next line."""
    lines = wrap_with_color(text, width, width).split("\n")
    return [x + RESET if k < len(lines) - 1 and last_color(x) else x for k, x in enumerate(lines)]


class Terminal:
    """Terminal text of a tree."""

    def __init__(self, theme: str = "github", width: int = 80, centered: frozenset[int] = frozenset()):
        self.colors = {k: paint(v) for k, v in THEMES.get(theme, THEMES["github"]).items()}
        self.theme, self.width, self.centered = theme, width, centered

    def inlines(self, nodes: list[Node]) -> str:
        return "".join(map(self.inline, nodes))

    def inline(self, n: Node) -> str:
        c = self.colors
        inner = lambda: self.inlines(n.children)
        match n.kind:
            case "text" | "math":
                return n.text
            case "code":
                return f"{c['green']}{n.text}{RESET}"
            case "strong":
                return f"{BOLD}{inner()}\x1b[22m"
            case "emph":
                return f"{ITALIC}{inner()}\x1b[23m"
            case "strikethrough":
                return f"{STRIKE}{inner()}\x1b[29m"
            case "spoiler":
                return f"{FAINT}{inner()}\x1b[22m"
            case "link":
                return f"\x1b]8;;{n.info}\x1b\\{c['cyan']}{UNDER}{inner()}{RESET}\x1b]8;;\x1b\\"
            case "wiki_link":
                return f"\x1b]8;;{n.info}\x1b\\{c['cyan']}{n.text}{RESET}\x1b]8;;\x1b\\"
            case "image":
                return f"{c['cyan']}🖼 {n.text}{RESET}"
            case "footnote_reference":
                return f"{c['cyan']}[{n.info}]{RESET}"
            case "html_inline":
                return f"{c['string']}{n.text}{RESET}"
            case "soft_break":
                return " "
            case "line_break":
                return "\n"
        return inner()

    def fill(self, text: str, width: int) -> list[str]:
        return [x for part in text.split("\n") for x in wrap(part, width)]

    def block(self, n: Node, width: int, depth: int = 0) -> list[str]:
        c = self.colors
        match n.kind:
            case "paragraph" | "description_term":
                lines = self.fill(self.inlines(n.children), width)
                if n.line in self.centered:
                    lines = [" " * max(0, (width - visible(x)) // 2) + x for x in lines]
                return lines
            case "heading":
                text = f"{'#' * n.level} {self.inlines(n.children)}"
                return [f"{c['keyword']}{BOLD}{x}{RESET}" for x in self.fill(text, width)]
            case "thematic_break":
                return [f"{c['border']}{'━' * width}{RESET}"]
            case "html_block":
                if m := re.search(r"<!--\s*S-TITLE:\s*(.*?)\s*-->", n.text):
                    inner = max(width - 2, visible(m[1]))
                    left = (inner - visible(m[1])) // 2
                    return ["┌" + "─" * inner + "┐", "│" + " " * left + m[1] + " " * (inner - left - visible(m[1])) + "│", "└" + "─" * inner + "┘"]
                if n.text.strip() == "<!--HR-->":
                    return [f"{c['border']}{'━' * width}{RESET}"]
                return [f"{c['comment']}{x}{RESET}" for x in n.text.split("\n")]
            case "code_block":
                lang = n.info.split(" ")[0] if n.info else ""
                lines = highlight(n.text, lang, self.theme).split("\n") if lang else [f"{c['green']}{x}{RESET}" for x in n.text.split("\n")]
                lines = [x for part in lines for x in wrap_with_color(part, width, width, "", True).split("\n")] if depth or len(lines) <= 10 else lines
                if len(lines) <= 10 or depth:
                    return [header(lang), *lines] if lang else lines
                digits = len(str(len(lines)))
                return [f"{c['comment']} {k:>{digits}} │{RESET} {x}" for k, x in enumerate(lines, 1)]
            case "block_quote":
                return [f"{c['border']}▌{RESET} {x}" for x in self.blocks(n.children, width - 2, depth + 1)]
            case "alert":
                color = c[ALERTS[n.info]]
                title = n.text or n.info.capitalize()
                return [f"{color}▌ {BOLD}{title}{RESET}"] + [f"{color}▌{RESET} {x}" for x in self.blocks(n.children, width - 2, depth + 1)]
            case "list":
                out = []
                for k, item in enumerate(n.children):
                    mark = f"{n.level + k}." if n.info == "ordered" else _BULLETS[(depth // 2) % 4]
                    if item.kind == "task_item":
                        mark = {"x": "☑", "X": "☑", " ": "☐", "-": "◐", "~": "◐", "!": "⚠"}.get(item.info, "•")
                    body = self.blocks(item.children, width - len(mark) - 1, depth + 2, tight=True) or [""]
                    out += [f"{c['yellow']}{mark}{RESET} {body[0]}"] + [" " * (len(mark) + 1) + x for x in body[1:]]
                return out
            case "table":
                return self.table(n)
            case "footnote_definition":
                body = self.blocks(n.children, width, depth + 1)
                return [f"{c['cyan']}[{n.info}]{RESET}: {body[0] if body else ''}", *body[1:]]
            case "description_list":
                return [x for child in n.children for x in self.block(child, width, depth)]
            case "description_details":
                return ["    " + x for x in self.fill(self.inlines(n.children), width - 4)]
        return self.fill(self.inline(n), width)

    def blocks(self, nodes: list[Node], width: int, depth: int = 0, tight: bool = False) -> list[str]:
        out: list[str] = []
        for k, n in enumerate(nodes):
            if k and not tight:
                out.append("")
            out += self.block(n, max(width, 10), depth)
        return out

    def table(self, n: Node) -> list[str]:
        rows = [[self.inlines(x.children).replace("\n", " ") for x in row.children] for row in n.children]
        widths = [max(visible(r[k]) for r in rows) for k in range(len(rows[0]))]
        aligns = n.info.split(",")

        def pad(text: str, w: int, align: str) -> str:
            rest = w - visible(text)
            left = rest // 2 if align == "center" else rest if align == "right" else 0
            return " " * left + text + " " * (rest - left)

        edge = lambda a, b, z: self.colors["border"] + a + b.join("─" * (w + 2) for w in widths) + z + RESET
        bar = f"{self.colors['border']}│{RESET}"
        line = lambda r, al: bar + bar.join(f" {pad(t, w, a)} " for t, w, a in zip(r, widths, al, strict=True)) + bar
        head = [edge("┌", "┬", "┐"), line(rows[0], ["center"] * len(widths)), edge("├", "┼", "┤")]
        return [*head, *[line(r, aligns) for r in rows[1:]], edge("└", "┴", "┘")]


def to_terminal(text: str, theme: str = "github", width: int = 80, centered: list[int] | None = None) -> str:
    terminal = Terminal(theme, width, frozenset(centered or ()))
    out = "\n".join(terminal.blocks(parse(text).children, width))
    return re.sub(r"\n([ \t]*\n){2,}", "\n\n", out).strip("\n")


def source_breaks(nodes: DataFrame, by: list[str], order: list[str], line: str = "line") -> DataFrame:
    """``nodes`` with ``breaks``: whether a node of a paragraph starts on another source line than the one before it."""
    before = F.lag(line).over(Window.partitionBy(*by).orderBy(*order))
    return nodes.withColumn("breaks", F.coalesce(before != F.col(line), F.lit(False)))


def md_to_html(text: Column, theme: str | None = None) -> Column:
    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else to_html(x, theme))

    return run(text)


def md_to_terminal(text: Column, theme: str = "github", width: int = 80) -> Column:
    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else to_terminal(x, theme, width))

    return run(text)
