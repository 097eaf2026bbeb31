"""Lines of colored text in lines of a width, by the least total raggedness."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import ANSI, display_width_of

_ANSI = re.compile(ANSI)
_COLOR = re.compile(r"\x1b\[([0-9;]*)m")
#: What a line, a column too many, and a short last line cost, and what counts as short.
LINE, OVERFLOW, SHORT, SHORT_SHARE = 1000, 2500, 25, 4


def visible(text: str) -> int:
    """Columns that a text takes without its sequences."""
    return display_width_of(_ANSI.sub("", text))


def fitted(words: list[str], width: int) -> list[list[str]]:
    """Words in lines whose squared gaps cost least together; the last line's gap is free.

    Best costs are kept for each number of words; lines that overflow are
    tried only where the last word alone does.
    """
    width = max(1, width)
    sizes = [visible(w) for w in words]
    best: list[tuple[float, int]] = [(0, 0)]
    for end in range(1, len(words) + 1):
        options = []
        size = -1
        for start in range(end - 1, -1, -1):
            size += sizes[start] + 1
            if size > width and start < end - 1:
                break
            cost = best[start][0] + LINE
            if size > width:
                cost += (size - width) * OVERFLOW
            elif end < len(words):
                cost += (width - size) ** 2
            elif start + 1 == end and size * SHORT_SHARE < width:
                cost += SHORT
            options.append((cost, start))
        best.append(min(options))
    lines, end = [], len(words)
    while end:
        start = best[end][1]
        lines.append(words[start:end])
        end = start
    return lines[::-1]


def last_color(text: str) -> str | None:
    """The last sequence that sets a foreground; None after a reset or without one."""
    found = None
    for m in _COLOR.finditer(text):
        if m[1] in ("", "0"):
            found = None
        elif any(x.isdigit() and (30 <= int(x) <= 38 or 90 <= int(x) <= 97) for x in m[1].split(";")):
            found = m[0]
    return found


def wrap(text: str, width: int) -> list[str]:
    """A line in lines of at most ``width`` columns where words allow; spaces before its first word stay."""
    lead = re.match(" *", text)[0]
    words = text[len(lead) :].split(" ")
    words[0] = lead + words[0]
    return [" ".join(line).rstrip(" ") if k else " ".join(line) for k, line in enumerate(fitted(words, width))]


def wrap_with_color(text: str, first: int, rest: int, prefix: str = "", auto_indent: bool = False) -> str:
    """A line that is too long in lines: the first of ``first`` columns, the others of ``rest`` behind ``prefix``.

    A line that fits is left as it is. The last color goes on in the next line;
    with ``auto_indent`` so does the indent.
    """
    if visible(text) <= first:
        return text
    end = "\n" if text.endswith("\n") else ""
    plain = _ANSI.sub("", text)
    indent = len(plain) - len(plain.lstrip()) if auto_indent else 0
    lines = wrap(text.rstrip("\n"), first)
    if len(lines) > 1:
        lines = [lines[0], *wrap(" ".join(lines[1:]).lstrip(" "), max(0, rest - indent))]
    out, color = lines[0], last_color(lines[0]) or ""
    for line in lines[1:]:
        out += f"\n{prefix}{' ' * indent}{color}{line}" if line.strip() else line
        color = last_color(line) or color
    return out + end


def wrap_lines(text: str, width: int, indent: int = 0, prefix: str = "", sub_prefix: str = "", several: bool = True) -> str:
    """Lines behind an indent and ``prefix``; what doesn't fit goes on behind ``sub_prefix``.

    Without ``several`` the text is one line, whose rest goes on behind ``prefix``.
    """
    room = max(0, width - 2 * indent)
    first, rest = max(0, room - visible(prefix)), max(0, room - visible(sub_prefix))
    pad = " " * indent
    if not several:
        return wrap_with_color(pad + prefix + text, first, rest, pad + prefix)
    end = "\n" if text.endswith("\n") else ""
    return "\n".join(wrap_with_color(pad + prefix + x, first, rest, pad + sub_prefix).strip("\n") for x in text.splitlines()) + end


def wrapped(text: Column, width: int, indent: int = 0, prefix: str = "", sub_prefix: str = "") -> Column:
    """``wrap_lines`` of a column."""

    @F.pandas_udf(T.StringType())
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else wrap_lines(x, width, indent, prefix, sub_prefix))

    return run(text)


def split_words(line: Column) -> Column:
    """A command line's words: quotes and backslashes as a shell takes them; null where a quote stays open."""
    import shlex

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(t: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else shlex.split(x)
            except ValueError:
                return None

        return t.map(one)

    return run(line)
