"""Code in color: comments, strings, numbers, keywords and calls, by one pattern per family of languages."""

from __future__ import annotations

import re
from functools import cache

from quire.functions.wrapping import wrap_with_color
from quire.plans.dims import LANGUAGE_COLORS, LANGUAGE_ICONS, THEMES

RESET = "\x1b[0m"

#: How comments start, by family.
_COMMENTS = {"hash": r"#[^\n]*", "slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "dash": r"--[^\n]*|/\*.*?(?:\*/|\Z)", "markup": r"<!--.*?(?:-->|\Z)", "percent": r"%[^\n]*", "semi": r";[^\n]*"}
_FAMILY = {
    "hash": "py python rb ruby sh bash zsh fish toml yaml yml r perl pl elixir ex exs dockerfile docker make ini conf config env nim julia",
    "dash": "sql lua haskell hs elm ada vhdl",
    "markup": "html htm xml svg md markdown vue",
    "percent": "tex latex matlab m octave erlang erl prolog",
    "semi": "asm s clojure clj lisp scheme",
}
_KEYWORDS = (
    "abstract and as async await bool boolean break case catch char class const continue def default defer del do double elif else elsif end enum except export extends "
    "extern false final finally float fn for foreach from func function go goto if impl import in include instanceof int interface internal is lambda let long loop match "
    "mod module move mut namespace new nil none not null or override package pass private protected pub public raise record ref return self short static string struct "
    "super switch template then this throw throws trait true try type typedef union unless unsafe unsigned until use using val var virtual void when where while with yield "
    "select insert update delete create drop table view join left right inner outer on group by order having limit values set into"
).split()


@cache
def _pattern(lang: str) -> re.Pattern:
    family = next((k for k, names in _FAMILY.items() if lang.lower() in names.split()), "slash")
    strings = r'"""(?:.|\n)*?(?:"""|\Z)|\'\'\'(?:.|\n)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\.|[^`\\])*`?'
    words = "|".join(sorted(_KEYWORDS))
    flags = re.S | (re.I if family == "dash" else 0)
    return re.compile(rf"(?P<comment>{_COMMENTS[family]})|(?P<string>{strings})|(?P<number>\b\d[\w.]*)|(?P<keyword>\b(?:{words})\b)|(?P<function>\b[A-Za-z_]\w*(?=\())|(?P<type>\b[A-Z]\w*)", flags)


def highlight(code: str, lang: str, theme: str = "github") -> str:
    """``code`` with a color before each piece and a reset after it; each line starts and ends without color.

    Languages are told apart by how comments start. Text without a language isn't colored.
    """
    colors = THEMES.get(theme, THEMES["github"])
    paint = lambda c: f"\x1b[38;2;{int(c[1:3], 16)};{int(c[3:5], 16)};{int(c[5:7], 16)}m"
    if lang.lower() in ("", "text", "txt", "plain"):
        return code

    def piece(m: re.Match) -> str:
        role = {"number": "constant", "type": "module"}.get(m.lastgroup, m.lastgroup)
        return "\n".join(f"{paint(colors[role])}{x}{RESET}" if x else "" for x in m[0].split("\n"))

    return _pattern(lang).sub(piece, code)


def header(lang: str) -> str:
    """A language's icon, in its color, and name."""
    icon = LANGUAGE_ICONS.get(lang.lower())
    return lang if icon is None else f"\x1b[38;5;{LANGUAGE_COLORS[lang.lower()]}m{icon} {lang}{RESET}"


def code_simple(code: str, lang: str, theme: str = "github", width: int = 80, indent: int = 0) -> str:
    """Code under its language, lines set in by two and wrapped with their indent."""
    lines = highlight(code, lang, theme).splitlines()
    if lines and not lines[-1].strip():
        lines.pop()
    pad, sub = " " * indent, " " * max(0, 4 - indent)
    room = max(0, width - 2 * indent)
    body = [wrap_with_color(f"{pad}  {x}", room, max(0, room - len(sub)), pad + sub, True) for x in lines]
    return "\n".join(["", "", pad + header(lang), *body, "", ""])


def code_full(code: str, lang: str, theme: str = "github", width: int = 80) -> str:
    """Code with line numbers, in a frame under its language."""
    colors = THEMES.get(theme, THEMES["github"])
    border = f"\x1b[38;2;{int(colors['border'][1:3], 16)};{int(colors['border'][3:5], 16)};{int(colors['border'][5:7], 16)}m"
    lines = highlight(code, lang, theme).splitlines()
    gutter = len(str(len(lines))) + 2
    rule = lambda joint: f"{border}{'─' * gutter}{joint}{'─' * max(0, width - gutter - 1)}{RESET}"
    sub = f"{' ' * gutter}{border}│{RESET}     "
    room = max(0, width - gutter - 3)
    out = ["", "", rule("┬"), f"{border}{' ' * gutter}│ {header(lang)}", rule("┼")]
    for k, line in enumerate(lines, 1):
        left = (gutter - len(str(k))) // 2
        number = f"{' ' * left}{k}{' ' * (gutter - left - len(str(k)))}"
        out.append(f"{border}{number}│ {RESET}{wrap_with_color(line, room, max(0, room - 4), sub, True)}")
    return "\n".join([*out, rule("┴"), "", ""])

