"""Small tables: themes, alerts, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROLES = (
    "keyword", "function", "string", "module", "constant", "comment", "foreground", "guide", "background", "surface", "border",
    "keyword_bg", "red", "green", "blue", "cyan", "yellow", "magenta", "white", "black",
)

#: Colors of the themes by role, in the order of ROLES.
THEMES = {
    name: dict(zip(ROLES, colors, strict=True))
    for name, colors in {
        "catppuccin": (
            "#CBA6F7", "#89B4FA", "#A6E3A1", "#89DCEB", "#F38BA8", "#7F849C", "#CDD6F4", "#45475A", "#1E1E2E", "#2A2A3A", "#45475A",
            "#2A1F33", "#F38BA8", "#A6E3A1", "#89B4FA", "#89DCEB", "#F9E2AF", "#CBA6F7", "#CDD6F4", "#1E1E2E",
        ),
        "nord": (
            "#81A1C1", "#88C0D0", "#A3BE8C", "#8FBCBB", "#B48EAD", "#616E88", "#D8DEE9", "#434C5E", "#272E37", "#323A47", "#434C5E",
            "#1C2329", "#BF616A", "#A3BE8C", "#81A1C1", "#88C0D0", "#EBCB8B", "#B48EAD", "#D8DEE9", "#2E3440",
        ),
        "monokai": (
            "#F92672", "#A6E22E", "#E6DB74", "#66D9EF", "#AE81FF", "#75715E", "#F8F8F2", "#3E3D32", "#272822", "#343429", "#49483E",
            "#2D1A1F", "#F92672", "#A6E22E", "#66D9EF", "#66D9EF", "#E6DB74", "#AE81FF", "#F8F8F2", "#272822",
        ),
        "dracula": (
            "#FF79C6", "#50FA7B", "#F1FA8C", "#8BE9FD", "#BD93F9", "#6272A4", "#F8F8F2", "#44475A", "#282A36", "#353746", "#44475A",
            "#2D1B26", "#FF5555", "#50FA7B", "#8BE9FD", "#8BE9FD", "#F1FA8C", "#FF79C6", "#F8F8F2", "#282A36",
        ),
        "gruvbox": (
            "#FB4934", "#FABD2F", "#B8BB26", "#83A598", "#D3869B", "#928374", "#EBDBB2", "#504945", "#282828", "#3C3836", "#665C54",
            "#2B1A18", "#FB4934", "#B8BB26", "#83A598", "#8EC07C", "#FABD2F", "#D3869B", "#EBDBB2", "#282828",
        ),
        "one_dark": (
            "#C678DD", "#61AFEF", "#98C379", "#56B6C2", "#E06C75", "#5C6370", "#ABB2BF", "#3E4451", "#282C34", "#353B45", "#3E4451",
            "#2A1F2D", "#E06C75", "#98C379", "#61AFEF", "#56B6C2", "#E5C07B", "#C678DD", "#ABB2BF", "#282C34",
        ),
        "solarized": (
            "#268BD2", "#B58900", "#2AA198", "#859900", "#D33682", "#586E75", "#839496", "#073642", "#002B36", "#0E3A47", "#586E75",
            "#0A2935", "#DC322F", "#859900", "#268BD2", "#2AA198", "#B58900", "#D33682", "#EEE8D5", "#002B36",
        ),
        "tokyo_night": (
            "#BB9AF7", "#7AA2F7", "#9ECE6A", "#2AC3DE", "#FF9E64", "#565F89", "#C0CAF5", "#3B4261", "#1A1B26", "#24283B", "#414868",
            "#261F2D", "#F7768E", "#9ECE6A", "#7AA2F7", "#2AC3DE", "#E0AF68", "#BB9AF7", "#C0CAF5", "#1A1B26",
        ),
        "makurai_light": (
            "#E35043", "#3D76F3", "#51A150", "#AB31A9", "#976700", "#A0A1A7", "#323640", "#D1D5DB", "#f8f8fc", "#E8E8F0", "#7e8a9e",
            "#FDF2F1", "#E35043", "#51A150", "#3D76F3", "#00BFCF", "#FFCC00", "#AB31A9", "#FFFFFF", "#000000",
        ),
        "makurai_dark": (
            "#FF7733", "#FFEE99", "#95FB79", "#82AAFF", "#D2A6FF", "#5C6773", "#FFFFFF", "#2D3640", "#14161f", "#1E212A", "#5C6773",
            "#261810", "#FF5555", "#95FB79", "#82AAFF", "#66D9EF", "#FFEE99", "#FF77FF", "#FFFFFF", "#14161f",
        ),
        "ayu": (
            "#FF8F40", "#FFB454", "#AAD94C", "#59C2FF", "#D2A6FF", "#ACB6BF8C", "#BFBDB6", "#1F2430", "#0A0E14", "#151A21", "#1F2430",
            "#1A1209", "#F28779", "#AAD94C", "#59C2FF", "#95E6CB", "#FFB454", "#D2A6FF", "#BFBDB6", "#0A0E14",
        ),
        "ayu_mirage": (
            "#FFA759", "#FFD580", "#BAE67E", "#73D0FF", "#D4BFFF", "#5C6773", "#CBCCC6", "#242936", "#1F2430", "#2A313F", "#343B4C",
            "#221A0D", "#FF6666", "#BAE67E", "#73D0FF", "#95E6CB", "#FFD580", "#D4BFFF", "#CBCCC6", "#1F2430",
        ),
        "github": (
            "#FF7B72", "#D2A8FF", "#A5D6FF", "#FFA657", "#79C0FF", "#8B949E", "#F0F6FC", "#30363D", "#0D1117", "#1C2128", "#30363D",
            "#2B1618", "#F85149", "#56D364", "#58A6FF", "#39D0D6", "#E3B341", "#BC8CFF", "#F0F6FC", "#0D1117",
        ),
        "synthwave": (
            "#FF7EDB", "#36F9F6", "#E6DB74", "#FE4450", "#FF8CC8", "#848077", "#F8F8F2", "#2A2139", "#262335", "#342949", "#495495",
            "#2B1929", "#FE4450", "#72F1B8", "#36F9F6", "#36F9F6", "#FEE715", "#FF7EDB", "#F8F8F2", "#262335",
        ),
        "material": (
            "#C792EA", "#82AAFF", "#C3E88D", "#FFCB6B", "#F78C6C", "#676E95", "#A6ACCD", "#4E5579", "#292D3E", "#32374D", "#444267",
            "#2F2A37", "#F07178", "#C3E88D", "#82AAFF", "#89DDFF", "#FFCB6B", "#C792EA", "#FFFFFF", "#292D3E",
        ),
        "rose_pine": (
            "#C4A7E7", "#9CCFD8", "#F6C177", "#EBBCBA", "#EB6F92", "#6E6A86", "#E0DEF4", "#26233A", "#191724", "#21202E", "#403D52",
            "#24202E", "#EB6F92", "#31748F", "#9CCFD8", "#9CCFD8", "#F6C177", "#C4A7E7", "#E0DEF4", "#191724",
        ),
        "kanagawa": (
            "#957FB8", "#7AA89F", "#98BB6C", "#7FB4CA", "#D27E99", "#727169", "#DCD7BA", "#2A2A37", "#1F1F28", "#2A2A37", "#54546D",
            "#1E1A22", "#C34043", "#76946A", "#7E9CD8", "#6A9589", "#C0A36E", "#938AA9", "#DCD7BA", "#1F1F28",
        ),
        "vscode": (
            "#569CD6", "#DCDCAA", "#CE9178", "#4EC9B0", "#B5CEA8", "#6A9955", "#D4D4D4", "#404040", "#1E1E1E", "#2D2D30", "#3E3E42",
            "#142129", "#F44747", "#6A9955", "#569CD6", "#4EC9B0", "#DCDCAA", "#C586C0", "#D4D4D4", "#1E1E1E",
        ),
        "everforest": (
            "#E67E80", "#A7C080", "#DBBC7F", "#7FBBB3", "#D699B6", "#7A8478", "#D3C6AA", "#3D484D", "#2D353B", "#384148", "#504945",
            "#2B1F20", "#E67E80", "#A7C080", "#7FBBB3", "#83C092", "#DBBC7F", "#D699B6", "#D3C6AA", "#2D353B",
        ),
        "autumn": (
            "#fc6501", "#fac25a", "#a1cd32", "#fc4c4c", "#FF6B9D", "#5C6773", "#FFFFFF", "#2D3640", "#14161f", "#1E2129", "#5C6773",
            "#2A1A0D", "#fc4c4c", "#a1cd32", "#5abffa", "#5abffa", "#fac25a", "#FF6B9D", "#FFFFFF", "#2e3339",
        ),
        "spring": (
            "#FFB347", "#D4FF59", "#37dbb5", "#66E6FF", "#D8A5FF", "#5C6773", "#FFFFFF", "#2D3640", "#14161f", "#1E2129", "#5C6773",
            "#2A1F0D", "#FF5555", "#D4FF59", "#66E6FF", "#66E6FF", "#FFB347", "#D2A6FF", "#FFFFFF", "#2e3339",
        ),
    }.items()
}

ALERTS = {"note": "blue", "tip": "green", "important": "magenta", "warning": "yellow", "caution": "red"}

#: Names of languages by the word after a code fence.
LANGUAGES = {
    "py": "Python", "python": "Python", "rs": "Rust", "rust": "Rust", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript",
    "typescript": "TypeScript", "java": "Java", "c": "C", "cpp": "C++", "cs": "C#", "go": "Go", "rb": "Ruby", "ruby": "Ruby", "php": "PHP",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "sql": "SQL", "html": "HTML", "css": "CSS", "json": "JSON", "yaml": "YAML", "yml": "YAML",
    "toml": "TOML", "xml": "XML", "md": "Markdown", "markdown": "Markdown", "lua": "Lua", "kt": "Kotlin", "swift": "Swift", "scala": "Scala",
    "r": "R", "hs": "Haskell", "ex": "Elixir", "zig": "Zig", "nim": "Nim", "dart": "Dart", "docker": "Docker", "make": "Make", "text": "Text",
}


#: The word after a code fence, a language's icon and the number of its color.
ICONS = (
    ("python", "\ue235", 214),
    ("py", "\ue235", 214),
    ("rust", "\ue7a8", 166),
    ("rs", "\ue7a8", 166),
    ("javascript", "\ue74e", 227),
    ("js", "\ue74e", 227),
    ("typescript", "\ue628", 75),
    ("ts", "\ue628", 75),
    ("go", "\ue627", 81),
    ("golang", "\ue627", 81),
    ("c", "\ue61e", 68),
    ("cpp", "\ue61d", 204),
    ("c++", "\ue61d", 204),
    ("cc", "\ue61d", 204),
    ("cxx", "\ue61d", 204),
    ("java", "\ue738", 208),
    ("csharp", "\uf81a", 129),
    ("cs", "\uf81a", 129),
    ("ruby", "\ue21e", 196),
    ("rb", "\ue21e", 196),
    ("php", "\ue73d", 99),
    ("swift", "\ue755", 202),
    ("kotlin", "\ue634", 141),
    ("kt", "\ue634", 141),
    ("dart", "\ue798", 39),
    ("lua", "\ue620", 33),
    ("sh", "\uebca", 34),
    ("bash", "\uf489", 34),
    ("zsh", "\uf489", 34),
    ("fish", "\uf489", 34),
    ("html", "\ue736", 202),
    ("htm", "\ue736", 202),
    ("css", "\ue749", 75),
    ("scss", "\ue749", 199),
    ("sass", "\ue74b", 199),
    ("less", "\ue758", 54),
    ("jsx", "\ue7ba", 81),
    ("tsx", "\ue7ba", 81),
    ("vue", "\ufd42", 83),
    ("json", "\ue60b", 185),
    ("yaml", "\uf0c5", 167),
    ("yml", "\uf0c5", 167),
    ("toml", "\ue6b2", 131),
    ("svg", "\U000f0721", 178),
    ("xml", "\ue619", 172),
    ("md", "\uf48a", 255),
    ("markdown", "\uf48a", 255),
    ("rst", "\uf15c", 248),
    ("tex", "\ue600", 25),
    ("latex", "\ue600", 25),
    ("txt", "\uf15c", 248),
    ("text", "\uf15c", 248),
    ("log", "\uf18d", 242),
    ("ini", "\uf17a", 172),
    ("conf", "\uf0ad", 172),
    ("config", "\uf0ad", 172),
    ("env", "\uf462", 227),
    ("dockerfile", "\uf308", 39),
    ("docker", "\uf308", 39),
    ("asm", "\uf471", 124),
    ("s", "\uf471", 124),
    ("haskell", "\ue777", 99),
    ("hs", "\ue777", 99),
    ("elm", "\ue62c", 33),
    ("clojure", "\ue768", 34),
    ("clj", "\ue768", 34),
    ("scala", "\ue737", 196),
    ("erlang", "\ue7b1", 125),
    ("erl", "\ue7b1", 125),
    ("elixir", "\ue62d", 99),
    ("ex", "\ue62d", 99),
    ("exs", "\ue62d", 99),
    ("perl", "\ue769", 33),
    ("pl", "\ue769", 33),
    ("r", "\uf25d", 33),
    ("matlab", "\uf799", 202),
    ("m", "\uf799", 202),
    ("octave", "\uf799", 202),
    ("zig", "\ue6a9", 214),
    ("h", "\ue61e", 110),
    ("lock", "\uf023", 244),
    ("png", "\uf1c5", 117),
    ("jpg", "\uf1c5", 110),
    ("jpeg", "\uf1c5", 110),
    ("gif", "\uf1c5", 213),
    ("bmp", "\uf1c5", 103),
    ("webp", "\uf1c5", 149),
    ("tiff", "\uf1c5", 144),
    ("ico", "\uf1c5", 221),
    ("mp4", "\uf03d", 203),
    ("mkv", "\uf03d", 132),
    ("webm", "\uf03d", 111),
    ("mov", "\uf03d", 173),
    ("avi", "\uf03d", 167),
    ("flv", "\uf03d", 131),
    ("mp3", "\uf001", 215),
    ("ogg", "\uf001", 109),
    ("flac", "\uf001", 113),
    ("wav", "\uf001", 123),
    ("m4a", "\uf001", 174),
    ("zip", "\uf410", 180),
    ("tar", "\uf410", 180),
    ("gz", "\uf410", 180),
    ("rar", "\uf410", 180),
    ("7z", "\uf410", 180),
    ("xz", "\uf410", 180),
    ("pdf", "\uf1c1", 196),
    ("doc", "\uf1c2", 33),
    ("docx", "\uf1c2", 33),
    ("xls", "\uf1c3", 70),
    ("xlsx", "\uf1c3", 70),
    ("ppt", "\uf1c4", 166),
    ("pptx", "\uf1c4", 166),
    ("odt", "\uf1c2", 33),
    ("epub", "\uf02d", 135),
    ("csv", "\uf1c3", 190),
    ("ttf", "\uf031", 98),
    ("otf", "\uf031", 98),
    ("woff", "\uf031", 98),
    ("woff2", "\uf031", 98),
)
LANGUAGE_ICONS = {name: icon for name, icon, _ in ICONS}
LANGUAGE_COLORS = {name: color for name, _, color in ICONS}


def language_icon(lang: Column) -> Column:
    """struct<icon, color> of a language, the color as a sequence; null for others."""
    key = F.lower(lang)
    color = F.concat(F.lit("\x1b[38;5;"), lookup({k: str(v) for k, v in LANGUAGE_COLORS.items()}, key), F.lit("m"))
    return F.when(lookup(LANGUAGE_ICONS, key).isNotNull(), F.struct(lookup(LANGUAGE_ICONS, key).alias("icon"), color.alias("color")))


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """A value of a small table by lower-case key, in the expression itself."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    found = F.element_at(F.create_map(*entries), F.lower(key))
    return found if default is None else F.coalesce(found, default)


def theme_color(theme: Column, role: str) -> Column:
    """A role's color in a theme; unknown themes are github."""
    return lookup({name: colors[role] for name, colors in THEMES.items()}, theme, F.lit(THEMES["github"][role]))


#: What parts of code are called, by the role of their color.
SCOPES = (
    ("keyword", ("keyword", "storage.modifier", "storage.type")),
    ("function", ("entity.name.function", "support.function", "variable.function")),
    ("module", ("module", "struct", "enum", "generic", "path", "meta.path", "entity.name.tag", "support.type", "meta.import-name")),
    ("string", ("string", "punctuation.string", "constant.other.color", "punctuation.definition.string")),
    ("constant", ("constant", "keyword.other.unit", "support.constant")),
    ("comment", ("comment", "punctuation.comment", "punctuation.definition.comment")),
    ("foreground", ("variable", "operator", "punctuation", "block", "support.type.property-name", "punctuation.definition", "keyword.operator")),
)
#: The properties of a page's style, and the role of each.
STYLE_ROLES = (
    ("keyword", "keyword"), ("function", "function"), ("type", "module"), ("constant", "constant"), ("comment", "comment"), ("foreground", "foreground"),
    ("background", "background"), ("surface", "surface"), ("border", "border"),
)


def scope_role(scope: Column) -> Column:
    """The role of the color of a dotted scope such as ``keyword.control.rust``: that of its longest known beginning, of whole parts; else "foreground".

    Null for null.
    """
    known = F.create_map(*[F.lit(x) for role, names in SCOPES for name in names for x in (name, role)])
    parts = F.split(scope, r"\.")
    starts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: known[F.array_join(F.slice(parts, F.lit(1), n), ".")])
    return F.when(scope.isNotNull(), F.coalesce(F.get(F.filter(starts, lambda r: r.isNotNull()), F.lit(0)), F.lit("foreground")))


def scope_color(theme: Column, scope: Column) -> Column:
    """The color of a scope in a theme; an unknown theme is the default one."""
    role = scope_role(scope)
    of = lambda theme, role: F.lit(THEMES[theme][role])
    colors = F.create_map(*[x for name in THEMES for r, _ in SCOPES for x in (F.lit(f"{name} {r}"), of(name, r))])
    default = F.create_map(*[x for r, _ in SCOPES for x in (F.lit(r), of("github", r))])
    return F.coalesce(colors[F.concat(F.lower(theme), F.lit(" "), role)], default[role])


def theme_style(theme: Column, properties: tuple[tuple[str, str], ...] = STYLE_ROLES) -> Column:
    """A theme's colors as the custom properties of a page's style; an unknown theme is the default one."""
    lines = [F.concat(F.lit(f"  --{name}: "), theme_color(theme, role), F.lit(";\n")) for name, role in properties]
    return F.concat(F.lit(":root {\n"), *lines, F.lit("}\n"))
