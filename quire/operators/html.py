"""HTML: media candidates, the biggest of a page, and Markdown by tag rules."""

from __future__ import annotations

import html
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.media import allowed, github_raw, media_type, mime_extension, valid_candidate
from quire.functions.text import escape_unknown_tags, let

#: The tags with a rule.
TAGS = "img pre code a blockquote figure figcaption br var i hr b strong em del s strike h1 h2 h3 h4 h5 h6 q div p details summary".split()
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open paragraph ends where one of these starts.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Formatting elements, which open again after their block was closed over them.
FORMATTING = frozenset("a b code em i s strike strong".split())
_SPECIAL = ENDS_P | frozenset("li td th body html".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """A tree of a fragment: implied ends of paragraphs, and formatting that is opened again."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.active: list[Node] = []
        self.drop_newline = False

    def _pop_to(self, node: Node) -> None:
        while self.open.pop() is not node:
            pass

    def _close_p(self) -> None:
        for node in reversed(self.open):
            if node.tag == "p":
                self._pop_to(node)
                return
            if node.tag in ("td", "th", "body", "html", ""):
                return

    def _reopen(self) -> None:
        for k, node in enumerate(self.active):
            if node not in self.open:
                again = Node(node.tag, node.attrs)
                self.open[-1].children.append(again)
                self.open.append(again)
                self.active[k] = again

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in reversed(attrs)}
        if tag in ENDS_P:
            self._close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
        else:
            if tag == "a":
                for node in [n for n in self.active if n.tag == "a"]:
                    self._end_formatting("a")
            self._reopen()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMATTING:
                self.active.append(node)
        self.drop_newline = tag == "pre"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _end_formatting(self, tag: str) -> None:
        node = next((n for n in reversed(self.active) if n.tag == tag), None)
        if node is None:
            return
        self.active.remove(node)
        if node not in self.open:
            return
        above = self.open[self.open.index(node) + 1 :]
        block = next((n for n in above if n.tag in _SPECIAL), None)
        if block is None:
            self._pop_to(node)
        else:  # the element ends inside a block that goes on
            self.open.remove(node)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag in VOID:
            return
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].children.append(Node("p", {}))
        else:
            for node in reversed(self.open):
                if node.tag == tag or (tag in HEADINGS and node.tag in HEADINGS):
                    self._pop_to(node)
                    return
                if node.tag in _SPECIAL and tag not in _SPECIAL:
                    return

    def handle_data(self, data):
        if self.drop_newline and data.startswith("\n"):
            data = data[1:]
        self.drop_newline = False
        if not data:
            return
        if data.strip():
            self._reopen()
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)


def tree(text: str) -> Node:
    builder = Builder()
    builder.feed(text)
    builder.close()
    return builder.root


_WRAPS = {"var": "*", "i": "*", "em": "*", "b": "**", "strong": "**", "del": "~~", "s": "~~", "strike": "~~"}


class Writer:
    """Markdown of a tree, in nested buffers; ``centered`` are the lines of what is to be centred."""

    def __init__(self):
        self.buffers = [""]
        self.space = False
        self.centered: list[int] = []

    def line(self) -> None:
        """Ends the line of the innermost buffer that has any text."""
        for k in range(len(self.buffers) - 1, -1, -1):
            if self.buffers[k]:
                if not self.buffers[k].endswith("\n"):
                    self.buffers[k] += "\n"
                return

    def write(self, text: str) -> None:
        if self.space:
            if not text.startswith("\n"):
                self.line()
            if not text.strip(" \t"):
                text = ""
        self.buffers[-1] += text
        self.space = False

    def inner(self, node: Node) -> str:
        self.buffers.append("")
        self.children(node)
        return self.buffers.pop()

    def block(self, text: str) -> None:
        self.line()
        self.write(text)
        self.space = True

    def centre(self, node: Node) -> bool:
        return node.attrs.get("align", "").strip().lower() == "center"

    def next_line(self) -> int:
        return len(self.buffers[0].split("\n")) - self.buffers[0].endswith("\n") + 1 if self.buffers[0] else 1

    def children(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.write(child)
            else:
                self.node(child)

    def node(self, n: Node) -> None:
        tag = n.tag
        if tag in _WRAPS:
            self.write(f"{_WRAPS[tag]}{self.inner(n).strip()}{_WRAPS[tag]}")
        elif tag in HEADINGS:
            text = self.inner(n).replace("\n", " ").strip()
            self.line()
            if self.centre(n):
                self.centered.append(self.next_line())
            self.write(f"{'#' * int(tag[1])} {text}")
            self.space = True
        elif tag in ("div", "p", "figure", "figcaption"):
            text = self.inner(n).strip()
            if text:
                self.line()
                first = self.next_line()
                self.write(text)
                if tag in ("div", "p") and self.centre(n):
                    self.centered += range(first, self.next_line())
                self.space = True
        elif tag in ("blockquote", "details"):
            self.block("\n".join(f"> {x}" for x in self.inner(n).strip().split("\n")))
        elif tag == "pre":
            self.block(f"```\n{self.inner(n).strip()}\n```")
        elif tag == "hr":
            self.block("<!--HR-->")
        elif tag == "br":
            self.space = True
        elif tag == "code":
            self.write(f"`{self.inner(n)}`")
        elif tag == "q":
            self.write(f'"{self.inner(n)}"')
        elif tag == "summary":
            self.write(f"▼ {self.inner(n).strip()}")
        elif tag == "a":
            text = self.inner(n)
            self.write(f"[{text.strip()}]({n.attrs['href'].strip()})" if "href" in n.attrs else text)
        elif tag == "img":
            w, h = n.attrs.get("width"), n.attrs.get("height")
            size = "" if w is None and h is None else f"#{w or ''}x{h or ''}"
            self.write(f"![{n.attrs.get('alt', 'IMG')}]({n.attrs.get('src', '')}{size})")
        else:
            self.children(n)


def to_markdown(text: str) -> tuple[str, list[int]]:
    """(Markdown, centred lines) of a fragment whose unknown tags are already escaped."""
    writer = Writer()
    writer.children(tree(text))
    return writer.buffers[0], writer.centered


@F.pandas_udf(T.StructType().add("content", T.StringType()).add("centered_lines", T.ArrayType(T.IntegerType())))
def _rules(text: pd.Series) -> pd.DataFrame:
    found = [to_markdown(t) if t is not None else (None, None) for t in text]
    return pd.DataFrame({"content": [x[0] for x in found], "centered_lines": [x[1] for x in found]})


_DROPPED = r"(?is)<(script|style|head)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>|<!--(?!\s*S-TITLE:).*?-->"


def html_to_markdown(text: Column, clean: bool = False) -> Column:
    """struct<content, centered_lines>: the tags with a rule as Markdown; other tags stay as text.

    ``clean`` first drops scripts, styles, heads and the marks of other tags.
    Escaping runs natively; the tree and its rules need Python.
    """
    if clean:
        text = F.regexp_replace(F.regexp_replace(text, _DROPPED, ""), rf"(?i)</?(?!(?:{'|'.join(TAGS)})(?![a-z0-9]))[a-z][a-z0-9]*[^>]*>", "")
    return _rules(escape_unknown_tags(text, TAGS))


def _tags(text: Column, tag: str) -> Column:
    """The whole tags of a kind. Repeats are possessive: they end only where a tag can, and take no stack."""
    return F.regexp_extract_all(text, F.lit(rf"(?i)<{tag}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))


#: A name and its value; values are taken whole, so that none of what stands in them is a name.
_PAIR = r"\s([^\s=>\"'/]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\"'\s>]++)"


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute in a tag; null without one."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_PAIR), F.lit(1)), F.lower)
    return let(F.array_position(names, name).cast("int"), lambda k: F.when(k > 0, F.get(F.regexp_extract_all(tag, F.lit(_PAIR), F.lit(2)), k - 1)))


#: What holds no markup: comments, scripts and styles.
_SILENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def media_candidates(pages: DataFrame, page: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(page, base, ord, src, kind): images, vector images, videos and their sources, in this order; duplicates stay.

    Values may be quoted, with spaces in them; comments, scripts and styles hold no candidates.
    """
    bare = lambda x: F.trim(F.regexp_replace(x, r"(?s)^[\"'](.*)[\"']$", "$1"))
    values = lambda of, tag, name: F.transform(F.filter(F.transform(_tags(of, tag), lambda x: _attribute(x, name)), lambda x: x.isNotNull()), bare)
    svg = lambda a: F.filter(a, lambda x: x.endswith(".svg"))
    of = lambda a, kind: F.transform(a, lambda x: F.struct(x.alias("src"), F.lit(kind).alias("kind")))

    def of_text(t: Column) -> Column:
        videos = F.regexp_extract_all(t, F.lit(r"(?is)<video\b.*?</video>"), F.lit(0))
        sources = F.flatten(F.transform(videos, lambda v: values(v, "source", "src")))
        vectors = F.concat(svg(values(t, "object", "data")), svg(values(t, "embed", "src")))
        images = lambda x: F.concat(of(x, "image"), of(vectors, "svg"), of(svg(x), "svg"))
        return F.concat(let(values(t, "img", "src"), images), of(values(t, "video", "src"), "video"), of(sources, "video"))

    every = let(F.regexp_replace(F.col(text), _SILENT, ""), of_text)
    d = pages.select(page, F.col(url).alias("base"), F.posexplode(every).alias("ord", "_c"))
    return d.select(page, "base", "ord", F.col("_c.src").alias("src"), F.col("_c.kind").alias("kind"))


@F.pandas_udf(T.StringType())
def _resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        try:
            return urljoin(b, html.unescape(r))
        except (ValueError, TypeError):
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])


def resolve(base: Column, ref: Column) -> Column:
    """A reference against its page's URL; null where either is none. Whole URLs need no Python."""
    return F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref).when(base.isNull() | ref.isNull(), None).otherwise(_resolve(base, ref))


def biggest_media(candidates: DataFrame, media: DataFrame, page: str = "page_id", most: int | None = None, images: bool = True, videos: bool = True, documents: bool = True) -> DataFrame:
    """(page, src, ext, size): the largest candidate of each page that is what it promised and allowed; of equal ones the first.

    ``media`` has (src, mime, size); a candidate is looked up by its reference
    resolved against its page, or as it stands. Filters come before the join's payload.
    """
    known = media.select(F.col("src").alias("_url"), mime_extension(F.col("mime")).alias("ext"), "size").filter("ext is not null and size is not null")
    if most is not None:
        known = known.filter(F.col("size") <= most)
    known = known.filter(allowed(media_type(F.col("ext")), images, videos, documents))
    met = candidates.withColumn("_full", resolve(F.col("base"), F.col("src")) if "base" in candidates.columns else F.col("src"))
    met = met.withColumn("_url", F.explode(F.array_distinct(F.array("src", "_full"))))
    fit = met.join(known, "_url").filter(valid_candidate(F.col("kind"), F.col("ext")))
    best = fit.groupBy(page).agg(F.max_by(F.struct(F.col("_url").alias("src"), "ext", "size"), F.struct("size", -F.col("ord"))).alias("b"))
    return best.select(page, "b.src", "b.ext", "b.size")


def scraped(pages: DataFrame, media: DataFrame, page: str = "page_id", url: str = "url", text: str = "html", most: int | None = None, **kinds: bool) -> DataFrame:
    """(page, src, ext, size) of what a URL gives: itself where its type is known and allowed, else the page's biggest media.

    Blob pages of GitHub stand for their raw files. Pages without either give nothing.
    """
    asked = pages.withColumn("_src", github_raw(F.col(url)))
    known = media.select(F.col("src").alias("_src"), mime_extension(F.col("mime")).alias("ext"), "size").filter("ext is not null")
    known = known.filter(allowed(media_type(F.col("ext")), **kinds))
    if most is not None:
        known = known.filter(F.col("size") <= most)
    direct = asked.join(known, "_src").select(page, F.col("_src").alias("src"), "ext", "size")
    rest = pages.join(direct.select(page), page, "left_anti")
    return direct.unionByName(biggest_media(media_candidates(rest, page, url, text), media, page, most, **kinds))


def with_images(refs: DataFrame, images: DataFrame, url: str = "url", alt: str = "alt") -> DataFrame:
    """References with their rendered image, or their alternative text where it is missing or failed."""
    good = images.filter("ok").select(F.col(url), F.col("rendered").alias("_rendered"))
    return refs.join(good, url, "left").withColumn("shown", F.coalesce("_rendered", alt)).drop("_rendered")
