"""HTML helpers that run inside Arrow UDFs: a small outline of a page and lookups on it.

Selectors are the subset the source registry uses: ``tag``, ``.class``, ``tag.class`` and descendants of these.
"""

from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .numeric import as_col
from .text import blank_if_null, squeeze, strip

# HTML elements without content, elements whose text is not shown, and blocks that end a paragraph.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
           "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

# Entities that need no parser, besides &amp;, and elements whose content is not parsed as usual.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\u00a0", "copy": "\u00a9", "reg": "\u00ae",
            "middot": "\u00b7", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019",
            "ldquo": "\u201c", "rdquo": "\u201d", "hellip": "\u2026", "raquo": "\u00bb", "laquo": "\u00ab"}
_RAW = ("script", "style", "title", "template", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext",
        "svg", "math")

_STRANGE_ENTITY = f"&(?!(?:amp|{'|'.join(ENTITIES)});)[#A-Za-z]"
_GAP = r"[ \t\n\r\f]"
_ATTRIBUTES = rf"(?:{_GAP}++[A-Za-z_:][-A-Za-z0-9_:.]*+(?:=\"[^\"<>]*+\")?+){{0,50}}+{_GAP}*+"
_MARKUP = "(?i)" + "|".join((
    *[rf"<{raw}{_ATTRIBUTES}>[^<]*+(?:<(?!!--|/{raw})[^<]*+){{0,200}}+</{raw}{_GAP}*+>" for raw in ("script", "style")],
    rf"<title{_ATTRIBUTES}>([^<]*+)</title{_GAP}*+>",
    rf"<(?!(?:{'|'.join(_RAW)})(?![A-Za-z0-9]))[a-z][a-z0-9]*+{_ATTRIBUTES}/?+>",
    rf"</[a-z][a-z0-9]*+{_GAP}*+>",
    "<!--[^<>-]*+-->",
    rf"\A{_GAP}*+<!DOCTYPE [^<>]*+>"))


class Outline(HTMLParser):
    """Elements in document order as ``(tag, attributes, ancestors)`` and text pieces with their open elements."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.elements, self.texts, self._open, self._pending = [], [], [], []
        self.feed(html or "")
        self.close()
        self._end_text()

    def handle_starttag(self, tag, attrs):
        self._end_text()
        if tag in _BLOCKS:
            self._leave("p", _BLOCKS - {"p"})
        if tag == "li":
            self._leave("li", {"ul", "ol"})
        self.elements.append((tag, {k: v or "" for k, v in attrs}, tuple(self._open)))
        if tag not in _VOID:
            self._open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._open.pop()

    def handle_endtag(self, tag):
        self._end_text()
        self._leave(tag, set())

    def handle_comment(self, data):
        self._end_text()

    def handle_data(self, data):
        self._pending.append(data)

    def _end_text(self):
        piece = "".join(self._pending).strip()
        self._pending.clear()
        if piece:
            self.texts.append((piece, tuple(self._open)))

    def _leave(self, tag, fences):
        for depth in range(len(self._open) - 1, -1, -1):
            name = self.elements[self._open[depth]][0]
            if name == tag:
                del self._open[depth:]
                return
            if name in fences:
                return

    def _is(self, index, step):
        tag, *classes = step.split(".")
        name, attrs, _ = self.elements[index]
        return (not tag or tag == name) and set(classes) <= set(attrs.get("class", "").split())

    def select(self, selector):
        """Indexes of matching elements."""
        *outer, last = selector.split()
        found = []
        for index, (_, _, ancestors) in enumerate(self.elements):
            if not self._is(index, last):
                continue
            rest = list(outer)
            for ancestor in reversed(ancestors):
                if rest and self._is(ancestor, rest[-1]):
                    rest.pop()
            if not rest:
                found.append(index)
        return found

    def text_of(self, index):
        """Stripped text pieces below an element, joined by one space."""
        out = []
        for piece, path in self.texts:
            below = index is None
            hidden = False
            for node in path:
                if below and self.elements[node][0] in _HIDDEN:
                    hidden = True
                below = below or node == index
            if below and not hidden:
                out.append(piece)
        return " ".join(out)


def outline_text(page, selector, sep=" "):
    return sep.join(page.text_of(i) for i in page.select(selector)).strip()


def outline_attr(page, selector, attr):
    found = page.select(selector)
    return page.elements[found[0]][1].get(attr, "").strip() if found else ""


def outline_links(page, selector, base):
    hrefs = (page.elements[i][1].get("href", "").strip() for i in page.select(selector))
    return list(dict.fromkeys(urljoin(base, h) for h in hrefs if h))


def select_text(html, selector, sep=" "):
    """Text of all elements matching ``selector``, joined by ``sep``; blank when none match."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: outline_text(Outline(h), selector, sep))

    return run(as_col(html))


def select_attr(html, selector, attr):
    """Attribute of the first element matching ``selector``; blank when there is none."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: outline_attr(Outline(h), selector, attr))

    return run(as_col(html))


@F.pandas_udf(T.ArrayType(T.StringType()))
def extract_links(html: pd.Series, selector: pd.Series, base: pd.Series) -> pd.Series:
    """Resolved links of a page, unique, in document order."""
    return pd.Series([outline_links(Outline(h), s, b or "") for h, s, b in zip(html, selector, base)])


_STRINGS, _PATH = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
OUTLINE = T.StructType([
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("tag", T.StringType()), T.StructField("classes", _STRINGS), T.StructField("names", _STRINGS),
        T.StructField("values", _STRINGS), T.StructField("path", _PATH)]))),
    T.StructField("texts", T.ArrayType(T.StructType([
        T.StructField("piece", T.StringType()), T.StructField("path", _PATH), T.StructField("hidden", T.IntegerType())])))])


@F.arrow_udf(OUTLINE)
def page_outline(html: pa.Array) -> pa.Array:
    """The outline of a page as a column, to be stored and asked many times.

    ``elements`` in document order with the indexes of their ancestors; ``texts`` with the elements around them and the innermost of
    these whose text is not shown (-1: none). NULL is a page without elements.
    """
    def one(text):
        page = Outline(text)
        elements = [{"tag": tag, "classes": attrs.get("class", "").split(), "names": list(attrs), "values": list(attrs.values()), "path": path}
                    for tag, attrs, path in page.elements]
        texts = [{"piece": piece, "path": path, "hidden": max((i for i in path if page.elements[i][0] in _HIDDEN), default=-1)}
                 for piece, path in page.texts]
        return {"elements": elements, "texts": texts}

    return pa.array([one(h.as_py()) for h in html], to_arrow_type(OUTLINE))


def _steps(selector):
    """A selector as (tag, classes) from the outermost step to the last."""
    def step(word):
        parts = F.split(word, r"\.")
        return F.struct(F.get(parts, F.lit(0)).alias("tag"), F.slice(parts, F.lit(2), F.size(parts)).alias("classes"))

    return F.transform(F.filter(F.split(selector, r"\s+"), lambda w: w != ""), step)


def _fits(element, step):
    return ((step["tag"] == "") | (step["tag"] == element["tag"])) & (F.size(F.array_except(step["classes"], element["classes"])) == 0)


def _found(outline, selector):
    """Indexes of the elements that match a selector column."""
    elements, steps = outline["elements"], _steps(selector)
    outer = F.size(steps) - 1

    def place(element, index):
        left = F.aggregate(F.reverse(element["path"]), outer, lambda n, above: F.when(
            (n > 0) & _fits(F.get(elements, above), F.get(steps, n - 1)), n - 1).otherwise(n))
        return F.when(_fits(element, F.get(steps, outer)) & (left == 0), index)

    return F.filter(F.transform(elements, place), lambda i: i.isNotNull())


def _attr(outline, index, name):
    element = F.get(outline["elements"], index)
    return F.get(element["values"], (F.array_position(element["names"], name) - 1).cast("int"))


def stored_text(outline, selector, sep=" "):
    """``select_text`` on a ``page_outline`` column; ``selector`` is a column."""
    def text_of(index):
        below = F.filter(outline["texts"], lambda t: F.array_contains(t["path"], index) & (t["hidden"] <= index))
        return F.array_join(F.transform(below, lambda t: t["piece"]), " ")

    return blank_if_null(strip(F.array_join(F.transform(_found(outline, selector), text_of), sep)))


def stored_attr(outline, selector, name):
    """``select_attr`` on a ``page_outline`` column."""
    return blank_if_null(strip(_attr(outline, F.get(_found(outline, selector), F.lit(0)), name)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(hrefs: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([list(dict.fromkeys(urljoin(b or "", h) for h in some)) for some, b in zip(hrefs, base)])


def stored_links(outline, selector, base):
    """``extract_links`` on a ``page_outline`` column; Python only resolves the addresses."""
    hrefs = F.transform(_found(outline, selector), lambda i: strip(_attr(outline, i, "href")))
    return _resolved(F.coalesce(F.filter(hrefs, lambda h: h != ""), F.array().cast("array<string>")), base)


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        value = unescape(text)
        return Outline(value).text_of(None) if "<" in value and ">" in value else value

    return texts.map(one)


def _decoded(c):
    """``c`` with the entities of ``ENTITIES`` replaced, in one pass as far as the text can tell."""
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def _plain_natively(t):
    """``_plain`` as expressions; NULL for texts that need the parser.

    Every ``<`` must begin a tag with plain or double-quoted attributes, a comment without dashes, a doctype at the start, or a whole
    script, style or title; and every entity must be one of the list. Whatever is not so leaves a ``<`` or a strange ``&`` behind.
    """
    value = F.when(~t.rlike(_STRANGE_ENTITY), _decoded(t))
    shown = F.regexp_replace(value, _MARKUP, " $1 ")
    simple = ~F.contains(shown, F.lit("<")) & ~shown.rlike(_STRANGE_ENTITY)
    tagged = F.contains(value, F.lit("<")) & F.contains(value, F.lit(">"))
    return F.when(tagged, F.when(simple, _decoded(shown))).otherwise(value)


def strip_markup(text):
    """Unescape entities, drop tags, squeeze white space.

    Common markup is taken off by expressions; only texts that these cannot decide visit Python's parser. NULL is blank.
    """
    t = blank_if_null(text)
    marked = t.rlike("&[#A-Za-z]") | (F.contains(t, F.lit("<")) & F.contains(t, F.lit(">")))
    native = F.when(marked, _plain_natively(t)).otherwise(t)
    return squeeze(F.coalesce(native, _plain(F.when(native.isNull(), t))))
