"""XHTML snippets: parsed, compared and repaired. Python functions of one value, used in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape
from xml.etree import ElementTree as XML

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import bounded

#: Attributes that carry structure, and tags whose text is a block.
STRUCTURE = ("id", "class", "href", "src", "alt", "title")
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "td", "th", "dt", "dd")
LINKED = ("id", "href", "src")


#: Texts that are page marks, numbers, colours or style declarations.
ODD = tuple(
    re.compile(x) for x in (r"(?i)page_\d+", r"[\d\s.,:;!?()\-–—_#]+", "#[0-9A-Fa-f]{3,8}", r"[.#]?[A-Za-z_][A-Za-z0-9_-]*\s*[:=]\s*[-#\w.,%() ]+")
)


def prose(text: str) -> bool:
    """`quire.functions.text.has_prose` of one value."""
    v = " ".join(text.split())
    return bool(v) and not any(p.fullmatch(v) for p in ODD) and any(unicodedata.category(c).startswith("L") for c in v)


def tag(e: XML.Element) -> str:
    return e.tag.rpartition("}")[2]


def snippet(html: str) -> XML.Element:
    """The one element of a snippet, without namespaces."""
    try:
        holder = XML.fromstring(f"<holder>{html}</holder>")
    except XML.ParseError as e:
        raise ValueError(f"the snippet is not well-formed: {e}") from e
    if len(holder) != 1:
        raise ValueError("the snippet must have exactly one root element")
    holder[0].tail = None
    return holder[0]


def rendered(e: XML.Element) -> str:
    return XML.tostring(e, encoding="unicode")


def plain(html: str) -> str:
    """A snippet's text; of what cannot be parsed, what is left without tags."""
    try:
        return "".join(XML.fromstring(html).itertext())
    except XML.ParseError:
        out, depth = [], 0
        for part in html.replace("<", "\0<").replace(">", ">\0").split("\0"):
            depth = part.startswith("<")
            if not (depth and part.endswith(">") and len(part) > 2):
                out.append(part)
        return unescape("".join(out))


def structure(e: XML.Element) -> list[tuple[str, str, str]]:
    return [(tag(x), a, x.attrib[a]) for x in e.iter() for a in STRUCTURE if a in x.attrib]


def structure_issues(source: str, target: str) -> list[tuple[str, str]]:
    """(rule, detail) of what a transformed snippet must keep of its source."""
    if not isinstance(target, str) or not target.strip():
        return [("empty", "")]
    try:
        a, b = snippet(source), snippet(target)
    except ValueError as e:
        return [("unparsable", str(e))]
    out = []
    if tag(a) != tag(b):
        out.append(("root tag", f"{tag(a)} -> {tag(b)}"))
    out += [("root attribute", f"{k}: {v} -> {b.attrib.get(k)}") for k, v in a.attrib.items() if k in STRUCTURE and b.attrib.get(k) != v]
    if structure(a) != structure(b):
        out.append(("structure", f"{structure(a)} -> {structure(b)}"))
    return out


def repaired(source: str, target: str) -> str:
    """The target with its root's links and ids as in the source, foreign linked elements taken out, and
    missing ones put in front, empty. What cannot be parsed stays."""
    try:
        a, b = snippet(source), snippet(target)
    except ValueError:
        return target
    if not structure(a) or structure(a) == structure(b):
        return target
    for k in LINKED:
        if k in a.attrib:
            b.attrib[k] = a.attrib[k]
    mark = lambda e: next(((tag(e), k, e.attrib[k]) for k in LINKED if k in e.attrib), None)
    wanted = Counter(m for e in a.iter() if (m := mark(e)))
    for parent in list(b.iter()):
        for child in list(parent):
            if (m := mark(child)) and m not in wanted:
                parent.remove(child)
    missing = wanted - Counter(m for e in b.iter() if (m := mark(e)))
    lost = []
    for e in a.iter():
        if (m := mark(e)) and missing[m] > 0:
            missing[m] -= 1
            lost.append(XML.Element(tag(e), dict(e.attrib)))
    for e in reversed(lost):
        b.insert(0, e)
    return rendered(b)


def validated(pairs: DataFrame) -> DataFrame:
    """(id, rule, detail) of all pairs (id, source_html, translated_html)."""
    bounded(pairs.sparkSession)

    def run(frames):
        for f in frames:
            rows = [(i, r, x) for i, s, g in zip(f["id"], f["source_html"], f["translated_html"], strict=True) for r, x in structure_issues(s or "", g)]
            yield pd.DataFrame(rows, columns=["id", "rule", "detail"])

    return pairs.select("id", "source_html", "translated_html").mapInPandas(run, "id string, rule string, detail string")


def repaired_rows(pairs: DataFrame) -> DataFrame:
    bounded(pairs.sparkSession)

    @F.pandas_udf("string")
    def fix(source: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([repaired(s or "", g) if isinstance(g, str) else g for s, g in zip(source, target, strict=True)])

    return pairs.withColumn("translated_html", fix("source_html", "translated_html"))


def blocks_of(html: str) -> list[tuple[int, str, str, str]]:
    """(place, tag, text, snippet) of the text elements of a well-formed page's body, in document order;
    nested ones count by themselves too."""
    root = XML.fromstring(html)
    body = next((e for e in root.iter() if tag(e) == "body"), root)
    out = []
    for e in body.iter():
        text = " ".join("".join(e.itertext()).split())
        if tag(e) in TEXT_TAGS and prose(text):
            copy = XML.fromstring(XML.tostring(e, encoding="unicode"))
            copy.tail = None
            for x in copy.iter():
                x.tag = tag(x)
            out.append((len(out) + 1, tag(e), text, rendered(copy)))
    return out
