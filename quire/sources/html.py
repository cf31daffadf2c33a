"""Raw HTML: titles, bodies, sanitised fragments and links, by expressions that bear malformed input."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as t


def _inner(html: Column, tag: str) -> Column:
    """The content of the first such element, null where there is none."""
    pattern = rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def title(html: Column, default: Column) -> Column:
    found = t.strip(t.without_tags(F.coalesce(_inner(html, "title"), _inner(html, "h1"), F.lit(""))))
    return F.coalesce(F.nullif(found, F.lit("")), default)


def body(html: Column) -> Column:
    return F.coalesce(_inner(html, "body"), html)


def sanitized(fragment: Column) -> Column:
    """Without scripts, styles, doctypes and document-level tags."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!doctype[^>]*>", r"(?is)</?(?:html|head|body|meta|title|link)[^>]*>"):
        fragment = F.regexp_replace(fragment, pattern, "")
    return t.strip(fragment)


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Texts with all named and numbered entities as characters."""
    return texts.map(unescape, na_action="ignore")


def paragraphed(fragment: Column) -> Column:
    """A sanitised fragment; one without any block of text becomes one escaped paragraph of all its text."""
    flat = t.squeeze(F.regexp_replace(fragment, "<[^>]+>", " "))
    flat = t.squeeze(F.when(F.contains(flat, F.lit("&")), unescaped(flat)).otherwise(flat))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        flat = F.replace(flat, F.lit(a), F.lit(b))
    return F.when(fragment.rlike(r"(?i)<(?:p|h[1-6]|blockquote|ul|ol|li)[\s>/]"), fragment).otherwise(F.concat(F.lit("<p>"), flat, F.lit("</p>")))


def ids(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, id): the distinct ids of every page's elements."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)\sid\s*=\s*"([^"]+)"'), F.lit(1)))
    return pages.select(key, F.explode(found).alias("id"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'(?i)href\s*=\s*"([^"]*)"'), F.lit(1))).alias("href"))


def path(url: Column) -> Column:
    """A URL's path without scheme, host, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
