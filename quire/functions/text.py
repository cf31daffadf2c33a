"""Column functions over text: normalising, classifying, matching and measuring. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java character class.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Marks that end sentences, quotation marks and brackets.
SENTENCE_MARKS, QUOTE_MARKS, OPENING, CLOSING = ".!?。！？", "\"“”‘’«»‹›「」『』", "([{（", ")]}）"
#: Punctuation that is cut from both ends of a term.
TERM_EDGES = " \t\r\n.,;:!?()[]{}\"“”"
CHARS_PER_TOKEN = 4


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def squeeze(x: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


#: Texts that are page marks, numbers, style colours or declarations, as Java reads them. They are told from
#: the text as it is, with any white space where a squeezed text has a space, so that nothing has to be squeezed.
_SPACE, _VALUE = WS[1:-1], r"-#\p{L}\p{N}_.,%()"
ODD = (
    rf"(?i)^{WS}*page_\p{{Nd}}+{WS}*\z", rf"^[\p{{Nd}}{_SPACE}.,:;!?()\-–—_#]+\z", rf"^{WS}*#[0-9A-Fa-f]{{3,8}}{WS}*\z",
    rf"^{WS}*[.#]?[A-Za-z_][A-Za-z0-9_-]*{WS}*[:=]{WS}*[{_VALUE}][{_VALUE}{_SPACE}]*\z",
)
#: What labels of chapters, front and back matter hold.
CHAPTER, FRONT, BACK = r"(?i)^chapter\s+\d+(?![\p{L}\p{N}_])", "contents|cover|title|copyright|praise", "acknowledg|about the author|author|also by"


def has_prose(x: Column) -> Column:
    """Whether a text is worth transforming: it has a letter and is no page mark, number, colour or
    style declaration."""
    v = F.coalesce(x, F.lit(""))
    return v.rlike(r"\p{L}") & ~reduce(Column.__or__, (v.rlike(p) for p in ODD))


def section_kind(label: Column) -> Column:
    """chapter, front_matter, back_matter or unknown, by the first rule that holds."""
    label = F.coalesce(label, F.lit(""))
    low = F.lower(label)
    return (
        F.when(label.rlike(CHAPTER), "chapter")
        .when(low.rlike(FRONT), "front_matter")
        .when(low.rlike(BACK), "back_matter")
        .otherwise("unknown")
    )


def block_chars(html: Column, text: Column) -> Column:
    """Size of a block: its markup, or its text where there is none; at least 1."""
    return F.greatest(F.lit(1), F.length(F.coalesce(F.nullif(html, F.lit("")), text, F.lit(""))))


def tokens_of_chars(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(chars / CHARS_PER_TOKEN)).cast("long")


def tokens_of_text(x: Column) -> Column:
    """0 for blank texts, else a quarter of the visible characters and one more."""
    n = F.length(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", ""))
    return F.when(n == 0, 0).otherwise(F.floor(n / CHARS_PER_TOKEN) + 1).cast("long")


def quoted(term: Column) -> Column:
    """A term as a regular expression that matches it literally."""
    return F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")


def holds_term(text: Column, term: Column) -> Column:
    """Whether a term occurs: between non-letters if it has a Latin letter, else anywhere."""
    bounded = F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z])"), quoted(term), F.lit("(?![A-Za-z])")))
    return F.when(term == "", False).when(term.rlike("[A-Za-z]"), bounded).otherwise(F.contains(text, term))


def replace_term(text: Column, term: Column, by: Column) -> Column:
    """Every occurrence replaced, under the same rule."""
    safe = F.regexp_replace(by, r"([\\$])", r"\\$1")
    bounded = F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-z])"), quoted(term), F.lit("(?![A-Za-z])")), safe)
    return F.when((term == "") | (by == ""), text).when(term.rlike("[A-Za-z]"), bounded).otherwise(F.replace(text, term, by))


def clean_term(x: Column) -> Column:
    """Straight quotes, single spaces, no punctuation at the ends and no possessive; then curly quotes."""
    t = F.btrim(F.regexp_replace(F.translate(x, "’", "'"), f"{WS}+", " "), F.lit(TERM_EDGES))
    return F.translate(F.regexp_replace(t, "'s$", ""), "'", "’")


def term_context(text: Column, term: Column, limit: int = 160) -> Column:
    """60 characters before and 90 after a term's first occurrence, any case, with dots where cut."""
    t = squeeze(text)
    pos = F.position(F.lower(term), F.lower(t))
    start = F.greatest(pos - 61, F.lit(0))
    end = F.least(pos - 1 + F.length(term) + 90, F.length(t))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "...").otherwise(""))
    return F.when((term != "") & (pos > 0), cut).otherwise(F.substring(t, F.lit(1), F.lit(limit)))


def count_chars(x: Column, chars: str) -> Column:
    return F.length(x) - F.length(F.translate(x, chars, ""))


def is_external(href: Column) -> Column:
    v = strip(href)
    return (v == "") | F.startswith(v, F.lit("#")) | v.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")


def memory_key(html: Column, text: Column) -> Column:
    """Hash of the white-space-compacted markup, or text where there is none."""
    v = strip(F.coalesce(F.nullif(html, F.lit("")), text, F.lit("")))
    return F.sha2(F.regexp_replace(v, f"{WS}+", " ").cast("binary"), 256)


def without_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


def first_name(label: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(strip(label), F.lit("")), default)


def project_slug(x: Column, default: str = "default") -> Column:
    s = F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9._-]+", "-")
    s = F.substring(F.btrim(s, F.lit(".-_")), F.lit(1), F.lit(80))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def lenient_bool(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y", "locked", "approved")


def clamped(x: Column, low: float, high: float, default: float, kind: str = "int") -> Column:
    """A number from untrusted text, within bounds."""
    return F.least(F.greatest(F.coalesce(x.try_cast(kind), F.lit(default).cast(kind)), F.lit(low).cast(kind)), F.lit(high).cast(kind))
