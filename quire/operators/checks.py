"""Transformed rows held against their sources: identities, order, leftovers and drift."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as t

LATIN = re.compile("[A-Za-z]")

#: What a placeholder looks like.
PLACEHOLDER = (
    r"(?i)第\s*[0-9一二三四五六七八九十百]+\s*段\s*译文|段译文|>\s*译文\s*<|[。！？；：，、]\s*译文\s*[。！？；：，、<]|"
    r"(?<![\p{L}\p{N}_])(?:translated text|translation goes here|placeholder)(?![\p{L}\p{N}_])"
)
#: A run of five or more Latin words, and a word that counts as unchanged.
LONG_RUN = r"[A-Za-z][A-Za-z0-9'’,-]*(?:\s+[A-Za-z][A-Za-z0-9'’,-]*){4,}"
SOURCE_WORD = r"[A-Za-z][A-Za-z'’.-]{3,}"
LONG_WORD = r"[A-Za-z]{4,}"


def identity_issues(source: DataFrame, target: DataFrame, batch: str = "batch", id_: str = "id") -> DataFrame:
    """(batch, rule, row_id) of identities: counts differ; ids empty, repeated, missing or unexpected; order
    changed. Both tables have batch, pos and id."""
    ids = lambda d: d.where(F.col(id_) != "").select(batch, id_).distinct()
    blank = lambda d, rule: d.where(F.col(id_) == "").select(batch, F.lit(rule).alias("rule"), F.lit("").alias("row_id")).distinct()

    def repeated(d: DataFrame, rule: str) -> DataFrame:
        n = d.where(F.col(id_) != "").groupBy(batch, id_).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return n.select(batch, F.lit(rule).alias("rule"), F.col(id_).alias("row_id"))

    def gone(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
        return ids(a).join(ids(b), [batch, id_], "left_anti").select(batch, F.lit(rule).alias("rule"), F.col(id_).alias("row_id"))

    def numbered(d: DataFrame, to: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(batch).orderBy("pos", id_))
        return d.select(batch, place.alias("n"), F.coalesce(F.col(id_), F.lit("")).alias(to))

    both = numbered(source, "a").join(numbered(target, "b"), [batch, "n"], "full").groupBy(batch)
    both = both.agg((F.count("a") != F.count("b")).alias("fewer"), F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("moved"))
    whole = lambda when, rule: both.where(when).select(batch, F.lit(rule).alias("rule"), F.lit("").alias("row_id"))
    out = whole("fewer", "count differs").unionByName(whole("moved", "order changed"))
    for part in (
        blank(source, "source id empty"), blank(target, "target id empty"), repeated(source, "source id repeated"), repeated(target, "target id repeated"),
        gone(source, target, "missing"), gone(target, source, "unexpected"),
    ):
        out = out.unionByName(part)
    return out


def long_leftover(html: Column) -> Column:
    return F.regexp_count(t.without_tags(html), F.lit(LONG_WORD)) > 12


def long_segments(source: Column, target: Column, most: int = 3) -> Column:
    """Runs of Latin words of 28 characters or more that the source has too; the first few, cut at 220."""
    compact = F.lower(F.regexp_replace(source, f"{t.WS}+", " "))
    runs = F.transform(F.regexp_extract_all(target, F.lit(LONG_RUN), F.lit(0)), t.squeeze)
    kept = F.filter(runs, lambda x: (F.length(x) >= 28) & F.contains(compact, F.lower(x)))
    return F.transform(F.slice(kept, 1, most), lambda x: F.substring(x, 1, 220))


def unchanged_words(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Per row the characters of distinct source words (any case, the first form) found in the target."""
    cut = lambda w: F.btrim(w, F.lit(".,;:!?()[]{}"))
    words = pairs.select(*key, "target", F.posexplode(F.transform(F.regexp_extract_all("source", F.lit(SOURCE_WORD), F.lit(0)), cut)).alias("pos", "word"))
    words = words.where(F.length("word") >= 4).withColumn("low", F.lower("word"))
    first = words.withColumn("q", F.row_number().over(Window.partitionBy(*key, "low").orderBy("pos"))).where("q = 1")
    return first.where(t.holds_term(F.col("target"), F.col("word"))).groupBy(*key).agg(F.sum(F.length("word")).alias("unchanged"))


def marks(x: Column) -> Column:
    return F.struct(
        t.count_chars(x, t.QUOTE_MARKS).alias("quotes"), t.count_chars(x, t.OPENING).alias("opening"), t.count_chars(x, t.CLOSING).alias("closing"), t.count_chars(x, t.SENTENCE_MARKS).alias("sentences")
    )


def marks_drift(source: Column, target: Column) -> Column:
    """Whether a kind of mark that the source has occurs another number of times in the target."""
    s, g = marks(source), marks(target)
    out = F.lit(False)
    for k in ("quotes", "opening", "closing", "sentences"):
        out = out | ((s[k] > 0) & (s[k] != g[k]))
    return out


def paired(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source row (batch, id and more) with the transformed row of its id: those without an id, and ids that
    were transformed more than once, are left out, as they are issues of their own."""
    more = [c for c in target.columns if c not in ("batch", "id")]
    one = target.where(F.coalesce("id", F.lit("")) != "").groupBy("batch", "id").agg(F.count(F.lit(1)).alias("q_n"), F.first(F.struct(*more)).alias("q")).where("q_n = 1")
    return source.where(F.coalesce("id", F.lit("")) != "").join(one.select("batch", "id", "q.*"), ["batch", "id"])


#: Letters of terms that one automaton holds: it takes about fifty bytes for each.
TERM_LETTERS = 4_000_000
_automata: dict[str, Any] = {}


def _automaton(name: str, terms: list[str]) -> Any:
    """The automaton of some terms, built once in a worker; that of another part takes its place."""
    if name not in _automata:
        import ahocorasick

        _automata.clear()
        a = ahocorasick.Automaton()
        for x in terms:
            a.add_word(x, (len(x), LATIN.search(x) is not None))
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def found(automaton: Any, text: str) -> set[str]:
    """The terms that occur in a text, under the rule of `holds_term`: those with a Latin letter not beside one."""
    out = set()
    for end, (n, bounded) in automaton.iter(text):
        start = end - n + 1
        if not (bounded and (start and LATIN.match(text[start - 1]) or end + 1 < len(text) and LATIN.match(text[end + 1]))):
            out.add(text[start : end + 1])
    return out


def term_hits(rows: DataFrame, terms: DataFrame, text: str, key: list[str]) -> DataFrame:
    """(key, term): which terms (source) occur in which rows. Every text is gone through once, by an automaton of all terms
    that each worker builds; terms of more than TERM_LETTERS letters in all are cut by hash into parts of that size, and texts
    are gone through once a part. Nothing is joined, so neither a frequent word nor the number of terms makes tasks uneven."""
    spark = rows.sparkSession
    terms = terms.where("source <> ''").select("source").distinct()
    letters = terms.agg(F.sum(F.length("source"))).first()[0] or 0
    parts = max(1, -(-letters // TERM_LETTERS))
    x = rows.select(*key, F.coalesce(F.col(text), F.lit("")).alias("q_text"))
    schema = T.StructType([*[x.schema[k] for k in key], T.StructField("term", T.StringType())])
    out = spark.createDataFrame([], schema)
    for i in range(parts):
        held = terms if parts == 1 else terms.where(F.pmod(F.xxhash64("source"), F.lit(parts)) == i)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [r["source"] for r in held.toLocalIterator()]))  # at most about TERM_LETTERS

        def search(batches: Iterator[pa.RecordBatch], shared: Any = shared) -> Iterator[pa.RecordBatch]:
            name, listed = shared.value
            if not listed:
                return
            automaton = _automaton(name, listed)
            for b in batches:
                at, hits = [], []
                for j, value in enumerate(b.column(len(key)).to_pylist()):
                    new = found(automaton, value)
                    at += [j] * len(new)
                    hits += new
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(take) for c in range(len(key))], pa.array(hits, pa.string())], [*key, "term"])

        more = x.mapInArrow(search, schema)
        out = more if i == 0 else out.unionByName(more)
    return out


def roll_up(issues: DataFrame, rows: DataFrame, chapter: str, most: int = 10) -> DataFrame:
    """The chapters with most blocking issues, then issues, then rows; ties by name."""
    n = issues.groupBy(chapter).agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "blocking").alias("blocking"))
    out = rows.groupBy(chapter).agg(F.count(F.lit(1)).alias("rows")).join(n, chapter, "left").na.fill(0, ["issues", "blocking"])
    return out.where("issues > 0").orderBy(F.desc("blocking"), F.desc("issues"), F.desc("rows"), chapter).limit(most)
