"""Registered queries of reports, audits, glossaries, memories, jobs and plans, each with its SQL.

As in `queries`, the driver's tables stand in for the engine's: conversations for transformed rows (a user's turn
is a source, the answer its target), pages for the files of one book, events for jobs' logs, customers and orders
for curated and imported terms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as t
from quire.operators import audit, batches, checks, jobs, memory, reports, terms, usage
from quire.session import bounded, hadoop, shared_dir, written
from quire.sources import books, formats, html, records, versions
from quire.streaming import events

from .oracles import ORACLES as _ORACLES
from .oracles import _CURATED, _EDGES, _LINE_ROWS, _LINES, _MARKS, _MASKED, _NAME, _PAIRS, _PATH, _PROSE, _V, _noise, _packed
from .tables import curated, imported, lines, pairs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: A preset as a book's owner would write it: known terms, and words that tell families of terms.
PRESET = {
    "translations": {"of the": "genitive", "and the": "addition", "The": "article"}, "title_words": ["De", "Los"], "place_words": ["La", "Le"], "org_words": ["Und"], "creature_words": ["there", "heren"],
}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.col("conv_id").alias("batch"), F.col("turn").cast("string").alias("row_id"), "source", "target")


def _persons(spark: SparkSession, d: str) -> DataFrame:
    """The frequent names of the sources, every third without a translation; aliases are first words."""
    found = terms.mentions(pairs(spark, d).select("conv_id", "source"), "conv_id", F.col("source"), terms.NAME)
    names = found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    alias = F.when(F.contains("term", F.lit(" ")), F.array(F.split_part("term", F.lit(" "), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return names.select("term", F.when(F.length("term") % 3 > 0, F.upper("term")).otherwise("").alias("translation"), alias.alias("aliases"))


_NAME_SQL = _NAME.replace("'", "''")
_CLEAN = f"replace(regexp_replace(trim(regexp_replace(replace(raw, '’', ''''), '\\s+', ' ', 'g'), {_EDGES}), '''s$', ''), '''', '’')"
_NAMES = f"""names AS (SELECT term, CASE WHEN length(term) % 3 > 0 THEN upper(term) ELSE '' END AS translation, CASE WHEN contains(term, ' ') THEN [term, split_part(term, ' ', 1)] ELSE [term] END AS forms
    FROM (SELECT {_CLEAN} AS term FROM (SELECT unnest(regexp_extract_all({_MASKED.replace('text', 'source', 1)}, '{_NAME_SQL}')) AS raw FROM pairs)) WHERE NOT {_noise("term")} GROUP BY term HAVING count(*) >= 2)"""
_HOLDS = lambda text, form: f"(CASE WHEN {form} = '' THEN false WHEN regexp_matches({form}, '[A-Za-z]') THEN regexp_matches({text}, '(^|[^A-Za-z])' || regexp_escape({form}) || '($|[^A-Za-z])') ELSE contains({text}, {form}) END)"
_USED = f"""used AS (SELECT conv_id AS batch, turn::VARCHAR AS row_id, term, translation, bool_or({_HOLDS("target", "form")}) AS in_target, translation <> '' AND contains(target, translation) AS translated
    FROM (SELECT *, unnest(forms) AS form FROM names), pairs WHERE true GROUP BY conv_id, turn, source, target, term, translation HAVING bool_or({_HOLDS("source", "form")}))"""
_BASE = f"WITH {_PAIRS}, {_NAMES}, {_USED}"


@query(
    f"""{_BASE} SELECT batch, row_id, 'untranslated-source-term' AS kind, 'blocking' AS severity, term || ' remains untranslated' AS message FROM used WHERE in_target
    UNION ALL SELECT batch, row_id, 'missing-locked-translation', 'nonblocking', term || ' does not use locked translation ' || translation FROM used WHERE NOT in_target AND NOT translated AND translation <> ''"""
)
def glossary_issues(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources that answers keep, or whose translation they lack."""
    return reports.term_issues(_rows(spark, d), _persons(spark, d)).drop("details")


@query(
    f"""{_BASE} SELECT batch, row_id, term AS source, translation, 'Person name ' || term || ' is present in source but neither source nor translation appears in output' AS message
    FROM used WHERE translation <> '' AND NOT in_target AND NOT translated"""
)
def person_drift(spark: SparkSession, d: str) -> DataFrame:
    x = reports.person_drift(_rows(spark, d), _persons(spark, d))
    return x.select("batch", "row_id", F.col("details")["source"].alias("source"), F.col("details")["translation"].alias("translation"), "message")


_COUNT = lambda column, chars: f"(length({column}) - length(translate({column}, '{chars}', '')))"
_DRIFT = " OR ".join(f"({_COUNT('source', m)} > 0 AND {_COUNT('source', m)} <> {_COUNT('target', m)})" for m in _MARKS.values())
_RUN = r"[A-Za-z][A-Za-z0-9''’,-]*(?:\s+[A-Za-z][A-Za-z0-9''’,-]*){4,}"
_ISSUES = rf"""seg AS (SELECT conv_id AS batch, turn::VARCHAR AS row_id, unnest(list_filter(list_transform(regexp_extract_all(target, '{_RUN}'), lambda r: trim(regexp_replace(r, '\s+', ' ', 'g'))),
        lambda r: length(r) >= 28 AND contains(lower(regexp_replace(source, '\s+', ' ', 'g')), lower(r)))[1:3]) AS sample FROM pairs),
    issues AS (SELECT batch, row_id, 'long-untranslated-segment' AS kind, 'blocking' AS severity FROM seg
        UNION ALL SELECT conv_id, turn::VARCHAR, 'punctuation-quote-drift', 'nonblocking' FROM pairs WHERE {_DRIFT}
        UNION ALL SELECT batch, row_id, 'person-name-drift', 'nonblocking' FROM used WHERE translation <> '' AND NOT in_target AND NOT translated)"""
_RATIO = r"""w AS (SELECT conv_id, turn, target, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM (SELECT *, regexp_extract_all(source, '[A-Za-z][A-Za-z''’.-]{3,}') AS a FROM pairs)),
    v AS (SELECT *, trim(raw, '.,;:!?()[]{}') AS word FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(word) ORDER BY i) AS r FROM v WHERE length(word) >= 4),
    h AS (SELECT length(word) AS n FROM f WHERE r = 1 AND regexp_matches(target, '(^|[^A-Za-z])' || regexp_escape(word) || '($|[^A-Za-z])'))"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return reports.quality_issues(_rows(spark, d), _persons(spark, d))


@query(f"{_BASE}, {_ISSUES} SELECT batch, row_id, kind, severity FROM issues")
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    """All issues of all kinds, one after another."""
    return _issues(spark, d).select("batch", "row_id", "kind", "severity")


@query(
    rf"""{_BASE}, {_ISSUES}, {_RATIO}, c AS (SELECT 'batch ' || batch AS chapter, count(*) FILTER (severity = 'blocking') AS b, count(*) AS i FROM issues GROUP BY batch),
    n AS (SELECT 'batch ' || conv_id AS chapter, count(*) AS r FROM pairs GROUP BY conv_id)
    SELECT (SELECT count(*) FROM pairs) AS row_count, round((SELECT coalesce(sum(n), 0) FROM h) / (SELECT sum(length(regexp_replace(source, '\s+', '', 'g'))) FROM pairs), 4) AS untranslated_ratio, count(*) AS issue_count,
    count(*) FILTER (severity = 'blocking') AS blocking_count, count(*) FILTER (severity <> 'blocking') AS nonblocking_count, count(DISTINCT batch) AS chapters_with_issues, least(count(*), 200) AS listed,
    least(count(*) FILTER (kind = 'long-untranslated-segment'), 50) AS long_segments, least(count(*) FILTER (kind = 'punctuation-quote-drift'), 50) AS mark_drifts, least(count(*) FILTER (kind = 'person-name-drift'), 50) AS name_drifts,
    (SELECT string_agg(chapter, ',' ORDER BY chapter) FROM (SELECT chapter FROM c JOIN n USING (chapter) ORDER BY b DESC, i DESC, r DESC, chapter LIMIT 10)) AS worst, (SELECT count(*) FROM n) AS chapters,
    (SELECT string_agg(batch || ' ' || row_id || ' ' || kind || ' ' || severity, ';' ORDER BY batch, row_id, kind) FROM (SELECT * FROM issues ORDER BY batch, row_id, kind LIMIT 200)) AS issues,
    (SELECT string_agg(batch || ' ' || row_id, ';' ORDER BY batch, row_id) FROM (SELECT * FROM issues WHERE kind = 'punctuation-quote-drift' ORDER BY batch, row_id LIMIT 50)) AS punctuation_quote_drift FROM issues"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of one row: totals, the ratio of what is untranslated, capped lists, the worst chapters."""
    rows = _rows(spark, d)
    chapters = rows.select("batch", F.lit("").alias("label"), F.lit("").alias("file")).distinct()
    r = reports.quality_report(rows, _issues(spark, d), chapters).withColumn("worst", F.array_join("worst", ","))
    text = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), ";").alias(c)
    shown = {"issues": text("issues", "batch", "row_id", "kind", "severity"), "punctuation_quote_drift": text("punctuation_quote_drift", "batch", "row_id")}
    return r.select(*[shown.get(c, F.col(c)) for c in r.columns if c not in ("long_untranslated_segments", "person_name_drift", "worst_chapters")])


@query(
    f"""{_BASE}, {_ISSUES}, g AS (SELECT batch, row_id, 'untranslated-source-term' AS kind, 'blocking' AS severity FROM used WHERE in_target UNION ALL SELECT batch, row_id, 'missing-locked-translation', 'nonblocking' FROM used WHERE NOT in_target AND NOT translated AND translation <> ''),
    b AS (SELECT (SELECT count(*) FROM g WHERE severity = 'blocking') + (SELECT count(*) FROM issues WHERE severity = 'blocking') AS n),
    l AS ((SELECT 0 AS part, batch, row_id, kind FROM g ORDER BY batch, row_id, kind LIMIT 200) UNION ALL (SELECT 1, batch, row_id, kind FROM issues ORDER BY batch, row_id, kind LIMIT 200))
    SELECT CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, (SELECT count(*) FROM g) + (SELECT count(*) FROM issues) AS detected, 0 AS fixed, (SELECT count(*) FROM g) + least(200, (SELECT count(*) FROM issues)) AS remaining, n AS blocking_remaining,
    (SELECT count(*) FROM g) + (SELECT count(*) FROM issues) - n AS nonblocking_remaining, (SELECT string_agg(batch || ' ' || row_id || ' ' || kind, ';' ORDER BY part, batch, row_id, kind) FROM (SELECT * FROM l ORDER BY part, batch, row_id, kind LIMIT 200)) AS issues FROM b"""
)
def combined_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues of terms and of quality in one report, those of terms first."""
    rows = _rows(spark, d)
    chapters = rows.select("batch", F.lit("").alias("label"), F.lit("").alias("file")).distinct()
    mine = reports.term_issues(rows, _persons(spark, d))
    r = reports.combined_report(mine, reports.quality_report(rows, _issues(spark, d), chapters), mine.count(), 0)
    return r.drop("glossary_issues", "quality").withColumn("issues", F.array_join(F.transform("issues", lambda x: F.concat_ws(" ", x["batch"].cast("string"), x["row_id"], x["kind"])), ";"))


@query(f"""{_BASE} SELECT DISTINCT u.batch, u.row_id, length(p.source) AS chars FROM used u JOIN pairs p ON p.conv_id = u.batch AND p.turn::VARCHAR = u.row_id WHERE in_target""")
def repair_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a repair of terms may change."""
    rows = _rows(spark, d)
    return reports.to_repair(rows, reports.term_issues(rows, _persons(spark, d))).select("batch", "row_id", F.length("source").cast("long").alias("chars"))


_IDS = """s AS (SELECT conv_id AS batch, turn AS pos, turn::VARCHAR AS id FROM conversations WHERE role = 'user'), t AS (SELECT conv_id AS batch, turn AS pos, (turn - 1)::VARCHAR AS id FROM conversations WHERE role = 'assistant'),
    a AS (SELECT batch, list(id ORDER BY pos, id) AS l FROM s GROUP BY batch), b AS (SELECT batch, list(id ORDER BY pos, id) AS l FROM t GROUP BY batch),
    ab AS (SELECT batch, coalesce(a.l, []) AS x, coalesce(b.l, []) AS y FROM a FULL JOIN b USING (batch)),
    issues AS (SELECT batch, 'count differs' AS rule, '' AS row_id FROM ab WHERE len(x) <> len(y) UNION ALL SELECT batch, 'order changed', '' FROM ab WHERE x <> y
        UNION ALL (SELECT batch, 'missing', id FROM (SELECT DISTINCT batch, id FROM s EXCEPT SELECT DISTINCT batch, id FROM t)) UNION ALL (SELECT batch, 'unexpected', id FROM (SELECT DISTINCT batch, id FROM t EXCEPT SELECT DISTINCT batch, id FROM s))
        UNION ALL SELECT batch, 'source id repeated', id FROM s GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT batch, 'target id repeated', id FROM t GROUP BY ALL HAVING count(*) > 1),
    done AS (SELECT DISTINCT batch FROM t), every AS (SELECT DISTINCT conv_id AS batch FROM conversations),
    shown AS (SELECT * FROM issues WHERE batch IN (SELECT batch FROM done) UNION ALL SELECT batch, 'missing output', '' FROM every WHERE batch NOT IN (SELECT batch FROM done))"""


@query(
    f"""WITH {_IDS} SELECT (SELECT count(*) FROM every) AS batch_count, (SELECT count(*) FROM shown) AS issue_count, (SELECT count(*) FROM done WHERE batch NOT IN (SELECT batch FROM issues)) AS completed_without_issues,
    coalesce((SELECT string_agg(rule || ' ' || batch || ' ' || row_id, ';' ORDER BY batch, rule, row_id) FROM (SELECT * FROM shown ORDER BY batch, rule, row_id LIMIT 500)), '') AS issues"""
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as batches, held against their answers: counts, and the first 500 issues."""
    c = table(spark, d, "conversations")
    side = lambda role, back: c.where(F.col("role") == role).select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), (F.col("turn") - back).cast("string").alias("id"))
    source, target = side("user", 0), side("assistant", 1)
    r = reports.validation_report(c.select(F.col("conv_id").alias("batch")).distinct(), target.select("batch").distinct(), checks.identity_issues(source, target))
    return r.withColumn("issues", F.array_join("issues", ";"))


@query(
    f"""WITH {_PAIRS}, s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user')
    SELECT a.conv_id AS batch, a.turn::VARCHAR AS row_id, length(coalesce(s.text, '')) AS source_chars FROM conversations a LEFT JOIN s ON s.conv_id = a.conv_id AND s.r = 1 WHERE a.role = 'assistant'"""
)
def last_source(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the last of their conversation's user turns as source: of repeated ids the last wins."""
    c = table(spark, d, "conversations")
    source = c.where("role = 'user'").select(F.col("conv_id").alias("batch"), F.lit("x").alias("row_id"), F.col("turn").alias("pos"), F.col("text").alias("source"))
    target = c.where("role = 'assistant'").select(F.col("conv_id").alias("batch"), F.lit("x").alias("row_id"), F.col("turn").cast("string").alias("turn"))
    return reports.sourced(target, source).select("batch", F.col("turn").alias("row_id"), F.length("source").cast("long").alias("source_chars"))


_CHUNKS = _packed(_LINE_ROWS, "doc_id", 20, 1500)


@query(
    f"""WITH {_CHUNKS}, m AS (SELECT doc_id, chunk, count(*) AS block_count FROM packed GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk) AS batch FROM m),
    f AS (SELECT *, 'batch_' || lpad(batch::VARCHAR, greatest(3, length(batch::VARCHAR))::INT, '0') || '_' || doc_id || '_' || lpad(chunk::VARCHAR, greatest(2, length(chunk::VARCHAR))::INT, '0') AS name FROM n)
    SELECT doc_id, chunk, block_count, batch, 'batches/' || name || '.jsonl' AS input, 'translated/' || name || '.translated.jsonl' AS output, batch AS parsed FROM f"""
)
def batch_files(spark: SparkSession, d: str) -> DataFrame:
    """Batches numbered over all documents, with their files' names, and the number read back from a name."""
    x = lines(spark, d).withColumn("chars", F.length("piece"))
    m = batches.manifest(batches.packed(x, "doc_id", [F.col("pos")], F.col("chars"), 20, 1500), "doc_id")
    f = batches.files(m, "doc_id", "doc_id")
    return f.select("doc_id", "chunk", "block_count", "batch", "input", "output", batches.number_of(F.col("output")).alias("parsed"))


@query(
    f"""WITH {_LINES}, x AS (SELECT source, length(piece) AS chars FROM lines JOIN documents USING (doc_id)),
    s AS (SELECT source, count(*) AS block_count, sum(chars)::BIGINT AS total_chars, max(chars) AS max_block_chars, quantile_disc(chars, 0.95) AS p95_block_chars, source = 'src3' AS pdf FROM x GROUP BY source),
    p AS (SELECT *, (CASE WHEN pdf THEN 4500 WHEN total_chars > 0 AND total_chars < 40000 AND max_block_chars < 4000 THEN 8000 WHEN total_chars > 800000 OR p95_block_chars > 3000 THEN 5000 ELSE 6000 END)::BIGINT AS batch_chars FROM s),
    o AS (SELECT *, (SELECT count(*) FROM x WHERE x.source = p.source AND x.chars > p.batch_chars) AS oversized FROM p)
    SELECT *, greatest(1, ceil(total_chars / batch_chars))::BIGINT AS estimated_batches, ceil(batch_chars / 4.0)::BIGINT AS tokens_per_batch, CASE WHEN oversized > 0 THEN 'oversized-source-blocks' ELSE '' END AS warnings FROM o"""
)
def preparation_plan(spark: SparkSession, d: str) -> DataFrame:
    """Plans by source, one of which is a PDF, with warnings."""
    docs = table(spark, d, "documents")
    x = lines(spark, d).join(docs.select("doc_id", "source"), "doc_id").withColumn("chars", F.length("piece").cast("long"))
    return batches.profile(x, "source", "chars", F.col("source") == "src3")


# One book: pages are its files; the manifest lists what pages link to; the spine is the pages' order.


def _book(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = table(spark, d, "pages").withColumn("book", F.lit("site")).withColumn("file", F.regexp_replace(html.path(F.col("url")), "^/", ""))
    links = html.links(pages, "page_id", "html").join(pages.select("page_id", "book", "file"), "page_id")
    named = F.regexp_replace(html.path(F.col("href")), "^/", "")
    manifest = links.where(~t.is_external(F.col("href"))).select("book", named.alias("file")).distinct().unionByName(pages.select("book", "file").distinct()).distinct()
    manifest = manifest.select("book", F.col("file").alias("id"), "file", F.when(F.length("file") % 2 == 0, "application/xhtml+xml").otherwise("text/css").alias("media_type"))
    return {
        "manifest": manifest, "spine": pages.select("book", F.col("page_id").alias("pos"), F.col("file").alias("idref")), "files": pages.select("book", "file").distinct(),
        "ids": html.ids(pages, "page_id", "html").join(pages.select("page_id", "book", "file"), "page_id").select("book", "file", "id"),
        "references": links.select("book", "file", F.lit("href").alias("kind"), F.regexp_replace("href", "^/", "").alias("value")),
        "targets": pages.where(F.contains("url", F.lit("#"))).select("book", F.col("url").alias("src"), "file", F.regexp_replace("url", "^[^#]*#", "").alias("anchor")),
        "points": pages.select("book"),
    }


_P = f"regexp_replace({_PATH('url')}, '^/', '')"
_BOOK = rf"""pg AS (SELECT *, {_P} AS file FROM pages), l AS (SELECT page_id, file, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1)) AS href FROM pg),
    r AS (SELECT file, regexp_replace(href, '^/', '') AS value, (trim(href) = '' OR trim(href) LIKE '#%' OR regexp_matches(trim(href), '^[a-zA-Z][a-zA-Z0-9+.-]*:')) AS ext, regexp_replace({_PATH('href')}, '^/', '') AS named FROM l),
    x AS (SELECT *, (trim(value) = '' OR trim(value) LIKE '#%' OR regexp_matches(trim(value), '^[a-zA-Z][a-zA-Z0-9+.-]*:')) AS external FROM r),
    manifest AS (SELECT DISTINCT named AS file FROM r WHERE NOT ext UNION SELECT DISTINCT file FROM pg),
    ids AS (SELECT DISTINCT file, id FROM (SELECT file, unnest(regexp_extract_all(html, '(?i)\sid\s*=\s*"([^"]+)"', 1)) AS id FROM pg)),
    dirs AS (SELECT *, regexp_replace(file, '[^/]*$', '') || regexp_replace(value, '#.*$', '') AS target FROM x)"""


@query(f"WITH {_BOOK} SELECT file FROM manifest WHERE file NOT IN (SELECT file FROM pg)")
def manifest_missing(spark: SparkSession, d: str) -> DataFrame:
    """Items of the manifest that are no files."""
    b = _book(spark, d)
    return audit.missing_files(b["manifest"], b["files"]).select("file")


@query(f"WITH {_BOOK} SELECT page_id AS pos, file FROM pg WHERE length(file) % 2 = 0")
def spine_documents(spark: SparkSession, d: str) -> DataFrame:
    """The spine's entries that the manifest has as chapters."""
    b = _book(spark, d)
    return audit.spine_chapters(b["spine"], b["manifest"]).select("pos", "file")


# Books of ten pages each: packaged, read back, changed and audited.


def _bound(spark: SparkSession, d: str) -> DataFrame:
    """Books (path, content) of the pages: headings and paragraphs with ids, a link to the next page's third paragraph and
    one to the outside, and a page list that names one paragraph of each page, be it there or not."""
    text = lambda x: F.replace(F.replace(x, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    k = F.col("page_id")
    chapters = table(spark, d, "pages").select(
        F.concat(F.lit("book-"), F.floor(k / 10)).alias("book"), k.alias("pos"), F.concat(F.lit("p"), k, F.lit(".xhtml")).alias("file"), t.squeeze(text(F.regexp_extract("html", "<h1>([^<]*)", 1))).alias("title"),
        F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), text).alias("paragraphs"), F.array(F.concat(F.lit("p"), k + 1, F.lit(".xhtml#p3")), F.lit("https://example.com/")).alias("links"), F.array(F.concat(F.lit("p"), k * 7 % 20 + 1)).alias("targets"),
    )
    return written(books.bound(chapters), "books")


_TEXT = lambda x: f"""replace(replace({x}, '&quot;', '"'), '&amp;', '&')"""
_BOUND = rf"""ch AS (SELECT 'book-' || (page_id // 10) AS book, page_id, 'p' || page_id || '.xhtml' AS file, trim(regexp_replace({_TEXT("regexp_extract(html, '<h1>([^<]*)', 1)")}, '\s+', ' ', 'g')) AS title, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pages),
    pieces AS (SELECT book, page_id, file, title, 0 AS n, 'h1' AS tag, title AS piece FROM ch UNION ALL SELECT book, page_id, file, title, generate_subscripts(ps, 1), 'p', {_TEXT("unnest(ps)")} FROM ch),
    vs AS (SELECT *, {_V} FROM pieces), bl AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n) AS seq FROM vs WHERE {_PROSE}),
    ord AS (SELECT page_id, row_number() OVER (PARTITION BY book ORDER BY page_id) AS "order" FROM ch)"""


@query(f"""WITH {_BOUND} SELECT book, "order", file, title AS label, seq, tag, length(v) AS chars, length(v) + 2 AS after FROM bl JOIN ord USING (page_id)""")
def book_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of packaged books, and what is read of them after each was replaced by a longer one."""
    bound = _bound(spark, d)
    found = written(books.blocks_in(bound), "blocks")
    longer = found.select("book", F.format_string("%s::%04d", "file", "seq").alias("id"), F.regexp_replace("html", "</([a-z0-9]+)>$", " +</$1>").alias("html"))
    after = books.blocks_in(books.applied_in(bound, longer)).select("book", "file", "seq", F.length("text").cast("long").alias("after"))
    x = found.select("book", F.col("order").cast("long").alias("order"), "file", "label", "seq", "tag", F.length("text").cast("long").alias("chars")).join(after, ["book", "file", "seq"])
    return x.withColumn("seq", F.col("seq").cast("long"))


@query(
    f"""WITH {_BOUND}, r AS (SELECT book, seq % 6 AS k FROM bl), f AS (SELECT book, 'empty' AS rule FROM r WHERE k = 0 UNION ALL SELECT book, unnest(['root tag', 'structure']) FROM r WHERE k = 2
    UNION ALL SELECT book, unnest(['root attribute', 'structure']) FROM r WHERE k = 3 UNION ALL SELECT book, 'unparsable' FROM r WHERE k = 4) SELECT book, rule, count(*) AS n FROM f GROUP BY ALL"""
)
def book_findings(spark: SparkSession, d: str) -> DataFrame:
    """Structural findings of blocks that came back empty, with another tag, without their id, or cut."""
    found, k = books.blocks_in(_bound(spark, d)), F.col("seq") % 6
    cut = F.expr("substring(html, 1, length(html) - 1)")
    new = F.when(k == 0, "").when(k == 2, F.regexp_replace("html", "^<[a-z0-9]+|[a-z0-9]+>$", "")).when(k == 3, F.regexp_replace("html", ' id="[^"]*"', "")).when(k == 4, cut).otherwise(F.col("html"))
    new = F.when(k == 2, F.concat(F.lit("<div"), new, F.lit("div>"))).otherwise(new)
    pairs_ = found.select("book", F.concat_ws("|", "book", "file", "seq").alias("id"), F.col("html").alias("source_html"), new.alias("translated_html"))
    return markup.validated(pairs_).groupBy(F.split_part("id", F.lit("|"), F.lit(1)).alias("book"), "rule").agg(F.count(F.lit(1)).alias("n"))


def _book_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The page targets and the ids of the packaged books."""
    x = written(books.parts_in(_bound(spark, d)), "parts")
    return x.where("part = 'target'").select("book", F.col("value").alias("src"), "file", F.col("id").alias("anchor")), x.where("part = 'id'").select("book", "file", "id")


@query(f"WITH {_BOUND} SELECT file || '#p' || (page_id * 7 % 20 + 1) AS src FROM ch WHERE page_id * 7 % 20 + 1 > len(ps)")
def page_target_missing(spark: SparkSession, d: str) -> DataFrame:
    """Page targets whose anchor is not in their file."""
    targets, ids = _book_parts(spark, d)
    return audit.missing_anchors(targets, ids).select("src")


@query(f"WITH {_BOUND} SELECT file, len(ps) + 1 AS ids FROM ch")
def id_index(spark: SparkSession, d: str) -> DataFrame:
    """How many ids each file has."""
    return _book_parts(spark, d)[1].groupBy("file").agg(F.countDistinct("id").alias("ids"))


@query(
    f"""WITH {_BOUND}, x AS (SELECT c.book, c.page_id * 7 % 20 + 1 > len(c.ps) AS lost, CASE WHEN n.file IS NULL OR len(n.ps) < 3 THEN 1 ELSE 0 END AS broken FROM ch c LEFT JOIN ch n ON n.book = c.book AND n.file = 'p' || (c.page_id + 1) || '.xhtml')
    SELECT book, count(*) + 1 AS manifest_count, count(*) AS spine_count, count(*) AS ncx_navpoints, count(*) AS ncx_page_targets, count(*) AS external_links, count(*) FILTER (lost) AS missing_page_anchors, sum(broken)::BIGINT AS broken_internal_links, (count(*) FILTER (lost) + sum(broken))::BIGINT AS issue_count FROM x GROUP BY book"""
)
def book_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit reports of the packaged books, as numbers."""
    r = books.audited_in(_bound(spark, d))
    return r.select("book", "manifest_count", "spine_count", "ncx_navpoints", "ncx_page_targets", "external_links", *[F.size(c).cast("long").alias(c) for c in ("missing_page_anchors", "broken_internal_links")], F.col("issue_count").cast("long").alias("issue_count"))


@query(
    f"""WITH {_BOOK}, f AS (SELECT 'missing_manifest_item' AS finding, file AS value, 1 AS n FROM manifest WHERE file NOT IN (SELECT file FROM pg)
    UNION ALL SELECT 'missing_page_anchor', url, 1 FROM pg WHERE contains(url, '#') AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.file = pg.file AND ids.id = regexp_replace(url, '^[^#]*#', ''))
    UNION ALL SELECT 'broken_internal_link', file || ': missing href ' || value, 1 FROM dirs WHERE NOT external AND target <> '' AND target NOT IN (SELECT file FROM pg)
    UNION ALL SELECT 'broken_internal_link', file || ': missing anchor ' || value, 1 FROM dirs WHERE NOT external AND target <> '' AND target IN (SELECT file FROM pg) AND contains(value, '#')
        AND regexp_replace(value, '^[^#]*#', '') <> '' AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.file = dirs.target AND ids.id = regexp_replace(value, '^[^#]*#', '')))
    SELECT finding, value, sum(n)::BIGINT AS n FROM f GROUP BY finding, value"""
)
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    """Everything that is wrong with the book, each once, with how often it occurs."""
    b = _book(spark, d)
    return audit.findings(b["manifest"], b["files"], b["ids"], b["references"], b["targets"]).drop("book")


@query(
    f"""WITH {_BOOK} SELECT (SELECT count(*) FROM manifest) AS manifest_count, (SELECT count(*) FROM pg) AS spine_count, (SELECT count(*) FROM pg WHERE length(file) % 2 = 0) AS spine_xhtml_count, (SELECT count(*) FROM pg) AS ncx_navpoints,
    (SELECT count(*) FROM pg WHERE contains(url, '#')) AS ncx_page_targets, (SELECT count(*) FROM x WHERE external AND value <> '') AS external_links,
    (SELECT count(DISTINCT file) FROM pg WHERE regexp_matches(file, '(?i)\\.(jpg|jpeg|png|gif|webp|svg)$')) AS image_count"""
)
def audit_counters(spark: SparkSession, d: str) -> DataFrame:
    b = _book(spark, d)
    return audit.counters(b["manifest"], b["spine"], b["files"], b["references"], b["targets"], b["points"]).drop("book")


# Glossaries: presets, searches, drafts.

_KNOWN = "(VALUES ('of the', 0), ('and the', 1)) AS k(source, pos)"
_LOW = r"\b[a-z][a-z]{4,}(?:-[a-z]{3,})?\b"
_PRESET_NOISE = f"(term = '' OR (term NOT IN ('of the', 'and the', 'The') AND {_noise('term')}))"
_WORDS = "string_split(term, ' ')"
_FAMILY = rf"""CASE WHEN lower(term) IN ('there', 'heren') OR len(list_filter({_WORDS}, lambda w: lower(w) IN ('there', 'heren'))) > 0 THEN 'creature' WHEN len(list_filter({_WORDS}, lambda w: w IN ('De', 'Los'))) > 0 THEN 'title'
    WHEN len({_WORDS}) > 1 AND len(list_filter({_WORDS}, lambda w: w = 'Und')) > 0 THEN 'organization' WHEN len(list_filter({_WORDS}, lambda w: w IN ('La', 'Le'))) > 0 THEN 'place' WHEN regexp_matches(substr(term, 1, 1), '\p{{Lu}}') THEN 'person' ELSE 'special' END"""


@query(
    rf"""WITH a AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), found AS (SELECT id, 0 AS emitter, pos, source AS term FROM a, {_KNOWN} WHERE {_HOLDS("text", "source")}
    UNION ALL SELECT id, 1, pos, term FROM (SELECT id, pos, {_CLEAN} AS term FROM (SELECT id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS raw FROM (SELECT id, regexp_extract_all({_MASKED}, '{_NAME_SQL}') AS m FROM a))) WHERE NOT {_PRESET_NOISE}
    UNION ALL SELECT id, 2, pos, term FROM (SELECT id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS term FROM (SELECT id, regexp_extract_all({_MASKED}, '{_LOW}') AS m FROM a)) WHERE term IN ('there', 'heren')),
    c AS (SELECT term, count(*) AS frequency, min((id, emitter, pos)) AS first FROM found GROUP BY term), r AS (SELECT * FROM c WHERE frequency >= 2 OR term IN ('of the', 'and the', 'The') ORDER BY frequency DESC, first LIMIT 240),
    k AS (SELECT *, {_FAMILY} AS type, CASE term WHEN 'of the' THEN 'genitive' WHEN 'and the' THEN 'addition' WHEN 'The' THEN 'article' ELSE '' END AS translation FROM r),
    f AS (SELECT *, (CASE WHEN translation <> '' THEN 0.95 WHEN type IN ('place', 'organization', 'title') AND contains(term, ' ') AND frequency >= 5 THEN 0.74 WHEN type = 'creature' AND frequency >= 3 THEN 0.7
        WHEN type = 'person' AND contains(term, ' ') AND frequency >= 3 THEN 0.68 WHEN type IN ('person', 'place') THEN 0.58 ELSE 0.45 END)::DOUBLE AS confidence FROM k WHERE NOT {_noise("term")})
    SELECT term, translation, type, frequency, CASE WHEN translation <> '' THEN 'approved' ELSE 'pending' END AS status, confidence, translation <> '' AS locked FROM f"""
)
def preset_glossary(spark: SparkSession, d: str) -> DataFrame:
    """The glossary of conversations with a preset: three emitters, families, confidence, translations."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return terms.glossary(c, "id", "text", terms.preset(PRESET))


@query(f"""WITH {_CURATED} SELECT count(*) AS total, count(*) FILTER (status <> 'ignored' AND (status = 'approved' OR locked)) AS approved, count(*) FILTER (status = 'pending' AND NOT locked) AS pending,
    count(*) FILTER (status = 'pending' AND NOT locked AND translation = '') AS empty, count(*) FILTER (status = 'ignored') AS ignored FROM curated""")
def glossary_states(spark: SparkSession, d: str) -> DataFrame:
    return terms.exclusive_summary(curated(spark, d))


@query(f"WITH {_CURATED} SELECT source, translation, status FROM curated WHERE contains(lower(source || ' ' || translation || ' ' || status), 'mach') AND status = 'pending'")
def glossary_search(spark: SparkSession, d: str) -> DataFrame:
    return terms.searched(curated(spark, d), "MACH", status="pending").select("source", "translation", "status")


@query(f"WITH {_CURATED} SELECT source, status FROM curated ORDER BY pos LIMIT 25 OFFSET 50")
def glossary_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25 terms."""
    return jobs.page(curated(spark, d), [F.col("pos")], 3).select("source", "status")


_OPEN = f"WITH {_CURATED}, o AS (SELECT *, translation = '' OR c % 2 = 0 AS blank FROM (SELECT *, pos AS c FROM curated))"


def _open_terms(spark: SparkSession, d: str) -> DataFrame:
    """Curated terms, of which every second has lost its translation."""
    return curated(spark, d).withColumn("translation", F.when(F.col("pos") % 2 == 0, "").otherwise(F.col("translation")))


@query(f'{_OPEN} SELECT source, (row_number() OVER (ORDER BY pos) - 1) // 40 AS "group" FROM o WHERE status = \'pending\' AND blank')
def autofill_groups(spark: SparkSession, d: str) -> DataFrame:
    """Pending terms without translations, forty a request."""
    return terms.to_fill(_open_terms(spark, d), "pos").select("source", "group")


@query(
    f"""{_OPEN}, dr AS (SELECT source, min(p) AS draft FROM (SELECT c_name AS source, lower(o_orderpriority) AS p, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) WHERE o_totalprice > 100000 GROUP BY source)
    SELECT status, count(*) AS terms, count(*) FILTER (status = 'pending' AND blank AND draft IS NOT NULL) AS filled, count(*) FILTER (blank AND (status <> 'pending' OR draft IS NULL)) AS empty FROM o LEFT JOIN dr USING (source) GROUP BY status"""
)
def autofill_filled(spark: SparkSession, d: str) -> DataFrame:
    """How many drafts filled terms, by state."""
    drafts = imported(spark, d).select("source", F.col("translation").alias("draft"))
    x = terms.filled(_open_terms(spark, d), drafts)
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("terms"), F.count_if("filled").alias("filled"), F.count_if(F.col("translation") == "").alias("empty"))


# Memories.


def _entries(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select(
        F.lit(None).cast("string").alias("source_hash"), F.col("source").alias("source_text"), F.lit("").alias("source_html"), F.when(F.col("turn") % 4 == 0, F.col("target")).otherwise(" ").alias("translated_html"),
        F.lit(None).cast("string").alias("target_language"), F.lit(None).cast("string").alias("source_project"), F.lit(None).cast("double").alias("confidence"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


def _memory(spark: SparkSession, d: str) -> DataFrame:
    """A memory of the first conversations' user turns, each as its own result."""
    c = table(spark, d, "conversations").where("role = 'user' AND conv_id % 3 = 0")
    m = c.select(t.memory_key(F.lit(""), F.col("text")).alias("source_hash"), F.col("text").alias("source_text"), F.lit("").alias("source_html"), F.lit("old").alias("translated_html"), F.lit("en").alias("target_language"),
                 F.lit("p").alias("source_project"), F.lit(0.5).alias("confidence"), F.lit(None).cast("timestamp").alias("updated_at"))
    return m.dropDuplicates(["source_hash"])


_KEY = r"sha256(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
_MEMORY = rf"""{_PAIRS}, old AS (SELECT DISTINCT {_KEY.format('text')} AS h FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
    ent AS (SELECT {_KEY.format('source')} AS h, target, conv_id * 1000 + turn AS seq, turn % 4 = 0 AND regexp_replace(target, '\s+', '', 'g') <> '' AS ok FROM pairs), new AS (SELECT h, arg_max(target, seq) AS t FROM ent WHERE ok GROUP BY h)"""


@query(f"WITH {_MEMORY} SELECT (SELECT count(*) FROM ent WHERE ok) AS imported, (SELECT count(*) FROM ent WHERE NOT ok) AS skipped, (SELECT count(*) FROM (SELECT h FROM old UNION SELECT h FROM new)) AS segment_entries, (SELECT count(DISTINCT p) FROM (SELECT 'p' AS p FROM old WHERE h NOT IN (SELECT h FROM new) UNION SELECT 'q' FROM new)) AS projects, 0 AS term_decisions")
def memory_import(spark: SparkSession, d: str) -> DataFrame:
    """What an import adds and skips, and how large the memory is then."""
    after, counts = memory.imported(_memory(spark, d), _entries(spark, d), "q", "fr")
    return counts.crossJoin(memory.stats(after))  # one row by one


@query(f"WITH {_MEMORY} SELECT h AS source_hash, CASE WHEN n.t IS NOT NULL THEN 'fr' ELSE 'en' END AS target_language, CASE WHEN n.t IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence, length(coalesce(n.t, 'old')) AS chars FROM (SELECT h FROM old UNION SELECT h FROM new) LEFT JOIN new n USING (h)")
def memory_after_import(spark: SparkSession, d: str) -> DataFrame:
    after, _ = memory.imported(_memory(spark, d), _entries(spark, d), "q", "fr")
    return after.select("source_hash", "target_language", "confidence", F.length("translated_html").cast("long").alias("chars"))


@query(f"WITH {_MEMORY} SELECT h AS source_hash, CASE WHEN n.t IS NOT NULL THEN 'fr' ELSE 'en' END AS target_language, length(coalesce(n.t, 'old')) AS chars, CASE WHEN n.t IS NOT NULL THEN 2 ELSE 1 END AS since, 2 AS versions FROM (SELECT h FROM old UNION SELECT h FROM new) LEFT JOIN new n USING (h)")
def memory_kept(spark: SparkSession, d: str) -> DataFrame:
    """A memory kept in the shared folder: filled, changed by an import, and told the same again, which makes no version; its
    entries with the version that each is of."""
    path = f"{shared_dir(spark)}/memory-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    memory.remember(spark, path, _memory(spark, d).withColumn("seq", F.lit(0)))
    memory.take_in(spark, path, _entries(spark, d), "q", "fr")
    memory.remember(spark, path, memory.stored(spark, path).withColumn("seq", F.lit(0)))
    now, first = memory.stored(spark, path), memory.stored(spark, path, 1)
    x = now.join(first.select("source_hash", *[F.col(c).alias(f"old_{c}") for c in memory.FIELDS]), "source_hash", "left")
    same = F.lit(True)
    for c in memory.FIELDS:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    last = versions.versions(spark, path)[-1]
    return x.select("source_hash", "target_language", F.length("translated_html").cast("long").alias("chars"), F.when(same, 1).otherwise(last).alias("since"), F.lit(last).alias("versions"))


@query(
    """WITH s AS (SELECT conv_id * 1000 + turn AS pos, conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id * 1000 + turn - 1 AS pos, text FROM conversations WHERE role = 'assistant')
    SELECT s.pos, CASE WHEN a.text IS NOT NULL AND s.conv_id % 2 = 0 THEN 'service' WHEN s.turn % 4 = 0 THEN 'memory' END AS origin,
    coalesce(length(CASE WHEN a.text IS NOT NULL AND s.conv_id % 2 = 0 THEN a.text WHEN s.turn % 4 = 0 THEN 'kept' END), -1) AS chars FROM s LEFT JOIN a USING (pos)"""
)
def memory_realigned(spark: SparkSession, d: str) -> DataFrame:
    """Results of a memory and a service put back into the sources' order; the service's count."""
    c = table(spark, d, "conversations")
    key = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    source = c.where("role = 'user'").select(key.alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    remembered = c.where("role = 'user' AND turn % 4 = 0").select(key.alias("id"), F.lit("kept").alias("translated_html"))
    provided = c.where("role = 'assistant' AND conv_id % 2 = 0").select((F.col("conv_id") * 1000 + F.col("turn") - 1).cast("string").alias("id"), F.col("text").alias("translated_html"))
    return memory.realigned(source, remembered, provided).select("pos", "origin", F.coalesce(F.length("translated_html"), F.lit(-1)).cast("long").alias("chars"))


# Jobs: an event's user is its job.

_KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'batch-started' WHEN 'click' THEN 'batch-completed' WHEN 'error' THEN 'batch-failed' WHEN 'purchase' THEN 'completed' ELSE 'packaging' END"


def kind_of(e: Column) -> Column:
    return F.when(e == "signup", "created").when(e == "view", "batch-started").when(e == "click", "batch-completed").when(e == "error", "batch-failed").when(e == "purchase", "completed").otherwise("packaging")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("job"), "event_id", (F.col("event_id") % 7).alias("batch"), kind_of(F.col("event_type")).alias("type"))


_LOG = f"log AS (SELECT user_id AS job, event_id, event_id % 7 AS batch, {_KIND} AS type FROM events)"
_AFTER = "CASE type WHEN 'created' THEN 'preparing' WHEN 'batch-started' THEN 'running' WHEN 'completed' THEN 'completed' END"


@query(
    f"""WITH {_LOG}, x AS (SELECT *, {_AFTER} AS after FROM log) SELECT job, coalesce(arg_max(after, event_id) FILTER (after IS NOT NULL), 'preparing') AS status, count(*) AS events,
    CASE WHEN arg_max(type, event_id) = 'packaging' THEN 'package' ELSE 'translate' END AS stage FROM x GROUP BY job"""
)
def job_status(spark: SparkSession, d: str) -> DataFrame:
    """Each job's status as its events leave it, and the stage it is in."""
    return jobs.folded_status(_log(spark, d), "job", "event_id", "type")


def _streamed(spark: SparkSession, d: str, run: Callable[[DataFrame, str, str], None]) -> str:
    """run(stream, late, folder): the events as a stream that waits for any of them (late: as long as the log is), and then
    again when one of a job of its own has come long after, which tells that the log has gone on. It comes last as a stream
    takes some files at a time: beside the first of them it would make all others late. Gives the folder for what is written."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    fs.mkdirs(hadoop(spark, f"{path}/later")[0])
    e = table(spark, d, "events")
    late = e.agg(F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))).first()[0] or 0
    late = f"{max(late + 1, 60 * 86_400)} seconds"
    stream = events.log(spark, f"{d}/events.parque[t]").unionByName(events.log(spark, f"{path}/later"))
    run(stream, late, path)
    later = e.agg(F.max("event_id") + 1, F.max("ts") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 DAY"), F.max("user_id") + 1).toDF("event_id", "ts", "user_id")
    later.select("event_id", "ts", "user_id", F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")).write.mode("append").parquet(f"{path}/later")
    run(stream, late, path)
    return path


@query(f"""WITH {_LOG}, x AS (SELECT *, {_AFTER} AS after FROM log) SELECT job, coalesce(arg_max(after, event_id) FILTER (after IS NOT NULL), 'preparing') AS status, count(*) AS events,
    CASE WHEN arg_max(type, event_id) = 'packaging' THEN 'package' ELSE 'translate' END AS stage, max(event_id) AS last_event, array_to_string(list_sort(list(event_id))[-5:], ',') AS tail FROM x GROUP BY job""")
def stream_job_status(spark: SparkSession, d: str) -> DataFrame:
    """Jobs' states as a stream folds them from the log, with their last five events."""

    def run(stream: DataFrame, late: str, path: str) -> None:
        log = stream.select("user_id", "event_id", "ts", kind_of(F.col("event_type")).alias("type"))
        events.gathered(events.statuses(log, "user_id", "event_id", "type", most=5, late=late), f"{path}/out", f"{path}/checkpoint")

    path = _streamed(spark, d, run)
    x = spark.read.parquet(f"{path}/out").groupBy("job").agg(F.max_by(F.struct("status", "events", "stage", "last_event", "tail"), "events").alias("s"))
    x = x.select("job", "s.*").withColumn("tail", F.array_join(F.transform("tail", lambda e: e.cast("string")), ","))
    return x.join(table(spark, d, "events").select(F.col("user_id").alias("job")).distinct(), "job", "left_semi")


@query(_ORACLES["rate_limit_windows"])
def stream_rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """The delays of rate_limit_windows, by a stream that keeps what it needs of each job in state."""
    path = _streamed(spark, d, lambda stream, late, path: events.written(events.limited(stream, 2, 40, 21600, late=late), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.schema(events.LIMITED).parquet(f"{path}/out").select("event_id", "delay")


@query(
    f"""WITH {_LOG}, s AS (SELECT job, batch, max(event_id) FILTER (type = 'batch-started') AS since, max(event_id) FILTER (type IN ('batch-completed', 'batch-failed')) AS ended FROM log GROUP BY ALL),
    o AS (SELECT job, max(event_id) AS over FROM log WHERE type = 'completed' GROUP BY job), f AS (SELECT job, batch, since FROM s LEFT JOIN o USING (job) WHERE since IS NOT NULL AND (ended IS NULL OR ended < since) AND (over IS NULL OR over < since))
    SELECT *, row_number() OVER (PARTITION BY job ORDER BY since, batch) = 1 AS current FROM f"""
)
def batches_in_flight(spark: SparkSession, d: str) -> DataFrame:
    return jobs.in_flight(_log(spark, d), "job", "batch", "event_id", "type")


@query(f"WITH {_LOG}, o AS (SELECT job, max(event_id) AS over FROM log WHERE type = 'completed' GROUP BY job) SELECT job, batch, min(event_id) AS at FROM log LEFT JOIN o USING (job) WHERE type = 'batch-failed' AND (over IS NULL OR over < event_id) GROUP BY job, batch")
def batches_failed(spark: SparkSession, d: str) -> DataFrame:
    return jobs.failed_batches(_log(spark, d), "job", "batch", "event_id", "type")


_STATES = """states AS (SELECT c_name AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'preparing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS filename,
    c_acctbal::BIGINT AS completed, 'key' || c_custkey AS api_key, c_custkey AS active FROM customer)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    return table(spark, d, "customer").select(
        F.col("c_name").alias("job_id"), F.when(k == 0, "running").when(k == 1, "preparing").when(k == 2, "completed").otherwise("failed").alias("status"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("filename"), F.lit("en").alias("target_language"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("title"),
        F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("key"), F.col("c_custkey").cast("string"))).alias("api_key"), F.lit("/jobs").alias("work_dir"), F.col("c_custkey").alias("last_active_at"),
    )


@query(f"WITH {_STATES} SELECT job_id, CASE WHEN status IN ('running', 'preparing') THEN 'failed' ELSE status END AS status, status IN ('running', 'preparing') AS interrupted, '' AS title FROM states WHERE filename IS NOT NULL")
def jobs_restored(spark: SparkSession, d: str) -> DataFrame:
    """States after a restart: unusable ones left out, interrupted ones failed, gaps filled."""
    return jobs.restored(_states(spark, d)).select("job_id", "status", "interrupted", "title")


@query(f"WITH {_STATES} SELECT job_id, status, active AS last_active_at, active % 3 > 0 AS has_api_key FROM states ORDER BY active DESC, job_id DESC LIMIT 30")
def jobs_public(spark: SparkSession, d: str) -> DataFrame:
    """The thirty jobs active last, without secrets and paths."""
    return jobs.public(jobs.by_activity(_states(spark, d), "last_active_at", "job_id", 30)).select("job_id", "status", "last_active_at", "has_api_key")


@query(
    """SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN 'Gen ' || c_custkey ELSE ' ' END, ' '),
    c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '（简体中文版）' ELSE ' (French)' END) AS title, CASE WHEN c_custkey % 2 = 0 THEN 'zh' ELSE 'fr' END AS code FROM customer"""
)
def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Titles given, generated, or made from file names and languages; the languages' codes."""
    k = F.col("c_custkey")
    language = F.when(k % 2 == 0, "Simplified Chinese").otherwise("French")
    title = jobs.title(F.when(k % 3 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 1, F.concat(F.lit("Gen "), k.cast("string"))).otherwise(" "), F.concat(F.lit("/books/"), "c_mktsegment", F.lit(".epub")), language)
    return table(spark, d, "customer").select("c_custkey", title.alias("title"), jobs.language_code(language).alias("code"))


# Usage, budgets, plans, formats.


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("n", F.floor("value").cast("long"))
    guess = lambda by: F.when(F.col("event_id") % 3 > 0, F.col("n") * by)
    return e.select(
        "event_type", F.lit(1).alias("requests"), (F.col("n") * 100).alias("prompt_tokens"), (F.col("n") * 30).alias("completion_tokens"), guess(110).alias("estimated_prompt_tokens"), guess(40).alias("estimated_completion_tokens"),
        F.col("user_id"), "event_id",
    )


_COST = lambda p, c: f"round((greatest(0, {p}) * 0.5 + greatest(0, {c}) * 1.5) / 1000000, 6)"
_CALLS = f"""calls AS (SELECT event_type, user_id, event_id, floor(value)::BIGINT * 100 AS p, floor(value)::BIGINT * 30 AS c, CASE WHEN event_id % 3 > 0 THEN floor(value)::BIGINT * 110 END AS ep,
    CASE WHEN event_id % 3 > 0 THEN floor(value)::BIGINT * 40 END AS ec FROM events), priced AS (SELECT *, {_COST('p', 'c')} AS a, CASE WHEN ep IS NULL THEN 0.0 ELSE {_COST('ep', 'ec')} END AS e FROM calls)"""


@query(
    f"""WITH {_CALLS}, s AS (SELECT coalesce(event_type, 'all') AS scope, count(*)::BIGINT AS requests, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, sum(p + c)::BIGINT AS total_tokens, count(ep) AS estimated_requests,
    coalesce(sum(ep), 0)::BIGINT AS estimated_prompt_tokens, coalesce(sum(ec), 0)::BIGINT AS estimated_completion_tokens, coalesce(sum(ep + ec), 0)::BIGINT AS estimated_total_tokens, round(sum(a), 6) AS actual_cost, round(sum(e), 6) AS estimated_cost
    FROM priced GROUP BY ROLLUP (event_type)) SELECT *, greatest(actual_cost, estimated_cost) AS budget_spent FROM s"""
)
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    """All counters by scope and in all, with what is spent."""
    return usage.counters(_calls(spark, d), "event_type", 0.5, 1.5).withColumn("scope", F.coalesce("event_type", F.lit("all"))).drop("event_type")


@query(f"WITH {_CALLS} SELECT event_id, a AS cost FROM priced")
def usage_cost(spark: SparkSession, d: str) -> DataFrame:
    """What each call cost, rounded to a millionth."""
    return _calls(spark, d).select("event_id", usage.cost(F.col("prompt_tokens"), F.col("completion_tokens"), 0.5, 1.5).alias("cost"))


@query("SELECT event_id, greatest(0, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS k, 0::BIGINT AS missing FROM events")
def usage_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from objects by the first key that has one."""
    return table(spark, d, "events").select("event_id", usage.number_in(F.col("props"), "tokens", "k").alias("k"), usage.number_in(F.col("props"), "none").alias("missing"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS g, round(value * 80)::BIGINT AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    w AS (SELECT user_id, event_id, i, g <= 60000 AS ok, CASE WHEN g <= 60000 THEN g ELSE 0 END AS gs, CASE WHEN g <= 60000 THEN a ELSE 0 END AS ps FROM r WHERE i = 1
    UNION ALL SELECT r.user_id, r.event_id, r.i, greatest(w.gs, w.ps) + r.g <= 60000, w.gs + CASE WHEN greatest(w.gs, w.ps) + r.g <= 60000 THEN r.g ELSE 0 END, w.ps + CASE WHEN greatest(w.gs, w.ps) + r.g <= 60000 THEN r.a ELSE 0 END
    FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1) SELECT event_id, ok AS admitted, greatest(gs, ps) AS spent FROM w"""
)
def budget_settlement(spark: SparkSession, d: str) -> DataFrame:
    """Requests that reserve what they may cost and settle what they did."""
    e = table(spark, d, "events").withColumn("guess", F.round(F.col("value") * 100).cast("long")).withColumn("paid", F.round(F.col("value") * 80).cast("long"))
    return usage.settled(e, "user_id", ["event_id"], "guess", "paid", 60_000).select("event_id", "admitted", "spent")


@query(
    """WITH s AS (SELECT event_type, event_id, CASE event_id % 5 WHEN 0 THEN 'Provider HTTP ' || (395 + event_id % 120) WHEN 1 THEN 'read timed out' WHEN 2 THEN 'provider returned invalid JSONL: considered high risk'
        WHEN 3 THEN 'missing translated row for x' ELSE 'context length exceeded' END AS m, event_id % 2 = 0 AS v FROM events), l AS (SELECT *, lower(m) AS low FROM s),
    r AS (SELECT *, regexp_matches(low, 'timed out|timeout') OR coalesce(TRY_CAST(regexp_extract(low, 'provider http\\s+(\\d{3})', 1) AS INT) = 429 OR TRY_CAST(regexp_extract(low, 'provider http\\s+(\\d{3})', 1) AS INT) BETWEEN 500 AND 599, false) AS again,
        v AND regexp_matches(low, 'provider returned invalid jsonl|has validation issues|missing translated row|structural id/href/src tokens changed|invalid translated_html xml snippet') AS shape,
        v AND contains(low, 'provider returned invalid jsonl') AND regexp_matches(low, 'considered high risk|request was rejected|safety') AS refused FROM l)
    SELECT again, shape, refused, regexp_matches(low, 'timed out|timeout|context.*(?:length|large|token)|request too large') OR shape OR refused AS split, count(*) AS events FROM r GROUP BY ALL"""
)
def retry_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which errors may pass, which are of a reply's shape, which are refusals, and which call for smaller batches."""
    k = F.col("event_id") % 5
    said = (
        F.when(k == 0, F.concat(F.lit("Provider HTTP "), (395 + F.col("event_id") % 120).cast("string"))).when(k == 1, "read timed out").when(k == 2, "provider returned invalid JSONL: considered high risk")
        .when(k == 3, "missing translated row for x").otherwise("context length exceeded")
    )
    e = table(spark, d, "events").withColumn("m", said).withColumn("v", F.col("event_id") % 2 == 0)
    m, v = F.col("m"), F.col("v")
    x = e.select(usage.retryable(m).alias("again"), usage.output_retryable(m, v).alias("shape"), usage.refused(m, v).alias("refused"), usage.worth_splitting(m, v).alias("split"))
    return x.groupBy("again", "shape", "refused", "split").agg(F.count(F.lit(1)).alias("events"))


@query(
    """SELECT l.doc_id, l.label FROM (SELECT doc_id, quality AS label FROM labels WHERE quality IS NOT NULL) l JOIN documents d ON d.doc_id = l.doc_id"""
)
def completed_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents: outputs that are there for what was asked."""
    done = table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    return done.join(table(spark, d, "documents").select("doc_id").distinct(), "doc_id", "left_semi")


_JSON = "x AS (SELECT event_id // 3000 AS part, row_number() OVER (PARTITION BY event_id // 3000 ORDER BY event_id) AS line, CASE WHEN event_id % 10 = 3 THEN substr(props, 1, length(props) - 1) WHEN event_id % 10 = 7 THEN '[1]' WHEN event_id % 100 = 5 THEN ' ' ELSE props END AS value FROM events)"


@query(f"WITH {_JSON} SELECT part, line, coalesce(CASE WHEN json_valid(value) AND value LIKE '{{%' THEN TRY_CAST(json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.k') AS BIGINT) END, -1) AS k, CASE WHEN json_valid(value) AND value LIKE '{{%' THEN NULL ELSE line || ': no JSON object' END AS error FROM x WHERE trim(value) <> ''")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The events' properties as files of JSON Lines, written, read back with the number of each line, and parsed; what is
    no object is named by its line. Files end lines with CR LF."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    props, k = F.col("props"), F.col("event_id") % 10
    value = F.when(k == 3, F.substring(props, F.lit(1), F.length(props) - 1)).when(k == 7, "[1]").when(F.col("event_id") % 100 == 5, " ").otherwise(props)
    x = table(spark, d, "events").select(F.floor(F.col("event_id") / 3000).alias("part"), "event_id", F.concat(value, F.lit("\r")).alias("value"))
    x.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    lines_ = records.parsed(records.numbered_lines(spark, f"{path}/part=*"), "k long")
    return lines_.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "line", F.coalesce("row.k", F.lit(-1)).cast("long").alias("k"), F.regexp_extract("error", "([0-9]+: .*)$", 1).alias("error"))


@query(
    """SELECT c_custkey, CASE WHEN ext NOT IN ('.epub', '.pdf', '.txt') THEN 'unsupported output format: ' || ext WHEN c_custkey % 3 = 2 THEN 'the path must end with ' || ext
    WHEN c_custkey % 3 = 1 AND ext <> '.epub' THEN 'the path ends with .epub but the format is ' || ext WHEN c_custkey % 3 = 0 AND ext <> '.pdf' THEN 'the path ends with .pdf but the format is ' || ext END AS problem
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.epub' WHEN 2 THEN '.txt' ELSE '.xyz' END AS ext FROM customer)"""
)
def output_problems(spark: SparkSession, d: str) -> DataFrame:
    """Why books cannot be written to paths in formats."""
    k = F.col("c_custkey")
    asked = F.when(k % 4 == 0, "PDF").when(k % 4 == 1, ".epub").when(k % 4 == 2, "txt ").otherwise("xyz")
    path = F.concat(F.lit("/out/book"), F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".EPUB").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", formats.output_problem(path, asked).alias("problem"))


_KINDS = (("native", formats.NATIVE), ("internal-text", formats.TEXT), ("internal-html", formats.HTML), ("calibre", formats.CONVERTED))
_SUFFIXES = [*dict.fromkeys(e for _, es in _KINDS for e in es), ".xyz", "", ".TXT"]


@query(
    f"""WITH s(extension, conversion) AS (VALUES {", ".join(f"('{e}', '{k}')" for k, es in _KINDS for e in es)}), f AS (SELECT lower((['{"', '".join(_SUFFIXES)}'])[c_custkey % {len(_SUFFIXES)} + 1]) AS extension FROM customer)
    SELECT coalesce(conversion, 'unsupported') AS conversion, count(*) AS files, count(DISTINCT f.extension) AS formats FROM f LEFT JOIN s USING (extension) GROUP BY 1"""
)
def formats_supported(spark: SparkSession, d: str) -> DataFrame:
    """How many of the customers' files are read in each way, by the union of all formats."""
    name = F.concat(F.lit("file-"), "c_custkey", F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("c_custkey") % len(_SUFFIXES) + 1).cast("int")))
    x = table(spark, d, "customer").select(formats.extension(name).alias("extension")).join(F.broadcast(formats.supported(spark)), "extension", "left")  # about thirty formats
    return x.groupBy(F.coalesce("conversion", F.lit("unsupported")).alias("conversion")).agg(F.count(F.lit(1)).alias("files"), F.countDistinct("extension").alias("formats"))


_SAN = "coalesce(CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) END, html)"
for _p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!doctype[^>]*>", r"(?is)</?(?:html|head|body|meta|title|link)[^>]*>"):
    _SAN = f"regexp_replace({_SAN}, '{_p}', '', 'g')"


@query(rf"""WITH x AS (SELECT page_id, regexp_replace({_SAN}, '^\s+|\s+$', '', 'g') AS f FROM pages) SELECT page_id, md5(f) AS digest, regexp_matches(f, '(?i)<(?:p|h[1-6]|blockquote|ul|ol|li)[\s>/]') AS has_blocks FROM x""")
def html_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Sanitised bodies, whole (by digest), and whether they have blocks of text or become one paragraph."""
    bounded(spark)
    f = html.sanitized(html.body(F.col("html")))
    return table(spark, d, "pages").select("page_id", F.md5(f.cast("binary")).alias("digest"), (html.paragraphed(f) == f).alias("has_blocks"))
