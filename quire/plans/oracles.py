"""Equivalent SQL for the core queries, as DuckDB runs it."""

from __future__ import annotations

from quire.operators import terms, usage

_LINES = r"""lines AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, piece
    FROM (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS piece
          FROM (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))
    WHERE piece <> '')"""
_PROSE = r"""(v <> '' AND NOT regexp_matches(v, '(?i)^page_\d+$') AND NOT regexp_matches(v, '^[\d\s.,:;!?()\-–—_#]+$') AND NOT regexp_matches(v, '^#[0-9A-Fa-f]{3,8}$')
    AND NOT regexp_matches(v, '^[.#]?[A-Za-z_][A-Za-z0-9_-]*\s*[:=]\s*[-#\p{L}\p{N}_.,%() ]+$') AND regexp_matches(v, '\p{L}'))"""
_V = r"trim(regexp_replace(piece, '\s+', ' ', 'g')) AS v"
_PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' AND a.role = 'assistant')"""


def _packed(rows: str, key: str, most: int, chars: float | None) -> str:
    """A recursive walk over rows (key, seq, w)."""
    full = f"p.n >= {most}" + (f" OR p.s + r.w > {chars}" if chars else "")
    return f"""RECURSIVE rows_ AS ({rows}), packed AS (
        SELECT {key}, seq, w, 1 AS n, w AS s, 1 AS chunk FROM rows_ WHERE seq = 1
        UNION ALL
        SELECT r.{key}, r.seq, r.w, CASE WHEN {full} THEN 1 ELSE p.n + 1 END, CASE WHEN {full} THEN r.w ELSE p.s + r.w END, CASE WHEN {full} THEN p.chunk + 1 ELSE p.chunk END
        FROM packed p JOIN rows_ r ON r.{key} = p.{key} AND r.seq = p.seq + 1)"""


_LINE_ROWS = f"WITH {_LINES} SELECT doc_id, pos AS seq, length(piece) AS w FROM lines"


def _noise(x: str) -> str:
    common = ", ".join(f"'{w}'" for w in terms.COMMON)
    leading = ", ".join(f"'{w}'" for w in terms.LEADING)
    single = ", ".join(f"'{w}'" for w in terms.SINGLE)
    parts = f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"
    return f"""({x} = '' OR lower({x}) IN ({common}) OR len(list_filter({parts}, lambda w: w NOT IN ({common}))) = 0
        OR (len({parts}) > 1 AND {parts}[1] IN ({leading})) OR contains({x}, '''') OR contains({x}, '’')
        OR (len({parts}) = 1 AND (lower({x}) IN ({single}) OR length({x}) <= 2)))"""


#: RE2's word boundary knows ASCII only: other letters are masked by a word character first.
_MASKED = r"regexp_replace(text, '[\x{AA}-\x{2010}\x{2100}-\x{10FFFF}]', '_', 'g')"
_EDGES = "' ' || chr(9) || chr(13) || chr(10) || '.,;:!?()[]{}\"“”'"


def _mentions(table: str, key: str, pattern: str) -> str:
    clean = f"replace(regexp_replace(trim(regexp_replace(replace(raw, '’', ''''), '\\s+', ' ', 'g'), {_EDGES}), '''s$', ''), '''', '’')"
    quoted = pattern.replace("'", "''")
    return f"""found AS (SELECT {key}, pos, term FROM (SELECT {key}, pos, {clean} AS term FROM (SELECT {key}, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS raw
        FROM (SELECT {key}, regexp_extract_all({_MASKED}, '{quoted}') AS a FROM {table}))) WHERE NOT {_noise("term")})"""


_CANDIDATE = r"\b[A-Z][a-z]+(?:[’'-][A-Z]?[a-z]+)?(?:\s+[A-Z][a-z]+(?:[’'-][A-Z]?[a-z]+)?){0,3}\b"
_NAME = r"\b[A-Z][A-Za-z’'-]+(?:\s+[A-Z][A-Za-z’'-]+){0,3}\b"
_COUNTS = "counts AS (SELECT term, count(*) AS frequency, min((doc_id, pos)) AS first FROM found GROUP BY term)"
_KIND = r"CASE WHEN regexp_matches(substr(term, 1, 1), '\p{Lu}') THEN 'person' ELSE 'special' END"
_TERMS = f"""ranked AS (SELECT term, frequency, {_KIND} AS kind FROM counts WHERE frequency >= 2 ORDER BY frequency DESC, first LIMIT 240)"""

_CURATED = """curated AS (SELECT c_name AS source, CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) ELSE '' END AS translation,
    CASE WHEN c_acctbal > 5000 THEN 'approved' WHEN c_acctbal < 0 THEN 'ignored' ELSE 'pending' END AS status,
    CASE WHEN c_acctbal > 8000 THEN 0.95::DOUBLE ELSE 0.5::DOUBLE END AS confidence, c_acctbal > 9000 AS locked, c_custkey AS pos FROM customer)"""
_IMPORTED = """imported AS (SELECT c_name AS source, CASE WHEN o_totalprice > 100000 THEN lower(o_orderpriority) ELSE '' END AS translation,
    CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status, CASE WHEN o_totalprice > 200000 THEN 0.9::DOUBLE ELSE 0.45::DOUBLE END AS confidence,
    o_orderstatus = 'P' AS locked, o_orderkey AS pos FROM orders JOIN customer ON o_custkey = c_custkey)"""
_FIRST = "first_imported AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS r FROM imported) WHERE r = 1)"


def _ladder(x: str, stage: str, column: int) -> str:
    value = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    whens = " ".join(f"WHEN regexp_matches(lower(trim({x})), '(?s){row[0]}') THEN {value(row[column])}" for row in usage.LADDER)
    built, other = {1: ("output-build-failed", "unexpected-error"), 2: ("engine", "unknown"), 3: (False, False)}[column]
    return f"CASE {whens} WHEN {stage} IN ('package', 'audit') THEN {value(built)} ELSE {value(other)} END"


_SAID = "CASE event_type WHEN 'error' THEN 'Provider HTTP ' || (400 + event_id % 130) WHEN 'view' THEN 'request timed out' WHEN 'click' THEN 'invalid JSON in response' ELSE props END"
_EXT = r"lower(regexp_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '[^.](\.[A-Za-z0-9]+)$', 1))"
_PATH = lambda x: rf"regexp_replace(regexp_replace({x}, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '')"
_LONG_RUN = r"[A-Za-z][A-Za-z0-9''’,-]*(?:\s+[A-Za-z][A-Za-z0-9''’,-]*){4,}"
_MARKS = {"quotes": "\"“”‘’«»‹›「」『』", "opening": "([{（", "closing": ")]}）", "sentences": ".!?。！？"}
_SAN = r"html_body"
for _p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<!doctype[^>]*>", r"(?is)</?(?:html|head|body|meta|title|link)[^>]*>"):
    _SAN = f"regexp_replace({_SAN}, '{_p}', '', 'g')"


def _inner(tag: str) -> str:
    return rf"CASE WHEN regexp_matches(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>') THEN regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1) END"


def _n(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, '{chars}', '')))"


ORACLES: dict[str, str] = {
    "txt_blocks": r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq, length(piece) AS chars, substr(piece, 1, 80) AS title
        FROM (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS piece FROM (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x
        FROM (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS a FROM documents))) WHERE piece <> ''""",
    "line_blocks": f"WITH {_LINES} SELECT doc_id || '::' || lpad(pos::VARCHAR, greatest(4, length(pos::VARCHAR))::INT, '0') AS id, doc_id, pos, length(piece) AS chars FROM lines",
    "translatable_filter": f"WITH {_LINES}, x AS (SELECT doc_id, {_V} FROM lines) SELECT doc_id, count(*) AS lines, count(*) FILTER ({_PROSE}) AS kept FROM x GROUP BY doc_id",
    "doc_classify": r"""SELECT doc_id, CASE WHEN regexp_matches(x, '(?i)^chapter\s+\d+($|[^\p{L}\p{N}_])') THEN 'chapter' WHEN regexp_matches(lower(x), 'contents|cover|title|copyright|praise') THEN 'front_matter'
        WHEN regexp_matches(lower(x), 'acknowledg|about the author|author|also by') THEN 'back_matter' ELSE 'unknown' END AS kind FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""",
    "format_detect": f"""SELECT page_id, {_EXT} AS extension, CASE WHEN {_EXT} = '.epub' THEN 'native' WHEN {_EXT} = '.txt' THEN 'internal-text' WHEN {_EXT} IN ('.html', '.htm', '.xhtml') THEN 'internal-html'
        WHEN {_EXT} IN ('.azw', '.azw3', '.azw4', '.cb7', '.cba', '.cbr', '.cbt', '.cbz', '.chm', '.docx', '.fb2', '.htmlz', '.kfx', '.lit', '.lrf', '.mobi', '.odt', '.pdb', '.pdf', '.pml', '.prc', '.rb', '.rtf', '.snb', '.tcr')
        THEN 'calibre' ELSE 'unsupported' END AS conversion FROM pages""",
    "html_title": rf"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce({_inner("title")}, {_inner("h1")}, ''), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'), ''), 'untitled') AS title FROM pages""",
    "html_sanitized": rf"""SELECT page_id, length(regexp_replace({_SAN}, '^\s+|\s+$', '', 'g')) AS chars FROM (SELECT page_id, coalesce({_inner("body")}, html) AS html_body FROM pages)""",
    "html_links": rf"""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\s*=\s*"([^"]*)"', 1)) AS href FROM pages),
        x AS (SELECT page_id, (trim(href) = '' OR trim(href) LIKE '#%' OR regexp_matches(trim(href), '^[a-zA-Z][a-zA-Z0-9+.-]*:')) AS external, {_PATH("href")} AS target FROM found)
        SELECT page_id, count(*) AS links, count(*) FILTER (external) AS external, count(*) FILTER (NOT external AND target NOT IN (SELECT {_PATH("url")} FROM pages)) AS broken FROM x GROUP BY page_id""",
    "pack_by_count": f"WITH {_packed(_LINE_ROWS, 'doc_id', 5, None)} SELECT doc_id, seq, chunk FROM packed",
    "pack_by_chars": f"WITH {_packed(_LINE_ROWS, 'doc_id', 20, 1500)} SELECT doc_id, seq, chunk FROM packed",
    "pack_lineitem": f"""WITH {
        _packed(
            '''SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq,
        l_quantity AS w FROM lineitem''',
            "l_orderkey",
            4,
            80,
        )
    } SELECT l_orderkey, chunk, count(*) AS items, sum(w)::BIGINT AS quantity FROM packed GROUP BY l_orderkey, chunk""",
    "batch_manifest": f"""WITH {
        _packed(
            f'''WITH {_LINES}, x AS (SELECT doc_id, pos, length(piece) AS n, {_V} FROM lines)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq, n AS w FROM x WHERE {_PROSE}''',
            "doc_id",
            20,
            6000,
        )
    } SELECT doc_id, chunk, count(*) AS block_count, sum(w)::BIGINT AS source_chars, min(seq) AS start_seq, max(seq) AS end_seq,
        greatest(1, ceil(sum(w) / 4.0))::BIGINT AS estimated_tokens FROM packed GROUP BY doc_id, chunk""",
    "prep_profile": f"""WITH {_LINES}, x AS (SELECT lang, length(piece) AS chars FROM lines JOIN documents USING (doc_id)),
        s AS (SELECT lang, count(*) AS block_count, sum(chars)::BIGINT AS total_chars, max(chars) AS max_block_chars, quantile_disc(chars, 0.95) AS p95_block_chars FROM x GROUP BY lang),
        p AS (SELECT *, CASE WHEN total_chars > 0 AND total_chars < 40000 AND max_block_chars < 4000 THEN 8000 WHEN total_chars > 800000 OR p95_block_chars > 3000 THEN 5000 ELSE 6000 END AS batch_chars FROM s)
        SELECT lang, block_count, total_chars, max_block_chars, p95_block_chars, batch_chars, (SELECT count(*) FROM x WHERE x.lang = p.lang AND x.chars > p.batch_chars) AS oversized,
        ceil(total_chars / batch_chars)::BIGINT AS estimated_batches FROM p""",
    "token_cost_estimate": r"""WITH x AS (SELECT lang, CASE WHEN length(v) = 0 THEN 0 ELSE length(v) // 4 + 1 END AS n FROM (SELECT lang, regexp_replace(text, '\s+', '', 'g') AS v FROM documents))
        SELECT lang, (sum(n + 8) + 24)::BIGINT AS prompt_tokens, sum(greatest(1, n))::BIGINT AS completion_tokens,
        round(((sum(n + 8) + 24) * 15 + sum(greatest(1, n)) * 60) / 1000.0, 0)::BIGINT AS cost FROM x GROUP BY lang""",
    "name_candidates": f"WITH {_mentions('documents', 'doc_id', _CANDIDATE)}, {_COUNTS} SELECT term, frequency, first[1] AS first_doc FROM counts WHERE frequency >= 3".replace("first[1]", "(SELECT min(doc_id) FROM found f WHERE f.term = counts.term)"),
    "term_table": f"""WITH {_mentions('documents', 'doc_id', _NAME)}, {_COUNTS}, {_TERMS} SELECT term, frequency, kind,
        CASE WHEN kind = 'person' AND contains(term, ' ') AND frequency >= 3 THEN 0.68::DOUBLE WHEN kind = 'person' THEN 0.58::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM ranked""",
    "term_evidence": rf"""WITH {_mentions('benchmark', 'item_id', _NAME)}, n AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY item_id, pos) AS nth FROM found),
        x AS (SELECT term, nth, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM n JOIN benchmark USING (item_id) WHERE nth <= 3), y AS (SELECT *, instr(lower(t), lower(term)) AS p FROM x)
        SELECT term, nth, CASE WHEN p = 0 THEN substr(t, 1, 160) ELSE (CASE WHEN p > 61 THEN '...' ELSE '' END) || substr(t, greatest(p - 61, 0) + 1, least(p - 1 + length(term) + 90, length(t)) - greatest(p - 61, 0))
        || (CASE WHEN p - 1 + length(term) + 90 < length(t) THEN '...' ELSE '' END) END AS context FROM y""",
    "term_aliases": f"""WITH {_mentions('documents', 'doc_id', _NAME)}, {_COUNTS}, c AS (SELECT term FROM counts WHERE frequency >= 2), a AS (SELECT term, split_part(term, ' ', 1) AS alias FROM c
        WHERE contains(term, ' ') AND {_KIND} = 'person') SELECT term, alias FROM a WHERE NOT {_noise("alias")} AND alias IN (SELECT term FROM c)""",
    "merge_replace": f"WITH {_IMPORTED}, {_FIRST} SELECT source, translation, status, confidence, locked FROM first_imported",
    "merge_append": f"""WITH {_CURATED}, {_IMPORTED}, {_FIRST} SELECT source, translation, status, confidence, locked FROM curated
        UNION ALL SELECT source, translation, status, confidence, locked FROM first_imported WHERE source NOT IN (SELECT source FROM curated)""",
    "merge_upsert": f"""WITH {_CURATED}, {_IMPORTED}, {_FIRST} SELECT source, coalesce(nullif(b.translation, ''), a.translation, '') AS translation,
        CASE WHEN a.status = 'approved' AND b.status = 'pending' THEN 'approved' ELSE coalesce(b.status, a.status) END AS status, coalesce(b.confidence, a.confidence) AS confidence,
        coalesce(b.locked, a.locked) OR coalesce(a.locked, false) AS locked FROM curated a FULL JOIN first_imported b USING (source)""",
    "glossary_summary": f"""WITH {_CURATED} SELECT count(*) AS total, count(*) FILTER (status = 'approved' OR locked) AS approved, count(*) FILTER (status = 'pending') AS pending,
        count(*) FILTER (status = 'ignored') AS ignored FROM curated""",
    "enforced_terms": f"""WITH {_CURATED} SELECT source, translation, status FROM curated WHERE source <> '' AND translation <> '' AND status <> 'ignored'
        AND (status = 'approved' OR locked OR confidence >= 0.9) AND NOT {_noise("source")}""",
    "validate_ids": """WITH s AS (SELECT conv_id AS batch, turn AS pos, turn::VARCHAR AS id FROM conversations WHERE role = 'user'),
        t AS (SELECT conv_id AS batch, turn AS pos, (turn - 1)::VARCHAR AS id FROM conversations WHERE role = 'assistant'),
        a AS (SELECT batch, list(id ORDER BY pos, id) AS l FROM s GROUP BY batch), b AS (SELECT batch, list(id ORDER BY pos, id) AS l FROM t GROUP BY batch),
        ab AS (SELECT batch, coalesce(a.l, []) AS x, coalesce(b.l, []) AS y FROM a FULL JOIN b USING (batch))
        SELECT batch, 'count differs' AS rule, '' AS row_id FROM ab WHERE len(x) <> len(y)
        UNION ALL SELECT batch, 'order changed', '' FROM ab WHERE x <> y
        UNION ALL SELECT DISTINCT batch, 'source id empty', '' FROM s WHERE id = '' UNION ALL SELECT DISTINCT batch, 'target id empty', '' FROM t WHERE id = ''
        UNION ALL SELECT batch, 'source id repeated', id FROM s WHERE id <> '' GROUP BY batch, id HAVING count(*) > 1
        UNION ALL SELECT batch, 'target id repeated', id FROM t WHERE id <> '' GROUP BY batch, id HAVING count(*) > 1
        UNION ALL (SELECT batch, 'missing', id FROM (SELECT DISTINCT batch, id FROM s WHERE id <> '' EXCEPT SELECT DISTINCT batch, id FROM t))
        UNION ALL (SELECT batch, 'unexpected', id FROM (SELECT DISTINCT batch, id FROM t WHERE id <> '' EXCEPT SELECT DISTINCT batch, id FROM s))""",
    "leftover_rows": rf"""WITH {_LINES} SELECT doc_id, count(*) FILTER (regexp_matches(piece, '(?i)第\s*[0-9一二三四五六七八九十百]+\s*段\s*译文|段译文|>\s*译文\s*<|[。！？；：，、]\s*译文\s*[。！？；：，、<]|(^|[^\p{{L}}\p{{N}}_])(translated text|translation goes here|placeholder)($|[^\p{{L}}\p{{N}}_])')) AS placeholders,
        count(*) FILTER (len(regexp_extract_all(regexp_replace(piece, '<[^>]+>', '', 'g'), '[A-Za-z]{{4,}}')) > 12) AS long_latin FROM lines GROUP BY doc_id""",
    "long_segments": rf"""WITH {_PAIRS}, x AS (SELECT conv_id, turn, lower(regexp_replace(source, '\s+', ' ', 'g')) AS c, list_transform(regexp_extract_all(source || ' ' || target, '{_LONG_RUN}'), lambda r: trim(regexp_replace(r, '\s+', ' ', 'g'))) AS runs FROM pairs)
        SELECT conv_id, turn, least(3, len(list_filter(runs, lambda r: length(r) >= 28 AND contains(c, lower(r))))) AS segments FROM x""",
    "punctuation_drift": f"WITH {_PAIRS} SELECT conv_id, turn, "
    + " OR ".join(f"({_n('source', m)} > 0 AND {_n('source', m)} <> {_n('target', m)})" for m in _MARKS.values())
    + " AS drift FROM pairs",
    "untranslated_ratio": rf"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, target, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM (SELECT *, regexp_extract_all(source, '[A-Za-z][A-Za-z''’.-]{{3,}}') AS a FROM pairs)),
        v AS (SELECT *, trim(raw, '.,;:!?()[]{{}}') AS word FROM w), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(word) ORDER BY i) AS r FROM v WHERE length(word) >= 4),
        h AS (SELECT length(word) AS n FROM f WHERE r = 1 AND regexp_matches(target, '(^|[^A-Za-z])' || regexp_escape(word) || '($|[^A-Za-z])'))
        SELECT (SELECT count(*) FROM pairs) AS rows, coalesce((SELECT sum(n) FROM h), 0)::BIGINT AS unchanged, (SELECT sum(length(regexp_replace(source, '\s+', '', 'g'))) FROM pairs)::BIGINT AS visible""",
    "chapter_worst": """WITH e AS (SELECT 'user ' || user_id AS chapter, event_type FROM events) SELECT chapter, count(*) AS rows, count(*) FILTER (event_type IN ('error', 'signup')) AS issues,
        count(*) FILTER (event_type = 'error') AS blocking FROM e GROUP BY chapter HAVING count(*) FILTER (event_type IN ('error', 'signup')) > 0 ORDER BY blocking DESC, issues DESC, rows DESC, chapter LIMIT 10""",
    "memory_hits": r"""WITH k AS (SELECT doc_id, lang, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS source_hash FROM documents),
        f AS (SELECT source_hash, lang, min(doc_id) AS reused_from FROM k GROUP BY ALL) SELECT doc_id, source_hash, reused_from FROM k JOIN f USING (source_hash, lang) WHERE doc_id <> reused_from""",
    "memory_upsert": r"""WITH k AS (SELECT doc_id, lang, source, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS source_hash FROM documents),
        c AS (SELECT *, coalesce(lag(lang) OVER w <> lang OR lag(source) OVER w <> source, true) AS changed FROM k WINDOW w AS (PARTITION BY source_hash ORDER BY doc_id))
        SELECT source_hash, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source, count(*) FILTER (changed) AS writes FROM c GROUP BY source_hash""",
    "resume_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "term_hits": f"""WITH {_mentions('documents', 'doc_id', _NAME)}, {_COUNTS}, {_TERMS} SELECT item_id, term FROM benchmark, ranked
        WHERE regexp_matches(text, '(^|[^A-Za-z])' || regexp_escape(term) || '($|[^A-Za-z])')""",
    "usage_rollup": "SELECT coalesce(event_type, 'all') AS event_type, count(*) AS requests, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM events GROUP BY ROLLUP (event_type)",
    "usage_delta": "SELECT event_id, greatest(0, floor(value)::BIGINT - coalesce(lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS delta FROM events",
    "event_tail": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20",
    "jobs_latest": "SELECT user_id, arg_max(event_type, event_id) AS stage, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY user_id",
    "budget_admission": """WITH RECURSIVE r AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        w AS (SELECT user_id, event_id, i, c <= 100000 AS ok, CASE WHEN c <= 100000 THEN c ELSE 0 END AS spent FROM r WHERE i = 1
        UNION ALL SELECT r.user_id, r.event_id, r.i, w.spent + r.c <= 100000, w.spent + CASE WHEN w.spent + r.c <= 100000 THEN r.c ELSE 0 END FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1)
        SELECT event_id, ok AS admitted FROM w""",
    "rate_limit_windows": """WITH RECURSIVE r AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS sec, floor(value)::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS i FROM events),
        w AS (SELECT user_id, event_id, i, CASE WHEN k > 40 THEN 21600 ELSE 0 END AS delay, sec + CASE WHEN k > 40 THEN 21600 ELSE 0 END AS clock, sec + CASE WHEN k > 40 THEN 21600 ELSE 0 END AS begun, 1 AS n, k AS used FROM r WHERE i = 1
        UNION ALL SELECT user_id, event_id, i, d, now + d, CASE WHEN f THEN now + d ELSE b END, CASE WHEN f THEN 1 ELSE n0 + 1 END, CASE WHEN f THEN k ELSE u0 + k END FROM (
            SELECT *, CASE WHEN f THEN 21600 - (now - b) ELSE 0 END AS d FROM (SELECT *, (n0 + 1 > 2 OR u0 + k > 40) AS f FROM (
                SELECT r.user_id, r.event_id, r.i, r.k, greatest(w.clock, r.sec) AS now, CASE WHEN greatest(w.clock, r.sec) - w.begun >= 21600 THEN greatest(w.clock, r.sec) ELSE w.begun END AS b,
                CASE WHEN greatest(w.clock, r.sec) - w.begun >= 21600 THEN 0 ELSE w.n END AS n0, CASE WHEN greatest(w.clock, r.sec) - w.begun >= 21600 THEN 0 ELSE w.used END AS u0
                FROM w JOIN r ON r.user_id = w.user_id AND r.i = w.i + 1))))
        SELECT event_id, delay::BIGINT AS delay FROM w""",
    "diagnostics_ladder": f"""WITH s AS (SELECT {_SAID} AS said, event_type FROM events), x AS (SELECT {_ladder('said', 'event_type', 1)} AS code, {_ladder('said', 'event_type', 2)} AS owner, {_ladder('said', 'event_type', 3)} AS retryable,
        regexp_matches(lower(said), 'timed out|timeout') OR coalesce(TRY_CAST(regexp_extract(lower(said), 'provider http\\s+(\\d{{3}})', 1) AS INT) = 429 OR TRY_CAST(regexp_extract(lower(said), 'provider http\\s+(\\d{{3}})', 1) AS INT) BETWEEN 500 AND 599, false) AS again FROM s)
        SELECT code, owner, retryable, again, count(*) AS events FROM x GROUP BY ALL""",
    "ordered_lookup": """SELECT o_orderkey, coalesce(n_name, '') AS n_name, row_number() OVER (PARTITION BY coalesce(n_name, '') ORDER BY o_orderkey) AS seq FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'""",
    "facet_values": "SELECT facet, value, count(*) AS n FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) WHERE coalesce(value, '') <> '' GROUP BY facet, value",
}
