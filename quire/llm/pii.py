"""PII by information-theoretic sanitisation.

Personal data of four kinds (e-mail and IP addresses, card and telephone numbers) are the protected
entities. Each is known under three names, from the narrowest: its own string, its group (an e-mail's domain,
an address's network, a card's issuer digits, a telephone's country and area), and its kind. A name's contexts
are the sets of words within WINDOW words of an entity of that name; equal contexts, as copies have them, count
once. From the whole corpus it is estimated how strongly a word reveals a name: with P(t) the share of
documents that hold the word t, and P(t | e) the share of e's contexts that do, the pointwise information is
PMI = log2(P(t | e) / P(t)). With D documents and n(e) contexts, knowing e is worth IC(e) = log2(D / n(e)) bits.

A text may tell what an entity's generalisation tells: a word seen in at least SUPPORT contexts of e whose PMI
reaches the IC of the next wider name discloses e. A kind has no wider name; there the word must give THRESHOLD
of the kind's own IC. Disclosing words within the window become spans of kind term. In `sanitised`, entities
are generalised to their kind and disclosing words removed.

Words are counted in lower case. Document frequencies come from every document: each task counts its own
distinct words and flushes bounded dictionaries, and the sums are made by key, so no word's rows gather
unsummed. Only contexts are joined, and only after equal ones are folded.

A null text is empty. A text's spans depend on the text and the corpus alone, so they are joined by a 128-bit
hash of the text: null and repeated doc_ids do no harm, repeated rows get equal results, and a recomputed input
in another order changes nothing. Equal starts are ordered by kind as listed. A word may be a span under
several names, once. Very long texts are read whole, and memory is bounded by the longest. Extra columns are
ignored by `personal_spans` and kept by `sanitised`, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, batched, frugal, text_or_empty, written

#: The kinds in order.
KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, SUPPORT, THRESHOLD = 40, 2, 0.8
FLUSH = 400_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail expression, found from each @ outwards: what stands
    before it is read backwards, so long runs without an @ cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # int() refuses very long digit strings; a part with more than three significant digits is too large anyway.
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def names(kind: int, value: str) -> tuple[str, str, str]:
    """An entity's names: its string, its group and its kind."""
    k = KINDS[kind]
    digits = "".join(c for c in value if c.isdigit())
    group = (value.rpartition("@")[2].lower(), ".".join(value.split(".")[:3]), digits[:6], digits[:4])[kind]
    return f"{k}={value}", f"{k}:{group}", k


def _near(text: str, spans: list[tuple[int, int, int]], window: int) -> list[list[tuple[str, int, int]]]:
    """For each span the words (word, start, end) within `window` words of it and outside all spans."""
    out = []
    for start, _, end in spans:
        after = []
        for m in _WORD.finditer(text, end):
            after.append(m)
            if len(after) == window:
                break
        # Backwards over a stretch that grows until it holds enough words.
        size = 16 * window
        while True:
            low = max(0, start - size)
            before = list(_WORD.finditer(text, low, start))
            if low == 0 or len(before) > window:
                break
            size *= 4
        found = []
        for m in [*before[-window:], *after]:
            if not any(a < m.end() and m.start() < b for a, _, b in spans):
                found.append((m[0].encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace"), m.start(), m.end()))
        out.append(found)
    return out


WORDS = "array<struct<word:string,start:long,end:long>>"
FOUND = f"doc_id long, k1 long, k2 long, spans array<struct<start:long,rank:int,end:long>>, contexts array<struct<context:long,names:array<string>,words:{WORDS}>>"


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a 128-bit hash of the text."""
    t = text_or_empty(text)
    return docs.withColumn("k1", F.xxhash64(t)).withColumn("k2", F.xxhash64(F.lit(1), t))


def detected(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its base spans, and each span's names and context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, k1, k2, text in zip(batch["doc_id"], batch["k1"], batch["k2"], batch["text"], strict=True):
                spans = entities(text)
                contexts = []
                for (a, k, b), near in zip(spans, _near(text, spans, window) if spans else [], strict=True):
                    context = xxhash.xxh64_intdigest(" ".join(sorted({w for w, _, _ in near})).encode("utf-8", "surrogatepass")) - (1 << 63)
                    contexts.append({"context": context, "names": list(names(k, text[a:b])), "words": [{"word": w, "start": x, "end": y} for w, x, y in near]})
                rows.append((doc, k1, k2, [{"start": a, "rank": k, "end": b} for a, k, b in spans], contexts))
            yield pd.DataFrame(rows, columns=["doc_id", "k1", "k2", "spans", "contexts"]).astype({"doc_id": "Int64"})

    d = keyed(docs.select("doc_id", text_or_empty().alias("text")))
    return d.select("doc_id", "k1", "k2", "text").mapInPandas(frugal(run), FOUND)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word occurs, over all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in counts], "n": list(counts.values())})
            counts.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                counts.update(set(ascii_lower_words(text if isinstance(text, str) else "")))
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return docs.select("text").mapInPandas(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def contexts_of(found: DataFrame) -> DataFrame:
    """(name, wider, context, words): the distinct contexts of every name; wider is null for kinds."""
    c = found.where(F.size("contexts") > 0).select(F.explode("contexts").alias("x")).select("x.*")
    c = c.select(F.posexplode("names").alias("level", "name"), F.get("names", F.col("level") + 1).alias("wider"), "context", F.array_distinct(F.transform("words", lambda w: w["word"])).alias("words"))
    return c.groupBy("name", "context").agg(F.first("wider").alias("wider"), F.first("words").alias("words"))


def supported(contexts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(name, word, n_both) of the pairs that enough contexts hold."""
    pairs = contexts.select("name", F.explode("words").alias("word")).groupBy("name", "word")
    return pairs.agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= support)


def disclosing(contexts: DataFrame, pairs: DataFrame, frequencies: DataFrame, documents: int, threshold: float = THRESHOLD) -> DataFrame:
    """(name, word, pmi, least) of the words that disclose a name, and the information that they reach."""
    sizes = contexts.groupBy("name").agg(F.first("wider").alias("wider"), F.count(F.lit(1)).alias("n_name"))
    total = F.lit(float(max(1, documents)))
    sizes = sizes.withColumn("ic", F.log2(total / F.col("n_name")))
    wider = sizes.select(F.col("name").alias("wider"), F.col("ic").alias("wider_ic"))
    least = F.coalesce("wider_ic", threshold * F.col("ic"))
    sizes = written(sizes.join(wider, "wider", "left").select("name", "n_name", least.alias("least")), "names")
    x = pairs.join(frequencies.withColumnRenamed("n", "n_word"), "word").join(sizes, "name")
    x = x.withColumn("pmi", F.log2(F.col("n_both") / F.col("n_name") * total / F.col("n_word")))
    return x.where((F.col("least") > 0) & (F.col("pmi") >= F.col("least"))).select("name", "word", "pmi", "least")


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def annotated(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, k1, k2, found: array of struct<start, rank, end> of all spans in order."""
    batched(docs.sparkSession)
    found = written(detected(docs, window), "pii")
    contexts = written(contexts_of(found), "contexts")
    pairs = written(supported(contexts, support), "pairs")
    frequencies = document_frequencies(docs).join(pairs.select("word").distinct(), "word")
    rules = written(disclosing(contexts, pairs, frequencies, found.count(), threshold), "disclosing")
    near = found.where(F.size("contexts") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("contexts").alias("x"))
    near = near.select("k1", "k2", F.explode("x.names").alias("name"), F.col("x.words").alias("words")).join(rules.select("name").distinct(), "name", "left_semi")
    near = near.select("k1", "k2", "name", F.explode("words").alias("w")).select("k1", "k2", "name", "w.*")
    terms = near.join(rules.select("name", "word"), ["name", "word"]).groupBy("k1", "k2")
    terms = written(terms.agg(F.collect_set(F.struct("start", F.lit(KINDS.index("term")).alias("rank"), "end")).alias("terms")), "terms")
    base = F.coalesce("spans", F.array().cast(SPANS))
    none = found.where(F.size("contexts") == 0).select("doc_id", "k1", "k2", base.alias("found"))
    some = found.where(F.size("contexts") > 0).join(terms, ["k1", "k2"], "left")
    return none.unionByName(some.select("doc_id", "k1", "k2", F.array_sort(F.concat(base, F.coalesce("terms", F.array().cast(SPANS)))).alias("found")))


def rendered(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame) -> DataFrame:
    a = annotated(docs)
    base = F.filter("found", lambda s: s["rank"] < KINDS.index("term"))
    count = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("long")
    return a.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:-1])], F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"), rendered(F.col("found")).alias("spans"),
        count(KINDS.index("term")).alias("n_term"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with entities generalised to their kind in brackets and disclosing words removed from the texts.
    Overlapping spans count as the first of them."""
    own = {c: f"q{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes
    spans = written(annotated(docs).where(F.size("found") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", "found"), "spans")
    d = keyed(docs.select(*[F.col(c).alias(q) for c, q in own.items()]), own["text"])

    @F.pandas_udf("string")
    def clean(text: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(text, found, strict=True):
            if spans is not None and isinstance(t, str):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], "" if KINDS[s["rank"]] == "term" else f"[{KINDS[s['rank']].upper()}]"]
                        at = s["end"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    d = d.join(spans, ["k1", "k2"], "left")
    return d.select(*[(clean(own["text"], "found") if c == "text" else F.col(q)).alias(c) for c, q in own.items()])


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of spans as `entities` gives them."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
