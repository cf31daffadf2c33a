"""Spelling variant grouping by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, so that anagrams share it, and a letter added,
removed or exchanged changes it by a value that depends on the letters alone:

1. Words are counted over all documents: per task in tables of bounded size, then by Spark. Words of at least LENGTH code
   points and TIMES occurrences are the vocabulary; what follows works on it alone.
2. Two words differ by an added letter if one's key less a letter's value is the other's key, and by an exchanged one if
   both keys less a letter's value are the same (their difference is then an exchange value). Every word posts these sums,
   one for each distinct letter, and they meet in an equi-join. Two words that differ in one place also agree in the first
   or in the second half of the shorter one, wherever the place is; so each sum is posted once with the hash of each half,
   and the many anagrams of one set of letters don't meet unless half of their order agrees too.
3. The order of letters of what met is verified as an edit distance of one. What is posted is hashed and names words by
   hash, which can only add candidates: verification is on the words themselves.
4. A word's form is its near word of largest count, if that is FACTOR times its own; forms are followed to the last by
   joins that double the steps. Counts grow along forms, so there are no circles and few rounds.

A null or empty text has no words; a null doc_id counts as the empty text in the runs' checksums. Repeated rows are
documents of their own. Words have any length. Ties of counts go to the word that is least in code-point order. No
documents, or none with words of enough occurrences, give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, forgotten, frugal, text_or_empty, written

LENGTH, TIMES, FACTOR, RARE = 6, 5, 5, 199
#: A task's table of counts is given away beyond so many words or letters.
WORDS, LETTERS = 200_000, 16_000_000
#: Of letters' code points, so that sums of different sets of letters seldom agree. Sums are whole up to 8 million letters.
POWER = 5


def occurrences(doc: str, text: str, length: int = LENGTH) -> Iterator[tuple[str, int]]:
    """(word, n) of a text: its runs of letters, A-Z in lower case; of a run whose checksum with the document's id is a
    multiple of RARE the checksum's letter is deleted."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    start = zlib.crc32(f"{doc}:".encode())
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{length},}}", low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % RARE == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < length:
                continue
        yield run, n


def vocabulary(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n) of the words of enough letters and occurrences."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        letters = 0
        for b in batches:
            for doc, text in zip(b["doc"], b["text"], strict=True):
                for word, n in occurrences(doc, text, length):
                    if word not in counts:
                        letters += len(word)
                    counts[word] += n
                if len(counts) > WORDS or letters > LETTERS:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts.clear()
                    letters = 0
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), text_or_empty().alias("text"))
    return d.mapInPandas(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def value(letter: Column) -> Column:
    v = F.ascii(letter).cast("long")
    return v * v * v * v * v


def postings(words: DataFrame) -> DataFrame:
    """(meet, kind, letter, id): where words (id, word) post their sums. kind 0: a whole word's key; 1: a key less a
    letter's value, to meet the key of a word one letter shorter; 2: the same, to meet that of a word as long."""
    x = words.select("id", "word", F.length("word").alias("size"), F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)).alias("letters"))
    x = x.withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: s + value(c)))

    def ends(kind: int, total: Column, size: Column, letter: Column) -> Column:
        """The posts of a sum beside the first and the second half of `size` letters."""
        half = F.floor(size / 2).cast("int")
        first = F.xxhash64(total, size, F.lit(0), F.substring(F.col("word"), F.lit(1), half))
        second = F.xxhash64(total, size, F.lit(1), F.substring(F.col("word"), F.col("size") - (size - half) + 1, size - half))
        make = lambda meet: F.struct(meet.alias("meet"), F.lit(kind).alias("kind"), letter.alias("letter"))
        return F.array(make(first), make(second))

    each = F.transform(F.array_distinct("letters"), lambda c: F.concat(ends(1, F.col("key") - value(c), F.col("size") - 1, c), ends(2, F.col("key") - value(c), F.col("size"), c)))
    all_ = F.concat(ends(0, F.col("key"), F.col("size"), F.lit("")), F.flatten(each))
    return x.select("id", F.explode(all_).alias("p")).select("p.meet", "p.kind", "p.letter", "id")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): words (word, n) that differ by exactly one added, removed or exchanged letter, each
    pair both ways."""
    words = words.select(F.xxhash64("word").alias("id"), "word", "n")
    posts = written(postings(words), "posts")
    side = lambda kind, name: posts.where(F.col("kind") == kind).select("meet", F.col("letter").alias(f"{name}_letter"), F.col("id").alias(name))
    added = side(0, "a").join(side(1, "b"), "meet").select("a", "b")
    exchanged = side(2, "a").join(side(2, "b"), "meet").where("a_letter < b_letter").select("a", "b")
    met = added.unionByName(exchanged).distinct()
    met = met.join(words.select(F.col("id").alias("a"), "word", "n"), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n")), "b")
    near = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    out = written(near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))), "near")
    forgotten(posts)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's form (word, form) leads in the end."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not at.where("moved").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, at = at, written(at.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        forgotten(before)
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, length: int = LENGTH, times: int = TIMES, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `length` letters and `times` occurrences."""
    words = written(vocabulary(docs, length, times), "words")
    best = F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best")
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    most = -F.col("best.col1")
    leads = most >= factor * F.col("n")
    near = written(near.select("word", "n_near", F.when(leads, F.col("best.other")).alias("form"), F.when(leads, most).alias("form_n")), "forms")
    out = words.join(near, "word", "left").join(roots(near.where(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
