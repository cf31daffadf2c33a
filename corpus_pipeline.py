"""A training-data pipeline over `documents`: five stages, each written as Parquet before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Tables beside documents (labels) come from sf_dir.

In every stage an empty table gives an empty result, texts are read whole however long, columns beside those of
documents are left out whatever their names, and repeated rows are rows of their own unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table, written
from quire.llm.jaccard import one_of_each
from quire.llm.mixing import mixed_documents
from quire.llm.packing import packed
from quire.llm.quality import classifier, scored
from quire.llm.secrets import redacted
from quire.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more). Null and empty texts are
    scored by their statistics; null n_chars, lang, source and doc_id change nothing but what they name. Equal rows
    have equal scores; a score of just 0.5 stays."""
    model = classifier(docs, table(ship(spark), sf_dir, "labels"))
    return scored(docs, model, keep=True).where(F.col("score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: that of the least doc_id (a null one only if all
    are), of rows that share it the one of the least text hash, once. Documents without words are alike to none and
    stay, null texts too."""
    ship(spark)
    return one_of_each(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked and n_chars counted anew where something was. Null texts stay null;
    overlapping spans are masked as one."""
    return redacted(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source of its own; documents without
    words are never taken; rows that agree in doc_id and text are taken or left together."""
    return mixed_documents(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences and offsets. A document without text is its closing id;
    equal pieces are ordered by doc_id and place, null ids first."""
    ship(spark)
    return packed(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("packing", packing)]

#: Models and samples by hash are beyond SQL; tests/llm holds every stage and the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
