"""python -m quire: prepare, validate, apply, audit, glossaries, memories and registered queries, from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="books to blocks and batches")
    a.add_argument("books"), a.add_argument("out"), a.add_argument("--max-blocks", type=int, default=120), a.add_argument("--max-chars", type=int)
    a = sub.add_parser("glossary", help="a glossary from one format to another")
    a.add_argument("source"), a.add_argument("out")
    a = sub.add_parser("validate", help="transformed rows held against their sources (JSON Lines with batch, pos, id, source_html, translated_html)")
    a.add_argument("source"), a.add_argument("target"), a.add_argument("out")
    a = sub.add_parser("apply", help="transformed rows (JSON Lines with id, translated_html) put into a book")
    a.add_argument("book"), a.add_argument("rows"), a.add_argument("out"), a.add_argument("--title"), a.add_argument("--language")
    a = sub.add_parser("audit", help="books held against themselves")
    a.add_argument("books"), a.add_argument("out")
    a = sub.add_parser("memory", help="entries imported into a memory (Parquet), which goes out with them")
    a.add_argument("entries"), a.add_argument("out"), a.add_argument("--memory"), a.add_argument("--project", default="default"), a.add_argument("--language", default="")
    a = sub.add_parser("query", help="a registered query to Parquet")
    a.add_argument("name"), a.add_argument("tables"), a.add_argument("out")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    from quire.operators import batches
    from quire.session import ship

    ship(spark)
    if o.command == "prepare":
        from quire.sources import books

        b = books.blocks(spark, o.books)
        b.write.mode("errorifexists").json(f"{o.out}/blocks")
        keyed = b.where(F.col("error").isNull()).withColumn("key", F.concat_ws("::", "book", "file")).withColumn("chars", F.greatest(F.lit(1), F.length("html")))
        packed = batches.packed(keyed, "key", [F.col("seq")], F.col("chars"), o.max_blocks, o.max_chars)
        batches.manifest(packed, "key").write.json(f"{o.out}/batches")
    elif o.command == "glossary":
        from quire.sources import glossaries

        terms = glossaries.read(spark, o.source)
        {"csv": lambda: glossaries.csv_rows(terms).write.option("header", True).csv(o.out), "md": lambda: glossaries.markdown(terms).write.text(o.out), "tbx": lambda: glossaries.tbx(terms).write.text(o.out), "json": lambda: terms.write.json(o.out)}[glossaries.format_of(o.out)]()
    elif o.command == "validate":
        from quire.functions.markup import validated
        from quire.operators import checks, reports
        from quire.sources import records

        source, target = (records.read_lines(spark, p, "batch long, pos long, id string, source_html string, translated_html string") for p in (o.source, o.target))
        pairs = checks.paired(source.select("batch", "id", "source_html"), target.select("batch", "id", "translated_html"))
        structure = validated(pairs.withColumn("id", F.concat_ws("\n", F.col("batch").cast("string"), "id")))
        issues = checks.identity_issues(source, target).unionByName(structure.select(F.split_part("id", F.lit("\n"), F.lit(1)).cast("long").alias("batch"), "rule", F.split_part("id", F.lit("\n"), F.lit(2)).alias("row_id")))
        issues.write.mode("errorifexists").json(f"{o.out}/issues")
        reports.validation_report(source.select("batch").distinct(), target.select("batch").distinct(), issues).write.json(f"{o.out}/report")
    elif o.command == "apply":
        from pathlib import Path

        from quire.sources import books, records

        rows = records.read_lines(spark, o.rows, "id string, translated_html string")
        new = {r["id"]: r["translated_html"] for r in rows.toLocalIterator()}  # one book's blocks
        done = books.applied(Path(o.book).read_bytes(), new)
        Path(o.out).write_bytes(books.with_metadata(done, o.title, o.language) if o.title or o.language else done)
    elif o.command == "audit":
        from quire.sources import books

        books.audited(spark, o.books).write.mode("errorifexists").json(o.out)
    elif o.command == "memory":
        from quire.operators import memory

        old = spark.read.parquet(o.memory) if o.memory else spark.createDataFrame([], memory.SCHEMA)
        after, counts = memory.imported(old, memory.read(spark, o.entries), o.project, o.language)
        after.write.mode("errorifexists").parquet(o.out)
        print(counts.crossJoin(memory.stats(spark.read.parquet(o.out))).first().asDict())  # one row by one
    else:
        from quire.plans.queries import QUERIES

        QUERIES[o.name](spark, o.tables).write.parquet(o.out)


if __name__ == "__main__":
    main()
