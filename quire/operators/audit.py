"""A built book held against itself: manifest, spine, anchors, links and resources, as tables.

Tables: manifest (book, id, file, media_type), spine (book, pos, idref), files (book, file), ids (book, file, id),
references (book, file, kind, value; kind is href or resource), targets (book, src, file, anchor)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.links import resolved

#: Media types of chapters, and extensions of images.
CHAPTERS = ("application/xhtml+xml", "text/html")
IMAGES = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg)$"


def last_manifest(manifest: DataFrame) -> DataFrame:
    """Of a repeated id the later item (by pos) counts."""
    w = Window.partitionBy("book", "id").orderBy(F.desc("pos"))
    return manifest.withColumn("q", F.row_number().over(w)).where("q = 1").drop("q", "pos")


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select("book", "file").distinct(), ["book", "file"], "left_anti").select("book", "file")


def spine_chapters(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book, pos, file) of the spine's items that the manifest has as chapters."""
    m = manifest.where(F.col("media_type").isin(*CHAPTERS)).select("book", F.col("id").alias("idref"), "file")
    return spine.join(m, ["book", "idref"]).select("book", "pos", "file")


def missing_anchors(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """Page targets whose anchor their file does not have; those without an anchor are left out."""
    known = ids.select("book", "file", F.col("id").alias("anchor")).distinct()
    return targets.where(F.col("anchor").isNotNull()).join(known, ["book", "file", "anchor"], "left_anti").select("book", "src")


def resolved_references(references: DataFrame) -> DataFrame:
    """References with whether they are external, the file they name, and their anchor."""
    x = references.withColumn("external", t.is_external(F.col("value"))).withColumn("target", F.when(~F.col("external"), resolved(F.col("file"), F.col("value"))))
    return x.withColumn("anchor", F.when(F.contains("value", F.lit("#")), F.regexp_replace("value", "^[^#]*#", "")))


def broken(references: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """(book, file, kind, value, why) of internal references whose file, or for an href whose anchor, is missing."""
    x = resolved_references(references).where("NOT external AND target <> ''")
    there = files.select("book", F.col("file").alias("target")).distinct().withColumn("there", F.lit(True))
    known = ids.select("book", F.col("file").alias("target"), F.col("id").alias("anchor")).distinct().withColumn("known", F.lit(True))
    x = x.join(there, ["book", "target"], "left").join(known, ["book", "target", "anchor"], "left")
    lost = (F.col("kind") == "href") & (F.coalesce("anchor", F.lit("")) != "") & F.col("known").isNull()
    why = F.when(F.col("there").isNull(), F.when(F.col("kind") == "href", "missing href").otherwise("missing resource")).when(lost, "missing anchor")
    return x.select("book", "file", "kind", "value", why.alias("why")).where("why IS NOT NULL")


def findings(manifest: DataFrame, files: DataFrame, ids: DataFrame, references: DataFrame, targets: DataFrame) -> DataFrame:
    """(book, finding, value, n): everything wrong, and how often; broken links count each time they occur."""
    b = broken(references, files, ids).withColumn("value", F.concat("file", F.lit(": "), "why", F.lit(" "), "value"))
    parts = (
        missing_files(manifest, files).select("book", F.lit("missing_manifest_item").alias("finding"), F.col("file").alias("value")),
        missing_anchors(targets, ids).select("book", F.lit("missing_page_anchor").alias("finding"), F.col("src").alias("value")),
        b.select("book", F.when(F.col("kind") == "href", "broken_internal_link").otherwise("broken_resource_link").alias("finding"), "value"),
    )
    return reduce(DataFrame.unionByName, parts).groupBy("book", "finding", "value").agg(F.count(F.lit(1)).alias("n"))


def counters(manifest: DataFrame, spine: DataFrame, files: DataFrame, references: DataFrame, targets: DataFrame, points: DataFrame) -> DataFrame:
    """Per book how many items, spine entries, chapters among them, navigation points, page targets, external
    links and images there are. points: book, one row a navigation point."""
    n = lambda df, to: df.groupBy("book").agg(F.count(F.lit(1)).alias(to))
    external = references.where((F.col("kind") == "href") & t.is_external(F.col("value")) & (F.col("value") != ""))
    parts = (
        n(spine, "spine_count"), n(spine_chapters(spine, manifest), "spine_xhtml_count"), n(points, "ncx_navpoints"), n(targets, "ncx_page_targets"), n(external, "external_links"),
        n(files.where(F.col("file").rlike(IMAGES)), "image_count"),
    )
    out = n(manifest, "manifest_count")
    for p in parts:
        out = out.join(p, "book", "full")
    return out.na.fill(0)


def report(counts: DataFrame, found: DataFrame) -> DataFrame:
    """counters with the findings: each kind's distinct values in order (all of them, as a book's report has), and
    the number of problems."""
    kinds = ("missing_manifest_item", "missing_page_anchor", "broken_internal_link", "broken_resource_link")
    listed = [F.array_sort(F.collect_set(F.when(F.col("finding") == k, F.col("value")))).alias(f"{k}s") for k in kinds]
    times = F.sum(F.when(F.col("finding") == "broken_internal_link", F.col("n")).otherwise(1)).alias("issue_count")
    out = counts.join(found.groupBy("book").agg(*listed, times), "book", "left")
    return out.select(*counts.columns, *[F.coalesce(f"{k}s", F.array().cast("array<string>")).alias(f"{k}s") for k in kinds], F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
