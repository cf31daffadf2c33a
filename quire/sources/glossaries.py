"""Glossaries from and to CSV, TBX, Markdown and JSON."""

from __future__ import annotations

import re
from xml.etree import ElementTree as XML

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.markup import tag

COLUMNS = ("source", "translation", "type", "aliases", "frequency", "evidence", "status", "confidence", "locked")
#: Other names of columns.
SYNONYMS = {"term": "source", "source_term": "source", "target": "translation", "target_term": "translation", "term_type": "type"}
SCHEMA = "source string, translation string, type string, aliases array<string>, frequency int, evidence array<string>, status string, confidence double, locked boolean"


def format_of(name: str) -> str:
    return {"csv": "csv", "tbx": "tbx", "xml": "tbx", "md": "md", "markdown": "md", "json": "json"}.get(name.rpartition(".")[2].lower(), "csv")


def _listed(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[;|,]"), t.strip), lambda v: v != "")


def normalised(df: DataFrame) -> DataFrame:
    """Any table with these columns as strings or arrays, coerced leniently; no more than three contexts."""
    have, kinds = set(df.columns), dict(df.dtypes)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    text = lambda c: t.strip(F.coalesce(col(c).cast("string"), F.lit("")))
    many = lambda c: col(c) if kinds.get(c, "").startswith("array") else _listed(col(c).cast("string"))
    return df.select(
        *([F.col("pos")] if "pos" in have else []), text("source").alias("source"), text("translation").alias("translation"), F.coalesce(F.nullif(text("type"), F.lit("")), F.lit("special")).alias("type"),
        many("aliases").alias("aliases"), F.coalesce(col("frequency").cast("string").try_cast("int"), F.lit(0)).alias("frequency"), F.slice(many("evidence"), 1, 3).alias("evidence"),
        F.coalesce(F.nullif(text("status"), F.lit("")), F.lit("pending")).alias("status"), F.coalesce(col("confidence").cast("string").try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(t.lenient_bool(col("locked").cast("string")), F.lit(False)).alias("locked"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for c in df.columns:
        name = re.sub(r"\s+", "_", c.strip().lower())
        df = df.withColumnRenamed(c, SYNONYMS.get(name, name))
    return normalised(df)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of terms, or an object that holds it as terms."""
    df = spark.read.option("multiLine", True).json(path)
    return normalised(df.select(F.explode("terms").alias("x")).select("x.*") if "terms" in df.columns else df)


def _tbx_terms(content: str) -> list[tuple]:
    out = []
    for entry in (e for e in XML.fromstring(content).iter() if tag(e) == "termEntry"):
        words = ["".join(next((x for x in s.iter() if tag(x) == "term"), XML.Element("x")).itertext()).strip() for s in entry.iter() if tag(s) == "langSet"]
        notes: dict[str, str] = {}
        for x in entry:
            if tag(x) in ("descrip", "note"):
                notes.setdefault(x.attrib.get("type", ""), "".join(x.itertext()).strip())
        sure = notes.get("status") == "approved" or notes.get("locked", "").lower() in ("1", "true", "yes", "y", "locked", "approved")
        confidence = notes.get("confidence") or ("1.0" if sure else "0.0")
        out.append((*(words + ["", ""])[:2], notes.get("type", ""), notes.get("aliases", ""), notes.get("frequency", ""), notes.get("evidence", ""), notes.get("status", ""), confidence, notes.get("locked", "")))
    return out


TBX = ("source", "translation", "type", "aliases", "frequency", "evidence", "status", "confidence", "locked")


def read_tbx(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for c in f["value"] for r in _tbx_terms(c)], columns=TBX)

    raw = spark.read.text(path, wholetext=True)
    return normalised(raw.mapInPandas(run, ", ".join(f"{c} string" for c in TBX)))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tables with a source and a translation column, and bullets `- source -> translation`."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", t.strip(F.col("line"))).where("line <> ''")
    row = F.startswith("line", F.lit("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), t.strip)
    x = lines.withColumn("cells", F.when(row, cells)).where(~F.coalesce(F.col("line").rlike(r"^\|[\s:|-]+\|?$"), F.lit(False)))
    low = F.transform("cells", F.lower)
    head = F.array_contains(low, "source") & (F.array_contains(low, "translation") | F.array_contains(low, "target"))
    x = x.withColumn("head", F.last(F.when(head, low), ignorenulls=True).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda *names: F.coalesce(*[F.try_element_at("cells", F.nullif(F.array_position("head", n), F.lit(0)).cast("int")) for n in names], F.lit(""))
    table = x.where(row & ~head & F.col("head").isNotNull()).select(
        "file", "pos", at("source").alias("source"), at("translation", "target").alias("translation"), at("type").alias("type"), at("aliases").alias("aliases"), at("frequency").alias("frequency"),
        at("status").alias("status"), at("confidence").alias("confidence"), at("locked").alias("locked"),
    )
    bullet = r"^[-*]\s*(.+?)(?:\s*->\s*(.*?))?(?:\s*\(([^)]*)\))?$"
    meta = F.filter(F.transform(F.split(F.regexp_extract("line", bullet, 3), ","), t.strip), lambda v: v != "")
    b = x.where(~row & F.col("line").rlike(bullet)).withColumn("meta", meta).select(
        "file", "pos", *[t.strip(F.regexp_extract("line", bullet, i)).alias(n) for i, n in ((1, "source"), (2, "translation"))], F.coalesce(F.get("meta", F.lit(1)), F.lit("")).alias("type"),
        F.lit("").alias("aliases"), F.coalesce(F.get("meta", F.lit(0)), F.lit("")).alias("frequency"), F.regexp_extract("line", r"(?i)confidence\s+([0-9.]+)", 1).alias("confidence"),
    ).where(F.lower("source") != "no pending candidates.")
    sure = (F.col("translation") != "") & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= 0.9)
    # Several files one after another, each in its order; of a source the first counts.
    both = table.unionByName(b, allowMissingColumns=True).withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.when(sure, "approved").otherwise("pending")))
    both = both.withColumn("locked", F.coalesce(F.nullif("locked", F.lit("")), sure.cast("string")))
    whole = normalised(both.withColumn("pos", F.struct("file", "pos")))
    first = whole.groupBy("source").agg(F.min_by(F.struct(*whole.columns), "pos").alias("q")).where("source <> ''").select("q.*")
    return first.orderBy("pos").drop("pos")


def read(spark: SparkSession, path: str) -> DataFrame:
    return {"csv": read_csv, "tbx": read_tbx, "md": read_markdown, "json": read_json}[format_of(path)](spark, path)


def stored(spark: SparkSession, path: str, build=None) -> DataFrame:
    """The terms kept in a JSON file, the first of each source and no noise; without a usable file, or when it is
    empty, what build gives (an empty table by default)."""
    from quire.operators.terms import is_noise

    try:
        df = read_json(spark, path)
        pos = F.monotonically_increasing_id()
        x = df.withColumn("pos", pos).where((F.col("source") != "") & ~is_noise(F.col("source")))
        names = [c for c in df.columns if c != "source"]
        out = x.groupBy("source").agg(F.min_by(F.struct(*names), "pos").alias("q")).select("source", "q.*")
        usable = not out.isEmpty()
    except Exception:  # a missing file, or one that is no list of objects
        usable = False
    if usable:
        return out
    return build() if build else spark.createDataFrame([], SCHEMA)


def csv_rows(terms: DataFrame) -> DataFrame:
    return terms.select(
        "source", "translation", "type", F.concat_ws("; ", "aliases").alias("aliases"), "frequency", F.concat_ws(" | ", "evidence").alias("evidence"), "status",
        F.format_string("%.2f", "confidence").alias("confidence"), "locked",
    )


def markdown(terms: DataFrame, most: int = 80) -> DataFrame:
    """One row: enforced terms as a table, then the most frequent pending ones as bullets (a report's limit)."""
    from quire.operators.terms import enforced

    line = F.concat(F.lit("| "), F.concat_ws(" | ", "source", "translation", "type", F.format_string("%.2f", "confidence")), F.lit(" |"))
    table = enforced(terms).select(line.alias("line"), "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "line"))), lambda x: x["line"]).alias("rows"))
    top = terms.where("status = 'pending'").orderBy(F.desc("frequency"), "source").limit(most)
    bullet = F.concat(F.lit("- "), F.col("source"), F.lit(" -> "), F.col("translation"), F.lit(" ("), F.col("frequency").cast("string"), F.lit(")"))
    pending = top.select((-F.col("frequency")).alias("o"), "source", bullet.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "source", "line"))), lambda x: x["line"]).alias("bullets"))
    head = F.array(F.lit("| source | translation | type | confidence |"), F.lit("| --- | --- | --- | --- |"))
    return table.crossJoin(pending).select(F.array_join(F.concat(head, "rows", "bullets"), "\n").alias("markdown"))  # one row by one


def tbx(terms: DataFrame) -> DataFrame:
    """One termEntry element per row: the two words, type, aliases, status, confidence and lock."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    note = lambda c, v: F.concat(F.lit(f'<descrip type="{c}">'), safe(v), F.lit("</descrip>"))
    side = lambda c: F.concat(F.lit("<langSet><tig><term>"), safe(F.col(c)), F.lit("</term></tig></langSet>"))
    text = lambda c: F.col(c).cast("string")
    notes = (note("type", text("type")), note("aliases", F.concat_ws("; ", "aliases")), note("status", text("status")), note("confidence", F.format_string("%.2f", "confidence")), note("locked", text("locked")))
    return terms.select(F.concat(F.lit("<termEntry>"), *notes, side("source"), side("translation"), F.lit("</termEntry>")).alias("value"))
