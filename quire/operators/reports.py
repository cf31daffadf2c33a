"""Quality reports over transformed rows: what remains untranslated, what drifted, and summaries with their caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import checks
from quire.session import written

#: How much of it a report lists.
LISTED, PER_KIND, VALIDATION_LISTED = 200, 50, 500
#: Messages of issues, with what goes before and after the term.
REMAINS, UNUSED, SEGMENT = " remains untranslated", " does not use locked translation ", "Long source-language segment remains in translated text"
MARKS = "Punctuation or quote balance changed from source text"
PERSON = ("Person name ", " is present in source but neither source nor translation appears in output")



def issue(batch: Column, row_id: Column, kind: str, severity: str, message: Column, **details: Column) -> list[Column]:
    """The columns of an issue; details that are null or empty are left out."""
    listed = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in details.items()]
    kept = F.map_from_entries(F.filter(F.array(*listed), lambda x: F.coalesce(x["value"], F.lit("")) != "")) if listed else F.create_map().cast("map<string,string>")
    return [batch.alias("batch"), row_id.alias("row_id"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"), kept.alias("details")]


def last_of_each(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: a later one replaces an earlier one."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("q")).select(*key, "q.*")


def sourced(target: DataFrame, source: DataFrame) -> DataFrame:
    """Every transformed row (batch, row_id, target) with its source's text, empty where there is none; of
    repeated source ids (with pos) the last counts."""
    s = last_of_each(source.select("batch", "row_id", "pos", "source"), ["batch", "row_id"], F.col("pos")).drop("pos")
    return target.join(s, ["batch", "row_id"], "left").withColumn("source", F.coalesce("source", F.lit("")))


def source_text(text: Column, html: Column) -> Column:
    """A row's text, or else that of its markup."""
    return F.coalesce(F.nullif(text, F.lit("")), t.without_tags(html), F.lit(""))


def named(rows: DataFrame, terms: DataFrame, text: str, key: list[str], to: str) -> DataFrame:
    """(key, term, `to`): which terms occur in which rows by themselves or by an alias. terms: term, aliases."""
    forms = terms.select(F.col("term"), F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("source")).where("source <> ''")
    hits = checks.term_hits(rows, forms.select("source").distinct(), text, key).withColumnRenamed("term", "source")
    return hits.join(forms, "source").select(*key, "term").distinct().withColumn(to, F.lit(True))


def _used(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows with the terms of their sources, and whether each is in the target as it is, or by its translation."""
    key = ["batch", "row_id"]
    x = named(rows, terms, "source", key, "in_source").join(named(rows, terms, "target", key, "in_target"), [*key, "term"], "left")
    x = x.join(rows.select(*key, "target"), key).join(terms.select("term", "translation"), "term")
    return x.withColumn("in_target", F.coalesce("in_target", F.lit(False))).withColumn("translated", (F.col("translation") != "") & F.contains("target", F.col("translation")))


def term_issues(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Issues of enforced terms (term, translation, aliases) in rows (batch, row_id, source, target): a term that
    remains as it is, or else one whose translation is missing."""
    x = _used(rows, terms)
    left = x.where("in_target").select(*issue(F.col("batch"), F.col("row_id"), "untranslated-source-term", "blocking", F.concat("term", F.lit(REMAINS)), source=F.col("term"), translation=F.col("translation")))
    lost = x.where("NOT in_target AND NOT translated AND translation <> ''")
    message = F.concat("term", F.lit(UNUSED), "translation")
    return left.unionByName(lost.select(*issue(F.col("batch"), F.col("row_id"), "missing-locked-translation", "nonblocking", message, source=F.col("term"), translation=F.col("translation"))))


def person_drift(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Issues of persons' names in a source of which the target has neither the name, an alias, nor the
    translation."""
    x = _used(rows, terms.where("translation <> ''")).where("NOT in_target AND NOT translated")
    message = F.concat(F.lit(PERSON[0]), "term", F.lit(PERSON[1]))
    return x.select(*issue(F.col("batch"), F.col("row_id"), "person-name-drift", "nonblocking", message, source=F.col("term"), translation=F.col("translation")))


def segment_issues(rows: DataFrame) -> DataFrame:
    x = rows.select("batch", "row_id", F.explode(checks.long_segments(F.col("source"), F.col("target"))).alias("segment"))
    return x.select(*issue(F.col("batch"), F.col("row_id"), "long-untranslated-segment", "blocking", F.lit(SEGMENT), sample=F.col("segment")))


def marks_issues(rows: DataFrame) -> DataFrame:
    x = rows.where(checks.marks_drift(F.col("source"), F.col("target")))
    detail = F.to_json(F.struct(checks.marks(F.col("source")).alias("source"), checks.marks(F.col("target")).alias("target")))
    return x.select(*issue(F.col("batch"), F.col("row_id"), "punctuation-quote-drift", "nonblocking", F.lit(MARKS), marks=detail))


def quality_issues(rows: DataFrame, persons: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (segment_issues(rows), marks_issues(rows), person_drift(rows, persons)))


def quality_report(rows: DataFrame, issues: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row: totals before any cap; issues listed up to LISTED, and PER_KIND of each kind, and how many these are; the
    worst chapters.
    rows: batch, row_id, source, target; chapters: batch, label, file (the first that is not empty names it)."""
    name = F.coalesce(F.nullif(t.strip("label"), F.lit("")), F.nullif(t.strip("file"), F.lit("")), F.concat(F.lit("batch "), F.col("batch").cast("string")))
    c = chapters.select("batch", name.alias("chapter"))
    unchanged = checks.unchanged_words(rows, ["batch", "row_id"])
    x = rows.join(unchanged, ["batch", "row_id"], "left")
    totals = x.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("unchanged"), F.lit(0)).alias("unchanged"), F.coalesce(F.sum(F.length(F.regexp_replace("source", f"{t.WS}+", ""))), F.lit(0)).alias("visible")
    )
    ratio = F.when(F.col("visible") > 0, F.round(F.col("unchanged") / F.greatest("visible", F.lit(1)), 4)).otherwise(0.0)
    issues = written(issues, "issues")  # what it takes to find them is done once
    placed = issues.join(c, "batch", "left")
    kinds = (("long-untranslated-segment", "long_segments", "long_untranslated_segments"), ("punctuation-quote-drift", "mark_drifts", "punctuation_quote_drift"), ("person-name-drift", "name_drifts", "person_name_drift"))
    split = placed.agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == "blocking").alias("blocking_count"), F.count_if(F.col("severity") != "blocking").alias("nonblocking_count"), F.countDistinct("chapter").alias("chapters_with_issues"),
        F.least(F.count(F.lit(1)), F.lit(LISTED)).alias("listed"), *[F.least(F.count_if(F.col("kind") == k), F.lit(PER_KIND)).alias(to) for k, to, _ in kinds],
    )
    lists = [as_list(listed_issues(issues), "issues"), *[as_list(listed_issues(issues.where(F.col("kind") == k), PER_KIND), to) for k, _, to in kinds]]
    worst = checks.roll_up(placed.select("chapter", "severity"), rows.join(c, "batch"), "chapter")
    worst = worst.agg(F.array_sort(F.collect_list("chapter")).alias("worst"), F.array_sort(F.collect_list(F.struct("chapter", "rows", "issues", "blocking", (F.col("issues") - F.col("blocking")).alias("nonblocking")))).alias("worst_chapters"))
    chapters_ = rows.join(c, "batch").agg(F.countDistinct("chapter").alias("chapters"))
    out = totals.select("row_count", ratio.alias("untranslated_ratio"))
    for one in (split, worst, chapters_, *lists):  # one row each
        out = out.crossJoin(one)
    return out


#: What issues are listed by.
ORDER = ("batch", "row_id", "kind", "message")


def listed_issues(issues: DataFrame, most: int = LISTED) -> DataFrame:
    """The issues that a report lists, in order."""
    return issues.orderBy(*ORDER, F.to_json("details")).limit(most)


def as_list(issues: DataFrame, to: str, first: Column | None = None) -> DataFrame:
    """One row: the issues of a list as an array, in order (of `first`, if told, before all)."""
    item = F.struct((first if first is not None else F.lit(0)).alias("first"), *ORDER, F.to_json("details").alias("more"), "severity", F.map_entries("details").alias("entries"))
    shown = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["batch"].alias("batch"), x["row_id"].alias("row_id"), x["kind"].alias("kind"), x["severity"].alias("severity"), x["message"].alias("message"), F.map_from_entries(x["entries"]).alias("details")))
    return issues.agg(shown.alias(to))


def combined_report(term_issues_: DataFrame, quality: DataFrame, detected: int, fixed: int) -> DataFrame:
    """One row: what remains after repairs. quality: a quality report. Issues of terms go first, then those that the quality
    report lists, LISTED of them in all; a remaining term or a blocking issue of quality fails."""
    t_ = written(term_issues_, "terms")
    counts = t_.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "blocking").alias("b"))
    mine = as_list(listed_issues(t_), "glossary_issues")
    x = counts.crossJoin(mine).crossJoin(quality)  # one row each
    blocking = F.col("b") + F.col("blocking_count")
    return x.select(
        F.when(blocking > 0, "failed").otherwise("passed").alias("status"), (F.lit(detected).cast("long") + F.col("issue_count")).alias("detected"), F.lit(fixed).cast("long").alias("fixed"),
        (F.col("n") + F.least("issue_count", F.lit(LISTED))).alias("remaining"), blocking.alias("blocking_remaining"), (F.col("n") - F.col("b") + F.col("nonblocking_count")).alias("nonblocking_remaining"),
        "glossary_issues", F.slice(F.concat("glossary_issues", "issues"), 1, LISTED).alias("issues"), F.struct(*[F.col(c) for c in quality.columns]).alias("quality"),
    )


def validation_report(batches: DataFrame, done: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: batches, those done and without issues, all issues (a batch not done is one), and the first of
    them. batches, done: batch; issues: batch, rule, row_id."""
    missing = batches.join(done, "batch", "left_anti").select("batch", F.lit("missing output").alias("rule"), F.lit("").alias("row_id"))
    x = issues.join(done, "batch", "left_semi").select("batch", "rule", "row_id").unionByName(missing)
    clean = done.join(batches, "batch", "left_semi").join(issues.select("batch").distinct(), "batch", "left_anti").agg(F.count(F.lit(1)).alias("completed_without_issues"))
    text = F.concat_ws(" ", "rule", F.col("batch").cast("string"), "row_id")
    first = x.orderBy("batch", "rule", "row_id").limit(VALIDATION_LISTED).agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "rule", "row_id", text.alias("text")))), lambda v: v["text"]).alias("issues"))
    counts = batches.agg(F.count(F.lit(1)).alias("batch_count")).crossJoin(x.agg(F.count(F.lit(1)).alias("issue_count")))
    return counts.crossJoin(clean).crossJoin(first)  # one row by one


def to_repair(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """The rows in which a term remains untranslated: those that a repair may change."""
    return rows.join(issues.where(F.col("kind") == "untranslated-source-term").select("batch", "row_id").distinct(), ["batch", "row_id"], "left_semi")


def repaired(rows: DataFrame, issues: DataFrame, terms: DataFrame) -> DataFrame:
    """(batch, row_id, target, changed): the rows to repair with their terms and aliases replaced, the longest first."""
    forms = terms.select("translation", F.explode(F.concat(F.array("term"), "aliases")).alias("form")).where("form <> '' AND translation <> ''")
    x = to_repair(rows, issues)
    hit = checks.term_hits(x, forms.select(F.col("form").alias("source")).distinct(), "target", ["batch", "row_id"]).withColumnRenamed("term", "form").join(forms, "form")
    per = hit.groupBy("batch", "row_id").agg(F.array_sort(F.collect_set(F.struct((-F.length("form")).alias("n"), "form", "translation"))).alias("forms"))
    new = F.aggregate("forms", F.col("target"), lambda acc, f: t.replace_term(acc, f["form"], f["translation"]))
    out = x.join(per, ["batch", "row_id"], "left").withColumn("new", F.coalesce(new, "target"))
    return out.select("batch", "row_id", F.col("new").alias("target"), (F.col("new") != F.col("target")).alias("changed"))


def progress(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """One row: batches, those with an output, and the text of a short report."""
    n = manifest.agg(F.count(F.lit(1)).alias("batches")).crossJoin(manifest.join(done, "batch", "left_semi").agg(F.count(F.lit(1)).alias("completed")))
    return n.withColumn("report", F.format_string("# Report\n\n- Batches: %d\n- Completed batches: %d\n", "batches", "completed"))


