"""Batches put through a pluggable transform: checked, split where that may help, and resumed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.markup import TEXT_TAGS, rendered, snippet, structure_issues
from quire.functions.split import cut
from quire.session import hadoop

#: A transform takes the rows of one batch (id, source_html) and returns rows (id, translated_html).
Transform = Callable[[pd.DataFrame], pd.DataFrame]
RESULT = "batch long, id string, translated_html string, error string"


def constant(text: str = "text") -> Transform:
    """A transform without a service: every element's text becomes a constant. For tests and rehearsals."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        def one(html: str) -> str:
            e = snippet(html)
            for x in e.iter():
                x.text, x.tail = text if x.tag in TEXT_TAGS or x is e else "", None
            return rendered(e)

        return pd.DataFrame({"id": rows["id"], "translated_html": rows["source_html"].map(one)})

    return run


def _checked(rows: pd.DataFrame, out: pd.DataFrame) -> str | None:
    if list(out["id"]) != list(rows["id"]):
        return "ids differ"
    bad = [(i, x[0]) for i, s, g in zip(rows["id"], rows["source_html"], out["translated_html"], strict=True) for x in structure_issues(s, g)]
    return f"{bad[0][0]}: {bad[0][1]}" if bad else None


def _in_pieces(transform: Transform, limit: int) -> Transform:
    """A transform of rows of which a long one without child elements is cut into pieces, each a request of its
    own, and put together again without loss."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        e = snippet(rows["source_html"].iloc[0]) if len(rows) == 1 else None
        if e is None or len(e) or len(e.text or "") <= limit:
            return transform(rows)
        texts = []
        for piece in cut(e.text, limit):
            part = snippet(rows["source_html"].iloc[0])
            part.text = piece
            one = transform(pd.DataFrame({"id": rows["id"], "source_html": [rendered(part)]}))
            if list(one["id"]) != list(rows["id"]):
                raise ValueError("ids differ")
            texts.append("".join(snippet(one["translated_html"].iloc[0]).itertext()))
        e.text = "".join(texts)
        return pd.DataFrame({"id": rows["id"], "translated_html": [rendered(e)]})

    return run


def transformed(rows: DataFrame, transform: Transform, retries: int = 2, depth: int = 8, limit: int = 6000) -> DataFrame:
    """rows (batch, seq, id, source_html) through the transform, a batch at a time. A batch that fails or
    whose result does not pass the checks is tried again, then in halves; what fails alone keeps its error.
    Transforms may run more than once for a row (tasks are retried), so they must not have effects of
    their own. A row longer than `limit` characters that stands alone is cut into pieces."""
    transform = _in_pieces(transform, limit)

    def attempt(part: pd.DataFrame, left: int) -> list[tuple]:
        error = ""
        for _ in range(1 + retries):
            try:
                out = transform(part)
                if not (why := _checked(part, out)):
                    return [(i, h, None) for i, h in zip(out["id"], out["translated_html"], strict=True)]
                error = why
            except Exception as e:  # a transform is foreign code
                error = str(e)
        if len(part) > 1 and left:
            half = len(part) // 2
            return attempt(part.iloc[:half], left - 1) + attempt(part.iloc[half:], left - 1)
        return [(i, None, error[:500]) for i in part["id"]]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        out = pd.DataFrame(attempt(group[["id", "source_html"]], depth), columns=["id", "translated_html", "error"])
        return out.assign(batch=group["batch"].iloc[0])[["batch", "id", "translated_html", "error"]]

    return rows.groupBy("batch").applyInPandas(run, RESULT)


#: A round's results: the batch's part (a path of halves: 0 the first, 1 the second), which attempt at it this was, and what a row
#: that failed has to wait for; `final` if nothing.
ROUND = "batch long, part string, attempt int, seq long, id string, translated_html string, error string, final boolean, next_part string, next_attempt int"


def results(spark: SparkSession, path: str) -> DataFrame:
    """(batch, id, translated_html, error, round, part): of every row of a path's rounds the result that passed the checks,
    or else the last error."""
    x = spark.read.schema(f"{ROUND}, round int").parquet(path)
    best = F.max_by(F.struct("translated_html", "error", "round", "part"), F.struct(F.col("error").isNull(), "round"))
    return x.groupBy("batch", "id").agg(best.alias("q")).select("batch", "id", "q.*")


def _rounds(spark: SparkSession, path: str) -> list[int]:
    p, fs = hadoop(spark, path)
    names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    # A round that was cut off has no mark of its commit, and is done again in its place.
    return sorted(int(n.getName()[6:]) for n in names if n.getName().startswith("round=") and fs.exists(hadoop(spark, f"{path}/{n.getName()}/_SUCCESS")[0]))


def in_rounds(rows: DataFrame, transform: Transform, path: str, retries: int = 2, depth: int = 8, limit: int = 6000) -> DataFrame:
    """What `transformed` gives, with every attempt of all batches a round of its own: a job that asks for what is still
    open, and writes what came. Later rounds ask only for what failed, again or in halves, so neither a lost executor nor
    a driver that is started anew asks twice for what is written; one that goes on at a path starts with the rows that
    have no result there. Gives `results`."""
    spark, ask = rows.sparkSession, _in_pieces(transform, limit)

    def once(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq").reset_index(drop=True)
        part, attempt, n = group["part"].iloc[0], int(group["attempt"].iloc[0]), len(group)
        try:
            out = ask(group[["id", "source_html"]])
            error = _checked(group, out)
        except Exception as e:  # a transform is foreign code
            out, error = None, str(e) or type(e).__name__
        done = group[["batch", "part", "attempt", "seq", "id"]].copy()
        done["translated_html"] = None if error else list(out["translated_html"])
        done["error"] = error[:500] if error else None
        again = attempt < retries
        done["final"] = not error or not again and (n == 1 or len(part) >= depth)
        done["next_part"] = part if again else [part + ("0" if i < n // 2 else "1") for i in range(n)]
        done["next_attempt"] = attempt + 1 if again else 0
        return done

    have = _rounds(spark, path)
    number = have[-1] + 1 if have else 0
    open_ = rows.select("batch", "seq", "id", "source_html")
    if have:
        open_ = open_.join(results(spark, path).where(F.col("error").isNull()).select("batch", "id"), ["batch", "id"], "left_anti")
    open_ = open_.withColumn("part", F.lit("")).withColumn("attempt", F.lit(0))
    while not open_.isEmpty() or not number:
        at = f"{path}/round={number}"
        open_.groupBy("batch", "part", "attempt").applyInPandas(once, ROUND).write.mode("overwrite").parquet(at)
        failed = spark.read.schema(ROUND).parquet(at).where("error IS NOT NULL AND NOT final").select("batch", "id", F.col("next_part").alias("part"), F.col("next_attempt").alias("attempt"))
        open_, number = rows.select("batch", "seq", "id", "source_html").join(failed, ["batch", "id"]), number + 1
    return results(spark, path)


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows of batches of which not every row is done: what a resumed run has to do."""
    ok = done.where(F.col("error").isNull()).select("batch", "id")
    open_ = rows.join(ok, ["batch", "id"], "left_anti").select("batch").distinct()
    return rows.join(open_, "batch", "left_semi")


def merged(parts: DataFrame) -> DataFrame:
    """Pieces (id, n, text) of split rows put together again."""
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
