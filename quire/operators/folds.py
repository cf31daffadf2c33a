"""Folds over ordered rows: each key's rows stream by in order, and only the fold's state is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import forgotten, written

#: A step takes the state and a row's values, and gives the next state and what to add to the row.
Step = Callable[[Any, tuple], tuple[Any, tuple]]


def _plain(x: Any) -> Any:
    return None if x is None or x is pd.NA or x is pd.NaT or x != x else x


def folded(df: DataFrame, key: str, order: list[Column], read: list[str], start: Any, step: Step, added: str) -> DataFrame:
    """df with the columns `added` (a schema) of a fold over each key's rows in order. Rows are dealt by key and
    sorted, so no key has to fit into memory: a key with a third of all rows is one pass of one task. `start` is
    the state before a key's first row and must not be changed in place. Ties are in no order of their own."""
    names = [x.split()[0] for x in added.split(", ")]
    kinds = {"boolean": "boolean", "int": "Int32", "long": "Int64", "double": "Float64", "string": "object"}
    types = {x.split()[0]: kinds[x.split()[1]] for x in added.split(", ")}
    at = {f"q_order{i}": o for i, o in enumerate(order)}
    rows = df.withColumns(at).repartition(key).sortWithinPartitions(key, *at).drop(*at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, start, False
        for f in frames:
            out: list[tuple] = []
            for k, *values in zip(f[key].tolist(), *(f[c].tolist() for c in read), strict=True):
                k = _plain(k)
                if not begun or k != last:
                    last, state, begun = k, start, True
                state, more = step(state, tuple(map(_plain, values)))
                out.append(more)
            new = pd.DataFrame(out, columns=names, index=f.index).astype(types)
            yield pd.concat([f.convert_dtypes(convert_string=False, convert_floating=False), new], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, {added}")


def positions(df: DataFrame, by: str, ties: list[Column], to: str, ranges: int | None = None) -> DataFrame:
    """df with `to`: the place from 1 of every row in the order of a column and ties, nulls first. Rows are dealt out by
    ranges of both (as many as the session's shuffles have partitions, if not told), so that neither all rows nor those of
    one frequent value meet in a task; a range's numbers start after the counts of those before it. Ranges come from a
    sample, so they are fixed by writing them once; and so that sampling doesn't work out all rows, these are written before."""
    order = [F.col(by), *ties]
    source = written(df, "rows")
    x = written(source.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("q_at", F.monotonically_increasing_id()), "places")
    forgotten(source)
    place, at = F.shiftright("q_at", 33), F.col("q_at").bitwiseAND(F.lit((1 << 33) - 1))  # Spark's id: the partition, and the row's number in it
    x = x.withColumn("q_range", place)
    before, upto = [], 0
    for r in sorted(x.groupBy("q_range").count().collect()):  # one row a range
        before.append((r["q_range"], upto))
        upto += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "q_range long, q_before long")
    return x.join(F.broadcast(offsets), "q_range").withColumn(to, at + F.col("q_before") + 1).drop("q_at", "q_range", "q_before")


def nearest_rank(counts: DataFrame, key: str, value: str, percent: int, to: str, width: int = 1024) -> DataFrame:
    """(key, `to`) of (key, value, n: how often): the least value (a whole number of at least 0) up to which a percentage of
    the occurrences lie. Running sums are taken over ranges of `width` values, and then within the one range that the
    rank falls into, so what meets in a task is neither all rows nor all values of a key."""
    x = counts.withColumn("q_range", F.floor(F.col(value) / width))
    ranges = x.groupBy(key, "q_range").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(key)
    ranges = ranges.withColumn("q_upto", F.sum("n").over(whole.orderBy("q_range"))).withColumn("q_all", F.sum("n").over(whole))
    reached = F.col("q_upto") * 100 >= F.col("q_all") * percent
    first = ranges.where(reached).groupBy(key).agg(F.min_by(F.struct("q_range", (F.col("q_upto") - F.col("n")).alias("before"), "q_all"), "q_range").alias("q")).select(F.col(key).alias("q_key"), "q.*")
    x = x.join(first.withColumnRenamed("q_range", "q_chosen"), F.col(key).eqNullSafe(F.col("q_key")) & (F.col("q_range") == F.col("q_chosen")))
    x = x.withColumn("q_upto", F.col("before") + F.sum("n").over(whole.orderBy(value)))
    return x.where(F.col("q_upto") * 100 >= F.col("q_all") * percent).groupBy(key).agg(F.min(value).alias(to))


def numbered(df: DataFrame, key: str, order: list[Column], to: str = "seq") -> DataFrame:
    """df with `to`: the place from 1 of every row among those of its key, in order. Rows are dealt out by ranges of key and
    order, so a key with any share of the rows is spread over as many tasks; what its earlier ranges hold is added. Rows are
    written first, as dealing them out reads them twice."""
    source = written(df, "rows")
    rows = source.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("q_range", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.LongType()), T.StructField("q_first", T.BooleanType()), T.StructField("q_row", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, row, first = None, 0, 0, False
        for b in batches:
            if not (n := b.num_rows):
                continue
            k = b.column(b.schema.get_field_index(key))
            new = changes(k, last)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start + 1, at + count + 1)
            own = np.where(start < 0, first, (start == 0) & (last is None))  # of the range's first key
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(own), pa.array(at + row)], [*b.schema.names, to, "q_first", "q_row"])
            first = bool(own[-1])
            last, count, row = k.slice(n - 1, 1), int(place[-1]), row + n

    x = written(rows.mapInArrow(run, schema), "numbered")
    forgotten(source)
    ends = x.groupBy("q_range").agg(F.min_by(key, "q_row").alias("head"), F.count_if("q_first").alias("heads"), F.max_by(key, "q_row").alias("tail"), F.max_by(to, "q_row").alias("tails"), F.count(F.lit(1)).alias("n"))
    before, open_key, held = [], None, 0
    for i, r in enumerate(sorted(ends.collect(), key=lambda r: r["q_range"])):  # one row a range
        goes_on = i > 0 and r["head"] == open_key
        before.append((r["q_range"], held if goes_on else 0))
        held = r["tails"] + (held if goes_on and r["heads"] == r["n"] else 0)
        open_key = r["tail"]
    offsets = df.sparkSession.createDataFrame(before, "q_range int, q_before long")
    x = x.join(F.broadcast(offsets), "q_range")
    return x.withColumn(to, F.col(to) + F.when(F.col("q_first"), F.col("q_before")).otherwise(0)).drop("q_range", "q_first", "q_row", "q_before")


def changes(k: pa.Array, last: pa.Array | None) -> np.ndarray:
    """Where a sorted column has another value than in the row before (last: the row before the first); nulls are one
    value."""
    out = np.ones(len(k), bool)
    x, y = k.slice(0, len(k) - 1), k.slice(1)
    out[1:] = ~(pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False) | pc.and_(pc.is_null(x), pc.is_null(y)).to_numpy(zero_copy_only=False))
    out[0] = last is None or k[0].as_py() != last[0].as_py()
    return out
