"""Embedding whitening: an exact scatter from residue numbers, and its eigenvectors.

An entry c of a vector becomes the whole number x = floor(1024 c) + 100000. With n vectors and sums S per dimension,
y = n x - S is centred and whole too, and V = sum of y y' / n^3 is x's covariance without any rounding:

1. One pass gives n, S and the range of every dimension: a row per dimension and task, added up by Spark.
2. From n and the ranges follows how large a cell of the scatter can be, and so how many primes below 2^22 are needed
   for their product to exceed twice that. Every task reduces y modulo each prime, to numbers of at most 2^21 on either
   side of 0, and multiplies blocks of 2048 rows as matrices of doubles: no sum exceeds 2^53, so all are exact.
3. Tasks' matrices are added modulo their primes, at most 64 at a time; Chinese remaindering gives the whole cells.
4. The covariance is rounded once, to doubles, and eigh gives components. Vectors are projected on the leading ones and
   divided by the root of the eigenvalue. A pass over what that gives measures its covariance against the identity, in
   tasks' centred parts that are merged without subtracting large numbers.

What the driver gets is of the size of the scatter (dimensions squared, a number per prime), whatever the number of vectors.

Vectors that are null or hold a null or a number that isn't finite are dropped, and so are empty ones, those with an entry of
2^43 or more on either side of 0 (x would be no exact whole number of doubles), and those of another length than most have
(ties: the longer). Repeated rows are rows of their own; a null vec_id stays null. With fewer dimensions than components
there are as many as dimensions. A component without variance (one vector, equal vectors, dependent dimensions) has null
whitened values and takes no part in identity_error, which is null if there is no other. No vectors give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import batched, forgotten, frugal, written

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 43)
COMPONENTS, PRIME_BITS, BLOCK = 8, 22, 2048
TOGETHER = 64
_LOW = (1 << 26) - 1


def remaining(vectors: DataFrame, column: str, key: str) -> DataFrame:
    """(key, v) of the vectors whose entries are all numbers within bounds."""
    sound = F.forall("v", lambda c: c.isNotNull() & F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).where((F.size("v") > 0) & sound)


def _whole(v: np.ndarray | pd.Series) -> np.ndarray:
    return np.floor(SCALE * (np.stack(v.to_list()) if isinstance(v, pd.Series) else v)).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int], int]:
    """How many vectors of the usual length there are, the sum of each dimension, and the widest dimension's range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}  # by length: high and low parts of sums, least, most, and how many
        for b in batches:
            for dims, v in b["v"].groupby(b["v"].map(len)):
                x = _whole(v)
                new = np.stack([(x >> 26).sum(0), (x & _LOW).sum(0), x.min(0), x.max(0), np.full(dims, len(x))])
                if dims in sums:
                    old = sums[dims]
                    new = np.stack([old[0] + new[0], old[1] + new[1], np.minimum(old[2], new[2]), np.maximum(old[3], new[3]), old[4] + new[4]])
                sums[dims] = new
        for dims, s in sums.items():
            yield pd.DataFrame({"dims": dims, "at": np.arange(dims), "high": s[0], "low": s[1], "least": s[2], "most": s[3], "n": s[4]})

    x = rows.select("v").mapInPandas(frugal(run), "dims int, at int, high long, low long, least long, most long, n long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    x = written(x.groupBy("dims", "at").agg(whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")), "sums")
    if (best := x.where("at = 0").orderBy(F.desc("n"), F.desc("dims")).first()) is None:
        return 0, [], 0
    got = sorted(x.where(F.col("dims") == best["dims"]).collect())  # a row per dimension
    forgotten(x)
    return best["n"], [(int(r["high"]) << 26) + int(r["low"]) for r in got], max(r["most"] - r["least"] for r in got)


def primes(bound: int) -> list[int]:
    """The largest primes below 2^22, as many as it takes for their product to exceed twice the bound."""
    top = 1 << PRIME_BITS
    out: list[int] = []
    bound = max(bound, 1)
    span = 4096  # numbers are sieved from the top in windows of this many
    while prod(out) <= 2 * bound:
        is_prime = np.ones(span, bool)
        for p in range(2, int(top**0.5) + 1):
            is_prime[(-(top - span)) % p :: p] = False
        for q in (top - span + np.flatnonzero(is_prime))[::-1].tolist():
            if prod(out) <= 2 * bound:
                out.append(q)
        top -= span
    return out


def residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n x - S modulo p, on either side of 0, as doubles."""
    r = ((n % p) * (x % p) - np.array([s % p for s in sums])) % p
    return (r - p * (r > p // 2)).astype(np.float64)


def _added(parts: DataFrame, by: list[str], add, schema: str) -> list[Row]:
    """parts (by, part, and what `add` makes one row of) added up, at most TOGETHER at a time: a row for each of `by`."""
    first = parts = written(parts, "parts")
    many = 1 + (parts.agg(F.max("part")).first()[0] or 0)
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / TOGETHER).cast("int")).groupBy(*by, "part").applyInPandas(add, schema)
        if (many := -(-many // TOGETHER)) <= 1:
            out = parts.collect()
            forgotten(first)
            return out


def scatter(rows: DataFrame, n: int, sums: list[int], span: int) -> list[list[int]]:
    """The sum over all vectors of y y' with y = n x - S, exactly."""
    dims, schema = len(sums), "prime int, at int, part int, sums binary"
    moduli = primes(n * (n * span) ** 2)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros((len(moduli), dims, dims), np.int64), None
        for b in batches:
            part = int(b["part"].iloc[0]) if len(b) else part
            v = b["v"][b["v"].map(len) == dims]
            for i in range(0, len(v), BLOCK):
                x = _whole(v.iloc[i : i + BLOCK])
                for k, p in enumerate(moduli):
                    r = residues(x, n, sums, p)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        if part is not None:
            yield pd.DataFrame([(k, i, part, total[k, i, i:].tobytes()) for k in range(len(moduli)) for i in range(dims)], columns=["prime", "at", "part", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        p = moduli[int(group["prime"].iloc[0])]
        out = group.iloc[:1].copy()
        out["sums"] = [(sum(np.frombuffer(s, np.int64) for s in group["sums"]) % p).tobytes()]
        return out

    parts = rows.select("v", F.spark_partition_id().alias("part")).mapInPandas(frugal(multiply), schema)
    got = {(r["prime"], r["at"]): np.frombuffer(bytes(r["sums"]), np.int64) for r in _added(parts, ["prime", "at"], add, schema)}
    return [remaindered([got[k, i] for k in range(len(moduli))], moduli) for i in range(dims)]


def remaindered(parts: list[np.ndarray], moduli: list[int]) -> list[int]:
    """The whole numbers, on either side of 0, of which the parts are the residues: mixed-radix digits are found in
    turn, and then put together."""
    digits: list[np.ndarray] = []
    for r, p in zip(parts, moduli, strict=True):
        value, weight = np.zeros_like(r), 1
        for d, q in zip(digits, moduli, strict=False):
            value, weight = (value + d * weight) % p, weight * q % p
        digits.append((r - value) * pow(weight, -1, p) % p)
    whole = np.zeros(len(parts[0]), object)
    for d, p in zip(reversed(digits), reversed(moduli), strict=True):
        whole = whole * p + d
    m = prod(moduli)
    return [int(w) - m if 2 * int(w) > m else int(w) for w in whole]


def deviations(x: np.ndarray, n: int, sums: list[int], span: int) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of each row of x, exactly."""
    dims = len(sums)
    if dims * (n * span) ** 2 < 1 << 63 and n * (abs(int(x.max())) + abs(int(x.min())) + 1) < 1 << 63:
        return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
    moduli = primes(dims * (n * span) ** 2)
    return remaindered([(residues(x, n, sums, p).astype(np.int64) ** 2 % p).sum(1) % p for p in moduli], moduli)


def whitened(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark = vectors.sparkSession
    batched(spark)
    rows, kind = remaining(vectors, column, key), vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, sums, span = _sums(rows)
    if not n:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    dims = len(sums)
    cells, v = scatter(rows, n, sums, span), np.zeros((dims, dims))
    for i, row in enumerate(cells):
        for j, c in enumerate(row, i):
            v[i, j] = v[j, i] = c / n**3  # whole numbers: rounded once
    values, axes = np.linalg.eigh(v)
    take = min(most, dims)
    values, axes = values[::-1][:take], axes[:, ::-1][:, :take]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(take)])  # the largest entry of each is positive
    trace = sum(row[0] for row in cells) / n**3
    varies = values > dims * np.finfo(float).eps * max(values[0], 0)
    weights = axes[:, varies] / np.sqrt(values[varies])
    base, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - base) - rest) @ weights

    error = _identity_error(rows, dims, project, int(varies.sum()))
    share = [float(e / trace) if trace else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column("v")), dims))
            if not (k := b.num_rows):
                continue
            x = _whole(b.column("v").flatten().to_numpy().reshape(k, dims))
            again = np.repeat(np.arange(k), take)
            w = np.full((k, take), np.nan)
            w[:, varies] = project(x)
            dev = pa.array([Decimal(d) for d in deviations(x, n, sums, span)], pa.decimal128(38, 0))
            columns = [b.column("key").take(again), pa.array(np.tile(np.arange(1, take + 1, dtype=np.int32), k)), pa.array(np.full(k * take, n)), dev.take(again), pa.array(w.reshape(-1), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "component", "n", "deviation", "whitened"])

    out = rows.mapInArrow(frugal(run), schema.split(", explained")[0])
    shares = F.element_at(F.array(*[F.lit(s).cast("double") for s in share]), F.col("component"))
    out = out.withColumn("explained", shares).withColumn("identity_error", F.lit(error).cast("double"))
    return out.withColumnRenamed("key", key)


def _identity_error(rows: DataFrame, dims: int, project, size: int) -> float | None:
    """The largest entry, without sign, of the projections' covariance minus the identity. Each task's part is
    centred on its own mean; parts are merged by the distance of their means."""
    if not size:
        return None
    schema = "part int, n long, mean binary, m binary"

    def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, bytes, bytes]:
        n, mean, m = 0, np.zeros(size), np.zeros((size, size))
        for k, other, q in parts:
            if k:
                apart = other - mean
                m = m + q + np.outer(apart, apart) * (n * k / (n + k))
                n, mean = n + k, mean + apart * (k / (n + k))
        return n, mean.tobytes(), m.tobytes()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = None

        def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            nonlocal part
            for b in batches:
                part = int(b["part"].iloc[0]) if len(b) else part
                v = b["v"][b["v"].map(len) == dims]
                if len(v):
                    w = project(_whole(v))
                    mean = w.mean(0)
                    yield len(w), mean, (w - mean).T @ (w - mean)

        n, mean, m = merged(parts())
        if n:
            yield pd.DataFrame([(part, n, mean, m)], columns=["part", "n", "mean", "m"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, m = merged((k, np.frombuffer(a), np.frombuffer(q).reshape(size, size)) for k, a, q in zip(group["n"], group["mean"], group["m"], strict=True))
        return pd.DataFrame([(int(group["part"].iloc[0]), n, mean, m)], columns=["part", "n", "mean", "m"])

    parts = rows.select("v", F.spark_partition_id().alias("part")).mapInPandas(frugal(measure), schema)
    (r,) = _added(parts, [], add, schema)
    return float(np.abs(np.frombuffer(bytes(r["m"])).reshape(size, size) / r["n"] - np.eye(size)).max())
