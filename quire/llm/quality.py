"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)), which is
linear in the number of non-zero inputs. Inputs: SLOTS hashed words (log counts, scaled to length 1),
statistics of the text's structure, and metadata (the logarithm of n_chars, what it differs from the text's
own length by, and whether it is missing). labels, lang, source and doc_id are never inputs.

The model is fitted on at most about MOST_LABELLED labelled training rows (by hash; a documented bound, so
that the driver's share is fixed) by Adam in numpy; equal rows are sent once, with their number. Scoring covers
every row and whole texts.

A null text is empty; its score comes from the statistics alone. With no usable labels, or labels of one
class only, the score is that class's share (0.5 without labels). Null labels are ignored, as are
labels of unknown documents; a document labelled twice counts twice. Repeated rows score alike. A table
without n_chars counts as one of nulls. An empty table gives no row. Other columns are ignored, or kept with
`keep`, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, frugal, held_out, held_out_of, released, sampled, written

SLOTS, RANK = 1 << 12, 8
MOST_LABELLED = 8000
CHUNK = 200
#: Names of the structure statistics and metadata, in the order of their inputs.
STATISTICS = (
    "log_words", "log_lines", "mean_word", "distinct_words", "top_word", "distinct_lines", "upper", "digit", "punctuation", "symbol", "non_ascii",
    "space", "short_words", "long_words", "repeated_pairs", "line_words", "ends_sentence", "bar_words", "caps_words", "metadata_chars", "metadata_against_text", "metadata_missing",
)
_UPPER, _DIGIT = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")
_TABLE = bytes(
    0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if chr(c) in ".,;:'\"()-" else 4 if 33 <= c <= 126 else 5 if c >= 128 else 6 for c in range(256)
)
_slot: dict[bytes, int] = {}


def slot_of(word: bytes) -> int:
    """A word's input, remembered for as many words as fit a bounded table."""
    s = _slot.get(word)
    if s is None:
        if len(_slot) > 100_000:
            _slot.clear()
        s = _slot[word] = zlib.crc32(word) % SLOTS
    return s


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's non-zero inputs."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    lower = Counter()
    for w, c in counts.items():
        lower[slot_of(w.lower())] += c
    kinds = np.bincount(np.frombuffer(raw.translate(_TABLE), np.uint8), minlength=7) if raw else np.zeros(7)
    size = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    given = n_chars is not None and n_chars >= 0
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    s = np.array(
        [
            np.log1p(n) / 5, np.log1p(len(lines)) / 3, min(lengths.mean(), 30) / 10, len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
            len(set(lines)) / max(1, len(lines)), kinds[0] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size,
            kinds[6] / size, (lengths <= 2).mean(), (lengths > 12).mean(), 1 - pairs / max(1, n - 1), np.log1p(n / max(1, len(lines))) / 4,
            sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)), counts[b"|"] / max(1, n), sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / max(1, n),
            np.log1p(n_chars) / 4 if given else 0.0, np.log1p(n_chars) - np.log1p(len(text or "")) if given else 0.0, 0.0 if given else 1.0,
        ]
    )
    slots = np.fromiter(lower, int, len(lower))
    values = np.log1p(np.fromiter(lower.values(), float, len(lower)))
    if len(values):
        values /= np.sqrt((values**2).sum())
    return np.concatenate([slots, SLOTS + np.arange(len(s))]), np.concatenate([values, s])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, values and row starts of several rows; the statistics standardised."""
        starts = np.cumsum([0, *(len(i) for i, _ in rows)])[:-1]
        index = np.concatenate([i for i, _ in rows]).astype(int)
        value = np.concatenate([x for _, x in rows]).astype(float)
        dense = index >= SLOTS
        k = index[dense] - SLOTS
        value[dense] = np.clip((value[dense] - self.mean[k]) / self.scale[k], -6, 6) * 0.5
        return index, value, starts

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.inputs(rows)), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, times: np.ndarray | None = None, epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> Machine:
    """Adam on the logistic loss with weight decay; both classes weigh alike half-way to balance. times: how
    often each row occurs."""
    width = SLOTS + len(STATISTICS)
    times = np.ones(len(labels)) if times is None else times
    share = float(np.average(labels, weights=times)) if len(labels) else 0.5
    rng = np.random.default_rng(seed)
    dense = np.array([x[-len(STATISTICS) :] for _, x in rows]) if rows else np.zeros((1, len(STATISTICS)))
    m = Machine(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(width), rng.normal(0, 0.02, (width, RANK)), dense.mean(0), dense.std(0) + 1e-3)
    if not 0 < share < 1:
        m.factors[:] = 0
        return m
    weight = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share))) * times / times.mean()
    state = [np.zeros(width), np.zeros(width), np.zeros((width, RANK)), np.zeros((width, RANK))]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            index, value, starts = m.inputs([(rows[i][0], rows[i][1].copy()) for i in pick])
            vx = m.factors[index] * value[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            g = (1 / (1 + np.exp(-np.clip(m.logits(index, value, starts), -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            each = np.repeat(np.arange(len(pick)), np.diff([*starts, len(index)]))
            gx = g[each] * value
            gl = np.bincount(index, gx, width) + decay * m.linear
            apart = gx[:, None] * (sums[each] - vx)
            gf = np.stack([np.bincount(index, apart[:, f], width) for f in range(RANK)], axis=1) + decay * m.factors
            t += 1
            for p, grad, a, b in ((m.linear, gl, state[0], state[1]), (m.factors, gf, state[2], state[3])):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            m.bias -= rate * float(g.sum())
    return m


INPUTS = "index binary, value binary, quality int"


def _chars(docs: DataFrame) -> Column:
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list, np.ndarray, np.ndarray]:
    """Inputs, labels and numbers of the training sample's distinct rows."""
    batched(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("quality"))
    train = docs.where(~held_out(3, 1)).select("doc_id", "text", _chars(docs).alias("n_chars"))
    known = sampled(known.where(known.labelled_id.isNotNull() & ~held_out_of("labelled_id", 3, 1)), most, "labelled_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, n, q in zip(b["text"], b["n_chars"], b["quality"], strict=True):
                index, value = features(text if isinstance(text, str) else None, None if pd.isna(n) else n)
                rows.append((index.astype(np.int16).tobytes(), value.astype(np.float32).tobytes(), q))
            yield pd.DataFrame(rows, columns=["index", "value", "quality"])

    # The labels are few by now; Spark broadcasts them by their size, or deals both sides. An id may name many
    # rows, so the rows are sampled too; packed inputs are a few KB a row for the driver.
    sample = train.join(written(known, "labels"), F.col("doc_id") == F.col("labelled_id"))
    inputs = written(sample.select("text", "n_chars", "quality").mapInPandas(frugal(run, _slot), INPUTS), "inputs")
    inputs = inputs.groupBy("index", "value", "quality").agg(F.count(F.lit(1)).alias("times"))
    # In an order of their own, so that the fit doesn't depend on how rows came.
    got = sorted((bytes(r["index"]), bytes(r["value"]), r["quality"], r["times"]) for r in sampled(inputs, most, "index", "value", "quality").collect())
    rows = [(np.frombuffer(i, np.int16), np.frombuffer(x, np.float32)) for i, x, _, _ in got]
    return rows, np.array([q for *_, q, _ in got]), np.array([n for *_, n in got], float)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, machine: Machine, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with keep, docs' own columns and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # of fixed size
    batched(spark)
    base = docs.withColumn("q_chars", _chars(docs)).withColumn("q_held", held_out(3, 1))
    base = base if keep else base.select("doc_id", "text", "q_chars", "q_held")

    def values(batch: pd.DataFrame) -> np.ndarray:
        """Scores, CHUNK rows at a time: an Arrow batch of long texts has more inputs than memory should hold."""
        out = []
        for at in range(0, len(batch), CHUNK):
            part = batch.iloc[at : at + CHUNK]
            out.append(shared.value.score([features(t if isinstance(t, str) else None, None if pd.isna(n) else n) for t, n in zip(part["text"], part["q_chars"], strict=True)]))
        return np.concatenate(out) if out else np.zeros(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = values(b)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["q_held"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    if not keep:
        return base.mapInPandas(frugal(run, _slot), SCORED)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            for text, q_chars in batches:
                yield pd.Series(values(pd.DataFrame({"text": text, "q_chars": q_chars})))
        finally:
            released(_slot)

    return base.withColumn("score", score("text", "q_chars")).select(*docs.columns, "score")


def classifier(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(*training_rows(docs, labels))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, classifier(docs, labels))
