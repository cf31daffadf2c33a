"""LM scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The vocabulary is factored into a softmax over symbols and one over each symbol's words. Symbols are the end, the
other most frequent training tokens (HEAD with it), each a word by itself, and SHAPES classes of all other words
(a class follows from a word's spelling). The model scores a symbol w after the two symbols before it: each
context symbol's vector is weighted by its place, the sum predicts a vector, and its product with the vector of w,
plus a bias, is the score. A class's words have vectors too, as many as the corpus has words (up to KNOWN, a bound
of memory): a word's score within its class is its vector's product with a second vector of the last frequent word
before it, plus a bias; words of fewer than LEAST occurrences learn no vector and keep their share. A known token beyond KNOWN has its class's probability times its own share of the class in
the training counts; the words of KNOWN share what is left. Each class keeps a share for unknown words, taken as
one symbol (as the base score does), by Good and Turing's estimate. So all words and unknown symbols share a
probability of 1.

Training: documents are dealt to shards and rounds by hashes of doc_id and text; the number of shards follows from
the number of training tokens (one for each SHARD). In a round each shard goes through its documents by Adagrad on
the noise-contrastive loss (noise from the unigram shares, shared within a batch; within classes, the class's) from
the parameters that the round before left; the shards' parameters are averaged, weighted by tokens, in slices of
bounded size. Corpora of any size are gone through once, in the same rounds. The order in a shard
is that of the hashes, so neither parameters nor scores hang on how the input is split.

Texts are read into tokens twice, to count words and to name them by their places in a table that all tasks have;
training and scoring go on from the places.

Scoring: as a symbol's score is a sum of one term for each context place, the normaliser of every pair of contexts
comes from one product of two matrices of exponentials; those of classes from products of the context vectors with
the classes' words. A token then costs a few look-ups and at most one product of short vectors.

Counts: words' training counts are summed over all documents into a table. Tasks get the counts of at most KNOWN
words of at most 64 bytes (a proven bound); all other words, pre-summed by document, are joined with the table. A
null or empty text has one token, the end; very long texts are scored whole. A null doc_id belongs to the training
part as crc32 of the empty text says (0, so it is held out). Repeated rows are scored and, as training rows,
counted each. Without training rows all counts are 0 and the model is uniform in its classes. An empty table gives
no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, batched, forgotten, frugal, held_out, text_or_empty, written

HEAD, SHAPES, WIDTH, NARROW = 960, 64, 16, 8
KNOWN, KNOWN_BYTES = 200_000, 64
BATCH, GROUP, NOISE, RATE = 4096, 128, 16, 0.12
TAIL_BATCH, TAIL_GROUP, TAIL_NOISE = 16_384, 16, 8
SHARD = 2_000_000
#: The shares of the documents that the rounds learn from.
ROUNDS = (0.1, 0.3, 0.6)
SLICE, CHUNK = 1 << 16, 1 << 17
FLUSH, LEAST = 800_000, 4
SMOOTH = 0.1
END = b""  # no word is empty


def shape(word: bytes) -> int:
    """A word's class: from its length, its last character, and the first of its non-ASCII characters."""
    size = (len(word) > 3) + (len(word) > 7) + (len(word) > 12)
    mark = word[-1:] in (b".", b",", b"!", b"?", b";", b":")
    if not word.isascii():
        kind = 2 + next(b for b in word if b >= 0xC0) % 2 + 2 * (next((b for b in word if 0x80 <= b < 0xC0), 0) % 3)
    else:
        kind = 0 if word.isalpha() or (mark and word[:-1].isalpha()) else 1
    return size + 4 * mark + 8 * min(kind, 7)


@dataclass
class Lexicon:
    """Counts of the words that every task knows, and what the classes' other words sum to."""

    index: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray  # of the known words
    words: int  # of the model
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_once: np.ndarray  # of them, those of words that occur once

    @property
    def size(self) -> int:
        return self.words + SHAPES

    @property
    def tail(self) -> int:
        """How many known words are in classes; they follow the head's words in the index."""
        return len(self.counts) - self.words

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1)))

    def unknown(self) -> np.ndarray:
        """What each class leaves for unknown words, as one: as much as its words that occur once have (what the
        next token is new with, by Good and Turing's estimate); at least SMOOTH of a token."""
        return np.maximum(self.class_once, SMOOTH) / np.maximum(self.class_tokens, SMOOTH)

    def within(self, c: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 share of a word in its class by its count."""
        u = np.minimum(self.unknown(), 1 - 1e-9 * (self.class_tokens > 0))[cls]
        return np.log10(np.where(c > 0, (1 - u) * c / np.maximum(self.class_tokens[cls], SMOOTH), u))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all training documents; the end is the empty token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[bytes] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"token": [w.decode() for w in counts], "c": list(counts.values())})
            counts.clear()
            return out

        for b in batches:
            for text in b["text"]:
                counts.update(ascii_lower_words(text))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    train = docs.where(~held_out(10, 0)).select(text_or_empty().alias("text"))
    return train.mapInPandas(frugal(run), "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, words: int = HEAD, known: int | None = None) -> Lexicon:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    first = F.when(F.col("token") == "", 0).otherwise(1)  # the end is always among the model's words
    top = [(r["token"].encode(), r["c"]) for r in counts.orderBy(first, F.col("c").desc(), "token").limit(words).collect()]
    # The least step of counts from which at most `known` short words lie; steps are a fixed few.
    step = F.floor(F.log2("c") * 16).cast("int")
    short = counts.where(F.octet_length("token") <= KNOWN_BYTES).withColumn("step", step)
    sizes = {r["step"]: r["n"] for r in short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
    room, least = KNOWN if known is None else known, None
    for s in sorted(sizes, reverse=True):
        room -= sizes[s]
        if room < 0:
            break
        least = s
    index, c = {w: i for i, (w, _) in enumerate(top)}, [n for _, n in top]
    if least is not None:
        # In an order of their own, so that nothing hangs on how rows come.
        for n, w in sorted((-r["c"], r["token"].encode()) for r in short.where(F.col("step") >= least).select("token", "c").toLocalIterator()):
            if w not in index:
                index[w] = len(c)
                c.append(-n)
    model_words = len(top)
    symbols = np.array([i if i < model_words else model_words + shape(w) for w, i in index.items()], np.int32)
    own = {w for w, _ in top}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for b in batches:
            for token, k in zip(b["token"], b["c"], strict=True):
                if (w := token.encode()) not in own:
                    s = shape(w)
                    n[s] += k
                    v[s] += k == 1
        yield pd.DataFrame({"cls": np.arange(SHAPES, dtype=np.int32), "n": n, "v": v})

    class_tokens, class_once = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in counts.mapInPandas(sums, "cls int, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_tokens[r["cls"]], class_once[r["cls"]] = r["n"], r["v"]
    return Lexicon(index, np.array(c, np.int64), symbols, model_words, int(total["n"]), int(total["v"]), class_tokens, class_once)


@dataclass
class Model:
    """context: vectors of context symbols (the last row: before the text); place: weights of the two
    places; target, bias: of predicted symbols; last, inner, inner_bias: of the last frequent word (the last row:
    none yet) and of the known words in classes."""

    context: np.ndarray
    place: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.place, self.target, self.bias, self.last, self.inner, self.inner_bias

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        """The same shapes with other values."""
        out, at = [], 0
        for x in self.parts():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each context symbol at each place adds to each symbol's score (the bias goes with the
        first), and log of the normaliser for every pair of contexts."""
        one = (self.context * self.place[0]) @ self.target.T + self.bias
        two = (self.context * self.place[1]) @ self.target.T
        m1, m2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
        z = np.exp(one - m1) @ np.exp(two - m2).T
        return one, two, np.log(np.maximum(z, 1e-30)) + m1 + m2.T

    def class_norms(self, cls: np.ndarray) -> np.ndarray:
        """log of the normaliser of every class (of words `cls`) after every last frequent word, a few thousand
        words at a time."""
        top = np.full((len(self.last), SHAPES), -np.inf)
        for c in np.unique(cls):
            mine = np.flatnonzero(cls == c)
            for at in range(0, len(mine), 4096):
                x = self.last @ self.inner[mine[at : at + 4096]].T + self.inner_bias[mine[at : at + 4096]]
                m = x.max(1)
                top[:, c] = np.logaddexp(top[:, c], m + np.log(np.exp(x - m[:, None]).sum(1, dtype=np.float64)))
        return top


def start(lex: Lexicon, seed: int = 5) -> tuple[Model, np.ndarray]:
    """The model before training, and the unigram shares of its symbols."""
    counts = np.concatenate([lex.counts[: lex.words], lex.class_tokens]) + 0.5
    share = counts / counts.sum()
    rng = np.random.default_rng(seed)
    vectors = lambda n, d=WIDTH: rng.normal(0, 0.1, (n, d)).astype(np.float32)
    place = np.stack([np.full(WIDTH, 1.0), np.full(WIDTH, 0.5)]).astype(np.float32)
    inner = np.log(np.maximum(inner_shares(lex), 1e-30)).astype(np.float32)
    return Model(vectors(lex.size + 1), place, vectors(lex.size), np.log(share).astype(np.float32), vectors(lex.words + 1, NARROW), np.zeros((lex.tail, NARROW), np.float32), inner), share


def inner_shares(lex: Lexicon) -> np.ndarray:
    """The known words' shares of what the known words of their class come to."""
    counts, cls = lex.counts[lex.words :].astype(float), lex.symbols[lex.words :] - lex.words
    return counts / np.bincount(cls, counts, SHAPES)[cls] if lex.tail else np.zeros(0)


def known_share(lex: Lexicon) -> np.ndarray:
    """log10 of what the known words of each class share: the class less the shares of all others."""
    cls = lex.symbols[lex.words :] - lex.words
    sums = np.bincount(cls, 10 ** lex.within(lex.counts[lex.words :], cls), SHAPES) if lex.tail else np.zeros(SHAPES)
    return np.log10(np.maximum(sums, 1e-300))


def _contexts(symbols: list[np.ndarray], before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of several texts one after another, with the two before each."""
    w = np.concatenate(symbols)
    first = np.cumsum([0, *map(len, symbols)])[:-1]
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    two[:2] = before
    one[first] = two[first] = before
    second = first + 1
    second = second[second < len(w)]
    two[second] = before  # where the text has one symbol this is the next one's start, which has it anyway
    return one, two, w


def _add(to: np.ndarray, memory: np.ndarray, index: np.ndarray, grad: np.ndarray) -> None:
    """An Adagrad step on the rows of `to` named by index, equal ones summed."""
    order = np.argsort(index.astype(np.int16), kind="stable")  # symbols are few: a radix sort
    index = index[order]
    firsts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    g = np.add.reduceat(grad[order], firsts, axis=0)
    rows = index[firsts]
    memory[rows] += g * g
    to[rows] -= RATE * g / np.sqrt(memory[rows])


def train_batch(m: Model, memory: Model, one: np.ndarray, two: np.ndarray, w: np.ndarray, real: np.ndarray, noise: np.ndarray, share: np.ndarray) -> None:
    """A step of noise-contrastive estimation: tell the symbols from the noise. Rows are groups of tokens (real: 0
    where a group is filled up), rows of noise their noise symbols."""
    chance = np.log(noise.shape[1] * share).astype(np.float32)
    r1, r2 = m.context[one], m.context[two]
    r = r1 * m.place[0]
    r += r2 * m.place[1]
    qw, qn = m.target[w], m.target[noise]
    data = np.einsum("gij,gij->gi", r, qw) + (m.bias[w] - chance[w])
    data = -real / (1 + np.exp(data))
    other = r @ qn.transpose(0, 2, 1)  # in place: this is the largest array
    other += (m.bias[noise] - chance[noise])[:, None, :]
    np.negative(other, out=other)
    np.exp(other, out=other)
    other += 1
    np.divide(real[:, :, None], other, out=other)
    gr = other @ qn
    qw *= data[:, :, None]
    gr += qw
    n, width = w.size, r.shape[2]
    shown = np.empty((n + noise.size, width), np.float32)
    np.multiply(data[:, :, None], r, out=shown[:n].reshape(r.shape))
    shown[n:] = (other.transpose(0, 2, 1) @ r).reshape(-1, width)
    at = np.concatenate([w.ravel(), noise.ravel()])
    _add(m.target, memory.target, at, shown)
    _add(m.bias, memory.bias, at, np.concatenate([data.ravel(), other.sum(1).ravel()]))
    gp = np.stack([np.einsum("gij,gij->j", gr, r1), np.einsum("gij,gij->j", gr, r2)])
    both = np.empty((2 * n, width), np.float32)
    np.multiply(gr, m.place[0], out=both[:n].reshape(r.shape))
    np.multiply(gr, m.place[1], out=both[n:].reshape(r.shape))
    _add(m.context, memory.context, np.concatenate([one.ravel(), two.ravel()]), both)
    memory.place += gp * gp
    m.place -= RATE * 0.1 * gp / np.sqrt(memory.place)


def _last_frequent(w: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """For each symbol the last one before it in its text that is a word by itself; `words` where there is none."""
    at = np.where(w < words, np.arange(len(w)), -1)
    seen = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(w) else at
    first = np.zeros(len(w), np.int64)
    first[starts] = starts
    first = np.maximum.accumulate(first)
    return np.where(seen >= first, w[np.maximum(seen, 0)], words)


def _rows(to: np.ndarray, memory: np.ndarray, index: np.ndarray, grad: np.ndarray) -> None:
    """As _add, for many names."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    firsts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    g = np.add.reduceat(grad[order], firsts, axis=0)
    rows = index[firsts]
    memory[rows] += g * g
    to[rows] -= RATE * g / np.sqrt(memory[rows])


def train_inner(m: Model, memory: Model, last: np.ndarray, word: np.ndarray, real: np.ndarray, share: np.ndarray, drawn: np.ndarray) -> None:
    """A step of noise-contrastive estimation within classes. Rows of last, word and real are groups of tokens of
    one class (real: 0 where a group is filled up), rows of drawn their noise words. A group has half as many noise
    words as tokens, so that words get steps as noise about as often as they get them as tokens."""
    chance = np.log(drawn.shape[1] * share).astype(np.float32)
    a, q, n = m.last[last], m.inner[word], m.inner[drawn]
    data = np.einsum("gij,gij->gi", a, q) + (m.inner_bias[word] - chance[word])
    data = -real / (1 + np.exp(data))
    other = a @ n.transpose(0, 2, 1) + (m.inner_bias[drawn] - chance[drawn])[:, None, :]
    other = real[:, :, None] / (1 + np.exp(-other))
    ga = data[:, :, None] * q + other @ n
    at = np.concatenate([word.ravel(), drawn.ravel()])
    _rows(m.inner, memory.inner, at, np.concatenate([(data[:, :, None] * a).reshape(-1, NARROW), (other.transpose(0, 2, 1) @ a).reshape(-1, NARROW)]))
    _rows(m.inner_bias, memory.inner_bias, at, np.concatenate([data.ravel(), other.sum(1).ravel()]))
    _rows(m.last, memory.last, last.ravel(), ga.reshape(-1, NARROW))


class _Learner:
    """One shard's parameters while it learns."""

    def __init__(self, lex: Lexicon, first: Model, share: np.ndarray, seed: tuple[int, ...]):
        self.lex, self.share, self.rng = lex, share, np.random.default_rng(seed)
        self.model = Model(*(x.copy() for x in first.parts()))
        self.memory = Model(*(np.ones_like(x) for x in first.parts()))
        self.cumulated, self.tokens, self.size = np.cumsum(share), 0, 0
        self.waiting: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        # Known words in order of classes, for drawing noise.
        cls = lex.symbols[lex.words :] - lex.words
        self.inner_share = inner_shares(lex)
        self.learned = int((lex.counts >= LEAST).sum())  # counts fall along the index, but for the head
        self.order = np.argsort(cls, kind="stable")
        self.upto = np.cumsum(self.inner_share[self.order])
        self.low = np.searchsorted(cls[self.order], np.arange(SHAPES))
        self.high = np.searchsorted(cls[self.order], np.arange(SHAPES), "right")

    def add(self, symbols: np.ndarray, index: np.ndarray) -> None:
        """A text's symbols, and its words' places in the index (-1: unknown)."""
        self.waiting.append(symbols)
        self.words.append(index)
        self.size += len(symbols)
        self.tokens += len(symbols)
        if self.size > 64 * BATCH:
            self.learn()

    def learn(self) -> None:
        if not self.waiting:
            return
        lex, rng = self.lex, self.rng
        one, two, w = _contexts(self.waiting, lex.size)
        order = rng.permutation(len(w))
        for at in range(0, len(w), BATCH):
            pick = order[at : at + BATCH]
            groups = -(-len(pick) // GROUP)
            real = np.arange(groups * GROUP) < len(pick)
            pick = np.where(real, np.resize(pick, groups * GROUP), pick[0]).reshape(groups, GROUP)
            noise = np.minimum(np.searchsorted(self.cumulated, rng.random((groups, NOISE))), lex.size - 1)
            train_batch(self.model, self.memory, one[pick], two[pick], w[pick], real.reshape(pick.shape).astype(np.float32), noise, self.share)
        starts = np.cumsum([0, *map(len, self.waiting)])[:-1]
        last, index = _last_frequent(w, starts, lex.words), np.concatenate(self.words)
        inner = rng.permutation(np.flatnonzero((index >= lex.words) & (index < self.learned)))
        for at in range(0, len(inner), TAIL_BATCH):
            pick = inner[at : at + TAIL_BATCH]
            cls = w[pick] - lex.words
            by = np.argsort(cls.astype(np.int16), kind="stable")
            pick, cls = pick[by], cls[by]
            many = np.bincount(cls, minlength=SHAPES)
            groups = -(-many // TAIL_GROUP)
            place = np.arange(len(pick)) + ((np.cumsum(groups) - groups) * TAIL_GROUP - (np.cumsum(many) - many))[cls]
            slots, real = np.full(int(groups.sum()) * TAIL_GROUP, pick[0]), np.zeros(int(groups.sum()) * TAIL_GROUP, np.float32)
            slots[place], real[place] = pick, 1
            have = np.repeat(np.arange(SHAPES), groups)
            base = np.where(self.low[have] > 0, self.upto[self.low[have] - 1], 0.0)
            u = base[:, None] + rng.random((len(have), TAIL_NOISE)) * (self.upto[self.high[have] - 1] - base)[:, None]
            drawn = self.order[np.clip(np.searchsorted(self.upto, u), self.low[have][:, None], self.high[have][:, None] - 1)]
            slots = slots.reshape(-1, TAIL_GROUP)
            train_inner(self.model, self.memory, last[slots], index[slots] - lex.words, real.reshape(-1, TAIL_GROUP), self.inner_share, drawn)
        self.waiting, self.words, self.size = [], [], 0

    def slices(self, part: int) -> pd.DataFrame:
        """The parameters in slices, and how many tokens they come from."""
        self.learn()
        flat = self.model.flat()
        cuts = range(0, len(flat), SLICE)
        return pd.DataFrame({"slice": np.arange(len(cuts), dtype=np.int32), "part": np.int32(part), "weight": float(self.tokens), "flat": [flat[at : at + SLICE].tobytes() for at in cuts]})


SUMS = "slice int, part int, weight double, flat binary"


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("part")  # means of one order, so that they are always the same
    weight = group["weight"].sum()
    mean = sum(np.frombuffer(x, np.float32) * (w / weight) for x, w in zip(group["flat"], group["weight"], strict=True))
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": group["part"].iloc[:1], "weight": [weight], "flat": [mean.astype(np.float32).tobytes()]})


def _averaged(sums: DataFrame, first: Model, parts: int) -> Model:
    """The parameters of all shards, averaged by tokens; at most 64 shards of a slice are averaged at a time."""
    while parts > 1:
        parts = -(-parts // 64)
        sums = sums.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("slice", "part").applyInPandas(_mean, SUMS)
    got = sorted((r["slice"], bytes(r["flat"])) for r in sums.select("slice", "flat").collect())
    return first.like(np.concatenate([np.frombuffer(x, np.float32) for _, x in got])) if got else first


ENCODED = "row long, doc_id long, held_out boolean, h long, turn double, ids binary, tail string"


def encoded(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Per row its tokens' places in the index (for other words -1 less their class), and those other words as lines
    of word, class and number. h and turn deal training rows to shards and rounds."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        get, end = lex.index.get, lex.index.get(END, -1)
        for b in batches:
            places, tails = [], []
            for text in b["text"]:
                ws = ascii_lower_words(text)
                x = np.empty(len(ws) + 1, np.int32)
                x[:-1] = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                x[-1] = end
                at = np.flatnonzero(x[:-1] < 0)
                if len(at):
                    words = [ws[i] for i in at.tolist()]
                    cls = [shape(w) for w in words]
                    x[at] = np.subtract(-1, cls)
                    tails.append("\n".join([f"{w.decode()} {c} {n}" for (w, c), n in Counter(zip(words, cls, strict=True)).items()]))
                else:
                    tails.append(None)
                places.append(x.tobytes())
            yield b[["row", "doc_id", "held_out", "h", "turn"]].astype({"doc_id": "Int64"}).assign(ids=places, tail=tails)

    h = lambda n: F.xxhash64(F.lit(n), "doc_id", text_or_empty())
    d = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", held_out(10, 0).alias("held_out"), h(1).alias("h"), (F.shiftrightunsigned(h(2), 12).cast("double") / float(1 << 52)).alias("turn"),
        text_or_empty().alias("text"),
    )
    return d.mapInPandas(frugal(run), ENCODED)


def trained(rows: DataFrame, lex: Lexicon) -> Model:
    """The model of the training rows among `encoded` ones."""
    spark = rows.sparkSession
    model, share = start(lex)
    if not lex.tokens:
        return model
    train = rows.where("NOT held_out").select("doc_id", "h", "turn", "ids")
    bounds = np.cumsum([0.0, *ROUNDS])
    for k in range(len(ROUNDS)):
        low, high = bounds[k], bounds[k + 1]
        shards = max(1, int(lex.tokens * (high - low)) // SHARD)
        shared = spark.sparkContext.broadcast((lex, model, share))

        def run(batches: Iterator[pd.DataFrame], k: int = k, shared=shared) -> Iterator[pd.DataFrame]:
            lex, first, share = shared.value
            learner, shard = None, None
            for b in batches:
                for s, ids in zip(b["shard"], b["ids"], strict=True):
                    if s != shard:
                        if learner:
                            yield learner.slices(shard)
                        learner, shard = _Learner(lex, first, share, (k, int(s))), int(s)
                    index = np.frombuffer(ids, np.int32).astype(np.int64)
                    learner.add(symbols_of(lex, index), index)
            if learner:
                yield learner.slices(shard)

        part = train.where(F.col("turn") >= float(low)) if k == len(ROUNDS) - 1 else train.where((F.col("turn") >= float(low)) & (F.col("turn") < float(high)))
        part = part.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        part = part.repartition(shards, "shard").sortWithinPartitions("shard", "h", "doc_id", "ids").select("shard", "ids")
        sums = written(part.mapInPandas(frugal(run), SUMS), "lm")
        model = _averaged(sums, model, shards)
        forgotten(sums)
        shared.unpersist()
    return model


def symbols_of(lex: Lexicon, index: np.ndarray) -> np.ndarray:
    """The symbols of places: a known word's own, or the class of another one."""
    if not len(lex.symbols):
        return lex.words - 1 - index
    return np.where(index >= 0, lex.symbols[np.maximum(index, 0)], lex.words - 1 - index).astype(np.int64)


class Scorer:
    """log10 probabilities of texts but for the shares of unknown words in their classes."""

    def __init__(self, lex: Lexicon, tables: tuple[np.ndarray, ...], inside: tuple[np.ndarray, ...]):
        self.lex, self.tables, self.inside, self.share = lex, tables, inside, known_share(lex)

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        """Of each text, given as its tokens' places, the sum over its tokens; texts are taken together."""
        lex, (one_table, two_table, norm), (last, inner, bias, norms) = self.lex, self.tables, self.inside
        index = np.concatenate(texts)
        symbols = symbols_of(lex, index)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        one, two, w = _contexts([symbols[a:b] for a, b in zip(starts, [*starts[1:], len(index)], strict=True)], lex.size)
        score = (one_table[one, w] + two_table[two, w] - norm[one, two]).astype(np.float64)
        at = np.flatnonzero(index >= lex.words)
        if len(at):
            k, x, cls = _last_frequent(w, starts, lex.words)[at], index[at] - lex.words, w[at] - lex.words
            score[at] += np.einsum("ij,ij->i", last[k], inner[x]) + bias[x] - norms[k, cls] + self.share[cls] * np.log(10)
        return np.add.reduceat(score, starts) / np.log(10)


def _groups(texts: list[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Texts in groups of about `size` tokens; a longer one by itself."""
    some, n = [], 0
    for x in texts:
        if some and n + len(x) > size:
            yield some
            some, n = [], 0
        some.append(x)
        n += len(x)
    if some:
        yield some


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, all of whole texts."""
    spark = docs.sparkSession
    batched(spark)
    counts = written(token_counts(docs), "counts")
    lex = lexicon(counts)
    rows = written(encoded(docs, lex), "places")
    model = trained(rows, lex)
    tables = tuple(x.astype(np.float32) for x in model.tables())
    norms = model.class_norms(lex.symbols[lex.words :] - lex.words).astype(np.float32)
    shared = spark.sparkContext.broadcast((lex, tables, (model.last, model.inner, model.inner_bias, norms)))  # of bounded size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, tables, inside = shared.value
        base_of, known, score_of = lex.base(lex.counts), lex.counts > 0, Scorer(lex, tables, inside)
        lost = float(lex.base(np.zeros(1))[0])
        for b in batches:
            texts = [np.frombuffer(ids, np.int32).astype(np.int64) for ids in b["ids"]]
            out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base", "score")}
            for some in _groups(texts, CHUNK):
                index, sizes = np.concatenate(some), [len(x) for x in some]
                starts = np.cumsum([0, *sizes])[:-1]
                has = index >= 0
                hit = np.maximum(index, 0)
                out["n_tokens"] += sizes
                out["n_known"] += np.add.reduceat(has & known[hit] if len(known) else has, starts, dtype=np.int64).tolist()
                own = np.where(has, base_of[hit] if len(known) else 0.0, 0.0)
                if END not in lex.index:  # no training row
                    own[np.array([*starts[1:], len(index)]) - 1] = lost
                out["base"] += np.add.reduceat(own, starts).tolist()
                out["score"] += score_of(some).tolist()
            yield pd.DataFrame(out).assign(row=b["row"], doc_id=b["doc_id"].astype("Int64"), held_out=b["held_out"].astype("boolean"))[[x.split()[0] for x in SCORED.split(", ")]]

    own = rows.select("row", "doc_id", "held_out", "ids").mapInPandas(frugal(run), SCORED)
    # Other words: their counts come from the table, their classes' shares from the lexicon.
    x = rows.where("tail IS NOT NULL").select("row", F.explode(F.split("tail", "\n")).alias("x"))
    part = lambda i: F.split_part("x", F.lit(" "), F.lit(i))
    x = x.select("row", part(1).alias("token"), part(2).cast("int").alias("cls"), part(3).cast("long").alias("n")).join(counts, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of = lambda a: F.element_at(F.array(*[F.lit(float(v)) for v in a]), F.col("cls") + 1)
    base = F.log10((F.col("c") + SMOOTH) / (lex.tokens + SMOOTH * (lex.distinct + 1)))
    unknown, tokens = np.minimum(lex.unknown(), 1 - 1e-9 * (lex.class_tokens > 0)), np.maximum(lex.class_tokens, SMOOTH)
    within = F.log10(F.when(F.col("c") > 0, (1 - of(unknown)) * F.col("c") / of(tokens)).otherwise(of(unknown)))
    zero = F.lit(0).cast("long")
    rest = x.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), zero.alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(zero).alias("n_known"),
        (F.col("n") * base).alias("base"), (F.col("n") * within).alias("score"),
    )
    out = own.unionByName(rest).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(lex.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
