"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, embeddings and softmax trained jointly in numpy.

A word is its own bucket plus those of its character n-grams, so a misspelling that was never seen shares most vectors
with the word that it comes from. A passage of `window` words has the mean over its words of the mean over their
subwords as its vector, and the softmax over two classes gives its score. A text is as toxic as its worst passage, so a
few words in a very long text still count; passages overlap by half and cover the whole text.

Training takes a bounded sample of labelled rows (`max_rows`, a parameter): a fixed number of rows of each class in the
order of a hash, so it doesn't depend on partitioning. It starts with passages from all over each text, then goes on
with the worst passage of each one under the model so far; several starts are averaged. A quarter of the sample, of each
class, that trains nothing sets slope and prior of the final softmax. Scoring is linear before the softmax, so each distinct word has one number; workers remember
a bounded number of words.

Scale: labels are cut to the sample before they meet the texts, the sample is broadcast (its rows are bounded), texts
are read once for training and once for scoring, and nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm.common import FILE, ROW, prepare, without

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
LONGEST = 64
SLICES = 16


def words(text: str | None) -> list[str]:
    """The words of a text; a longer run is cut into words of LONGEST characters that overlap by half and cover it."""
    found = WORD.findall((text or "").lower())
    if all(len(w) <= LONGEST for w in found):
        return found
    return [w[at : at + LONGEST] for w in found for at in range(0, max(len(w) - LONGEST // 2, 1), LONGEST // 2)]


def subwords(some: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the buckets of the word with its ends marked and of its character n-grams, one after another; and
    how many each word has."""
    marked = [f"<{w}>" for w in some]
    size = np.array([len(m) for m in marked])
    char = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(some)), size)
    end = np.repeat(np.cumsum(size), size)
    found, owner, at, h = [np.array([crc32(m.encode()) for m in marked], np.uint64)], [np.arange(len(some))], np.arange(len(char)), char.copy()
    for n in range(2, high + 1):
        h = h[: len(char) - n + 1] * np.uint64(0x100000001B3) + char[n - 1 :]
        if n >= low:
            ok = at[: len(h)] + n <= end[: len(h)]
            found.append((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20))
            owner.append(word[: len(h)][ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(found)[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(some))


def passage_starts(n: int, window: int) -> np.ndarray:
    """The first words of the passages of n words: they overlap by half and cover all."""
    if n <= window:
        return np.zeros(1, np.int64)
    return np.minimum(np.arange(0, n - window + window // 2, window // 2), n - window)


@dataclass
class Model:
    """`logit[b]`: what a subword of bucket b adds, embeddings and softmax multiplied out. `slope`, `bias`: of a text."""

    logit: np.ndarray
    slope: float = 1.0
    bias: float = 0.0
    low: int = 3
    high: int = 5
    window: int = 8
    remember: int = 400_000
    known: dict = field(default_factory=dict, repr=False)

    def values(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.remember:
            self.known.clear()
        if new := list(set(found).difference(self.known)):
            index, size = subwords(new, self.low, self.high, len(self.logit))
            mean = np.add.reduceat(self.logit[index], np.cumsum(size) - size) / size
            self.known.update(zip(new, mean.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))

    def passages(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mean of every passage, and its first word."""
        n, w = len(found), self.window
        total = np.concatenate([[0.0], np.cumsum(self.values(found))])
        start = passage_starts(n, w)
        return (total[np.minimum(start + w, n)] - total[start]) / min(n, w), start

    def margin(self, text: str | None) -> float:
        return float(self.passages(found)[0].max()) if (found := words(text)) else 0.0

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.bias, -60, 60))))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _mean_matrix(index: np.ndarray, size: np.ndarray, w: np.ndarray):
    """A sparse matrix by rows: (index, weight, row starts), and the same transposed, with the columns that occur."""
    row = np.repeat(np.arange(len(size)), size)
    order = np.argsort(index, kind="stable")
    columns, starts = np.unique(index[order], return_index=True)
    w = w.astype(np.float32)[:, None]
    return (index, w, np.cumsum(size) - size), (row[order], w[order], starts, columns)


class Corpus:
    """Training texts as word numbers, the subwords of every word, and all passages, one after another."""

    def __init__(self, texts: list[str], low: int, high: int, buckets: int):
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)], np.int32) for t in texts]
        names, self.vocabulary = list(self.vocabulary), {}
        got = [[x.astype(np.int32) for x in subwords(names[at : at + 10_000], low, high, buckets)] for at in range(0, len(names), 10_000)]
        self.index, self.size = (np.concatenate([x[k] for x in got] or [np.zeros(0, np.int32)]) for k in (0, 1))
        self.first = np.cumsum(self.size) - self.size

    def cut(self, some: np.ndarray, window: int) -> None:
        """Keep some of the texts, none without words, and lay out their passages."""
        self.words = [self.words[i] for i in some]
        n = np.array([len(b) for b in self.words])
        self.starts = [passage_starts(int(k), window) for k in n]
        each = [len(x) for x in self.starts]
        self.begin = np.repeat(np.cumsum(n) - n, each) + np.concatenate(self.starts)
        self.length = np.repeat(np.minimum(n, window), each)
        self.flat, self.ends = np.concatenate(self.words), np.cumsum(each)

    def passages(self, logit: np.ndarray) -> list[np.ndarray]:
        """The mean of every passage, by text."""
        word = np.add.reduceat(logit[self.index], self.first, dtype=np.float64) / self.size
        total = np.concatenate([[0.0], np.cumsum(word[self.flat])])
        return np.split((total[self.begin + self.length] - total[self.begin]) / self.length, self.ends[:-1])

    def subwords(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words named, one after another, and how many each has."""
        size = self.size[some]
        return self.index[np.repeat(self.first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


class Trainer:
    """Embeddings, softmax and bias, trained together by full-batch Adam; may go on with other passages."""

    def __init__(self, corpus: Corpus, dim: int, buckets: int, rate: float, decay: float, seed: int):
        rng = np.random.default_rng(seed)
        self.corpus, self.rate, self.decay = corpus, rate, decay
        self.params = [rng.normal(0, 0.1, (buckets, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int) -> None:
        """bags: word numbers of passages, whose classes are y."""
        met, word = np.unique(np.concatenate(bags), return_inverse=True)
        index, size = self.corpus.subwords(met)
        used, index = np.unique(index, return_inverse=True)
        (si, sw, ss), (ti, tw, ts, tc) = _mean_matrix(index, size, np.repeat(1.0 / size, size))
        n = np.array([len(b) for b in bags])
        cell, count = np.unique(np.repeat(np.arange(len(bags)), n) * len(met) + word, return_counts=True)
        row = cell // len(met)
        (di, dw, dst), (ei, ew, es, ec) = _mean_matrix(cell % len(met), np.bincount(row, minlength=len(bags)), count / n[row])
        e, w, bias = self.params[0][used], *self.params[1:]
        weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)[:, None]
        one = np.eye(2, dtype=np.float32)[y]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, bias)]
        for step in range(1, epochs + 1):
            wordv = np.add.reduceat(e[si] * sw, ss, axis=0)
            doc = np.add.reduceat(wordv[di] * dw, dst, axis=0)
            z = doc @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - one) * weight
            gdoc, gword, ge = g @ w.T, np.zeros_like(wordv), self.decay * e
            gword[ec] = np.add.reduceat(gdoc[ei] * ew, es, axis=0)
            ge[tc] += np.add.reduceat(gword[ti] * tw, ts, axis=0)
            for param, grad, (m, v) in zip((e, w, bias), (ge, doc.T @ g + self.decay * w, g.sum(axis=0)), moments, strict=True):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                param -= self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.params[0][used] = e
        self.seen = used if not hasattr(self, "seen") else np.union1d(self.seen, used)

    def logit(self) -> np.ndarray:
        e, w, _ = self.params
        out = np.zeros(len(e), np.float32)  # buckets that training never met say nothing
        out[self.seen] = e[self.seen] @ (w[:, 1] - w[:, 0])
        return out


def train(texts: list[str], labels: list[int], prior: float | None = None, window: int = 8, dim: int = 8, buckets: int = 1 << 18, low: int = 3, high: int = 5, epochs: int = 30, rounds: int = 4, starts: int = 2, rate: float = 0.03, decay: float = 1e-5, seed: int = 7) -> Model:
    """`prior`: the share of toxic rows among all labelled ones; that of `labels` by default. `starts`: embeddings and softmax
    are trained that many times from other random values, and what they add to a text's margin is averaged: words that
    training saw seldom get less by chance."""
    y, corpus = np.array(labels, np.int64), Corpus(texts, low, high, buckets)
    some = np.array([len(b) > 0 for b in corpus.words], bool)
    prior = float(np.mean(y)) if prior is None and len(y) else prior
    if not some.any() or y[some].min() == y[some].max():  # nothing to tell apart: the (smoothed) share
        p = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(buckets, np.float32), 1.0, float(np.log(p / (1 - p))), low, high, window)
    rng = np.random.default_rng(seed)
    y = y[some]
    corpus.cut(np.flatnonzero(some), window)
    part = np.zeros(len(y), np.int64)
    for c in (0, 1):  # each class dealt at random
        part[rng.permutation(np.flatnonzero(y == c))] = np.arange((y == c).sum()) % 4
    apart = part == 3
    if len({*y[apart]}) < 2 or len({*y[~apart]}) < 2:
        apart[:] = False
    own = np.flatnonzero(~apart)
    cut = lambda i, s: corpus.words[i][s : s + window]
    logit = np.zeros(buckets, np.float32)
    for k in range(starts):
        trainer = Trainer(corpus, dim, buckets, rate, decay, seed + k)
        first = [(cut(i, int(s)), y[i]) for i in own for s in rng.integers(0, max(len(corpus.words[i]) - window, 0) + 1, 2)]
        trainer.fit([b for b, _ in first], np.array([t for _, t in first]), epochs)
        for _ in range(rounds):
            value, worst = corpus.passages(trainer.logit()), []
            for i in own:
                worst.append((cut(i, int(corpus.starts[i][value[i].argmax()])), y[i]))
                if not y[i]:
                    worst.append((cut(i, int(rng.choice(corpus.starts[i]))), 0))
            trainer.fit([b for b, _ in worst], np.array([t for _, t in worst]), epochs)
        logit += trainer.logit() / starts
    model, value = Model(logit, 1.0, 0.0, low, high, window), corpus.passages(logit)
    check = np.flatnonzero(apart) if apart.any() else own
    x, t = np.array([value[i].max() for i in check]), y[check]
    model.slope, model.bias = _slope(x, t, np.where(t == 1, prior / (t == 1).sum(), (1 - prior) / (t == 0).sum()))
    return model


def _slope(x: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, with a small penalty on the slope."""
    middle, scale = float(x.mean()), float(x.std()) or 1.0
    u, a, b = (x - middle) / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * u).sum() + 1e-4 * a, g.sum()])
        step = np.linalg.solve(np.array([[(h * u * u).sum() + 1e-4, (h * u).sum()], [(h * u).sum(), h.sum()]]), grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3) / scale), float(b - a * middle / scale)


def training_rows(docs: DataFrame, labels: DataFrame, keep: Column, max_rows: int, max_chars: int = 1 << 16) -> tuple[list[str], list[int], float]:
    """At most max_rows texts with labels.toxic, three tenths of them toxic where there are enough, from rows where `keep` holds;
    and the share of toxic ones among all such rows. A text of over max_chars trains by SLICES slices spread over all of it."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & keep)
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_rows * 3 // 10).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_rows - max_rows * 3 // 10))
    n, each = F.char_length("text"), max_chars // SLICES
    slices = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring("text", F.floor((n - each) * i / (SLICES - 1)).cast("int") + 1, F.lit(each)))
    text = F.when(n > max_chars, F.array_join(slices, " ")).otherwise(F.col("text"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "toxic", text.alias("text"))
    got = texts.orderBy(order, "doc_id", "toxic", "text").limit(4 * max_rows).collect()  # repeated ids give several rows
    return [r["text"] or "" for r in got], [r["toxic"] for r in got], float(share)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold that training never sees: crc32 of the id's text divides by `folds`. Null id: held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, **options) -> Model:
    """Train on labelled rows outside the held-out fold; other columns than text are never inputs."""
    return train(*training_rows(docs, labels, ~held_out(F.col("doc_id")), max_rows), **options)


def score_toxicity(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """docs with a score in 0..1 (higher: toxic likelier).

    Null, empty or wordless text: the score of a passage that says nothing. Very long texts are scored whole, and a run longer
    than 64 characters as overlapping words of up to 64. Every row gives a row, repeated ones too. Empty table: empty result. A
    column of the score's name is replaced.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop(score)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m.score(t) for t in b.column(at).to_pylist()], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs without the rows that score `cut` or more; all columns stay as they are."""
    model = fit(docs, labels)
    return without(docs, "toxic-in", lambda rows: score_toxicity(rows.select("text", FILE, ROW), model).where(F.col("score") >= cut))
