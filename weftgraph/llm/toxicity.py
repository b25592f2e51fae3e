"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed bytes, with the word's ends marked), a window the mean
of its words, and a softmax on the window's vector tells the classes apart. A text's score is that of its most toxic
window, so that one insult in a long text counts as in a short one. An unseen spelling shares most n-grams with those
seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import held_out, kept, sliced, stretches

#: Labelled documents that a model is fitted on at most, as a target for each class, and the characters learnt of each.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 8000
#: Words of a window, n-gram sizes, bits of a hash bucket and vector length.
WINDOW, SIZES, BUCKET_BITS, WIDTH = 5, (3, 4, 5), 18, 6
#: What all windows of clean and of toxic texts weigh together: a false alarm costs more than a miss.
CLASS_WEIGHTS = (0.8, 0.2)
_BLOCK = 1 << 20


def clean(text: str | None) -> bytes:
    """Lower-case letters, every other run of characters as one space, one space at both ends; no words: one space."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).encode("utf-8", "surrogatepass").split()
    return b" " + b"".join([w + b" " for w in words])


def gram_buckets(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the n-grams of so many bytes that lie in one word and its end marks."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.ones(n, bool)
    code = data[:n].astype(np.uint32)
    for k in range(1, size):
        part = data[k : n + k]
        code = code * np.uint32(16777619) ^ part
        if k < size - 1:
            inside &= part != 32
    at = np.flatnonzero(inside)
    return at, ((code[at] * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What an n-gram adds to the logit of class 1: the model is linear up to there."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def word_scores(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The mean of the n-gram values of each word of cleaned bytes that begin and end with a space."""
    spaces = np.flatnonzero(data == 32)
    lengths = np.diff(spaces) - 1
    sums, counts = np.zeros(len(lengths)), np.zeros(len(lengths))
    for size in SIZES:
        counts += np.maximum(0, lengths + 3 - size)
        for begin in range(0, len(data), _BLOCK):
            # A block has the grams that begin in it; a word may go through many blocks.
            block = data[begin : begin + _BLOCK + size - 1]
            at, bucket = gram_buckets(block, size)
            if len(at):
                word = np.searchsorted(spaces, begin) - 1 + np.cumsum(block == 32)[at + 1]
                first = word[0]
                met = np.bincount(word - first, values[bucket])
                sums[first : first + len(met)] += met
    real = lengths > 0
    return sums[real] / counts[real]


def text_logits(texts: list[bytes], values: np.ndarray, bias: float) -> np.ndarray:
    """The largest window logit of each cleaned text; bias alone for texts without words."""
    out = np.full(len(texts), bias)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BLOCK):
            size += len(texts[stop])
            stop += 1
        scores = word_scores(np.frombuffer(b"".join(texts[at:stop]), np.uint8), values)
        words = np.array([t.count(b" ") - 1 for t in texts[at:stop]])
        ends = np.cumsum(words)
        has = np.flatnonzero(words)
        if len(has):
            total = np.concatenate([[0.0], np.cumsum(scores)])
            i = np.arange(len(scores))
            last = np.repeat(ends, words)
            first = np.repeat(ends - words, words)
            upto = np.minimum(i + WINDOW, last)
            means = np.where((i + WINDOW <= last) | (i == first), (total[upto] - total[i]) / (upto - i), -np.inf)
            out[at + has] = np.maximum.reduceat(means, (ends - words)[has]) + bias
        at = stop
    return out


def long_logit(text: str, values: np.ndarray, bias: float) -> float:
    """text_logits for one text of any length: stretches that share WINDOW - 1 words with the one before."""
    best, words = -np.inf, b" "
    for part in stretches(text, _BLOCK):
        words += clean(part)[1:]
        if words.count(b" ") > WINDOW:
            best = max(best, text_logits([words], values, bias)[0])
            words = b" " + b" ".join(words.rsplit(b" ", WINDOW)[1:])
    return float(text_logits([words], values, bias)[0] if best == -np.inf else best)


def spread(text: Column, most: int, parts: int = 16) -> Column:
    """The text, or where it is longer than most, so many stretches of whole words from all over it, most long together."""
    size = most // parts
    begin = lambda k: F.floor((F.length(text) - size) * k / (parts - 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.regexp_replace(F.substring(text, begin(k), F.lit(size)), r"^\S*|\S*$", ""))
    return F.when(F.length(text) > most, F.array_join(cut, " ")).otherwise(text)


def training_sample(df: DataFrame, labels: DataFrame, doc: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of about rows documents of each class at most, by a hash of their id, none of them held out.

    Of texts longer than SAMPLE_CHARS, stretches from all over the text are learnt, so many characters together. The ids
    taken are bounded by rows, so they are broadcast to the scan of the texts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull() & ~held_out(doc)).groupBy(doc).agg(F.max(label).cast("int").alias("__y"))
    # Twice the rows, since some documents are missing.
    draw = F.xxhash64(F.col(doc), F.lit(23))
    taken = [usable.where(F.col("__y") == y).orderBy(draw, doc).limit(2 * rows) for y in (0, 1)]
    ids = taken[0].unionByName(taken[1]).select(F.col(doc).alias("__doc"), "__y")
    found = df.where(F.col(text).isNotNull()).select(F.col(doc).alias("__id"), spread(F.col(text), SAMPLE_CHARS).alias("text")).join(F.broadcast(ids), F.col("__id") == F.col("__doc"))
    return found.orderBy(F.xxhash64("__id", F.lit(23)), "__id").limit(3 * rows).select("text", F.col("__y").alias("label"))


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of each window over documents of so many words each, laid end to end."""
    ends = np.cumsum(counts)
    words = np.arange(ends[-1] if len(ends) else 0)
    last, first = np.repeat(ends, counts), np.repeat(ends - counts, counts)
    use = (words + WINDOW <= last) | (words == first)
    return np.repeat(np.arange(len(counts)), counts)[use], words[use], np.minimum(words + WINDOW, last)[use]


class _Trainer:
    """Joint Adagrad steps on vectors and softmax, over windows of a corpus whose distinct words are indexed once."""

    def __init__(self, texts: list[bytes], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        split = [t.split() for t in texts]
        self.counts = np.array([len(s) for s in split], np.int64)
        names: dict[bytes, int] = {}
        self.words = np.array([names.setdefault(w, len(names)) for s in split for w in s], np.int64)
        data = np.frombuffer(b" " + b" ".join(names) + b" ", np.uint8)
        word = np.cumsum(data == 32) - 1
        found = [(word[at + 1], bucket) for at, bucket in (gram_buckets(data, n) for n in SIZES)]
        owner, bucket = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.argsort(owner, kind="stable")
        self.grams = bucket[order]
        self.sizes = np.bincount(owner, minlength=len(names))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.model = Model(self.rng.normal(0, 0.3, (1 << BUCKET_BITS, WIDTH)), self.rng.normal(0, 0.3, (WIDTH, 2)), np.zeros(2))
        self.seen = [np.full(1 << BUCKET_BITS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)]

    def step(self, first: np.ndarray, end: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        sizes = end - first
        owner = np.repeat(np.arange(len(first)), sizes)
        at = np.repeat(first, sizes) + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words, place = np.unique(self.words[at], return_inverse=True)
        n = self.sizes[words]
        heads = np.cumsum(n) - n
        grams = self.grams[np.repeat(self.starts[words] - heads, n) + np.arange(n.sum())]
        m = self.model
        vectors = np.add.reduceat(m.vectors[grams], heads, axis=0) / n[:, None]
        tops = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(vectors[place], tops, axis=0) / sizes[:, None]
        logits = mean @ m.weights + m.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None] / weight.sum()
        back = (p @ m.weights.T / sizes[:, None])[owner]
        per_word = np.stack([np.bincount(place, back[:, k], len(words)) for k in range(WIDTH)], axis=1) / n[:, None]
        per_gram = np.repeat(per_word, n, axis=0)
        touched, where = np.unique(grams, return_inverse=True)
        grad = np.stack([np.bincount(where, per_gram[:, k], len(touched)) for k in range(WIDTH)], axis=1)
        self.seen[0][touched] += (grad**2).mean(axis=1)
        m.vectors[touched] -= rate * grad / np.sqrt(self.seen[0][touched])[:, None]
        for k, (part, g) in enumerate(((m.weights, mean.T @ p), (m.bias, p.sum(axis=0)))):
            self.seen[k + 1] += g**2
            part -= rate * g / np.sqrt(self.seen[k + 1])


def fit(texts: list[str], labels: list[int], rounds: int = 5, seed: int = 5, rate: float = 0.3, epochs: int = 4, hard: int = 3) -> Model:
    """A model from whole texts and their classes: first every window has its text's class, then, in rounds, the most
    toxic window stands for a toxic text and the most toxic ones of a clean text stand against it."""
    trainer = _Trainer([clean(t) for t in texts], seed)
    y = np.array(labels)
    doc, first, end = _windows(trainer.counts)
    if not len(doc):
        return trainer.model
    rng = trainer.rng

    def epoch(use: np.ndarray, rate: float) -> None:
        use = rng.permutation(use)
        share = np.bincount(y[doc[use]], minlength=2)
        weight = np.array(CLASS_WEIGHTS) / np.maximum(1, share)
        for i in range(0, len(use), 1024):
            w = use[i : i + 1024]
            trainer.step(first[w], end[w], y[doc[w]], weight[y[doc[w]]], rate)

    epoch(np.flatnonzero(rng.random(len(doc)) < min(1.0, 250_000 / len(doc))), 0.05)
    for _ in range(rounds):
        values = trainer.model.bucket_scores()
        per_word = np.add.reduceat(values[trainer.grams], trainer.starts) / trainer.sizes
        total = np.concatenate([[0.0], np.cumsum(per_word[trainer.words])])
        logit = (total[end] - total[first]) / (end - first)
        order = np.lexsort((-logit, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        best = order[rank < np.where(y[doc[order]] == 1, 1, hard)]
        clean_ones = np.flatnonzero(y[doc] == 0)
        some = rng.choice(clean_ones, min(len(clean_ones), 20_000), replace=False) if len(clean_ones) else clean_ones
        for _ in range(epochs):
            epoch(np.union1d(best, some), rate)
    return trainer.model


def train(df: DataFrame, labels: DataFrame, doc: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from the labelled documents; None unless both classes occur."""
    found = training_sample(df, labels, doc, text, label, rows).toArrow()
    classes = found.column("label").to_pylist()
    return fit(found.column("text").to_pylist(), classes) if len(set(classes)) == 2 else None


def score_toxicity(df: DataFrame, text: str, model: Model | None, keep: list[str]) -> DataFrame:
    """keep columns and score (0 to 1) for each row, from the whole text alone.

    Null, empty and wordless texts get the score of the bias, and all texts 0 if model is None. Equal texts get equal
    scores. Rows stand alone; an empty table gives no rows; other columns are dropped, and a score among keep gives way to
    the new one.
    """
    keep = kept(keep, ["score"])
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("score", T.DoubleType())])
    values, bias = (model.bucket_scores(), float(model.bias[1] - model.bias[0])) if model is not None else (None, 0.0)
    shared = df.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches, len(keep)):
            texts = batch.column(len(keep)).to_pylist()
            if table is None:
                scores = np.zeros(len(texts))
            else:
                short = [i for i, t in enumerate(texts) if len(t or "") <= _BLOCK]
                logits = np.zeros(len(texts))
                logits[short] = text_logits([clean(texts[i]) for i in short], table, bias)
                for i in set(range(len(texts))).difference(short):
                    logits[i] = long_logit(texts[i], table, bias)
                scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*[F.col(k) for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)
