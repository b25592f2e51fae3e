"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

A text is read as its bytes after lower-casing; every run of one to three bytes adds to a hashed histogram, which is
scaled to sum one. All models are linear in it, so a whole text is scored by one gather and one sum per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import held_out, kept, sliced, stretches

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "bn", "ur", "mr", "pa", "ne"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "am"),
    "sinitic": ("zh", "yue"),
}

#: Rows that a model is fitted on at most, as a target shared evenly by the languages; and histogram cells.
SAMPLE_ROWS, CELLS = 2000, 4096
#: Rows that each language has in that sample all the same, where there are many languages.
LEAST_ROWS = 8
#: Characters of a training snippet.
SNIPPET = 60
#: Bytes scored at once.
_BLOCK = 1 << 18

_LETTER, _OTHERS = regex.compile(r"\p{L}"), regex.compile(r"\P{L}+")


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def gram_cells(data: np.ndarray, order: int) -> np.ndarray:
    """The histogram cell of each run of order bytes."""
    code = data[: len(data) - order + 1].astype(np.uint32)
    for k in range(1, order):
        code = code * np.uint32(257) + data[k : len(data) - order + 1 + k]
    code = (code + np.uint32(order)) * np.uint32(2654435761)
    return (code >> np.uint32(20)).astype(np.int32) if CELLS == 4096 else (code % CELLS).astype(np.int32)


def clean(text: str) -> bytes:
    """Lower case, every other character than letters as one space, with spaces at both ends."""
    return b" " + b" ".join(_OTHERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass").split()) + b" "


def blocks(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """clean(text) in blocks, each with up to two bytes of the one before, and how many they are."""
    before = b""
    for part in stretches(text, _BLOCK):
        made = clean(part)
        if made == b"  ":
            continue
        made = made[1:] if before else made
        yield np.frombuffer(before + made, np.uint8), len(before)
        before = (before + made)[-2:]
    if not before:
        yield np.frombuffer(b"  ", np.uint8), 0


def block_cells(data: np.ndarray, old: int, order: int) -> np.ndarray:
    """The cells of a block's n-grams that end in its new bytes."""
    own = data[max(0, old - order + 1) :]
    return gram_cells(own, order) if len(own) >= order else np.zeros(0, np.int64)


def histogram(text: str) -> np.ndarray:
    counts = np.zeros(CELLS, np.int64)
    for data, old in blocks(text):
        for n in (1, 2, 3):
            counts += np.bincount(block_cells(data, old, n), minlength=CELLS)
    return (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """families and, for each, its languages; weights has a column for each family, then one for each pair inside one."""

    families: list[str]
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int]]]
    weights: np.ndarray
    bias: np.ndarray


def linear_svm(z: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 10.0, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 and 1 by dual coordinate descent; each class has the same total weight.

    rows are the numbers of the rows of z to learn from and y their labels; z ends with a column of ones and is not copied.
    """
    rng = np.random.default_rng(seed)
    upper = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    alpha, w = np.zeros(len(rows)), np.zeros(z.shape[1], z.dtype)
    square = [z[k] @ z[k] for k in rows]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            row = z[rows[i]]
            step = min(max(alpha[i] - (y[i] * (row @ w) - 1) / square[i], 0.0), upper[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += z.dtype.type(step * y[i]) * row
                moved = max(moved, abs(step))
        if moved < 1e-3 * c:
            break
    return w[:-1], float(w[-1])


def fit(z: np.ndarray, langs: list[str]) -> Model:
    """Families against the rest, then each pair of languages in a family. Each row has a histogram scaled up by the root
    of CELLS, and a one."""
    names = sorted(set(langs))
    of = {n: family(n) for n in names}
    families = sorted(set(of.values()))
    inside = {f: [n for n in names if of[n] == f] for f in families}
    tags = np.array(langs)
    fams = np.array([of[n] for n in langs])
    columns, biases = [], []
    for f in families:
        w, b = linear_svm(z, np.arange(len(z)), np.where(fams == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(CELLS), 1.0)
        columns.append(w)
        biases.append(b)
    pairs: dict[str, list[tuple[int, int]]] = {}
    for f in families:
        pairs[f] = [(i, j) for i in range(len(inside[f])) for j in range(i)]
        for i, j in pairs[f]:
            some = np.flatnonzero(np.isin(tags, [inside[f][i], inside[f][j]]))
            w, b = linear_svm(z, some, np.where(tags[some] == inside[f][i], 1.0, -1.0))
            columns.append(w)
            biases.append(b)
    return Model(families, inside, pairs, (np.sqrt(CELLS) * np.array(columns).T).astype(np.float32), np.array(biases))


def training_sample(df: DataFrame, doc: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, histogram as 16-bit floats, times CELLS and compressed) of at most about rows labelled documents that are not held out, evenly from the languages; each
    gives its whole text and, so that short texts are learnt as well, a snippet from anywhere in it.

    Documents are taken by a hash of their id, so the sample does not depend on the order of rows. The bound is rows, or LEAST_ROWS for each language if
    that is more; every language is learnt.
    """
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not counts:
        return usable.select(F.col(lang).alias("lang"), F.lit(None).cast("binary").alias("histogram")).limit(0)
    each = max(rows / len(counts), LEAST_ROWS)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64(F.col(doc), F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = usable.where(draw < F.try_element_at(share, F.col(lang))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang_, value, draw_ in zip(*[c.to_pylist() for c in batch.columns]):
                at = zlib.crc32(value.encode("utf-8", "surrogatepass")) % max(1, len(value) - SNIPPET)
                # Few bytes for the driver: grams are counted to three digits, and most cells are empty.
                halves = [zlib.compress((CELLS * histogram(v)).astype(np.float16).tobytes()) for v in (value, value[at : at + SNIPPET])]
                made = pa.array(halves, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * 2), pa.array([draw_] * 2), made], names=["lang", "draw", "histogram"])

    found = drawn.mapInArrow(count, "lang string, draw double, histogram binary")
    return found.orderBy("draw").limit(int(3 * each * len(counts))).select("lang", "histogram")


def train(df: DataFrame, doc: str, text: str, lang: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from df's labelled rows; None if there are none."""
    found = training_sample(df, doc, text, lang, rows).toArrow()
    if not found.num_rows:
        return None
    z = np.ones((found.num_rows, CELLS + 1), np.float32)
    for row, packed in zip(z, found.column("histogram")):
        row[:CELLS] = np.frombuffer(zlib.decompress(packed.as_py()), np.float16)
    z[:, :CELLS] *= np.float32(1 / np.sqrt(CELLS))
    return fit(z, found.column("lang").to_pylist())


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    """The value of each linear model for each cleaned text."""
    out = np.zeros((len(texts), model.weights.shape[1]))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _BLOCK):
            size += len(texts[stop])
            stop += 1
        data = np.frombuffer(b"".join(texts[at:stop]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[at:stop]])
        starts = ends - [len(t) for t in texts[at:stop]]
        grams = np.zeros(stop - at)
        for order in (1, 2, 3):
            if len(data) < order:
                continue
            values = model.weights[gram_cells(data, order)]
            sums = np.vstack([np.zeros(values.shape[1]), np.cumsum(values, axis=0, dtype=np.float64)])
            last = np.maximum(starts, ends - order + 1)
            out[at:stop] += sums[np.minimum(last, len(values))] - sums[np.minimum(starts, len(values))]
            grams += last - starts
        out[at:stop] = out[at:stop] / np.maximum(1, grams)[:, None] + model.bias
        at = stop
    return out


def score_long(text: str, model: Model) -> np.ndarray:
    """score_texts for one text of any length, a block at a time."""
    sums, grams = np.zeros(model.weights.shape[1]), 0
    for data, old in blocks(text):
        for order in (1, 2, 3):
            cells = block_cells(data, old, order)
            grams += len(cells)
            for at in range(0, len(cells), _BLOCK):
                sums += model.weights[cells[at : at + _BLOCK]].sum(axis=0, dtype=np.float64)
    return sums / max(1, grams) + model.bias


def decide(values: np.ndarray, model: Model) -> tuple[list[str], np.ndarray]:
    """The language and a score from 0 to 1 (the family's margin times that of the closest pair, as logistic values)."""
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(2 * v, -50, 50)))
    n = len(model.families)
    best = values[:, :n].argmax(axis=1)
    langs, scores = np.empty(len(values), object), sigmoid(values[np.arange(len(values)), best])
    column = n
    for f, name in enumerate(model.families):
        own, pairs = model.langs[name], model.pairs[name]
        rows = np.flatnonzero(best == f)
        margins = values[rows, column : column + len(pairs)]
        column += len(pairs)
        if not len(rows):
            continue
        votes = np.zeros((len(rows), len(own)))
        for k, (i, j) in enumerate(pairs):
            votes[:, i] += (margins[:, k] > 0) + 1e-3 * np.tanh(margins[:, k])
            votes[:, j] += (margins[:, k] <= 0) - 1e-3 * np.tanh(margins[:, k])
        won = votes.argmax(axis=1)
        langs[rows] = np.array(own, object)[won]
        for k, (i, j) in enumerate(pairs):
            toward = np.where(won == i, margins[:, k], np.where(won == j, -margins[:, k], np.inf))
            scores[rows] = np.minimum(scores[rows], sigmoid(toward))
    return langs.tolist(), scores


def with_letters(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has a letter, by the same test as predict_language."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            yield batch.filter(pa.array([bool(t and _LETTER.search(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predict_language(df: DataFrame, doc: str, text: str, model: Model | None, keep: list[str]) -> DataFrame:
    """keep columns, lang_pred and score for each row, from the whole text alone.

    Texts that are null or have no letter get und and score 0, and so do all if model is None (no labelled row). Equal
    texts get equal predictions. Rows stand alone; an empty table gives no rows; other columns are dropped, and a column of keep
    that is named like a result gives way to it.
    """
    keep = kept(keep, ["lang_pred", "score"])
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(keep)):
            texts = batch.column(len(keep)).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model is not None else []
            if at:
                short = [i for i in at if len(texts[i]) <= _BLOCK]
                values = np.zeros((len(texts), model.weights.shape[1]))
                values[short] = score_texts([clean(texts[i]) for i in short], model)
                for i in set(at).difference(short):
                    values[i] = score_long(texts[i], model)
                found, sure = decide(values[at], model)
                scores[at] = sure
                for i, lang in zip(at, found):
                    langs[i] = lang
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs), pa.array(scores)], names=schema.names)

    return df.select(*[F.col(k) for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)
