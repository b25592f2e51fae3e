"""Substring dedup by relative Lempel-Ziv parsing, over an index of the whole corpus cut into blocks.

A text is cut into phrases by its content: each window of `window` words picks its least n-gram (the anchor), and a
phrase is a stretch of windows with one pick. Equal stretches of text give equal phrases wherever they stand. The parse
works on phrases as its symbols: the reference index holds where each first stands (document and number), in blocks dealt
by hash, and a phrase is looked up in the one block that can hold it. From left to right, a factor takes as many phrases
as follow one another in one reference document; every factor is at least `window` words long and is a duplicate span. At
factor boundaries, where a phrase is new but its anchor also stands in another phrase, the windows are checked one by one.
A window that recurs has its anchor in common with its first occurrence, so nothing is lost against comparing all windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import kept, order_id, sliced, told_apart, written
from weftgraph.llm.minhash import WordHashes, gram_hashes, mix
from weftgraph.plans.lineage import remove_table

#: Words of an anchor: windows of 20 words hold 15 of these, and pick the least.
ANCHOR = 6
_BASE = 0x9E3779B97F4A7C15


class Phrases:
    """The phrases of one text: starts and ends (first and last window), anchors and phrase hashes."""

    def __init__(self, words: np.ndarray, window: int) -> None:
        self.words, self.window = words, window
        grams = gram_hashes(words, ANCHOR)
        per = window - ANCHOR + 1
        if len(grams) < per:
            self.first = self.last = np.zeros(0, np.int64)
            self.anchors = self.hashes = np.zeros(0, np.uint64)
            return
        self.first, pick = _picks(grams, per)
        self.last = np.concatenate([self.first[1:], [len(grams) - per + 1]]) - 1
        self.anchors = grams[pick]
        # Polynomial sums, brought to a common power, tell stretches of words apart at the cost of two lookups each.
        up, down = _powers(len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
        stretch = (sums[self.last + window] - sums[self.first]) * down[self.first]
        self.hashes = mix(mix(stretch) + (self.last - self.first).astype(np.uint64))

    def again(self) -> np.ndarray:
        """True for phrases that stand earlier in the same text."""
        seen = np.ones(len(self.hashes), bool)
        seen[np.unique(self.hashes, return_index=True)[1]] = False
        return seen


def _picks(grams: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the stretches of windows (per grams each) that pick one gram, the leftmost least, and its places."""
    width, least = 1, grams
    while 2 * width <= per:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < per:
        least = np.minimum(least[: len(least) - (per - width)], least[per - width :])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    views = np.lib.stride_tricks.sliding_window_view(grams, per)
    pick = starts + views[starts].argmin(axis=1)
    # Where a least gram stands twice, the stretch goes on beyond its first place, and is cut there.
    if (np.append(starts[1:], len(least)) > pick + 1).any():
        each = np.arange(len(views)) + views.argmin(axis=1)
        starts = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
        pick = each[starts]
    return starts, pick


_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _tables[i] = np.cumprod(table, dtype=np.uint64)
    return _tables


def _word_ids(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of_text((text or "").encode("utf-8", "surrogatepass"))


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, phrase, doc, at, again) of each phrase of each text; at is its number in the text, again is true where it
    stands earlier in the same text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, 1):
            parts = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Phrases(_word_ids(t, hashes), window)
                n = len(own.first)
                if n:
                    parts.append((own.anchors.view(np.int64), own.hashes.view(np.int64), np.full(n, d, np.int64), np.arange(n, dtype=np.int32), own.again()))
            hashes.trim()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(5)], names=["anchor", "phrase", "doc", "at", "again"])

    return docs.mapInArrow(run, "anchor long, phrase long, doc long, at int, again boolean")


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """(hash, doc, start, again) of the windows of the phrases listed in check; marked has doc, packed and check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for batch in sliced(batches, 1):
            parts = []
            for d, packed, check in zip(*[c.to_pylist() for c in batch.columns]):
                own = Phrases(hashes.of(unpack.decompress(packed).split()), window)
                at = np.sort(np.array(check, np.int64))
                at = at[at < len(own.first)]
                n = own.last[at] - own.first[at] + 1
                starts = np.repeat(own.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keys = gram_hashes(own.words, window)[starts]
                again = np.ones(len(keys), bool)
                again[np.unique(keys, return_index=True)[1]] = False
                parts.append((keys.view(np.int64), np.full(len(keys), d, np.int64), starts.astype(np.int32), again))
            hashes.trim()
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(4)], names=["hash", "doc", "start", "again"])

    return marked.mapInArrow(run, "hash long, doc long, start int, again boolean")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, packed): texts as compressed UTF-8, for shuffles. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, 1):
            texts = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc", "packed"])

    return docs.mapInArrow(run, "doc long, packed binary")


def duplicate_spans(df: DataFrame, doc: str, text: str, window: int = 20, numbers: DataFrame | None = None) -> DataFrame:
    """(doc, phrases, starts) of each document that repeats an earlier one or itself: its phrases that are duplicates as a
    whole, as (at, source, source_at): their numbers here and where they first stand; and the starts of further windows.
    factors() and covered() turn them into words. With numbers, told_apart's table of (id, row_no), phrases also have
    source_id, the id behind the source's row number.

    A window of `window` words is a duplicate if the same words start earlier: in a smaller doc, or earlier in the same.
    Words are separated by blanks; null and short texts have no window. A null id counts as the largest. Rows that repeat
    an id must repeat its text here, and are then one document (see told_apart). An empty table gives no rows; extra columns are ignored.
    Stretches are compared by 64-bit hashes under a common anchor.
    """
    docs = df.select(order_id(doc).alias("doc"), F.col(text).alias("text"))
    found = written(_occurrences(docs, window), "occurrences")
    varied = found.groupBy("anchor").agg(F.min("phrase").alias("low"), F.max("phrase").alias("high")).where("low < high").select("anchor", F.lit(True).alias("v"))
    first_at = F.min_by("at", F.when(~F.col("again"), F.col("doc")))
    index = found.groupBy("anchor", "phrase").agg(F.min("doc").alias("first_doc"), first_at.alias("first_at"), F.count(F.lit(1)).alias("n"))
    blocks = index.join(varied, "anchor", "left")
    blocks = blocks.where("n > 1 OR v").select("phrase", "first_doc", "first_at", F.coalesce("v", F.lit(False)).alias("varied"))
    if numbers is not None:
        blocks = blocks.join(numbers.select(F.col("row_no").alias("first_doc"), F.nullif("id", F.lit(2**63 - 1)).alias("source_id")), "first_doc", "left")
    common = written(blocks, "common")
    named = ["source_id"] if numbers is not None else []
    met = found.drop("anchor").join(common, "phrase").where("first_doc < doc OR again OR varied")
    whole = (F.col("first_doc") < F.col("doc")) | F.col("again")
    lists = met.groupBy("doc").agg(F.collect_set(F.when(whole, F.struct("at", F.col("first_doc").alias("source"), F.col("first_at").alias("source_at"), *named))).alias("phrases"), F.collect_set(F.when(~whole, F.col("at"))).alias("check"))
    lists = written(lists, "phrases")
    # Half of the operator's disk space; what follows reads lists alone.
    remove_table(found)
    remove_table(common)
    marked = _packed(docs).join(lists.where("size(check) > 0").select("doc", "check"), "doc")
    windows = written(_windows(marked.select("doc", "packed", "check"), window).distinct(), "windows")
    firsts = windows.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("hash", "low")
    late = windows.where("NOT again").join(firsts, "hash").where("low < doc").select("doc", "start")
    starts = late.unionByName(windows.where("again").select("doc", "start")).groupBy("doc").agg(F.collect_set("start").alias("starts"))
    return lists.select("doc", "phrases").join(starts, "doc", "left").where("size(phrases) > 0 OR starts IS NOT NULL")


def factors(own: Phrases, at: np.ndarray, source_at: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, place) of the greedy factors of a text, in words: the longest runs of known phrases, from left to
    right, that follow one another in one source; place: where the lists have a factor's first phrase."""
    order = np.argsort(at, kind="stable")
    order = order[at[order] < len(own.first)]
    at, source, source_at = at[order], source[order], source_at[order]
    if not len(at):
        return at, at, order
    goes_on = (np.diff(at) == 1) & (np.diff(source) == 0) & (np.diff(source_at) == 1)
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    tails = np.append(heads[1:], len(at)) - 1
    return own.first[at[heads]], own.last[at[tails]] + own.window, order[heads]


def covered(own: Phrases, begins: np.ndarray, stops: np.ndarray, starts: list[int] | None) -> np.ndarray:
    """True for the words of a text that lie in one of its factors or single duplicate windows."""
    n = len(own.words)
    edge = np.zeros(n + 1, np.int64)
    single = np.array(starts or [], np.int64)
    single = single[single + own.window <= n]
    np.add.at(edge, np.concatenate([begins, single]).astype(np.int64), 1)
    np.add.at(edge, np.concatenate([stops, single + own.window]).astype(np.int64), -1)
    return np.cumsum(edge)[:n] > 0


def _cut(raw: bytes, flips: np.ndarray) -> bytes:
    """raw without the words from each flips[2k] up to flips[2k + 1], and without the blanks after them."""
    data = np.frombuffer(raw, np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = np.append(np.flatnonzero(word & ~np.concatenate([[False], word[:-1]])), len(raw))
    parts, at = [], 0
    for i, j in zip(begins[flips[::2]], begins[flips[1::2]]):
        parts.append(raw[at:i])
        at = j
    return b"".join([*parts, raw[at:]])


def remove_duplicate_spans(df: DataFrame, doc: str, text: str, keep: list[str], window: int = 20, join_words: bool = True) -> DataFrame:
    """keep columns of every row with text (what is left), n_words, n_removed, removed, the spans as (start, words), and
    factors, the parse as (start, words, source): source is the id of the document that first holds the factor's phrases,
    null for one without an id.

    What is left are the kept words joined by one space and a null text is empty; with join_words=False the blanks between
    kept words stay as they are and a null text is null. Rows with the same id, or none, and different texts are documents
    of their own, in the order of the texts' hashes. A column of keep that is named like a result gives way to it. See
    duplicate_spans.
    """
    df, doc, numbers = told_apart(df, doc, text)
    others = kept(keep, [text, "n_words", "n_removed", "removed", "factors"])
    schema = T.StructType(
        [
            *[df.schema[c] for c in others],
            T.StructField(text, T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType())]))),
            T.StructField("factors", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("source", T.LongType())]))),
        ]
    )
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
    factor = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("source", pa.int64())]))
    width = len(others)
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(others)]
    out_type = [f.name for f in schema]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, width):
            texts = [None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.binary()), batch.column(width + 1)], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for batch in sliced(batches, width):
            texts, counts, gone, spans, parses = [], [], [], [], []
            for packed, starts, *phrases in zip(*[c.to_pylist() for c in batch.columns[width:]]):
                raw = b"" if packed is None else unpack.decompress(packed)
                words = raw.split()
                counts.append(len(words))
                if not phrases[0] and not starts:
                    gone.append(0)
                    spans.append([])
                    parses.append([])
                    texts.append((b" ".join(words) if join_words else raw).decode("utf-8", "surrogatepass") if packed is not None or join_words else None)
                    continue
                own = Phrases(hashes.of(words), window)
                begins, stops, places = factors(own, *[np.array(x or [], np.int64) for x in phrases[:3]])
                parses.append([{"start": i, "words": j - i, "source": phrases[-1][k]} for i, j, k in zip(begins.tolist(), stops.tolist(), places.tolist())])
                out = covered(own, begins, stops, starts)
                gone.append(int(out.sum()))
                flips = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append([{"start": int(i), "words": int(j - i)} for i, j in zip(flips[::2], flips[1::2])])
                left = b" ".join([w for w, o in zip(words, out.tolist()) if not o]) if join_words else _cut(raw, flips)
                texts.append(left.decode("utf-8", "surrogatepass"))
            hashes.trim()
            cols = [batch.column(i) for i in range(width)]
            cols += [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(parses, factor)]
            yield pa.RecordBatch.from_arrays(cols, names=out_type)

    rows = df.select(*named, F.col(text).alias("packed"), order_id(doc).alias("__doc"))
    names = rows.columns
    kinds = T.StructType([T.StructField("packed", T.BinaryType()) if f.name == "packed" else f for f in rows.schema])
    spans_of = duplicate_spans(df, doc, text, window, numbers)
    joined = rows.mapInArrow(pack, kinds).join(spans_of.withColumnRenamed("doc", "__d"), F.col("__doc") == F.col("__d"), "left")
    parts = [F.col(f"phrases.{c}").alias(f"p_{c}") for c in ("at", "source_at", "source")]
    if numbers is not None:
        parts.append(F.col("phrases.source_id").alias("p_id"))
    return joined.select(*names[:width], "packed", "starts", *parts).mapInArrow(apply, schema)
