"""Phrase collocations by suffix-sigma: every contiguous phrase of up to max_n words is counted from sorted suffixes.

Each word begins a suffix of at most max_n words, cut at the end of its piece. Suffixes are shuffled by language and first
word, sorted in reverse order, and one stack of open prefixes counts all phrases: a row closes the prefixes that it does
not share with the row before. First words (and prefixes of theirs) that hold a large share of all words are dealt by
further words; their counts are then partial, and are summed at the end. Scores come from joins of phrases with their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import give_back, sliced, written

#: Between the language and the words of a key; lower than all bytes that words have once ESCAPED is applied.
SEP = "\x01"
ESCAPED = {"\x02": "\x02\x05", "\x01": "\x02\x04", "\x00": "\x02\x03"}

#: A-Z as a-z, tabs as spaces, ends of pieces as line breaks.
_PIECE_ENDS = b".,;:!?\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + _PIECE_ENDS, bytes(range(97, 123)) + b" " + b"\n" * len(_PIECE_ENDS))
_EDGE = re.compile(rb"[ \n]")

#: Bytes of text whose suffixes a task counts at once, suffixes that a partition sorts, and the most partitions; beyond
#: them partitions grow, which Spark's sort spills.
WINDOW_BYTES, PARTITION_SUFFIXES, MOST_PARTITIONS = 4_000_000, 1_500_000, 20_000

#: A prefix with over one in so many of all words is dealt by a further word, so there are at most so many of each length.
HEAVY_PARTS = 4096


def _escaped(text: str) -> str:
    for plain, code in ESCAPED.items():
        text = text.replace(plain, code)
    return text


class Tokens:
    """The words of a window of texts: distinct ones, and for each occurrence its code from 1 and those of the words after it."""

    def __init__(self, raw: bytes, begin: int, end: int, ahead: int, doc_starts: np.ndarray, doc_langs: np.ndarray, max_n: int) -> None:
        a = np.frombuffer(raw, np.uint8, ahead - begin, begin)
        word = (a != 32) & (a != 10)
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(a[word])).dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64) + 1
        piece = np.cumsum(a == 10, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        own = int(np.searchsorted(starts, end - begin))
        self.lang = doc_langs[np.searchsorted(doc_starts, starts[:own] + begin, "right") - 1]
        self.codes = np.zeros((max_n, own), np.int64)
        for j in range(max_n):
            n = min(own, len(codes) - j)
            self.codes[j, :n] = np.where(piece[j : j + n] == piece[:n], codes[j : j + n], 0)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        """A hash for each code, 0 for no word."""
        return np.concatenate([np.zeros(1, np.uint64), _hashed(self.words)])

    def groups(self, length: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One position of each distinct (language, first length words), and how often it occurs, among positions at."""
        lang, codes = (self.lang, self.codes) if at is None else (self.lang[at], self.codes[:, at])
        base = len(self.words) + 1
        key, top = lang.astype(np.int64), int(lang.max(initial=0)) + 1
        for j in range(length):
            if top * base >= 2**63:
                key = np.unique(key, return_inverse=True)[1]
                top = len(key) + 1
            key, top = key * base + codes[j], top * base
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        return (first if at is None else at[first]), counts

    def keys(self, at: np.ndarray, langs: pa.Array, length: int, with_lang: bool = True) -> pa.Array:
        """The suffixes at these positions as strings, language first."""
        words = pa.concat_arrays([pa.array([None], pa.string()), self.words])
        parts = [words.take(pa.array(self.codes[j, at])) for j in range(length)]
        return pc.binary_join_element_wise(*([langs.take(pa.array(self.lang[at]))] if with_lang else []), *parts, SEP, null_handling="skip")


def _windows(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[tuple[Tokens, pa.Array]]:
    """The words of (lang, text) batches, in windows that begin each suffix once, with their languages."""
    more = re.compile(rb"(?: +[^ \n]+){0,%d}" % (max_n - 1))
    for batch in sliced(batches, 1, WINDOW_BYTES):
        coded = pc.fill_null(batch.column(0), "und").dictionary_encode()
        langs, doc_langs = pa.array([_escaped(x) for x in coded.dictionary.to_pylist()], pa.string()), coded.indices.to_numpy()
        texts = pc.fill_null(batch.column(1), "").cast(pa.binary()).to_pylist()
        raw = b"\n".join(texts)
        if any(x.encode() in raw for x in ESCAPED):
            texts = [_escaped(t.decode()).encode() for t in texts]
            raw = b"\n".join(texts)
        raw = raw.translate(_PLAIN)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        texts, begin = None, 0
        while begin < len(raw):
            end = begin + WINDOW_BYTES
            cut = _EDGE.search(raw, end) if end < len(raw) else None
            end = cut.start() if cut else len(raw)
            yield Tokens(raw, begin, end, more.match(raw, end).end(), np.cumsum(sizes) - sizes, doc_langs, max_n), langs
            begin = end
    give_back()


def _hashed(texts: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in texts.to_pylist()), np.uint64, len(texts))


def _prefix_hashes(t: Tokens, at: np.ndarray, langs: pa.Array, lengths: int) -> list[np.ndarray]:
    """For each length, a hash of (language, first words) of the suffixes at these positions."""
    out, h = [], _hashed(langs)[t.lang[at]]
    for j in range(lengths):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + t.word_hashes[t.codes[j, at]]
        out.append(h ^ (h >> np.uint64(32)))
    return out


def _hash_of(key: str) -> int:
    """The hash of _prefix_hashes for a whole key, language first."""
    lang, *words = key.split(SEP)
    h = xxhash.xxh64_intdigest(lang)
    for w in words:
        h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(w)) % 2**64
    return h ^ (h >> 32)


def _usual(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))


def word_shares(docs: DataFrame, lang: str, text: str, max_n: int) -> DataFrame:
    """(lang, prefix, n) to be summed: the number of words (prefix null), and of prefixes of up to max_n - 1 words that are
    frequent in a window. A prefix with one in HEAVY_PARTS of all words has at least half of them in windows that report it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, langs in _windows(batches, max_n):
            n = np.bincount(t.lang, minlength=len(langs))
            own = np.flatnonzero(n)
            names, keys, counts = [langs.take(pa.array(own))], [pa.nulls(len(own), pa.string())], [n[own]]
            at, least = np.arange(len(t.lang)), max(2, len(t.lang) // (2 * HEAVY_PARTS))
            for length in range(1, max_n):
                first, count = t.groups(length, at)
                often = (count >= least) & (t.codes[length - 1, first] > 0)
                first, count = first[often], count[often]
                names.append(langs.take(pa.array(t.lang[first])))
                keys.append(t.keys(first, langs, length))
                counts.append(count)
                hashes = _prefix_hashes(t, at, langs, length)[-1]
                at = at[np.isin(hashes, _prefix_hashes(t, first, langs, length)[-1])]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.concat_arrays(keys), pa.array(np.concatenate(counts), pa.int64())], names=["lang", "prefix", "n"])

    rows = _usual(docs, lang, text).mapInArrow(run, "lang string, prefix string, n long")
    return rows.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def _packed_suffixes(docs: DataFrame, lang: str, text: str, max_n: int, buckets: int, heavy: list[str]) -> DataFrame:
    """(bucket, depth, keys, counts): the suffixes of a window by bucket. depth: words that decide the bucket, so that
    phrases of at least so many words lie in one bucket, and shorter ones in several."""
    heavy_hashes = np.array(sorted(map(_hash_of, heavy)), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, langs in _windows(batches, max_n):
            at, counts = t.groups(max_n)
            if not len(at):
                continue
            hashes = _prefix_hashes(t, at, langs, max_n)
            depth, split, chosen = np.ones(len(at), np.int8), np.ones(len(at), bool), hashes[0]
            for length in range(1, max_n):
                split &= np.isin(hashes[length - 1], heavy_hashes)
                depth[split] = length + 1
                chosen = np.where(split, hashes[length], chosen)
            bucket = (chosen % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((bucket, depth))
            bucket, depth = bucket[order], depth[order]
            begins = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (depth[1:] != depth[:-1])]))
            offsets = pa.array(np.concatenate([begins, [len(order)]]).astype(np.int32))
            keys = pa.ListArray.from_arrays(offsets, t.keys(at[order], langs, max_n))
            many = pa.ListArray.from_arrays(offsets, pa.array(counts[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(depth[begins]), keys, many], names=["bucket", "depth", "keys", "counts"])

    return _usual(docs, lang, text).mapInArrow(run, "bucket int, depth tinyint, keys array<string>, counts array<int>")


def _count_prefixes(max_n: int, least: int):
    """A function over batches of (depth, key, n), sorted by key in reverse: (lang, phrase, words, n) of every prefix with
    n >= least, and of those that other partitions may have as well (words < depth)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[str] = []
        # The stack: for each number of words the prefix that is open, its count so far and its depth.
        opened: list[tuple[str, int, int] | None] = [None] * (max_n + 1)

        def closed(done: list[tuple[int, str, int]]) -> pa.RecordBatch:
            parts = [key.split(SEP)[: length + 1] for length, key, _ in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in parts], pa.string()), pa.array([SEP.join(p[1:]) for p in parts], pa.string()), pa.array([x[0] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.int64())],
                names=["lang", "phrase", "words", "n"],
            )

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            depth, keys, n = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy().astype(np.int64)
            tokens = pc.split_pattern(keys, SEP)
            bounds = tokens.offsets.to_numpy()
            sizes = np.diff(bounds)
            codes = tokens.values.dictionary_encode().indices.to_numpy()
            table = np.full((rows, max_n + 1), -1, np.int32)
            table[np.arange(max_n + 1) < sizes[:, None]] = codes
            first, common = keys[0].as_py().split(SEP), np.zeros(rows, np.int8)
            common[0] = next((i for i, (x, y) in enumerate(zip(first, before)) if x != y), min(len(first), len(before)))
            same = np.ones(rows - 1, bool)
            for j in range(max_n + 1):
                same &= table[1:, j] == table[:-1, j]
                common[1:] += same
            done: list[tuple[int, str, int]] = []
            for length in range(1, max_n + 1):
                at = np.flatnonzero(sizes > length)
                pushed = np.flatnonzero(common[at] <= length)
                if (now := opened[length]) is not None:
                    key, so_far, deep = now
                    opened[length] = (key, so_far + int(n[at[: pushed[0]] if len(pushed) else at].sum()), deep)
                if not len(pushed):
                    continue
                if (now := opened[length]) is not None and (now[1] >= least or length < now[2]):
                    done.append((length, now[0], now[1]))
                sums, begins = np.add.reduceat(n[at], pushed), at[pushed]
                for i in np.flatnonzero((sums[:-1] >= least) | (length < depth[begins[:-1]])).tolist():
                    done.append((length, keys[int(begins[i])].as_py(), int(sums[i])))
                opened[length] = (keys[int(begins[-1])].as_py(), int(sums[-1]), int(depth[begins[-1]]))
            before = keys[rows - 1].as_py().split(SEP)
            if done:
                yield closed(done)
        last = [(length, x[0], x[1]) for length, x in enumerate(opened) if x is not None and (x[1] >= least or length < x[2])]
        if last:
            yield closed(last)
        give_back()

    return run


def phrase_counts(docs: DataFrame, lang: str, text: str, max_n: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of up to max_n words with n >= least, (lang, n) words of each language).

    lang and phrase are keys: words joined by SEP, with ESCAPED applied; readable() gives them back. Both are written tables.
    """
    shares = written(word_shares(docs, lang, text, max_n), "word_shares")
    words = shares.where("prefix IS NULL").select("lang", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Prefixes of one length do not overlap, so each length has HEAVY_PARTS of them at most (twice that in bounds).
    heavy = [r.prefix for r in shares.where(F.col("prefix").isNotNull() & (F.col("n") * 2 * HEAVY_PARTS >= total) & (F.col("n") >= 64)).select("prefix").collect()]
    parts = min(MOST_PARTITIONS, 1 + total // PARTITION_SUFFIXES)
    packed = _packed_suffixes(docs, lang, text, max_n, parts, heavy).repartitionById(parts, F.col("bucket"))
    suffixes = packed.select("depth", F.inline(F.arrays_zip("keys", "counts"))).select("depth", F.col("keys").alias("key"), F.col("counts").alias("n"))
    counted = suffixes.sortWithinPartitions(F.desc("key")).mapInArrow(_count_prefixes(max_n, least), "lang string, phrase string, words int, n long")
    counts = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return written(counts, "phrases"), words


def readable(key, between: str = " "):
    """A key column as text."""
    out = F.replace(key, F.lit(SEP), F.lit(between))
    for plain, code in reversed(ESCAPED.items()):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def mine_phrases(docs: DataFrame, lang: str, text: str, max_n: int = 3, least: int = 10, covered_percent: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the most strongly bound phrases of 2 to max_n words of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line breaks, and those into words at spaces and tabs. n
    counts a language's words, a the phrase (overlaps included); of all cuts into two parts, found l and r times, the one
    with the lowest score floor(1000000 a a / (l r)) counts, of equal ones the first. Phrases found fewer than least times
    are no candidates; those inside a longer candidate that makes up covered_percent of their occurrences are dropped. Each
    language's first `most` are ranked by score, a (both descending) and phrase in byte order.

    Null and empty texts have no words, a null language is und. Repeated rows count each time; an empty table gives no rows;
    other columns are not read. Very long texts go in windows that overlap by max_n - 1 words. Arithmetic is exact up to
    a = 10^16.
    """
    if max_n < 2:
        raise ValueError("phrases have two words at least")
    found, words = phrase_counts(docs, lang, text, max_n, least)
    part = lambda begin, size: F.array_join(F.slice("own", begin, size), SEP)
    candidates = found.where("words > 1").withColumn("own", F.split("phrase", SEP))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", "own", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    scored = scored.withColumns({"num": whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), "den": whole("l") * whole("r")})
    best = scored.select("lang", "phrase", "a", F.struct(F.expr("num div den").alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = candidates.where("words > 2").select("lang", "n", "words", "own", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "n", "own", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    covers = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(covers, ["lang", "phrase"], "left").where(F.coalesce(whole("longer") * 100 < whole("a") * covered_percent, F.lit(True)))
    shown = kept.select("lang", readable(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = shown.withColumn("rank", rank).where(F.col("rank") <= most)
    out = ranked.join(words, "lang")
    return out.select(readable(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
