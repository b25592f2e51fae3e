"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification and union-find.

Every shingle draws a random permutation of the signature's slots and, level by level, a rank that grows with the level;
a slot keeps the least rank. Levels stop as soon as no slot can still fall, which for longer texts is after one or two.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import order_id, shuffle_width, sliced, told_apart, written
from weftgraph.llm.components import components

#: Bands and their rows: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^24 < 4e-6.
BANDS, ROWS = 24, 4
#: Shingles signed together, documents that one copy of a pivot is compared with, and members of a slice of a cluster.
_BLOCK, _SLICE, _MEMBERS = 60_000, 200, 200
#: Documents and shingles of a block of queries, which a task holds whole; slices of over _FULL members are cut further.
_QUERIES, _HELD, _FULL = 2000, 2_000_000, 2000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, computed once each; emptied by trim() when large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_text(self, raw: bytes, most: int = 4_000_000) -> np.ndarray:
        """The hashes of a text's words; a long text is split in stretches of about most bytes, cut at blanks."""
        if len(raw) <= most:
            return self.of(raw.split())
        parts, at = [], 0
        while at < len(raw):
            cut = _BLANKS.search(raw, min(at + most, len(raw)))
            end = cut.start() if cut else len(raw)
            parts.append(self.of(raw[at:end].split()))
            self.trim()
            at = end
        return np.concatenate(parts)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size word hashes."""
    n = len(words) - size + 1
    out = np.full(max(0, n), np.uint64(size))
    for k in range(size if n > 0 else 0):
        out = out * _GOLDEN + words[k : n + k]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of size words, A-Z lower-cased; fewer words are one shingle, none are none."""
    ids = hashes.of_text((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(ids):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(ids, min(size, len(ids))))


def signed_sets(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """super_minhash of sets of any size: parts of at most _BLOCK values are signed, and a set has its parts' minima."""
    parts = [(i, s[k : k + _BLOCK]) for i, s in enumerate(sets) for k in range(0, max(1, len(s)), _BLOCK)]
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, part in enumerate(parts):
        block.append(part)
        size += len(part[1])
        if size >= _BLOCK or k == len(parts) - 1:
            np.minimum.at(sig, [i for i, _ in block], super_minhash([s for _, s in block], slots))
            block, size = [], 0
    return sig


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of some sets; an empty set has the greatest value in all slots."""
    sig = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    perm = np.tile(np.arange(slots, dtype=np.uint8), (len(values), 1))
    flat = sig.reshape(-1)
    for level in range(slots):
        if not len(values):
            break
        draw = mix(values + np.uint64((int(_GOLDEN) * (level + 1)) % 2**64))
        rows = np.arange(len(values))
        pick = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, pick]
        perm[rows, pick] = perm[:, level]
        rank = np.uint64(level << 32) | (draw >> np.uint64(32))
        np.minimum.at(flat, owner * slots + slot, rank)
        # A slot that holds a rank of this level or below can't fall at the next; done when all do.
        going = np.unique(owner)
        going = going[sig[going].max(axis=1) >= np.uint64((level + 1) << 32)]
        keep = np.isin(owner, going)
        if not keep.all():
            values, owner, perm = values[keep], owner[keep], perm[keep]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band; the low five bits are the band's number."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for k in range(ROWS):
        key = mix(key * _GOLDEN + parts[:, :, k])
    return (key & ~np.uint64(31)) | np.arange(BANDS, dtype=np.uint64)


def signatures(df: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """doc, n_shingles, set_a and set_b (together 128 bits that tell sets apart) and bands (empty for empty sets)."""
    schema = T.StructType(
        [T.StructField("doc", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_shingles", "set_a", "set_b")], T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        docs: list[int] = []
        sets: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            keys = band_keys(signed_sets(sets, BANDS * ROWS))
            per = np.where(sizes > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
            sums = [np.array([int(mix(s ^ salt).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64) for salt in (np.uint64(0), _GOLDEN)]
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes), *map(pa.array, sums), bands], names=schema.names)
            docs.clear()
            sets.clear()
            hashes.trim()
            return out

        size = 0
        for batch in sliced(batches, 1):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(d)
                sets.append(shingle_set(t, words, hashes))
                size += len(sets[-1])
                if size > _BLOCK:
                    yield flush()
                    size = 0
        if docs:
            yield flush()

    return df.select(order_id(doc), F.col(text)).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have 100 * intersection >= percent * union.

    texts has (doc, text). Each b meets its a's in one stream, cut into slices of bounded size with a copy of b's text
    each, so a b with very many partners is spread over tasks.
    """
    counted = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _SLICE).cast("int").alias("slices"))
    right = counted.join(texts.withColumnRenamed("doc", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("a"), "text"
    )
    left = (
        pairs.join(texts.withColumnRenamed("doc", "a"), "a")
        .join(counted, "b")
        .select("b", F.pmod(F.xxhash64("a"), F.col("slices").cast("long")).cast("int").alias("slice"), "a", "text")
    )
    rows = right.unionByName(left)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        pivot: np.ndarray = np.zeros(0, np.uint64)
        for batch in sliced(batches, 3):
            found: list[tuple[int, int]] = []
            for b, a, text in zip(*[batch.column(c).to_pylist() for c in ("b", "a", "text")]):
                own = shingle_set(text, words, hashes)
                if a is None:
                    pivot = own
                    continue
                small, large = sorted((len(own), len(pivot)))
                if 100 * small >= percent * large:
                    both = len(np.intersect1d(own, pivot, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(pivot) - both):
                        found.append((a, b))
            hashes.trim()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = rows.repartition(shuffle_width(pairs.sparkSession), "b", "slice").sortWithinPartitions("b", "slice", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, doc: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_key, n_shingles, component_id (the smallest document reachable over links) and kept for each row of df.

    Documents with equal sets form one class, whose smallest id stands for it. Classes that share a band key meet in a
    bucket. In a first round each class is compared with the smallest class of its buckets, in a second with the smallest
    of every bucket, in a third with another of every bucket. What shares a bucket but still lies in different components
    is then compared in blocks (see _rest_links). So a bucket of thousands of near copies costs a few comparisons for
    each, and no link within a bucket is lost. Links are confirmed on full sets.

    Null, empty and wordless texts have no shingle and are linked with nothing. A very long text is hashed and signed in
    blocks, so that a task holds 8 bytes for each of its shingles besides the text. doc_key is the id, null as the largest
    value. Rows with the same id are judged by their own text, and among those of them that are linked one text is kept;
    exact repetitions of a row get the same verdict. An empty table gives no rows; extra columns are ignored.
    """
    df, doc, numbers = told_apart(df, doc, text)
    signed = written(signatures(df, doc, text, words), "signed")
    some = signed.where("n_shingles > 0")
    classes = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc").alias("rep"))
    labelled = written(
        some.select("doc", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"]).select("doc", "n_shingles", "set_a", "set_b", "rep"), "classes"
    )
    reps = some.join(labelled.where("doc = rep").select("doc", "set_a", "set_b").distinct(), ["doc", "set_a", "set_b"], "left_semi")
    keyed = reps.select("doc", "n_shingles", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("pivot")).where("n > 1")
    buckets = written(keyed.join(shared.select("key", "pivot"), "key").select("key", "doc", "n_shingles", "pivot"), "buckets")
    wanted = buckets.select("doc").distinct()
    texts = df.select(order_id(doc).alias("doc"), F.col(text).alias("text"))
    texts = written(texts.join(wanted, "doc", "left_semi").dropDuplicates(["doc"]), "texts")

    def link(pairs: DataFrame, forest: DataFrame | None, name: str) -> tuple[DataFrame | None, DataFrame]:
        pairs = written(pairs, name)
        links = verified(pairs, texts, words, percent).toDF("child", "parent")
        return components(links if forest is None else links.unionByName(forest)), pairs

    first = buckets.where("pivot < doc").groupBy("doc").agg(F.min("pivot").alias("b")).select(F.col("doc").alias("a"), "b")
    forest, tested = link(first, None, "pairs1")
    for turn, pivot in ((2, "pivot"), (3, "other")):
        open_ones = _open_buckets(buckets, forest)
        near = open_ones.select("key", F.col("doc").alias("a"), F.col("comp").alias("comp_a"), F.col("n_shingles").alias("n_a"))
        far = open_ones.select(F.col("doc").alias("b"), F.col("comp").alias("comp_b"), F.col("n_shingles").alias("n_b")).distinct()
        met = near.join(open_ones.select("key", F.col(pivot).alias("b")).distinct(), "key").where("a != b").join(far, "b")
        apart = met.where(f"comp_a != comp_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        pairs = apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        forest, more = link(pairs, forest, f"pairs{turn}")
        tested = tested.unionByName(more)
    rest = _rest_links(_open_buckets(buckets, forest), reps, texts, words, percent)
    forest = components(rest.unionByName(forest))
    out = labelled.join(forest.select(F.col("child").alias("rep"), "parent"), "rep", "left")
    named = out.select(F.col("doc").alias("doc_key"), "n_shingles", F.coalesce("parent", "rep").alias("component_id"))
    every = named.unionByName(signed.where("n_shingles = 0").select(F.col("doc").alias("doc_key"), "n_shingles", F.col("doc").alias("component_id")))
    every = every.withColumn("kept", F.col("doc_key") == F.col("component_id"))
    if numbers is None:
        return every
    for column in ("doc_key", "component_id"):
        every = every.join(numbers.select(F.col("row_no").alias(column), F.col("id").alias(f"{column}_id")), column)
    return every.select(F.col("doc_key_id").alias("doc_key"), "n_shingles", F.col("component_id_id").alias("component_id"), "kept")


def _open_buckets(buckets: DataFrame, forest: DataFrame) -> DataFrame:
    """Members of the buckets that lie in more than one component: key, doc, n_shingles, comp, pivot and other, a second
    pivot (the smallest under another order)."""
    named = buckets.join(forest.select(F.col("child").alias("doc"), "parent"), "doc", "left").withColumn("comp", F.coalesce("parent", "doc"))
    mask = F.lit(0x2545F4914F6CDD1D)
    state = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.col("doc").bitwiseXOR(mask)).alias("masked"))
    state = state.where("low != high").select("key", F.col("masked").bitwiseXOR(mask).alias("other"))
    return written(named.join(state, "key").select("key", "doc", "n_shingles", "comp", "pivot", "other"), "open")


def _blocks(open_ones: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Members of open buckets, dealt so that those of different components meet: queries (query 0) and members (1).

    Buckets that share documents form a cluster. A cluster's largest component needs no comparison in itself, so the
    other members are the queries, dealt to blocks of about _QUERIES documents and _HELD shingles. Each block meets all
    members in slices: 64 of them, or as many as keep a slice between _MEMBERS and _FULL. A task holds one block and
    streams one slice, whatever the cluster's size.
    """
    first = open_ones.groupBy("key").agg(F.min("doc").alias("low"))
    shared = open_ones.join(first, "key").where("doc != low").select("doc", "low").distinct()
    cluster = components(shared)
    members = open_ones.select("doc", "comp", "n_shingles").distinct().join(cluster.withColumnRenamed("child", "doc"), "doc", "left")
    members = written(members.select("doc", "comp", "n_shingles", F.coalesce("parent", "doc").alias("cluster")), "members")
    sizes = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp", "held")).alias("top"), F.sum("n").alias("all"), F.sum("held").alias("held"))
    slices = F.greatest(F.least(F.ceil(F.col("all") / _MEMBERS), F.lit(64)), F.ceil(F.col("all") / _FULL))
    blocks = F.greatest(F.ceil((F.col("all") - F.col("top.n")) / _QUERIES), F.ceil((F.col("held") - F.col("top.held")) / _HELD), F.lit(1))
    main = main.select("cluster", F.col("top.comp").alias("main"), slices.cast("int").alias("slices"), blocks.cast("int").alias("blocks"))
    named = members.drop("n_shingles").join(main, "cluster")
    own = reps.select("doc", "bands", "n_shingles").dropDuplicates(["doc"])
    full = named.join(own, "doc").join(texts, "doc").withColumn("asks", F.col("comp") != F.col("main"))
    columns = ["cluster", "block", "slice", "query", "asks", "doc", "comp", "bands", "text"]
    dealt_to = lambda n, seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = full.where("asks").withColumns({"block": dealt_to("blocks", 1), "query": F.lit(0)}).withColumn("slice", each("slices"))
    there = full.withColumns({"slice": dealt_to("slices", 2), "query": F.lit(1)}).withColumn("block", each("blocks"))
    return asked.select(*columns).unionByName(there.select(*columns))


def _rest_links(open_ones: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(child, parent) links between members of open buckets that lie in different components.

    Only pairs that share a band key are compared, two queries once, inside the task of their block and slice (see
    _blocks), and only links leave it.
    """
    rows = _blocks(open_ones, reps, texts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        place: tuple[int, int, int] | None = None
        queries: list[tuple[int, int, np.ndarray]] = []
        keys: list[np.ndarray] = []
        table = np.zeros((0, BANDS), np.int64)
        for batch in sliced(batches, 8):
            found: list[tuple[int, int]] = []
            for cluster_, block, slice_, query, asks, doc, comp, bands, text in zip(*[c.to_pylist() for c in batch.columns]):
                if place != (cluster_, block, slice_):
                    place, queries, keys = (cluster_, block, slice_), [], []
                own = shingle_set(text, words, hashes)
                if query == 0:
                    queries.append((doc, comp, own))
                    keys.append(np.array(bands, np.int64))
                    table = np.zeros((0, BANDS), np.int64)
                    continue
                if len(table) != len(keys):
                    table = np.stack(keys)
                for i in np.flatnonzero((table == np.array(bands, np.int64)).any(axis=1)) if queries else ():
                    other, other_comp, theirs = queries[i]
                    if other_comp == comp or (asks and other >= doc) or 100 * min(len(own), len(theirs)) < percent * max(len(own), len(theirs)):
                        continue
                    both = len(np.intersect1d(own, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(theirs) - both):
                        found.append((max(doc, other), min(doc, other)))
            hashes.trim()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["child", "parent"])

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "cluster", "block", "slice").sortWithinPartitions("cluster", "block", "slice", "query", "doc")
    return dealt.mapInArrow(compare, "child long, parent long")
