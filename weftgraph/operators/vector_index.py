"""Approximate vector search by an inverted file: every row lies in the list of its nearest centroid, and a query scores only
the rows of the lists nearest to it. vector.top_k_join is the exact search.

Rows and queries are scored in blocks, a matrix product for each pair of blocks of one list, so that a task's memory follows
the blocks and not the lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.plans.lineage import materialized

#: Rows that centroids are fitted on (those with the smallest hashes of their keys), the most centroids, and rows of a block.
SAMPLE_ROWS, MOST_LISTS, BLOCK_ROWS = 20_000, 4096, 1024

#: Sample rows that are asked for their PROBE_K nearest ones in the sample to find how many lists hold PROBE_SHARE of these.
PROBE_ROWS, PROBE_K, PROBE_SHARE = 256, 20, 0.97


def _nearest(units: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector, in blocks: the product of a whole sample and all centroids is large."""
    return np.concatenate([np.argmax(units[i : i + BLOCK_ROWS] @ book.T, axis=1) for i in range(0, len(units), BLOCK_ROWS)])


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; the first are spread over the sample in its order."""
    book = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(sample, book)
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, sample)
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        book = np.where(sizes > 0, sums / np.where(sizes > 0, sizes, 1), book)
    # Of centroids that are one but for rounding, as copies in the sample make them, the first stays.
    return book[np.sort(np.unique(np.round(book, 6), axis=0, return_index=True)[1])]


def lists_to_probe(units: np.ndarray, book: np.ndarray, share: float = PROBE_SHARE) -> int:
    """How many lists, in the order of a query's nearest centroids, hold this share of its nearest rows in the sample."""
    of, own = _nearest(units, book), np.arange(0, len(units), max(1, len(units) // PROBE_ROWS))
    found = []
    for at in np.array_split(own, -(-len(own) // 64)):
        scores = units[at] @ units.T
        scores[np.arange(len(at)), at] = -2
        near = np.argsort(-scores, axis=1)[:, : min(PROBE_K, len(units) - 1)]
        place = np.argsort(np.argsort(-(units[at] @ book.T), axis=1, kind="stable"), axis=1)
        found.append(np.take_along_axis(place, of[near], axis=1).ravel())
    places = np.concatenate(found)
    return 1 + int(np.quantile(places, share, method="higher")) if places.size else 1


def _unit(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(rows: DataFrame, vector: str, width: int | None = None) -> DataFrame:
    """Rows with a finite vector other than zero, of one length if that is given. Others are near to nothing."""
    finite = F.coalesce(F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), F.lit(False))
    met = rows.where(finite & F.exists(vector, lambda x: x != 0))
    return met if width is None else met.where(F.size(vector) == width)


def _dealt(rows: DataFrame, key: str, vector: str, book: np.ndarray, probes: int) -> DataFrame:
    """(list, key, vector as float64 bytes) of unit vectors, a row for each of the `probes` nearest lists."""
    shared, width = rows.sparkSession.sparkContext.broadcast(book), book.shape[1]
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("key", rows.schema[key].dataType), T.StructField("unit", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                units = _unit(part.column(1), width)
                near = np.argsort(-(units @ shared.value.T), axis=1, kind="stable")[:, :probes]
                row = np.repeat(np.arange(len(units)), near.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), part.column(0).take(pa.array(row)), pa.array([units[i].tobytes() for i in row], pa.binary())], names=schema.names)

    return rows.select(key, vector).mapInArrow(run, schema)


def _blocks(dealt: DataFrame, size: int) -> DataFrame:
    """(list, keys, block) with up to `size` vectors of one list each, from rows that are sorted by list in their partitions."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("keys", T.ArrayType(dealt.schema["key"].dataType)), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
            for begin, end in zip(starts, [*starts[1:], len(of)]):
                for at in range(begin, end, size):
                    part = batch.slice(at, min(size, end - at))
                    keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), keys, pa.array([b"".join(part.column(2).to_pylist())], pa.binary())], names=schema.names)

    return dealt.mapInArrow(run, schema)


@dataclass(frozen=True)
class VectorIndex:
    """lists: (list, keys, block), a written table of every usable row; book: the centroids (lists x dimensions); probes: how
    many lists a query needs by the sample. Data without clusters need many, up to all."""

    lists: DataFrame
    book: np.ndarray
    key: str
    probes: int

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query, key, score, rank): the k rows of the nearest `probes` lists with the highest cosine to each query.

        queries has (query, vector). Ties go to the smaller key, scores that agree to 12 digits tie. Queries with null, zero
        or non-finite vectors, or of another length than the index's, find nothing; repeated queries count once.
        """
        width, k_type = self.book.shape[1], self.lists.schema["keys"].dataType.elementType
        asked = usable(queries, "vector", width).dropDuplicates(["query"])
        dealt = _dealt(asked, "query", "vector", self.book, min(probes or self.probes, len(self.book)))
        asked = _blocks(dealt.repartition("list").sortWithinPartitions("list"), BLOCK_ROWS).toDF("__list", "asked", "questions")
        # Blocks of near copies look small, compressed, and take many times that in the driver that would broadcast them.
        met = self.lists.hint("merge").join(asked, F.col("list") == F.col("__list")).select("keys", "block", "asked", "questions")
        schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField(self.key, k_type), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    rows = np.frombuffer(batch.column(1)[i].as_buffer(), np.float64).reshape(-1, width)
                    wanted = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(-1, width)
                    scores = np.round(wanted @ rows.T, 12)
                    # All rows that could be among the k best: those that tie with the last place too.
                    last = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                    q, r = np.nonzero(scores >= last[:, None])
                    columns = [batch.column(2)[i].values.take(pa.array(q)), batch.column(0)[i].values.take(pa.array(r)), pa.array(scores[q, r])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col(self.key)))
        return met.mapInArrow(run, schema).withColumn("rank", best).where(F.col("rank") <= k)


def build_index(rows: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE_ROWS) -> VectorIndex | None:
    """An index of every row with a usable vector (see usable()) of the length of the sample's first; None without any.

    Centroids are fitted on at most `sample` rows, those with the smallest hashes of their keys; without a number of lists
    there are about as many as the square root of the rows, at most MOST_LISTS and one for four rows of the sample. Rows are
    dealt by range of (list, hash of key), so that a list with a large share of them is split. Repeated keys stay apart.
    """
    fit = usable(rows, vector)
    # Arrow buffers: as Python objects the sample takes several times its size.
    drawn = fit.orderBy(F.xxhash64(key), key).limit(sample).select(vector).toArrow().column(0).combine_chunks()
    if not len(drawn):
        return None
    sizes = drawn.value_lengths()
    width = sizes[0].as_py()
    units = _unit(drawn.filter(pa.compute.equal(sizes, width)), width)
    fit = usable(rows, vector, width)
    count = lists or int(fit.count() ** 0.5)
    book = centroids(units, max(1, min(count, MOST_LISTS, max(1, len(units) // 4))))
    dealt = materialized(_dealt(fit, key, vector, book, 1), "dealt")
    placed = dealt.repartitionByRange(F.col("list"), F.xxhash64("key")).sortWithinPartitions("list")
    return VectorIndex(materialized(_blocks(placed, BLOCK_ROWS), "index"), book, key, lists_to_probe(units, book))
