"""Vector codes: product quantization trained by RDD treeAggregate over columnar blocks of numbers.

A block holds the components of some hundred vectors, one array for each dimension. In each round a task accumulates the
squared distances of its blocks to all entries dimension by dimension, adds sums and counts of the nearest entries with
np.add.at, and these integer tensors merge through a tree of tasks. The driver gets one tensor, whose size the codebooks fix.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import give_back, kept, written

#: Vectors of a block, and the largest component for which sums of squares stay within 64 bits in any vector of up to
#: 2^16 dimensions a part. Larger ones are computed with Python's integers, exactly and slowly.
BLOCK_ROWS, LARGE = 512, 2**22


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact for every finite double: as int64 where small, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = values.astype(np.float64) * scale
    if not values.size or np.abs(scaled).max() < LARGE:
        return np.floor(scaled).astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 2.0**40 else int(x) * scale for x in values.astype(np.float64).ravel().tolist()]
    return np.array([*exact, None], object)[:-1].reshape(values.shape)


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of block (dimensions x vectors) the lower index of the nearest entry of book (entries x dimensions),
    and its squared distance."""
    kind = object if object in (block.dtype, book.dtype) else np.int64
    distance, gap = np.zeros((2, block.shape[1], len(book)), kind)
    for x, entries in zip(block, book.T):
        np.subtract(x[:, None], entries[None, :], out=gap)
        np.multiply(gap, gap, out=gap)
        distance += gap
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(best)), best]


class Tensor:
    """Sums and counts of the parts that each entry has got; adds blocks and other tensors."""

    def __init__(self, books: np.ndarray) -> None:
        self.sums, self.counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)

    def add(self, block: np.ndarray, books: np.ndarray) -> Tensor:
        width = books.shape[2]
        if block.dtype == object and self.sums.dtype != object:
            self.sums = self.sums.astype(object)
        for p, book in enumerate(books):
            own = block[p * width : (p + 1) * width]
            best, _ = nearest(own, book)
            np.add.at(self.sums[p], best, own.T)
            np.add.at(self.counts[p], best, 1)
        return self

    def merge(self, other: Tensor) -> Tensor:
        self.sums, self.counts = self.sums + other.sums, self.counts + other.counts
        return self

    def moved(self, books: np.ndarray) -> np.ndarray:
        """Each entry at the floored mean of its parts; unused ones stay."""
        used = self.counts > 0
        out = books.astype(object) if object in (self.sums.dtype, books.dtype) else books.copy()
        out[used] = self.sums[used] // self.counts[used][:, None]
        return out


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False)))


def first_books(rows: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The codebooks (parts x entries x dimensions) of the smallest keys, null as the largest, ties by vector; None without
    a usable vector. At most `entries` rows come to the driver."""
    least = rows.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).limit(entries).select(vector).collect()
    if not least:
        return None
    table = floors(np.array([r[0] for r in least], np.float64), scale)
    return np.ascontiguousarray(table.reshape(len(least), parts, -1).transpose(1, 0, 2))


def blocks(rows: DataFrame, vector: str, keep: list[str], scale: int) -> DataFrame:
    """(block, keep columns as lists): about BLOCK_ROWS vectors in a row, each as a pickled array (dimensions x vectors)."""
    schema = T.StructType([T.StructField("block", T.BinaryType()), *[T.StructField(k, T.ArrayType(rows.schema[k].dataType)) for k in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                raw = pickle.dumps(np.ascontiguousarray(floors(values, scale).T), 5)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(1 + i)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), *lists], names=schema.names)
        give_back()

    return rows.select(vector, *keep).mapInArrow(run, schema)


def trained(table: DataFrame, books: np.ndarray, rounds: int, depth: int) -> np.ndarray:
    """Codebooks after so many rounds over a table of blocks."""
    spark = table.sparkSession
    rdd = table.select("block").rdd.map(lambda r: pickle.loads(r.block))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        add = lambda tensor, block, shared=shared: (tensor or Tensor(shared.value)).add(block, shared.value)
        merge = lambda a, b: a.merge(b) if a and b else a or b
        books = rdd.treeAggregate(None, add, merge, depth).moved(books)
        shared.destroy()
    return books


def quantize(rows: DataFrame, key: str, vector: str, keep: list[str], parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, depth: int = 2) -> tuple[DataFrame, np.ndarray | None]:
    """(keep columns, code, error) for each usable vector, and the codebooks (parts x entries x dimensions of a part).

    Components become floor(scale * x). Vectors are cut into equal consecutive parts; the codebook of a part position begins
    as that part of the smallest keys and is moved `rounds` times to the floored means of the parts nearest to each entry
    (squared Euclidean distance, ties to the lower entry; unused entries stay). code has two hex digits for each part, error
    is the sum of its squared distances (null if beyond a long).

    Rows without a vector, or with null or non-finite components, go; so do vectors that cannot be cut into equal parts of
    at least one component, and those of another length than the vector of the smallest key, which no entry could stand for.
    scale is a power of two, so that products are exact.
    Repeated rows and keys count each time; null keys are the largest. With fewer vectors than entries the codebooks are
    smaller; without any there are no rows, and None. Columns of keep named like a result give way to it.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries have two hex digits")
    keep = kept(keep, ["code", "error"])
    fit = usable(rows, vector).where((F.size(vector) > 0) & (F.size(vector) % parts == 0))
    length = fit.orderBy(F.col(key).asc_nulls_last(), F.col(vector)).select(F.size(vector)).first()
    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if length is None:
        return rows.sparkSession.createDataFrame([], schema), None
    fit = fit.where(F.size(vector) == length[0])
    named = {k: f"__k{i}" for i, k in enumerate(keep)}
    table = written(blocks(fit.select(F.col(vector).alias("__v"), *[fit[k].alias(n) for k, n in named.items()]), "__v", list(named.values()), scale), "blocks")
    books = trained(table, first_books(fit, key, vector, parts, entries, scale), rounds, depth)
    width, digits = books.shape[2], np.array([f"{i:02x}" for i in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(0)):
                block = pickle.loads(raw.as_buffer())
                met = [nearest(block[p * width : (p + 1) * width], book) for p, book in enumerate(books)]
                code, error = digits[met[0][0]], sum(e for _, e in met)
                for best, _ in met[1:]:
                    code = code + digits[best]
                if error.dtype == object:
                    error = [e if e < 2**63 else None for e in error]
                columns = [batch.column(1 + j)[i].values for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=schema.names)
        give_back()

    return table.mapInArrow(run, schema), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and position, in decimal with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
