"""Helpers that several text operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.lineage import materialized

#: Bytes between words: space and \t \n \v \f \r, exactly what bytes.split() splits at.
BLANK = r"[\x20\x09-\x0D]"

_A_BLANK = re.compile(r"\s")

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    return materialized(df, name)


def order_id(column: str | Column) -> Column:
    """doc_id for comparisons, null as the largest value."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(2**63 - 1)).cast("long")


def told_apart(df: DataFrame, doc: str, text: str) -> tuple[DataFrame, str, DataFrame | None]:
    """df, a long column that tells its rows apart by id and text, and the (id, text_key, row_no) behind it.

    Where every id has one text, that is df, doc and None. Otherwise (null ids above all) rows are numbered in the order
    of id, null as the largest, and hash of the text, and df comes with row_no. Exact repetitions of a row share a number.
    """
    rows = df.select(order_id(doc).alias("id"), F.xxhash64(text).alias("text_key"))
    if rows.groupBy("id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low != high").isEmpty():
        return df, doc, None
    ranged = rows.distinct().repartitionByRange("id", "text_key").sortWithinPartitions("id", "text_key")
    placed = written(ranged.select("id", "text_key", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "placed")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, placed.groupBy("part").count().collect())):
        offsets += [F.lit(part), F.lit(before - (part << 33))]
        before += n
    numbers = written(placed.select("id", "text_key", (F.col("at") + F.try_element_at(F.create_map(*offsets), "part")).alias("row_no")), "numbers")
    met = (order_id(df[doc]) == numbers["id"]) & (F.xxhash64(df[text]) == numbers["text_key"])
    return written(df.join(numbers, met).select(*[df[c] for c in df.columns], "row_no"), "told_apart"), "row_no", numbers


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB rather than 10000 texts of any length, unless the session says otherwise."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(keep: list[str], made: list[str]) -> list[str]:
    """The columns of keep that no column of made replaces: one with a made column's name gives way, as with withColumn."""
    names = {m.lower() for m in made}
    return [k for k in keep if k.lower() not in names]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc: str) -> Column:
    """True for documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text or list column holds about most_bytes, so that a task's memory does not follow the
    lengths of its rows (a single longer row stays whole). At the end of a task freed memory goes back."""
    for batch in batches:
        sizes = np.full(batch.num_rows, 8) if not batch.num_rows else _sizes(batch.column(column))
        part = np.cumsum(sizes) // most_bytes
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if batch.num_rows else []
        for i, j in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(i, j - i)
    batch = None
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Following batches joined while a text or list column holds less than about most_bytes, for work whose cost is mostly
    one for each batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += int(_sizes(batch.column(column)).sum()) if batch.num_rows else 0
        if size >= most_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def stretches(text: str, most: int) -> Iterator[str]:
    """The text in parts of about so many characters, cut before blanks, so that what is made of a very long text at once
    stays small. A longer word stays whole."""
    at = 0
    while len(text) - at > most:
        cut = _A_BLANK.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, and shares its executor with the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _sizes(values: pa.Array) -> np.ndarray:
    if pa.types.is_list(values.type):
        return np.diff(values.offsets.to_numpy()) * 8
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy().astype(np.int64)
