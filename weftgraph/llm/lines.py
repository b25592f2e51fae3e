"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed for first occurrences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import ascii_lower, kept, order_id, shuffle_width, sliced
from weftgraph.plans.lineage import shared_dir


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\v\f\r")))


def sorted_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows range-partitioned by keys and order and sorted so within partitions, checkpointed as it lies.

    The bounds are whole (key, order) tuples, so a key that holds a third of the rows spreads over as many partitions as
    its share asks for. checkpoint() keeps partitions and order, which the streams below need.
    """
    spark = rows.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.repartitionByRange(shuffle_width(spark), *keys, *order).sortWithinPartitions(*keys, *order).checkpoint()


def later_holders(ranged: DataFrame, keys: list[str], holder: str, out: list[str]) -> DataFrame:
    """The rows of ranged (see sorted_by_key; keys are long) whose key occurs with a smaller holder, as columns out.

    Each partition is one stream: the first row of a key names its first holder. Where a key goes on from one partition
    into the next, the first holder comes from a table with one row per partition (their number is a setting, not the
    data's size), which is all that reaches the driver.
    """
    k1, k2 = keys

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail, part = None, None, 0
        for batch in batches:
            if batch.num_rows:
                a, b, h = (batch.column(c).to_numpy() for c in (k1, k2, holder))
                part = batch.column("__part")[0].as_py()
                head = head or (int(a[0]), int(b[0]))
                key = int(a[-1]), int(b[-1])
                if not tail or tail[:2] != key:
                    tail = (*key, int(h[np.flatnonzero((a == key[0]) & (b == key[1]))[0]]))
        if head:
            yield pa.RecordBatch.from_pydict(dict(zip("part a b c d first".split(), [[x] for x in (part, *head, *tail)])))

    numbered = ranged.withColumn("__part", F.spark_partition_id())
    found = numbered.select(k1, k2, holder, "__part").mapInArrow(ends, "part long, a long, b long, c long, d long, first long").collect()
    carry: dict[int, tuple[int, int, int]] = {}
    going: tuple[int, int, int] | None = None
    for row in sorted(found, key=lambda r: r["part"]):
        if going and going[:2] == (row["a"], row["b"]):
            carry[row["part"]] = going
        if not going or going[:2] != (row["c"], row["d"]):
            going = (row["c"], row["d"], row["first"])
    schema = T.StructType([ranged.schema[c] for c in out])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                last = carry.get(batch.column("__part")[0].as_py())
            a, b, h = (batch.column(c).to_numpy() for c in (k1, k2, holder))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = last is None or last[:2] != (a[0], b[0])
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            first = h[starts]
            if not new[0]:
                first, run = np.concatenate([[last[2]], first]), run + 1
            firsts = first[run]
            last = (int(a[-1]), int(b[-1]), int(firsts[-1]))
            mask = pa.array(h > firsts)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in out], names=out)

    return numbered.mapInArrow(stream, schema)


def pack_keep_bitmap(dropped: list[int]) -> bytes:
    """zlib of a bit per line up to the last dropped one, 1 to keep; lines beyond are kept."""
    keep = np.ones(-(-(max(dropped) + 1) // 8) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def apply_keep_bitmap(lines: list[str], packed: bytes) -> list[str]:
    keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)].tolist()
    return [x for x, k in zip(lines, keep) if k] + lines[len(keep) :]


def line_dedup(df: DataFrame, doc: str, text: str, least_chars: int = 10) -> DataFrame:
    """doc_key, text_key, n_dropped and keep_bitmap for each document that loses a line.

    A line's key is line_key; keys of at least least_chars code points that occur in two or more documents lose all
    their lines except in the smallest doc. Null or empty text is one empty line, which is never dropped. Rows with the
    same id count as one document, and text_key (a hash) tells their texts apart; exact repetitions of a row share one
    entry. doc_key is the id, null as the largest. An empty table gives no rows; extra columns are ignored. Keys are
    compared by two 64-bit hashes.
    """
    split = df.select(order_id(doc).alias("doc_key"), F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("__lines"))
    rows = split.select("doc_key", "text_key", F.posexplode("__lines").alias("__pos", "__line")).withColumn("__key", line_key(F.col("__line")))
    rows = rows.where(F.length("__key") >= least_chars).select(
        F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"), "doc_key", "text_key", "__pos"
    )
    ranged = sorted_by_key(rows, ["__h1", "__h2"], ["doc_key", "__pos"])
    dropped = later_holders(ranged, ["__h1", "__h2"], "doc_key", ["doc_key", "text_key", "__pos"])
    lost = dropped.groupBy("doc_key", "text_key").agg(F.collect_set("__pos").alias("__lost"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__lost").to_pylist()
            cols = [batch.column(0), batch.column(1), pa.array(map(len, lists), pa.int64()), pa.array(map(pack_keep_bitmap, lists), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_key", "text_key", "n_dropped", "keep_bitmap"])

    return lost.mapInArrow(pack, "doc_key long, text_key long, n_dropped long, keep_bitmap binary")


def drop_lines(df: DataFrame, doc: str, text: str, keep: list[str], least_chars: int = 10) -> DataFrame:
    """keep columns and text of every row of df, with n_lines and n_dropped; text is the kept lines joined by \\n.

    A null text stays null. A column of keep named n_lines or n_dropped gives way. Texts meet only the bitmaps, never other documents' lines.
    """
    others = kept(keep, [text, "n_lines", "n_dropped"])
    ids = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(others)], F.col(text).alias("__whole"), order_id(doc).alias("__d"), F.xxhash64(text).alias("__t"))
    drops = line_dedup(df, doc, text, least_chars)
    joined = ids.join(drops, (F.col("__d") == F.col("doc_key")) & (F.col("__t") == F.col("text_key")), "left")
    schema = T.StructType(
        [
            *[df.schema[c] for c in others],
            T.StructField(text, T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, len(others)):
            texts, n_lines = [], []
            for value, bitmap in zip(batch.column("__whole").to_pylist(), batch.column("keep_bitmap").to_pylist()):
                n_lines.append(1 + (value or "").count("\n"))
                texts.append("\n".join(apply_keep_bitmap(value.split("\n"), bitmap)) if bitmap else value)
            cols = [batch.column(i) for i in range(len(others))]
            cols += [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), batch.column("n_dropped").fill_null(0)]
            yield pa.RecordBatch.from_arrays(cols, names=[*others, text, "n_lines", "n_dropped"])

    inputs = [f"k{i}" for i in range(len(others))]
    return joined.select(*inputs, "__whole", "n_dropped", "keep_bitmap").mapInArrow(apply, schema)
