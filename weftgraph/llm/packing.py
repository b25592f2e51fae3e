"""Online best-fit packing of token sequences with a fixed number of open bins.

Pieces come in the order of their documents and are placed once, for good. A task keeps OPEN_BINS bins open; where a piece
needs a new one beyond that, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import encoder, text_blocks

#: Bins that a task keeps open. More do not fill sequences better: 98.7 to 99.1 % of the places with 64 as with 8192.
OPEN_BINS = 128


class BestFit:
    """Open bins by free space: bit f of the bitset is set while a bin with f free places is open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits = self.open = self.made = self.closed = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece: the open bin that it fills best, else a new one; the fullest closes for it."""
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, own = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        return own, self.capacity - free


def token_pieces(df: DataFrame, doc: str, text: str, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc, piece, start, length and ids_crc32 of each document's pieces: its ids and end_id, cut from the end.

    A document of at most capacity ids is one piece; a longer one has a shorter first piece and full ones. Null texts are
    empty and give the piece [end_id]. Rows stand alone, rows with the same id are cut each; other columns are ignored.
    """
    schema = T.StructType(
        [
            T.StructField(doc, df.schema[doc].dataType),
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")],
        ]
    )
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in text_blocks(batches, 1):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                stop = total % capacity or min(total, capacity)
                for piece, at in enumerate([0, *range(stop, total, capacity)]):
                    to = stop if piece == 0 else at + capacity
                    rows.append((i, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
            columns = [list(c) for c in zip(*rows)] or [[]] * 5
            docs = batch.column(0).take(pa.array(columns[0], pa.int32()))
            longs = [pa.array(c, pa.int64()) for c in columns[2:]]
            yield pa.RecordBatch.from_arrays([docs, pa.array(columns[1], pa.int32()), *longs], names=schema.names)

    return df.select(F.col(doc), F.col(text).alias("__text")).mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = OPEN_BINS) -> DataFrame:
    """pieces (doc first, then piece and length) with sequence_id and offset, by online best fit in each task.

    Pieces are dealt by hash to the session's shuffle partitions, which adaptive execution joins where they are small, so
    that a small table is packed in one task. Each task places its share in the order of (doc, piece), rows that repeat an
    id by their other columns; only the bins that close early and the last ones of each task stay part empty (see fill).
    Offsets are gapless from 0 in each sequence. A lost task repeats its numbers. An empty table gives no rows.
    """
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns
    doc = names[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column("__task")[0].as_py() << 40
            put = [bins.place(n) for n in batch.column("length").to_pylist()]
            cols = [batch.column(c) for c in names]
            cols += [pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    spread = pieces.repartition(F.xxhash64(doc, "piece")).sortWithinPartitions(doc, "piece", *[c for c in names if c not in (doc, "piece")])
    return spread.withColumn("__task", F.spark_partition_id().cast("long")).mapInArrow(place, schema)


def pack_documents(df: DataFrame, doc: str, text: str, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """All documents of df cut into pieces and packed into sequences of at most capacity ids; see token_pieces and pack."""
    return pack(token_pieces(df, doc, text, tokenizer, capacity), capacity)


def fill(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: pieces, tokens, sequences and fill, the share of the sequences' places that hold a token (null: none)."""
    counts = packed.agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("tokens"), F.count_distinct("sequence_id").alias("sequences"))
    return counts.withColumn("fill", F.try_divide("tokens", F.col("sequences") * capacity))
