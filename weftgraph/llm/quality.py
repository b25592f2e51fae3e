"""Rule-based quality: per-document repetition counts, and lines that recur across a host's documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import BLANK, sliced, written

SYMBOLS = "#*$%&|<>"

#: Distinct documents of a host that may hold a line.
MOST_DOCS = 10

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                first = seen.setdefault(w, i)
                if first != i:
                    covered[i : i + 3] = covered[first : first + 3] = b"\1\1\1"
            repeat = sum(covered)
    return n, len(text) - blanks, symbols, dup, repeat


def normalised_line(line: Column) -> Column:
    """Lower case, digits as 0, runs of blanks as one space, no blanks at the ends."""
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANK + "+", " ")
    return F.trim(squeezed)


def line_frequency(lines: DataFrame, most_docs: int) -> DataFrame:
    """(__line, n_docs) of each line of a host that is in more than most_docs distinct documents of it.

    lines is the table of _lines(). A line counts once for a document, however often it stands there; the counts are
    aggregated inside tasks first, so a line or host of a third of all rows is no hot spot.
    """
    once = lines.groupBy("__line", "__doc", "__text").agg(F.lit(1).alias("__one"))
    return once.groupBy("__line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > most_docs)


def _host(host: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit("\0null")))


def _lines(df: DataFrame, doc: str, text: str, host: str) -> DataFrame:
    """One row per line that has a word: doc id, hashes of text and host, the line's number, hash with its host and words."""
    split = df.select(F.col(doc).alias("__doc"), F.xxhash64(text).alias("__text"), _host(host).alias("__host"), F.posexplode(F.split(text, "\n")).alias("__at", "__raw"))
    norm = split.withColumn("__norm", normalised_line(F.col("__raw"))).where("__norm != ''")
    words = F.length("__norm") - F.length(F.replace("__norm", F.lit(" "), F.lit(""))) + 1
    return norm.select("__doc", "__text", "__at", F.xxhash64("__host", "__norm").alias("__line"), words.cast("long").alias("__words"))


def text_left(text: Column, removed_lines: Column) -> Column:
    """A text without its removed_lines (see quality_rules); null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed_lines, i)), "\n")


def quality_rules(
    df: DataFrame,
    doc: str,
    text: str,
    host: str,
    most_docs: int = MOST_DOCS,
    most_removed: float = 0.7,
    least_words: int = 50,
    most_repeat_pct: int = 50,
) -> DataFrame:
    """doc, the counts of text_counts, base_failed, removed_share, kept and removed_lines, one row for each row of df.

    A line (normalised, hashed with its host to 64 bits) in more than most_docs distinct documents of a host is removed:
    its number, from 0, is in removed_lines (text_left gives the text without them). The limit is a number of documents,
    the same at every size of host. A document that loses more than most_removed of its words, or is left with fewer than
    least_words, is depleted and rejected. base_failed (fewer than least_words words, or more than most_repeat_pct per
    cent of the words in repeated 3-word windows) rejects as well. Copies of a document count like any other documents.

    Null texts are empty (no words: base_failed). A null host is a host of its own. Rows with the same id are judged by
    their own text; exact repetitions of a row are one document and get the same verdict. Extra columns are ignored. An
    empty table gives no rows. Lines are hashed once and written to the shared folder; texts of any length are cut there
    into rows, and the counts hold one text at a time.
    """
    kinds = [T.StructField(c, T.LongType()) for c in _COUNTS]
    schema = T.StructType([T.StructField(doc, df.schema[doc].dataType), T.StructField("__text", T.LongType()), *kinds])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            rows = [text_counts(x) for x in batch.column(2).to_pylist()]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=[doc, "__text", *_COUNTS])

    base = df.select(F.col(doc), F.xxhash64(text).alias("__text"), F.col(text).alias("__whole")).mapInArrow(count, schema)
    lines = written(_lines(df, doc, text, host), "lines")
    over = line_frequency(lines, most_docs).select("__line")
    # A set, since repeated rows repeat their lines.
    gone = lines.join(over, "__line").groupBy("__doc", "__text").agg(F.array_sort(F.collect_set(F.struct("__at", "__words"))).alias("__gone"))
    joined = base.join(gone.withColumnRenamed("__text", "__t"), base[doc].eqNullSafe(F.col("__doc")) & (base["__text"] == F.col("__t")), "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_pct * F.col("n_words"))
    lost = F.aggregate(F.coalesce(F.col("__gone.__words"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, x: n + x)
    share = F.coalesce(F.try_divide(lost, "n_words"), F.lit(0.0))
    kept = ~failed & (share <= most_removed) & (F.col("n_words") - lost >= least_words)
    numbers = F.coalesce(F.col("__gone.__at"), F.array().cast("array<int>"))
    return joined.select(F.col(doc), *_COUNTS, failed.alias("base_failed"), share.alias("removed_share"), kept.alias("kept"), numbers.alias("removed_lines"))
