"""Exact vector search: stated queries against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: About so many queries and rows meet in one block, whose scores are made for so many queries at a time.
MOST_QUERIES, MOST_ROWS, AT_ONCE = 1024, 4096, 16

#: Blocks share tasks where there are more of them.
MOST_TASKS = 10_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance), so that more is nearer."""
    squared = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + squared)


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int, similarity: str = "cosine") -> DataFrame:
    """(key, score) of the k rows nearest to one vector; ties go to the smaller key."""
    score = {"cosine": cosine, "euclidean": euclidean}[similarity](F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return rows.select(key, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), key).limit(k)


def _matrices(table: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """For each length of the vectors (id, vector) of a block that hold no null: their ids, ascending, and the vectors."""
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    table = table.take(pa.compute.sort_indices(table, sort_keys=[(table.column_names[0], "ascending")], null_placement="at_start"))
    ids, vectors = (table.column(i).combine_chunks() for i in (0, 1))
    sizes, out = vectors.value_lengths(), {}
    for width in pa.compute.unique(sizes.drop_null()).to_pylist():
        own = pa.compute.equal(sizes, width)
        values, kept = vectors.filter(own).flatten().to_numpy(zero_copy_only=False), ids.filter(own)
        out[width] = (kept, values.astype(np.float64).reshape(len(kept), width))
    return out


def _sums(a: np.ndarray, b: np.ndarray, squared: bool) -> np.ndarray:
    """Sums over dimensions, for each row of a and column of b (dimensions first), added one dimension after the other: equal
    vectors get equal sums wherever they lie, as cosine() and euclidean() add them."""
    out, part = np.zeros((a.shape[0], b.shape[1])), np.empty((a.shape[0], b.shape[1]))
    for d in range(a.shape[1]):
        if squared:
            np.subtract(a[:, d, None], b[d], out=part)
            np.multiply(part, part, out=part)
        else:
            np.multiply(a[:, d, None], b[d], out=part)
        out += part
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _best(asked: np.ndarray, rows: np.ndarray, k: int, similarity: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) by place: the k best rows of each query, of those that tie the first ones. NaN is the highest score."""
    columns, found = np.ascontiguousarray(rows.T), []
    norms = (_norms(asked), _norms(rows)) if similarity == "cosine" else None
    with np.errstate(all="ignore"):
        for at in range(0, len(asked), AT_ONCE):
            scores = _sums(asked[at : at + AT_ONCE], columns, similarity != "cosine")
            if norms:
                product = norms[1] * norms[0][at : at + AT_ONCE, None]
                none, scores = product == 0, scores / product
            else:
                none, scores = np.zeros(scores.shape, bool), 1 / (1 + scores)
            low = np.nan_to_num(-scores, nan=-np.inf, posinf=np.finfo(float).max, neginf=np.finfo(float).min)
            low[none] = np.inf
            if low.shape[1] > k:
                last = np.partition(low, k - 1, axis=1)[:, k - 1, None]
                better, ties = low < last, low == last
                kept = better | (ties & (ties.cumsum(axis=1) <= k - better.sum(axis=1, keepdims=True)))
            else:
                kept = np.ones(low.shape, bool)
            q, r = np.nonzero(kept & ~none)
            found.append((q + at, r, scores[q, r]))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k_join(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, similarity: str = "cosine") -> DataFrame:
    """(query, key, score, rank) of the k nearest rows to each query; queries has (query, vector).

    Exact, so the work is their product. Both sides are counted and dealt to blocks by the hash of their rows; each block of
    about MOST_QUERIES queries meets each block of about MOST_ROWS rows in a group of its own, whose k best of each query are
    ranked in the end, so a task's memory follows the blocks. Ties go to the smaller key. Null and zero vectors, those that
    hold a null, and rows of another length than a query's have no score.
    """
    if k < 1 or similarity not in ("cosine", "euclidean"):
        raise ValueError("k >= 1, and cosine or euclidean, are needed")
    across, down = (max(1, -(-df.count() // size)) for df, size in ((queries, MOST_QUERIES), (rows, MOST_ROWS)))
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.where(whole("vector")).select(F.col("query").alias("id"), "vector", F.pmod(F.xxhash64("query", "vector"), F.lit(across)).cast("int").alias("q"), every(down).alias("r"))
    held = rows.where(whole(vector)).select(F.col(key).alias("id"), F.col(vector).alias("vector"), every(across).alias("q"), F.pmod(F.xxhash64(key, vector), F.lit(down)).cast("int").alias("r"))
    schema = T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField(key, rows.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        own, other = (_matrices(x.select(["id", "vector"])) for x in (asked, held))
        parts = [pa.table([pa.array([], x.schema.field("id").type) for x in (asked, held)] + [pa.array([], pa.float64())], names=schema.names)]
        for width in own.keys() & other.keys():
            q, r, scores = _best(own[width][1], other[width][1], k, similarity)
            parts.append(pa.table([own[width][0].take(pa.array(q)), other[width][0].take(pa.array(r)), pa.array(scores)], names=schema.names))
        return pa.concat_tables(parts)

    # A group's work is large and its rows are few: as many partitions as groups, which adaptive execution does not join.
    dealt = [df.repartition(min(across * down, MOST_TASKS), "q", "r").groupBy("q", "r") for df in (asked, held)]
    met = dealt[0].cogroup(dealt[1]).applyInArrow(run, schema)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col(key)))
    return met.withColumn("rank", best).where(F.col("rank") <= k).select("query", key, "score", "rank")
