"""Rendezvous sharding over weighted shards, in DataFrame operations only.

Each record draws one hash per shard from (key, shard); the shard with the smallest exponential deviate -ln(u)/weight
wins. A record's draws for the old shards do not change when a shard is added, so only the records that the new shard
wins move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the digest that make a draw: 52 bits, which a double holds exactly.
_DRAW_DIGITS = 13
_DRAW_RANGE = float(2 ** (4 * _DRAW_DIGITS))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights)-1) of a string key; a null key counts as the empty string, ties go to the lower shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive, one per shard")
    key = F.coalesce(key.cast("string"), F.lit(""))

    def draw(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f"#{shard}")).cast("binary")), 1, _DRAW_DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_DRAW_RANGE)
        return F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*[draw(i, w) for i, w in enumerate(weights)]))["shard"]


def shard_records(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    grown_weight: float | None = None,
    order_by: Sequence[str] = (),
    buckets: int = 1024,
) -> DataFrame:
    """df's columns plus shard, slot (gapless from 0 in its shard) and grown_shard (with one more shard; null without).

    Slots need no task that sees a whole shard: rows are numbered in (shard, bucket) groups, and the groups' starts are
    prefix sums over at most len(weights) * buckets counts, a bound that makes the broadcast safe at any input size.
    Rows with the same key share a shard and get slots next to each other, ordered by order_by. Null keys form one key.
    An empty table gives no rows. Columns named shard, slot or grown_shard give way to the results (a key of such a name is
    read first); others pass, whatever their names.
    """
    out = [c for c in df.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    own = "__"  # before the names of helper columns, so that no column of df has one
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    n_bucket, n_row, n_rows, n_start, n_shard, n_of, n_key, n_text = (own + x for x in ("bucket", "row", "n", "start", "shard", "b", "key", "text"))
    ties = [f"{own}o{i}" for i in range(len(order_by))]
    text_key = F.coalesce(df[key].cast("string"), F.lit(""))
    read = df.select(*[df[c] for c in out], df[key].alias(n_key), text_key.alias(n_text), *[df[c].alias(t) for c, t in zip(order_by, ties)])
    grown = rendezvous_shard(F.col(n_text), [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    bucket = F.pmod(F.xxhash64(n_text), F.lit(buckets)).cast("int")
    placed = read.withColumns({"shard": rendezvous_shard(F.col(n_text), weights), n_bucket: bucket})
    counts = placed.groupBy("shard", n_bucket).agg(F.count(F.lit(1)).alias(n_rows))
    before = Window.partitionBy("shard").orderBy(n_bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("shard").alias(n_shard), F.col(n_bucket).alias(n_of), F.coalesce(F.sum(n_rows).over(before), F.lit(0)).alias(n_start)
    )
    in_bucket = Window.partitionBy("shard", n_bucket).orderBy(n_key, *ties)
    numbered = placed.withColumn(n_row, F.row_number().over(in_bucket) - 1)
    joined = numbered.join(F.broadcast(starts), (F.col("shard") == F.col(n_shard)) & (F.col(n_bucket) == F.col(n_of)))
    return joined.select(
        *[df[c] for c in out], F.col("shard"), (F.col(n_start) + F.col(n_row)).cast("long").alias("slot"), grown.alias("grown_shard")
    )
