"""Running sums and maxima that do not put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Order values per chunk: a chunk's rows of one key meet in one task.
CHUNK = 1 << 18


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with name: the sum of value over earlier rows of its key, without its own.

    order is a non-negative integer, unique in a key. Rows are summed inside chunks of it; chunk totals, which are
    pre-aggregated and few, are summed before them. A hot key's rows thus spread over as many tasks as it has chunks.
    """
    d = df.withColumn("_v", value.cast("long")).withColumn("_c", F.floor(F.col(order) / chunk))
    totals = d.groupBy(*keys, "_c").agg(F.sum("_v").alias("_t"))
    earlier = F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = totals.select(*keys, "_c", earlier.alias("_before"))
    inside = F.coalesce(F.sum("_v").over(W.partitionBy(*keys, "_c").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_in", inside).join(before, [*keys, "_c"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_v", "_c", "_in", "_before")


def floor_join(probes: DataFrame, index: DataFrame, keys: list[str], at: str, place: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """probes with name: the greatest value of the rows of index, of the same keys, whose place is not above the probe's
    at; null if there is none. No pairs are made: both are laid out along the place in chunks of it, and a probe takes the
    maximum so far. Chunk maxima are pre-aggregated; a hot key spreads over as many tasks as it has chunks."""
    kind = index.select(value.alias("v")).schema["v"].dataType
    cols = [c for c in probes.columns if c not in keys]
    rows = index.select(*keys, F.col(place).cast("long").alias("_at"), value.alias("_v"), F.lit(None).cast(probes.select(*cols).schema).alias("_p"), F.lit(0).alias("_k"))
    rows = rows.unionByName(probes.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(None).cast(kind).alias("_v"), F.struct(*cols).alias("_p"), F.lit(1).alias("_k")))
    rows = rows.withColumn("_c", F.floor(F.col("_at") / chunk))
    tops = rows.groupBy(*keys, "_c").agg(F.max("_v").alias("_top"))
    before = tops.select(*keys, "_c", F.max("_top").over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = rows.withColumn("_in", F.max("_v").over(W.partitionBy(*keys, "_c").orderBy("_at", "_k").rowsBetween(W.unboundedPreceding, 0))).where("_k = 1")
    return inside.join(before, [*keys, "_c"]).select(*keys, "_p.*", F.greatest("_in", "_before").alias(name) if kind.typeName() != "struct" else F.array_max(F.array("_in", "_before")).alias(name))
