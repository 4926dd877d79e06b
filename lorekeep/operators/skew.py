"""Joins and ranks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import cut

#: A key is hot when it holds more than one in so many of all rows; so there are at most as many hot keys.
HOT_SHARE = 64


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``table`` that has one row per key.

    ``weight`` is the column of ``table`` that says how many rows the key has, ``total`` the sum of
    all weights. Keys above ``total / HOT_SHARE`` (at most ``HOT_SHARE`` of them, by counting) are
    joined by broadcast, the others by shuffle, so no task gets a hot key whole.
    """
    limit = max(1, total // HOT_SHARE)
    value = [c for c in table.columns if c not in keys]
    hot = table.filter(F.col(weight) > limit).select(*keys, F.struct(*value).alias("_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(table.filter(F.col(weight) <= limit), keys, how)
    warm = marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in value])
    return cold.select(*rows.columns, *value).unionByName(warm)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, descending: bool = True) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the key that come strictly before, by ``order`` (descending by default).

    ``(keys, order)`` must be unique. The rows are range partitioned by key and order, so a hot key
    spreads over many tasks; offsets between the parts are summed over (key, part) totals, of which
    a key has at most as many as there are parts. The cut keeps the range bounds the same for both uses.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *keys, by).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_part").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "_part"]).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")
