"""Parquet sources and the current-row view of re-delivered lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import cut


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One parquet table of the folder ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key; rows with a null in ``order`` come last.

    An aggregate with map-side combine, so a key delivered very often is reduced before the
    shuffle; rows are sorted by key on both sides of it, as strings can't be hash aggregated. Equal ``order`` values are decided by the remaining columns, so the result is stable.
    Pass only the columns that are needed: every column is shuffled.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_b")
    out = df.groupBy(*keys).agg(best)
    picks = {order: F.col("_b._o"), **{c: F.col(f"_b.{c}") for c in rest}}
    return out.select(*[F.col(c) if c in keys else picks[c].alias(c) for c in df.columns])


#: Repeated keys that travel to every task whole; with more, all rows are shuffled.
REPEATED = 500_000


def latest_wide(df: DataFrame, key: str, order: str) -> DataFrame:
    """As :func:`latest` by one key, for wide rows of which few are repeated: only those are shuffled.

    The repeated keys are found from the key column alone, and their latest rows are kept. All others are
    read where they lie, by each use again, so ``df`` should be a scan.
    """
    repeated = cut(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col(key).isNull() | (F.col("_n") > 1)).select(F.col(key).alias("_key")))
    if repeated.count() > REPEATED or repeated.filter("_key is null").count():
        return latest(df, [key], order)
    of = lambda how: df.join(F.broadcast(repeated), F.col(key) == F.col("_key"), how)
    return of("left_anti").unionByName(cut(latest(of("left_semi"), [key], order)))


def current_lessons(spark: SparkSession, base: str, *columns: str, wide: bool = False) -> DataFrame:
    """Current rows of ``agent_lesson``: of each id the row with the latest ``updated_at``.

    ``columns`` prunes the scan; ``id`` and ``updated_at`` are always there. ``wide`` rows stay where they lie unless their id is repeated.
    """
    df = table(spark, base, "agent_lesson")
    keep = ["id", "updated_at", *[c for c in columns if c not in ("id", "updated_at")]]
    return latest_wide(df.select(*keep), "id", "updated_at") if wide else latest(df.select(*keep), ["id"], "updated_at")
