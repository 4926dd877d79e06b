"""One ranking from several differently scaled scores: weighted Borda count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.skew import lookup_join, running_sum
from lorekeep.session import cut


def borda(candidates: DataFrame, group: str, item: str, scores: dict[str, float], missing: str = "mid") -> DataFrame:
    """``(group, item, points, position)``: one ranking per group, in which each score counts by rank alone.

    ``candidates`` has one row per (group, item); ``scores`` names its score columns and their weights,
    higher scores are better. Per score, competition ranks with averaged ties become points (items
    minus rank); the weighted points are summed, and the sum is ranked, ties going to the smaller
    item. A score is missing when it is null or NaN: with ``missing="mid"`` it gets the points of the
    middle rank of the group, with ``"lowest"`` all missing ones share the last ranks. If all scores of
    a group are missing, all its items tie. Rows with a null group or item are dropped. Other
    columns are ignored, whatever their names.

    No group is sorted in one task: equal scores are counted first, and distinct values are ranked
    over range partitions, so that a group with a third of all rows spreads over the cluster.
    """
    if missing not in ("mid", "lowest"):
        raise ValueError("missing must be 'mid' or 'lowest'")
    base = candidates.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(scores)])
    base = base.filter(F.col("g").isNotNull() & F.col("i").isNotNull())
    weights = [float(w) for w in scores.values()]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.nanvl(f"s{k}", F.lit(None)).alias("s"), F.lit(w).alias("w")) for k, w in enumerate(weights)]))
    long = cut(base.select("g", "i", cells.alias("c")).select("g", "i", "c.k", "c.w", "c.s"))
    total = max(1, long.count())
    groups = long.groupBy("g", "k").agg(F.count("*").alias("n"), F.count("s").alias("has"))
    counts = long.filter("s is not null").groupBy("g", "k", "s").agg(F.count("*").alias("c"))
    ranked = running_sum(counts, ["g", "k"], "s", "c", "before").withColumn("rank", F.col("before") + (F.col("c") + 1) / 2)
    placed = lookup_join(long.filter("s is not null"), ranked.select("g", "k", "s", "rank", "c"), ["g", "k", "s"], "c", total)
    scored = placed.select("g", "i", "k", "w", "rank").unionByName(long.filter("s is null").select("g", "i", "k", "w", F.lit(None).cast("double").alias("rank")))
    last = (F.col("n") + 1) / 2 if missing == "mid" else (F.col("has") + 1 + F.col("n")) / 2
    points = lookup_join(scored, groups, ["g", "k"], "n", total).withColumn("points", F.col("w") * (F.col("n") - F.coalesce("rank", last)))
    sums = points.groupBy("g", "i").agg(F.sum("points").alias("points"))
    # The final order is unique: points first, then the item.
    final = running_sum(sums.withColumn("one", F.lit(1)).withColumn("o", F.struct(F.col("points"), (-F.col("i").cast("decimal(20,0)")).alias("t"))), ["g"], "o", "one", "before")
    return final.select(F.col("g").alias(group), F.col("i").alias(item), "points", (F.col("before") + 1).alias("position"))
