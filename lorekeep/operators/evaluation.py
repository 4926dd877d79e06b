"""Retrieval quality and significance statistics over DataFrames."""

from __future__ import annotations

from math import erf, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lorekeep.operators.skew import running_sum

Z = 1.959963984540054


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """``(query_id, rank, n_relevant)`` of relevant items found; queries without any hit have a null rank."""
    n = relevant.groupBy("query_id").agg(F.countDistinct("id").alias("n_relevant"))
    found = ranked.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).select("query_id", "rank")
    return n.join(found, "query_id", "left")


def per_query(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``(query_id, hit_k, recall_k, rr)``: whether any answer is in the top k, the share found, and the reciprocal rank."""
    cols: list[Column] = [F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr")]
    for k in ks:
        inside = (F.coalesce("rank", F.lit(1 << 30)) <= k).cast("int")
        cols += [F.max(inside).alias(f"hit_{k}"), (F.sum(inside) / F.first("n_relevant")).alias(f"recall_{k}")]
    return hits(ranked, relevant).groupBy("query_id").agg(*cols)


def overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """``(query_id, overlap)``: share of the top k that two rankings of a query have in common."""
    both = a.filter(F.col("rank") <= k).select("query_id", "id").join(b.filter(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"])
    found = both.groupBy("query_id").agg(F.count("*").alias("n"))
    return a.select("query_id").distinct().join(found, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def overlap_summary(overlaps: DataFrame) -> DataFrame:
    """``(queries, mean, median, p10)`` of the overlaps of :func:`overlap`, one row."""
    from lorekeep.operators.lifecycle import quantiles

    spread = quantiles(overlaps, "overlap", {"median": 0.5, "p10": 0.1})
    return overlaps.agg(F.count("*").alias("queries"), F.avg("overlap").alias("mean")).crossJoin(spread)  # one row each


def mean_ci(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """``(by, n, mean, low, high)``: the mean with 1.96 standard errors (sample variance)."""
    c = F.col(column).cast("double")
    agg = values.groupBy(*(by or [])).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.var_samp(c), F.lit(0.0)).alias("_v"))
    half = 1.96 * F.sqrt(F.col("_v") / F.col("n"))
    return agg.select(*(by or []), "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """The Wilson score interval of a proportion at 95 %."""
    p, z2 = successes / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return mid - half, mid + half


def cohen_h(p1: Column, p2: Column) -> Column:
    """Cohen's effect size of two proportions."""
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """The z statistic of two proportions, pooled; null where the pooled variance is 0."""
    pooled = (x1 + x2) / (n1 + n2)
    return F.try_divide(x1 / n1 - x2 / n2, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p value of a z statistic, in Arrow batches (no error function is built in)."""
    # Few statistics reach this, one for each test, so the function is applied as it is.
    return pd.Series([None if v is None or v != v else 1 - erf(abs(v) / sqrt(2)) for v in z], dtype="float64")


def holm(tests: DataFrame, family: str, key: str, p: str) -> DataFrame:
    """Adds ``p_holm``: p values of each family adjusted by Holm's step-down procedure."""
    order = Window.partitionBy(family).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(family))
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1))
    return tests.withColumn("_s", scaled).withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(only_a, only_b, statistic)`` of paired yes/no outcomes, with continuity correction."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    counts = pairs.agg(F.sum((x & ~y).cast("int")).alias("only_a"), F.sum((~x & y).cast("int")).alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return counts.withColumn("statistic", F.coalesce(F.try_divide(F.greatest(d, F.lit(0)) * F.greatest(d, F.lit(0)), F.col("only_a") + F.col("only_b")), F.lit(0.0)))


def welch(values: DataFrame, arm: str, column: str, left: str, right: str) -> DataFrame:
    """``(t, df)``: Welch's t and its degrees of freedom of two arms."""
    c = F.col(column).cast("double")

    def of(name: str) -> list[Column]:
        own = F.when(F.col(arm) == name, c)
        return [F.avg(own).alias(f"m_{name}"), F.var_samp(own).alias(f"v_{name}"), F.count(own).alias(f"n_{name}")]

    s = values.agg(*of(left), *of(right))
    a, b = (F.col(f"v_{n}") / F.col(f"n_{n}") for n in (left, right))
    t = F.try_divide(F.col(f"m_{left}") - F.col(f"m_{right}"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col(f"n_{left}") - 1) + b * b / (F.col(f"n_{right}") - 1))
    return s.select(t.alias("t"), df.alias("df"))


def bonferroni(p: Column, tests: Column | int) -> Column:
    """A p value adjusted for so many tests."""
    return F.least(F.lit(1.0), p * (tests if isinstance(tests, Column) else F.lit(tests)))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(n, mean, t)`` of the differences ``a - b``; ``t`` is null where they don't vary. Pairs with a null don't count."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    s = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("_s"))
    return s.select("n", "mean", F.try_divide("mean", F.col("_s") / F.sqrt("n")).alias("t"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``(statistic, df)`` of the independence of two columns of few values, from one pass of counts."""
    counts = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    x, y = counts.groupBy("a").agg(F.sum("o").alias("na")), counts.groupBy("b").agg(F.sum("o").alias("nb"))
    cells = x.crossJoin(y).join(counts, ["a", "b"], "left").crossJoin(counts.agg(F.sum("o").alias("n")))  # one row for each pair of values
    e = F.col("na") * F.col("nb") / F.col("n")
    d = F.coalesce("o", F.lit(0)) - e
    return cells.agg(F.sum(d * d / e).alias("statistic"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"))


def cliffs_delta(values: DataFrame, arm: str, column: str, left: str, right: str) -> DataFrame:
    """``(delta)``: how much more often values of the left arm exceed the right's than the reverse, by average ranks of equal values."""
    c = F.col(column).cast("double")
    counts = values.filter(F.col(arm).isin(left, right) & c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"), F.sum((F.col(arm) == left).cast("long")).alias("n1"))
    ranked = running_sum(counts.withColumn("_all", F.lit(0)), ["_all"], "v", "n", "before", descending=False)
    s = ranked.agg(F.sum(F.col("n1") * (F.col("before") + (F.col("n") + 1) / 2)).alias("r1"), F.sum("n1").alias("n1"), F.sum(F.col("n") - F.col("n1")).alias("n2"))
    return s.select((2 * F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n2")) - 1).alias("delta"))


def percentile_rank(values: DataFrame, column: str, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of a column."""
    return values.agg(*[F.expr(f"percentile_disc({q}) within group (order by {column})").alias(f"p{round(100 * q)}") for q in qs])


def bootstrap_mean(values: DataFrame, column: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """``(low, high)``: the 95 % bootstrap interval of a mean, by Poisson resampling in one pass without collecting rows."""
    weights = F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    u = F.pmod(F.xxhash64(F.lit(seed), "r", "_id"), F.lit(1 << 30)) / float(1 << 30)
    # Poisson(1) by inversion of its distribution function.
    w = sum(((u > c).cast("int") for c in (0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    rows = values.select(F.col(column).cast("double").alias("x"), F.monotonically_increasing_id().alias("_id")).withColumn("r", weights).withColumn("w", w)
    means = rows.groupBy("r").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def arm(key: Column, arms: int = 3) -> Column:
    """The arm of a run, dealt by a hash of its key: A, B, C ..."""
    return F.chr(F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(arms)) + 65)


def graph_probes(edges: DataFrame, lessons: DataFrame, most: float = 0.7) -> DataFrame:
    """``(source_id, target_id, similarity)``: linked lessons whose vectors alone wouldn't find each other."""
    from lorekeep.operators.vectors import cosine

    rows = lessons.select("id", "embedding")
    a, b = (rows.select(F.col("id").alias(f"{n}_id"), F.col("embedding").alias(f"_{n}")) for n in ("source", "target"))
    joined = edges.select("source_id", "target_id").distinct().join(a, "source_id").join(b, "target_id")
    return joined.select("source_id", "target_id", cosine("_source", "_target").alias("similarity")).filter(F.col("similarity") < most)


def weight_grid(candidates: DataFrame, relevant: DataFrame, a: str, b: str, steps: int = 10, k: int = 10) -> DataFrame:
    """``(weight, recall)``: mean recall at ``k`` of each blend ``weight * a + (1 - weight) * b``, over a grid of fixed size."""
    weight = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    grid = candidates.withColumn("weight", weight).withColumn("s", F.col("weight") * F.col(a) + (1 - F.col("weight")) * F.col(b))
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc_nulls_last("s"), "id")
    top = grid.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    n = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    found = top.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("weight", "query_id").agg(F.count("*").alias("h"))
    asked = candidates.select("query_id").distinct().join(n, "query_id").withColumn("weight", weight)
    return asked.join(found, ["weight", "query_id"], "left").groupBy("weight").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def turn_session(turn: Column) -> Column:
    """The session of a turn id such as ``D1:3``."""
    return F.split(turn, ":")[0]
