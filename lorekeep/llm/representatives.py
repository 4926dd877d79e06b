"""Best representative of each duplicate group: survivor, field sources, and token-level consensus of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.skew import lookup_join
from lorekeep.session import cut

#: Distinct values aligned in one task; larger groups are aligned in rounds of so many profiles.
FAN_IN = 32
GAP = 0.6


def survivors(records: DataFrame, group: str, key: str, order: list[tuple[str, Column, bool]], fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """One row per group of two or more records: the survivor and, per field, the record that supplies it.

    ``records`` has one row per ``key``. ``order`` lists ``(column, usable, highest first)``: the
    survivor is first by these, unusable values (and nulls) last in each, then by the least key.
    ``fields`` maps an output column to ``(ordered column, highest)``: the key of the record with the
    highest (or lowest) usable value, the least key on ties, null where no record has a usable value.
    Rows with a null group or key are dropped. Comes down to one aggregate with map-side combine, so
    a group with a third of all rows is reduced before the shuffle.
    """
    names = {c: f"_v{k}" for k, (c, _, _) in enumerate(order)}
    usable = [F.when(ok, F.col(c)).alias(names[c]) for c, ok, _ in order]
    base = records.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("_g"), F.col(key).cast("long").alias("_k"), *usable)

    def rising(name: str, highest: bool) -> Column:
        v = F.col(name)
        kind = base.schema[name].dataType.simpleString()
        v = F.unix_micros(v) if kind == "timestamp" else v.cast("double")
        return v if highest else -v

    rank = F.struct(*[F.struct(F.col(names[c]).isNotNull(), rising(names[c], high)) for c, _, high in order], -F.col("_k"))
    aggs = [F.max(F.struct(rank.alias("r"), F.col("_k").alias("k"))).alias("_s")]
    for out, (c, high) in fields.items():
        best = F.max(F.when(F.col(names[c]).isNotNull(), F.struct(rising(names[c], high).alias("v"), (-F.col("_k")).alias("k"))))
        aggs.append((-best.getField("k")).alias(out))
    grouped = base.groupBy("_g").agg(F.count("*").alias("_n"), *aggs).filter("_n > 1")
    return grouped.select(F.col("_g").alias(group), F.col("_s.k").alias("survivor"), *fields)


def _align(a: list[dict[str, float]], b: list[dict[str, float]]) -> list[dict[str, float]]:
    """Aligns two profiles (columns of token weights; "" is a gap) and adds them up."""
    wa, wb = sum(a[0].values()) if a else 0.0, sum(b[0].values()) if b else 0.0
    if not a or not b:
        return [dict(c) for c in a or b]
    score = np.full((len(a), len(b)), -1.0)
    at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        for t in c:
            if t:
                at.setdefault(t, []).append(j)
    for i, c in enumerate(a):
        for t, w in c.items():
            for j in at.get(t, ()):
                score[i, j] += 2 * (w / wa) * (b[j][t] / wb)
    ramp = GAP * np.arange(len(b) + 1)
    best = np.empty((len(a) + 1, len(b) + 1))
    best[0] = -ramp
    for i in range(1, len(a) + 1):
        row = np.maximum(best[i - 1] - GAP, np.concatenate([[-np.inf], best[i - 1, :-1] + score[i - 1]]))
        best[i] = np.maximum.accumulate(row + ramp) - ramp
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and abs(best[i, j] - best[i - 1, j - 1] - score[i - 1, j - 1]) < 1e-9:
            i, j = i - 1, j - 1
            left, right = a[i], b[j]
        elif i and abs(best[i, j] - best[i - 1, j] + GAP) < 1e-9:
            i -= 1
            left, right = a[i], {"": wb}
        else:
            j -= 1
            left, right = {"": wa}, b[j]
        out.append({t: left.get(t, 0.0) + right.get(t, 0.0) for t in {**left, **right}})
    return out[::-1]


def _progressive(profiles: list[list[dict[str, float]]]) -> list[dict[str, float]]:
    """Aligns profiles one after another, the most trusted first."""
    profiles = sorted(profiles, key=lambda p: (-(sum(p[0].values()) if p else 0.0), len(p)))
    total = profiles[0]
    for p in profiles[1:]:
        total = _align(total, p)
    return total


def _distance(a: list[str], b: list[str]) -> int:
    """Token edit distance, row by row."""
    ids = {t: k for k, t in enumerate({*a, *b})}
    y = np.array([ids[t] for t in b], np.int64)
    ramp = np.arange(len(b) + 1)
    row = ramp
    for i, t in enumerate(a, 1):
        step = np.minimum(row + 1, np.concatenate([[i], row[:-1] + (y != ids[t])]))
        row = np.minimum.accumulate(step - ramp) + ramp
    return int(row[-1])


def consensus(values: DataFrame, group: str, key: str, value: str, weight: str | None = None) -> DataFrame:
    """``(group, key, distance)``: the existing value of each group that is closest to its consensus.

    The distinct values of a group are split into tokens at white space and aligned progressively,
    the heaviest first; each column elects its heaviest token (or gap; ties go to the smaller token),
    and the value with the least token edit distance to the elected text wins, then the heavier, then
    the one with the least key. ``weight`` is a column of positive weights (1 without it).
    Null values and rows with a null group or key don't take part; groups of null values only give no
    row. A group is aligned in rounds of ``FAN_IN`` profiles, so none is collected into one task.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = values.select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(value).alias("v"), w.alias("w")).filter("g is not null and k is not null and v is not null")
    distinct = cut(base.groupBy("g", "v").agg(F.sum("w").alias("w"), F.min("k").alias("k")))
    total = max(1, distinct.count())
    kind = distinct.schema["g"].dataType.simpleString()
    schema = f"g {kind}, id long, profile array<map<string,double>>"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": b.g, "id": b.k, "profile": [[{t: w} for t in v.split()] for v, w in zip(b.v, b.w, strict=True)]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        merged = _progressive([[dict(c) for c in p] for p in part.profile])
        return pd.DataFrame({"g": part.g.iloc[:1], "id": [part.id.min()], "profile": [merged]})

    profiles = distinct.mapInPandas(first, schema)
    while True:
        sizes = profiles.groupBy("g").agg(F.count("*").alias("n"))
        cells = lookup_join(profiles, sizes, ["g"], "n", total).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / FAN_IN)))
        profiles = cut(cells.select("g", "id", "profile", "part").groupBy("g", "part").applyInPandas(merge, schema))
        if not profiles.groupBy("g").count().filter("count > 1").limit(1).count():
            break

    def elect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [" ".join(t for t in (min(dict(c).items(), key=lambda x: (-x[1], x[0]))[0] for c in p) if t) for p in b.profile]
            yield pd.DataFrame({"g": b.g, "elected": text})

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [_distance(v.split(), e.split()) for v, e in zip(b.v, b.elected, strict=True)]
            yield pd.DataFrame({"g": b.g, "k": b.k, "w": b.w, "distance": pd.array(d, dtype="int64")})

    sizes = distinct.groupBy("g").agg(F.count("*").alias("n"))
    elected = profiles.mapInPandas(elect, f"g {kind}, elected string").join(sizes, "g")
    far = lookup_join(distinct, elected, ["g"], "n", total).mapInPandas(measure, f"g {kind}, k long, w double, distance long")
    best = F.min(F.struct("distance", (-F.col("w")).alias("w"), "k")).alias("b")
    return far.groupBy("g").agg(best).select(F.col("g").alias(group), F.col("b.k").alias(key), "b.distance")
