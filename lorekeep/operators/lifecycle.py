"""Curation: consolidation and its undo, outcomes and confidence, staleness, reclassification, corpus statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import OPEN, RecallConfig
from lorekeep.functions import text
from lorekeep.operators import skew, vectors
from lorekeep.session import cut

CLUSTERED_TYPES = text.CONTENT_TYPES
# Confidence steps of the additive mode.
SUCCESS_DELTA, FAIL_DELTA = 0.02, 0.12


#: States that consolidation and staleness pass over.
MERGED_STATES, RETIRED_STATES = ("superseded", "archived", "rejected"), ("deprecated", "archived", "rejected")
#: Lessons that consolidation compares for each cluster it may report.
CANDIDATES = 20


def candidates(lessons: DataFrame, dim: int, limit: int | None) -> DataFrame:
    """Active lessons that may be merged: the first ``limit`` by recall count, confidence, importance and age, all with None."""
    rows = lessons.filter(F.col("is_active") & ~F.col("state").isin(*MERGED_STATES) & F.col("embedding").isNotNull())
    if limit is not None:
        rows = rows.orderBy(F.desc_nulls_first("recall_count"), F.desc_nulls_first("confidence"), F.desc_nulls_first("importance"), F.asc_nulls_last("created_at"), "id").limit(limit)
    return rows.filter(vectors.usable("embedding", dim) & F.col("role").isNotNull())


def similar_pairs(rows: DataFrame, similarity: float, dim: int) -> DataFrame:
    """``(a, b, sim)``: pairs of one role at least so similar, compared in blocks."""
    given = rows.select("id", F.xxhash64("role").alias("g"), F.col("embedding").alias("v"))
    found = vectors.block_above(given, given, float(np.nextafter(similarity, -1)), dim).filter("query_id < id")
    # Roles are compared by hash in the blocks, and by name here.
    a, b = (rows.select(F.col("id").alias(x), F.col("role").alias(f"role_{x}")) for x in "ab")
    pairs = found.select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.col("score").alias("sim"))
    return pairs.join(a, "a").join(b, "b").filter("role_a = role_b").select("a", "b", "sim")


def clusters(pairs: DataFrame) -> DataFrame:
    """``(id, root)``: the least id reachable over the pairs ``(a, b)``; labels jump to their label's label each round."""
    edges = cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        seen = edges.join(labels.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        near = labels.join(seen, "id").select("id", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = cut(near.join(jump, "root").select("id", F.least("root", "far").alias("root"), "old"))
        if not new.filter("root <> old").limit(1).count():
            return new.select("id", "root")
        labels = new.select("id", "root")


def consolidate(lessons: DataFrame, similarity: float = 0.92, limit: int = 100, dim: int = 64, every: bool = False) -> DataFrame:
    """``(canonical_id, member_ids, size, mean_sim)`` of the largest clusters of similar lessons of one role.

    The feature compares the first ``CANDIDATES * limit`` lessons only; with ``every`` all are compared, and
    the limit holds for the reported clusters alone.
    The canonical lesson is first by recall count, confidence and importance, then the oldest, then the least id;
    ``member_ids`` lists the others in that order.
    """
    given = cut(candidates(lessons, dim, None if every else CANDIDATES * limit).select("id", "role", "embedding"))
    pairs = cut(similar_pairs(given, similarity, dim))
    roots = clusters(pairs)
    members = roots.join(lessons, "id")
    order = F.struct(
        (-F.coalesce("recall_count", F.lit(0))).alias("r"),
        (-F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))).alias("c"),
        (-F.coalesce(F.col("importance").cast("int"), F.lit(0))).alias("i"),
        F.col("created_at").isNull().alias("n"),
        "created_at",
        "id",
    )
    grouped = members.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["id"]).alias("ids"))
    means = pairs.join(roots.withColumnRenamed("id", "a"), "a").groupBy("root").agg(F.avg("sim").alias("mean_sim"))
    out = grouped.join(means, "root").select(F.col("ids")[0].alias("canonical_id"), F.array_join(F.slice(F.transform("ids", lambda i: i.cast("string")), 2, 1 << 30), ",").alias("member_ids"), F.size("ids").alias("size"), "mean_sim")
    return out.orderBy(F.desc("size"), F.desc("mean_sim"), "canonical_id").limit(limit)


def supersede(lessons: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lessons, edges)`` after consolidation: members superseded and inactive, evidence added, an edge with each prior state."""
    members = found.select("canonical_id", F.explode(F.split("member_ids", ",").cast("array<long>")).alias("id"))
    extra = found.select(F.col("canonical_id").alias("id"), (F.col("size") - 1).alias("extra"))
    joined = lessons.join(members, "id", "left").join(extra, "id", "left")
    gone = F.col("canonical_id").isNotNull()
    edges = joined.filter(gone).select(F.col("id").alias("source_id"), F.col("canonical_id").alias("target_id"), F.lit("SUPERSEDED_BY").alias("relation_type"), F.to_json(F.struct(F.col("state").alias("prior_state"))).alias("metadata"))
    after = joined.withColumns({"state": F.when(gone, "superseded").otherwise(F.col("state")), "is_active": F.col("is_active") & ~gone, "evidence_count": F.col("evidence_count") + F.coalesce("extra", F.lit(0))})
    return after.drop("canonical_id", "extra"), edges


def undo_consolidate(lessons: DataFrame, edges: DataFrame, canonical: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lessons, edges)`` with superseded members restored to their prior state, their edges gone, and the evidence reset to 1."""
    mine = F.col("relation_type") == "SUPERSEDED_BY"
    if canonical is not None:
        mine = mine & (F.col("target_id") == canonical)
    back = edges.filter(mine).select(F.col("source_id").alias("id"), F.get_json_object("metadata", "$.prior_state").alias("prior"))
    heads = edges.filter(mine).select(F.col("target_id").alias("id"), F.lit(True).alias("head")).distinct()
    joined = lessons.join(back, "id", "left").join(heads, "id", "left")
    out = joined.withColumns({"state": F.coalesce("prior", "state"), "is_active": F.col("is_active") | F.col("prior").isNotNull(), "evidence_count": F.when(F.col("head"), 1).otherwise(F.col("evidence_count"))})
    return out.drop("prior", "head"), edges.filter(~mine)


def posterior(success: Column, fail: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Mean of the Beta posterior after so many successes and failures."""
    return (success + alpha) / (success + fail + alpha + beta)


def reinforce(outcomes: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """``(id, successes, failures, neutral, confidence)`` of an outcome log ``(id, outcome, used)``; unused outcomes don't count."""
    used = outcomes.filter(F.coalesce("used", F.lit(True)))
    counts = [F.sum((F.col("outcome") == o).cast("int")).alias(n) for o, n in (("success", "successes"), ("failure", "failures"), ("neutral", "neutral"))]
    return used.groupBy("id").agg(*counts).withColumn("confidence", posterior(F.col("successes"), F.col("failures"), alpha, beta))


def reinforce_additive(outcomes: DataFrame, start: float = 0.5) -> DataFrame:
    """``(id, confidence)``: steps up and down folded in the order of ``seq``, clamped to 0..1 at each step."""
    step = F.when(F.col("outcome") == "success", SUCCESS_DELTA).when(F.col("outcome") == "failure", -FAIL_DELTA).otherwise(0.0)
    ordered = F.array_sort(F.collect_list(F.struct("seq", step.alias("d"))))
    fold = F.aggregate(ordered, F.lit(start), lambda c, s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c + s["d"])))
    return outcomes.groupBy("id").agg(fold.alias("confidence"))


def stale(lessons: DataFrame, config: RecallConfig, days: int = 45, keep_confidence: float = 0.6, keep_provenance: bool = True) -> DataFrame:
    """``(id, idle_days, would_deprecate, position)`` of active lessons not recalled for so long, never recalled ones first.

    Flagged are those less confident than ``keep_confidence``, of an importance under 5 and (with
    ``keep_provenance``) without provenance; unknown values keep a lesson. Retired states are passed over.
    """
    last = F.coalesce("last_recalled_at", "created_at")
    idle = (F.unix_micros(F.lit(config.now)) - F.unix_micros(last)) / 86_400_000_000
    gone = F.coalesce((F.col("confidence") < F.lit(keep_confidence).cast("float")) & (F.col("importance") < 5), F.lit(False))
    if keep_provenance:
        gone = gone & F.col("commit_sha").isNull() & F.col("artifact_hash").isNull()
    rows = lessons.filter(F.col("is_active") & ~F.col("state").isin(*RETIRED_STATES))
    rows = rows.select("id", idle.alias("idle_days"), gone.alias("would_deprecate"), "last_recalled_at", "created_at").filter(F.col("idle_days") > days)
    order = F.struct(F.col("last_recalled_at").isNotNull().alias("a"), F.coalesce(F.unix_micros("last_recalled_at"), F.lit(0)).alias("b"), F.coalesce(F.unix_micros("created_at"), F.lit(0)).alias("c"), "id")
    ranked = skew.running_sum(rows.withColumns({"_all": F.lit(0), "_one": F.lit(1), "_o": order}), ["_all"], "_o", "_one", "before", descending=False)
    return ranked.select("id", "idle_days", "would_deprecate", (F.col("before") + 1).alias("position"))


def mark_stale(lessons: DataFrame, config: RecallConfig, cap: int = 50, **rules) -> DataFrame:
    """``(id, state)`` of the lessons to deprecate, or no row when more than ``cap`` would be: nothing is done halfway."""
    gone = stale(lessons, config, **rules).filter("would_deprecate").select("id", F.lit("deprecated").alias("state"))
    return gone if gone.limit(cap + 1).count() <= cap else gone.limit(0)


def reclassified(lessons: DataFrame) -> DataFrame:
    """``(content_type, before, after)``: how many lessons have each type, and would have after classification.

    Types set by curators (not among the classifier's own) stay.
    """
    old = F.col("content_type")
    new = F.when(old.isNull() | old.isin(*text.CONTENT_TYPES), text.classify_content_type(F.col("lesson_text"))).otherwise(old)
    sides = F.explode(F.array(F.struct(old.alias("content_type"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(new.alias("content_type"), F.lit(0).alias("b"), F.lit(1).alias("a"))))
    return lessons.select(sides.alias("s")).groupBy(F.coalesce("s.content_type", F.lit("none")).alias("content_type")).agg(F.sum("s.b").alias("before"), F.sum("s.a").alias("after"))


def quantiles(rows: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantiles of ``value`` under the names of ``at``; nulls don't count, no values give nulls.

    Equal values are counted first and the counts summed over range partitions, so no task holds all values.
    """
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = skew.running_sum(counts.withColumn("_all", F.lit(0)), ["_all"], "v", "n", "before", descending=False)

    def pick(place: int) -> Column:
        return F.max(F.when((F.col("before") <= place) & (F.col("before") + F.col("n") > place), F.col("v")))

    out = {}
    for name, q in at.items():
        place = q * (max(1, total) - 1)
        low, high = int(np.floor(place)), int(np.ceil(place))
        out[name] = pick(low) + (pick(high) - pick(low)) * (place - low)
    return ranked.agg(*[c.alias(name) for name, c in out.items()])


def stats(lessons: DataFrame, edges: DataFrame, config: RecallConfig, version: str, hybrid: bool = True) -> DataFrame:
    """One row: the store's counts, coverages, age and confidence, and the settings of retrieval in force.

    Catalogue checks of a database have no meaning here: ``orphan_count`` is 0 and ``recall_hybrid_available`` true.
    """
    config = config.clamped()
    live = F.col("t_valid_to") == F.lit(OPEN)
    share = lambda c: F.coalesce(F.round(100.0 * F.avg(c.cast("int")), 2), F.lit(0.0))
    days = F.coalesce((F.unix_micros(F.lit(config.now)) - F.unix_micros(F.min("created_at"))) / 86_400_000_000, F.lit(0.0))
    counted = lessons.agg(
        F.count("*").alias("lesson_count"),
        F.count("embedding").alias("embedded_count"),
        share(F.col("embedding").isNotNull()).alias("embedding_coverage_pct"),
        share(F.coalesce("topic", "lesson_text").isNotNull()).alias("tsv_coverage_pct"),
        F.rint(days).cast("int").alias("oldest_lesson_age_days"),
        F.coalesce(F.sum((live & F.col("verified_at").isNull()).cast("long")), F.lit(0)).alias("ghost_count"),
        F.coalesce(F.avg(F.when(live, F.col("confidence").cast("double"))), F.lit(0.5)).alias("confidence_mean"),
        F.coalesce(F.sum((live & (F.col("confidence") < 0.3)).cast("int")), F.lit(0)).cast("int").alias("confidence_below_threshold_count"),
    )
    spread = quantiles(lessons.filter(live), "confidence", {"confidence_p10": 0.1, "confidence_p50": 0.5, "confidence_p90": 0.9})
    spread = spread.select(*[F.coalesce(c, F.lit(0.5)).alias(c) for c in spread.columns])
    fixed = {
        "version": version, "recency_weight": config.recency_weight, "ef_search": config.ef_search, "importance_weight": 0.15, "hybrid_enabled": hybrid,
        "recall_hybrid_available": True, "orphan_count": 0, "graph_expand_weight": config.expand_weight, "graph_expand_depth": config.expand_depth,
        "graph_expand_ann_k": config.expand_anchors, "graph_expand_per_node": config.expand_per_node, "graph_entity_expand_weight": config.entity_weight,
        "graph_entity_min_overlap": config.entity_min_overlap, "graph_entity_max_expansion": config.entity_max_expansion,
    }
    # Three frames of one row each.
    joined = counted.crossJoin(edges.agg(F.count("*").alias("mem_edge_count"))).crossJoin(spread)
    return joined.withColumns({name: F.lit(v) for name, v in fixed.items()})


def corpus_stats(lessons: DataFrame, dim: int) -> DataFrame:
    """One row of corpus statistics: counts, coverages, confidence quantiles and age."""
    share = lambda c: F.round(100.0 * F.avg(c.cast("int")), 2)
    sure = F.col("confidence").between(0, 1)
    conf = F.when(sure, F.col("confidence").cast("double"))
    spread = quantiles(lessons.select(conf.alias("c")), "c", {"confidence_p10": 0.1, "confidence_p50": 0.5, "confidence_p90": 0.9})
    counted = lessons.agg(
        F.count("*").alias("total"),
        F.sum(F.col("is_active").cast("int")).alias("active"),
        F.countDistinct("role").alias("roles"),
        F.countDistinct("project_id").alias("projects"),
        share(vectors.usable("embedding", dim)).alias("embedded_pct"),
        share(F.col("verified_at").isNotNull()).alias("verified_pct"),
        share(F.col("commit_sha").isNotNull()).alias("provenance_pct"),
        F.avg(conf).alias("mean_confidence"),
        F.unix_micros(F.min("created_at")).alias("oldest_us"),
    )
    return counted.crossJoin(spread)  # one row each


def embedding_policy(lessons: DataFrame, dim: int, exempt: tuple[str, ...] = ("entity", "fact", "relation", "temporal")) -> DataFrame:
    """``(content_type, embedded)``: vectors that the selective policy would drop, by type."""
    return lessons.filter(F.col("content_type").isin(*exempt) & F.col("embedding").isNotNull()).groupBy("content_type").agg(F.count("*").alias("embedded"))


def apply_embedding_policy(lessons: DataFrame, exempt: tuple[str, ...] = ("entity", "fact", "relation", "temporal")) -> DataFrame:
    """The lessons without the vectors that the selective policy drops."""
    drop = F.coalesce(F.col("content_type").isin(*exempt), F.lit(False))
    return lessons.withColumn("embedding", F.when(~drop, F.col("embedding")))


def counts_json(rows: DataFrame, key: str) -> DataFrame:
    """``(counts)``: one JSON object of the number of rows of each value of a column of few values, keys in order."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))).alias("counts"))


def evict(lessons: DataFrame, ids: DataFrame, config: RecallConfig) -> DataFrame:
    """The lessons with those of ``ids(id)`` superseded: closed and changed at ``now``, inactive. Unknown ids change nothing."""
    marked = lessons.join(ids.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    gone, now = F.col("_gone").isNotNull(), F.lit(config.now)
    changed = {"t_valid_to": now, "state": F.lit("superseded"), "is_active": F.lit(False), "updated_at": now, "state_changed_at": now}
    return marked.withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in changed.items() if c in lessons.columns}).drop("_gone")


def latest_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def evict_expired(lessons: DataFrame, config: RecallConfig) -> DataFrame:
    """The lessons that have not expired at the time of the settings."""
    return lessons.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(config.now)))


def mark_recalled(lessons: DataFrame, recalls: DataFrame) -> DataFrame:
    """Adds a log of recalls ``(id, at)`` to the counts and the last time of recall; unknown ids are skipped."""
    seen = recalls.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = lessons.join(seen, "id", "left")
    return joined.withColumns({"recall_count": F.coalesce("recall_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_recalled_at": F.greatest("last_recalled_at", "_at")}).drop("_n", "_at")


def stats_by(lessons: DataFrame, *keys: str) -> DataFrame:
    """Counts, activity and mean confidence over every combination of the keys (a cube; null stands for all, ``level`` tells them apart)."""
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence").cast("double"))
    return lessons.cube(*keys).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(F.col("is_active").cast("int")).alias("active"), F.avg(sure).alias("mean_confidence"))
