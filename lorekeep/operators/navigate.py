"""Budgeted navigation: locate what fits a character budget, expand what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import OPEN, RecallConfig
from lorekeep.operators import graph, retrieval, skew, vectors
from lorekeep.operators.visibility import json_contains, visible
from lorekeep.session import cut

# Weights of the navigation score's auxiliary signals, and preview lengths.
NAVIGATE_AUX = {"importance": 0.05, "recency": 0.05, "provenance": 0.05}
PREVIEW, NEIGHBOUR_PREVIEW, RELATION_TEXT = 120, 50, 200
#: More than there are lessons.
ALL = 1 << 40


def within_budget(ranked: DataFrame, budget: int, straddle: bool = False) -> DataFrame:
    """Rows of ``(query_id, id, score, chars)`` while the running sum of ``chars`` by score stays within the budget.

    Inclusive by default; with ``straddle`` the row that crosses the budget is kept, and its sum is cut to the budget.
    """
    order = F.struct(F.col("score").isNull().alias("a"), (-F.col("score").cast("double")).alias("b"), "id")
    rows = ranked.withColumns({"_order": order, "_chars": F.coalesce("chars", F.lit(0)).cast("long")})
    summed = skew.running_sum(rows, ["query_id"], "_order", "_chars", "running_chars", descending=False)
    summed = summed.withColumn("running_chars", F.col("running_chars") + F.col("_chars")).drop("_order", "_chars")
    if not straddle:
        return summed.filter(F.col("running_chars") <= budget)
    kept = summed.filter(F.col("running_chars") - F.col("chars") < budget)
    return kept.withColumn("running_chars", F.least("running_chars", F.lit(budget)))


def locate(queries: DataFrame, lessons: DataFrame, edges: DataFrame | None, config: RecallConfig, budget: int = 2000, where: dict | None = None, project: int | None = None, straddle: bool = False) -> DataFrame:
    """``(query_id, id, preview, score, chars, running_chars, path)``: the best lessons whose texts fit the budget together.

    Every visible lesson with a usable vector or a text match is ranked by the final score; only the
    running sum cuts. So the ranks of a query run over all its matches, as many as there are lessons.
    """
    seen = visible(lessons, config, project=project)
    if where:
        seen = seen.filter(json_contains("metadata", where))
    if config.entity_weight <= 0 and (config.graph_weight <= 0 or edges is None):
        return _located(queries, seen, config, budget, straddle)
    pool = retrieval.fuse(retrieval.pools(queries, seen, None, RecallConfig(**{**config.__dict__, "ef_search": ALL}), ALL // 4), config)
    facts = seen.select("id", _aux(config).alias("aux"), F.substring("lesson_text", 1, PREVIEW).alias("preview"), F.length("lesson_text").alias("chars"))
    rows = pool.join(facts, "id").withColumn("score", F.col("rrf_score") + F.col("aux"))
    if config.graph_weight > 0 and edges is not None:
        first = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id")
        anchors = pool.withColumn("_r", F.row_number().over(first)).filter("_r <= 5").select("query_id", "id")
        near = graph.proximity(graph.active(edges), anchors, None, bidirectional=True)
        rows = rows.join(near, ["query_id", "id"], "left").withColumn("score", F.col("score") * (1 + config.graph_weight * F.coalesce("proximity", F.lit(0.0))))
    out = within_budget(rows.select("query_id", "id", "preview", "score", "chars"), budget, straddle)
    return out.withColumn("path", F.lit("hybrid"))


def _aux(config: RecallConfig) -> Column:
    """What importance, recency and provenance add to the fused score."""
    aux = NAVIGATE_AUX["importance"] * F.col("importance") / 5.0 + NAVIGATE_AUX["recency"] * retrieval.recency(F.col("created_at"), config)
    return retrieval.AUX_SCALE * (aux + NAVIGATE_AUX["provenance"] * retrieval.provenance(F.col("commit_sha"), F.col("verified_at")))


def _located(queries: DataFrame, seen: DataFrame, config: RecallConfig, budget: int, straddle: bool) -> DataFrame:
    """:func:`locate` without expansion: all matches are ranked inside cells, and only those that can fit the budget leave them."""
    usable = lambda c: F.when(vectors.usable(c, config.dim), F.col(c)).alias("v")
    seen = cut(seen.select("id", "topic", "lesson_text", usable("embedding"), _aux(config).alias("aux")))
    asked = cut(queries.select("query_id", usable("v"), "text"))
    texts, hits = retrieval.text_hits(asked, seen)
    hits = cut(hits)
    by_score = hits.groupBy("text_id", "bm25_score").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("text_id").orderBy(F.desc("bm25_score")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = hits.join(by_score.select("text_id", "bm25_score", (F.coalesce(before, F.lit(0)) + 1).cast("double").alias("r")), ["text_id", "bm25_score"])
    held = ranked.groupBy("id").agg(F.collect_list(F.struct("text_id", "bm25_score", "r")).alias("h"))
    chars = F.coalesce(F.length("lesson_text"), F.lit(0)).cast("long").alias("chars")
    records = cut(seen.select("id", "v", "aux", chars).join(held, "id", "left").select("id", "v", F.col("h.text_id").alias("texts"), F.col("h.bm25_score").alias("scores"), F.col("h.r").alias("ranks"), "aux", "chars"))
    good = records.filter("v is not null").count()
    sizes = hits.join(records.select("id", F.col("v").isNull().alias("bare")), "id").groupBy("text_id").agg(F.count("*").alias("n"), F.sum(F.col("bare").cast("int")).alias("bare"))
    n = F.when(F.col("v").isNotNull(), F.lit(good) + F.coalesce("bare", F.lit(0))).otherwise(F.coalesce("n", F.lit(0)))
    asked = cut(asked.join(texts, "query_id", "left").join(sizes, "text_id", "left").select("query_id", "v", "text_id", n.cast("long").alias("n")))
    k = float(config.rrf_k)
    found = vectors.block_budget(asked, records, budget, config.dim, k, config.vec_weight, config.bm25_weight)
    score = F.when(F.col("base") > vectors.LAST / 2, F.col("base") + config.vec_weight / (k + F.col("vec_rank")))
    preview = seen.select("id", F.substring("lesson_text", 1, PREVIEW).alias("preview"), F.length("lesson_text").alias("chars"))
    rows = found.select("query_id", "id", score.alias("score")).join(preview, "id")
    return within_budget(rows.select("query_id", "id", "preview", "score", "chars"), budget, straddle).withColumn("path", F.lit("hybrid"))


def locate_newest(lessons: DataFrame, config: RecallConfig, content_type: str, budget: int, k: int = 50) -> DataFrame:
    """The newest ``k`` lessons of a type, cut where the budget is crossed (the crossing row is kept)."""
    newest = visible(lessons, config, types=[content_type]).orderBy(F.desc_nulls_last("created_at"), "id").limit(k)
    rows = newest.select(F.lit(0).alias("query_id"), "id", F.unix_micros("created_at").alias("score"), F.length("lesson_text").alias("chars"))
    return within_budget(rows, budget, straddle=True).drop("query_id", "score")


def locate_related(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: neighbours of scored seeds ``(query_id, id, score)``, by ``.7 * edge weight + .3 * seed score``."""
    hop = graph.both_ways(graph.active(edges).select("source_id", "target_id", "weight")).select(F.col("source_id").alias("id"), "target_id", "weight")
    found = seeds.join(hop, "id").select("query_id", F.col("target_id").alias("id"), (0.7 * F.col("weight").cast("double") + 0.3 * F.col("score")).alias("score"))
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def expand(lessons: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, threshold: float = 0.5, relations: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """``(id, content, detail, neighbour_ids, neighbour_previews, running_chars, path)``: the seeds ``(id)`` and what lies around them.

    Active, currently valid lessons only. Walks go up to ``depth`` hops in either direction over open edges of
    at least the threshold and of the given relations. A seed lists the lessons reached from it that are no
    seeds, by depth and id, with the starts of their texts; each reached lesson also has a row of its own, with
    path ``graph_expand`` instead of ``content``. ``detail`` is the JSON of the requested metadata fields, null
    without any. ``running_chars`` sums the texts by id.
    """
    live = lessons.filter(F.col("is_active") & (F.col("t_valid_to") == F.lit(OPEN)))
    use = graph.active(edges).filter(F.col("weight") >= F.lit(threshold).cast("float"))
    if relations is not None:
        use = use.filter(F.upper("relation_type").isin(*[r.upper() for r in relations]))
    hop = graph.both_ways(use.select("source_id", "target_id")).distinct().withColumn("weight", F.lit(1.0))
    hop = hop.join(live.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    given = seeds.select("id").distinct().join(live.select("id"), "id", "left_semi")
    walked = graph._walk(given.select(F.col("id").alias("start"), F.col("id").alias("node")), hop, depth).filter("depth > 0")
    near = walked.groupBy("start", F.col("node").alias("id")).agg(F.min("depth").alias("depth")).join(seeds.select("id"), "id", "left_anti")
    near = cut(near.join(live.select("id", F.substring("lesson_text", 1, NEIGHBOUR_PREVIEW).alias("preview")), "id"))
    listed = near.groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_list(F.struct("depth", "id", "preview"))).alias("_l"))
    kept = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, _: k.isin(*(fields or [""])))
    facts = live.select("id", F.col("lesson_text").alias("content"), F.when(F.size(kept) > 0, F.to_json(kept)).alias("detail"))
    first = given.join(listed, "id", "left").select("id", F.transform("_l", lambda s: s["id"]).alias("neighbour_ids"), F.transform("_l", lambda s: s["preview"]).alias("neighbour_previews"), F.lit("content").alias("path"))
    further = near.select("id").distinct().select("id", F.lit(None).cast("array<long>").alias("neighbour_ids"), F.lit(None).cast("array<string>").alias("neighbour_previews"), F.lit("graph_expand").alias("path"))
    rows = first.unionByName(further).join(facts, "id").withColumns({"_all": F.lit(0), "_chars": F.coalesce(F.length("content"), F.lit(0)).cast("long")})
    summed = skew.running_sum(rows, ["_all"], "id", "_chars", "before", descending=False)
    return summed.select("id", "content", "detail", "neighbour_ids", "neighbour_previews", (F.col("before") + F.col("_chars")).alias("running_chars"), "path")


def typed_projection(lessons: DataFrame) -> DataFrame:
    """``(id, content, detail)``: entities by topic, relations by the start of their text, others whole; the type's details as JSON."""
    kind = F.col("content_type")
    content = F.when(kind == "entity", F.col("topic")).when(kind == "relation", F.substring("lesson_text", 1, RELATION_TEXT)).otherwise(F.col("lesson_text"))
    detail = F.to_json(F.struct(kind.alias("content_type"), F.col("importance").cast("int").alias("importance"), "item_kind"), {"ignoreNullFields": "false"})
    return lessons.select("id", content.alias("content"), detail.alias("detail"))


def dispatch(queries: DataFrame, lessons: DataFrame, edges: DataFrame, config: RecallConfig, content_type: str | None = None, budget: int = 2000) -> DataFrame:
    """``(query_id, id, score, path)``: entity lookups by text rank, temporal ones by time, relations over the graph, others by the hybrid score."""
    seen = visible(lessons, config)
    if content_type == "entity":
        found = retrieval.text_pool(queries, seen.filter("content_type = 'entity'"), 50).withColumnRenamed("bm25_score", "score")
    elif content_type == "temporal":
        newest = locate_newest(lessons, config, "temporal", budget)
        found = queries.select("query_id").crossJoin(F.broadcast(newest.select("id", (-F.col("running_chars")).cast("double").alias("score"))))  # at most 50 rows
    elif content_type == "relation":
        seeds = retrieval.recall_hybrid(queries, lessons, None, config, 10).select("query_id", "id", "score")
        found = locate_related(seeds, edges).join(seen.select("id"), "id", "left_semi")
    else:
        found = locate(queries, lessons, edges, config, budget)
    return found.select("query_id", "id", "score", F.lit(content_type or "hybrid").alias("path"))


#: Rows that the second style of dispatch returns, and the seeds of its relations.
DISPATCHED, SEEDS = 20, 10


def dispatch_by_text(queries: DataFrame, lessons: DataFrame, edges: DataFrame, config: RecallConfig, content_type: str | None = None, budget: int = 2000, project: int | None = None) -> DataFrame:
    """``(query_id, id, score, path)``: the second style of :func:`dispatch`, without budgets for entities and relations.

    Entities are the 20 best by text; relations the 20 best neighbours of the ten best by text, over all edges.
    Any other type takes the path of :func:`locate`.
    """
    if content_type not in ("entity", "relation"):
        return locate(queries, lessons, edges, config, budget, project=project).select("query_id", "id", "score", F.lit("hybrid").alias("path"))
    live = lessons.filter("is_active")
    if project is not None:
        live = live.filter(F.col("project_id") == project)
    if content_type == "entity":
        live = live.filter((F.col("content_type") == "entity") & (F.col("t_valid_to") == F.lit(OPEN)))
        found = retrieval.text_pool(queries, live, DISPATCHED).withColumnRenamed("bm25_score", "score")
    else:
        seeds = retrieval.text_pool(queries, live, SEEDS).select("query_id", "id", F.col("bm25_score").alias("score"))
        near = locate_related(seeds, edges.withColumn("valid_until", F.lit(None).cast("timestamp"))).join(live.select("id"), "id", "left_semi")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        found = near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= DISPATCHED)
    return found.select("query_id", "id", "score", F.lit(content_type).alias("path"))


#: Mean radius of the earth in kilometres.
EARTH_KM = 6371.0088


def within_km(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """``(a_id, b_id, km)``: places ``(id, lat, lon)`` of two tables at most so far apart, joined on latitude bands.

    A band is as high as the distance, so each place meets three bands and no others.
    """
    band = km / (EARTH_KM * 3.141592653589793 / 180)
    x = a.select(F.col("id").alias("a_id"), F.radians("lat").alias("la"), F.radians("lon").alias("lo"), F.floor(F.col("lat") / band).alias("c"))
    x = x.withColumn("c", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    y = b.select(F.col("id").alias("b_id"), F.radians("lat").alias("lb"), F.radians("lon").alias("lp"), F.floor(F.col("lat") / band).alias("c"))
    h = F.pow(F.sin((F.col("lb") - F.col("la")) / 2), 2) + F.cos("la") * F.cos("lb") * F.pow(F.sin((F.col("lp") - F.col("lo")) / 2), 2)
    return x.join(y, "c").select("a_id", "b_id", (2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))).alias("km")).filter(F.col("km") <= km)
