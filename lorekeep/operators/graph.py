"""Walks over the typed edge table, and edge builders. Paths are arrays of ids; every hop is one join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import OPEN


def active(edges: DataFrame, sentinel: bool = True) -> DataFrame:
    """Edges that are open: null, or also (with ``sentinel``) the far-future mark."""
    open_ = F.col("valid_until").isNull()
    return edges.filter(open_ | (F.col("valid_until") >= F.lit(OPEN)) if sentinel else open_)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, so that a walk is an equi-join instead of a join on either end."""
    turned = edges.withColumns({"source_id": F.col("target_id"), "target_id": F.col("source_id")})
    return edges.unionByName(turned)


def _walk(starts: DataFrame, edges: DataFrame, depth: int, per_node: int | None = None) -> DataFrame:
    """All simple paths from ``starts(start, node)`` over ``edges(source_id, target_id, weight)``, up to ``depth`` hops.

    Weights are multiplied in single precision. With ``per_node`` only the heaviest edges of a path's last
    node are followed, of those to nodes that the path has not seen.
    """
    if per_node is not None:
        # A path has seen at most ``depth`` nodes, each with a few parallel edges, so no edge beyond these can be among its first.
        best = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("weight"), "target_id")
        same = F.count("*").over(Window.partitionBy("source_id", "target_id"))
        edges = edges.withColumn("_n", same).withColumns({"_n": F.max("_n").over(Window.partitionBy("source_id")), "_r": F.row_number().over(best)})
        edges = edges.filter(F.col("_r") <= per_node + depth * F.col("_n")).drop("_r", "_n")
    hop = edges.select(F.col("source_id").alias("node"), "target_id", F.coalesce("weight", F.lit(1.0)).cast("float").alias("w"), "weight")
    level = starts.withColumns({"depth": F.lit(0), "path": F.array("node"), "path_weight": F.lit(1.0).cast("float")})
    out = level
    for _ in range(depth):
        nxt = level.join(hop, "node").filter(~F.array_contains("path", F.col("target_id")))
        if per_node is not None:
            first = Window.partitionBy("start", "path").orderBy(F.desc_nulls_last("weight"), "target_id")
            nxt = nxt.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= per_node)
        level = nxt.select("start", F.col("target_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("target_id")).alias("path"), (F.col("path_weight") * F.col("w")).cast("float").alias("path_weight"))
        out = out.unionByName(level)
    return out


def causal_chain(edges: DataFrame, starts: DataFrame, depth: int, relations: list[str] | None = None, only_active: bool = True, direction: str = "forward") -> DataFrame:
    """``(start, node, depth, path, path_weight)``: all simple paths from each start, in one or both directions."""
    if direction not in ("forward", "backward", "both"):
        raise ValueError("direction must be forward, backward or both")
    use = active(edges) if only_active else edges
    if relations is not None:
        use = use.filter(F.upper("relation_type").isin(*[r.upper() for r in relations]))
    use = use.select("source_id", "target_id", "weight").distinct()
    if direction == "backward":
        use = use.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight")
    if direction == "both":
        use = both_ways(use)
    return _walk(starts, use, depth).filter("depth > 0")


def temporal_window(lessons: DataFrame, edges: DataFrame, starts: DataFrame, minutes: float = 15, unlinked: bool = True, k: int = 20, role: str | None = None, project: int | None = None) -> DataFrame:
    """``(start, id, delta_sec, linked, edge_weight)``: lessons created within the window around each start, nearest first.

    Time is cut into cells of the window's width, so the band join is an equi-join on neighbouring cells.
    """
    if role is not None:
        lessons = lessons.filter(F.col("role") == role)
    if project is not None:
        lessons = lessons.filter(F.col("project_id") == project)
    width = F.lit(int(minutes * 60_000_000))
    mine = starts.select(F.col("id").alias("start"), F.unix_micros("created_at").alias("t0")).filter("t0 is not null")
    cell = F.floor(F.col("t0") / width)
    mine = mine.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    others = lessons.select("id", F.unix_micros("created_at").alias("t")).filter("t is not null").withColumn("cell", F.floor(F.col("t") / width))
    near = mine.join(others, "cell").filter((F.col("id") != F.col("start")) & (F.abs(F.col("t") - F.col("t0")) <= width))
    links = both_ways(edges.select("source_id", "target_id", "weight")).groupBy("source_id", "target_id").agg(F.max("weight").alias("edge_weight"))
    out = near.join(links, (F.col("start") == F.col("source_id")) & (F.col("id") == F.col("target_id")), "left")
    out = out.select("start", "id", (F.abs(F.col("t") - F.col("t0")) / 1e6).alias("delta_sec"), F.col("source_id").isNotNull().alias("linked"), "edge_weight")
    if not unlinked:
        out = out.filter("linked")
    order = Window.partitionBy("start").orderBy("delta_sec", "id")
    return out.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def proximity(edges: DataFrame, anchors: DataFrame, kinds: list[str] | None, max_depth: int = 2, bidirectional: bool = False) -> DataFrame:
    """``(query_id, id, proximity)``: the best ``1 - depth / max_depth`` over walks from each query's anchors.

    ``anchors`` is ``(query_id, id)``.
    """
    use = edges if kinds is None else edges.filter(F.col("edge_kind").isin(*kinds))
    use = use.select("source_id", "target_id", F.lit(1.0).alias("weight")).distinct()
    if bidirectional:
        use = both_ways(use).distinct()
    walked = _walk(anchors.select(F.col("query_id").alias("start"), F.col("id").alias("node")), use, max_depth).filter("depth > 0")
    return walked.groupBy(F.col("start").alias("query_id"), F.col("node").alias("id")).agg(F.max(1 - F.col("depth") / max_depth).alias("proximity"))


def expand(edges: DataFrame, anchors: DataFrame, depth: int, per_node: int) -> DataFrame:
    """``(query_id, id, graph_score)``: nodes reached over open causal edges, with the greatest product of weights."""
    use = active(edges, sentinel=False).filter("edge_kind = 'causal'").select("source_id", "target_id", "weight").distinct()
    walked = _walk(anchors.select(F.col("query_id").alias("start"), F.col("id").alias("node")), use, depth, per_node).filter("depth > 0")
    return walked.groupBy(F.col("start").alias("query_id"), F.col("node").alias("id")).agg(F.max("path_weight").alias("graph_score"))


def entity_candidates(lessons: DataFrame, keys: DataFrame, min_overlap: int, max_expansion: int) -> DataFrame:
    """``(query_id, id, key_overlap)``: active lessons that carry a query's entity keys; of each key the first ``max_expansion`` by id."""
    carried = lessons.filter("is_active").select("id", F.explode(F.from_json(F.get_json_object("metadata", "$.entity_keys"), "array<string>")).alias("key")).distinct()
    first = Window.partitionBy("key").orderBy("id")
    capped = carried.join(keys.select("key").distinct(), "key", "left_semi").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= max_expansion)
    found = capped.join(keys.select("query_id", "key").distinct(), "key").groupBy("query_id", "id").agg(F.count("*").alias("key_overlap"))
    return found.filter(F.col("key_overlap") >= min_overlap)


def merged_metadata(edges: DataFrame) -> DataFrame:
    """``(source_id, target_id, relation_type, metadata)``: the keys of all requests of an open edge, the latest value of each, as JSON.

    Each key's latest value is found by an aggregate, so only an edge's distinct keys come together. Metadata that
    is null or no object adds nothing; an edge without any has null.
    """
    keys = ["source_id", "target_id", "relation_type"]
    base = active(edges).filter("source_id <> target_id").select("source_id", "target_id", F.upper("relation_type").alias("relation_type"), "metadata", F.struct("updated_at", "id").alias("o"))
    pairs = base.select(*keys, "o", F.explode(F.from_json("metadata", "map<string,string>")).alias("k", "v"))
    newest = pairs.groupBy(*keys, "k").agg(F.max(F.struct("o", "v")).alias("m"))
    merged = newest.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("m.v").alias("v")))))).alias("metadata"))
    return base.select(*keys).distinct().join(merged, keys, "left")


def causal_edges(lessons: DataFrame, run: str = "source_run_id") -> DataFrame:
    """``(source_id, target_id, relation_type, edge_kind, weight)``: each lesson to the next of its run, by creation time."""
    order = Window.partitionBy(run).orderBy("created_at", "id")
    rows = lessons.filter(F.col(run).isNotNull() & F.col("created_at").isNotNull())
    out = rows.select("id", F.lag("id").over(order).alias("before")).filter("before is not null")
    return out.select(F.col("before").alias("source_id"), F.col("id").alias("target_id"), F.lit("DERIVED_FROM").alias("relation_type"), F.lit("causal").alias("edge_kind"), F.lit(1.0).alias("weight"))


def temporal_edges(rows: DataFrame, session: Column, minutes: float = 30) -> DataFrame:
    """``(source_id, target_id, gap_sec)``: pairs of one session at most so far apart, the earlier first.

    An equi-join on (session, time cell) with its neighbour cell, so a long session spreads over its cells.
    """
    width = int(minutes * 60_000_000)
    base = rows.select(session.alias("s"), "id", F.unix_micros("created_at").alias("t")).filter("s is not null and t is not null").withColumn("cell", F.floor(F.col("t") / width))
    later = base.select("s", F.col("id").alias("id2"), F.col("t").alias("t2"), F.col("cell").alias("cell"))
    mine = base.withColumn("cell", F.explode(F.array(F.col("cell"), F.col("cell") + 1)))
    pairs = mine.join(later, ["s", "cell"]).filter((F.col("t2") - F.col("t") <= width) & ((F.col("t2") > F.col("t")) | ((F.col("t2") == F.col("t")) & (F.col("id2") > F.col("id")))))
    return pairs.select(F.col("id").alias("source_id"), F.col("id2").alias("target_id"), ((F.col("t2") - F.col("t")) / 1e6).alias("gap_sec"))


def upsert(edges: DataFrame, mode: str = "replace", at: datetime | None = None) -> DataFrame:
    """One open edge per (source, target, relation): requests folded in the order of ``updated_at``, then ``id``.

    ``replace`` keeps the last weight, ``max`` the greatest, ``avg`` averages each with the result so far.
    Weights are clamped to 0..1, relation types upper-cased, loops dropped.
    """
    if mode not in ("replace", "max", "avg"):
        raise ValueError("mode must be replace, max or avg")
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("weight").cast("double"), F.lit(1.0))))
    base = active(edges).filter("source_id <> target_id").select("source_id", "target_id", F.upper("relation_type").alias("relation_type"), F.struct("updated_at", "id", w.alias("w")).alias("e"))
    keys = ["source_id", "target_id", "relation_type"]
    if mode == "max":
        return base.groupBy(*keys).agg(F.max("e.w").alias("weight"))
    if mode == "replace":
        return base.groupBy(*keys).agg(F.max("e").alias("m")).select(*keys, F.col("m.w").alias("weight"))
    fold = F.aggregate(F.array_sort(F.collect_list("e")), F.lit(None).cast("double"), lambda a, e: F.when(a.isNull(), e["w"]).otherwise((a + e["w"]) / 2))
    return base.groupBy(*keys).agg(fold.alias("weight"))
