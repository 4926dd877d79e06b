"""Retrieval over batches of queries: exact vector search, text pools, rank fusion and the final score.

``queries`` is a DataFrame ``(query_id, v, text)``; either signal may be null. All windows are
partitioned by query, and pools are limited per query before they are ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import RecallConfig
from lorekeep.functions import lexical, text
from lorekeep.operators import graph, vectors
from lorekeep.operators.visibility import visible
from lorekeep.session import cut

# How auxiliary signals are scaled into a fused score, and their weights.
AUX_SCALE = (0.8 / 61) / 0.76
AUX = {"importance": 0.025, "confidence": 0.025, "recency": 0.05, "provenance": 0.05}
RECENCY_DAYS = 90


def recency(created: Column, config: RecallConfig, days: int = RECENCY_DAYS) -> Column:
    """Linear decay from 1 now to 0 after ``days``; a creation in the future counts as now or newer (above 1 is kept)."""
    age = (F.unix_micros(F.lit(config.now)) - F.unix_micros(created)) / 1e6 / (days * 86400.0)
    return F.greatest(F.lit(0.0), 1 - F.least(age, F.lit(1.0)))


def provenance(commit: Column, verified: Column) -> Column:
    """1 for a verified commit, 0.4 for a commit, else 0."""
    return F.when(commit.isNotNull() & verified.isNotNull(), 1.0).when(commit.isNotNull(), 0.4).otherwise(0.0)


def match_confidence(score: Column) -> Column:
    """The cosine clamped to 0..1 in single precision; 0 for null."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).cast("float")


def recall_fast(queries: DataFrame, lessons: DataFrame, config: RecallConfig, k: int = 10, min_score: float | None = None, **filters) -> DataFrame:
    """``(query_id, id, vec_score, rank)``: the ``k`` closest lessons, without a test of validity; ``min_score`` is applied after the limit."""
    seen = visible(lessons, config, validity=False, **filters).filter(vectors.usable("embedding", config.dim))
    asked = queries.filter(vectors.usable("v", config.dim)).select("query_id", "v")
    out = vectors.block_topk(asked, seen.select("id", F.col("embedding").alias("v")), k, config.dim).withColumnRenamed("score", "vec_score")
    return out if min_score is None else out.filter(match_confidence(F.col("vec_score")) >= F.lit(min_score).cast("float"))


def _texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, text_id)`` of the queries with a text, and ``(text_id, terms)``: queries of the same terms have one text."""
    asked = queries.filter("text is not null").select("query_id", F.array_sort(F.array_distinct(lexical.tokens(F.col("text")))).alias("terms"))
    asked = cut(asked.filter(F.size("terms") > 0))
    texts = cut(asked.groupBy("terms").agg(F.min("query_id").alias("text_id")))
    return asked.join(texts, "terms").select("query_id", "text_id"), texts.select("text_id", "terms")


def _split(lessons: DataFrame, *more: str | Column) -> DataFrame:
    """``(id, more..., a, b)``: the tokens of topic and text, in as few parts as there are tasks at once."""
    return vectors.parts(lessons.select("id", *more, lexical.joined(F.col("topic")).alias("a"), lexical.joined(F.col("lesson_text")).alias("b")))


def _known(texts: DataFrame, lessons: DataFrame) -> lexical.Texts:
    """A block of texts, ready to be matched; with texts of several terms the lessons are read for the terms' frequencies."""
    found = lexical.Texts(texts.toArrow())
    if not len(found.long):
        return found

    def count(batches):
        n = np.zeros(len(found.terms), np.int64)
        for b in batches:
            n += found.frequency(b.column("a"), b.column("b"))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["code", "n"])

    counts = _split(lessons).select("a", "b").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(len(found.terms), np.int64)
    frequency[counts.column("code").to_numpy()] = counts.column("n").to_numpy()
    return found.by_rarest(frequency)


#: Texts that travel to every task at once; with more, the lessons are read again for each block of them.
TEXTS = 32_768
#: Hits that a task gathers before it drops those behind the best.
HITS = 1 << 20


def text_hits(queries: DataFrame, lessons: DataFrame, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(query_id, text_id)`` of the queries with a text, and ``(text_id, id, bm25_score)``: the lessons that hold all its terms, by cover density.

    Queries of the same terms have one text, matched once. The lessons are matched where they lie, so neither their terms nor the
    matches are shuffled. With ``size`` each task gives only its ``size`` best of a text.
    """
    asked, texts = _texts(queries)
    blocks = -(-texts.count() // TEXTS)
    hits = None
    for i in range(blocks):
        known = _known(texts.filter(F.pmod(F.xxhash64("text_id"), F.lit(blocks)) == i), lessons)

        def match(batches, known=known):
            kept, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
            for b in batches:
                t, row, score = known.match(b.column("a"), b.column("b"))
                kept.append((t, b.column("id").to_numpy()[row], score))
                n += len(t)
                if size is None or n > HITS:
                    kept = [_best(*map(np.concatenate, zip(*kept, strict=True)), size)]
                    n = len(kept[0][0]) // 2
                if size is None:
                    yield _batch(kept.pop())
            if kept:
                yield _batch(_best(*map(np.concatenate, zip(*kept, strict=True)), size))

        found = _split(lessons).mapInArrow(match, HIT)
        hits = found if hits is None else hits.unionByName(found)
    return asked, lessons.sparkSession.createDataFrame([], HIT) if hits is None else hits


HIT = "text_id long, id long, bm25_score double"


def _best(text: np.ndarray, ids: np.ndarray, score: np.ndarray, size: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``size`` best hits of each text (all with None); ties go to the smaller id."""
    if size is None:
        return text, ids, score
    order = np.lexsort((ids, -score, text))
    text, ids, score = text[order], ids[order], score[order]
    first = np.arange(len(text)) - np.searchsorted(text, text) < size
    return text[first], ids[first], score[first]


def _batch(hits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in hits], names=["text_id", "id", "bm25_score"])


def text_pool(queries: DataFrame, lessons: DataFrame, size: int | None) -> DataFrame:
    """``(query_id, id, bm25_score)``: lessons that hold all terms of a query, by cover density, the best ``size`` of each query (all with None).

    The best are found once for all queries of the same terms.
    """
    # More than a task can hold is given whole.
    asked, hits = text_hits(queries, lessons, size if size is None or size <= vectors.KEPT else None)
    if size is not None:
        best = Window.partitionBy("text_id").orderBy(F.desc("bm25_score"), "id")
        hits = hits.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= size).drop("_r")
    return asked.join(hits, "text_id").select("query_id", "id", "bm25_score")


def fuse(pool: DataFrame, config: RecallConfig) -> DataFrame:
    """Adds ``n_candidates``, ``vec_rank``, ``bm25_rank`` and the fused ``rrf_score`` of each query's pool.

    Text ranks exist only for candidates with a text score; the others take the rank after the last.
    """
    q = Window.partitionBy("query_id")
    by_text = Window.partitionBy("query_id", F.col("bm25_score") > 0).orderBy(F.desc_nulls_last("bm25_score"))
    ranked = pool.withColumns({
        "n_candidates": F.count("*").over(q),
        "vec_rank": F.row_number().over(q.orderBy(F.desc_nulls_last("vec_score"), "id")),
        "bm25_rank": F.when(F.col("bm25_score") > 0, F.rank().over(by_text)),
    })
    k = float(config.rrf_k)
    terms = config.vec_weight / (k + F.col("vec_rank")) + config.bm25_weight / (k + F.coalesce("bm25_rank", F.col("n_candidates") + 1))
    return ranked.withColumn("rrf_score", terms + 1 / (k + 1) * (config.vec_weight * F.col("vec_score") + config.bm25_weight * F.col("bm25_score")))


#: What the final score takes from a lesson.
FACTS = ("importance", "confidence", "created_at", "commit_sha", "verified_at")


def _seen(lessons: DataFrame, config: RecallConfig, *more: str | Column, **filters) -> DataFrame:
    """``(id, topic, lesson_text, v, more...)`` of the visible lessons, ``v`` null unless usable. Each pass reads the columns it needs from ``lessons`` again, as all of them kept would be about as large as the table."""
    return visible(lessons, config, **filters).select("id", "topic", "lesson_text", F.when(vectors.usable("embedding", config.dim), F.col("embedding")).alias("v"), *more)


def pools(queries: DataFrame, lessons: DataFrame, edges: DataFrame | None, config: RecallConfig, k: int, seen: DataFrame | None = None, **filters) -> DataFrame:
    """``(query_id, id, vec_score, bm25_score, graph_score, key_overlap, retrieval_source)``: disjoint candidate pools of each query.

    ``seen`` are the visible lessons, where they are there already.
    """
    seen = _seen(lessons, config, **filters) if seen is None else seen
    good = seen.filter("v is not null").select("id", "v")
    asked = cut(queries.filter(vectors.usable("v", config.dim)).select("query_id", "v"))
    vec = vectors.block_topk(asked, good, max(4 * k, config.ef_search), config.dim).select("query_id", "id", F.col("score").alias("vec_score"))
    words = text_pool(queries, seen, max(4 * k, 40))
    if config.expand_weight > 0 or config.entity_weight > 0:
        vec, words = cut(vec), cut(words)
    # A candidate of the text pool alone still has a cosine where both vectors are usable, but ranks with 0.
    both = vec.withColumn("bm25_score", F.lit(None).cast("double")).unionByName(words.withColumn("vec_score", F.lit(None).cast("double"))).repartition("query_id")
    both = both.groupBy("query_id", "id").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("vec_score", "bm25_score")])
    none = {"graph_score": F.lit(0.0).cast("float"), "key_overlap": F.lit(0).cast("long")}
    out = both.withColumns(none | {"retrieval_source": F.lit("ann")})
    if config.expand_weight > 0 and edges is not None:
        top = Window.partitionBy("query_id").orderBy(F.desc("vec_score"), "id")
        anchors = vec.withColumn("_r", F.row_number().over(top)).filter(F.col("_r") <= config.expand_anchors).select("query_id", "id")
        reached = graph.expand(edges, anchors, config.expand_depth, config.expand_per_node).join(out.select("query_id", "id"), ["query_id", "id"], "left_anti")
        reached = _with_cosine(reached.join(seen.select("id"), "id", "left_semi"), asked, good)
        out = out.unionByName(reached.select("query_id", "id", "vec_score", F.lit(0.0).alias("bm25_score"), "graph_score", none["key_overlap"].alias("key_overlap"), F.lit("graph").alias("retrieval_source")))
    if config.entity_weight > 0:
        keys = queries.filter("text is not null").select("query_id", F.explode(text.entity_keys(F.col("text"))).alias("key"))
        named = graph.entity_candidates(lessons, keys, config.entity_min_overlap, config.entity_max_expansion).join(out.select("query_id", "id"), ["query_id", "id"], "left_anti")
        named = _with_cosine(named.join(seen.select("id"), "id", "left_semi"), asked, good)
        out = out.unionByName(named.select("query_id", "id", "vec_score", F.lit(0.0).alias("bm25_score"), none["graph_score"].alias("graph_score"), "key_overlap", F.lit("entity").alias("retrieval_source")))
    return out


def _with_cosine(pairs: DataFrame, asked: DataFrame, good: DataFrame) -> DataFrame:
    """Adds ``vec_score``: the cosine of each pair ``(query_id, id)``, 0 where a vector is not usable. The pairs are few."""
    joined = pairs.join(asked.select("query_id", F.col("v").alias("_q")), "query_id", "left").join(good.select("id", F.col("v").alias("_r")), "id", "left")
    return joined.withColumn("vec_score", F.coalesce(F.round(vectors.cosine("_q", "_r"), 12), F.lit(0.0))).drop("_q", "_r")


def recall_hybrid(queries: DataFrame, lessons: DataFrame, edges: DataFrame | None, config: RecallConfig, k: int = 10, min_score: float | None = None, **filters) -> DataFrame:
    """``(query_id, id, score, vec_score, bm25_score, rrf_score, match_confidence, retrieval_source, rank)``: the hybrid ranking of each query."""
    config = config.clamped()
    seen = _seen(lessons, config, *FACTS, **filters)
    fused = fuse(pools(queries, lessons, edges, config, k, seen), config)
    if config.graph_weight > 0 and edges is not None:
        fused = cut(fused)
    aux = (
        AUX["importance"] * F.col("importance") / 5.0
        + AUX["confidence"] * F.col("confidence").cast("double")
        + AUX["recency"] * recency(F.col("created_at"), config)
        + AUX["provenance"] * provenance(F.col("commit_sha"), F.col("verified_at"))
    )
    rows = fused.join(seen.select("id", (AUX_SCALE * aux + config.confidence_boost * (F.col("confidence").cast("double") - 0.5)).alias("aux")), "id")
    score = F.col("rrf_score") + F.col("aux")
    score = score + config.expand_weight * F.col("graph_score").cast("double") + config.entity_weight * F.col("key_overlap")
    if config.graph_weight > 0 and edges is not None:
        first = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "id")
        anchors = fused.withColumn("_r", F.row_number().over(first)).filter("_r <= 5").select("query_id", "id")
        rows = rows.join(graph.proximity(edges, anchors, ["causal", "temporal"]), ["query_id", "id"], "left")
        score = score * (1 + config.graph_weight * F.coalesce("proximity", F.lit(0.0)))
    rows = rows.withColumns({"score": score, "match_confidence": match_confidence(F.col("vec_score"))})
    if min_score is not None:
        rows = rows.filter(F.col("match_confidence") >= F.lit(min_score).cast("float"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", "vec_score", "bm25_score", "rrf_score", "match_confidence", "retrieval_source", "rank")


#: Weight of the text score on the vector path.
TEXT_WEIGHT = 0.1


def recall_vectors(queries: DataFrame, lessons: DataFrame, edges: DataFrame | None, config: RecallConfig, k: int = 10, min_score: float | None = None, **filters) -> DataFrame:
    """``(query_id, id, score, vec_score, rank)``: the vector path, ``(cosine + weighted recency) * (1 + proximity) + 0.1 * text score``, without a test of validity.

    Every visible lesson is scored. The blocks rank all by cosine, recency and text score at once, as if near no
    anchor; those near one are scored apart and compete with the others.
    A query with a text also ranks lessons without a usable vector, at cosine 0.
    """
    config = config.clamped()
    gain = config.recency_weight * config.temporal_boost
    seen = _seen(lessons, config, (gain * recency(F.col("created_at"), config)).alias("fresh"), validity=False, **filters)
    asked = cut(queries.withColumn("v", F.when(vectors.usable("v", config.dim), F.col("v"))).select("query_id", "v", "text"))
    links, texts = _texts(asked)
    asked = cut(asked.join(links, "query_id", "left").select("query_id", "v", "text", "text_id"))
    rows = vectors.block_topk_hits(asked, _split(seen, "v", F.col("fresh").alias("bias")), lambda mine: _known(mine.select("text_id").distinct().join(texts, "text_id"), seen), k, config.dim, TEXT_WEIGHT, min_score)
    if config.graph_weight > 0 and edges is not None:
        good = seen.filter("v is not null").select("id", "v")
        anchors = vectors.block_topk(asked.filter("v is not null"), good, 5, config.dim).select("query_id", "id")
        near = cut(graph.proximity(edges, anchors, ["causal", "temporal"]).join(seen.select("id"), "id", "left_semi"))
        scored = _with_cosine(near, asked.filter("v is not null"), good).join(seen.select("id", "fresh"), "id")
        hits = text_hits(asked, seen)[1].withColumn("ft", F.col("bm25_score") / (1 - F.col("bm25_score")))
        scored = scored.join(asked.select("query_id", "text_id"), "query_id").join(hits, ["text_id", "id"], "left")
        score = (F.col("vec_score") + F.col("fresh")) * (1 + config.graph_weight * F.col("proximity")) + TEXT_WEIGHT * F.coalesce("ft", F.lit(0.0))
        scored = scored.withColumn("score", score).select("query_id", "id", "score", "vec_score")
        if min_score is not None:
            scored = scored.filter(match_confidence(F.col("vec_score")) >= F.lit(min_score).cast("float"))
        rows = rows.join(near.select("query_id", "id"), ["query_id", "id"], "left_anti").unionByName(scored)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("score", 11)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "vec_score", "rank")


def recall_lessons(queries: DataFrame, lessons: DataFrame, edges: DataFrame | None, config: RecallConfig, k: int = 10, hybrid: bool = True, min_score: float | None = None, **filters) -> DataFrame:
    """The router: queries with vector and text, or with a text alone, take the hybrid path (unless switched off), the others the vector path."""
    texted = F.col("text").isNotNull() if hybrid else F.lit(False)
    a = recall_hybrid(queries.filter(texted), lessons, edges, config, k, min_score, **filters).select("query_id", "id", "score", "vec_score", "rank")
    return a.unionByName(recall_vectors(queries.filter(~texted), lessons, edges, config, k, min_score, **filters))


def recall_situation(lessons: DataFrame, situation: str, config: RecallConfig, k: int = 10, role: str | None = None, project: int | None = None) -> DataFrame:
    """The newest typed lessons of a situation."""
    seen = visible(lessons, config, role=role, project=project).filter("content_type is not null")
    return seen.filter(text.situation_key(F.col("topic"), F.col("lesson_text")) == situation).orderBy(F.desc("created_at"), "id").limit(k)


def recall_entity(lessons: DataFrame, key: str, config: RecallConfig, k: int = 10) -> DataFrame:
    """The most important, newest lessons that carry an entity key."""
    keys = F.from_json(F.get_json_object("metadata", "$.entity_keys"), "array<string>")
    return visible(lessons, config).withColumn("keys", keys).filter(F.array_contains("keys", key)).orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("created_at"), "id").limit(k)
