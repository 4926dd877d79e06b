"""The write path as batch transforms: gates, enrichment, versions, facts, events and relations.

Each function takes immutable frames and returns new ones; order within a key is ``(created_at, id)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.config import OPEN
from lorekeep.functions import text
from lorekeep.operators import vectors
from lorekeep.session import cut

NEAR_DUPLICATE = 0.98


def versions(lessons: DataFrame) -> DataFrame:
    """Re-derives validity: a version ends where the next of its content hash begins; the last stays open.

    A content hash's versions are few by nature (one record's history), so its window is small.
    """
    order = Window.partitionBy("content_hash").orderBy("created_at", "id")
    begin = F.coalesce("created_at", "t_valid_from")
    return lessons.withColumns({"t_valid_from": begin, "t_valid_to": F.coalesce(F.lead("created_at").over(order), F.lit(OPEN))})


def near_duplicates_of(batch: DataFrame, lessons: DataFrame, dim: int) -> DataFrame:
    """``(id, existing_id, similarity)``: the open lesson of the same project closest to each new one, above the guard.

    A null project never matches. The batch meets the lessons in blocks, so a large project costs no more than its share.
    """
    old = lessons.filter(F.col("is_active") & (F.col("t_valid_to") == F.lit(OPEN)) & F.col("project_id").isNotNull() & vectors.usable("embedding", dim))
    new = batch.filter(F.col("project_id").isNotNull() & vectors.usable("embedding", dim))
    of = lambda rows: rows.select("id", F.col("project_id").alias("g"), F.col("embedding").alias("v"))
    found = vectors.block_above(of(new), of(old), NEAR_DUPLICATE, dim).filter("id <> query_id")
    close = found.select(F.col("query_id").alias("id"), F.col("id").alias("existing_id"), F.col("score").alias("similarity"))
    return close.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("existing_id")).alias("e"))).alias("b")).select("id", (-F.col("b.e")).alias("existing_id"), "b.similarity")


def enrich(batch: DataFrame) -> DataFrame:
    """Adds the content type (where missing), entity keys in the metadata, the content hash and the quality verdict."""
    keys = text.entity_keys(F.col("lesson_text"))
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    with_keys = F.when(F.size(keys) > 0, F.map_concat(F.map_filter(meta, lambda k, _: k != "entity_keys"), F.create_map(F.lit("entity_keys"), F.to_json(keys)))).otherwise(meta)
    return batch.withColumns({
        "content_type": F.coalesce("content_type", text.classify_content_type(F.col("lesson_text"))),
        "metadata": F.to_json(with_keys),
        "content_hash": text.content_hash(F.col("role"), F.col("topic"), F.col("commit_sha"), F.col("artifact_hash")),
        "rejected": text.quality_error(F.col("lesson_text")),
    })


def ingest(batch: DataFrame, lessons: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """``(accepted, refused)``: the batch's good rows, enriched; and ``(id, reason, existing_id)`` of the others.

    Refused are short or repetitive texts, vectors of another dimension, and near duplicates of an open lesson.
    """
    rich = enrich(batch).withColumn("rejected", F.coalesce("rejected", F.when(F.col("embedding").isNotNull() & (F.size("embedding") != dim), "dimension")))
    # A verdict depends on these alone, so it holds for each row of the id that has them.
    rich = rich.withColumn("_k", F.xxhash64("lesson_text", F.size("embedding")))
    # The gates over the texts are dear, so they run once; kept are the verdicts and the vectors, not the texts.
    judged = cut(rich.select("id", "_k", "rejected", "project_id", "embedding"))
    twins = cut(near_duplicates_of(judged.filter("rejected is null"), lessons, dim))
    refused = judged.filter("rejected is not null").select("id", F.col("rejected").alias("reason"), F.lit(None).cast("long").alias("existing_id"))
    refused = refused.unionByName(twins.select("id", F.lit("near_duplicate").alias("reason"), "existing_id"))
    gone = judged.filter("rejected is not null").unionByName(judged.join(twins.select("id"), "id", "left_semi"))
    gone = gone.select(F.col("id").alias("_id"), F.col("_k").alias("_gone")).distinct()
    left = rich.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_gone")), "left_anti")
    return left.drop("rejected", "_k"), refused


def fact_versions(facts: DataFrame) -> DataFrame:
    """``(entity, property, version, value, confidence, first_id)``: equal consecutive values merge, a change starts a version.

    ``facts`` is ``(id, entity, property, value, confidence, at)``; names match whatever their case. The
    merged confidence is the greatest.
    """
    keyed = facts.withColumns({"entity": F.lower("entity"), "property": F.lower("property")})
    order = Window.partitionBy("entity", "property").orderBy("at", "id")
    before = F.lag("value").over(order)
    marked = keyed.withColumn("change", F.when(F.lag("id").over(order).isNotNull() & before.eqNullSafe(F.col("value")), 0).otherwise(1))
    numbered = marked.withColumn("version", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("entity", "property", "version").agg(F.first("value").alias("value"), F.max("confidence").alias("confidence"), F.min(F.struct("at", "id")).alias("f")).select("entity", "property", "version", "value", "confidence", F.col("f.id").alias("first_id"))


def first_events(events: DataFrame, name: str, project: str, at: str) -> DataFrame:
    """The first event of each name (whatever its case) and project; repeated ones change nothing."""
    rest = [c for c in events.columns if c not in (name, project)]
    keyed = events.withColumn(name, F.lower(name))
    best = keyed.groupBy(name, project).agg(F.min(F.struct(at, "id", *[c for c in rest if c not in (at, "id")])).alias("b"))
    return best.select(name, project, *[F.col(f"b.{c}").alias(c) for c in rest])


def merge_relations(edges: DataFrame) -> DataFrame:
    """``(source_id, target_id, relation_type, confidence, times)``: one row per triple with the greatest confidence."""
    return edges.groupBy("source_id", "target_id", F.upper("relation_type").alias("relation_type")).agg(F.max("weight").alias("confidence"), F.count("*").alias("times"))


def reembed(lessons: DataFrame, vectors_: DataFrame, dim: int) -> DataFrame:
    """Replaces vectors by ``vectors_(id, v)`` of the right dimension; unknown ids are skipped, null leaves the old one."""
    new = vectors_.filter(F.size("v") == dim).dropDuplicates(["id"])
    return lessons.join(new, "id", "left").withColumn("embedding", F.coalesce("v", "embedding")).drop("v")


def recompute_content(lessons: DataFrame, texts: DataFrame) -> DataFrame:
    """Replaces texts by ``texts(id, new_text)`` and counts the version and the patch."""
    hit = F.col("new_text").isNotNull().cast("int")
    joined = lessons.join(texts.dropDuplicates(["id"]), "id", "left")
    return joined.withColumns({"lesson_text": F.coalesce("new_text", "lesson_text"), "version_n": F.col("version_n") + hit, "patch_count": F.col("patch_count") + hit}).drop("new_text")
