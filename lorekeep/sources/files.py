"""Other sources and sinks: CSV run tables, nested JSON conversations, Markdown export, table imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "run_id int, arm string, week int, outcome string, turns int, cost_usd double, retrieved_count int, mean_cosine double"


def runs_csv(spark: SparkSession, path: str) -> DataFrame:
    """An A/B run table with a header, by its explicit schema."""
    return spark.read.csv(path, header=True, schema=RUNS)


def sessions_json(spark: SparkSession, path: str) -> DataFrame:
    """``(question_id, session_id, turn, role, content)``: nested haystack sessions flattened to turns."""
    schema = "question_id string, question string, answer string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>"
    raw = spark.read.json(path, multiLine=True, schema=schema)
    zipped = raw.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("z"))
    turns = zipped.select("question_id", F.col("z.haystack_session_ids").alias("session_id"), F.posexplode("z.haystack_sessions").alias("turn", "t"))
    return turns.select("question_id", "session_id", "turn", "t.role", "t.content")


def markdown_blocks(lessons: DataFrame) -> DataFrame:
    """``(item_kind, id, block)``: each lesson as a block with YAML front matter."""
    front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("id")), F.concat(F.lit("role: "), F.col("role")), F.concat(F.lit("state: "), F.col("state")), F.lit("---"))
    body = F.concat(F.lit("## "), F.col("topic"), F.lit("\n\n"), F.col("lesson_text"))
    return lessons.select("item_kind", "id", "created_at", F.concat(front, F.lit("\n"), body, F.lit("\n")).alias("block"))


def export_markdown(lessons: DataFrame, path: str) -> None:
    """Writes the blocks as text, one folder per kind, in order of creation within each file."""
    blocks = markdown_blocks(lessons).repartition("item_kind", F.month("created_at")).sortWithinPartitions("item_kind", "created_at", "id")
    blocks.select("item_kind", F.col("block").alias("value")).write.mode("overwrite").partitionBy("item_kind").text(path)


def import_memory(external: DataFrame, lessons: DataFrame) -> DataFrame:
    """Rows of an external memory table in this model, without those whose role and text are here already.

    Priority 0..10 becomes importance 1..5, the time to live becomes an expiry.
    """
    kinds = {"episodic": "event", "semantic": "fact", "procedural": "procedure"}
    kind = F.lit("note")
    for a, b in kinds.items():
        kind = F.when(F.lower("layer") == a, b).otherwise(kind)
    rows = external.select(
        F.col("agent_role").alias("role"),
        F.col("memory_text").alias("lesson_text"),
        kind.alias("item_kind"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.round(F.col("priority") / 2.0))).cast("short").alias("importance"),
        (F.col("created_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)"))).alias("expires_at"),
        F.col("git_sha").alias("commit_sha"),
        "created_at",
    )
    return rows.join(lessons.select("role", "lesson_text"), ["role", "lesson_text"], "left_anti")
