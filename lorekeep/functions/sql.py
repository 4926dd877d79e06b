"""The engine's scalar functions and views for users of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lorekeep.functions import text
from lorekeep.sources.tables import current_lessons, table


def _named(relations: tuple[str, ...]) -> str:
    return ", ".join(f"'{r}'" for r in relations)


#: Name, parameters, result and body of each function; they are inlined by the optimiser.
FUNCTIONS = (
    ("confidence_posterior", "s DOUBLE, f DOUBLE", "DOUBLE", "(s + 1.0D) / (s + f + 2.0D)"),
    ("match_confidence", "score DOUBLE", "FLOAT", "cast(least(1.0D, greatest(0.0D, score)) as float)"),
    ("provenance_score", "commit_sha STRING, verified_at TIMESTAMP", "DOUBLE", "case when commit_sha is null then 0.0D when verified_at is null then 0.4D else 1.0D end"),
    ("recency_score", "created_at TIMESTAMP, at TIMESTAMP, days DOUBLE", "DOUBLE", "greatest(0.0D, 1 - least((unix_micros(at) - unix_micros(created_at)) / 1e6D / (days * 86400), 1.0D))"),
    ("edge_kind", "relation STRING", "STRING", "case " + " ".join(f"when upper(relation) in ({_named(names)}) then '{kind}'" for kind, names in text.EDGE_KINDS.items()) + " else 'semantic' end"),
    ("token_cost", "t STRING", "BIGINT", "greatest(1L, ceil(octet_length(t) / 4.0D))"),
    ("content_hash", "role STRING, topic STRING, commit_sha STRING, artifact STRING", "STRING", "md5(concat(coalesce(role, ''), '|', coalesce(topic, ''), '|', coalesce(commit_sha, artifact, '')))"),
    ("vector_cosine", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
     "try_divide(aggregate(zip_with(a, b, (x, y) -> cast(x as double) * y), 0.0D, (s, v) -> s + v), "
     "sqrt(aggregate(a, 0.0D, (s, v) -> s + cast(v as double) * v)) * sqrt(aggregate(b, 0.0D, (s, v) -> s + cast(v as double) * v)))"),
)


def register(spark: SparkSession, base: str | None = None) -> None:
    """Registers the functions, and with ``base`` the views ``lesson`` (current rows), ``edge`` and ``ingest_log``, for this session."""
    for name, takes, gives, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    if base:
        columns = [c for c in table(spark, base, "agent_lesson").columns if c not in ("id", "updated_at")]
        current_lessons(spark, base, *columns).createOrReplaceTempView("lesson")
        table(spark, base, "mem_edge").distinct().createOrReplaceTempView("edge")
        table(spark, base, "memory_ingest_log").createOrReplaceTempView("ingest_log")
