"""Which lessons a reader may see: activity, verification, filters, validity and tenancy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.config import OPEN, RecallConfig


def visible(
    lessons: DataFrame,
    config: RecallConfig,
    role: str | None = None,
    project: int | None = None,
    exclude_dag: str | None = None,
    types: list[str] | None = None,
    validity: bool = True,
) -> DataFrame:
    """The lessons that pass the standard predicate; an argument of None adds no predicate, so the rest is pushed down."""
    out = lessons.filter("is_active")
    if not config.include_unverified:
        out = out.filter("verified_at is not null")
    if role is not None:
        out = out.filter(F.col("role") == role)
    if project is not None:
        out = out.filter(F.col("project_id") == project)
    if exclude_dag is not None:
        out = out.filter(~F.col("source_dag_id").eqNullSafe(F.lit(exclude_dag)))
    if types is not None:
        out = out.filter(F.col("content_type").isin(*types))
    if validity:
        out = current_items(out) if config.as_of is None else as_of(out, config.as_of)
    return tenant_rows(out, config.tenant)


def current_items(lessons: DataFrame) -> DataFrame:
    """Versions whose validity is open."""
    return lessons.filter(F.col("t_valid_to") == F.lit(OPEN))


def as_of(lessons: DataFrame, at: datetime) -> DataFrame:
    """Versions valid at a time: from inclusive, to exclusive."""
    return lessons.filter((F.col("t_valid_from") <= F.lit(at)) & (F.col("t_valid_to") > F.lit(at)))


def tenant_rows(lessons: DataFrame, tenant: str) -> DataFrame:
    """A tenant's rows; an empty tenant sees all."""
    return lessons if not tenant else lessons.filter(F.col("project_id").cast("string") == tenant)


def tenant_edges(edges: DataFrame, lessons: DataFrame, tenant: str) -> DataFrame:
    """Edges with at least one endpoint among the tenant's rows, each once."""
    if not tenant:
        return edges
    own = tenant_rows(lessons, tenant).select(F.col("id").alias("_own")).distinct()
    a = edges.join(own, F.col("source_id") == F.col("_own"), "left_semi")
    b = edges.join(own, F.col("source_id") == F.col("_own"), "left_anti").join(own, F.col("target_id") == F.col("_own"), "left_semi")
    return a.unionByName(b)


def json_contains(column: str, wanted: dict, path: str = "$"):
    """Whether a JSON text holds all of a nested dict (values compared as text; lists must contain each element)."""
    out = F.lit(True)
    for k, v in wanted.items():
        at = f"{path}.{k}"
        if isinstance(v, dict):
            out = out & json_contains(column, v, at)
        elif isinstance(v, list):
            have = F.from_json(F.get_json_object(column, at), "array<string>")
            for x in v:
                out = out & F.array_contains(have, str(x))
        else:
            out = out & (F.get_json_object(column, at) == (str(v).lower() if isinstance(v, bool) else str(v)))
    return F.coalesce(out, F.lit(False))


def json_has(column: str, key: str):
    """Whether a JSON text is an object with the key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))
