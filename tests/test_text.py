"""Golden pairs of the text functions."""

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import lexical, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "kind"),
    [
        ("root cause of the failure: DB connection timed out and crashed the service.", "incident"),
        ("We decided to use psycopg2 instead of asyncpg because synchronous was sufficient.", "decision"),
        ("The agency-v3-next container is the canonical service for all new task dispatch.", "entity"),
        ("When submitting a bugfix PR, always add a test.", "procedure"),
        ("The PR was rejected for having typos", None),
        ("The retry limit defaults to five.", "fact"),
        ("éfailed caused", None),
        ("", None),
        (None, None),
    ],
)
def test_classify(spark, given, kind):
    assert one(spark, text.classify_content_type(F.col("t")), t=given) == kind


@pytest.mark.parametrize(
    ("given", "keys"),
    [
        ("The model claude-sonnet-4-6 is the default for dispatch in v3-next.", ["model:claude-sonnet-4-6"]),
        ("The bug was in apps/v3-next/routes/tasks.py line 42 causing a 500 error.", ["file:apps/v3-next/routes/tasks.py"]),
        ("The PHANTOM_DONE bug caused tasks to be marked complete without real commits.", ["failure:PHANTOM_DONE"]),
        ("Read auth.users before src/readme.md", ["schema:auth.users"]),
        ("plain prose", []),
        (None, None),
    ],
)
def test_entity_keys(spark, given, keys):
    assert one(spark, text.entity_keys(F.col("t")), t=given) == keys


@pytest.mark.parametrize(
    ("topic", "body", "key"),
    [
        ("[INCIDENT:deploy_gap] after release", None, "class=deploy_gap"),
        ("x", "failure_class=INFRA_AUTH_INVALID then outcome=ESCALATED", "class=INFRA_AUTH_INVALID|outcome=ESCALATED"),
        (None, "failure_class=A1", "class=A1"),
        ("x", "outcome=COMPLETED", "class=completed"),
        ("x", "nothing", None),
    ],
)
def test_situation(spark, topic, body, key):
    assert one(spark, text.situation_key(F.col("a"), F.col("b")), a=topic, b=body) == key


def test_slug_quality_and_kind(spark):
    assert one(spark, text.canonical_slug(F.lit("org"), F.col("t")), t="  Ünder & Co. ") == "org:nder_co"
    assert one(spark, text.canonical_slug(F.lit("nope"), F.col("t")), t="a") is None
    assert len(one(spark, text.canonical_slug(F.lit("org"), F.col("t")), t="word_" * 30)) <= 68
    assert one(spark, text.quality_error(F.col("t")), t="short") == "too_short"
    assert one(spark, text.quality_error(F.col("t")), t="again " * 9 + "once") == "repetitive"
    assert one(spark, text.quality_error(F.col("t")), t="a good text with several words") is None
    assert one(spark, text.edge_kind(F.col("t")), t="PART_OF") == "entity"
    assert one(spark, text.token_cost(F.col("t")), t="") == 1


def test_query_parser():
    q = lexical.parse_query('root "cause found" or incident -weekly')
    assert q == {"groups": [[["root"]], [["cause", "found"], ["incident"]]], "without": [["weekly"]]}


def test_cover_density(spark):
    docs = spark.createDataFrame([(1, "root", "the cause"), (2, "none", "root of it and cause"), (3, "x", "cause weekly root"), (4, None, None)], "id long, t string, b string")
    got = {r.id: r.score for r in lexical.cover_density(docs, "id", "t", "b", "root cause -weekly", normalise=False).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    single = {r.id: r.score for r in lexical.cover_density(docs, "id", "t", "b", "root", normalise=False).collect()}
    assert single == {1: 1.0, 2: pytest.approx(0.4), 3: pytest.approx(0.4)}
