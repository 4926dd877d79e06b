"""Files in and out, imports, places, streams and rewrites on small inputs."""

import json
from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from lorekeep.config import OPEN
from lorekeep.functions import sql
from lorekeep.operators import navigate, vectors, writes
from lorekeep.sources import files
from lorekeep.streaming import streams

T = datetime(2026, 1, 1)


def test_runs_csv(spark, tmp_path):
    path = tmp_path / "runs.csv"
    path.write_text("run_id,arm,week,outcome,turns,cost_usd,retrieved_count,mean_cosine\n1,A,1,success,3,0.5,4,\n2,B,1,,2,0.25,0,0.5\n")
    rows = files.runs_csv(spark, str(path)).orderBy("run_id").collect()
    assert (rows[0].arm, rows[0].mean_cosine, rows[1].outcome, rows[1].cost_usd) == ("A", None, None, 0.25)


def test_sessions_json(spark, tmp_path):
    path = tmp_path / "sessions.json"
    turns = [[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [{"role": "user", "content": "c"}], []]
    path.write_text(json.dumps([{"question_id": "q", "question": "?", "answer": "!", "haystack_sessions": turns, "haystack_session_ids": ["s1", "s2", "s3"]}]))
    got = [tuple(r) for r in files.sessions_json(spark, str(path)).orderBy("session_id", "turn").collect()]
    assert got == [("q", "s1", 0, "user", "a"), ("q", "s1", 1, "assistant", "b"), ("q", "s2", 0, "user", "c")]


def test_export_and_import(spark, tmp_path):
    lessons = spark.createDataFrame([(1, "r", "t", "x", "draft", "note", T), (2, "r", "u", "y", "draft", "fact", T)], "id long, role string, topic string, lesson_text string, state string, item_kind string, created_at timestamp")
    files.export_markdown(lessons, str(tmp_path / "md"))
    text = "\n".join(p.read_text() for p in (tmp_path / "md").rglob("*.txt"))
    assert "## t\n\nx" in text and "## u\n\ny" in text and {p.name for p in (tmp_path / "md").glob("item_kind=*")} == {"item_kind=note", "item_kind=fact"}
    schema = "agent_role string, memory_text string, layer string, priority int, created_at timestamp, ttl_seconds int, git_sha string"
    external = spark.createDataFrame([("r", "x", "semantic", 10, T, None, None), ("r", "z", "Procedural", 3, T, 60, "abc"), ("r", "w", None, None, T, None, None)], schema)
    got = {r.lesson_text: r for r in files.import_memory(external, lessons).collect()}
    assert set(got) == {"z", "w"} and got["z"].item_kind == "procedure" and got["z"].importance == 2 and got["z"].expires_at == T + timedelta(seconds=60)
    assert got["w"].item_kind == "note" and got["w"].expires_at is None


def test_rewrites(spark):
    lessons = spark.createDataFrame([(1, [1.0, 0.0], "a", 1, 0), (2, [0.0, 1.0], "b", 1, 0)], "id long, embedding array<float>, lesson_text string, version_n int, patch_count int")
    new = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0]), (9, [1.0, 1.0])], "id long, v array<float>")
    assert {r.id: r.embedding for r in writes.reembed(lessons, new, 2).collect()} == {1: [0.5, 0.5], 2: [0.0, 1.0]}
    texts = spark.createDataFrame([(2, "c")], "id long, new_text string")
    assert {r.id: (r.lesson_text, r.version_n, r.patch_count) for r in writes.recompute_content(lessons, texts).collect()} == {1: ("a", 1, 0), 2: ("c", 2, 1)}
    assert lessons.select(vectors.pad("embedding", 4).alias("v")).first().v == [1.0, 0.0, 0.0, 0.0]


def test_places(spark):
    a = spark.createDataFrame([(1, 52.52, 13.405), (2, None, 1.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([(7, 52.5, 13.4), (8, 48.85, 2.35)], "id long, lat double, lon double")
    near = navigate.within_km(a, b, 10).collect()
    assert [(r.a_id, r.b_id) for r in near] == [(1, 7)] and near[0].km == pytest.approx(2.25, abs=0.05)


def test_sql_functions(spark):
    sql.register(spark, "/root/testdata/sf0.001")
    got = spark.sql("select confidence_posterior(3, 0) as p, edge_kind('caused_by') as k, token_cost('') as c, match_confidence(1.5D) as m, vector_cosine(array(1f, 0f), array(0f, 0f)) as v, (select count(*) from lesson) as n").first()
    assert (got.p, got.k, got.c, got.m, got.v) == (0.8, "causal", 1, 1.0, None) and got.n > 0


def test_streams(spark, tmp_path):
    at = [(1, "s", T), (2, "s", T + timedelta(minutes=10)), (3, "s", T + timedelta(minutes=90)), (4, None, T)]
    spark.createDataFrame(at, "id long, s string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: streams.source(spark, str(tmp_path / "e"))
    pairs = streams.drain(streams.co_occurrences(read(), read()), f"pairs-{uuid4().hex}")
    assert [(r.source_id, r.target_id) for r in pairs.collect()] == [(1, 2)]
    kept = streams.unexpired(read().withColumns({"created_at": F.col("at"), "expires_at": F.when(F.col("id") == 1, F.col("at")).when(F.col("id") == 2, F.lit(OPEN))}))
    assert sorted(r.id for r in streams.drain(kept, f"kept-{uuid4().hex}").collect()) == [2, 3, 4]
    once = streams.first_to_table(read().unionByName(read()), ["s"], f"once-{uuid4().hex}")
    assert sorted(map(str, (r.s for r in once.collect()))) == ["None", "s"]
    late = streams.first_events(read(), ["s"], "at")
    assert streams.drain(late, f"late-{uuid4().hex}").count() == 2


def test_small_functions(spark):
    from lorekeep.config import RecallConfig
    from lorekeep.functions import text
    from lorekeep.operators import graph, lifecycle, visibility

    one = spark.createDataFrame([("person:a_b", "q1", "multi-session", '{"a": null}'), ("person:A", "q2_abs", "multi-session", "[1]"), (None, "q3", "new", None)], "k string, q string, kind string, j string")
    rows = one.select(text.valid_slug(F.col("k")).alias("ok"), text.question_category(F.col("q"), F.col("kind")).alias("c"), visibility.json_has("j", "a").alias("has")).collect()
    assert [tuple(r) for r in rows] == [(True, "multi_session_user", True), (False, "multi_session_topic_absent", False), (False, "single_session_user", False)]
    lessons = spark.createDataFrame([(1, T, OPEN, "draft", True, "entity", [1.0]), (2, T, OPEN, "draft", True, None, [1.0])], "id long, updated_at timestamp, t_valid_to timestamp, state string, is_active boolean, content_type string, embedding array<float>")
    gone = {r.id: (r.state, r.is_active, r.t_valid_to) for r in lifecycle.evict(lessons, lessons.filter("id = 1").select("id"), RecallConfig(now=T)).collect()}
    assert gone == {1: ("superseded", False, T), 2: ("draft", True, OPEN)}
    assert {r.id: r.embedding for r in lifecycle.apply_embedding_policy(lessons).collect()} == {1: None, 2: [1.0]}
    assert lifecycle.counts_json(lessons, "content_type").first().counts == '{"entity":1}'
    edges = spark.createDataFrame([(1, 1, 2, "a", '{"x": 1, "y": 1}', T), (2, 1, 2, "A", '{"x": 2}', T + timedelta(1)), (3, 3, 4, "a", None, T)], "id long, source_id long, target_id long, relation_type string, metadata string, updated_at timestamp").withColumn("valid_until", F.lit(None).cast("timestamp"))
    assert {r.source_id: r.metadata for r in graph.merged_metadata(edges).collect()} == {1: '{"x":"2","y":"1"}', 3: None}
