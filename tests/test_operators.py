"""Scenarios of the core operators on small frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lorekeep.config import OPEN, RecallConfig
from lorekeep.operators import evaluation, graph, lifecycle, navigate, retrieval, skew, vectors, visibility, writes
from lorekeep.sources.tables import latest

T = datetime(2026, 1, 1)
SCHEMA = (
    "id long, updated_at timestamp, created_at timestamp, role string, project_id int, topic string, lesson_text string, importance short, metadata string, "
    "commit_sha string, artifact_hash string, verified_at timestamp, embedding array<float>, is_active boolean, content_type string, source_dag_id string, state string, "
    "t_valid_from timestamp, t_valid_to timestamp, confidence float, recall_count long, evidence_count int, content_hash string, item_kind string, version_n int, patch_count int"
)


def lesson(i, **kw):
    row = dict(
        id=i, updated_at=T, created_at=T + timedelta(minutes=i), role="r", project_id=1, topic=f"topic {i}", lesson_text=f"text of lesson {i}", importance=3, metadata="{}",
        commit_sha=None, artifact_hash=None, verified_at=T, embedding=[1.0, 0.0, 0.0, 0.0], is_active=True, content_type=None, source_dag_id=None, state="draft",
        t_valid_from=T, t_valid_to=OPEN, confidence=0.5, recall_count=0, evidence_count=1, content_hash=f"h{i}", item_kind="note", version_n=1, patch_count=0,
    )
    return tuple((row | kw).values())


def lessons(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_latest_keeps_one_row_and_survives_nulls(spark):
    df = spark.createDataFrame([(1, T, "a"), (1, T + timedelta(1), "b"), (1, None, "c"), (2, None, None), (2, None, None)], "id long, at timestamp, x string")
    assert sorted((r.id, r.x) for r in latest(df, ["id"], "at").collect()) == [(1, "b"), (2, None)]
    assert latest(df.limit(0), ["id"], "at").count() == 0


def test_visibility(spark):
    df = lessons(spark, lesson(1), lesson(2, is_active=False), lesson(3, verified_at=None), lesson(4, source_dag_id="d"), lesson(5, t_valid_to=T), lesson(6, project_id=2))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(visibility.visible(df, RecallConfig())) == [1, 4, 6]
    assert ids(visibility.visible(df, RecallConfig(), exclude_dag="d")) == [1, 6]
    assert ids(visibility.visible(df, RecallConfig(include_unverified=True), project=1)) == [1, 3, 4]
    assert ids(visibility.visible(df, RecallConfig(tenant="2"))) == [6]


def test_skewed_join_and_ranks_match_plain_ones(spark):
    rows = spark.range(3000).select((F.col("id") % 100 * (F.col("id") % 3 > 0).cast("int")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.lookup_join(rows, table, ["k"], "n", 3000)
    assert got.count() == 3000 and got.join(table.withColumnRenamed("n", "m"), "k").filter("n <> m").count() == 0
    counts = rows.groupBy("k").agg(F.count("*").alias("c")).withColumn("g", F.lit(1))
    ranked = skew.running_sum(counts, ["g"], "k", "c", "before").collect()
    plain = {r.k: r.c for r in counts.collect()}
    assert all(r.before == sum(c for k, c in plain.items() if k > r.k) for r in ranked) and len(ranked) == len(plain)


def test_block_topk_is_exact_and_breaks_ties_by_id(spark):
    records = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0, 0.0]) for i in range(12)], "id long, v array<float>")
    asked = spark.createDataFrame([(7, [2.0, 1.0, 0.0, 0.0])], "query_id long, v array<float>")
    got = vectors.block_topk(asked, records, 5, 4).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 5, 8, 11, 1]
    assert vectors.block_topk(asked, records.limit(0), 5, 4).count() == 0


def test_hybrid_ranks_and_text_pool(spark):
    df = lessons(spark, lesson(1, topic="alpha"), lesson(2, embedding=[0.0, 1.0, 0.0, 0.0], topic="alpha beta"), lesson(3, embedding=None, topic="beta"), lesson(4, embedding=[0.0] * 4, topic="none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "beta"), (2, None, "alpha beta"), (3, [0.0, 1.0, 0.0, 0.0], None)], "query_id long, v array<float>, text string")
    config = RecallConfig(dim=4, now=T)
    got = {(r.query_id, r.id): r for r in retrieval.recall_hybrid(asked, df, None, config, 10).collect()}
    assert {k for k in got if k[0] == 2} == {(2, 2)}
    assert {k for k in got if k[0] == 1} == {(1, 1), (1, 2), (1, 3)}
    assert got[1, 1].vec_score == pytest.approx(1.0) and got[1, 3].vec_score == 0.0
    pools = retrieval.fuse(retrieval.pools(asked, df, None, config, 10), config).filter("query_id = 1").collect()
    ranks = {r.id: (r.vec_rank, r.bm25_rank) for r in pools}
    assert ranks[1] == (1, None) and ranks[2][1] is not None and ranks[3][1] is not None


def test_expansion_is_disjoint_and_ends_on_cycles(spark):
    df = lessons(spark, *[lesson(i, embedding=[1.0, 0.0, 0.0, 0.0] if i == 1 else None) for i in range(1, 5)])
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.5)], "source_id long, target_id long, weight float").withColumns({"valid_until": F.lit(None).cast("timestamp"), "edge_kind": F.lit("causal")})
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], None)], "query_id long, v array<float>, text string")
    rows = retrieval.recall_hybrid(asked, df, edges, RecallConfig(dim=4, now=T, expand_weight=0.5, expand_depth=2, graph_weight=0.1), 10).collect()
    assert sorted((r.id, r.retrieval_source) for r in rows) == [(1, "ann"), (2, "graph"), (3, "graph")]
    off = retrieval.recall_hybrid(asked, df, edges, RecallConfig(dim=4, now=T), 10).collect()
    assert [r.id for r in off] == [1]


def test_walks(spark):
    edges = spark.createDataFrame([(1, 2, "CAUSED_BY"), (2, 3, "caused_by"), (3, 1, "CAUSED_BY")], "source_id long, target_id long, relation_type string").withColumns({"weight": F.lit(0.5), "valid_until": F.lit(None).cast("timestamp"), "edge_kind": F.lit("causal")})
    starts = spark.createDataFrame([(1, 1)], "start long, node long")
    assert sorted((r.node, r.depth) for r in graph.causal_chain(edges, starts, 5).collect()) == [(2, 1), (3, 2)]
    assert sorted(r.node for r in graph.causal_chain(edges, starts, 1, direction="both").collect()) == [2, 3]
    with pytest.raises(ValueError):
        graph.causal_chain(edges, starts, 1, direction="up")
    near = graph.proximity(edges, starts.select(F.col("start").alias("query_id"), F.col("node").alias("id")), None)
    assert {r.id: r.proximity for r in near.collect()} == {2: 0.5, 3: 0.0}


def test_budget(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 10), (1, 2, 2.0, 10), (1, 3, 1.0, 10)], "query_id long, id long, score double, chars int")
    assert sorted(r.id for r in navigate.within_budget(rows, 20).collect()) == [1, 2]
    assert sorted((r.id, r.running_chars) for r in navigate.within_budget(rows, 15, straddle=True).collect()) == [(1, 10), (2, 15)]


def test_versions_and_facts(spark):
    df = lessons(spark, lesson(1, content_hash="h"), lesson(2, content_hash="h"), lesson(3))
    got = {r.id: r.t_valid_to for r in writes.versions(df).collect()}
    assert got == {1: T + timedelta(minutes=2), 2: OPEN, 3: OPEN}
    facts = spark.createDataFrame([(1, "A", "p", "x", 0.5, T), (2, "a", "P", "x", 0.9, T + timedelta(1)), (3, "a", "p", "y", 0.1, T + timedelta(2)), (4, "a", "p", "x", 0.2, T + timedelta(3))], "id long, entity string, property string, value string, confidence double, at timestamp")
    assert [(r.version, r.value, r.confidence) for r in writes.fact_versions(facts).orderBy("version").collect()] == [(1, "x", 0.9), (2, "y", 0.1), (3, "x", 0.2)]


def test_ingest_gates(spark):
    old = lessons(spark, lesson(1))
    new = lessons(
        spark,
        lesson(10, lesson_text="long enough and the root cause is known"),
        lesson(11, lesson_text="x", embedding=None),
        lesson(12, lesson_text="another long enough text here", embedding=[0.0, 1.0]),
        lesson(13, lesson_text="another long enough text here", embedding=[0.0, 1.0, 0.0, 0.0]),
        lesson(14, lesson_text="a project-less row never matches", project_id=None),
    )
    accepted, refused = writes.ingest(new, old, 4)
    assert sorted((r.id, r.reason) for r in refused.collect()) == [(10, "near_duplicate"), (11, "too_short"), (12, "dimension")]
    assert sorted(r.id for r in accepted.collect()) == [13, 14]


def test_consolidate_and_undo(spark):
    rows = [lesson(1, recall_count=5), lesson(2, embedding=[0.9998, 0.02, 0.0, 0.0], recall_count=2), lesson(3, embedding=[0.9999, 0.01414, 0.0, 0.0], recall_count=1), lesson(4, embedding=[0.0, 0.0, 0.0, 1.0]), lesson(5, role="other")]
    df = lessons(spark, *rows)
    found = lifecycle.consolidate(df, 0.92, 100, 4)
    assert [(r.canonical_id, r.member_ids, r["size"]) for r in found.collect()] == [(1, "2,3", 3)]
    after, edges = lifecycle.supersede(df, found)
    state = {r.id: (r.state, r.is_active, r.evidence_count) for r in after.collect()}
    assert state[2] == ("superseded", False, 1) and state[1][2] == 3 and edges.count() == 2
    assert lifecycle.consolidate(after, 0.92, 100, 4).count() == 0
    back, left = lifecycle.undo_consolidate(after, edges)
    assert {r.id: (r.state, r.is_active, r.evidence_count) for r in back.collect()}[2] == ("draft", True, 1) and left.count() == 0


def test_posterior(spark):
    log = spark.createDataFrame([Row(id=1, outcome=o, used=u) for o, u in [("success", True)] * 5 + [("failure", False)]])
    assert lifecycle.reinforce(log).first().confidence == pytest.approx(6 / 7)
    steps = spark.createDataFrame([(1, 1, "failure"), (1, 2, "success")], "id long, seq int, outcome string")
    assert lifecycle.reinforce_additive(steps).first().confidence == pytest.approx(0.4)


def test_statistics(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r.k: round(r.p_holm, 4) for r in evaluation.holm(df, "f", "k", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    x = spark.createDataFrame([(8.0, 10.0)], "k double, n double")
    low, high = x.select(*evaluation.wilson(F.col("k"), F.col("n"))).first()
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)


def test_consolidate_compares_the_first_candidates_or_all(spark):
    axis = lambda k: [float(i == k) for i in range(32)]
    important = [lesson(i, importance=5, embedding=axis(i)) for i in range(1, 26)]
    df = lessons(spark, *important, *[lesson(i, importance=1, embedding=axis(30)) for i in (40, 41)], lesson(44, state="archived", embedding=axis(30)), lesson(42, importance=1, role="other", embedding=axis(30)), lesson(43, role=None, embedding=axis(30)))
    assert [(r.canonical_id, r.member_ids) for r in lifecycle.consolidate(df, 0.92, 1, 32, every=True).collect()] == [(40, "41")]
    assert lifecycle.consolidate(df, 0.92, 1, 32).count() == 0


def test_locate_ranks_every_match(spark):
    df = lessons(spark, *[lesson(i, importance=1) for i in range(1, 60)], lesson(60, importance=5, commit_sha="c"))
    asked = spark.createDataFrame([(7, None, "lesson")], "query_id long, v array<float>, text string")
    config = RecallConfig(**{**RecallConfig().__dict__, "vec_weight": 0.0, "dim": 4})
    got = navigate.locate(asked, df, None, config, budget=40).collect()
    assert max(got, key=lambda r: r.score).id == 60 and sum(r.chars for r in got) <= 40


def test_hub_cap_counts_unseen_nodes_only(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.8), (2, 4, 0.7)], "source_id long, target_id long, weight float").withColumns({"valid_until": F.lit(None).cast("timestamp"), "edge_kind": F.lit("causal")})
    anchors = spark.createDataFrame([(1, 1)], "query_id long, id long")
    got = {r.id: round(r.graph_score, 4) for r in graph.expand(edges, anchors, 2, 1).collect()}
    assert got == {2: 0.9, 3: 0.72}


def test_expanded_candidates_keep_their_cosine(spark):
    df = lessons(spark, lesson(1), *[lesson(i, embedding=[1.0, 0.1, 0.0, 0.0]) for i in range(10, 60)], lesson(2, embedding=[0.6, 0.8, 0.0, 0.0]))
    edges = spark.createDataFrame([(1, 2, 0.5)], "source_id long, target_id long, weight float").withColumns({"valid_until": F.lit(None).cast("timestamp"), "edge_kind": F.lit("causal")})
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], None)], "query_id long, v array<float>, text string")
    config = RecallConfig(dim=4, now=T, expand_weight=0.5, ef_search=10)
    pool = {r.id: r for r in retrieval.pools(asked, df, edges, config, 1).collect()}
    assert pool[2].retrieval_source == "graph" and pool[2].vec_score == pytest.approx(0.6) and len(pool) == 11


def test_recall_router_takes_any_signal(spark):
    df = lessons(spark, lesson(1, topic="alpha"), lesson(2, embedding=[0.0, 1.0, 0.0, 0.0], topic="alpha beta"), lesson(3, embedding=None, topic="beta"))
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], None), (2, None, "beta"), (3, [0.0, 1.0, 0.0, 0.0], "alpha"), (4, None, None)], "query_id long, v array<float>, text string")
    config = RecallConfig(dim=4, now=T)
    for hybrid in (True, False):
        got = retrieval.recall_lessons(asked, df, None, config, 10, hybrid=hybrid).collect()
        assert {r.id for r in got if r.query_id == 2} == {2, 3}
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1][0] == 1
        assert {r.query_id for r in got} == {1, 2, 3}
    near = retrieval.recall_lessons(asked.filter("query_id = 1"), df, None, config, 10, min_score=0.5).collect()
    assert [r.id for r in near] == [1]


def test_expand_walks_and_previews(spark):
    df = lessons(spark, lesson(1, metadata='{"lang": "en", "x": 1}'), lesson(2, lesson_text="b" * 80), lesson(3), lesson(4, is_active=False), lesson(5))
    edges = spark.createDataFrame([(1, 2, 0.9, "A"), (3, 2, 0.9, "A"), (1, 4, 0.9, "A"), (1, 5, 0.1, "A")], "source_id long, target_id long, weight float, relation_type string").withColumn("valid_until", F.lit(None).cast("timestamp"))
    seeds = spark.createDataFrame([(1,), (4,)], "id long")
    got = {r.id: r for r in navigate.expand(df, edges, seeds, 2, fields=["lang"]).collect()}
    assert set(got) == {1, 2, 3} and got[1].neighbour_ids == [2, 3] and got[1].neighbour_previews[0] == "b" * 50
    assert got[1].detail == '{"lang":"en"}' and got[2].detail is None and got[2].path == "graph_expand" and got[2].neighbour_ids is None
    assert got[3].running_chars == sum(len(r.content) for r in got.values())
    assert set(r.id for r in navigate.expand(df, edges, seeds, 1).collect()) == {1, 2}
    assert navigate.expand(df, edges, seeds.limit(0)).count() == 0


def test_quantiles_and_staleness(spark):
    values = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 10.0, None)], "x double")
    assert lifecycle.quantiles(values, "x", {"a": 0.5, "b": 0.9}).first().asDict() == {"a": 2.0, "b": pytest.approx(7.6)}
    assert lifecycle.quantiles(values.limit(0), "x", {"a": 0.5}).first().a is None
    df = lessons(spark, lesson(1, confidence=0.1), lesson(2, confidence=0.9), lesson(3, state="archived"), lesson(4, confidence=0.1, importance=5), lesson(5, confidence=None)).withColumn("last_recalled_at", F.lit(None).cast("timestamp"))
    config = RecallConfig(now=T + timedelta(100))
    assert [(r.id, r.would_deprecate) for r in lifecycle.stale(df, config).orderBy("position").collect()] == [(1, True), (2, False), (4, False), (5, False)]
    assert [r.id for r in lifecycle.mark_stale(df, config).collect()] == [1] and lifecycle.mark_stale(df, config, cap=0).count() == 0


def test_more_statistics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    assert evaluation.paired_t(df, "a", "b").first().t == pytest.approx(2 / (1 / 3**0.5))
    table = spark.createDataFrame([("x", "p")] * 10 + [("y", "q")] * 10, "a string, b string")
    assert tuple(evaluation.chi_square(table, "a", "b").first()) == (pytest.approx(20.0), 1)
    arms = spark.createDataFrame([("l", 3.0), ("l", 2.0), ("r", 1.0), ("r", 2.0)], "arm string, v double")
    assert evaluation.cliffs_delta(arms, "arm", "v", "l", "r").first().delta == pytest.approx(0.75)
    assert df.select(evaluation.bonferroni(F.lit(0.02), 3).alias("p")).first().p == pytest.approx(0.06)
    low, mid = evaluation.percentile_rank(df, "a", (0.5, 0.95)).first()
    assert (low, mid) == (2.0, 3.0)
