"""Work that must not grow with queries times records: shared texts, grids of cells, groups in cells of their own."""

import numpy as np
import pytest
from test_operators import lesson, lessons

from lorekeep.config import RecallConfig
from lorekeep.functions import lexical
from lorekeep.operators import lifecycle, navigate, retrieval, vectors

ASK = "query_id long, v array<float>, text string"


def test_queries_of_one_text_are_matched_once(spark):
    rows = lessons(spark, *[lesson(i, topic="alpha beta" if i % 2 else "beta") for i in range(1, 7)])
    asked = spark.createDataFrame([(i, None, "Alpha alpha") for i in range(10, 30)] + [(30, None, "beta alpha"), (31, None, "alpha  BETA")], ASK)
    texts, hits = retrieval.text_hits(asked, rows)
    assert texts.count() == 22 and texts.select("text_id").distinct().count() == 2
    assert sorted((r.text_id, r.id) for r in hits.collect()) == [(t, i) for t in (10, 30) for i in (1, 3, 5)]
    assert retrieval.text_pool(asked, rows, 2).count() == 44


def test_vector_path_ranks_text_hits_in_cells(spark):
    rows = lessons(
        spark, *[lesson(i, topic="alpha" if i % 3 == 0 else "other", embedding=None if i % 5 == 0 else [1.0, float(i), 0.0, 0.0]) for i in range(1, 31)]
    )
    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.0, 0.0], "alpha"), (2, None, "alpha"), (3, [0.0, 1.0, 0.0, 0.0], None)], ASK)
    got = {}
    for r in retrieval.recall_vectors(asked, rows, None, RecallConfig(dim=4), 40).collect():
        got.setdefault(r.query_id, []).append(r)
    # With a vector: usable ones and hits; without: hits alone, at cosine 0.
    assert [len(got[q]) for q in (1, 2, 3)] == [24 + 2, 10, 24]
    assert all(r.vec_score == 0 for r in got[2]) and all(r.vec_score == 0 for r in got[1] if r.id % 5 == 0)
    fresh = {r.id: r.score - r.vec_score for r in got[3]}
    for r in got[1]:
        assert r.score - r.vec_score == pytest.approx(fresh.get(r.id, r.score - 0.1) + (0.1 if r.id % 3 == 0 else 0), abs=1e-9)
    assert [r.rank for r in sorted(got[1], key=lambda r: (-r.score, r.id))] == list(range(1, 27))


def test_grid_moves_few_bytes():
    b, p = vectors._grid(15_000, 525_000, 100, 64, 100)
    assert b * p >= 50 and p >= 525_000 // vectors.PART
    assert 15_000 * p * (256 + 2000) + 525_000 * b * 256 < 1.5e9  # 100 parts of all queries were 3.8e9


@pytest.mark.parametrize("cell", [4, 16_384])
def test_only_rows_of_one_group_meet(spark, monkeypatch, cell):
    monkeypatch.setattr(vectors, "CELL", cell)
    x = np.random.default_rng(1).normal(size=(40, 3))
    g = [0] * 25 + [1] * 10 + [2] * 5
    df = spark.createDataFrame([(i, g[i], [float(v) for v in x[i]]) for i in range(40)], "id long, g long, v array<float>")
    found = {(r.query_id, r.id) for r in vectors.block_above(df.filter("id % 2 = 0"), df, 0.5, 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert found == {(a, b) for a in range(0, 40, 2) for b in range(40) if g[a] == g[b] and u[a] @ u[b] > 0.5}
    assert vectors.block_above(df.limit(0), df, 0.5, 3).count() == 0
    plan = vectors.block_above(df, df, 0.5, 3)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow [c#" in plan


def test_consolidation_of_all_in_cells_of_roles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 3)
    rows = lessons(spark, *[lesson(i, role="a" if i <= 8 else "b", embedding=[1.0, 0.001 * i, 0.0, 0.0]) for i in range(1, 13)])
    got = lifecycle.consolidate(rows, 0.92, 10, 4, every=True).collect()
    assert [(r.canonical_id, r["size"]) for r in got] == [(1, 8), (9, 4)]
    assert sum(len(c) for c in [vectors.block_above(*[rows.selectExpr("id", "cast(1 as long) g", "embedding v")] * 2, 0.9, 4).collect()]) == 144


@pytest.mark.parametrize("ranker", [lexical.bm25, lexical.tfidf_cosine])
def test_ranked_texts_are_cut_in_each_part(spark, ranker):
    docs = spark.createDataFrame([(i, "common " + ("rare " if i % 10 == 0 else "") + f"w{i} " * (i % 3)) for i in range(100)] + [(100, ""), (101, None)], "id long, t string")
    asked = spark.createDataFrame([(1, "common common rare"), (2, "absent"), (3, "w7 common"), (4, "")], "q long, t string")
    every, few = (ranker(docs, "id", "t", asked, "q", "t", k).collect() for k in (1000, 2))
    best = lambda rows, q, k: sorted(((round(-r.score, 9), r.id) for r in rows if r.query_id == q))[:k]
    assert [len([r for r in every if r.query_id == q]) for q in (1, 2, 3, 4)] == [100, 0, 100, 0]
    assert len(few) <= 2 * 2 * 4 and all(best(few, q, 2) == best(every, q, 2) for q in (1, 3))
    assert {i % 10 for _, i in best(every, 1, 10)} == {0} and best(every, 3, 1)[0][1] == 7


def test_cosine_of_terms_in_every_document_is_zero(spark):
    docs = spark.createDataFrame([(i, "common") for i in range(5)] + [(9, "common w")], "id long, t string")
    got = lexical.tfidf_cosine(docs, "id", "t", spark.createDataFrame([(1, "common")], "q long, t string"), "q", "t", 10).collect()
    assert sorted((r.id, r.score) for r in got) == [(i, 0.0) for i in (0, 1, 2, 3, 4, 9)]


def test_norms_know_terms_of_one_document_without_sending_them(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d")], "id long, t string")
    got = {r.id: r.score for r in lexical.tfidf_cosine(docs, "id", "t", spark.createDataFrame([(1, "a z")], "q long, t string"), "q", "t", 5).collect()}
    a, one = np.log(3 / 2), np.log(3)
    assert got == pytest.approx({1: a / np.hypot(a, one), 2: 2 * a / np.hypot(2 * a, one)})


def test_whole_query_texts_count(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = lessons(spark, lesson(1, lesson_text=words), lesson(2, lesson_text=words + " last"))
    asked = spark.createDataFrame([(1, None, words + " last"), (2, None, words)], ASK)
    assert sorted((r.query_id, r.id) for r in retrieval.text_pool(asked, rows, 10).collect()) == [(1, 2), (2, 1), (2, 2)]


def test_long_texts_start_from_their_rarest_term(spark):
    rows = lessons(spark, *[lesson(i, topic="common", lesson_text=f"common words {'rare' if i == 7 else 'usual'}") for i in range(1, 21)])
    asked = spark.createDataFrame([(1, None, "rare common words"), (2, None, "common absent")], ASK)
    _, hits = retrieval.text_hits(asked, rows)
    assert [(r.text_id, r.id) for r in hits.collect()] == [(1, 7)]
    assert retrieval.text_pool(asked, rows, None).collect()[0].id == 7


@pytest.mark.parametrize("part", [3, 65_536])
def test_locate_ranks_all_matches_but_moves_few(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "PART", part)
    x = np.random.default_rng(2).normal(size=(300, 4))
    rows = lessons(spark, *[lesson(i, topic="alpha" if i % 7 == 0 else "beta", lesson_text="t" * 50 + (" alpha" if i % 11 == 0 else ""), embedding=None if i % 13 == 0 else [float(v) for v in x[i]], importance=None if i % 17 == 0 else i % 5) for i in range(300)])
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "alpha"), (2, None, "alpha"), (3, [0.0, 1.0, 0.0, 0.0], None), (4, None, "absent"), (5, None, None)], ASK)
    config = RecallConfig(dim=4)
    for budget, straddle in ((1000, False), (1000, True), (10**6, False)):
        got = {(r.query_id, r.id): r for r in navigate.locate(asked, rows, None, config, budget, straddle=straddle).collect()}
        # An edge table and a weight take the path that ranks every pair; no edge changes a score.
        edges = spark.createDataFrame([], "source_id long, target_id long, edge_kind string, weight float, valid_until timestamp")
        every = {(r.query_id, r.id): r for r in navigate.locate(asked, rows, edges, RecallConfig(dim=4, graph_weight=0.1), budget, straddle=straddle).collect()}
        assert set(got) == set(every) and len(got) > 30
        assert all(got[i].running_chars == every[i].running_chars and got[i].score == pytest.approx(every[i].score, abs=1e-12) for i in got)
    seen = []
    monkeypatch.setattr(vectors, "block_topk", lambda *a, **k: seen.append(a))
    navigate.locate(asked, rows, None, config, 1000).count()
    assert not seen


def test_pools_take_visible_rows_once(spark, monkeypatch):
    found = []
    monkeypatch.setattr(retrieval, "visible", lambda rows, *a, f=retrieval.visible, **k: found.append(rows) or f(rows, *a, **k))
    rows = lessons(spark, *[lesson(i, topic="alpha") for i in range(1, 6)])
    edges = spark.createDataFrame([(1, 2, "causal", 0.9, None)], "source_id long, target_id long, edge_kind string, weight float, valid_until timestamp")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "alpha")], ASK)
    got = retrieval.recall_hybrid(asked, rows, edges, RecallConfig(dim=4, expand_weight=0.2), 3).collect()
    plan = retrieval.pools(asked, rows, edges, RecallConfig(dim=4, expand_weight=0.2), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in got] == [1, 2, 3] and len(found) == 2 and "FlatMapGroupsInArrow" not in plan


def test_wide_rows_are_not_shuffled_for_their_latest(spark, tmp_path, monkeypatch):
    from lorekeep.sources import tables

    rows = [(i, i, f"old {i}") for i in range(40)] + [(3, 100, "new"), (5, None, "unknown"), (7, 1, "older")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id long, at long, x string").write.parquet(path)
    df = spark.read.parquet(path)
    every = lambda d: sorted(d.collect())
    got = tables.latest_wide(df, "id", "at")
    assert every(got) == every(tables.latest(df, ["id"], "at")) and len(every(got)) == 40
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "REPEATED", 2)
    assert every(tables.latest_wide(df, "id", "at")) == every(got)
    null = df.unionByName(spark.createDataFrame([(None, 1, "a"), (None, 2, "b")], "id long, at long, x string"))
    assert [r.x for r in tables.latest_wide(null, "id", "at").filter("id is null").collect()] == ["b"]


def test_visible_rows_are_not_kept_as_a_copy(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "cut", lambda df, f=retrieval.cut: kept.append(df.columns) or f(df))
    rows = lessons(spark, *[lesson(i, topic="alpha") for i in range(1, 6)])
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "alpha")], ASK)
    assert retrieval.recall_hybrid(asked, rows, None, RecallConfig(dim=4), 3).count() == 3
    assert retrieval.recall_vectors(asked, rows, None, RecallConfig(dim=4), 3).count() == 3
    assert kept and not any("lesson_text" in c for c in kept)


def test_ingestion_keeps_verdicts_not_texts_and_finds_twins_once(spark, monkeypatch):
    from lorekeep.operators import writes

    kept, found = [], []
    monkeypatch.setattr(writes, "cut", lambda df, f=writes.cut: kept.append(df.columns) or f(df))
    monkeypatch.setattr(vectors, "block_above", lambda *a, f=vectors.block_above: found.append(a) or f(*a))
    text = "Workers lose their leases when the clock of a host jumps, so renew them by a monotonic clock {}."
    old = lessons(spark, lesson(1, embedding=[1.0, 0.0, 0.0, 0.0]))
    new = lessons(spark, lesson(2, lesson_text=text.format(2), embedding=[1.0, 0.01, 0.0, 0.0]), lesson(3, lesson_text=text.format(3), embedding=[0.0, 1.0, 0.0, 0.0]), lesson(4, lesson_text="short"), lesson(5, lesson_text=text.format(5), embedding=[1.0]))
    accepted, refused = writes.ingest(new, old, 4)
    assert [(r.id, r.lesson_text) for r in accepted.collect()] == [(3, text.format(3))]
    assert {(r.id, r.existing_id) for r in refused.collect()} == {(2, 1), (4, None), (5, None)}
    assert len(found) == 1 and not any("lesson_text" in c for c in kept)
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan


@pytest.mark.parametrize("block", [3, 65_536])
def test_search_leaves_records_where_they_lie(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "RECORDS", 7)
    x = np.random.default_rng(3).normal(size=(60, 3)).round(1)
    x[40:50] = x[30]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, v array<float>").repartition(5)
    found = vectors.block_topk(df.filter("id % 6 = 0").withColumnRenamed("id", "query_id"), df, 12, 3)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan and "Coalesce" in plan
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 6):
        s = np.round(u @ u[q], 12)
        got = sorted((r.rank, r.id) for r in found.collect() if r.query_id == q)
        assert got == list(enumerate(sorted(range(60), key=lambda i: (-s[i], i))[:12], 1))


def test_text_hits_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HITS", 3)
    rows = lessons(spark, *[lesson(i, topic="alpha beta" if i % 3 == 0 else "beta", lesson_text="alpha " * (i % 4)) for i in range(1, 31)])
    asked = spark.createDataFrame([(1, None, "alpha"), (2, None, "beta alpha"), (3, None, "beta"), (4, None, "gamma")], ASK)
    _, hits = retrieval.text_hits(asked, rows)
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    held = {i for i in range(1, 31) if i % 3 == 0 or i % 4}
    assert {(r.text_id, r.id) for r in hits.collect()} == {(t, i) for t in (1, 2) for i in held} | {(3, i) for i in range(1, 31)}
    every = retrieval.text_pool(asked, rows, None).collect()
    best = {(q, r.id) for q in (1, 2, 3) for r in sorted((r for r in every if r.query_id == q), key=lambda r: (-r.bm25_score, r.id))[:4]}
    assert {(r.query_id, r.id) for r in retrieval.text_pool(asked, rows, 4).collect()} == best
    monkeypatch.setattr(retrieval, "TEXTS", 1)
    assert {(r.query_id, r.id) for r in retrieval.text_pool(asked, rows, 4).collect()} == best


def test_vector_path_moves_neither_texts_nor_hits(spark, monkeypatch):
    rows = lessons(spark, *[lesson(i, topic="alpha" if i % 3 == 0 else "other", embedding=None if i % 5 == 0 else [1.0, float(i), 0.0, 0.0]) for i in range(1, 31)])
    asked = spark.createDataFrame([(1, [1.0, 2.0, 0.0, 0.0], "alpha"), (2, None, "alpha"), (3, [0.0, 1.0, 0.0, 0.0], None), (4, None, None)], ASK)
    kept = []
    monkeypatch.setattr(retrieval, "cut", lambda df, f=retrieval.cut: kept.append(df.columns) or f(df))
    found = retrieval.recall_vectors(asked, rows, None, RecallConfig(dim=4), 6)
    every = sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
    assert not any("ft" in c or "id" in c for c in kept) and "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    assert [len([r for r in every if r[0] == q]) for q in (1, 2, 3, 4)] == [6, 6, 6, 0]
    monkeypatch.setattr(vectors, "BLOCK", 1)
    monkeypatch.setattr(vectors, "RECORDS", 4)
    again = sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.recall_vectors(asked, rows, None, RecallConfig(dim=4), 6).collect())
    assert [r[:3] for r in again] == [r[:3] for r in every] and [r[3] for r in again] == pytest.approx([r[3] for r in every], abs=1e-11)


@pytest.mark.parametrize("least", [-0.1, 0.0, 1e-9, 0.1, 0.3, 0.5, 0.7, 1.0, 1.1])
def test_one_edge_says_which_cosines_reach_the_least(least):
    edge = vectors._reaching(least)
    near = [edge] if np.isfinite(edge) else []
    for _ in range(3):
        near += [np.nextafter(x, d) for x in near for d in (-9.0, 9.0)]
    cos = np.concatenate([near, np.random.default_rng(3).uniform(-1, 1, 1000), least + np.linspace(-1e-7, 1e-7, 1001), least + np.linspace(-2e-12, 2e-12, 101)])
    assert ((cos >= edge) == (np.clip(np.round(cos, 12), 0.0, 1.0).astype(np.float32) >= np.float32(least))).all()


def test_least_score_holds_for_text_hits_and_bare_lessons(spark):
    rows = lessons(spark, *[lesson(i, topic="alpha" if i % 2 else "beta", embedding=None if i == 5 else [1.0, float(i), 0.0, 0.0]) for i in range(1, 9)])
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "alpha"), (2, None, "alpha"), (3, [1.0, 0.0, 0.0, 0.0], None)], ASK)
    ids = lambda least: sorted((r.query_id, r.id) for r in retrieval.recall_vectors(asked, rows, None, RecallConfig(dim=4), 10, least).collect())
    every = [(1, i) for i in range(1, 9)] + [(2, i) for i in (1, 3, 5, 7)] + [(3, i) for i in (1, 2, 3, 4, 6, 7, 8)]
    assert ids(None) == ids(0.0) == every
    assert ids(0.3) == [(q, i) for q in (1, 3) for i in (1, 2, 3)] and ids(1.1) == []


def test_queries_that_lack_rows_sort_no_scores(monkeypatch):
    best = vectors._Best(3, 2)
    best.add(2, np.zeros(2, np.int64), np.array([0.9, 0.8]), np.array([7, 8]))
    scores = np.array([[-np.inf, 0.1, -np.inf, -1e290], [0.3, 0.2, 0.1, 0.2], [0.7, 0.85, 0.8, -np.inf]])
    assert sorted(zip(*(x.tolist() for x in best.candidates(0, scores)), strict=True)) == [(0, 1), (0, 3), (1, 0), (1, 1), (1, 3), (2, 1), (2, 2)]
    monkeypatch.setattr(vectors, "_first", None)  # few rows are taken without it
    assert best.candidates(0, scores[:1])[1].tolist() == [1, 3]
