"""The core's queries over the test tables. Every query reads its whole tables.

Batches of searches take as queries the lessons whose id is divisible by 50, against all lessons.
Times in results are microseconds; arrays are delimited strings; floats are rounded where sums may differ.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.config import RecallConfig
from lorekeep.functions import lexical, sql, text
from lorekeep.operators import evaluation, graph, lifecycle, navigate, retrieval, vectors, writes
from lorekeep.operators import visibility as see
from lorekeep.plans.catalogue import SQL as SQL_OF
from lorekeep.plans.catalogue import query
from lorekeep.sources import files
from lorekeep.sources.tables import current_lessons, table
from lorekeep.streaming import streams

CONFIG = RecallConfig()
NOW_US = 1782864000000000

# ---- SQL building blocks ----

L = "l as (select * from agent_lesson qualify row_number() over (partition by id order by updated_at desc) = 1)"
GOOD = "(embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"
SEEN = "seen as (select * from l where is_active and verified_at is not null and epoch_us(t_valid_to) = 253370764800000000)"
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
ASK = f"ask as (select id as query_id, embedding as v, list_extract({TOK.format('topic')}, 1) as text from l where id % 50 = 0)"
COS = "round(list_cosine_similarity(v::double[], embedding::double[]), 12)"


def _lessons(spark: SparkSession, base: str, *columns: str, wide: bool = False) -> DataFrame:
    return current_lessons(spark, base, *columns, wide=wide)


def _all(spark: SparkSession, base: str) -> DataFrame:
    return current_lessons(
        spark, base, "created_at", "role", "project_id", "topic", "lesson_text", "importance", "metadata", "commit_sha", "verified_at", "embedding",
        "is_active", "content_type", "source_dag_id", "t_valid_from", "t_valid_to", "confidence", wide=True,
    )


def _ask(lessons: DataFrame) -> DataFrame:
    """The stated set of searches: the vector and the first topic word of each lesson whose id is divisible by 50."""
    return lessons.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("v"), F.get(lexical.tokens(F.col("topic")), F.lit(0)).alias("text"))


# ---- visibility and snapshots ----


@query("visible_lessons", f"with {L}, {SEEN} select role, count(*) as n, count(distinct project_id) as projects from seen group by role")
def visible_lessons(spark: SparkSession, base: str) -> DataFrame:
    rows = see.visible(_lessons(spark, base, "is_active", "verified_at", "t_valid_to", "role", "project_id"), CONFIG)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"))


@query("visible_filtered", f"with {L}, {SEEN} select id, role, content_type from seen where role = 'agent_dispatch' and source_dag_id is distinct from 'dag-1' and content_type in ('incident', 'decision')")
def visible_filtered(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "is_active", "verified_at", "t_valid_to", "role", "content_type", "source_dag_id")
    return see.visible(rows, CONFIG, role="agent_dispatch", exclude_dag="dag-1", types=["incident", "decision"]).select("id", "role", "content_type")


@query("as_of_snapshot", f"with {L} select id, version_n from l where epoch_us(t_valid_from) <= 1735689600000000 and epoch_us(t_valid_to) > 1735689600000000")
def as_of_snapshot(spark: SparkSession, base: str) -> DataFrame:
    from datetime import datetime

    return see.as_of(_lessons(spark, base, "t_valid_from", "t_valid_to", "version_n"), datetime(2025, 1, 1)).select("id", "version_n")


@query("current_items", f"with {L} select item_kind, count(*) as n from l where epoch_us(t_valid_to) = 253370764800000000 group by item_kind")
def current_items(spark: SparkSession, base: str) -> DataFrame:
    return see.current_items(_lessons(spark, base, "t_valid_to", "item_kind")).groupBy("item_kind").agg(F.count("*").alias("n"))


@query("metadata_contains", f"with {L} select id from l where json_extract_string(metadata, '$.channel') = 'hook' and json_extract_string(metadata, '$.lang') = 'en'")
def metadata_contains(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "metadata").filter(see.json_contains("metadata", {"channel": "hook", "lang": "en"})).select("id")


@query("tenant_edges", f"with {L}, t as (select id from l where project_id = 7) select id from (select distinct * from mem_edge) where source_id in (select id from t) or target_id in (select id from t)")
def tenant_edges(spark: SparkSession, base: str) -> DataFrame:
    return see.tenant_edges(table(spark, base, "mem_edge").distinct(), _lessons(spark, base, "project_id"), "7").select("id")


@query("bitemporal_versions", f"with {L}, o as (select id, epoch_us(created_at) as f, epoch_us(lead(created_at) over (partition by content_hash order by created_at nulls first, id)) as t from l) select id, f as valid_from_us, coalesce(t, 253370764800000000) as valid_to_us from o where f is not null")
def bitemporal_versions(spark: SparkSession, base: str) -> DataFrame:
    rows = writes.versions(_lessons(spark, base, "content_hash", "created_at", "t_valid_from")).filter("created_at is not null")
    return rows.select("id", F.unix_micros("t_valid_from").alias("valid_from_us"), F.unix_micros("t_valid_to").alias("valid_to_us"))


# ---- vectors ----


@query("vector_topk", f"with {L}, {ASK}, s as (select query_id, id, {COS} as score from ask, l where is_active and verified_at is not null and {GOOD} and {GOOD.replace('embedding', 'v')}) select query_id, id, round(score, 9) as vec_score, row_number() over (partition by query_id order by score desc, id) as rank from s qualify rank <= 10")
def vector_topk(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "topic", "embedding", "is_active", "verified_at")
    return retrieval.recall_fast(_ask(lessons), lessons, CONFIG, 10).select("query_id", "id", F.round("vec_score", 9).alias("vec_score"), "rank")


VECTOR_PATH = f"""with {L}, {ASK}, base as (select * from l where is_active and verified_at is not null),
f as (select query_id, id, case when {GOOD} and {GOOD.replace('embedding', 'v')} then {COS} else 0.0 end as c, {GOOD} as good,
      0.05 * greatest(0.0, 1 - least(({NOW_US} - epoch_us(created_at)) / 1e6 / 7776000.0, 1.0)) as fresh,
      (len(list_filter({TOK.format('topic')}, lambda t: t = text)) * 1.0 + len(list_filter({TOK.format('lesson_text')}, lambda t: t = text)) * 0.4) as ft, {GOOD.replace('embedding', 'v')} as asked from ask, base),
p as (select query_id, id, c, c + fresh + 0.1 * coalesce(ft, 0.0) as sc from f where (good and asked and fresh is not null) or ft > 0)
"""


@query("vector_path", VECTOR_PATH + "select query_id, id, round(sc, 9) as score from p qualify row_number() over (partition by query_id order by round(sc, 11) desc nulls last, id) <= 10")
def vector_path(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "topic", "lesson_text", "embedding", "is_active", "verified_at", "created_at", wide=True)
    return retrieval.recall_vectors(_ask(lessons), lessons, None, CONFIG, 10).select("query_id", "id", F.round("score", 9).alias("score"))


@query("vector_path_min_score", VECTOR_PATH + "select query_id, id, round(sc, 9) as score from p where least(1.0, greatest(0.0, c))::float >= 0.3::float qualify row_number() over (partition by query_id order by round(sc, 11) desc nulls last, id) <= 10")
def vector_path_min_score(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "topic", "lesson_text", "embedding", "is_active", "verified_at", "created_at", wide=True)
    return retrieval.recall_vectors(_ask(lessons), lessons, None, CONFIG, 10, 0.3).select("query_id", "id", F.round("score", 9).alias("score"))


CENTROIDS = f"with {L}, p as (select role, i as pos, avg(embedding[i + 1]::double) as m from l, range(64) t(i) where {GOOD} group by role, i)"


@query("topic_centroids", CENTROIDS + " select role, pos::integer as pos, round(m, 9) + 0.0 as mean from p")
def topic_centroids(spark: SparkSession, base: str) -> DataFrame:
    good = _lessons(spark, base, "role", "embedding").filter(vectors.usable("embedding", 64))
    return vectors.centroids(good, "role", "embedding").select("role", F.posexplode("centroid").alias("pos", "m")).select("role", "pos", F.round("m", 9).alias("mean"))


@query("nearest_topic", CENTROIDS + f", c as (select role, list(m order by pos) as c from p group by role), s as (select id, c.role, 1 - list_cosine_similarity(embedding::double[], c.c) as d from l, c where {GOOD}) select id, role, round(d, 9) as distance from s qualify row_number() over (partition by id order by round(d, 12), role) = 1")
def nearest_topic(spark: SparkSession, base: str) -> DataFrame:
    good = _lessons(spark, base, "role", "embedding").filter(vectors.usable("embedding", 64))
    means = vectors.centroids(good, "role", "embedding")
    return vectors.nearest_centroid(good.select("id", "embedding"), "id", "embedding", means, "role").select("id", "role", F.round("distance", 9).alias("distance"))


# ---- lexical ----


@query("token_frequency", f"with {L}, t as (select id, unnest({TOK.format('lesson_text')}) as term from l) select term, count(*) as occurrences, count(distinct id) as documents from t group by term")
def token_frequency(spark: SparkSession, base: str) -> DataFrame:
    terms = lexical.term_documents(_lessons(spark, base, "lesson_text"), "id", lexical.tokens(F.col("lesson_text")))
    return terms.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


@query("inverted_index", f"with {L}, t as (select id, unnest({TOK.format('topic')}) as term, unnest(range(1, 1 + len({TOK.format('topic')}))) as p from l) select term, count(distinct id) as documents, sum(p)::bigint as position_sum from t group by term")
def inverted_index(spark: SparkSession, base: str) -> DataFrame:
    index = lexical.inverted_index(_lessons(spark, base, "topic", "lesson_text"), "id", "topic", "lesson_text").filter(F.size("positions_a") > 0)
    total = F.aggregate("positions_a", F.lit(0).cast("long"), lambda a, p: a + p)
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum(total).alias("position_sum"))


TEXT_POOL = f"""hits as (select query_id, id, len(list_filter({TOK.format('topic')}, lambda t: t = text)) * 1.0 + len(list_filter({TOK.format('lesson_text')}, lambda t: t = text)) * 0.4 as w
         from ask, seen where text is not null),
tp as (select query_id, id, w / (w + 1) as b from hits where w > 0 qualify row_number() over (partition by query_id order by round(w, 6) desc, id) <= 40)"""


@query("single_term_rank", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL} select query_id, id, round(b, 6) as bm25_score from tp")
def single_term_rank(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return retrieval.text_pool(_ask(lessons), see.visible(lessons, CONFIG), 40).select("query_id", "id", F.round("bm25_score", 6).alias("bm25_score"))


@query(
    "bm25_topk",
    f"""with {L}, ask as (select id as query_id, unnest(regexp_extract_all(lower(topic), '[a-z0-9]+')) as term from l where id % 50 = 0),
q as (select query_id, term, count(*) as times from ask group by all),
d as (select id, regexp_extract_all(lower(lesson_text), '[a-z0-9]+') as w from l),
s as (select count(*) as n, avg(len(w)) as mean from d),
tf as (select id, len(w) as len, unnest(list_distinct(w)) as term, w from d),
p as (select id, len, term, len(list_filter(w, lambda x: x = term)) as tf from tf where term in (select term from q)),
df as (select term, count(*) as df from p group by term),
sc as (select query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) as score from p join df using (term) join q using (term), s group by all)
select query_id, id, round(score, 6) as score from sc qualify row_number() over (partition by query_id order by round(score, 9) desc, id) <= 10""",
)
def bm25_topk(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "topic", "lesson_text")
    scored = lexical.bm25(lessons, "id", "lesson_text", lessons.filter("id % 50 = 0").select("id", "topic"), "id", "topic", 10)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r <= 10").select("query_id", "id", F.round("score", 6).alias("score"))


@query("cover_density")
def cover_density(spark: SparkSession, base: str) -> DataFrame:
    return lexical.cover_density(_lessons(spark, base, "topic", "lesson_text"), "id", "topic", "lesson_text", 'root cause or incident "in task" -weekly')


# ---- hybrid retrieval ----

POOLS = f"""vp as (select query_id, id, {COS} as s from ask, seen where {GOOD} and {GOOD.replace('embedding', 'v')} qualify row_number() over (partition by query_id order by s desc, id) <= 100),
pool as (select query_id, id, coalesce(s, 0.0) as s, coalesce(b, 0.0) as b from vp full join tp using (query_id, id)),
ranked as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id order by s desc nulls last, id) as vr,
           case when b > 0 then rank() over (partition by query_id, b > 0 order by round(b, 9) desc) end as br from pool),
fused as (select *, 0.4 / (60 + vr) + 0.4 / (60 + coalesce(br, n + 1)) + 1.0 / 61 * (0.4 * s + 0.4 * b) as rrf from ranked)"""
FINAL = f"""scored as (select f.*, rrf + (0.8::double / 61 / 0.76) * (0.025 * importance / 5.0 + 0.025 * confidence::double
           + 0.05 * greatest(0.0, 1 - least(({NOW_US} - epoch_us(created_at)) / 1e6 / 7776000.0, 1.0))
           + 0.05 * case when commit_sha is not null and verified_at is not null then 1.0 when commit_sha is not null then 0.4 else 0.0 end) as score
           from fused f join l using (id))"""


@query("rrf_ranks", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS} select query_id, id, n as n_candidates, vr as vec_rank, coalesce(br, 0) as bm25_rank, round(rrf, 9) as rrf_score from fused")
def rrf_ranks(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    fused = retrieval.fuse(retrieval.pools(_ask(lessons), lessons, None, CONFIG, 10), CONFIG)
    return fused.select("query_id", "id", "n_candidates", "vec_rank", F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.round("rrf_score", 9).alias("rrf_score"))


@query("hybrid_recall", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS}, {FINAL} select query_id, id, round(score, 9) as score, row_number() over (partition by query_id order by score desc nulls last, id) as rank from scored qualify rank <= 10")
def hybrid_recall(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return retrieval.recall_hybrid(_ask(lessons), lessons, None, CONFIG, 10).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("hybrid_min_score", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS}, {FINAL} select query_id, id, round(score, 9) as score from scored where least(1.0, greatest(0.0, s))::float >= 0.3::float qualify row_number() over (partition by query_id order by score desc nulls last, id) <= 10")
def hybrid_min_score(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return retrieval.recall_hybrid(_ask(lessons), lessons, None, CONFIG, 10, min_score=0.3).select("query_id", "id", F.round("score", 9).alias("score"))


EXPANDED = f"""h as (select distinct source_id, target_id, weight from mem_edge where valid_until is null and edge_kind = 'causal'),
x0 as (select query_id, id from vp qualify row_number() over (partition by query_id order by s desc, id) <= 15),
x1 as (select query_id, x0.id as a, target_id as id, coalesce(weight, 1)::float as w from x0 join h on source_id = x0.id and target_id <> x0.id
       qualify row_number() over (partition by query_id, x0.id order by weight desc nulls last, target_id) <= 3),
x2 as (select query_id, target_id as id, (w * coalesce(weight, 1)::float)::float as w from x1 join h on source_id = x1.id and target_id not in (x1.id, a)
       qualify row_number() over (partition by query_id, a, x1.id, w order by weight desc nulls last, target_id) <= 3),
xg as (select query_id, id, max(w) as g from (select query_id, id, w from x1 union all select query_id, id, w from x2) group by all),
xp as (select query_id, xg.id, case when {GOOD} and {GOOD.replace('embedding', 'v')} then {COS} else 0.0 end as s, g from xg join seen on seen.id = xg.id join ask using (query_id) where (query_id, xg.id) not in (select (query_id, id) from pool0)),
pool as (select query_id, id, s, b, 0.0::float as g from pool0 union all select query_id, id, s, 0.0, g from xp)"""


@query("hybrid_expanded", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS.replace('pool as (', 'pool0 as (', 1).replace('ranked as (', EXPANDED + ', ranked as (', 1)}, {FINAL} select query_id, id, round(score + 0.2 * g::double, 9) as score, round(s, 9) as vec_score, case when g > 0 then 'graph' else 'ann' end as retrieval_source from scored qualify row_number() over (partition by query_id order by score + 0.2 * g::double desc nulls last, id) <= 10")
def hybrid_expanded(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    config = RecallConfig(expand_weight=0.2, expand_depth=2, expand_per_node=3)
    found = retrieval.recall_hybrid(_ask(lessons), lessons, table(spark, base, "mem_edge").distinct(), config, 10)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), F.round("vec_score", 9).alias("vec_score"), "retrieval_source")


@query("recall_router")
def recall_router(spark: SparkSession, base: str) -> DataFrame:
    """A third of the searches each with both signals, a vector alone and a text alone."""
    lessons = _all(spark, base)
    kind = F.col("query_id") % 3
    asked = _ask(lessons).withColumns({"v": F.when(kind < 2, F.col("v")), "text": F.when(kind != 1, F.col("text"))})
    return retrieval.recall_lessons(asked, lessons, None, CONFIG, 10).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query("entity_hybrid")
def entity_hybrid(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid retrieval by whole texts, with graph and entity expansion and proximity."""
    lessons = _all(spark, base)
    config = RecallConfig(expand_weight=0.2, entity_weight=0.1, graph_weight=0.2)
    asked = _ask(lessons).join(lessons.select(F.col("id").alias("query_id"), F.col("lesson_text").alias("t")), "query_id").select("query_id", "v", F.col("t").alias("text"))
    return retrieval.recall_hybrid(asked, lessons, table(spark, base, "mem_edge").distinct(), config, 10)


@query("situation_lookup", f"with {L}, {SEEN} select id, epoch_us(created_at) as created_us from seen where content_type is not null and topic like '[INCIDENT:worker\\_loss]%' escape '\\' order by created_at desc nulls last, id limit 10")
def situation_lookup(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.recall_situation(_all(spark, base), "class=worker_loss", CONFIG, 10).select("id", F.unix_micros("created_at").alias("created_us"))


# ---- graph ----

EDGES = "e as (select distinct * from mem_edge where valid_until is null or epoch_us(valid_until) >= 253370764800000000)"


@query(
    "causal_chain",
    f"""with recursive {EDGES}, h as (select distinct source_id, target_id, coalesce(weight, 1)::float as w from e where upper(relation_type) = 'CAUSED_BY'),
r(start, node, depth, path, pw) as (select distinct source_id, source_id, 0, [source_id], 1::float from h where source_id % 50 = 0
 union all select start, h.target_id, depth + 1, list_append(path, h.target_id), (pw * w)::float from r join h on h.source_id = r.node where depth < 3 and not list_contains(path, h.target_id))
select start, node, depth, list_aggregate(path, 'string_agg', '>') as path, round(pw::double, 5) as path_weight from r where depth > 0""",
)
def causal_chain(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "mem_edge").distinct()
    starts = graph.active(edges).filter("upper(relation_type) = 'CAUSED_BY' and source_id % 50 = 0").select(F.col("source_id").alias("start"), F.col("source_id").alias("node")).distinct()
    chain = graph.causal_chain(edges, starts, 3, ["CAUSED_BY"])
    return chain.select("start", "node", "depth", F.array_join(F.transform("path", lambda i: i.cast("string")), ">").alias("path"), F.round(F.col("path_weight").cast("double"), 5).alias("path_weight"))


@query(
    "temporal_window",
    f"""with {L}, n as (select s.id as start, o.id, abs(epoch_us(o.created_at) - epoch_us(s.created_at)) / 1e6 as delta_sec from l s join l o on o.id <> s.id
 and epoch_us(o.created_at) between epoch_us(s.created_at) - 900000000 and epoch_us(s.created_at) + 900000000 where s.id % 50 = 0),
g as (select a, b, max(weight) as w from (select source_id as a, target_id as b, weight from mem_edge union all select target_id, source_id, weight from mem_edge) group by all)
select start, id, delta_sec, a is not null as linked, round(w::double, 6) as edge_weight from (select * from n qualify row_number() over (partition by start order by delta_sec, id) <= 20) left join g on a = start and b = id""",
)
def temporal_window(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "created_at")
    return graph.temporal_window(lessons, table(spark, base, "mem_edge").distinct(), lessons.filter("id % 50 = 0")).withColumn("edge_weight", F.round(F.col("edge_weight").cast("double"), 6))


@query(
    "graph_proximity",
    """with h as (select distinct source_id, target_id from mem_edge where edge_kind in ('causal', 'temporal')),
a as (select distinct source_id as q from h where source_id % 50 = 0),
one as (select q, target_id as id, [q, target_id] as path from a join h on source_id = q where target_id <> q),
two as (select q, h.target_id as id from one join h on h.source_id = one.id where not list_contains(path, h.target_id)),
u as (select q, id, 0.5::double as p from one union all select q, id, 0.0 from two)
select q as query_id, id, max(p) as proximity from u group by all""",
)
def graph_proximity(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "mem_edge")
    anchors = edges.filter("edge_kind in ('causal', 'temporal') and source_id % 50 = 0").select(F.col("source_id").alias("query_id"), F.col("source_id").alias("id")).distinct()
    return graph.proximity(edges, anchors, ["causal", "temporal"])


@query(
    "graph_expand",
    """with h as (select distinct source_id, target_id, weight from mem_edge where valid_until is null and edge_kind = 'causal'),
a as (select distinct source_id as q from mem_edge where source_id % 50 = 0),
one as (select q, target_id as id, coalesce(weight, 1)::float as w from a join h on source_id = q and target_id <> q qualify row_number() over (partition by q order by weight desc nulls last, target_id) <= 3),
two as (select q, target_id as id, (w * coalesce(weight, 1)::float)::float as w from (select *, row_number() over () as p from one) o join h on source_id = o.id and target_id not in (q, o.id)
        qualify row_number() over (partition by p order by weight desc nulls last, target_id) <= 3)
select q as query_id, id, round(max(w)::double, 6) as graph_score from (select q, id, w from one union all select q, id, w from two) group by all""",
)
def graph_expand(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "mem_edge").distinct()
    anchors = edges.filter("source_id % 50 = 0").select(F.col("source_id").alias("query_id"), F.col("source_id").alias("id")).distinct()
    return graph.expand(edges, anchors, 2, 3).select("query_id", "id", F.round(F.col("graph_score").cast("double"), 6).alias("graph_score"))


@query(
    "entity_expand",
    f"""with {L}, k as (select distinct id, unnest(from_json(json_extract(metadata, '$.entity_keys'), '["varchar"]')) as key from l where is_active and json_extract(metadata, '$.entity_keys') is not null),
c as (select * from k qualify row_number() over (partition by key order by id) <= 50), q as (select id as query_id, key from k where id % 50 = 0)
select query_id, c.id, count(*) as key_overlap from q join c using (key) group by all""",
)
def entity_expand(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "metadata", "is_active")
    keys = lessons.filter("is_active and id % 50 = 0").select(F.col("id").alias("query_id"), F.explode(F.from_json(F.get_json_object("metadata", "$.entity_keys"), "array<string>")).alias("key"))
    return graph.entity_candidates(lessons, keys, 1, 50)


@query("edges_causal_same_run", f"with {L}, o as (select lag(id) over (partition by source_run_id order by created_at, id) as source_id, id as target_id from l where source_run_id is not null and created_at is not null) select source_id, target_id from o where source_id is not null")
def edges_causal_same_run(spark: SparkSession, base: str) -> DataFrame:
    return graph.causal_edges(_lessons(spark, base, "source_run_id", "created_at")).select("source_id", "target_id")


@query(
    "edges_temporal_30m",
    f"""with {L}, b as (select role, id, epoch_us(created_at) as t from l where created_at is not null)
select x.id as source_id, y.id as target_id, (y.t - x.t) / 1e6 as gap_sec from b x join b y on x.role = y.role and y.t - x.t between 0 and 1800000000 and (y.t > x.t or y.id > x.id)""",
)
def edges_temporal_30m(spark: SparkSession, base: str) -> DataFrame:
    return graph.temporal_edges(_lessons(spark, base, "role", "created_at"), F.col("role"))


CLAMPED = f"with {EDGES}, b as (select source_id, target_id, upper(relation_type) as relation_type, least(1.0, greatest(0.0, coalesce(weight::double, 1.0))) as w, updated_at, id from e where source_id <> target_id)"


@query("edge_upsert_max", CLAMPED + " select source_id, target_id, relation_type, round(max(w), 6) as weight from b group by all")
def edge_upsert_max(spark: SparkSession, base: str) -> DataFrame:
    return graph.upsert(table(spark, base, "mem_edge").distinct(), "max").withColumn("weight", F.round("weight", 6))


@query("edge_upsert_replace", CLAMPED + " select source_id, target_id, relation_type, round(w, 6) as weight from b qualify row_number() over (partition by source_id, target_id, relation_type order by updated_at desc, id desc) = 1")
def edge_upsert_replace(spark: SparkSession, base: str) -> DataFrame:
    return graph.upsert(table(spark, base, "mem_edge").distinct(), "replace").withColumn("weight", F.round("weight", 6))


@query("edge_upsert_avg", CLAMPED + ", g as (select source_id, target_id, relation_type, list(w order by updated_at, id) as ws from b group by all) select source_id, target_id, relation_type, round(list_reduce(ws, lambda a, x: (a + x) / 2), 6) as weight from g")
def edge_upsert_avg(spark: SparkSession, base: str) -> DataFrame:
    return graph.upsert(table(spark, base, "mem_edge").distinct(), "avg").withColumn("weight", F.round("weight", 6))


@query(
    "edge_metadata",
    f"""with {EDGES}, b as (select source_id, target_id, upper(relation_type) as relation_type, metadata, updated_at, id from e where source_id <> target_id),
p as (select *, unnest(json_keys(metadata)) as k from b where metadata is not null), v as (select source_id, target_id, relation_type, k, json_extract_string(metadata, '$.' || k) as v from p qualify row_number() over (partition by source_id, target_id, relation_type, k order by updated_at desc, id desc) = 1),
m as (select source_id, target_id, relation_type, string_agg(k || '=' || v, ',' order by k) as entries from v group by all), d as (select distinct source_id, target_id, relation_type from b)
select d.*, coalesce(entries, '') as entries from d left join m using (source_id, target_id, relation_type)""",
)
def edge_metadata(spark: SparkSession, base: str) -> DataFrame:
    """The merged metadata of each open edge."""
    merged = graph.merged_metadata(table(spark, base, "mem_edge").distinct())
    entries = F.transform(F.array_sort(F.map_entries(F.from_json("metadata", "map<string,string>"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("source_id", "target_id", "relation_type", F.coalesce(F.array_join(entries, ","), F.lit("")).alias("entries"))


@query("relation_merge", "select source_id, target_id, upper(relation_type) as relation_type, round(max(weight)::double, 6) as confidence, count(*) as times from (select distinct * from mem_edge) group by all")
def relation_merge(spark: SparkSession, base: str) -> DataFrame:
    return writes.merge_relations(table(spark, base, "mem_edge").distinct()).withColumn("confidence", F.round(F.col("confidence").cast("double"), 6))


# ---- navigation ----


@query(
    "navigate_budget",
    f"""with {L}, {SEEN}, r as (select id as i, role, length(lesson_text) as chars, coalesce(importance, 0)::double as s from seen),
x as (select role, i as id, chars, sum(chars) over (partition by role order by s desc, i range between unbounded preceding and current row) as running_chars from r)
select role, id, chars, running_chars::bigint as running_chars from x where running_chars <= 5000""",
)
def navigate_budget(spark: SparkSession, base: str) -> DataFrame:
    rows = see.visible(_lessons(spark, base, "role", "lesson_text", "importance", "is_active", "verified_at", "t_valid_to"), CONFIG)
    ranked = rows.select(F.col("role").alias("query_id"), "id", F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("score"), F.length("lesson_text").alias("chars"))
    return navigate.within_budget(ranked, 5000).select(F.col("query_id").alias("role"), "id", "chars", "running_chars")


LOCATED = f"""tp as (select query_id, id, w / (w + 1) as b from (select query_id, id, len(list_filter({TOK.format('topic')}, lambda t: t = text)) * 1.0 + len(list_filter({TOK.format('lesson_text')}, lambda t: t = text)) * 0.4 as w from ask, seen where text is not null) where w > 0),
vp as (select query_id, id, {COS} as s from ask, seen where {GOOD} and {GOOD.replace('embedding', 'v')}), {POOLS[POOLS.index('pool as ('):]},
ns as (select query_id, f.id, left(lesson_text, 120) as preview, length(lesson_text) as chars, rrf + (0.8::double / 61 / 0.76) * (0.05 * importance / 5.0 + 0.05 * greatest(0.0, 1 - least(({NOW_US} - epoch_us(created_at)) / 1e6 / 7776000.0, 1.0))
 + 0.05 * case when commit_sha is not null and verified_at is not null then 1.0 when commit_sha is not null then 0.4 else 0.0 end) as score from fused f join seen using (id)),
nr as (select *, sum(chars) over (partition by query_id order by score desc nulls last, id rows unbounded preceding) as running_chars from ns)"""


@query("navigate_locate", f"with {L}, {SEEN}, {ASK}, {LOCATED} select query_id, id, preview, round(score, 9) as score, chars, running_chars::bigint as running_chars from nr where running_chars <= 2000")
def navigate_locate(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return navigate.locate(_ask(lessons), lessons, None, CONFIG, 2000).drop("path").withColumn("score", F.round("score", 9))


@query(
    "navigate_expand",
    f"""with {L}, {EDGES}, live as (select * from l where is_active and epoch_us(t_valid_to) = 253370764800000000),
u as (select source_id as a, target_id as b, weight from e union all select target_id, source_id, weight from e), h as (select distinct a, b from u where weight >= 0.5::float and b in (select id from live)),
s as (select id from live where id % 50 = 0), one as (select s.id as start, b as id from s join h on a = s.id where b <> s.id),
two as (select start, h.b as id from one join h on a = one.id where h.b not in (start, one.id)),
n as (select start, x.id, min(d) as depth from (select start, id, 1 as d from one union all select start, id, 2 from two) x where x.id % 50 <> 0 group by all),
g as (select start as id, string_agg(n.id::varchar, ',' order by depth, n.id) as neighbour_ids, string_agg(left(lesson_text, 50), '|' order by depth, n.id) as neighbour_previews from n join live on live.id = n.id group by start),
r as (select id, 'content' as path from s union all select distinct id, 'graph_expand' from n)
select r.id, path, case when json_extract(metadata, '$.lang') is not null then json_extract_string(metadata, '$.lang') end as lang, coalesce(neighbour_ids, '') as neighbour_ids, coalesce(neighbour_previews, '') as neighbour_previews,
 sum(length(lesson_text)) over (order by r.id)::bigint as running_chars from r join live using (id) left join g on g.id = r.id and path = 'content'""",
)
def navigate_expand(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "lesson_text", "metadata", "is_active", "t_valid_to")
    found = navigate.expand(lessons, table(spark, base, "mem_edge").distinct(), lessons.filter("id % 50 = 0").select("id"), 2, 0.5, fields=["lang"])
    ids = F.array_join(F.transform("neighbour_ids", lambda i: i.cast("string")), ",")
    return found.select("id", "path", F.get_json_object("detail", "$.lang").alias("lang"), F.coalesce(ids, F.lit("")).alias("neighbour_ids"), F.coalesce(F.array_join("neighbour_previews", "|"), F.lit("")).alias("neighbour_previews"), "running_chars")


@query("typed_projection", f"with {L} select id, case content_type when 'entity' then topic when 'relation' then left(lesson_text, 200) else lesson_text end as content from l")
def typed_projection(spark: SparkSession, base: str) -> DataFrame:
    return navigate.typed_projection(_lessons(spark, base, "content_type", "topic", "lesson_text", "importance", "item_kind")).select("id", "content")


# ---- text functions ----


def _sql_word(*patterns: str) -> str:
    body = "|".join(p.replace("'", "''") for p in patterns)
    return f"regexp_matches(lesson_text, '(?is)(^|[^\\p{{L}}\\p{{N}}_])({body})($|[^\\p{{L}}\\p{{N}}_])')"


CLASSIFY_SQL = f"""case when {_sql_word(*text.INCIDENT)} or ({_sql_word(text.INCIDENT_BOTH[0])} and {_sql_word(text.INCIDENT_BOTH[1])}) then 'incident'
 when {_sql_word(*text.DECISION)} or regexp_matches(lesson_text, '(?is)(^|[^\\p{{L}}\\p{{N}}_])ADR[-\\s]?[0-9]') or regexp_matches(lesson_text, '(?is)we (chose|selected|adopted|agreed|preferred?|decided)($|[^\\p{{L}}\\p{{N}}_])')
  or ({_sql_word(text.DECISION_BOTH[0])} and {_sql_word(text.DECISION_BOTH[1])}) then 'decision'
 when {_sql_word(*text.ENTITY)} then 'entity'
 when {_sql_word(*text.FACT)} and not {_sql_word('when')} and not {_sql_word(text.ACTION)} then 'fact'
 when {_sql_word(*text.PROCEDURE)} then 'procedure' end"""


@query("classify", f"with {L} select id, {CLASSIFY_SQL} as kind from l")
def classify(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "lesson_text").select("id", text.classify_content_type(F.col("lesson_text")).alias("kind"))


@query("entity_keys")
def entity_keys(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "lesson_text").select("id", F.array_join(text.entity_keys(F.col("lesson_text")), ",").alias("keys"))


@query("situation_keys", f"with {L} select id, case when regexp_matches(topic, '^\\[INCIDENT:[a-z0-9_]+\\]') then 'class=' || regexp_extract(topic, '^\\[INCIDENT:([a-z0-9_]+)\\]', 1) when regexp_matches(lesson_text, 'failure_class=[A-Z0-9_]+') then 'class=' || regexp_extract(lesson_text, 'failure_class=([A-Z0-9_]+)', 1) || case when regexp_matches(lesson_text, 'outcome=[A-Z]+') then '|outcome=' || regexp_extract(lesson_text, 'outcome=([A-Z]+)', 1) else '' end when contains(lesson_text, 'outcome=COMPLETED') then 'class=completed' end as situation from l")
def situation_keys(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "topic", "lesson_text").select("id", text.situation_key(F.col("topic"), F.col("lesson_text")).alias("situation"))


@query("slugs", f"with {L}, s as (select id, trim(regexp_replace(lower(topic), '[^a-z0-9]+', '_', 'g'), '_') as p from l) select id, case when length(p) > 64 then 'concept:' || rtrim(regexp_replace(left(p, 64), '_[^_]*$', ''), '_') when p <> '' then 'concept:' || p end as slug from s")
def slugs(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "topic").select("id", text.canonical_slug(F.lit("concept"), F.col("topic")).alias("slug"))


@query("content_hashes", f"with {L} select id, md5(coalesce(role, '') || '|' || coalesce(topic, '') || '|' || coalesce(commit_sha, artifact_hash, '')) as hash from l")
def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "role", "topic", "commit_sha", "artifact_hash").select("id", text.content_hash(*(F.col(c) for c in ("role", "topic", "commit_sha", "artifact_hash"))).alias("hash"))


@query("ingest_quality", f"with {L}, t as (select id, lesson_text, string_split(regexp_replace(trim(lesson_text), '\\s+', ' ', 'g'), ' ') as w from l) select id, case when lesson_text is null or length(trim(lesson_text)) < 20 then 'too_short' when list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) / len(w) > 0.8 then 'repetitive' end as verdict from t")
def ingest_quality(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "lesson_text").select("id", text.quality_error(F.col("lesson_text")).alias("verdict"))


@query("edge_kinds", "select id, case when relation_type in ('CAUSED_BY', 'DERIVED_FROM', 'CONTRADICTS') then 'causal' when relation_type in ('CO_OCCURRED', 'PRECEDED_BY') then 'temporal' when relation_type in ('ENTITY_LINK', 'SHARED_TAG', 'IS_A', 'PART_OF') then 'entity' else 'semantic' end as kind from (select distinct id, upper(relation_type) as relation_type from mem_edge)")
def edge_kinds(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "mem_edge").select("id", F.upper("relation_type").alias("r")).distinct().select("id", text.edge_kind(F.col("r")).alias("kind"))


@query("token_costs", f"with {L} select id, greatest(1, ceil(octet_length(encode(lesson_text)) / 4.0))::bigint as tokens from l")
def token_costs(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "lesson_text").select("id", text.token_cost(F.col("lesson_text")).alias("tokens"))


# ---- writes and curation ----


@query("fact_versions", f"with {L}, o as (select lower(topic) as entity, state as value, id, created_at, lag(state) over (partition by lower(topic) order by created_at nulls first, id) as b, lag(id) over (partition by lower(topic) order by created_at nulls first, id) as p from l), v as (select *, sum(case when p is not null and b is not distinct from value then 0 else 1 end) over (partition by entity order by created_at nulls first, id rows unbounded preceding) as version from o) select entity, version::bigint as version, any_value(value) as value from v group by entity, version")
def fact_versions(spark: SparkSession, base: str) -> DataFrame:
    facts = _lessons(spark, base, "topic", "state", "created_at", "confidence").select("id", F.col("topic").alias("entity"), F.lit("state").alias("property"), F.col("state").alias("value"), "confidence", F.col("created_at").alias("at"))
    return writes.fact_versions(facts).select("entity", "version", "value")


@query("event_idempotent", f"with {L} select lower(topic) as topic, coalesce(project_id, -1) as project_id, id from l qualify row_number() over (partition by lower(topic), project_id order by created_at nulls first, id) = 1")
def event_idempotent(spark: SparkSession, base: str) -> DataFrame:
    return writes.first_events(_lessons(spark, base, "topic", "project_id", "created_at").select("id", "topic", "project_id", "created_at"), "topic", "project_id", "created_at").select("topic", F.coalesce("project_id", F.lit(-1)).alias("project_id"), "id")


@query("ingest_batch")
def ingest_batch(spark: SparkSession, base: str) -> DataFrame:
    lessons = current_lessons(spark, base, "role", "topic", "lesson_text", "metadata", "embedding", "project_id", "content_type", "commit_sha", "artifact_hash", "is_active", "t_valid_to", wide=True)
    accepted, refused = writes.ingest(lessons, lessons, 64)
    return accepted.select(F.lit("accepted").alias("outcome")).unionByName(refused.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("confidence_posterior", f"with {L} select id, round((success_count + 1.0) / (success_count + fail_count + 2.0), 9) as confidence from l")
def confidence_posterior(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "success_count", "fail_count").select("id", F.round(lifecycle.posterior(F.col("success_count"), F.col("fail_count")), 9).alias("confidence"))


@query("stale_lessons", f"with {L}, s as (select *, ({NOW_US} - epoch_us(coalesce(last_recalled_at, created_at))) / 86400000000 as idle from l where is_active and state not in ('deprecated', 'archived', 'rejected')) select id, round(idle, 6) as idle_days, coalesce(confidence < 0.6::float and importance < 5, false) and commit_sha is null and artifact_hash is null as would_deprecate, row_number() over (order by last_recalled_at is not null, last_recalled_at, coalesce(epoch_us(created_at), 0), id) as position from s where idle > 45")
def stale_lessons(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "is_active", "state", "last_recalled_at", "created_at", "confidence", "importance", "commit_sha", "artifact_hash")
    return lifecycle.stale(rows, CONFIG).withColumn("idle_days", F.round("idle_days", 6))


CONSOLIDATED = f"""with recursive {L}, c as (select * from l where is_active and state not in ('superseded', 'archived', 'rejected') and embedding is not null
 order by recall_count desc nulls first, case when isnan(confidence) then 'infinity'::float else confidence end desc nulls first, importance desc nulls first, created_at nulls last, id limit 2000), u as (select * from c where {GOOD} and role is not null),
p as (select a.id as a, b.id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) as sim from u a join u b on a.id < b.id and a.role = b.role where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.92),
y as (select a, b from p union select b, a from p), r(a, b) as (select a, b from y union select r.a, y.b from r join y on y.a = r.b), g as (select a as id, least(a, min(b)) as root from r group by a),
m as (select root, avg(sim) as mean_sim from p join g on g.id = a group by root),
o as (select g.root, list(c.id order by coalesce(recall_count, 0) desc, coalesce(case when isnan(confidence) then 'infinity'::double else confidence end, 0) desc, coalesce(importance, 0) desc, created_at nulls last, c.id) as ids from g join c using (id) group by g.root)
select ids[1] as canonical_id, list_aggregate(ids[2:], 'string_agg', ',') as member_ids, len(ids)::integer as size, round(mean_sim, 9) as mean_sim from o join m using (root) order by size desc, round(mean_sim, 9) desc, canonical_id limit 100"""


def _consolidated(spark: SparkSession, base: str, every: bool) -> DataFrame:
    lessons = _lessons(spark, base, "is_active", "state", "embedding", "role", "recall_count", "confidence", "importance", "created_at", wide=every)
    return lifecycle.consolidate(lessons, 0.92, 100, every=every).withColumn("mean_sim", F.round("mean_sim", 9))


@query("consolidate_clusters", CONSOLIDATED)
def consolidate_clusters(spark: SparkSession, base: str) -> DataFrame:
    return _consolidated(spark, base, every=False)


@query("consolidate_every")
def consolidate_every(spark: SparkSession, base: str) -> DataFrame:
    """All active lessons compared in blocks, not the first 2,000 only; the limit is that of the report."""
    return _consolidated(spark, base, every=True)


@query("reclassify_distribution", f"with {L}, k as (select coalesce(content_type, 'none') as b, coalesce(case when content_type is null or content_type in ('incident', 'decision', 'entity', 'fact', 'procedure') then {CLASSIFY_SQL} else content_type end, 'none') as a from l), u as (select b as content_type, 1 as x, 0 as y from k union all select a, 0, 1 from k) select content_type, sum(x)::bigint as before, sum(y)::bigint as after from u group by content_type")
def reclassify_distribution(spark: SparkSession, base: str) -> DataFrame:
    return lifecycle.reclassified(_lessons(spark, base, "content_type", "lesson_text"))


@query(
    "corpus_stats",
    f"""with {L}, c as (select *, case when confidence between 0 and 1 and not isnan(confidence) then confidence::double end as conf, {GOOD} as good from l)
select count(*) as total, sum(is_active::int)::bigint as active, count(distinct role) as roles, count(distinct project_id) as projects,
round(100.0 * avg(good::int), 2) as embedded_pct, round(100.0 * avg((verified_at is not null)::int), 2) as verified_pct, round(100.0 * avg((commit_sha is not null)::int), 2) as provenance_pct,
round(avg(conf), 9) as mean_confidence, round(quantile_cont(conf, 0.1), 9) as confidence_p10, round(quantile_cont(conf, 0.5), 9) as confidence_p50, round(quantile_cont(conf, 0.9), 9) as confidence_p90,
epoch_us(min(created_at)) as oldest_us from c""",
)
def corpus_stats(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "is_active", "role", "project_id", "embedding", "verified_at", "commit_sha", "confidence", "created_at")
    out = lifecycle.corpus_stats(rows, 64)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_confidence", "confidence_p10", "confidence_p50", "confidence_p90")})


@query(
    "store_stats",
    f"""with {L}, v as (select * from l where epoch_us(t_valid_to) = 253370764800000000), t as (select count(*) as lesson_count, count(embedding) as embedded_count,
 round(100.0 * avg((embedding is not null)::int), 2) as embedding_coverage_pct, round(100.0 * avg((coalesce(topic, lesson_text) is not null)::int), 2) as tsv_coverage_pct,
 round_even(({NOW_US} - epoch_us(min(created_at))) / 86400000000, 0)::integer as oldest_lesson_age_days from l),
w as (select count(*) filter (where verified_at is null) as ghost_count, round(avg(confidence::double), 6) as confidence_mean, round(quantile_cont(confidence::double, 0.1), 6) as confidence_p10,
 round(quantile_cont(confidence::double, 0.5), 6) as confidence_p50, round(quantile_cont(confidence::double, 0.9), 6) as confidence_p90, (count(*) filter (where confidence < 0.3::float))::integer as confidence_below_threshold_count from v)
select '1' as version, t.*, (select count(*) from mem_edge) as mem_edge_count, w.*, 0.05::double as recency_weight, 100 as ef_search, 0.15::double as importance_weight, true as hybrid_enabled, true as recall_hybrid_available, 0 as orphan_count,
 0.0::double as graph_expand_weight, 1 as graph_expand_depth, 15 as graph_expand_ann_k, 10 as graph_expand_per_node, 0.0::double as graph_entity_expand_weight, 1 as graph_entity_min_overlap, 50 as graph_entity_max_expansion from t, w""",
)
def store_stats(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "embedding", "topic", "lesson_text", "created_at", "verified_at", "t_valid_to", "confidence")
    out = lifecycle.stats(lessons, table(spark, base, "mem_edge"), CONFIG, "1")
    return out.withColumns({c: F.round(c, 6) for c in ("confidence_mean", "confidence_p10", "confidence_p50", "confidence_p90")})


@query("embedding_policy", f"with {L} select content_type, count(*) as embedded from l where content_type in ('entity', 'fact', 'relation', 'temporal') and embedding is not null group by content_type")
def embedding_policy(spark: SparkSession, base: str) -> DataFrame:
    return lifecycle.embedding_policy(_lessons(spark, base, "content_type", "embedding"), 64)


@query("policy_counts", f"with {L}, c as (select content_type, count(*) as n from l where content_type in ('entity', 'fact', 'relation', 'temporal') and embedding is not null group by content_type) select '{{' || string_agg('\"' || content_type || '\":' || n, ',' order by content_type) || '}}' as counts from c having count(*) > 0")
def policy_counts(spark: SparkSession, base: str) -> DataFrame:
    """What the selective policy drops, as one JSON object: before less after."""
    lessons = _lessons(spark, base, "content_type", "embedding").filter("embedding is not null")
    return lifecycle.counts_json(lifecycle.apply_embedding_policy(lessons).filter("embedding is null"), "content_type")


@query("freshness_year", f"with {L} select id, round(greatest(0.0, 1 - least(({NOW_US} - epoch_us(coalesce(t_valid_from, created_at))) / 1e6 / 31536000.0, 1.0)), 9) as freshness, strftime(created_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as created_iso from l")
def freshness_year(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "t_valid_from", "created_at")
    fresh = retrieval.recency(F.coalesce("t_valid_from", "created_at"), CONFIG, 365)
    return rows.select("id", F.round(fresh, 9).alias("freshness"), text.iso_utc(F.col("created_at")).alias("created_iso"))


@query("ingest_batches", "select source_origin, count(*) as batches, count(*) filter (where retired_at is null) as open, sum(max_id - coalesce(min_id, max_id))::bigint as width from memory_ingest_log group by source_origin")
def ingest_batches(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "memory_ingest_log")
    return log.groupBy("source_origin").agg(F.count("*").alias("batches"), F.sum(F.col("retired_at").isNull().cast("int")).alias("open"), F.sum(F.col("max_id") - F.coalesce("min_id", "max_id")).alias("width"))


# ---- evaluation ----

RANKERS = """c as (select * from recall_candidate qualify row_number() over (partition by query_id, lesson_id order by scored_at desc, raw_vec_score desc nulls last, raw_bm25_score desc nulls last) = 1),
v as (select query_id, lesson_id as id, row_number() over (partition by query_id order by raw_vec_score desc nulls last, lesson_id) as rank from c),
b as (select query_id, lesson_id as id, row_number() over (partition by query_id order by raw_bm25_score desc nulls last, lesson_id) as rank from c)"""


def _rankers(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    from lorekeep.sources.tables import latest

    c = latest(table(spark, base, "recall_candidate"), ["query_id", "lesson_id"], "scored_at")
    by = lambda s: Window.partitionBy("query_id").orderBy(F.desc_nulls_last(s), "lesson_id")
    return tuple(c.select("query_id", F.col("lesson_id").alias("id"), F.row_number().over(by(s)).alias("rank")) for s in ("raw_vec_score", "raw_bm25_score"))


@query("recall_at_k", f"with {RANKERS}, rel as (select query_id, id from b where rank <= 3), h as (select r.query_id, v.rank from rel r left join v using (query_id, id)) select query_id, max((rank <= 1)::int) as hit_1, sum((rank <= 1)::int) / count(*) as recall_1, max((rank <= 5)::int) as hit_5, sum((rank <= 5)::int) / count(*) as recall_5, max((rank <= 10)::int) as hit_10, sum((rank <= 10)::int) / count(*) as recall_10, round(1.0 / min(rank), 9) as rr from h group by query_id")
def recall_at_k(spark: SparkSession, base: str) -> DataFrame:
    v, b = _rankers(spark, base)
    return evaluation.per_query(v, b.filter("rank <= 3")).withColumn("rr", F.round("rr", 9))


@query("overlap_at_k", f"with {RANKERS} select v.query_id, count(b.id) / 10 as overlap from v left join (select * from b where rank <= 10) b on b.query_id = v.query_id and b.id = v.id where v.rank <= 10 group by v.query_id")
def overlap_at_k(spark: SparkSession, base: str) -> DataFrame:
    v, b = _rankers(spark, base)
    return evaluation.overlap(v, b, 10)


@query("overlap_summary", f"with {RANKERS}, o as (select v.query_id, count(b.id) / 10 as overlap from v left join (select * from b where rank <= 10) b on b.query_id = v.query_id and b.id = v.id where v.rank <= 10 group by v.query_id) select count(*) as queries, round(avg(overlap), 9) as mean, round(quantile_cont(overlap, 0.5), 9) as median, round(quantile_cont(overlap, 0.1), 9) as p10 from o")
def overlap_summary(spark: SparkSession, base: str) -> DataFrame:
    v, b = _rankers(spark, base)
    return evaluation.overlap_summary(evaluation.overlap(v, b, 10)).withColumns({c: F.round(c, 9) for c in ("mean", "median", "p10")})


ARMS = f"with {L}, s as (select role, confidence::double as x, success_count as s, success_count + fail_count as n from l where confidence between 0 and 1 and not isnan(confidence))"


@query("mean_ci", ARMS + " select role, count(x) as n, round(avg(x), 9) as mean, round(avg(x) - 1.96 * sqrt(coalesce(var_samp(x), 0) / count(x)), 9) as low, round(avg(x) + 1.96 * sqrt(coalesce(var_samp(x), 0) / count(x)), 9) as high from s group by role")
def mean_ci(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "role", "confidence").filter("confidence between 0 and 1")
    return evaluation.mean_ci(rows, "confidence", ["role"]).withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})


@query("wilson_intervals", ARMS + f", t as (select role, sum(s)::double as k, sum(n)::double as m from s group by role having sum(n) > 0), z as (select *, k / m as p, {evaluation.Z * evaluation.Z} as z2 from t) select role, round((p + z2 / (2 * m)) / (1 + z2 / m) - {evaluation.Z} * sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m), 9) as low, round((p + z2 / (2 * m)) / (1 + z2 / m) + {evaluation.Z} * sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / (1 + z2 / m), 9) as high from z")
def wilson_intervals(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "role", "confidence", "success_count", "fail_count").filter("confidence between 0 and 1")
    t = rows.groupBy("role").agg(F.sum("success_count").cast("double").alias("k"), F.sum(F.col("success_count") + F.col("fail_count")).cast("double").alias("m")).filter("m > 0")
    low, high = evaluation.wilson(F.col("k"), F.col("m"))
    return t.select("role", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("mcnemar_rankers", f"with {RANKERS}, p as (select v.query_id, bool_or(v.rank <= 5 and b.rank <= 1) as x, bool_or(b.rank <= 5 and v.rank <= 1) as y from v join b using (query_id, id) group by v.query_id), t as (select count(*) filter (where x and not y) as only_a, count(*) filter (where not x and y) as only_b from p) select only_a, only_b, round(coalesce(power(greatest(abs(only_a - only_b) - 1, 0), 2) / nullif(only_a + only_b, 0), 0), 9) as statistic from t")
def mcnemar_rankers(spark: SparkSession, base: str) -> DataFrame:
    v, b = _rankers(spark, base)
    both = v.join(b.withColumnRenamed("rank", "other"), ["query_id", "id"]).groupBy("query_id").agg(F.max((F.col("rank") <= 5) & (F.col("other") <= 1)).alias("x"), F.max((F.col("other") <= 5) & (F.col("rank") <= 1)).alias("y"))
    return evaluation.mcnemar(both, "x", "y").withColumn("statistic", F.round("statistic", 9))


@query("welch_arms", ARMS + ", a as (select avg(x) filter (role = 'agent_dispatch') as m1, var_samp(x) filter (role = 'agent_dispatch') as v1, count(*) filter (role = 'agent_dispatch') as n1, avg(x) filter (role = 'backend_engineer') as m2, var_samp(x) filter (role = 'backend_engineer') as v2, count(*) filter (role = 'backend_engineer') as n2 from s) select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 6) as df from a")
def welch_arms(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "role", "confidence").filter("confidence between 0 and 1")
    out = evaluation.welch(rows, "role", "confidence", "agent_dispatch", "backend_engineer")
    return out.select(F.round("t", 6).alias("t"), F.round("df", 6).alias("df"))


@query("holm_adjusted")
def holm_adjusted(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "role", "success_count", "fail_count")
    t = rows.groupBy("role").agg(F.sum("success_count").cast("double").alias("k"), F.sum(F.col("success_count") + F.col("fail_count")).cast("double").alias("m")).filter("m > 0").withColumn("family", F.lit(0))
    rest = t.agg(F.sum("k").alias("all_k"), F.sum("m").alias("all_m"))
    z = evaluation.two_proportion_z(F.col("k"), F.col("m"), F.col("all_k") - F.col("k"), F.col("all_m") - F.col("m"))
    return evaluation.holm(t.crossJoin(F.broadcast(rest)).withColumn("p", evaluation.normal_p(z)), "family", "role", "p").select("role", "p", "p_holm")


@query("paired_t", f"with {L}, d as (select success_count - fail_count as d from l) select count(*) as n, round(avg(d), 9) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t from d")
def paired_t(spark: SparkSession, base: str) -> DataFrame:
    out = evaluation.paired_t(_lessons(spark, base, "success_count", "fail_count"), "success_count", "fail_count")
    return out.select("n", F.round("mean", 9).alias("mean"), F.round("t", 6).alias("t"))


@query("chi_square", f"with {L}, o as (select chr((('0x' || substr(sha256(id::varchar), 1, 8))::bigint % 3 + 65)::int) as a, coalesce(last_outcome, 'none') as b from l), c as (select a, b, count(*) as n from o group by all), x as (select a, sum(n) as na from c group by a), y as (select b, sum(n) as nb from c group by b), t as (select sum(n) as n from c), e as (select na * nb / t.n as e, coalesce(c.n, 0) as o from x cross join y cross join t left join c using (a, b)) select round(sum((o - e) * (o - e) / e), 6) as statistic, ((select count(*) from x) - 1) * ((select count(*) from y) - 1) as df from e")
def chi_square(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "last_outcome").select(evaluation.arm(F.col("id")).alias("arm"), F.coalesce("last_outcome", F.lit("none")).alias("outcome"))
    return evaluation.chi_square(rows, "arm", "outcome").withColumn("statistic", F.round("statistic", 6))


@query("cliffs_delta", ARMS + ", a as (select role, x, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as r from s where role in ('agent_dispatch', 'backend_engineer')), c as (select sum(r) filter (role = 'agent_dispatch') as r1, count(*) filter (role = 'agent_dispatch') as n1, count(*) filter (role = 'backend_engineer') as n2 from a) select round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1, 9) as delta from c")
def cliffs_delta(spark: SparkSession, base: str) -> DataFrame:
    rows = _lessons(spark, base, "role", "confidence").filter("confidence between 0 and 1")
    return evaluation.cliffs_delta(rows, "role", "confidence", "agent_dispatch", "backend_engineer").select(F.round("delta", 9).alias("delta"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, base: str) -> DataFrame:
    v, b = _rankers(spark, base)
    return evaluation.bootstrap_mean(evaluation.per_query(v, b.filter("rank <= 3")), "rr")


# ---- streams ----


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex[:8]}"


@query("stream_outcomes", "select id, sum((last_outcome = 'success')::int)::bigint as successes, sum((last_outcome = 'failure')::int)::bigint as failures, round((sum((last_outcome = 'success')::int) + 1.0) / (sum((last_outcome = 'success')::int) + sum((last_outcome = 'failure')::int) + 2.0), 9) as confidence from agent_lesson where last_outcome is not null group by id")
def stream_outcomes(spark: SparkSession, base: str) -> DataFrame:
    events = streams.source(spark, f"{base}/agent_lesson.parquet").filter("last_outcome is not null").select("id", F.col("last_outcome").alias("outcome"), F.lit(True).alias("used"))
    done = streams.drain(streams.outcomes(events), _name("outcomes"), mode="complete")
    return done.select("id", "successes", "failures", F.round("confidence", 9).alias("confidence"))


@query("stream_recalls", "select epoch_us(last_recalled_at) // 86400000000 as day, count(*) as recalls from agent_lesson where last_recalled_at is not null group by day")
def stream_recalls(spark: SparkSession, base: str) -> DataFrame:
    events = streams.source(spark, f"{base}/agent_lesson.parquet").filter("last_recalled_at is not null").select(F.col("last_recalled_at").alias("at"))
    done = streams.drain(streams.recalls_by_time(events, "at"), _name("recalls"), mode="complete")
    return done.select(F.floor(F.unix_micros("window.start") / 86_400_000_000).alias("day"), "recalls")


@query("export_blocks", f"with {L} select item_kind, count(*) as blocks, sum(length('---' || chr(10) || 'id: ' || id || chr(10) || 'role: ' || role || chr(10) || 'state: ' || state || chr(10) || '---' || chr(10) || '## ' || topic || chr(10) || chr(10) || lesson_text || chr(10)))::bigint as chars from l group by item_kind")
def export_blocks(spark: SparkSession, base: str) -> DataFrame:
    blocks = files.markdown_blocks(_lessons(spark, base, "item_kind", "created_at", "role", "state", "topic", "lesson_text"))
    return blocks.groupBy("item_kind").agg(F.count("*").alias("blocks"), F.sum(F.length("block")).alias("chars"))


# ---- more of the surveyed surface ----


@query(
    "tfidf_topk",
    f"""with {L}, d as (select id, regexp_extract_all(lower(lesson_text), '[a-z0-9]+') as w from l), q0 as (select id as query_id, regexp_extract_all(lower(topic), '[a-z0-9]+') as w from l where id % 50 = 0),
n as (select count(*) as n from l), t as (select id, unnest(list_distinct(w)) as term, w from d), p as (select id, term, len(list_filter(w, lambda x: x = term)) as tf from t),
df as (select term, ln(n / count(*)) as idf from p, n group by term, n), wd as (select id, term, tf * idf as w from p join df using (term)), dn as (select id, sqrt(sum(w * w)) as dn from wd group by id),
tq as (select query_id, unnest(list_distinct(w)) as term, w from q0), wq as (select query_id, term, len(list_filter(w, lambda x: x = term)) * idf as qw from tq join df using (term)), qn as (select query_id, sqrt(sum(qw * qw)) as qn from wq group by query_id),
s as (select query_id, id, sum(w * qw) as dot from wd join wq using (term) group by all)
select query_id, id, round(coalesce(dot / nullif(dn * qn, 0), 0), 6) as score from s join dn using (id) join qn using (query_id) qualify row_number() over (partition by query_id order by round(coalesce(dot / nullif(dn * qn, 0), 0), 9) desc, id) <= 10""",
)
def tfidf_topk(spark: SparkSession, base: str) -> DataFrame:
    lessons = _lessons(spark, base, "topic", "lesson_text")
    scored = lexical.tfidf_cosine(lessons, "id", "lesson_text", lessons.filter("id % 50 = 0").select("id", "topic"), "id", "topic", 10)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("_r", F.row_number().over(order)).filter("_r <= 10").select("query_id", "id", F.round("score", 6).alias("score"))


@query("token_f1", f"with {L}, t as (select id, list_distinct(regexp_extract_all(lower(topic), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(lesson_text), '[a-z0-9]+')) as b from l) select id, round(case when len(list_intersect(a, b)) > 0 then 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) else 0.0 end, 9) as f1 from t")
def token_f1(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base, "topic", "lesson_text").select("id", F.round(lexical.token_f1(F.col("topic"), F.col("lesson_text")), 9).alias("f1"))


@query("evict_expired", f"with {L} select id from l where expires_at is null or epoch_us(expires_at) >= {NOW_US}")
def evict_expired(spark: SparkSession, base: str) -> DataFrame:
    return lifecycle.evict_expired(_lessons(spark, base, "expires_at"), CONFIG).select("id")


@query("recall_marks", f"with {L}, r as (select lesson_id as id, count(*) as n from recall_candidate group by lesson_id) select l.id, coalesce(recall_count, 0) + coalesce(n, 0) as recall_count from l left join r using (id)")
def recall_marks(spark: SparkSession, base: str) -> DataFrame:
    log = table(spark, base, "recall_candidate").select(F.col("lesson_id").alias("id"), F.col("scored_at").alias("at"))
    return lifecycle.mark_recalled(_lessons(spark, base, "recall_count", "last_recalled_at"), log).select("id", "recall_count")


@query("stats_cube", f"with {L} select coalesce(item_kind, 'all') as item_kind, coalesce(source_type, 'all') as source_type, count(*) as n, sum(is_active::int)::bigint as active from l group by cube (item_kind, source_type)")
def stats_cube(spark: SparkSession, base: str) -> DataFrame:
    rows = lifecycle.stats_by(_lessons(spark, base, "item_kind", "source_type", "is_active", "confidence"), "item_kind", "source_type")
    return rows.select(F.coalesce("item_kind", F.lit("all")).alias("item_kind"), F.coalesce("source_type", F.lit("all")).alias("source_type"), "n", "active")


@query("expanded_pools", f"with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS.split('ranked as (')[0].replace('pool as (', 'pool0 as (', 1)} {EXPANDED} select query_id, id, case when g > 0 then 'graph' else 'ann' end as retrieval_source from pool")
def expanded_pools(spark: SparkSession, base: str) -> DataFrame:
    """The candidate pools: each lesson once a query, the expanded ones beside the plain ones."""
    lessons = _all(spark, base)
    config = RecallConfig(expand_weight=0.2, expand_depth=2, expand_per_node=3)
    return retrieval.pools(_ask(lessons), lessons, table(spark, base, "mem_edge").distinct(), config, 10).select("query_id", "id", "retrieval_source")


@query("entity_lookup", f"with {L}, {SEEN} select id, importance from seen where list_contains(from_json(json_extract(metadata, '$.entity_keys'), '[\"varchar\"]'), (select min(k) from (select unnest(from_json(json_extract(metadata, '$.entity_keys'), '[\"varchar\"]')) as k from seen where json_extract(metadata, '$.entity_keys') is not null))) order by importance desc nulls last, created_at desc nulls last, id limit 10")
def entity_lookup(spark: SparkSession, base: str) -> DataFrame:
    """The top lessons of the first entity key there is."""
    lessons = _all(spark, base)
    keys = see.visible(lessons, CONFIG).select(F.explode(F.from_json(F.get_json_object("metadata", "$.entity_keys"), "array<string>")).alias("k"))
    return retrieval.recall_entity(lessons, keys.agg(F.min("k")).first()[0] or "", CONFIG, 10).select("id", "importance")


@query("graph_probes", f"with {L}, g as (select id, embedding from l where {GOOD}), p as (select distinct source_id, target_id from mem_edge) select source_id, target_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as similarity from p join g a on a.id = source_id join g b on b.id = target_id where round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) < 0.7")
def graph_probes(spark: SparkSession, base: str) -> DataFrame:
    good = _lessons(spark, base, "embedding").filter(vectors.usable("embedding", 64))
    return evaluation.graph_probes(table(spark, base, "mem_edge"), good).withColumn("similarity", F.round("similarity", 9))


@query("hash_arms", f"with {L} select id, chr((('0x' || substr(sha256(id::varchar), 1, 8))::bigint % 3 + 65)::int) as arm from l")
def hash_arms(spark: SparkSession, base: str) -> DataFrame:
    return _lessons(spark, base).select("id", evaluation.arm(F.col("id")).alias("arm"))


@query("weight_grid", f"""with {RANKERS}, w as (select i / 10 as weight from range(11) t(i)), rel as (select query_id, id from b where rank <= 3), n as (select query_id, count(*) as n from rel group by query_id),
g as (select weight, query_id, lesson_id as id from c, w qualify row_number() over (partition by weight, query_id order by weight * coalesce(raw_vec_score, 0) + (1 - weight) * coalesce(raw_bm25_score, 0) desc nulls last, lesson_id) <= 10),
h as (select weight, query_id, count(*) as h from g join rel using (query_id, id) group by all) select weight, round(avg(coalesce(h, 0) / n), 9) as recall from n cross join w left join h using (weight, query_id) group by weight""")
def weight_grid(spark: SparkSession, base: str) -> DataFrame:
    from lorekeep.sources.tables import latest

    c = latest(table(spark, base, "recall_candidate"), ["query_id", "lesson_id"], "scored_at").select("query_id", F.col("lesson_id").alias("id"), F.coalesce("raw_vec_score", F.lit(0.0)).alias("a"), F.coalesce("raw_bm25_score", F.lit(0.0)).alias("b"))
    _, text_rank = _rankers(spark, base)
    return evaluation.weight_grid(c, text_rank.filter("rank <= 3"), "a", "b").withColumn("recall", F.round("recall", 9))


@query("sql_functions", f"""with {L} select id, round((success_count + 1.0) / (success_count + fail_count + 2.0), 9) as confidence, greatest(1, ceil(octet_length(encode(lesson_text)) / 4.0))::bigint as tokens,
 case when commit_sha is null then 0.0 when verified_at is null then 0.4 else 1.0 end::double as provenance, round(greatest(0.0, 1 - least(({NOW_US} - epoch_us(created_at)) / 1e6 / 7776000.0, 1.0)), 9) as recency,
 md5(coalesce(role, '') || '|' || coalesce(topic, '') || '|' || coalesce(commit_sha, artifact_hash, '')) as hash, case when {GOOD} then 1.0::double end as self from l where is_active""")
def sql_functions(spark: SparkSession, base: str) -> DataFrame:
    """The registered functions, called from SQL over the current lessons."""
    sql.register(spark)
    name = _name("lessons").replace("-", "_")
    rows = _lessons(spark, base, "success_count", "fail_count", "lesson_text", "commit_sha", "verified_at", "created_at", "role", "topic", "artifact_hash", "embedding", "is_active")
    rows.withColumn("good", vectors.usable("embedding", 64)).createOrReplaceTempView(name)
    return spark.sql(f"""select id, round(confidence_posterior(success_count, fail_count), 9) as confidence, token_cost(lesson_text) as tokens, provenance_score(commit_sha, verified_at) as provenance,
        round(recency_score(created_at, timestamp_micros({NOW_US}), 90), 9) as recency, content_hash(role, topic, commit_sha, artifact_hash) as hash,
        case when good then round(vector_cosine(embedding, embedding), 9) end as self from {name} where is_active""")


@query("dispatch_entity_text", f"with {L}, {ASK}, h as (select query_id, id, len(list_filter({TOK.format('topic')}, lambda t: t = text)) * 1.0 + len(list_filter({TOK.format('lesson_text')}, lambda t: t = text)) * 0.4 as w from ask, l where text is not null and is_active and content_type = 'entity' and epoch_us(t_valid_to) = 253370764800000000) select query_id, id, round(w / (w + 1), 6) as score, 'entity' as path from h where w > 0 qualify row_number() over (partition by query_id order by round(w, 6) desc, id) <= 20")
def dispatch_entity_text(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return navigate.dispatch_by_text(_ask(lessons), lessons, table(spark, base, "mem_edge").distinct(), CONFIG, "entity").withColumn("score", F.round("score", 6))


@query("dispatch_relation", f"""with {L}, {SEEN}, {ASK}, {TEXT_POOL}, {POOLS}, {FINAL}, {EDGES}, k as (select query_id, id, score from scored qualify row_number() over (partition by query_id order by score desc nulls last, id) <= 10),
 u as (select source_id as a, target_id as b, weight from e union all select target_id, source_id, weight from e)
 select query_id, b as id, round(max(0.7 * weight::double + 0.3 * score), 9) as score, 'relation' as path from k join u on a = id where b in (select id from seen) group by query_id, b""")
def dispatch_relation(spark: SparkSession, base: str) -> DataFrame:
    lessons = _all(spark, base)
    return navigate.dispatch(_ask(lessons), lessons, table(spark, base, "mem_edge").distinct(), CONFIG, "relation").withColumn("score", F.round("score", 9))


@query("stream_sessions", "with e as (select event_id, user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as b from events), s as (select *, sum(case when b is null or t - b > 1800000000 then 1 else 0 end) over (partition by user_id order by t, event_id rows unbounded preceding) as k from e) select user_id, min(t) as start_us, count(*) as n from s group by user_id, k")
def stream_sessions(spark: SparkSession, base: str) -> DataFrame:
    events = streams.source(spark, f"{base}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    done = streams.drain(streams.sessions(events, "user_id", "ts"), _name("sessions"), mode="complete")
    return done.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


VERSIONS = SQL_OF["bitemporal_versions"].replace("l as (select * from agent_lesson qualify row_number() over (partition by id order by updated_at desc) = 1)", "l as (select distinct id, content_hash, created_at from agent_lesson)")


@query("stream_versions", VERSIONS)
def stream_versions(spark: SparkSession, base: str) -> DataFrame:
    """Versions from a stream of deliveries, each delivered state of a lesson once."""
    rows = streams.source(spark, f"{base}/agent_lesson.parquet").select("id", "content_hash", "created_at", F.lit(None).cast("timestamp").alias("t_valid_from"))
    written = streams.first_to_table(rows, ["id", "content_hash", "created_at"], _name("versions"))
    out = writes.versions(written.distinct()).filter("created_at is not null")
    return out.select("id", F.unix_micros("t_valid_from").alias("valid_from_us"), F.unix_micros("t_valid_to").alias("valid_to_us"))


@query("stream_unexpired", "select id from agent_lesson where created_at is not null and (expires_at is null or expires_at > created_at)")
def stream_unexpired(spark: SparkSession, base: str) -> DataFrame:
    rows = streams.source(spark, f"{base}/agent_lesson.parquet").select("id", "created_at", "expires_at").filter("created_at is not null")
    return streams.drain(streams.unexpired(rows), _name("unexpired")).select("id")


@query("stream_first_events", "select distinct id from agent_lesson")
def stream_first_events(spark: SparkSession, base: str) -> DataFrame:
    rows = streams.source(spark, f"{base}/agent_lesson.parquet").select("id", "updated_at")
    return streams.first_to_table(rows, ["id"], _name("first")).select("id")
