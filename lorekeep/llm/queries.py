"""The pN_ queries over the test tables, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import components as groups
from lorekeep.llm import languages, leakage, packing, quality, rank_fusion, representatives
from lorekeep.llm import near_duplicates as near
from lorekeep.llm import similar_vectors as vectors
from lorekeep.session import cut
from lorekeep.sources.tables import current_lessons, latest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _current_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Each query's candidates with their latest scores; a lesson's confidence outside 0..1 is missing."""
    scored = latest(table(spark, base, "recall_candidate"), ["query_id", "lesson_id"], "scored_at")
    sure = current_lessons(spark, base, "confidence").select(F.col("id").alias("lesson_id"), F.when(F.col("confidence").between(0, 1), F.col("confidence")).alias("confidence"))
    return scored.join(sure, "lesson_id", "left")


BORDA = {"raw_vec_score": 1.0, "raw_bm25_score": 1.0, "confidence": 1.0}

P1_SQL = """
with c as (select query_id, lesson_id, raw_vec_score, raw_bm25_score from recall_candidate
           qualify row_number() over (partition by query_id, lesson_id order by scored_at desc, raw_vec_score desc nulls last, raw_bm25_score desc nulls last) = 1),
l as (select id, confidence from agent_lesson qualify row_number() over (partition by id order by updated_at desc) = 1),
s as (select c.*, case when confidence between 0 and 1 and not isnan(confidence) then confidence::double end as conf from c left join l on l.id = c.lesson_id),
m as (select query_id, lesson_id, unnest([1, 2, 3]) as k, unnest([raw_vec_score, raw_bm25_score, conf]) as v from s),
r as (select *, count(*) over (partition by query_id, k) as n,
             rank() over (partition by query_id, k order by coalesce(v, '-infinity'::double) desc)
             + (count(*) over (partition by query_id, k, coalesce(v, '-infinity'::double)) - 1) / 2.0 as rk from m),
p as (select query_id, lesson_id, sum(n - rk) as points from r group by all)
"""


@query("p1_found", P1_SQL + "select query_id, lesson_id from p qualify row_number() over (partition by query_id order by points desc, lesson_id) = 1")
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The first candidate of each query by weighted Borda count."""
    ranking = rank_fusion.borda(_current_candidates(spark, base), "query_id", "lesson_id", BORDA, missing="lowest")
    return ranking.filter("position = 1").select("query_id", "lesson_id")


@query("p1_ranking", P1_SQL + "select query_id, lesson_id, points::double as points, row_number() over (partition by query_id order by points desc, lesson_id) as position from p")
def p1_ranking(spark: SparkSession, base: str) -> DataFrame:
    """All candidates of each query in one ranking."""
    return rank_fusion.borda(_current_candidates(spark, base), "query_id", "lesson_id", BORDA, missing="lowest")


P2_SQL = """
with recursive l as (select id, lesson_text from agent_lesson qualify row_number() over (partition by id order by updated_at desc) = 1),
w as (select id, unnest(list_distinct(regexp_extract_all(lower(lesson_text), '[\\p{L}\\p{N}]+'))) as w from l),
n as (select id, count(*) as n, hash(list_sort(list(w))) as same from w group by id having count(*) >= 8),
s as (select a.id as id_a, b.id as id_b, count(*) as k from w a join w b on a.w = b.w and a.id < b.id group by all),
p as (select id_a, id_b from s join n x on x.id = id_a join n y on y.id = id_b where k >= 0.6 * (x.n + y.n - k)),
"""


@query("p2_found", P2_SQL + "e as (select 1) select id_a, id_b from p")
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of lessons whose texts share at least 0.6 of their distinct words."""
    members, links = near.near_duplicates(table(spark, base, "agent_lesson"), "id", "lesson_text", "updated_at", threshold=0.6, min_words=8)
    return near.expand(members, links)


P2_GROUPS_SQL = P2_SQL + """
c as (select id, min(id) over (partition by same) as class from n),
k as (select distinct x.class as a, y.class as b from p join c x on x.id = id_a join c y on y.id = id_b where x.class <> y.class),
e as (select a, b from k union select b, a from k),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
g as (select a, least(a, min(b)) as root from r group by a), d as (select a, count(distinct b) as n_links from e group by a)
select id as lesson_id, class, coalesce(root, class) as "group", coalesce(n_links, 0)::bigint as n_links
from c left join g on g.a = class left join d on d.a = class
"""


@query("p2_groups", P2_GROUPS_SQL)
def p2_groups(spark: SparkSession, base: str) -> DataFrame:
    """Every lesson with the class of its words, its group of near duplicates and its class's number of links."""
    members, links = near.near_duplicates(table(spark, base, "agent_lesson"), "id", "lesson_text", "updated_at", threshold=0.6, min_words=8)
    return near.groups(members, cut(links)).withColumnRenamed("id", "lesson_id")


P3_SQL = """
with l as (select id, embedding from agent_lesson qualify row_number() over (partition by id order by updated_at desc) = 1),
u as materialized (select id, embedding::double[64] as e from l where embedding is not null and len(embedding) = 64
           and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
select a.id as id_a, b.id as id_b from u a join u b on a.id < b.id where array_cosine_similarity(a.e, b.e) >= 0.9
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of lessons whose embeddings have a cosine of at least 0.9."""
    return vectors.similar_pairs(table(spark, base, "agent_lesson"), "id", "embedding", "updated_at", dim=64, cosine=0.9).select("id_a", "id_b")


@query("p3_nearest")
def p3_nearest(spark: SparkSession, base: str) -> DataFrame:
    """The ten most similar lessons of every lesson whose id is divisible by 50, among all lessons."""
    lessons = current_lessons(spark, base, "embedding").filter(vectors.usable("embedding", 64)).select("id", F.col("embedding").alias("v"))
    return vectors.nearest(lessons.filter("id % 50 = 0"), lessons, 10, dim=64).select("query_id", "id", "cosine", "rank")


def _rules() -> list[tuple]:
    """The survivor's order: each field with the values it may have, and whether more is better."""
    created = F.col("created_at")
    return [
        ("recall_count", F.col("recall_count") >= 0, True),
        ("confidence", F.col("confidence").between(0, 1), True),
        ("importance", F.col("importance").between(1, 5), True),
        ("created_at", (created >= F.lit("2023-01-01").cast("timestamp")) & (created < F.lit("2026-07-01").cast("timestamp")), False),
    ]


FIELDS = {"recall_id": ("recall_count", True), "confidence_id": ("confidence", True), "importance_id": ("importance", True), "created_id": ("created_at", True)}

P4_SQL = """
with l as (select id, content_hash, recall_count, confidence, importance, created_at from agent_lesson
           qualify row_number() over (partition by id order by updated_at desc) = 1),
u as (select id, content_hash, case when recall_count >= 0 then recall_count end as rc,
             case when confidence between 0 and 1 and not isnan(confidence) then confidence end as cf,
             case when importance between 1 and 5 then importance end as im,
             case when created_at >= '2023-01-01 00:00:00+00'::timestamptz and created_at < '2026-07-01 00:00:00+00'::timestamptz then created_at end as cr from l),
g as (select *, count(*) over (partition by content_hash) as n,
             first_value(id) over (partition by content_hash order by rc desc nulls last, cf desc nulls last, im desc nulls last, cr nulls last, id) as lesson_id,
             first_value(case when rc is not null then id end) over (partition by content_hash order by rc desc nulls last, id) as recall_id,
             first_value(case when cf is not null then id end) over (partition by content_hash order by cf desc nulls last, id) as confidence_id,
             first_value(case when im is not null then id end) over (partition by content_hash order by im desc nulls last, id) as importance_id,
             first_value(case when cr is not null then id end) over (partition by content_hash order by cr desc nulls last, id) as created_id from u)
select distinct content_hash, lesson_id, recall_id, confidence_id, importance_id, created_id from g where n > 1
"""


@query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The surviving lesson of each shared content hash, and the lessons that supply its fields."""
    lessons = current_lessons(spark, base, "content_hash", "recall_count", "confidence", "importance", "created_at")
    return representatives.survivors(lessons, "content_hash", "id", _rules(), FIELDS).withColumnRenamed("survivor", "lesson_id")


@query("p4_consensus")
def p4_consensus(spark: SparkSession, base: str) -> DataFrame:
    """Of each shared content hash, the lesson whose text is closest to the group's token-level consensus, weighted by evidence."""
    lessons = current_lessons(spark, base, "content_hash", "lesson_text", "evidence_count")
    shared = lessons.groupBy("content_hash").count().filter("count > 1").select("content_hash")
    members = lessons.join(shared, "content_hash").withColumn("weight", F.greatest(F.lit(1), F.coalesce("evidence_count", F.lit(1))))
    return representatives.consensus(members, "content_hash", "id", "lesson_text", "weight").withColumnRenamed("id", "lesson_id")


P5_SQL = """
with recursive e as (select id_a as a, id_b as b from con_pairs union all select id, root from con_uf),
s as (select a, b from e where a is not null and b is not null and a <> b union select b, a from e where a is not null and b is not null and a <> b),
r(a, b) as (select a, b from s union select r.a, s.b from r join s on s.a = r.b)
select a as lesson_id, least(a, min(b)) as root from r group by a
"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Every linked lesson with the smallest id of its group."""
    uf = table(spark, base, "con_uf").select(F.col("id").alias("id_a"), F.col("root").alias("id_b"))
    links = table(spark, base, "con_pairs").select("id_a", "id_b").unionByName(uf)
    return groups.components(links, "id_a", "id_b").withColumnRenamed("id", "lesson_id")


P8_SQL = """
with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') as w from eval_item),
d as (select doc_id, hash(w[k : k + 11]) as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from w where len(w) >= 12)),
t as (select item_id, hash(w[k : k + 11]) as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12))
select distinct doc_id, item_id from d join t using (g)
"""


@query("p8_found", P8_SQL)
def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return leakage.leaks(table(spark, base, "documents"), "doc_id", "text", table(spark, base, "eval_item"), "item_id", "item_text", span=12)


@query("p6_found")
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Languages of lessons whose label is missing or wrong or whose text is mixed, and of topics in another language."""
    lessons = table(spark, base, "agent_lesson").select("id", "updated_at", "lesson_text", "topic", F.get_json_object("metadata", "$.lang").alias("lang"))
    model = languages.train(lessons, "lesson_text", "lang")
    return languages.wrong_or_missing(lessons, "id", "lesson_text", "topic", "lang", model, "updated_at").withColumnRenamed("id", "lesson_id")


@query("p6_segments")
def p6_segments(spark: SparkSession, base: str) -> DataFrame:
    """Each sentence or line of a lesson's text, and its topic, with its language and a confidence, where one is near enough."""
    lessons = current_lessons(spark, base, "lesson_text", "topic", "metadata").withColumn("lang", F.get_json_object("metadata", "$.lang"))
    model = languages.train(lessons, "lesson_text", "lang")
    texts = languages.segment_languages(lessons.select("id", "lesson_text"), "lesson_text", model)
    topics = languages.segment_languages(lessons.select("id", "topic"), "topic", model, languages.TOPIC_WORDS, whole=True)
    both = texts.withColumn("field_name", F.lit("lesson_text")).unionByName(topics.withColumn("field_name", F.lit("topic")))
    return both.select(F.col("id").alias("lesson_id"), "field_name", F.explode("found").alias("s")).select("lesson_id", "field_name", "s.segment", "s.lang", F.round("s.confidence", 6).alias("confidence"))


@query("p9_found")
def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents that are not prose, and what they are instead."""
    return quality.not_prose(table(spark, base, "documents"), "doc_id", "text")


@query("p9_statistics")
def p9_statistics(spark: SparkSession, base: str) -> DataFrame:
    """All statistics of each document, its kind and why, and the prose rules it fails."""
    stats = quality.statistics(table(spark, base, "documents"), "doc_id", "text")
    made = quality.reasons(quality.kind_reasons(quality.kinds(stats)))
    return made.withColumn("reasons", F.array_join("reasons", "; ")).withColumn("because", F.array_join("because", "; "))


def _windows(spark: SparkSession, base: str) -> list:
    """The container capacities: a fixed table of four rows."""
    return table(spark, base, "context_window").select("window_id", "capacity_tokens").orderBy("capacity_tokens").collect()


@query("p7_packing")
def p7_packing(spark: SparkSession, base: str) -> DataFrame:
    """Every document in a container of one of the context sizes, each document once, longer sizes filled from shorter ones."""
    sizes = cut(packing.sizes(table(spark, base, "documents"), "doc_id", "text", packing.token_counter()))
    return packing.pack(sizes, [w.capacity_tokens for w in _windows(spark, base)]).withColumnRenamed("id", "doc_id")


@query("p7_each_window")
def p7_each_window(spark: SparkSession, base: str) -> DataFrame:
    """All documents packed for each context size by itself."""
    sizes = cut(packing.sizes(table(spark, base, "documents"), "doc_id", "text", packing.token_counter()))
    packed = [packing.pack(sizes, [w.capacity_tokens]).withColumn("window_id", F.lit(w.window_id)) for w in _windows(spark, base)]
    out = packed[0]
    for p in packed[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", "doc_id")


@query("p7_unused")
def p7_unused(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens and the share of unused space of each context size, all documents packed for it by itself."""
    return packing.usage(p7_each_window(spark, base))
