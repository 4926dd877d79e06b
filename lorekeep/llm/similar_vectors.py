"""Most similar vectors: multi-index hashing over learned rotated binary codes, floats reranked.

A rotation is learned on a bounded sample (iterative quantisation): it turns the vectors so that
their signs lose little. Several rotations, each from another start, give longer codes. A code is
split into substrings; every vector is indexed under each of them and under its nearest probes, which
flip the bits that the vector is least sure of. Vectors that meet and lie within the Hamming radius
are reranked by their true cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.multi_index import close_pairs, lists, longs, mix
from lorekeep.session import cut

#: Vectors the rotations are learned on, at most, those of the least hashed ids; all vectors are indexed.
SAMPLE = 8192
ITERATIONS = 25
#: Pairs at the threshold never meet with at most this probability (closer ones with less).
MISS = 0.01
BITS = 128
CODE = [f"c{k}" for k in range(BITS // 64)]
#: Bits of a substring at least, and records that share one by chance, about.
LEAST_WIDTH, BUCKET = 12, 128
#: Standard deviations of the Hamming distance at the threshold by which the radius exceeds its mean.
SLACK = 3.0
#: Pairs drawn to find how often two vectors at the threshold meet.
DRAWN = 4000


def usable(vector: str, dim: int) -> F.Column:
    """Whether the vector has ``dim`` elements, none of them null, NaN or infinite, and is not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.coalesce(bad, F.lit(False)) & ~F.coalesce(zero, F.lit(True))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """A ``(dim, bits)`` projection of stacked rotations, each learned by iterative quantisation."""
    dim = sample.shape[1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // dim)):
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ITERATIONS if len(sample) > dim else 0):
            signs = np.sign(sample @ turn)
            u, _, v = np.linalg.svd(sample.T @ signs)
            turn = u @ v
        out.append(turn)
    return np.concatenate(out, axis=1)[:, :bits].astype(np.float32)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, dim).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _slots(turned: np.ndarray, width: int, tables: int, probes: int) -> np.ndarray:
    """The values a vector is indexed under: each substring, and each with one of its ``probes`` least sure bits flipped."""
    part = turned[:, : tables * width].reshape(len(turned), tables, width)
    weight = np.uint64(1) << np.arange(width, dtype=np.uint64)
    key = ((part > 0) * weight).sum(axis=2, dtype=np.uint64)
    unsure = np.argsort(np.abs(part), axis=2)[:, :, :probes].astype(np.uint64)
    keys = np.concatenate([key[:, :, None], key[:, :, None] ^ (np.uint64(1) << unsure)], axis=2)
    return mix(keys ^ mix(np.arange(1, tables + 1, dtype=np.uint64))[:, None]).reshape(len(turned), -1)


@lru_cache
def shape(n: int, cosine: float, dim: int) -> tuple[int, int, int]:
    """``(width, tables, probes)`` for ``n`` vectors: of those by which pairs at ``cosine`` are missed seldom enough, the fewest entries.

    The chance to meet is measured on drawn pairs, as it depends on how sure the flipped bits are.
    """
    width = max(LEAST_WIDTH, int(np.ceil(np.log2(max(1, n) / BUCKET))) if n > BUCKET else 0)
    rng = np.random.default_rng(3)
    x, z = rng.standard_normal((2, DRAWN, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    most = 2 * BITS // width
    turn = learn_rotations(np.zeros((0, dim)), most * width)
    best = None
    for probes in range(width + 1):
        a, b = (_slots(v @ turn, width, most, probes).reshape(DRAWN, most, -1) for v in (x, y))
        met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3))
        missed = [1 - met[:, :t].any(axis=1).mean() for t in range(1, most + 1)]
        tables = next((t for t, m in enumerate(missed, 1) if m <= MISS), None)
        if tables and (best is None or tables * (probes + 1) < best[1] * (best[2] + 1)):
            best = (width, tables, probes)
        if best and probes > best[2] + 2:
            break
    return best or (width, most, width)


def encode(vectors: DataFrame, vector: str, dim: int, rotation: np.ndarray, width: int, tables: int, probes: int) -> DataFrame:
    """Replaces the vector by its ``slots`` and its code; the other columns stay."""
    others = [f for f in vectors.schema.fields if f.name != vector]
    names = [*[f.name for f in others], "slots", *CODE]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                turned = _rows(b.column(vector), dim) @ rotation
                code = longs(turned[:, :BITS] > 0)
                out = [b.column(f.name) for f in others]
                out += [lists(_slots(turned, width, tables, probes)), *[pa.array(np.ascontiguousarray(code[:, k])) for k in range(len(CODE))]]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "slots array<long>", *[f"{c} long" for c in CODE]]
    return vectors.mapInArrow(make, ", ".join(schema))


def _usable_rows(records: DataFrame, key: str, vector: str, version: str | None, dim: int) -> DataFrame:
    columns = [F.col(key).cast("long").alias("id"), (F.col(version) if version else F.lit(0)).alias("version"), F.col(vector).cast("array<float>").alias("v")]
    return records.select(*columns).filter(F.col("id").isNotNull()).withColumn("ok", usable("v", dim))


def _learn(good: DataFrame, bits: int, dim: int, n: int) -> np.ndarray:
    """Rotations learned on vectors of least hashed id: the same sample whatever the order of the rows.

    About twice ``SAMPLE`` of the ``n`` rows reach the driver, however many there are.
    """
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    picked = good.select("v", share.alias("h")).filter(F.col("h") < (1 << 40) * min(1.0, 2 * SAMPLE / max(1, n))).toPandas()
    rows = picked.sort_values("h", kind="stable").v.head(SAMPLE)
    sample = np.stack(rows).astype(np.float64) if len(rows) else np.eye(dim)
    return learn_rotations(sample / np.linalg.norm(sample, axis=1, keepdims=True), bits)


def similar_pairs(records: DataFrame, key: str, vector: str, version: str | None = None, dim: int = 64, cosine: float = 0.9) -> DataFrame:
    """``(id_a, id_b, cosine)`` of different records whose vectors have at least that cosine.

    ``key`` may repeat: with ``version`` the row with its greatest value counts; if that row's vector
    is not usable (null, of another length, all zero, or with a null, NaN or infinite element) the
    record gives no row. Rows with a null key are dropped. Vectors need not have length one. A pair
    exactly at the threshold is missed with a probability of about ``MISS``; closer ones with less.
    """
    base = _usable_rows(records, key, vector, version, dim)
    n = base.count()
    width, tables, probes = shape(n, cosine, dim)
    fraction = float(np.arccos(cosine) / np.pi)
    radius = int(BITS * fraction + SLACK * np.sqrt(BITS * fraction * (1 - fraction)))
    # Only ids and versions are shuffled to find the current rows.
    newest = base.groupBy("id").agg(F.max(F.struct("version", "ok")).alias("m"))
    newest = cut(newest.select("id", "m.version", "m.ok"))
    good = base.filter("ok").drop("ok")
    # Vectors of older versions are indexed too and fall out below, which spares a join of all vectors.
    marks = cut(encode(good, "v", dim, _learn(good, max(BITS, width * tables), dim, n), width, tables, probes))
    close = cut(close_pairs(marks.select("id", "slots", *CODE), CODE, radius, n, tables * (probes + 1)))
    involved = close.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(newest.filter("ok").select("id", "version"), "id")
    floats = good.join(involved, ["id", "version"]).dropDuplicates(["id"]).select("id", "v")
    a, b = floats.select(F.col("id").alias("id_a"), F.col("v").alias("va")), floats.select(F.col("id").alias("id_b"), F.col("v").alias("vb"))
    pairs = close.join(a, "id_a").join(b, "id_b")
    return rerank(pairs, dim).filter(F.col("cosine") >= cosine)


def rerank(pairs: DataFrame, dim: int) -> DataFrame:
    """The true cosine of ``va`` and ``vb`` for each pair, in double precision."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in ("va", "vb"))
                c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id_a"), b.column("id_b"), pa.array(c)], names=["id_a", "id_b", "cosine"])

    return pairs.select("id_a", "id_b", "va", "vb").mapInArrow(make, "id_a long, id_b long, cosine double")


#: Bits past the k-th closest code that are reranked too, in standard deviations of the distance of one pair.
MARGIN = 4.0
#: Queries in a block, and records of a part, at most on average.
BLOCK, PART = 16_384, 65_536


def nearest(queries: DataFrame, records: DataFrame, k: int = 10, dim: int = 64, bits: int = 256) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` records most similar to each query, in blocks.

    Both inputs are ``(id long, v array<float>)`` with usable vectors; the queries are a stated set. A block
    of queries meets every part of the records. There each query's Hamming radius grows until ``k`` codes lie
    within it, and by ``MARGIN`` more; all codes inside are reranked by cosine, however many there are. Neighbours
    beyond the close ones share no selective substring, so codes are compared whole here. Only ``k`` rows a
    query and part leave the task. A record is not its own neighbour. Ties go to the smaller id.
    """
    n = records.count()
    rotation = _learn(records, bits, dim, n)
    blocks, parts = max(1, -(-queries.count() // BLOCK)), max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // PART))
    q = queries.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.lit(True).alias("query"), "id", "v")
    r = records.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("p"), F.lit(False).alias("query"), "id", "v")
    margin = int(MARGIN * np.sqrt(bits * 0.25))

    def search(key: tuple, cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        is_query = cell.column("query").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = cell.column("id").to_numpy(), _rows(cell.column("v").chunk(0), dim)
        order = np.argsort(ids, kind="stable")
        ids, x, is_query = ids[order], x[order], is_query[order]
        qi, ri, qx, rx = ids[is_query], ids[~is_query], x[is_query], x[~is_query]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qi) and len(ri):
            qc, rc = (longs(v @ rotation > 0).view(np.uint64) for v in (qx, rx))
            take = min(len(ri), k + 1) - 1
            for i in range(len(qi)):
                apart = np.bitwise_count(rc ^ qc[i]).sum(axis=1, dtype=np.int16)
                near = np.flatnonzero(apart <= np.partition(apart, take)[take] + margin)
                cos = np.round(rx[near].astype(np.float64) @ qx[i].astype(np.float64), 12)
                near, cos = near[ri[near] != qi[i]], cos[ri[near] != qi[i]]
                best = np.argsort(-cos, kind="stable")[:k]
                found.append((np.full(len(best), qi[i]), ri[near[best]], cos[best]))
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"query_id": a, "id": b, "cosine": c})

    found = q.unionByName(r).groupBy("q", "p").applyInArrow(search, "query_id long, id long, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
