"""Pigeonhole join of fingerprints: fingerprints that are close in Hamming distance share a block.

A fingerprint is split into blocks, and every record is indexed under each block's value. Two
fingerprints that differ in fewer places than there are blocks share a block for certain; beyond
that they share one with a probability that the callers choose their numbers of blocks by.
The records of a block meet in a sort-merge join inside the JVM, where their codes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut

#: A block value with more entries is cut into chunks of about so many, and each pair of chunks meets by itself.
CHUNK = 8192
#: Values counted at once in a task, and the least count that a task reports.
COUNTED, REPORTED = 1 << 23, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of the value."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def longs(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit integers, zero filled."""
    raw = np.packbits(bits, axis=1)
    full = np.zeros((len(bits), -(-raw.shape[1] // 8) * 8), np.uint8)
    full[:, : raw.shape[1]] = raw
    return full.view(np.int64)


def lists(values: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an array of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, np.ascontiguousarray(values).view(np.int64).ravel())


def heavy_slots(marks: DataFrame, limit: int) -> DataFrame:
    """``(slot, chunks)`` of the block values with more than ``limit`` entries, counted before any shuffle.

    A task reports only what it holds ``REPORTED`` times and more, so a value that is spread thinly over
    very many tasks can exceed the limit by that much a task before it is split.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(slot[keep]), pa.array(n[keep].astype(np.int64))], names=["slot", "n"])

        for b in batches:
            held.append(b.column("slots").flatten().to_numpy())
            size += len(held[-1])
            if size >= COUNTED:
                yield report()
                held, size = [], 0
        if size:
            yield report()

    counts = marks.select("slots").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") > limit).select("slot", F.ceil(F.col("n") / limit).cast("int").alias("chunks"))


def close_pairs(marks: DataFrame, code: list[str], radius: int, rows: int, blocks: int) -> DataFrame:
    """Distinct ``(id_a, id_b)`` of the records that share a block and differ in at most ``radius`` bits.

    ``marks`` has ``id``, ``slots`` (the values of the record's blocks) and the columns ``code`` of
    64-bit words; it is read several times, so pass a materialised table. ``rows`` is its number of rows
    and ``blocks`` the greatest length of ``slots``. Equal records may repeat; a record does not meet itself.
    Heavy block values (at most 65,536 of them, by counting) are cut into chunks; none is capped.
    """
    limit = max(CHUNK, rows * blocks >> 16)
    heavy = cut(heavy_slots(marks, limit))
    entries = marks.select(F.explode("slots").alias("slot"), "id", *code)
    plain = entries
    found = []
    if not heavy.isEmpty():
        plain = entries.join(F.broadcast(heavy), "slot", "left_anti")
        own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        hot = entries.join(F.broadcast(heavy), "slot").withColumn("own", own)
        left = hot.withColumn("j", F.explode(F.sequence("own", F.col("chunks") - 1))).withColumnRenamed("own", "i")
        right = hot.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumnRenamed("own", "j")
        found.append(_meet(left, right, ["slot", "i", "j"], code, radius))
    found.append(_meet(plain, plain, ["slot"], code, radius))
    return reduce(DataFrame.unionByName, found).distinct()


def _meet(left: DataFrame, right: DataFrame, keys: list[str], code: list[str], radius: int) -> DataFrame:
    """The close pairs among the rows that agree in the keys; rows of one chunk meet once."""
    a = left.select(*keys, F.col("id").alias("x"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(code)])
    b = right.select(*keys, F.col("id").alias("y"), *[F.col(c).alias(f"y{k}") for k, c in enumerate(code)])
    apart = reduce(add, [F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))) for k in range(len(code))], F.lit(0))
    once = F.col("x") < F.col("y") if len(keys) == 1 else (F.col("x") < F.col("y")) | ((F.col("i") < F.col("j")) & (F.col("x") != F.col("y")))
    met = a.hint("merge").join(b, keys).filter(once & (apart <= radius))
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
