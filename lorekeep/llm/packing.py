"""Filling fixed-capacity containers: hierarchical packing over several context sizes.

Documents are routed to the smallest size that holds them. The largest size is packed first, best
fit by decreasing size, and its gaps are filled with documents of the shorter sizes; then the next
size, and so on. Containers are dealt into step groups so that each group gets its share of every
size. Only a text larger than the largest container is split.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.batches import slices

#: Where the public tokenizers' vocabularies lie, and which one sizes are counted in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents packed together in one task; a task's last containers are its only loose ones.
SHARD = 8192
#: Tokens of a step group.
STEP_TOKENS = 65_536


def token_counter(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[], Callable[[str], int]]:
    """Makes, on a worker, a function that counts a text's tokens. The vocabulary, under a megabyte, travels with the job."""
    with open(vocabulary, "rb") as file:
        lines = file.read().splitlines()

    def load() -> Callable[[str], int]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return load


def sizes(documents: DataFrame, key: str, text: str, counter: Callable[[], Callable[[str], int]]) -> DataFrame:
    """``(id, n)``: each document's size in tokens. Null texts count as empty; rows with a null key are dropped."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = None
        for b in slices(batches, "text"):
            measure = measure or counter()
            n = [measure(t) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "n"])

    source = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    return source.mapInArrow(count, "id long, n long")


class _Open:
    """Containers of one capacity by remaining room; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by = capacity, 0, {}

    def put(self, container: int, room: int) -> None:
        self.by.setdefault(room, []).append(container)
        self.rooms |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        fitting = self.rooms >> size
        if not fitting:
            return None
        room = size + (fitting & -fitting).bit_length() - 1
        own = self.by[room]
        container = own.pop()
        if not own:
            self.rooms ^= 1 << room
        return container, room


def fill(n: np.ndarray, capacities: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of items of sizes ``n`` (at most the largest capacity): tier, container within all, and offset in it.

    ``capacities`` ascend. Items are taken largest first; ties keep their order.
    """
    tier = np.full(len(n), -1, np.int64)
    box = np.full(len(n), -1, np.int64)
    offset = np.zeros(len(n), np.int64)
    order = np.argsort(-n, kind="stable")
    home = np.searchsorted(capacities, n)
    made = 0
    for k in range(len(capacities) - 1, -1, -1):
        open_ = _Open(capacities[k])
        for i in order:
            if box[i] >= 0 or home[i] > k:
                continue
            size = int(n[i])
            got = open_.take(size)
            if got is None:
                # A shorter document waits for its own size; only the size's own open a container.
                if home[i] < k:
                    continue
                got = (made, capacities[k])
                made += 1
            tier[i], box[i], offset[i] = k, got[0], capacities[k] - got[1]
            open_.put(got[0], got[1] - size)
    return tier, box, offset


def pack(items: DataFrame, capacities: list[int], shard: int = SHARD, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``(id, part, start, n, capacity, container, step, offset)``: where each item goes.

    ``items`` is ``(id, n)`` with ``id`` unique; repeated capacities count once, and an empty list of
    capacities or none above 0 is an error. An item above the largest capacity is split into parts of
    that capacity and a rest; any other is whole (part 0, ``start`` 0), including items of size 0.
    Items are dealt into shards of about ``shard`` by a hash of the id, so a shard's work is bounded
    at any input size, and a repeated run gives the same result.
    """
    caps = sorted({int(c) for c in capacities if c and c > 0})
    if not caps:
        raise ValueError("no capacity above 0")
    top = caps[-1]
    count = items.count()
    shards = max(1, -(-count // shard))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / top)).cast("int")))
    parts = items.select("id", "n", part.alias("part")).select(
        "id", "part", (F.col("part").cast("long") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("part").cast("long") * top).alias("n")
    )
    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)).cast("int"))

    def place(key: tuple, cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("id", "ascending"), ("part", "ascending")])
        tier, box, offset = fill(cell.column("n").to_numpy(), caps)
        # Each size's containers are dealt evenly over the shard's steps.
        first = np.unique(box, return_index=True)[1]
        kind = tier[first]
        held = sum(caps[k] for k in kind)
        steps = max(1, round(held / step_tokens))
        step_of = np.zeros(len(first), np.int64)
        for k in range(len(caps)):
            own = np.flatnonzero(kind == k)
            step_of[own] = np.arange(len(own)) * steps // max(1, len(own))
        base = key[0].as_py() << 32
        out = {c: cell.column(c) for c in ("id", "part", "start", "n")}
        out |= {"capacity": np.array(caps)[tier].astype(np.int32), "container": base + box, "step": base + step_of[box], "offset": offset}
        return pa.table(out)

    return sharded.groupBy("shard").applyInArrow(place, "id long, part int, start long, n long, capacity int, container long, step long, offset long")


def usage(packed: DataFrame) -> DataFrame:
    """``(capacity, containers, items, tokens, unused_share)`` of each container size; an empty packing gives no rows."""
    boxes = packed.groupBy("capacity", "container").agg(F.sum("n").alias("n"), F.count("*").alias("items"))
    out = boxes.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"))
    return out.withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))
