"""Evaluation texts leaking into documents: winnowed k-gram fingerprints, hits extended word by word.

Of each window of ``span - k + 1`` consecutive k-grams the one with the least hash is kept, in the
documents and in the items alike, so every shared run of ``span`` words or more has a fingerprint in
common (winnowing's guarantee). A hit is extended to both sides and counts if the run is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.batches import slices, word_hashes

#: Items whose fingerprints fit in so many entries are matched in the scan of the documents; more are joined by shuffle.
INLINE_ENTRIES = 1_000_000
DOC_GAP, ITEM_GAP = 0, 1


def winnow(h: np.ndarray, gap: int, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected k-grams; k-grams over a separator are never selected."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    cross = np.zeros(n, bool)
    for j in range(k):
        part = h[j : j + n]
        g = (g ^ part) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
        cross |= part == gap
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    g = np.where(cross, top, g)
    pad = np.concatenate([np.full(window - 1, top), g, np.full(window - 1, top)])
    least = pad[: n + window - 1].copy()  # least[s] is the minimum of the window that ends at g[s]
    for j in range(1, window):
        np.minimum(least, pad[j : j + n + window - 1], out=least)
    most = least[:n].copy()
    for j in range(1, window):
        np.maximum(most, least[j : j + n], out=most)
    at = np.flatnonzero((most == g) & ~cross)
    return at, g[at]


def _context(h: np.ndarray, at: np.ndarray, k: int, reach: int, gap: int) -> np.ndarray:
    """The k-gram at each position with ``reach`` words on both sides, separators beyond the ends."""
    padded = np.concatenate([np.full(reach, gap, np.uint64), h, np.full(reach, gap, np.uint64)])
    return padded[at[:, None] + np.arange(k + 2 * reach)]


def _run(a: np.ndarray, b: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Length of the equal run around the k-gram of each pair of contexts (at most ``k + 2 * reach``)."""
    same = a == b
    left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
    right = np.cumprod(same[:, reach + k :], axis=1).sum(axis=1)
    return np.where(same[:, reach : reach + k].all(axis=1), left + k + right, 0)


def _entries(texts: DataFrame, key: str, text: str, k: int, span: int, gap: int) -> DataFrame:
    window, reach = span - k + 1, span - k

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, owner = word_hashes(b.column("text").to_pylist(), gap)
            at, g = winnow(h, gap, k, window)
            ctx = _context(h, at, k, reach, gap)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(owner[at])), pa.array(g.view(np.int64)), pa.array([r.tobytes() for r in ctx], pa.binary())], names=["key", "g", "context"])

    source = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return source.mapInArrow(make, "key long, g long, context binary")


def leaks(documents: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, span: int = 12, k: int = 5) -> DataFrame:
    """``(doc, item)``, distinct: the document's words hold ``span`` or more consecutive words of the item.

    Null, empty and shorter texts hold nothing; rows with a null key are dropped; repeated rows and
    other columns don't matter. Whole texts are used on both sides. Items within ``INLINE_ENTRIES``
    fingerprints (counted first) travel to the scan of the documents; more are joined by shuffle.
    """
    width = k + 2 * (span - k)
    wanted = _entries(items, item, item_text, k, span, ITEM_GAP)
    count = wanted.limit(INLINE_ENTRIES + 1).count()
    if count > INLINE_ENTRIES:
        found = _entries(documents, doc, text, k, span, DOC_GAP)
        hits = found.withColumnRenamed("key", "d").withColumnRenamed("context", "c").join(wanted, "g").select("d", "key", "c", "context")

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, width) for c in ("c", "context"))
                    yield pa.RecordBatch.from_arrays([b.column("d"), b.column("key")], names=[doc, item]).filter(pa.array(_run(x, y, k, span - k) >= span))

        return hits.mapInArrow(extend, f"`{doc}` long, `{item}` long").distinct()

    rows = wanted.toArrow()
    g = rows.column("g").to_numpy().view(np.uint64)
    order = np.argsort(g, kind="stable")
    g, keys = g[order], rows.column("key").to_numpy()[order]
    contexts = np.frombuffer(b"".join(rows.column("context").to_pylist()), np.uint64).reshape(-1, width)[order]
    unique, first, repeats = np.unique(g, return_index=True, return_counts=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, owner = word_hashes(b.column("text").to_pylist(), DOC_GAP)
            at, q = winnow(h, DOC_GAP, k, span - k + 1)
            slot = np.searchsorted(unique, q)
            slot[slot == len(unique)] = 0
            hit = unique[slot] == q if len(unique) else np.zeros(len(q), bool)
            at, slot = at[hit], slot[hit]
            n = repeats[slot]
            which = np.repeat(first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            for s in range(0, len(at), 65536):
                long = _run(_context(h, at[s : s + 65536], k, span - k, DOC_GAP), contexts[which[s : s + 65536]], k, span - k) >= span
                pairs = np.unique(np.stack([owner[at[s : s + 65536][long]], which[s : s + 65536][long]]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(pairs[0])), pa.array(keys[pairs[1]])], names=[doc, item])

    source = documents.select(F.col(doc).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return source.mapInArrow(scan, f"`{doc}` long, `{item}` long").distinct()
