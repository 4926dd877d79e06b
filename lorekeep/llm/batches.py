"""Word arrays of text batches, made in slices so that very long texts don't fill a worker's memory."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words are maximal runs of letters and digits, lower-cased.
WORD = re.compile(r"[^\W_]+")
#: Bytes of text turned into words at once.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of ``column`` (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.searchsorted(size, np.arange(limit, size[-1], limit), side="left") + 1) if size[-1] > limit else []
        edges = [0, *[int(c) for c in cuts if c < b.num_rows], b.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            yield b.slice(s, e - s)


def word_hashes(texts: list[str | None], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the text of each; ``gap`` separates the texts.

    Before the first, between and after the texts stands one separator with the hash ``gap``.
    """
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = np.empty(sum(map(len, words)), object)
    flat[:] = [w for ws in words for w in ws]
    code, unique = pd.factorize(flat)
    hashed = pd.util.hash_array(np.asarray(unique, object), categorize=False) if len(unique) else np.zeros(0, np.uint64)
    n = np.array([len(ws) for ws in words], np.int64)
    text = np.repeat(np.arange(len(words)), n)
    out = np.full(len(flat) + len(words) + 1, gap, np.uint64)
    out[np.arange(len(flat)) + text + 1] = hashed[code]
    owner = np.repeat(np.arange(len(words)), n + 1)
    return out, np.concatenate([owner, [len(words) - 1]]) if len(words) else np.zeros(1, np.int64)
