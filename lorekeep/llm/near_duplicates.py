"""Near-duplicate records: pigeonhole blocks over minwise fingerprints.

1. Each text becomes a fingerprint of minwise hashes of its distinct words: two fingerprints agree in
   each place with the probability of the texts' Jaccard similarity. Texts with the same distinct words
   form one class and are compared once.
2. Fingerprints are split into blocks and joined on them; pairs in a block are compared by the Hamming
   distance of one bit a place.
3. Pairs that are close enough are checked exactly by the Jaccard similarity of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.batches import slices
from lorekeep.llm.components import components
from lorekeep.llm.multi_index import close_pairs, lists, longs, mix
from lorekeep.session import cut

#: Pairs exactly at the threshold share no block with at most this probability; closer pairs with far less.
MISS = 0.01
#: Similarity that texts with nothing to do with each other seldom exceed; the blocks' length follows from it.
BACKGROUND = 0.1
#: Records that share a block by chance, about.
BUCKET = 1000
LEAST_LENGTH = 3
#: Places compared by one bit each: with so many, unlike texts seldom pass.
BITS = 256
CODE = [f"c{k}" for k in range(BITS // 64)]
#: Standard deviations by which the radius exceeds the mean distance at the threshold.
SLACK = 3.5
#: Hashes of a slice's unique words held at once; with more words, fewer places are made at a time.
SPREAD = 1 << 23
#: Bytes of text worked on at once.
SLICE_BYTES = 1_000_000
#: Bits of the filter that keeps texts in no close pair out of the shuffle: a fixed 1 MB, whatever the input.
FILTER_BITS = 1 << 23


def shape(n: int, threshold: float) -> tuple[int, int]:
    """``(length, blocks)`` for ``n`` texts: places in a block, and blocks.

    The length grows with the logarithm of ``n`` so that blocks stay small, and the number of blocks
    follows from it: 19 blocks up to a million texts, 34 up to ten million, 57 up to a hundred million.
    """
    length = max(LEAST_LENGTH, math.ceil(math.log(max(1, n) / BUCKET) / -math.log(BACKGROUND) - 1e-9) if n > BUCKET else 0)
    return length, math.ceil(math.log(MISS) / math.log(1 - threshold**length))


def radius(threshold: float) -> int:
    """Bits that a pair at the threshold differs in at most, but for one such pair in 4,000."""
    f = (1 - threshold) / 2
    return int(BITS * f + SLACK * math.sqrt(BITS * f * (1 - f)))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: (number of each text, index into the unique words, unique words)."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(column, "")), r"[^\p{L}\p{N}]+", " ")
    split = pc.utf8_split_whitespace(spaced)
    words = split.flatten().dictionary_encode()
    empty = max((i for i, w in enumerate(words.dictionary.to_pylist()) if not w), default=-1)
    text = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
    pairs = pd.unique(text * len(words.dictionary) + words.indices.to_numpy())
    text, code = np.divmod(pairs, max(1, len(words.dictionary)))
    text, code = text[code != empty], code[code != empty]
    return np.bincount(text, minlength=len(column)), code, words.dictionary.to_numpy(zero_copy_only=False)


def _hash(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def fingerprints(texts: DataFrame, text: str, length: int, blocks: int, min_words: int) -> DataFrame:
    """Replaces the text by ``words`` (number of distinct words), ``same`` (hash of the set), ``slots`` and the code.

    ``slots`` (a value for each block) and the code are null for texts of too few words, and for all but the
    first text of each class in a slice: copies are dropped before they are shuffled.
    """
    others = [f for f in texts.schema.fields if f.name != text]
    places = -(-max(BITS, length * blocks) // 64) * 64
    rng = np.random.default_rng(5)
    factor = rng.integers(0, 1 << 63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, places, dtype=np.uint64)
    turn = rng.integers(0, 1 << 63, (blocks, length), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, SLICE_BYTES):
            n, code, unique = _words(b.column(text))
            h = mix(_hash(unique))
            starts = np.concatenate([[0], np.cumsum(n)])
            same = np.zeros(b.num_rows, np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                same[full] = np.add.reduceat(mix(h ^ np.uint64(0xFF51AFD7ED558CCD))[code], starts[full])
            same = mix(same ^ n.astype(np.uint64))
            lead = np.zeros(b.num_rows, bool)
            lead[np.unique(same, return_index=True)[1]] = True
            lead &= n >= min_words
            at = np.flatnonzero(lead)
            least = np.empty((len(at), places), np.uint32)
            step = min(places, max(1, SPREAD // max(1, len(h))))
            for p in range(0, places, step):
                spread = ((h[:, None] * factor[p : p + step] + shift[p : p + step]) >> np.uint64(32)).astype(np.uint32)
                for k, i in enumerate(at):
                    spread[code[starts[i] : starts[i + 1]]].min(axis=0, out=least[k, p : p + step])
            slots = (mix(least[:, : blocks * length].astype(np.uint64)).reshape(-1, blocks, length) * turn).sum(axis=2, dtype=np.uint64)
            slots = mix(slots ^ mix(np.arange(1, blocks + 1, dtype=np.uint64)))
            bits = longs(least[:, :BITS] & 1)
            back = pa.array(np.cumsum(lead) - 1, mask=~lead)
            out = [b.column(f.name) for f in others]
            out += [pa.array(n.astype(np.int32)), pa.array(same.view(np.int64)), lists(slots).take(back)]
            out += [pa.array(np.ascontiguousarray(bits[:, k])).take(back) for k in range(len(CODE))]
            yield pa.RecordBatch.from_arrays(out, names=[*[f.name for f in others], "words", "same", "slots", *CODE])

    schema = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "words int", "same long", "slots array<long>", *[f"{c} long" for c in CODE]]
    return texts.mapInArrow(make, ", ".join(schema))


def maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Drops most rows whose ``id`` is not among ``ids`` and none that is, by a broadcast bitmap of fixed size.

    With more ids than bits the bitmap lets everything through, and the join that follows does all the work.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    got = words.toArrow()
    table[got.column("w").to_numpy()] = got.column("b").to_numpy()
    kept, columns = table.tobytes(), rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(kept, np.int64)
        for b in batches:
            s = b.column("_s").to_numpy()
            hit = (bits[s >> 6] >> (s & 63)) & 1
            yield b.filter(pa.array(hit.astype(bool))).select(columns)

    return rows.withColumn("_s", slot).mapInArrow(keep, rows.schema)


def near_duplicates(texts: DataFrame, key: str, text: str, version: str | None = None, threshold: float = 0.6, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with the same distinct words, and pairs of classes that are near duplicates.

    Returns ``members(class, id)``, one row per record with at least ``min_words`` distinct words
    (``class`` is the least id with those words), and ``links(class_a, class_b, similarity)`` with the
    Jaccard similarity of the distinct words, at least ``threshold``; ``class_a < class_b``.

    ``key`` may repeat: with ``version`` the row with its greatest value counts (equal ones are taken
    to be identical), without it repeated rows are taken to be identical. Rows with a null key are
    dropped; null, empty and too short texts give no row. Other columns are ignored, and no name
    clashes with theirs. Copies are never expanded here, so a text copied into a third of all rows
    costs one comparison.
    """
    columns = [F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (F.col(version) if version else F.lit(0)).alias("version")]
    base = texts.select(*columns).filter(F.col("id").isNotNull())
    n = base.count()
    length, blocks = shape(n, threshold)
    marks = cut(fingerprints(base, "text", length, blocks, min_words))
    current = marks.groupBy("id").agg(F.max(F.struct("version", "words", "same")).alias("m")).select("id", "m.*").filter(F.col("words") >= min_words)
    current = cut(current)
    classes = current.groupBy("same").agg(F.min(F.struct("id", "version")).alias("r")).select("same", F.col("r.id").alias("class"), "r.version")
    classes = cut(classes)
    members = current.select("id", "same").join(classes.select("same", "class"), "same").select("class", "id")
    # Texts of older versions are indexed too, which spares a join; their classes fall out here.
    leads = marks.filter(F.col("slots").isNotNull()).select(F.col("same").alias("id"), "slots", *CODE)
    near = close_pairs(leads, CODE, radius(threshold), n, blocks)
    a, b = (classes.select(F.col("same").alias(f"id_{x}"), F.col("class").alias(f"class_{x}")) for x in "ab")
    close = cut(near.join(a, "id_a").join(b, "id_b").select(F.least("class_a", "class_b").alias("id_a"), F.greatest("class_a", "class_b").alias("id_b")))
    # Exact check: the words of the classes in any close pair, and only those, are made again.
    ids = close.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    involved = cut(ids.join(classes.select(F.col("class").alias("id"), F.col("version").alias("newest")), "id"))
    texts_of = maybe_in(base, involved).join(involved, "id").filter("version = newest").dropDuplicates(["id"])
    # One string of distinct words a class travels, which compresses far better than an array of hashes.
    distinct = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    words = texts_of.select("id", F.array_join(distinct, " ").alias("w"))
    a, b = words.select(F.col("id").alias("id_a"), F.col("w").alias("a")), words.select(F.col("id").alias("id_b"), F.col("w").alias("b"))
    both = close.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", F.split("a", " ").alias("wa"), F.split("b", " ").alias("wb"))
    both = both.withColumn("k", F.size(F.array_intersect("wa", "wb")))
    similarity = F.col("k") / (F.size("wa") + F.size("wb") - F.col("k"))
    links = both.select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), similarity.alias("similarity"))
    return members, links.filter(F.col("similarity") >= F.lit(threshold) - 1e-9)


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs ``(id_a, id_b)`` of records that the classes and links stand for, the smaller id first."""
    # A class's least id stands for it, so only classes with further members need a lookup.
    further = members.filter("class <> id")
    grown = cut(further.unionByName(further.select("class").distinct().withColumn("id", F.col("class"))))
    # All members of a class meet as in a block, which splits very large classes.
    inner = close_pairs(grown.select("id", F.array("class").alias("slots")), [], 0, grown.count(), 1)
    a = grown.select(F.col("class").alias("class_a"), F.col("id").alias("x"))
    b = grown.select(F.col("class").alias("class_b"), F.col("id").alias("y"))
    outer = links.select("class_a", "class_b").join(a, "class_a", "left").join(b, "class_b", "left")
    outer = outer.select(F.coalesce("x", "class_a").alias("x"), F.coalesce("y", "class_b").alias("y"))
    return inner.unionByName(outer.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class, group, n_links)``: each record's class, the least id it is linked to directly or not, and its class's links."""
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    roots = components(links, "class_a", "class_b").select(F.col("id").alias("class"), F.col("root").alias("group"))
    out = members.join(ends, "class", "left").join(roots, "class", "left")
    return out.select("id", "class", F.coalesce("group", "class").alias("group"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
