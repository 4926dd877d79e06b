"""Languages of documents and segments: nearest centroid over TF-IDF character n-grams.

A bounded sample of labelled texts trains several clustered centroids per language. A segment's
vector is the sum of the normalised TF-IDF n-gram vectors of its words; it gets the language of the
centroid with the greatest cosine, unless that is too far (rejection). Because the vector is a sum
over words, a worker needs only each word's products with the centroids and a short sketch for the
norm, and keeps them for words it has seen. A word counts once in a segment, so that an article
repeated in it doesn't outweigh the others.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.batches import WORD, slices

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru")
# ISO 639-1, 639-2 codes and names of each language, in English and its own.
SPELLINGS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ru": ("ru", "rus", "russian", "русский"),
}
#: Labelled texts per language the centroids are fitted on, at most.
SAMPLE = 160
#: Width of the hashed n-gram space, centroids per language, rounds of outlier removal and clustering.
DIM, CLUSTERS, ROUNDS = 4096, 3, 4
GRAMS = (2, 3)
#: A whole word counts so many times as one of its n-grams.
WORD_TIMES = 2
SKETCH = 64
#: A segment counts with so many plain words at least; a topic with fewer.
SEGMENT_WORDS, TOPIC_WORDS = 4, 3
#: Cosine under which a segment has no language, and the lead over the next language.
LEAST_COSINE, LEAST_LEAD = 0.2, 0.002
#: Texts with fewer distinct words, or a smaller share of plain words, are placeholders or machine output.
PROSE_WORDS, PROSE_SHARE = 8, 0.3
#: Words a worker keeps; beyond, it starts anew.
KEPT_WORDS = 200_000

SEGMENT = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
ASIDE = re.compile(r"\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]|\([^()]*\)|\[[^\[\]]*\]|^\s*[A-Z]{2,12}:\s")
OUTER = " \t.,;:!?…-–—*>#|\"'()[]{}<>/"


def label_code(label: Column) -> Column:
    """The code of a label spelled as code, region code or name in any case; null for any other."""
    pairs = [x for code, names in SPELLINGS.items() for n in names for x in (F.lit(n), F.lit(code))]
    return F.create_map(*pairs)[F.split(F.lower(F.trim(label)), "[-_]")[0]]


def _plain(segment: str) -> tuple[list[str], int]:
    """Distinct words of letters only, and their number with repetitions: names with digits or hyphens, paths and codes are left out."""
    out, n = {}, 0
    for t in segment.replace("'", " ").replace("’", " ").split():
        w = t.strip(OUTER)
        if w.isalpha():
            out[w.lower()] = None
            n += 1
    return list(out), n


def counted_segments(text: str) -> list[tuple[list[str], int]]:
    """The plain words of each sentence or line, without quotes, remarks in brackets and a leading note mark, and their number."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return [_plain(ASIDE.sub(" ", s)) for s in SEGMENT.split(text)]


def segments(text: str) -> list[list[str]]:
    """The distinct plain words of each sentence or line."""
    return [words for words, _ in counted_segments(text)]


def _distinct(text: str, enough: int) -> int:
    """Distinct words of the text; counting stops at ``enough``."""
    seen = set()
    for m in WORD.finditer(text.lower()):
        seen.add(m.group())
        if len(seen) == enough:
            break
    return len(seen)


def _grams(word: str) -> list[str]:
    w = f"_{word}_"
    return [w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)] + [w] * WORD_TIMES


def _slot(gram: str) -> int:
    return int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=4).digest(), "little") % DIM


def _counts(word: str) -> np.ndarray:
    return np.bincount([_slot(g) for g in _grams(word)], minlength=DIM).astype(np.float32)


def _vectors(words: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.stack([_counts(w) for w in words]) * idf if words else np.zeros((0, DIM), np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Centroids (rows) with their languages, the inverse document frequencies, and the sketch for norms."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    sketch: np.ndarray

    def table(self, words: list[str]) -> np.ndarray:
        """Per word: its products with the centroids, then its sketch."""
        v = _vectors(words, self.idf)
        return np.concatenate([v @ self.centroids.T, v @ self.sketch], axis=1)

    def scores(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of summed rows of :meth:`table`: language index, cosine, and lead over the next language."""
        k = len(self.centroids)
        cos = sums[:, :k] / np.maximum(np.linalg.norm(sums[:, k:], axis=1, keepdims=True), 1e-9)
        by = np.stack([cos[:, self.owner == i].max(axis=1, initial=-1.0) for i in range(len(LANGUAGES))], axis=1)
        top = np.sort(by, axis=1)
        return by.argmax(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def fit(texts: list[str], labels: list[str], seed: int = 3) -> Model:
    """Fits the centroids. Segments nearer to another language than their label's are dropped in rounds."""
    segs, owner = [], []
    for t, label in zip(texts, labels, strict=True):
        for words in segments(t):
            if len(words) >= SEGMENT_WORDS:
                segs.append(words)
                owner.append(LANGUAGES.index(label))
    vocabulary = sorted({w for s in segs for w in s})
    at = {w: i for i, w in enumerate(vocabulary)}
    counts = np.stack([_counts(w) for w in vocabulary]) if vocabulary else np.zeros((1, DIM), np.float32)
    seen = np.zeros(DIM, np.float32)
    for s in segs:
        seen += counts[[at[w] for w in s]].any(axis=0)
    idf = (np.log((1 + len(segs)) / (1 + seen)) + 0.1).astype(np.float32)
    words = counts * idf
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    x = np.stack([words[[at[w] for w in s]].sum(axis=0) for s in segs]) if segs else np.zeros((0, DIM), np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    y, rng = np.array(owner, np.int64), np.random.default_rng(seed)
    good = np.ones(len(x), bool)
    centroids, kinds = np.zeros((0, DIM), np.float32), np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        rows, marks = [], []
        for i in range(len(LANGUAGES)):
            own = x[good & (y == i)]
            if not len(own):
                continue
            k = min(CLUSTERS if turn else 1, len(own))
            c = own[rng.choice(len(own), k, replace=False)] if k > 1 else own.mean(axis=0, keepdims=True)
            for _ in range(8 if k > 1 else 0):
                near = (own @ c.T).argmax(axis=1)
                c = np.stack([own[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            rows.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))
            marks += [i] * k
        if not rows:
            break
        centroids, kinds = np.concatenate(rows).astype(np.float32), np.array(marks)
        good = kinds[(x @ centroids.T).argmax(axis=1)] == y
    sketch = (rng.integers(0, 2, (DIM, SKETCH)) * 2 - 1).astype(np.float32) / np.sqrt(SKETCH)
    return Model(idf, centroids, kinds, sketch)


def train(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE) -> Model:
    """Fits a model on at most ``sample`` texts per language, chosen by a hash of the text.

    ``label`` holds any spelling :func:`label_code` knows; other labels, null and empty texts are passed over.
    """
    rows = labelled.select(F.col(text).alias("t"), label_code(F.col(label)).alias("l")).filter("l is not null and t is not null and t <> ''")
    order = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    picked = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).orderBy("l", "r").select("t", "l").collect()
    return fit([r.t for r in picked], [r.l for r in picked])


class _Scorer:
    """Scores lists of words, and keeps the rows of the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((1024, len(model.centroids) + SKETCH), np.float32)

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        flat = np.empty(sum(map(len, lists)), object)
        flat[:] = [w for ws in lists for w in ws]
        code, unique = pd.factorize(flat)
        if len(self.at) > KEPT_WORDS:
            self.at = {}
        fresh = [w for w in unique if w not in self.at]
        for s in range(0, len(fresh), 512):
            part = fresh[s : s + 512]
            n = len(self.at)
            while n + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n : n + len(part)] = self.model.table(part)
            self.at.update(zip(part, range(n, n + len(part)), strict=True))
        place = np.array([self.at[w] for w in unique], np.int64)[code] if len(flat) else np.zeros(0, np.int64)
        n = np.array([len(ws) for ws in lists], np.int64)
        out = np.zeros((len(lists), self.rows.shape[1]), np.float32)
        full = np.flatnonzero(n)
        starts = np.cumsum(n) - n
        for s in range(0, len(full), 4096):
            part = full[s : s + 4096]
            lo, hi = starts[part[0]], starts[part[-1]] + n[part[-1]]
            out[part] = np.add.reduceat(self.rows[place[lo:hi]], starts[part] - lo, axis=0)
        return out


def segment_languages(texts: DataFrame, text: str, model: Model, least_words: int = SEGMENT_WORDS, whole: bool = False) -> DataFrame:
    """Adds ``found``, an array of ``(segment, lang, confidence)``, and ``words`` (distinct words, counted up to ``PROSE_WORDS``) and ``plain`` (share of plain words), and drops ``text``.

    Segments are sentences and lines, numbered from 0; with ``whole`` the text is one segment. A
    segment with fewer than ``least_words`` plain words, or too far from every centroid, has no entry.
    The confidence is the cosine's lead over the next language as a share of the cosine, 0 to 1.
    Null and empty texts give an empty array.
    """
    others = [f for f in texts.schema.fields if f.name != text]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in slices(batches, text):
            lists, owner, number, distinct, share = [], [], [], [], []
            for i, t in enumerate(b.column(text).to_pylist()):
                counted = counted_segments(t or "")
                own = [words for words, _ in counted]
                if whole:
                    own = [list(dict.fromkeys(w for s in own for w in s))]
                raw = len((t or "").split())
                share.append(sum(n for _, n in counted) / raw if raw else 0.0)
                distinct.append(_distinct(t or "", PROSE_WORDS))
                for k, ws in enumerate(own):
                    if len(ws) >= least_words:
                        lists.append(ws)
                        owner.append(i)
                        number.append(k)
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            if lists and len(model.centroids):
                lang, cos, lead = model.scores(scorer.sums(lists))
                for i, k, c, s, d in zip(owner, number, lang.tolist(), cos.tolist(), lead.tolist(), strict=True):
                    if s >= LEAST_COSINE and d >= LEAST_LEAD:
                        found[i].append({"segment": k, "lang": LANGUAGES[c], "confidence": min(1.0, d / s)})
            kind = pa.list_(pa.struct([("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))
            out = [b.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, kind), pa.array(distinct, pa.int32()), pa.array(share, pa.float64())], names=[*[f.name for f in others], "found", "words", "plain"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "found array<struct<segment:int,lang:string,confidence:double>>", "words int", "plain double"])
    return texts.mapInArrow(make, schema)


def document_languages(found: Column) -> Column:
    """``(lang, segments, confidence)`` of each language of a ``found`` array, most segments first."""

    def of(code: str) -> Column:
        own = F.filter(found, lambda s: s["lang"] == code)
        total = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["confidence"])
        return F.struct(F.size(own).alias("segments"), F.lit(code).alias("lang"), F.try_divide(total, F.size(own)).alias("confidence"))

    every = F.filter(F.array(*[of(c) for c in LANGUAGES]), lambda s: s["segments"] > 0)
    return F.reverse(F.array_sort(every))


def wrong_or_missing(records: DataFrame, key: str, text: str, topic: str, label: str, model: Model, version: str | None = None) -> DataFrame:
    """``(key, field_name, lang)``: languages of texts whose label is missing, unknown or wrong, or that mix languages, and of topics in a language of their own.

    ``key`` may repeat; with ``version`` the row with its greatest value counts. A text that is a
    placeholder or machine output gives no row. Rows with a null key are dropped; null texts give no row.
    """
    base = records.select(F.col(key).cast("long").alias("id"), (F.col(version) if version else F.lit(0)).alias("version"), label_code(F.col(label)).alias("label"), F.col(text).alias("text"), F.col(topic).alias("topic"))
    scored = segment_languages(base.filter("id is not null"), "text", model)
    scored = scored.withColumn("langs", F.sort_array(F.array_distinct(F.transform("found", lambda s: s["lang"]))))
    scored = scored.select("id", "version", "label", "topic", "langs", ((F.col("words") >= PROSE_WORDS) & (F.col("plain") >= PROSE_SHARE)).alias("prose"))
    both = segment_languages(scored, "topic", model, TOPIC_WORDS, whole=True)
    both = both.select("id", "version", "label", "langs", "prose", F.get("found", F.lit(0))["lang"].alias("topic"))
    current = both.groupBy("id").agg(F.max(F.struct("version", "label", "langs", "prose", "topic")).alias("m")).select("id", "m.*").filter("prose")
    odd = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    rows = F.concat(
        F.when(F.coalesce(odd, F.lit(True)), F.transform("langs", lambda c: F.struct(F.lit("lesson_text").alias("f"), c.alias("c")))).otherwise(F.array().cast("array<struct<f:string,c:string>>")),
        F.when((F.size("langs") > 0) & F.col("topic").isNotNull() & ~F.array_contains("langs", F.col("topic")), F.array(F.struct(F.lit("topic").alias("f"), F.col("topic").alias("c")))).otherwise(F.array().cast("array<struct<f:string,c:string>>")),
    )
    return current.select("id", F.explode(rows).alias("r")).select(F.col("id").alias(key), F.col("r.f").alias("field_name"), F.col("r.c").alias("lang"))
