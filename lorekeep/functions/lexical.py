"""Lexical retrieval: tokens, inverted index, conjunctive match, BM25, TF-IDF and cover density."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut

TOKEN = r"[\p{L}\p{N}_]+"
# The weights of topic (A) and body (B) terms, and BM25's parameters.
WEIGHT_A, WEIGHT_B = 1.0, 0.4
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def joined(text: Column) -> Column:
    """The tokens of a text, with a blank between them."""
    return F.array_join(tokens(text), " ")


class Texts:
    """Query texts, matched with a batch of documents at once, where these lie.

    A text is the list of its distinct terms. A text of one term scores by the sum of the weights of its places; a longer
    one by its minimal covers, and only documents that hold its rarest term are compared with it whole.
    """

    def __init__(self, table: pa.Table):
        lists = table.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.ids, self.terms, self.codes, self.ends = table.column("text_id").to_numpy(), coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        need = np.diff(self.ends)
        self.alone = np.full(len(self.terms), -1, np.int64)
        self.alone[self.codes[self.ends[:-1][need == 1]]] = self.ids[need == 1]
        self.long, self.rarest = np.nonzero(need > 1)[0], np.zeros(0, np.int64)

    def by_rarest(self, frequency: np.ndarray) -> Texts:
        """Sorts the longer texts by their rarest term, without those that have a term in no document."""
        rarest = [min((frequency[c], c) for c in self.codes[self.ends[t] : self.ends[t + 1]]) for t in self.long]
        kept = sorted((c, t) for (n, c), t in zip(rarest, self.long, strict=True) if n > 0)
        self.rarest, self.long = (np.array([x[i] for x in kept], np.int64) for i in (0, 1))
        return self

    def _coded(self, joined: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token its document, its place there from 1, and its code or -1."""
        lists = pc.split_pattern(joined, " ")
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        row = np.repeat(np.arange(len(joined)), np.diff(starts))
        return row, np.arange(len(row)) - starts[row] + 1, pc.index_in(lists.flatten(), value_set=self.terms).fill_null(-1).to_numpy()

    def _places(self, topics: pa.Array, bodies: pa.Array) -> tuple[np.ndarray, ...]:
        """Document, place (the body after the topic), code and weight of all tokens that are terms, in order."""
        (ra, pa_, ca), (rb, pb, cb) = self._coded(topics), self._coded(bodies)
        size = np.bincount(ra, minlength=len(topics))
        row, place, code = (np.concatenate(x) for x in ((ra, rb), (pa_, pb + size[rb]), (ca, cb)))
        weight = np.concatenate([np.full(len(ra), WEIGHT_A), np.full(len(rb), WEIGHT_B)])
        kept = np.nonzero(code >= 0)[0]
        kept = kept[np.lexsort((place[kept], row[kept]))]
        return row[kept], place[kept], code[kept], weight[kept]

    def frequency(self, topics: pa.Array, bodies: pa.Array) -> np.ndarray:
        """How many of the documents hold each term."""
        row, _, code, _ = self._places(topics, bodies)
        return np.bincount(np.unique(row * len(self.terms) + code) % len(self.terms), minlength=len(self.terms)) if len(row) else np.zeros(len(self.terms), np.int64)

    def match(self, topics: pa.Array, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, document and score of the documents that hold all terms of a text."""
        row, place, code, weight = self._places(topics, bodies)
        one = self.alone[code] >= 0
        pair, inverse = np.unique(row[one] * max(1, len(self.terms)) + code[one], return_inverse=True)
        total = np.round(np.bincount(inverse, weight[one], len(pair)), 9)
        found = [(self.alone[pair % max(1, len(self.terms))], pair // max(1, len(self.terms)), total / (total + 1))]
        if len(self.long):
            found.append(self._match_long(row, place, code, weight))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _match_long(self, row: np.ndarray, place: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.zeros(len(self.terms), bool)
        first[self.rarest] = True
        held, out = np.zeros(len(self.terms), bool), []
        for r in np.unique(row[first[code]]):
            lo, hi = np.searchsorted(row, (r, r + 1))
            mine = code[lo:hi]
            held[mine] = True
            for c in np.unique(mine[first[mine]]):
                for t in self.long[slice(*np.searchsorted(self.rarest, (c, c + 1)))]:
                    terms = self.codes[self.ends[t] : self.ends[t + 1]]
                    if held[terms].all():
                        at = lo + np.nonzero(np.isin(mine, terms))[0]
                        x = _covers(list(zip(place[at].tolist(), code[at].tolist(), weight[at].tolist(), strict=True)), len(terms))
                        out.append((self.ids[t], r, x / (x + 1)))
            held[mine] = False
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        return np.array(a, np.int64), np.array(b, np.int64), np.array(c, np.float64)


def bm25_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, as the baseline ranker splits them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def inverted_index(docs: DataFrame, key: str, topic: str, body: str) -> DataFrame:
    """``(term, id, positions_a, positions_b)``: where each term stands in topic and body (from 1, the body after the topic)."""
    a, b = tokens(F.col(topic)), tokens(F.col(body))
    both = F.concat(F.transform(a, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("p"), F.lit(True).alias("a"))), F.transform(b, lambda t, i: F.struct(t.alias("term"), (i + 1 + F.size(a)).alias("p"), F.lit(False).alias("a"))))
    flat = docs.select(F.col(key).alias("id"), F.explode(both).alias("e")).select("id", "e.*")
    at = lambda a: F.array_sort(F.collect_list(F.when(F.col("a") == a, F.col("p"))))
    return flat.groupBy("term", "id").agg(at(True).alias("positions_a"), at(False).alias("positions_b"))


def term_documents(docs: DataFrame, key: str, split: Column, only: DataFrame | None = None) -> DataFrame:
    """``(id, term, tf, length)``: term counts, summed inside each task before the shuffle.

    With ``only`` (a table of terms) other terms are dropped before they are counted.
    """
    base = docs.select(F.col(key).alias("id"), split.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    if only is not None:
        base = base.join(only.select("term").distinct(), "term", "left_semi")
    return base.groupBy("id", "length", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "length")


#: Tokens of a part of the documents, and queries of a block, about.
TOKENS, ASKED = 2_500_000, 65_536
#: Rows that the document frequencies of a part are packed into.
PACKED = 64


def _base(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int, float, int]:
    """``(id, s, length)`` of the documents that have tokens, split once; and the number of all, their mean length and all tokens."""
    base = cut(docs.select(F.col(key).alias("id"), bm25_tokens(F.col(text)).alias("w")).select("id", F.array_join("w", " ").alias("s"), F.size("w").alias("length")))
    size = base.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.sum("length").alias("all")).first()
    return base.filter("length > 0"), size.n or 0, size.mean or 1.0, size["all"] or 0


def _frequencies(base: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(term, df)``: in how many documents each term is, of the terms of ``only`` or all."""
    terms = base.select(F.explode(F.array_distinct(F.split("s", " "))).alias("term"))
    if only is not None:
        only = only.select("term").distinct()
        terms = terms.join(F.broadcast(only) if only.limit(200_001).count() <= 200_000 else only, "term", "left_semi")
    return cut(terms.groupBy("term").agg(F.count("*").alias("df")))


def _best(base: DataFrame, asked: DataFrame, tokens: int, k: int, mean: float, idf: DataFrame | None = None, rare: float = 0.0) -> DataFrame:
    """``(query_id, id, score)``: of each query the ``k`` best documents of every part, and perhaps more that tie in 9 places.

    ``asked`` is ``(query_id, term, w)``. Each block of queries meets each part of the documents in one cell, where the terms'
    postings are added up; so neither the postings nor the scores of all pairs are shuffled. With ``idf(term, idf)`` the scores are cosines
    of TF-IDF vectors (a term that it lacks has ``rare``), else BM25.
    """
    asked = cut(asked.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("q")).select(F.col("query_id").alias("id"), F.array_join("q.term", " ").alias("s"), F.col("q.w").alias("x")))
    blocks, parts = max(1, -(-asked.count() // ASKED)), max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TOKENS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["q", "p", "kind", "id", "s", "x", "length"]
    none = {"length": F.lit(0), "p": every(parts)}
    cells = base.withColumns({"kind": F.lit(0), "x": F.lit(None).cast("array<double>"), "q": every(blocks), "p": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")}).select(*columns)
    cells = cells.unionByName(asked.withColumns(none | {"kind": F.lit(1), "q": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")}).select(*columns))
    if idf is not None:
        packed = idf.groupBy(F.pmod(F.xxhash64("term"), F.lit(PACKED)).alias("id")).agg(F.collect_list(F.struct("term", "idf")).alias("t"))
        packed = packed.select("id", F.array_join("t.term", " ").alias("s"), F.col("t.idf").alias("x")).withColumn("q", every(blocks))
        cells = cells.unionByName(packed.withColumns(none | {"kind": F.lit(2)}).select(*columns))
    cosine = idf is not None

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks().sort_by("id")
        kind = cell.column("kind").to_numpy()
        docs, queries, known = (cell.filter(pa.array(kind == i)) for i in range(3))
        words = lambda t: pc.split_pattern(t.column("s"), " ").combine_chunks()
        ids, n = docs.column("id").to_numpy(), len(docs)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if n and len(queries):
            lists = words(docs)
            coded = lists.flatten().dictionary_encode()
            vocabulary, size = coded.dictionary, len(coded.dictionary)
            at = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + at, return_counts=True)
            code, doc = pair // n, pair % n
            if cosine:
                weight = np.full(size, rare)
                if len(known):
                    place = pc.index_in(words(known).flatten(), value_set=vocabulary)
                    held = place.is_valid().to_numpy(zero_copy_only=False)
                    weight[place.drop_null().to_numpy()] = known.column("x").combine_chunks().flatten().to_numpy()[held]
                value = tf * weight[code]
                norm = np.sqrt(np.bincount(doc, value * value, n))
            else:
                value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * docs.column("length").to_numpy()[doc] / mean))
            start = np.searchsorted(code, np.arange(size + 1))
            lists = words(queries)
            ends, mine = lists.offsets.to_numpy(), pc.index_in(lists.flatten(), value_set=vocabulary)
            mine = mine.fill_null(-1).to_numpy()
            w, qi = queries.column("x").combine_chunks().flatten().to_numpy(), queries.column("id").to_numpy()
            take, dense = min(k, n), {}
            for i in range(len(queries)):
                terms = [(c, x) for c, x in zip(mine[ends[i] : ends[i + 1]], w[ends[i] : ends[i + 1]], strict=True) if c >= 0]
                if not terms:
                    continue
                score = np.zeros(n)
                for c, x in terms:
                    lo, hi = start[c], start[c + 1]
                    if hi - lo > n // 8:
                        if c not in dense:
                            dense[c] = np.zeros(n)
                            dense[c][doc[lo:hi]] = value[lo:hi]
                        score += x * dense[c]
                    else:
                        score[doc[lo:hi]] += x * value[lo:hi]
                if cosine:
                    by = norm * np.sqrt(np.sum(w[ends[i] : ends[i + 1]] ** 2))
                    score = np.divide(score, by, out=np.zeros(n), where=by > 0)
                edge = np.partition(score, n - take)[n - take] - 2e-9
                if edge <= 0:
                    # Few positive scores: those that share a term count, whatever their score.
                    best = np.unique(np.concatenate([doc[start[c] : start[c + 1]] for c, _ in terms]))
                    best = best[score[best] >= edge]
                else:
                    best = np.nonzero(score >= edge)[0]
                best = best[np.lexsort((best, -np.round(score[best], 9)))[:take]]
                found.append((np.full(len(best), qi[i]), ids[best], score[best]))
        a, b, c = (np.concatenate(z) for z in zip(*found, strict=True))
        return pa.table({"query_id": a, "id": b, "score": c})

    return cells.groupBy("q", "p").applyInArrow(search, "query_id long, id long, score double")


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """``(query_id, id, score)``: BM25 of documents that share a term with a query, among them the ``k`` best of each; repeated query terms count again."""
    wanted = cut(queries.select(F.col(query_key).alias("query_id"), F.explode(bm25_tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    base, n, mean, tokens = _base(docs, key, text)
    df = _frequencies(base, wanted)
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return _best(base, wanted.join(df, "term").select("query_id", "term", (F.col("times") * idf).alias("w")), tokens, k, mean)


def parse_query(text: str) -> dict:
    """A web-style query: ``groups`` of alternatives, each a list of terms in order, and ``without`` terms to exclude.

    Quotes make a phrase, ``or`` joins alternatives, a leading minus excludes.
    """
    groups, without, alternative = [], [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.strip()[:200]):
        if not minus and word.lower() == "or" and groups:
            alternative = True
            continue
        terms = re.findall(r"[^\W]+", (phrase or word).lower())
        if not terms:
            continue
        if minus:
            without.append(terms)
        elif alternative:
            groups[-1].append(terms)
        else:
            groups.append([terms])
        alternative = False
    return {"groups": groups, "without": without}


def _covers(places: list[tuple[int, int, float]], need: int) -> float:
    """Sum over the minimal covers of the harmonic weight of the cover, damped by its length in excess."""
    total, start, seen = 0.0, 0, {}
    for end in range(len(places)):
        term = places[end][1]
        seen[term] = seen.get(term, 0) + 1
        while len(seen) == need:
            first = places[start]
            if seen[first[1]] == 1:
                span = places[start : end + 1]
                noise = max(0, span[-1][0] - span[0][0] - (len(span) - 1))
                total += len(span) / sum(1.0 / w for _, _, w in span) / (1.0 + noise)
            seen[first[1]] -= 1
            if not seen[first[1]]:
                del seen[first[1]]
            start += 1
    return total


def matches(text: str, query: dict) -> list[tuple[int, int, float]] | None:
    """Places ``(position, group, weight)`` of a query's terms in the text, or null if it doesn't match."""
    words = re.findall(r"[^\W]+", text.lower())

    def at(terms: list[str]) -> list[int]:
        return [i for i in range(len(words) - len(terms) + 1) if words[i : i + len(terms)] == terms]

    if any(at(t) for t in query["without"]):
        return None
    places = []
    for g, alternatives in enumerate(query["groups"]):
        own = [(i + 1 + j, g, 1.0) for terms in alternatives for i in at(terms) for j in range(len(terms))]
        if not own:
            return None
        places += own
    return sorted(places) or None


def cover_density(docs: DataFrame, key: str, topic: str, body: str, query: str, normalise: bool = True) -> DataFrame:
    """``(id, score)`` of the documents that match a web-style query, ranked by cover density over topic (A) and body (B).

    Phrases and alternatives make positions matter, which built-in columns cannot express; the text
    is read in Arrow batches. With ``normalise`` the score is ``r / (r + 1)``.
    """
    parsed = parse_query(query)
    need = len(parsed["groups"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, scores = [], []
            for k, t, x in zip(*(b.column(c).to_pylist() for c in ("id", "t", "x")), strict=True):
                head = len(re.findall(r"[^\W]+", (t or "").lower()))
                places = matches(f"{t or ''} \n {x or ''}", parsed) if need else None
                if places:
                    r = _covers([(p, g, WEIGHT_A if p <= head else WEIGHT_B) for p, g, _ in places], need)
                    keys.append(k)
                    scores.append(r / (r + 1) if normalise else r)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(topic).alias("t"), F.col(body).alias("x")).mapInArrow(rank, "id long, score double")


def tfidf_cosine(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """``(query_id, id, score)``: cosine of the TF-IDF vectors (tf * ln(n / df)) of queries and documents that share a term, among them the ``k`` best of each query."""
    wanted = cut(queries.select(F.col(query_key).alias("query_id"), F.explode(bm25_tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    base, n, mean, tokens = _base(docs, key, text)
    df = _frequencies(base).withColumn("idf", F.log(F.lit(n) / F.col("df")))
    # Terms of one document, which are most, need not travel to the parts.
    asked = wanted.join(df, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))
    return _best(base, asked, tokens, k, mean, df.filter("df > 1").select("term", "idf"), float(np.log(max(1, n))))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the distinct tokens of two texts; 0 where either has none or they share none."""
    x, y = F.array_distinct(bm25_tokens(a)), F.array_distinct(bm25_tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(both > 0, 2.0 * both / (F.size(x) + F.size(y))).otherwise(0.0)
