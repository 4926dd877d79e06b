"""The llm operators on small fixtures: against brute force, exact round trips, and the hard cases of each."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import components, languages, leakage, multi_index, near_duplicates, packing, quality, rank_fusion, representatives, similar_vectors

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "va", "zo", "pe", "ni", "da") for b in ("ban", "der", "fil", "gor", "hem", "jit", "lun", "mop", "rax", "sut")]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# ---- 1: one ranking from several scores ----


def borda_plain(data, missing):
    out = {}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        points = {r[1]: 0.0 for r in own}
        for k in (2, 3):
            v = {r[1]: r[k] if r[k] is not None and r[k] == r[k] else None for r in own}
            has = [x for x in v.values() if x is not None]
            for i, x in v.items():
                if x is None:
                    rank = (len(own) + 1) / 2 if missing == "mid" else (len(has) + 1 + len(own)) / 2
                else:
                    rank = sum(y > x for y in has) + (sum(y == x for y in has) + 1) / 2
                points[i] += len(own) - rank
        for p, i in enumerate(sorted(points, key=lambda i: (-points[i], i)), 1):
            out[g, i] = (points[i], p)
    return out


@pytest.mark.parametrize("missing", ["mid", "lowest"])
def test_borda_matches_plain_count(spark, missing):
    r = random.Random(1)
    data = [(g, i, r.choice([None, float("nan"), 1.0, 2.0, 500.0, r.random()]), r.choice([None, 0.1, 0.2, r.random()])) for g, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame([(*d, "clash", None) for d in data], "q long, i long, a double, b double, points string, position string")
    got = {(x.q, x.i): (x.points, x.position) for x in rank_fusion.borda(df, "q", "i", {"a": 1.0, "b": 1.0}, missing).collect()}
    assert got == borda_plain(data, missing)


def test_borda_edge_cases(spark):
    schema = "q long, i long, a double"
    assert rank_fusion.borda(spark.createDataFrame([], schema), "q", "i", {"a": 1.0}).count() == 0
    nulls = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (1, 2, None), (1, 1, None)], schema)
    assert rows(rank_fusion.borda(nulls, "q", "i", {"a": 1.0}), "i", "position") == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        rank_fusion.borda(nulls, "q", "i", {"a": 1.0}, "first")


# ---- 2: near duplicates ----


def edited(r, words):
    out = list(words)
    for _ in range(r.randint(0, 5)):
        at = r.randrange(len(out))
        if r.random() < 0.5:
            out[at] = r.choice(WORDS) + str(r.randint(1, 99))
        else:
            out.insert(at, r.choice(WORDS))
    half = r.randrange(len(out))
    return out[half:] + out[:half]


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(2)
    texts = []
    for _ in range(150):
        base = [r.choice(WORDS) + r.choice(["", str(r.randint(1, 60))]) for _ in range(40)]
        texts += [" ".join(edited(r, base)) for _ in range(r.choice([1, 1, 2, 3]))]
    texts += [texts[0], texts[0].upper() + "!"]
    data = [(i, 1, t, "x") for i, t in enumerate(texts)] + [(0, 0, "an older state of the first text with other words in it", "x"), (0, 1, texts[0], "x"), (None, 1, "a", "x"), (9001, 1, None, "x"), (9002, 1, "", "x"), (9003, 1, "too few words", "x")]
    df = spark.createDataFrame(data, "id long, v int, t string, class string")
    members, links = near_duplicates.near_duplicates(df, "id", "t", "v")
    got = set(rows(near_duplicates.expand(members, links), "id_a", "id_b"))
    sets = [set(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got <= true and len(got) >= 0.99 * len(true)
    assert members.filter("id > 9000").count() == 0


def test_near_duplicates_that_share_common_words(spark):
    r = random.Random(22)
    common, texts = [f"common{i}" for i in range(21)], []
    for i in range(150):
        both = common + [f"both{i}x{k}" for k in range(13)]
        for side in "ab":
            words = both + [f"{side}{i}x{k}" for k in range(11)]
            texts.append(" ".join(r.sample(words, 45)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    _, links = near_duplicates.near_duplicates(df, "id", "t")
    got = rows(links, "class_a", "class_b")  # 34 of 56 words shared in each true pair
    assert set(got) <= {(2 * i, 2 * i + 1) for i in range(150)} and len(got) >= 0.95 * 150


def test_near_duplicates_of_nothing_and_of_copies(spark):
    empty = spark.createDataFrame([], "id long, t string")
    members, links = near_duplicates.near_duplicates(empty, "id", "t")
    assert near_duplicates.expand(members, links).count() == 0
    copies = spark.range(200).select("id", F.lit("one two three four five six seven eight nine").alias("t"))
    members, links = near_duplicates.near_duplicates(copies, "id", "t")
    assert links.count() == 0 and rows(members.select("class").distinct(), "class") == [(0,)] and members.count() == 200


def test_hot_blocks_are_cut_and_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (60, 64)).astype(bool)
    bits[:40, :16] = False  # forty codes share two blocks
    slots = np.packbits(bits, axis=1).astype(int) + 256 * np.arange(8)
    code = multi_index.longs(bits)[:, 0]
    marks = spark.createDataFrame([(i, slots[i].tolist(), int(code[i])) for i in range(60)] * 2, "id long, slots array<long>, c0 long")
    true = {(i, j) for i in range(60) for j in range(i + 1, 60) if (bits[i] != bits[j]).sum() <= 26 and set(slots[i]) & set(slots[j])}
    assert rows(multi_index.close_pairs(marks, ["c0"], 26, 120, 8), "id_a", "id_b") == sorted(true)
    monkeypatch.setattr(multi_index, "CHUNK", 4)
    monkeypatch.setattr(multi_index, "REPORTED", 1)
    assert multi_index.heavy_slots(marks, 4).count() > 1
    assert rows(multi_index.close_pairs(marks, ["c0"], 26, 120, 8), "id_a", "id_b") == sorted(true)


# ---- 3: similar vectors ----


def test_similar_pairs_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    close = base[:60] + 0.15 * rng.standard_normal((60, 16))
    x = np.concatenate([base, close]) * rng.uniform(0.2, 9, (360, 1))
    bad = [(500, 1, None), (501, 1, [1.0]), (502, 1, [0.0] * 16), (503, 1, [float("nan")] * 16), (None, 1, [1.0] * 16), (0, 0, [5.0] * 16), (0, 1, x[0].tolist())]
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)] + bad, "id long, at int, e array<double>").withColumn("code", F.lit("clash"))
    got = set(rows(similar_vectors.similar_pairs(df, "id", "e", "at", dim=16, cosine=0.9), "id_a", "id_b"))
    u = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    true = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j}
    assert got <= true and len(got) >= 0.95 * len(true) and len(true) > 20
    assert similar_vectors.similar_pairs(df.limit(0), "id", "e", "at", dim=16).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = set(rows(similar_vectors.nearest(df.filter("id % 50 = 0"), df, 10, dim=32), "query_id", "id"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(40), np.arange(0, 2000, 50)] = -2
    true = {(q * 50, int(j)) for q in range(40) for j in np.argsort(-s[q])[:10]}
    assert len(got) == 400 and len(got & true) / 400 >= 0.9


# ---- 4: representatives ----


def test_survivors_with_unusable_values_and_ties(spark):
    data = [("g", 1, 5, 0.5), ("g", 2, 5, float("nan")), ("g", 3, -1, 0.9), ("g", 4, None, 0.9), ("solo", 5, 1, 1.0), (None, 6, 1, 1.0), ("none", 7, None, None), ("none", 8, -3, 2.0)]
    df = spark.createDataFrame(data, "h string, id long, n int, c double").withColumn("survivor", F.lit("clash"))
    order = [("n", F.col("n") >= 0, True), ("c", F.col("c").between(0, 1), True)]
    got = representatives.survivors(df, "h", "id", order, {"n_id": ("n", True), "c_id": ("c", True)})
    assert sorted(rows(got, "h", "survivor", "n_id", "c_id"), key=lambda r: r[0]) == [("g", 1, 1, 3), ("none", 7, None, None)]
    assert representatives.survivors(df.limit(0), "h", "id", order, {}).count() == 0


def test_consensus(spark):
    data = [("g", 1, "the cat sat on the mat"), ("g", 2, "the cat sat on a mat"), ("g", 3, "the cat sat on the mat"), ("g", 4, "no dog"), ("g", 5, None), ("h", 6, ""), ("n", 7, None)]
    df = spark.createDataFrame(data, "g string, id long, t string")
    assert rows(representatives.consensus(df, "g", "id", "t"), "g", "id", "distance") == [("g", 1, 0), ("h", 6, 0)]
    many = spark.createDataFrame([("g", i, f"alpha beta x{i} gamma delta") for i in range(80)] + [("g", 99, "alpha beta gamma delta")], "g string, id long, t string")
    best = representatives.consensus(many, "g", "id", "t").first()
    assert best.distance <= 1


# ---- 5: groups ----


def test_components_match_union_find(spark):
    r = random.Random(6)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2120)] + [(7, 7), (None, 1), (1, None), (3, 9), (9, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    true = sorted((x, find(x)) for x in root if x != find(x) or any(find(y) == x for y in root if y != x))
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a long, b long, root string")
    assert rows(components.components(df, "a", "b"), "id", "root") == true
    assert components.components(df.limit(0), "a", "b").count() == 0


# ---- 6: languages ----

SAMPLES = {
    "en": "The worker checks the queue and then the report is written to the table before the night run.",
    "de": "Der Arbeiter prüft die Warteschlange und danach wird der Bericht vor dem nächtlichen Lauf geschrieben.",
    "fr": "Le travailleur vérifie la file et ensuite le rapport est écrit dans la table avant la nuit.",
    "es": "El trabajador comprueba la cola y después el informe se escribe en la tabla antes de la noche.",
    "pt": "O trabalhador verifica a fila e depois o relatório é escrito na tabela antes da noite.",
    "nl": "De werker controleert de wachtrij en daarna wordt het verslag voor de nacht in de tabel geschreven.",
    "ru": "Рабочий проверяет очередь, а затем отчёт записывается в таблицу до ночного прогона.",
}


def test_languages_and_held_out_segments(spark):
    model = languages.fit([t for t in SAMPLES.values() for _ in range(3)], [c for c in SAMPLES for _ in range(3)])
    mixed = SAMPLES["en"] + " " + SAMPLES["de"]
    data = [
        (1, 1, SAMPLES["en"], "the report of the night run", "English"),
        (2, 1, SAMPLES["fr"], "le rapport avant la nuit", "en-GB"),
        (3, 1, mixed, "the report is written", "en"),
        (4, 1, SAMPLES["es"], "der Bericht wird danach geschrieben", "es_MX"),
        (5, 1, SAMPLES["nl"], "", "unknown"),
        (6, 1, "n/a", "the report of the night run", None),
        (7, 1, '{"k":"a1","v":22}\n0x12ab 0x99 33|44|55 a/b:3 c/d:9 e_f g_h 1 2', "the report of the night run", None),
        (8, 1, None, None, None),
        (9, 1, "the report is written before night. " * 20, "the report of the night run", None),
        (10, 1, SAMPLES["fr"].replace(".", " ") * 30, "", "en"),
        (2, 0, SAMPLES["ru"], "x", "ru"),
        (None, 1, SAMPLES["ru"], "x", None),
    ]
    df = spark.createDataFrame(data, "id long, at int, t string, topic string, label string")
    got = rows(languages.wrong_or_missing(df, "id", "t", "topic", "label", model, "at"), "id", "field_name", "lang")
    assert got == [(2, "lesson_text", "fr"), (3, "lesson_text", "de"), (3, "lesson_text", "en"), (4, "topic", "de"), (5, "lesson_text", "nl"), (10, "lesson_text", "fr")]
    found = languages.segment_languages(df.filter("id = 3").select("id", "t"), "t", model)
    parts = found.select(languages.document_languages(F.col("found")).alias("d")).first().d
    assert {p.lang for p in parts} == {"en", "de"} and all(0 < p.confidence <= 1 for p in parts)


def test_an_untrained_model_finds_nothing(spark):
    df = spark.createDataFrame([("", None), (None, "en"), ("text", "xx")], "t string, l string")
    model = languages.train(df, "t", "l")
    assert [r.found for r in languages.segment_languages(df.select("t"), "t", model).collect()] == [[], [], []]


# ---- 7: packing ----


def test_packing_is_a_partition_of_the_items(spark):
    r = random.Random(7)
    n = [0, 1, 512, 513, 8192, 8193, 30000] + [r.choice([r.randrange(1, 400), r.randrange(1, 9000)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(n)), "id long, n long")
    got = packing.pack(df, [512, 2048, 4096, 8192, 512, None], shard=500).toPandas()
    assert got.groupby("id").n.sum().to_dict() == dict(enumerate(n))
    split = got.groupby("id").size()
    assert all((split[i] > 1) == (x > 8192) for i, x in enumerate(n))
    for _, box in got.sort_values("offset").groupby("container"):
        assert box.n.sum() <= box.capacity.iloc[0] and box.capacity.nunique() == 1 and box.step.nunique() == 1
        assert (box.offset.to_numpy() == np.cumsum(box.n.to_numpy()) - box.n.to_numpy()).all()
    used = got.groupby("container").agg(n=("n", "sum"), c=("capacity", "first"))
    assert used.n.sum() / used.c.sum() > 0.95
    assert packing.pack(df.limit(0), [512]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, [0, None])


def test_sizes(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "x")], "id long, t string")
    assert rows(packing.sizes(df, "id", "t", lambda: lambda t: len(t.split())), "id", "n") == [(1, 3), (2, 0), (3, 0)]


# ---- 8: leakage ----


@pytest.mark.parametrize("inline", [True, False])
def test_leaks_match_brute_force(spark, monkeypatch, inline):
    r = random.Random(8)
    if not inline:
        monkeypatch.setattr(leakage, "INLINE_ENTRIES", 3)
    items = [[r.choice(WORDS) for _ in range(r.randint(8, 40))] for _ in range(25)]
    docs = []
    for _ in range(120):
        words = [r.choice(WORDS) for _ in range(r.randint(0, 200))]
        it = r.choice(items)
        span = r.choice([0, 5, 11, 12, 13, 30])
        at = r.randrange(max(1, len(it) - span + 1))
        cut_at = r.randrange(len(words) + 1)
        docs.append(words[:cut_at] + it[at : at + span] + words[cut_at:])
    texts = [re.sub(" ", lambda _: r.choice([" ", ", ", "\n", "  "]), " ".join(d)) for d in docs]
    grams = {tuple(w[i : i + 12]): 0 for w in docs for i in range(len(w) - 11)}
    true = sorted({(d, k) for k, w in enumerate(items) for d, x in enumerate(docs) if any(tuple(w[i : i + 12]) in grams and w[i : i + 12] == x[j : j + 12] for i in range(len(w) - 11) for j in range(len(x) - 11))})
    data = [(i, t.title()) for i, t in enumerate(texts)] + [(0, texts[0]), (900, None), (901, ""), (None, " ".join(items[0]))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("g", F.lit("clash"))
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(77, None), (78, "")], "item_id long, item_text string")
    assert rows(leakage.leaks(df, "doc_id", "text", ev, "item_id", "item_text"), "doc_id", "item_id") == true and true
    assert leakage.leaks(df.limit(0), "doc_id", "text", ev, "item_id", "item_text").count() == 0
    assert leakage.leaks(df, "doc_id", "text", ev.limit(0), "item_id", "item_text").count() == 0


# ---- 9: quality ----


def test_kinds_and_reasons(spark):
    r = random.Random(9)
    prose = "".join(f"The {r.choice(WORDS)} checks the {r.choice(WORDS)} and a report is written to the {r.choice(WORDS)} before the night run, so nobody waits for it. " for _ in range(30))
    data = {
        1: (prose, "prose"),
        2: ("Notes:\n" + "\n".join(f"- item number {i}" for i in range(12)), "list"),
        3: ("\n".join(f"{i},x{i},2025-01-{i:02d},name" for i in range(10, 30)), "table"),
        4: ("| a | b |\r\n| --- | --- |\r\n| 1 | 2 |\r\n| 3 | 4 |", "table"),
        5: ("spam spam " * 60, "junk"),
        6: ("", "junk"),
        7: (None, "junk"),
        8: ("a0b1c2d3" * 40, "junk"),
        9: ("T h e   w o r k e r   c h e c k s   t h e   q u e u e   a n d   t h e   r e p o r t", "junk"),
        10: (prose + "\n- one\n- two\n- three\n\n" + prose, "prose"),
        12: ("".join(r.choices("!#$%&*+-./<=>?@[]^_{|}~ab01  ", k=400)), "junk"),
        13: ("+---+---+\n| 1 | 2 |\n+---+---+\n| 3 | 4 |\n+---+---+", "table"),
        11: ("tqrq sl wqxw tjrxvd hwqvxvsqx jxqkfgqzx qwlz rvwknhzvzd mwkgmlh", "junk"),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in data.items()], "id long, t string").withColumn("n_words", F.lit("clash"))
    got = {r.id: r for r in quality.kind_reasons(quality.reasons(quality.kinds(quality.statistics(df, "id", "t")))).collect()}
    assert got[12].because[0] == "junk: random characters" and got[1].because == []
    assert rows(quality.not_prose(df, "id", "t"), "id", "kind") == sorted((k, kind) for k, (_, kind) in data.items() if kind != "prose")
    assert {k: r.kind for k, r in got.items()} == {k: kind for k, (_, kind) in data.items()}
    assert got[1].reasons == [] and got[5].reasons and got[7].n_words == 0
    assert quality.statistics(df.limit(0), "id", "t").count() == 0
    long = spark.createDataFrame([(1, prose * 400)], "id long, t string")
    assert quality.kinds(quality.statistics(long, "id", "t")).first().kind == "prose"


def test_text_without_vowels_is_measured_in_every_document(spark):
    r = random.Random(90)
    words = ["".join(r.choices("bcdfghjklmnpqrstvwxz", k=8)) for _ in range(95)]
    for at in range(0, 95, 19):
        words[at] = "the"  # one word in 19 is common
    spaced = "the team reads " + " ".join("bcd_fgh" for _ in range(9))
    df = spark.createDataFrame([(1, " ".join(words)), (2, spaced)], "id long, t string")
    got = {x.id: x for x in quality.kinds(quality.statistics(df, "id", "t")).collect()}
    assert got[1].common_words > 0.05 and got[1].vowelless_text > 0.8 and got[1].kind == "junk"
    assert got[2].common_words > 0.05 and got[2].vowelless_text == pytest.approx(63 / 75)


def test_gated_patterns_count_what_they_match(spark):
    from pyspark.sql import functions as F

    from lorekeep.llm import quality

    texts = ["a,b,c\nd,e,f", "a, b, c\nd, e", "x;y;z", "plain words", "a | b", "a\tb", "one  two", "+--+\n", "<tr>x", "{x}", "(cid:12) y", "\\u00e4", "a,\nb,c", ",,", "1,2,\n", "a;b,c;d,e", ""]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    pairs = [(quality._TABLE, quality._CELL_MARKS, quality._CELL_RUN), (quality._MARKUP, ("<", "{"), None), (quality._CODE, ("(cid:", "\\"), None)]
    for pattern, marks, run in pairs:
        got = df.select((F.length("t") - quality._left(t, pattern)).alias("a"), quality._matched(t, pattern, *marks, run=run).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got] and any(r.a for r in got)
