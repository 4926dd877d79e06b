"""Per-document text statistics, published threshold rules, and the kind of a document.

All statistics are built-in column expressions over the whole text, so they stay in the JVM and
need no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sixteen frequent function words of each of the seven languages, our choice.
COMMON = {
    "en": ("the", "of", "and", "a", "to", "in", "is", "was", "that", "it", "for", "with", "on", "be", "by", "from"),
    "de": ("der", "die", "das", "und", "den", "mit", "von", "zu", "ist", "nicht", "ein", "eine", "auf", "dem", "aber", "für"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "est", "que", "pour", "dans", "avec", "sur", "ne"),
    "es": ("el", "la", "los", "de", "y", "un", "una", "que", "en", "por", "con", "para", "no", "se", "del", "pero"),
    "pt": ("o", "a", "os", "de", "e", "um", "uma", "que", "em", "por", "com", "para", "não", "do", "da", "mas"),
    "nl": ("de", "het", "een", "en", "van", "in", "is", "op", "te", "met", "voor", "niet", "maar", "dat", "zijn", "om"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "для", "из", "но", "к", "за", "от", "при", "до", "как"),
}
#: Longest entry of a list, longest cell of a table, in characters.
ENTRY, CELL = 80, 60
#: Lines without a mark count as entries up to this length; wrapped prose is wider.
BARE = 45
#: Share of the text from which a kind prevails.
MOST = 0.5

_BULLET = rf"[ \t]*(?:[-*+•–—‣◦]|\d{{1,3}}[.)]|\[[ xX]\])[ \t]+\S[^\n]{{0,{ENTRY - 1}}}(?<![.!?])"
_PAIR = r"[ \t]*[^\s:=]{1,40}[ \t]*(?:->|=>|→|=|:)[ \t]*[^\s:=][^\n]{0,39}(?<![.!?])"
_BARE = rf"[^\n]{{1,{BARE}}}(?<![.!?])"
_ENTRY = rf"(?m)^(?:{_BULLET}|{_PAIR}|{_BARE})[ \t]*$"
_ROW = "|".join(
    (
        r"[^|\n]*\|[^|\n]*\|[^\n]*",
        r"[ \t]*\+[-=+]+\+[ \t]*",
        rf"[^,\n]{{0,{CELL}}}(?:,(?![ \t])[^,\n]{{0,{CELL}}}){{2,}}",
        rf"[^;\n]{{0,{CELL}}}(?:;(?![ \t])[^;\n]{{0,{CELL}}}){{2,}}",
        r"[^\t\n]+(?:\t[^\t\n]*)+",
        rf"\S[^\n]{{0,{CELL}}}?(?: {{2,}}\S[^\n]{{0,{CELL}}}?)+",
        r"[ \t]*</?(?:table|tbody|thead|tr|td|th)\b[^\n]*",
    )
)
_TABLE = rf"(?m)^(?:{_ROW})[ \t]*$"
# What any row of cells holds; plain search for these is far faster than the pattern of rows.
_CELL_MARKS = ("|", "\t", "  ", "<", "+")
_CELL_RUN = rf",(?![ \t])[^,\n]{{0,{CELL}}},(?![ \t])|;(?![ \t])[^;\n]{{0,{CELL}}};(?![ \t])"
_BROKEN = r"[�ÂÃ¢½¿ï°™€]"
_MARKUP = r"</?[A-Za-z!][^<>\n]{0,300}>|\{[^{}\n]{0,80}\}"
_BLOB_LENGTH, _BLOB = 32, r"^[A-Za-z0-9+/=_-]+$"
_MARKS = tuple("|-*•–—+=:>#")
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýаеёиоуыэюя"
_CODE = r"\(cid:\d+\)|\\[ux][0-9a-fA-F]{2,4}"


def _left(text: Column, pattern: str) -> Column:
    """Characters left without the matches of the pattern."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _without(text: Column | str, mark: str) -> Column:
    """Characters left without the mark; plain search is far faster than a pattern."""
    return F.length(F.replace(text, F.lit(mark), F.lit("")))


def _matched(text: Column, pattern: str, *marks: str, run: str | None = None) -> Column:
    """Characters within matches of the pattern, each of which holds one of the marks or a match of ``run``; other texts are not searched."""
    held = reduce(or_, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(held if run is None else held | text.rlike(run), F.length(text) - _left(text, pattern)).otherwise(F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(documents: DataFrame, key: str, text: str) -> DataFrame:
    """One row per row of ``documents``: the key and the statistics of its text.

    Null and empty texts count as empty: every count and share is 0. Words are runs of non-blanks,
    lower-cased. Other columns are dropped, so none can clash.
    """
    given = F.coalesce(F.col(text), F.lit(""))
    clean = F.when(given.contains("\r"), F.regexp_replace(given, r"\r\n?", "\n")).otherwise(given)
    base = documents.select(F.col(key), clean.alias("t"))
    base = base.withColumn("tokens", F.filter(F.split(F.lower("t"), r"\s+"), lambda w: w != "")).withColumn("n", F.length("t"))
    common = sorted({w for ws in COMMON.values() for w in ws})
    base = base.withColumn("line", F.array_join("tokens", " ")).withColumn("n_words", F.size("tokens"))
    base = base.withColumn("dense", F.length("line") - F.greatest(F.col("n_words") - 1, F.lit(0)))
    base = base.withColumn("runs", F.trim(F.regexp_replace("t", r"[^\p{L}\p{N}]+", " ")))
    base = base.withColumn("run_chars", _without("runs", " "))
    base = base.withColumn("n_lines", F.regexp_count("t", F.lit(r"(?:\A|\n)[^\S\n]*\S")))
    t, n, words, dense = F.col("t"), F.col("n"), F.col("n_words"), F.col("dense")
    spaced = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    vowelless = F.regexp_replace(spaced, rf" [^ {_VOWELS}]++(?= )", "")
    # Broken encodings leave characters outside ASCII, so a text of single bytes holds none.
    broken = F.when(F.octet_length("t") == n, F.lit(0)).otherwise(n - _left(t, _BROKEN))
    is_common = F.filter("tokens", lambda w: w.isin(*common))
    return base.select(
        F.col(key),
        n.alias("n_chars"),
        words.alias("n_words"),
        F.col("n_lines"),
        _share(dense, words).alias("mean_word_length"),
        _share(F.size(F.array_distinct("tokens")), words).alias("distinct_words"),
        _share(F.size(F.filter("tokens", lambda w: (F.length(w) == 1) & ~w.isin(*_MARKS))), words).alias("single_letters"),
        _share(F.size(is_common), words).alias("common_words"),
        F.size(F.array_distinct(is_common)).alias("n_common_words"),
        _share(F.size(F.filter("tokens", lambda w: w.rlike(r"\p{L}"))), words).alias("words_with_letters"),
        _share(F.length(F.regexp_replace("runs", r"[^\p{L}]+", "")), dense).alias("letters"),
        _share(F.col("run_chars"), dense).alias("letters_digits"),
        _share(F.col("run_chars"), F.length("runs") - F.col("run_chars") + 1).alias("mean_run_length"),
        # What is left of the line differs by the words without vowels and the blank before each.
        _share(dense - _without(vowelless, " "), dense).alias("vowelless_text"),
        _share(dense - _left(t, r"[\s#{}<>|\\~^*_=\[\]@$&%+]+"), words).alias("symbols_per_word"),
        F.size(F.array_remove(F.array_distinct(F.split(F.regexp_replace("t", r"[\p{L}\p{N}\s]+", ""), "")), "")).alias("different_marks"),
        _share(n - _without("t", "#"), words).alias("hashes_per_word"),
        _share(F.regexp_count(t, F.lit(r"\.\.\.|…")), words).alias("ellipses_per_word"),
        _share(F.regexp_count(t, F.lit(r"[.!?:\"'»”)\]][ \t]*(?:\n|\z)")), F.col("n_lines")).alias("punctuated_lines"),
        _share(F.regexp_count(t, F.lit(r"(?m)^[ \t]*(?:[-*+•–—‣◦]|\d{1,3}[.)]|\[[ xX]\])[ \t]")), F.col("n_lines")).alias("bullet_lines"),
        _share(F.regexp_count(t, F.lit(r"(?m)(?:\.\.\.|…)[ \t]*$")), F.col("n_lines")).alias("ellipsis_lines"),
        _share(_matched(t, _TABLE, *_CELL_MARKS, run=_CELL_RUN), n).alias("table_text"),
        _share(n - _left(t, _ENTRY), n).alias("entry_text"),
        _share(_matched(t, _MARKUP, "<", "{"), n).alias("markup_text"),
        _share(F.length(F.array_join(F.filter("tokens", lambda w: (F.length(w) >= _BLOB_LENGTH) & w.rlike(_BLOB)), "")), n).alias("blob_text"),
        _share(_matched(t, _CODE, "(cid:", "\\"), n).alias("code_text"),
        _share(broken, dense).alias("broken_text"),
    )


def _named(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()]), lambda r: r.isNotNull())


def reasons(s: DataFrame) -> DataFrame:
    """Adds ``reasons``: the published prose rules that each document fails, in order.

    All but the last are the quality rules of Rae et al. 2021 (arXiv:2112.11446, appendix A.1) with their
    thresholds; the stop words are ours, as theirs are English only. The last is the line rule of Penedo et
    al. 2024 (arXiv:2406.17557).
    """
    c = F.col
    rules = {
        "fewer than 50 or more than 100,000 words": ~c("n_words").between(50, 100_000),
        "mean word length outside 3 to 10": ~c("mean_word_length").between(3, 10),
        "more than 0.1 hash signs a word": c("hashes_per_word") > 0.1,
        "more than 0.1 ellipses a word": c("ellipses_per_word") > 0.1,
        "more than 0.9 of the lines start with a bullet": c("bullet_lines") > 0.9,
        "more than 0.3 of the lines end with an ellipsis": c("ellipsis_lines") > 0.3,
        "under 0.8 of the words hold a letter": c("words_with_letters") < 0.8,
        "fewer than two of the stop words": c("n_common_words") < 2,
        "at most 0.12 of the lines end with punctuation": c("punctuated_lines") <= 0.12,
    }
    return s.withColumn("reasons", _named(rules))


def _rules() -> dict[str, dict[str, Column]]:
    """Our own thresholds for each kind that is not prose, by kind in order of precedence."""
    c = F.col
    no_table = c("table_text") < MOST
    # Justified prose has wide gaps as aligned cells have, but it keeps its sentences.
    sentences = (c("common_words") >= 0.15) & (c("punctuated_lines") >= MOST)
    return {
        "junk": {
            "no words": c("n_words") == 0,
            "codes of characters": c("code_text") >= MOST,
            "blobs": c("blob_text") >= MOST,
            "broken characters": c("broken_text") >= 0.2,
            "markup": (c("markup_text") >= MOST) & no_table,
            # Cells are set off by a few marks again and again, random characters mix many.
            "random characters": (c("letters_digits") < 0.3) & (c("mean_run_length") < 2) & (c("different_marks") >= 12),
            "letters apart": (c("single_letters") >= 0.6) & (c("n_words") >= 20),
            "random letters": (c("vowelless_text") >= 0.8) & (c("letters") >= MOST) & (c("n_words") >= 5) & no_table,
            "few letters": (c("letters") < 0.35) & no_table & (c("entry_text") < MOST),
            "the same words": (c("distinct_words") < 0.12) & (c("n_words") >= 20) & (c("distinct_words") * c("n_words") <= 40),
        },
        "table": {"rows of cells": (c("table_text") >= MOST) & ~sentences},
        "list": {"short entries": (c("entry_text") >= MOST) & (c("n_lines") >= 3)},
    }


def kinds(s: DataFrame) -> DataFrame:
    """Adds ``kind``: ``junk``, ``table``, ``list`` or ``prose``, by fixed thresholds on the statistics.

    An empty document is junk. Junk goes before table, and table before list.
    """
    kind = F
    for name, rules in _rules().items():
        kind = kind.when(reduce(or_, rules.values()), name)
    return s.withColumn("kind", kind.otherwise("prose"))


def kind_reasons(s: DataFrame) -> DataFrame:
    """Adds ``because``: the rules that hold for each document, each after the kind it speaks for."""
    return s.withColumn("because", _named({f"{kind}: {name}": holds for kind, rules in _rules().items() for name, holds in rules.items()}))


def not_prose(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, kind)`` of the documents that are not prose.

    The kind is made in a generator: a filter would be pushed below the statistics, and each of them
    would be computed twice.
    """
    made = kinds(statistics(documents, key, text))
    return made.select(key, F.explode(F.filter(F.array("kind"), lambda k: k != "prose")).alias("kind"))
