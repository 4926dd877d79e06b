"""Deterministic text classification, key extraction and hashing, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries that treat accented letters and digits as parts of words.
START, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

# The patterns, vocabularies and types of the surveyed functions.
MODEL = (
    r"(claude[-_][a-z0-9][-a-z0-9_.]{2,30}|gpt[-_][a-z0-9][-a-z0-9_.]{1,20}|llama[-_][a-z0-9][-a-z0-9_.]{1,20}"
    r"|mistral[-_][a-z0-9][-a-z0-9_.]{1,20}|gemma[-_][a-z0-9][-a-z0-9_.]{1,20})"
)
FILE = r"((?:apps|src|tests|scripts|extension|alembic|routes|workflows|transactions|adapters|agents)/[a-zA-Z0-9_./-]{2,80}(?:\.[a-z]{1,6})?)"
FAILURE = r"([A-Z][A-Z0-9]+(?:_[A-Z][A-Z0-9]+)+)"
FAILURE_WORDS = (
    "FAIL|ERROR|BUG|CRASH|PANIC|TIMEOUT|DEAD|ZOMBIE|ORPHAN|LEAK|STALE|BROKEN|CORRUPT|ABORT|REJECT|INVALID|MISSING|CONFLICT|DUPLICATE|PHANTOM"
    "|OVERFLOW|UNDERFLOW|VIOLATION|OOM|EXCEEDED|CEILING|LIMIT|UNMET|DENIED|REFUSED|FORBIDDEN|UNAUTHORIZED|CANCELLED|CANCELED|SUPERSEDED|STORM"
    "|THROTTL|QUOTA|BLOCKED|HANG|STALL|LOST|UNAVAILABLE|UNREACHABLE|RETRY|EXHAUSTED|DEGRADED|SKIPPED|EMPTY|NOT_FOUND|NOTFOUND"
)
SCHEMA = r"([a-z_][a-z0-9_]{1,60}\.[a-z_][a-z0-9_]{1,60})"
NOT_SCHEMA = (
    "py", "sql", "md", "ts", "js", "tsx", "jsx", "sh", "yml", "yaml", "json", "toml", "txt", "csv", "html", "css", "go", "rs", "rb", "java",
    "c", "h", "cpp", "ini", "cfg", "lock", "log", "out", "env", "xml", "conf", "png", "svg", "jpg", "gz", "zip", "com", "org", "net", "io", "dev", "local",
)
CONTENT_TYPES = ("incident", "decision", "entity", "fact", "procedure")
SLUG_TYPES = ("person", "org", "project", "product", "location", "concept")
CONTACT = ("email", "phone", "address", "telegram", "full_name")
EDGE_KINDS = {
    "causal": ("CAUSED_BY", "DERIVED_FROM", "CONTRADICTS"),
    "temporal": ("CO_OCCURRED", "PRECEDED_BY"),
    "entity": ("ENTITY_LINK", "SHARED_TAG", "IS_A", "PART_OF"),
}
INCIDENT = (
    r"(root.?cause|postmortem|outage|incident|hotfix|regression|rollback|revert)",
    r"(stacktrace|traceback|segfault|oom.?kill)",
    r"the (bug|error|issue|failure) (was|is)",
)
INCIDENT_BOTH = (r"(crashed?|broken|corrupted?|panicked?|failed)", r"(caused|because of|due to|led to|resulted?|triggered?)")
DECISION = (r"(decided|decision|verdict|approved|chosen)",)
DECISION_OPEN = (START + r"ADR[-\s]?\d", r"we (chose|selected|adopted|agreed|preferred?|decided)" + END)
DECISION_BOTH = (r"(chose|selected|adopted)", r"(instead|over|rather than|in favor of)")
ENTITY = (
    r"is (?:a|the)(?:\s+\w+){0,2}\s+(?:service|tool|library|module|package|repo|repository|component|system|project)",
    r"is (?:the)(?:\s+\w+){0,1}\s+(?:lead|owner|author|contact|maintainer|engineer|manager|architect|operator|po)",
    r"(owns?|maintains?|is responsible for)",
)
FACT = (
    r"(defaults? to|default (value |port |behavior )?is)",
    r"always returns?",
    r"(is always|is set to|is stored in|is fixed at|is never)",
    r"version (is|was)",
    r"(schema|table|column|port|endpoint) (is|has|was|uses?|contains?)",
)
ACTION = r"(run|install|deploy|configure|restart|use)"
PROCEDURE = (
    r"when",
    r"(must|should|always|never|avoid|prefer|recommend)",
    r"(run|execute|install|deploy|configure|restart|use)",
    r"(command|script|workflow|pattern|approach|method)",
    r"how to",
)


def _word(text: Column, *patterns: str) -> Column:
    """Whether any pattern occurs as whole words, whatever the case."""
    return text.rlike("(?is)" + "|".join(f"{START}(?:{p}){END}" for p in patterns))


def _open(text: Column, *patterns: str) -> Column:
    """Whether any pattern occurs; patterns say for themselves where a word must begin or end."""
    return text.rlike("(?is)" + "|".join(patterns))


def classify_content_type(text: Column) -> Column:
    """``incident``, ``decision``, ``entity``, ``fact``, ``procedure`` or null: the first kind whose words occur."""
    both = lambda pair: _word(text, pair[0]) & _word(text, pair[1])
    return (
        F.when(_word(text, *INCIDENT) | both(INCIDENT_BOTH), "incident")
        .when(_word(text, *DECISION) | _open(text, *DECISION_OPEN) | both(DECISION_BOTH), "decision")
        .when(_word(text, *ENTITY), "entity")
        .when(_word(text, *FACT) & ~_word(text, "when") & ~_word(text, ACTION), "fact")
        .when(_word(text, *PROCEDURE), "procedure")
    )


def entity_keys(text: Column) -> Column:
    """Sorted distinct ``model:``, ``file:``, ``failure:`` and ``schema:`` keys of a text; empty when none, null for null."""

    def found(pattern: str, flags: str = "") -> Column:
        return F.regexp_extract_all(text, F.lit(f"{flags}{START}{pattern}{END}"), F.lit(1))

    models = F.transform(found(MODEL, "(?i)"), lambda m: F.concat(F.lit("model:"), F.lower(m)))
    files = F.filter(found(FILE), lambda m: ~m.rlike(r"\.\.$|//$|\.md$"))
    failures = F.filter(found(FAILURE), lambda m: F.length(m).between(6, 40) & m.rlike(FAILURE_WORDS))
    schemas = F.filter(found(SCHEMA, "(?i)"), lambda m: ~F.lower(F.split_part(m, F.lit("."), F.lit(2))).isin(*NOT_SCHEMA))
    parts = [
        models,
        F.transform(files, lambda m: F.concat(F.lit("file:"), m)),
        F.transform(failures, lambda m: F.concat(F.lit("failure:"), m)),
        F.transform(schemas, lambda m: F.concat(F.lit("schema:"), F.lower(m))),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def situation_key(topic: Column, text: Column) -> Column:
    """``class=...`` of an incident topic, else of a failure class (with the outcome) or a completed outcome in the text; else null."""
    failure = F.regexp_extract(text, r"failure_class=([A-Z0-9_]+)", 1)
    outcome = F.regexp_extract(text, r"outcome=([A-Z]+)", 1)
    return (
        F.when(topic.rlike(r"^\[INCIDENT:[a-z0-9_]+\]"), F.concat(F.lit("class="), F.regexp_extract(topic, r"^\[INCIDENT:([a-z0-9_]+)\]", 1)))
        .when(failure != "", F.concat(F.lit("class="), failure, F.when(outcome != "", F.concat(F.lit("|outcome="), outcome)).otherwise("")))
        .when(text.contains("outcome=COMPLETED"), "class=completed")
    )


def canonical_slug(kind: Column, label: Column) -> Column:
    """``kind:slug`` with the slug cut to 64 characters at an underscore; null for an unknown kind or an empty label."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.substring(plain, 1, 64)
    short = F.when(F.length(plain) > 64, F.regexp_replace(F.regexp_replace(cut, "_[^_]*$", ""), "_+$", "")).otherwise(plain)
    return F.when(kind.isin(*SLUG_TYPES) & (short != ""), F.concat(kind, F.lit(":"), short))


def is_contact(prop: Column) -> Column:
    """Whether a property names personal contact data."""
    return prop.isin(*CONTACT)


def content_hash(role: Column, topic: Column, commit: Column, artifact: Column) -> Column:
    """MD5 of role, topic and the commit (else artifact, else nothing), joined by bars."""
    empty = F.lit("")
    return F.md5(F.concat(F.coalesce(role, empty), F.lit("|"), F.coalesce(topic, empty), F.lit("|"), F.coalesce(commit, artifact, empty)))


def edge_kind(relation: Column) -> Column:
    """The kind of a relation type: causal, temporal, entity, else semantic."""
    out = F.lit("semantic")
    for kind, names in EDGE_KINDS.items():
        out = F.when(relation.isin(*names), kind).otherwise(out)
    return out


def repetition(text: Column) -> Column:
    """Share of the most frequent token of a trimmed text."""
    tokens = F.split(F.regexp_replace(F.trim(text), r"\s+", " "), " ")
    most = F.array_max(F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda u: u == t))))
    return most / F.size(tokens)


def quality_error(text: Column, least: int = 20, most: float = 0.8) -> Column:
    """``too_short`` or ``repetitive`` for texts that ingestion refuses; null for good ones."""
    return F.when(text.isNull() | (F.length(F.trim(text)) < least), "too_short").when(repetition(text) > most, "repetitive")


def token_cost(text: Column) -> Column:
    """About a text's tokens: a quarter of its bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def valid_slug(key: Column) -> Column:
    """Whether an entity key has a known kind and a plain slug; false for null."""
    return F.coalesce(key.rlike(rf"\A(?:{'|'.join(SLUG_TYPES)}):[a-z0-9_]+\z"), F.lit(False))


def iso_utc(at: Column) -> Column:
    """A time as ISO 8601 in UTC, to the second; sessions run in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# The category of each question type; unanswerable questions and unknown types have their own.
QUESTION_CATEGORIES = {
    "single-session-user": "single_session_user",
    "single-session-assistant": "single_session_user",
    "single-session-preference": "single_session_user",
    "multi-session": "multi_session_user",
    "temporal-reasoning": "temporal_reasoning",
    "knowledge-update": "knowledge_update",
}
ABSENT, USUAL = "multi_session_topic_absent", "single_session_user"


def question_category(question: Column, kind: Column) -> Column:
    """The category of a question, by its id's ending and its type."""
    out = F.lit(USUAL)
    for name, category in QUESTION_CATEGORIES.items():
        out = F.when(kind == name, category).otherwise(out)
    return F.when(question.endswith("_abs"), ABSENT).otherwise(out)
