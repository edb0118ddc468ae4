"""Text scalars as Column expressions: everything here stays inside the JVM and whole-stage code generation.

All functions give null for null; lengths count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_TOKENS = 12
# Values fixed by the data model.
_TOKEN = r"[\p{L}\p{N}_./-]{2,}"
_TERM = r"[\p{L}\p{N}]+"
_SECRETS = (
    r"sk-[a-zA-Z0-9]{32,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"-----BEGIN.*PRIVATE KEY-----",
    r"[a-zA-Z0-9+/]{40,}={0,2}",
)
_DANGLING = (r"(?i)\bsee above\b", r"(?i)\bas mentioned\b", r"(?i)\bcontinued from\b", r"(?i)\bsee below\b")
# Second parts after which a line-end hyphen belongs to the word.
DEHYPHENATE_KEEP = ("the", "a", "an", "in", "on", "of", "to", "for", "by", "with", "art", "time", "based", "driven", "level", "scale")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def query_tokens(text: Column) -> Column:
    """Unicode tokens of two characters or more, the first twelve."""
    return F.slice(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), 1, QUERY_TOKENS)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda t: F.length(t) > 1)


def normalise_memory(text: Column) -> Column:
    """Trimmed, lower case, single blanks; ASCII letters and digits, CJK ideographs and blanks only."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))), r"\s+", " "), r"[^a-z0-9一-龥 ]", "")


def has_secret(text: Column) -> Column:
    return any_of([text.rlike(p) for p in _SECRETS])


def dehyphenate(text: Column) -> Column:
    """Joins words that were broken at a line end, unless the second part stands for itself."""
    keep = "|".join(DEHYPHENATE_KEEP)
    return F.regexp_replace(text, rf"(\b[a-zA-Z]+)-\n(?!(?:{keep})\b)([a-z]+\b)", "$1$2")


def clean_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"\r\n", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def strip_tags(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def embedding_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def is_complete(text: Column) -> Column:
    """False where the text points outside of itself."""
    following = text.rlike(r"(?i)\bthe following\b") & ~text.rlike(r"\n-")
    return ~(any_of([text.rlike(p) for p in _DANGLING]) | following)


def is_technical(query: Column) -> Column:
    """Whether character n-grams help with the query: acronyms, camel case, formulas, metrics."""
    return any_of([
        query.rlike(r"\b[A-Z]{2,}|\b[A-Z][a-z]+[A-Z]"),
        query.rlike(r"(?i)[=+\-*/^()]|Eq\.\d|accuracy|precision|recall|F1|loss"),
        query.rlike(r"(?i)\b(highest|best|top|maximum|minimum)\s+\w*\s*(accuracy|score|performance)"),
    ])


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def normalise_list(items: Column) -> Column:
    """Trimmed, lower case, without empty items, sorted."""
    return F.array_sort(F.filter(F.transform(items, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def short_hash(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("", *parts), 256), 1, digits)


def truncate_at_newline(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, at the last line end if that keeps more than 80 %."""
    head = F.substring(text, 1, limit)
    last = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    cut = F.when(last > limit * 0.8, F.substring(head, F.lit(1), last.cast("int"))).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def snippet(text: Column, words: list[str], size: int = 10) -> Column:
    """Up to ``size`` tokens around the first match, matches in square brackets."""
    tokens = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    marks = "|".join(f"{w}" for w in sorted(words))
    hit = F.coalesce(F.array_position(F.transform(tokens, lambda t: t.rlike(rf"(?i)\b(?:{marks})\b")), True), F.lit(0))
    start = F.greatest(F.lit(1), hit - size // 2).cast("int")
    part = F.array_join(F.slice(tokens, start, F.lit(size)), " ")
    return F.regexp_replace(part, rf"(?i)\b({marks})\b", "[$1]")


def similar_words(a: Column, b: Column) -> Column:
    """Edit distance of at most two and at most 30 % of the longer word."""
    d = F.levenshtein(a, b)
    return (d <= 2) & (d <= F.greatest(F.length(a), F.length(b)) * 0.3)
