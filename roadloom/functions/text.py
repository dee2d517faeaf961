"""Predicates on free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that speak to the reader instead of telling it something: orders to drop its task, a part given to it, false headings of a
#: dialogue, orders to act at once for everyone. A default; callers give their own.
PHRASES = [
    r"\b(do\s+not|don't|stop)\s+follow(ing)?\b[\s\S]{0,30}\b(rules|instructions|guidelines)\b",
    r"\b(ignore|override|bypass)\b[\s\S]{0,30}\b(rules|instructions|safety|checks)\b",
    r"\b(act|behave|respond)\s+(as|like)\s+(an?\s+|the\s+)?(admin|administrator|system|developer)\b",
    r"^\s*(system|assistant|developer)\s*:",
    r"\breveal\b[\s\S]{0,30}\b(prompt|secret|password|token)s?\b",
    r"\b(confirm|cancel|book|resolve)\s+(everything|all\s+of\s+(it|them))\b",
]


def suspicious(text: Column, phrases: list[str] = PHRASES) -> Column:
    """Whether a text holds one of the phrases, in whatever case."""
    return text.rlike(f"(?im)({'|'.join(phrases)})")


def json_strings(payload: Column) -> Column:
    """The string values anywhere in a JSON text, unescaped, without the names of fields; null where the text is no JSON."""
    whole = F.to_json(F.try_parse_json(payload))
    quoted = F.regexp_extract_all(whole, F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?+'), F.lit(0))
    values = F.filter(quoted, lambda x: ~x.endswith(":"))
    return F.transform(values, lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)))


def suspicious_in_json(payload: Column, phrases: list[str] = PHRASES, length: int = 200) -> Column:
    """The string values of a JSON text that hold one of the phrases, each clipped to `length` characters; a text that is no JSON
    counts as one value. Null for null, and an empty array where there is none."""
    values = F.coalesce(json_strings(payload), F.array(payload))
    return F.when(payload.isNotNull(), F.transform(F.filter(values, lambda x: suspicious(x, phrases)), lambda x: clipped(x, length)))


def clipped(text: Column, length: int = 200) -> Column:
    return F.substr(text, F.lit(1), F.lit(length))
