"""Normalising search requests: times, names, limits and the search route."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    ROUTE_IDENTIFIER_PATTERNS,
    ROUTE_QUESTION_PATTERNS,
    ROUTE_QUESTION_WORDS,
)
from palimpsest.functions.text import strip

_SINCE = re.compile(
    r"(?P<number>\d+(?:\.\d+)?)\s*(?P<unit>minutes?|mins?|m|hours?|hrs?|h|days?|d)"
)


def parse_since(value: str) -> float:
    """'60m', '2h' or '3d' as fractional days."""
    match = _SINCE.fullmatch(value.strip().lower())
    if match is None:
        raise ValueError(f"not a time span: {value!r} (write 60m, 2h or 3d)")
    number, unit = float(match["number"]), match["unit"][0]
    per_day = {"m": 1440, "h": 24, "d": 1}[unit]
    return number / per_day


def parse_date(value: str, now: datetime) -> datetime:
    """'today', 'yesterday', 'YYYY-MM-DD' or 'YYYY-MM-DD HH:MM'."""
    text = value.strip()
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    named = {"today": midnight, "yesterday": midnight - timedelta(days=1)}
    if text.lower() in named:
        return named[text.lower()]
    for form in ("%Y-%m-%d %H:%M", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    raise ValueError(f"not a date: {value!r} (write YYYY-MM-DD, today or yesterday)")


def end_of_range(value: str, now: datetime) -> datetime:
    """Upper bound of a date range: a bare day lasts until its final second."""
    parsed = parse_date(value, now)
    if re.search(r"\d:\d", value):
        return parsed
    return parsed.replace(hour=23, minute=59, second=59)


def clamp(value, default: int, low: int | None = None, high: int | None = None) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    if low is not None:
        number = max(low, number)
    return number if high is None else min(high, number)


def resolve_agent(agent: str | None, aliases: Mapping[str, str]) -> str | None:
    return aliases.get(agent.lower(), agent) if agent else agent


def wants_semantic(query: str) -> bool:
    """Whether a question reads like natural language rather than an identifier."""
    lowered = query.lower().strip()
    words = lowered.split()
    quoted = query.startswith('"') and query.endswith('"')
    path_like = "/" in query or query.endswith((".md", ".py"))
    identifier = any(re.search(p, query) for p in ROUTE_IDENTIFIER_PATTERNS)
    terse = len(words) <= 2 and not set(words) & set(ROUTE_QUESTION_WORDS)
    if quoted or path_like or identifier or terse:
        return False
    return any(re.search(p, lowered) for p in ROUTE_QUESTION_PATTERNS)


def wants_semantic_column(query: Column) -> Column:
    """The same decision for a column of queries."""
    def matches_any(text: Column, patterns: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.rlike("(?dU)" + p) for p in patterns])

    lowered = strip(F.lower(query))
    words = F.array_remove(F.split(lowered, r"(?U)[\s\x1c-\x1f]+"), "")
    question_words = F.array(*[F.lit(w) for w in ROUTE_QUESTION_WORDS])
    literal = (
        (F.startswith(query, F.lit('"')) & F.endswith(query, F.lit('"')))
        | F.contains(query, F.lit("/"))
        | F.endswith(query, F.lit(".md"))
        | F.endswith(query, F.lit(".py"))
        | matches_any(query, ROUTE_IDENTIFIER_PATTERNS)
        | ((F.size(words) <= 2) & ~F.arrays_overlap(words, question_words))
    )
    return ~literal & matches_any(lowered, ROUTE_QUESTION_PATTERNS)
