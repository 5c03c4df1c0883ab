"""Redaction of credentials, and counts per credential family."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    CASE_SPECIALS,
    FIRST_LETTERS,
    REDACTION_PATTERNS,
    REDACTION_PLACEHOLDER,
    REDACTION_TRIGGERS,
    SECRET_FAMILIES,
    SECRET_FAMILY_TRIGGERS,
)


def _glance(body: str) -> str:
    """A look at the first letter of a match, where it is known."""
    return "".join(f"(?=[{letters}])" for begin, letters in FIRST_LETTERS.items() if body.startswith(begin))


def _replacement(pattern: str, group: int) -> tuple[str, str]:
    """Rewrite a pattern so that everything around the secret group is kept.

    Text before and after the secret becomes capture groups of its own, and the
    replacement puts them back around the placeholder.
    """
    body = pattern.removeprefix("(?i)")
    flags = _glance(body) + "(?Uiu)" if pattern.startswith("(?i)") else "(?U)"
    parts = list(_top_level_groups(body))
    if len(parts) < group:
        return flags + body, REDACTION_PLACEHOLDER
    start, end = parts[group - 1]
    before, secret, after = body[:start], body[start + 1 : end - 1], body[end:]
    before = re.sub(r"(?<!\\)\((?!\?)", "(?:", before)
    after = re.sub(r"(?<!\\)\((?!\?)", "(?:", after)
    return (
        f"{flags}({before})(?:{secret})({after})",
        "$1" + REDACTION_PLACEHOLDER + "$2",
    )


def _top_level_groups(pattern: str) -> Iterable[tuple[int, int]]:
    """Spans of the capturing groups of a pattern, in opening order."""
    spans, stack, in_class, index = {}, [], False, 0
    while index < len(pattern):
        char = pattern[index]
        if char == "\\":
            index += 2
            continue
        if in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
            if pattern[index + 1 : index + 2] == "]":
                index += 1
        elif char == "(":
            stack.append((index, pattern[index + 1 : index + 2] != "?"))
        elif char == ")" and stack:
            opened, capturing = stack.pop()
            if capturing:
                spans[opened] = index + 1
        index += 1
    return sorted(spans.items())


def load_custom_patterns(lines: Iterable[str]) -> list[tuple[str, int]]:
    """Custom patterns, one per line; blank lines and comments are skipped."""
    kept = []
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        try:
            re.compile(line)
        except re.error:
            continue
        kept.append((line, 1))
    return kept


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression on a value that is worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _holds_any(lowered: Column, literals: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in literals])


def _replaced(text: Column, chosen: Column, pattern: str, group: int) -> Column:
    """The text with a pattern's secrets replaced if the pattern was chosen for the row."""
    rewritten, replacement = _replacement(pattern, group)
    return _let(text, lambda t: F.when(chosen, F.regexp_replace(t, rewritten, replacement)).otherwise(t))


def redact(text: Column, custom: Iterable[tuple[str, int]] = ()) -> Column:
    """Replace each secret by a placeholder and keep the text around it.

    A pattern runs only on rows whose original text holds one of its literals;
    replacing a secret never creates a literal. Most rows hold none and are done
    after plain substring tests on one lower-case copy.
    """
    every_literal = sorted({t for literals in REDACTION_TRIGGERS for t in literals}) + CASE_SPECIALS

    def of(row: Column) -> Column:
        plain, lowered = row["text"], row["lowered"]
        redacted = plain
        for (pattern, group), literals in zip(REDACTION_PATTERNS, REDACTION_TRIGGERS):
            specials = CASE_SPECIALS if pattern.startswith("(?i)") else []
            redacted = _replaced(redacted, _holds_any(lowered, literals + specials), pattern, group)
        return F.when(_holds_any(lowered, every_literal), redacted).otherwise(plain)

    result = _let(F.struct(text.alias("text"), F.lower(text).alias("lowered")), of)
    for pattern, group in custom:
        result = F.regexp_replace(result, *_replacement(pattern, group))
    return result


def family_counts(text: Column, lowered: Column) -> dict[str, Column]:
    """Occurrences of each credential family, by family name; a pattern runs where the text's lower case holds a literal of it."""
    return {
        name: F.when(
            _holds_any(lowered, SECRET_FAMILY_TRIGGERS[name] + CASE_SPECIALS), F.regexp_count(text, F.lit(_glance(pattern) + "(?Uiu)" + pattern))
        ).otherwise(0)
        for name, pattern in SECRET_FAMILIES.items()
    }
