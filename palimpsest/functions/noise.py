"""Noise tests for messages, mail and documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    DOCUMENT_CODE_ENDINGS,
    DOCUMENT_DESIGN_ENDINGS,
    DOCUMENT_TYPE_BLOCKLIST,
    MAIL_SENDER_BLOCKLIST,
    MAIL_SUBJECT_PATTERNS,
    NOISE_LIKE_FILTERS,
    NOISE_PATTERNS,
)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _pattern_test(text: Column, pattern: str, ignore_case: bool, dot_all: bool) -> Column:
    """A pattern as the cheapest equal test.

    Patterns without operators become equality, prefix or substring tests. The
    others run only on rows that hold the literal they begin with.
    """
    literal = re.match(r"(?:[^\\\[\](){}*+?|.$]|\\\.)*", pattern.removeprefix("^")).group()
    anchored, rest = pattern.startswith("^"), pattern.removeprefix("^")[len(literal) :]
    literal = literal.replace("\\.", ".")
    if rest == "$":
        return text.isin(literal, literal + "\n")
    if rest == "":
        test = F.startswith if anchored else F.contains
        return test(text, F.lit(literal))
    flags = "(?dU" + ("iu" if ignore_case else "") + ("s" if dot_all else "") + ")"
    if ignore_case:
        lowered = F.lower(text)
        begins = F.contains(lowered, F.lit(literal.lower())) | F.contains(lowered, F.lit("ſ"))
    else:
        begins = (F.startswith if anchored else F.contains)(text, F.lit(literal))
    return begins & text.rlike(flags + pattern)


def noise_reason(text: Column) -> Column:
    """Reason of the first noise pattern found, NULL for ordinary text."""
    expr = None
    for pattern, ignore_case, dot_all, reason in NOISE_PATTERNS:
        hit = _pattern_test(text, pattern, ignore_case, dot_all)
        expr = F.when(hit, reason) if expr is None else expr.when(hit, reason)
    return expr


def is_noise(text: Column) -> Column:
    return noise_reason(text).isNotNull()


def passes_noise_filter(text: Column, lowered: Column | None = None) -> Column:
    """The LIKE filters applied before the patterns when stored text is cleaned.

    Each filter is an equality, prefix or substring test on lower-case text, which a
    caller may hand over ready-made.
    """
    lowered = F.lower(text) if lowered is None else lowered
    tests = []
    for like in NOISE_LIKE_FILTERS:
        core = like.strip("%").lower()
        if "_" in core:
            # an underscore stands for any one character
            same_size = F.char_length(text) == len(like)
            tests.append(same_size & F.like(lowered, F.lit(like.lower())))
        elif like.startswith("%"):
            tests.append(F.contains(lowered, F.lit(core)))
        elif like.endswith("%"):
            tests.append(F.startswith(lowered, F.lit(core)))
        else:
            tests.append(lowered == core)
    return _any(tests)


def stored_noise_reason(text: Column) -> Column:
    """Noise reason of stored text: LIKE filters first, then the patterns."""
    return F.when(passes_noise_filter(text), noise_reason(text))


def is_mail_noise(sender: Column, subject: Column) -> Column:
    lowered = F.lower(sender)
    by_sender = _any([F.contains(lowered, F.lit(part)) for part in MAIL_SENDER_BLOCKLIST])
    by_subject = _any([subject.rlike("(?dUiu)" + p) for p in MAIL_SUBJECT_PATTERNS])
    return F.coalesce(by_sender, F.lit(False)) | F.coalesce(by_subject, F.lit(False))


def is_document_noise(mime: Column, name: Column) -> Column:
    endings = "|".join(
        re.escape(e) for e in DOCUMENT_CODE_ENDINGS + DOCUMENT_DESIGN_ENDINGS
    )
    by_type = F.coalesce(mime.isin(DOCUMENT_TYPE_BLOCKLIST), F.lit(False))
    by_name = F.coalesce(F.lower(name).rlike(f"(?:{endings})\\z"), F.lit(False))
    return by_type | by_name
