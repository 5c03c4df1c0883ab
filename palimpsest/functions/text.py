"""Column functions over message and document text."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    DEEP_LINK_CHANNEL_PATTERN,
    DEEP_LINK_HEAD_CHARS,
    DEEP_LINK_MESSAGE_PATTERN,
    DEEP_LINK_PREFIX,
    SYSTEM_TAG_PATTERN,
)

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def _single_mark_letters() -> tuple[str, str]:
    """Lower-case letters that are one ASCII letter plus one mark, and that letter."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        if char != char.lower():
            continue
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            marked.append(char)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED_LETTERS, PLAIN_LETTERS = _single_mark_letters()
_PY_FOLD = str.maketrans(MARKED_LETTERS, PLAIN_LETTERS)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def right_strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+\z", "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def folded(text: Column) -> Column:
    """Lower case without single diacritics."""
    lowered = F.lower(text)
    unmarked = F.regexp_replace(lowered, r"\p{Mn}+", "")
    return F.when(is_ascii(text), lowered).otherwise(
        F.translate(unmarked, MARKED_LETTERS, PLAIN_LETTERS)
    )


def tokens_of_folded(text: Column) -> Column:
    """Letter-and-digit runs of a folded text, in order; NULL gives none."""
    safe = F.coalesce(text, F.lit(""))
    runs = F.when(is_ascii(safe), F.split(safe, "[^a-z0-9]+")).otherwise(
        F.split(safe, r"[^\p{L}\p{N}]+")
    )
    return F.array_remove(runs, "")


def py_tokens(text: str) -> list[str]:
    """The same tokens for a query held on the driver."""
    lowered = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn")
    lowered = lowered.translate(_PY_FOLD)
    spaced = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in lowered)
    return spaced.split()


def head(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def shorten(text: Column, chars: int) -> Column:
    """Cut to `chars` characters and mark the cut."""
    return F.when(
        F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def shorten_by_role(role: Column, text: Column, limits: dict[str, int]) -> Column:
    """Cut the text of the given roles only; NULL shows as empty."""
    shown = F.coalesce(text, F.lit(""))
    expr = None
    for name, chars in limits.items():
        expr = (
            F.when(role == name, shorten(shown, chars))
            if expr is None
            else expr.when(role == name, shorten(shown, chars))
        )
    return shown if expr is None else expr.otherwise(shown)


def without_system_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)" + SYSTEM_TAG_PATTERN, ""))


#: What an entity may look like: decimal, hexadecimal, or a name of at most 32 characters, each with or without its end.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The shortest and longest names that need no semicolon.
BARE_NAMES = {name: value for name, value in html.entities.html5.items() if not name.endswith(";")}
BARE_SIZES = range(max(map(len, BARE_NAMES)), min(map(len, BARE_NAMES)) - 1, -1)
_HIGHEST_DIGITS = 7  # 0x10FFFF has six hexadecimal and seven decimal digits


def _numeric_entities() -> dict[int, str]:
    """Numbers that do not stand for their own character: what the standard maps elsewhere or drops."""
    numbers = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
    decoded = {n: html.unescape(f"&#{n};") for n in numbers}
    return {n: text for n, text in decoded.items() if text != chr(n)}


def _looked_up(table: dict, key: Column) -> Column:
    """The value of a key; the table is one literal, worked out once."""
    return F.element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key.cast("string"))


def _numeric(digits: Column, base: int) -> Column:
    """The character of a number in digits without leading zeros."""
    number = F.conv(F.substring(digits, 1, _HIGHEST_DIGITS), base, 10).cast("bigint")
    outside = (F.char_length(digits) > _HIGHEST_DIGITS) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(outside, "\ufffd").otherwise(F.coalesce(_looked_up(_numeric_entities(), number), own))


def _decoded(entity: Column) -> Column:
    """The text of one entity; what is none stays."""
    name = F.substring(entity, 2, 40)
    digits = F.regexp_replace(entity, r"\A&#[xX]?0*|;\z", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    bare = F.coalesce(
        *[
            F.concat(_looked_up({n: v for n, v in BARE_NAMES.items() if len(n) == size}, F.substring(name, 1, size)), F.substring(name, size + 1, 40))
            for size in BARE_SIZES
        ],
        entity,
    )
    named = F.coalesce(_looked_up({n: v for n, v in html.entities.html5.items() if n.endswith(";")}, name), bare)
    return (
        F.when(entity.rlike(r"\A&#[xX]"), _numeric(digits, 16))
        .when(F.startswith(entity, F.lit("&#")), _numeric(digits, 10))
        .otherwise(named)
    )


def decode_entities(text: Column) -> Column:
    """HTML entities as characters, each replaced once, where it stands."""
    between = F.split(text, ENTITY)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _decoded)
    both = F.zip_with(between, found, lambda before, entity: F.concat(before, F.coalesce(entity, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(both, "")).otherwise(text)


def html_to_text(markup: Column) -> Column:
    """Visible text of an HTML fragment."""
    text = F.regexp_replace(markup, r"(?is)<(style|script)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"(?i)<(br|p|div|tr|li|h[1-6])[^>]*/?>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def is_single_emoji(text: Column) -> Column:
    """One to ten characters, each non-ASCII or an ASCII symbol such as + or <."""
    trimmed = strip(text)
    return F.coalesce(
        (F.char_length(trimmed) <= 10)
        & trimmed.rlike(r"\A[\x{7F}-\x{10FFFF}+<=>|~^`]+\z"),
        F.lit(False),
    )


def is_blank(text: Column) -> Column:
    """NULL or nothing but spaces."""
    return text.isNull() | (F.trim(text) == "")


def deep_link(text: Column) -> Column:
    """Link to the original chat message, when both ids are in the text's head."""
    start = head(text, DEEP_LINK_HEAD_CHARS)
    message = F.regexp_extract(start, DEEP_LINK_MESSAGE_PATTERN, 1)
    channel = F.regexp_extract(start, DEEP_LINK_CHANNEL_PATTERN, 1)
    return F.when(
        (message != "") & (channel != ""),
        F.concat(F.lit(DEEP_LINK_PREFIX), channel, F.lit("/"), message),
    )


def summary_sentence(conversations: Column, files: Column, notes: Column) -> Column:
    base = F.concat(
        F.lit("Found "), conversations.cast("string"), F.lit(" conversation matches")
    )
    file_part = F.concat(files.cast("string"), F.lit(" file matches"))
    return F.when(
        notes > 0,
        F.concat(
            base, F.lit(", "), file_part, F.lit(", and "),
            notes.cast("string"), F.lit(" thought matches"),
        ),
    ).otherwise(F.concat(base, F.lit(" and "), file_part))
