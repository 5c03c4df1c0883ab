r"""Rules for the quality of a text, as a table of thresholds that becomes one projection.

A rule bounds one count as a percentage of another: symbols by words, stop words by words, repeated lines by lines. The
table (RULES, or the caller's own) is compiled into columns over counts of the row, so a text is read once, where it
is stored, and nothing is shuffled. Bounds are compared in whole numbers, `100 * part <= most * whole`. All of it is
DataFrame functions.

Words are runs of characters other than ASCII white space. Words in three-word windows found twice or more in a text
are found by sorting (hash of the window, place) inside the row, and only where some hash is there twice.

Defined results: a null text is the empty text, with no words; it fails on length. A rule whose whole is zero holds. Rows
pass one by one, so repeated rows and ids, ties and null ids need no care, a very long text is bounded by its own row, and
an empty table gives an empty table. Other columns pass unchanged, but for ones named like an added column, which are
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import SPACE, as_row, whole_text

MIN_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?\"'()[]"
BULLETS = ("-", "*", "+", "•", "‣")
ELLIPSES = ("...", "…")
#: Frequent words of English, German, French and Spanish that hardly any running text lacks.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on", "or",
    "that", "the", "this", "to", "was", "with", "you",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "dans", "de", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "y",
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_stop_words", "n_upper_words", "n_repeat_words",
    "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines",
)


@dataclass(frozen=True)
class Rule:
    """`part` is at least `least` and at most `most` per cent of `whole`; both are names in COUNTS."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        part, whole, tests = F.col(self.part) * 100, F.col(self.whole), F.lit(True)
        if self.least is not None:
            tests = tests & (part >= whole * self.least)
        if self.most is not None:
            tests = tests & (part <= whole * self.most)
        return tests


RULES = (
    Rule("word_length", "word_chars", "n_words", least=300, most=1000),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("upper_words", "n_upper_words", "n_words", most=60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=30),
)


def _all_of(tests: list[Column]) -> Column:
    held = F.lit(True)
    for test in tests:
        held = held & test
    return held


def _any_of(tests: list[Column]) -> Column:
    return ~_all_of([~test for test in tests])


def _covered(places: str) -> Column:
    """How many words are in windows that begin at the sorted places."""
    steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def counted(docs: DataFrame) -> DataFrame:
    """`_row`, the whole row, and the COUNTS of its text, as longs."""
    words, sorted_ = F.col("_words"), F.col("_sorted")

    def window(word: Column, at: Column) -> Column:
        return F.xxhash64(word, *[F.get(words, at + k) for k in range(1, WINDOW)])

    def again(at_: Column, i: Column) -> Column:
        return (at_["hash"] == F.get(sorted_, i + 1)["hash"]) | ((i > 0) & (at_["hash"] == F.get(sorted_, i - 1)["hash"]))

    def line_count(test) -> Column:
        return F.size(F.filter("_lines", test))

    texts = docs.select(as_row(docs).alias("_row"), whole_text().alias("_text"))
    cut = texts.select(
        "_row",
        "_text",
        F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.transform(F.split("_text", "\n"), lambda s: F.struct(s.alias("line"), F.btrim(s, F.lit(SPACE)).alias("bare"))),
                 lambda s: s["bare"] != "").alias("_lines"),
    )
    hashed = cut.select("*", F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))), window).alias("_windows"))
    ordered = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("hash"), i.alias("at")))),
        ).alias("_sorted"),
    )
    placed = ordered.select("*", F.sort_array(F.transform(F.filter("_sorted", again), lambda s: s["at"])).alias("_places"))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.char_length("_text") - F.char_length(F.regexp_replace("_text", "[" + "".join(SYMBOLS) + "]", "")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(MARKS)).isin(*STOP_WORDS))),
        "n_upper_words": F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)))),
        "n_repeat_words": F.coalesce(_covered("_places"), F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct(F.transform("_lines", lambda s: s["line"]))),
        "n_bullet_lines": line_count(lambda s: _any_of([F.startswith(s["bare"], F.lit(b)) for b in BULLETS])),
        "n_ellipsis_lines": line_count(lambda s: _any_of([F.endswith(s["bare"], F.lit(e)) for e in ELLIPSES])),
    }
    # Generated, so that a filter on a count or a verdict stays above; below, it would repeat the costly columns.
    return placed.select("_row", F.inline(F.array(F.struct(*[counts[name].cast("long").alias(name) for name in COUNTS]))))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with their counts, `base_failed`, `failed_rules` (names, in the table's order) and `kept`."""
    known = set(COUNTS)
    if any(r.part not in known or r.whole not in known for r in rules):
        raise ValueError(f"a rule compares two of {', '.join(COUNTS)}")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    added = {"base_failed": base, "failed_rules": failed, "kept": ~base & _all_of([r.holds() for r in rules])}
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (*COUNTS, *added)]
    return counted(docs).select(*own, *COUNTS, *[column.alias(name) for name, column in added.items()])


def rules_sql(rules: Sequence[Rule] = RULES) -> str:
    """The rules as an SQL condition over the same counts."""
    bounds = [f"100 * {r.part} >= {r.least} * {r.whole}" for r in rules if r.least is not None]
    bounds += [f"100 * {r.part} <= {r.most} * {r.whole}" for r in rules if r.most is not None]
    return " AND ".join(bounds) or "TRUE"
