"""Line search in note files: every query word on or near a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import LINE_CONTEXT, LINE_FINGERPRINT_CHARS, LINE_WINDOW
from palimpsest.functions.text import right_strip
from palimpsest.operators.once import computed_once


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    lines = F.split(text, r"\r\n|\r|\n")
    ended = F.element_at(lines, -1) == ""
    return F.when(ended, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def find_lines(files: DataFrame, query: str, context: int = LINE_CONTEXT) -> DataFrame:
    """All matching lines of files given as (path, agent, content).

    A line matches when it holds a query word and the lines around it hold all of
    them. A file is one row and is searched in place, without a shuffle: lines
    are numbered as array positions, and only hits are turned into rows.
    """
    words = query.lower().split()
    columns = ["path", "agent", "line_num", "line", "context_before", "context_after", "score"]
    if not words:
        return files.select(
            "path", "agent", F.lit(0).alias("line_num"), F.col("content").alias("line"),
            F.array().cast("array<string>").alias("context_before"),
            F.array().cast("array<string>").alias("context_after"),
            F.lit(0.0).alias("score"),
        ).where(F.lit(False))
    reach = LINE_WINDOW // 2

    def holds(text: Column, word: str) -> Column:
        return F.contains(text, F.lit(word))

    def every(text: Column) -> Column:
        return reduce(lambda a, b: a & b, [holds(text, w) for w in words])

    def some(text: Column) -> Column:
        return reduce(lambda a, b: a | b, [holds(text, w) for w in words])

    def around(lines: Column, at: Column, before: int, after: int) -> Column:
        start = F.greatest(at - before, F.lit(1))
        return F.slice(lines, start, at + after - start + 1)

    low, raw = F.col("_low"), F.col("_lines")
    lowered = computed_once(files.select("path", "agent", "content"), {"_text": F.lower("content")})
    split = computed_once(
        lowered,
        {"_low": split_lines(F.col("_text")), "_lines": split_lines(F.col("content"))},
        keep=every(F.col("_text")),
    ).drop("_text", "content")
    at = F.filter(
        F.sequence(F.lit(1), F.size("_low")),
        lambda i: some(F.get(low, i - 1)) & every(F.array_join(around(low, i, reach, reach), " ")),
    )
    candidates = computed_once(split, {"_at": at})
    hit = F.transform(
        F.col("_at"),
        lambda i: F.struct(
            i.alias("line_num"),
            right_strip(F.get(raw, i - 1)).alias("line"),
            F.transform(
                F.slice(raw, F.greatest(i - context, F.lit(1)), i - F.greatest(i - context, F.lit(1))),
                right_strip,
            ).alias("context_before"),
            F.transform(F.slice(raw, i + 1, F.lit(context)), right_strip).alias("context_after"),
            (
                reduce(lambda a, b: a + b, [holds(F.get(low, i - 1), w).cast("int") for w in words])
                / len(words)
            ).alias("score"),
        ),
    )
    return candidates.select("path", "agent", F.inline(hit)).select(*columns)


def search_files(
    files: DataFrame,
    query: str,
    agent: str | None = None,
    limit: int = 20,
    context: int = LINE_CONTEXT,
) -> DataFrame:
    """Best matching lines, equal line beginnings shown once."""
    if agent:
        files = files.where(F.col("agent") == agent)
    order = [F.desc("score"), F.col("path"), F.col("line_num")]
    same = Window.partitionBy(F.substring("line", 1, LINE_FINGERPRINT_CHARS)).orderBy(*order)
    return (
        find_lines(files, query, context)
        .withColumn("_copy", F.row_number().over(same))
        .where(F.col("_copy") == 1)
        .drop("_copy")
        .orderBy(*order)
        .limit(limit)
    )


def document_hits(hits: DataFrame, line_chars: int = 500) -> DataFrame:
    """The narrow form of line hits that the search interfaces return."""
    return hits.select(
        "path", "agent", "line_num",
        F.substring("line", 1, line_chars).alias("line"),
        F.round("score", 3).alias("score"),
    )
