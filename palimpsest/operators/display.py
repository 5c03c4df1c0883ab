"""Result pages as text, made of columns.

Every function gives a one-row DataFrame with the column `text`. Pages are limited before they get here; their rows
are formatted where they are, numbered, and put together in one string by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest import fixed_values as shown

def _whole_page():
    return Window.partitionBy(F.lit(0))


def _text(blocks: DataFrame, nothing: str = "") -> DataFrame:
    """Blocks (part, at, text) in order, a line break between two; or what is shown for an empty page."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "text"))), lambda b: b["text"])
    return blocks.agg(F.when(F.count(F.lit(1)) == 0, F.lit(nothing)).otherwise(F.array_join(ordered, "\n")).alias("text"))


def _block(rows: DataFrame, part: Column | int, at: Column, text: Column) -> DataFrame:
    return rows.select(
        (F.lit(part) if isinstance(part, int) else part).cast("long").alias("part"), at.cast("long").alias("at"), text.alias("text")
    )


def _numbered(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumns(
        {"_n": F.row_number().over(_whole_page().orderBy(*order)), "_rows": F.count(F.lit(1)).over(_whole_page())}
    )


def _snippet(text: Column, chars: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def _minute(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm"), F.lit("unknown"))


def search_page(arms: Mapping[str, DataFrame], context_chars: int = 150) -> DataFrame:
    """Unified search: a section for each arm that found something, then the summary."""
    chars = max(50, context_chars)
    number = F.col("_n")
    name = lambda c: F.coalesce(F.col(c), F.lit("None"))
    entries = {
        "conversations": lambda: (
            F.format_string(shown.SHOWN_CONVERSATION, number, name("agent"), name("channel"), _minute(F.col("timestamp")), name("role"), _snippet(F.col("content"), chars))
        ),
        "thoughts": lambda: (
            F.format_string(shown.SHOWN_THOUGHT, number, name("agent"), name("source"), _minute(F.col("created_at")), _snippet(F.col("content"), chars))
        ),
        "files": lambda: (
            F.format_string(shown.SHOWN_FILE, number, name("agent"), name("path"), F.col("line_num"), F.substring("line", 1, chars))
        ),
    }
    blocks = _block(arms["summary"], 9, F.lit(0), F.concat(F.lit("\n"), F.col("summary")))
    for part, (arm, entry) in enumerate(entries.items()):
        if arm not in arms:
            continue
        page = _numbered(arms[arm], *[c for c in ("score", "message_id", "id", "path", "line_num") if c in arms[arm].columns])
        title = "\n".join(["\n" + shown.SHOWN_RULE, shown.SHOWN_SECTIONS[part], shown.SHOWN_RULE])
        blocks = blocks.unionByName(_block(page.where(number == 1), part, F.lit(0), F.lit(title)))
        blocks = blocks.unionByName(_block(page, part, number, entry()))
    return _text(blocks)


def transcript_page(transcript: DataFrame, minutes: int) -> DataFrame:
    """A recent transcript grouped by session, sessions in order of appearance."""
    page = _numbered(transcript, "timestamp", "message_index", "id")
    per_session = Window.partitionBy("session_id")
    page = page.withColumns({"_first": F.min("_n").over(per_session), "_shown": F.count(F.lit(1)).over(per_session)})
    opening = page.where(F.col("_n") == F.col("_first"))
    sessions = F.count(F.lit(1)).over(_whole_page())
    total = F.col("message_count")
    note = F.when(F.col("_shown") < total, F.format_string("%d of %d msgs", "_shown", total)).otherwise(F.format_string("%d msgs", total))
    heads = F.format_string(shown.SHOWN_SESSION, "agent_id", note, F.col("timestamp").cast("string"), F.substring("session_id", 1, 12))
    counted = opening.withColumn("_sessions", sessions).where(F.col("_first") == 1)
    title = F.format_string(shown.SHOWN_TRANSCRIPT, F.lit(minutes), "_rows", "_sessions")
    blocks = (
        _block(counted, 0, F.lit(0), title)
        .unionByName(_block(opening, F.col("_first"), F.lit(0), heads))
        .unionByName(_block(page, F.col("_first"), F.col("_n"), F.format_string(shown.SHOWN_MESSAGE, "role", "content")))
        .unionByName(_block(opening, F.col("_first"), F.lit(2**62), F.lit("")))
    )
    return _text(blocks, shown.SHOWN_NO_TRANSCRIPT % minutes)


def activity_page(activity: DataFrame) -> DataFrame:
    page = _numbered(activity, F.desc("started_at"), "session_id")
    row = F.format_string(
        shown.SHOWN_ACTIVITY_ROW, "agent_id", F.col("started_at").cast("string"), "message_count", F.coalesce("first_user_message", F.lit(""))
    )
    blocks = _block(page.where("_n = 1"), 0, F.lit(0), F.format_string(shown.SHOWN_ACTIVITY, "_rows"))
    return _text(blocks.unionByName(_block(page, 0, F.col("_n"), row)), shown.SHOWN_NO_ACTIVITY)


def capture_page(status: DataFrame) -> DataFrame:
    """Captured items and the latest of each source."""
    page = _numbered(status, "source")
    blocks = (
        _block(status.agg(F.coalesce(F.sum("captured"), F.lit(0)).alias("n")), 0, F.lit(0), F.format_string(shown.SHOWN_CAPTURED, "n"))
        .unionByName(_block(page, 1, F.col("_n"), F.format_string(shown.SHOWN_CAPTURED_ROW, "source", F.col("captured").cast("string"))))
        .unionByName(_block(page.where("_n = 1"), 2, F.lit(0), F.lit(shown.SHOWN_LATEST)))
        .unionByName(_block(page, 3, F.col("_n"), F.format_string(shown.SHOWN_CAPTURED_ROW, "source", F.col("latest").cast("string"))))
    )
    return _text(blocks)


def line_page(hits: DataFrame, verbose: bool = False) -> DataFrame:
    """Line-search results, with their surroundings when verbose."""
    page = _numbered(hits, *[c for c in ("score", "path", "line_num") if c in hits.columns])
    near = lambda c: F.transform(c, lambda x: F.format_string(shown.SHOWN_LINE_CONTEXT, F.substring(x, 1, 100)))
    head = F.format_string(shown.SHOWN_LINE_HIT, "_n", "agent", "path", "line_num")
    lines = [F.array(F.lit("\n" + shown.SHOWN_RULE), head, F.lit(shown.SHOWN_RULE))]
    lines += [near("context_before")] * verbose
    lines += [F.array(F.format_string(shown.SHOWN_LINE, F.substring("line", 1, 200)))]
    lines += [near("context_after")] * verbose
    return _text(_block(page, 0, F.col("_n"), F.array_join(F.concat(*lines), "\n")), shown.SHOWN_NO_LINES)


def stored_note(note_id: Column, embedded: Column) -> Column:
    """What a reader is told when a note has been stored."""
    with_, without = (F.lit(x) for x in shown.SHOWN_EMBEDDED)
    return F.format_string(shown.SHOWN_NOTE_STORED, note_id, F.when(embedded, with_).otherwise(without))
