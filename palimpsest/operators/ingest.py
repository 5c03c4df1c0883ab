"""Session lines to messages, sessions and log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import MAX_RAW_LINE_CHARS, TEXT_TIME_PATTERN, TOOL_RESULT_ROLES
from palimpsest.functions.noise import is_noise
from palimpsest.functions.paths import (
    Naming,
    file_stem,
    is_excluded,
    session_uuid,
    with_session_metadata,
)
from palimpsest.functions.secrets import redact
from palimpsest.functions.text import strip, without_system_tags
from palimpsest.operators.once import computed_once

# Bytes of a file that one numbering group covers.
BLOCK_BYTES = 64 * 1024 * 1024


# --- one line ----------------------------------------------------------------


def _kind(value: Column) -> Column:
    """JSON kind of a variant: STRING, ARRAY<...>, OBJECT<...>, BIGINT and so on."""
    return F.schema_of_variant(value)


def _string(entry: Column, path: str) -> Column:
    """A member that is a JSON string, else NULL."""
    member = F.try_variant_get(entry, path, "variant")
    return F.when(_kind(member) == "STRING", F.try_variant_get(entry, path, "string"))


def content_text(content: Column) -> Column:
    """Text of a message body: a string, or the text parts of a list."""
    parts = F.filter(
        F.try_variant_get(content, "$", "array<variant>"),
        lambda p: F.try_variant_get(p, "$.type", "string") == "text",
    )
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    kind = _kind(content)
    return F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(
        F.startswith(kind, F.lit("ARRAY")) & (F.size(parts) > 0), F.array_join(texts, " ")
    )


def entry_time(entry: Column) -> Column:
    """Time of an entry: ISO text or milliseconds since 1970, in UTC."""
    stamp = F.try_variant_get(entry, "$.timestamp", "variant")
    written = F.try_variant_get(entry, "$.timestamp", "string")
    millis = F.try_variant_get(entry, "$.timestamp", "double")
    kind = _kind(stamp)
    numeric = kind.rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(
        kind == "STRING",
        F.when(written.rlike(r"\A\d{4}-?\d{2}-?\d{2}"), F.try_to_timestamp(written)),
    ).when(numeric, F.timestamp_micros((millis * 1000).cast("bigint"))).cast("timestamp_ntz")


def time_in_text(text: Column) -> Column:
    """A '[YYYY-MM-DD HH:MM' mark inside a text."""
    pattern = "(?U)" + TEXT_TIME_PATTERN
    marked = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.try_to_timestamp(F.when(marked != " ", marked), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def parse_raw(lines: DataFrame) -> DataFrame:
    """Every line holding a JSON object, as a variant; overlong lines are dropped."""
    value = F.col("value")
    return (
        computed_once(
            lines.withColumn("value", strip(value)),
            {"entry": F.try_parse_json("value")},
            keep=(value != "") & (F.char_length("value") <= MAX_RAW_LINE_CHARS),
        )
        .where(F.col("entry").isNotNull())
        .drop("value")
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """(path, offset, value) lines to the messages worth keeping.

    Order matters: tags are stripped before secrets are redacted, and noise is
    judged on the redacted text.
    """
    entry = F.col("entry")
    opened = computed_once(
        lines.withColumn("value", strip(F.col("value"))),
        {"entry": F.try_parse_json("value")},
        keep=F.col("value") != "",
    ).drop("value")
    members = computed_once(
        opened,
        {
            "_type": F.try_variant_get(entry, "$.type", "string"),
            "_message": F.try_variant_get(entry, "$.message", "variant"),
            "_role": F.try_variant_get(entry, "$.role", "string"),
            "_content": F.try_variant_get(entry, "$.content", "variant"),
            "_timestamp": entry_time(entry),
        },
        keep=entry.isNotNull(),
    ).drop("entry")
    message, kind = F.col("_message"), F.col("_type")
    shape = (
        F.when(kind == "message", "message")
        .when(kind.isin("user", "assistant") & message.isNotNull(), "tool")
        .when(kind.isNull() & F.col("_role").isNotNull() & F.col("_content").isNotNull(), "legacy")
    )
    shaped = computed_once(
        members,
        {
            "_shape": shape,
            "_inner_role": F.try_variant_get(message, "$.role", "string"),
            "_inner_content": F.try_variant_get(message, "$.content", "variant"),
        },
    ).drop("_message")
    legacy = F.col("_shape") == "legacy"
    voiced = computed_once(
        shaped,
        {
            "role": F.when(legacy, F.col("_role"))
            .when(F.col("_shape") == "tool", F.coalesce("_inner_role", "_type"))
            .otherwise(F.col("_inner_role")),
            "_body": F.when(legacy, F.col("_content")).otherwise(F.col("_inner_content")),
        },
        keep=F.col("_shape").isNotNull(),
    ).drop("_type", "_role", "_content", "_inner_role", "_inner_content")
    spoken = F.col("role").isNotNull() & ~F.col("role").isin(TOOL_RESULT_ROLES)
    texts = computed_once(voiced, {"content": strip(content_text(F.col("_body")))}, spoken).drop("_body")
    untagged = computed_once(
        texts,
        {
            "content": F.when(
                F.col("_shape") == "tool", without_system_tags(F.col("content"))
            ).otherwise(F.col("content"))
        },
        keep=F.col("content") != "",
    )
    clean = computed_once(untagged, {"content": redact(F.col("content"))}, F.col("content") != "")
    return clean.where(~is_noise(F.col("content"))).select(
        "path", "offset", "role", "content",
        F.coalesce("_timestamp", time_in_text(F.col("content"))).alias("timestamp"),
    )


# --- numbering ---------------------------------------------------------------


def number_messages(kept: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Message index of each kept line of its file, in file order.

    Numbering is a prefix sum in two levels: rank within a block of the file, plus
    the rows of the blocks before it. A file of any size is thus numbered block by
    block; only block counts meet in one task. `starts` gives the index at which a
    file continues: (path, start_index).
    """
    blocked = kept.withColumn("_block", F.floor(F.col("offset") / BLOCK_BYTES))
    earlier = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocked.groupBy("path", "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("path", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"))
    )
    if starts is not None:
        bases = bases.join(starts.select("path", "start_index"), "path", "left").select(
            "path", "_block", (F.col("_base") + F.coalesce("start_index", F.lit(0))).alias("_base")
        )
    inside = Window.partitionBy("path", "_block").orderBy("offset")
    return (
        blocked.withColumn("_rank", F.row_number().over(inside))
        .join(bases, ["path", "_block"])
        .withColumn("message_index", (F.col("_base") + F.col("_rank") - 1).cast("int"))
        .drop("_block", "_rank", "_base")
    )


def session_rows(numbered: DataFrame) -> DataFrame:
    """Size and first and last known time of each file's messages."""
    timed = F.when(F.col("timestamp").isNotNull(), F.col("offset"))
    return numbered.groupBy("path").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min_by("timestamp", timed).alias("started_at"),
        F.max_by("timestamp", timed).alias("ended_at"),
    )


def describe_sessions(
    rows: DataFrame, naming: Naming = Naming(), telegram: DataFrame | None = None
) -> DataFrame:
    """Session rows with id, agent and channel taken from their path.

    `telegram` lists (folder, session_id) of sessions held over telegram.
    """
    rows = rows.withColumn("id", file_stem(F.col("path")))
    tagged = None
    if telegram is not None:
        listed = telegram.select(
            "folder", F.col("session_id").alias("id"), F.lit(True).alias("_telegram")
        ).distinct()
        rows = rows.withColumn("folder", F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1)).join(
            listed, ["folder", "id"], "left"
        )
        tagged = "_telegram"
    return with_session_metadata(rows, naming, tagged).select(
        "id", "agent_id", "channel", "channel_id", "started_at", "ended_at", "message_count", F.col("path").alias("source_file"),
    )


# --- which files to read -----------------------------------------------------


def plan_files(listing: DataFrame, log: DataFrame, sessions: DataFrame, globs=None) -> DataFrame:
    """What to do with each listed file: load, append, reload or skip.

    `listing` is (path, size), `log` the index log and `sessions` (id, source_file).
    A file whose session UUID is already indexed from another path is skipped.
    """
    path = F.col("path")
    indexed = sessions.select(F.col("id").alias("_uuid"), F.col("source_file").alias("_other"))
    logged = log.select(
        F.col("source_file").alias("path"),
        F.col("file_size").alias("_old_size"),
        F.coalesce("message_count", F.lit(0)).alias("_old_count"),
        F.coalesce("last_byte_offset", F.lit(0)).alias("_old_offset"),
    )
    excluded = is_excluded(path) if globs is None else is_excluded(path, globs)
    elsewhere = F.col("_other").isNotNull() & (F.col("_other") != path)
    known = F.col("_old_size").isNotNull()
    unchanged = known & (F.col("_old_size") == F.col("size"))
    grown = known & (F.col("size") > F.col("_old_size")) & (F.col("_old_offset") > 0)
    action = (
        F.when(excluded | elsewhere | unchanged, "skip")
        .when(grown, "append")
        .when(known, "reload")
        .otherwise("load")
    )
    reason = (
        F.when(excluded, "excluded")
        .when(elsewhere, F.concat(F.lit("session already indexed from "), F.col("_other")))
        .when(unchanged, "already indexed")
    )
    appending = F.col("action") == "append"
    return (
        listing.withColumn("_uuid", F.coalesce(session_uuid(path), path))
        .join(indexed, "_uuid", "left")
        .join(logged, "path", "left")
        .withColumns({"action": action, "reason": reason})
        .withColumns(
            {
                "start_offset": F.when(appending, F.col("_old_offset")).otherwise(F.lit(0)),
                "start_index": F.when(appending, F.col("_old_count")).otherwise(F.lit(0)),
            }
        )
        .select("path", "size", "action", "reason", "start_offset", "start_index")
    )


def first_of_uuid(planned: DataFrame) -> DataFrame:
    """Of new files sharing a session UUID, the first path only."""
    loading = F.col("action") == "load"
    firsts = (
        planned.where(loading)
        .withColumn("_uuid", session_uuid(F.col("path")))
        .groupBy(F.coalesce("_uuid", "path").alias("_key"))
        .agg(F.min("path").alias("path"))
        .select("path")
    )
    return planned.where(~loading).unionByName(planned.where(loading).join(firsts, "path", "left_semi"))


def compare_listing(listing: DataFrame, log: DataFrame) -> DataFrame:
    """(path, state) of files that are new, changed, unchanged or gone."""
    before = log.select(
        F.col("source_file").alias("path"), F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime")
    )
    now = listing.select("path", "size", "modified_at")
    state = (
        F.when(F.col("size").isNull(), "deleted")
        .when(F.col("_size").isNull(), "new")
        .when((F.col("size") != F.col("_size")) | (F.col("modified_at") != F.col("_mtime")), "changed")
        .otherwise("same")
    )
    return now.join(before, "path", "full_outer").select("path", state.alias("state"))


def not_stored(new: DataFrame, messages: DataFrame) -> DataFrame:
    """New messages whose (session, index) is not stored yet."""
    return new.join(
        messages.select("session_id", "message_index"), ["session_id", "message_index"], "left_anti"
    )


def replaced_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions after new rows took the place of those with the same id."""
    return sessions.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
