"""Inputs the given tables lack, written from them row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import model


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, place, question): a question about each document's first words (place 0) and about each of its sentences."""
    doc = F.col("doc_id")
    start = _pick(
        doc, "what is ", "the plan for ", '"', "how ", "act_", "did we settle on ", "", "docs/", "tell me: ", "please discuss ",
    )
    end = _pick(F.floor(doc / 10), "?", "", '"', ".md", " again", " 1.2.3", " 0123456789", " now")
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    head = F.array_join(F.slice(words, 1, (doc % 4 + 1).cast("int")), " ")
    sentences = F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    asked = model.table(spark, folder, "documents").select("doc_id", F.posexplode(F.concat(F.array(head), sentences)).alias("place", "body"))
    return asked.select("doc_id", "place", F.concat(start, "body", end).alias("question"))


def tool_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages by role, so that role-dependent cuts apply."""
    return model.corpus(spark, folder).withColumn(
        "role", _pick(F.col("id"), "user", "assistant", "tool_result")
    )


def author_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as posts: an author joined with their first event."""
    author = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return model.table(spark, folder, "events").select(
        author.alias("author"),
        (F.col("event_type") == "error").alias("is_bot"),
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("posted_at"),
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("joined_at"),
    )


# --- session files -----------------------------------------------------------


def _uuid(key: Column) -> Column:
    digest = F.md5(key.cast("string"))
    cut = [F.substring(digest, 1, 8), *[F.substring(digest, s, 4) for s in (9, 13, 17)], F.substring(digest, 21, 12)]
    return F.concat_ws("-", *cut)


def session_paths(spark: SparkSession, folder: str) -> DataFrame:
    """A session file for each conversation, under all kinds of folders and names."""
    key = F.col("conv_id")
    number, uuid = key.cast("string"), _uuid(key)

    def joined(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    forms = [
        joined("/srv/agents/main/sessions/", uuid, ".jsonl"),
        joined("/srv/agents/orla/sessions/boot-", number, ".jsonl"),
        joined("/srv/agents-archive-cc/agent-main-cron-", uuid, "-20260220.jsonl"),
        joined("/srv/agents-archive-claude/agent-orla-discord-ch-", number, "-x.jsonl"),
        joined("/srv/agents-archive-vps/", uuid, ".jsonl.bak-1"),
        joined("/srv/agents-archive/rook/agent-main-telegram-", number, "-y.jsonl"),
        joined("/srv/agents-grok-sessions/", number, ".jsonl"),
        joined("/srv/agents-chat-sessions/", number, ".jsonl"),
        joined("/home/me/.claude/projects/-p/", uuid, ".jsonl"),
        joined("/home/you/.claude/projects/-p/subagents/", uuid, ".jsonl"),
        joined("/data/", uuid, ".jsonl"),
        joined("/data/orla-", number, ".jsonl"),
        joined("/data/main/abcdef", number, "-z.jsonl"),
        joined("/data/agent-abcdef-slack-", number, "-q.jsonl.deleted.2026"),
    ]
    path = F.element_at(F.array(*forms), (key % len(forms) + 1).cast("int"))
    return model.table(spark, folder, "conversations").select(path.alias("path")).distinct()


def session_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations written as session lines, in every accepted and refused shape."""
    conv, turn = F.col("conv_id"), F.col("turn")
    body = F.concat(F.lit("  "), "text", F.lit("\n"))
    reminder = F.concat(F.lit("<system-reminder>be\nbrief</system-reminder>"), "text")
    at = F.date_format(
        F.lit(model.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=conv.cast("int"), mins=turn.cast("int")),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    millis = (F.lit(1704067200) + conv * 3600 + turn * 60) * 1000
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text").alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("skipped").alias("text")),
        F.struct(F.lit("text").alias("type"), F.lit("end").alias("text")),
    )
    shape = (conv + turn) % 9
    line = (
        F.when(shape == 0, F.to_json(F.struct(F.lit("message").alias("type"), at.alias("timestamp"), F.struct("role", body.alias("content")).alias("message"))))
        .when(shape == 1, F.to_json(F.struct(F.lit("user").alias("type"), millis.alias("timestamp"), F.struct(reminder.alias("content")).alias("message"))))
        .when(shape == 2, F.to_json(F.struct(F.lit("assistant").alias("type"), at.alias("timestamp"), F.struct("role", parts.alias("content")).alias("message"))))
        .when(shape == 3, F.to_json(F.struct("role", F.concat(F.lit("[2024-05-06 07:08 GMT] "), "text").alias("content"))))
        .when(shape == 4, F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("tool_result").alias("role"), F.col("text").alias("content")).alias("message"))))
        .when(shape == 5, F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.lit("HEARTBEAT_OK").alias("content")).alias("message"))))
        .when(shape == 6, F.concat(F.lit('{"type": "message", "broken": '), F.to_json(F.struct("text"))))
        .when(shape == 7, F.to_json(F.struct(F.lit("summary").alias("type"), F.col("text").alias("content"))))
        .otherwise(F.to_json(F.struct("role", F.concat("text", F.lit(" password=hunter2secret")).alias("content"))))
    )
    return model.table(spark, folder, "conversations").select(
        F.concat(F.lit("/srv/agents/main/sessions/s"), conv.cast("string"), F.lit(".jsonl")).alias("path"),
        (turn * 100_000).alias("offset"),
        line.alias("value"),
    )


def _sized_files(spark: SparkSession, folder: str) -> DataFrame:
    return (
        model.table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.sum(F.char_length("text")).alias("size"), F.count(F.lit(1)).alias("turns"))
    )


def _file_of(conv: Column) -> Column:
    return F.concat(
        F.lit("/srv/agents/main/sessions/"),
        F.when(conv % 11 == 10, F.lit("boot-")).otherwise(F.lit("")),
        _uuid(conv), F.lit(".jsonl"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """The session folder now: conversations as files."""
    conv = F.col("conv_id")
    return _sized_files(spark, folder).select(
        _file_of(conv).alias("path"), "size",
        (F.lit(model.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=conv.cast("int"))).alias("modified_at"),
    )


def index_log(spark: SparkSession, folder: str) -> DataFrame:
    """What was indexed before: some files were smaller, some larger, some are new."""
    conv, size = F.col("conv_id"), F.col("size")
    old = (
        F.when(conv % 5 == 1, size - 100).when(conv % 5 == 2, size + 100).otherwise(size)
    )
    minutes = F.make_dt_interval(mins=conv.cast("int"))
    return _sized_files(spark, folder).where(F.col("turns") > 3).select(
        F.when(conv % 7 == 3, F.concat(F.lit("/gone/"), conv.cast("string"), F.lit(".jsonl")))
        .otherwise(_file_of(conv)).alias("source_file"),
        old.alias("file_size"),
        (F.lit(model.EPOCH).cast("timestamp_ntz") + minutes).alias("file_mtime"),
        (F.lit(model.EPOCH).cast("timestamp_ntz") + minutes + F.expr("interval 30 seconds")).alias("indexed_at"),
        F.col("turns").alias("message_count"),
        F.when(conv % 10 == 6, F.lit(0)).otherwise(old - 10).alias("last_byte_offset"),
    )


def indexed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions stored before; some came from another path."""
    conv = F.col("conv_id")
    return _sized_files(spark, folder).where(F.col("turns") > 3).select(
        _uuid(conv).alias("id"),
        F.when(conv % 8 == 2, F.concat(F.lit("/archive/"), _uuid(conv), F.lit(".jsonl"))).otherwise(_file_of(conv)).alias("source_file"),
    )


# --- texts with marks --------------------------------------------------------


def tagged_texts(spark: SparkSession, folder: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    tag = _pick(doc, "system-reminder", "local-command-stdout", "command-name", "other")
    return model.table(spark, folder, "documents").select(
        doc.alias("id"),
        F.concat(F.lit("<"), tag, F.lit(" a=1>x\ny</"), tag, F.lit("> "), text, F.lit(" <command-args>z</command-args>")).alias("content"),
    )


def linked_texts(spark: SparkSession, folder: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    number = doc.cast("string")
    both = F.concat(F.lit("[Discord guild channel id:7"), number, F.lit("] hi [message_id: "), number, F.lit("] "), text)
    content = (
        F.when(doc % 4 == 0, both)
        .when(doc % 4 == 1, F.concat(F.lit("[message_id: "), number, F.lit("] "), text))
        .when(doc % 4 == 2, F.concat(text, both))
        .otherwise(text)
    )
    return model.table(spark, folder, "documents").select(doc.alias("id"), content.alias("content"))


def dated_texts(spark: SparkSession, folder: str) -> DataFrame:
    doc, text = F.col("doc_id"), F.col("text")
    day = F.lpad((doc % 40).cast("string"), 2, "0")
    return model.table(spark, folder, "documents").select(
        doc.alias("id"),
        F.when(doc % 3 == 0, text)
        .otherwise(F.concat(text, F.lit(" [2026-02-"), day, F.lit("  10:25 GMT+11] "), text))
        .alias("content"),
    )


def cleanup_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as audit rows."""
    return model.table(spark, folder, "events").select(
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("ran_at"),
        F.col("event_type").alias("mode"),
        F.col("user_id").alias("deleted"),
        F.col("event_id").alias("freed_bytes"),
    )
