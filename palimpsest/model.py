"""Table schemas, and the views that stand in for them on the given test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = (
    "id string, agent_id string, channel string, channel_id string, started_at timestamp_ntz, "
    "ended_at timestamp_ntz, message_count bigint, total_tokens bigint, source_file string, "
    "indexed_at timestamp_ntz, is_archived boolean"
)
MESSAGES = (
    "id bigint, session_id string, role string, content string, timestamp timestamp_ntz, "
    "message_index int, token_count int"
)
EMBEDDINGS = (
    "id bigint, message_id bigint, embedding array<float>, model string, created_at timestamp_ntz"
)
INDEX_LOG = (
    "source_file string, file_size bigint, file_mtime timestamp_ntz, indexed_at timestamp_ntz, "
    "message_count bigint, last_byte_offset bigint, status string"
)
NOTES = (
    "id bigint, content string, source string, agent string, metadata string, "
    "created_at timestamp_ntz"
)
NOTE_EMBEDDINGS = (
    "id bigint, note_id bigint, embedding array<float>, model string, created_at timestamp_ntz"
)
CAPTURE_LOG = (
    "source_type string, source_id string, account string, thought_id bigint, "
    "source_modified string, captured_at timestamp_ntz"
)
CLEANUP_RUNS = (
    "ran_at timestamp_ntz, mode string, duplicates_found bigint, junk_found bigint, "
    "noise_found bigint, orphaned_embeddings_found bigint, deleted bigint, freed_bytes bigint"
)

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, as Spark splits it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _after_epoch(**parts: Column) -> Column:
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(**parts)


def _agent(key: Column) -> Column:
    """Mostly ordinary agents, some hidden ones and some hex fragments."""
    return (
        F.when(key % 7 == 5, "boot")
        .when(key % 7 == 6, F.concat(F.lit("abc12"), key.cast("string")))
        .otherwise(F.concat(F.lit("Agent"), (key % 5).cast("string")))
    )


def _channel(key: Column) -> Column:
    return F.element_at(F.array(F.lit("direct"), F.lit("discord"), F.lit("telegram")), (key % 3 + 1).cast("int"))


# --- conversations as messages and sessions ----------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, folder, "conversations").select(
        (conv * 1000 + turn).alias("id"),
        conv.cast("string").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        _after_epoch(hours=conv.cast("int"), mins=turn.cast("int")).alias("timestamp"),
        turn.cast("int").alias("message_index"),
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    counted = messages(spark, folder).groupBy("session_id").agg(
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        F.count(F.lit(1)).alias("message_count"),
    )
    key = F.col("session_id").cast("bigint")
    return counted.select(
        F.col("session_id").alias("id"),
        _agent(key).alias("agent_id"),
        _channel(key).alias("channel"),
        "started_at", "ended_at", "message_count",
        F.concat(
            F.lit("/srv/agents/"), _agent(key), F.lit("/sessions/"),
            F.when(key % 4 == 0, F.lit("boot-")).otherwise(F.lit("")), "session_id", F.lit(".jsonl"),
        ).alias("source_file"),
    )


# --- documents as a corpus to clean ------------------------------------------


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages: three to a session, indexes that repeat."""
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        doc.alias("id"),
        F.concat_ws("/", "source", F.floor(doc / 60).cast("string")).alias("session_id"),
        F.col("lang").alias("role"),
        F.col("text").alias("content"),
        _after_epoch(mins=doc.cast("int")).alias("timestamp"),
        (F.floor(doc / 20) % 2).cast("int").alias("message_index"),
    )


def corpus_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the corpus, known only where one of their documents is labelled."""
    rows = corpus(spark, folder)
    labelled = table(spark, folder, "labels").select(F.col("doc_id").alias("id")).distinct()
    known = rows.join(labelled, "id", "left_semi").select("session_id").distinct()
    counted = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
    )
    return counted.join(known, "session_id", "left_semi").select(
        F.col("session_id").alias("id"),
        F.substring_index("session_id", "/", 1).alias("agent_id"),
        F.lit("direct").alias("channel"),
        "started_at", "ended_at", "message_count",
    )


def stained_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with status lines, blanks and emoji mixed into its texts."""
    text, kind = F.col("content"), F.col("id") % 17

    def around(before: str, after: str) -> Column:
        return F.concat(F.lit(before), text, F.lit(after))

    stained = (
        F.when(kind == 0, "HEARTBEAT_OK")
        .when(kind == 1, around("Gateway restarting ", ""))
        .when(kind == 2, F.lit(None).cast("string"))
        .when(kind == 3, "   ")
        .when(kind == 4, "\U0001f44d")
        .when(kind == 5, around("", " OpenClaw Health Check Report"))
        .when(kind == 6, around("If nothing needs attention ", " reply with ONLY: NO_REPLY"))
        .when(kind == 7, around("note: ", " gateway restarted and back online"))
        .when(kind == 8, around("SECURITY NOTICE: The following content is from an EXTERNAL ", ""))
        .when(kind == 9, F.concat(F.lit("Gateway restarting now, will reconnect: "), text))
        .when(kind == 10, "<3")
        .when(kind == 11, around("You are running a boot check ", ""))
        .otherwise(text)
    )
    return corpus(spark, folder).withColumn("content", stained)


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("message_id"), "embedding", "label"
    )


def note_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).withColumnRenamed("message_id", "note_id")


# --- documents as notes and files --------------------------------------------


def notes(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, folder, "documents").select(
        doc.alias("id"),
        F.col("text").alias("content"),
        F.col("source"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("agent"),
        F.concat(F.lit('{"origin": "'), "source", F.lit('"}')).alias("metadata"),
        _after_epoch(mins=(doc * 7).cast("int")).alias("created_at"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.concat(
            F.lit("/home/u/clawd-"), "lang", F.lit("/"), "source", F.lit("/"),
            F.col("doc_id").cast("string"), F.lit(".md"),
        ).alias("path"),
        F.col("lang").alias("agent"),
        F.col("text").alias("content"),
    )


def secret_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with credentials of several families written into them."""
    text, kind = F.col("text"), F.col("doc_id") % 11
    digest = F.md5(F.col("doc_id").cast("string"))
    upper = F.upper(F.substring(digest, 1, 16))
    planted = (
        F.when(kind == 0, F.concat(text, F.lit(" password="), digest, F.lit(" end")))
        .when(kind == 1, F.concat(F.lit("api_key: '"), digest, F.lit("' "), text))
        .when(kind == 2, F.concat(text, F.lit(" AKIA"), upper, F.lit(" "), text))
        .when(kind == 3, F.concat(text, F.lit(" Authorization: Bearer "), digest, F.lit(". "), text))
        .when(kind == 4, F.concat(F.lit("x sk-"), digest, F.lit(" "), text))
        .when(kind == 5, F.concat(text, F.lit(" xoxb-"), digest, F.lit(" ghp_"), digest))
        .when(kind == 6, F.concat(text, F.lit(" postgres://user:"), digest, F.lit("@db ")))
        .when(kind == 7, F.concat(text, F.lit(" COOKIE_SECRET="), digest, F.lit("\nPWD: "), digest))
        .otherwise(text)
    )
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), planted.alias("content")
    )


# --- events as the capture log and as repeated notes -------------------------


def capture_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("source_type"),
        F.col("event_id").cast("string").alias("source_id"),
        (F.col("user_id") % 2).cast("string").alias("account"),
        F.col("event_id").alias("thought_id"),
        F.get_json_object("props", "$.k").alias("source_modified"),
        F.col("ts").alias("captured_at"),
    )


def keyed_captures(spark: SparkSession, folder: str) -> DataFrame:
    """Captures whose key recurs: one source id per user."""
    return capture_log(spark, folder).drop("source_id").join(
        table(spark, folder, "events").select(
            F.col("event_id").alias("thought_id"), F.col("user_id").cast("string").alias("source_id")
        ),
        "thought_id",
    )


def repeated_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as short notes that come again and again."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("content"),
        F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("created_at"),
    )


# --- pages, parts and documents as feeds -------------------------------------


def mail(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as mail: the host writes, the page is the body."""
    page = F.col("page_id")
    host = F.regexp_extract("url", r"://([^/?#:]+)", 1)
    box = F.element_at(
        F.array(*[F.lit(x) for x in ("alice@", "News@", "sales@", "no-reply@", "bob.x.com@", "team@", "orders@")]),
        (page % 7 + 1).cast("int"),
    )
    opening = F.element_at(
        F.array(*[F.lit(x) for x in ("Your  Order ", "Re: ", "minutes ", "Weekly report ", "please verify your account ")]),
        (page % 5 + 1).cast("int"),
    )
    return table(spark, folder, "pages").select(
        page.alias("id"),
        (page % 2).cast("string").alias("account"),
        F.concat(box, host).alias("sender"),
        F.concat(opening, F.coalesce(F.nullif(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("")), F.lit("none"))).alias("subject"),
        _after_epoch(hours=page.cast("int")).cast("string").alias("date"),
        _after_epoch(hours=page.cast("int")).alias("received_at"),
        F.col("url").alias("snippet"),
        F.col("html").alias("body"),
        F.concat(F.lit("t"), F.floor(page / 3).cast("string")).alias("thread_id"),
    )


def mail_log(spark: SparkSession, folder: str) -> DataFrame:
    """Mail captured before: every page met on a mobile host."""
    return table(spark, folder, "pages").where(F.contains("url", F.lit("://m."))).select(
        F.lit("gmail").alias("source_type"),
        F.col("page_id").cast("string").alias("source_id"),
        (F.col("page_id") % 2).cast("string").alias("account"),
        F.col("page_id").alias("thought_id"),
        F.lit(None).cast("string").alias("source_modified"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("captured_at"),
    )


def drive_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as stored files of many types."""
    doc = F.col("doc_id")
    kinds = [
        ("text/plain", ".txt"), ("application/vnd.google-apps.document", ""), ("image/png", ".png"),
        ("application/vnd.google-apps.spreadsheet", ""), ("text/plain", ".min.js"),
        ("application/vnd.google-apps.presentation", ""), ("application/x-novel", ".bin"),
        ("text/markdown", ".PSD"), ("text/markdown", ".md"),
    ]
    pick = (doc % len(kinds) + 1).cast("int")
    return table(spark, folder, "documents").select(
        doc.alias("id"),
        F.col("lang").alias("account"),
        F.concat(F.col("source"), F.lit("-"), doc.cast("string"), F.element_at(F.array(*[F.lit(e) for _, e in kinds]), pick)).alias("name"),
        F.element_at(F.array(*[F.lit(m) for m, _ in kinds]), pick).alias("mime"),
        F.concat(F.lit("v"), (doc % 3).cast("string")).alias("modified"),
        F.col("n_chars").alias("size"),
        F.col("text"),
        _after_epoch(mins=doc.cast("int")).alias("created_at"),
    )


def drive_log(spark: SparkSession, folder: str) -> DataFrame:
    """Files captured before: the labelled documents, all at version v1."""
    return (
        table(spark, folder, "labels").select("doc_id").distinct()
        .join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
        .select(
            F.lit("drive").alias("source_type"),
            F.col("doc_id").cast("string").alias("source_id"),
            F.col("lang").alias("account"),
            F.col("doc_id").alias("thought_id"),
            F.lit("v1").alias("source_modified"),
            F.lit(EPOCH).cast("timestamp_ntz").alias("captured_at"),
        )
    )


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as chat posts."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, folder, "conversations").select(
        F.concat(F.lit("C"), (conv % 20).cast("string")).alias("channel_id"),
        F.concat(F.lit("room-"), (conv % 20).cast("string")).alias("channel_name"),
        F.col("role").alias("user_id"),
        F.initcap("role").alias("user_name"),
        F.concat((F.lit(1704067200) + conv * 3600 + turn * 60).cast("string"), F.lit(".000100")).alias("ts"),
        F.when(F.col("role") == "system", "bot_message").alias("subtype"),
        F.col("text"),
    )


def stored_feed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Mail and file notes as stored: some with metadata, some without."""
    told = F.col("id") % 2 == 0
    mail_notes = mail(spark, folder).select(
        F.col("id"),
        F.concat(F.lit("Email from "), "sender", F.lit(": "), "subject", F.lit("\n"), "snippet").alias("content"),
        F.lit("gmail").alias("source"),
        F.when(told, F.to_json(F.struct(F.col("sender").alias("from"), "subject"))).otherwise("{}").alias("metadata"),
    )
    file_notes = drive_documents(spark, folder).select(
        (F.col("id") + 1_000_000_000).alias("id"),
        F.concat(F.lit("Drive: "), "name", F.lit("\n"), "text").alias("content"),
        F.lit("drive").alias("source"),
        F.when(told, F.to_json(F.struct("name", F.col("mime").alias("mimeType")))).otherwise("not json").alias("metadata"),
    )
    return mail_notes.unionByName(file_notes)
