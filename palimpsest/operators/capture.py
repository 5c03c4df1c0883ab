"""Capturing notes: mail, documents, chat and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import (
    BODY_CHARS,
    CHAT_SKIPPED_SUBTYPES,
    DOCUMENT_FOLDER_TYPE,
    DOCUMENT_SHEET_TYPE,
    DOCUMENT_SLIDES_TYPE,
    DOCUMENT_TEXT_TYPES,
    REPEAT_WINDOW_HOURS,
)
from palimpsest.functions.noise import is_document_noise, is_mail_noise
from palimpsest.functions.secrets import redact
from palimpsest.functions.text import head, html_to_text, strip
from palimpsest.operators.filters import as_time, days_before
from palimpsest.session import staged

LOG_KEY = ["source_type", "source_id", "account"]


# --- notes -------------------------------------------------------------------


def prepared_notes(raw: DataFrame) -> DataFrame:
    """Incoming notes ready to store: stripped, not empty, secrets removed."""
    return (
        raw.withColumn("content", strip(F.col("content")))
        .where(F.col("content") != "")
        .withColumn("content", redact(F.col("content")))
    )


def _keyed(notes: DataFrame) -> DataFrame:
    """(id, digest, second) of each note. The digest is half of a SHA-256 in 16 bytes, as every turn shuffles it; null texts have an empty one."""
    second = F.timestamp_diff(
        "SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at")
    )
    digest = F.unhex(F.substring(F.sha2("content", 256), 1, 32))
    return notes.select("id", F.coalesce(digest, F.lit("").cast("binary")).alias("digest"), second.alias("second"))


def _first_of_seconds(notes: DataFrame, width: int) -> DataFrame:
    """(digest, second, id, slot): the first note of each text and second. Slots are `width` seconds wide."""
    return (
        _keyed(notes)
        .groupBy("digest", "second")
        .agg(F.min("id").alias("id"))
        .withColumn("slot", F.floor(F.col("second") / width))
    )


def _next_kept(firsts: DataFrame, width: int) -> DataFrame:
    """(digest, second, next): the first second of the text that a note kept at `second` does not silence.

    It is in the slot after the note's own, which then is one bounded group, or else it is the first of a later slot.
    """
    slots = firsts.groupBy("digest", "slot").agg(F.min("second").alias("first"))
    later = Window.partitionBy("digest").orderBy("slot")  # a row for each slot of the history
    beyond = F.when(F.lead("slot").over(later) == F.col("slot") + 1, F.lead("first", 2).over(later)).otherwise(
        F.lead("first").over(later)
    )
    beyond = slots.select("digest", "slot", beyond.alias("_beyond"))
    none = F.lit(None).cast("bigint")
    there = firsts.select("digest", "slot", F.col("second").alias("at"), F.col("second").alias("found"), none.alias("second"))
    asked = firsts.select(
        "digest", (F.col("slot") + 1).alias("slot"), (F.col("second") + width).alias("at"), none.alias("found"), "second"
    )
    after = Window.partitionBy("digest", "slot").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    inside = there.unionByName(asked).withColumn("_inside", F.min("found").over(after)).where(F.col("second").isNotNull())
    inside = inside.select("digest", (F.col("slot") - 1).alias("slot"), "second", "_inside")
    return inside.join(beyond, ["digest", "slot"]).select(
        "digest", "second", F.coalesce("_inside", "_beyond").alias("next")
    )


def _kept_seconds(firsts: DataFrame, width: int) -> DataFrame:
    """(digest, second) of the notes that stay, by pointer doubling.

    Each second points to the next one it would let through. A text's first note stays, and so does all that pointers
    reach from there. Each turn doubles what is reached and how far pointers reach, so the turns are the logarithm of the longest chain.
    """
    jumps = staged(_next_kept(firsts, width).where(F.col("next").isNotNull()), "repeats-jumps")
    kept = staged(firsts.groupBy("digest").agg(F.min("second").alias("second")), "repeats-kept")
    while not jumps.isEmpty():
        reached = kept.join(jumps, ["digest", "second"]).select("digest", F.col("next").alias("second"))
        kept = staged(kept.unionByName(reached), "repeats-kept")
        onward = jumps.select("digest", F.col("second").alias("next"), F.col("next").alias("_far"))
        jumps = staged(
            jumps.join(onward, ["digest", "next"]).select("digest", "second", F.col("_far").alias("next")), "repeats-jumps"
        )
    return kept


def capture_answers(notes: DataFrame, hours: int = REPEAT_WINDOW_HOURS) -> DataFrame:
    """(id, stored_id, duplicate) of each note: the stored note that stands for it, itself unless it is a repeat.

    Only a stored note silences later ones of its text, for some hours, the last second included. Times have second
    precision, as stored; of equal times the smallest id is stored. Notes without a time repeat each other alone. All
    null texts are one text. No text is gathered in one group: its seconds meet by slots as wide as the window, and a
    slot holds one stored note at most.
    """
    width = hours * 3600
    firsts = staged(_first_of_seconds(notes, width), "repeats-seconds")
    timed = firsts.where(F.col("second").isNotNull())
    stored = _kept_seconds(timed, width).join(timed, ["digest", "second"])
    note = F.struct(F.col("second").alias("at"), F.col("id").alias("stored_id"))
    near = stored.select("digest", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), note.alias("note"))
    near = near.groupBy("digest", "slot").agg(F.min("note").alias("_one"), F.max("note").alias("_two"))
    last = F.when(F.col("_two.at") <= F.col("second"), F.col("_two.stored_id")).otherwise(F.col("_one.stored_id"))
    answers = timed.join(near, ["digest", "slot"]).select("digest", "second", last.alias("stored_id"))
    timeless = firsts.where(F.col("second").isNull()).select("digest", "second", F.col("id").alias("stored_id"))
    answers = staged(answers.unionByName(timeless), "repeats-answers")
    keyed = _keyed(notes).toDF("id", "_digest", "_second")
    same = (F.col("_digest") == F.col("digest")) & F.col("_second").eqNullSafe(F.col("second"))
    return keyed.join(answers, same).select(
        "id", "stored_id", (F.col("id") != F.col("stored_id")).alias("duplicate")
    )


def drop_repeats(notes: DataFrame, hours: int = REPEAT_WINDOW_HOURS) -> DataFrame:
    """Notes without those repeating a stored note of the last 24 hours; see capture_answers()."""
    width = hours * 3600
    firsts = staged(_first_of_seconds(notes, width), "repeats-seconds")
    kept = _kept_seconds(firsts.where(F.col("second").isNotNull()), width)
    ids = firsts.join(kept, ["digest", "second"]).select("id")
    ids = ids.unionByName(firsts.where(F.col("second").isNull()).select("id"))
    return notes.join(ids, "id", "left_semi")


def delete_notes(notes: DataFrame, vectors: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Notes and their vectors without the given ids."""
    doomed = ids.select("id").distinct()
    return {
        "notes": notes.join(doomed, "id", "left_anti"),
        "embeddings": vectors.join(doomed.withColumnRenamed("id", "note_id"), "note_id", "left_anti"),
        "deleted": notes.select("id").join(doomed, "id", "left_semi"),
        "absent": doomed.join(notes.select("id"), "id", "left_anti"),
    }


# --- capture log -------------------------------------------------------------


def upsert_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log after new entries: the latest entry of each key wins."""
    rest = [c for c in log.columns if c not in LOG_KEY]
    latest = F.max_by(F.struct(*rest), F.struct("captured_at", "thought_id"))
    return (
        log.unionByName(new)
        .groupBy(*LOG_KEY)
        .agg(latest.alias("_row"))
        .select(*LOG_KEY, "_row.*")
    )


def capture_status(log: DataFrame) -> DataFrame:
    """Entries and latest capture per source and account."""
    label = F.when(
        F.coalesce("account", F.lit("")) != "", F.concat_ws(":", "source_type", "account")
    ).otherwise(F.col("source_type"))
    return (
        log.groupBy("source_type", "account")
        .agg(F.count(F.lit(1)).alias("captured"), F.max("captured_at").alias("latest"))
        .select(label.alias("source"), "captured", "latest")
    )


def not_captured(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items whose (source_type, source_id, account) is not in the log."""
    return items.join(log.select(*LOG_KEY), LOG_KEY, "left_anti")


def merge_boxes(inbox: DataFrame, sent: DataFrame) -> DataFrame:
    """Inbox and sent mail as one feed; the inbox copy of a mail stays."""
    both = inbox.withColumn("_box", F.lit(0)).unionByName(sent.withColumn("_box", F.lit(1)))
    rest = [c for c in inbox.columns if c not in ("id", "account")]
    return (
        both.groupBy("account", "id")
        .agg(F.min_by(F.struct(*rest), "_box").alias("_mail"))
        .select("id", "account", "_mail.*")
    )


# --- feeds -------------------------------------------------------------------
# Each feed is a landed table of items. The result has one row per item with the
# outcome, and for items to capture the note's content and metadata.


def _decided(items: DataFrame, outcome: Column, content: Column, metadata: Column) -> DataFrame:
    captured = F.col("outcome").isin("captured", "updated")
    return items.withColumn("outcome", outcome).select(
        *LOG_KEY, "outcome", "source_modified",
        F.when(captured, content).alias("content"),
        F.when(captured, metadata).alias("metadata"),
    )


def _with_log(items: DataFrame, log: DataFrame) -> DataFrame:
    known = log.select(*LOG_KEY, F.lit(True).alias("_known"), F.col("source_modified").alias("_stored"))
    return items.join(known, LOG_KEY, "left")


def capture_mail(
    mail: DataFrame, log: DataFrame, full_body: bool = True, filter_noise: bool = True, after=None
) -> DataFrame:
    """Mail to notes. `after` limits a backfill to mail since that time."""
    if after is not None:
        mail = mail.where(F.col("received_at") >= as_time(after))
    items = mail.withColumns(
        {
            "source_type": F.lit("gmail"),
            "source_id": F.col("id").cast("string"),
            "source_modified": F.lit(None).cast("string"),
            "sender": F.coalesce("sender", F.lit("Unknown")),
            "subject": F.coalesce("subject", F.lit("No subject")),
        }
    )
    body = F.col("snippet")
    if full_body:
        has_body = F.coalesce("body", F.lit("")) != ""
        body = F.when(has_body, head(html_to_text(F.col("body")), BODY_CHARS)).otherwise(body)
    noisy = is_mail_noise(F.col("sender"), F.col("subject")) if filter_noise else F.lit(False)
    outcome = F.when(F.col("_known"), "skipped").when(noisy, "filtered").otherwise("captured")
    content = F.concat(
        F.lit("Email from "), F.col("sender"), F.lit(": "), F.col("subject"), F.lit("\n"),
        F.coalesce(body, F.lit("")),
    )
    metadata = F.to_json(
        F.struct(
            F.col("sender").alias("from"), "subject", F.col("date"),
            F.col("source_id").alias("message_id"), "thread_id", "account",
        )
    )
    return _decided(_with_log(items, log), outcome, content, metadata)


def capture_documents(
    documents: DataFrame, log: DataFrame, filter_noise: bool = True, created_after=None
) -> DataFrame:
    """Documents to notes; a document changed since its capture comes again."""
    documents = documents.where(F.coalesce("mime", F.lit("")) != DOCUMENT_FOLDER_TYPE)
    if created_after is not None:
        documents = documents.where(F.col("created_at") > as_time(created_after))
    items = documents.withColumns(
        {
            "source_type": F.lit("drive"),
            "source_id": F.col("id").cast("string"),
            "source_modified": F.coalesce("modified", F.lit("")),
            "mime": F.coalesce("mime", F.lit("")),
            "name": F.coalesce("name", F.lit("Untitled")),
        }
    )
    noisy = is_document_noise(F.col("mime"), F.col("name")) if filter_noise else F.lit(False)
    unchanged = F.col("_known") & (F.col("_stored") == F.col("source_modified"))
    outcome = (
        F.when(noisy, "filtered")
        .when(unchanged, "skipped")
        .when(F.col("_known"), "updated")
        .otherwise("captured")
    )
    body = (
        F.when(F.col("mime") == DOCUMENT_SHEET_TYPE, F.concat(F.lit("(Google Spreadsheet — "), "name", F.lit(")")))
        .when(F.col("mime") == DOCUMENT_SLIDES_TYPE, F.concat(F.lit("(Google Slides — "), "name", F.lit(")")))
        .when(F.col("mime").isin(DOCUMENT_TEXT_TYPES), head(F.coalesce("text", F.lit("")), BODY_CHARS))
        .otherwise(
            F.concat(
                F.lit("("), "mime", F.lit(", size: "),
                F.coalesce(F.col("size").cast("string"), F.lit("unknown")), F.lit(")"),
            )
        )
    )
    content = F.when(body != "", F.concat(F.lit("Drive: "), "name", F.lit("\n"), body)).otherwise(
        F.concat(F.lit("Drive: "), "name")
    )
    metadata = F.to_json(
        F.struct(
            F.col("source_id").alias("file_id"), "name", F.col("mime").alias("mimeType"),
            F.col("source_modified").alias("modifiedTime"), "account",
        )
    )
    return _decided(_with_log(items, log), outcome, content, metadata)


def capture_chat(posts: DataFrame, log: DataFrame) -> DataFrame:
    """Chat posts to notes; joins, leaves, bots and empty posts are left out."""
    kept = posts.where(
        ~F.coalesce(F.col("subtype").isin(CHAT_SKIPPED_SUBTYPES), F.lit(False))
        & (F.coalesce("text", F.lit("")) != "")
    )
    items = kept.withColumns(
        {
            "source_type": F.lit("slack"),
            "source_id": F.concat_ws(":", "channel_id", "ts"),
            "account": F.lit("default"),
            "source_modified": F.lit(None).cast("string"),
        }
    )
    outcome = F.when(F.col("_known"), "skipped").otherwise("captured")
    content = F.concat(
        F.lit("Slack ["), "channel_name", F.lit("] "), "user_name", F.lit(": "),
        head(F.col("text"), BODY_CHARS),
    )
    posted = F.date_format(
        F.timestamp_micros((F.col("ts").cast("decimal(20,6)") * 1000000).cast("long")),
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    )
    metadata = F.to_json(
        F.struct(
            "channel_id", "channel_name", "user_id", F.col("user_name").alias("username"), "ts",
            posted.alias("date"),
        )
    )
    return _decided(_with_log(items, log), outcome, content, metadata)


def outcome_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("source_type", "outcome").agg(F.count(F.lit(1)).alias("items"))


# --- removing noisy notes stored earlier -------------------------------------


def _field(metadata: Column, name: str) -> Column:
    return F.coalesce(
        F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "string"), F.lit("")
    )


def stored_mail_noise(notes: DataFrame) -> DataFrame:
    """Stored mail notes that today's filter would reject.

    Sender and subject come from the metadata, else from the first line of the note.
    """
    mail = notes.where(F.col("source") == "gmail")
    first_line = F.element_at(F.split("content", "\n"), 1)
    parsed = r"(?s)\AEmail from (.*?): (.*)\z"
    told, title = _field(F.col("metadata"), "from"), _field(F.col("metadata"), "subject")
    fallback = (told == "") & first_line.rlike(parsed)
    sender = F.when(fallback, F.regexp_extract(first_line, parsed, 1)).otherwise(told)
    subject = F.when(fallback, F.regexp_extract(first_line, parsed, 2)).otherwise(title)
    return mail.select(
        "id", sender.alias("sender"), subject.alias("subject"),
        is_mail_noise(sender, subject).alias("noise"),
    )


def stored_document_noise(notes: DataFrame) -> DataFrame:
    """Stored document notes that today's filter would reject."""
    documents = notes.where(F.col("source") == "drive")
    metadata = F.col("metadata")
    mime = F.coalesce(
        F.try_variant_get(F.try_parse_json(metadata), "$.mimeType", "string"),
        _field(metadata, "mime_type"),
    )
    told = _field(metadata, "name")
    first_line = F.element_at(F.split("content", "\n"), 1)
    name = F.when(
        (told == "") & F.startswith(F.col("content"), F.lit("Drive: ")),
        strip(F.regexp_replace(first_line, r"\ADrive: ", "")),
    ).otherwise(told)
    return documents.select(
        "id", name.alias("name"), mime.alias("mime"), is_document_noise(mime, name).alias("noise")
    )


def noise_totals(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("noise")).alias("noise"),
        F.count_if(~F.col("noise")).alias("kept"),
    )


def purge_notes(notes: DataFrame, vectors: DataFrame, log: DataFrame, judged: DataFrame, source_type: str) -> dict[str, DataFrame]:
    """Remove noisy notes with their vectors and log entries."""
    doomed = judged.where("noise").select("id")
    tables = delete_notes(notes, vectors, doomed)
    of_source = F.col("source_type") == source_type
    noisy_log = log.where(of_source).join(
        doomed.withColumnRenamed("id", "thought_id"), "thought_id", "left_semi"
    )
    tables["log"] = log.join(noisy_log.select(*LOG_KEY), LOG_KEY, "left_anti")
    return tables


def embedding_backlog(notes: DataFrame, vectors: DataFrame, min_chars: int) -> DataFrame:
    """Notes long enough to embed that have no vector."""
    return notes.where(F.char_length("content") >= min_chars).join(
        vectors.select(F.col("note_id").alias("id")), "id", "left_anti"
    )
