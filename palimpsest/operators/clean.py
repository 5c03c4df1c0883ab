"""Finding and removing duplicates, junk, noise and orphaned vectors.

Texts are compared by digest, so grouping never shuffles content. Groups of any
size are counted by partial aggregation, and marking the members of a group goes
through a join that splits large groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed_values import (
    DUPLICATE_PAGE,
    JUNK_PAGE,
    NOISE_PAGE,
    ORPHAN_VECTOR_BYTES,
    SIMILAR_MIN_CHARS,
    SIMILARITY_TIERS,
    SNAPSHOT_SECONDS,
)
from palimpsest.functions.noise import noise_reason, passes_noise_filter
from palimpsest.functions.text import head, is_blank, is_single_emoji
from palimpsest.operators.filters import as_time, first_rows, sessions_keyed, with_session
from palimpsest.operators.once import computed_once
from palimpsest.operators.skew import join_on_sized_key

MEGABYTE = 1024 * 1024


def megabytes(size: Column) -> Column:
    return F.round(F.coalesce(size, F.lit(0)) / MEGABYTE, 2)


# --- the same message indexed twice within a session -------------------------


def _slot() -> Column:
    """Identity of a message inside its session (index is never negative)."""
    return F.concat_ws(
        "\x1f", F.col("session_id"), F.col("role"), F.coalesce("message_index", F.lit(-1)).cast("string")
    )


def _repeated_slots(messages: DataFrame) -> DataFrame:
    return (
        messages.groupBy("session_id", "role", "message_index")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("id").alias("keep_id"),
            F.min_by(F.char_length("content"), "id").alias("chars"),
        )
        .where(F.col("copies") > 1)
    )


def repeated_per_session(messages: DataFrame) -> DataFrame:
    """Per session: repeated messages, surplus rows and their size."""
    return (
        _repeated_slots(messages)
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("repeated_messages"),
            F.sum(F.col("copies") - 1).alias("duplicate_rows"),
            F.sum(F.coalesce("chars", F.lit(0)) * (F.col("copies") - 1)).alias("bytes_saved"),
        )
    )


def repeated_messages(messages: DataFrame, sessions: DataFrame, limit: int | None = DUPLICATE_PAGE) -> DataFrame:
    """Sessions holding repeated messages, most surplus rows first; all of them for None.

    The page is cut before its previews are read.
    """
    page = first_rows(repeated_per_session(messages).orderBy(F.desc("duplicate_rows"), "session_id"), limit)
    sample = (
        messages.where(F.col("content").isNotNull())
        .select(
            "session_id", "message_index", "id",
            F.struct(head(F.col("content"), 100).alias("preview"), "role").alias("shown"),
        )
        .join(page.select("session_id"), "session_id", "left_semi")
        .groupBy("session_id")
        .agg(F.min_by("shown", F.struct("message_index", "id")).alias("shown"))
    )
    facts = sessions.select(
        F.col("id").alias("session_id"), "agent_id", "channel", "started_at",
        F.coalesce("message_count", F.lit(0)).alias("expected_messages"),
    )
    return (
        page.join(facts, "session_id", "left")
        .join(sample, "session_id", "left")
        .select(
            "session_id",
            F.coalesce("agent_id", F.lit("unknown")).alias("agent"),
            F.coalesce("channel", F.lit("unknown")).alias("channel"),
            "started_at",
            F.coalesce("expected_messages", F.lit(0)).alias("expected_messages"),
            (F.coalesce("expected_messages", F.lit(0)) + F.col("duplicate_rows")).alias("actual_messages"),
            "repeated_messages",
            "duplicate_rows",
            F.coalesce("shown.preview", F.lit("")).alias("sample_preview"),
            F.coalesce("shown.role", F.lit("")).alias("sample_role"),
            "bytes_saved",
        )
    )


def repeated_summary(messages: DataFrame) -> DataFrame:
    """Totals over every session, one row."""
    return repeated_per_session(messages).agg(
        F.coalesce(F.sum("repeated_messages"), F.lit(0)).alias("total_groups"),
        F.coalesce(F.sum("duplicate_rows"), F.lit(0)).alias("total_removable"),
        megabytes(F.sum("bytes_saved")).alias("estimated_savings_mb"),
        F.count(F.lit(1)).alias("affected_sessions"),
    )


def repeated_ids(messages: DataFrame) -> DataFrame:
    """(session_id, id) of every surplus copy; the lowest id of a message stays."""
    slots = _repeated_slots(messages).select(_slot().alias("slot"), "copies", "keep_id")
    rows = messages.select("id", "session_id", _slot().alias("slot"))
    return (
        join_on_sized_key(rows, slots, "slot", "copies", "id")
        .where(F.col("id") != F.col("keep_id"))
        .select("session_id", "id")
    )


# --- the same text in several sessions ---------------------------------------


def compared_text(tier: str, text: Column) -> Column:
    """The part of a text that two similar messages must share."""
    chars, _ = SIMILARITY_TIERS[tier]
    return text if chars is None else F.lower(head(F.trim(text), chars))


def message_keys(messages: DataFrame, tier: str = "exact") -> DataFrame:
    """Narrow stand-in for messages: id, session, length and text digest.

    Written once (`write`), it serves every similarity report without reading
    content again.
    """
    return messages.where(F.char_length("content") > SIMILAR_MIN_CHARS).select(
        "id", "session_id",
        F.char_length("content").cast("long").alias("chars"),
        F.unhex(F.sha2(compared_text(tier, F.col("content")), 256)).alias("digest"),
    )


def similar_groups(keys: DataFrame) -> DataFrame:
    """Digests found in two or more sessions.

    Counting goes by (digest, session) first: a text repeated in a third of all
    rows shrinks to one row per session before it meets in one task.
    """
    per_session = keys.groupBy("digest", "session_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("keep_id"),
        F.sum("chars").alias("chars"),
    )
    return (
        per_session.groupBy("digest")
        .agg(
            F.sum("copies").alias("copies"),
            F.count(F.lit(1)).alias("sessions"),
            F.min("keep_id").alias("keep_id"),
            F.sum("chars").alias("chars"),
        )
        .where(F.col("sessions") >= 2)
    )


def similar_messages(messages: DataFrame, tier: str = "exact", limit: int | None = DUPLICATE_PAGE) -> DataFrame:
    """Largest groups of similar messages, shown by their oldest member; all groups for None."""
    page = first_rows(similar_groups(message_keys(messages, tier)).orderBy(F.desc("copies"), "keep_id"), limit)
    fingerprint = (
        F.lit(None).cast("string")
        if tier == "exact"
        else head(compared_text(tier, F.col("content")), 200)
    )
    return (
        messages.withColumnRenamed("id", "keep_id")
        .join(page, "keep_id")
        .select(
            head(F.col("content"), 200).alias("content_preview"),
            "role", "copies", "sessions", "keep_id",
            fingerprint.alias("fingerprint"),
            (F.col("chars") - F.floor(F.col("chars") / F.col("copies"))).alias("bytes_saved"),
            F.lit(SIMILARITY_TIERS[tier][1]).alias("score"),
        )
    )


def similar_summary(messages: DataFrame, tier: str = "exact") -> DataFrame:
    """Number of groups, removable rows and their size, one row."""
    surplus = F.col("copies") - 1
    return similar_groups(message_keys(messages, tier)).agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.coalesce(F.sum(surplus), F.lit(0)).alias("total_removable"),
        megabytes(F.sum(F.col("chars") / F.col("copies") * surplus)).alias("estimated_savings_mb"),
    )


def similar_members(messages: DataFrame, tier: str = "exact") -> DataFrame:
    """(id, keep_id) for every member of every group of similar messages."""
    keys = message_keys(messages, tier)
    groups = similar_groups(keys).select("digest", "copies", "keep_id")
    return join_on_sized_key(keys, groups, "digest", "copies", "id").select("id", "keep_id")


def similar_ids(messages: DataFrame, tier: str = "exact") -> DataFrame:
    """Ids to remove so that each group keeps its oldest member."""
    return similar_members(messages, tier).where(F.col("id") != F.col("keep_id")).select("id")


def group_of(messages: DataFrame, sessions: DataFrame, keep_id: int) -> DataFrame:
    """All messages with the same content as one message, with session facts."""
    wanted = messages.where(F.col("id") == keep_id).select("content").scalar()
    return _with_facts(_shown(messages.where(F.col("content") == wanted)), sessions)


def all_group_members(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """The members of every group of exact copies, with session facts."""
    return _with_facts(_shown(messages).join(similar_members(messages), "id"), sessions)


def _shown(messages: DataFrame) -> DataFrame:
    """What is shown of a message, so that no join moves whole texts."""
    return messages.select(
        "id", "session_id", "role", "timestamp", head(F.col("content"), 500).alias("content_preview")
    )


def _with_facts(shown: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_session(shown, sessions, "agent_id", "channel", how="left").drop("message_count")


# --- junk and noise ----------------------------------------------------------


def junk(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, role, session_id, content, category), one row per reason.

    Content is reduced to a preview and two flags before the session look-up.
    """
    text = F.col("content")
    flagged = messages.select(
        "id", "role", "session_id",
        head(F.coalesce(text, F.lit("")), 200).alias("content"),
        is_blank(text).alias("_blank"),
        (F.char_length(text).between(1, 10) & is_single_emoji(text)).alias("_emoji"),
    )
    known = sessions_keyed(sessions).withColumn("_known", F.lit(True))
    located = join_on_sized_key(flagged, known, "session_id", None, "id", "left")
    categories = F.array_compact(
        F.array(
            F.when(F.col("_blank"), "empty"),
            F.when(F.col("_known").isNull(), "orphaned"),
            F.when(F.col("_emoji"), "single_char"),
        )
    )
    return located.select(
        "id", "role", "session_id", "content", F.explode(categories).alias("category")
    )


def junk_page(messages: DataFrame, sessions: DataFrame, limit: int | None = JUNK_PAGE) -> DataFrame:
    """First junk rows: blank ones, then orphans, then emoji, by id."""
    return first_rows(junk(messages, sessions).orderBy("category", "id"), limit)


def junk_counts(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return junk(messages, sessions).groupBy("category").agg(F.count(F.lit(1)).alias("messages"))


def junk_ids(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Junk ids; a row that is junk for two reasons comes twice."""
    return junk(messages, sessions).select("id", "category")


def noise(messages: DataFrame) -> DataFrame:
    """Stored messages that are status noise, with the reason."""
    text = F.col("content")
    lowered = computed_once(
        messages.select("id", "role", "session_id", "content"), {"_lowered": F.lower(text)}
    )
    passing = lowered.where(passes_noise_filter(text, F.col("_lowered"))).drop("_lowered")
    return (
        computed_once(passing, {"reason": noise_reason(text)})
        .where(F.col("reason").isNotNull())
        .select("id", "role", "session_id", head(text, 300).alias("content"), "reason")
    )


def noise_page(messages: DataFrame, limit: int | None = NOISE_PAGE) -> DataFrame:
    return first_rows(noise(messages).orderBy("id"), limit)


def noise_counts(messages: DataFrame) -> DataFrame:
    return noise(messages).groupBy("reason").agg(F.count(F.lit(1)).alias("messages"))


def noise_ids(messages: DataFrame) -> DataFrame:
    return noise(messages).select("id")


# --- vectors without a message -----------------------------------------------


def orphaned_vectors(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """(embedding_id, message_id) of vectors whose message is gone."""
    return vectors.select(F.col("id").alias("embedding_id"), "message_id").join(
        messages.select(F.col("id").alias("message_id")), "message_id", "left_anti"
    )


def orphaned_vectors_summary(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    return orphaned_vectors(vectors, messages).agg(
        F.count(F.lit(1)).alias("total"),
        (F.count(F.lit(1)) * ORPHAN_VECTOR_BYTES).alias("freed_bytes"),
        megabytes(F.count(F.lit(1)) * ORPHAN_VECTOR_BYTES).alias("estimated_savings_mb"),
    )


def without_orphaned_vectors(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    return vectors.join(
        messages.select(F.col("id").alias("message_id")), "message_id", "left_semi"
    )


# --- dry run -----------------------------------------------------------------


def dry_run(
    messages: DataFrame, sessions: DataFrame, vectors: DataFrame, categories=None
) -> DataFrame:
    """Totals of all detectors, one row; detectors left out count as zero.

    Texts are read once. A message becomes one narrow row for its slot in the session, with flags, and one for its text
    digest; both kinds are counted by one shuffle, first within a session and then by session or digest, so a text
    or a session with a third of all rows is one row per task by then.
    """
    chosen = set(
        categories or ["duplicates", "junk", "noise", "orphaned_embeddings", "similar"]
    )
    counted = _dry_run_counts(messages, chosen)
    known = sessions.select(F.col("id").alias("session_id"), F.lit(True).alias("_known")).distinct()
    slots, alike = F.col("kind") == _SLOT, (F.col("kind") == _TEXT) & (F.col("sessions") >= 2)
    surplus = F.col("copies") - 1
    zero = F.lit(0).cast("bigint")

    def total(condition: Column, amount: Column | str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(amount) if isinstance(amount, str) else amount)), zero)

    orphans = F.when(F.col("_known").isNull(), F.col("copies")).otherwise(zero)
    sums = counted.join(known, "session_id", "left").agg(
        total(slots, "copies").alias("total_messages"),
        total(slots, "surplus").alias("duplicates_found"),
        (total(slots, F.col("junk") + orphans) if "junk" in chosen else zero).alias("junk_found"),
        total(slots, "noise").alias("noise_found"),
        total(alike, surplus).alias("similar_found"),
        megabytes(F.sum(F.when(slots, F.col("surplus_chars")))).alias("_repeated_mb"),
        megabytes(F.sum(F.when(alike, F.col("chars") / F.col("copies") * surplus))).alias("_similar_mb"),
    )
    savings = ["_repeated_mb"] * ("duplicates" in chosen) + ["_similar_mb"] * ("similar" in chosen)
    saved = [F.col(c) for c in savings]
    orphaned = zero
    if "orphaned_embeddings" in chosen:
        totals = orphaned_vectors_summary(vectors, messages)
        orphaned = totals.select("total").scalar().cast("bigint")
        saved.append(totals.select("estimated_savings_mb").scalar().cast("double"))
    return sums.select(
        "total_messages",
        sessions.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_sessions"),
        (F.col("duplicates_found") if "duplicates" in chosen else zero).alias("duplicates_found"),
        "junk_found",
        "noise_found",
        orphaned.alias("orphaned_embeddings_found"),
        "similar_found",
        F.round(reduce(lambda x, y: x + y, saved, F.lit(0.0)), 2).alias("estimated_savings_mb"),
    )


_SLOT, _TEXT = 0, 1


def _dry_run_counts(messages: DataFrame, chosen: set[str]) -> DataFrame:
    """Rows of sessions (kind _SLOT) and of texts (kind _TEXT) with their counts."""
    text, none = F.col("content"), F.lit(False)
    is_junk = is_blank(text).cast("int") + (F.char_length(text).between(1, 10) & is_single_emoji(text)).cast("int")
    lowered = computed_once(
        messages.select("id", "session_id", "role", "message_index", "content"), {"_lowered": F.lower(text)} if "noise" in chosen else {"_lowered": F.lit("")}
    )
    passing = passes_noise_filter(text, F.col("_lowered")) if "noise" in chosen else none
    noisy = F.coalesce(F.when(passing, noise_reason(text).isNotNull()), none).cast("int")
    chars = F.char_length(text).cast("long")

    def row(kind: int, digest: Column, role: Column, index: Column, junk_: Column, noise_: Column) -> Column:
        fields = {"kind": F.lit(kind), "digest": digest, "role": role, "message_index": index, "chars": chars, "junk": junk_, "noise": noise_}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    slot = row(
        _SLOT, F.lit(None).cast("binary"), F.col("role"), F.col("message_index"),
        F.coalesce(is_junk, F.lit(0)) if "junk" in chosen else F.lit(0), noisy,
    )
    digest = F.unhex(F.sha2(compared_text("exact", text), 256))
    alike = row(_TEXT, digest, F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(0), F.lit(0))
    rows = F.array(slot, F.when(chars > SIMILAR_MIN_CHARS, alike)) if "similar" in chosen else F.array(slot)
    facts = lowered.select("id", "session_id", F.inline(F.array_compact(rows)))
    within = facts.groupBy("kind", "digest", "session_id", "role", "message_index").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by("chars", "id").alias("first_chars"),
        F.sum("chars").alias("chars"),
        F.sum("junk").alias("junk"),
        F.sum("noise").alias("noise"),
    )
    session = F.when(F.col("kind") == _SLOT, F.col("session_id"))
    surplus = F.col("copies") - 1
    return within.groupBy("kind", "digest", session.alias("session_id")).agg(
        F.sum("copies").alias("copies"),
        F.count(F.lit(1)).alias("sessions"),
        F.sum("chars").alias("chars"),
        F.sum("junk").alias("junk"),
        F.sum("noise").alias("noise"),
        F.sum(surplus).alias("surplus"),
        F.sum(F.coalesce("first_chars", F.lit(0)) * surplus).alias("surplus_chars"),
    )


# --- removal -----------------------------------------------------------------


def delete_messages(
    messages: DataFrame, sessions: DataFrame, vectors: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """The tables without the given messages, and what the removal did.

    `ids` may name a message more than once. Sessions that lost a message get
    their count recomputed.
    """
    doomed = ids.select("id").distinct()
    kept = messages.join(doomed, "id", "left_anti")
    sizes = messages.select("id", "session_id", F.char_length(F.coalesce("content", F.lit(""))).alias("chars"))
    removed = sizes.join(doomed, "id", "left_semi")
    per_session = removed.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("gone"),
        F.sum("chars").alias("freed"),
    )
    left = sizes.join(doomed, "id", "left_anti").groupBy("session_id").agg(F.count(F.lit(1)).alias("left"))
    recount = per_session.select("session_id").join(left, "session_id", "left").select(
        "session_id", F.coalesce("left", F.lit(0)).alias("recount")
    )
    updated = (
        sessions.join(recount, sessions["id"] == recount["session_id"], "left")
        .withColumn("message_count", F.coalesce("recount", "message_count"))
        .select(*sessions.columns)
    )
    effects = per_session.agg(
        F.coalesce(F.sum("gone"), F.lit(0)).alias("deleted"),
        F.coalesce(F.sum("freed"), F.lit(0)).alias("freed_bytes"),
        F.count(F.lit(1)).alias("sessions_updated"),
    )
    return {
        "messages": kept,
        "sessions": updated,
        "embeddings": vectors.join(doomed.withColumnRenamed("id", "message_id"), "message_id", "left_anti"),
        "effects": effects,
    }


def delete_sessions(
    messages: DataFrame, sessions: DataFrame, vectors: DataFrame, log: DataFrame, session_ids: DataFrame
) -> dict[str, DataFrame]:
    """The tables without some sessions: vectors, messages, log rows and sessions."""
    doomed = session_ids.select("session_id").distinct()
    sized = (
        sessions.withColumnRenamed("id", "session_id")
        .join(doomed, "session_id", "left_semi")
        .select("session_id", "message_count", "source_file")
    )
    gone = join_on_sized_key(
        messages.select("id", "session_id"), sized.select("session_id", "message_count"),
        "session_id", None, "id", "left_semi",
    ).select("id")
    files = sized.where(F.col("source_file").isNotNull()).select("source_file").distinct()
    return {
        "messages": messages.join(gone, "id", "left_anti"),
        "sessions": sessions.join(doomed, sessions["id"] == doomed["session_id"], "left_anti"),
        "embeddings": vectors.join(gone.withColumnRenamed("id", "message_id"), "message_id", "left_anti"),
        "index_log": log.join(files, "source_file", "left_anti"),
        "effects": sized.agg(
            F.count(F.lit(1)).alias("sessions"),
            F.coalesce(F.sum("message_count"), F.lit(0)).alias("listed_messages"),
        ).withColumns(
            {
                "deleted_messages": gone.agg(F.count(F.lit(1))).scalar(),
                "deleted_embeddings": vectors.select("message_id")
                .join(gone.withColumnRenamed("id", "message_id"), "message_id", "left_semi")
                .agg(F.count(F.lit(1)))
                .scalar(),
            }
        ),
    }


# --- audit log and snapshot --------------------------------------------------

AUDIT_COUNTS = [
    "duplicates_found", "junk_found", "noise_found", "orphaned_embeddings_found",
    "deleted", "freed_bytes",
]


def audit_rows(results: DataFrame, mode: str, now) -> DataFrame:
    """Audit-log rows for a dry run or a removal; absent counts are zero."""
    return results.select(
        as_time(now).alias("ran_at"),
        F.lit(mode).alias("mode"),
        *[
            (F.col(c) if c in results.columns else F.lit(0)).cast("bigint").alias(c)
            for c in AUDIT_COUNTS
        ],
    )


def history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("ran_at"), "mode").limit(limit)


def save_snapshot(result: DataFrame, folder: str, now) -> None:
    result.withColumn("taken_at", as_time(now)).write.mode("overwrite").parquet(folder)


def fresh_snapshot(snapshot: DataFrame, now, max_seconds: int = SNAPSHOT_SECONDS) -> DataFrame:
    """The stored result if it is young enough, with its age; else no row."""
    age = F.timestamp_diff("SECOND", F.col("taken_at"), as_time(now))
    return snapshot.withColumn("cache_age_seconds", age).where(age <= max_seconds).drop("taken_at")
