"""Operators on small tables with known answers."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.functions import paths
from palimpsest.operators import browse, capture, clean, display, fts, ingest, lines, search, segments, vector
from palimpsest.operators.skew import join_on_sized_key
from palimpsest.sources.notes import read_notes
from palimpsest.streaming.notes import new_notes, recent_counts

NOW = datetime(2026, 3, 8, 12, 0)


def messages(spark, rows):
    """rows: (id, session, role, content, index, minutes before now)"""
    df = spark.createDataFrame(rows, "id bigint, session_id string, role string, content string, message_index int, ago int")
    return df.withColumn("timestamp", F.lit(str(NOW)).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("ago"))).drop("ago")


def sessions(spark, rows):
    """rows: (id, agent, count, minutes before now)"""
    df = spark.createDataFrame(rows, "id string, agent_id string, message_count bigint, ago int")
    at = F.lit(str(NOW)).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("ago"))
    return df.select("id", "agent_id", F.lit("direct").alias("channel"), at.alias("started_at"), at.alias("ended_at"), "message_count")


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_sized_join_equals_plain_join(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    sized = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("k") != 7)
    for how in ("inner", "left", "left_semi", "left_anti"):
        split = join_on_sized_key(rows, sized, "k", "n", "id", how, slice_rows=20)
        plain = rows.join(sized, "k", how)
        assert sorted(map(tuple, split.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    spread = join_on_sized_key(rows, sized, "k", "n", "id", slice_rows=20)
    assert "_slice" in spread._jdf.queryExecution().toString()


def test_recent_rules(spark):
    known = sessions(spark, [("b1", "butler", 4, 10), ("a1", "atlas", 3, 5), ("x1", "boot", 5, 3), ("old", "butler", 5, 90)])
    rows = messages(spark, [
        (1, "b1", "user", "q", 0, 10), (2, "b1", "assistant", "a", 1, 9), (3, "b1", "tool_result", "x" * 600, 2, 9),
        (4, "b1", "assistant", "b", 3, 8), (5, "a1", "user", "q", 0, 5), (6, "a1", "assistant", "a", 1, 5),
        (7, "a1", "assistant", None, 2, 4), (8, "x1", "system", "s", 0, 3), (9, "old", "user", "q", 0, 90),
    ])
    page = browse.recent(rows, known, NOW, 30)
    assert ids(page) == [1, 2, 3, 4, 5, 6, 7]
    assert len(page.where("id = 3").first()["content"]) == 503
    assert ids(browse.recent(rows, known, NOW, 999)) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert ids(browse.recent(rows, known, NOW, 30, agent="Butler")) == [1, 2, 3, 4]
    shown = display.transcript_page(browse.recent(rows, known, NOW, 30, surface="tool"), 30).first()["text"]
    assert "7 messages across 2 session(s)" in shown and "butler (4 msgs)" in shown
    assert display.transcript_page(browse.recent(rows, known, "2027-01-01", 5), 5).first()["text"].startswith("No messages")
    assert "(5 msgs)" in display.activity_page(browse.activity(rows, known, NOW, surface="tool")).first()["text"]
    flags = browse.context(spark.createDataFrame([("b1", 3)], "session_id string, message_id bigint"), rows, 1)
    assert [(r["id"], r["is_match"], r["has_more_before"], r["has_more_after"]) for r in flags.orderBy("id").collect()] == [
        (2, False, True, False), (3, True, True, False), (4, False, True, False)]


def test_cleaning(spark):
    known = sessions(spark, [("s1", "a", 5, 1), ("s2", "b", 1, 1)])
    long = "The same long sentence in two places"
    rows = messages(spark, [
        (100, "s1", "user", "dup", 0, 1), (200, "s1", "user", "dup", 0, 1), (300, "s1", "user", "dup", 0, 1),
        (1, "s1", "user", long, 1, 1), (2, "s2", "user", long, 1, 1), (3, "s1", "assistant", long, 2, 1),
        (4, "s2", "user", "  " + long.upper() + "  ", 3, 1), (5, "s2", "user", "x" * 20, 4, 1), (6, "s1", "user", "x" * 20, 4, 1),
        (7, "s1", "user", None, 5, 1), (8, "s1", "user", "  ", 6, 1), (9, "gone", "user", "hello", 0, 1),
        (10, "s1", "user", "❤", 7, 1), (11, "s1", "user", "HEARTBEAT_OK", 8, 1), (12, "gone", "user", "", 1, 1),
    ])
    assert ids(clean.repeated_ids(rows)) == [200, 300]
    report = clean.repeated_messages(rows, known).first()
    assert (report["session_id"], report["duplicate_rows"], report["actual_messages"]) == ("s1", 2, 7)
    assert ids(clean.similar_ids(rows, "exact")) == [2, 3]
    assert ids(clean.similar_ids(rows, "high")) == [2, 3, 4]
    assert ids(clean.group_of(rows, known, 1)) == [1, 2, 3]
    assert sorted(map(tuple, clean.junk_ids(rows, known).collect())) == [
        (7, "empty"), (8, "empty"), (9, "orphaned"), (10, "single_char"), (12, "empty"), (12, "orphaned")]
    assert ids(clean.noise_ids(rows)) == [11]
    vectors = spark.createDataFrame([(1, 1), (2, 99999), (3, 7)], "id bigint, message_id bigint")
    assert ids(clean.orphaned_vectors(vectors, rows), "message_id") == [99999]
    gone = clean.delete_messages(rows, known, vectors, clean.junk_ids(rows, known))
    assert tuple(gone["effects"].first()) == (5, 8, 2)
    assert ids(gone["embeddings"]) == [1, 2]
    assert {r["id"]: r["message_count"] for r in gone["sessions"].collect()} == {"s1": 7, "s2": 1}
    again = clean.delete_messages(gone["messages"], gone["sessions"], vectors, clean.junk_ids(gone["messages"], known))
    assert again["effects"].first()["deleted"] == 0
    total = clean.dry_run(rows, known, vectors, ["noise", "junk"]).first()
    assert (total["noise_found"], total["junk_found"], total["duplicates_found"]) == (1, 6, 0)


def test_audit_and_snapshot(spark, tmp_path):
    result = spark.createDataFrame([(2, 5)], "deleted bigint, freed_bytes bigint")
    first = clean.audit_rows(result, "delete", "2026-03-08 10:00:00")
    second = clean.audit_rows(result, "dry_run", "2026-03-08 11:00:00")
    runs = clean.history(first.unionByName(second), 1).collect()
    assert [(r["mode"], r["junk_found"], r["freed_bytes"]) for r in runs] == [("dry_run", 0, 5)]
    folder = str(tmp_path / "snap")
    clean.save_snapshot(result, folder, "2026-03-08 10:00:00")
    stored = spark.read.parquet(folder)
    assert clean.fresh_snapshot(stored, "2026-03-08 10:09:00").first()["cache_age_seconds"] == 540
    assert clean.fresh_snapshot(stored, "2026-03-08 10:11:00").count() == 0


def test_bm25_against_plain_python(spark, tmp_path):
    texts = ["red fox jumps", "the red-fox", "fox red fox red", "blue", "Red! fox? fox", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    split = [fts.py_tokens(t or "") for t in texts]
    n, avg = len(split), sum(map(len, split)) / len(split)

    def expected(phrases):
        counts = [[sum(s[i : i + len(p)] == p for i in range(len(s))) for s in split] for p in phrases]
        scores = {}
        for d, s in enumerate(split):
            if all(c[d] for c in counts):
                total = 0
                for c in counts:
                    df = sum(x > 0 for x in c)
                    idf = max(np.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                    total += idf * c[d] * 2.2 / (c[d] + 1.2 * (0.25 + 0.75 * len(s) / avg))
                scores[d] = -total
        return scores

    fts.write_index(rows, "id", "content", str(tmp_path))
    postings, stats = fts.read_index(spark, str(tmp_path))
    for query, phrases in {"red fox": [["red"], ["fox"]], "red-fox": [["red", "fox"]], "the fox": [["fox"]]}.items():
        scanned = {r["id"]: r["score"] for r in fts.search_rows(rows, ["content"], query).collect()}
        indexed = {r["row_id"]: r["score"] for r in fts.search_postings(postings, stats, query).collect()}
        assert scanned == pytest.approx(expected(phrases)) and indexed == pytest.approx(expected(phrases))
    for nothing in ("the of", "fox ???", ""):
        assert fts.search_rows(rows, ["content"], nothing).count() == 0


def test_indexed_search_page(spark, tmp_path):
    rows = messages(spark, [(1, "s1", "user", "red fox", 0, 1), (2, "s2", "user", "fox", 0, 1), (3, "zz", "user", "fox", 0, 1)])
    known = sessions(spark, [("s1", "ann", 1, 1), ("s2", "bob", 1, 1)])
    index = segments.open_index(spark, str(tmp_path)).add(rows, "id", "content")
    found = search.keyword_messages_indexed(index, rows, known, "fox", agent="BOB")
    assert [(r["id"], r["content"]) for r in found.collect()] == [(2, "fox")]


def test_unified_search_page(spark):
    rows = messages(spark, [(1, "s1", "user", "red fox", 0, 1), (2, "s1", "user", "red fox", 1, 1)])
    known = sessions(spark, [("s1", "ann", 2, 1)])
    notes = spark.createDataFrame([(1, "a red note", "gmail", None, "{}", datetime(2026, 1, 1))], model.NOTES)
    vectors = vector.embed(rows, "id", "content")
    files = spark.createDataFrame([("/a.md", "main", "x\nthe red\nfox\n")], "path string, agent string, content string")
    library = search.Library(rows, known, vectors, notes, vectors, files)
    arms = search.unified_search(library, search.SearchRequest("red fox"))
    page = display.search_page(arms).first()["text"]
    assert "Found 1 conversation matches and 2 file matches" in page and "#1 | ann | direct" in page
    assert set(search.unified_search(library, search.SearchRequest("red", files_only=True))) == {"files", "summary"}
    shown = display.line_page(lines.search_files(files, "red fox"), verbose=True).first()["text"]
    assert "#1 | Agent: main | /a.md:" in shown and "-> the red" in shown and "  x" in shown
    assert display.line_page(lines.search_files(files, "absent"), verbose=True).first()["text"].startswith("No results")
    status = spark.createDataFrame([("gmail", 2, "2026-01-02"), ("drive", 1, None)], "source string, captured long, latest string")
    assert display.capture_page(status).first()["text"].startswith("Total captured: 3\n  drive: 1\n  gmail: 2\n\nLatest captures:\n")


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None)], "id bigint, embedding array<float>")
    found = {r["id"]: round(r["score"], 4) for r in vector.similar(rows, "id", [3.0, 0.0]).collect()}
    assert found == {1: 1.0, 3: 0.6}
    both = vector.nearest_per_query(rows.where("id < 4"), "id", {"x": [1.0, 0.0], "y": [0.0, 1.0]}, 1)
    assert sorted((r["query"], r["id"]) for r in both.collect()) == [("x", 1), ("y", 2)]
    texts = spark.createDataFrame([(1, "long enough to be embedded"), (2, "short")], "id bigint, content string")
    made = vector.embed(texts, "id", "content").collect()
    assert [r["id"] for r in made] == [1] and len(made[0]["embedding"]) == 1536


def test_repeats_within_a_day(spark):
    at = ["2026-01-01 00:00:00", "2026-01-01 23:00:00", "2026-01-02 00:00:00", "2026-01-02 00:00:01", "2026-01-03 00:00:00"]
    notes = spark.createDataFrame([(i, "same", t) for i, t in enumerate(at)] + [(9, "other", at[1])], "id bigint, content string, t string")
    notes = notes.withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    assert ids(capture.drop_repeats(notes)) == [0, 3, 9]


def test_mail_twice_and_purge(spark):
    mail = spark.createDataFrame(
        [("m1", "me", "Ann <ann@firm.de>", "Plan", "d", NOW, "snip", "<p>Hi &amp; bye</p>", "t"), ("m2", "me", "news@x.org", "Sale", "d", NOW, "s", "", "t")],
        "id string, account string, sender string, subject string, date string, received_at timestamp_ntz, snippet string, body string, thread_id string",
    )
    empty = spark.createDataFrame([], model.CAPTURE_LOG)
    first = capture.capture_mail(mail, empty)
    assert {r["source_id"]: (r["outcome"], r["content"]) for r in first.collect()} == {
        "m1": ("captured", "Email from Ann <ann@firm.de>: Plan\nHi & bye"), "m2": ("filtered", None)}
    log = first.where("outcome = 'captured'").select(
        "source_type", "source_id", "account", F.lit(1).cast("bigint").alias("thought_id"), "source_modified", F.lit(str(NOW)).cast("timestamp_ntz").alias("captured_at"))
    assert capture.capture_mail(mail, capture.upsert_log(empty, log)).where("source_id = 'm1'").first()["outcome"] == "skipped"
    notes = spark.createDataFrame(
        [(1, "Email from news@x.org: Sale\nx", "gmail", None, "{}", NOW), (2, "Email from ann@firm.de: Plan\nx", "gmail", None, None, NOW)], model.NOTES)
    vectors = spark.createDataFrame([(1, 1), (2, 2)], "id bigint, note_id bigint")
    purged = capture.purge_notes(notes, vectors, log, capture.stored_mail_noise(notes), "gmail")
    assert (ids(purged["notes"]), ids(purged["embeddings"]), purged["log"].count()) == ([2], [2], 0)


def test_sessions_replaced_and_described(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, message_count bigint")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, message_count bigint")
    assert sorted(map(tuple, ingest.replaced_sessions(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    rows = spark.createDataFrame([("/u/.claude/projects/p/s1.jsonl", 1, None, None)], "path string, message_count bigint, started_at timestamp_ntz, ended_at timestamp_ntz")
    listed = spark.createDataFrame([("/u/.claude/projects/p", "s1")], "folder string, session_id string")
    assert ingest.describe_sessions(rows, telegram=listed).first()["channel"] == "telegram"


def test_note_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(paths, "SKIPPED_DIRECTORIES", ["node_modules"])  # tests run below /tmp
    home = tmp_path / "clawd-ann"
    (home / "node_modules").mkdir(parents=True)
    (home / "a.md").write_text("first\r\nsecond word\n\nthird")
    (home / "b.json").write_text("word")
    (home / "node_modules" / "c.md").write_text("word")
    found = lines.find_lines(read_notes(spark, [str(home)]).where(F.lit(True)), "word third").collect()
    assert [(r["line_num"], r["line"], r["context_before"], r["score"]) for r in found] == [
        (2, "second word", ["first"], 0.5), (4, "third", ["second word", ""], 0.5)]


def test_streams_of_notes(spark, tmp_path):
    folder = str(tmp_path / "in")
    at = F.lit(str(NOW)).cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, " a "), (2, "a"), (3, "b"), (4, " ")], "id bigint, content string").withColumn("created_at", at)
    rows.coalesce(1).write.parquet(folder)
    live = spark.readStream.schema(rows.schema).parquet(folder)
    query = new_notes(live).writeStream.format("memory").queryName("fresh_notes").option("checkpointLocation", str(tmp_path / "c1")).start()
    counted = recent_counts(live.select(F.col("content").alias("session_id"), F.col("created_at").alias("timestamp")))
    counts = counted.writeStream.outputMode("complete").format("memory").queryName("note_counts").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        query.processAllAvailable()
        counts.processAllAvailable()
        assert sorted(r["content"] for r in spark.table("fresh_notes").collect()) == ["a", "b"]
        assert spark.table("note_counts").agg(F.sum("messages")).first()[0] == 4
    finally:
        query.stop()
        counts.stop()
