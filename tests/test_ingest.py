"""Session files: parsing, growing and shrinking files, equal results of all routes."""

import json

from pyspark.sql import functions as F

from palimpsest.functions.paths import Naming
from palimpsest.operators import ingest
from palimpsest.sources.tail import list_files, read_sessions
from palimpsest.streaming.archive import Archive, index_once, start_ingest

UUID = "00042d69-0c1c-4ac4-a7ff-95decb61900d"


def line(role="user", content="hello", **more):
    return json.dumps({"type": "message", "message": {"role": role, "content": content}, **more}) + "\n"


def folder(tmp_path):
    target = tmp_path / "agents" / "main" / "sessions"
    target.mkdir(parents=True)
    return target


def stored(archive):
    rows = archive.messages().orderBy("session_id", "message_index").collect()
    return [(r["session_id"], r["message_index"], r["content"]) for r in rows]


def test_shapes_and_refused_lines(spark, tmp_path):
    file = folder(tmp_path) / "s1.jsonl"
    tagged = "<system-reminder>x\ny</system-reminder>"
    parts = [{"type": "text", "text": "hi"}, {"type": "image"}, "odd", {"type": "text", "text": "there"}]
    file.write_bytes(
        line(content="first", timestamp="2026-03-08T10:00:00Z").encode()
        + json.dumps({"type": "user", "message": {"content": tagged + "from cc"}}).encode() + b"\n"
        + json.dumps({"type": "assistant", "message": {"role": "assistant", "content": parts}}).encode() + b"\n"
        + json.dumps({"role": "user", "content": "[2026-02-06 10:25 GMT+11] old"}).encode() + b"\n"
        + b"\n{broken\n[1, 2]\n"
        + json.dumps({"type": "user", "message": {"content": tagged}}).encode() + b"\n"
        + line(role="toolResult", content="big").encode()
        + line(content="HEARTBEAT_OK").encode()
        + line(content="millis", timestamp=1772964000000).encode()
        + b'{"type":"message","message":{"role":"user","content":"bad \xff byte"}}\n'
        + line(content="my pass" + "word: hunter2secret").encode()
        + b'{"type":"message","message":{"role":"user","content":"partial'
    )
    kept = ingest.number_messages(ingest.parse_lines(read_sessions(spark, [str(tmp_path)])))
    rows = kept.orderBy("message_index").collect()
    assert [r["content"] for r in rows] == [
        "first", "from cc", "hi there", "[2026-02-06 10:25 GMT+11] old", "millis", "bad � byte",
        "my password: [REDACTED]",
    ]
    assert [r["message_index"] for r in rows] == list(range(7))
    assert [str(r["timestamp"]) for r in rows] == [
        "2026-03-08 10:00:00", "None", "None", "2026-02-06 10:25:00", "2026-03-08 10:00:00", "None", "None",
    ]
    assert [r["role"] for r in rows][1:3] == ["user", "assistant"]


def test_small_chunks_give_the_same_lines(spark, tmp_path):
    target = folder(tmp_path)
    for name in ("a", "b"):
        (target / f"{name}.jsonl").write_text("".join(line(content=f"{name}{i} " + "x" * (i % 40)) for i in range(200)))
    whole = read_sessions(spark, [str(tmp_path)])
    chopped = read_sessions(spark, [str(tmp_path)], chunkBytes="97")
    assert chopped.count() == 400
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, chopped.collect()))


def test_numbering_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BLOCK_BYTES", 50)
    kept = spark.range(100).select(
        F.lit("p").alias("path"), (F.col("id") * 7).alias("offset"), F.col("id").alias("expected")
    )
    starts = spark.createDataFrame([("p", 5)], "path string, start_index bigint")
    rows = ingest.number_messages(kept, starts).collect()
    assert all(r["message_index"] == r["expected"] + 5 for r in rows) and len(rows) == 100


def test_stream_follows_growth_shrinking_and_twin_files(spark, tmp_path):
    target = folder(tmp_path / "in")
    file = target / f"{UUID}.jsonl"
    archive = Archive(spark, str(tmp_path / "store"), Naming({"main": "Mara"}))
    query = start_ingest(archive, [str(tmp_path / "in")], str(tmp_path / "ck"), every="1 second")
    try:
        file.write_text(line(content="one", timestamp="2026-03-08T10:00:00Z") + line(content="two") + '{"type"')
        query.processAllAvailable()
        assert stored(archive) == [(UUID, 0, "one"), (UUID, 1, "two")]
        with file.open("w") as out:
            out.write(line(content="one", timestamp="2026-03-08T10:00:00Z") + line(content="two"))
            out.write(line(content="three", timestamp="2026-03-08T11:00:00Z"))
        copy = tmp_path / "in" / "agents-archive" / f"agent-main-cron-{UUID}-20260220.jsonl"
        copy.parent.mkdir()
        copy.write_text(line(content="one"))
        query.processAllAvailable()
        assert stored(archive) == [(UUID, 0, "one"), (UUID, 1, "two"), (UUID, 2, "three")]
        session = archive.sessions().collect()
        assert [(s["id"], s["agent_id"], s["channel"], s["message_count"]) for s in session] == [(UUID, "Mara", "direct", 3)]
        assert str(session[0]["ended_at"]) == "2026-03-08 11:00:00"
        file.write_text(line(content="anew"))
        query.processAllAvailable()
        assert stored(archive) == [(UUID, 0, "anew")]
    finally:
        query.stop()
    ids = [r["id"] for r in archive.messages().collect()]
    assert len(ids) == len(set(ids))


def test_batch_runs_equal_one_full_run(spark, tmp_path):
    target = folder(tmp_path / "in")
    step, full = Archive(spark, str(tmp_path / "step")), Archive(spark, str(tmp_path / "full"))
    root = str(tmp_path / "in")
    texts = [line(content=f"m{i}") for i in range(30)]
    for batch, upto in enumerate((10, 20, 30)):
        (target / "grow.jsonl").write_text("".join(texts[:upto]))
        (target / f"new{batch}.jsonl").write_text(line(content=f"n{batch}"))
        (target / f"boot-{batch}.jsonl").write_text(line(content="excluded"))
        planned = index_once(step, list_files(spark, root), batch)
        if batch == 2:
            actions = {r["path"].rsplit("/", 1)[1]: r["action"] for r in planned.collect()}
    assert actions["grow.jsonl"] in ("append", "skip") and actions["boot-1.jsonl"] == "skip"
    index_once(full, list_files(spark, root), 0)
    assert stored(step) == stored(full) and len(stored(full)) == 33
    step.add_batch(read_sessions(spark, [root]).where(F.lit(False)), 3)
    assert stored(step) == stored(full)
