"""The stored keyword index against a search that scans."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fts, search, segments

WORDS = ["red", "fox", "runs", "Blue", "sky", "the", "red-fox", "ünder", "日本", "x1"]
QUERIES = ["red fox", "red-fox", "sky", "Blue sky runs", "fox fox", "ünder 日本", "the of", "absent"]


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, content string").repartition(2)


def check(spark, index, texts):
    rows = table(spark, texts)
    for query in QUERIES:
        want = {r["id"]: r["score"] for r in fts.search_rows(rows, ["content"], query).collect()}
        assert {r["row_id"]: r["score"] for r in index.search(query).collect()} == pytest.approx(want), query
    assert index.stats().first() == fts.corpus_stats(rows, ["content"]).first()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))


def test_batches_replacements_deletions_and_merge(spark, tmp_path):
    rng = random.Random(1)
    index = segments.open_index(spark, str(tmp_path))
    assert index.version == 0 and index.search("red").count() == 0
    texts = {i: sentence(rng) for i in range(120)} | {120: None, 121: "", 122: "red fox " * 3_000}
    index = index.add(table(spark, texts), "id", "content", bucket_rows=50)
    check(spark, index, texts)
    again = {i: sentence(rng) for i in range(100, 160)}
    index = index.add(table(spark, again), "id", "content", bucket_rows=1_000)
    texts |= again
    check(spark, index, texts)
    gone = [3, 5, 110, 122, 999]
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "any_name long"))
    texts = {i: t for i, t in texts.items() if i not in gone}
    back = {5: "red fox back again"}
    before = index
    index = index.add(table(spark, back), "id", "content")
    check(spark, before, texts)
    texts |= back
    reread = segments.open_index(spark, str(tmp_path))
    assert reread.version == index.version == 4 and len(reread.segments) == 4
    check(spark, reread, texts)
    merged = reread.merge(bucket_rows=60)
    assert len(merged.segments) == 1 and not merged.segments[0].tombstones
    check(spark, merged, texts)
    assert merged.delete(spark.createDataFrame([(999,)], "id long")).segments == merged.segments


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    index = segments.open_index(spark, str(tmp_path)).add(table(spark, {1: "red", 2: "fox"}), "id", "content")
    broken = table(spark, {3: "red"}).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        index.add(broken, "id", "content")
    index = segments.open_index(spark, str(tmp_path))
    assert index.version == 1
    check(spark, index.add(table(spark, {4: "red fox"}), "id", "content"), {1: "red", 2: "fox", 4: "red fox"})


def test_only_the_terms_buckets_are_read(spark, tmp_path):
    texts = {i: f"red w{i} fox" for i in range(200)}
    index = segments.open_index(spark, str(tmp_path)).add(table(spark, texts), "id", "content", bucket_rows=10)
    plan = index.postings(["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in plan or "EqualTo(term,red)" in plan


def test_a_page_reads_no_text(spark, tmp_path):
    rows = table(spark, {i: f"red w{i} fox" for i in range(50)})
    rows.write.parquet(str(tmp_path / "messages"))
    rows = spark.read.parquet(str(tmp_path / "messages")).withColumn("session_id", F.lit("s")).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    known = spark.createDataFrame([("s", "ann", "direct", 50)], "id string, agent_id string, channel string, message_count long")
    index = segments.open_index(spark, str(tmp_path / "index")).add(rows, "id", "content")
    page = search.stored_page(index, rows, known, "red fox", 10, agent="ANN", date_from="2023-01-01")
    assert page.count() == 10 and "content" not in page._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_batch_keep_every_posting(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.blocks.BATCH_TOKENS", 40)
    rng = random.Random(7)
    texts = {i: sentence(rng) for i in range(200)} | {200: "red fox " * 100, 201: None}
    index = segments.open_index(spark, str(tmp_path)).add(table(spark, texts), "id", "content", bucket_rows=90)
    gone = [i for i in range(200) if i % 3 == 0] + list(range(30, 60))
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
    merged = index.merge(bucket_rows=50)
    check(spark, merged, {i: t for i, t in texts.items() if i not in gone})
    assert not set(gone) & {r.row_id for r in merged.postings().select("row_id").collect()}


def test_a_term_of_many_rows_is_few_stored_rows(spark, tmp_path):
    texts = {i: " ".join(f"w{j}" for j in range(50)) for i in range(300)}
    segments.open_index(spark, str(tmp_path)).add(table(spark, texts), "id", "content")
    stored = spark.read.parquet(f"{tmp_path}/[bp]*s/segment=1").count()
    assert stored <= 51 * 2  # 51 * 300 as one row for each term and row


def test_postings_are_counted_without_a_shuffle(spark):
    built = fts.build_postings(table(spark, {1: "red fox red", 2: None}), "id", "content", positions=True)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the one that table() asks for
    assert sorted(tuple(r) for r in built.collect()) == [(1, 3, "fox", 1, 1, [1]), (1, 3, "red", 2, 0, [0, 2])]
