"""The stored indexes that queries build: every change is made, and none depends on what ran before."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import fts
from palimpsest.operators.segments import StoredIndex
from palimpsest.plans import stored
from palimpsest.plans.catalog import NOTE_QUERY, QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    ids = F.explode(F.array("id", F.when(F.col("id") % 9 == 0, F.col("id")).otherwise(F.col("id") + 1_000)))
    rows = spark.range(-60, 60).select(ids.alias("doc_id")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    text = F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.concat_ws(" ", F.lit("tion er th"), "doc_id"))
    rows.select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_index_stats_makes_every_change_and_the_merge(spark, folder, monkeypatch):
    merge, merged = StoredIndex.merge, []
    monkeypatch.setattr(StoredIndex, "merge", lambda index, *a: merged.append(index.version) or merge(index, *a))
    found = [QUERIES["index_stats"](spark, folder).first() for _ in range(2)]
    assert merged == [5]  # by the first of the two
    want = stored.changed_corpus(spark, folder)
    assert found == [fts.corpus_stats(want, ["content"]).first()] * 2
    index = stored.updated_index(spark, folder)
    assert index.version == 6 and len(index.segments) == 1 and not index.segments[0].tombstones
    assert sorted(r.row_id for r in index.rows().collect()) == sorted(r.id for r in want.select("id").collect())


def test_updates_are_read_from_their_segments_after_the_merge(spark, folder):
    merged = stored.updated_index(spark, folder)
    again, changed = stored.updated_index(spark, folder), stored.changed_index(spark, folder)
    assert again == merged and (again.version, changed.version, len(changed.segments)) == (6, 5, 5)
    assert changed.stats().first() == merged.stats().first()
    want = {(r.id, round(r.score, 6)) for r in fts.search_rows(stored.changed_corpus(spark, folder), ["content"], NOTE_QUERY).collect()}
    assert {tuple(r) for r in QUERIES["kw_index_updates"](spark, folder).collect()} == want
