"""A stored keyword index, written batch by batch as segments.

Each batch becomes a segment of postings in blocks (see blocks.py): the rows of one term in one part of the batch, with all
positions and the rows' lengths, sorted by term inside buckets of terms. The one shuffle that writes the buckets moves
blocks, spread over lanes of each bucket by term; adaptive execution joins small lanes and splits the lane of a frequent term. Each row also has a
posting of the empty term, which makes the narrow table of rows and lengths.

Rows are never changed in place. A deletion is a tombstone (row_id), which holds for segments before its own, so a row
that is indexed again lives on in the later segment. Counts of rows and tokens, and what tombstones took from them, stand in the
list of segments; the ranking statistics need no scan. merge() rewrites all living postings as one segment, part by part: the blocks of a part
meet those of its rows that are gone.

The list of segments is a small table with a version for each write, written last: a write that fails leaves the version
before, and a reader sees one version throughout. One writer at a time. Old segments stay for readers that began
before a merge; the folder's owner removes them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import blocks, fts
from palimpsest.operators.blocks import EVERY_ROW

#: Rows for each bucket of terms in a segment.
BUCKET_ROWS = 1_000_000
#: Parts of a bucket that are written by tasks of their own unless they are small.
LANES = 64


@dataclass(frozen=True)
class Segment:
    number: int
    buckets: int = 0
    rows: int = 0
    total_length: int = 0
    tombstones: bool = False
    gone_rows: int = 0
    gone_length: int = 0


SEGMENTS = "number long, buckets long, rows long, total_length long, tombstones boolean, gone_rows long, gone_length long"


@dataclass(frozen=True)
class StoredIndex:
    """One version of an index: its living segments."""

    spark: SparkSession
    folder: str
    version: int
    segments: Sequence[Segment]

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/segment={number}"

    def _read(self, kind: str, numbers: Sequence[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        paths = [self._path(kind, n) for n in numbers]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def tombstones(self) -> DataFrame:
        """(row_id, dead_before): the latest tombstone of each row."""
        found = self._read("tombstones", [s.number for s in self.segments if s.tombstones], "row_id long, segment long")
        return found.groupBy("row_id").agg(F.max("segment").alias("dead_before"))

    def _blocks(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Blocks of some terms, or of all, with those rows that are gone."""
        held = [s for s in self.segments if s.buckets]
        found = self._read("blocks", [s.number for s in held], f"{blocks.BLOCK}, segment long, bucket int")
        if terms is None:
            return found
        place = F.lit(False)
        for s in held:
            buckets = self.spark.range(1).select(*[_bucket(F.lit(t), s.buckets) for t in terms]).first()
            place = place | ((F.col("segment") == s.number) & F.col("bucket").isin(*set(buckets)))
        return found.where(place & F.col("term").isin(*terms))

    def _has_gone(self) -> bool:
        """Whether a tombstone holds for a segment with postings."""
        held, dead = [s.number for s in self.segments if s.buckets], [s.number for s in self.segments if s.tombstones]
        return bool(held and dead) and min(held) < max(dead)

    def postings(self, terms: Sequence[str] | None = None, positions: bool = True) -> DataFrame:
        """Living postings (row_id, length, term, tf, positions) of some terms, or of all."""
        found = self._blocks(terms).select("segment", "term", F.inline(blocks.postings_of_block(positions)))
        if self._has_gone():
            gone = self.tombstones().withColumnRenamed("row_id", "_gone")
            found = found.join(gone, (F.col("row_id") == F.col("_gone")) & (F.col("segment") < F.col("dead_before")), "left_anti")
        return found.select("row_id", "length", "term", "tf", *(["positions"] if positions else []))

    def _living_blocks(self) -> DataFrame:
        """All blocks without the rows that are gone. The blocks of one part of a batch make a group, a bounded one."""
        found = self._blocks().drop("bucket")
        if not self._has_gone():
            return found.drop("segment")
        rows = self._blocks([EVERY_ROW]).select("segment", "block", F.explode("row_ids").alias("row_id"))
        gone = rows.join(self.tombstones(), "row_id").where(F.col("segment") < F.col("dead_before"))
        part = ["segment", "block"]
        return found.groupBy(part).cogroup(gone.select(*part, "row_id").groupBy(part)).applyInArrow(blocks.without, blocks.BLOCK)

    def rows(self) -> DataFrame:
        """(row_id, length) of the living rows."""
        return self.postings([EVERY_ROW], positions=False).select("row_id", "length")

    def stats(self) -> DataFrame:
        """rows and total_length of the living rows: one row, without a scan."""
        rows = sum(s.rows - s.gone_rows for s in self.segments)
        length = sum(s.total_length - s.gone_length for s in self.segments)
        return self.spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(length).cast("long").alias("total_length"))

    def search(self, query: str) -> DataFrame:
        """(row_id, score) of the rows matching every phrase of the query."""
        phrases = fts.query_phrases(query)
        words = sorted({word for phrase in phrases for word in phrase}) if phrases else []
        return fts.search_postings(self.postings(words, any(len(p) > 1 for p in phrases or [])), self.stats(), query)

    def _commit(self, segments: Sequence[Segment]) -> StoredIndex:
        version = self.version + 1
        rows = [tuple(s.__dict__.values()) for s in segments]
        self.spark.createDataFrame(rows, SEGMENTS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/version={version}")
        return replace(self, version=version, segments=tuple(segments))

    def _write(self, packed: DataFrame, number: int, buckets: int) -> Segment:
        """Writes a segment's blocks; its counts come from the blocks of the empty term."""
        lane = F.pmod(F.xxhash64("term", F.lit(LANES)), F.lit(LANES))
        (
            packed.withColumns({"bucket": _bucket(F.col("term"), buckets), "_lane": lane})
            .hint("rebalance", "bucket", "_lane")  # adaptive execution splits and joins these partitions by their size
            .sortWithinPartitions("bucket", "term", "block").drop("_lane")
            .write.mode("overwrite").partitionBy("bucket").parquet(self._path("blocks", number))
        )
        new = Segment(number, buckets)
        held = replace(self, segments=(new,)).rows().agg(F.count(F.lit(1)), F.sum("length")).first()
        return replace(new, rows=held[0], total_length=held[1] or 0)

    def _entomb(self, ids: DataFrame, number: int) -> Segment | None:
        """Writes tombstones for those ids that live, before the segment of the number."""
        living = self.rows().withColumnRenamed("row_id", "_living")
        gone = living.join(ids.distinct(), F.col("_living") == F.col("row_id"), "left_semi").select(F.col("_living").alias("row_id"), "length")
        gone.write.mode("overwrite").parquet(self._path("tombstones", number))
        kept = self.spark.read.schema("row_id long, length int").parquet(self._path("tombstones", number))
        count, length = kept.agg(F.count(F.lit(1)), F.sum("length")).first()
        return Segment(number, tombstones=True, gone_rows=count, gone_length=length) if count else None

    def add(self, rows: DataFrame, row_id: str, text: str, bucket_rows: int = BUCKET_ROWS) -> StoredIndex:
        """The next version, with the batch as a segment; rows of it that are there already are replaced."""
        number = self.version + 1
        ids = rows.select(F.col(row_id).cast("long").alias("row_id"))
        dead = self._entomb(ids, number) if self.segments else None
        new = self._write(row_blocks(rows, row_id, text), number, max(1, -(-rows.count() // bucket_rows)))
        if dead:
            new = replace(new, tombstones=True, gone_rows=dead.gone_rows, gone_length=dead.gone_length)
        return self._commit([*self.segments, new])

    def delete(self, ids: DataFrame) -> StoredIndex:
        """The next version, without the rows of the ids, the one column of the frame."""
        dead = self._entomb(ids.toDF("row_id").select(F.col("row_id").cast("long")), self.version + 1)
        return self._commit([*self.segments, dead] if dead else self.segments)

    def merge(self, bucket_rows: int = BUCKET_ROWS) -> StoredIndex:
        """The next version: all living postings as one segment, without tombstones."""
        living = sum(s.rows - s.gone_rows for s in self.segments)
        return self._commit([self._write(self._living_blocks(), self.version + 1, max(1, -(-living // bucket_rows)))])


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def row_blocks(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """Blocks of the rows' postings, and of a posting of the empty term for each row."""
    texts = rows.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text"))
    return fts.row_words(texts).mapInArrow(blocks.pack, blocks.BLOCK)


def open_index(spark: SparkSession, folder: str, until: int | None = None) -> StoredIndex:
    """The latest version of the index in a folder, of those up to a number if one is given; an empty one where there is none.

    A version that is followed by others is for reading only.
    """
    folder = folder.rstrip("/")
    try:
        found = spark.read.schema(f"{SEGMENTS}, version long").parquet(f"{folder}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return StoredIndex(spark, folder, 0, ())
    if until is not None:
        found = found.where(F.col("version") <= until)
    version = found.agg(F.max("version")).first()[0] or 0
    rows = found.where(F.col("version") == version).drop("version").orderBy("number").collect()
    return StoredIndex(spark, folder, version, tuple(Segment(**r.asDict()) for r in rows))
