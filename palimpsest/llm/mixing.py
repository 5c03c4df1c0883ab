"""Mixing sources to target weights by a low-discrepancy schedule.

Every source gets a target in words. A source's documents are shuffled by hash, laid end to end and cut into blocks
of equally many words. The schedule deals time steps to sources: step k has the van der Corput point of k (its bits
reversed), and the cumulative quotas of the sources cut the line of points into one interval per source. So every
stretch of the schedule holds each source close to its share. The rank of a step among its source's steps says which
block it takes; after its last block a source starts again with its first. The step at which a source meets its
target is cut there.

All of it is DataFrame functions. No window spans a source: the running position of a document is a sum inside
(source, hash range) plus the sums of the ranges before, and the rank of a step is computed from its bits alone.
A join key is (source, block), which holds one block's words at most, so a hot source is spread like any other.

Defined results: a null text has size 0; documents of size 0 take nothing. The null source is a source, ordered last.
Rows that repeat a doc_id are documents of their own. A table without words has no schedule. An empty table gives an
empty table. Equal input, seed and block size give an equal mix for any number of partitions, but for rows that are
equal throughout, whose places are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import WORD, as_row, numbered, partitions, stage, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 256
HASH_BITS = 60
#: Steps that one row of the schedule is expanded to at a time.
CHUNK = 4096


def _targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Shares the words out by weight; what a source cannot hold goes to the others until none is over its bound.

    With l words per unit of weight, a source gets min(bound, l * weight). Each turn recomputes l from the sources
    that are not full; only sums reach the driver.
    """
    wanted = share * (sources.agg(F.sum("_words")).first()[0] or 0)
    rate = 0.0
    while True:
        full = F.col("_bound") <= F.lit(rate) * F.col("_weight")
        held, weight = sources.agg(
            F.sum(F.when(full, F.col("_bound"))).alias("held"), F.sum(F.when(~full, F.col("_weight"))).alias("weight")
        ).first()
        following = (wanted - (held or 0.0)) / weight if weight else rate
        if following <= rate:
            break
        rate = following
    return sources.withColumn("_target", F.least("_bound", F.lit(rate) * F.col("_weight")))


def _reversed_bits(k: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def _steps_before(bits: int, edge: str) -> Column:
    """How many steps before `_k` have a point below the column `edge`.

    The steps before k are, for each set bit m of k, a run of 2^m steps whose points are 2^(bits-m) apart, so those
    below the edge are counted by one division.
    """
    apart = f"shiftleft(1L, {bits} - m)"
    first = f"((_point & ({apart} - 1L)) - shiftright({apart}, 1))"
    inside = f"shiftright({edge} - {first} + {apart} - 1L, {bits} - m)"
    return F.expr(
        f"aggregate(sequence(0, {bits} - 1), 0L, (n, m) -> n + "
        f"if((shiftright(_k, m) & 1L) = 1L, greatest(0L, least({inside}, shiftleft(1L, m))), 0L))"
    )


def _shuffling_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", whole_text()).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Narrow rows: document, source, size, and the hash that shuffles the source."""
    size = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").alias("_source"), size.alias("_size"), _shuffling_hash(seed).alias("_hash"))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with `_start`, the words of their source that come before them in the shuffled order."""
    ranges = partitions(rows.sparkSession)
    rows = rows.withColumn("_range", F.floor(F.col("_hash") / F.lit(float(1 << HASH_BITS)) * ranges))
    sums = rows.groupBy("_no", "_range").agg(F.sum("_size").alias("_sum"))
    before = sums.select(
        "_no",
        "_range",
        (F.sum("_sum").over(Window.partitionBy("_no").orderBy("_range")) - F.col("_sum")).alias("_before"),
    )
    inside = F.sum("_size").over(
        Window.partitionBy("_no", "_range").orderBy("_hash", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_inside", inside - F.col("_size"))
        .join(before, ["_no", "_range"])
        .withColumn("_start", F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", "_range")
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).

    documents: doc_id, _source, _size, _no, _words (of the source), _target, _start.
    schedule: what each step takes: _step, _no, _rank, _pass, doc_id, _start, _from (the first word of the document)
    and _taken (words). A document has a row for each step that reads part of it.
    """
    rows = stage(sized(docs, seed), "sized")
    sources = rows.groupBy("_source").agg(F.sum("_size").alias("_words"))
    sources = numbered(sources, "_source").withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_no") % len(weights) + 1).cast("int"))
    )
    sources = stage(sources.withColumn("_bound", F.col("_words") * F.lit(float(most))), "sources")
    block = F.lit(block_words)
    # A target of t words is `_full` whole passes and `_rest` words of another.
    sources = (
        _targets(sources, share, most)
        .withColumn("_wanted", F.floor(F.col("_target") + F.lit(1e-6)))
        .withColumn("_full", F.when(F.col("_words") > 0, F.expr("_wanted div _words")).otherwise(F.lit(0)))
        .withColumn("_rest", F.col("_wanted") - F.col("_full") * F.col("_words"))
        .withColumn("_blocks", F.ceil(F.col("_words") / block))
        .withColumn("_quota", F.col("_full") * F.col("_blocks") + F.ceil(F.col("_rest") / block))
    )
    sources = stage(sources, "targets")
    steps = sources.agg(F.sum("_quota")).first()[0] or 0
    bits = max(1, int(steps - 1).bit_length())
    # The sources' intervals, in the order of their numbers: a running sum over ranges of numbers, then inside each.
    quota = sources.withColumn("_range", F.expr("_no div 4096"))
    ends = quota.groupBy("_range").agg(F.sum("_quota").alias("_sum"))
    ends = ends.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    quota = quota.join(ends, "_range").withColumn(
        "_upper", F.col("_before") + F.sum("_quota").over(Window.partitionBy("_range").orderBy("_no"))
    ).withColumn("_lower", F.col("_upper") - F.col("_quota"))

    # Every point of every interval, a chunk at a time, so that a hot source's steps are spread over all tasks.
    chunks = quota.where(F.col("_quota") > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.expr(f"_lower div {CHUNK}"), F.expr(f"(_upper - 1) div {CHUNK}")))
    ).repartition(partitions(docs.sparkSession), "_no", "_chunk")
    points = chunks.withColumn(
        "_point",
        F.explode(
            F.sequence(
                F.greatest("_lower", F.col("_chunk") * CHUNK), F.least(F.col("_upper") - 1, F.col("_chunk") * CHUNK + CHUNK - 1)
            )
        ),
    )
    timed = points.withColumn("_k", _reversed_bits(F.col("_point"), bits)).withColumn(
        "_rank", _steps_before(bits, "_upper") - _steps_before(bits, "_lower")
    )
    slots = timed.select(
        F.col("_k").alias("_step"),
        "_no",
        "_rank",
        F.expr("_rank div _blocks").alias("_pass"),
        F.expr("_rank % _blocks").alias("_block"),
        F.when(F.expr("_rank div _blocks") < F.col("_full"), F.col("_words")).otherwise(F.col("_rest")).alias("_until"),
    )

    rows = rows.join(
        sources.select(F.col("_source").alias("_named"), "_no", "_words", "_target"), F.col("_source").eqNullSafe(F.col("_named"))
    ).drop("_named")
    documents = placed(rows)
    last = F.col("_start") + F.col("_size")
    pieces = (
        documents.where(F.col("_size") > 0)
        .select("doc_id", "_no", "_start", "_size", F.explode(F.sequence(F.expr(f"_start div {block_words}"), F.expr(f"(_start + _size - 1) div {block_words}"))).alias("_block"))
        .withColumn("_low", F.greatest("_start", F.col("_block") * block))
        .withColumn("_high", F.least(last, (F.col("_block") + 1) * block))
    )
    schedule = (
        # Spark takes the steps for as small as the chunks that they come from; they are not to be broadcast.
        pieces.join(slots.hint("merge"), ["_no", "_block"])
        .withColumn("_taken", F.least("_high", "_until") - F.col("_low"))
        .where(F.col("_taken") > 0)
        .select("_step", "_no", "_rank", "_pass", "doc_id", "_start", (F.col("_low") - F.col("_start")).alias("_from"), "_taken")
    )
    return documents, schedule


def taken(documents: DataFrame, schedule: DataFrame) -> DataFrame:
    """The documents with `_taken`, all words that the schedule takes of them."""
    # (source, first word) names a document that has words.
    sums = schedule.groupBy("_no", "_start").agg(F.sum("_taken").alias("_taken"))
    sums = sums.withColumn("_some", F.lit(True))
    keyed = documents.withColumn("_some", F.col("_size") > 0)
    return keyed.join(sums, ["_no", "_start", "_some"], "left").withColumn(
        "_taken", F.coalesce("_taken", F.lit(0).cast("long"))
    ).drop("_some")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of the documents: a row for each pass that takes a document or its beginning.

    Only the document at which a source meets its target is cut, after its last taken word. Rows that are equal in
    doc_id, source and text are interchangeable, and so are their other columns.
    """
    seed = settings.get("seed", 0)
    documents, schedule = mix(docs, **settings)
    takes = schedule.groupBy("_no", "_start", "_pass").agg(F.sum("_taken").alias("_taken"))
    takes = documents.where(F.col("_size") > 0).join(takes, ["_no", "_start"]).select(
        F.col("doc_id").alias("_id"), F.col("_source").alias("_of"), F.col("_hash").alias("_key"), "_size", "_taken"
    )
    keyed = docs.select(
        as_row(docs).alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_from_source"), _shuffling_hash(seed).alias("_hash")
    ).dropDuplicates(["_doc", "_from_source", "_hash"])
    rows = keyed.join(
        takes, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_from_source").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_key"))
    )
    text = F.col("_row")["text"]
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    beginning = F.array_join(F.slice(words, 1, F.col("_taken").cast("int")), "")
    cut = F.when(F.col("_taken") < F.col("_size"), beginning).otherwise(text)
    return rows.select(F.col("_row").withField("text", cut).alias("_row")).select("_row.*")
