"""Document fingerprints: a Merkle tree over clauses, paragraphs and sections.

A paragraph is a line. A section is a run of paragraphs; one ends after each paragraph whose digest begins with 0, so
borders move with the text and an insertion changes one section. Below the paragraphs are clauses of at most eight
words, so that an edit inside a long paragraph is located too. The root is a SHA-256 digest over the sections'
digests, those are over the paragraphs' digests, and equal roots mean equal texts. Branches that differ locate edits.

A fingerprint is one string: `root:sections:clauses`. Sections are the first eight digits of each section's digest.
A clause is a number of 52 hash bits and its length in words, in the order of the text. The likeness of two
fingerprints is 1 for equal roots; otherwise it is the words in clauses that both have, as a share of the words in
all distinct clauses of the longer one.

All of it is DataFrame functions on one row. The next document is found without a global order in one task: ids are
cut into ranges by a bounded list of quantiles, a window looks ahead inside a range, and the last document of a range
meets a guest, the first one of the next range that has any.

Defined results: a null text is the empty text, which has one paragraph and no clause. Rows in order: null ids first,
equal ids by their text. The last row's next is the first row; a single row is its own next. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from palimpsest.llm.common import partitions, stage, whole_text

#: At most eight words, ending early after a mark.
CLAUSE = r"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.,;:!?][\x20\x09-\x0D]+){0,7}[^\x20\x09-\x0D]+"
LENGTH_BITS = 12
#: Quantiles of the ids. Between two of them ids are taken as evenly spread.
QUANTILES = 32


def clauses(text: Column) -> Column:
    """A number for each clause: hash bits and, in the lowest bits, the length in words."""
    low = (1 << LENGTH_BITS) - 1

    def number(clause: Column) -> Column:
        words = F.least(F.size(F.split(clause, r"[\x20\x09-\x0D]+")), F.lit(low))
        return F.xxhash64(clause).bitwiseAND(F.lit(~low)).bitwiseOR(words.cast("long"))

    return F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), number)


def sections(text: Column) -> Column:
    """The digest of each section."""
    digests = F.transform(
        F.split(text, "\n"), lambda p: F.sha2(p, 256)
    )
    marked = F.transform(digests, lambda d: F.concat(d, F.when(d.startswith("0"), F.lit("/")).otherwise(F.lit(" "))))
    return F.transform(F.split(F.array_join(marked, ""), "/"), lambda s: F.sha2(s, 256))


def with_tree(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds `<prefix>_sections` and `<prefix>_clauses` of a text column."""
    return rows.withColumn(f"{prefix}_sections", sections(F.col(text))).withColumn(f"{prefix}_clauses", clauses(F.col(text)))


def root(prefix: str) -> Column:
    return F.sha2(F.array_join(f"{prefix}_sections", ""), 256)


def fingerprint(prefix: str) -> Column:
    """The string of a tree's columns."""
    return F.concat_ws(
        ":",
        root(prefix),
        F.array_join(F.transform(f"{prefix}_sections", lambda s: F.substring(s, 1, 8)), "."),
        F.array_join(F.transform(f"{prefix}_clauses", lambda c: F.lower(F.hex(c))), "."),
    )


def tree_of(fingerprint_: Column) -> Column:
    """The clause numbers of a fingerprint string, for comparing stored fingerprints."""
    numbers = F.filter(F.split(F.element_at(F.split(fingerprint_, ":"), 3), r"\."), lambda c: c != "")
    # conv() gives an unsigned number; halves keep it inside a long.
    return F.transform(
        numbers,
        lambda c: F.shiftleft(F.conv(F.substring(F.lpad(c, 16, "0"), 1, 8), 16, 10).cast("long"), 32).bitwiseOR(
            F.conv(F.substring(F.lpad(c, 16, "0"), 9, 8), 16, 10).cast("long")
        ),
    )


def likeness(root_a: Column, clauses_a: Column, root_b: Column, clauses_b: Column) -> Column:
    """From 0 to 1: words of the common clauses as a share of those of the longer tree's distinct clauses."""
    low = F.lit((1 << LENGTH_BITS) - 1)

    def words(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0).cast("long"), lambda n, c: n + c.bitwiseAND(low))

    all_ = F.greatest(words(F.array_distinct(clauses_a)), words(F.array_distinct(clauses_b)))
    common = words(F.array_intersect(clauses_a, clauses_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(all_ == 0, F.lit(0.0)).otherwise(common / all_)


def differing_sections(sections_a: Column, sections_b: Column) -> Column:
    """The positions, from 0, of the sections of the first tree that the second lacks: where the edits are."""
    return F.filter(
        F.transform(sections_a, lambda s, i: F.when(~F.array_contains(sections_b, s), i)), lambda i: i.isNotNull()
    )


def _range(bounds: list[int], ranges: int) -> Column:
    """A number from 0 to `ranges` that never falls as doc_id grows: its place among the quantiles, and in between."""
    key, each = F.col("doc_id"), -(-ranges // max(1, len(bounds) - 1))
    place = F.lit(0).cast("long")
    for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
        inside = F.floor((key.cast("double") - F.lit(float(low))) / F.lit(float(high - low)) * each) if high > low else F.lit(0)
        place = F.when(key >= F.lit(low), F.lit(i * each) + F.least(inside, F.lit(each - 1 if i < len(bounds) - 2 else each))).otherwise(place)
    return F.when(key.isNull(), F.lit(-1)).otherwise(place).cast("long")


def with_next(docs: DataFrame, text: str = "text") -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, _text, next_text) and guests, in ranges of ids, and the window over a range that looks ahead."""
    spark = docs.sparkSession
    fractions = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), fractions, 10_000)).first()[0] or [0]
    bounds = sorted(set(found))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"))
    rows = rows.withColumn("_range", _range(bounds, 4 * partitions(spark)))
    # The first id of each range, a row for each of a bounded number of ranges, says where the guest comes from.
    firsts = rows.groupBy("_range").agg(F.min("doc_id").alias("_first"))
    circle = Window.orderBy("_range")
    hosts = stage(
        firsts.select(
            F.coalesce(F.lag("_range").over(circle), F.max("_range").over(Window.partitionBy())).alias("_host"),
            F.col("_range").alias("_from"),
            "_first",
        ),
        "ranges",
    )
    guests = rows.join(hosts, (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    guests = guests.groupBy("_host").agg(F.min("_text").alias("_text")).select(
        F.lit(None).cast("long").alias("doc_id"), "_text", F.col("_host").alias("_range"), F.lit(True).alias("_guest")
    )
    all_ = rows.withColumn("_guest", F.lit(False)).unionByName(guests)
    ahead = Window.partitionBy("_range").orderBy("_guest", *order)
    return all_.withColumn("next_text", F.lead("_text").over(ahead)), ahead


def edited(text: str, following: str) -> Column:
    """The text with its last half replaced by the beginning of the next one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), F.char_length(text) - half), F.substring(F.col(following), F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """Every row with its tree, its edited text's tree and the next row's, under own_, edit_ and next_."""
    rows, ahead = with_next(docs)
    rows = with_tree(rows, "_text", "own").withColumn("own_root", root("own"))
    rows = (
        rows.withColumn("next_root", F.lead("own_root").over(ahead))
        .withColumn("next_clauses", F.lead("own_clauses").over(ahead))
        .where(~F.col("_guest"))
        .withColumn("edited_text", edited("_text", "next_text"))
    )
    rows = with_tree(rows, "edited_text", "edit")
    return rows.withColumn("edit_root", root("edit")).drop("_range", "_guest")
