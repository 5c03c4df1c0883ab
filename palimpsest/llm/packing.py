"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. Documents longer than a sequence are cut into full pieces, the first of
which may be shorter. Pieces are placed by decreasing length, each into the open sequence with the least room that
still holds it, found by a segment tree over the possible amounts of room.

Pieces of equal length are interchangeable, so the packing is worked out from the number of pieces of each length,
a table with at most one row for each length up to the capacity, whatever the number of documents. The tree's leaves
are amounts of room; open sequences with the same contents are one group with a count, and a whole group is filled at
once. The result says which ranks among the pieces of a length go where; ranks come from a number inside
(length, hash bucket) plus the sizes of the buckets before, so a length that a third of all pieces have is spread too.

The plan is bounded: each length splits at most two groups, so there are at most 3 * capacity groups, and a group
holds at most sqrt(2 * capacity) different lengths; for 2048 that is below 400,000 numbers, at any input size.

Defined results: a null text is the empty text, whose piece is the end id alone. Rows that repeat a doc_id are packed
as documents of their own; equal ones get places in an unspecified order. An empty table packs into no sequences. The
plan depends only on the lengths. Texts of any length are cut; nothing is dropped or shortened.
"""

from __future__ import annotations

import base64
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import partitions, stage

CAPACITY = 2048
END_ID = 0
#: Longer words go to the library whose time does not grow with the square of a word.
LONGEST = 1000
#: Texts that a worker turns into pieces at a time.
BATCH_BYTES = 2_000_000


class TextIds:
    """Token ids of whole texts by a file of the tokenizers library.

    With `ranks`, the same byte-pair vocabulary as a file of merge ranks, plain texts go to the faster library that
    reads those: texts of Latin letters, digits and marks without anything that could be a special token, and without
    a word or run of spaces over LONGEST characters. For such texts both give the same ids.
    """

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, model: str, ranks: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=found, special_tokens={})

    def _is_plain(self, text: str) -> bool:
        if "<|" in text or not self.PLAIN.fullmatch(text):
            return False
        return len(text) <= LONGEST or (" " * LONGEST not in text and max(map(len, text.split(" "))) <= LONGEST)

    def of(self, text: str) -> np.ndarray:
        if self.fast and self._is_plain(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def by_size(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose second column, a text, holds about so many bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + chars, "right")))
        yield batch.slice(low, high - low)
        low = high


_IDS: dict[tuple[str, str | None], TextIds] = {}


def text_ids(model: str, ranks: str | None) -> TextIds:
    if (model, ranks) not in _IDS:
        _IDS[model, ranks] = TextIds(model, ranks)
    return _IDS[model, ranks]


def pieces(docs: DataFrame, model: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of every piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(model, ranks).of
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in by_size(batch, BATCH_BYTES):
                rows: list[list] = [[] for _ in names]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "").astype("<u4", copy=False).tobytes() + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (low, high) in enumerate(zip(edges, edges[1:])):
                        for column, value in zip(rows, (doc, k, low, high - low, ids[low * 4 : high * 4])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


class Rooms:
    """A segment tree over amounts of room 0..capacity; a node says whether a sequence with such room is open."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        node = room + self.leaves
        self.open[node] = is_open
        while node > 1:
            node >>= 1
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest amount of room, `least` at least, that an open sequence has."""
        node = least + self.leaves
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, pieces of it in each), ...] in the order of placing)."""
    rooms, groups = Rooms(capacity), defaultdict(list)

    def put(n: int, room: int, held: list[tuple[int, int]]) -> None:
        if n:
            groups[room].append((n, held))
            rooms.set(room, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:  # new sequences
                n, room, held = -(-left // (capacity // length)), capacity, []
            else:
                n, held = groups[room].pop()
                rooms.set(room, bool(groups[room]))
            # A sequence that has taken a piece has less room than before: the next piece goes there while it fits.
            most = room // length
            filled, over = min(n, left // most), 0
            put(filled, room - most * length, [*held, (length, most)])
            left -= filled * most
            if filled < n and left:
                over = left
                put(1, room - over * length, [*held, (length, over)])
                left = 0
            if held:
                put(n - filled - bool(over), room, held)
    return [group for room in sorted(groups) for group in groups[room]]


def places(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, pieces in each sequence, offset), by first rank."""
    table, ranks, sequence = defaultdict(list), defaultdict(int), 0
    for n, held in groups:
        offset = 0
        for length, each in held:
            table[length].append((ranks[length], sequence, each, offset))
            ranks[length] += n * each
            offset += length * each
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in table.items()}


def pack(sized: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Rows that have a `length` with their `sequence_id` and `offset`.

    The rows are written once, then ranked inside (length, bucket of the order columns).
    """
    spark = sized.sparkSession
    buckets = partitions(spark)
    rows = stage(sized.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))), "pieces")
    sizes = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "length",
        "_bucket",
        (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"),
    )
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(best_fit(counts, capacity))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1
    ranked = (
        rows.withColumn("_inside", inside)
        .join(before, ["length", "_bucket"])
        .withColumn("_rank", F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_inside", "_before")
    )
    kept = [f for f in ranked.schema if f.name != "_rank"]
    at, size = ranked.columns.index("_rank"), ranked.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, lengths = batch.column(at).to_numpy(), batch.column(size).to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                own = lengths == length
                row = table[int(length)]
                row = row[np.searchsorted(row[:, 0], ranks[own], "right") - 1]
                past = ranks[own] - row[:, 0]
                sequence[own] = row[:, 1] + past // row[:, 2]
                offset[own] = row[:, 3] + past % row[:, 2] * length
            columns = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=[*(f.name for f in kept), "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
