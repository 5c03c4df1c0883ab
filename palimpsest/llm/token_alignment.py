r"""Alignment of two tokenizers' tokens over the same bytes.

Every text is tokenised whole by both: A, a byte-level vocabulary, reads a space and the text, and B, a vocabulary of
pieces, adds that space itself. Offsets where a token of A and one of B both end cut a text's tokens into groups, and the
two tokens that end there are linked.

A text's offsets are marked where tokens of B end, and read where tokens of A end, so groups and links are array
operations over the whole text and no token is looked at alone. The bytes of all tokens of both sides are held against
the text. The text of the groups is laid out in one piece, from the decimal names of all ids.

How often a pair of ids is linked is counted over all texts in two steps: links are counted in each chunk, documents of
one task with about so many bytes, which names its distinct pairs once, and the chunks' counts are summed by pair. What is
kept of a document are its links as numbers into its chunk's list, so the counts come back by one row for each pair of a
chunk, whatever the number of links, and a chunk with its documents is one group of a cogroup, bounded in bytes (a
chunk holds one document more than its bound at most; a very long text is a chunk of its own). A pair that all
chunks have is one row in each; adaptive execution splits that join, as both sides are plain shuffles.

Defined results: a text that is null or empty, or whose tokens' bytes are not the space and the text (one that holds the
mark U+2581, for one), has no tokens: zeros and an empty string. Strings of special tokens inside texts are ordinary text. Rows
that repeat a doc_id, or have none, are documents of their own and count each. An empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage
from palimpsest.llm.packing import TextIds

MARK = "▁"
#: Bytes of text in a chunk.
CHUNK_BYTES = 4_000_000


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Strings:
    """The byte strings of ids, laid end to end."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array([len(x) for x in strings])
        self.letters = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = self.sizes.cumsum() - self.sizes

    def of(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The strings of the ids, whose sizes and ends are given, as one."""
        if not len(ids):
            return self.letters[:0]
        at = np.repeat(self.offsets[ids] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.letters[at]


class Aligner:
    """Both tokenizers, the bytes of their tokens and the decimal names of ids. Each worker holds one."""

    def __init__(self, model_a: str, model_b: str, ranks_a: str | None = None) -> None:
        import sentencepiece

        self.a = TextIds(model_a, ranks_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_b)
        letters = byte_letters()
        entries = self.a.tokenizer.get_vocab(with_added_tokens=False)
        tokens = {i: bytes(letters[c] for c in t) for t, i in entries.items() if all(c in letters for c in t)}
        self.bytes_a = Strings([tokens.get(i, b"") for i in range(max(tokens) + 1)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Strings(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        )
        self.names = Strings([b"%d," % i for i in range(max(len(self.bytes_a.sizes), len(self.bytes_b.sizes)))])

    def align(self, text: str) -> tuple[int, int, str, bytes]:
        """(tokens of A, tokens of B, groups as text, links as pairs of 32-bit ids) of a text."""
        none = 0, 0, "", b""
        if not text:
            return none
        whole = np.frombuffer((" " + text).encode(), np.uint8)
        a, b = self.a.of(" " + text), np.asarray(self.b.encode_as_numpy(text, num_threads=1))
        sizes_a, sizes_b = self.bytes_a.sizes[a], self.bytes_b.sizes[b]
        ends_a, ends_b = sizes_a.cumsum(), sizes_b.cumsum()
        for strings, ids, sizes, ends in ((self.bytes_a, a, sizes_a, ends_a), (self.bytes_b, b, sizes_b, ends_b)):
            if not len(ids) or ends[-1] != len(whole) or not np.array_equal(strings.of(ids, sizes, ends), whole):
                return none
        marked = np.zeros(len(whole) + 1, bool)
        marked[ends_b] = True
        last_a = np.flatnonzero(marked[ends_a])  # the last tokens of the groups
        marked[:] = False
        marked[ends_a[last_a]] = True
        last_b = np.flatnonzero(marked[ends_b])
        links = np.stack([a[last_a], b[last_b]], 1).astype("<u4").tobytes()
        # Places of tokens where each group has its tokens of A, then those of B.
        in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - in_b, in_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, in_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        sizes = self.names.sizes[ids]
        ends = sizes.cumsum()
        groups = self.names.of(ids, sizes, ends)
        groups[ends[place_a[last_a]] - 1] = ord("|")
        groups[ends[place_b[last_b]] - 1] = ord(";")
        return len(a), len(b), groups[:-1].tobytes().decode("ascii"), links


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*models: str | None) -> Aligner:
    if models not in _ALIGNERS:
        _ALIGNERS[models] = Aligner(*models)
    return _ALIGNERS[models]


_ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, pairs binary, counts binary"


def place_type(pairs: int) -> str:
    """The type of places in a list of so many pairs."""
    return "<u1" if pairs <= 2**8 else "<u2" if pairs <= 2**16 else "<u4"


def _chunk_rows(chunk: int, docs: list[tuple]) -> pa.RecordBatch:
    """The rows of a chunk's documents, and one more with its distinct pairs and their counts."""
    import pandas as pd

    places, pairs = pd.factorize(np.frombuffer(b"".join(d[4] for d in docs), "<u8"))
    counts = np.bincount(places, minlength=len(pairs))
    edges = np.cumsum([0, *(len(d[4]) // 8 for d in docs)])
    # What follows only sums over a document's links: sorted, and with no more bytes than needed, they are small on disk.
    places = places.astype(place_type(len(pairs)))
    links = [np.sort(places[low:high]).tobytes() for low, high in zip(edges, edges[1:])]
    n, none = len(docs), [None]
    columns = [
        [chunk] * (n + 1), [d[0] for d in docs] + none, [d[1] for d in docs] + none, [d[2] for d in docs] + none,
        [len(d[4]) // 8 for d in docs] + none, [d[5] for d in docs] + none, [d[3] for d in docs] + none, links + none, [None] * n + [pairs.tobytes()], [None] * n + [counts.astype("<i8").tobytes()],
    ]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 3
    names = [f.split()[0] for f in _ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def aligned(docs: DataFrame, model_a: str, model_b: str, ranks_a: str | None = None, *, keep_groups: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents and of chunks; see _ALIGNED. `groups` has the groups' text if it is to be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(model_a, model_b, ranks_a).align
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                n_a, n_b, groups, links = align(text)
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                held.append((doc, n_a, n_b, groups if keep_groups else None, links, digest))
                size += len(text) + 100  # documents without text take room as well
                if size >= chunk_bytes:
                    yield _chunk_rows(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield _chunk_rows(chunk, held)

    return stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ALIGNED), "aligned")


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(named, counts): (chunk, place, pair) of every chunk; (pair, count, best) over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs, counts = np.frombuffer(pairs, "<i8"), np.frombuffer(counts, "<i8")
                columns = [np.fromiter(repeat(chunk, len(pairs)), np.int64, len(pairs)), np.arange(len(pairs), dtype=np.int32), pairs, counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "place", "pair", "n"])

    chunks = rows.where(F.col("pairs").isNotNull()).select("chunk", "pairs", "counts")
    named = stage(chunks.mapInArrow(run, "chunk long, place int, pair long, n long"), "pairs")
    counts = stage(named.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    piece = F.shiftrightunsigned("pair", 32)  # the id of B
    most = counts.groupBy(piece.alias("_b")).agg(F.max("count").alias("_most"))  # one row for each piece of the vocabulary
    counts = counts.withColumn("_b", piece).join(most, "_b").select("pair", "count", (F.col("count") == F.col("_most")).alias("best"))
    return named.select("chunk", "place", "pair"), stage(counts, "pair-counts")


def with_counts(rows: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and groups of the rows of aligned()."""
    named, counts = pair_counts(rows)
    known = named.join(counts, "pair").select("chunk", "place", "count", "best")
    docs = rows.where(F.col("pairs").isNull()).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def run(docs_: pa.Table, known_: pa.Table) -> pa.Table:
        at = known_.column("place").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = known_.column("count").to_numpy(), known_.column("best").to_numpy()
        links = [np.frombuffer(x, place_type(len(at))) for x in docs_.column("links").to_pylist()]
        sums = {
            "n_links": np.array([len(x) for x in links], np.int64),
            "n_best": np.array([best[x].sum() for x in links], np.int64),
            "count_sum": np.array([count[x].sum() for x in links], np.int64),
        }
        return pa.table({n: sums[n] if n in sums else docs_.column(n) for n in names})

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    return docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, fields)
