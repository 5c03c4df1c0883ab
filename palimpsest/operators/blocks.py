"""Postings counted inside the task that holds the rows, and packed into blocks.

A batch of token arrays is put in order of term, row and position by one stable sort of term numbers. A block holds the
postings of one term in one batch as arrays: the rows, their lengths, and all positions, with `begins` telling where each
row's positions begin and the last ones end. A shuffle then moves a few arrays for each term and batch instead of a row for
each term and row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of a batch that are sorted at once; a longer row is a batch of its own.
BATCH_TOKENS = 1_000_000
#: The posting that every row has, with the row's length.
EVERY_ROW = ""
BLOCK = "term string, block long, row_ids array<long>, lengths array<int>, begins array<int>, positions array<int>"


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (row_id, words) with a bounded number of tokens."""
    ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
    start, before = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_TOKENS, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, ends[stop - 1]


def _counted(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and by term and row: the term's number, row, frequency; all positions in that order; and the rows' lengths."""
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if len(coded.dictionary) <= 1 << 16:
        codes = codes.astype(np.uint16)  # sorted by digits
    order = np.argsort(codes, kind="stable")
    row = np.repeat(np.arange(len(words)), lengths)
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return coded.dictionary, codes[at], row[at], np.diff(at, append=len(codes)).astype(np.int32), place[order], lengths.astype(np.int32)


def row_postings(positions: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row_id, words) to (row_id, length, term, tf, first_pos), with all positions if wanted."""
    names = ["row_id", "length", "term", "tf", "first_pos", *(["positions"] if positions else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _cut(batch):
                terms, code, row, tf, places, lengths = _counted(part.column(1))
                begins = np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)
                columns = [part.column(0).take(pa.array(row)), pa.array(lengths[row]), terms.take(pa.array(code)), pa.array(tf), pa.array(places[begins[:-1]])]
                if positions:
                    columns.append(pa.ListArray.from_arrays(pa.array(begins), pa.array(places)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _packed(terms: pa.Array, block: pa.Array, edges: np.ndarray, ids: pa.Array, lengths: np.ndarray, tf: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Blocks of terms; the postings of a term lie between two edges."""
    starts = np.concatenate([[0], np.cumsum(tf, dtype=np.int64)])
    begins = np.insert(starts[:-1], edges[1:], starts[edges[1:]]) - np.repeat(starts[edges[:-1]], np.diff(edges) + 1)

    def lists(at: np.ndarray, values) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))

    columns = [
        terms, block, lists(edges, ids), lists(edges, lengths.astype(np.int32)),
        lists(edges + np.arange(len(edges)), begins.astype(np.int32)), lists(starts[edges], places),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "row_ids", "lengths", "begins", "positions"])


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, words) to blocks of the terms and one of the empty term. A block is named by its batch's smallest row."""
    for batch in batches:
        for part in _cut(batch):
            ids = part.column(0)
            terms, code, row, tf, places, lengths = _counted(part.column(1))
            rows = len(ids)
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            first = np.flatnonzero(new)
            edges = np.concatenate([[0], rows + first, [rows + len(code)]])
            named = pa.concat_arrays([pa.array([EVERY_ROW], pa.string()), terms.take(pa.array(code[first])).cast(pa.string())])
            yield _packed(
                named, pa.array(np.full(len(named), pc.min(ids).as_py() or 0, np.int64)), edges,
                pa.concat_arrays([ids, ids.take(pa.array(row))]),
                np.concatenate([lengths, lengths[row]]), np.concatenate([np.zeros(rows, np.int32), tf]), places,
            )


def without(blocks: pa.Table, gone: pa.Table) -> pa.Table:
    """Blocks of one batch without the rows that are gone."""
    blocks = blocks.select(["term", "block", "row_ids", "lengths", "begins", "positions"])
    if not len(blocks) or not len(gone):
        return blocks
    terms, block, row_ids, lengths, begins, positions = (c.combine_chunks() for c in blocks.columns)
    ids = row_ids.flatten()
    kept = ~pc.is_in(ids, value_set=gone["row_id"].combine_chunks()).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(row_ids).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    inner = np.ones(len(ids) + len(sizes), bool)
    inner[edges[1:] + np.arange(len(sizes))] = False  # the step from a term's end to the next term's start
    tf = np.diff(begins.flatten().to_numpy(zero_copy_only=False))[inner[:-1]]
    living = np.concatenate([[0], np.cumsum(kept)])[edges]
    left = np.diff(living) > 0
    places = positions.flatten().to_numpy(zero_copy_only=False)[np.repeat(kept, tf)]
    mask = pa.array(left)
    return pa.Table.from_batches([
        _packed(
            terms.filter(mask), block.filter(mask), np.concatenate([[0], living[1:][left]]),
            ids.filter(pa.array(kept)), lengths.flatten().to_numpy(zero_copy_only=False)[kept], tf[kept], places,
        )
    ])


def postings_of_block(positions: bool) -> Column:
    """An array of (row_id, length, tf), with all positions if wanted, of a block's rows."""

    def posting(row_id: Column, i: Column) -> Column:
        begin = F.get("begins", i)
        tf = F.get("begins", i + 1) - begin
        found = [row_id.alias("row_id"), F.get("lengths", i).alias("length"), tf.alias("tf")]
        return F.struct(*found, *([F.slice("positions", begin + 1, tf).alias("positions")] if positions else []))

    return F.transform("row_ids", posting)
