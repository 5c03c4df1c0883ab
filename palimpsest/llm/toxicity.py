"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: words in lower case, without marks at their ends, and the first four and five letters
of each, which inflected and joined words share; all hashed to 32 bits. The machine has a
weight for each term and a short vector for each, and scores a text by the sum of the weights and of the products of
the vectors of all pairs of its terms. So it learns that an insult next to a group's name is worse than either, which
a sum of weights misses.

The labelled rows to learn from are at most `most_rows`, chosen by hash, so the model is bounded at any input size:
it knows the terms that at least `min_rows` of those rows hold, and whose rows are labelled 1 clearly more or less often
than others, or that have a pair whose rows are labelled 1 clearly more or less often than all rows and those of either
term. All pairs are looked at, so two terms that say nothing alone are known too if they do together. Terms are counted in
tasks, and pairs of blocks of terms are compared in tasks, by the rows that hold each term. What reaches the driver are
the known terms and each row's positions among them; training is numpy there. Each whole text is scored where it is read.

Defined results: a null or empty text has the score of the intercept. A row with a null doc_id is scored and never
learned from. Labels or documents that repeat a doc_id count as several rows; null labels are left out. A very long text is
held by one task alone and has a row of its own in what is kept for the tasks; the driver never sees it. Without any label, or with
one kind only, the score is the smoothed share of label 1 (one half without labels). Only the text is an input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import hashed_sample, stage, tiled
from palimpsest.llm.packing import by_size

MOST_ROWS = 20_000
MIN_ROWS = 5
FACTORS = 4
#: A term is kept if its rows' share of label 1 is so many standard errors from the mean.
LEAST_ERRORS = 3.0
EPOCHS = 20
#: Lengths of the beginnings of words that are terms.
STEMS = (4, 5)
MARKS = ".,;:!?\"'()[]{}<>*_`~-…«»„“”‚‘’¡¿"
KEPT_WORDS = 200_000
#: Terms whose pairs are looked at in one task, of these at once, and bytes of rows' terms that a worker turns at a time.
TILE, BLOCK, HELD_BYTES = 4_096, 256, 4_000_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by the number of folds."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def hashed_terms(word: str) -> tuple[int, ...]:
    """The hashes of a word's terms: the word without marks at its ends, and its beginnings. None for marks alone."""
    bare = word.lower().strip(MARKS)
    beginnings = (bare[:n] + "-" for n in STEMS if len(bare) >= n)
    return tuple(zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in (bare, *beginnings)) if bare else ()


class Terms:
    """The terms of texts, as positions in a sorted list of hashes, or as hashes themselves."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known = None if known is None else {int(h): i for i, h in enumerate(known)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _look_up(self, word: str) -> tuple[int, ...]:
        value = hashed_terms(word)
        if self.known is not None:
            value = tuple(self.known[h] for h in value if h in self.known)
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = value
        return value

    def of(self, text: str) -> list[int]:
        kept = self.words
        return sorted({t for w in set(text.split()) for t in (kept[w] if w in kept else self._look_up(w))})


@dataclass
class Machine:
    """score(text) = logistic(bias + sum of weights + sum over pairs of products of vectors)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts laid end to end: the score before the logistic, and the sum of each text's vectors."""
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        n = len(edges) - 1
        linear = np.bincount(owner, self.weights[at], n)
        v = self.vectors[at]
        sums = np.stack([np.bincount(owner, v[:, f], n) for f in range(v.shape[1])], 1)
        squares = np.bincount(owner, (v * v).sum(1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _positions(terms: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a row's terms are among sorted terms, without those that are not."""
    at = np.searchsorted(terms, row)
    at[at == len(terms)] = 0
    return at[terms[at] == row] if len(terms) else at[:0]


def divergence(share: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The Kullback-Leibler divergence of shares from other shares; other shares are neither 0 nor 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ones = np.where(share > 0, share * np.log(share / other), 0.0)
        return ones + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - other)), 0.0)


@dataclass(frozen=True)
class Clearness:
    """When a term or a pair of terms is clearly more, or less, often labelled 1 than other rows.

    A term is so many standard errors off. By Chernoff's bound, n rows whose share is d nats off have a chance below
    exp(-n d); a pair is clear if so little is to be expected of none of all pairs.
    """

    share: float
    least: float

    @staticmethod
    def of(rows: int, ones: int, terms: int) -> Clearness:
        return Clearness((ones + 0.5) / (rows + 1), math.log(max(2.0, terms * (terms - 1) / 2)))

    def telling(self, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        return np.abs(toxic - counts * self.share) / np.sqrt(counts * self.share * (1 - self.share)) >= LEAST_ERRORS

    def able(self) -> tuple[float, float]:
        """With fewer rows labelled 1 than the first, and fewer rows than the second, no pair is clear."""
        return self.least / -math.log(self.share), self.least / -math.log(1 - self.share)

    def clear(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """a, b: (counts, toxic) of two runs of terms; n, k: the same of each pair of them."""
        own = [(toxic + 0.5) / (counts + 1) for counts, toxic in (a, b)]
        high = np.maximum(np.maximum(own[0], self.share)[:, None], np.maximum(own[1], self.share)[None, :])
        low = np.minimum(np.minimum(own[0], self.share)[:, None], np.minimum(own[1], self.share)[None, :])
        part = k / np.maximum(n, 1)
        found = (part > high) & (n * divergence(part, high) > self.least)
        return found | (part < low) & (n * divergence(part, low) > self.least) & (n > 0)


def _held(rows: list[np.ndarray], n_rows: int) -> np.ndarray:
    """A line for each term, with 1 at the rows that hold it."""
    held = np.zeros((len(rows), n_rows), np.float32)
    for line, at in zip(held, rows):
        line[at] = 1
    return held


def clear_pairs(a: list[np.ndarray], b: list[np.ndarray], labels: np.ndarray, rule: Clearness) -> np.ndarray:
    """For each two of the terms a and b, given by the rows that hold them, whether the pair is clear."""
    held = _held(a, len(labels)), _held(b, len(labels))
    ones = np.flatnonzero(labels)
    toxic = held[0][:, ones], held[1][:, ones]
    sums = [(h.sum(1, dtype=float), t.sum(1, dtype=float)) for h, t in zip(held, toxic)]
    return rule.clear(*sums, (held[0] @ held[1].T).astype(float), (toxic[0] @ toxic[1].T).astype(float))


def telling_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, labels: np.ndarray, rule: Clearness) -> tuple[np.ndarray, np.ndarray]:
    """Which of the terms a, and which of b, are in a clear pair of both; with None for b, in a pair of two of a."""
    same = b is None
    b = a if same else b
    told = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for low in range(0, len(a), BLOCK):
        for other in range(low if same else 0, len(b), BLOCK):
            found = clear_pairs(a[low : low + BLOCK], b[other : other + BLOCK], labels, rule)
            if same and low == other:
                np.fill_diagonal(found, False)
            told[0][low : low + BLOCK] |= found.any(1)
            told[1][other : other + BLOCK] |= found.any(0)
    return (told[0] | told[1],) * 2 if same else told


def train(rows: list[list[int]], labels: np.ndarray, *, min_rows: int = MIN_ROWS, **settings) -> Machine:
    """Fits a machine to a few rows of hashed terms, all in one process."""
    labels = labels.astype(float)
    rows = [np.sort(np.asarray(r, np.uint32)) for r in rows]
    terms, counts = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_counts=True)
    terms = terms[counts >= min_rows]
    known = [_positions(terms, row) for row in rows]
    holders = [[] for _ in terms]
    for i, row in enumerate(known):
        for at in row:
            holders[at].append(i)
    rule = Clearness.of(len(rows), int(labels.sum()), len(terms))
    toxic = np.array([labels[h].sum() for h in holders])
    kept = rule.telling(np.array([len(h) for h in holders], float), toxic)
    if 0 < labels.sum() < len(labels):
        kept |= telling_pairs(holders, None, labels, rule)[0]
    known = [_positions(terms[kept], row) for row in rows]
    edges = np.cumsum([0, *map(len, known)])
    return descend(terms[kept], np.concatenate([*known, np.zeros(0, np.int64)]), edges, labels, **settings)


def descend(
    terms: np.ndarray, flat: np.ndarray, edges: np.ndarray, labels: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 1
) -> Machine:
    """Adaptive gradient steps over small batches of rows, which are laid end to end as positions among the terms."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    generator = np.random.default_rng(seed)
    vectors = generator.normal(0, 0.01, (len(terms), factors))
    machine = Machine(terms, float(np.log(share / (1 - share))), np.zeros(len(terms)), vectors)
    if not 0 < labels.sum() < len(labels):
        machine.vectors[:] = 0
        return machine
    weight_sq, vector_sq, bias_sq = np.full(len(terms), 1e-6), np.full((len(terms), factors), 1e-6), 1e-6
    rate, decay, batch = 0.1, 1e-5, 128
    for _ in range(epochs):
        order = generator.permutation(len(labels))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            at = np.concatenate([flat[edges[i] : edges[i + 1]] for i in chosen])
            lengths = edges[chosen + 1] - edges[chosen]
            raw, sums = machine.raw(at, np.concatenate([[0], np.cumsum(lengths)]))
            error = logistic(raw) - labels[chosen]
            owner = np.repeat(np.arange(len(chosen)), lengths)
            distinct, back = np.unique(at, return_inverse=True)
            pull = error[owner]
            grad = np.bincount(back, pull, len(distinct)) / len(chosen) + decay * machine.weights[distinct]
            weight_sq[distinct] += grad**2
            machine.weights[distinct] -= rate * grad / np.sqrt(weight_sq[distinct])
            own = machine.vectors[at]
            grads = pull[:, None] * (sums[owner] - own)
            grads = np.stack([np.bincount(back, grads[:, f], len(distinct)) for f in range(factors)], 1) / len(chosen)
            grads += decay * machine.vectors[distinct]
            vector_sq[distinct] += grads**2
            machine.vectors[distinct] -= 0.3 * rate * grads / np.sqrt(vector_sq[distinct])
            step = float(error.mean())
            bias_sq += step**2
            machine.bias -= rate * step / bias_sq**0.5
    return machine


def _learnable(docs: DataFrame, labels: DataFrame, most_rows: int, folds: int) -> DataFrame:
    """(row, toxic, place, terms) of the labelled texts outside the held-out fold; place orders rows by their terms."""
    learnable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    chosen = hashed_sample(learnable.select("doc_id", F.col("toxic").cast("int").alias("_toxic")), most_rows, "doc_id", "_toxic")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, row = Terms(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1)):  # one at a time: texts may be very long
                found = np.array(terms.of(text.as_py() or ""), np.uint32).tobytes()
                columns = [pa.array([row]), pa.array([toxic.as_py()], pa.int32()), pa.array([found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "toxic", "terms"])
                row += 1

    # Kept first, so that Spark knows how small this side is and does not shuffle the texts.
    rows = docs.select("doc_id", "text").join(stage(chosen, "toxicity-labels"), "doc_id").select("text", "_toxic")
    rows = rows.mapInArrow(hashed, "row long, toxic int, terms binary").withColumn("place", F.xxhash64("terms", "toxic"))
    return stage(rows.select("row", "toxic", "place", "terms"), "toxicity-rows")


def _number_type(rows: int) -> str:
    return "<u2" if rows <= 2**16 else "<i4"


def _holders(rows: DataFrame, numbers: Broadcast, marks: Broadcast) -> DataFrame:
    """(term, rows, n, k): for some of the terms' rows at a time, their numbers, how many, and how many labelled 1.

    All in one step: two steps of Python in a task have a worker each, and executors keep both and what they held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = numbers.value
        kind = np.dtype(_number_type(len(known)))
        for batch in batches:
            for part in by_size(batch, HELD_BYTES):
                at = np.searchsorted(known, part.column(0).to_numpy())
                blobs = part.column(1).to_pylist()
                owner = np.repeat(order[np.minimum(at, len(known) - 1)], [len(b) // 4 for b in blobs])
                terms = np.frombuffer(b"".join(blobs), np.uint32)
                by_term = np.argsort(terms, kind="stable")
                distinct, starts = np.unique(terms[by_term], return_index=True)
                owner, ends = owner[by_term], np.append(starts, len(terms))
                toxic = np.append(0, np.cumsum(marks.value[owner])).astype(np.int64)
                edges, owners = pa.array(ends * kind.itemsize, pa.int32()), pa.py_buffer(owner.astype(kind).tobytes())
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(distinct), [None, edges.buffers()[1], owners])
                columns = [pa.array(distinct.astype(np.int64)), lists, pa.array(np.diff(ends)), pa.array(np.diff(toxic[ends]))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "rows", "n", "k"])

    return rows.select("row", "terms").mapInArrow(run, "term long, rows binary, n long, k long")


def _kept_terms(rows: DataFrame, numbers: np.ndarray, labels: np.ndarray, min_rows: int) -> np.ndarray:
    """The sorted terms that say something, alone or in a pair; counted and compared in tasks."""
    spark = rows.sparkSession
    order = np.argsort(numbers)
    shared = spark.sparkContext.broadcast((numbers[order], order))
    marks = spark.sparkContext.broadcast(labels)
    holders, kind = _holders(rows, shared, marks), _number_type(len(numbers))
    often = holders.groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    often = stage(often.where(F.col("n") >= min_rows), "toxicity-often")
    rule = Clearness.of(len(labels), int(labels.sum()), often.count())
    off = F.abs(F.col("k") - F.col("n") * rule.share) / F.sqrt(F.col("n") * (rule.share * (1 - rule.share)))
    told = often.where(off >= LEAST_ERRORS).select("term")
    if 0 < labels.sum() < len(labels):
        few_toxic, few_rows = rule.able()
        able = stage(often.where((F.col("k") >= few_toxic) | (F.col("n") >= few_rows)).select("term"), "toxicity-able")
        # Of each term at most the numbers of all rows learned from, which are bounded.
        whole = holders.select("term", "rows").join(able, "term").groupBy("term").agg(F.collect_list("rows").alias("rows"))
        tiles = tiled(stage(whole.select(F.lit(0).alias("all"), F.col("term").alias("node"), "rows"), "toxicity-able"), "all", TILE)

        def compared(table: pa.Table) -> pa.Table:
            own = table.column("own").to_numpy()
            lists = [np.concatenate([np.frombuffer(x, kind) for x in parts]) for parts in table.column("rows").to_pylist()]
            terms = table.column("node").to_numpy()
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
            told_a, told_b = telling_pairs([lists[i] for i in a], None if low == high else [lists[i] for i in b], marks.value, rule)
            return pa.table({"term": np.concatenate([terms[a[told_a]], terms[b[told_b]]])})

        told = told.union(tiles.groupBy("low", "high").applyInArrow(compared, "term long"))
    return np.sort(told.distinct().toArrow().column(0).to_numpy()).astype(np.uint32)


def fit(
    docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, folds: int = 5, *, min_rows: int = MIN_ROWS, **settings
) -> Machine:
    """Learns from labelled rows outside the held-out fold; at most `most_rows` of them, the first by hash."""
    rows = _learnable(docs, labels, most_rows, folds)
    chosen = rows.select("place", "toxic", "row").orderBy("place", "toxic", "row").limit(most_rows).toArrow()
    numbers, marks = chosen.column("row").to_numpy(), chosen.column("toxic").to_numpy().astype(float)
    if not len(numbers):
        return descend(np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(1, np.int64), marks, **settings)
    if most_rows < rows.count():  # labels or documents that repeat an id
        rows = rows.join(rows.sparkSession.createDataFrame([(int(n),) for n in numbers], "row long"), "row", "left_semi")
    terms = _kept_terms(rows, numbers, marks, min_rows)
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, HELD_BYTES):
                found = [_positions(shared.value, np.frombuffer(t, np.uint32)).astype("<i4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["row", "at"])

    found = rows.select("row", "terms").mapInArrow(known, "row long, at binary").toArrow()
    order = np.argsort(numbers)
    places = np.empty(len(numbers), np.int64)  # the order of the chosen rows, the same on each run
    places[order[np.searchsorted(numbers[order], found.column("row").to_numpy())]] = np.arange(len(numbers))
    at = found.column("at").combine_chunks().take(pa.array(places))
    lengths = np.array([len(x.as_buffer()) // 4 for x in at], np.int64)
    flat = np.frombuffer(b"".join(x.as_buffer() for x in at), "<i4")
    return descend(terms, flat, np.concatenate([[0], np.cumsum(lengths)]), marks, **settings)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """All columns of the documents and `_score`, from 0 to 1; a column of that name is replaced."""
    docs = docs.drop("_score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)
    at, size = docs.columns.index("text"), len(docs.columns)
    names = [f"c{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        terms = Terms(model.terms)
        for batch in batches:
            rows = [terms.of(t or "") for t in batch.column(at).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
            flat = np.concatenate([np.array(r, np.int64) for r in rows])
            scores = logistic(model.raw(flat, edges)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "_score"])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return docs.toDF(*names).mapInArrow(run, f"{fields}, _score double").toDF(*docs.columns, "_score")
