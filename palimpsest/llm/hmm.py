"""A hidden Markov language model over words: Baum-Welch training and exact likelihood of whole texts.

Words are runs of characters other than ASCII white space, with A-Z in lower case; a text ends with an end token.
Counts of all words in all training texts are a table that grows with the corpus and never leaves the executors. The
model itself is bounded: the most frequent words are symbols of their own, all other known words share classes by how
they begin and end, and a word's probability is that of its class in the hidden state times its smoothed share of the
class. Training is Baum-Welch over all training texts: each task runs the scaled forward and backward recursions on
its texts, all at once, one step of time after the other, and gives expected counts by symbol, which Spark adds up.
Scores come from the forward recursion over the whole text, in double precision.

Texts are encoded once, into two bytes a token, in batches of a few megabytes. A batch lists its distinct rare words;
those lists are joined with the counts, so the join moves a row for each distinct word of a batch and not for each
token, and no word is hot. Each batch then meets its own counts and is scored.

A word that training never saw has the probability 1 / (N + V + 1) in every state, as the base model gives it, so that
score and base_score differ by what the model knows of known words.

Defined results: a null text is the empty text, which has the end token alone. A row with a null doc_id is not held
out. Rows that repeat a doc_id are scored and learned from as texts of their own. Without training texts N and V are
0, every word is unknown and both scores are 0. An empty table gives an empty table. Texts are never shortened; for
training alone they are cut into stretches of at most STRETCH tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stage
from palimpsest.llm.packing import by_size

STATES = 8
TURNS = 4
#: Words that are symbols of their own, and classes of the others. Together at most 65,535.
FREQUENT = 24_000
CLASSES = 8_192
STRETCH = 512
#: How many tokens' worth of the overall shares is added to a state's counts.
PRIOR = 500.0
BATCH_BYTES = 8_000_000
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words and the end token (empty). Bytes know no letters but A-Z and no space but ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def word_class(word: bytes) -> int:
    """The class of a word that is no symbol of its own: by its first two and last three bytes."""
    return zlib.crc32(word[:2] + b" " + word[-3:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): how often each word occurs in the texts. Each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"]
            )
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > 1_000_000:
                    yield given()
        yield given()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Bounded parameters. `symbols` maps frequent words; rows of `emit` are symbols, then classes."""

    symbols: dict[bytes, int]
    counts: np.ndarray
    class_size: np.ndarray
    tokens: int
    distinct: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def unknown(self) -> float:
        return 1.0 / (self.tokens + self.distinct + 1)


def initial(frequent: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], states: int = STATES, seed: int = 11) -> Model:
    """A model whose states differ by hashed noise. classes: by number, (count, distinct words)."""
    generator = np.random.default_rng(seed)
    counts = np.zeros(len(frequent) + CLASSES)
    counts[: len(frequent)] = [n for _, n in frequent]
    sizes = np.zeros(CLASSES)
    for k, (n, types) in classes.items():
        counts[len(frequent) + k] = n
        sizes[k] = types
    share = counts / max(1.0, counts.sum())
    emit = share[:, None] * np.exp(0.5 * generator.normal(size=(len(counts), states)))
    emit /= np.maximum(emit.sum(0), 1e-300)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(
        {w: i for i, (w, _) in enumerate(frequent)}, counts, sizes, int(counts.sum()), len(frequent) + int(sizes.sum()),
        np.full(states, 1 / states), move, emit,
    )


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of texts (batch, doc_id, held_out, symbols, rare) and, for each batch, one with its distinct rare `words`.

    symbols: two bytes a token. rare: for each token of a class, four bytes, its word's place in the batch's list.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.symbols)
    names = ["batch", "doc_id", "held_out", "symbols", "rare", "words"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = shared.value, TaskContext.get().partitionId() << 32
        first_class = len(own)
        for batch in batches:
            for part in by_size(batch, BATCH_BYTES):
                places: dict[bytes, int] = {}
                class_of: list[int] = []
                rows: list[list] = [[] for _ in names]
                for doc, text, out in zip(*(part.column(i).to_pylist() for i in (0, 1, 2))):
                    words = words_of(text)
                    symbols = np.array(list(map(own.get, words, repeat(65_535))), np.uint16)
                    at = np.flatnonzero(symbols == 65_535)
                    rare = []
                    for k in at.tolist():
                        word = words[k]
                        place = places.get(word)
                        if place is None:
                            place = places[word] = len(class_of)
                            class_of.append(first_class + word_class(word))
                        rare.append(place)
                    symbols[at] = [class_of[place] for place in rare]
                    for column, value in zip(rows, (number, doc, out, symbols.astype("<u2", copy=False).tobytes(), np.array(rare, "<u4").tobytes(), None)):
                        column.append(value)
                for column, value in zip(rows, (number, None, None, None, None, list(places))):
                    column.append(value)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")))
    fields = "batch long, doc_id long, held_out boolean, symbols binary, rare binary, words array<binary>"
    return stage(rows.mapInArrow(run, fields), "encoded")


def _in_time(sequences: list[np.ndarray]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(symbols, edges, order): all first symbols, all second ones, and so on, the longest sequence first in each.

    Step t is the slice from edges[t] to edges[t + 1]; its rows are the first ones of the step before.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([sequences[i] for i in order] or [np.zeros(0, np.int64)])
    lengths = lengths[order]
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    alive = np.bincount(step, minlength=1) if len(flat) else np.zeros(0, np.int64)
    return flat[np.argsort(step, kind="stable")].astype(np.int64), [0, *np.cumsum(alive).tolist()], order


def log_likelihood(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of symbols, by the scaled forward recursion."""
    symbols, edges, order = _in_time(sequences)
    emitted, scales = emit[symbols], np.empty(len(symbols))
    state = start[None, :]
    for t, (low, high) in enumerate(zip(edges, edges[1:])):
        state = (state[: high - low] @ move if t else state) * emitted[low:high]
        scales[low:high] = scale = state.sum(1)
        state /= scale[:, None]
    rows = np.concatenate([np.arange(high - low) for low, high in zip(edges, edges[1:])] or [np.zeros(0, np.int64)])
    result = np.zeros(len(sequences))
    result[order] = np.bincount(rows, np.log10(scales), len(sequences))
    return result


def expected_counts(sequences: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts (start, move, emit) of sequences of symbols."""
    symbols, edges, _ = _in_time(sequences)
    steps = list(zip(edges, edges[1:]))
    weights, forward = emit[symbols], np.empty((len(symbols), len(start)), emit.dtype)
    for t, (low, high) in enumerate(steps):
        state = forward[low:high]
        if t:
            np.matmul(forward[edges[t - 1] : edges[t - 1] + high - low], move, out=state)
        else:
            state[:] = start
        state *= weights[low:high]
        scale = state.sum(1)[:, None]
        state /= scale
        weights[low:high] /= scale
    moves = np.zeros(move.shape)
    later = np.ones((steps[0][1] if steps else 0, len(start)), emit.dtype)
    for t in range(len(steps) - 1, 0, -1):  # `forward` becomes the probability of each state
        low, high = steps[t]
        n, before = high - low, edges[t - 1]
        ahead = later[:n] * weights[low:high]
        moves += forward[before : before + n].T @ ahead
        forward[low:high] *= later[:n]
        later[:n] = ahead @ move.T
    first = slice(0, edges[1] if steps else 0)
    forward[first] *= later
    emits = np.stack([np.bincount(symbols, forward[:, k], len(emit)) for k in range(len(start))], 1)
    return forward[first].sum(0), moves * move, emits


def learned(model: Model, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model that expected counts give, smoothed by the overall shares."""
    share = model.counts / max(1.0, model.counts.sum())
    emit = emits + PRIOR * share[:, None]
    start, move = starts + 1.0, moves + 1.0
    return Model(
        model.symbols, model.counts, model.class_size, model.tokens, model.distinct,
        start / start.sum(), move / move.sum(1, keepdims=True), emit / np.maximum(emit.sum(0), 1e-300),
    )


def one_turn(texts: DataFrame, model: Model) -> Model:
    """One turn of Baum-Welch over all texts (symbols)."""
    states = len(model.start)
    shared = texts.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))
    columns = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = (x.astype(np.float32) for x in shared.value)
        emit = np.maximum(emit, np.float32(1e-30))
        totals = [np.zeros(states), np.zeros((states, states)), np.zeros(emit.shape)]
        for batch in batches:
            for part in by_size(batch.select([0, 0]), BATCH_BYTES // 4):
                sequences = []
                for blob in part.column(0).to_pylist():
                    symbols = np.frombuffer(blob, "<u2")
                    sequences.extend(symbols[i : i + STRETCH] for i in range(0, len(symbols), STRETCH))
                for total, found in zip(totals, expected_counts(sequences, start, move, emit)):
                    total += found
        # Symbols from 0; then a row for the start, and one for each state that is moved from.
        table = np.concatenate([totals[2], totals[0][None, :], totals[1]])
        at = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), *[pa.array(table[at, k]) for k in range(states)]], names=["at", *columns]
        )

    found = texts.select("symbols").mapInArrow(run, "at long, " + ", ".join(f"{c} double" for c in columns))
    summed = found.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    n = len(model.emit)
    table = np.zeros((n + 1 + states, states))
    table[summed.column("at").to_numpy()] = np.stack([summed.column(c).to_numpy() for c in columns], 1)
    return learned(model, table[n], table[n + 1 :], table[:n])


def _most_frequent(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """At most so many words, all those from some frequency on, by a histogram of the frequencies in small steps."""
    step = F.floor(F.log2("n") * 64)
    bars = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, None
    for bar in sorted(bars, key=lambda b: -b.step):
        total += bar.words
        if total > most:
            break
        least = bar.step
    return counts.where(step >= least) if least is not None else counts.limit(0)


def train(docs: DataFrame, states: int = STATES, turns: int = TURNS) -> tuple[Model, DataFrame, DataFrame]:
    """(model, counts of words, encoded texts). Learns from the rows that are not held out."""
    counts = stage(count_words(docs.where(~held_out(F.col("doc_id")))), "word-counts")
    top = _most_frequent(counts).toArrow()
    frequent = sorted(zip(top.column("word").to_pylist(), top.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    own = docs.sparkSession.sparkContext.broadcast({w for w, _ in frequent})

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, CLASSES), np.int64)
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in own.value:
                    sums[:, word_class(word)] += (n, 1)
            at = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["k", "n", "types"])

    rare = counts.mapInArrow(classed, "k long, n long, types long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    model = initial(frequent, {r.k: (r.n, r.types) for r in rare.collect()}, states)
    texts = encoded(docs, model)
    learning = texts.where(F.col("symbols").isNotNull() & ~F.col("held_out")).select("symbols")
    for _ in range(turns if model.tokens else 0):
        model = one_turn(learning, model)
    return model, counts, texts


def score(model: Model, counts: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of every encoded text."""
    rare = texts.where(F.col("words").isNotNull()).select("batch", F.posexplode("words").alias("at", "word"))
    known = (
        rare.join(counts, "word", "left")
        .groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("_found"))
        .select(F.col("batch").alias("of"), F.transform("_found", lambda x: x["n"]).alias("n"))
    )
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        model = shared.value
        own, unknown = len(model.symbols), model.unknown
        # Past the symbols and classes stands the unknown word, which is the same in every state.
        emit = np.concatenate([np.maximum(model.emit, 1e-300), np.ones((1, len(model.start)))])
        n_rare = np.array(found.column("n")[0].as_py() if found.num_rows else [], np.int64)
        members = model.counts[own:] + model.class_size
        sequences, extra, base, n_known, n_tokens = [], [], [], [], []
        for symbols, places in zip(rows.column("symbols").to_pylist(), rows.column("rare").to_pylist()):
            symbols = np.frombuffer(symbols, "<u2").astype(np.int64)
            seen = n_rare[np.frombuffer(places, "<u4")]
            in_class = symbols >= own
            of_word = np.empty(len(symbols))
            of_word[~in_class] = model.counts[symbols[~in_class]]
            of_word[in_class] = seen
            lost = of_word == 0
            share = np.ones(len(symbols))
            share[in_class] = (seen + 1) / np.maximum(members[symbols[in_class] - own], 1)
            share[lost] = unknown
            share[~lost] *= 1 - unknown
            symbols[lost] = len(emit) - 1
            sequences.append(symbols)
            extra.append(np.log10(share).sum())
            base.append(np.log10((of_word + 1) * unknown).sum())
            n_known.append(int((~lost).sum()))
            n_tokens.append(len(symbols))
        total = log_likelihood(sequences, model.start, model.move, emit) + np.array(extra)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(total),
            }
        )

    grouped = texts.where(F.col("symbols").isNotNull()).select("batch", "doc_id", "held_out", "symbols", "rare").groupBy("batch")
    return grouped.cogroup(known.groupBy("of")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
