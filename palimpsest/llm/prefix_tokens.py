"""Exact token counts at every prefix of a text.

A byte-pair encoding has a property that makes the counts a dynamic program: whatever the first tokens of an
encoding spell is itself encoded as those tokens. So the encoding of a prefix is the encoding of a shorter prefix
and one more token, and that token is the only one that ends there and may follow the shorter prefix's last token.
A pair of tokens may follow one another if the text of both is encoded as these two.

No piece of the model continues past the beginning of a new word or over a line break, so the program runs once for
each distinct word, and a text is put together from its words. For each code point the table keeps one signed byte,
the change in the count, so a text of n code points has a table of n bytes: a prefix's count is a sum, and a budget is
met at the last prefix whose count does not exceed it. Nothing is encoded again.

Characters that the vocabulary lacks count one token for each of their UTF-8 bytes, as the model's byte pieces do.

Defined results: a null text is the empty text, with no tokens and an empty table. Rows pass one by one, so repeated
rows, null ids and very long texts (bounded by the row itself) need no special care. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a worker keeps in each of two generations, and pairs of pieces.
KEPT_WORDS = 600_000
KEPT_PAIRS = 1_000_000
#: Longer words (texts without spaces) are worked out each time.
LONGEST_KEPT = 64


class PrefixCounter:
    """The counts for one model file. Each worker holds one."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        odd = (processor.is_control, processor.is_unknown, processor.is_byte, processor.is_unused)
        self.scores = {
            processor.id_to_piece(i): processor.get_score(i)
            for i in range(processor.get_piece_size())
            if not any(f(i) for f in odd)
        }
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.scores):
            raise ValueError("a piece of this model spans words or lines")
        # A vocabulary may hold pieces that no merges lead to.
        self.pieces = {p for p in self.scores if self._merged(p) == [p]}
        ends: dict[str, set[int]] = {}
        for piece in self.pieces:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {character: tuple(sorted(found)) for character, found in ends.items()}
        # A dummy space begins a text, if the model has it.
        self.lead = MARK if processor.encode("a", out_type=str)[0].startswith(MARK) else ""
        # Two generations of words: when the newer is full it becomes the older, so frequent words stay.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cut = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")

    def _merged(self, text: str) -> list[str]:
        """The encoding by its definition: the best-scored neighbours become one, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, left: str, right: str) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return fits

    def word(self, word: str) -> bytes:
        """The change of the count at each character of a word (a run without a break inside)."""
        changes = self.older.get(word)
        if changes is None:
            changes = self._changes(word)
        if len(word) <= LONGEST_KEPT:
            if len(self.words) >= KEPT_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = changes
        return changes

    def _changes(self, word: str) -> bytes:
        pieces, pairs, lengths = self.pieces, self.pairs, self.lengths
        counts, lasts, changes = [0], [""], []
        for end, character in enumerate(word, 1):
            count, last = 0, ""
            if character not in lengths:  # spelled in bytes; nothing joins with it
                count = counts[-1] + len(character.encode("utf-8", "surrogatepass"))
            else:
                for n in lengths[character]:
                    if n > end:
                        break
                    piece = word[end - n : end]
                    if piece in pieces:
                        before = lasts[end - n]
                        fits = not before or pairs.get((before, piece))
                        if fits is None:
                            fits = self._may_follow(before, piece)
                        if fits:
                            count, last = counts[end - n] + 1, piece
                            break
            changes.append((count - counts[-1]) & 255)
            counts.append(count)
            lasts.append(last)
        return bytes(changes)

    def table(self, text: str) -> tuple[bytes, int]:
        """(changes, tokens): a signed byte for each code point, and the count of the whole text."""
        if not text:
            return b"", 0
        words = self.cut.findall(self.lead + text.replace(" ", MARK))
        kept, slow = self.words.get, self.word
        parts = [kept(w) or slow(w) for w in words]
        changes = np.frombuffer(b"".join(parts), np.int8)
        if self.lead:  # the dummy space counts with the first character
            total = int(changes.sum(dtype=np.int64))
            changes = changes[1:].copy()
            changes[0] += total - int(changes.sum(dtype=np.int64))
        return changes.tobytes(), int(changes.sum(dtype=np.int64))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def prefix_table(docs: DataFrame, model: str, *, budget: int, keep_table: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits (code points of the longest prefix within the budget), and the table.

    `changes` is binary with a signed byte for each code point; see tokens_of_prefix().
    """
    fields = "doc_id long, n_bytes long, n_tokens long, fits long" + ", changes binary" * keep_table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            sizes, tokens, fits, tables = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                changes, total = count.table(text)
                sizes.append(len(text.encode()))
                tokens.append(total)
                fits.append(len(text) if total <= budget else last_within(changes, budget))
                tables.append(changes)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.int64())]
            if keep_table:
                columns.append(pa.array(tables, pa.binary()))
            names = ["doc_id", "n_bytes", "n_tokens", "fits", "changes"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def last_within(changes: bytes, budget: int) -> int:
    """The length in code points of the longest prefix that has at most so many tokens."""
    counts = np.cumsum(np.frombuffer(changes, np.int8), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def tokens_of_prefix(changes: Column, length: Column) -> Column:
    """The tokens of the first `length` code points, from a stored table."""

    @F.pandas_udf("long")
    def at(tables, lengths):
        import pandas as pd

        return pd.Series([int(np.frombuffer(t, np.int8)[: max(0, n)].sum(dtype=np.int64)) for t, n in zip(tables, lengths)])

    return at(changes, length)


def truncated(changes: Column, budget: Column) -> Column:
    """The length of the longest prefix within a budget of tokens, from a stored table."""

    @F.pandas_udf("long")
    def at(tables, budgets):
        import pandas as pd

        return pd.Series([last_within(t, b) for t, b in zip(tables, budgets)])

    return at(changes, budget)
