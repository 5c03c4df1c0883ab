"""Quality rules, hard negatives and token alignment against plain versions, on small tables with every odd kind of row."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives, quality_rules, token_alignment, toxicity
from palimpsest.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, _row string, n_words string, kept string, chunk string, links string, groups string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILES = [tokenizer_file(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def odd_texts():
    plain = " ".join(f"the word{i}ing of" for i in range(40))
    return [
        None, "", " \n\t ", "one", "a b c a b c", plain, plain + " ###", f"{plain}\n{plain}\n{plain}", "x" * 20_000, "ab " * 30_000,
        "ünïcode ﬁ 日本語 🙂 <|endoftext|> </s> <s>", "▁ mark", "a  b   c\n\n d\t e", "\x00 nul ​ zero", "- one\n- two\n* three",
        "THE!! OF!! " * 60, "wait...\nso…\n" + plain, "don't we'll 1234567 12.5 %", "\n\n\n", " no break　space", "é" * 50,
        "﻿head", "def f(x):\n    return x  # done\n", "<0x41> <unk> Ġ Ċ", "a\r\nb\rc", "é composed", "🙂🙂🙂 👩‍👩‍👧",
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(odd_texts())) + [(5, odd_texts()[5]), (5, "other"), (None, odd_texts()[5]), (None, None)]
    return spark.createDataFrame([(i, t, "r", "n", "k", "c", "l", "g") for i, t in rows], DOCS).repartition(3)


# --- quality rules --------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    times = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bare = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_stop_words": sum(w.lower().strip(quality_rules.MARKS) in quality_rules.STOP_WORDS for w in words),
        "n_upper_words": sum(w == w.upper() and w != w.lower() for w in words),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(x.startswith(quality_rules.BULLETS) for x in bare),
        "n_ellipsis_lines": sum(x.endswith(quality_rules.ELLIPSES) for x in bare),
    }


def test_counts_and_verdicts(spark, docs):
    found = quality_rules.judged(docs)
    assert found.columns == ["doc_id", "text", "_row", "chunk", "links", "groups", *quality_rules.COUNTS, "base_failed", "failed_rules", "kept"]
    for r in found.collect():
        counts = plain_counts(r.text)
        assert {name: r[name] for name in counts} == counts, r.doc_id
        failed = [
            rule.name for rule in quality_rules.RULES
            if (rule.least is not None and 100 * counts[rule.part] < rule.least * counts[rule.whole])
            or (rule.most is not None and 100 * counts[rule.part] > rule.most * counts[rule.whole])
        ]
        base = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        assert (r.base_failed, r.failed_rules, r.kept) == (base, failed, not base and not failed)
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert 5 in kept and not kept & {0, 1, 7, 8, 9, 15}


def test_repeated_windows_by_chance(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd"[:n]) for _ in range(rng.randrange(60))) for n in (2, 3, 4) for _ in range(100)]
    rows = quality_rules.judged(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert all(r.n_repeat_words == plain_counts(texts[r.doc_id])["n_repeat_words"] for r in rows)


def test_rules_of_ones_own(spark, docs):
    assert quality_rules.judged(docs, ()).where("kept <> (NOT base_failed)").count() == 0
    none = quality_rules.judged(docs, [quality_rules.Rule("none", "n_lines", "n_words", least=100_000)])
    assert none.where("kept AND n_words > 0").count() == 0
    with pytest.raises(ValueError):
        quality_rules.judged(docs, [quality_rules.Rule("odd", "text", "n_words", most=1)])
    assert quality_rules.judged(docs.limit(0)).count() == 0


# --- hard negatives -------------------------------------------------------------------


def plain_negatives(rows, is_anchor, scale=256, most=5):
    usable = []
    for at, (vec_id, vector, label) in enumerate(rows):
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((at, vec_id, label, [min(max(math.floor(x * scale), -(2**31)), 2**31 - 1) for x in vector]))
    last = 2**63 - 1
    found = collections.Counter()
    for at, vec_id, label, ints in usable:
        if vec_id is None or not is_anchor(vec_id):
            continue
        scored = [
            (min(max(sum(a * b for a, b in zip(ints, other)), -(2**63)), 2**63 - 1), last if i is None else i, theirs)
            for n, i, theirs, other in usable if n != at and len(other) == len(ints)
        ]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, i, _ in [s for s in scored if s[2] == label][:most]:
            window = [s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:most]
            for rank, (negative, j, _) in enumerate(window, 1):
                found[vec_id, None if i == last else i, rank, None if j == last else j, score, negative] += 1
    return found


def vectors(spark, rows):
    schema = "vec_id long, embedding array<double>, label int, row long, angles int, tile string"
    return spark.createDataFrame([(*r, 1, 2, "t") for r in rows], schema).repartition(3)


def mined(frame, anchors, **settings):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return collections.Counter(tuple(r[n] for n in names) for r in hard_negatives.mine(frame, anchors, **settings).collect())


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] + rng.normal(scale=0.4, size=12)).tolist(), int(rng.integers(3))) for i in range(300)]
    rows += [(1000 + i, rows[7][1], i % 3) for i in range(60)]  # one very common vector: ties everywhere
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[7][1], 1), (None, rows[7][1], 0), (20, None, 1), (30, rows[1][1], None)]
    rows += [(40, [1.0] * 11 + [None], 1), (50, [1.0] * 11 + [math.nan], 1), (60, [1.0] * 11 + [math.inf], 1), (70, [], 1), (80, [], 2)]
    rows += [(90, [0.0] * 12, 1), (100, [0.0] * 12, 2), (110, [1e30] + [0.0] * 11, 1), (120, [1e30] + [0.5] * 11, 2), (130, [2.0], 1), (140, [1.8], 2)]
    return rows


def test_negatives_equal_brute_force(spark, odd_vectors):
    frame = vectors(spark, odd_vectors)
    found = mined(frame, F.col("vec_id") % 10 == 0, row_tile=40, anchor_tile=16)
    assert found == plain_negatives(odd_vectors, lambda i: i % 10 == 0) and len(found) > 300
    assert mined(frame.limit(0), F.col("vec_id") % 10 == 0) == {}
    assert mined(frame, F.lit(False)) == {}


def test_bounds_hold(odd_vectors):
    ints = hard_negatives.whole_numbers(np.array([r[1] for r in odd_vectors[:360]]), 256)
    axes = hard_negatives.directions(ints[:50].astype(float))
    norms = np.linalg.norm(ints.astype(float), axis=1)
    angles = np.arccos(np.clip(ints @ axes.T / norms[:, None], -1, 1))
    side = hard_negatives.Side(np.arange(360), np.arange(360), np.zeros(360), ints, norms, angles)
    low, high = hard_negatives.score_bounds(side, side)
    scores = ints.astype(np.int64) @ ints.T.astype(np.int64)
    assert (low <= scores).all() and (scores <= high).all()
    far = high < 0.8 * np.sort(scores, axis=1)[:, -5][:, None]
    assert far.mean() > 0.3  # clusters are told apart without a score


def test_single_scores_equal_products():
    rng = np.random.default_rng(1)
    for most in (100, 2**20, 2**31 - 1):
        a, b = rng.integers(-most, most, (7, 9), dtype=np.int64).astype(np.int32), rng.integers(-most, most, (30, 9), dtype=np.int64).astype(np.int32)
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -(2**63)), 2**63 - 1) for q in b] for p in a]
        for share in (0.05, 0.9):
            wanted = rng.random((7, 30)) < share
            found = hard_negatives.integer_scores(a, b, wanted)
            assert all(found[i, j] == (want[i][j] if wanted[i, j] else hard_negatives.LOWEST) for i in range(7) for j in range(30))


# --- token alignment ------------------------------------------------------------------


class PlainTokens:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(FILES[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
        self.letters = token_alignment.byte_letters()
        self.names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_a(self, i):
        return bytes(self.letters[c] for c in self.names[i])

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """(ids of A, ids of B, groups) by walking both sides byte by byte."""
        if not text:
            return [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spelled_a, spelled_b = [self.bytes_a(i) for i in a], [self.bytes_b(i) for i in b]
        if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            return [], [], []
        ends = [dict(zip(itertools.accumulate(map(len, s)), range(len(s)))) for s in (spelled_a, spelled_b)]
        found, low_a, low_b = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            high_a, high_b = ends[0][end] + 1, ends[1][end] + 1
            found.append((a[low_a:high_a], b[low_b:high_b]))
            low_a, low_b = high_a, high_b
        return a, b, found


def plain_alignment(texts):
    tokens = PlainTokens()
    cut = [tokens.groups(t) for t in texts]
    counts = collections.Counter((g[0][-1], g[1][-1]) for _, _, groups in cut for g in groups)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for a, b, groups in cut:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), digest, text


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("chunk_bytes", [1, 4_000_000])
def test_alignment_equals_plain_walk(spark, docs, chunk_bytes):
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter((r.doc_id, *w) for r, w in zip(rows, plain_alignment([r.text for r in rows])))
    found = token_alignment.with_counts(token_alignment.aligned(docs, *FILES, keep_groups=True, chunk_bytes=chunk_bytes))
    assert collections.Counter((r.doc_id, *(r[n] for n in NAMES)) for r in found.collect()) == want
    assert sum(w[1] == 0 for w in want) >= 3  # null, empty, and the text with the mark itself
    empty = token_alignment.with_counts(token_alignment.aligned(docs.limit(0), *FILES))
    assert empty.columns == ["doc_id", *NAMES] and empty.count() == 0


def test_alignment_of_random_strings():
    rng = random.Random(11)
    letters = ["a", "b", "E", "é", "日", "🙂", " ", "  ", "\n", "\t", "\r\n", "'s", ".", "12", "the ", "<|endoftext|>", " ", "　", "́", "\x00", "ing "]
    align, plain = token_alignment.Aligner(*FILES).align, PlainTokens()
    for _ in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        a, b, groups = plain.groups(text)
        found = align(text)
        assert found[:2] == (len(a), len(b)), repr(text)
        assert found[2] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), repr(text)
        assert found[3] == np.array([(x[-1], y[-1]) for x, y in groups], "<u4").tobytes()


def test_aligner_keeps_nothing_of_texts():
    """A text costs the same whether its words were met before or not."""
    aligner, plain = token_alignment.Aligner(*FILES), PlainTokens()
    text = "\n".join(" ".join(f"wo{i * 7919:x}rd,{j}" for i in range(40 * j, 40 * j + 40)) for j in range(50))
    sizes = {n: len(v) for n, v in vars(aligner).items() if hasattr(v, "__len__")}
    a, b, groups = plain.groups(text)
    assert aligner.align(text)[2] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    assert {n: len(v) for n, v in vars(aligner).items() if hasattr(v, "__len__")} == sizes


# --- terms of the toxicity classifier counted in tasks ------------------------------------


def test_terms_counted_in_tasks_equal_one_process(spark):
    rng = random.Random(2)
    rows = []
    for k in range(1_500):
        held = {w for w in "abcdefghij" if rng.random() < 0.4} | {f"rare{k}"}
        toxic = {"a", "b"} <= held if k % 50 else "z" in held
        rows.append((k + 1, " ".join(sorted(held)) + (" filler" * 20_000 if k < 3 else ""), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    machine = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    learned = frame.where(~toxicity.held_out(F.col("doc_id"))).collect()
    plain = toxicity.train([toxicity.Terms().of(r.text) for r in learned], np.array([r.toxic for r in learned]))
    assert set(machine.terms.tolist()) == set(plain.terms.tolist()) and len(machine.terms) >= 2
    scores = {r.doc_id: r["_score"] for r in toxicity.score(frame, machine).collect()}
    right = [(scores[i] >= 0.5) == bool(y) for i, _, y in rows]
    assert sum(right) > 0.97 * len(right)


def test_one_python_step_in_a_task(spark, monkeypatch):
    """Two steps of Python in one task have a worker each, which the executor keeps with what it held."""
    plans, write = [], toxicity.stage
    monkeypatch.setattr(toxicity, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    docs = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} end") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(200)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, epochs=1)
    steps = [part.count("MapInArrow") for plan in plans for part in plan.split("Exchange")]
    assert max(steps) == 1


def test_batches_of_written_tables_are_bounded(spark):
    from palimpsest.llm import common

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 40, numPartitions=1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound)
    found = [r.n for r in common.stage(texts.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) >= 40_000_000 and max(found) <= 2 * common.ARROW_BYTES
    assert spark.conf.get(bound) == before


def test_few_documents_under_one_label_id(spark):
    frame = spark.createDataFrame([(k // 30 + 1, f"text {k} {'bad' if k % 2 else 'good'}", k % 2) for k in range(300)], "doc_id long, text string, toxic int")
    machine = toxicity.fit(frame.drop("toxic"), frame.select("doc_id", "toxic").distinct(), most_rows=100)
    assert 0 < toxicity.score(frame, machine).agg(F.max("_score")).first()[0] <= 1


def test_raw_score_is_the_pairwise_sum():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(np.arange(9, dtype=np.uint32), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    texts = [[0, 3, 8], [], [1], list(range(9))]
    edges = np.cumsum([0, *map(len, texts)])
    found, _ = machine.raw(np.array(sum(texts, []), int), edges)
    for score, text in zip(found, texts):
        pairs = sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(text, 2))
        assert score == pytest.approx(0.3 + machine.weights[text].sum() + pairs)


def test_arrow_lists_cut_by_length():
    column = pa.array([[1.0, 2.0], [3.0], [4.0, 5.0], []], pa.list_(pa.float32()))
    found = {size: (at.tolist(), v.tolist()) for size, at, v in hard_negatives._by_size(column)}
    assert found == {0: ([3], [[]]), 1: ([1], [[3.0]]), 2: ([0, 2], [[1.0, 2.0], [4.0, 5.0]])}
