"""The operators against plain versions, on small tables with every odd kind of row."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, common, dart_minhash, hmm, line_dedup, merkle, mixing, packing, prefix_tokens, projection_forest, toxicity
from palimpsest.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, node string, _score double, _lines long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPM, BPE, RANKS = "piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def odd_texts():
    line = "This License Line is shared by very many of the documents here."
    base = " ".join(f"w{i}" for i in range(60))
    near = " ".join(f"w{i}" if i != 30 else "other" for i in range(60))
    return [
        None, "", " \n\t ", "one", "one two three", base, base, near, near + " tail", "ünïcode ﬁ 日本 🙂 <|endoftext|> </s>",
        "x" * 20_000, "a b " * 3_000, f"{line}\nown 1", f" {line.upper()} \nown 2", f"{line}\n{line}\nown 3", f"own 4\n{line}",
        f"{line}\t", f"{line}\nown 6\n\n", "\n\n\n",
    ]


def odd_rows():
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, "a different text under the same id"), (None, rows[5][1]), (None, None), (None, None)]
    sources = ["a", None, "b", "é", "a"]
    return [(i, t, None if k % 3 else "en", sources[k % 5], None, k, "r", None, 0.5, 7) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(rows):
    return collections.Counter((i, t or "") for i, t, *_ in rows)


# --- chat -----------------------------------------------------------------------------


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")


def test_snapshots_collapse(spark):
    log = [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(1, t, *x) for t, x in enumerate(log[:2])] + [(2, t, *x) for t, x in enumerate(log)]
    rows += [(3, t, *x) for t, x in enumerate(log)] + [(4, t, *x) for t, x in enumerate(log[:2] + [("assistant", "other")])]
    rows += [(5, 0, None, "s"), (6, 0, "system", None), (7, None, "user", "x"), (None, 0, "user", "z"), (8, 0, "system", "s"), (8, 0, "system", "s")]
    found = {r.conv_id: (r.n_turns, r.text) for r in chat.format_chats(chats(spark, [(*r, 9) for r in rows])).collect()}
    assert set(found) == {2, 4, 5, 6, 7, None}
    assert found[2] == (4, "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in log))
    assert found[5][1] == "<|user|>\ns\n<|end|>\n"


def test_long_conversation_in_parts(spark):
    rows = [(1, t, "user", f"t{t}", 0) for t in range(1000)] + [(2, t, "user", f"t{t}", 0) for t in range(700)]
    rows += [(3, t, "user", f"t{t}" if t != 600 else "changed", 0) for t in range(700)]
    found = chat.format_chats(chats(spark, rows)).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in found} == {1, 3}
    assert "".join(r.text for r in found if r.conv_id == 1) == "".join(f"<|user|>\nt{t}\n<|end|>\n" for t in range(1000))


def test_many_rows_at_few_turns_in_parts(spark):
    rows = [(None, k % 3, ("user", None)[k % 2], f"t{k:04}") for k in range(500)] + [(None, 70, "user", "later"), (None, 700, "user", None)]
    rows += [(None, None, "user", f"z{k:04}") for k in range(95)]
    rows += [(4, 0, "user", f"u{k:04}") for k in range(40)] + [(5, 0, "user", "short"), (5, 64, "user", "short")]
    found = chat.format_chats(chats(spark, [(*r, 9) for r in rows]).repartition(5), part_rows=40).collect()
    assert max(r.n_turns for r in found) == 40 and len({(r.conv_id, r.part) for r in found}) == len(found)
    for conv in (None, 4, 5):
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[2] is not None, r[2] or ""))
        whole = "".join(r.text for r in sorted((r for r in found if r.conv_id == conv), key=lambda r: r.part))
        assert whole == "".join(f"<|{role or 'user'}|>\n{text or ''}\n<|end|>\n" for _, role, text in own)
    assert [r.part for r in sorted((r for r in found if r.conv_id == 5), key=lambda r: r.part)] == [0, 1]


def test_no_conversations(spark):
    assert chat.format_chats(chats(spark, [])).count() == 0


# --- token counts ---------------------------------------------------------------------


def test_counts_at_every_prefix(docs, none):
    import sentencepiece

    model = tokenizer_file(SPM)
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    found = prefix_tokens.prefix_table(docs, model, budget=5).collect()
    assert len(found) == len(odd_rows())
    totals = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found)
    assert totals == collections.Counter((i, len((t or "").encode()), len(processor.encode(t or ""))) for i, t, *_ in odd_rows())
    counter = prefix_tokens.counter(model)
    for text in (t for t in odd_texts() if t and len(t) < 500):
        changes, _ = counter.table(text)
        counts = np.cumsum(np.frombuffer(changes, np.int8))
        want = [len(processor.encode(text[: n + 1])) for n in range(len(text))]
        assert counts.tolist() == want
        assert prefix_tokens.last_within(changes, 5) == max([n + 1 for n, c in enumerate(want) if c <= 5], default=0)
    assert prefix_tokens.prefix_table(none, model, budget=5).count() == 0


def test_stored_table_answers(docs):
    table = prefix_tokens.prefix_table(docs.where("doc_id = 8"), tokenizer_file(SPM), budget=9)
    row = table.select(
        "fits", prefix_tokens.truncated(F.col("changes"), F.lit(9)).alias("t"), prefix_tokens.tokens_of_prefix(F.col("changes"), F.col("fits")).alias("n")
    ).first()
    assert row.fits == row.t and row.n <= 9


# --- line dedup -----------------------------------------------------------------------


def plain_line_dedup(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    shared = {k: max(i for i in ids if i is not None) for k, ids in holders.items() if len(ids) >= 5}
    found = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if shared.get(key(x), i) == i]
        found.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return collections.Counter(found)


def test_shared_lines_go(docs, none):
    found = line_dedup.drop_shared_lines(docs)
    assert collections.Counter((r.doc_id, r.text, r["_lines"], r["_dropped"]) for r in found.collect()) == plain_line_dedup(odd_rows())
    assert found.select("_row", "_id").distinct().count() == len(odd_rows())
    assert line_dedup.drop_shared_lines(none).count() == 0


def test_lines_of_other_letters(spark):
    rows = [(i, "É" * 40 if i % 2 else "é" * 40) for i in range(9)] + [(i, "ABC é " * 9) for i in range(9, 15)]
    rows = [(*r, None, None, None, 0, "", "", 0.0, 0) for r in rows]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert collections.Counter((r.doc_id, r.text, r["_lines"], r["_dropped"]) for r in found) == plain_line_dedup(rows)


# --- mixing ---------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rate = left / sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and rate * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: rate * weight[s] for s in names if s not in full}
        for s in over:
            full.add(s)
            target[s] = most * sizes[s]
            left -= target[s]


def test_targets_are_met(docs, none):
    documents, schedule = mixing.mix(docs, block_words=16)
    found = mixing.taken(documents, schedule).collect()
    assert collections.Counter((r.doc_id, r["_source"], r["_size"]) for r in found) == collections.Counter(
        (r[0], r[3], len(WORD.findall(r[1] or ""))) for r in odd_rows()
    )
    sizes = collections.Counter()
    for r in odd_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = plain_targets(sizes)
    took = collections.Counter()
    for r in found:
        assert r["_taken"] <= 2 * r["_size"] and math.isclose(r["_target"], targets[r["_source"]], rel_tol=1e-9)
        took[r["_source"]] += r["_taken"]
    assert all(targets[s] - 1 <= took[s] <= targets[s] for s in sizes)
    assert mixing.taken(*mixing.mix(none)).count() == 0
    again = collections.Counter((r.doc_id, r["_size"], r["_taken"]) for r in mixing.taken(*mixing.mix(docs.repartition(5), block_words=16)).collect())
    assert again == collections.Counter((r.doc_id, r["_size"], r["_taken"]) for r in found)


def test_schedule_is_even(spark):
    rows = [(i, "w " * 64, None, "abc"[i % 3], 0, 0, "", "", 0.0, 0) for i in range(90)]
    _, schedule = mixing.mix(spark.createDataFrame(rows, DOCS), block_words=64)
    steps = sorted((r["_step"], r["_no"], r["_rank"]) for r in schedule.collect())
    shares = collections.Counter(no for _, no, _ in steps)
    seen = collections.Counter()
    for k, (_, no, rank) in enumerate(steps):
        assert rank == seen[no]
        seen[no] += 1
        assert all(abs(seen[s] - (k + 1) * shares[s] / len(steps)) <= 8 for s in shares)


def test_mixed_texts(docs):
    found = mixing.mixed(docs, block_words=16)
    assert found.columns == docs.columns
    took = collections.Counter()
    for r in mixing.taken(*mixing.mix(docs, block_words=16)).collect():
        took[r["_source"]] += r["_taken"]
    got = collections.Counter()
    originals = texts_of(odd_rows())
    for r in found.collect():
        got[r.source] += len(WORD.findall(r.text))
        assert any(t.startswith(r.text) for i, t in originals if i == r.doc_id)
    assert got == +took


# --- language model -------------------------------------------------------------------


def tiny_model():
    return hmm.initial([(b"a", 5), (b"b", 3), (hmm.END, 2)], {4: (2, 2)}, states=3)


def test_forward_is_the_sum_over_paths():
    model = tiny_model()
    for sequence in ([0], [1, 0, 2], [0, 1, 1, 7, 2]):
        total = 0.0
        for path in np.ndindex(*[3] * len(sequence)):
            p = model.start[path[0]] * model.emit[sequence[0], path[0]]
            for t in range(1, len(sequence)):
                p *= model.move[path[t - 1], path[t]] * model.emit[sequence[t], path[t]]
            total += p
        found = hmm.log_likelihood([np.array(sequence), np.array([0, 0])], model.start, model.move, model.emit)[0]
        assert math.isclose(found, math.log10(total), rel_tol=1e-12)


def test_baum_welch_counts_are_expectations():
    model, sequence = tiny_model(), [0, 1, 7, 2]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros(model.emit.shape)
    weights = []
    for path in np.ndindex(3, 3, 3, 3):
        p = model.start[path[0]] * model.emit[sequence[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[sequence[t], path[t]]
        weights.append((path, p))
    total = sum(p for _, p in weights)
    for path, p in weights:
        start[path[0]] += p / total
        for t in range(4):
            emit[sequence[t], path[t]] += p / total
            if t:
                move[path[t - 1], path[t]] += p / total
    for found, want in zip(hmm.expected_counts([np.array(sequence)], model.start, model.move, model.emit), (start, move, emit)):
        assert np.allclose(found, want)


def test_scores(docs, none):
    low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")
    words = [(i, WORD.findall(low(t)) + [""]) for i, t, *_ in odd_rows()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in words if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter(
        (i, out(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words
    )
    model, table, texts = hmm.train(docs, turns=2)
    assert (model.tokens, model.distinct) == (n, v)
    assert math.isclose(model.emit.sum(0).min(), 1) and math.isclose(model.move.sum(1).max(), 1)
    found = hmm.score(model, table, texts).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == want
    assert all(r.score <= 0 for r in found)
    assert hmm.score(*hmm.train(none)).count() == 0


def test_model_beats_the_base(spark):
    generator = random.Random(3)
    rows = []
    for i in range(300):
        words = [f"{'abcd'[i % 4]}{generator.randrange(40)}" for _ in range(80)]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = hmm.score(*hmm.train(docs)).where("held_out").collect()
    assert sum(r.score > r.base_score for r in found) > 0.95 * len(found)


# --- embeddings -----------------------------------------------------------------------


def plain_links(rows, least=0.93):
    units = []
    for _, vector, label in rows:
        bad = vector is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector) or not any(vector)
        scaled = None if bad else np.array(vector) / np.abs(vector).max()
        units.append(None if bad else scaled / np.linalg.norm(scaled))
    links = [
        [j for j in range(len(rows)) if j != i and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least]
        if units[i] is not None else []
        for i in range(len(rows))
    ]
    names = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([names[i], *(names[j] for j in near)])
            changed |= low != names[i]
            names[i] = low
    of = collections.defaultdict(list)
    for i, k in enumerate(names):
        of[k].append(rows[i][0])
    lowest = {k: min((x for x in ids if x is not None), default=None) for k, ids in of.items()}
    return collections.Counter((rows[i][0], len(links[i]), lowest[names[i]]) for i in range(len(rows)))


def test_vectors(spark, monkeypatch):
    generator = np.random.default_rng(5)
    rows = [(i, generator.normal(size=16).tolist(), i % 3) for i in range(400)]
    for i in range(200):  # chains of near copies
        base = np.array(rows[int(generator.integers(len(rows)))][1])
        rows.append((400 + i, (base + generator.normal(size=16) * 0.08).tolist(), i % 3))
    rows += [(700 + i, rows[7][1], 1) for i in range(40)] + [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[7][1], 1)]
    rows += [(800, None, 1), (801, [], 1), (802, [0.0] * 16, 1), (803, [float("nan")] * 16, 1), (804, [None] * 16, 1), (805, [1.0, 2.0], 1), (806, [2.0, 4.0], 1), (807, rows[7][1], None), (808, [1e300] * 16, 1), (809, [1e299] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    monkeypatch.setattr(projection_forest, "SAMPLE_LEAF", 32)
    found = projection_forest.near_duplicates(frame.repartition(3)).collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in found) == plain_links(rows)
    assert projection_forest.near_duplicates(frame.limit(0)).count() == 0


def test_tiles_and_deep_leaves_lose_nothing(spark):
    generator = np.random.default_rng(6)
    base = generator.normal(size=8)
    rows = [(i, (base + generator.normal(size=8) * 0.02).tolist(), 0) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = projection_forest.vectors_of(frame)
    forests = projection_forest.fitted(nodes, 1, leaf=64)
    cells = projection_forest.dealt(nodes, forests, leaf_rows=40)
    links = projection_forest.links_in_cells(cells, tile=16)
    assert links.count() < 300 * 60  # no pairs of all with all
    members = nodes.select(F.lit(b"x").alias("component"), "node", "vector", F.lit(1).cast("long").alias("copies"))
    assert {r.links for r in projection_forest.links_counted(members, tile=16).collect()} == {299}


def test_small_leaves_keep_pairs_together(spark):
    generator = np.random.default_rng(8)
    near = generator.normal(size=(2000, 64))
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    away = generator.normal(size=near.shape)
    away -= (away * near).sum(1, keepdims=True) * near
    far = 0.931 * near + (1 - 0.931**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([near, far]))]
    nodes = projection_forest.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).cache()
    cells = projection_forest.cells_of(nodes, leaf_rows=48)
    held = cells.join(nodes, "node").groupBy("cell").agg(F.collect_list("vec_id").alias("ids")).collect()
    assert sum(len(r.ids) > 48 for r in held) < 0.2 * len(held)  # leaves were cut
    met = {i for r in held for i in set(r.ids) if i < 2000 and i + 2000 in set(r.ids)}
    assert len(met) >= 1996


def test_whole_labels_where_trees_do_not_hold(spark, monkeypatch):
    rows = [(i, np.random.default_rng(i).normal(size=16).tolist(), i % 2) for i in range(600)]
    nodes = projection_forest.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    monkeypatch.setattr(projection_forest, "MOST_TURNS", 0)
    assert {r["count"] for r in projection_forest.cells_of(nodes).groupBy("cell").count().collect()} == {300}


# --- packing --------------------------------------------------------------------------


def test_best_fit_decreasing_is_the_plain_one():
    generator = random.Random(2)
    for _ in range(200):
        capacity = generator.choice([7, 64, 100])
        lengths = [generator.randint(1, capacity) for _ in range(generator.randint(0, 150))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fitting = [(room, i) for i, room in enumerate(bins) if room >= n]
            if fitting:
                bins[min(fitting)[1]] -= n
            else:
                bins.append(capacity - n)
        groups = packing.best_fit(collections.Counter(lengths), capacity)
        assert sorted(bins) == sorted(capacity - sum(n * k for n, k in held) for times, held in groups for _ in range(times))


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(BPE))
    cut = packing.pieces(docs, tokenizer_file(BPE), tokenizer_file(RANKS), capacity=64)
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in cut.collect()) == want
    found = packing.pack(cut.drop("ids"), capacity=64).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in found) == collections.Counter(
        k[:4] for k, n in want.items() for _ in range(n)
    )
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(none, tokenizer_file(BPE)).drop("ids")).count() == 0


def test_fast_encoder_gives_the_same_ids():
    plain, both = packing.TextIds(tokenizer_file(BPE)), packing.TextIds(tokenizer_file(BPE), tokenizer_file(RANKS))
    generator = random.Random(4)
    letters = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA1, 0x250), 0x2013, 0x201C, 0x20AC)]
    texts = ["".join(generator.choices(letters, k=generator.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(generator.choices("ab's .,\n tlldRE019", k=30)) for _ in range(3000)]
    assert all((plain.of(t) == both.of(t)).all() for t in [*texts, *(t or "" for t in odd_texts())])


# --- fingerprints ---------------------------------------------------------------------


def test_fingerprints(docs, none):
    rows = sorted(((i, t or "") for i, t, *_ in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = collections.Counter()
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()] += 1
    frame = merkle.compared(docs).select("*", merkle.fingerprint("own").alias("print"), merkle.fingerprint("edit").alias("edit_print"))
    found = frame.collect()
    assert collections.Counter((r.doc_id, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in found) == want
    prints = collections.defaultdict(set)
    for r in found:
        prints[r["_text"]].add(r["print"])
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    same = frame.select(merkle.tree_of(F.col("print")).alias("a"), F.col("own_clauses").alias("b")).where("a <> b").count()
    assert same == 0
    assert merkle.compared(none).count() == 0
    one = merkle.compared(docs.where("doc_id = 8")).first()
    assert one.next_root == one.own_root or one.next_root is None


def test_likeness_and_places(spark):
    a = "\n".join(f"paragraph {i} has its own words, and a second clause {i * 7}." for i in range(200))
    b = a.replace("paragraph 90 has", "paragraph 90 had")
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    frame = merkle.with_tree(merkle.with_tree(frame, "a", "a"), "b", "b")
    row = frame.select(
        merkle.likeness(merkle.root("a"), F.col("a_clauses"), merkle.root("b"), F.col("b_clauses")).alias("near"),
        merkle.differing_sections(F.col("a_sections"), F.col("b_sections")).alias("at"),
        F.size("a_sections").alias("n"),
    ).first()
    assert 0.98 < row.near < 1 and len(row.at) <= 2 and row.n > 5


# --- near duplicates ------------------------------------------------------------------


def plain_classes(rows, least=0.8):
    sets = []
    for _, t, *_ in rows:
        words = WORD.findall(t or "")
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else None)
    names = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and names[j] < names[i] and len(a & b) >= least * len(a | b):
                    names[i], changed = names[j], True
    ids = collections.defaultdict(set)
    for i, k in enumerate(names):
        ids[k].add(rows[i][0])
    return collections.Counter(
        (rows[i][0], min((x for x in ids[k] if x is not None), default=None) if sets[i] else rows[i][0]) for i, k in enumerate(names)
    )


def varied_rows():
    generator = random.Random(8)
    rows, base = odd_rows(), [f"v{k}" for k in range(200)]
    for i in range(100, 160):  # a group of near copies, each with a few words of its own
        words = list(base)
        for _ in range(generator.randint(0, 4)):
            words[generator.randrange(200)] = f"n{generator.random()}"
        rows.append((i, " ".join(words), *rows[0][2:]))
    for i in range(160, 200):  # half shared, half not
        rows.append((i, " ".join(base[:100] + [f"{i}q{k}" for k in range(100)]), *rows[0][2:]))
    return rows


def test_near_copies(spark, none):
    rows = varied_rows()
    frame = spark.createDataFrame(rows, DOCS).repartition(4)
    found = dart_minhash.near_duplicates(frame).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in found) == plain_classes(rows)
    kept = dart_minhash.one_of_each(frame)
    assert kept.columns == frame.columns
    with_words = [r for r in kept.collect() if WORD.search(r.text or "")]
    assert len(with_words) == len({r.component for r in found if r.component is not None})
    assert dart_minhash.near_duplicates(none).count() == 0 and dart_minhash.one_of_each(none).count() == 0


def test_tiles_are_bounded_by_weight(spark):
    rows = [(1, f"n{k}".encode(), 50 if k % 10 == 0 else 1) for k in range(400)] + [(2, b"x", 5), (2, b"y", 5), (3, b"z", 9)]
    frame = spark.createDataFrame(rows, "bucket long, node binary, held int")
    found = common.tiled(frame, "bucket", 200, F.col("held")).collect()
    assert {r.bucket for r in found} == {1, 2}  # a row alone has no pairs
    own = collections.Counter()
    for node, tile, held in {(bytes(r.node), r.own, r.held) for r in found if r.bucket == 1}:
        own[tile] += held
    assert len(own) == -(-(40 * 50 + 360) // 200) and max(own.values()) < 600
    met = collections.defaultdict(set)
    for r in found:
        met[r.bucket, r.low, r.high].add((bytes(r.node), r.own))
    pairs = collections.Counter(
        (b, x, y) for (b, low, high), held in met.items() for (x, i), (y, j) in itertools.combinations(sorted(held), 2) if low == high or i != j
    )
    assert set(pairs.values()) == {1} and len(pairs) == 400 * 399 // 2 + 1


def test_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "TILE_BYTES", 1 << 14)
    monkeypatch.setattr(dart_minhash, "FEW", 0)  # one turn with pivots, all others in tiles
    rows = varied_rows()
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in found) == plain_classes(rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_the_similarity(weighted):
    generator = random.Random(1)
    shingler = dart_minhash.Shingler()
    errors = []
    for _ in range(30):
        a = [f"w{generator.randrange(40) if weighted else k}" for k in range(300)]
        b = list(a)
        for _ in range(generator.randint(0, 40)):
            b[generator.randrange(300)] = f"z{generator.random()}"
        texts = [" ".join(x) for x in (a, b)]
        elements, edges = shingler.of(texts, weighted)
        times = dart_minhash.signatures(elements, edges, 400)
        assert np.isfinite(times).all()
        x, y = (collections.Counter(tuple(t[k : k + 5]) for k in range(296)) for t in (a, b))
        if not weighted:
            x, y = collections.Counter(set(x)), collections.Counter(set(y))
        errors.append((times[0] == times[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12


# --- toxicity -------------------------------------------------------------------------


def test_machine_learns_pairs():
    generator = random.Random(7)
    words = {w: toxicity.hashed_terms(w)[0] for w in ("insult", "group", *(f"n{k}" for k in range(50)))}
    rows, labels = [], []
    for _ in range(3000):
        held = {f"n{generator.randrange(50)}" for _ in range(8)} | {w for w in ("insult", "group") if generator.random() < 0.4}
        rows.append(sorted(words[w] for w in held))
        labels.append(int({"insult", "group"} <= held))
    machine = toxicity.train(rows, np.array(labels))
    known = {int(t): i for i, t in enumerate(machine.terms)}
    at = {w: known[h] for w, h in words.items() if h in known}
    a, b = at["insult"], at["group"]
    both, _ = machine.raw(np.array([a, b]), np.array([0, 2]))
    each, _ = machine.raw(np.array([a, b]), np.array([0, 1, 2]))
    assert toxicity.logistic(both)[0] > 0.9 and (toxicity.logistic(each) < 0.2).all()
    assert machine.vectors[a] @ machine.vectors[b] > 1


def test_pairs_of_terms_neutral_alone(spark):
    generator = random.Random(3)
    rows = []
    for k in range(10_000):  # a and b alone are as often toxic as all rows
        held = {f"n{generator.randrange(300)}" for _ in range(40)}
        held |= {"a", "b"} if k < 75 else {"a"} if k < 2500 else {"b"} if k < 4925 else {"slur"} if k < 5150 else set()
        rows.append((sorted(toxicity.hashed_terms(w)[0] for w in held), int(k < 75 or 4925 <= k < 5150)))
    generator.shuffle(rows)
    machine = toxicity.train([r for r, _ in rows[2000:]], np.array([y for _, y in rows[2000:]]))
    known = {int(t): i for i, t in enumerate(machine.terms)}
    a, b = (toxicity.hashed_terms(w)[0] for w in "ab")
    for row, y in rows[:2000]:
        at = np.array([known[t] for t in row if t in known], int)
        score = toxicity.logistic(machine.raw(at, np.array([0, len(at)]))[0])[0]
        if a in row or b in row:
            assert (score >= 0.5) == bool(y)


def test_scores_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, None if i % 5 == 4 else i % 3 % 2) for i in range(20)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(docs, labels)
    found = toxicity.score(docs, machine)
    assert found.columns == [c for c in docs.columns if c != "_score"] + ["_score"]
    assert texts_of([(r.doc_id, r.text) for r in found.collect()]) == texts_of(odd_rows())
    assert all(0 <= r["_score"] <= 1 for r in found.collect())
    assert toxicity.score(none, machine).count() == 0
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r["_score"] for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, "bad word" if zlib.crc32(str(i).encode()) % 5 == 0 else "good word") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.startswith("bad"))) for i, t in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    assert not machine.weights.any()

