"""24-hour repeats against a plain walk through the notes of each text."""

import random
from datetime import datetime, timedelta

from palimpsest.operators import capture

START = datetime(2026, 1, 1)
SCHEMA = "id bigint, content string, created_at timestamp_ntz"


def walked(notes, hours):
    """{id: id of the stored note} by going through each text's notes in order."""
    answers, last = {}, {}
    for id_, content, at in sorted(notes, key=lambda n: (n[2] is not None, n[2] or START, n[0])):
        stored = last.get((content, at is None))
        if stored is None or (at is not None and at > stored[1] + timedelta(hours=hours)):
            stored = last[(content, at is None)] = (id_, at)
        answers[id_] = stored[0]
    return answers


def made(n, seed):
    chance = random.Random(seed)
    notes = []
    for id_ in range(n):
        content = chance.choice(["hot"] * 4 + [f"note {chance.randrange(5)}", "", None])
        seconds = chance.choice([chance.randrange(10 * 86_400), chance.randrange(20) * 43_200, -chance.randrange(3 * 86_400)])
        at = None if chance.random() < 0.03 else START + timedelta(seconds=seconds)
        notes.append((id_, content, at))
    return notes


def test_answers_equal_a_walk(spark):
    for hours, seed in ((24, 1), (1, 2)):
        notes = made(400, seed)
        frame = spark.createDataFrame(notes, SCHEMA)
        found = {r["id"]: (r["stored_id"], r["duplicate"]) for r in capture.capture_answers(frame, hours).collect()}
        expected = walked(notes, hours)
        assert found == {i: (s, i != s) for i, s in expected.items()}
        assert {r["id"] for r in capture.drop_repeats(frame, hours).collect()} == set(expected.values())


def test_the_last_second_is_silenced(spark):
    notes = [(i, "same", START + timedelta(seconds=s)) for i, s in enumerate((0, 86_400, 86_401, 2 * 86_400 + 1, 2 * 86_400 + 2))]
    found = {r["id"]: r["stored_id"] for r in capture.capture_answers(spark.createDataFrame(notes, SCHEMA)).collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_no_notes(spark):
    assert capture.capture_answers(spark.createDataFrame([], SCHEMA)).count() == 0
    assert capture.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_turn_moves_narrow_rows(spark):
    keyed = capture._keyed(spark.createDataFrame(made(50, 3), SCHEMA)).collect()
    assert {len(bytes(r["digest"]) if not isinstance(r["digest"], str) else r["digest"].encode()) for r in keyed} <= {0, 16}
    assert len({bytes(r["digest"]) for r in keyed}) == len({n[1] for n in made(50, 3)})
