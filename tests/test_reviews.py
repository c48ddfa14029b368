"""Logs of reviews against a review that is walked step by step."""

import random

from quire.operators import reviews as R

LOG, ASKED = "book_id long, seq long, action string, id string", "book_id long, place int, id string, action string"


def walk(n, actions):
    """A review as it runs: answers by place, and whether it ended."""
    at, given = 0, {}
    for a in actions:
        if a == "back":
            at = max(at - 1, 0)
        elif a in ("all", "none"):
            return given | dict.fromkeys(range(at, n), a == "all"), True
        elif a in ("yes", "no"):
            given[at] = a == "yes"
            at += 1
            if at == n:
                return given, True
    return given, False


def test_answers(spark):
    rng = random.Random(4)
    sizes = {b: rng.randint(0, 7) for b in range(150)}
    logs = {b: rng.choices(["yes", "no", "back", "all", "none", "?", None], [8, 8, 7, 1, 1, 1, 1], k=rng.randint(0, 25)) for b in [*range(140), 900]}
    log = [(b, i * 3, a, "x") for b, acts in logs.items() for i, a in enumerate(acts)]
    rng.shuffle(log)
    asked = [(b, p, f"{b}:{p}", "y") for b, n in sizes.items() for p in range(n)]
    got = R.reduce_answers(spark.createDataFrame(log, LOG), spark.createDataFrame(asked, ASKED))
    rows = got.collect()
    assert len(rows) == len(asked)
    for r in rows:
        given, ended = walk(sizes[r.book_id], logs.get(r.book_id, []))
        assert (r.is_title, r.finished) == (given.get(r.place), ended), r
    decided = {(r.book_id, r.id): r.is_title for r in R.decisions_of(got).collect()}
    want = {(b, f"{b}:{p}"): yes for b, n in sizes.items() if n and walk(n, logs.get(b, []))[1] for p, yes in walk(n, logs[b])[0].items()}
    assert decided == want and len(want) > 50


def test_going_back_and_the_rest(spark):
    """Answers that were given before going back are overwritten by an answer for the rest."""
    asked = spark.createDataFrame([(1, p, str(p), "") for p in range(4)], ASKED)
    log = spark.createDataFrame([(1, i, a, "") for i, a in enumerate(["back", "yes", "yes", "yes", "back", "back", "none", "yes"])], LOG)
    assert [r.is_title for r in R.reduce_answers(log, asked).orderBy("place").collect()] == [True, False, False, False]
    empty = R.reduce_answers(log.limit(0), asked)
    assert {(r.is_title, r.finished) for r in empty.collect()} == {(None, False)}
    assert R.reduce_answers(log, asked.limit(0)).count() == 0
