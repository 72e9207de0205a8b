"""Range states by composed maps equal the fold, event by event, for any span of blocks and skewed clients."""

import random

import pytest

from hanmaru.streaming.keys import Ranges
from hanmaru.streaming.ranges import range_states, range_states_at

SCHEMA = "client_id string, seq long, kind string, loc long, len long, text_len long"


def some_events():
    rng = random.Random(4)
    rows = [("hot", i + 7, rng.choice(["begin", "sync", "insert", "clear", "clear", "finish", "other"]), rng.choice([None, 3, 9]), rng.randrange(4), rng.randrange(3)) for i in range(700)]
    rows += [(f"c{c}", rng.randrange(300) * 20 + i - 3000, rng.choice(["begin", "sync", "insert", "clear"]), rng.choice([None, 5]), 1, 2) for c in range(12) for i in range(9)]
    return rows


def folded(rows):
    out = {}
    for client in {r[0] for r in rows}:
        s = Ranges()
        for _, seq, kind, loc, size, n in sorted(r for r in rows if r[0] == client):
            place = None if loc is None else (loc, size)
            if kind == "begin":
                if s.mode == "none":
                    s.mode, s.loc, s.len = "initial-selection", loc, size
            elif kind == "sync":
                s.sync(place)
            elif kind == "insert":
                s.inserted(place, n)
            elif kind == "finish":
                s.finish()
            elif kind == "clear" and s.mode == "client-marked":
                s.mode, s.len = "initial-selection", 0
            out[client, seq] = s.mode, s.loc, s.len
    return out


@pytest.mark.parametrize("span", [64, 512])
def test_maps_equal_the_fold(spark, span):
    rows = some_events()
    events, want = spark.createDataFrame(rows, SCHEMA), folded(rows)
    assert {(r.client_id, r.seq): (r.mode, r.loc, r.len) for r in range_states_at(events, span).collect()} == want
    last = {c: want[c, max(s for d, s in want if d == c)] for c, _ in want}
    assert {r.client_id: (r.mode, r.loc, r.len) for r in range_states(events, span).collect()} == last


def test_no_events(spark):
    events = spark.createDataFrame([], SCHEMA)
    assert range_states(events).count() == range_states_at(events).count() == 0
