from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfline.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string"
ROLE = st.sampled_from(["system", "user", "assistant", None])


def cheapest(roles):
    """The least cost over every choice of states and of merging."""
    best = 0 if not roles else C.INFINITE
    for states in product((1, 2, 3), repeat=len(roles)) if roles else ():
        cost, p = 0, C.START
        for role, q in zip(roles, states):
            label = C.UNKNOWN if role is None else 0 if C.STATES[q] == role else C.RELABEL
            ways = ([C.INSERT * len(C.BETWEEN[p, q])] if (p, q) in C.BETWEEN else []) + ([C.MERGE] if p == q else [])
            cost += label + min(ways, default=C.INFINITE)
            p = q
        best = min(best, cost + C.INSERT * len(C.ENDING[p]))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(ROLE, max_size=5))
def test_cost_is_least(roles):
    steps = C.repaired(roles)
    assert sum(s[2] for s in steps) + (C.INSERT * len(C.ENDING[steps[-1][1]]) if steps else 0) == cheapest(roles)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(ROLE, min_size=1, max_size=4), min_size=1, max_size=4))
def test_fragments_cost_as_much_as_the_whole(parts):
    states = C.states_at_cuts([C.matrix(p) for p in parts])
    steps = [s for i, p in enumerate(parts) for s in C.repaired(p, states[i], states[i + 1])]
    whole = [r for p in parts for r in p]
    assert sum(s[2] for s in steps) + C.INSERT * len(C.ENDING[states[-1]]) == cheapest(whole) if len(whole) < 7 else True
    assert all(a[1] == b[0] for a, b in zip(steps, steps[1:]))


def texts(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn if r.turn is not None else -1)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.rendered
    return out


def turn(role, text=""):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_repair_and_render(spark):
    rows = [
        (1, 0, "Human", "hi"), (1, 1, "user", "again"), (1, 2, "GPT", "yes"),
        (2, 0, "assistant", "first"), (2, 1, "user", None),
        (3, 0, None, "who"), (3, 1, "weird", "what"),
        (None, None, "user", "a"), (4, 0, "system", "s"),
    ]
    got = texts(C.repair(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as cost", "2 as PART")).collect())
    assert got[1] == turn("user", "hi\n\nagain") + turn("assistant", "yes")
    assert got[2] == turn("user") + turn("assistant", "first") + turn("user") + turn("assistant")
    assert got[3] == turn("user", "who") + turn("assistant", "what")
    assert got[4] == turn("system", "s") + turn("user") + turn("assistant")
    assert got[None] == turn("user", "a") + turn("assistant")


def test_empty_and_repeated(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = C.repair(spark.createDataFrame([(1, 0, "user", "x")] * 3, SCHEMA)).collect()
    assert [r.action for r in rows].count("merge") == 2


@pytest.mark.parametrize("n", [1, 2, 500])
def test_one_conversation_over_many_partitions(spark, n):
    roles = ["user", "assistant", "user", "user", "system", None, "assistant"]
    rows = [(5, i, roles[i * i % 7], f"t{i}") for i in range(n)]
    got = C.repair(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = C.repaired([C.known_role(r) for _, _, r, _ in rows])
    ending = C.INSERT * len(C.ENDING[want[-1][1]])
    assert sum(r.cost for r in got) == sum(s[2] for s in want) + ending
    assert "".join(r.rendered for r in sorted(got, key=lambda r: r.turn)).count("t") >= n
