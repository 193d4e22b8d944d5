"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton, then rendering.

Legal conversations are an optional system turn followed by user and assistant turns in alternation, user
first and assistant last.  Each given turn becomes a turn of some role or is merged into the turn before it;
empty turns may be inserted.  The cheapest way is found by dynamic programming whose state is the last role.

Conversations are dealt over partitions by ranges of (conv_id, turn), so one of any length is spread over as
many partitions as it needs.  Fragments at the edges of partitions are summed up as matrices of least costs
between states; the few matrices of a split conversation fix the states at its cuts (at most two fragments for
each partition reach the driver), and every partition then repairs its turns on its own.
"""

from __future__ import annotations

import math
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.llm.common import checkpointed, table

STATES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 4, 1, 2
#: Empty turns between two states; pairs that are missing are illegal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation legally.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
OPEN, CLOSE, JOIN = "<|im_start|>{role}\n", "<|im_end|>\n", "\n\n"
PARTITION_BYTES = 32 << 20

INFINITE = math.inf


def known_role(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in STATES[1:] else None


def moves(role: str | None) -> dict[tuple[int, int], tuple[int, bool]]:
    """(from state, to state) -> (least cost of a turn with this role, whether it is merged)."""
    found = {}
    for q in (SYSTEM, USER, ASSISTANT):
        label = UNKNOWN if role is None else 0 if STATES[q] == role else RELABEL
        for p in range(4):
            ways = []
            if (p, q) in BETWEEN:
                ways.append((label + INSERT * len(BETWEEN[p, q]), False))
            if p == q:
                ways.append((label + MERGE, True))
            if ways:
                found[p, q] = min(ways)
    return found


MOVES = {role: moves(role) for role in (None, *STATES[1:])}


def step(costs: list[float], role: str | None) -> tuple[list[float], list[int]]:
    """(least cost of each state after a turn, the state each came from)."""
    after, came = [INFINITE] * 4, [-1] * 4
    for (p, q), (cost, _) in MOVES[role].items():
        if costs[p] + cost < after[q]:
            after[q], came[q] = costs[p] + cost, p
    return after, came


def matrix(roles: list[str | None]) -> list[list[float]]:
    """Least costs of all turns from each state to each state."""
    rows = [[0.0 if p == q else INFINITE for q in range(4)] for p in range(4)]
    for role in roles:
        rows = [step(row, role)[0] for row in rows]
    return rows


def last_state(costs: list[float]) -> int:
    return min(range(4), key=lambda q: (costs[q] + INSERT * len(ENDING[q]), -q))


def states_at_cuts(matrices: list[list[list[float]]]) -> list[int]:
    """The state before each fragment and after the last one, from the fragments' matrices."""
    costs, came = [0.0, INFINITE, INFINITE, INFINITE], []
    for m in matrices:
        best = [min(range(4), key=lambda p: (costs[p] + m[p][q], p)) for q in range(4)]
        came.append(best)
        costs = [costs[best[q]] + m[best[q]][q] for q in range(4)]
    states = [last_state(costs)]
    for best in reversed(came):
        states.append(best[states[-1]])
    return states[::-1]


def repaired(roles: list[str | None], start: int = START, end: int | None = None) -> list[tuple[int, int, int, bool]]:
    """(state before, state after, cost, merged) of each turn; without `end` a legal ending is chosen."""
    costs = [INFINITE] * 4
    costs[start] = 0
    trail = []
    for role in roles:
        costs, came = step(costs, role)
        trail.append(came)
    q = last_state(costs) if end is None else end
    out = []
    for role, came in zip(reversed(roles), reversed(trail)):
        p = came[q]
        out.append((p, q, *MOVES[role][p, q]))
        q = p
    return out[::-1]


def rendered(steps: list[tuple[int, int, int, bool]], texts: list[str | None], final: bool) -> list[str]:
    """What each turn adds to the conversation's text; joined in order the pieces are the whole."""
    out = []
    for (p, q, _, merge), text in zip(steps, texts):
        if merge:
            out.append(JOIN + (text or ""))
        else:
            empty = "".join(OPEN.format(role=STATES[r]) + CLOSE for r in BETWEEN[p, q])
            out.append((CLOSE if p != START else "") + empty + OPEN.format(role=STATES[q]) + (text or ""))
    if final and out:
        out[-1] += CLOSE + "".join(OPEN.format(role=STATES[r]) + CLOSE for r in ENDING[steps[-1][1]])
    return out


def _runs(batches, columns: list[str]):
    """(conv_id, rows) for each run of rows with one conv_id, over all batches of a partition."""
    rows = (dict(zip(columns, values)) for batch in batches for values in zip(*(batch.column(c).to_pylist() for c in columns)))
    return groupby(rows, key=lambda r: r["conv_id"])


EDGES = pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.float64()))])


def _edges(batches):
    """The first and the last conversation of a partition as matrices."""
    first = last = part = None
    for conv, rows in _runs(batches, ["part", "conv_id", "role"]):
        rows = list(rows)
        part = rows[0]["part"]
        last = (conv, [known_role(r["role"]) for r in rows])
        first = first or last
    for conv, roles in [] if first is None else [first] if first is last else [first, last]:
        costs = [c for row in matrix(roles) for c in row]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, conv, costs), EDGES)], schema=EDGES)


def cuts(edges: list[tuple[int, int | None, list[float]]]) -> dict[tuple[int, int | None], tuple[int, int | None]]:
    """(part, conv_id) -> (state before, state after or None at the end) for fragments of split conversations."""
    of: dict[int | None, list[tuple[int, list[list[float]]]]] = {}
    for part, conv, costs in edges:
        of.setdefault(conv, []).append((part, [costs[i : i + 4] for i in range(0, 16, 4)]))
    found = {}
    for conv, fragments in of.items():
        if len(fragments) > 1:
            fragments.sort(key=lambda x: x[0])
            states = states_at_cuts([m for _, m in fragments])
            for i, (part, _) in enumerate(fragments):
                found[part, conv] = (states[i], states[i + 1] if i < len(fragments) - 1 else None)
    return found


OUT = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("new_role", T.StringType()), T.StructField("action", T.StringType()), T.StructField("inserted", T.IntegerType()),
        T.StructField("cost", T.IntegerType()), T.StructField("rendered", T.StringType()),
    ]
)
ARROW_OUT = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("cost", pa.int32()), ("rendered", pa.string())]
)


def repair(conversations: DataFrame) -> DataFrame:
    """Every turn of `conversations` (conv_id, turn, role, text) with its repaired role and rendered piece.

    action: keep, relabel, merge, or merge+relabel.  inserted: empty turns put before this one, and after the
    last.  cost: of this turn, ending included, so a conversation's sum is the least.  rendered: pieces in the
    order of turns join to the conversation's text.

    Roles are read without case and outer spaces; unknown and null roles take any role at a small cost; null
    texts are empty; equal turns are ordered by role, then text; repeated rows are turns of their own; null
    conv_ids are one conversation, null turns its first; an empty table gives no rows; other columns play no part.
    """
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    size = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 24)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / PARTITION_BYTES))
    order = ["conv_id", "turn", "role", "text", "__row"]
    ranged = own.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    # A checkpoint keeps partitions as they are, so that both passes below see the same cuts.
    dealt = checkpointed(ranged.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")))
    edges = dealt.select("part", "conv_id", "role").mapInArrow(_edges, "part int, conv_id long, costs array<double>").collect()
    known = spark.sparkContext.broadcast(cuts([(r["part"], r["conv_id"], r["costs"]) for r in edges]))

    def run(batches):
        for conv, rows in _runs(batches, ["part", "conv_id", "turn", "role", "text"]):
            rows = list(rows)
            start, end = known.value.get((rows[0]["part"], conv), (START, None))
            roles = [known_role(r["role"]) for r in rows]
            steps = repaired(roles, start, end)
            pieces = rendered(steps, [r["text"] for r in rows], end is None)
            out = []
            for i, (r, role, (p, q, cost, merge), piece) in enumerate(zip(rows, roles, steps, pieces)):
                relabelled = role != STATES[q]
                action = "merge+relabel" if merge and relabelled else "merge" if merge else "relabel" if relabelled else "keep"
                closing = len(ENDING[q]) if end is None and i == len(rows) - 1 else 0
                inserted = (0 if merge else len(BETWEEN[p, q])) + closing
                out.append((conv, r["turn"], r["role"], STATES[q], action, inserted, cost + INSERT * closing, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW_OUT)], schema=ARROW_OUT)

    return dealt.mapInArrow(run, OUT)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of all conversations, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))
