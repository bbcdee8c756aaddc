"""Chat formatting: the cheapest repair of a conversation's roles, and its rendered pieces.

A legal conversation is a path of an automaton: perhaps a system turn, then user and assistant turns by turns, ending
with the assistant. Each turn is kept, relabelled, or merged into the one before it, with or without an empty turn put in
between; dynamic programming over the automaton's states finds the cheapest choice for the whole conversation.

A conversation's cost from state to state is a small matrix, and matrices of parts multiply (in the min-plus sense). So
turns are range-partitioned by conversation and turn, a long conversation over as many tasks as it needs: each task
gives the matrices of the two conversations at its borders, the states at the borders follow from those, and each task
then decides its turns alone. Only border matrices, two for each task, go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import shared_dir

ROLES = ("system", "user", "assistant")
#: State 0 is the start; state k + 1 comes after role k.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, INSERT, NAME = 2, 1, 3, 1
FAR = 1 << 50
#: Other names of the roles.
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "instruction": "system"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

COLUMNS = "conv_id bigint, turn bigint, role string, action string, inserted array<string>, appended array<string>, piece string"


def state_of(role: str | None) -> int:
    """The state after a role as written; 0 for none or an unknown one, which any label fits."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else 0


def options(state: int, role: int) -> Iterator[tuple[int, int, str, int | None]]:
    """Cost, next state, action and inserted state for a turn of a role (0: unknown) in a state."""
    for new in (SYSTEM, USER, ASSISTANT):
        named = "keep" if role == new else "relabel"
        cost = 0 if role == new else RELABEL if role else NAME
        if new in NEXT[state]:
            yield cost, new, named, None
        if new == state:
            yield cost + MERGE, new, "merge" if role == new else "relabel_merge", None
        for between in NEXT[state]:
            if new in NEXT[between]:
                yield cost + INSERT, new, named, between


def _best(role: int) -> list[list[tuple[int, str, int | None] | None]]:
    """For each state and next state the cheapest option, the first of equal ones."""
    table: list[list[tuple[int, str, int | None] | None]] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        for cost, new, action, between in options(state, role):
            if table[state][new] is None or cost < table[state][new][0]:
                table[state][new] = (cost, action, between)
    return table


STEPS = [_best(role) for role in range(4)]
COSTS = [[[cell[0] if cell else FAR for cell in line] for line in table] for table in STEPS]
#: What ends a conversation legally from each state: the turns to append.
ENDINGS: list[tuple[int, ...]] = [(), (USER, ASSISTANT), (ASSISTANT,), ()]


def advance(costs: list[int], role: int) -> list[int]:
    step = COSTS[role]
    return [min(costs[s] + step[s][t] for s in range(4)) for t in range(4)]


def matrix(roles: list[int]) -> list[list[int]]:
    """Costs from each state to each over the roles."""
    found = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for role in roles:
        found = [[min(x, FAR) for x in advance(line, role)] for line in found]
    return found


def final_state(costs: list[int]) -> int:
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(ENDINGS[s]), s))


def decide(roles: list[int], entry: int, exit_: int | None) -> list[tuple[int, str, int | None]]:
    """State, action and inserted state of each turn on the cheapest way from entry to exit (or to a legal end)."""
    rows = [[0 if s == entry else FAR for s in range(4)]]
    for role in roles:
        rows.append(advance(rows[-1], role))
    state = final_state(rows[-1]) if exit_ is None else exit_
    chosen = []
    for i in range(len(roles) - 1, -1, -1):
        before = min(range(4), key=lambda s: (rows[i][s] + COSTS[roles[i]][s][state], s))  # noqa: B023
        _, action, between = STEPS[roles[i]][before][state]
        chosen.append((state, action, between))
        state = before
    return chosen[::-1]


def borders(parts: list[tuple[int, int, int | None, list[list[int]]]]) -> dict[tuple[int, int], tuple[int, int | None, bool]]:
    """Entry state, exit state (None: the conversation ends there) and whether it begins there, for each border part.

    parts: task, number in the task (0 first, 1 last), conversation, matrix.
    """
    chains: dict[int | None, list[tuple[int, int, list[list[int]]]]] = {}
    for task, number, conversation, costs in sorted(parts, key=lambda p: p[:2]):
        chains.setdefault(conversation, []).append((task, number, costs))
    found = {}
    for chain in chains.values():
        ways = [[0, FAR, FAR, FAR]]
        for _, _, costs in chain:
            ways.append([min(min(ways[-1][s] + costs[s][t] for s in range(4)), FAR) for t in range(4)])
        state = final_state(ways[-1])
        for i in range(len(chain) - 1, -1, -1):
            task, number, costs = chain[i]
            before = min(range(4), key=lambda s: (ways[i][s] + costs[s][state], s))  # noqa: B023
            found[task, number] = (before, None if i == len(chain) - 1 else state, i == 0)
            state = before
    return found


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int | None, list[tuple]]]:
    """Runs of one conversation's turns in a task, whole, with their number: 0 for the first, 1 for the last, else None.

    A task's part of a conversation is held whole: it is no more than the task's share of all turns.
    """
    conversation, held, number = None, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if held and row[0] != conversation:
                yield (0 if number == 0 else None), conversation, held
                held, number = [], number + 1
            conversation = row[0]
            held.append(row)
    if held:
        yield (0 if number == 0 else 1), conversation, held


def render(text: str | None, state: int, action: str, between: int | None, first: bool, appended: tuple[int, ...], last: bool) -> str:
    """A turn's piece; a conversation's pieces, one after another, are its rendering. Marks within a text are broken up."""
    empty = lambda s: f"{OPEN}{ROLES[s - 1]}\n{CLOSE}"
    body = (text or "").replace("<|", "< |")
    out = "\n" if action.endswith("merge") else ("" if first else CLOSE) + (empty(between) if between else "") + f"{OPEN}{ROLES[state - 1]}\n"
    return out + body + (CLOSE + "".join(map(empty, appended)) if last else "")


def format_chats(conversations: DataFrame) -> DataFrame:
    """COLUMNS, one row for each turn: its repaired role, what was done, the empty turns put before it and (after the
    last) appended, and its rendered piece.

    Turns are in order of turn (nulls first), then role and text; a null conv_id is a conversation of its own; null
    texts are empty; null and unknown roles fit any label at a small cost; repeated rows are turns of their own; other
    columns are ignored; no rows give none.
    """
    spark = conversations.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # the salt parts equal rows, which may come in any order
    keys = ["conv_id", "turn", "role", "digest", "salt"]
    turns = conversations.select("conv_id", "turn", "role", "text").withColumns({"digest": F.xxhash64("text"), "salt": F.rand(7)})
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text").checkpoint()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, conversation, rows in _conversations(batches):
            if number is not None:
                flat = [x for line in matrix([state_of(r[2]) for r in rows]) for x in line]
                yield pa.record_batch([pa.array([task], pa.int64()), pa.array([number], pa.int64()), pa.array([conversation], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], ["task", "number", "conv_id", "costs"])

    found = dealt.mapInArrow(matrices, "task bigint, number bigint, conv_id bigint, costs array<bigint>").collect()  # two rows a task at most
    ends = spark.sparkContext.broadcast(borders([(r["task"], r["number"], r["conv_id"], [list(r["costs"][i : i + 4]) for i in range(0, 16, 4)]) for r in found]))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        give = lambda: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for number, conversation, rows in _conversations(batches):
            entry, exit_, begins = ends.value[task, number] if number is not None else (START, None, True)
            chosen = decide([state_of(r[2]) for r in rows], entry, exit_)
            for i, ((_, turn, _, text), (state, action, between)) in enumerate(zip(rows, chosen, strict=True)):
                last = exit_ is None and i == len(rows) - 1
                appended = ENDINGS[state] if last else ()
                out.append((conversation, turn, ROLES[state - 1], action, [ROLES[between - 1]] if between else [], [ROLES[s - 1] for s in appended], render(text, state, action, between, begins and i == 0, appended, last)))
                if len(out) == 2000:
                    yield give()
                    out = []
        if out:
            yield give()

    return dealt.mapInArrow(repair, COLUMNS)
