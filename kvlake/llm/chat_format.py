"""Chat formatting with minimum-cost role repair.

A legal chat is an optional system turn and then user and assistant in turns, ending with the
assistant. Dynamic programming over that automaton finds the cheapest repair of each conversation:
turns are kept, merged into the one before, relabelled, or preceded by empty turns.

Rows are range-partitioned by (conversation, turn), so one conversation may lie in many partitions.
The cost of a run of turns is a matrix over the automaton's states and such matrices multiply (with
min and plus): each partition's two outer conversations are summed up that way, and every partition
then repairs its own rows from the right state. The choice among equal costs depends on the forward
costs alone, so the result doesn't depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the roles; a role that is none of these must be relabelled.
ALIASES = {"system": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """A relabelled turn puts words into another's mouth, so it costs the most."""

    merge: int = 1
    insert: int = 2
    relabel: int = 4


@dataclass(frozen=True)
class Edit:
    cost: int
    action: str
    role: int
    inserted: tuple[int, ...] = ()


def _empties(state: int, goal: int) -> tuple[int, ...] | None:
    """The shortest row of empty turns after which a turn of role ``goal`` is legal."""
    reach = [((), state)]
    for path, at in reach:
        if goal in NEXT[at]:
            return path
        if len(path) < 3:
            reach += [((*path, n), n) for n in NEXT[at] if n != SYSTEM]
    return None


def edits(costs: Costs) -> dict[tuple[int, int, int], Edit]:
    """The cheapest edit for (state, role of the turn, next state); role START stands for an unknown role.

    Among equal costs: keep, merge, relabel, relabel and merge, insert.
    """
    out = {}
    for state in STATES:
        for role in STATES:
            found: list[Edit] = []
            if role in NEXT[state]:
                found.append(Edit(0, "keep", role))
            if role == state != START:
                found.append(Edit(costs.merge, "merge", role))
            found += [Edit(costs.relabel, "relabel", n) for n in NEXT[state] if n != role]
            if state not in (START, role):
                found.append(Edit(costs.relabel + costs.merge, "relabel_merge", state))
            if role != START and (path := _empties(state, role)):
                found.append(Edit(costs.insert * len(path), "insert", role, path))
            for e in found:
                if (key := (state, role, e.role)) not in out or e.cost < out[key].cost:
                    out[key] = e
    return out


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that make the end legal."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


class Repair:
    """The automaton with costs; forward steps are remembered, since costs above the least are few."""

    def __init__(self, costs: Costs):
        self.costs, self.edits = costs, edits(costs)
        self._steps: dict[tuple, tuple] = {}

    def forward(self, at: tuple[int, ...], role: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Costs (above their least) after one more turn, and from which state each came, the first of equals."""
        got = self._steps.get((at, role))
        if got is None:
            to, back = [], []
            for s in STATES:
                best = min((at[p] + self.edits[p, role, s].cost, p) for p in STATES if (p, role, s) in self.edits) if s != START else (FAR, START)
                to.append(min(best[0], FAR))
                back.append(best[1])
            least = min(to)
            got = tuple(min(x - least, FAR) if x < FAR else FAR for x in to), tuple(back)
            self._steps[at, role] = got
        return got

    def run(self, at: tuple[int, ...], roles: list[int]) -> tuple[tuple[int, ...], list[tuple[int, ...]]]:
        backs = []
        for r in roles:
            at, back = self.forward(at, r)
            backs.append(back)
        return at, backs

    def last_state(self, at: tuple[int, ...]) -> int:
        return min(STATES, key=lambda s: (at[s] + self.costs.insert * len(closing(s)), s))

    def matrix(self, roles: list[int]) -> list[tuple[int, ...]]:
        """Costs from each state to each state over a run of turns, above the least of all."""
        rows, offset = [], []
        for s in STATES:
            at, extra = tuple(0 if p == s else FAR for p in STATES), 0
            for r in roles:
                raw = [min((at[p] + self.edits[p, r, q].cost for p in STATES if (p, r, q) in self.edits and at[p] < FAR), default=FAR) for q in STATES]
                least = min(raw)
                extra += least
                at = tuple(x - least if x < FAR else FAR for x in raw)
            rows.append(at)
            offset.append(extra)
        low = min(offset)
        return [tuple(x + o - low if x < FAR else FAR for x in row) for row, o in zip(rows, offset, strict=True)]

    @staticmethod
    def apply(at: tuple[int, ...], matrix: list[tuple[int, ...]]) -> tuple[int, ...]:
        to = [min(min(at[p] + matrix[p][q], FAR) for p in STATES) for q in STATES]
        least = min(to)
        return tuple(x - least if x < FAR else FAR for x in to)

    @staticmethod
    def trace(backs: list[tuple[int, ...]], state: int) -> list[int]:
        """The states before each turn and after the last."""
        out = [state]
        for back in reversed(backs):
            out.append(back[out[-1]])
        return out[::-1]


FRESH = (0, FAR, FAR, FAR)


def role_code(role: str | None) -> int:
    return ALIASES.get(role.strip().lower(), START) if role is not None else START


def turn_open(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


TURN_CLOSE = "<|im_end|>\n"


def turn_piece(edit: Edit, text: str | None, first: bool) -> str:
    """What a turn adds to the rendered chat; marks inside a text are broken by a space."""
    body = (text or "").replace("<|im_", "<| im_")
    if edit.action in ("merge", "relabel_merge"):
        return "\n" + body
    empties = "".join(turn_open(r) + TURN_CLOSE for r in edit.inserted)
    return ("" if first else TURN_CLOSE) + empties + turn_open(edit.role) + body


def end_piece(state: int) -> str:
    return TURN_CLOSE + "".join(turn_open(r) + TURN_CLOSE for r in closing(state))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table, bool]]:
    """(conv_id, its rows, whether they are the partition's last), in order; only one conversation's part is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        start = 0
        for i in range(len(ids)):
            if (i and ids[i] != ids[i - 1]) or (not i and held and held[0].column(0)[0].as_py() != ids[0]):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held), False
                held, start = [], i
        if len(ids) > start:
            held.append(batch.slice(start))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held), True


def _outer(costs: Costs, key: str):
    """(conv_id, role) to a row for the first and one for the last conversation of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, first = Repair(costs), True
        for conv, rows, last in _conversations(batches):
            if first or last:
                m = repair.matrix([role_code(r) for r in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([conv], rows.schema.field(0).type), pa.array([first]), pa.array([last]), pa.array([[x for r in m for x in r]], pa.list_(pa.int64()))],
                    names=["part", key, "first", "last", "matrix"],
                )
            first = False

    return run


def _back_maps(costs: Costs, entries: dict[int, tuple[int, ...]]):
    """Where a continued conversation's states at a partition's end lead back to at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part in entries:
            repair = Repair(costs)
            for _, rows, _ in _conversations(batches):
                _, backs = repair.run(entries[part], [role_code(r) for r in rows.column(1).to_pylist()])
                starts = [repair.trace(backs, s)[0] for s in STATES]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([starts], pa.list_(pa.int32()))], names=["part", "starts"])
                break

    return run


def _repaired(costs: Costs, entries: dict[int, tuple[int, ...]], exits: dict[int, int]):
    """The output rows; ``entries``: forward costs where the first conversation goes on from before, ``exits``: state where the last one goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, repair, first = TaskContext.get().partitionId(), Repair(costs), True
        for _, rows, last in _conversations(batches):
            goes_on = last and part in exits
            continued = first and part in entries
            roles = [role_code(r) for r in rows.column(2).to_pylist()]
            at, backs = repair.run(entries[part] if continued else FRESH, roles)
            states = repair.trace(backs, exits[part] if goes_on else repair.last_state(at))
            chosen = [repair.edits[s, r, n] for s, r, n in zip(states, roles, states[1:], strict=False)]
            texts = rows.column(3).to_pylist()
            pieces = [turn_piece(e, t, not (i or continued)) for i, (e, t) in enumerate(zip(chosen, texts, strict=True))]
            if not goes_on:
                pieces[-1] += end_piece(states[-1])
            out = pa.Table.from_arrays(
                [
                    *(rows.column(i) for i in range(3)),
                    pa.array([e.action for e in chosen]),
                    pa.array([NAMES[e.role] for e in chosen]),
                    pa.array([len(e.inserted) for e in chosen], pa.int32()),
                    pa.array(pieces, pa.string()),
                ],
                names=[*rows.schema.names[:3], "action", "new_role", "n_inserted", "piece"],
            )
            yield from out.combine_chunks().to_batches()
            first = False

    return run


def repair_turns(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, turn, role, action, new_role, n_inserted (empty turns put before it), piece of every row of ``conversations``.

    The pieces of a conversation, in the order of turn, role and hash of the text (nulls first), are its
    rendered chat; the last piece also ends it. Repeated rows count as turns of their own, a null role is unknown, a null text is empty, and rows without a conv_id
    are one conversation. Only two short rows for each partition reach the driver. A task holds the roles of
    a conversation's turns in its partition together; a longer conversation spans partitions. An empty table
    gives no rows. Other columns are not read.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "tie")]
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("tie", F.xxhash64("text"))
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("tie"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    repair = Repair(costs)
    sums = rows.select("conv_id", "role").mapInArrow(_outer(costs, "conv_id"), f"part int, conv_id {kinds['conv_id']}, first boolean, last boolean, matrix array<bigint>").collect()
    entries: dict[int, tuple[int, ...]] = {}
    ends: dict[int, tuple[int, ...]] = {}
    chains: list[list[int]] = []
    before = None
    by_part: dict[int, list] = {}
    for r in sums:
        by_part.setdefault(r.part, []).append(r)
    for part in sorted(by_part):
        head = next(r for r in by_part[part] if r.first)
        tail = next(r for r in by_part[part] if r.last)
        at = FRESH
        if before is not None and before[1] == head.conv_id:
            at = entries[part] = before[2]
            if chains and chains[-1][-1] == before[0]:
                chains[-1].append(part)
            else:
                chains.append([before[0], part])
        if head is tail:
            at = repair.apply(at, [tuple(tail.matrix[i : i + 4]) for i in range(0, 16, 4)])
        else:
            if part in entries:
                ends[part] = repair.apply(at, [tuple(head.matrix[i : i + 4]) for i in range(0, 16, 4)])
            at = repair.apply(FRESH, [tuple(tail.matrix[i : i + 4]) for i in range(0, 16, 4)])
        before = (part, tail.conv_id, at)
        ends.setdefault(part, at)
        # A chain stops where the partition's last conversation is another one.
        if head is not tail and chains and chains[-1][-1] == part:
            chains.append([part])
    exits: dict[int, int] = {}
    chains = [c for c in chains if len(c) > 1]
    if chains:
        back = {r.part: r.starts for r in rows.select("conv_id", "role").mapInArrow(_back_maps(costs, entries), "part int, starts array<int>").collect()}
        for chain in chains:
            state = repair.last_state(ends[chain[-1]])
            for part, earlier in zip(chain[:0:-1], chain[-2::-1], strict=True):
                state = back[part][state]
                exits[earlier] = state
    return rows.mapInArrow(_repaired(costs, entries, exits), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, action string, new_role string, n_inserted int, piece string")


def render(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id and chat, the whole rendered text of each conversation: for conversations whose text fits a row."""
    turns = repair_turns(conversations, costs).withColumn("at", F.monotonically_increasing_id())
    pieces = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    return pieces.select("conv_id", F.array_join("pieces.piece", "").alias("chat"))
