"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn and then user and assistant turns
in alternation, ending with the assistant. A dynamic program over this automaton
decides for each turn whether it is kept, merged into the turn before, relabelled
or preceded by empty turns, at the least total cost, and the repaired sequence is
rendered turn by turn.

A conversation is cut into chunks of `chunk` turn numbers. A chunk's costs from
every state to every state are a small matrix; the matrices of a conversation are
combined to give each chunk its first and last state, and chunks are traced back
on their own. So a conversation of any length is neither sorted nor held in one task.
Where turn numbers are null or repeat, so that a chunk would hold more than `chunk` rows
four times over, the rows of that conversation are sorted by ranges and counted, and
chunks are of places in that order.

Edge cases: null texts are empty; null or unknown roles are relabelled at a lower
cost; a null turn number comes last; equal turn numbers are ordered by role and
text, repeated rows are turns of their own; rows of a null conv_id are one conversation;
`<|im_` in a text becomes `< |im_`, so that it can't forge a turn; texts of any length
stay whole; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcorpus.llm.common import shared_dir, table, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which role may open the next turn in a state; the state after it is the role's own.
_OPENS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 1 << 60


class Costs(NamedTuple):
    merge: int = 2
    relabel: int = 3
    unknown: int = 1
    insert: int = 4


def _filled(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which role may follow state."""
    paths = [((), state)]
    for _ in range(3):
        for path, s in paths:
            if role in _OPENS[s]:
                return path
        paths = [((*path, r), r) for path, s in paths for r in _OPENS[s] if r != SYSTEM]
    return None


#: (state, role) -> the empty turns to insert; None if role can't follow.
_FILL = {(s, r): _filled(s, r) for s in range(4) for r in (SYSTEM, USER, ASSISTANT)}
#: The empty turns that end a conversation.
_END = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def moves(state: int, role: int | None, costs: Costs):
    """(cost, next state, merged, role taken, inserted) of all ways to take a turn of this role (None: unknown)."""
    for taken in (SYSTEM, USER, ASSISTANT):
        extra = 0 if taken == role else costs.unknown if role is None else costs.relabel
        if state == taken:
            yield extra + costs.merge, taken, True, taken, ()
        if (fill := _FILL[state, taken]) is not None:
            yield extra + costs.insert * len(fill), taken, False, taken, fill


def _tables(costs: Costs):
    """For each role and state the moves, cheapest first for each next state."""
    out = {}
    for role in (None, SYSTEM, USER, ASSISTANT):
        for state in range(4):
            best = {}
            for m in moves(state, role, costs):
                if m[1] not in best or m < best[m[1]]:
                    best[m[1]] = m
            out[role, state] = list(best.values())
    return out


def matrix(roles: list, tables) -> list[int]:
    """The least cost from each state to each state over turns of these roles."""
    out = []
    for start in range(4):
        cost = [0 if s == start else _FAR for s in range(4)]
        for role in roles:
            nxt = [_FAR] * 4
            for s, c in enumerate(cost):
                if c < _FAR:
                    for m in tables[role, s]:
                        if c + m[0] < nxt[m[1]]:
                            nxt[m[1]] = c + m[0]
            cost = nxt
        out += cost
    return out


def trace(roles: list, first: int, last: int, tables) -> list[tuple]:
    """The moves of a cheapest way from the first to the last state."""
    cost, back = {first: 0}, []
    for role in roles:
        nxt = {}
        for s in sorted(cost):
            for m in tables[role, s]:
                c = cost[s] + m[0]
                if m[1] not in nxt or c < nxt[m[1]][0]:
                    nxt[m[1]] = (c, s, m)
        back.append(nxt)
        cost = {s: x[0] for s, x in nxt.items()}
    out, state = [], last
    for step in reversed(back):
        _, before, move = step[state]
        out.append(move)
        state = before
    return out[::-1]


def join_chunks(chunks: list[list[int]], costs: Costs) -> list[tuple[int, int, int, bool]]:
    """(first state, last state, cost up to here, whether it is the last) of each chunk's matrix in turn."""
    best, back = {START: 0}, []
    for m in chunks:
        nxt = {}
        for a in sorted(best):
            for b in range(4):
                c = best[a] + m[4 * a + b]
                if c < _FAR and (b not in nxt or c < nxt[b][0]):
                    nxt[b] = (c, a)
        back.append(nxt)
        best = {b: x[0] for b, x in nxt.items()}
    state = min(best, key=lambda s: (best[s] + costs.insert * len(_END[s]), s))
    out = []
    for i in range(len(back) - 1, -1, -1):
        c, before = back[i][state]
        out.append((before, state, c + (costs.insert * len(_END[state]) if i == len(back) - 1 else 0), i == len(back) - 1))
        state = before
    return out[::-1]


def _opened(role: int, text: str, first: bool) -> str:
    text = text.replace("<|im_", "< |im_")  # a text can't forge a turn
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role - 1]}\n{text}"


def _numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """rows with chunk: of turn numbers, or of places in the conversation where one of them would be too large."""
    rows = rows.withColumn("chunk", F.floor(F.coalesce("turn", F.lit((1 << 63) - 1)) / chunk))
    long = rows.groupBy("conv_id", "chunk").count().where(F.col("count") > 4 * chunk).select(F.col("conv_id").alias("long")).distinct()
    long = written(long, "long-chats")
    if long.isEmpty():
        return rows
    same = F.col("conv_id").eqNullSafe(F.col("long"))
    side = F.broadcast(long) if long.count() <= 100_000 else long
    # equal rows are told apart by a number that is written before it is sorted by
    theirs = written(rows.join(side, same, "left_semi").withColumn("nth", F.monotonically_increasing_id()), "long-rows")
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("nth")]
    ranged = theirs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    ranged = written(ranged, "long-sorted")
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each conversation and range
    shift = parts.select(F.col("conv_id").alias("own"), F.col("part").alias("at"), (before - F.col("first")).alias("shift"))
    placed = ranged.join(shift, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("part") == F.col("at"))).withColumn("place", F.col("i") + F.col("shift"))
    # places stand for turn numbers in the chunks' order; the turn itself stays
    placed = placed.select("conv_id", "turn", "role", "text", F.floor(F.col("place") / chunk).alias("chunk"))
    return rows.join(side, same, "left_anti").unionByName(placed)


def repaired(turns: DataFrame, costs: Costs = Costs(), chunk: int = 512) -> DataFrame:
    """A row for each piece of the repaired conversations, in the order of chunk and place:
    conv_id, chunk, place, turn (null: inserted), action, role, text, rendered, conversation_cost
    (set in the last piece). Concatenating rendered gives a conversation's text."""
    shared_dir(turns.sparkSession)
    tables = _tables(costs)
    number = {r: i + 1 for i, r in enumerate(ROLES)}
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = _numbered(rows.withColumn("conv_id", F.col("conv_id").cast("long")), chunk)
    order = ["conv_id", "chunk", F.col("turn").asc_nulls_last(), "role", "text"]

    def groups(batches, columns, keys):
        """Rows of equal first `keys` columns, one group after another."""
        held, name = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns))):
                if row[:keys] != name:
                    if held:
                        yield name, held
                    held, name = [], row[:keys]
                held.append(row[keys:])
        if held:
            yield name, held

    def matrices(batches):
        for (conv, part), held in groups(batches, 4, 2):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([matrix([number.get(r[1]) for r in held], tables)], pa.list_(pa.int64()))], ["conv_id", "chunk", "m"])

    def states(batches):
        for (conv,), held in groups(batches, 3, 1):
            ends = join_chunks([m for _, m in held], costs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(held), pa.int64()), pa.array([p for p, _ in held], pa.int64()), *[pa.array([e[i] for e in ends], pa.int64()) for i in range(3)], pa.array([e[3] for e in ends], pa.bool_())], ["conv_id", "chunk", "first", "last", "cost", "ends"]
            )

    def pieces(batches):
        for (conv, part, first, last, cost, ends), held in groups(batches, 9, 6):
            out, n = [], first == START
            steps = trace([number.get(r[1]) for r in held], first, last, tables)
            for (turn, role, text), (_, _, merge, taken, fill) in zip(held, steps):
                for r in fill:
                    out.append((None, "insert", r, "", _opened(r, "", n)))
                    n = False
                same = number.get(role) == taken
                action = ("merge" if merge else "keep") if same else ("relabel_merge" if merge else "relabel")
                out.append((turn, action, taken, text, "\n\n" + text.replace("<|im_", "< |im_") if merge else _opened(taken, text, n)))
                n = False
            if ends:
                out += [(None, "insert", r, "", _opened(r, "", False)) for r in _END[last]]
                turn, action, r, text, rendered = out[-1]
                out[-1] = (turn, action, r, text, rendered + "<|im_end|>\n")
            k = len(out)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv] * k, pa.int64()),
                    pa.array([part] * k, pa.int64()),
                    pa.array(range(k), pa.int64()),
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.string()),
                    pa.array([ROLES[o[2] - 1] for o in out], pa.string()),
                    pa.array([o[3] for o in out], pa.string()),
                    pa.array([o[4] for o in out], pa.string()),
                    pa.array([None] * (k - 1) + [cost if ends else None], pa.int64()),
                ],
                ["conv_id", "chunk", "place", "turn", "action", "role", "text", "rendered", "conversation_cost"],
            )

    sorted_ = rows.select("conv_id", "chunk", "turn", "role", "text").repartition("conv_id", "chunk").sortWithinPartitions(*order)
    chunks = sorted_.select("conv_id", "chunk", "turn", "role").mapInArrow(matrices, "conv_id long, chunk long, m array<long>")
    known = written(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(states, "conv_id long, chunk long, first long, last long, cost long, ends boolean"), "chat-states")
    k = known.select(F.col("conv_id").alias("kc"), F.col("chunk").alias("kk"), "first", "last", "cost", "ends")
    both = rows.join(k, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("chunk") == F.col("kk"))).select("conv_id", "chunk", "first", "last", "cost", "ends", "turn", "role", "text")
    return both.repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(pieces, "conv_id long, chunk long, place long, turn long, action string, role string, text string, rendered string, conversation_cost long")


def rendered(pieces: DataFrame) -> DataFrame:
    """conv_id and the text of whole conversations, for those that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "place", "rendered")))
    return pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda x: x["rendered"])).alias("text"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
