"""Minimum-cost repair of chat roles, then rendering.

A legal conversation is empty, or an optional system turn, then user and assistant turns in turn,
beginning with user and ending with assistant. Each given turn is kept, relabelled, or merged into
the turn before it if both then have the same role; empty turns may be inserted. Dynamic programming
over the automaton, whose state is the role of the last turn, finds the cheapest way (`COSTS`); ties
go to the smaller state, then to keeping, merging and inserting in this order.

Conversations of at most `PIECE_BYTES` are repaired whole, one at a time. A longer one is sorted over
all tasks and cut into pieces of about that size at places that its own bytes fix. As each turn is a
4 x 4 matrix in the (min, +) algebra, a piece is one such matrix; from these the costs at the ends of
all pieces of a conversation follow, where the smallest of the cheapest states is taken, and each
piece is then repaired on its own. Its repaired pieces are joined again, `ROW_PIECES` to a row.

Defined results: a null or unknown role costs as much to give a role as a relabel; null text counts
as empty; turns sort by turn, nulls first, then role, then text; repeated rows are separate turns;
a null conversation id is one conversation. An empty table gives an empty result. Each conversation
has one row (part 0), and one more for every `ROW_PIECES` pieces of about `PIECE_BYTES`, in the order
of `part`; rows depend on the turns alone, not on partitions. Ids stay as they are. Extra columns are
ignored. What one task holds at a time is one conversation of `PIECE_BYTES`, or one piece and its last
turn; the matrices of a conversation, 128 bytes a piece, meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

ROLES = ("", "system", "user", "assistant")
#: What each change costs.
COSTS = {"merge": 1.0, "relabel": 2.0, "insert": 3.0}
_NEXT = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
_INF = float("inf")
#: Bytes of a piece (each turn counts `TURN_BYTES` besides its text), and pieces in a row of the result.
PIECE_BYTES, TURN_BYTES, ROW_PIECES = 1 << 20, 32, 64
START = np.array([0.0, _INF, _INF, _INF])


def _ways() -> dict[tuple[int, int], tuple[float, tuple[str, ...]]]:
    """(last role, role to write) to cost and the inserted turns, or a merge."""
    ways: dict[tuple[int, int], tuple[float, tuple[str, ...]]] = {}
    for s in range(4):
        for e in range(1, 4):
            options = [(0.0, ())] if (s, e) in _NEXT else []
            if s == e:
                options.append((COSTS["merge"], ("merge",)))
            options += [(COSTS["insert"], (ROLES[x],)) for x in range(1, 4) if (s, x) in _NEXT and (x, e) in _NEXT]
            options += [(2 * COSTS["insert"], (ROLES[x], ROLES[y])) for x in range(1, 4) for y in range(1, 4) if (s, x) in _NEXT and (x, y) in _NEXT and (y, e) in _NEXT]
            if options:
                ways[s, e] = min(options, key=lambda o: o[0])
    return ways


WAYS = _ways()
#: What it costs to end in each state: the missing assistant turn, and before it a user turn.
CLOSING = {0: (0.0, ()), 1: (2 * COSTS["insert"], ("user", "assistant")), 2: (COSTS["insert"], ("assistant",)), 3: (0.0, ())}
END = np.array([CLOSING[s][0] for s in range(4)])


def _matrix(role: int) -> np.ndarray:
    """Cost of writing a turn of the given role (0: unknown), from the last role to the next."""
    out = np.full((4, 4), _INF)
    for (s, e), (cost, _) in WAYS.items():
        out[s, e] = cost + (0.0 if e == role else COSTS["relabel"])
    return out


MATRICES = [_matrix(r) for r in range(4)]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def _unit() -> np.ndarray:
    return np.where(np.eye(4, dtype=bool), 0.0, _INF)


def product(roles: list[int]) -> np.ndarray:
    out = _unit()
    for r in roles:
        out = times(out, MATRICES[r])
    return out


def repair(roles: list[int], texts: list[str], begin: np.ndarray, end: np.ndarray) -> tuple[list[tuple[str, str]], dict[str, float], int, int]:
    """The cheapest run of turns, given the costs of the states before and after; with counts of changes and the states at both ends.

    A turn that is merged into one before the range has the action "merge" in the first place.
    """
    costs, back = begin, []
    for r in roles:
        step = costs[:, None] + MATRICES[r]
        back.append(step.argmin(axis=0))
        costs = step.min(axis=0)
    state = last = int((costs + end).argmin())
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    path.reverse()
    out: list[tuple[str, str]] = []
    done = {"merges": 0, "relabels": 0, "inserts": 0, "cost": 0.0}
    for r, text, s, e in zip(roles, texts, path, path[1:], strict=False):
        cost, way = WAYS[s, e]
        done["cost"] += cost + (0.0 if e == r else COSTS["relabel"])
        done["relabels"] += e != r
        if way == ("merge",):
            done["merges"] += 1
            if out:
                out[-1] = (out[-1][0], out[-1][1] + "\n" + text)
            else:
                out.append(("merge", text))
        else:
            done["inserts"] += len(way)
            out += [(x, "") for x in way]
            out.append((ROLES[e], text))
    return out, done, path[0], last


def close(turns: list[tuple[str, str]], done: dict[str, float], state: int) -> None:
    cost, way = CLOSING[state]
    turns += [(x, "") for x in way]
    done["inserts"] += len(way)
    done["cost"] += cost


def render(turns: list[tuple[str, str]]) -> str:
    """Each turn as <|role|>, its text, and <|end|>; a merged first piece goes on without a head."""
    return "".join((f"\n{t}" if r == "merge" else f"<|{r}|>\n{t}") + ("<|end|>\n" if i + 1 < len(turns) else "") for i, (r, t) in enumerate(turns))


def _codes(roles: pa.ChunkedArray) -> list[int]:
    known = {"system": 1, "user": 2, "assistant": 3}
    return [known.get(r.strip().lower(), 0) if r is not None else 0 for r in roles.to_pylist()]


_RESULT = ["part", "turns_in", "turns_out", "merges", "relabels", "inserts", "cost", "rendered"]
_TYPES = "part bigint, turns_in bigint, turns_out bigint, merges bigint, relabels bigint, inserts bigint, cost double, rendered string"
_ORDER = [("turn", "ascending"), ("role", "ascending"), ("text", "ascending")]


def _row(conv: pa.ChunkedArray, part: int, roles: list[int], texts: list[str], begin: np.ndarray, after: np.ndarray | None) -> pa.Table:
    """The repaired turns as one row; `after` is the cost of the states that may follow, None at the end of the conversation."""
    turns, done, _, state = repair(roles, texts, begin, END if after is None else after)
    if after is None:
        close(turns, done, state)
    text = render(turns) + ("<|end|>\n" if after is None else "")
    if part and turns and turns[0][0] != "merge":
        text = "<|end|>\n" + text
    values = [part, len(roles), sum(r != "merge" for r, _ in turns), done["merges"], done["relabels"], done["inserts"], done["cost"], text]
    types = [pa.int64()] * 6 + [pa.float64(), pa.string()]
    return pa.table([conv.slice(0, 1), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], ["conv", *_RESULT])


def _mend(table: pa.Table) -> pa.Table:
    """One conversation that fits a piece."""
    table = table.take(_sorted(table))
    return _row(table["conv"], 0, _codes(table["role"]), table["text"].to_pylist(), START, None)


def _sorted(table: pa.Table) -> pa.Array:
    return pc.sort_indices(table, sort_keys=_ORDER, null_placement="at_start")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per conversation: id, part, turns in and out, merges, relabels, inserts, cost and the rendered text."""
    source = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text") + F.lit(TURN_BYTES)
    long = staged(source.groupBy("conv").agg(F.sum(size).alias("bytes")).where(F.col("bytes") > piece_bytes).select(F.col("conv").alias("long")), "chat-long")
    same = F.col("conv").eqNullSafe(F.col("long"))
    kind = dict(source.dtypes)["conv"]
    short = source.join(long, same, "left_anti").groupBy("conv").applyInArrow(_mend, f"conv {kind}, {_TYPES}")
    if long.isEmpty():
        return short.withColumnRenamed("conv", id_col)
    pieces = _pieces(source.join(long, same, "left_semi"), size, piece_bytes)
    return short.unionByName(_mended(pieces, kind)).withColumnRenamed("conv", id_col)


def _pieces(rows: DataFrame, size: Column, piece_bytes: int) -> DataFrame:
    """The turns of long conversations with their `piece` and their `place` in the order of all rows.

    Rows are sorted by ranges; a running sum of bytes within each (conversation, range) and the bytes
    of the ranges before give each turn its place, so no task needs a whole conversation.
    """
    order = ["conv", "turn", "role", "text"]
    # equal rows would share a range; the number tells them apart
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    ranged = staged(ranged.select("conv", "role", "text", size.cast("bigint").alias("bytes"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")), "chat-ranges")
    sums = ranged.groupBy("conv", "range").agg(F.sum("bytes").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("conv").alias("c"), F.col("range").alias("r"), before.alias("base"))
    here = Window.partitionBy("conv", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("passed", F.coalesce(F.sum("bytes").over(here), F.lit(0)))
    placed = running.join(base, F.col("conv").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    piece = F.floor((F.col("base") + F.col("passed")) / F.lit(piece_bytes)).cast("bigint")
    return staged(placed.select("conv", piece.alias("piece"), "place", "role", "text"), "chat-pieces")


def _mended(pieces: DataFrame, kind: str) -> DataFrame:
    """The repaired pieces, joined again."""

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        held = pa.array([product(_codes(table["role"])).reshape(-1).tolist()], pa.list_(pa.float64()))
        return pa.table([table["conv"].slice(0, 1), table["piece"].slice(0, 1), held], ["conv", "piece", "matrix"])

    def ends(table: pa.Table) -> pa.Table:
        """Per piece the costs of the states before it and after it; null after the last."""
        table = table.sort_by("piece")
        every = np.array(table["matrix"].to_pylist()).reshape(-1, 4, 4)
        to_go = [END]
        for m in every[:0:-1]:
            to_go.append((m + to_go[-1][None, :]).min(axis=1))
        state, begin, after = START, [], []
        for m, rest in zip(every[:-1], to_go[:0:-1], strict=True):
            begin.append(state.tolist())
            best = int(((state[:, None] + m).min(axis=0) + rest).argmin())
            state = np.full(4, _INF)
            state[best] = 0.0
            after.append(state.tolist())
        begin.append(state.tolist())
        lists = pa.list_(pa.float64())
        return pa.table([table["conv"], table["piece"], pa.array(begin, lists), pa.array([*after, None], lists)], ["conv", "piece", "begin", "after"])

    def mend(table: pa.Table, around: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        begin, after = around["begin"][0].as_py(), around["after"][0].as_py()
        return _row(table["conv"], table["piece"][0].as_py(), _codes(table["role"]), table["text"].to_pylist(), np.array(begin), None if after is None else np.array(after))

    matrices = pieces.select("conv", "piece", "place", "role").groupBy("conv", "piece").applyInArrow(matrix, f"conv {kind}, piece bigint, matrix array<double>")
    around = matrices.groupBy("conv").applyInArrow(ends, f"conv {kind}, piece bigint, begin array<double>, after array<double>")
    mended = pieces.groupBy("conv", "piece").cogroup(around.groupBy("conv", "piece")).applyInArrow(mend, f"conv {kind}, {_TYPES}")
    grouped = mended.groupBy("conv", F.floor(F.col("part") / F.lit(ROW_PIECES)).alias("row"))
    sums = [F.sum(c).cast("bigint").alias(c) for c in _RESULT[1:6]]
    text = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("part", "rendered"))), lambda x: x["rendered"]))
    return grouped.agg(*sums, F.sum("cost").alias("cost"), text.alias("rendered")).select("conv", F.col("row").cast("bigint").alias("part"), *_RESULT[1:])
