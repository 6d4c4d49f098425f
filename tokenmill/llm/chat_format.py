"""Chat formatting by minimum-cost role repair (operator 1).

A legal conversation is: an optional system message, then user and assistant
messages in turn, user first, assistant last. Each input turn either becomes a
message of its own or is merged into the message before it, under its own role
or relabelled, and empty messages may be inserted before it or at the end.
Every act has a cost; dynamic programming over the automaton of legal turns
finds the cheapest repair, and the repaired sequence is rendered.

The step of one turn is a small (min, +) matrix over the automaton's states, so
parts of a conversation combine associatively. Turns are sorted by range over
(conversation, turn, place) into blocks of about ``block_rows`` narrow rows
(no texts); only the at most two conversations at a block's ends hand a matrix
each to the task that chains them, one short row per block. A conversation with a third of all rows is thus many blocks, in no single task.
The rendered form is one fragment per input turn; a conversation's fragments,
in order, are its rendered text.

Defined results: a null text is empty; a null or unknown role must be
relabelled, at the cost of a relabel; null conversation ids are one
conversation; null turns come first; repeated (conversation, turn) rows all
count, in the order of their place in the files; ties go to appending before
merging, then to the earlier state; an empty table gives no rows; other
columns stay, columns with the result's names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import landed, numbered, private, table, text_or_empty
from tokenmill.session import ship_code

# Costs of the acts, and the template's marks.
MERGE, RELABEL, INSERT = 1, 4, 2
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK_ROWS = 100_000

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
# messages to insert between a state and the next role for the sequence to be legal; no entry: no way
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
FAR = 1 << 40


def _acts(role: int) -> np.ndarray:
    """``[4, 4, 2]``: cost of going from a state to a state by one turn of that
    role (0: unknown), and 1 if the cheapest act is a merge."""
    out = np.zeros((4, 4, 2), np.int64)
    out[:, :, 0] = FAR
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            change = 0 if t == role else RELABEL
            if (s, t) in BETWEEN:
                out[s, t] = len(BETWEEN[s, t]) * INSERT + change, 0
            if s == t and MERGE + change < out[s, t, 0]:
                out[s, t] = MERGE + change, 1
    return out


_STEP = np.stack([_acts(r) for r in range(4)])
_ENDING = np.array([len(CLOSING[s]) * INSERT for s in range(4)])


def role_number(role: pd.Series) -> np.ndarray:
    return role.map({r: k + 1 for k, r in enumerate(ROLES)}).fillna(0).to_numpy(np.int64)


def _forward(roles: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the states behind the turns, and each turn's best previous states."""
    back = np.zeros((len(roles), 4), np.int8)
    for k, r in enumerate(roles):
        reach = costs[:, None] + _STEP[r, :, :, 0]
        back[k] = reach.argmin(0)
        costs = np.minimum(reach.min(0), FAR)
    return costs, back


def _path(back: np.ndarray, last: int) -> np.ndarray:
    states = np.zeros(len(back) + 1, np.int64)
    states[-1] = last
    for k in range(len(back) - 1, -1, -1):
        states[k] = back[k, states[k + 1]]
    return states


def _only(state: int) -> np.ndarray:
    costs = np.full(4, FAR, np.int64)
    costs[state] = 0
    return costs


def _segments(part: pd.DataFrame):
    """Ranges of the rows of one conversation, in order."""
    conv = part["conv"].to_numpy(object)
    edge = [k for k in range(1, len(conv)) if conv[k] != conv[k - 1]]
    return list(zip([0, *edge], [*edge, len(conv)], strict=True))


_ENDS = "block int, last boolean, conv string, m array<long>"
_AT_ENDS = "block int, last boolean, before int, after int, ends boolean"
_REPAIRED = "f long, i long, before int, after int, merged boolean, closing boolean"


def _ends(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """The matrices of a block's first and last conversations (once if it has only one)."""
    part = part.sort_values("pos")
    seg = _segments(part)
    rows = []
    for k in sorted({0, len(seg) - 1}):
        a, b = seg[k]
        roles = part["role"].to_numpy(np.int64)[a:b]
        m = [int(c) for s in range(4) for c in _forward(roles, _only(s))[0]]
        rows.append((key[0], k == len(seg) - 1, part["conv"].iloc[a], m))
    return pd.DataFrame(rows, columns=["block", "last", "conv", "m"])


def _chained(part: pd.DataFrame) -> pd.DataFrame:
    """The block ends of one conversation: state before, state behind, and whether it ends there."""
    part = part.sort_values("block")
    costs, steps = _only(START), []
    for m in part["m"]:
        reach = costs[:, None] + np.array(m).reshape(4, 4)
        steps.append(reach.argmin(0))
        costs = np.minimum(reach.min(0), FAR)
    states = [int((costs + _ENDING).argmin())]
    for step in reversed(steps):
        states.append(int(step[states[-1]]))
    states.reverse()
    return pd.DataFrame({"block": part["block"], "last": part["last"], "before": states[:-1], "after": states[1:],
                         "ends": [False] * (len(part) - 1) + [True]})


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``turns`` with ``role_out``, ``action``, ``n_inserted``, ``cost`` and ``rendered``."""
    ship_code(turns.sparkSession)
    row, step = private(turns, "_row"), private(turns, "_step")
    rows = numbered(turns, row)
    known = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(role))
    narrow = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("conv"),
                         F.col(turn).alias("turn"), F.col(row)["f"].alias("f"), F.col(row)["i"].alias("i"),
                         F.coalesce(known, F.lit(0)).cast("int").alias("role"))
    blocks = max(1, math.ceil(narrow.count() / block_rows))
    order = ["conv", F.col("turn").asc_nulls_first(), "f", "i"]
    dealt = narrow.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    dealt = landed(dealt.withColumn("block", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
                   .drop("turn"), "turns")
    # one short row per block that a conversation reaches into
    at_ends = dealt.groupBy("block").applyInPandas(_ends, _ENDS).groupBy("conv").applyInPandas(_chained, _AT_ENDS)
    acts = dealt.groupBy("block").cogroup(at_ends.groupBy("block")).applyInPandas(_solved, _REPAIRED) \
        .select(F.struct("f", "i").alias(row), F.struct("before", "after", "merged", "closing").alias(step))
    got = rows.drop("role_out", "action", "n_inserted", "cost", "rendered").join(acts, row)
    return _rendered(got, role, text, F.col(step)).drop(row, step)


def _solved(part: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """Each turn's step; a block's first and last conversations start and end as ``ends`` says."""
    at_ends = {bool(e.last): (int(e.before), int(e.after), bool(e.ends)) for e in ends.itertuples()}
    part = part.sort_values("pos")
    roles = part["role"].to_numpy(np.int64)
    before, after = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    closing = np.zeros(len(part), bool)
    seg = _segments(part)
    for k, (a, b) in enumerate(seg):
        if 0 < k < len(seg) - 1:
            costs, back = _forward(roles[a:b], _only(START))
            last, closed = int((costs + _ENDING).argmin()), True
        else:
            first, last, closed = at_ends[k == len(seg) - 1]
            _, back = _forward(roles[a:b], _only(first))
        states = _path(back, last)
        before[a:b], after[a:b] = states[:-1], states[1:]
        closing[b - 1] = closed
    merged = _STEP[roles, before, after, 1].astype(bool)
    return pd.DataFrame({"f": part["f"], "i": part["i"], "before": before, "after": after, "merged": merged,
                         "closing": closing})


def _empty(roles) -> str:
    return "".join(f"{OPEN}{ROLES[r - 1]}\n{CLOSE}" for r in roles)


def _by_states(step, table_of: dict, default):
    """A literal by (state before, state behind)."""
    out = F.lit(default)
    for (s, t), v in table_of.items():
        out = F.when((step["before"] == s) & (step["after"] == t), F.lit(v)).otherwise(out)
    return out


def _rendered(df: DataFrame, role: str, text: str, step) -> DataFrame:
    inserted = F.when(step["merged"], "").otherwise(_by_states(step, {k: _empty(v) for k, v in BETWEEN.items() if v}, ""))
    count = F.when(step["merged"], 0).otherwise(_by_states(step, {k: len(v) for k, v in BETWEEN.items() if v}, 0))
    tail = F.lit("")
    tail_count = F.lit(0)
    for s, v in CLOSING.items():
        here = step["closing"] & (step["after"] == s)
        tail = F.when(here, F.lit(CLOSE + _empty(v))).otherwise(tail)
        tail_count = F.when(here, F.lit(len(v))).otherwise(tail_count)
    out = F.element_at(F.array(*[F.lit(r) for r in ROLES]), step["after"])
    relabelled = ~F.coalesce(F.col(role) == out, F.lit(False))
    # a message is closed by the turn that opens the next one, or at the conversation's end
    head = F.when(step["merged"], "\n").otherwise(F.concat(
        F.when(step["before"] == START, "").otherwise(CLOSE), inserted, F.lit(OPEN), out, F.lit("\n")))
    return df.withColumns({
        "role_out": out,
        "action": F.concat(F.when(step["merged"], "merge").otherwise("append"), F.when(relabelled, "+relabel").otherwise("")),
        "n_inserted": (count + tail_count).cast("long"),
        "cost": (F.when(step["merged"], MERGE).otherwise(0) + F.when(relabelled, RELABEL).otherwise(0)
                 + (count + tail_count) * INSERT).cast("long"),
        "rendered": F.concat(head, text_or_empty(text), tail),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))
