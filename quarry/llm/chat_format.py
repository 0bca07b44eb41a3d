"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton, then rendering.

Legal conversations: an optional system turn, then user and assistant in turn, ending with assistant.  For each turn of the input the
repair chooses to keep its role or relabel it, to open a new turn or merge it into the one before, and to put empty turns before it; at
the end empty turns may complete the conversation.  The choices of least total cost win; ties go to the option listed first.

Costs are min-plus matrices over four states, and matrices of neighbouring segments multiply.  The table is dealt into ranges of
(conv_id, turn), so a conversation of any length is spread over many ranges; only the products of ranges that one conversation
spans meet in one place, sixteen numbers each.

Returns a row per turn and inserted turn: conv_id, turn, part (inserted turns come before their turn: 0, 1, ...; those at the end have turn
null), role, action (keep, relabel, merge, insert), text, rendered.  A conversation's rendered pieces in order (turn nulls last, part) are
its formatted text.  Null roles and unknown ones are relabelled at a lower cost; null texts are empty; null turns come first;
turns with equal numbers are ordered by role and text; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, table

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = [None, "system", "user", "assistant"]
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
END = {NONE: (), ASSISTANT: (), USER: (ASSISTANT,), SYSTEM: (USER, ASSISTANT)}
#: Turns and bytes of text in a range, about.
CHUNK, CHUNK_BYTES = 20_000, 64 << 20


def steps(role: str | None) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """(from, to, cost, action, inserted) that a turn of this role allows."""
    own = ALIASES.get((role or "").strip().lower())
    out = []
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            cost = 0.0 if own == t else RELABEL_UNKNOWN if own is None else RELABEL
            if t in NEXT[s]:
                out.append((s, t, cost, "keep" if own == t else "relabel", ()))
            if s == t:
                out.append((s, t, cost + MERGE, "merge", ()))
            for m in NEXT[s]:
                if t in NEXT[m]:
                    out.append((s, t, cost + INSERT, "keep" if own == t else "relabel", (m,)))
    return out


class Steps(dict):
    def __missing__(self, role):
        self[role] = steps(role)
        return self[role]


def forward(roles: list, start: list[float], known: Steps) -> list[list[float]]:
    """Least costs of each state before the first and after every turn."""
    out = [start]
    for r in roles:
        now = [math.inf] * 4
        for s, t, c, _, _ in known[r]:
            now[t] = min(now[t], out[-1][s] + c)
        out.append(now)
    return out


def matrix(roles: list, known: Steps) -> list[float]:
    """Least costs from each state to each, row by row."""
    return [x for s in range(4) for x in forward(roles, [0.0 if k == s else math.inf for k in range(4)], known)[-1]]


def repaired(roles: list, known: Steps, enter: int = NONE, leave: int | None = None) -> tuple[list[tuple[int, int, str, tuple]], int]:
    """The chosen (from, to, action, inserted) of each turn, and the last state."""
    cost = forward(roles, [0.0 if k == enter else math.inf for k in range(4)], known)
    if leave is None:
        leave = min(range(4), key=lambda s: cost[-1][s] + INSERT * len(END[s]))
    out, state = [], leave
    for k in range(len(roles) - 1, -1, -1):
        s, t, _, action, new = next(x for x in known[roles[k]] if x[1] == state and cost[k][x[0]] + x[2] == cost[k + 1][state])
        out.append((s, t, action, new))
        state = s
    return out[::-1], leave


def dealt(conversations: DataFrame) -> DataFrame:
    """conv_id, turn (both as text, so that null and every number stay what they are), role, text in ranges of (conv_id, turn),
    numbered by chunk and ordered by place."""
    rows, size = conversations.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(rows / CHUNK), math.ceil(size / CHUNK_BYTES))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    own = conversations.select("conv_id", "turn", "role", "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    texts = [F.col(x).cast("string").alias(x) for x in ("conv_id", "turn")]
    return stored(own.select(*texts, "role", "text", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().alias("place")), "turns")


def format_chats(conversations: DataFrame) -> DataFrame:
    turns = dealt(conversations)

    def ends(own: pd.DataFrame) -> pd.DataFrame:
        # Only the first and the last conversation of a range can go on in another.
        known, rows = Steps(), []
        own = own.sort_values("place")
        chunk = int(own["chunk"].iloc[0])
        groups = list(own.groupby(_runs(own["conv_id"])))
        for _, g in {k: v for k, v in (groups[0], groups[-1])}.items():
            rows.append((g["conv_id"].iloc[0], chunk, matrix(g["role"].tolist(), known)))
        return pd.DataFrame(rows, columns=["conv_id", "chunk", "costs"])

    def joints(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("chunk")
        cost, back = [0.0, math.inf, math.inf, math.inf], []
        for m in own["costs"]:
            now = [min((cost[s] + m[4 * s + t], s) for s in range(4)) for t in range(4)]
            back.append([s for _, s in now])
            cost = [c for c, _ in now]
        state, rows = min(range(4), key=lambda s: cost[s] + INSERT * len(END[s])), []
        for chunk, b in zip(own["chunk"].tolist()[::-1], back[::-1], strict=True):
            rows.append((own["conv_id"].iloc[0], chunk, b[state], state, chunk == own["chunk"].max()))
            state = b[state]
        return pd.DataFrame(rows, columns=["conv_id", "chunk", "enter", "leave", "final"])

    parts = turns.groupBy("chunk").applyInPandas(ends, "conv_id string, chunk int, costs array<double>")
    parts = stored(parts, "chat-costs")
    many = parts.groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").selectExpr("conv_id as of")
    links = parts.join(many, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").groupBy("conv_id").applyInPandas(joints, "conv_id string, chunk int, enter int, leave int, final boolean")
    links = stored(links, "chat-joints").groupBy("chunk").agg(F.collect_list(F.struct("conv_id", "enter", "leave", "final")).alias("joints"))

    def write(own: pd.DataFrame) -> pd.DataFrame:
        known, rows = Steps(), []
        own = own.sort_values("place")
        at = {_value(x["conv_id"]): x for x in (own["joints"].iloc[0] if own["joints"].iloc[0] is not None else [])}
        for _, g in own.groupby(_runs(own["conv_id"])):
            conv = _value(g["conv_id"].iloc[0])
            j = at.get(conv)
            chosen, last = repaired(g["role"].tolist(), known, j["enter"] if j else NONE, j["leave"] if j else None)
            for turn, text, (s, t, action, new) in zip(g["turn"], g["text"], chosen, strict=True):
                turn, text = _value(turn), text or ""
                for k, m in enumerate(new):
                    rows.append((conv, turn, k, ROLES[m], "insert", "", opened(s, m, "")))
                s = new[-1] if new else s
                rows.append((conv, turn, len(new), ROLES[t], action, text, f"\n{text}" if action == "merge" else opened(s, t, text)))
            if not j or j["final"]:
                for k, m in enumerate(END[last]):
                    rows.append((conv, None, k, ROLES[m], "insert", "", opened(last if k == 0 else END[last][k - 1], m, "")))
                if rows:
                    rows[-1] = (*rows[-1][:-1], rows[-1][-1] + "<|end|>\n")
        return pd.DataFrame(rows, columns=["conv_id", "turn", "part", "role", "action", "text", "rendered"])

    schema = "conv_id string, turn string, part int, role string, action string, text string, rendered string"
    out = turns.join(links, "chunk", "left").groupBy("chunk").applyInPandas(write, schema)
    return out.withColumns({x: F.col(x).cast(conversations.schema[x].dataType) for x in ("conv_id", "turn")})


def _value(x) -> str | None:
    return None if x is None or x != x else x


def _runs(ids: pd.Series) -> pd.Series:
    """Numbers of the runs of equal ids; null is an id of its own."""
    own, none = ids.fillna(""), ids.isna()
    return ((own != own.shift()) | (none != none.shift())).cumsum()


def opened(before: int, role: int, text: str) -> str:
    return ("" if before == NONE else "<|end|>\n") + f"<|{ROLES[role]}|>\n{text}"


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
