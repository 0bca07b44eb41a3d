"""Chat repair against a search over whole role sequences, ids that look alike, and benchmark items that share a shingle."""

import itertools
import time

from quarry.llm import chat_format, decontaminate
from quarry.llm.shared import WordHashes

KNOWN = ["user", "assistant", "system"]


def least_by_sequences(roles):
    """The least cost over all legal sequences of up to a few turns and all ways to lay the given turns on them, written from the rules:
    system may stand first alone, then user and assistant alternate, the last is assistant."""
    best = float("inf")
    legal = [seq for n in range(2, 2 * len(roles) + 3) for lead in ((), ("system",)) for seq in [lead + tuple(itertools.islice(itertools.cycle(("user", "assistant")), n))] if n % 2 == 0]
    for seq in legal:
        # cost[i][j]: the first i turns stand on the first j places; each place holds one turn or more, or is inserted.
        cost = {(0, 0): 0.0}
        for i in range(len(roles) + 1):
            for j in range(len(seq) + 1):
                options = [cost[i, j]] if (i, j) in cost else []
                if j and (i, j - 1) in cost:
                    options.append(cost[i, j - 1] + chat_format.INSERT)
                if i and j:
                    options += [cost[i - 1, k] + c for k, c in ((j - 1, lay(roles[i - 1], seq[j - 1], False)), (j, lay(roles[i - 1], seq[j - 1], True))) if (i - 1, k) in cost and c is not None and (k < j or i > 1)]
                if options:
                    cost[i, j] = min(options)
        best = min(best, cost.get((len(roles), len(seq)), best))
    return best


def lay(role, place, merged):
    for s, t, c, action, new in chat_format.steps(role):
        if chat_format.ROLES[t] == place and not len(new) and (action == "merge") == merged and (not merged or s == t):
            return c
    return None


def test_null_and_empty_ids_are_different_conversations(spark):
    rows = [(None, 1, "user", "a"), ("", 1, "user", "b"), (None, 2, "assistant", "c"), ("", 2, "assistant", "d"), ("x", 1, "user", "e")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    text = {}
    for r in sorted(out, key=lambda r: (str(r.conv_id), r.turn is None, r.turn or 0, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert len(text) == 3 and "a" in text[None] and "b" not in text[None] and "d" in text[""] and text[None].endswith("<|end|>\n") and text[""].endswith("<|end|>\n")


def test_repairs_cost_the_least_of_all_sequences():
    for n in range(1, 5):
        for roles in itertools.product(KNOWN, repeat=n):
            known = chat_format.Steps()
            m = chat_format.matrix(list(roles), known)
            mine = min(m[4 * chat_format.NONE + t] + chat_format.INSERT * len(chat_format.END[t]) for t in range(4))
            assert abs(mine - least_by_sequences(list(roles))) < 1e-9, roles


def test_items_that_share_a_shingle_take_little_time():
    shared = "answer the following question with one word please"
    items = decontaminate.Items(list(range(4096)), [f"{shared} " + " ".join(f"w{i}x{k}" for k in range(12)) for i in range(4096)], 5, 15)
    cache, took = WordHashes(), time.perf_counter()
    assert list(items.found(f"well {shared} and so on " + "some more words " * 20, 0.8, cache)) == []
    assert time.perf_counter() - took < 0.5
    assert [x[0] for x in items.found(f"{shared} " + " ".join(f"w7x{k}" for k in range(12)), 0.8, cache)] == [7]
