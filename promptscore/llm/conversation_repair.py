"""Conversation structure repair: the cheapest edits that give a conversation the shape ``(s?(ua)+)?``.

Rows are first damaged as a test harness would (``damaged``), all in DataFrame functions: by
``crc32("conv_id:turn") % 20`` a row is dropped (0), emptied (1), loses its ``.!?`` (2), is repeated with the
same turn (3) or becomes a user row (4). A null conv_id, turn, role or text is one space wherever it is used
as text, so a null text is blank and a null role has the initial " ". An empty role has no initial, fits no
place of the shape and makes both its adjacent pairs illegal.

Each conversation's rows, by turn (nulls first, then role and text), are judged: a row's first fault of
blank (only ASCII white space), duplicate (its role and text came earlier) and truncated (its last
non-space character is not one of ``.!?``) counts. ``illegal`` counts adjacent rows whose role initials are
not ``su``, ``ua`` or ``au``; ``gaps`` is ``max - min + 1 - distinct`` over the non-null turns.

Repair is a shortest path over nodes (row position, state of the shape automaton: start, after s, after u,
after a) with edits Keep 0, Rerole to user/assistant 1, Delete 2 (blank and duplicate rows must be deleted),
Insert an empty user/assistant row 5, and 5 more for every truncated row that is not deleted:

1. Cost DP: the cheapest cost to the end from every node, backwards over the rows.
2. Prefix-doubling path ranking: every node points along its least optimal arc (letters D < I < K < R; a
   letter leads from a node to one node only). Round k ranks all nodes by the audit string of length 2^k
   that starts there, from the pairs (rank, rank of the node 2^(k-1) ahead), and doubles the pointers. The
   ranks order the nodes by their least optimal continuation; the doubled pointers pick out the nodes of the
   start's path and their positions without walking it. The nodes of all conversations of an Arrow batch are
   ranked in one pass.

Result per original conv_id (null is a conversation too): gaps, blank, duplicate, truncated, illegal, cost,
audit (edit initials, ASCII-least among the cheapest) and repaired_sha256 (SHA-256 of the repaired
``role:text`` rows joined by newlines; an empty repair is the hash of the empty string). A conversation
without rows after damage gives zeros, an empty audit and the empty string's hash. Extra columns are
ignored. Rows are hashed to tasks by conv_id and sorted there; a task reads its sorted rows batch by batch
and repairs each conversation as it ends. One conversation is in one task: the hash of its whole repair
needs all its rows in order in one place.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_INF = 1 << 60
# states: 0 start, 1 after s, 2 after u, 3 after a; accepting: 0 and 3
_EMIT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEW_ROLE = {0: "u", 1: "u", 2: "a", 3: "u"}  # the role a rerole or an insert gives in each state
_LETTERS = "DIKR"  # in ASCII order
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows after damage; ``present`` is false for a dropped row, which
    is kept only so that its conversation is not lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key) % 20).alias("fate"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit(""))
        .when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("fate") != 0).alias("present"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def faults(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        marks = text.rstrip(_WHITE)
        if not marks:
            out.append(_BLANK)
        elif (role, text) in seen:
            out.append(_DUPLICATE)
        elif marks[-1] not in ".!?":
            out.append(_TRUNCATED)
        else:
            out.append(0)
        seen.add((role, text))
    return out


def _arcs(initials: list[str], fault: list[int], node: int, n: int):
    """(letter, target, cost) of the arcs leaving ``node`` = 4 * position + state."""
    i, state = divmod(node, 4)
    out = [("I", 4 * i + _EMIT[(state, _NEW_ROLE[state])], INSERT)]
    if i < n:
        extra = TRUNCATED if fault[i] == _TRUNCATED else 0
        out.append(("D", 4 * (i + 1) + state, DELETE))
        if fault[i] not in (_BLANK, _DUPLICATE):
            if (state, initials[i]) in _EMIT:
                out.append(("K", 4 * (i + 1) + _EMIT[(state, initials[i])], KEEP + extra))
            out.append(("R", 4 * (i + 1) + _EMIT[(state, _NEW_ROLE[state])], REROLE + extra))
    return out


def optimal_arcs(initials: list[str], fault: list[int]) -> tuple[int, list[list[tuple]]]:
    """Cost DP: (cheapest cost, the optimal arcs of every node), backwards over the rows; inserts stay in a
    row, so they are relaxed a few times there. The two end nodes get no arcs (their continuation is empty)."""
    n = len(initials)
    nodes = 4 * (n + 1)
    dist = [_INF] * nodes
    dist[4 * n] = dist[4 * n + 3] = 0
    arcs = [_arcs(initials, fault, v, n) for v in range(nodes)]
    for i in range(n, -1, -1):
        low = 4 * (i + 1)
        for v in range(4 * i, 4 * i + 4):
            dist[v] = min([dist[v], *[c + dist[w] for _, w, c in arcs[v] if w >= low]])
        for _ in range(4):
            for v in range(4 * i, 4 * i + 4):
                dist[v] = min([dist[v], *[c + dist[w] for _, w, c in arcs[v] if w < low]])
    optimal = [[a for a in arcs[v] if a[2] + dist[a[1]] == dist[v]] for v in range(nodes)]
    optimal[4 * n] = optimal[4 * n + 3] = []
    return dist[0], optimal


def least_paths(graphs: list[list[list[tuple]]]) -> list[list[tuple[str, int]]]:
    """Prefix-doubling path ranking over the nodes of many conversations at once.

    Every node points along its least optimal arc, by letter and then by the rank of its target; a node
    without arcs points at its conversation's sink. Round k ranks all nodes by the pair (rank, rank of the
    node 2^(k-1) ahead), that is by their audit strings of length 2^k, and doubles the pointers. The doubled
    pointers then mark the nodes on each start's path, and steps to the sink give their order.
    Returns, per conversation, the path as (letter, node) pairs.
    """
    offsets, total = [], 0
    for optimal in graphs:
        offsets.append(total)
        total += len(optimal) + 1  # the last node of each conversation is its sink
    targets = [[(w + base, letter) for letter, w, _ in arcs] for optimal, base in zip(graphs, offsets) for arcs in (*optimal, [])]
    sinks = np.repeat(np.array(offsets) + np.array([len(o) for o in graphs]), [len(o) + 1 for o in graphs])
    by_letter = all(len({letter for _, letter in t}) == len(t) for t in targets)
    rank, chosen = np.zeros(total + 1, np.int64), None
    while True:
        pointer, letter = sinks.copy(), np.zeros(total, np.int64)  # letter 0: the empty continuation
        for v, t in enumerate(targets):
            if t:
                w, code = min(t, key=lambda a: (_LETTERS.index(a[1]), rank[a[0]]))
                pointer[v], letter[v] = w, 1 + _LETTERS.index(code)
        rank, ahead, steps = letter.copy(), pointer.copy(), (letter > 0).astype(np.int64)
        jumps = [pointer.copy()]
        for _ in range(int(np.ceil(np.log2(2 * max(map(len, graphs), default=1) + 2))) + 1):
            rank = np.unique(rank * (rank.max() + 1) + rank[ahead], return_inverse=True)[1].astype(np.int64)
            steps = steps + steps[ahead]
            ahead = ahead[ahead]
            jumps.append(ahead)
        if by_letter or (chosen is not None and np.array_equal(pointer, chosen)):
            break
        chosen = pointer
    starts = np.array(offsets, np.int64)
    on_path = np.zeros(total, bool)
    on_path[starts] = True
    for jump in reversed(jumps[:-1]):  # every offset from a start is a sum of distinct powers of two
        on_path[jump[on_path]] = True
    owner = np.repeat(np.arange(len(graphs)), [len(o) + 1 for o in graphs])
    path = np.flatnonzero(on_path & (letter > 0))
    path = path[np.lexsort((steps[starts[owner[path]]] - steps[path], owner[path]))]
    out = [[] for _ in graphs]
    for v in path.tolist():
        c = owner[v]
        out[c].append((_LETTERS[letter[v] - 1], v - offsets[c]))
    return out


def repair_paths(conversations: list[tuple[list[str], list[int]]]) -> list[tuple[int, str, list[tuple[str, int, str]]]]:
    """(cost, audit, [(letter, row position or -1 for an insert, new role initial)]) of the least cheapest repair
    of each (initials, faults)."""
    solved = [optimal_arcs(initials, fault) for initials, fault in conversations]
    paths = least_paths([optimal for _, optimal in solved])
    out = []
    for (initials, _), (cost, _), path in zip(conversations, solved, paths):
        edits = []
        for code, v in path:
            i, state = divmod(v, 4)
            edits.append((code, i if code != "I" else -1, initials[i] if code == "K" else _NEW_ROLE[state]))
        out.append((cost, "".join(e[0] for e in edits), edits))
    return out


def repair_path(initials: list[str], fault: list[int]) -> tuple[int, str, list[tuple[str, int, str]]]:
    return repair_paths([(initials, fault)])[0]


def _illegal(initials: list[str]) -> int:
    return sum(1 for a, b in zip(initials, initials[1:]) if a + b not in ("su", "ua", "au"))


def _rows(conv_id, turns: list, roles: list[str], texts: list[str], present: list[bool]) -> tuple:
    """The judged rows of one conversation (dropped rows left out) and its counts."""
    kept = [i for i, p in enumerate(present) if p]
    roles, texts, turns = [roles[i] for i in kept], [texts[i] for i in kept], [turns[i] for i in kept if turns[i] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r in roles]
    fault = faults(roles, texts)
    counts = [fault.count(k) for k in (_BLANK, _DUPLICATE, _TRUNCATED)]
    return (conv_id, gaps, *counts, _illegal(initials)), roles, texts, initials, fault


def _results(conversations: list[tuple]) -> list[tuple]:
    """Result rows of several conversations, their paths ranked together."""
    judged = [_rows(*c) for c in conversations]
    repairs = repair_paths([(initials, fault) for _, _, _, initials, fault in judged])
    names = {"u": "user", "a": "assistant"}
    out = []
    for (head, roles, texts, _, _), (cost, audit, edits) in zip(judged, repairs):
        lines = []
        for code, i, new in edits:
            if code == "K":
                lines.append(f"{roles[i]}:{texts[i]}")
            elif code == "R":
                lines.append(f"{names[new]}:{texts[i]}")
            elif code == "I":
                lines.append(f"{names[new]}:")
        digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((*head, cost, audit, digest))
    return out


_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.string()]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of the sorted rows of a partition; a conversation may run over several batches."""
    current, rows = None, None
    for batch in batches:
        done = []
        for conv_id, turn, role, text, present in zip(*[c.to_pylist() for c in batch.columns]):
            if rows is None or conv_id != current:
                if rows is not None:
                    done.append((current, *rows))
                current, rows = conv_id, ([], [], [], [])
            for column, value in zip(rows, (turn, role, text, present)):
                column.append(value)
        if done:
            yield _batch(_results(done))
    if rows is not None:
        yield _batch(_results([(current, *rows)]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id, see the module's text."""
    rows = damaged(conversations).repartition("conv_id")
    ordered = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "turn", "role", "text", "present").mapInArrow(_conversations, _OUT)
