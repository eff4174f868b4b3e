r"""Chat formatting: roles recovered from plain transcripts by a hidden Markov model.

A transcript is text in which some lines name their speaker and others go on with the turn. Every line is in
one of six hidden states, a role (system, user, assistant) that begins or continues a turn. What is seen of
a line is its speaker marker (one of a role's names, or none), whether the line before is blank, its length
class, and whether it ends like a question. Viterbi gives the likeliest states, and the turns are rendered
in the canonical form

    <|role|>\n
    text\n
    <|end|>\n

Start, transition and emission probabilities are smoothed counts over labelled lines, gathered by Spark over
all transcripts with known roles (a few hundred sums come to the driver, whatever the input).

Transcripts are decoded in sections of at most ``SECTION`` turns, so no task holds a long conversation
whole; a section after the first starts from the states that follow a turn. A marker is only taken as one at
the start of a line, before ":" or in brackets or after "###".

Defined cases: a null or blank turn is a turn with an empty line; null roles count as "user"; unknown roles
as "user"; rows equal in (conversation, turn, role, text) are one turn; different rows with the same turn
number follow each other by role and text; null conversation ids form a conversation of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ["system", "user", "assistant"]
SECTION = 512
NAMES = {
    "system": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "question": "user", "q": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "answer": "assistant", "a": "assistant",
}
_MARKER = re.compile(r"^[ \t]*(?:#{2,4}[ \t]*|\[|\*\*)?([A-Za-z]{1,12})(?:\][ \t]*:?|\*\*[ \t]*:?|:\*\*|[ \t]*:)[ \t]*")
_HEADING = re.compile(r"^[ \t]*#{2,4}[ \t]*([A-Za-z]{1,12})[ \t]*:?[ \t]*$")
_LENGTHS = [1, 40, 160, 640]
N_STATES = 2 * len(ROLES)
N_SEEN = (len(ROLES) + 1) * 2 * (len(_LENGTHS) + 1) * 2
_SUMS = N_STATES + N_STATES * N_STATES + N_STATES * N_SEEN


def marker(line: str) -> tuple[str | None, str]:
    """The role that a line names, and the line without the marker."""
    for pattern in (_HEADING, _MARKER):
        m = pattern.match(line)
        if m and m[1].lower() in NAMES:
            return NAMES[m[1].lower()], line[m.end() :]
    return None, line


def observe(lines: list[str]) -> np.ndarray:
    """What is seen of each line, as one number."""
    seen, blank = [], True
    for line in lines:
        role, rest = marker(line)
        size = int(np.searchsorted(_LENGTHS, len(rest.strip()), side="right"))
        kind = ROLES.index(role) + 1 if role else 0
        seen.append(((kind * 2 + blank) * (len(_LENGTHS) + 1) + size) * 2 + rest.rstrip().endswith("?"))
        blank = not line.strip()
    return np.array(seen, np.int64)


def counts(states: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Start, transition and emission counts of one labelled transcript, in one vector."""
    out = np.zeros(_SUMS)
    if len(states):
        out[states[0]] += 1
        np.add.at(out, N_STATES + states[:-1] * N_STATES + states[1:], 1)
        np.add.at(out, N_STATES + N_STATES * N_STATES + states * N_SEEN + seen, 1)
    return out


class RoleModel:
    """Logarithms of the model's probabilities, from summed counts."""

    def __init__(self, sums: np.ndarray, smoothing: float = 0.5):
        def share(x):
            return np.log((x + smoothing) / (x + smoothing).sum(axis=-1, keepdims=True))

        self.start = share(sums[:N_STATES])
        self.step = share(sums[N_STATES : N_STATES + N_STATES * N_STATES].reshape(N_STATES, N_STATES))
        # Markers are told apart from the rest of a line, so that rare combinations are not lost.
        emitted = sums[N_STATES + N_STATES * N_STATES :].reshape(N_STATES, len(ROLES) + 1, -1)
        of_marker, of_rest = share(emitted.sum(axis=2)), share(emitted.sum(axis=1))
        self.emit = (of_marker[:, :, None] + of_rest[:, None, :]).reshape(N_STATES, N_SEEN)
        self.start[1::2] = -np.inf  # a transcript does not begin inside a turn
        for a in range(N_STATES):
            for b in range(1, N_STATES, 2):
                if a // 2 != b // 2:
                    self.step[a, b] = -np.inf  # only a turn's own role continues it

    def viterbi(self, seen: np.ndarray) -> np.ndarray:
        if not len(seen):
            return np.zeros(0, np.int64)
        score, back = self.start + self.emit[:, seen[0]], np.zeros((len(seen), N_STATES), np.int64)
        for t in range(1, len(seen)):
            ways = score[:, None] + self.step
            back[t] = ways.argmax(axis=0)
            score = ways.max(axis=0) + self.emit[:, seen[t]]
        path = np.empty(len(seen), np.int64)
        path[-1] = score.argmax()
        for t in range(len(seen) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def parse(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) turns of a transcript."""
        lines = transcript.split("\n")
        turns: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.viterbi(observe(lines)).tolist()):
            if state % 2 == 0:
                turns.append((ROLES[state // 2], []))
            turns[-1][1].append(marker(line)[1] if state % 2 == 0 else line)
        return [(role, "\n".join(body).strip()) for role, body in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def sections(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, section, turns): each section's (role, text) in order; SECTION turns and their repeats at most."""
    known = F.lower(F.trim(F.col(role)))
    own = turns.select(
        F.col(conv),
        F.col(turn).cast("long").alias("_turn"),
        F.when(known.isin(ROLES), known).otherwise("user").alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).distinct()
    listed = own.groupBy(conv, F.expr(f"coalesce(_turn div {SECTION}, -1)").alias("section")).agg(
        F.sort_array(F.collect_list(F.struct("_turn", "role", "text"))).alias("turns")
    )
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


_STYLES = [
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions:\n", "user": "### Human:\n", "assistant": "### Assistant:\n"},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "**System:** ", "user": "**Human:** ", "assistant": "**AI:** "},
]


def transcript_of(turns: list[tuple[str, str]], style: int) -> tuple[str, np.ndarray]:
    """A transcript in one of the styles and the true state of each line; even styles part turns by a blank
    line, and every third turn of a conversation in styles past the first five goes without its marker."""
    lines, states = [], []
    for i, (role, text) in enumerate(turns):
        bare = style >= len(_STYLES) and i % 3 == 2
        body = ("" if bare else _STYLES[style % len(_STYLES)][role]) + text
        own = body.split("\n")
        if i and (style % 2 == 0 or bare):
            lines.append("")
            states.append(states[-1] | 1)
        lines += own
        states += [2 * ROLES.index(role)] + [2 * ROLES.index(role) + 1] * (len(own) - 1)
    return "\n".join(lines), np.array(states, np.int64)


def _style(key: int) -> int:
    return key % (2 * len(_STYLES))


def _turn_lists(column: pa.Array) -> list[list[tuple[str, str]]]:
    return [[(t["role"], t["text"]) for t in turns or ()] for turns in column.to_pylist()]


def learn(sectioned: DataFrame, conv: str = "conv_id") -> RoleModel:
    """A model from the transcripts of all sections whose roles are known."""
    keyed = sectioned.select(F.pmod(F.xxhash64(conv), F.lit(1 << 20)).alias("key"), "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SUMS)
        for batch in batches:
            for key, turns in zip(batch.column(0).to_pylist(), _turn_lists(batch.column(1))):
                transcript, states = transcript_of(turns, _style(key))
                total += counts(states, observe(transcript.split("\n")))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    sums = np.zeros(_SUMS)
    for slot, n in keyed.mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n")).collect():
        sums[slot] = n
    return RoleModel(sums)


def format_sections(sectioned: DataFrame, model: RoleModel, conv: str = "conv_id") -> DataFrame:
    """(conv, section, n_turns, n_right, rendered): each section written out as a plain transcript, parsed
    again and rendered; ``n_right`` turns have the role and text of the table at their place."""
    keyed = sectioned.select(conv, "section", F.pmod(F.xxhash64(conv), F.lit(1 << 20)).alias("key"), "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, right, rendered = [], [], []
            for key, turns in zip(batch.column(2).to_pylist(), _turn_lists(batch.column(3))):
                found = model.parse(transcript_of(turns, _style(key))[0])
                sizes.append(len(found))
                right.append(sum(a == (role, text.strip()) for a, (role, text) in zip(found, turns)))
                rendered.append(render(found))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(right, pa.int64()), pa.array(rendered, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[conv, "section", "n_turns", "n_right", "rendered"])

    kind = sectioned.schema[conv].dataType.simpleString()
    return keyed.mapInArrow(run, f"{conv} {kind}, section long, n_turns long, n_right long, rendered string")


def parse_transcripts(docs: DataFrame, model: RoleModel, id_col: str, text: str = "text") -> DataFrame:
    """(id, turns, rendered) of transcripts as they are found, one per row."""
    own = docs.select(F.col(id_col), F.col(text).cast("string").alias("_text"))
    kind = own.schema[id_col].dataType.simpleString()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [model.parse(t.as_py() or "") for t in batch.column(1)]
            turns = pa.array([[{"role": r, "text": x} for r, x in p] for p in parsed], turn)
            columns = [batch.column(0), turns, pa.array([render(p) for p in parsed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "turns", "rendered"])

    return own.mapInArrow(run, f"{id_col} {kind}, turns array<struct<role string, text string>>, rendered string")
